"""Graph operators: assembly, neighbourhoods, closure, components, levels, propagation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.sources.scratch import materialise

# Weights of trust tiers and edge types, and the decay and threshold of impact.
TIER_WEIGHT = {"semantic": 1.0, "syntactic": 0.6, "dynamic": 1.0}
TYPE_WEIGHT = {
    "calls": 1.0, "http-call": 0.9, "db-read": 0.9, "db-write": 0.9, "queue": 0.9, "imports": 0.8, "env-read": 0.8, "env-set": 0.8,
    "packages": 0.8, "implements": 0.8, "uses": 0.7, "references": 0.6,
}
OTHER_TIER, OTHER_TYPE, DECAY, LEAST = 0.6, 0.5, 0.55, 0.2


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "semantic", 0).when(tier == "syntactic", 1).otherwise(2)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, type): best tier, evidence as sorted distinct ``path:line``."""
    tiers = F.element_at(F.array(F.lit("semantic"), F.lit("syntactic"), F.lit("dynamic")), F.min(tier_rank(F.col("tier"))) + 1)
    place = F.array_sort(F.collect_set(F.concat_ws(":", "path", F.col("line").cast("string"))))
    return edges.groupBy("src", "dst", "type").agg(tiers.alias("tier"), place.alias("evidence"))


def fan_in(edges: DataFrame) -> DataFrame:
    """Distinct neighbours of each node over undirected edges, self-loops left out."""
    both = edges.filter("src <> dst").select("src", "dst").union(edges.filter("src <> dst").select("dst", "src"))
    return both.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("fan_in"))


def closure(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """(seed, id, hops) reached from each seed along src -> dst; a seed itself only if in a cycle.

    Semi-naive: each round joins only the new pairs, and is materialised so that
    the lineage stays short. Rounds are as many as the longest shortest path.
    """
    step = edges.select("src", F.col("dst").alias("id")).distinct()
    seen = materialise(seeds.select("seed").join(step, F.col("seed") == F.col("src")).select("seed", "id", F.lit(1).alias("hops")).distinct(), "closure")
    front, hops = seen, 1
    while limit is None or hops < limit:
        hops += 1
        new = front.select("seed", F.col("id").alias("src")).join(step, "src").select("seed", "id").distinct().join(seen, ["seed", "id"], "left_anti")
        front = materialise(new.withColumn("hops", F.lit(hops)), "front")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops) within depth undirected hops, the start at 0."""
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    away = closure(both, start, depth).filter("seed <> id")
    return start.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops")).unionByName(away)


def _spread(best: DataFrame, step: DataFrame) -> DataFrame:
    """(id, colour): the greatest colour that reaches each node along step (src, dst), itself included."""
    while True:
        near = step.join(best.withColumnsRenamed({"id": "src", "colour": "c"}), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("c"))
        new = materialise(best.join(near, "id", "left").select("id", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("moved")), "colours")
        best = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return best


def components(edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components, named by their least node.

    Nodes without an edge in or out are trimmed. Of the rest, the greatest id
    that reaches a node is its colour; the nodes that reach back to their
    colour's node within it are its component and leave. All tables hold a row
    for each node or edge at most, and are materialised each round.
    """
    nodes = materialise(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "nodes")
    step = materialise(edges.filter("src <> dst").select("src", "dst").distinct(), "steps")
    found = None
    while nodes.limit(1).count():
        inner = nodes.join(step.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(step.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        colour = _spread(materialise(inner.withColumn("colour", F.col("id")), "colours"), step.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi"))
        c = lambda end: colour.withColumnsRenamed({"id": end, "colour": f"{end}_colour"})
        back = materialise(step.join(c("src"), "src").join(c("dst"), "dst").filter("src_colour = dst_colour").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        done = _reached(colour.filter("id = colour"), back)
        out = nodes.join(colour, "id", "left_anti").select("id", F.col("id").alias("colour")).unionByName(done)
        found = out if found is None else found.unionByName(out)
        nodes = materialise(nodes.join(out, "id", "left_anti"), "nodes")
        step = materialise(step.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"), "steps")
    if found is None:
        return nodes.withColumn("component", F.col("id"))
    least = found.groupBy("colour").agg(F.min("id").alias("component"))
    return materialise(found.join(least, "colour").select("id", "component"), "components")


def _reached(start: DataFrame, step: DataFrame) -> DataFrame:
    """(id, colour) of start and of all that step leads to from there."""
    seen, front = start, start
    while True:
        new = front.join(step.withColumnRenamed("src", "id"), "id").select(F.col("dst").alias("id"), "colour").distinct().join(seen.select("id"), "id", "left_anti")
        front = materialise(new, "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)


def connected(pairs: DataFrame) -> DataFrame:
    """(id, family): connected components of undirected (a, b), named by their least node, by least labels and pointer jumps."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    label = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("family")), "families")
    while True:
        near = both.join(label.withColumnsRenamed({"id": "b", "family": "f"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("f").alias("f"))
        step = label.join(near, "id").select("id", F.least("family", "f").alias("family"), F.col("family").alias("was"))
        jump = step.select(F.col("id").alias("family"), F.col("family").alias("further"))
        new = materialise(step.join(jump, "family", "left").select("id", F.least("family", "further").alias("family"), (F.least("family", "further") < F.col("was")).alias("moved")), "families")
        label = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return label


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): 0 for nodes that depend on nothing outside their component, else one above the highest dependency.

    Cycles are condensed first, so every node of one has the same level and the
    rounds, as many as the longest chain, end.
    """
    comp = components(edges)
    c = lambda end: comp.withColumnsRenamed({"id": end, "component": f"{end}_c"})
    step = materialise(edges.join(c("src"), "src").join(c("dst"), "dst").filter("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct(), "steps")
    level = materialise(comp.select(F.col("component").alias("id")).distinct().withColumn("level", F.lit(0)), "levels")
    while True:
        up = step.join(level.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("level") + 1).alias("up"))
        new = materialise(level.join(up, "id", "left").select("id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level"), (F.coalesce("up", F.lit(0)) > F.col("level")).alias("moved")), "levels")
        level = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return comp.join(level.withColumnRenamed("id", "component"), "component").select("id", "level")


def edge_factor() -> Column:
    tier = F.create_map(*[F.lit(x) for kv in TIER_WEIGHT.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv])
    return F.coalesce(tier[F.col("tier")], F.lit(OTHER_TIER)) * F.coalesce(kind[F.col("type")], F.lit(OTHER_TYPE))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, score, hops): best product of edge factors and decay from any seed, at LEAST or above.

    edges are undirected (src, dst, type, tier). A factor is at most 1 and each
    hop decays, so rounds end after two or three whatever the graph's size.
    """
    both = edges.select("src", "dst", edge_factor().alias("f"))
    both = both.union(both.select("dst", "src", "f")).groupBy("src", "dst").agg(F.max("f").alias("f"))
    best = materialise(seeds.select("id", F.lit(1.0).alias("score"), F.lit(0).alias("hops")), "impact")
    front = best
    while True:
        new = front.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("score") * F.col("f") * DECAY).alias("score"), (F.col("hops") + 1).alias("hops")).filter(F.col("score") >= LEAST)
        new = new.groupBy("id").agg(F.max(F.struct("score", (-F.col("hops")).alias("h"))).alias("m")).select("id", "m.score", (-F.col("m.h")).alias("hops"))
        old = best.select("id", F.col("score").alias("was"))
        front = materialise(new.join(old, "id", "left").filter("was is null or score > was").select("id", "score", "hops"), "impact")
        if not front.limit(1).count():
            return best
        best = best.join(front.select("id"), "id", "left_anti").unionByName(front)


def project_to_modules(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Undirected module pairs: the target's owner, the source as it is, self pairs left out."""
    own = edges.join(owner.withColumnsRenamed({"id": "dst"}), "dst", "left").select(F.col("src").alias("a"), F.coalesce("module", "dst").alias("b")).filter("a <> b")
    return own.union(own.select("b", "a")).distinct()


def iterate(df: DataFrame, step: Callable[[DataFrame], DataFrame], changed: str, rounds: int) -> DataFrame:
    """Apply step until no row says it changed, at most so many rounds; each round is materialised."""
    for _ in range(rounds):
        df = materialise(step(df), "iterate")
        if not df.filter(changed).limit(1).count():
            break
    return df
