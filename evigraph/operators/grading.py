"""Grading edges against an external answer key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.sources.scratch import materialise


def grade(edges: DataFrame, sites: DataFrame, files: DataFrame) -> DataFrame:
    """edges (seq, path, line, t_path, t_line, t_kind, tier) with bucket and reason.

    sites: (site, path, line, i_path, i_line, targets array of (path, line, name,
    external)). A target at the edge's place confirms; an interface's place or a
    function-valued variable is abstract; a file that the key didn't load, a line
    without sites, sites without targets, or a line with an unresolved site are
    silent; all else contradicts.
    """
    # one row per line: how many targets and open sites; the edge's own place is looked up among the line's targets
    lines = sites.groupBy("path", "line").agg(F.sum(F.size("targets")).alias("many"), F.bool_or(F.size("targets") == 0).alias("open"))
    targets = sites.select("path", "line", F.explode("targets").alias("t")).select("path", "line", F.col("t.path").alias("t_path"), F.col("t.line").alias("t_line")).distinct().withColumn("hit", F.lit(True))
    faces = sites.filter("i_path is not null").select("path", "line", F.col("i_path").alias("t_path"), F.col("i_line").alias("t_line")).distinct().withColumn("face", F.lit(True))
    place = ["path", "line", "t_path", "t_line"]
    rows = edges.join(lines, ["path", "line"], "left").join(targets, place, "left").join(faces, place, "left").join(files.select("path").distinct().withColumn("loaded", F.lit(True)), "path", "left")
    none = F.col("many") == 0
    bound = F.col("t_kind").isin("variable", "constant") & ~none
    cases = [
        (F.col("loaded").isNull(), "silent", "not-loaded"), (F.col("many").isNull(), "silent", "unreachable"), (F.col("hit"), "confirmed", ""),
        (F.col("face"), "abstract", ""), (bound, "abstract", "func-value"), (none, "silent", "no-targets"), (F.col("open"), "silent", "line-unresolved"),
    ]
    bucket, reason = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for rule, b, r in cases[1:]:
        bucket, reason = bucket.when(rule, b), reason.when(rule, r)
    return rows.select(*edges.columns, bucket.otherwise("contradicted").alias("bucket"), reason.otherwise("").alias("reason"))


def precision(graded: DataFrame, *by: str) -> DataFrame:
    """Counts, precision and strict precision (null without a denominator)."""
    n = lambda rule: F.count_if(rule)
    c, x, lu = n(F.col("bucket") == "confirmed"), n(F.col("bucket") == "contradicted"), n(F.col("reason") == "line-unresolved")
    out = graded.groupBy(*by).agg(F.count("*").alias("edges"), c.alias("confirmed"), x.alias("contradicted"), n(F.col("bucket") == "abstract").alias("abstract"), n(F.col("bucket") == "silent").alias("silent"), lu.alias("unresolved"))
    strict = F.when(F.col("unresolved") > 0, F.try_divide("confirmed", F.col("confirmed") + F.col("contradicted") + F.col("unresolved")))
    return out.withColumns({"precision": F.round(F.try_divide("confirmed", F.col("confirmed") + F.col("contradicted")), 6), "strict": F.round(strict, 6)}).drop("unresolved")


def key_pairs(sites: DataFrame) -> DataFrame:
    """In-repo (site, target) pairs of the key, with their class by how and what."""
    t = sites.select("path", "line", "mode", "i_path", F.explode("targets").alias("t")).filter("not t.external")
    how = F.when(F.col("mode").isin("observed", "macro"), F.col("mode")).when((F.col("mode") == "dynamic") & F.col("i_path").isNotNull(), "interface").when(F.col("mode") == "dynamic", "func-value").otherwise("static")
    what = F.when(F.col("t.kind") != "", F.col("t.kind")).when(F.col("t.closure"), "closure").otherwise("named")
    return t.select("path", "line", F.col("t.path").alias("t_path"), F.col("t.line").alias("t_line"), F.col("t.name").alias("t_name"), F.concat_ws("->", how, what).alias("class"))


def recall(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Per class: pairs, hits and recall."""
    drawn = edges.select("path", "line", "t_path", "t_line").distinct().withColumn("hit", F.lit(1))
    rows = key_pairs(sites).join(drawn, ["path", "line", "t_path", "t_line"], "left")
    return rows.groupBy("class").agg(F.count("*").alias("pairs"), F.count("hit").alias("hits")).withColumn("recall", F.round(F.try_divide("hits", "pairs"), 6))


def collapsed(graded: DataFrame, sites: DataFrame) -> DataFrame:
    """Pairs at collapsed identity (site place, target path and name), and those that a confirmed edge hits."""
    pairs = key_pairs(sites)
    done = graded.filter("bucket = 'confirmed'").select("path", "line", "t_path", "t_line").distinct()
    all_ = pairs.select("path", "line", "t_path", "t_name").distinct().agg(F.count("*").alias("pairs"))
    hit = pairs.join(done, ["path", "line", "t_path", "t_line"], "left_semi").select("path", "line", "t_path", "t_name").distinct().agg(F.count("*").alias("hits"))
    return all_.join(hit, how="cross")


def poison(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """Edges with wrong targets, one step on in the list of distinct targets, cyclically, past any that the line allows.

    The list is in first-seen order. A line allows few targets, so the first
    free step is found among as many steps as its distinct allowed targets, plus
    two; the list is joined by position, not scanned.
    """
    first = edges.groupBy("t_path", "t_line").agg(F.min("seq").alias("first"))
    # positions by range partition: sizes of earlier shares plus the rank in its own
    ranged = first.repartitionByRange("first").withColumn("share", F.spark_partition_id())
    ranged = materialise(ranged, "targets")
    sizes = ranged.groupBy("share").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per share
    place = ranged.join(before, "share").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("share").orderBy("first")) - 1).select("t_path", "t_line", "pos")
    total = place.agg(F.count("*").alias("total"))
    allowed = sites.select("path", "line", F.explode("targets").alias("t")).select("path", "line", F.col("t.path").alias("c_path"), F.col("t.line").alias("c_line"))
    allowed = allowed.union(sites.filter("i_path is not null").select("path", "line", "i_path", "i_line")).distinct()
    room = allowed.groupBy("path", "line").agg(F.count("*").alias("room"))
    asked = edges.join(room, ["path", "line"], "left").join(F.broadcast(total), how="cross")
    steps = F.sequence(F.lit(0), F.least(F.coalesce("room", F.lit(0)) + 1, F.col("total") - 1))
    tried = asked.withColumn("k", F.explode(steps)).withColumn("pos", F.pmod(F.col("seq") + 1 + F.col("k"), F.col("total")))
    tried = tried.join(place.withColumnsRenamed({"t_path": "c_path", "t_line": "c_line"}), "pos").filter("not (c_path = t_path and c_line = t_line)")
    free = tried.join(allowed, ["path", "line", "c_path", "c_line"], "left_anti").groupBy("seq").agg(F.min_by(F.struct("c_path", "c_line"), "k").alias("c"))
    out = edges.join(free, "seq", "left").withColumns({"n_path": F.coalesce("c.c_path", "t_path"), "n_line": F.coalesce("c.c_line", F.col("t_line") + 1)})
    beside = allowed.select("path", "line", F.col("c_path").alias("n_path"), F.col("c_line").alias("n_line"))
    return out.join(beside, ["path", "line", "n_path", "n_line"], "left_anti").select(*[F.col({"t_path": "n_path", "t_line": "n_line"}.get(c, c)).alias(c) for c in edges.columns])


def check_poison(graded: DataFrame) -> DataFrame:
    out = graded.agg(F.count("*").alias("seeded"), F.count_if(F.col("bucket") == "confirmed").alias("confirmed"), F.count_if(F.col("bucket").isin("contradicted", "abstract", "suspect")).alias("refused"))
    return out.withColumns({"unjudged": F.col("seeded") - F.col("confirmed") - F.col("refused"), "passed": (F.col("seeded") > 0) & (F.col("confirmed") == 0)})
