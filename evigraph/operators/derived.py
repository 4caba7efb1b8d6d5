"""Edges derived from drawn edges and facts; each pass refuses what is already drawn or doesn't have one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.sources.scratch import materialise


def undrawn(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls (src, dst, path, line) without an edge of type calls between their ends yet, one row per site."""
    return calls.dropDuplicates(["src", "dst", "path", "line"]).join(edges.filter("type = 'calls'").select("src", "dst"), ["src", "dst"], "left_anti")


def one_answer(candidates: DataFrame, by: list[str], target: str = "dst") -> DataFrame:
    """Rows of the keys for which all candidates name one target."""
    one = candidates.groupBy(*by).agg(F.count_distinct(target).alias("n")).filter("n = 1").select(*by)
    return candidates.join(one, by, "left_semi")


def with_calls(items: DataFrame, classes: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Each with-item (src, class, path, line) of one known class runs its ``__enter__`` and ``__exit__``."""
    known = one_answer(items.join(classes.select(F.col("id").alias("class")), "class", "left_semi"), ["src", "path", "line"], "class")
    ends = known.withColumn("name", F.explode(F.array(F.lit("__enter__"), F.lit("__exit__"))))
    return undrawn(ends.join(methods.select("class", "name", F.col("id").alias("dst")), ["class", "name"]).select("src", "dst", "path", "line"), edges)


def method_calls(built: DataFrame, methods: DataFrame, name: str, edges: DataFrame) -> DataFrame:
    """Calls of an instance of a known class run its method of that name (``__call__``, ``__init__``)."""
    own = methods.filter(F.col("name") == name).select("class", F.col("id").alias("dst"))
    return undrawn(built.join(own, "class").select("src", "dst", "path", "line"), edges)


def alias_calls(sites: DataFrame, right_sides: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls through an alias (src, alias, path, line) whose right-hand side (path, alias, dst) the index named once."""
    return undrawn(sites.join(one_answer(right_sides, ["path", "alias"]).distinct(), ["path", "alias"]).select("src", "dst", "path", "line"), edges)


def fixture_injections(requests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Requests (src, name, scopes nearest first) take the fixture (name, scope, dst) of the nearest scope.

    Two definitions in that scope refuse the request. Of a scope's fixtures of a name only the ends go to its requests.
    """
    ends = fixtures.groupBy("name", "scope").agg(F.min("dst").alias("dst"), F.max("dst").alias("last"), F.bool_or(F.col("dst").isNull()).alias("blank"))
    asked = requests.select("src", "name", F.posexplode("scopes").alias("depth", "scope"))
    at = asked.join(ends, ["name", "scope"]).groupBy("src", "name", "depth").agg(F.min("dst").alias("dst"), F.max("last").alias("last"), F.bool_or("blank").alias("blank"))
    near = at.groupBy("src", "name").agg(F.min_by(F.struct("dst", "last", "blank"), "depth").alias("s")).filter("s.dst = s.last")
    dst = F.explode(F.when(F.col("s.blank"), F.array("s.dst", F.lit(None))).otherwise(F.array("s.dst")))
    return near.select("src", dst.alias("dst"), "name")


def union_member_sites(receivers: DataFrame, holders: DataFrame) -> DataFrame:
    """Sites (path, line, col, method) whose receiver's member classes hold the method in two or more definitions."""
    hit = receivers.select("path", "line", "col", "method", F.explode("members").alias("class")).join(holders, ["class", "method"])
    return hit.groupBy("path", "line", "col").agg(F.count_distinct("definition").alias("n")).filter("n >= 2").drop("n")


def unstated_bases(heads: DataFrame, uses: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): bases resolved inside a class's header lines, of a name in the header, without an implements edge."""
    hit = uses.join(heads.withColumnsRenamed({"id": "class"}), "path").filter("line between first and last and array_contains(names, name) and dst <> class")
    return hit.select(F.col("class").alias("src"), "dst").distinct().join(edges.filter("type = 'implements'").select("src", "dst"), ["src", "dst"], "left_anti")


def split_refused(rows: DataFrame, refused: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) of rows by a key table."""
    return rows.join(refused.select(*on).distinct(), on, "left_anti"), rows.join(refused.select(*on).distinct(), on, "left_semi")


def rehome(facts: DataFrame, minted: DataFrame) -> DataFrame:
    """Facts (path, line, scope) inside a minted body (path, first, last, id) belong to the innermost such body."""
    from evigraph.operators.evidence import inside_interval

    keyed = facts.withColumn("__id", F.monotonically_increasing_id())
    hit = inside_interval(keyed.select("__id", "path", "line"), minted, "path", "line", "first", "last", 256)
    best = hit.groupBy("__id").agg(F.min_by("id", F.struct((F.col("last") - F.col("first")).alias("w"), "id")).alias("body"))
    return keyed.join(best, "__id", "left").withColumn("scope", F.coalesce("body", "scope")).drop("__id", "body")


def mint(definitions: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index definitions (path, line, name, kind) without a symbol; and why the others weren't minted, counted."""
    reason = F.when(F.col("name").isNull() | (F.col("name") == ""), "unnamed").when(F.col("kind").isin("parameter", "local"), "local").when(F.col("known").isNotNull(), "known")
    joined = definitions.join(symbols.select("path", "line", "name").distinct().withColumn("known", F.lit(True)), ["path", "line", "name"], "left").withColumn("reason", reason)
    return joined.filter("reason is null").drop("known", "reason"), joined.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def blind_spots(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file (path, lines, captured): uncaptured lines, and their share over all files (4 places).

    A symbol is captured if its file is and every edge into it is semantic;
    an uncaptured file counts whole, overlapping extents once.
    """
    other = edges.filter("tier <> 'semantic'").select(F.col("dst").alias("id")).distinct()
    spans = symbols.join(other, "id", "left_semi").join(files.filter("captured").select("path"), "path")
    lines = spans.select("path", F.explode(F.sequence("line", "end_line")).alias("n")).distinct().groupBy("path").agg(F.count("*").alias("k"))
    out = files.join(lines, "path", "left").select("path", "lines", F.when(F.col("captured"), F.coalesce("k", F.lit(0))).otherwise(F.col("lines")).cast("long").alias("uncaptured"))
    share = out.agg(F.round(F.try_divide(F.sum("uncaptured"), F.sum("lines")), 4).alias("fraction"))
    return out.join(F.broadcast(share), how="cross")


def class_calls(calls: DataFrame, classmethods: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cls(...)`` in a classmethod's own body calls its class: the new edges (src, dst, path, line), and how many sites weren't drawn and why.

    calls: (module, path, scope, callee, line); classmethods: (module, qualname, first, last, owner).
    """
    spans = classmethods.withColumnRenamed("qualname", "scope")
    sites = calls.filter("callee = 'cls'").join(spans, ["module", "scope"]).filter("line between first and last")
    sites = sites.groupBy("module", "path", "scope", "line").agg(F.min_by("owner", "first").alias("owner"))
    rows = sites.select(F.concat_ws(".", "module", "scope").alias("src"), F.concat_ws(".", "module", "owner").alias("dst"), "path", "line")
    ids = symbols.select("id").distinct()
    known = rows.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "path", "line")
    drawn = undrawn(known, edges).select("src", "dst", "path", "line")
    left = rows.join(known, ["src", "dst", "path", "line"], "left_anti").select(F.lit("no-class-symbol").alias("why")).union(known.join(drawn, ["src", "dst", "path", "line"], "left_anti").select(F.lit("already-drawn")))
    return drawn, left.groupBy("why").agg(F.count("*").alias("n"))


def factory_calls(sites: DataFrame, factories: DataFrame, edges: DataFrame) -> DataFrame:
    """Decorator factories applied with arguments call what they return: sites (src, factory, path, line, args) and factories (factory, guard, dst).

    A guard is the argument that must be given for the return to be taken; null takes any. One answer only.
    """
    hit = sites.join(factories, "factory").filter(F.col("guard").isNull() | F.array_contains("args", F.col("guard")))
    return undrawn(one_answer(hit, ["src", "path", "line"]).select("src", "dst", "path", "line"), edges)


def value_calls(uses: DataFrame, injections: DataFrame, methods: DataFrame, bases: DataFrame, edges: DataFrame, most: int = 16) -> tuple[DataFrame, DataFrame]:
    """Calls (src, param, method, path, line) on an injected parameter run the method of its value's class, or of the nearest base in a chain of single bases.

    injections: (src, param, class); methods: (class, name, id); bases: (class,
    base). Sites with several classes, a fork among the bases, or no such method
    are counted by reason.
    """
    typed = uses.join(injections.select("src", "param", "class").distinct(), ["src", "param"])
    one = one_answer(typed, ["src", "path", "line", "method"], "class")
    forks = bases.groupBy("class").agg(F.count_distinct("base").alias("n"), F.min("base").alias("base"))
    front, found, forked = one.select("src", "path", "line", "method", "class"), None, None
    key = ["src", "path", "line", "method"]
    for _ in range(most):  # a chain of bases is short
        front = materialise(front, "chain")
        if not front.limit(1).count():
            break
        hit = front.join(methods.select("class", F.col("name").alias("method"), F.col("id").alias("dst")), ["class", "method"]).select("src", "dst", "path", "line", "method")
        found = hit if found is None else found.union(hit)
        up = front.join(hit.select(*key).distinct(), key, "left_anti").join(forks, "class", "left")
        fork = up.filter("n > 1").select(*key)
        forked = fork if forked is None else forked.union(fork)
        front = up.filter("n = 1").select(*key, F.col("base").alias("class"))
    if found is None:
        found, forked = one.select("src", F.lit("").alias("dst"), "path", "line", "method").limit(0), one.select(*key).limit(0)
    every = typed.select(*key).distinct()
    why = (
        every.join(one.select(*key).distinct(), key, "left_anti").select(F.lit("several-classes").alias("why")).union(forked.select(F.lit("forked-bases")))
        .union(one.select(*key).distinct().join(found.select(*key).distinct(), key, "left_anti").join(forked, key, "left_anti").select(F.lit("no-method")))
    )
    return undrawn(found.select("src", "dst", "path", "line"), edges), why.groupBy("why").agg(F.count("*").alias("n"))
