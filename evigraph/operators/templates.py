"""Change templates: how well holes and anchors cover what a change touched, and which holes its fills close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.operators.evidence import innermost

# Kinds of holes that stand for a symbol.
SYMBOL_HOLES = ["SIGNATURE", "BODY", "CALLER_UPDATE", "TEST_EXPECTATION"]


def coverage(hunks: DataFrame, holes: DataFrame, width: int = 64) -> DataFrame:
    """(template, bucket, n): hunks (template, hunk, path, start, end, created) by what of their template (template, path, start, end, type) they touch:
    a new file, a symbol's hole, a region, or nothing.

    Hunks not known to be new files count by what they touch. Overlaps are found by buckets of lines.
    """
    def deal(df: DataFrame) -> DataFrame:
        return df.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))

    h = deal(holes.select("template", "path", "start", "end", (F.col("type").isin(SYMBOL_HOLES)).alias("symbol"), (F.col("type") == "MODULE_REGION").alias("region")))
    asked = deal(hunks.filter("created is distinct from true").select("template", "hunk", "path", "start", "end"))
    both = asked.alias("x").join(h.alias("h"), ["template", "path", "__b"]).filter("h.start <= x.end and x.start <= h.end")
    touched = both.groupBy("template", "hunk").agg(F.bool_or("symbol").alias("symbol"), F.bool_or("region").alias("region"))
    rows = hunks.join(touched, ["template", "hunk"], "left")
    bucket = F.when(F.col("created"), "new_file").when(F.col("symbol"), "symbol").when(F.col("region"), "region").otherwise("outside")
    return rows.groupBy("template", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _around(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows with the innermost symbol around their path and line, or null."""
    places = innermost(rows.select("path", "line").distinct(), symbols, "path", "line", ["path", "line"], 128)
    return rows.join(places, ["path", "line"], "left")


def score_anchors(anchors: DataFrame, paths: DataFrame, symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Per matcher of anchors (template, matcher, node): how many, and how many lie in a file and in a symbol that the change (template, path, line) touched.

    paths: (node, path); symbols: (path, scope, start, end), of which a changed line belongs to the innermost.
    """
    files = hunks.select("template", "path").distinct().withColumn("in_file", F.lit(True))
    gold = _around(hunks.select("template", "path", "line").distinct(), symbols).filter("scope is not null").select("template", F.col("scope").alias("node")).distinct().withColumn("in_symbol", F.lit(True))
    rows = anchors.join(paths.select("node", "path"), "node", "left").join(files, ["template", "path"], "left").join(gold, ["template", "node"], "left")
    return rows.groupBy("matcher").agg(F.count("*").alias("anchors"), F.count("in_file").alias("file_hits"), F.count("in_symbol").alias("symbol_hits"))


def close_implied(holes: DataFrame, fills: DataFrame) -> DataFrame:
    """(template, hole, reason) of holes that fills (template, hole, value) make needless: calls of a function whose signature stays, and regions that stay.

    holes: (template, hole, type, symbol, kind, callee, closed).
    """
    filled = holes.join(fills, ["template", "hole"], "left")
    same = F.coalesce(F.col("value") == "unchanged", F.lit(False))
    kept = filled.filter((F.col("type") == "SIGNATURE") & same & F.col("kind").isin("function", "method")).select("template", F.col("symbol").alias("callee")).distinct().withColumn("stays", F.lit(True))
    rows = filled.filter("not closed").join(kept, ["template", "callee"], "left")
    reason = F.when((F.col("type") == "CALLER_UPDATE") & F.col("stays"), F.concat(F.lit("signature of "), "callee", F.lit(" unchanged"))).when((F.col("type") == "MODULE_REGION") & same, "unchanged")
    return rows.select("template", "hole", reason.alias("reason")).filter("reason is not null")


def literal_anchors(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """(literal, path, line, symbol): hits (literal, path, line) of a literal with the innermost symbol (path, scope, start, end) around them."""
    return _around(hits.select("literal", "path", "line").distinct(), symbols).select("literal", "path", "line", F.col("scope").alias("symbol"))


def anchor_candidates(unresolved: DataFrame, names: DataFrame, top: int = 5) -> DataFrame:
    """(term, name, shared, place): the names that share most three-letter pieces with an unresolved term, the first few.

    Pieces are joined, so that only names with a common one are compared.
    """
    pieces = lambda df, c: df.select(c).distinct().select(c, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda k: F.lower(F.substr(F.col(c), k, F.lit(3)))))).alias("piece"))
    both = pieces(unresolved, "term").join(pieces(names, "name"), "piece").groupBy("term", "name").agg(F.count("*").alias("shared"))
    sizes = lambda df, c, n: pieces(df, c).groupBy(c).agg(F.count("*").alias(n))
    rows = both.join(sizes(unresolved, "term", "a"), "term").join(sizes(names, "name", "b"), "name")
    rows = rows.withColumn("share", F.round(F.col("shared") / (F.col("a") + F.col("b") - F.col("shared")), 6))
    from evigraph.operators.evidence import window_rank

    return rows.withColumn("place", window_rank(["term"], [F.desc("share"), F.col("name")])).filter(F.col("place") <= top).select("term", "name", "shared", "share", "place")
