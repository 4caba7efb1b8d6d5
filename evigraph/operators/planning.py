"""Change planning: co-change, coupling, contracts, merging units, cover and waves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.operators.graph import edge_factor
from evigraph.sources.scratch import materialise

# Sizes of commits that count, and how co-change scales coupling.
LEAST_FILES, MOST_FILES, FULL = 2, 50, 8


def cochange(commits: DataFrame) -> DataFrame:
    """(a, b, n, factor): commits in which both files changed, a < b.

    Commits of fewer than LEAST_FILES or more than MOST_FILES distinct files
    don't count, which also bounds a commit's pairs.
    """
    files = commits.select("commit", "path").distinct()
    fit = files.groupBy("commit").agg(F.count("*").alias("k")).filter(F.col("k").between(LEAST_FILES, MOST_FILES)).select("commit")
    own = files.join(fit, "commit")
    pairs = own.withColumnRenamed("path", "a").join(own.withColumnRenamed("path", "b"), "commit").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("factor", 1 + F.least("n", F.lit(FULL)) / 4)


def partners(pairs: DataFrame, least: int) -> DataFrame:
    """(path, other, n) of pairs seen at least so often, from both sides."""
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("other"), "n")
    return both.union(both.select("other", "path", "n")).filter(F.col("n") >= least)


def coupling(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """(a, b, weight): summed tier x type x evidence weights of module pairs, times their co-change factor."""
    w = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (edge_factor() * F.greatest("evidence", F.lit(1))).alias("w"))
    out = w.groupBy("a", "b").agg(F.sum("w").alias("w")).join(factors.select("a", "b", "factor"), ["a", "b"], "left")
    return out.select("a", "b", (F.col("w") * F.coalesce("factor", F.lit(1.0))).alias("weight"))


def contracts(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges between different units, one per (src, dst, type), with both units."""
    u = lambda c: units.select(F.col("id").alias(c), F.col("unit").alias(f"{c}_unit"))
    return edges.join(u("src"), "src").join(u("dst"), "dst").filter("src_unit <> dst_unit").select("src", "dst", "type", "src_unit", "dst_unit").distinct()


def greedy_cover(catches: DataFrame) -> DataFrame:
    """(input, round, covers): inputs that together catch every fault of catches (input, fault).

    A round counts each input's faults that are still open and takes the largest
    count, then the shorter input, then the lesser. Rounds are as many as the
    cover has inputs; only the pick reaches the driver.
    """
    left = materialise(catches.select("input", "fault").distinct(), "open")
    picks, n = [], 0
    while True:
        best = left.groupBy("input").agg(F.count("*").alias("covers")).orderBy(F.desc("covers"), F.length("input"), "input").limit(1).collect()
        if not best:
            return catches.sparkSession.createDataFrame(picks, "input string, round int, covers long")
        n += 1
        picks.append((best[0]["input"], n, best[0]["covers"]))
        caught = left.filter(F.col("input") == best[0]["input"]).select("fault")
        left = materialise(left.join(caught, "fault", "left_anti"), "open")


def redundant_cases(kills: DataFrame) -> DataFrame:
    """Cases of kills (case, fault) that can all go with every fault still caught, those that catch least going first.

    A case that alone catches some fault stays. Of the others, rounds take the
    first in order, and its faults lose one catcher.
    """
    left = materialise(kills.select("case", "fault").distinct(), "kills")
    size = materialise(left.groupBy("case").agg(F.count("*").alias("size")), "sizes")
    gone, n = [], 0
    while True:
        sole = left.groupBy("fault").agg(F.count("*").alias("n"), F.min("case").alias("case")).filter("n = 1").select("case")
        first = size.join(left.select("case").distinct(), "case", "left_semi").join(sole, "case", "left_anti").orderBy("size", "case").limit(1).collect()
        if not first:
            return kills.sparkSession.createDataFrame(gone, "case string, round int")
        n += 1
        gone.append((first[0]["case"], n))
        left = materialise(left.filter(F.col("case") != first[0]["case"]), "kills")


def waves(entries: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The nth entry of a key goes to wave n."""
    return entries.withColumn("wave", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ready(units: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """Units not done whose needs are all done."""
    open_needs = needs.join(done.select(F.col("unit").alias("need")), "need", "left_anti").select("unit").distinct()
    return units.join(done.select("unit"), "unit", "left_anti").join(open_needs, "unit", "left_anti")
