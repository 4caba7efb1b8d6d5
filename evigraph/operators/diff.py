"""Snapshot differences: graph diff, movement, coverage delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_rows(base: DataFrame, head: DataFrame, key: list[str]) -> DataFrame:
    """Rows by identity key: added ones from head, removed ones from base, with a sign."""
    added = head.join(base.select(*key).distinct(), key, "left_anti").withColumn("sign", F.lit("+"))
    removed = base.join(head.select(*key).distinct(), key, "left_anti").withColumn("sign", F.lit("-"))
    return added.unionByName(removed)


def any_change(base: DataFrame, head: DataFrame) -> DataFrame:
    """(changed): whether either side has a row that the other hasn't; one row is enough to know."""
    rows = base.join(head, base.columns, "left_anti").limit(1).union(head.join(base, base.columns, "left_anti").limit(1))
    return rows.agg((F.count("*") > 0).alias("changed"))


def summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("type", "sign").agg(F.count("*").alias("n"))


def movement(base: DataFrame, head: DataFrame, key: str, bad: str) -> DataFrame:
    """Per key of both snapshots: regressed, fixed, still-failing or unchanged; a missing side doesn't fail."""
    b, h = base.select(key, F.col(bad).alias("was")), head.select(key, F.col(bad).alias("now"))
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    move = F.when(~was & now, "regressed").when(was & ~now, "fixed").when(was & now, "still-failing").otherwise("unchanged")
    return b.join(h, key, "full").select(key, move.alias("movement"))


def coverage_delta(base_modules: DataFrame, head_modules: DataFrame, base_guards: DataFrame, head_guards: DataFrame, accepted: DataFrame) -> DataFrame:
    """Modules (id, no_code) with a change of guarding: new-unguarded, no-code, accepted or lost-guard."""
    b, h = base_guards.select("id").distinct(), head_guards.select("id").distinct()
    bare = head_modules.join(h, "id", "left_anti")
    new = bare.join(base_modules.select("id"), "id", "left_anti").select("id", F.when(F.col("no_code"), "no-code").otherwise("new-unguarded").alias("change"))
    lost = bare.join(b, "id").join(accepted.select("id").withColumn("ok", F.lit(True)), "id", "left").select("id", F.when(F.col("ok"), "accepted").otherwise("lost-guard").alias("change"))
    return new.unionByName(lost)
