"""Enrichment packs: registered passes over a read-only context that add rows, each failure isolated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "src string, dst string, type string, tier string"


class PackRefusal(Exception):
    """A pack's input is wrong in a way that must stop the run."""


@dataclass(frozen=True)
class Pack:
    """A named pass: whether it applies to a context, and the edges that it adds at its tier."""

    name: str
    tier: str
    applies: Callable[[dict[str, DataFrame]], bool]
    run: Callable[[dict[str, DataFrame]], DataFrame]


@dataclass
class Registry:
    packs: list[Pack] = field(default_factory=list)

    def register(self, pack: Pack) -> Pack:
        if any(p.name == pack.name for p in self.packs):
            raise ValueError(f"pack {pack.name} is registered twice")
        self.packs.append(pack)
        return pack


def run_packs(spark: SparkSession, context: dict[str, DataFrame], packs: list[Pack]) -> tuple[DataFrame, DataFrame]:
    """The rows that packs add, in their order and each once, with the pack's name; and (pack, message) of packs that failed.

    A refusal stops the run; any other failure, in planning or on the first
    look at the rows, leaves the pack out.
    """
    out = spark.createDataFrame([], f"{ROWS}, pack string, place int")
    failed = []
    for place, pack in enumerate(packs):
        try:
            if not pack.applies(context):
                continue
            rows = pack.run(context).select("src", "dst", "type").distinct()
            rows.limit(1).count()
        except PackRefusal:
            raise
        except Exception as e:  # noqa: BLE001  a pack's own failure must not take the others along
            failed.append((pack.name, type(e).__name__))
            continue
        out = out.unionByName(rows.withColumns({"tier": F.lit(pack.tier), "pack": F.lit(pack.name), "place": F.lit(place)}))
    first = out.groupBy("src", "dst", "type").agg(F.min(F.struct("place", "tier", "pack")).alias("f"))
    return first.select("src", "dst", "type", "f.tier", "f.pack"), spark.createDataFrame(failed, "pack string, message string")


def judge_soft(rules: DataFrame, runner: Callable[[str], tuple[str, str]]) -> DataFrame:
    """Soft rules (id, statement) with the verdict and the reason of an injected judge; a judge that fails leaves ``unknown``."""
    @F.pandas_udf("struct<verdict: string, reason: string>")
    def judged(statements: pd.Series) -> pd.DataFrame:
        rows = []
        for s in statements:
            try:
                rows.append(runner(s))
            except Exception as e:  # noqa: BLE001  the judge is foreign code
                rows.append(("unknown", type(e).__name__))
        return pd.DataFrame(rows, columns=["verdict", "reason"])

    return rules.withColumn("__j", judged("statement")).select("id", "__j.verdict", "__j.reason")
