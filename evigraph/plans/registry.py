"""The registry that query modules fill: name to query, and name to its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without sql it has no twin, and a test compares it with brute force."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def shared_sql(name: str, tables: list[str], sql: str, twin: str | None = None) -> None:
    """A query that is SQL itself: Spark plans the text, and DuckDB runs it, or its twin where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in tables:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(sql)

    query(name, twin or sql)(run)
