"""Readers and writers of artifacts: version-gated JSON, JSON lines, logs with a cursor, source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evigraph.sources.scratch import materialise


class VersionError(ValueError):
    """An artifact's schema version isn't one that the reader accepts."""


def require_version(df: DataFrame, accepts: set[int], name: str) -> DataFrame:
    """df, or a refusal that says which versions are there; a table without rows is refused as missing."""
    found = sorted(r[0] for r in df.select("schema_version").distinct().limit(100).collect())
    if not found:
        raise VersionError(f"{name} is missing or empty; run the ingest again")
    if not set(found) <= accepts:
        raise VersionError(f"{name} has schema version {found}, readable are {sorted(accepts)}; run the ingest again")
    return df


def read_artifact(spark: SparkSession, path: str, schema: StructType | str, accepts: set[int], name: str) -> DataFrame:
    return require_version(spark.read.schema(schema).option("multiLine", True).json(path), accepts, name)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def read_instances(spark: SparkSession, path: str, schema: StructType | str, list_columns: list[str], array: bool) -> DataFrame:
    """JSON lines or one JSON array; list columns (strings in schema) may be JSON-encoded strings."""
    df = spark.read.schema(schema).option("multiLine", array).json(path)
    return df.withColumns({c: F.from_json(F.col(c), "array<string>") for c in list_columns})


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log with a line cursor: rows of schema plus ``line`` (from 1 within a file) and ``torn``.

    Lines that aren't JSON stay as torn rows, so the cursor stays aligned. A long
    log is read in splits: lines are numbered within their split, and the splits'
    line counts, one row each, give where a split begins.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    raw = materialise(raw, "log")
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    first = raw.groupBy("file", "block").agg(F.min("at").alias("first"))  # ids of a split's rows follow each other
    lines = raw.join(F.broadcast(before.join(first, ["file", "block"])), ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)
    rows = lines.filter(F.trim("value") != "").select("file", "line", F.try_parse_json("value").isNull().alias("torn"), F.from_json("value", schema).alias("r"))
    return rows.select("file", "line", "torn", "r.*")


def log_page(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The rows after a cursor; torn rows take part in the cursor but aren't returned."""
    return log.filter(F.col("line") > after).orderBy("file", "line").limit(limit).filter(~F.col("torn"))


def read_sources(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """path (relative) and text of source files, without hidden and skipped directories."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    # Directories that a source walk leaves out.
    skipped = ["node_modules", "__pycache__", "venv", ".venv", "build", "dist", "target"]
    path = F.regexp_replace("path", f"^.*?{root.strip('/').replace('.', '[.]')}/", "")
    out = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"))
    parts = F.split("path", "/")
    return out.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, skipped))) & ~F.exists(parts, lambda p: p.startswith(".") & (F.length(p) > 1)))


def write_artifact(df: DataFrame, path: str, order: list[str], stamp: dict[str, str]) -> None:
    """Replace an artifact: totally ordered rows with the provenance stamp; Spark's committer keeps readers from torn files."""
    df.withColumns({k: F.lit(v) for k, v in stamp.items()}).orderBy(*order).write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def to_mermaid(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> str:
    """A drawing of a small graph view; a larger one is refused rather than cut."""
    if nodes.limit(limit + 1).count() > limit or edges.limit(limit * 4 + 1).count() > limit * 4:
        raise ValueError("the view is too large to draw")
    arrows = {"imports": "-->", "calls": "==>", "uses": "-.->"}
    ids = {r["id"]: f"n{k}" for k, r in enumerate(nodes.select("id").orderBy("id").collect())}
    lines = ["graph LR", *(f'  {v}["{k}"]' for k, v in ids.items())]
    for e in edges.select("src", "dst", "type").orderBy("src", "dst", "type").collect():
        if e["src"] in ids and e["dst"] in ids:
            lines.append(f"  {ids[e['src']]} {arrows.get(e['type'], '-.-')} {ids[e['dst']]}")
    return "\n".join(lines)


def read_escalations(spark: SparkSession, path: str) -> DataFrame:
    """Escalation records under a folder, oldest first; torn ones are left out."""
    raw = spark.read.option("recursiveFileLookup", True).text(path).filter(F.try_parse_json("value").isNotNull())
    rows = raw.select(F.from_json("value", "session STRING, id LONG, status STRING, at TIMESTAMP").alias("r")).select("r.*")
    return rows.filter("session is not null").orderBy("at", "id")
