"""The star-schema and event tables as graphs, evidence sites, histories and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, path and name of regions, nations, suppliers, customers and parts."""
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name")]
    out = None
    for kind, key, name in parts:
        df = table(spark, d, kind).select(F.concat(F.lit(f"{kind}:"), F.col(key)).alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}/"), F.col(key)).alias("path"), F.col(name).alias("name"))
        out = df if out is None else out.unionByName(df)
    return out


def module_edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, type, tier: nations import regions, suppliers and customers import nations."""
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey")).alias("src"), F.concat(F.lit("region:"), F.col("n_regionkey")).alias("dst"), F.lit("semantic").alias("tier"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("src"), F.concat(F.lit("nation:"), F.col("s_nationkey")).alias("dst"), F.lit("semantic").alias("tier"))
    c = table(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("src"), F.concat(F.lit("nation:"), F.col("c_nationkey")).alias("dst"), F.lit("syntactic").alias("tier"))
    return n.unionByName(s).unionByName(c).withColumn("type", F.lit("imports"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, type, tier, path, line: suppliers call parts, order lines are the evidence."""
    tier = F.when(F.col("l_returnflag") == "A", "semantic").when(F.col("l_returnflag") == "N", "syntactic").otherwise("dynamic")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("dst"), F.lit("calls").alias("type"), tier.alias("tier"),
        F.concat(F.lit("order/"), F.col("l_orderkey")).alias("path"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("at"),
    )


def sites(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Evidence sites from events: a user is a file, a day of five a line, a half hour of the day a column."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    col = F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)
    base = e.select(
        F.col("event_id").alias("seq"), "event_type", F.concat(F.lit("u"), F.col("user_id")).alias("file"), (F.dayofmonth("ts") % 5 + 1).alias("line"), F.concat(F.lit("k"), k % 5).alias("name"),
        F.when(F.col("event_id") % 13 == 0, -1).otherwise(col).cast("int").alias("col"), F.concat(F.lit("p"), F.col("event_id") % 3).alias("def_file"), (F.col("event_id") % 2).cast("int").alias("def_line"),
    )
    pick = lambda kind: base.filter(F.col("event_type") == kind).drop("event_type")
    syntax = pick("click").select("seq", "file", "line", "name", "col", F.when(F.col("seq") % 11 == 0, "import").otherwise("call").alias("kind"), (F.col("seq") % 29 == 0).alias("ambiguous"))
    semantic = pick("purchase").select("seq", "file", "line", "name", "col", "def_file", "def_line", F.when(F.col("seq") % 19 == 0, "implements").otherwise("resolution").alias("kind"))
    fallback = pick("signup").groupBy("file", "line", "name").agg(F.min(F.struct("seq", "def_file", "def_line")).alias("f")).select("file", "line", "name", "f.def_file", "f.def_line")
    external = pick("error").select("file", "line", "name", (F.col("seq") % 3 == 0).alias("in_repo"))
    withhold = base.select("file").filter(F.col("file").rlike("0$")).distinct()
    return {"syntax": syntax, "semantic": semantic, "fallback": fallback, "external": external, "withhold": withhold}


#: The same views as DuckDB SQL.
SITES_SQL = """
base AS (SELECT event_id AS seq, event_type, 'u' || user_id AS file, (day(ts) % 5 + 1)::INT AS line, 'k' || ((props->>'$.k')::INT % 5) AS name,
  (CASE WHEN event_id % 13 = 0 THEN -1 ELSE hour(ts) * 2 + minute(ts) // 30 END)::INT AS col,
  'p' || (event_id % 3) AS def_file, (event_id % 2)::INT AS def_line FROM events),
syntax AS (SELECT seq, file, line, name, col, CASE WHEN seq % 11 = 0 THEN 'import' ELSE 'call' END AS kind, seq % 29 = 0 AS ambiguous FROM base WHERE event_type = 'click'),
semantic AS (SELECT seq, file, line, name, col, def_file, def_line, CASE WHEN seq % 19 = 0 THEN 'implements' ELSE 'resolution' END AS kind FROM base WHERE event_type = 'purchase'),
fallback AS (SELECT file, line, name, arg_min(def_file, seq) AS def_file, arg_min(def_line, seq) AS def_line FROM base WHERE event_type = 'signup' GROUP BY ALL),
external AS (SELECT file, line, name, seq % 3 = 0 AS in_repo FROM base WHERE event_type = 'error'),
withhold AS (SELECT DISTINCT file FROM base WHERE file LIKE '%0')
"""
GRAPH_SQL = """
medges AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'semantic' AS tier, 'imports' AS type FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'semantic', 'imports' FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'syntactic', 'imports' FROM customer),
calls AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, 'calls' AS type, CASE l_returnflag WHEN 'A' THEN 'semantic' WHEN 'N' THEN 'syntactic' ELSE 'dynamic' END AS tier,
  'order/' || l_orderkey AS path, l_linenumber AS line, l_shipdate AS at FROM lineitem),
nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, 'region/' || r_regionkey AS path, r_name AS name FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', 'nation/' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', 'supplier/' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', 'customer/' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part', 'part/' || p_partkey, p_name FROM part)
"""
