"""Queries of experiment statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from evigraph.operators import stats
from evigraph.plans.registry import query, shared_sql
from evigraph.sources.domain import table

REC = "rec AS (SELECT l.doc_id, d.lang, d.source, l.quality, l.toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _rec(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query("solve_rate", f"WITH {REC} SELECT lang, count(*) AS n, count(quality) AS judged, count(*) FILTER (WHERE quality = 1) AS solved, round(avg(quality), 4) AS rate FROM rec GROUP BY lang")
def solve_rate(spark, d):
    return _rec(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("judged"), F.count_if(F.col("quality") == 1).alias("solved"), F.round(F.avg("quality"), 4).alias("rate"))


@query("per_solved_mean", "SELECT o_orderpriority AS arm, count(v) AS observed, count(*) - count(v) AS unobserved, round(avg(v), 4) AS mean FROM (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders) GROUP BY o_orderpriority")
def per_solved_mean(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return o.groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("v").alias("observed"), (F.count("*") - F.count("v")).alias("unobserved"), F.round(F.avg("v"), 4).alias("mean"))


@query("pass_at_k", f"WITH {REC}, c AS (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS c FROM rec GROUP BY ALL) SELECT source, lang, CASE WHEN n >= 3 THEN round(1 - (greatest(n - c, 0) / n) * (greatest(n - c - 1, 0) / (n - 1)) * (greatest(n - c - 2, 0) / (n - 2)), 6) END AS pass3 FROM c")
def pass_at_k(spark, d):
    c = _rec(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("c"))
    return c.select("source", "lang", F.round(stats.pass_at_k(F.col("n"), F.col("c"), 3), 6).alias("pass3"))


@query("mcnemar", f"WITH RECURSIVE {REC}, c AS (SELECT lang, source, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS lost, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS gained FROM rec GROUP BY lang, source), t AS (SELECT lang, source, lost, gained, 0 AS i, 0.5 ** (lost + gained) AS term FROM c UNION ALL SELECT lang, source, lost, gained, i + 1, term * (lost + gained - i) / (i + 1) FROM t WHERE i < least(lost, gained)) SELECT lang, source, lost, gained, round(CASE WHEN lost + gained = 0 THEN 1.0 ELSE least(1.0, 2 * sum(term)) END::DOUBLE, 6) AS p FROM t GROUP BY lang, source, lost, gained")
def mcnemar(spark, d):
    lost, gained = (F.col("quality") == 1) & (F.col("toxic") == 1), (F.col("quality") == 0) & (F.col("toxic") == 0)
    c = _rec(spark, d).groupBy("lang", "source").agg(F.count_if(lost).alias("lost"), F.count_if(gained).alias("gained"))
    return c.withColumn("p", F.round(stats.mcnemar(F.col("lost"), F.col("gained")), 6))


@query("sign_flip")
def sign_flip(spark, d):
    r = _rec(spark, d).groupBy("lang", "source").agg(F.sum("quality").cast("long").alias("q"), F.sum("toxic").cast("long").alias("t"), F.count("*").alias("den"))
    return stats.sign_flip(r.withColumn("num", F.col("q") - 2 * F.col("t")), "lang", "num", "den")


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    r = _rec(spark, d).groupBy("source").agg((F.avg("quality") - F.avg("toxic")).alias("value"))
    return stats.paired_bootstrap(r, "source", "value")


@query("auc", "WITH r AS (SELECT l.toxic AS y, d.n_chars % 97 AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id), b AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM r GROUP BY s), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT round((sum(p * (below + n / 2)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc FROM w")
def auc(spark, d):
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select("toxic", (F.col("n_chars") % 97).alias("s"))
    return stats.rank_auc(r, "s", "toxic").select(F.round("auc", 6).alias("auc"))


@query("mutual_information", f"WITH {REC}, j AS (SELECT lang, quality, count(*) AS n FROM rec GROUP BY ALL), t AS (SELECT sum(n) AS total FROM j), a AS (SELECT lang, sum(n) AS na FROM j GROUP BY lang), b AS (SELECT quality, sum(n) AS nb FROM j GROUP BY quality) SELECT round(greatest(sum(n / total * log2(n * total / (na * nb))), 0)::DOUBLE, 6) AS bits FROM j JOIN a USING (lang) JOIN b USING (quality) CROSS JOIN t")
def mutual_information(spark, d):
    return stats.mutual_information(_rec(spark, d), "lang", "quality").select(F.round("bits", 6).alias("bits"))


@query("confusion_matrix", f"WITH {REC} SELECT lang, count(*) FILTER (WHERE quality = 0) AS q0, count(*) FILTER (WHERE quality = 1) AS q1 FROM rec GROUP BY lang")
def confusion_matrix(spark, d):
    return _rec(spark, d).groupBy("lang").pivot("quality", [0, 1]).count().select("lang", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"))


@query("udf_ratio")
def udf_ratio(spark, d):
    """Names nearest to a term by sequence ratio, lengths within 4, best 5, by a vectorised UDF."""
    from difflib import SequenceMatcher

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        return names.map(lambda n: SequenceMatcher(None, "lace spring", n).ratio() if n is not None else None)

    p = table(spark, d, "part").select("p_name").distinct().filter(F.abs(F.length("p_name") - 11) <= 4)
    return p.withColumn("ratio", F.round(ratio("p_name"), 6)).orderBy(F.desc("ratio"), "p_name").limit(5)


@query("udaf_sum", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount), 2) AS total FROM lineitem GROUP BY l_returnflag")
def udaf_sum(spark, d):
    """A grouped aggregate registered by name, summing exactly."""
    from math import fsum

    @F.pandas_udf("double")
    def precise_sum(v: pd.Series) -> float:
        return fsum(v)

    spark.udf.register("precise_sum", precise_sum)
    table(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 64).alias("share")).agg(F.expr("precise_sum(l_extendedprice * l_discount)").alias("s")).createOrReplaceTempView("shares")
    return spark.sql("SELECT l_returnflag, round(sum(s), 2) AS total FROM shares GROUP BY l_returnflag")


@query("udtf_split", "SELECT doc_id, 'seg' AS kind, count(*) AS n FROM (SELECT doc_id, unnest(string_split(source || ';' || lang || '|' || 'x', ';')) AS s FROM documents) GROUP BY doc_id UNION ALL SELECT doc_id, 'pipe', 1 FROM documents")
def udtf_split(spark, d):
    from evigraph.functions.tables import Segments

    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(";", "source", F.concat("lang", F.lit("|x"))).alias("c"))
    n = docs.lateralJoin(Segments(F.col("c").outer()).select("segment")).groupBy("doc_id").agg((F.count("*") - 1).alias("n"))
    return n.select("doc_id", F.lit("seg").alias("kind"), "n").union(n.select("doc_id", F.lit("pipe"), F.lit(1)))


shared_sql("separable_groups", ["orders"], "WITH a AS (SELECT o_orderpriority AS arm, avg(o_totalprice) AS m, max(o_totalprice) - min(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY o_orderpriority) SELECT x.arm AS a, y.arm AS b, abs(x.m - y.m) > greatest(x.s, y.s) AND x.n > 1 AND y.n > 1 AS separable FROM a x JOIN a y ON x.arm < y.arm")
shared_sql("bucket_slope", ["orders"], "WITH b AS (SELECT o_orderpriority AS arm, o_orderstatus AS bucket, avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority, o_orderstatus) SELECT arm, round(max_by(m, bucket) - min_by(m, bucket), 4) AS slope FROM b GROUP BY arm")
shared_sql("density_by_module", ["documents", "labels"], "SELECT d.source AS module, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS none_, count(*) AS total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source")
shared_sql("tolerant_compare", ["lineitem"], "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, abs(l_quantity - l_tax * 500) <= 0.5 + 0.1 * abs(l_quantity) AS close FROM lineitem")
shared_sql("balanced_sample", ["labels"], "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 10007, doc_id) AS k FROM labels) SELECT doc_id, quality FROM r WHERE k <= 20")
shared_sql("most_common_tuple", ["documents"], "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS k FROM c) SELECT lang, source, n FROM r WHERE k = 1")
shared_sql("run_back", ["orders"], "WITH r AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS ok FROM orders), c AS (SELECT *, min(ok) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS held FROM r) SELECT o_custkey, count(*) AS run FROM c WHERE held = 1 GROUP BY o_custkey")
shared_sql("multi_grain_report", ["orders"], "SELECT o_orderstatus AS arm, o_orderpriority AS kind, count(*) AS n, CAST(grouping(o_orderpriority) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))")
