"""Queries of the relational surface: joins, sets, grouping, windows, and native event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.plans.registry import query, shared_sql
from evigraph.sources.domain import table


@query("broadcast_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def broadcast_join(spark, d):
    """nation has one row per nation: a fixed size."""
    n = F.broadcast(table(spark, d, "nation"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("asof_join", "WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS p_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT c.event_id, (SELECT p_id FROM p WHERE p.user_id = c.user_id AND p.ts <= c.ts ORDER BY p.ts DESC, p_id DESC LIMIT 1) AS p_id FROM c")
def asof_join(spark, d):
    """Union, sort within the key, carry the last match: no pairs are made."""
    from pyspark.sql import Window

    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).withColumn("buy", F.col("event_type") == "purchase")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("buy"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("buy"), F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("p_id", last).filter("not buy").select("event_id", "p_id")


@query("range_join", "WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id AS p_id, user_id, ts FROM events WHERE event_type = 'purchase') SELECT c.event_id, p.p_id FROM c JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR")
def range_join(spark, d):
    from evigraph.operators.evidence import inside_interval

    e = table(spark, d, "events").withColumn("ms", F.unix_micros(F.col("ts").cast("timestamp")))
    c = e.filter("event_type = 'click'").select("user_id", "event_id", F.col("ms").alias("start"), (F.col("ms") + 6 * 3_600_000_000).alias("end"))
    p = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("p_id"), "ms")
    return inside_interval(p, c, "user_id", "ms", "start", "end", 6 * 3_600_000_000).select("event_id", "p_id")


@query("approx_distinct")
def approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("tumbling_window", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("sliding_window", "WITH s AS (SELECT event_type, ts, time_bucket(INTERVAL 1 HOUR, ts) AS b FROM events), x AS (SELECT event_type, b - INTERVAL 1 HOUR * i AS start FROM s, range(0, 3) r(i)) SELECT event_type, start, count(*) AS n FROM x GROUP BY ALL")
def sliding_window(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_window(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("pivot_counts", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY l_returnflag")
def pivot_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).count().select("l_returnflag", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


@query("salted_skew_sum", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def salted_skew_sum(spark, d):
    """Two-step aggregation: a hot status is summed in shares first."""
    o = table(spark, d, "orders").groupBy("o_orderstatus", F.pmod(F.xxhash64("o_orderkey"), F.lit(32)).alias("share")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return o.groupBy("o_orderstatus").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


T = ["lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents"]
shared_sql("set_ops_distinct", ["customer", "supplier"], "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) a UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) b UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) c")
shared_sql("set_ops_all", ["customer", "supplier"], "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) a UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) b UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) c")
shared_sql("semi_join", ["customer", "orders"], "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
shared_sql("anti_join", ["customer", "orders"], "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
shared_sql("left_right_full_join", ["nation", "supplier"], "SELECT 'left' AS kind, count(*) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 0 UNION ALL SELECT 'right', count(*) FROM supplier RIGHT JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'full', count(*) FROM nation FULL JOIN supplier ON n_nationkey = s_suppkey")
shared_sql("grouping_sets", ["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
shared_sql("cube", ["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
shared_sql("rollup", ["lineitem"], "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
shared_sql("rank_family", ["supplier"], "SELECT s_suppkey, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS d, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS INT) AS n FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
shared_sql("lag_lead", ["orders"], "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
shared_sql("frame_rows", ["orders"], "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
shared_sql("frame_range", ["part"], "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM part")
shared_sql("select_distinct", ["part"], "SELECT DISTINCT p_brand, p_size FROM part")
shared_sql("cte_reuse", ["lineitem"], "WITH r AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(q, 2) AS q FROM r WHERE q = (SELECT max(q) FROM r)")
shared_sql("update_rewrite", ["part"], "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size - 25 ELSE p_size END AS p_size FROM part")
shared_sql("delete_rewrite", ["part", "lineitem"], "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
shared_sql("insert_select", ["part", "supplier"], "SELECT CONCAT('p', p_partkey) AS k FROM part UNION ALL SELECT CONCAT('s', s_suppkey) FROM supplier WHERE s_acctbal > 0")
shared_sql("pricing_summary", ["lineitem"], "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
shared_sql("star_join_revenue", ["lineitem", "orders", "customer", "nation", "region"], "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
shared_sql("directory_rollup", ["pages"], r"SELECT split_part(url, '/', 3) AS dir, split_part(split_part(url, '/', 4), '?', 1) AS lang, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1, 2")
shared_sql("guarding_tests", ["lineitem", "part"], "SELECT p_brand AS module, count(DISTINCT l_suppkey) AS tests FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
shared_sql("unpivot_roles", ["customer"], "SELECT c_custkey, 'seg' AS k, c_mktsegment AS v FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer")
shared_sql("planner_hit", ["pages", "documents"], "SELECT count(*) AS hits FROM (SELECT DISTINCT source FROM documents) d JOIN (SELECT DISTINCT concat('src', page_id % 40) AS p FROM pages) p ON d.source = p.p OR endswith(p.p, concat('/', d.source))", "SELECT count(*) AS hits FROM (SELECT DISTINCT source FROM documents) d JOIN (SELECT DISTINCT concat('src', page_id % 40) AS p FROM pages) p ON d.source = p.p OR ends_with(p.p, concat('/', d.source))")
