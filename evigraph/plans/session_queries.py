"""Queries of session logs, stores and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.plans.registry import query, shared_sql
from evigraph.sources.domain import table

EPOCH = "epoch_ms(ts)"


@query("session_stats", "SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS prompts, sum(len(coalesce(text, '')))::BIGINT AS chars, max(turn)::BIGINT AS last_turn FROM conversations GROUP BY conv_id")
def session_stats(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("prompts"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.max("turn").cast("long").alias("last_turn"))


@query("session_summary", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS allowed, count(*) FILTER (WHERE event_type = 'error') AS denied, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, event_id) AS last_command, max(ts) > TIMESTAMP '2024-01-29 23:55:00' AS active FROM events GROUP BY user_id")
def session_summary(spark, d):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, d, "events").groupBy("user_id").agg(n("view").alias("allowed"), n("error").alias("denied"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("event_type", "event_id").alias("last_command"), (F.max("ts") > F.expr("timestamp_ntz '2024-01-29 23:55:00'")).alias("active"))


@query("streak", "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT user_id, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d), n AS (SELECT user_id, island, count(*) AS n FROM r GROUP BY ALL) SELECT user_id, max(n) AS longest FROM n GROUP BY user_id")
def streak(spark, d):
    from pyspark.sql import Window

    days = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))  # a user's days, not events
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


@query("json_content_lateral", "SELECT event_id, (props->>'$.k')::INT AS k, unnest([1, 2])::INT AS part FROM events WHERE event_type = 'view'")
def json_content_lateral(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("part"))


@query("correlated_backfill", "SELECT c.c_custkey, c.c_name, (SELECT coalesce(sum(o.o_orderkey), 0)::BIGINT FROM orders o WHERE o.o_custkey = c.c_custkey) AS cost, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
def correlated_backfill(spark, d):
    use = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_orderkey").alias("cost"), F.count("*").alias("n"))
    return table(spark, d, "customer").join(use, "c_custkey", "left").select("c_custkey", "c_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cost", "n")))


@query("upsert_latest", "WITH u AS (SELECT o_custkey AS k, o_orderkey AS v, 2 AS p FROM orders UNION ALL SELECT c_custkey, -1, 1 FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, v DESC) AS rn FROM u) SELECT k, v FROM r WHERE rn = 1")
def upsert_latest(spark, d):
    """On conflict do update: the store's rows with incoming ones over them, the latest by key."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"), F.lit(1).alias("p"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.lit(2).alias("p"))
    return old.union(new).groupBy("k").agg(F.max(F.struct("p", "v"))["v"].alias("v"))


@query("on_conflict_do_nothing", "SELECT c_custkey AS k, 'old' AS source FROM customer UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def on_conflict_do_nothing(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().join(old, "k", "left_anti")
    return old.withColumn("source", F.lit("old")).union(new.withColumn("source", F.lit("new")))


@query("relational_find", "SELECT c.c_custkey, c.c_name, coalesce(string_agg(o.o_orderkey::VARCHAR, ',' ORDER BY o.o_orderkey), '') AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL")
def relational_find(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce(F.array_join(F.col("keys").cast("array<string>"), ","), F.lit("")).alias("orders"))


@query("projection_fork", "SELECT conv_id + 1000000 AS conv_id, turn, role FROM conversations WHERE turn < 3 UNION ALL SELECT conv_id, turn, role FROM conversations")
def projection_fork(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return c.filter("turn < 3").withColumn("conv_id", F.col("conv_id") + 1_000_000).unionByName(c)


@query("hash_split", "SELECT doc_id, (('0x' || substr(sha256('7' || chr(10) || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0)::DOUBLE < 0.2 AS held FROM documents")
def hash_split(spark, d):
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("7\n"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 2.0**32
    return table(spark, d, "documents").select("doc_id", (h < 0.2).alias("held"))


@query("text_search", "SELECT doc_id, (pos - 1)::INT AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE contains(lower(text), 'license')")
def text_search(spark, d):
    lines = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.filter(F.contains(F.lower("text"), F.lit("license")))


@query("jaccard_nearest", "WITH w AS (SELECT DISTINCT p_name AS item_id, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda x: len(x) >= 3)) AS t FROM part), p AS (SELECT a.item_id, b.item_id AS other, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS s FROM w a JOIN w b ON a.item_id <> b.item_id) SELECT item_id, arg_min(other, (-s, other)) AS nearest, floor(max(s) * 100) / 100 AS score FROM p GROUP BY item_id HAVING max(s) >= 0.2")
def jaccard_nearest(spark, d):
    """Best Jaccard of word sets, first wins ties, at least 0.2: candidates share a word, counted by an equi-join."""
    words = F.array_distinct(F.filter(F.split(F.lower("p_name"), "[^a-z]+"), lambda x: F.length(x) >= 3))
    w = table(spark, d, "part").select(F.col("p_name").alias("item_id"), words.alias("t")).distinct().withColumn("n", F.size("t"))
    e = w.select("item_id", "n", F.explode("t").alias("w"))
    both = e.join(e.select(F.col("item_id").alias("other"), F.col("n").alias("m"), "w"), "w").filter("item_id <> other").groupBy("item_id", "other", "n", "m").agg(F.count("*").alias("k"))
    best = both.withColumn("s", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).groupBy("item_id").agg(F.min_by("other", F.struct((-F.col("s")).alias("a"), "other")).alias("nearest"), F.max("s").alias("score"))
    return best.filter("score >= 0.2").withColumn("score", F.floor(F.col("score") * 100) / 100)


@query("loose_groups", "WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, string_split(name, ' ') AS w FROM n), e AS (SELECT name, w, unnest(range(1, len(w) + 1)) AS pos FROM t), g AS (SELECT len(w)::INT AS size, pos::INT AS pos, array_to_string(list_concat(w[:pos - 1], ['*'], w[pos + 1:]), ' ') AS pattern, w[pos] AS v FROM e) SELECT size, pos, pattern, count(DISTINCT v) AS n FROM g GROUP BY ALL HAVING count(DISTINCT v) >= 2")
def loose_groups(spark, d):
    t = table(spark, d, "part").select(F.split("p_name", " ").alias("w")).distinct().withColumn("size", F.size("w"))
    e = t.select("w", "size", F.posexplode("w").alias("p", "v"))
    pattern = F.array_join(F.transform("w", lambda x, i: F.when(i == F.col("p"), F.lit("*")).otherwise(x)), " ")
    return e.select("size", (F.col("p") + 1).alias("pos"), pattern.alias("pattern"), "v").groupBy("size", "pos", "pattern").agg(F.count_distinct("v").alias("n")).filter("n >= 2")


@query("chunk_text")
def chunk_text(spark, d):
    """Documents in chunks of whole lines, at most 800 characters unless a line is longer."""
    chunks = F.expr("""aggregate(split(text, '\n'), named_struct('done', cast(array() as array<int>), 'own', 0),
      (acc, line) -> if(acc.own > 0 and acc.own + length(line) + 1 > 800, named_struct('done', concat(acc.done, array(acc.own)), 'own', length(line) + 1), named_struct('done', acc.done, 'own', acc.own + length(line) + 1)),
      acc -> concat(acc.done, array(acc.own)))""")
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "size"))


@query("masked_text", "SELECT doc_id, len(regexp_extract_all(text, '\\bthe\\b')) AS hidden, md5(regexp_replace(text, '\\bthe\\b', '<name>', 'g')) AS masked FROM documents")
def masked_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\bthe\b")).cast("long").alias("hidden"), F.md5(F.regexp_replace("text", r"\bthe\b", "<name>")).alias("masked"))


@query("line_diff_classes")
def line_diff_classes(spark, d):
    """Files of a patch made of pages' titles, by a table function, with counts of added and removed lines."""
    from evigraph.functions.tables import DiffSections

    p = table(spark, d, "pages").select("page_id", F.format_string("--- a/%s\n+++ b/%s\n@@ -1 +1,2 @@\n-old\n+new\n+more\n--- /dev/null\n+++ b/n%s\n+x", F.col("page_id"), F.col("page_id"), F.col("page_id")).alias("diff"))
    return p.lateralJoin(DiffSections(F.col("diff").outer())).drop("diff")


@query("moniker_parse")
def moniker_parse(spark, d):
    from evigraph.functions.tables import Descriptors

    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("py pip pkg 1.0 "), F.translate("p_name", " ", "/"), F.lit("/C#m().")).alias("moniker"))
    return p.lateralJoin(Descriptors(F.col("moniker").outer())).select("p_partkey", "pos", "kind", "name")


TOKENS = r"lower(regexp_replace(regexp_replace(p_brand || 'X9 getHTTPCode_v2', '([a-z0-9])([A-Z])', '\1_\2'{g}), '([A-Za-z])([0-9])', '\1_\2'{g}))"


@query("identifier_tokens", "SELECT DISTINCT p_brand, " + TOKENS.format(g=", 'g'") + " AS tokens FROM part")
def identifier_tokens(spark, d):
    own = F.concat("p_brand", F.lit("X9 getHTTPCode_v2"))
    snake = F.regexp_replace(F.regexp_replace(own, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Za-z])([0-9])", "$1_$2")
    return table(spark, d, "part").select("p_brand", F.lower(snake).alias("tokens")).distinct()


@query("seeded_derangement", "WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('k' || doc_id::VARCHAR)) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT a.doc_id, b.doc_id AS given FROM h a JOIN h b ON b.lang = a.lang AND b.r = a.r % a.n + 1")
def seeded_derangement(spark, d):
    """A cyclic shift of a seeded shuffle within each group."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.lit("k"), F.col("doc_id").cast("string")), 256))
    h = table(spark, d, "documents").select("doc_id", "lang")
    first = F.first("doc_id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return h.select("doc_id", F.coalesce(F.lead("doc_id").over(w), first).alias("given"))


shared_sql("tool_filter_counts", ["events"], "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS unfinished FROM events GROUP BY user_id")
shared_sql("instance_selection", ["orders"], "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'id' WHEN o_orderpriority = '5-LOW' THEN 'repo' WHEN o_totalprice < 50000 THEN 'difficulty' WHEN o_orderdate IS NULL THEN 'undated' WHEN o_orderdate < TIMESTAMP '1995-01-01 00:00:00' THEN 'before-cutoff' ELSE 'kept' END AS reason FROM orders) t GROUP BY reason")
shared_sql("depth_bucket", ["orders", "lineitem"], "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN count(*) = 1 THEN '1' WHEN count(*) <= 3 THEN '2-3' ELSE '4+' END AS bucket FROM lineitem GROUP BY l_orderkey) t GROUP BY bucket")
shared_sql("page_cursor", ["orders"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
shared_sql("key_range_page", ["part"], "SELECT p_partkey, p_name FROM part WHERE p_name >= 'b' AND p_name < 'c' AND p_partkey > 10 ORDER BY p_name, p_partkey LIMIT 21")
shared_sql("latest_message", ["conversations"], "SELECT conv_id, max_by(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id", "SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY conv_id")
shared_sql("first_user_message", ["conversations"], "SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id")
shared_sql("next_promotable", ["events"], "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'signup') SELECT user_id, event_id FROM r WHERE k = 1")
shared_sql("topk_overflow", ["lineitem"], "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, CAST(k AS INT) AS k, n - 12 AS more FROM r WHERE k <= 12")
shared_sql("range_tiles", ["orders"], "SELECT CAST(floor(date_diff('DAY', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 31) AS BIGINT) AS tile, count(*) AS n FROM orders GROUP BY 1".replace("date_diff('DAY', DATE '1992-01-01', CAST(o_orderdate AS DATE))", "datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01')"), "SELECT CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 31) AS BIGINT) AS tile, count(*) AS n FROM orders GROUP BY 1")
shared_sql("batches_of_500", ["customer"], "SELECT CAST(floor((c_custkey) / 500) AS BIGINT) AS batch, count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high FROM customer GROUP BY 1")
shared_sql("latest_sequence", ["customer", "orders"], "SELECT c.c_custkey, coalesce(max(o.o_orderkey), -1) AS latest FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
shared_sql("session_listing", ["orders"], "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
shared_sql("suspended_sessions", ["orders"], "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus = 'P'")
shared_sql("models_by_tokens", ["lineitem"], "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS tokens, count(*) AS calls FROM lineitem GROUP BY l_returnflag ORDER BY tokens DESC")
shared_sql("filled_roles", ["events"], "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS role FROM events", "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS role FROM events")
shared_sql("changed_keys", ["orders"], "WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT coalesce(a.k, b.k) AS k FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
shared_sql("session_usage_totals", ["lineitem"], "SELECT l_suppkey, CAST(sum(coalesce(l_orderkey, 0)) AS BIGINT) AS tokens, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
