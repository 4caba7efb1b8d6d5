"""Queries of a service's views, of change templates, plan units, the event log and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import eventlog, graph, packs, partition, planning, rules, service, stats, templates
from evigraph.plans.graph_queries import COMMITS, _commits
from evigraph.plans.registry import query
from evigraph.sources import domain, files
from evigraph.sources.domain import GRAPH_SQL, table
from evigraph.sources.scratch import scratch_path

WITH = f"WITH RECURSIVE {GRAPH_SQL}"


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("common_root", "SELECT 'src/lib/' AS root")
def common_root(spark, d):
    p = table(spark, d, "part")
    ids = p.select(F.when(F.col("p_partkey") % 9 == 0, _cat("ext:x/", F.col("p_brand"))).when(F.col("p_partkey") % 9 == 1, "plain").otherwise(_cat("src/lib/", F.col("p_brand"), "/", F.col("p_partkey"))).alias("id"))
    return service.common_root(ids)


@query("package_of", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ext' WHEN 1 THEN p_brand WHEN 2 THEN 'pk' || p_size ELSE 'whole' || p_size END AS package FROM part")
def package_of(spark, d):
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    id_ = F.when(k == 0, _cat("ext:os.", size)).when(k == 1, _cat("src/lib/", F.col("p_brand"), "/a")).when(k == 2, _cat("pk", size, ".mod.x")).otherwise(_cat("whole", size))
    return table(spark, d, "part").select("p_partkey", service.package_of(id_, F.lit("src/lib/")).alias("package"))


@query("node_detail", f"{WITH}, a AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 2) SELECT 'nation:' || s_nationkey AS id, 'symbol' AS part, s_name AS name, s_suppkey AS line FROM supplier WHERE 'nation:' || s_nationkey IN (SELECT id FROM a) UNION ALL SELECT DISTINCT dst, 'in', src, NULL FROM medges WHERE dst IN (SELECT id FROM a) UNION ALL SELECT DISTINCT src, 'out', dst, NULL FROM medges WHERE src IN (SELECT id FROM a)")
def node_detail(spark, d):
    ids = table(spark, d, "nation").filter("n_regionkey = 2").select(_cat("nation:", F.col("n_nationkey")).alias("id"))
    symbols = table(spark, d, "supplier").select(_cat("nation:", F.col("s_nationkey")).alias("module"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("line"))
    return service.node_detail(ids, symbols, domain.module_edges(spark, d))


DOCS = """dc AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'module-doc' ELSE 'test-doc' END AS kind, 'd' || c_custkey AS id, c_custkey % 13 <> 0 AS readable FROM customer), so AS (SELECT DISTINCT CASE WHEN o_custkey % 2 = 0 THEN 'module-doc' ELSE 'test-doc' END AS kind, 'd' || o_custkey AS id, 'p' || (o_orderkey % 50) AS path, 'h' || (o_orderkey % 50) AS hash FROM orders WHERE o_orderkey % 3 = 0), nw AS (SELECT 'p' || i AS path, CASE WHEN i % 7 = 0 THEN 'new' ELSE 'h' || i END AS hash FROM range(0, 45) t(i)),
bd AS (SELECT dc.kind, dc.id, CASE WHEN NOT readable THEN 'broken' WHEN EXISTS (SELECT 1 FROM so LEFT JOIN nw ON nw.path = so.path WHERE so.kind = dc.kind AND so.id = dc.id AND nw.hash IS DISTINCT FROM so.hash) THEN 'stale' ELSE 'fresh' END AS status FROM dc)"""


def _badges(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    kind = lambda x: F.when(x % 2 == 0, "module-doc").otherwise("test-doc").alias("kind")
    docs = c.select(kind(k), _cat("d", k).alias("id"), (k % 13 != 0).alias("readable"))
    o, n = table(spark, d, "orders").filter("o_orderkey % 3 = 0"), F.col("o_orderkey") % 50
    sources = o.select(kind(F.col("o_custkey")), _cat("d", F.col("o_custkey")).alias("id"), _cat("p", n).alias("path"), _cat("h", n).alias("hash")).distinct()
    now = spark.range(45).select(_cat("p", F.col("id")).alias("path"), F.when(F.col("id") % 7 == 0, "new").otherwise(_cat("h", F.col("id"))).alias("hash"))
    return service.doc_badges(docs, sources, now)


@query("doc_badges", f"WITH {DOCS} SELECT * FROM bd")
def doc_badges(spark, d):
    return _badges(spark, d).drop("changed")


@query("behaviour_index", f"WITH {DOCS} SELECT bd.id, 't' || i AS test, 'does ' || i AS text, CASE WHEN status = 'stale' THEN 'stale' ELSE 'fresh' END AS status FROM bd, range(0, 2) r(i) WHERE kind = 'test-doc'")
def behaviour_index(spark, d):
    badges = _badges(spark, d).filter("kind = 'test-doc'")
    docs = badges.select("id", F.array(*(F.struct(F.lit(f"t{i}").alias("test"), F.lit(f"does {i}").alias("text")) for i in range(2))).alias("behaviours"))
    return service.behaviours(docs, badges)


@query("sessions_pending", "WITH s AS (SELECT o_custkey AS session, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey) SELECT s.*, (SELECT count(*) FROM orders o WHERE o.o_custkey = s.session AND o_orderstatus = 'P' AND (o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '1996-06-01')) AS pending FROM s")
def sessions_pending(spark, d):
    o = table(spark, d, "orders")
    requests = o.select(F.col("o_custkey").alias("session"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("deadline"))
    return service.sessions(o.groupBy(F.col("o_custkey").alias("session")).agg(F.max("o_orderdate").alias("last_seen")), requests, F.lit("1996-06-01").cast("timestamp_ntz"))


@query("latest_compaction", "WITH e AS (SELECT user_id AS session, event_id AS seq, event_type, event_id % 4 AS m FROM events) SELECT session, max(seq) AS seq FROM e WHERE event_type = 'click' AND seq % 3 <> 0 AND (m < 2 OR m - 2 = session % 2) GROUP BY session")
def latest_compaction(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    status = F.when(n % 3 != 0, "completed").otherwise("failed")
    context = F.when(n % 4 >= 2, _cat(',"providerContext":{"provenance":{"model":"m', n % 4 - 2, '"}}')).otherwise("")
    messages = e.select(F.col("user_id").alias("session"), n.alias("seq"), F.when(F.col("event_type") == "click", "compaction").otherwise("note").alias("type"), F.concat(F.lit('{"status":"'), status, F.lit('"'), context, F.lit("}")).alias("data"))
    return service.latest_compaction(messages, ["model"], e.select(F.col("user_id").alias("session"), _cat("m", F.col("user_id") % 2).alias("model")).distinct())


@query("project_list", "SELECT s_suppkey AS id, s_acctbal AS active FROM supplier WHERE s_suppkey % 4 <> 0 ORDER BY s_acctbal DESC, s_suppkey")
def project_list(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("active"), F.when(F.col("s_suppkey") % 4 == 0, 1).alias("archived")).filter("archived is null").drop("archived").orderBy(F.desc("active"), "id")


@query("parts_by_message", "SELECT conv_id::VARCHAR AS key, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS items FROM conversations GROUP BY conv_id")
def parts_by_message(spark, d):
    c = table(spark, d, "conversations").withColumn("part", F.concat_ws(":", F.col("turn").cast("string"), "role"))
    return service.group_by(c, F.col("conv_id").cast("string"), "part", ["turn", "role"]).withColumn("items", F.array_join("items", ","))


@query("rule_labels", "SELECT l_returnflag AS source, l_linestatus AS pattern, l_linenumber > 4 AS by_default, CASE WHEN l_linenumber > 4 THEN CASE WHEN l_returnflag = 'N' THEN 'default:engine' ELSE 'default:' || l_returnflag END ELSE l_returnflag || ': ' || l_linestatus END AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def rule_labels(spark, d):
    by = F.col("l_linenumber") > 4
    label = service.rule_label(by, F.when(by & (F.col("l_returnflag") == "N"), "").otherwise(F.col("l_returnflag")), F.col("l_linestatus"))
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("pattern"), by.alias("by_default"), label.alias("label")).agg(F.count("*").alias("n"))


@query("manifest_covers", """WITH q AS (SELECT DISTINCT 'm' || (p_size % 5) AS manifest, CASE p_partkey % 5 WHEN 0 THEN 'mod' || (p_partkey % 9) WHEN 1 THEN 'mod' || (p_partkey % 9) || '.f.g' WHEN 2 THEN 'src/a' || (p_partkey % 7) || '/' WHEN 3 THEN 'src/a' || (p_partkey % 7) || '/x.py' ELSE 'src/a' || (p_partkey % 7) || '/x.py:12' END AS query FROM part), i AS (SELECT 'm' || a AS manifest, 'mod' || b AS id FROM range(0, 5) x(a), range(0, 9) y(b) WHERE (a + b) % 3 = 0), p AS (SELECT 'm' || a AS manifest, 'src/a' || b || '/x.py' AS path FROM range(0, 5) x(a), range(0, 7) y(b) WHERE (a + b) % 2 = 0)
SELECT q.*, EXISTS (SELECT 1 FROM i WHERE i.manifest = q.manifest AND (q.query = i.id OR starts_with(q.query, i.id || '.'))) OR (regexp_matches(query, '[/.]') AND EXISTS (SELECT 1 FROM p WHERE p.manifest = q.manifest AND (path = rtrim(query, '/') OR starts_with(path, rtrim(query, '/') || '/') OR starts_with(rtrim(query, '/'), path)))) AS covered FROM q""")
def manifest_covers(spark, d):
    p, k, n = table(spark, d, "part"), F.col("p_partkey") % 5, F.col("p_partkey")
    text = F.when(k == 0, _cat("mod", n % 9)).when(k == 1, _cat("mod", n % 9, ".f.g")).when(k == 2, _cat("src/a", n % 7, "/")).when(k == 3, _cat("src/a", n % 7, "/x.py")).otherwise(_cat("src/a", n % 7, "/x.py:12"))
    ids = spark.createDataFrame([(f"m{a}", f"mod{b}") for a in range(5) for b in range(9) if (a + b) % 3 == 0], "manifest string, id string")
    paths = spark.createDataFrame([(f"m{a}", f"src/a{b}/x.py") for a in range(5) for b in range(7) if (a + b) % 2 == 0], "manifest string, path string")
    return service.covered(p.select(_cat("m", F.col("p_size") % 5).alias("manifest"), text.alias("query")), ids, paths)


@query("last_envelope", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{\"type\":\"result\",\"n\":' || event_id || '}' WHEN 1 THEN '{\"type\":\"result\",\"n\":1}' END AS envelope FROM events")
def last_envelope(spark, d):
    k = F.col("event_id")
    first = F.lit('log\n{"type":"result","n":1}\n{"type": broken\n')
    text = F.when(k % 4 == 0, F.concat(first, F.lit('  {"type":"result","n":'), k.cast("string"), F.lit('}\nend'))).when(k % 4 == 1, F.concat(first, F.lit('{"type":"other"}'))).when(k % 4 == 2, "no json").otherwise('{"type":"note"}')
    return service.last_envelope(table(spark, d, "events").select(k.alias("id"), text.alias("text")))


@query("graph_freshness", "SELECT 'r' || s_suppkey AS repo, CASE s_suppkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'stale' WHEN 3 THEN 'stale' ELSE 'fresh' END AS status FROM supplier")
def graph_freshness(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    repo, head = _cat("r", k).alias("repo"), _cat("h", k)
    graph_ = s.filter("s_suppkey % 6 <> 0").select(repo, F.lit("graph").alias("name"), F.when(k % 6 == 2, "old").otherwise(head).alias("sha"), (k % 6 != 1).alias("readable"))
    tests = s.select(repo, F.lit("tests"), F.when(k % 6 == 3, "old").when(k % 6 == 2, "old").otherwise(head), F.lit(True))
    return service.freshness(graph_.union(tests), s.select(repo, head.alias("head")))


@query("name_universes", "SELECT universe, count(*) AS n FROM (SELECT 'id' AS universe, 'p' || p_partkey AS name FROM part UNION SELECT 'id', 's.' || p_name FROM part UNION SELECT 'qual', 'q.' || p_name FROM part UNION SELECT 'name', p_name FROM part UNION SELECT 'module', 'p' || p_partkey FROM part WHERE p_partkey % 5 <> 0 UNION SELECT 'path', p_brand FROM part WHERE p_partkey % 5 <> 0 UNION SELECT 'id', 'ext:' || p_type FROM part WHERE p_partkey % 5 = 0 UNION SELECT 'ext', p_type FROM part WHERE p_partkey % 5 = 0) WHERE NOT (universe = 'id' AND starts_with(name, 'p') AND TRY_CAST(substr(name, 2) AS BIGINT) % 5 = 0) GROUP BY universe")
def name_universes(spark, d):
    p, own = table(spark, d, "part"), F.col("p_partkey") % 5 != 0
    nodes = p.select(F.when(own, _cat("p", F.col("p_partkey"))).otherwise(_cat("ext:", F.col("p_type"))).alias("id"), F.when(own, F.col("p_brand")).alias("path"))
    symbols = p.select(_cat("s.", F.col("p_name")).alias("id"), _cat("q.", F.col("p_name")).alias("qualname"), F.col("p_name").alias("name"))
    return service.name_universes(nodes, symbols).groupBy("universe").agg(F.count("*").alias("n"))


@query("report_blocks", "SELECT n_nationkey AS id, b::INT AS block, k AS name, v AS value FROM (SELECT n_nationkey, 0 AS b, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 0, 'at', '1:2' FROM nation UNION ALL SELECT n_nationkey, 1, 'region', n_regionkey::VARCHAR FROM nation)")
def report_blocks(spark, d):
    text = F.concat(F.lit("intro\n```report\nname: "), "n_name", F.lit("\nat: 1:2\nplain\n```\ntext: no\n```report\nregion: "), F.col("n_regionkey").cast("string"), F.lit("\n```\n```other\nx: y\n```"))
    return service.report_blocks(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), text.alias("text")))


@query("world_distance", "WITH c AS (SELECT o_orderpriority AS world, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT world, key, n / sum(n) OVER (PARTITION BY world) AS share FROM c), w AS (SELECT DISTINCT o_orderpriority AS world FROM orders), b AS (SELECT world, key, share FROM w, (VALUES ('F', 0.4), ('O', 0.4), ('X', 0.2)) t(key, share)) SELECT coalesce(a.world, b.world) AS world, round(sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0)))::DOUBLE / 2, 6) AS distance FROM a FULL JOIN b ON a.world = b.world AND a.key = b.key GROUP BY 1")
def world_distance(spark, d):
    o = table(spark, d, "orders")
    n = o.groupBy(F.col("o_orderpriority").alias("world"), F.col("o_orderstatus").alias("key")).agg(F.count("*").alias("n"))
    seen = n.join(n.groupBy("world").agg(F.sum("n").alias("t")), "world").select("world", "key", (F.col("n") / F.col("t")).alias("share"))
    expected = n.select("world").distinct().withColumn("k", F.explode(F.array(*(F.struct(F.lit(a).alias("key"), F.lit(b).alias("share")) for a, b in (("F", 0.4), ("O", 0.4), ("X", 0.2)))))).select("world", "k.key", "k.share")
    return service.total_variation(seen, expected)


HUNKS = """hu AS (SELECT l_orderkey % 40 AS template, l_orderkey * 10 + l_linenumber AS hunk, 'f' || (l_partkey % 20) AS path, l_partkey % 90 AS s, l_partkey % 90 + l_linenumber AS e, l_tax = 0.08 AS created FROM lineitem WHERE l_quantity < 6 QUALIFY row_number() OVER (PARTITION BY hunk ORDER BY path, s, e) = 1), ho AS (SELECT l_orderkey % 40 AS template, 'f' || (l_partkey % 20) AS path, l_suppkey % 90 AS s, l_suppkey % 90 + 6 AS e, CASE l_linenumber % 3 WHEN 0 THEN 'BODY' WHEN 1 THEN 'MODULE_REGION' ELSE 'NOTE' END AS type FROM lineitem WHERE l_quantity > 48)"""


def _hunks(spark, d):
    c, li = F.col, table(spark, d, "lineitem")
    hunks = li.filter("l_quantity < 6").select((c("l_orderkey") % 40).alias("template"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("hunk"), _cat("f", c("l_partkey") % 20).alias("path"), (c("l_partkey") % 90).alias("start"), (c("l_partkey") % 90 + c("l_linenumber")).alias("end"), (c("l_tax") == 0.08).alias("created"))
    order = [x for k in ("path", "start", "end") for x in (c(k).isNull().alias(f"no_{k}"), c(k))]  # nulls last, as in the SQL
    first = hunks.groupBy("hunk").agg(F.min(F.struct(*order, "template", "created")).alias("h")).select("hunk", *(f"h.{k}" for k in ("path", "start", "end", "template", "created")))
    k = c("l_linenumber") % 3
    holes = li.filter("l_quantity > 48").select((c("l_orderkey") % 40).alias("template"), _cat("f", c("l_partkey") % 20).alias("path"), (c("l_suppkey") % 90).alias("start"), (c("l_suppkey") % 90 + 6).alias("end"), F.when(k == 0, "BODY").when(k == 1, "MODULE_REGION").otherwise("NOTE").alias("type"))
    return first, holes


@query("template_coverage", f"WITH {HUNKS}, x AS (SELECT hu.template, CASE WHEN created THEN 'new_file' WHEN EXISTS (SELECT 1 FROM ho WHERE ho.template = hu.template AND ho.path = hu.path AND ho.s <= hu.e AND hu.s <= ho.e AND type = 'BODY') THEN 'symbol' WHEN EXISTS (SELECT 1 FROM ho WHERE ho.template = hu.template AND ho.path = hu.path AND ho.s <= hu.e AND hu.s <= ho.e AND type = 'MODULE_REGION') THEN 'region' ELSE 'outside' END AS bucket FROM hu) SELECT template, bucket, count(*) AS n FROM x GROUP BY ALL")
def template_coverage(spark, d):
    return templates.coverage(*_hunks(spark, d))


@query("template_anchors", f"""WITH {HUNKS}, an AS (SELECT DISTINCT l_orderkey % 40 AS template, CASE WHEN l_linenumber < 3 THEN 'name' ELSE 'literal' END AS matcher, CASE WHEN l_suppkey % 2 = 0 THEN 'f' || (l_partkey % 20) ELSE 's' || (l_partkey % 60) END AS node FROM lineitem WHERE l_quantity = 30), sy AS (SELECT 's' || i AS scope, 'f' || (i % 20) AS path, i AS s, i + i % 30 AS e FROM range(0, 60) t(i)),
ln AS (SELECT DISTINCT template, path, s AS line FROM hu), gs AS (SELECT DISTINCT template, (SELECT arg_min(scope, lpad((sy.e - sy.s)::VARCHAR, 4, '0') || lpad((9999 - sy.s)::VARCHAR, 4, '0') || scope) FROM sy WHERE sy.path = ln.path AND ln.line BETWEEN sy.s AND sy.e) AS node FROM ln)
SELECT matcher, count(*) AS anchors, count(*) FILTER (WHERE (template, CASE WHEN node LIKE 's%' THEN 'f' || (node[2:]::INT % 20) ELSE node END) IN (SELECT (template, path) FROM hu)) AS file_hits, count(*) FILTER (WHERE (template, node) IN (SELECT (template, node) FROM gs WHERE node IS NOT NULL)) AS symbol_hits FROM an GROUP BY matcher""")
def template_anchors(spark, d):
    c = F.col
    anchors = table(spark, d, "lineitem").filter("l_quantity = 30").select((c("l_orderkey") % 40).alias("template"), F.when(c("l_linenumber") < 3, "name").otherwise("literal").alias("matcher"), F.when(c("l_suppkey") % 2 == 0, _cat("f", c("l_partkey") % 20)).otherwise(_cat("s", c("l_partkey") % 60)).alias("node")).distinct()
    i = c("id")
    symbols = spark.range(60).select(_cat("f", i % 20).alias("path"), _cat("s", i).alias("scope"), i.alias("start"), (i + i % 30).alias("end"))
    paths = symbols.select(F.col("scope").alias("node"), "path").union(spark.range(20).select(_cat("f", i), _cat("f", i)))
    return templates.score_anchors(anchors, paths, symbols, _hunks(spark, d)[0].select("template", "path", F.col("start").alias("line")))


HOLES = "ho AS (SELECT o_custkey AS template, 'H' || o_orderkey AS hole, (['SIGNATURE', 'CALLER_UPDATE', 'MODULE_REGION', 'BODY'])[(o_orderkey % 4 + 1)::INT] AS type, 'y' || (o_orderkey % 3) AS symbol, CASE WHEN o_orderkey % 5 = 0 THEN 'class' ELSE 'function' END AS kind, 'y' || (o_orderkey % 4) AS callee, o_orderkey % 19 = 0 AS closed, CASE WHEN o_orderkey % 2 = 0 THEN 'unchanged' ELSE 'x' END AS value FROM orders)"


@query("closed_holes", f"WITH {HOLES} SELECT template, hole, CASE WHEN type = 'CALLER_UPDATE' THEN 'signature of ' || callee || ' unchanged' ELSE 'unchanged' END AS reason FROM ho WHERE NOT closed AND ((type = 'CALLER_UPDATE' AND (template, callee) IN (SELECT (template, symbol) FROM ho WHERE type = 'SIGNATURE' AND value = 'unchanged' AND kind = 'function')) OR (type = 'MODULE_REGION' AND value = 'unchanged'))")
def closed_holes(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("SIGNATURE", "CALLER_UPDATE", "MODULE_REGION", "BODY")))
    holes = o.select(F.col("o_custkey").alias("template"), _cat("H", k).alias("hole"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("type"), _cat("y", k % 3).alias("symbol"), F.when(k % 5 == 0, "class").otherwise("function").alias("kind"), _cat("y", k % 4).alias("callee"), (k % 19 == 0).alias("closed"))
    fills = o.select(F.col("o_custkey").alias("template"), _cat("H", k).alias("hole"), F.when(k % 2 == 0, "unchanged").otherwise("x").alias("value"))
    return templates.close_implied(holes, fills)


@query("literal_anchors", "WITH h AS (SELECT DISTINCT l_returnflag AS literal, 'f' || (l_partkey % 20) AS path, l_orderkey % 80 AS line FROM lineitem WHERE l_quantity > 46), sy AS (SELECT 's' || i AS scope, 'f' || (i % 20) AS path, i AS s, i + i % 30 AS e FROM range(0, 60) t(i)) SELECT literal, path, line, (SELECT arg_min(scope, lpad((e - s)::VARCHAR, 4, '0') || lpad((9999 - s)::VARCHAR, 4, '0') || scope) FROM sy WHERE sy.path = h.path AND h.line BETWEEN s AND e) AS symbol FROM h")
def literal_anchors(spark, d):
    c, i = F.col, F.col("id")
    hits = table(spark, d, "lineitem").filter("l_quantity > 46").select(c("l_returnflag").alias("literal"), _cat("f", c("l_partkey") % 20).alias("path"), (c("l_orderkey") % 80).alias("line"))
    return templates.literal_anchors(hits, spark.range(60).select(_cat("f", i % 20).alias("path"), _cat("s", i).alias("scope"), i.alias("start"), (i + i % 30).alias("end")))


@query("anchor_candidates", "WITH t AS (SELECT DISTINCT lower(p_type) AS term FROM part WHERE p_size < 8), n AS (SELECT DISTINCT p_name AS name FROM part), pt AS (SELECT DISTINCT term, substr(term, i, 3) AS g FROM t, range(1, 60) r(i) WHERE i <= greatest(length(term) - 2, 1)), pn AS (SELECT DISTINCT name, lower(substr(name, i, 3)) AS g FROM n, range(1, 60) r(i) WHERE i <= greatest(length(name) - 2, 1)), b AS (SELECT term, name, count(*) AS shared FROM pt JOIN pn USING (g) GROUP BY ALL), s AS (SELECT b.*, round(shared / ((SELECT count(*) FROM pt WHERE pt.term = b.term) + (SELECT count(*) FROM pn WHERE pn.name = b.name) - shared), 6) AS share FROM b) SELECT term, name, shared, share, row_number() OVER (PARTITION BY term ORDER BY share DESC, name)::INT AS place FROM s QUALIFY place <= 3")
def anchor_candidates(spark, d):
    p = table(spark, d, "part")
    return templates.anchor_candidates(p.filter("p_size < 8").select(F.lower("p_type").alias("term")), p.select(F.col("p_name").alias("name")), 3)


@query("merge_units")
def merge_units(spark, d):
    """Brands as modules, coupled by suppliers in common; greedy merging, checked by brute force in tests."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    own = li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("s"), F.col("p_brand").alias("b")).distinct()
    modules = own.groupBy(F.col("b").alias("module")).agg((F.count("*") * 40).alias("weight")).withColumn("score", F.when(F.col("module").endswith("1"), 1.0).otherwise(F.col("weight") / 100_000))
    pairs = own.withColumnRenamed("b", "a").join(own, "s").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    return partition.partition(modules, pairs, 9_000, 6).withColumn("flags", F.array_join("flags", ","))


@query("cochange_seen_twice", f"WITH {COMMITS} SELECT a, b, n FROM pairs WHERE n >= 2")
def cochange_seen_twice(spark, d):
    return planning.cochange(_commits(spark, d)).filter("n >= 2").select("a", "b", "n")


LOG = "lg AS (SELECT user_id AS aggregate, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, 'e' || event_id AS id, event_type AS data FROM events WHERE event_id % 3 <> 0)"


def _log(spark, d):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").filter("event_id % 3 <> 0").select(F.col("user_id").alias("aggregate"), seq.cast("long").alias("seq"), _cat("e", F.col("event_id")).alias("id"), F.col("event_type").alias("data"))


@query("log_publish", f"WITH {LOG}, nw AS (SELECT event_id AS arrival, CASE WHEN event_id % 5 = 0 THEN 'e' || (event_id + 1) WHEN event_id % 7 = 0 THEN 'dup' ELSE 'n' || event_id END AS id, user_id AS aggregate FROM events WHERE event_id % 3 = 0), f AS (SELECT * FROM nw WHERE id NOT IN (SELECT id FROM lg) QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrival) = 1) SELECT f.aggregate, coalesce((SELECT max(seq) FROM lg WHERE lg.aggregate = f.aggregate), -1) + row_number() OVER (PARTITION BY f.aggregate ORDER BY arrival) AS seq, id FROM f")
def log_publish(spark, d):
    k = F.col("event_id")
    new = table(spark, d, "events").filter("event_id % 3 = 0").select(k.alias("arrival"), F.when(k % 5 == 0, _cat("e", k + 1)).when(k % 7 == 0, "dup").otherwise(_cat("n", k)).alias("id"), F.col("user_id").alias("aggregate"), F.col("event_type").alias("data"))
    return eventlog.publish(_log(spark, d), new)[0].select("aggregate", F.col("seq").cast("long").alias("seq"), "id")


@query("log_replay", f"WITH {LOG}, m AS (SELECT aggregate, max(seq) AS last FROM lg GROUP BY aggregate), ic AS (SELECT aggregate, seq, CASE WHEN seq % 6 = 5 THEN 'other' ELSE id END AS id, data FROM lg WHERE seq % 2 = 1 UNION ALL SELECT aggregate, last + i, 'x' || i, 'd' FROM m, (VALUES (1), (2), (4)) t(i)) SELECT ic.aggregate, ic.seq, ic.id, CASE WHEN lg.seq IS NOT NULL THEN CASE WHEN lg.id = ic.id AND lg.data = ic.data THEN 'skip' ELSE 'divergent' END WHEN ic.seq - last <= 2 THEN 'append' ELSE 'gap' END AS what FROM ic JOIN m ON m.aggregate = ic.aggregate LEFT JOIN lg ON lg.aggregate = ic.aggregate AND lg.seq = ic.seq")
def log_replay(spark, d):
    log = _log(spark, d)
    old = log.filter("seq % 2 = 1").withColumn("id", F.when(F.col("seq") % 6 == 5, "other").otherwise(F.col("id")))
    more = log.groupBy("aggregate").agg(F.max("seq").alias("last")).withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 4)))))
    return eventlog.replay(log, old.unionByName(more.select("aggregate", (F.col("last") + F.col("i")).alias("seq"), _cat("x", F.col("i")).alias("id"), F.lit("d").alias("data"))))


@query("log_read", f"WITH {LOG}, m AS (SELECT aggregate, max(seq) AS mark FROM lg GROUP BY aggregate) SELECT aggregate, 0 AS part, seq, id FROM lg WHERE seq > 3 UNION ALL SELECT aggregate, 1, mark, 'synced' FROM m UNION ALL SELECT l.aggregate, 2, l.seq + 2, 'live' FROM lg l JOIN m ON m.aggregate = l.aggregate WHERE l.seq + 2 > mark")
def log_read(spark, d):
    log = _log(spark, d)
    return eventlog.read_then_live(log, log.select("aggregate", (F.col("seq") + 2).alias("seq"), F.lit("live").alias("id")), 3)


@query("stream_claims", "SELECT 's' || (user_id % 20) AS stream, user_id AS writer, event_id AS at, user_id = first(user_id) OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS granted FROM events")
def stream_claims(spark, d):
    return eventlog.claim(table(spark, d, "events").select(_cat("s", F.col("user_id") % 20).alias("stream"), F.col("user_id").alias("writer"), F.col("event_id").alias("at")))


@query("mail_sequence", "WITH o AS (SELECT user_id % 9 AS box, count(*) AS last FROM events WHERE event_type = 'error' GROUP BY 1) SELECT n.box, (coalesce(last, 0) + row_number() OVER (PARTITION BY n.box ORDER BY arrival))::BIGINT AS seq, body FROM (SELECT user_id % 9 AS box, event_id AS arrival, 'b' || event_id AS body FROM events WHERE event_type = 'signup') n LEFT JOIN o ON o.box = n.box")
def mail_sequence(spark, d):
    from pyspark.sql import Window

    e, box = table(spark, d, "events"), (F.col("user_id") % 9).alias("box")
    old = e.filter("event_type = 'error'").select(box, F.row_number().over(Window.partitionBy(F.col("user_id") % 9).orderBy("event_id")).alias("seq"))
    return eventlog.append_mail(old, e.filter("event_type = 'signup'").select(box, F.col("event_id").alias("arrival"), _cat("b", F.col("event_id")).alias("body")))


@query("flight_lines", "SELECT user_id AS session, '{\"at\":\"' || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE '2024-05-01T00:00:00' END || '\",\"tool\":\"' || event_type || '\"}' AS line FROM events")
def flight_lines(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.when(F.col("event_id") % 2 == 0, F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("tool"))
    return eventlog.record_flight(e, "2024-05-01 00:00:00")


@query("debounced_refreshes")
def debounced_refreshes(spark, d):
    """Refreshes of a day for users' events in hours; a fold over each user's asks, checked by brute force in tests."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), (F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long").alias("at"))
    return eventlog.refreshes(e.distinct(), 24)


@query("pack_union", f"WITH {GRAPH_SQL} SELECT src, dst, type, CASE WHEN src LIKE 'nation%' THEN 'syntactic' ELSE 'dynamic' END AS tier, CASE WHEN src LIKE 'nation%' THEN 'nations' ELSE 'all' END AS pack FROM medges")
def pack_union(spark, d):
    """Three passes: one over nations, one that fails, one over everything."""
    registry = packs.Registry()
    registry.register(packs.Pack("nations", "syntactic", lambda c: True, lambda c: c["edges"].filter("startswith(src, 'nation')")))
    registry.register(packs.Pack("broken", "dynamic", lambda c: True, lambda c: c["edges"].select("no such column")))
    registry.register(packs.Pack("absent", "dynamic", lambda c: "routes" in c, lambda c: c["routes"]))
    registry.register(packs.Pack("all", "dynamic", lambda c: True, lambda c: c["edges"]))
    return packs.run_packs(spark, {"edges": domain.module_edges(spark, d)}, registry.packs)[0]


@query("soft_rules", "SELECT 'r' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'unknown' WHEN n_regionkey = 1 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN n_nationkey % 5 = 0 THEN 'ValueError' ELSE 'read ' || length(n_name || ' ' || n_regionkey) END AS reason FROM nation")
def soft_rules(spark, d):
    def judge(statement: str) -> tuple[str, str]:
        name, region = statement.split(" ")
        if int(name.rpartition("_")[2]) % 5 == 0:
            raise ValueError(statement)
        return ("fail" if region == "1" else "pass"), f"read {len(statement)}"

    n = table(spark, d, "nation").select(_cat("r", F.col("n_nationkey")).alias("id"), _cat(F.col("n_name"), " ", F.col("n_regionkey")).alias("statement"))
    return packs.judge_soft(n, judge)


@query("entropy_bins", "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), q AS (SELECT (SELECT min(value) FROM v WHERE r = ceil(s * n)) AS c FROM (SELECT unnest([0.25, 0.5, 0.75]) AS s)) SELECT event_id, (SELECT count(*) FROM q WHERE c <= value)::INT AS bin FROM events")
def entropy_bins(spark, d):
    e = table(spark, d, "events")
    cuts = stats.quantile_cuts(e, "value", [0.25, 0.5, 0.75]).agg(F.collect_list("cut").alias("cuts"))  # three values
    return e.join(F.broadcast(cuts), how="cross").select("event_id", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("value"))), F.lit(0)).alias("bin"))


@query("median_duration", "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_duration(spark, d):
    return stats.medians(table(spark, d, "events"), "event_type", "value").withColumn("median", F.round("median", 6))


@query("severity_order", "SELECT p_brand AS id, row_number() OVER (ORDER BY CASE WHEN min(p_size) < 3 THEN 0 ELSE 4 END, substr(p_brand, 7)::INT, p_brand) AS place FROM part GROUP BY p_brand")
def severity_order(spark, d):
    verdicts = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.when(F.min("p_size") < 3, "fail").otherwise("pass").alias("verdict"))
    return rules.ordered(verdicts).select("id", "place")


@query("grid_neighbours", "WITH c AS (SELECT DISTINCT p_brand AS a, p_size AS b FROM part) SELECT x.a, x.b, count(*) AS n FROM c x JOIN c y ON (x.a = y.a AND abs(x.b - y.b) = 1) OR (x.b = y.b AND x.a <> y.a) GROUP BY x.a, x.b")
def grid_neighbours(spark, d):
    """Cells beside each cell, by an equi-join for each side: the next size either way, and the row's other brands by its count."""
    c = table(spark, d, "part").select(F.col("p_brand").alias("a"), F.col("p_size").alias("b")).distinct()
    near = c.select("a", F.explode(F.array(F.col("b") - 1, F.col("b") + 1)).alias("b")).join(c, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("n"))
    row = c.groupBy("b").agg((F.count("*") - 1).alias("others"))
    both = c.join(near, ["a", "b"], "left").join(row, "b").select("a", "b", (F.coalesce("n", F.lit(0)) + F.col("others")).alias("n"))
    return both.filter("n > 0")


@query("artifact_round_trip", "SELECT n_nationkey AS id, n_name AS name, 'abc' AS sha FROM nation")
def artifact_round_trip(spark, d):
    """An artifact written with its stamp and order, and read back behind its version gate."""
    path = scratch_path(spark, "artifact")
    files.write_artifact(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(4).alias("schema_version")), path, ["id"], {"sha": "abc"})
    return files.require_version(files.read_jsonl(spark, path, "id INT, name STRING, sha STRING, schema_version INT"), {3, 4}, "nations").select("id", "name", "sha")


@query("jsonl_round_trip", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def jsonl_round_trip(spark, d):
    path = scratch_path(spark, "jsonl")
    files.append_jsonl(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    files.append_jsonl(table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name")), path)
    return files.read_jsonl(spark, path, "id INT, name STRING")


@query("instances_round_trip", "SELECT p_partkey AS id, p_brand || ',' || p_type AS tests FROM part")
def instances_round_trip(spark, d):
    path = scratch_path(spark, "instances")
    table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.array("p_brand", "p_type")).alias("tests")).write.json(path)
    return files.read_instances(spark, path, "id LONG, tests STRING", ["tests"], False).withColumn("tests", F.array_join("tests", ","))


@query("log_cursor", "WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line, event_type FROM events WHERE event_id < 400) SELECT line, event_type AS tool FROM s WHERE line > 100 AND line <= 150 AND event_id % 11 <> 0")
def log_cursor(spark, d):
    """A log with torn lines, read on from a cursor; torn lines keep their numbers."""
    path = scratch_path(spark, "log")
    e = table(spark, d, "events").filter("event_id < 400").orderBy("event_id").coalesce(1)
    whole = F.to_json(F.struct(F.col("event_type").alias("tool")))
    e.select(F.when(F.col("event_id") % 11 == 0, F.left(whole, F.lit(8))).otherwise(whole).alias("value")).write.text(path)
    return files.log_page(files.read_log(spark, path, "tool STRING"), 100, 50).select("line", "tool")


@query("version_gate", "SELECT 3 AS found, false AS accepted UNION ALL SELECT 4, true")
def version_gate(spark, d):
    rows = []
    for found in (3, 4):
        df = table(spark, d, "region").select(F.lit(found).alias("schema_version"))
        try:
            files.require_version(df, {4, 5}, "regions")
            rows.append((found, True))
        except files.VersionError:
            rows.append((found, False))
    return spark.createDataFrame(rows, "found int, accepted boolean")


@query("escalation_scan", "SELECT 's' || (o_custkey % 7) AS session, o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 50 <> 3 AND o_orderkey < 500 ORDER BY o_orderdate, o_orderkey")
def escalation_scan(spark, d):
    path = scratch_path(spark, "escalations")
    o = table(spark, d, "orders").filter("o_orderkey < 500")
    whole = F.to_json(F.struct(_cat("s", F.col("o_custkey") % 7).alias("session"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("string").alias("at")))
    o.select(F.when(F.col("o_orderkey") % 50 == 3, F.left(whole, F.lit(20))).otherwise(whole).alias("value")).write.text(path)
    return files.read_escalations(spark, path).select("session", "id", "status")


@query("compiled_rules", "SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'import-linter' ELSE 'eslint' END AS target, string_agg('forbid ' || s_name, chr(10) ORDER BY s_suppkey) AS config FROM supplier GROUP BY 1")
def compiled_rules(spark, d):
    r = table(spark, d, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "import-linter").otherwise("eslint").alias("target"), F.col("s_suppkey").alias("position"), F.lit("forbid").alias("kind"), F.col("s_name").alias("what"))
    return rules.compile_rules(r, {"import-linter": "{kind} {what}", "eslint": "{kind} {what}"})


@query("change_spec", "SELECT n_regionkey AS plan, '{\"plan\":' || n_regionkey || ',\"units\":[' || string_agg('{\"name\":\"' || n_name || '\",\"weight\":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']}' AS spec FROM nation GROUP BY n_regionkey")
def change_spec(spark, d):
    """A plan as one nested document."""
    units = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda u: F.struct(u["n_name"].alias("name"), u["n_nationkey"].alias("weight")))
    specs = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("plan")).agg(units.alias("units"))
    return specs.select("plan", F.to_json(F.struct("plan", "units")).alias("spec"))


@query("any_change", f"{WITH}, b AS (SELECT DISTINCT src, dst FROM calls WHERE line <= 3), h AS (SELECT DISTINCT src, dst FROM calls WHERE line >= 2) SELECT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM h) OR EXISTS (SELECT * FROM h EXCEPT SELECT * FROM b) AS edges, EXISTS (SELECT src FROM b EXCEPT SELECT src FROM h) OR EXISTS (SELECT src FROM h EXCEPT SELECT src FROM b) AS nodes")
def any_change(spark, d):
    from evigraph.operators import diff

    c = domain.calls(spark, d).select("src", "dst", "line")
    b, h = c.filter("line <= 3").select("src", "dst").distinct(), c.filter("line >= 2").select("src", "dst").distinct()
    flag = lambda x, y, name: diff.any_change(x, y).withColumnRenamed("changed", name)
    return flag(b, h, "edges").join(flag(b.select("src").distinct(), h.select("src").distinct(), "nodes"), how="cross")


@query("graph_levels_of_calls", f"{WITH} SELECT id, CASE WHEN id LIKE 'supplier%' THEN 1 ELSE 0 END::INT AS level FROM (SELECT src AS id FROM calls UNION SELECT dst FROM calls)")
def graph_levels_of_calls(spark, d):
    return graph.levels(domain.calls(spark, d).select("src", "dst").distinct())
