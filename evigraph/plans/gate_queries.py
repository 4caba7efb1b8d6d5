"""Queries of gates, references, sites, decisions and requirements."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import gate
from evigraph.plans.registry import query
from evigraph.plans.rule_queries import RULE_SCHEMA, RULE_SQL, RULES
from evigraph.sources import domain
from evigraph.sources.domain import GRAPH_SQL, table


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("plan_gate", f"""WITH {GRAPH_SQL}, {RULE_SQL}, a AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN 'new:' ELSE 'customer:' END || c_custkey AS src, 'nation:' || (c_custkey % 9) AS dst FROM customer),
x AS (SELECT id, row_number() OVER () AS pos, scope, importers, "except", imported FROM rules WHERE status = 'confirmed' AND kind = 'forbidden-import'),
h AS (SELECT a.src, a.dst, arg_min(x.id, regexp_extract(x.id, '[0-9]+')::INT) AS invariant FROM a JOIN x ON list_contains(x.imported, a.dst) LEFT JOIN nodes n ON n.id = a.src WHERE NOT list_contains(x."except", a.src) AND (n.path IS NULL OR x.scope IN ('', '.', '*') OR n.path = x.scope OR starts_with(n.path, x.scope || '/'))
 AND len(list_filter(x.importers, lambda p: p = '*' OR (CASE WHEN p LIKE '%.*' OR p LIKE '%/*' THEN starts_with(a.src, p[:-2]) ELSE p = a.src END))) > 0 GROUP BY ALL)
SELECT a.src, a.dst, CASE WHEN h.src IS NULL THEN 'pass' ELSE 'fail' END AS verdict, h.invariant FROM a LEFT JOIN h ON h.src = a.src AND h.dst = a.dst""")
def plan_gate(spark, d):
    c = table(spark, d, "customer")
    adds = c.select(_cat(F.when(F.col("c_custkey") % 4 == 0, "new:").otherwise("customer:"), F.col("c_custkey")).alias("src"), _cat("nation:", F.col("c_custkey") % 9).alias("dst"))
    rules = spark.createDataFrame(RULES, RULE_SCHEMA).withColumn("position", F.regexp_extract("id", "[0-9]+", 0).cast("int"))
    return gate.plan_gate(adds, rules, domain.nodes(spark, d))


@query("callee_sets", """WITH li AS (SELECT 'o' || (l_orderkey % 200) AS body, 'f' || (l_partkey % 9) AS callee, l_returnflag AS r, l_linestatus AS s FROM lineitem), g AS (SELECT DISTINCT body, callee FROM li WHERE r <> 'N' AND callee < 'f5'), h AS (SELECT DISTINCT body, callee FROM li WHERE s = 'O' AND callee > 'f1'),
b AS (SELECT DISTINCT body FROM li) SELECT body, coalesce((SELECT string_agg(callee, ',' ORDER BY callee) FROM g WHERE g.body = b.body), '') AS gold, coalesce((SELECT string_agg(callee, ',' ORDER BY callee) FROM h WHERE h.body = b.body), '') AS got,
coalesce((SELECT string_agg(callee, ',' ORDER BY callee) FROM g WHERE g.body = b.body AND callee NOT IN (SELECT callee FROM h WHERE h.body = b.body)), '') AS missing, coalesce((SELECT string_agg(callee, ',' ORDER BY callee) FROM h WHERE h.body = b.body AND callee NOT IN (SELECT callee FROM g WHERE g.body = b.body)), '') AS extra,
coalesce(round((SELECT count(*) FROM g JOIN h USING (body, callee) WHERE g.body = b.body) / nullif((SELECT count(*) FROM (SELECT * FROM g UNION SELECT * FROM h) u WHERE u.body = b.body), 0), 6), 1.0) AS jaccard FROM b""")
def callee_sets(spark, d):
    li = table(spark, d, "lineitem").select(_cat("o", F.col("l_orderkey") % 200).alias("body"), _cat("f", F.col("l_partkey") % 9).alias("callee"), "l_returnflag", "l_linestatus")
    none = lambda rule: li.select("body", F.when(rule, F.col("callee")).alias("callee"))
    out = gate.callee_sets(none((F.col("l_returnflag") != "N") & (F.col("callee") < "f5")), none((F.col("l_linestatus") == "O") & (F.col("callee") > "f1")))
    return out.select("body", *(F.array_join(c, ",").alias(c) for c in ("gold", "got", "missing", "extra")), "jaccard")


@query("outcome_classes", "SELECT class, count(*) AS n FROM (SELECT CASE WHEN l_tax < 0.02 THEN CASE WHEN l_quantity > 25 THEN 'invented' ELSE 'compile' END WHEN l_discount = 0.05 THEN 'not-installed' WHEN l_returnflag = 'R' OR l_linenumber > 5 THEN 'wrong' WHEN l_linestatus = 'F' THEN 'edge' ELSE 'pass' END AS class FROM lineitem) GROUP BY class")
def outcome_classes(spark, d):
    c = F.col
    cls = gate.outcome(c("l_tax") >= 0.02, F.when(c("l_quantity") > 25, 1).otherwise(0), c("l_discount") != 0.05, c("l_returnflag") == "R", F.greatest(c("l_linenumber") - 5, F.lit(0)), F.when(c("l_linestatus") == "F", 1).otherwise(0))
    return table(spark, d, "lineitem").groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


REFS = """refs AS (SELECT DISTINCT 'd' || (l_orderkey % 30) AS doc, CASE l_linenumber % 7 WHEN 0 THEN 'part' || (l_partkey % 12) WHEN 1 THEN 'm' || (l_partkey % 5) || '.part' || (l_partkey % 12) WHEN 2 THEN 'file' || (l_partkey % 6) || '.py' WHEN 3 THEN 'os.path' WHEN 4 THEN 'pkg.m' || (l_partkey % 5) WHEN 5 THEN 'own' || (l_partkey % 3) || '.x' ELSE 'src/file' || (l_partkey % 6) || '.go' END AS ref FROM lineitem),
dfn AS (SELECT 'd' || i AS doc, 'own' || (i % 3) AS name FROM range(0, 20) t(i))"""


@query("reference_classes", f"""WITH {REFS} SELECT doc, ref, CASE WHEN EXISTS (SELECT 1 FROM dfn WHERE dfn.doc = refs.doc AND dfn.name IN (ref, split_part(ref, '.', 1), regexp_extract(ref, '[^.]*$'))) THEN 'defined' WHEN ref IN ('pkg.m0', 'pkg.m1', 'pkg.m2', 'src/file0.py', 'src/file1.py', 'src/file2.go') THEN 'in-graph' WHEN regexp_full_match(ref, 'part[0-7]') THEN 'in-graph'
WHEN regexp_matches(ref, '[.](py|go|ts)$') THEN CASE WHEN ref IN ('file0.py', 'file1.py') THEN 'in-graph' ELSE 'hallucinated' END WHEN ref = 'os.path' THEN 'unverifiable' WHEN regexp_full_match(ref, 'm[0-2][.]part[0-7]') THEN 'in-graph' ELSE 'hallucinated' END AS class FROM refs""")
def reference_classes(spark, d):
    p, li = F.col("l_partkey"), table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 7
    ref = (
        F.when(k == 0, _cat("part", p % 12)).when(k == 1, _cat("m", p % 5, ".part", p % 12)).when(k == 2, _cat("file", p % 6, ".py")).when(k == 3, "os.path").when(k == 4, _cat("pkg.m", p % 5)).when(k == 5, _cat("own", p % 3, ".x")).otherwise(_cat("src/file", p % 6, ".go"))
    )
    refs = li.select(_cat("d", F.col("l_orderkey") % 30).alias("doc"), ref.alias("ref"))
    defined = spark.range(20).select(_cat("d", F.col("id")).alias("doc"), _cat("own", F.col("id") % 3).alias("name"))
    names = [("name", f"part{i}") for i in range(8)] + [("module", f"pkg.m{i}") for i in range(3)] + [("path", x) for x in ("src/file0.py", "src/file1.py", "src/file2.go")] + [("ext", "os")]
    return gate.resolve_references(refs, defined, spark.createDataFrame(names, "universe string, name string"))


SITE_SQL = """refs AS (SELECT o_orderkey AS ref, 's' || (o_custkey % 40) AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'insert' ELSE 'replace' END AS action, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 60 END AS parent, o_orderkey % 17 = 0 AS whole FROM orders),
f AS (SELECT 's' || i AS path, i % 3 <> 0 AS captured, 'r' || i AS reason FROM range(0, 30) t(i)), sy AS (SELECT 's' || (s_suppkey % 40) AS path, 'y' || s_suppkey AS id, s_suppkey % 50 + 1 AS start, s_suppkey % 50 + 1 + s_nationkey AS fin, s_suppkey % 2 = 0 AS captured, 'q' || s_suppkey AS reason FROM supplier), ln AS (SELECT 's' || i AS path, i + 7 AS line, 'l' || i AS reason FROM range(0, 30) t(i))"""


@query("site_statements", f"""WITH {SITE_SQL}, a AS (SELECT r.*, f.captured AS fc, f.reason AS fr, f.path IS NOT NULL AND NOT whole AND parent IS NOT NULL AS live FROM refs r LEFT JOIN f ON f.path = r.path),
b AS (SELECT a.*, (SELECT min(reason) FROM ln WHERE ln.path = a.path AND ln.line = a.parent AND live AND action = 'replace') AS lr, (SELECT arg_min(id || '|' || captured || '|' || reason, (fin - start) * 1000000 + start) FROM sy WHERE live AND sy.path = a.path AND a.parent BETWEEN start AND fin AND (action = 'replace' OR a.parent + 1 <= fin)) AS sym FROM a)
SELECT ref, CASE WHEN lr IS NOT NULL THEN 'site' WHEN sym IS NOT NULL THEN 'symbol' ELSE 'file' END AS grain, CASE WHEN lr IS NOT NULL THEN path || ':' || parent WHEN sym IS NOT NULL THEN split_part(sym, '|', 1) ELSE path END AS id, CASE WHEN lr IS NOT NULL THEN false WHEN sym IS NOT NULL THEN split_part(sym, '|', 2) = 'true' ELSE coalesce(fc, false) END AS captured,
CASE WHEN lr IS NOT NULL THEN lr WHEN sym IS NOT NULL THEN CASE WHEN split_part(sym, '|', 2) = 'false' THEN split_part(sym, '|', 3) END WHEN fc IS NOT NULL THEN CASE WHEN NOT fc THEN fr END ELSE 'unmapped' END AS reason FROM b""")
def site_statements(spark, d):
    return gate.sites_of(*_site_inputs(spark, d))


def _site_inputs(spark, d):
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    key = F.col("o_orderkey")
    refs = o.select(key.alias("ref"), _cat("s", F.col("o_custkey") % 40).alias("path"), F.when(key % 3 == 0, "insert").otherwise("replace").alias("action"), F.when(key % 11 != 0, key % 60).alias("parent"), (key % 17 == 0).alias("whole"))
    i = F.col("id")
    files = spark.range(30).select(_cat("s", i).alias("path"), (i % 3 != 0).alias("captured"), _cat("r", i).alias("reason"))
    start = F.col("s_suppkey") % 50 + 1
    symbols = s.select(_cat("s", F.col("s_suppkey") % 40).alias("path"), _cat("y", F.col("s_suppkey")).alias("id"), start.alias("start"), (start + F.col("s_nationkey")).alias("end"), (F.col("s_suppkey") % 2 == 0).alias("captured"), _cat("q", F.col("s_suppkey")).alias("reason"), F.col("s_suppkey").alias("place"))
    lines = spark.range(30).select(_cat("s", i).alias("path"), (i + 7).alias("line"), _cat("l", i).alias("reason"))
    return refs, files, symbols, lines


@query("diff_gate", f"""WITH {SITE_SQL}, st AS (SELECT r.ref, EXISTS (SELECT 1 FROM f WHERE f.path = r.path AND f.captured) AND r.ref % 2 = 0 AS captured FROM refs r), rf AS (SELECT o_orderkey AS ref, o_custkey % 100 AS diff, (['invented', 'near-miss', 'arity', 'new', 'resolved', 'unimported', 'resolved', 'resolved'])[(o_orderkey % 8 + 1)::INT] AS class FROM orders WHERE o_orderkey % 9 = 0),
t AS (SELECT DISTINCT c_custkey % 100 AS diff, CASE c_custkey % 5 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'src/new' || c_custkey || '.py' WHEN 2 THEN 'docs/x.md' WHEN 3 THEN 'lib/testdata/y.py' ELSE 'lib/z.py' END AS path, c_custkey % 5 = 1 AS created, c_custkey % 5 <> 2 AS is_code FROM customer WHERE c_custkey < 150),
x AS (SELECT diff, CASE WHEN class = 'new' THEN 'routed' WHEN class IN ('invented', 'near-miss') AND NOT st.captured THEN 'unknown' WHEN class IN ('invented', 'near-miss', 'arity', 'unimported') THEN 'blocking' ELSE 'clear' END AS fate FROM rf JOIN st ON st.ref = rf.ref
 UNION ALL SELECT diff, CASE WHEN NOT is_code OR contains(path, 'testdata') OR (created AND path LIKE 'src/%') THEN 'allowed' ELSE 'blocking' END FROM t WHERE path <> 'src/a.py')
SELECT diff, blocking, unknown, routed, allowed, CASE WHEN blocking > 0 THEN 'blocked' ELSE 'clear' END AS verdict FROM (SELECT dd.diff, count(*) FILTER (WHERE fate = 'blocking') AS blocking, count(*) FILTER (WHERE fate = 'unknown') AS unknown, count(*) FILTER (WHERE fate = 'routed') AS routed, count(*) FILTER (WHERE fate = 'allowed') AS allowed FROM (SELECT diff FROM rf UNION SELECT diff FROM t) dd LEFT JOIN x ON x.diff = dd.diff GROUP BY dd.diff)""")
def diff_gate(spark, d):
    refs, files, _, _ = _site_inputs(spark, d)
    sites = refs.join(files.select("path", "captured"), "path", "left").select("ref", (F.coalesce("captured", F.lit(False)) & (F.col("ref") % 2 == 0)).alias("captured"))
    o, c = table(spark, d, "orders").filter("o_orderkey % 9 = 0"), table(spark, d, "customer").filter("c_custkey < 150")
    classes = F.array(*map(F.lit, ("invented", "near-miss", "arity", "new", "resolved", "unimported", "resolved", "resolved")))
    named = o.select(F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 100).alias("diff"), F.element_at(classes, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("class"))
    k = F.col("c_custkey") % 5
    path = F.when(k == 0, "src/a.py").when(k == 1, _cat("src/new", F.col("c_custkey"), ".py")).when(k == 2, "docs/x.md").when(k == 3, "lib/testdata/y.py").otherwise("lib/z.py")
    touched = c.select((F.col("c_custkey") % 100).alias("diff"), path.alias("path"), (k == 1).alias("created"), (k != 2).alias("is_code")).distinct()
    return gate.diff_gate(named, sites, touched, spark.createDataFrame([("src/a.py",)], "path string"))


@query("map_defects", f"WITH {SITE_SQL}, l2 AS (SELECT path, line FROM ln UNION ALL SELECT 'zz', 3), sy2 AS (SELECT path, id, CASE WHEN start > 49 THEN NULL ELSE start END AS start, fin FROM sy) SELECT 'symbol' AS what, id, 'unknown file' AS defect FROM sy2 WHERE path NOT IN (SELECT path FROM f) UNION ALL SELECT 'symbol', id, 'bad span' FROM sy2 WHERE start IS NULL UNION ALL SELECT 'site', path || ':' || line, 'unknown file' FROM l2 WHERE path NOT IN (SELECT path FROM f)")
def map_defects(spark, d):
    _, files, symbols, lines = _site_inputs(spark, d)
    symbols = symbols.withColumn("start", F.when(F.col("start") <= 49, F.col("start")))
    return gate.map_defects(files, symbols, lines.select("path", "line").union(spark.createDataFrame([("zz", 3)], "path string, line long")))


@query("unresolved_by_file", "WITH l AS (SELECT 'o' || (l_orderkey % 300) AS path, CASE WHEN l_quantity > 40 THEN l_linenumber END AS line, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS class, CASE WHEN l_discount > 0.02 THEN l_linenumber END AS n FROM lineitem) SELECT path, coalesce(class, 'unclassed') AS class, sum(coalesce(n, 1))::BIGINT AS n FROM l WHERE line IS NULL AND path IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey < 100) GROUP BY ALL")
def unresolved_by_file(spark, d):
    li = table(spark, d, "lineitem")
    lines = li.select(_cat("o", F.col("l_orderkey") % 300).alias("path"), F.when(F.col("l_quantity") > 40, F.col("l_linenumber")).alias("line"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("class"), F.when(F.col("l_discount") > 0.02, F.col("l_linenumber")).alias("n"))
    return gate.unresolved_by_file(lines, table(spark, d, "orders").filter("o_orderkey < 100").select(_cat("o", F.col("o_orderkey")).alias("path")))


@query("input_hashes", "SELECT 'd' || doc_id AS name, sha256(text) AS sha256 FROM documents UNION ALL SELECT 'partition', sha256('[' || (SELECT string_agg('\"' || n_name || '\"', ',' ORDER BY n_name) FROM nation) || ']')")
def input_hashes(spark, d):
    docs = gate.input_hashes(table(spark, d, "documents").select(_cat("d", F.col("doc_id")).alias("name"), F.col("text").alias("content")))
    return docs.union(gate.partition_hash(table(spark, d, "nation").select(F.col("n_name").alias("path"))).select(F.lit("partition"), "sha256"))


KEYS = "inf AS (SELECT o_orderkey AS position, 'I-' || o_orderkey AS id, '  keep  ' || o_orderpriority || '   apart ' AS statement, ' s' || (o_custkey % 40) AS scope FROM orders), keyed AS (SELECT *, 'sha256:' || left(sha256(trim(regexp_replace(statement, '\\s+', ' ', 'g')) || chr(10) || trim(scope)), 32) AS key FROM inf), led AS (SELECT DISTINCT key FROM keyed WHERE position % 5 = 0)"


def _inferred(spark, d):
    o = table(spark, d, "orders")
    inferred = o.select(F.col("o_orderkey").alias("position"), _cat("I-", F.col("o_orderkey")).alias("id"), _cat("  keep  ", F.col("o_orderpriority"), "   apart ").alias("statement"), _cat(" s", F.col("o_custkey") % 40).alias("scope"))
    return inferred, inferred.filter("position % 5 = 0").select(gate.content_key(F.col("statement"), F.col("scope")).alias("key"))


@query("content_key", f"WITH {KEYS} SELECT id, key FROM keyed")
def content_key(spark, d):
    return _inferred(spark, d)[0].select("id", gate.content_key(F.col("statement"), F.col("scope")).alias("key"))


@query("pending_invariants", f"WITH {KEYS} SELECT id, key FROM keyed WHERE key NOT IN (SELECT key FROM led)")
def pending_invariants(spark, d):
    return gate.pending(*_inferred(spark, d)).select("id", "key")


@query("readiness", f"WITH {KEYS}, p AS (SELECT count(*) AS n FROM keyed WHERE key NOT IN (SELECT key FROM led)) SELECT n = 0 AS ready, n AS pending FROM p")
def readiness(spark, d):
    return gate.readiness(gate.pending(*_inferred(spark, d)), spark.createDataFrame([(True,)], "confirmed boolean"))


@query("nearest_confirmed", "WITH w AS (SELECT 'w' || p_partkey AS id, 'a/b' || (p_size % 5) || '/c' || (p_partkey % 7) AS scope FROM part), c AS (SELECT 'c' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' || (p_size % 4) ELSE 'a/b' || (p_size % 5) || '/c' || (p_partkey % 4) END AS scope FROM part WHERE p_partkey < 60) SELECT w.id, w.scope, (SELECT arg_min(c.id, lpad((100 - length(c.scope) + length(replace(c.scope, '/', '')))::VARCHAR, 4, '0') || c.id) FROM c WHERE c.scope = w.scope OR starts_with(w.scope, c.scope || '/')) AS neighbour FROM w")
def nearest_confirmed(spark, d):
    p, size, key = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    waiting = p.select(_cat("w", key).alias("id"), _cat("a/b", size % 5, "/c", key % 7).alias("scope"))
    confirmed = p.filter("p_partkey < 60").select(_cat("c", key).alias("id"), F.when(key % 3 == 0, "a").when(key % 3 == 1, _cat("a/b", size % 4)).otherwise(_cat("a/b", size % 5, "/c", key % 4)).alias("scope"))
    return gate.nearest_confirmed(waiting, confirmed)


REQ = """rq AS (SELECT o_custkey % 50 AS plan, 'R' || (o_orderkey % 20) AS id, o_orderkey FROM orders), fl AS (SELECT DISTINCT plan, id, './' || CASE WHEN o_orderkey % 2 = 0 THEN 'x/' ELSE '' END || 'f' || (o_orderkey % 30) || '.py' AS file FROM rq WHERE o_orderkey % 20 < 12),
it AS (SELECT p AS plan, 'u' || (i % 4) AS unit, CASE WHEN i % 3 = 0 THEN 'x/' ELSE '' END || 'f' || i || '.py' AS path FROM range(0, 50) a(p), range(0, 25) b(i) WHERE i % 5 <> p % 5 OR p % 2 = 0), pl AS (SELECT p AS plan, i AS pos, 'f' || (CASE WHEN p % 3 = 0 THEN 4 ELSE p % 25 + i END) || '.py' AS file FROM range(0, 50) a(p), range(0, 2) b(i)),
of AS (SELECT DISTINCT fl.plan, fl.id, it.unit FROM fl JOIN it ON it.plan = fl.plan AND (it.path = fl.file[3:] OR ends_with(it.path, '/' || fl.file[3:]) OR ends_with(fl.file[3:], '/' || it.path))), po AS (SELECT pl.plan, pl.pos, it.unit FROM pl JOIN it ON it.plan = pl.plan AND (it.path = pl.file OR ends_with(it.path, '/' || pl.file))),
one AS (SELECT plan, count(DISTINCT unit) AS n, min(unit) AS unit, arg_min(unit, pos || unit) AS first FROM po GROUP BY plan)"""


@query("requirement_owners", f"""WITH {REQ}, r AS (SELECT DISTINCT plan, id FROM rq) SELECT plan, id, unit, 'named-file' AS source FROM of UNION ALL SELECT r.plan, r.id, CASE WHEN nf AND n = 1 THEN one.unit ELSE first END, CASE WHEN nf AND n = 1 THEN 'contained' WHEN first IS NOT NULL THEN 'assigned' ELSE '' END FROM (SELECT r.*, NOT EXISTS (SELECT 1 FROM fl WHERE fl.plan = r.plan AND fl.id = r.id) AS nf FROM r) r LEFT JOIN one ON one.plan = r.plan WHERE NOT EXISTS (SELECT 1 FROM of WHERE of.plan = r.plan AND of.id = r.id)""")
def requirement_owners(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("plan"), _cat("R", F.col("o_orderkey") % 20).alias("id"), "o_orderkey")
    k = F.col("o_orderkey")
    files = o.filter("o_orderkey % 20 < 12").select("plan", "id", _cat("./", F.when(k % 2 == 0, "x/").otherwise(""), "f", k % 30, ".py").alias("file")).distinct()
    grid = spark.range(50).select(F.col("id").alias("plan"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    i, p = F.col("i"), F.col("plan")
    interiors = grid.filter("i % 5 <> plan % 5 or plan % 2 = 0").select("plan", _cat("u", i % 4).alias("unit"), _cat(F.when(i % 3 == 0, "x/").otherwise(""), "f", i, ".py").alias("path"))
    planned = grid.filter("i < 2").select("plan", i.alias("pos"), _cat("f", F.when(p % 3 == 0, F.lit(4)).otherwise(p % 25 + i), ".py").alias("file"))
    return gate.assign_requirements(o, files, interiors, planned, "assign")


@query("last_handoff", "WITH m AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'handoff' ELSE 'note' END AS kind, 'b' || event_id AS body FROM events) SELECT session, coalesce(arg_max(body, seq) FILTER (WHERE kind = 'handoff'), arg_max(body, seq)) AS chosen, count(*) - 1 AS set_aside FROM m GROUP BY session")
def last_handoff(spark, d):
    e = table(spark, d, "events")
    return gate.last_handoff(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "handoff").otherwise("note").alias("kind"), _cat("b", F.col("event_id")).alias("body")))
