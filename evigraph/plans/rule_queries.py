"""Queries of rules, policies and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import grading, rules
from evigraph.plans.registry import query, shared_sql
from evigraph.sources import domain
from evigraph.sources.domain import GRAPH_SQL, table

# A few rules and policies over the graph and command views (inputs of the queries, in both engines).
RULES = [
    ("I-1", "confirmed", "graph", "forbidden-import", "*", ["*"], ["region:0"], ["nation:0"]),
    ("I-2", "confirmed", "graph", "forbidden-import", "customer", ["customer:1.*", "customer:7"], ["nation:5", "nation:7"], []),
    ("I-3", "confirmed", "graph", "forbidden-import", "supplier", ["*"], ["region:4"], []),
    ("I-4", "inferred", "graph", "forbidden-import", "*", ["*"], ["region:1"], []),
    ("I-5", "confirmed", "soft", "forbidden-import", "*", ["*"], ["region:1"], []),
    ("I-6", "confirmed", "graph", "pattern-absent", "*", ["*"], ["region:1"], []),
    ("I-10", "confirmed", "graph", "forbidden-import", "customer", ["*"], ["nation:3"], []),
]
RULE_SCHEMA = "id string, status string, check string, kind string, scope string, importers array<string>, imported array<string>, except array<string>"
POLICY = [
    (0, 0, "builtin", "rm *", "deny", "never"), (0, 1, "builtin", "view*", "allow", ""), (1, 0, "box", "purchase*", "escalate", ""), (1, 1, "box", "*", "allow", ""),
    (2, 0, "repo", "click k?", "deny", ""), (2, 1, "repo", "signup *", "allow", ""), (2, 2, "repo", "signup k*", "escalate", ""),
]
POLICY_SCHEMA = "specificity int, file_order int, source string, pattern string, decision string, reason string"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"


RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}', '{c}', '{k}', '{sc}', {_list(im)}, {_list(to)}, {_list(ex)})" for i, s, c, k, sc, im, to, ex in RULES) + ") t(id, status, \"check\", kind, scope, importers, imported, \"except\"))"
POLICY_SQL = "policy AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, '{s}', '{p}', '{x}')" for a, b, s, p, x, _ in POLICY) + ") t(specificity, file_order, source, pattern, decision))"
WITH = f"WITH {GRAPH_SQL}, {RULE_SQL}"


@query("rule_forbidden", f"""{WITH}, x AS (SELECT id, scope, importers, "except", unnest(imported) AS dst FROM rules WHERE status = 'confirmed' AND "check" <> 'soft' AND kind = 'forbidden-import'),
hit AS (SELECT DISTINCT x.id, e.src, e.dst, e.tier FROM x JOIN medges e ON e.dst = x.dst LEFT JOIN nodes n ON n.id = e.src
  WHERE NOT list_contains(x."except", e.src) AND (n.path IS NULL OR x.scope IN ('', '.', '*') OR n.path = x.scope OR starts_with(n.path, x.scope || '/'))
  AND len(list_filter(x.importers, lambda p: p = '*' OR (CASE WHEN p LIKE '%.*' OR p LIKE '%/*' THEN starts_with(e.src, p[:-2]) ELSE p = e.src END))) > 0),
f AS (SELECT id, count(*) AS violations, count(*) FILTER (WHERE tier = 'semantic') AS proven FROM hit GROUP BY id),
v AS (SELECT r.id, coalesce(violations, 0) AS violations, coalesce(proven, 0) AS proven, CASE WHEN status <> 'confirmed' THEN 'skipped' WHEN "check" = 'soft' THEN 'soft' WHEN kind <> 'forbidden-import' THEN 'unknown' WHEN coalesce(proven, 0) > 0 THEN 'fail' WHEN coalesce(violations, 0) > 0 THEN 'suspect' ELSE 'pass' END AS verdict FROM rules r LEFT JOIN f ON f.id = r.id)
SELECT *, CASE verdict WHEN 'fail' THEN 0 WHEN 'suspect' THEN 1 WHEN 'unknown' THEN 2 WHEN 'soft' THEN 3 WHEN 'pass' THEN 4 ELSE 5 END AS severity FROM v""")
def rule_forbidden(spark, d):
    return rules.forbidden_imports(spark.createDataFrame(RULES, RULE_SCHEMA), domain.module_edges(spark, d), domain.nodes(spark, d))


COMMANDS = "cmd AS (SELECT DISTINCT event_type || '  k' || (user_id % 12) AS command FROM events UNION SELECT 'rm -rf /x' UNION SELECT 'odd')"


def _commands(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", F.lit("  k"), F.col("user_id") % 12).alias("command"))
    return e.union(spark.createDataFrame([("rm -rf /x",), ("odd",)], "command string")).distinct()


@query("policy_resolve", f"""WITH {POLICY_SQL}, {COMMANDS}, h AS (SELECT c.command, p.*, row_number() OVER (PARTITION BY c.command ORDER BY CASE decision WHEN 'deny' THEN 0 ELSE 1 END, -specificity, CASE decision WHEN 'escalate' THEN 0 ELSE 1 END, file_order) AS rn
  FROM cmd c JOIN policy p ON regexp_full_match(trim(regexp_replace(c.command, '\\s+', ' ', 'g')), replace(replace(p.pattern, '*', '.*'), '?', '.')) WHERE p.pattern <> '*' OR c.command <> 'odd')
SELECT c.command, coalesce(h.decision, 'allow') AS decision, coalesce(h.source, 'box') AS source, h.command IS NULL AS by_default FROM cmd c LEFT JOIN (SELECT * FROM h WHERE rn = 1) h ON h.command = c.command""")
def policy_resolve(spark, d):
    policy = spark.createDataFrame(POLICY, POLICY_SCHEMA)
    odd = rules.resolve_policy(_commands(spark, d).filter("command = 'odd'"), policy.filter("pattern <> '*'"), spark.createDataFrame([(1, "box", "allow")], "specificity int, source string, decision string"))
    rest = rules.resolve_policy(_commands(spark, d).filter("command <> 'odd'"), policy, spark.createDataFrame([(1, "box", "allow")], "specificity int, source string, decision string"))
    return rest.union(odd)


@query("glob_match", f"WITH {POLICY_SQL}, t AS (SELECT DISTINCT p_type AS text FROM part), g AS (SELECT unnest(['*BRASS', 'S*', '?TANDARD*', 'ECONOMY ANODIZED STEEL', '*A*E*']) AS pattern) SELECT pattern, text FROM g JOIN t ON regexp_full_match(text, replace(replace(pattern, '*', '.*'), '?', '.'))")
def glob_match(spark, d):
    g = spark.createDataFrame([(x,) for x in ("*BRASS", "S*", "?TANDARD*", "ECONOMY ANODIZED STEEL", "*A*E*")], "pattern string")
    t = table(spark, d, "part").select(F.col("p_type").alias("text")).distinct()
    return t.join(F.broadcast(g), rules.glob_matches(F.col("pattern"), F.col("text"))).select("pattern", "text")


@query("compound_policy", f"WITH {POLICY_SQL}, c AS (SELECT DISTINCT p_type || ' && cd x' AS command, p_type AS own FROM part) SELECT command, CASE WHEN own LIKE 'S%' THEN 'deny' WHEN own LIKE '%BRASS' THEN 'escalate' WHEN own LIKE '%E%' THEN 'allow' ELSE 'escalate' END AS decision FROM c")
def compound_policy(spark, d):
    """Compound commands split outside quotes by a table function, then the most restrictive decision."""
    from evigraph.functions.tables import Segments

    cmds = table(spark, d, "part").select(F.concat("p_type", F.lit(" && cd x")).alias("command")).distinct()
    segs = cmds.lateralJoin(Segments(F.col("command").outer()).select("segment", "neutral"))
    policy = spark.createDataFrame([(0, 0, "builtin", "S*", "deny", ""), (1, 0, "repo", "*BRASS", "escalate", ""), (1, 1, "repo", "*E*", "allow", "")], POLICY_SCHEMA)
    defaults = spark.createDataFrame([(0, "builtin", "escalate")], "specificity int, source string, decision string")
    judged = rules.resolve_policy(segs.select(F.col("segment").alias("command")), policy, defaults).withColumnRenamed("command", "segment")
    return rules.most_restrictive(segs.join(judged, "segment"))


@query("scope_prefix", f"{WITH}, s AS (SELECT unnest(['', '.', 'nation', 'nation/1', 'part/2']) AS scope) SELECT scope, count(*) AS n FROM s JOIN nodes ON scope IN ('', '.') OR path = scope OR starts_with(path, scope || '/') GROUP BY scope")
def scope_prefix(spark, d):
    s = spark.createDataFrame([(x,) for x in ("", ".", "nation", "nation/1", "part/2")], "scope string")
    n = domain.nodes(spark, d)
    return n.join(F.broadcast(s), rules.scope_matches(F.col("scope"), F.col("path"))).groupBy("scope").agg(F.count("*").alias("n"))


KEY = """WITH edges AS (SELECT l_orderkey * 8 + l_linenumber AS seq, 'o' || l_orderkey AS path, l_linenumber AS line, 'p' || (CASE WHEN l_quantity > 40 THEN l_partkey + 1 ELSE l_partkey END) AS t_path, CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS t_line,
  CASE WHEN l_tax > 0.07 THEN 'variable' ELSE 'function' END AS t_kind, CASE l_returnflag WHEN 'A' THEN 'semantic' ELSE 'syntactic' END AS tier FROM lineitem),
sites AS (SELECT l_orderkey * 8 + l_linenumber AS site, 'o' || l_orderkey AS path, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'dynamic' WHEN l_linestatus = 'O' THEN 'macro' ELSE 'static' END AS mode,
  CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 'p' || (l_partkey + 1) END AS i_path, CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 0 END AS i_line, l_partkey, l_suppkey, l_extendedprice, l_discount, l_quantity FROM lineitem WHERE l_tax > 0.01),
tgt AS (SELECT site, path, line, mode, i_path, 'p' || l_partkey AS t_path, 0 AS t_line, 'f' || l_suppkey AS t_name, l_extendedprice < 5000 AS external, l_discount < 0.03 AS closure FROM sites WHERE l_quantity > 5),
files AS (SELECT 'o' || o_orderkey AS path FROM orders WHERE o_orderstatus <> 'P'),
graded AS (SELECT e.*, CASE WHEN e.path NOT IN (SELECT path FROM files) THEN 'silent:not-loaded' WHEN NOT EXISTS (SELECT 1 FROM sites s WHERE s.path = e.path AND s.line = e.line) THEN 'silent:unreachable'
  WHEN EXISTS (SELECT 1 FROM tgt t WHERE t.path = e.path AND t.line = e.line AND t.t_path = e.t_path AND t.t_line = e.t_line) THEN 'confirmed:'
  WHEN EXISTS (SELECT 1 FROM sites s WHERE s.path = e.path AND s.line = e.line AND s.i_path = e.t_path AND s.i_line = e.t_line) THEN 'abstract:'
  WHEN t_kind = 'variable' AND EXISTS (SELECT 1 FROM tgt t WHERE t.path = e.path AND t.line = e.line) THEN 'abstract:func-value'
  WHEN NOT EXISTS (SELECT 1 FROM tgt t WHERE t.path = e.path AND t.line = e.line) THEN 'silent:no-targets'
  WHEN EXISTS (SELECT 1 FROM sites s WHERE s.path = e.path AND s.line = e.line AND s.l_quantity <= 5) THEN 'silent:line-unresolved' ELSE 'contradicted:' END AS br FROM edges e),
g AS (SELECT * EXCLUDE br, split_part(br, ':', 1) AS bucket, split_part(br, ':', 2) AS reason FROM graded)
"""


def _key(spark, d):
    """Claims and an answer key at order lines: a line has few rows, so a site's targets stay few."""
    li = table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    place = F.col("seq"), F.concat(F.lit("o"), "l_orderkey").alias("path"), F.col("l_linenumber").alias("line")
    part = lambda k: F.concat(F.lit("p"), k)
    moved = F.when(F.col("l_quantity") > 40, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))
    edges = li.select(*place, part(moved).alias("t_path"), F.when(F.col("l_discount") > 0.08, 1).otherwise(0).alias("t_line"), F.when(F.col("l_tax") > 0.07, "variable").otherwise("function").alias("t_kind"), F.when(F.col("l_returnflag") == "A", "semantic").otherwise("syntactic").alias("tier"))
    target = F.struct(part(F.col("l_partkey")).alias("path"), F.lit(0).alias("line"), F.concat(F.lit("f"), "l_suppkey").alias("name"), (F.col("l_extendedprice") < 5000).alias("external"), (F.col("l_discount") < 0.03).alias("closure"), F.lit("").alias("kind"))
    face = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 20)
    sites = li.filter("l_tax > 0.01").select(
        F.col("seq").alias("site"), *place[1:], F.when(F.col("l_returnflag") == "R", "dynamic").when(F.col("l_linestatus") == "O", "macro").otherwise("static").alias("mode"), F.when(face, part(F.col("l_partkey") + 1)).alias("i_path"), F.when(face, 0).alias("i_line"),
        F.when(F.col("l_quantity") > 5, F.array(target)).otherwise(F.array().cast("array<struct<path:string,line:int,name:string,external:boolean,closure:boolean,kind:string>>")).alias("targets"),
    )
    return edges, sites, table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("path"))


@query("grade_buckets", f"{KEY} SELECT seq, path, line, t_path, t_line, bucket, reason FROM g")
def grade_buckets(spark, d):
    return grading.grade(*_key(spark, d)).select("seq", "path", "line", "t_path", "t_line", "bucket", "reason")


@query("grade_silent_reasons", f"{KEY} SELECT reason, count(*) AS n FROM g WHERE bucket = 'silent' GROUP BY reason")
def grade_silent_reasons(spark, d):
    return grading.grade(*_key(spark, d)).filter("bucket = 'silent'").groupBy("reason").agg(F.count("*").alias("n"))


@query("grade_precision", f"""{KEY}, c AS (SELECT tier, count(*) AS edges, count(*) FILTER (WHERE bucket = 'confirmed') AS confirmed, count(*) FILTER (WHERE bucket = 'contradicted') AS contradicted, count(*) FILTER (WHERE bucket = 'abstract') AS abstract, count(*) FILTER (WHERE bucket = 'silent') AS silent, count(*) FILTER (WHERE reason = 'line-unresolved') AS lu FROM g GROUP BY tier)
SELECT tier, edges, confirmed, contradicted, abstract, silent, round(confirmed / nullif(confirmed + contradicted, 0), 6) AS precision, CASE WHEN lu > 0 THEN round(confirmed / nullif(confirmed + contradicted + lu, 0), 6) END AS strict FROM c""")
def grade_precision(spark, d):
    return grading.precision(grading.grade(*_key(spark, d)), "tier")


@query("recall_by_class", f"""{KEY}, p AS (SELECT t.*, (CASE WHEN mode = 'macro' THEN mode WHEN mode = 'dynamic' AND i_path IS NOT NULL THEN 'interface' WHEN mode = 'dynamic' THEN 'func-value' ELSE 'static' END) || '->' || (CASE WHEN closure THEN 'closure' ELSE 'named' END) AS class FROM tgt t WHERE NOT external)
SELECT class, count(*) AS pairs, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM edges e WHERE e.path = p.path AND e.line = p.line AND e.t_path = p.t_path AND e.t_line = p.t_line)) AS hits, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM edges e WHERE e.path = p.path AND e.line = p.line AND e.t_path = p.t_path AND e.t_line = p.t_line)) / count(*), 6) AS recall FROM p GROUP BY class""")
def recall_by_class(spark, d):
    edges, sites, _ = _key(spark, d)
    return grading.recall(edges, sites)


@query("collapsed_recall", f"{KEY} SELECT count(*) AS pairs, count(*) FILTER (WHERE hit) AS hits FROM (SELECT path, line, t_path, t_name, bool_or(EXISTS (SELECT 1 FROM g WHERE bucket = 'confirmed' AND g.path = t.path AND g.line = t.line AND g.t_path = t.t_path AND g.t_line = t.t_line)) AS hit FROM tgt t WHERE NOT external GROUP BY path, line, t_path, t_name)")
def collapsed_recall(spark, d):
    edges, sites, files = _key(spark, d)
    return grading.collapsed(grading.grade(edges, sites, files), sites)


@query("poison_check")
def poison_check(spark, d):
    edges, sites, files = _key(spark, d)
    edges = edges.groupBy("seq").agg(F.min(F.struct(*edges.columns)).alias("e")).select("e.*")  # an edge's number must be its own
    return grading.check_poison(grading.grade(grading.poison(edges, sites), sites, files))


shared_sql("trace_bucket", ["events"], """WITH e AS (SELECT event_id, user_id, event_type, value FROM events), s AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS mixed, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS hit FROM e GROUP BY user_id)
SELECT e.event_id, CASE WHEN s.hit = 1 AND e.value > 50 THEN 'confirmed' WHEN s.mixed = 1 THEN 'unobserved' ELSE 'suspect' END AS bucket FROM e JOIN s ON s.user_id = e.user_id WHERE e.event_type = 'click'""")
shared_sql("next_record_id", ["part"], "SELECT max(CAST(substr(p_brand, 7) AS INT)) + 1 AS next_id FROM part")
shared_sql("effective_status", ["orders"], "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'expired' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'resolved' END AS status FROM orders")
shared_sql("staleness", ["orders"], "WITH old AS (SELECT o_custkey AS path, max(o_orderkey) AS hash FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_custkey), now AS (SELECT o_custkey AS path, max(o_orderkey) AS hash FROM orders GROUP BY o_custkey) SELECT n.path, CASE WHEN o.hash IS NULL THEN 'missing' WHEN o.hash = n.hash THEN 'fresh' ELSE 'stale' END AS state FROM now n LEFT JOIN old o ON o.path = n.path")
