"""Queries of the two-lane evidence join over event sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import evidence as ev
from evigraph.plans.registry import query
from evigraph.sources.domain import SITES_SQL, sites, table

WITH = f"WITH {SITES_SQL}"
HITS = f"""{WITH},
cand AS (SELECT s.seq, r.seq AS hit_seq, r.col AS hit_col, r.def_file AS hit_def_file, r.def_line AS hit_def_line, r.name AS hit_name,
  row_number() OVER (PARTITION BY s.seq ORDER BY CASE WHEN s.col < 0 THEN 0 WHEN r.col < 0 THEN 1073741824 ELSE abs(r.col - s.col) END, r.seq) AS rn
  FROM syntax s JOIN semantic r ON r.kind = 'resolution' AND r.file = s.file AND r.line = s.line AND r.name = s.name),
first_hit AS (SELECT s.*, c.hit_seq, c.hit_col, c.hit_def_file, c.hit_def_line, c.hit_name FROM syntax s LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON c.seq = s.seq),
own AS (SELECT s.seq, arg_min(r.seq, r.seq) AS r_seq, arg_min(r.col, r.seq) AS r_col, arg_min(r.def_file, r.seq) AS r_file, arg_min(r.def_line, r.seq) AS r_line, arg_min(r.name, r.seq) AS r_name
  FROM first_hit s JOIN fallback f ON f.file = s.file AND f.line = s.line AND f.name = s.name
  JOIN semantic r ON r.kind = 'resolution' AND r.file = s.file AND r.line = s.line AND r.col = s.col
  WHERE s.hit_seq IS NULL AND s.kind = 'call' AND s.col >= 0 GROUP BY s.seq HAVING bool_and(r.def_file = f.def_file AND r.def_line = f.def_line)),
hits AS (SELECT h.seq, h.file, h.line, h.name, h.col, h.kind, h.ambiguous, coalesce(h.hit_seq, o.r_seq) AS hit_seq, coalesce(h.hit_col, o.r_col) AS hit_col,
  coalesce(h.hit_def_file, o.r_file) AS hit_def_file, coalesce(h.hit_def_line, o.r_line) AS hit_def_line, coalesce(h.hit_name, o.r_name) AS hit_name FROM first_hit h LEFT JOIN own o ON o.seq = h.seq)
"""
FATES = f"""{HITS},
fates AS (SELECT h.*, CASE WHEN ambiguous THEN 'unresolved' WHEN hit_seq IS NOT NULL THEN 'resolved'
  WHEN EXISTS (SELECT 1 FROM external e WHERE e.file = h.file AND e.line = h.line AND e.name = h.name) THEN 'external' ELSE 'unresolved' END AS fate FROM hits h WHERE kind = 'call')
"""


@query("nearest_match_join", f"{HITS} SELECT seq, file, line, name, col, hit_seq, hit_def_file, hit_def_line FROM first_hit")
def nearest_match_join(spark, d):
    s = sites(spark, d)
    return ev.match_resolution(s["syntax"], s["semantic"]).select("seq", "file", "line", "name", "col", "hit_seq", "hit_def_file", "hit_def_line")


@query("own_column_join", f"{HITS} SELECT seq, r_seq, r_file AS def_file, r_line AS def_line FROM own")
def own_column_join(spark, d):
    s = sites(spark, d)
    first = ev.match_resolution(s["syntax"], s["semantic"])
    return ev.match_own_column(first.filter("hit_seq is null"), s["semantic"], s["fallback"]).select("seq", "own.r_seq", "own.def_file", "own.def_line")


JOINED = f"""{HITS},
drawn AS (SELECT CASE kind WHEN 'call' THEN 'calls' ELSE 'imports' END AS kind, file, line, hit_def_file AS def_file, hit_def_line AS def_line, 'semantic' AS tier, 'scip+tree-sitter' AS lanes FROM hits WHERE hit_seq IS NOT NULL AND NOT ambiguous),
guessed AS (SELECT CASE h.kind WHEN 'call' THEN 'calls' ELSE 'imports' END AS kind, h.file, h.line, f.def_file, f.def_line, 'syntactic' AS tier, 'tree-sitter' AS lanes FROM hits h
  JOIN fallback f ON f.file = h.file AND f.line = h.line AND f.name = h.name WHERE h.hit_seq IS NULL AND NOT h.ambiguous
  AND NOT EXISTS (SELECT 1 FROM external e WHERE NOT e.in_repo AND e.file = h.file AND e.line = h.line AND e.name = h.name)
  AND NOT (h.kind = 'call' AND h.file IN (SELECT file FROM withhold))),
loose AS (SELECT 'uses' AS kind, file, line, def_file, def_line, 'semantic' AS tier, 'scip' AS lanes FROM semantic r WHERE kind = 'resolution'
  AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.file = r.file AND h.line = r.line AND h.hit_name = r.name AND h.hit_col = r.col)
  AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.col < 0 AND h.file = r.file AND h.line = r.line AND h.hit_name = r.name)),
facts AS (SELECT * FROM drawn UNION ALL SELECT * FROM guessed UNION ALL SELECT * FROM loose
  UNION ALL SELECT 'implements', file, line, def_file, def_line, 'semantic', 'scip' FROM semantic WHERE kind = 'implements')
"""


@query("two_lane_join", f"{JOINED} SELECT * FROM facts")
def two_lane_join(spark, d):
    return ev.join_lanes(**sites(spark, d))


@query("two_lane_disposition", f"{JOINED} SELECT kind, tier, lanes, count(*) AS n FROM facts GROUP BY ALL")
def two_lane_disposition(spark, d):
    return ev.join_lanes(**sites(spark, d)).groupBy("kind", "tier", "lanes").agg(F.count("*").alias("n"))


@query("external_veto_anti", f"{HITS} SELECT seq, file, line, name FROM hits h WHERE hit_seq IS NULL AND NOT EXISTS (SELECT 1 FROM external e WHERE NOT e.in_repo AND e.file = h.file AND e.line = h.line AND e.name = h.name)")
def external_veto_anti(spark, d):
    s = sites(spark, d)
    hits = ev.matched(s["syntax"], s["semantic"], s["fallback"]).filter("hit_seq is null")
    return hits.join(s["external"].filter("not in_repo").select("file", "line", "name").distinct(), ["file", "line", "name"], "left_anti").select("seq", "file", "line", "name")


@query("lane_agreement", f"{HITS} SELECT h.seq, h.file, h.line, h.name, h.hit_def_file = f.def_file AND h.hit_def_line = f.def_line AS agree FROM first_hit h JOIN fallback f ON f.file = h.file AND f.line = h.line AND f.name = h.name WHERE h.kind = 'call' AND h.hit_seq IS NOT NULL")
def lane_agreement(spark, d):
    s = sites(spark, d)
    return ev.agreement(s["syntax"], s["semantic"], s["fallback"])


@query("dispositions", f"{FATES} SELECT seq, file, line, fate FROM fates")
def dispositions(spark, d):
    s = sites(spark, d)
    return ev.dispositions(s["syntax"], s["semantic"], s["fallback"], s["external"]).select("seq", "file", "line", "fate")


@query("coverage_rollup", f"{FATES} SELECT file, count(*) AS sites, count(*) FILTER (WHERE fate = 'resolved') AS resolved, count(*) FILTER (WHERE fate = 'external') AS external, count(*) FILTER (WHERE fate = 'unresolved') AS unresolved, round(count(*) FILTER (WHERE fate <> 'unresolved') / count(*), 3) AS accounted FROM fates GROUP BY file")
def coverage_rollup(spark, d):
    s = sites(spark, d)
    return ev.coverage(ev.dispositions(s["syntax"], s["semantic"], s["fallback"], s["external"]))


TAIL = f"""{FATES},
tail AS (SELECT f.*, CASE WHEN EXISTS (SELECT 1 FROM fallback g WHERE g.file = f.file AND g.line = f.line AND g.name = f.name) THEN 'fallback-resolved' WHEN ambiguous THEN 'union-member'
  WHEN EXISTS (SELECT 1 FROM semantic r WHERE r.file = f.file AND r.line = f.line) THEN 'other-name' WHEN col < 0 THEN 'no-column' ELSE 'unclassified' END AS class FROM fates f WHERE fate = 'unresolved')
"""


def _tail(spark, d):
    s = sites(spark, d)
    rows = ev.dispositions(s["syntax"], s["semantic"], s["fallback"], s["external"]).filter("fate = 'unresolved'")
    rows = rows.join(s["fallback"].select("file", "line", "name").withColumn("fell", F.lit(True)), ["file", "line", "name"], "left")
    rows = rows.join(s["semantic"].select("file", "line").distinct().withColumn("other", F.lit(True)), ["file", "line"], "left")
    rules = [("fallback-resolved", F.col("fell")), ("union-member", F.col("ambiguous")), ("other-name", F.col("other")), ("no-column", F.col("col") < 0)]
    return ev.classify_tail(rows, rules)


@query("tail_classify", f"{TAIL} SELECT file, class, count(*) AS n FROM tail GROUP BY ALL")
def tail_classify(spark, d):
    return _tail(spark, d).groupBy("file", "class").agg(F.count("*").alias("n"))


@query("tail_language_rollup", f"{TAIL} SELECT CASE WHEN right(file, 1) < '5' THEN 'py' ELSE 'go' END AS lang, class, count(*) AS n FROM tail GROUP BY ALL")
def tail_language_rollup(spark, d):
    lang = F.when(F.substring("file", -1, 1) < "5", "py").otherwise("go")
    return _tail(spark, d).groupBy(lang.alias("lang"), "class").agg(F.count("*").alias("n"))


@query("unresolved_sites", f"{FATES} SELECT seq, file, line, name FROM fates WHERE fate = 'unresolved'")
def unresolved_sites(spark, d):
    s = sites(spark, d)
    return ev.dispositions(s["syntax"], s["semantic"], s["fallback"], s["external"]).filter("fate = 'unresolved'").select("seq", "file", "line", "name")


SPANS = "spans AS (SELECT user_id AS u, event_id AS scope, epoch_ms(ts) AS start, epoch_ms(ts) + 1000 * (1 + event_id % 5000) * 60 AS \"end\" FROM events WHERE event_type = 'signup'), points AS (SELECT user_id AS u, event_id AS id, epoch_ms(ts) AS at FROM events WHERE event_type = 'click')"


def _spans(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    spans = e.filter("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("event_id").alias("scope"), F.col("ms").alias("start"), (F.col("ms") + 60_000 * (1 + F.col("event_id") % 5000)).alias("end"))
    return e.filter("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), F.col("ms").alias("at")), spans


@query("interval_shadow_join", f'WITH {SPANS} SELECT p.id, s.scope FROM points p JOIN spans s ON s.u = p.u AND p.at BETWEEN s.start AND s."end"')
def interval_shadow_join(spark, d):
    points, spans = _spans(spark, d)
    return ev.inside_interval(points, spans, "u", "at", "start", "end", 86_400_000).select("id", "scope")


@query("innermost_scope", f'WITH {SPANS}, hit AS (SELECT p.id, s.scope, row_number() OVER (PARTITION BY p.id ORDER BY s."end" - s.start, -s.start, s.scope) AS rn FROM points p JOIN spans s ON s.u = p.u AND p.at BETWEEN s.start AND s."end") SELECT p.id, h.scope FROM points p LEFT JOIN hit h ON h.id = p.id AND h.rn = 1')
def innermost_scope(spark, d):
    points, spans = _spans(spark, d)
    return ev.innermost(points, spans, "u", "at", "id", 86_400_000).select("id", "scope")


@query("shadow_exclusion", f'WITH {SPANS} SELECT p.id FROM points p WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.u = p.u AND p.at BETWEEN s.start AND s."end")')
def shadow_exclusion(spark, d):
    points, spans = _spans(spark, d)
    return points.join(ev.inside_interval(points, spans, "u", "at", "start", "end", 86_400_000).select("id"), "id", "left_anti").select("id")


@query("longest_prefix_join", "WITH n AS (SELECT DISTINCT p_type || ' ' || p_brand AS name FROM part), m AS (SELECT DISTINCT split_part(p_type, ' ', 1) AS module FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) FROM part WHERE p_size < 10) SELECT n.name, (SELECT m.module FROM m WHERE n.name = m.module OR starts_with(n.name, m.module || ' ') ORDER BY len(m.module) DESC LIMIT 1) AS module FROM n")
def longest_prefix_join(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.concat_ws(" ", "p_type", "p_brand").alias("name")).distinct()
    words = F.split("p_type", " ")
    modules = p.select(words[0].alias("module")).union(p.filter("p_size < 10").select(F.array_join(F.slice(words, 1, 2), " "))).distinct()
    return ev.longest_prefix(names, modules, " ")


@query("term_resolver", "WITH terms AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT r_name FROM region), cand AS (SELECT term, 1 AS priority, 'part:' || p_partkey AS target FROM terms JOIN part ON p_name = term UNION ALL SELECT term, 2, 'region:' || r_regionkey FROM terms JOIN region ON r_name = term UNION ALL SELECT term, 3, 'part:' || p_partkey FROM terms JOIN part ON p_brand = term UNION ALL SELECT term, 4, 'part:' || p_partkey FROM terms JOIN part ON split_part(p_name, ' ', 1) = term), best AS (SELECT term, min(priority) AS priority FROM cand GROUP BY term) SELECT c.term, c.priority, min(c.target) AS target FROM cand c JOIN best b ON b.term = c.term AND b.priority = c.priority GROUP BY ALL HAVING count(DISTINCT c.target) = 1")
def term_resolver(spark, d):
    p, r = table(spark, d, "part"), table(spark, d, "region")
    stem = F.split("p_name", " ")[0]
    terms = p.select(stem.alias("term")).union(p.select("p_brand")).union(r.select("r_name")).distinct()
    part = F.concat(F.lit("part:"), F.col("p_partkey"))
    cand = None
    for k, df in enumerate([p.select(F.col("p_name").alias("term"), part.alias("target")), r.select(F.col("r_name").alias("term"), F.concat(F.lit("region:"), F.col("r_regionkey")).alias("target")), p.select(F.col("p_brand").alias("term"), part.alias("target")), p.select(stem.alias("term"), part.alias("target"))], 1):
        own = df.join(terms, "term").withColumn("priority", F.lit(k))
        cand = own if cand is None else cand.unionByName(own)
    return ev.first_by_priority(cand, ["term"]).select("term", "priority", "target")
