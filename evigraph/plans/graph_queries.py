"""Queries of graph assembly, traversal, impact and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import diff, graph, planning
from evigraph.plans.registry import query
from evigraph.sources import domain
from evigraph.sources.domain import GRAPH_SQL, table

WITH = f"WITH RECURSIVE {GRAPH_SQL}"


@query("fan_in", f"{WITH}, b AS (SELECT src, dst FROM medges UNION SELECT dst, src FROM medges) SELECT src AS id, count(DISTINCT dst) AS fan_in FROM b GROUP BY src")
def fan_in(spark, d):
    return graph.fan_in(domain.module_edges(spark, d))


@query("edge_dedup_evidence", f"{WITH} SELECT src, dst, type, ['semantic', 'syntactic', 'dynamic'][min(CASE tier WHEN 'semantic' THEN 1 WHEN 'syntactic' THEN 2 ELSE 3 END)] AS tier, array_to_string(list_sort(list(DISTINCT path || ':' || line)), ',') AS evidence FROM calls GROUP BY src, dst, type")
def edge_dedup_evidence(spark, d):
    return graph.dedup_edges(domain.calls(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query("first_wins_dedup", "SELECT p_brand AS id, arg_min(p_name, p_partkey) AS name, min(p_partkey) AS seq FROM part GROUP BY p_brand")
def first_wins_dedup(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min_by("p_name", "p_partkey").alias("name"), F.min("p_partkey").alias("seq"))


@query("who_calls", f"{WITH} SELECT src, tier, count(*) AS evidence FROM calls WHERE dst = 'part:7' GROUP BY ALL")
def who_calls(spark, d):
    return domain.calls(spark, d).filter("dst = 'part:7'").groupBy("src", "tier").agg(F.count("*").alias("evidence"))


@query("neighborhood_1hop", f"{WITH} SELECT src, dst, type, tier, CASE WHEN src = 'nation:3' THEN 'out' ELSE 'in' END AS side FROM medges WHERE src = 'nation:3' OR dst = 'nation:3'")
def neighborhood_1hop(spark, d):
    return domain.module_edges(spark, d).filter("src = 'nation:3' or dst = 'nation:3'").select("src", "dst", "type", "tier", F.when(F.col("src") == "nation:3", "out").otherwise("in").alias("side"))


@query("node_suggestions", f"{WITH} SELECT id, kind FROM nodes WHERE contains(lower(name), 'as') AND kind IN ('nation', 'region')")
def node_suggestions(spark, d):
    return domain.nodes(spark, d).filter(F.contains(F.lower("name"), F.lit("as")) & F.col("kind").isin("nation", "region")).select("id", "kind")


@query("neighborhood_khop", f"""{WITH}, b AS (SELECT src, dst FROM medges UNION SELECT dst, src FROM medges),
h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'region:1'), h2 AS (SELECT DISTINCT b.dst AS id FROM b JOIN h1 ON b.src = h1.id),
u AS (SELECT 'region:1' AS id, 0 AS hops UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) SELECT id, min(hops)::INT AS hops FROM u GROUP BY id""")
def neighborhood_khop(spark, d):
    start = spark.createDataFrame([("region:1",)], "seed string")
    return graph.neighbourhood(domain.module_edges(spark, d), start, 2).select("id", "hops")


@query("closure_reach", f"{WITH}, r AS (SELECT src AS seed, dst AS id FROM medges UNION SELECT r.seed, e.dst FROM r JOIN medges e ON e.src = r.id) SELECT seed, id FROM r")
def closure_reach(spark, d):
    e = domain.module_edges(spark, d)
    return graph.closure(e, e.select(F.col("src").alias("seed")).distinct()).select("seed", "id")


RING = "trade AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL), ring AS (SELECT 'n' || a AS src, 'n' || arg_min(b, -1000 * n + b) AS dst FROM trade GROUP BY a)"


def _ring(spark, d):
    """Each supplier nation points to the nation of its customers with the most order lines."""
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    trade = j.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"))
    return trade.groupBy("a").agg(F.min_by("b", -1000 * F.col("n") + F.col("b")).alias("b")).select(F.concat(F.lit("n"), "a").alias("src"), F.concat(F.lit("n"), "b").alias("dst"))


@query("scc_components", f"WITH RECURSIVE {RING}, ids AS (SELECT src AS id FROM ring UNION SELECT dst FROM ring), r AS (SELECT src, dst FROM ring UNION SELECT r.src, e.dst FROM r JOIN ring e ON e.src = r.dst) SELECT i.id, least(i.id, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src = i.id), i.id)) AS component FROM ids i")
def scc_components(spark, d):
    return graph.components(_ring(spark, d))


@query("levels", f"{WITH}, ids AS (SELECT src AS id FROM medges UNION SELECT dst FROM medges), l AS (SELECT id, 0 AS level FROM ids UNION SELECT e.src, l.level + 1 FROM l JOIN medges e ON e.dst = l.id) SELECT id, max(level)::INT AS level FROM l GROUP BY id")
def levels(spark, d):
    return graph.levels(domain.module_edges(spark, d))


@query("impact_expand", f"""{WITH}, b AS (SELECT src, dst, CASE tier WHEN 'syntactic' THEN 0.6 ELSE 1.0 END * 0.8 AS f FROM medges), u AS (SELECT src, dst, f FROM b UNION ALL SELECT dst, src, f FROM b), w AS (SELECT src, dst, max(f) AS f FROM u GROUP BY ALL),
s1 AS (SELECT w.dst AS id, 1.0 * w.f * 0.55 AS score FROM w WHERE w.src = 'region:2'), s1f AS (SELECT id, max(score) AS score FROM s1 WHERE score >= 0.2 GROUP BY id),
s2 AS (SELECT w.dst AS id, s.score * w.f * 0.55 AS score FROM s1f s JOIN w ON w.src = s.id), s2f AS (SELECT id, max(score) AS score FROM s2 WHERE score >= 0.2 GROUP BY id),
s3 AS (SELECT w.dst AS id, s.score * w.f * 0.55 AS score FROM s2f s JOIN w ON w.src = s.id),
al AS (SELECT 'region:2' AS id, 1.0 AS score UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) SELECT id, round(max(score)::DOUBLE, 6) AS score FROM al WHERE score >= 0.2 GROUP BY id""")
def impact_expand(spark, d):
    seeds = spark.createDataFrame([("region:2",)], "id string")
    return graph.propagate(domain.module_edges(spark, d), seeds).select("id", F.round("score", 6).alias("score"))


@query("module_projection", f"{WITH}, own AS (SELECT c.src AS a, 'brand:' || p.p_brand AS b FROM (SELECT DISTINCT src, dst FROM calls) c JOIN part p ON 'part:' || p.p_partkey = c.dst) SELECT a, b FROM own UNION SELECT b, a FROM own")
def module_projection(spark, d):
    owner = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("id"), F.concat(F.lit("brand:"), F.col("p_brand")).alias("module"))
    return graph.project_to_modules(domain.calls(spark, d).select("src", "dst").distinct(), owner)


COMMITS = "c AS (SELECT DISTINCT l_orderkey AS commit, 'part:' || l_partkey AS path FROM lineitem), fit AS (SELECT commit FROM c GROUP BY commit HAVING count(*) BETWEEN 2 AND 50), own AS (SELECT c.* FROM c JOIN fit USING (commit)), pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS n FROM own x JOIN own y ON x.commit = y.commit AND x.path < y.path GROUP BY ALL)"


def _commits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("part:"), F.col("l_partkey")).alias("path"))


@query("cochange_pairs", f"WITH {COMMITS} SELECT a, b, n, 1 + least(n, 8) / 4 AS factor FROM pairs")
def cochange_pairs(spark, d):
    return planning.cochange(_commits(spark, d))


@query("cochange_partners", f"WITH {COMMITS}, s AS (SELECT a AS path, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs) SELECT path, other, n FROM s WHERE n >= 2")
def cochange_partners(spark, d):
    return planning.partners(planning.cochange(_commits(spark, d)), 2)


@query("coupling", f"{WITH}, {COMMITS}, e AS (SELECT src, dst, CASE min(CASE tier WHEN 'semantic' THEN 0 WHEN 'syntactic' THEN 1 ELSE 2 END) WHEN 1 THEN 0.6 ELSE 1.0 END AS f, count(DISTINCT path || ':' || line) AS k FROM calls GROUP BY ALL), w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(f * k) AS w FROM e GROUP BY ALL) SELECT w.a, w.b, round((w.w * CASE WHEN p.n IS NULL THEN 1.0 ELSE 1 + least(p.n, 8) / 4 END)::DOUBLE, 6) AS weight FROM w LEFT JOIN pairs p ON p.a = w.a AND p.b = w.b")
def coupling(spark, d):
    edges = graph.dedup_edges(domain.calls(spark, d)).withColumn("evidence", F.size("evidence"))
    return planning.coupling(edges, planning.cochange(_commits(spark, d))).withColumn("weight", F.round("weight", 6))


@query("contracts_crossing", f"{WITH}, u AS (SELECT 'supplier:' || s_suppkey AS id, 'unit' || (s_suppkey % 3) AS unit FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'unit' || (p_partkey % 3) FROM part), c AS (SELECT DISTINCT e.src, e.dst, e.type, a.unit AS src_unit, b.unit AS dst_unit FROM calls e JOIN u a ON a.id = e.src JOIN u b ON b.id = e.dst WHERE a.unit <> b.unit) SELECT 'K' || row_number() OVER (PARTITION BY src_unit ORDER BY src, dst, type) AS id, src, dst, type, src_unit, dst_unit FROM c")
def contracts_crossing(spark, d):
    from pyspark.sql import Window

    units = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("unit"), F.col("s_suppkey") % 3).alias("unit"))
    units = units.union(table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")), F.concat(F.lit("unit"), F.col("p_partkey") % 3)))
    rank = F.row_number().over(Window.partitionBy("src_unit").orderBy("src", "dst", "type"))
    return planning.contracts(domain.calls(spark, d), units).withColumn("id", F.concat(F.lit("K"), rank))


@query("guard_lookup", f"{WITH} SELECT DISTINCT c.src AS test, p.p_brand AS module FROM calls c JOIN part p ON 'part:' || p.p_partkey = c.dst WHERE p.p_brand LIKE 'Brand#1%'")
def guard_lookup(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey")).alias("dst"), F.col("p_brand").alias("module")).filter(F.col("module").startswith("Brand#1"))
    return domain.calls(spark, d).join(p, "dst").select(F.col("src").alias("test"), "module").distinct()


@query("reach_kinds", f"{WITH} SELECT dst AS id, bool_or(tier = 'semantic') AS by_call, bool_or(tier = 'dynamic') AS by_fixture, NOT bool_or(tier = 'semantic') AND bool_or(tier = 'dynamic') AS only_fixture FROM calls GROUP BY dst")
def reach_kinds(spark, d):
    sem, dyn = F.bool_or(F.col("tier") == "semantic"), F.bool_or(F.col("tier") == "dynamic")
    return domain.calls(spark, d).groupBy(F.col("dst").alias("id")).agg(sem.alias("by_call"), dyn.alias("by_fixture"), (~sem & dyn).alias("only_fixture"))


@query("instability_roles", f"{WITH}, f AS (SELECT src AS id, count(DISTINCT dst) AS uses FROM medges GROUP BY src), g AS (SELECT dst AS id, count(DISTINCT src) AS users FROM medges GROUP BY dst), j AS (SELECT coalesce(f.id, g.id) AS id, coalesce(uses, 0) AS uses, coalesce(users, 0) AS users FROM f FULL JOIN g ON f.id = g.id) SELECT id, uses, users, CASE WHEN uses / (uses + users) < 1 / 3 THEN 'base' WHEN uses / (uses + users) > 2 / 3 THEN 'entry' ELSE 'middle' END AS role FROM j")
def instability_roles(spark, d):
    e = domain.module_edges(spark, d)
    uses, users = e.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("uses")), e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("users"))
    j = uses.join(users, "id", "full").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("uses", "users")))
    share = F.col("uses") / (F.col("uses") + F.col("users"))
    return j.withColumn("role", F.when(share < 1 / 3, "base").when(share > 2 / 3, "entry").otherwise("middle"))


@query("visible_subgraph", f"{WITH}, v AS (SELECT id FROM nodes WHERE kind IN ('nation', 'supplier')) SELECT DISTINCT src, type, dst FROM medges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)")
def visible_subgraph(spark, d):
    v = domain.nodes(spark, d).filter(F.col("kind").isin("nation", "supplier")).select("id")
    e = domain.module_edges(spark, d)
    return e.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst").distinct()


@query("overview_counts", f"{WITH} SELECT kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge:' || type, count(*) FROM medges GROUP BY type")
def overview_counts(spark, d):
    n = domain.nodes(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    return n.union(domain.module_edges(spark, d).groupBy(F.concat(F.lit("edge:"), "type")).agg(F.count("*")))


@query("ready_units", "WITH n AS (SELECT DISTINCT 'nation:' || n_nationkey AS unit, 'region:' || n_regionkey AS need FROM nation), u AS (SELECT unit FROM n UNION SELECT need FROM n), done AS (SELECT 'region:' || r_regionkey AS unit FROM region WHERE r_regionkey < 3) SELECT unit FROM u WHERE unit NOT IN (SELECT unit FROM done) AND unit NOT IN (SELECT unit FROM n WHERE need NOT IN (SELECT unit FROM done))")
def ready_units(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("unit"), F.concat(F.lit("region:"), "n_regionkey").alias("need")).distinct()
    units = n.select("unit").union(n.select("need")).distinct()
    done = table(spark, d, "region").filter("r_regionkey < 3").select(F.concat(F.lit("region:"), "r_regionkey").alias("unit"))
    return planning.ready(units, n, done)


@query("waves", "SELECT l_orderkey AS cell, l_linenumber AS item, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice)::INT AS wave FROM lineitem")
def waves(spark, d):
    li = table(spark, d, "lineitem")
    return planning.waves(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]).select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("item"), F.col("l_partkey").alias("part"), "wave")


CUTS = f"""{WITH}, base AS (SELECT src, dst, type, min(tier) AS tier, min(line) AS line FROM calls WHERE "at" < TIMESTAMP '1997-01-01' GROUP BY ALL), head AS (SELECT src, dst, type, min(tier) AS tier, min(line) AS line FROM calls WHERE "at" >= TIMESTAMP '1996-01-01' GROUP BY ALL), delta AS (SELECT *, '+' AS sign FROM head h WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.src = h.src AND b.dst = h.dst AND b.type = h.type) UNION ALL SELECT *, '-' FROM base b WHERE NOT EXISTS (SELECT 1 FROM head h WHERE b.src = h.src AND b.dst = h.dst AND b.type = h.type))"""


def _snapshots(spark, d):
    c = domain.calls(spark, d)
    cut = lambda rule: c.filter(rule).groupBy("src", "dst", "type").agg(F.min("tier").alias("tier"), F.min("line").alias("line"))
    return cut("at < timestamp '1997-01-01'"), cut("at >= timestamp '1996-01-01'")


@query("graph_diff", f"{CUTS} SELECT src, dst, type, tier, sign FROM delta")
def graph_diff(spark, d):
    return diff.diff_rows(*_snapshots(spark, d), ["src", "dst", "type"]).select("src", "dst", "type", "tier", "sign")


@query("delta_summary", f"{CUTS} SELECT type, sign, count(*) AS n FROM delta GROUP BY ALL")
def delta_summary(spark, d):
    return diff.summary(diff.diff_rows(*_snapshots(spark, d), ["src", "dst", "type"]))


@query("coverage_delta", f"{CUTS}, bm AS (SELECT DISTINCT dst AS id FROM base), hm AS (SELECT 'part:' || p_partkey AS id, p_size < 5 AS no_code FROM part), bg AS (SELECT DISTINCT dst AS id FROM base WHERE tier = 'dynamic' AND line = 1), hg AS (SELECT DISTINCT dst AS id FROM head WHERE tier = 'dynamic' AND line = 1), ok AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size > 25), bare AS (SELECT * FROM hm WHERE id NOT IN (SELECT id FROM hg)) SELECT id, CASE WHEN no_code THEN 'no-code' ELSE 'new-unguarded' END AS change FROM bare WHERE id NOT IN (SELECT id FROM bm) UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM ok) THEN 'accepted' ELSE 'lost-guard' END FROM bare WHERE id IN (SELECT id FROM bg)")
def coverage_delta(spark, d):
    base, head = _snapshots(spark, d)
    p = table(spark, d, "part")
    pid = F.concat(F.lit("part:"), F.col("p_partkey")).alias("id")
    guards = lambda s: s.filter("tier = 'dynamic' and line = 1").select(F.col("dst").alias("id"))
    return diff.coverage_delta(base.select(F.col("dst").alias("id")).distinct(), p.select(pid, (F.col("p_size") < 5).alias("no_code")), guards(base), guards(head), p.filter("p_size > 25").select(pid))


@query("movement", f"{CUTS}, b AS (SELECT dst AS id, bool_or(tier = 'dynamic') AS was FROM base GROUP BY dst), h AS (SELECT dst AS id, bool_or(tier = 'dynamic') AS now FROM head GROUP BY dst), j AS (SELECT coalesce(b.id, h.id) AS id, coalesce(was, false) AS was, coalesce(now, false) AS now FROM b FULL JOIN h ON b.id = h.id) SELECT id, CASE WHEN now AND NOT was THEN 'regressed' WHEN was AND NOT now THEN 'fixed' WHEN was THEN 'still-failing' ELSE 'unchanged' END AS movement FROM j")
def movement(spark, d):
    base, head = _snapshots(spark, d)
    bad = lambda s: s.groupBy(F.col("dst").alias("id")).agg(F.bool_or(F.col("tier") == "dynamic").alias("bad"))
    return diff.movement(bad(base), bad(head), "id", "bad")


@query("identity_compare", f"{CUTS} SELECT count(*) AS differing FROM (SELECT src, dst, type FROM base EXCEPT SELECT src, dst, type FROM head)")
def identity_compare(spark, d):
    base, head = _snapshots(spark, d)
    return base.select("src", "dst", "type").exceptAll(head.select("src", "dst", "type")).agg(F.count("*").alias("differing"))
