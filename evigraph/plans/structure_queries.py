"""Queries of change impact and of the shapes of graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import graph, impact, planning, stats, structure
from evigraph.plans.graph_queries import RING, _ring
from evigraph.plans.registry import query
from evigraph.sources import domain
from evigraph.sources.domain import GRAPH_SQL, table

WITH = f"WITH RECURSIVE {GRAPH_SQL}"
STOP = ", ".join(f"'{w}'" for w in impact.STOPWORDS)

#: Nations are modules, regions packages, suppliers symbols; each nation's proposal names some of them in several ways.
NAMES_SQL = f"""gn AS (SELECT 'nation:' || n_nationkey AS id, 'module' AS kind, 'src/nation/' || n_name || '.py' AS path FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'package', 'src/' || r_name || '/__init__.py' FROM region),
sy AS (SELECT 'sup.n' || s_nationkey || '.' || replace(s_name, '#', '_') AS id, replace(s_name, '#', '_') AS name, 'nation:' || s_nationkey AS module FROM supplier),
pr AS (SELECT n_nationkey AS proposal, 'Make the ' || n_name || ' use region:' || n_regionkey || ' with nation/NATION_' || ((n_nationkey + 3) % 25) || '.py then n' || (n_nationkey % 7) || '.Supplier_' || lpad(n_nationkey::VARCHAR, 9, '0') || ' or supplier_' || lpad(((n_nationkey + 1) % 10)::VARCHAR, 9, '0') || '( and AltName plain' AS text FROM nation),
raw AS (SELECT proposal, unnest(ts) AS term, generate_subscripts(ts, 1) - 1 AS pos FROM (SELECT proposal, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_./:@-]{{2,}}') AS ts FROM pr)),
tm AS (SELECT proposal, term, pos FROM raw WHERE lower(term) NOT IN ({STOP}) UNION ALL SELECT n_nationkey, 'nation:' || ((n_nationkey + 5) % 25), -1 FROM nation WHERE n_nationkey < 5),
rs AS (SELECT term, coalesce((SELECT max(id) FROM gn WHERE id = term), (SELECT min(module) FROM sy WHERE sy.id = term), (SELECT max(id) FROM gn WHERE path = term), (SELECT CASE WHEN count(*) = 1 THEN max(id) END FROM gn WHERE ends_with(path, '/' || term)),
  (SELECT CASE WHEN count(DISTINCT id) = 1 THEN max(id) END FROM gn WHERE lower(regexp_extract(path, '([^/]*)[.][^./]*$', 1)) = lower(term)), (SELECT CASE WHEN count(DISTINCT module) = 1 THEN max(module) END FROM sy WHERE lower(name) = lower(term)),
  (SELECT CASE WHEN contains(term, '.') AND NOT contains(term, '/') AND count(DISTINCT module) = 1 THEN max(module) END FROM sy WHERE ends_with(sy.id, '.' || term))) AS module FROM (SELECT DISTINCT term FROM tm)),
sd AS (SELECT proposal, module, arg_min(tm.term, pos) AS term, min(pos) < 0 AS explicit FROM tm JOIN rs ON rs.term = tm.term WHERE module IS NOT NULL GROUP BY proposal, module)"""


def _names(spark, d):
    n, r, s = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    nodes = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.lit("module").alias("kind"), F.concat(F.lit("src/nation/"), "n_name", F.lit(".py")).alias("path"))
    nodes = nodes.union(r.select(F.concat(F.lit("region:"), "r_regionkey"), F.lit("package"), F.concat(F.lit("src/"), "r_name", F.lit("/__init__.py"))))
    name = F.replace("s_name", F.lit("#"), F.lit("_"))
    symbols = s.select(F.concat(F.lit("sup.n"), "s_nationkey", F.lit("."), name).alias("id"), name.alias("name"), F.concat(F.lit("nation:"), "s_nationkey").alias("module"))
    k = F.col("n_nationkey")
    text = F.concat(
        F.lit("Make the "), "n_name", F.lit(" use region:"), "n_regionkey", F.lit(" with nation/NATION_"), (k + 3) % 25, F.lit(".py then n"), k % 7, F.lit(".Supplier_"), F.lpad(k.cast("string"), 9, "0"),
        F.lit(" or supplier_"), F.lpad(((k + 1) % 10).cast("string"), 9, "0"), F.lit("( and AltName plain"),
    )
    proposals = n.select(k.alias("proposal"), text.alias("text"))
    explicit = n.filter("n_nationkey < 5").select(k.alias("proposal"), F.concat(F.lit("nation:"), (k + 5) % 25).alias("value"))
    return nodes, symbols, proposals, explicit


@query("code_shaped_terms", f"WITH {NAMES_SQL} SELECT DISTINCT term, regexp_matches(term, '[./:_-]') OR (term <> lower(term) AND regexp_matches(term, '[a-z][A-Z]|[A-Z][A-Z]')) AS shaped FROM raw")
def code_shaped_terms(spark, d):
    _, _, proposals, _ = _names(spark, d)
    found = proposals.select(F.explode(F.regexp_extract_all("text", F.lit(f"({impact.TERM})"), 1)).alias("term")).distinct()
    return found.select("term", impact.code_shaped(F.col("term")).alias("shaped"))


@query("seed_resolve", f"WITH {NAMES_SQL} SELECT proposal, module, term, explicit FROM sd")
def seed_resolve(spark, d):
    nodes, symbols, proposals, explicit = _names(spark, d)
    return impact.seeds(proposals, explicit, nodes, symbols)[0]


@query("unresolved_terms", f"WITH {NAMES_SQL} SELECT DISTINCT proposal, tm.term FROM tm JOIN rs ON rs.term = tm.term WHERE module IS NULL AND pos >= 0 AND (regexp_matches(tm.term, '[./:_-]') OR regexp_matches(tm.term, '[a-z][A-Z]|[A-Z][A-Z]'))")
def unresolved_terms(spark, d):
    nodes, symbols, proposals, explicit = _names(spark, d)
    return impact.seeds(proposals, explicit, nodes, symbols)[1]


@query("tolerant_resolve", f"WITH {NAMES_SQL}, w AS (SELECT proposal AS list, pos, trim(term) AS term FROM tm WHERE pos >= 0), h AS (SELECT w.list, w.pos, coalesce(rs.module, (SELECT max(r2.module) FROM rs r2 WHERE contains(w.term, '.') AND NOT contains(w.term, '/') AND r2.term = split_part(w.term, '.', 1))) AS module FROM w LEFT JOIN rs ON rs.term = w.term) SELECT list, module, min(pos)::INT AS first FROM h WHERE module IS NOT NULL GROUP BY list, module")
def tolerant_resolve(spark, d):
    nodes, symbols, proposals, _ = _names(spark, d)
    terms = impact.proposal_terms(proposals).withColumnRenamed("proposal", "list")
    return impact.resolve_list(terms, nodes, symbols)[0]


HYGIENE_SQL = f"""{NAMES_SQL}, hy AS (SELECT sd.*, gn.kind = 'package' AND NOT explicit AND EXISTS (SELECT 1 FROM sd o JOIN gn g ON g.id = o.module WHERE o.proposal = sd.proposal AND g.kind <> 'package') AS package, explicit OR regexp_matches(term, '[./:_-]') OR regexp_matches(term, '[a-z][A-Z]|[A-Z][A-Z]') AS firm FROM sd JOIN gn ON gn.id = sd.module),
kp AS (SELECT hy.proposal, module, term, explicit, CASE WHEN package THEN 'package' WHEN NOT firm AND EXISTS (SELECT 1 FROM hy o WHERE o.proposal = hy.proposal AND o.firm AND NOT o.package) AND NOT contains(pr.text, hy.term || '(') THEN 'prose' END AS rejected FROM hy JOIN pr ON pr.proposal = hy.proposal)"""


@query("seed_hygiene", f"WITH {HYGIENE_SQL} SELECT * FROM kp")
def seed_hygiene(spark, d):
    nodes, symbols, proposals, explicit = _names(spark, d)
    return impact.hygiene(impact.seeds(proposals, explicit, nodes, symbols)[0], proposals, nodes)


IMPACT_SQL = f"""WITH {GRAPH_SQL}, {HYGIENE_SQL}, b AS (SELECT src, dst, CASE tier WHEN 'syntactic' THEN 0.6 ELSE 1.0 END * 0.8 AS f FROM medges), u AS (SELECT src, dst, f FROM b UNION ALL SELECT dst, src, f FROM b), w AS (SELECT src, dst, max(f)::DOUBLE AS f FROM u GROUP BY ALL),
s0 AS (SELECT DISTINCT module AS id, 1.0::DOUBLE AS score FROM kp WHERE proposal = 3 AND rejected IS NULL), s1 AS (SELECT w.dst AS id, max(s.score * w.f * 0.55) AS score FROM s0 s JOIN w ON w.src = s.id GROUP BY w.dst HAVING max(s.score * w.f * 0.55) >= 0.2),
s2 AS (SELECT w.dst AS id, max(s.score * w.f * 0.55) AS score FROM s1 s JOIN w ON w.src = s.id GROUP BY w.dst HAVING max(s.score * w.f * 0.55) >= 0.2), im AS (SELECT id, max(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id)"""


def _impact(spark, d):
    kept = seed_hygiene(spark, d).filter("proposal = 3 and rejected is null")
    return impact.build(domain.module_edges(spark, d), kept)


@query("impact_build", f"{IMPACT_SQL} SELECT id, round(score, 6) AS score FROM im")
def impact_build(spark, d):
    return _impact(spark, d).select("id", F.round("score", 6).alias("score"))


@query("impact_modules_top8", f"{IMPACT_SQL}, o AS (SELECT 'supplier:' || s_suppkey AS id, 'nation:' || s_nationkey AS own FROM supplier), m AS (SELECT coalesce(own, im.id) AS module, max(score) AS score FROM im LEFT JOIN o ON o.id = im.id GROUP BY 1) SELECT module, round(score, 6) AS score FROM m WHERE module <> 'nation:3' ORDER BY m.score DESC, module LIMIT 8")
def impact_modules_top8(spark, d):
    owner = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.concat(F.lit("nation:"), "s_nationkey").alias("module"))
    return impact.impact_modules(_impact(spark, d), owner, "nation:3").select("module", F.round("score", 6).alias("score"))


@query("impact_roles", f"{IMPACT_SQL}, ub AS (SELECT src, dst FROM medges UNION SELECT dst, src FROM medges), fi AS (SELECT src AS id, count(DISTINCT dst) AS n FROM ub GROUP BY src) SELECT im.id, CASE WHEN score >= 1 THEN CASE WHEN im.id IN (SELECT module FROM kp WHERE proposal = 3 AND NOT explicit) AND coalesce(n, 0) >= 30 THEN 'hub' ELSE 'work' END WHEN im.id LIKE 'region:%' THEN 'package-root' WHEN coalesce(n, 0) >= 30 THEN 'hub' ELSE 'work' END AS role FROM im LEFT JOIN fi ON fi.id = im.id")
def impact_roles(spark, d):
    e = domain.module_edges(spark, d)
    lexical = seed_hygiene(spark, d).filter("proposal = 3 and not explicit").select(F.col("module").alias("id"))
    roots = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    return impact.context(_impact(spark, d), graph.fan_in(e), lexical, roots).select("id", "role")


TRADE = "tr AS (SELECT s_nationkey AS a, c_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def _trade(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).agg(F.count("*").alias("n"))


@query("condensed_levels", f"""WITH RECURSIVE {RING}, ids AS (SELECT src AS id FROM ring UNION SELECT dst FROM ring), r AS (SELECT src, dst FROM ring UNION SELECT r.src, e.dst FROM r JOIN ring e ON e.src = r.dst),
c AS (SELECT i.id, least(i.id, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src WHERE a.src = i.id), i.id)) AS comp FROM ids i), ce AS (SELECT DISTINCT x.comp AS src, y.comp AS dst FROM ring JOIN c x ON x.id = ring.src JOIN c y ON y.id = ring.dst WHERE x.comp <> y.comp),
l AS (SELECT comp, 0 AS level FROM c UNION SELECT ce.src, l.level + 1 FROM l JOIN ce ON ce.dst = l.comp) SELECT c.id, max(l.level)::INT AS level FROM c JOIN l ON l.comp = c.comp GROUP BY c.id""")
def condensed_levels(spark, d):
    return graph.levels(_ring(spark, d))


@query("feedback_arcs")
def feedback_arcs(spark, d):
    """Trade between nations in three views; a greedy order decides, so brute force checks it in tests."""
    e = _trade(spark, d).filter("(a + b) % 4 = 0")
    return structure.against_layers(e.select(F.concat(F.lit("v"), (F.col("a") + F.col("b")) % 3).alias("view"), F.concat(F.lit("n"), "a").alias("src"), F.concat(F.lit("n"), "b").alias("dst"), F.col("n").alias("weight")))


@query("view_layers", f"{WITH}, e AS (SELECT DISTINCT split_part(src, ':', 1) AS view, src, dst FROM medges), ids AS (SELECT view, src AS id FROM e UNION SELECT view, dst FROM e) SELECT view, id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.view = ids.view AND e.src = ids.id) THEN 1 ELSE 0 END::INT AS level FROM ids")
def view_layers(spark, d):
    e = domain.module_edges(spark, d).select(F.split_part("src", F.lit(":"), F.lit(1)).alias("view"), "src", "dst", F.lit(1).alias("weight"))
    return structure.layers(e)


@query("shared_percentile", f"{WITH}, p AS (SELECT DISTINCT src, dst FROM calls), x AS (SELECT src, dst, 'n' || s_nationkey AS sb, 'b' || p_brand AS db FROM p JOIN supplier ON src = 'supplier:' || s_suppkey JOIN part ON dst = 'part:' || p_partkey), f AS (SELECT dst AS id, count(*) AS fan_in, count(DISTINCT sb) AS users FROM x GROUP BY dst), c AS (SELECT fan_in, row_number() OVER (ORDER BY fan_in) - 1 AS r, count(*) OVER () AS n FROM f) SELECT id, fan_in, users FROM f WHERE fan_in >= greatest((SELECT min(fan_in) FROM c WHERE r = least(n - 1, floor(n * 0.95))), 3) AND users >= 3")
def shared_percentile(spark, d):
    boxes = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("box"))
    boxes = boxes.union(table(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey"), F.concat(F.lit("b"), "p_brand")))
    return structure.shared_modules(domain.calls(spark, d), boxes)


@query("cut_degree", f"WITH {TRADE}, pr AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM tr WHERE a <> b AND n > 1), u AS (SELECT n_nationkey AS module, 'U' || n_regionkey AS unit FROM nation WHERE n_nationkey < 20), x AS (SELECT ua.unit AS ua, ub.unit AS ub FROM pr LEFT JOIN u ua ON ua.module = a LEFT JOIN u ub ON ub.module = b WHERE ua.unit IS DISTINCT FROM ub.unit), e AS (SELECT ua AS unit FROM x UNION ALL SELECT ub FROM x) SELECT u.unit, (SELECT count(*) FROM e WHERE e.unit = u.unit) AS cut FROM (SELECT DISTINCT unit FROM u) u")
def cut_degree(spark, d):
    units = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("module"), F.concat(F.lit("U"), "n_regionkey").alias("unit"))
    return structure.cut_degree(units, _trade(spark, d).filter("a <> b and n > 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


@query("node_weights", f"{WITH}, g AS (SELECT dst AS id, src, 'supplier/' || replace(src, 'supplier:', '') AS file FROM calls WHERE line = 1), sz AS (SELECT 'part/' || p_partkey AS path, p_size * 101 AS bytes FROM part WHERE p_size > 3 UNION ALL SELECT 'supplier/' || s_suppkey, s_suppkey * 7 + 1 FROM supplier), t AS (SELECT id, sum(coalesce(bytes, 0)) AS t FROM (SELECT DISTINCT id, file FROM g) x LEFT JOIN sz ON sz.path = x.file GROUP BY id) SELECT n.id, ((coalesce(sz.bytes, 0) + coalesce(t.t, 0) + CASE WHEN p.p_partkey % 3 = 0 THEN 40 ELSE 0 END) // 4)::BIGINT AS weight FROM nodes n JOIN part p ON n.id = 'part:' || p.p_partkey LEFT JOIN sz ON sz.path = n.path LEFT JOIN t ON t.id = n.id")
def node_weights(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    sizes = p.filter("p_size > 3").select(F.concat(F.lit("part/"), "p_partkey").alias("path"), (F.col("p_size") * 101).cast("long").alias("bytes")).union(s.select(F.concat(F.lit("supplier/"), "s_suppkey"), F.col("s_suppkey") * 7 + 1))
    guards = domain.calls(spark, d).filter("line = 1").select(F.col("dst").alias("id"), F.replace("src", F.lit(":"), F.lit("/")).alias("file"))
    docs = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit(40).alias("bytes"))
    return structure.node_weights(domain.nodes(spark, d).filter("kind = 'part'"), sizes, guards, docs)


@query("call_order", f"{WITH}, m AS (SELECT src, dst, length(src)::INT AS line FROM medges), f AS (SELECT src, dst, min(line) AS line FROM m GROUP BY ALL), h1 AS (SELECT src AS entry, dst AS id, 1 AS hops, line FROM f WHERE src LIKE 'supplier:%') SELECT * FROM h1 UNION ALL SELECT h1.entry, f.dst, 2, min(f.line) FROM h1 JOIN f ON f.src = h1.id GROUP BY ALL")
def call_order(spark, d):
    e = domain.module_edges(spark, d).withColumn("line", F.length("src"))
    return structure.call_order(e, table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id")))


@query("callee_expansion", f"{WITH}, c AS (SELECT DISTINCT dst AS seed, src AS callee FROM calls) SELECT seed, callee FROM c WHERE seed IN (SELECT seed FROM c GROUP BY seed HAVING count(*) <= 20)")
def callee_expansion(spark, d):
    """Parts as callers of their suppliers; a part with more than 20 isn't expanded."""
    back = domain.calls(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return structure.callee_expansion(back, domain.nodes(spark, d).filter("kind = 'part'").select("id"), 20)


@query("first_visits", "WITH v AS (SELECT 'region:' || r_regionkey AS entry, 'region:' || r_regionkey AS id, -1 AS n, -1 AS s FROM region UNION ALL SELECT 'region:' || n_regionkey, 'nation:' || n_nationkey, n_nationkey, -1 FROM nation UNION ALL SELECT 'region:' || n_regionkey, 'supplier:' || s_suppkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT entry, id, row_number() OVER (PARTITION BY entry ORDER BY n, s) - 1 AS place FROM v")
def first_visits(spark, d):
    e = domain.module_edges(spark, d).filter("not startswith(src, 'customer')")
    down = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.split_part("src", F.lit(":"), F.lit(2)).cast("long").alias("line"))
    return structure.first_visits(down, table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("id")))


@query("affix_groups")
def affix_groups(spark, d):
    """Parts by size, by what their names begin or end with; rounds of a greedy pick, checked by brute force in tests."""
    return structure.affix_groups(table(spark, d, "part").select(F.concat(F.lit("b"), F.col("p_size") % 5).alias("box"), F.col("p_partkey").cast("string").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("stem")), 30)


@query("view_edge_rollup", f"WITH x AS (SELECT s_nationkey AS a, c_nationkey AS b, l_returnflag AS kind, 'o' || l_orderkey AS sample FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), m AS (SELECT n_nationkey AS id, 'R' || n_regionkey AS box FROM nation WHERE n_nationkey < 15), y AS (SELECT p.box AS a, q.box AS b, CASE WHEN p.box IS NULL THEN 'in' WHEN q.box IS NULL THEN 'out' ELSE 'inside' END AS side, kind, sample FROM x LEFT JOIN m p ON p.id = x.a LEFT JOIN m q ON q.id = x.b WHERE p.box IS DISTINCT FROM q.box) SELECT a, b, side, kind, count(*) AS n, array_to_string(list_sort(list(DISTINCT sample))[1:3], ',') AS samples FROM y GROUP BY a, b, side, kind")
def view_edge_rollup(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    e = j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("o"), "l_orderkey").alias("sample"))
    members = table(spark, d, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("box"))
    return structure.view_edges(members, e).withColumn("samples", F.array_join("samples", ","))


@query("connected_families", f"WITH RECURSIVE {RING}, u AS (SELECT src AS a, dst AS b FROM ring UNION SELECT dst, src FROM ring), r AS (SELECT a AS id, a AS c FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.c) SELECT id, min(c) AS family FROM r GROUP BY id")
def connected_families(spark, d):
    return graph.connected(_ring(spark, d).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("greedy_cover")
def greedy_cover(spark, d):
    """Brands that cover all suppliers of their parts; rounds of a greedy pick, checked by brute force in tests."""
    c = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return planning.greedy_cover(c.select(F.col("p_brand").alias("input"), F.col("l_suppkey").alias("fault")).distinct())


@query("redundant_cases")
def redundant_cases(spark, d):
    """Nations whose customers' order priorities by status others have too; rounds, checked by brute force in tests."""
    c = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return planning.redundant_cases(c.filter("o_orderkey % 7 = c_nationkey % 7").select(F.concat(F.lit("n"), F.col("c_nationkey") % 9).alias("case"), F.concat("o_orderpriority", "o_orderstatus").alias("fault")).distinct())


@query("quantile_cuts", "WITH v AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem), s AS (SELECT unnest([0.25, 0.5, 0.95]) AS share) SELECT share::DOUBLE AS share, (SELECT min(x) FROM v WHERE r = greatest(ceil(share * n), 1)) AS cut FROM s")
def quantile_cuts(spark, d):
    return stats.quantile_cuts(table(spark, d, "lineitem"), "l_extendedprice", [0.25, 0.5, 0.95])
