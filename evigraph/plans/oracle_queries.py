"""Queries of answer keys: exports, merges of compile units, missed pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import oracle
from evigraph.plans.registry import query
from evigraph.sources.domain import table


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


GRADE = """ed AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, l_returnflag AS tier, 'pkg/o' || (l_orderkey % 100) || CASE WHEN l_linenumber = 3 THEN '.md' WHEN l_linenumber = 4 THEN '_x.go' ELSE '.go' END AS path, l_linenumber AS line FROM lineitem),
sy AS (SELECT 'part:' || p_partkey AS dst, p_size AS t_line, CASE WHEN p_partkey % 9 = 0 THEN 'macro' ELSE 'function' END AS t_kind, CASE WHEN p_partkey % 4 = 0 THEN 'doc' ELSE 'pkg' END || '/' || lower(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 7 = 0 THEN '.py' ELSE '.go' END AS t_path, p_partkey % 11 <> 0 AS known FROM part),
ok AS (SELECT ed.*, t_path, t_line, t_kind FROM ed JOIN sy USING (dst) WHERE known AND t_path LIKE '%.go' AND path LIKE '%.go' AND NOT starts_with(path, 'pkg/o1.go/') AND NOT regexp_matches(path, '^pkg/o(5|55)_x[.]go$'))"""


def _gradeable(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    place = _cat("pkg/o", F.col("l_orderkey") % 100, F.when(F.col("l_linenumber") == 3, ".md").when(F.col("l_linenumber") == 4, "_x.go").otherwise(".go"))
    evidence = F.array(F.struct(place.alias("path"), F.col("l_linenumber").alias("line"), F.lit("scip").alias("lane")))
    edges = li.select(_cat("supplier:", F.col("l_suppkey")).alias("src"), _cat("part:", F.col("l_partkey")).alias("dst"), F.lit("calls").alias("type"), F.col("l_returnflag").alias("tier"), evidence.alias("evidence"))
    key = F.col("p_partkey")
    module = _cat(F.when(key % 4 == 0, "doc").otherwise("pkg"), "/", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.when(key % 7 == 0, ".py").otherwise(".go"))
    symbols = p.select(_cat("part:", key).alias("id"), F.col("p_size").alias("line"), F.when(key % 9 == 0, "macro").otherwise("function").alias("kind"), F.when(key % 11 != 0, module).otherwise("gone").alias("module"))
    nodes = p.select(module.alias("id"), F.lit("module").alias("kind"), module.alias("path")).distinct()
    return oracle.gradeable(edges, nodes, symbols, "pkg", "go", ["pkg/o1.go", "pkg/o5_x.go", "pkg/o55_x.go"])


@query("gradeable_edges", f"WITH {GRADE} SELECT src, dst, path, line, t_path, t_line FROM ok WHERE t_kind <> 'macro' AND path <> 'pkg/o1.go'")
def gradeable_edges(spark, d):
    return _gradeable(spark, d)[0].select("src", "dst", "path", "line", "t_path", "t_line")


@query("gradeable_excluded", f"WITH {GRADE} SELECT 'macro' AS why, count(*) AS n FROM ok WHERE t_kind = 'macro' AND path <> 'pkg/o1.go'")
def gradeable_excluded(spark, d):
    return _gradeable(spark, d)[1]


FOREIGN = """fr AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 13 = 0 THEN 'nowhere' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'ext' ELSE 'lib' END || '/f' || (o_custkey % 30) || CASE WHEN o_orderkey % 7 = 0 THEN '.md' ELSE '.py' END || ':' || (o_custkey % 9 + 1) END AS site, 'lib/t' || (o_custkey % 5) || '.py:' || (o_custkey % 3 + 1) AS callee, CASE WHEN o_orderkey % 17 = 0 THEN 'macro' ELSE 'function' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'fuzzy' ELSE '' END AS label FROM orders),
ps AS (SELECT *, split_part(site, ':', 1) AS path, split_part(site, ':', 2)::BIGINT AS line, split_part(callee, ':', 1) AS t_path, split_part(callee, ':', 2)::BIGINT AS t_line FROM fr WHERE site <> 'nowhere'), ws AS (SELECT *, CASE WHEN path LIKE '%.md' THEN 'other-language' WHEN path NOT LIKE 'lib/%' THEN 'outside-cell' WHEN kind = 'macro' THEN 'macro' END AS why FROM ps)"""


def _foreign(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    site = F.when(k % 13 == 0, "nowhere").otherwise(_cat(F.when(k % 5 == 0, "ext").otherwise("lib"), "/f", c % 30, F.when(k % 7 == 0, ".md").otherwise(".py"), ":", c % 9 + 1))
    rows = o.select(k.alias("seq"), site.alias("site"), _cat("lib/t", c % 5, ".py:", c % 3 + 1).alias("callee"), F.when(k % 17 == 0, "macro").otherwise("function").alias("kind"), F.when(k % 2 == 0, "fuzzy").otherwise("").alias("label"))
    return oracle.foreign_edges(rows, "lib", "py", [], "tool")


@query("foreign_edges", f"WITH {FOREIGN} SELECT path, line, t_path, t_line, CASE arg_min(label, seq) WHEN '' THEN 'tool' ELSE 'tool:fuzzy' END AS tier FROM ws WHERE why IS NULL GROUP BY path, line, t_path, t_line")
def foreign_edges(spark, d):
    return _foreign(spark, d)[0].select("path", "line", "t_path", "t_line", "tier")


@query("foreign_excluded", f"WITH {FOREIGN}, x AS (SELECT count(*) AS n FROM ws WHERE why IS NULL GROUP BY path, line, t_path, t_line) SELECT why, count(*) AS n FROM ws WHERE why IS NOT NULL GROUP BY why UNION ALL SELECT 'duplicate', sum(n - 1)::BIGINT FROM x HAVING sum(n - 1) > 0 UNION ALL SELECT 'malformed', count(*) FROM fr WHERE site = 'nowhere' HAVING count(*) > 0")
def foreign_excluded(spark, d):
    _, left, bad = _foreign(spark, d)
    return left.union(bad.groupBy(F.lit("malformed").alias("why")).agg(F.count("*").alias("n")))


#: Suppliers are compile units, parts names that they declare and call.
CLANG = """dc AS (SELECT DISTINCT 'u' || l_suppkey AS unit, 'k' || (l_partkey % 40) AS key, CASE WHEN l_partkey % 40 < 20 THEN 'h/' || (l_partkey % 40) ELSE 'u' || l_suppkey END || '.c' AS path, l_partkey % 40 + 1 AS line, 'function' AS kind, l_partkey % 40 BETWEEN 30 AND 33 AS static, l_partkey % 40 NOT BETWEEN 10 AND 14 AND l_partkey % 40 <> 31 AS body, l_partkey % 40 NOT BETWEEN 12 AND 16 AS in_repo, l_partkey % 40 = 11 AS implicit FROM lineitem WHERE l_quantity > 20),
ca AS (SELECT 'u' || l_suppkey AS unit, 's' || (l_orderkey % 60) || '.c' AS path, l_linenumber AS line, l_linenumber * 2 AS col, 's' || (l_orderkey % 60) || '.c' AS spell_path, l_linenumber AS spell_line, 1 AS spell_col, 'k' || (l_partkey % 43) AS callee, 'n' || (l_partkey % 43) AS name, CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 'macro' ELSE CASE WHEN l_tax > 0.05 THEN 'dynamic' ELSE 'virtual' END END AS mode, 'c' || l_suppkey AS caller FROM lineitem WHERE l_quantity < 12),
ow AS (SELECT unit, key, bool_or(static) AS static, max(CASE WHEN body AND in_repo THEN path || ':' || lpad(line::VARCHAR, 5, '0') END) AS own, bool_or(in_repo AND NOT implicit) AS declared FROM dc GROUP BY ALL), gd AS (SELECT key, count(DISTINCT path || ':' || lpad(line::VARCHAR, 5, '0')) AS defs, min(path || ':' || lpad(line::VARCHAR, 5, '0')) AS def FROM dc WHERE body AND in_repo AND NOT EXISTS (SELECT 1 FROM ow WHERE ow.unit = dc.unit AND ow.key = dc.key AND ow.static) GROUP BY key),
rs AS (SELECT ca.*, CASE WHEN mode = 'dynamic' THEN NULL WHEN coalesce(static, false) THEN own WHEN coalesce(defs, 0) = 1 THEN def WHEN defs > 1 THEN own END AS target, coalesce(static, false) AS st, coalesce(defs, 0) AS nd, coalesce(declared, false) AS dl FROM ca LEFT JOIN ow ON ow.unit = ca.unit AND ow.key = ca.callee LEFT JOIN gd ON gd.key = ca.callee),
rr AS (SELECT *, CASE WHEN mode = 'dynamic' OR target IS NOT NULL THEN NULL WHEN (st OR nd = 0) AND dl THEN 'undefined' WHEN st OR nd = 0 THEN 'external' ELSE 'link-ambiguous' END AS reason FROM rs)"""


def _units(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    k = c("l_partkey") % 40
    decls = li.filter("l_quantity > 20").select(
        _cat("u", c("l_suppkey")).alias("unit"), _cat("k", k).alias("key"), F.when(k < 20, _cat("h/", k, ".c")).otherwise(_cat("u", c("l_suppkey"), ".c")).alias("path"), (k + 1).alias("line"), F.lit("function").alias("kind"),
        k.between(30, 33).alias("static"), (~k.between(10, 14) & (k != 31)).alias("body"), (~k.between(12, 16)).alias("in_repo"), (k == 11).alias("implicit"),
    ).distinct()
    n = c("l_linenumber")
    place = _cat("s", c("l_orderkey") % 60, ".c")
    mode = F.when(c("l_returnflag") == "A", "static").when(c("l_returnflag") == "N", "macro").when(c("l_tax") > 0.05, "dynamic").otherwise("virtual")
    calls = li.filter("l_quantity < 12").select(
        _cat("u", c("l_suppkey")).alias("unit"), place.alias("path"), n.alias("line"), (n * 2).alias("col"), place.alias("spell_path"), n.alias("spell_line"), F.lit(1).alias("spell_col"), _cat("k", c("l_partkey") % 43).alias("callee"), _cat("n", c("l_partkey") % 43).alias("name"), mode.alias("mode"), _cat("c", c("l_suppkey")).alias("caller"),
    )
    return oracle.resolve_units(calls, decls)


@query("unit_call_targets", f"WITH {CLANG} SELECT unit, path, line, callee, mode, split_part(target, ':', 1) AS t_path, split_part(target, ':', 2)::BIGINT AS t_line, reason FROM rr WHERE target IS NOT NULL UNION ALL SELECT unit, path, line, callee, mode, NULL, NULL, reason FROM rr WHERE target IS NULL")
def unit_call_targets(spark, d):
    return _units(spark, d).select("unit", "path", "line", "callee", "mode", "t_path", "t_line", "reason")


@query("unit_merge", f"""WITH {CLANG}, m AS (SELECT path, line, col, mode, callee, count(DISTINCT target) + count(DISTINCT CASE WHEN reason = 'external' THEN name END) AS n, count(DISTINCT CASE WHEN reason = 'external' THEN name END) AS ext, string_agg(DISTINCT split_part(target, ':', 1) || ':' || split_part(target, ':', 2)::BIGINT, ',') AS ts FROM rr GROUP BY ALL)
SELECT path, line, col, mode, callee, CASE WHEN mode = 'dynamic' THEN 'dynamic' WHEN n >= 2 THEN 'tu-split' WHEN n = 1 AND ext = 1 THEN 'external' WHEN n = 1 THEN mode ELSE 'none' END AS bucket, coalesce(list_sort(string_split(ts, ','))[1], '') AS first FROM m""")
def unit_merge(spark, d):
    out = oracle.merge_units(_units(spark, d))
    places = F.array_sort(F.transform("targets", lambda t: F.concat_ws(":", t["t_path"], t["t_line"].cast("string"))))
    none = F.when(F.col("bucket").isin("undefined", "link-ambiguous"), "none").otherwise(F.col("bucket"))
    return out.select("path", "line", "col", "mode", "callee", none.alias("bucket"), F.coalesce(F.get(places, F.lit(0)), F.lit("")).alias("first"))


@query("keyed_merge", "WITH s AS (SELECT DISTINCT 'o' || l_orderkey AS site, 'k' || (l_partkey % 90) AS key FROM lineitem WHERE l_quantity > 30), df AS (SELECT DISTINCT 'k' || (p_partkey % 70) AS key, p_brand AS path, p_size % 3 AS line FROM part WHERE p_size > 40) SELECT site, coalesce(string_agg(DISTINCT path || ':' || line, ',' ORDER BY path || ':' || line), '') AS targets FROM s LEFT JOIN df USING (key) GROUP BY site")
def keyed_merge(spark, d):
    rows = table(spark, d, "lineitem").filter("l_quantity > 30").select(_cat("o", F.col("l_orderkey")).alias("site"), _cat("k", F.col("l_partkey") % 90).alias("key"))
    defs = table(spark, d, "part").filter("p_size > 40").select(_cat("k", F.col("p_partkey") % 70).alias("key"), F.col("p_brand").alias("path"), (F.col("p_size") % 3).alias("line"))
    return oracle.merge_keyed(rows, defs).withColumn("targets", F.array_join(F.array_sort(F.transform("targets", lambda t: F.concat_ws(":", t["path"], t["line"].cast("string")))), ","))


IMPLICIT = "ip AS (SELECT 'o' || l_orderkey AS path, l_linenumber AS line, 'p' || l_partkey AS t_path, l_suppkey AS t_line, CASE WHEN l_tax > 0.04 THEN ['conv', 'base'] ELSE ['drop'] END AS fam FROM lineitem WHERE l_discount > 0.05), dr AS (SELECT DISTINCT 'o' || l_orderkey AS path, l_linenumber AS line, 'p' || l_partkey AS t_path, l_suppkey AS t_line FROM lineitem WHERE l_returnflag = 'A'), j AS (SELECT ip.*, dr.path IS NOT NULL AS hit FROM ip LEFT JOIN dr ON dr.path = ip.path AND dr.line = ip.line AND dr.t_path = ip.t_path AND dr.t_line = ip.t_line)"


def _implicit(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    place = (_cat("o", c("l_orderkey")).alias("path"), c("l_linenumber").alias("line"), _cat("p", c("l_partkey")).alias("t_path"), c("l_suppkey").alias("t_line"))
    pairs = li.filter("l_discount > 0.05").select(*place, F.when(c("l_tax") > 0.04, F.array(F.lit("conv"), F.lit("base"))).otherwise(F.array(F.lit("drop"))).alias("families"))
    return oracle.implicit_recall(pairs, li.filter("l_returnflag = 'A'").select(*place), 100, 40)


@query("implicit_families", f"WITH {IMPLICIT} SELECT CASE WHEN len(fam) = 2 THEN 'base+conv' ELSE 'drop' END AS families, count(*) AS pairs, count(*) FILTER (WHERE hit) AS hits FROM j GROUP BY 1")
def implicit_families(spark, d):
    return _implicit(spark, d)[0]


@query("implicit_recall", f"WITH {IMPLICIT} SELECT count(*) + 100 AS pairs, count(*) FILTER (WHERE hit) + 40 AS hits, round((count(*) FILTER (WHERE hit) + 40) / (count(*) + 100), 6) AS recall FROM j")
def implicit_recall(spark, d):
    return _implicit(spark, d)[1]


SHAPES = """sh AS (SELECT 'f' || (l_orderkey % 80) AS path, l_linenumber AS line, (l_partkey % 6)::INT AS col, 'n' || (l_suppkey % 4) AS name, (['identifier', 'new', 'member', 'call'])[(l_partkey % 4 + 1)::INT] AS shape, CASE l_suppkey % 3 WHEN 0 THEN 'var:const:top:arrow' WHEN 1 THEN 'function' END AS decl, CASE WHEN l_suppkey % 2 = 0 THEN 'ident:var:let:nested:call' ELSE 'this' END AS recv FROM lineitem WHERE l_quantity > 44),
bk AS (SELECT path, line, col, name, CASE shape WHEN 'identifier' THEN 'identifier:' || CASE decl WHEN 'function' THEN 'function' WHEN 'var:const:top:arrow' THEN 'const-top-arrow' ELSE 'unresolved' END WHEN 'new' THEN 'new:' || coalesce(decl, 'unresolved') WHEN 'member' THEN 'member:on-' || CASE recv WHEN 'this' THEN 'this' ELSE 'let-nested-call' END ELSE 'call' END AS bucket FROM sh),
ms AS (SELECT l_orderkey * 10 + l_linenumber AS miss, 'f' || (l_orderkey % 80) AS path, l_linenumber AS line, 't' || (l_partkey % 3) AS t_path, l_suppkey % 7 AS t_line, 'q.n' || (l_suppkey % 4) AS t_name FROM lineitem WHERE l_quantity < 3 QUALIFY row_number() OVER (PARTITION BY miss ORDER BY path, line, t_path, t_line, t_name) = 1), ks AS (SELECT DISTINCT 'f' || (l_orderkey % 80) AS path, l_linenumber AS line, (l_partkey % 6 + 1)::INT AS col, 't' || (l_partkey % 3) AS t_path, l_suppkey % 7 AS t_line FROM lineitem WHERE l_quantity < 3),
cf AS (SELECT DISTINCT 'f' || (l_orderkey % 80) AS path, l_linenumber AS line, 't' || (l_partkey % 3) AS t_path, l_suppkey % 5 AS t_line, 'q.n' || (l_suppkey % 4) AS t_name FROM lineitem WHERE l_quantity = 10)"""


@query("shape_buckets", f"WITH {SHAPES} SELECT bucket, count(*) AS n FROM bk GROUP BY bucket")
def shape_buckets(spark, d):
    return _shapes(spark, d).groupBy(oracle.shape_bucket().alias("bucket")).agg(F.count("*").alias("n"))


def _shapes(spark, d):
    li, c = table(spark, d, "lineitem").filter("l_quantity > 44"), F.col
    shape = F.element_at(F.array(*map(F.lit, ("identifier", "new", "member", "call"))), (c("l_partkey") % 4 + 1).cast("int"))
    decl = F.when(c("l_suppkey") % 3 == 0, "var:const:top:arrow").when(c("l_suppkey") % 3 == 1, "function")
    return li.select(_cat("f", c("l_orderkey") % 80).alias("path"), c("l_linenumber").alias("line"), (c("l_partkey") % 6).cast("int").alias("col"), _cat("n", c("l_suppkey") % 4).alias("name"), shape.alias("shape"), decl.alias("decl"), F.when(c("l_suppkey") % 2 == 0, "ident:var:let:nested:call").otherwise("this").alias("recv"))


@query("miss_buckets", f"""WITH {SHAPES}, x AS (SELECT ms.*, t_name[3:] AS nm, EXISTS (SELECT 1 FROM cf WHERE cf.path = ms.path AND cf.line = ms.line AND cf.t_path = ms.t_path AND cf.t_name = ms.t_name AND cf.t_line <> ms.t_line) AS sib, (SELECT list({{'n': bk.name, 'b': bk.bucket}}) FROM bk JOIN ks ON ks.path = bk.path AND ks.line = bk.line AND ks.col - 1 = bk.col WHERE bk.path = ms.path AND bk.line = ms.line AND ks.t_path = ms.t_path AND ks.t_line = ms.t_line) AS hits, (SELECT list({{'n': bk.name, 'b': bk.bucket}}) FROM bk WHERE bk.path = ms.path AND bk.line = ms.line) AS near FROM ms),
y AS (SELECT x.*, CASE WHEN len(hits) > 1 AND len(list_filter(hits, lambda e: e.n = nm)) > 0 THEN list_filter(hits, lambda e: e.n = nm) ELSE hits END AS ex, list_filter(near, lambda e: e.n = nm) AS byname FROM x), z AS (SELECT miss, sib, near, list_distinct(list_transform(ex, lambda e: e.b)) AS eb, list_distinct(list_transform(byname, lambda e: e.b)) AS nb FROM y)
SELECT miss, CASE WHEN sib THEN 'sibling' WHEN len(eb) = 1 THEN eb[1] WHEN len(eb) > 1 THEN 'ambiguous' WHEN len(nb) = 1 THEN nb[1] WHEN len(nb) > 1 THEN 'ambiguous' WHEN len(near) > 0 THEN 'no-record' ELSE 'no-site' END AS bucket, CASE WHEN sib THEN 'sibling' WHEN len(eb) = 1 THEN 'exact' WHEN len(eb) > 1 THEN 'ambiguous' WHEN len(nb) = 1 THEN 'name' WHEN len(nb) > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM z""")
def miss_buckets(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    place = (_cat("f", c("l_orderkey") % 80).alias("path"), c("l_linenumber").alias("line"), _cat("t", c("l_partkey") % 3).alias("t_path"))
    name = _cat("q.n", c("l_suppkey") % 4).alias("t_name")
    few = li.filter("l_quantity < 3")
    misses = few.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("miss"), *place, (c("l_suppkey") % 7).alias("t_line"), name)
    sites = few.select(*place, (c("l_suppkey") % 7).alias("t_line"), (c("l_partkey") % 6 + 1).cast("int").alias("col"))
    confirmed = li.filter("l_quantity = 10").select(*place, (c("l_suppkey") % 5).alias("t_line"), name)
    first = misses.groupBy("miss").agg(F.min(F.struct(*misses.columns)).alias("m")).select("m.*")  # a miss's number must be its own
    return oracle.bucket_misses(first, _shapes(spark, d), sites, confirmed).select("miss", "bucket", "how")


@query("foreign_repair", "SELECT 'supplier:' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE WHEN l_linenumber > 2 THEN l_orderkey ELSE p_size END AS line, p_brand AS t_path, p_size AS t_line FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def foreign_repair(spark, d):
    edges = table(spark, d, "lineitem").select(_cat("supplier:", F.col("l_suppkey")).alias("src"), _cat("p", F.col("l_partkey")).alias("dst"), F.when(F.col("l_linenumber") > 2, F.col("l_orderkey")).alias("line"))
    return oracle.repair_lines(edges, table(spark, d, "part").filter("p_size > 10").select(_cat("p", F.col("p_partkey")).alias("id"), F.col("p_brand").alias("path"), F.col("p_size").alias("line")))
