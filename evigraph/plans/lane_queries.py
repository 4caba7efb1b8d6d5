"""Queries of the two lanes' finer joins, and of call resolution from sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import derived, evidence
from evigraph.plans.registry import query
from evigraph.sources.domain import GRAPH_SQL, table


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


HITS = """ht AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'f' || (l_orderkey % 40) AS file, (l_partkey % 30)::BIGINT AS line, CASE WHEN l_tax = 0 THEN -1 ELSE (l_suppkey % 6)::INT END AS col, (['add', 'index', 'eq', 'operator<<', 'make'])[(l_suppkey % 5 + 1)::INT] AS name, 'd' || (l_partkey % 7) AS def_file, (l_partkey % 11)::BIGINT AS def_line FROM lineitem),
tk AS (SELECT DISTINCT 'f' || (l_orderkey % 40) AS file, (l_suppkey % 30)::BIGINT AS line, (l_partkey % 6)::INT AS col, (['+', '[]', '!=', '<<', '-'])[(l_partkey % 5 + 1)::INT] AS spelling, l_linenumber = 2 AS in_template FROM lineitem WHERE l_quantity < 8), cn AS (SELECT DISTINCT 'd' || (i % 7) AS file, (i % 5)::BIGINT AS line FROM range(0, 35) t(i))"""


def _hits(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % 5 + 1).cast("int"))
    hits = li.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), _cat("f", c("l_orderkey") % 40).alias("file"), (c("l_partkey") % 30).alias("line"), F.when(c("l_tax") == 0, -1).otherwise((c("l_suppkey") % 6).cast("int")).alias("col"), pick(("add", "index", "eq", "operator<<", "make"), c("l_suppkey")).alias("name"), _cat("d", c("l_partkey") % 7).alias("def_file"), (c("l_partkey") % 11).alias("def_line"))
    tokens = li.filter("l_quantity < 8").select(_cat("f", c("l_orderkey") % 40).alias("file"), (c("l_suppkey") % 30).alias("line"), (c("l_partkey") % 6).cast("int").alias("col"), pick(("+", "[]", "!=", "<<", "-"), c("l_partkey")).alias("spelling"), (c("l_linenumber") == 2).alias("in_template"))
    constructors = spark.range(35).select(_cat("d", c("id") % 7).alias("file"), (c("id") % 5).alias("line")).distinct()
    return hits, tokens.distinct(), constructors


@query("trait_operator_calls", f"WITH {HITS} SELECT DISTINCT ht.seq FROM ht JOIN tk ON tk.file = ht.file AND tk.line = ht.line AND tk.col = ht.col AND tk.spelling = CASE ht.name WHEN 'add' THEN '+' WHEN 'index' THEN '[]' WHEN 'eq' THEN '!=' END WHERE ht.col >= 0")
def trait_operator_calls(spark, d):
    hits, tokens, _ = _hits(spark, d)
    return evidence.trait_operator_calls(hits, tokens)


@query("symbol_operator_calls", f"WITH {HITS}, a AS (SELECT file, line, col, bool_or(in_template) AS t FROM tk WHERE spelling = '<<' GROUP BY ALL) SELECT ht.seq, CASE WHEN t THEN 'withheld' ELSE 'call' END AS fate FROM ht JOIN a ON a.file = ht.file AND a.line = ht.line AND a.col = ht.col WHERE ht.name = 'operator<<' AND ht.col >= 0")
def symbol_operator_calls(spark, d):
    hits, tokens, _ = _hits(spark, d)
    return evidence.symbol_operator_calls(hits, tokens)


@query("construction_calls", f"WITH {HITS}, a AS (SELECT file, line, col, bool_or(in_template) AS t FROM tk GROUP BY ALL) SELECT ht.seq, CASE WHEN t THEN 'withheld' ELSE 'call' END AS fate FROM ht JOIN a ON a.file = ht.file AND a.line = ht.line AND a.col = ht.col WHERE ht.col >= 0 AND (def_file, def_line) IN (SELECT (file, line) FROM cn)")
def construction_calls(spark, d):
    return evidence.construction_calls(*_hits(spark, d))


@query("new_calls", f"WITH {HITS}, tg AS (SELECT file AS def_file, line AS def_line, CASE WHEN line > 1 THEN 'ctor' || file END AS to_file, CASE WHEN line > 1 THEN line + 100 END AS to_line FROM cn) SELECT ht.seq, to_file, to_line, CASE WHEN to_file IS NULL THEN 'class-only' ELSE 'call' END AS fate FROM ht JOIN tg USING (def_file, def_line) WHERE col >= 0 AND EXISTS (SELECT 1 FROM tk WHERE tk.file = ht.file AND tk.line = ht.line AND tk.col = ht.col)")
def new_calls(spark, d):
    hits, tokens, ctors = _hits(spark, d)
    has = F.col("line") > 1
    targets = ctors.select(F.col("file").alias("def_file"), F.col("line").alias("def_line"), F.when(has, _cat("ctor", F.col("file"))).alias("to_file"), F.when(has, F.col("line") + 100).alias("to_line"))
    return evidence.new_calls(hits, tokens, targets)


@query("implicit_constructions", f"WITH {HITS}, bd AS (SELECT 'f' || (i % 40) AS file, i % 9 * 3 AS s, i % 9 * 3 + 2 AS e FROM range(0, 100) t(i)) SELECT DISTINCT ht.seq FROM ht JOIN bd ON bd.file = ht.file AND ht.line BETWEEN s AND e WHERE col >= 0 AND (def_file, def_line) IN (SELECT (file, line) FROM cn) AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.file = ht.file AND tk.line = ht.line AND tk.col = ht.col)")
def implicit_constructions(spark, d):
    hits, tokens, ctors = _hits(spark, d)
    i = F.col("id")
    bodies = spark.range(100).select(_cat("f", i % 40).alias("file"), (i % 9 * 3).alias("start"), (i % 9 * 3 + 2).alias("end"))
    return evidence.implicit_constructions(hits, bodies, ctors, tokens)


DIS = """an AS (SELECT 'f' || (l_orderkey % 40) AS file, l_linenumber AS line, 'n' || (l_suppkey % 3) AS name, 'd' || (l_partkey % 4) AS def_file, (l_partkey % 9)::BIGINT AS def_line FROM lineitem WHERE l_quantity > 48), rw AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'f' || (l_orderkey % 50) AS file, l_linenumber AS line, 'n' || (l_suppkey % 3) AS name, 'd' || (l_suppkey % 4) AS guess_file, (l_suppkey % 9)::BIGINT AS guess_line, 'd' || (l_partkey % 4) AS def_file, (l_partkey % 13)::BIGINT AS def_line FROM lineitem WHERE l_quantity < 3 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY file, line, name, guess_file, guess_line, def_file, def_line) = 1),
tw AS (SELECT 'd' || (i % 4) AS path, 't' || (i % 3) AS name, (i % 6 * 2)::BIGINT AS line, (i % 6 * 2 + 1)::BIGINT AS end_line FROM range(0, 24) t(i))"""


@query("disagreement_shapes", f"""WITH {DIS}, x AS (SELECT rw.*, (SELECT count(*) FROM an WHERE an.file = rw.file AND an.line = rw.line AND an.name = rw.name) > 1 AND EXISTS (SELECT 1 FROM an WHERE an.file = rw.file AND an.line = rw.line AND an.name = rw.name AND an.def_file = guess_file AND an.def_line = guess_line) AS pair,
guess_file = def_file AND EXISTS (SELECT 1 FROM tw a JOIN tw b ON b.path = a.path AND b.name = a.name AND (b.line, b.end_line) <> (a.line, a.end_line) WHERE a.path = guess_file AND a.line = guess_line AND rw.def_line BETWEEN b.line AND b.end_line AND NOT rw.def_line BETWEEN a.line AND a.end_line) AS twin FROM rw) SELECT seq, CASE WHEN pair THEN 'same-line-pair' WHEN twin THEN 'cfg-twin' WHEN file < 'f2' THEN 'withheld' END AS shape FROM x""")
def disagreement_shapes(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    place = (c("l_linenumber").alias("line"), _cat("n", c("l_suppkey") % 3).alias("name"))
    answers = li.filter("l_quantity > 48").select(_cat("f", c("l_orderkey") % 40).alias("file"), *place, _cat("d", c("l_partkey") % 4).alias("def_file"), (c("l_partkey") % 9).alias("def_line"))
    rows = li.filter("l_quantity < 3").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), _cat("f", c("l_orderkey") % 50).alias("file"), *place, _cat("d", c("l_suppkey") % 4).alias("guess_file"), (c("l_suppkey") % 9).alias("guess_line"), _cat("d", c("l_partkey") % 4).alias("def_file"), (c("l_partkey") % 13).alias("def_line"))
    i = c("id")
    twins = spark.range(24).select(_cat("d", i % 4).alias("path"), _cat("t", i % 3).alias("name"), (i % 6 * 2).alias("line"), (i % 6 * 2 + 1).alias("end_line"))
    first = rows.groupBy("seq").agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")  # a row's number must be its own
    return evidence.disagreement_shapes(first, answers, twins, rows.select("file").filter("file < 'f2'")).select("seq", "shape")


@query("constructor_lines", "WITH m AS (SELECT DISTINCT 'f' || (l_orderkey % 90) AS file, l_partkey % 40 AS line, CASE l_linenumber % 3 WHEN 0 THEN 'C' || (l_suppkey % 3) || '#C' || (l_suppkey % 3) ELSE 'C1#C2' END AS tail FROM lineitem WHERE l_quantity > 47) SELECT file, line FROM m GROUP BY file, line HAVING count(DISTINCT tail) = 1 AND split_part(min(tail), '#', 1) = split_part(min(tail), '#', 2)")
def constructor_lines(spark, d):
    c = F.col
    tail = F.when(c("l_linenumber") % 3 == 0, _cat("C", c("l_suppkey") % 3, "#C", c("l_suppkey") % 3)).otherwise("C1#C2")
    defs = table(spark, d, "lineitem").filter("l_quantity > 47").select(_cat("f", c("l_orderkey") % 90).alias("file"), (c("l_partkey") % 40).alias("line"), _cat("cxx . . $ ns/", tail, "(1a).").alias("moniker"))
    return evidence.constructor_lines(defs)


@query("contradicted_symbols", "WITH s AS (SELECT 'p' || p_partkey AS id, 'f' || (p_partkey % 60) AS file, p_size AS line, 'n' || (p_partkey % 4) AS name, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'type' END AS kind FROM part), df AS (SELECT DISTINCT 'f' || (s_suppkey % 60) AS file, n_nationkey + 1 AS line, 'n' || ((s_suppkey + n_nationkey) % 4) AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'function' ELSE 'type' END AS kind FROM supplier, nation), a AS (SELECT file, line, list(name) AS ns, list(kind || ':' || name) AS ks, string_agg(kind || ':' || name, ',' ORDER BY kind || ':' || name) AS read FROM df GROUP BY ALL) SELECT id, CASE WHEN NOT list_contains(ns, name) THEN 'another-name' ELSE 'another-kind' END AS why, read FROM s JOIN a USING (file, line) WHERE NOT list_contains(ks, kind || ':' || name)")
def contradicted_symbols(spark, d):
    c = F.col
    s = table(spark, d, "part").select(_cat("p", c("p_partkey")).alias("id"), _cat("f", c("p_partkey") % 60).alias("file"), c("p_size").alias("line"), _cat("n", c("p_partkey") % 4).alias("name"), F.when(c("p_size") % 2 == 0, "function").otherwise("type").alias("kind"))
    grid = table(spark, d, "supplier").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(24))))
    defs = grid.select(_cat("f", c("s_suppkey") % 60).alias("file"), (c("n") + 1).alias("line"), _cat("n", (c("s_suppkey") + c("n")) % 4).alias("name"), F.when(c("n") % 3 == 0, "function").otherwise("type").alias("kind"))
    return evidence.contradicted(s, defs)


#: Calls by suppliers' methods: modules are nations, order lines the sites.
RESOLVE = """cs AS (SELECT l_orderkey * 10 + l_linenumber AS seq, 'm' || (l_suppkey % 10) AS module, CASE l_partkey % 3 WHEN 0 THEN 'C' || (l_suppkey % 4) || '.run' WHEN 1 THEN 'go' ELSE '' END AS scope, (['self.f' || (l_partkey % 6), 'f' || (l_partkey % 8), 'imp' || (l_partkey % 4), 'pkg.m' || (l_partkey % 10) || '.C1.f2', 'al.C2.f3', '<expr>.f1', 'loc'])[(l_linenumber - 1) % 7 + 1] AS callee, l_linenumber AS line FROM lineitem WHERE l_quantity > 45 QUALIFY row_number() OVER (PARTITION BY seq ORDER BY module, scope, callee, line) = 1),
sy AS (SELECT 'm' || a AS module, q AS qualname, k AS kind FROM range(0, 10) t(a), (SELECT 'C' || i AS q, 'class' AS k FROM range(0, 4) c(i) UNION ALL SELECT 'C' || i || '.f' || j, 'method' FROM range(0, 4) c(i), range(0, 4) f(j) WHERE (i + j) % 2 = 1 UNION ALL SELECT 'f' || j, 'function' FROM range(0, 5) f(j)) x),
rs AS (SELECT seq, CASE WHEN callee LIKE '<%' THEN NULL WHEN callee LIKE 'self.%' THEN CASE WHEN scope LIKE 'C%' AND EXISTS (SELECT 1 FROM sy WHERE sy.module = cs.module AND sy.qualname = split_part(scope, '.', 1) || '.' || callee[6:]) THEN module || '.' || split_part(scope, '.', 1) || '.' || callee[6:] || '|self' END
 WHEN callee = 'loc' THEN CASE WHEN scope = 'go' AND line < 100 THEN module || '.go.loc|local' END WHEN callee LIKE 'f%' THEN CASE WHEN EXISTS (SELECT 1 FROM sy WHERE sy.module = cs.module AND sy.qualname = callee) THEN module || '.' || callee || '|own' END
 WHEN callee LIKE 'imp%' THEN CASE WHEN callee IN ('imp0', 'imp1') THEN 'm3.f' || callee[4:] || '|import' END WHEN callee LIKE 'pkg.%' THEN CASE WHEN EXISTS (SELECT 1 FROM sy WHERE sy.module = split_part(callee, '.', 2) AND sy.qualname = 'C1.f2') THEN split_part(callee, '.', 2) || '.C1.f2|dotted' END WHEN callee LIKE 'al.%' THEN CASE WHEN EXISTS (SELECT 1 FROM sy WHERE sy.module = 'm5' AND qualname = 'C2.f3') THEN 'm5.C2.f3|dotted' END END AS r FROM cs)"""


def _resolve(spark, d):
    li, c = table(spark, d, "lineitem").filter("l_quantity > 45"), F.col
    scope = F.when(c("l_partkey") % 3 == 0, _cat("C", c("l_suppkey") % 4, ".run")).when(c("l_partkey") % 3 == 1, "go").otherwise("")
    names = F.array(_cat("self.f", c("l_partkey") % 6), _cat("f", c("l_partkey") % 8), _cat("imp", c("l_partkey") % 4), _cat("pkg.m", c("l_partkey") % 10, ".C1.f2"), F.lit("al.C2.f3"), F.lit("<expr>.f1"), F.lit("loc"))
    calls = li.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), _cat("m", c("l_suppkey") % 10).alias("module"), scope.alias("scope"), F.element_at(names, (c("l_linenumber") - 1) % 7 + 1).alias("callee"), c("l_linenumber").alias("line")).distinct()
    rows = [(f"m{a}", q, k) for a in range(10) for q, k in [(f"C{i}", "class") for i in range(4)] + [(f"C{i}.f{j}", "method") for i in range(4) for j in range(4) if (i + j) % 2 == 1] + [(f"f{j}", "function") for j in range(5)]]
    symbols = spark.createDataFrame(rows, "module string, qualname string, kind string")
    imports = spark.createDataFrame([(f"m{a}", f"imp{k}", "m3", f"f{k}") for a in range(10) for k in (0, 1, 9)] + [(f"m{a}", "al", "m5", None) for a in range(10)], "module string, bound string, target string, original string")
    modules = spark.createDataFrame([(f"m{a}", f"pkg.m{a}") for a in range(10)], "id string, import_name string")
    local = spark.createDataFrame([(f"m{a}", "go", 1, 99, "loc") for a in range(10)], "module string, scope string, start int, end int, name string")
    first = calls.groupBy("seq").agg(F.min(F.struct(*calls.columns)).alias("r")).select("r.*")
    return first, evidence.resolve_calls(first, symbols, imports, modules, local)


@query("call_resolution", f"WITH {RESOLVE} SELECT seq, split_part(r, '|', 1) AS target, split_part(r, '|', 2) AS rule FROM rs WHERE r IS NOT NULL")
def call_resolution(spark, d):
    return _resolve(spark, d)[1]


@query("fallback_table", f"WITH {RESOLVE}, w AS (SELECT cs.module || '.py' AS file, cs.line, regexp_extract(cs.callee, '[^.]*$') AS name, split_part(r, '|', 1) AS target, cs.seq, cs.callee FROM cs JOIN rs USING (seq) WHERE r IS NOT NULL AND NOT (cs.callee = 'f1' AND cs.line BETWEEN 1 AND 3) AND NOT (cs.callee = 'imp1' AND cs.line BETWEEN 2 AND 5 AND cs.module <> 'm3')) SELECT file, line, name, split_part(arg_max(target, seq), '.', 1) || '.py' AS def_file, length(arg_max(target, seq)) AS def_line FROM w GROUP BY file, line, name")
def fallback_table(spark, d):
    calls, resolved = _resolve(spark, d)
    where = resolved.select(F.col("target").alias("id"), _cat(F.split_part("target", F.lit("."), F.lit(1)), ".py").alias("path"), F.length("target").alias("line")).distinct()
    spans = lambda name, a, b: spark.createDataFrame([(f"m{k}.py", name, a, b) for k in range(10)], "path string, name string, start int, end int")
    return evidence.fallback_table(resolved, calls.withColumn("path", _cat(F.col("module"), ".py")), where, spans("f1", 1, 3), spans("imp1", 2, 5))


@query("named_loads", "WITH m AS (SELECT 'id' || p_partkey AS id, 'pkg.' || replace(p_name, ' ', '_') AS import_name, p_brand || '/x' || (p_partkey % 90) || '.py' AS path FROM part), l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'import_module' ELSE 'spec_from_file_location' END AS via, CASE WHEN s_suppkey % 2 = 0 THEN (SELECT 'pkg.' || replace(p_name, ' ', '_') FROM part WHERE p_partkey = s_suppkey) WHEN s_suppkey % 4 = 1 THEN 'x' || (s_suppkey % 90) || '.py' ELSE (SELECT p_brand || '/x' || (p_partkey % 90) || '.py' FROM part WHERE p_partkey = s_suppkey) END AS written FROM supplier) SELECT 's' || s_suppkey AS path, s_suppkey AS line, via, written, coalesce(CASE WHEN via = 'import_module' THEN (SELECT CASE WHEN count(DISTINCT id) = 1 THEN min(id) END FROM m WHERE import_name = written) ELSE (SELECT CASE WHEN count(DISTINCT id) = 1 THEN min(id) END FROM m WHERE m.path = written OR ends_with(m.path, '/' || written)) END, '') AS target FROM l")
def named_loads(spark, d):
    p, s = table(spark, d, "part"), table(spark, d, "supplier")
    path = _cat(F.col("p_brand"), "/x", F.col("p_partkey") % 90, ".py")
    name = _cat("pkg.", F.replace("p_name", F.lit(" "), F.lit("_")))
    modules = p.select(_cat("id", F.col("p_partkey")).alias("id"), name.alias("import_name"), path.alias("path"))
    own = p.select(F.col("p_partkey").alias("s_suppkey"), name.alias("n"), path.alias("p"))
    key = F.col("s_suppkey")
    via = F.when(key % 2 == 0, "import_module").otherwise("spec_from_file_location")
    written = F.when(key % 2 == 0, F.col("n")).when(key % 4 == 1, _cat("x", key % 90, ".py")).otherwise(F.col("p"))
    loads = s.join(own, "s_suppkey", "left").select(_cat("s", key).alias("path"), key.alias("line"), via.alias("via"), written.alias("written"))
    return evidence.named_loads(loads, modules)


CLS = "cm AS (SELECT 'm' || (s_suppkey % 9) AS module, 'C' || (s_suppkey % 5) || '.make' AS qualname, s_suppkey % 5 * 10 AS first, s_suppkey % 5 * 10 + 9 AS last, 'C' || (s_suppkey % 5) AS owner FROM supplier GROUP BY ALL), cc AS (SELECT DISTINCT 'm' || (l_suppkey % 9) AS module, 'p' || (l_suppkey % 9) AS path, 'C' || (l_partkey % 5) || '.make' AS scope, l_linenumber * 8 AS line FROM lineitem), st AS (SELECT cc.module || '.' || cc.scope AS src, cc.module || '.' || owner AS dst, path, line FROM cc JOIN cm ON cm.module = cc.module AND cm.qualname = cc.scope AND line BETWEEN first AND last)"


@query("class_calls", f"WITH {CLS} SELECT DISTINCT src, dst, path, line FROM st WHERE dst NOT LIKE '%C4' AND NOT (src = 'm1.C1.make' AND dst = 'm1.C1')")
def class_calls(spark, d):
    c = F.col
    methods = table(spark, d, "supplier").select(_cat("m", c("s_suppkey") % 9).alias("module"), _cat("C", c("s_suppkey") % 5, ".make").alias("qualname"), (c("s_suppkey") % 5 * 10).alias("first"), (c("s_suppkey") % 5 * 10 + 9).alias("last"), _cat("C", c("s_suppkey") % 5).alias("owner")).distinct()
    calls = table(spark, d, "lineitem").select(_cat("m", c("l_suppkey") % 9).alias("module"), _cat("p", c("l_suppkey") % 9).alias("path"), _cat("C", c("l_partkey") % 5, ".make").alias("scope"), F.lit("cls").alias("callee"), (c("l_linenumber") * 8).alias("line")).distinct()
    ids = spark.createDataFrame([(f"m{m}.C{k}{x}",) for m in range(9) for k in range(5) for x in ("", ".make") if k < 4 or x], "id string")
    edges = spark.createDataFrame([("m1.C1.make", "m1.C1", "calls")], "src string, dst string, type string")
    return derived.class_calls(calls, methods, ids, edges)[0]


@query("factory_calls", "WITH s AS (SELECT DISTINCT 'f' || l_suppkey AS src, 'd' || (l_partkey % 4) AS factory, 'p' || (l_suppkey % 7) AS path, l_partkey AS line, CASE WHEN l_partkey % 3 = 0 THEN 'k' ELSE 'z' END AS arg FROM lineitem WHERE l_quantity < 5), r AS (SELECT s.*, CASE factory WHEN 'd0' THEN 'w0' WHEN 'd1' THEN CASE WHEN arg = 'k' THEN 'w1' END WHEN 'd2' THEN CASE WHEN arg <> 'k' THEN 'w3' END END AS dst FROM s) SELECT src, dst, path, line FROM r WHERE dst IS NOT NULL")
def factory_calls(spark, d):
    c = F.col
    sites = table(spark, d, "lineitem").filter("l_quantity < 5").select(_cat("f", c("l_suppkey")).alias("src"), _cat("d", c("l_partkey") % 4).alias("factory"), _cat("p", c("l_suppkey") % 7).alias("path"), c("l_partkey").alias("line"), F.array(F.when(c("l_partkey") % 3 == 0, "k").otherwise("z")).alias("args")).distinct()
    factories = spark.createDataFrame([("d0", None, "w0"), ("d1", "k", "w1"), ("d2", None, "w3"), ("d2", "k", "w4")], "factory string, guard string, dst string")
    return derived.factory_calls(sites, factories, spark.createDataFrame([], "src string, dst string, type string"))


VAL = "us AS (SELECT DISTINCT 't' || l_suppkey AS src, 'fx' || (l_partkey % 5) AS param, 'm' || (l_partkey % 3) AS method, 'p' AS path, l_partkey AS line FROM lineitem WHERE l_quantity < 4), ij AS (SELECT 't' || s_suppkey AS src, 'fx' || i AS param, 'K' || i AS class FROM supplier, range(0, 5) t(i) UNION ALL SELECT 't' || s_suppkey, 'fx4', 'K0' FROM supplier WHERE s_suppkey % 2 = 0)"


@query("value_calls", f"WITH {VAL} SELECT src, CASE param WHEN 'fx0' THEN CASE method WHEN 'm0' THEN 'K0.m0' END WHEN 'fx1' THEN CASE method WHEN 'm1' THEN 'K1.m1' WHEN 'm0' THEN 'K0.m0' END WHEN 'fx2' THEN CASE method WHEN 'm1' THEN 'K1.m1' WHEN 'm0' THEN 'K0.m0' END END AS dst, path, line FROM us WHERE (param = 'fx0' AND method = 'm0') OR (param IN ('fx1', 'fx2') AND method IN ('m0', 'm1'))")
def value_calls(spark, d):
    """K2 has the base K1 and that the base K0; K3 forks; K4 has several classes or no method."""
    return _value(spark, d)[0]


@query("value_call_refusals", f"WITH {VAL} SELECT why, count(*) AS n FROM (SELECT CASE WHEN param = 'fx4' AND src[2:]::INT % 2 = 0 THEN 'several-classes' WHEN param = 'fx3' THEN 'forked-bases' ELSE 'no-method' END AS why FROM us WHERE NOT ((param = 'fx0' AND method = 'm0') OR (param IN ('fx1', 'fx2') AND method IN ('m0', 'm1')))) GROUP BY why")
def value_call_refusals(spark, d):
    return _value(spark, d)[1]


def _value(spark, d):
    c = F.col
    uses = table(spark, d, "lineitem").filter("l_quantity < 4").select(_cat("t", c("l_suppkey")).alias("src"), _cat("fx", c("l_partkey") % 5).alias("param"), _cat("m", c("l_partkey") % 3).alias("method"), F.lit("p").alias("path"), c("l_partkey").alias("line")).distinct()
    s = table(spark, d, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    injections = s.select(_cat("t", c("s_suppkey")).alias("src"), _cat("fx", c("i")).alias("param"), _cat("K", c("i")).alias("class"))
    injections = injections.union(table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(_cat("t", c("s_suppkey")), F.lit("fx4"), F.lit("K0")))
    methods = spark.createDataFrame([("K0", "m0", "K0.m0"), ("K1", "m1", "K1.m1")], "class string, name string, id string")
    bases = spark.createDataFrame([("K1", "K0"), ("K2", "K1"), ("K3", "K1"), ("K3", "K0")], "class string, base string")
    return derived.value_calls(uses, injections, methods, bases, spark.createDataFrame([], "src string, dst string, type string"))


@query("symbol_imports", f"WITH {GRAPH_SQL}, i AS (SELECT DISTINCT 'p' || n_nationkey AS path, 'r' || n_regionkey AS module, 'x' || (n_nationkey % 4) AS original, CASE WHEN n_nationkey % 3 = 0 THEN 'y' END AS bound, CASE WHEN n_nationkey % 5 = 0 THEN 'f' ELSE '' END AS scope FROM nation) SELECT DISTINCT 'id' || path AS module, coalesce(bound, original) AS bound, 'T' || module AS target, original FROM i WHERE scope = '' AND module <> 'r4'")
def symbol_imports(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    imports = n.select(_cat("p", k).alias("path"), _cat("r", F.col("n_regionkey")).alias("module"), _cat("x", k % 4).alias("original"), F.when(k % 3 == 0, "y").alias("bound"), F.when(k % 5 == 0, "f").otherwise("").alias("scope"))
    modules = table(spark, d, "region").filter("r_regionkey < 4").select(_cat("Tr", F.col("r_regionkey")).alias("id"), _cat("r", F.col("r_regionkey")).alias("import_name"))
    return evidence.symbol_imports(imports, modules, imports.select("path", _cat("id", F.col("path")).alias("id")))
