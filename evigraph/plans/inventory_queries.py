"""Queries of inventories: tests, definitions, coverage by unit and directory."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import inventory as inv
from evigraph.plans.registry import query
from evigraph.sources import domain
from evigraph.sources.domain import GRAPH_SQL, table

WITH = f"WITH RECURSIVE {GRAPH_SQL}"


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


#: Parts as Python symbols: brands are files, sizes lines; a third are methods of classes, some of which are built by __init__.
SYMS = """sm AS (SELECT CASE WHEN p_brand > 'Brand#3' THEN 'tests/test_' || lower(replace(p_brand, '#', '')) || '.py' ELSE 'src/' || p_brand || '.py' END AS path, 'm' || p_brand AS module, CASE p_partkey % 3 WHEN 0 THEN 'method' ELSE 'function' END AS kind, nm AS name, CASE p_partkey % 3 WHEN 0 THEN (CASE p_size % 3 WHEN 0 THEN 'Test' WHEN 1 THEN 'TestDeep.In' ELSE 'Helper' END) || (p_partkey % 10) || '.' || nm WHEN 1 THEN nm ELSE 'outer.' || nm END AS qualname, p_size AS line
 FROM (SELECT *, CASE WHEN p_partkey % 31 = 0 THEN '__init__' WHEN p_partkey % 4 = 0 THEN 'test_' || p_partkey ELSE 'run' || p_partkey END AS nm FROM part))"""


def _symbols(spark, d):
    p = table(spark, d, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(key % 31 == 0, "__init__").when(key % 4 == 0, _cat("test_", key)).otherwise(_cat("run", key))
    path = F.when(F.col("p_brand") > "Brand#3", _cat("tests/test_", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), ".py")).otherwise(_cat("src/", F.col("p_brand"), ".py"))
    owner = F.when(size % 3 == 0, "Test").when(size % 3 == 1, "TestDeep.In").otherwise("Helper")
    qual = F.when(key % 3 == 0, _cat(owner, key % 10, ".", name)).when(key % 3 == 1, name).otherwise(_cat("outer.", name))
    return p.select(path.alias("path"), _cat("m", F.col("p_brand")).alias("module"), F.when(key % 3 == 0, "method").otherwise("function").alias("kind"), name.alias("name"), qual.alias("qualname"), size.alias("line"), key.alias("key"))


@query("python_tests", f"WITH {SYMS} SELECT path || '::' || replace(qualname, '.', '::') AS id, path, 'pytest' AS framework, line, module || '.' || qualname AS symbol FROM sm s WHERE starts_with(path, 'tests/') AND starts_with(name, 'test') AND ((kind = 'function' AND qualname = name) OR (kind = 'method' AND regexp_full_match(qualname, 'Test[^.]*[.][^.]*') AND NOT EXISTS (SELECT 1 FROM sm i WHERE i.path = s.path AND i.qualname = split_part(s.qualname, '.', 1) || '.__init__')))")
def python_tests(spark, d):
    return inv.python_tests(_symbols(spark, d))


@query("path_predicates", "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || (CASE page_id % 5 WHEN 0 THEN '/test_a.py' WHEN 1 THEN '/tests/x.ts' WHEN 2 THEN '/testdata/y' WHEN 3 THEN '/b_test.go' ELSE '/c.spec.ts' END) AS path FROM pages) SELECT page_id, page_id % 5 = 0 AS test_file, page_id % 5 = 2 AS fixture, page_id % 5 <> 2 AS test_path, (['python', 'typescript', NULL, 'go', 'typescript'])[(page_id % 5 + 1)::INT] AS language, string_split(path, '/')[1] || CASE WHEN len(string_split(path, '/')) > 2 THEN '/' || string_split(path, '/')[2] ELSE '' END AS dir FROM p")
def path_predicates(spark, d):
    k = F.col("page_id") % 5
    tail = F.when(k == 0, "/test_a.py").when(k == 1, "/tests/x.ts").when(k == 2, "/testdata/y").when(k == 3, "/b_test.go").otherwise("/c.spec.ts")
    p = table(spark, d, "pages").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail).alias("path"))
    path = F.col("path")
    return p.select("page_id", inv.is_test_file(path).alias("test_file"), inv.is_fixture_path(path).alias("fixture"), inv.is_test_path(path).alias("test_path"), inv.language_of(path, F.lit(None).cast("string")).alias("language"), inv.directory_of(path).alias("dir"))


LANG = "ls AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'pkg/a_test.go' WHEN 1 THEN 'pkg/a.go' WHEN 2 THEN 'web/x.test.ts' ELSE 'src/FooTest.java' END AS path, 'm' AS module, 'function' AS kind, CASE s_suppkey % 5 WHEN 0 THEN 'TestRun' WHEN 1 THEN 'Testing' WHEN 2 THEN 'BenchmarkX' WHEN 3 THEN 'helper' ELSE 'Example' END || CASE WHEN s_suppkey % 3 = 0 THEN '_' || s_suppkey ELSE '' END AS name, s_suppkey AS line FROM supplier)"


@query("tests_by_language", f"WITH {LANG} SELECT 'go test' AS framework, path || '::' || name AS id, line FROM ls WHERE path = 'pkg/a_test.go' AND regexp_matches(name, '^(Test|Benchmark|Fuzz|Example)($|[^a-z])') UNION ALL SELECT 'jest', path || '::' || name, line FROM ls WHERE path = 'web/x.test.ts' AND line % 3 = 0 UNION ALL SELECT 'junit', path || '::' || name, line FROM ls WHERE path = 'src/FooTest.java' AND line % 3 = 0")
def tests_by_language(spark, d):
    k = F.col("s_suppkey")
    path = F.when(k % 4 == 0, "pkg/a_test.go").when(k % 4 == 1, "pkg/a.go").when(k % 4 == 2, "web/x.test.ts").otherwise("src/FooTest.java")
    name = _cat(F.when(k % 5 == 0, "TestRun").when(k % 5 == 1, "Testing").when(k % 5 == 2, "BenchmarkX").when(k % 5 == 3, "helper").otherwise("Example"), F.when(k % 3 == 0, _cat("_", k)).otherwise(""))
    s = table(spark, d, "supplier").select(path.alias("path"), F.lit("m").alias("module"), F.lit("function").alias("kind"), name.alias("name"), name.alias("qualname"), k.alias("line"))
    marks = s.filter("line % 3 = 0").select("path", "line")
    out = inv.tests_by_language(s, "go").union(inv.tests_by_language(s, "typescript", marks)).union(inv.tests_by_language(s, "java", marks))
    return out.select("framework", "id", "line")


@query("test_reach_labels", f"""{WITH}, cl AS (SELECT src, dst FROM medges WHERE src NOT LIKE 'supplier:%'), inj AS (SELECT 'customer:' || c_custkey AS src, 'supplier:' || (c_custkey % 10) AS dst, CASE WHEN c_custkey % 2 = 0 THEN 'autouse' ELSE 'named' END AS via FROM customer WHERE c_custkey < 60 UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'named' FROM supplier),
ts AS (SELECT 'customer:' || c_custkey AS seed FROM customer WHERE c_custkey < 60), al AS (SELECT src, dst FROM cl UNION SELECT src, dst FROM inj), na AS (SELECT src, dst FROM cl UNION SELECT src, dst FROM inj WHERE via = 'named'),
ra AS (SELECT seed, dst AS id FROM ts JOIN al ON al.src = seed UNION SELECT ra.seed, al.dst FROM ra JOIN al ON al.src = ra.id), rn AS (SELECT seed, dst AS id FROM ts JOIN na ON na.src = seed UNION SELECT rn.seed, na.dst FROM rn JOIN na ON na.src = rn.id), rc AS (SELECT seed, dst AS id FROM ts JOIN cl ON cl.src = seed UNION SELECT rc.seed, cl.dst FROM rc JOIN cl ON cl.src = rc.id)
SELECT seed AS id, coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM ra WHERE ra.seed = ts.seed), '') AS reaches, coalesce((SELECT string_agg(DISTINCT replace(id, ':', '.'), ',' ORDER BY replace(id, ':', '.')) FROM ra WHERE ra.seed = ts.seed), '') AS reaches_modules,
coalesce((SELECT string_agg(DISTINCT replace(id, ':', '.'), ',' ORDER BY replace(id, ':', '.')) FROM rn WHERE rn.seed = ts.seed AND id NOT IN (SELECT id FROM rc WHERE rc.seed = ts.seed)), '') AS through_fixtures, coalesce((SELECT string_agg(DISTINCT replace(id, ':', '.'), ',' ORDER BY replace(id, ':', '.')) FROM ra WHERE ra.seed = ts.seed AND id NOT IN (SELECT id FROM rn WHERE rn.seed = ts.seed)), '') AS through_autouse FROM ts""")
def test_reach_labels(spark, d):
    """Customers are tests, their nations and regions what they call, suppliers the fixtures that they are given."""
    e = domain.module_edges(spark, d).filter("not startswith(src, 'supplier')").withColumn("type", F.lit("calls"))
    key = F.col("c_custkey")
    c = table(spark, d, "customer").filter("c_custkey < 60")
    inj = c.select(_cat("customer:", key).alias("src"), _cat("supplier:", key % 10).alias("dst"), F.when(key % 2 == 0, "autouse").otherwise("named").alias("via"))
    inj = inj.union(table(spark, d, "supplier").select(_cat("supplier:", F.col("s_suppkey")), _cat("nation:", F.col("s_nationkey")), F.lit("named")))
    tests = c.select(_cat("customer:", key).alias("id"), _cat("customer:", key).alias("symbol"), F.lit("tests/test_a.py").alias("path"))
    owners = domain.nodes(spark, d).select("id", F.replace("id", F.lit(":"), F.lit(".")).alias("module"), "path")
    out = inv.test_reach(tests, e, owners, inj)
    return out.select("id", *(F.array_join(x, ",").alias(x) for x in ("reaches", "reaches_modules", "through_fixtures", "through_autouse")))


@query("test_index", f"{WITH}, g AS (SELECT DISTINCT src AS test, dst AS id FROM calls WHERE tier = 'semantic' UNION SELECT 'orphan:' || s_suppkey, 'gone:' || s_suppkey FROM supplier), n AS (SELECT id FROM nodes WHERE kind = 'part') SELECT 'covered' AS what, n.id, count(*) AS tests FROM n JOIN g ON g.id = n.id GROUP BY n.id UNION ALL SELECT 'unguarded', id, 0 FROM n WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT DISTINCT 'orphan', test, 0 FROM g WHERE test NOT IN (SELECT test FROM g JOIN n ON n.id = g.id)")
def test_index(spark, d):
    g = domain.calls(spark, d).filter("tier = 'semantic'").select(F.col("src").alias("test"), F.col("dst").alias("id"))
    g = g.union(table(spark, d, "supplier").select(_cat("orphan:", F.col("s_suppkey")), _cat("gone:", F.col("s_suppkey"))))
    covered, bare, orphans = inv.test_index(domain.nodes(spark, d).filter("kind = 'part'"), g)
    zero = F.lit(0).cast("long").alias("tests")
    return covered.select(F.lit("covered").alias("what"), "id", "tests").union(bare.select(F.lit("unguarded"), "id", zero)).union(orphans.select(F.lit("orphan"), F.col("test"), zero))


@query("own_code", "WITH m AS (SELECT 'p' || p_partkey AS id, 'd' || (p_size % 5) || '/e' || (p_size % 3) || '/f' || p_partkey || '.py' AS path FROM part) SELECT id FROM m WHERE NOT (path LIKE 'd1/%' OR path LIKE 'd2/e0/%') AND id NOT IN (SELECT 'p' || p_partkey FROM part WHERE p_partkey % 6 = 0)")
def own_code(spark, d):
    p, size, key = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    m = p.select(_cat("p", key).alias("id"), _cat("d", size % 5, "/e", size % 3, "/f", key, ".py").alias("path"), key.alias("key"))
    trees = inv.excluded_trees(spark.createDataFrame([(".", "d1"), ("d2", "e0"), ("", "zz")], "root string, dir string"), m)
    return inv.own_code(m.select("id", "path"), m.filter("key % 6 = 0").select("path"), trees).select("id")


@query("excluded_trees", "SELECT DISTINCT CASE WHEN p_size % 5 = 1 THEN 'd1' ELSE 'd2/e0' END AS dir FROM part WHERE p_size % 5 = 1 OR (p_size % 5 = 2 AND p_size % 3 = 0)")
def excluded_trees(spark, d):
    size = F.col("p_size")
    m = table(spark, d, "part").select(_cat("d", size % 5, "/e", size % 3, "/f.py").alias("path"))
    return inv.excluded_trees(spark.createDataFrame([(".", "d1"), ("d2", "e0"), ("", "zz")], "root string, dir string"), m)


@query("value_only", f"{WITH}, s AS (SELECT 'part:' || p_partkey AS id, 'b:' || p_brand || (p_size % 9) AS module, CASE WHEN p_size % 9 < 4 THEN 'function' WHEN p_size % 9 = 4 THEN 'type' ELSE 'const' END AS kind, p_size % 9 < 2 AS scope_only FROM part), c AS (SELECT dst FROM calls WHERE tier = 'dynamic' AND line = 1) SELECT DISTINCT module AS id FROM s WHERE module NOT IN (SELECT module FROM s WHERE kind IN ('function', 'type') AND NOT scope_only) AND module NOT IN (SELECT module FROM s JOIN c ON c.dst = s.id)")
def value_only(spark, d):
    k = F.col("p_size") % 9
    s = table(spark, d, "part").select(_cat("part:", F.col("p_partkey")).alias("id"), _cat("b:", F.col("p_brand"), k).alias("module"), F.when(k < 4, "function").when(k == 4, "type").otherwise("const").alias("kind"), (k < 2).alias("scope_only"))
    modules = s.select(F.col("module").alias("id"), F.lit("module").alias("kind")).distinct()
    return inv.value_only(modules, s, domain.calls(spark, d).filter("tier = 'dynamic' and line = 1"))


DEFS = "df AS (SELECT 's/' || l_suppkey || '.rs' AS path, 'f' || (l_partkey % 60) AS qualname, l_orderkey AS line, l_orderkey + l_linenumber AS end_line, CASE WHEN l_suppkey % 5 = 0 THEN 'impl' || (l_linenumber % 2) ELSE 'impl' END AS header, CASE WHEN l_partkey % 60 = 7 AND l_linenumber = 2 THEN 'const' ELSE 'fn' END AS kind, l_suppkey % 3 <> 0 AS gated FROM lineitem WHERE l_quantity > 45)"


def _defs(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 45")
    c = F.col
    return li.select(
        _cat("s/", c("l_suppkey"), ".rs").alias("path"), _cat("f", c("l_partkey") % 60).alias("qualname"), c("l_orderkey").alias("line"), (c("l_orderkey") + c("l_linenumber")).alias("end_line"), F.when(c("l_suppkey") % 5 == 0, _cat("impl", c("l_linenumber") % 2)).otherwise("impl").alias("header"),
        F.when((c("l_partkey") % 60 == 7) & (c("l_linenumber") == 2), "const").otherwise("fn").alias("kind"), (c("l_suppkey") % 3 != 0).alias("gated"),
    )


REPEATS = f"{DEFS}, rp AS (SELECT path, qualname, CASE WHEN count(DISTINCT header) > 1 OR count(DISTINCT kind) > 1 THEN 'shared' WHEN bool_and(gated) THEN 'twin' ELSE 'repeat' END AS why FROM df GROUP BY ALL HAVING count(*) > 1)"


@query("repeated_definitions", f"WITH {REPEATS} SELECT rp.path, rp.qualname, why, string_agg(line || '-' || end_line, ',' ORDER BY line, end_line) AS spans FROM rp JOIN df ON df.path = rp.path AND df.qualname = rp.qualname GROUP BY ALL")
def repeated_definitions(spark, d):
    return inv.repeated_definitions(_defs(spark, d)).withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["line"].cast("string"), s["end_line"].cast("string"))), ","))


@query("compiled_arms", f"WITH {REPEATS}, a AS (SELECT DISTINCT df.path, df.qualname, line, end_line FROM df JOIN rp ON rp.path = df.path AND rp.qualname = df.qualname AND why = 'twin'), ix AS (SELECT DISTINCT path, line + 1 AS d FROM df WHERE line % 2 = 0), lv AS (SELECT DISTINCT a.* FROM a JOIN ix ON ix.path = a.path AND d BETWEEN line AND end_line) SELECT * FROM lv WHERE (path, qualname) IN (SELECT (path, qualname) FROM lv GROUP BY path, qualname HAVING count(*) = 1)")
def compiled_arms(spark, d):
    defs = _defs(spark, d)
    twins = inv.repeated_definitions(defs).filter("why = 'twin'")
    return inv.compiled_arms(twins, defs.filter("line % 2 = 0").select("path", (F.col("line") + 1).alias("line")))


@query("init_spans", "WITH s AS (SELECT 'g' || l_suppkey || '.go' AS path, l_orderkey AS line, l_orderkey + 2 AS end_line FROM lineitem WHERE l_partkey % 50 = 3) SELECT path, string_agg(line || '-' || end_line, ',' ORDER BY line) AS spans FROM s GROUP BY path HAVING count(*) > 1")
def init_spans(spark, d):
    li = table(spark, d, "lineitem")
    s = li.select(_cat("g", F.col("l_suppkey"), ".go").alias("path"), F.lit("function").alias("kind"), F.when(F.col("l_partkey") % 50 == 3, "init").otherwise("T.init").alias("qualname"), F.col("l_orderkey").alias("line"), (F.col("l_orderkey") + 2).alias("end_line"))
    return inv.init_spans(s).withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["line"].cast("string"), x["end_line"].cast("string"))), ","))


@query("type_files", "WITH t AS (SELECT CASE WHEN p_size % 4 = 0 THEN '' ELSE 'com.' || replace(p_brand, '#', '') END AS package, replace(p_name, ' ', '') || (p_size % 10) AS type, 'f' || p_partkey AS path FROM part) SELECT CASE WHEN package = '' THEN type ELSE package || '.' || type END AS name, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM t GROUP BY 1")
def type_files(spark, d):
    size = F.col("p_size")
    t = table(spark, d, "part").select(F.when(size % 4 == 0, "").otherwise(_cat("com.", F.replace("p_brand", F.lit("#"), F.lit("")))).alias("package"), _cat(F.replace("p_name", F.lit(" "), F.lit("")), size % 10).alias("type"), _cat("f", F.col("p_partkey")).alias("path"))
    return inv.type_files(t)


IMP = "im AS (SELECT DISTINCT 'p' || (l_orderkey % 300) AS path, (['os.path', 'urllib.parse', 'own.util', 'json', 'types'])[(l_partkey % 5 + 1)::INT] AS module, CASE WHEN l_suppkey % 3 = 0 THEN 'x' || (l_suppkey % 2) END AS original, CASE WHEN l_suppkey % 6 = 0 THEN 'y' || (l_partkey % 2) END AS bound, (l_linenumber = 7)::INT AS level FROM lineitem)"


@query("stdlib_bindings", f"WITH {IMP}, b AS (SELECT path, module, level, unnest(CASE WHEN bound IS NOT NULL THEN [bound] WHEN original IS NOT NULL THEN [original] WHEN contains(module, '.') THEN [split_part(module, '.', 1), module] ELSE [module] END) AS name FROM im) SELECT path, name FROM b GROUP BY path, name HAVING bool_and(level = 0 AND split_part(module, '.', 1) IN ('os', 'urllib', 'json'))")
def stdlib_bindings(spark, d):
    li, c = table(spark, d, "lineitem"), F.col
    module = F.element_at(F.array(*map(F.lit, ("os.path", "urllib.parse", "own.util", "json", "types"))), (c("l_partkey") % 5 + 1).cast("int"))
    imports = li.select(_cat("p", c("l_orderkey") % 300).alias("path"), module.alias("module"), F.when(c("l_suppkey") % 3 == 0, _cat("x", c("l_suppkey") % 2)).alias("original"), F.when(c("l_suppkey") % 6 == 0, _cat("y", c("l_partkey") % 2)).alias("bound"), (c("l_linenumber") == 7).cast("int").alias("level"))
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    return inv.stdlib_bindings(imports, names("os", "urllib", "json", "types"), names("own", "types"))


COV = "cv AS (SELECT 'a' || (o_custkey % 4) || '/b' || (o_custkey % 3) || '/c/f' || (o_orderkey % 40) || (['.py', '.ts', '.tf', '.h'])[(o_orderkey % 4 + 1)::INT] AS path, CASE WHEN o_orderkey % 8 = 3 THEN 'cpp' END AS language, o_orderkey % 20 AS sites, o_orderkey % 7 AS unresolved, o_orderpriority AS cls FROM orders), lg AS (SELECT *, coalesce(language, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' WHEN path LIKE '%.h' THEN 'c' END) AS lang FROM cv)"


def _coverage(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    ending = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".tf", ".h"))), (k % 4 + 1).cast("int"))
    return o.select(_cat("a", c % 4, "/b", c % 3, "/c/f", k % 40, ending).alias("path"), F.when(k % 8 == 3, "cpp").alias("language"), (k % 20).alias("sites"), (k % 7).alias("unresolved"), F.create_map("o_orderpriority", F.lit(1).cast("long")).alias("tail"))


@query("directory_coverage", f"WITH {COV}, x AS (SELECT string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS dir, lang AS language, * EXCLUDE (path, language, lang) FROM lg WHERE lang IS NOT NULL) SELECT dir, language, sum(sites)::BIGINT AS sites, sum(unresolved)::BIGINT AS unresolved, (SELECT string_agg(cls || '=' || n, ',' ORDER BY cls) FROM (SELECT cls, count(*) AS n FROM x y WHERE y.dir = x.dir AND y.language = x.language GROUP BY cls)) AS tail FROM x GROUP BY dir, language")
def directory_coverage(spark, d):
    out = inv.coverage_by_directory(_coverage(spark, d))
    return out.withColumn("tail", F.array_join(F.transform(F.array_sort(F.map_entries("tail")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("classes_available", f"WITH {COV} SELECT lang AS language, CASE lang WHEN 'python' THEN 'local,nested,external' WHEN 'typescript' THEN 'nested' ELSE 'local' END AS classes FROM lg WHERE lang IN ('python', 'typescript', 'cpp') GROUP BY lang")
def classes_available(spark, d):
    table_ = [("python", "external", 3), ("python", "local", 1), ("python", "nested", 2), ("typescript", "nested", 2), ("cpp", "local", 1), ("go", "local", 1)]
    out = inv.classes_available(_coverage(spark, d), spark.createDataFrame(table_, "language string, class string, position int"))
    return out.withColumn("classes", F.array_join("classes", ","))


@query("verification_base", "SELECT r_regionkey AS position, CASE r_regionkey WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'l' || r_regionkey END AS language, CASE r_regionkey WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS repos, CASE r_regionkey WHEN 0 THEN 'verified on 3 repos: a, b, c' WHEN 1 THEN 'verified on 1 repo: this' ELSE 'not verified on any repo' END AS note FROM region")
def verification_base(spark, d):
    k = F.col("r_regionkey")
    asked = table(spark, d, "region").select(k.alias("position"), F.when(k == 0, "python").when(k == 1, "go").otherwise(_cat("l", k)).alias("language"))
    base = spark.createDataFrame([("python", 3, "a, b, c", "many"), ("go", 1, "this", "one")], "language string, repos int, on string, depth string")
    return inv.verification_base(asked, base).select("position", "language", "repos", "note")


UNITS = "un AS (SELECT DISTINCT 'u' || (o_custkey % 6) AS unit, path FROM (SELECT *, 'a' || (o_custkey % 4) || '/b' || (o_custkey % 3) || '/c/f' || (o_orderkey % 40) || (['.py', '.ts', '.tf', '.h'])[(o_orderkey % 4 + 1)::INT] AS path FROM orders)), cs AS (SELECT path, sum(sites) AS sites, sum(unresolved) AS unresolved FROM cv GROUP BY path)"


def _complement(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    cov = _coverage(spark, d)
    ending = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".tf", ".h"))), (k % 4 + 1).cast("int"))
    units = o.select(_cat("u", c % 6).alias("unit"), _cat("a", c % 4, "/b", c % 3, "/c/f", k % 40, ending).alias("path"))
    errors = table(spark, d, "nation").select(F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") % 7 == 0, ".").when(F.col("n_nationkey") % 3 == 0, _cat("a", F.col("n_nationkey") % 4)).otherwise(_cat("a", F.col("n_nationkey") % 4, "/b", F.col("n_nationkey") % 3, "/c/d/e")).alias("path"), F.lit("parse").alias("stage"), F.col("n_name").alias("message"))
    return inv.complement(cov.groupBy("path").agg(F.sum("sites").alias("sites"), F.sum("unresolved").alias("unresolved")), units, errors)


@query("unit_complement", f"""WITH {COV}, {UNITS}, er AS (SELECT n_nationkey AS seq, CASE WHEN n_nationkey % 7 = 0 THEN '.' WHEN n_nationkey % 3 = 0 THEN 'a' || (n_nationkey % 4) ELSE 'a' || (n_nationkey % 4) || '/b' || (n_nationkey % 3) || '/c/d/e' END AS path, n_name AS message FROM nation),
fd AS (SELECT DISTINCT unit, regexp_replace(path, '/[^/]*$', '') AS dir FROM un), hit AS (SELECT DISTINCT unit, seq, er.path || ': parse: ' || message AS text FROM er JOIN fd ON er.path = '.' OR er.path = dir OR starts_with(dir, er.path || '/') OR starts_with(er.path, dir || '/')), rk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY seq) AS r FROM hit)
SELECT un.unit, coalesce(sum(sites), 0)::BIGINT AS sites, coalesce(sum(unresolved), 0)::BIGINT AS unresolved, coalesce((SELECT string_agg(text, '|' ORDER BY seq) FROM rk WHERE rk.unit = un.unit AND r <= 10), '') AS degradations FROM un LEFT JOIN cs ON cs.path = un.path GROUP BY un.unit""")
def unit_complement(spark, d):
    return _complement(spark, d).withColumn("degradations", F.array_join("degradations", "|"))


@query("context_manifest", f"WITH {COV}, {UNITS}, s AS (SELECT un.unit, coalesce(sum(sites), 0)::BIGINT AS sites, coalesce(sum(unresolved), 0)::BIGINT AS unresolved FROM un LEFT JOIN cs ON cs.path = un.path GROUP BY un.unit) SELECT *, sites >= 10 AND unresolved / sites > 0.2 AS human_first FROM s")
def context_manifest(spark, d):
    return inv.human_first(_complement(spark, d).drop("degradations"), 10, 0.2)


@query("policy_manifest", f"WITH {COV}, {UNITS}, g AS (SELECT DISTINCT unit, 'tests/' || unit || '.py' AS path FROM un), e AS (SELECT * FROM un UNION SELECT * FROM g) SELECT unit, path, path LIKE '%/f3.%' OR path = 'tests/u1.py' AS refused FROM e")
def policy_manifest(spark, d):
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    ending = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".tf", ".h"))), (k % 4 + 1).cast("int"))
    units = o.select(_cat("u", c % 6).alias("unit"), _cat("a", c % 4, "/b", c % 3, "/c/f", k % 40, ending).alias("path")).distinct()
    guards = units.select("unit", _cat("tests/", F.col("unit"), ".py").alias("path")).distinct()
    forbidden = units.union(guards).filter("path like '%/f3.%' or path = 'tests/u1.py'").select("path")
    held, refused = inv.write_mounts(units, guards, forbidden)
    return held.withColumn("refused", F.lit(False)).union(refused.withColumn("refused", F.lit(True)))


@query("refusal_record", "WITH r AS (SELECT 'p' || l_partkey AS path, l_orderkey AS line, l_returnflag AS token, l_linestatus AS name FROM lineitem WHERE l_quantity > 49) SELECT (SELECT count(*) FROM r) AS n, string_agg(path || ':' || line || ' `' || token || '` named `' || name || '`', '; ' ORDER BY path, line, token, name) AS examples FROM (SELECT * FROM r ORDER BY path, line, token, name LIMIT 3) HAVING count(*) > 0")
def refusal_record(spark, d):
    r = table(spark, d, "lineitem").filter("l_quantity > 49").select(_cat("p", F.col("l_partkey")).alias("path"), F.col("l_orderkey").alias("line"), F.col("l_returnflag").alias("token"), F.col("l_linestatus").alias("name"))
    return inv.refusal_record(r).withColumn("examples", F.array_join("examples", "; "))
