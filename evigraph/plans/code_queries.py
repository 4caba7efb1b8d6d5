"""Queries of source scans and derived edges: the sources are small literals, the joins run on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.operators import derived
from evigraph.plans.registry import query
from evigraph.sources import code, domain
from evigraph.sources.domain import GRAPH_SQL, table

SOURCES = [
    ("app/__init__.py", ""), ("app/api.py", "from app import core\nimport os, fastapi\n\n\n@router.get('/items')\ndef items():\n    with core.Lock() as lock:\n        return core.load(os.getcwd())\n\n\n@router.route(PREFIX)\ndef odd():\n    pass\n"),
    ("app/core.py", "class Base:\n    pass\n\n\nclass Lock(Base):\n    def __enter__(self):\n        return self\n\n    def __exit__(self, *a):\n        pass\n\n\ndef load(path):\n    return open(path)\n"),
    ("tools/core.py", "x = 1\n"), ("tools/app/core.py", "def helper():\n    pass\n"), ("main.go", 'package main\n\nimport "fmt"\n\nfunc Run(a int) {\n\tfmt.Println(a)\n}\n\ntype T struct {\n}\n'),
    ("lib.rs", "use std::fmt;\n\npub fn go_on() {\n    step();\n}\n\nstruct S {\n}\n"), ("A.java", "import java.util.List;\n\nclass A {\n  public int f(int x) {\n    return g(x);\n  }\n}\n"),
    ("a.c", '#include "a.h"\n\nint add(int a, int b)\n{\n  return mul(a, b);\n}\n'), ("a.ts", "import { x } from './x';\n\nexport function run() {\n  x();\n}\n"), ("m.tf", 'resource "aws_s3" "logs" {\n}\n\nmodule "net" {\n  source = "./net"\n}\n'),
    ("pyproject.toml", '[project]\nname = "app"\n\n[project.scripts]\napp = "app.api:items"\n'), ("tests/test_api.py", "def test_items():\n    pass\n"),
]


def _files(spark):
    return spark.createDataFrame(SOURCES, "path string, text string")


@query("code_scan")
def code_scan(spark, d):
    return code.scan(_files(spark))


@query("module_discovery")
def module_discovery(spark, d):
    return code.modules(_files(spark))


@query("cli_entries")
def cli_entries(spark, d):
    return code.cli_entries(_files(spark))


@query("route_scan")
def route_scan(spark, d):
    return code.scan(_files(spark)).filter(F.col("kind").isin("route", "declined-route")).select("path", "line", "kind", F.col("name").alias("method"), F.col("target").alias("route"), F.col("scope").alias("handler"))


@query("with_call_edges")
def with_call_edges(spark, d):
    facts = code.scan(_files(spark))
    local = facts.filter("kind = 'with'").select(F.col("scope").alias("src"), F.element_at(F.split("name", "[.]"), -1).alias("class"), "path", "line")
    classes = facts.filter("kind = 'class'").select(F.col("target").alias("id"))
    methods = facts.filter("kind = 'method'").select(F.col("scope").alias("class"), "name", F.col("target").alias("id"))
    return derived.with_calls(local, classes, methods, domain.module_edges(spark, d))


@query("union_member_sites", f"WITH {GRAPH_SQL} SELECT path, line FROM calls GROUP BY path, line HAVING count(DISTINCT dst) >= 2")
def union_member_sites(spark, d):
    c = domain.calls(spark, d)
    recv = c.select("path", "line", F.lit(0).alias("col"), F.lit("m").alias("method"), F.array("dst").alias("members"))
    return derived.union_member_sites(recv, c.select(F.col("dst").alias("class"), F.lit("m").alias("method"), F.col("dst").alias("definition")).distinct()).select("path", "line")


@query("alias_calls", f"WITH {GRAPH_SQL}, r AS (SELECT path, line, min(dst) AS dst FROM calls GROUP BY path, line HAVING count(DISTINCT dst) = 1) SELECT DISTINCT 'region:' || (r.line % 5) AS src, r.dst, r.path, r.line FROM r")
def alias_calls(spark, d):
    c = domain.calls(spark, d)
    sites = c.select(F.concat(F.lit("region:"), F.col("line") % 5).alias("src"), F.col("line").alias("alias"), "path", "line").distinct()
    return derived.alias_calls(sites, c.select("path", F.col("line").alias("alias"), "dst"), domain.module_edges(spark, d))


@query("fixture_injections", "WITH q AS (SELECT 'c' || c_custkey AS src, c_nationkey AS n, c_mktsegment AS name FROM customer), f AS (SELECT s_nationkey AS n, 's' || s_suppkey AS dst FROM supplier), near AS (SELECT q.src, q.name, f.dst FROM q JOIN f ON f.n = q.n), one AS (SELECT src FROM near GROUP BY src HAVING count(DISTINCT dst) = 1), has AS (SELECT DISTINCT src FROM near), far AS (SELECT q.src, q.name, 'r' || n.n_regionkey AS dst FROM q JOIN nation n ON n.n_nationkey = q.n WHERE q.src NOT IN (SELECT src FROM has)) SELECT src, dst, name FROM near WHERE src IN (SELECT src FROM one) UNION ALL SELECT src, dst, name FROM far")
def fixture_injections(spark, d):
    """A customer's request takes its nation's only supplier, else its region; two suppliers refuse."""
    n = table(spark, d, "nation")
    q = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    q = q.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("r"), "n_regionkey")).alias("scopes"))
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    near = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("scope"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    far = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("scope"), F.concat(F.lit("r"), "r_regionkey").alias("dst"))
    return derived.fixture_injections(q, near.union(far).crossJoin(F.broadcast(segments)))


@query("unstated_bases", f"WITH {GRAPH_SQL}, h AS (SELECT 'supplier:' || s_suppkey AS class FROM supplier WHERE s_acctbal > 0) SELECT DISTINCT c.src, c.dst FROM calls c JOIN h ON h.class = c.src WHERE c.line BETWEEN 2 AND 3")
def unstated_bases(spark, d):
    c = domain.calls(spark, d)
    uses = c.select(F.col("src").alias("path"), "line", "dst", F.lit("b").alias("name"))
    heads = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.lit(2).alias("first"), F.lit(3).alias("last"), F.array(F.lit("b")).alias("names")).withColumn("path", F.col("id"))
    return derived.unstated_bases(heads, uses, domain.module_edges(spark, d))


@query("mint_missing", "WITH s AS (SELECT DISTINCT o_custkey AS path, o_orderstatus AS name FROM orders WHERE o_orderpriority = '1-URGENT'), x AS (SELECT o.o_custkey AS path, o.o_orderkey AS line, o.o_orderstatus AS name, CASE WHEN o.o_orderstatus = 'P' THEN 'local' ELSE 'function' END AS kind, o.o_orderpriority AS p FROM orders o) SELECT path, line, name FROM x WHERE kind <> 'local' AND p <> '1-URGENT'")
def mint_missing(spark, d):
    o = table(spark, d, "orders")
    defs = o.select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderstatus") == "P", "local").otherwise("function").alias("kind"), F.col("o_orderpriority").alias("p"))
    return derived.mint(defs, defs.filter("p = '1-URGENT'"))[0].select("path", "line", "name")


@query("blind_spot_map", f"""WITH {GRAPH_SQL}, f AS (SELECT 'supplier/' || s_suppkey AS path, 100 AS lines, s_acctbal > 0 AS captured FROM supplier), s AS (SELECT 'part:' || p_partkey AS id, 'supplier/' || (p_partkey % (SELECT count(*) FROM supplier)) AS path, p_size AS line, p_size + 3 AS end_line FROM part),
u AS (SELECT DISTINCT s.path, unnest(range(s.line, s.end_line + 1)) AS n FROM s JOIN f ON f.path = s.path AND f.captured WHERE EXISTS (SELECT 1 FROM calls c WHERE c.dst = s.id AND c.tier <> 'semantic')), k AS (SELECT path, count(*) AS k FROM u GROUP BY path),
o AS (SELECT f.path, f.lines, CASE WHEN captured THEN coalesce(k, 0) ELSE lines END::BIGINT AS uncaptured FROM f LEFT JOIN k ON k.path = f.path) SELECT *, (SELECT round(sum(uncaptured) / sum(lines), 4) FROM o) AS fraction FROM o""")
def blind_spot_map(spark, d):
    s = table(spark, d, "supplier")
    files = s.select(F.concat(F.lit("supplier/"), "s_suppkey").alias("path"), F.lit(100).alias("lines"), (F.col("s_acctbal") > 0).alias("captured"))
    many = F.broadcast(s.agg(F.count("*").alias("many")))
    p = table(spark, d, "part").join(many, how="cross")
    symbols = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat(F.lit("supplier/"), F.col("p_partkey") % F.col("many")).alias("path"), F.col("p_size").alias("line"), (F.col("p_size") + 3).alias("end_line"))
    return derived.blind_spots(files, symbols, domain.calls(spark, d))
