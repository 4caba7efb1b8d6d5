"""Source scans and derived edges on small trees."""

from evigraph.operators import derived
from evigraph.plans.code_queries import SOURCES
from evigraph.sources import code


def facts(spark, *kinds):
    rows = code.scan(spark.createDataFrame(SOURCES, "path string, text string")).collect()
    return {(r["path"], r["name"], r["line"], r["end_line"]) for r in rows if r["kind"] in kinds}


def test_symbols_by_language(spark):
    got = facts(spark, "function", "class", "type", "method", "resource", "tf-module")
    assert {("app/core.py", "Lock", 5, 10), ("main.go", "Run", 5, 7), ("main.go", "T", 9, 10), ("lib.rs", "go_on", 3, 5), ("A.java", "A", 3, 7), ("a.c", "add", 3, 6), ("a.ts", "run", 3, 5), ("m.tf", "net", 4, 6)} <= got


def test_calls_and_imports(spark):
    assert {("main.go", "Println", 6, 6), ("lib.rs", "step", 4, 4), ("A.java", "g", 5, 5), ("a.c", "mul", 5, 5)} <= facts(spark, "call")
    assert {("main.go", "fmt", 3, 3), ("a.ts", "./x", 1, 1), ("a.c", "a.h", 1, 1), ("m.tf", "./net", 5, 5)} <= facts(spark, "import")


def test_broken_python_is_one_error_row(spark):
    rows = code.scan(spark.createDataFrame([("x.py", "def ("), ("y.py", None), ("z.bin", "x")], "path string, text string")).collect()
    assert [(r["path"], r["kind"]) for r in rows] == [("x.py", "error")]


def test_module_ids_collide_by_root(spark):
    files = [("app/__init__.py", ""), ("app/core.py", ""), ("tools/core.py", ""), ("other/core.py", ""), ("setup.py", "")]
    got = {r["path"]: (r["id"], r["root"]) for r in code.modules(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"app/__init__.py": ("app", "."), "app/core.py": ("app.core", "."), "tools/core.py": ("tools:core", "tools"), "other/core.py": ("other:core", "other"), "setup.py": ("setup", ".")}


def test_derived_edges_refuse_what_is_drawn_or_doubtful(spark):
    d = spark.createDataFrame
    edges = d([("f", "Lock.__exit__", "calls", "semantic")], "src string, dst string, type string, tier string")
    items = d([("f", "Lock", "a", 1), ("g", "Lock", "a", 2), ("g", "Other", "a", 2)], "src string, class string, path string, line int")
    classes = d([("Lock",), ("Other",)], "id string")
    methods = d([("Lock", "__enter__", "Lock.__enter__"), ("Lock", "__exit__", "Lock.__exit__")], "class string, name string, id string")
    assert [(r["src"], r["dst"]) for r in derived.with_calls(items, classes, methods, edges).collect()] == [("f", "Lock.__enter__")]


def test_rehome_takes_the_innermost_body(spark):
    d = spark.createDataFrame
    facts_ = d([("a", 5, "m"), ("a", 50, "m")], "path string, line int, scope string")
    bodies = d([("a", 1, 20, "outer"), ("a", 4, 6, "inner")], "path string, first int, last int, id string")
    assert {(r["line"], r["scope"]) for r in derived.rehome(facts_, bodies).collect()} == {(5, "inner"), (50, "m")}


def test_routes_without_a_literal_need_a_framework(spark):
    body = "\n\n@app.get(PATH)\ndef a():\n    pass\n\n\n@app.route('/x', methods=['get', 'PUT'])\ndef b():\n    pass\n"
    files = [("web.py", "from flask import Flask" + body), ("other.py", "import os" + body)]
    rows = code.scan(spark.createDataFrame(files, "path string, text string")).filter("kind in ('route', 'declined-route')").collect()
    assert {(r["path"], r["kind"], r["name"]) for r in rows} == {("web.py", "declined-route", ""), ("web.py", "route", "GET"), ("web.py", "route", "PUT"), ("other.py", "route", "GET"), ("other.py", "route", "PUT")}
