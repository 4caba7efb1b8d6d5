"""Index, rounding and padding rules of the scalar library, table functions, files and streams."""

import json

import pytest
from pyspark.sql import functions as F

from evigraph.functions import scalars as s
from evigraph.sources import files
from evigraph.streaming import events


def cases():
    A = F.array(*map(F.lit, [1, 2, 3, 2]))
    return [
        (s.at(A, -1), 2), (s.at(A, 9), None), (s.index_of(A, F.lit(2)), 1), (s.index_of(A, F.lit(7)), -1), (s.last_index_of(A, F.lit(2)), 3), (s.slice_(A, 1, -1), [2, 3]), (s.slice_(A, -2), [3, 2]),
        (s.splice(A, 1, 2, F.lit(9)), [1, 9, 2]), (s.with_(A, -1, F.lit(8)), [1, 2, 3, 8]), (s.fill(A, F.lit(0), 1, 3), [1, 0, 0, 2]), (s.copy_within(A, 0, 2), [3, 2, 3, 2]), (s.join(A, "-"), "1-2-3-2"),
        (s.find_index(A, lambda x: x > 1), 1), (s.find_last_index(A, lambda x: x == 2), 3), (s.find(A, lambda x: x > 5), None),
        (s.pad_start(F.lit("abcd"), 2, "x"), "abcd"), (s.pad_start(F.lit("a"), 3, "x"), "xxa"), (s.pad_end(F.lit("a"), 3, "x"), "axx"), (s.string_at(F.lit("abc"), -1), "c"), (s.string_at(F.lit("abc"), 7), None),
        (s.substring(F.lit("abcdef"), 4, 1), "bcd"), (s.string_slice(F.lit("abcdef"), -3, -1), "de"), (s.string_last_index_of(F.lit("abcab"), F.lit("ab")), 3), (s.replace_first(F.lit("aXbX"), "X", "--"), "a--bX"), (s.split(F.lit("a.b.c"), ".", 2), ["a", "b"]),
        (s.trim(F.lit("  a \t")), "a"), (s.search(F.lit("ab1"), "[0-9]"), 2), (s.js_round(F.lit(-2.5)), -2), (s.js_round(F.lit(2.5)), 3), (s.trunc(F.lit(-2.7)), -2), (s.clz32(F.lit(0)), 32), (s.clz32(F.lit(1)), 31), (s.clz32(F.lit(-1)), 0),
        (s.imul(F.lit(0xFFFFFFFF), F.lit(5)), -5), (s.imul(F.lit(123456789), F.lit(987654321)), -67153019), (s.parse_int(F.lit(" 42px")), 42), (s.parse_int(F.lit("px")), None), (s.parse_float(F.lit("1.5e3x")), 1500.0),
        (s.is_safe_integer(F.lit(2.0**53)), False), (s.from_code_point(F.lit(300)), "Ĭ"), (s.normalize_nfc(F.lit("é")), "é"), (s.query_params(F.lit("http://h/p?a=1&b=2")), {"a": "1", "b": "2"}), (s.put(F.create_map(F.lit("a"), F.lit(1)), F.lit("a"), F.lit(2)), {"a": 2}),
    ]


def test_scalars(spark):
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases())]).first()
    for k, (column, want) in enumerate(cases()):
        assert got[k] == want, column


def test_table_functions(spark):
    from evigraph.functions.tables import Descriptors, DiffSections

    diff = "\n".join([
        "--- a/x", "+++ b/x", "@@ -1,2 +1,3 @@", "--- was a line", "+b", "+c", " same", "--- /dev/null", "+++ b/y", "@@ -0,0 +1 @@", "+z",
        "diff --git a/g b/g", "deleted file mode 100644", "--- a/g", "+++ /dev/null", "@@ -1 +0,0 @@", "-g", "diff --git a/o b/p", "similarity index 90%", "rename from o", "rename to p",
        "diff --git a/i.png b/i.png", "Binary files a/i.png and b/i.png differ",
    ])
    rows = DiffSections(F.lit(diff)).collect()
    assert [(r["path"], r["old_path"], r["created"], r["deleted"], r["renamed"], r["binary"], r["added"], r["removed"]) for r in rows] == [
        ("x", "x", False, False, False, False, 2, 1), ("y", "/dev/null", True, False, False, False, 1, 0), ("g", "g", False, True, False, False, 0, 1),
        ("p", "o", False, False, True, False, 0, 0), ("i.png", "i.png", False, False, False, True, 0, 0),
    ]
    rows = Descriptors(F.lit("scip py pkg 1 `a b`/C#m().")).collect()
    assert [(r["kind"], r["name"]) for r in rows][-2:] == [("type", "C"), ("method", "m")]
    assert Descriptors(F.lit("local 5")).collect() == Descriptors(F.lit("scip py pkg")).collect() == []


def test_added_lines_know_their_parents(spark):
    from evigraph.functions.tables import AddedAnchors

    hunks = "@@ -3,3 +3,4 @@\n a\n-b\n+B\n+C\n d\n@@ -0,0 +9 @@\n+new"
    assert [tuple(r) for r in AddedAnchors(F.lit(hunks)).collect()] == [(4, "replace", 4, "B"), (5, "insert", 4, "C"), (9, "insert", 0, "new")]


def test_complete_streams_keep_their_last_result(spark, tmp_path):
    """Several micro-batches give one row for each user."""
    rows = [(k, "2024-01-01 00:00:00", k % 2, "click", 1.0, "{}") for k in range(6)]
    for n in range(3):
        spark.createDataFrame(rows[2 * n : 2 * n + 2], "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    stream = spark.readStream.schema(events.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = events.run_once(events.usage(stream), "many", "complete")
    assert sorted((r["user_id"], r["events"]) for r in out.collect()) == [(0, 3), (1, 3)] and out.columns == ["user_id", "events", "value"]


def test_log_keeps_its_cursor_over_torn_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"tool": "a"}\n{"tool": \n\n{"tool": "c"}\n')
    log = files.read_log(spark, str(tmp_path), "tool STRING")
    assert [(r["line"], r["torn"], r["tool"]) for r in log.orderBy("line").collect()] == [(1, False, "a"), (2, True, None), (4, False, "c")]
    assert [r["tool"] for r in files.log_page(log, 1, 5).collect()] == ["c"]


def test_version_gate(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"schema_version": 3, "sha": "x"}))
    with pytest.raises(files.VersionError):
        files.read_artifact(spark, str(tmp_path / "g.json"), "schema_version INT, sha STRING", {4}, "graph")
    assert files.read_artifact(spark, str(tmp_path / "g.json"), "schema_version INT, sha STRING", {3}, "graph").count() == 1


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    files.append_jsonl(df, str(tmp_path / "o"))
    files.append_jsonl(df, str(tmp_path / "o"))
    assert files.read_jsonl(spark, str(tmp_path / "o"), "n long, s string").count() == 2


def test_sources_leave_hidden_and_skipped_folders_out(spark, tmp_path):
    for p in ("a.py", "pkg/b.py", "node_modules/c.py", ".git/d.py"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x = 1")
    assert sorted(r["path"] for r in files.read_sources(spark, str(tmp_path), "*.py").collect()) == ["a.py", "pkg/b.py"]


def test_mermaid_refuses_large_views(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, type string")
    assert "n0 ==> n1" in files.to_mermaid(nodes, edges)
    with pytest.raises(ValueError):
        files.to_mermaid(nodes, edges, 1)


def test_timer_expires_signups(spark, small):
    out = events.run_once(events.expiring(events.read_events(spark, small), 86_400_000), "timer-test")
    got = {r["status"]: r["n"] for r in out.groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got.get("expired", 0) > 0
