"""The decision table of the two-lane join, row by row."""

import pytest

from evigraph.operators import evidence as ev

SYNTAX = "seq long, file string, line int, name string, col int, kind string, ambiguous boolean"
SEMANTIC = "seq long, file string, line int, name string, col int, def_file string, def_line int, kind string"
FALLBACK = "file string, line int, name string, def_file string, def_line int"
EXTERNAL = "file string, line int, name string, in_repo boolean"


@pytest.fixture
def lanes(spark):
    def run(syntax=(), semantic=(), fallback=(), external=(), withhold=()):
        d = spark.createDataFrame
        args = d(list(syntax), SYNTAX), d(list(semantic), SEMANTIC), d(list(fallback), FALLBACK), d(list(external), EXTERNAL), d([(w,) for w in withhold], "file string")
        return sorted(tuple(r) for r in ev.join_lanes(*args).select("kind", "line", "def_file", "def_line", "tier").collect())

    return run


def call(seq=1, line=1, name="f", col=4, kind="call", ambiguous=False):
    return (seq, "a.py", line, name, col, kind, ambiguous)


def res(seq=1, line=1, name="f", col=4, def_file="b.py", def_line=9, kind="resolution"):
    return (seq, "a.py", line, name, col, def_file, def_line, kind)


GUESS = ("a.py", 1, "f", "c.py", 3)


def test_resolved_call_is_semantic(lanes):
    assert lanes([call()], [res()]) == [("calls", 1, "b.py", 9, "semantic")]


def test_import_site(lanes):
    assert lanes([call(kind="import")], [res()]) == [("imports", 1, "b.py", 9, "semantic")]


def test_missed_call_falls_back(lanes):
    assert lanes([call()], [], [GUESS]) == [("calls", 1, "c.py", 3, "syntactic")]


def test_missed_call_without_guess_draws_nothing(lanes):
    assert lanes([call()]) == []


def test_unclaimed_resolution_is_a_use(lanes):
    assert lanes([], [res()]) == [("uses", 1, "b.py", 9, "semantic")]


def test_other_name_on_the_line_does_not_match(lanes):
    assert lanes([call()], [res(name="g")]) == [("uses", 1, "b.py", 9, "semantic")]


def test_nearest_column_wins_and_the_other_is_a_use(lanes):
    got = lanes([call(col=20)], [res(1, col=4, def_line=1), res(2, col=18, def_line=2)])
    assert got == [("calls", 1, "b.py", 2, "semantic"), ("uses", 1, "b.py", 1, "semantic")]


def test_site_without_column_takes_the_first_and_claims_the_name(lanes):
    assert lanes([call(col=-1)], [res(1, col=4, def_line=1), res(2, col=18, def_line=2)]) == [("calls", 1, "b.py", 1, "semantic")]


def test_candidate_without_column_ranks_last(lanes):
    got = lanes([call(col=500)], [res(1, col=-1, def_line=1), res(2, col=4, def_line=2)])
    assert ("calls", 1, "b.py", 2, "semantic") in got


def test_ambiguous_site_only_claims(lanes):
    assert lanes([call(ambiguous=True)], [res()], [GUESS]) == []


def test_external_vetoes_the_guess(lanes):
    assert lanes([call()], [], [GUESS], [("a.py", 1, "f", False)]) == []


def test_external_in_repo_does_not_veto(lanes):
    assert lanes([call()], [], [GUESS], [("a.py", 1, "f", True)]) == [("calls", 1, "c.py", 3, "syntactic")]


def test_withheld_file_drops_guessed_calls_not_imports(lanes):
    assert lanes([call()], [], [GUESS], [], ["a.py"]) == []
    assert lanes([call(kind="import")], [], [GUESS], [], ["a.py"]) == [("imports", 1, "c.py", 3, "syntactic")]


def test_implements_passes_through(lanes):
    assert lanes([], [res(kind="implements")]) == [("implements", 1, "b.py", 9, "semantic")]


def test_own_column_needs_every_resolution_to_be_the_guess(lanes):
    alias = res(name="real", def_file="c.py", def_line=3)
    assert lanes([call()], [alias], [GUESS]) == [("calls", 1, "c.py", 3, "semantic")]
    assert lanes([call()], [alias, res(2, name="other")], [GUESS])[0] == ("calls", 1, "c.py", 3, "syntactic")


def test_coverage_counts_add_up(spark):
    d = spark.createDataFrame
    fates = ev.dispositions(d([call(), call(2, line=2), call(3, line=3)], SYNTAX), d([res()], SEMANTIC), d([], FALLBACK), d([("a.py", 2, "f", False)], EXTERNAL))
    (row,) = ev.coverage(fates).collect()
    assert (row["sites"], row["resolved"], row["external"], row["unresolved"], row["accounted"]) == (3, 1, 1, 1, 0.667)


def test_innermost_scope(spark):
    points = spark.createDataFrame([(1, 1, 5), (2, 1, 50)], "id long, f long, at long")
    spans = spark.createDataFrame([(1, 0, 10, 7), (1, 4, 6, 8), (1, 4, 6, 9)], "f long, start long, end long, scope long")
    got = {r["id"]: r["scope"] for r in ev.innermost(points, spans, "f", "at", "id", 4).collect()}
    assert got == {1: 8, 2: None}


def test_longest_prefix(spark):
    names = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "name string")
    modules = spark.createDataFrame([("a",), ("a.b",)], "module string")
    assert {r["name"]: r["module"] for r in ev.longest_prefix(names, modules).collect()} == {"a.b.c": "a.b", "a.x": "a", "z": None}
