"""Graph operators on the small fixture graph, and on random graphs against plain Python."""

import random

import pytest

from evigraph.operators import diff, graph, planning, partition

EDGES = [
    ("app.api", "app.core", "imports", "semantic"), ("app.api", "ext:react", "imports", "syntactic"), ("app.api", "env:HOME", "env-read", "syntactic"),
    ("app.api", "app.core", "calls", "semantic"), ("app.api", "app.auth", "calls", "semantic"), ("billing", "app.core", "calls", "syntactic"),
]
SCHEMA = "src string, dst string, type string, tier string"


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


def test_impact_of_the_fixture(spark, edges):
    got = {r["id"]: round(r["score"], 4) for r in graph.propagate(edges, spark.createDataFrame([("app.core",)], "id string")).collect()}
    assert got == {"app.core": 1.0, "app.api": 0.55, "billing": 0.33, "app.auth": 0.3025}


def test_fan_in_counts_distinct_neighbours(edges):
    got = {r["id"]: r["fan_in"] for r in graph.fan_in(edges).collect()}
    assert got["app.core"] == 2 and got["app.api"] == 4


def test_neighbourhood_depths(spark, edges):
    got = {r["id"]: r["hops"] for r in graph.neighbourhood(edges, spark.createDataFrame([("billing",)], "seed string"), 2).collect()}
    assert got == {"billing": 0, "app.core": 1, "app.api": 2}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_closure_and_components_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)}
    step: dict = {}
    for a, b in pairs:
        step.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), list(step.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += step.get(x, ())
        return seen

    df = spark.createDataFrame([(a, b, "calls", "semantic") for a, b in pairs], SCHEMA)
    nodes = sorted({x for p in pairs for x in p})
    got = {(r["seed"], r["id"]) for r in graph.closure(df, spark.createDataFrame([(n,) for n in nodes], "seed string")).collect()}
    assert got == {(a, b) for a in nodes for b in reach(a)}
    want = {a: min([a, *(b for b in reach(a) if a in reach(b))]) for a in nodes}
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == want


def test_levels(spark):
    df = spark.createDataFrame([("a", "b", "imports", "semantic"), ("b", "c", "imports", "semantic"), ("a", "c", "imports", "semantic")], SCHEMA)
    assert {r["id"]: r["level"] for r in graph.levels(df).collect()} == {"a": 2, "b": 1, "c": 0}


def test_cochange_limits_and_factor(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b")] + [(3, f"f{k}") for k in range(51)] + [(10 + k, p) for k in range(9) for p in "xy"]
    got = {(r["a"], r["b"]): (r["n"], r["factor"]) for r in planning.cochange(spark.createDataFrame(rows, "commit long, path string")).collect()}
    assert got == {("a", "b"): (1, 1.25), ("x", "y"): (9, 3.0)}


def test_units_respect_budget_cap_and_seeds():
    got = partition.build_units({"a": 1000, "b": 1000, "c": 5000}, [("a", "b", 5.0), ("b", "c", 9.0)], 5500)
    assert [(u, m) for u, m, _, _ in got] == [("U1", "c"), ("U2", "a"), ("U2", "b")]
    many = {f"m{k}": 10_000 + k for k in range(5)}
    got = partition.build_units(many, [], 100, 3, {"m1": 1.0, "m4": 0.5})
    assert {m: u for u, m, _, _ in got} == {"m4": "U1", "m3": "U2", "m1": "U3", "m2": "D1", "m0": "D2"}
    assert all(("deferred" in f) == u.startswith("D") and (("oversize" in f) == u.startswith("U")) for u, _, _, f in got)
    got = partition.build_units(many, [("m0", "m1", 1.0)], 100, 4, dict.fromkeys(many, 1.0))
    assert sorted(m for u, m, _, f in got if "capped" in f) == ["m0", "m1"]


def plain_units(weights, couplings, budget):
    """The strongest fitting pair of all, again and again."""
    units = [[m] for m in sorted(weights)]
    link = {}
    for a, b, w in couplings:
        link[min(a, b), max(a, b)] = link.get((min(a, b), max(a, b)), 0) + w
    while True:
        pairs = []
        for x in units:
            for y in units:
                if x is not y and x[0] < y[0]:
                    w = sum(link.get((min(a, b), max(a, b)), 0) for a in x for b in y)
                    if w > 0 and sum(weights[m] for m in x + y) <= budget:
                        pairs.append((-w, x[0], y[0], x, y))
        if not pairs:
            return {frozenset(u) for u in units}
        *_, x, y = min(pairs, key=lambda p: p[:3])
        units = sorted([u for u in units if u is not x and u is not y] + [sorted(x + y)])


def test_units_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(20):
        names = [f"m{k:02d}" for k in range(9)]
        weights = {m: rng.randrange(100_000, 200_000) for m in names}  # contracts never rival the inside
        couplings = [(*sorted(rng.sample(names, 2)), float(rng.randrange(1, 9))) for _ in range(14)]
        got: dict = {}
        for u, m, _, _ in partition.build_units(weights, couplings, 500_000):
            got.setdefault(u, set()).add(m)
        assert {frozenset(x) for x in got.values()} == plain_units(weights, couplings, 500_000)


def test_greedy_cover_prefers_larger_then_shorter(spark):
    rows = [("long", 1), ("long", 2), ("xy", 1), ("xy", 2), ("z", 3), ("z", 3)]
    got = planning.greedy_cover(spark.createDataFrame(rows, "input string, fault int")).orderBy("round").collect()
    assert [(r["input"], r["covers"]) for r in got] == [("xy", 2), ("z", 1)]


def test_redundant_cases_leave_every_fault_caught(spark):
    rows = [("a", 1), ("b", 1), ("b", 2), ("c", 2), ("c", 3), ("d", 1), ("d", 2)]
    got = [r["case"] for r in planning.redundant_cases(spark.createDataFrame(rows, "case string, fault int")).orderBy("round").collect()]
    assert got == ["a", "b", "d"][: len(got)] and {f for c, f in rows if c not in got} == {1, 2, 3}


def test_components_and_levels_of_cyclic_graphs(spark):
    import random

    rng = random.Random(2)
    for n, m in ((1, 0), (6, 7), (25, 30), (25, 60)):
        ids = [f"n{k:02d}" for k in range(n)]
        edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)] + [(i, i) for i in ids[:1]]
        reach = {i: {i} for i in ids}
        for _ in ids:
            for a, b in edges:
                reach[a] |= reach[b]
            for a, b in edges:
                reach[a] |= reach[b]
        used = {x for e in edges for x in e}
        comp = {i: min(j for j in reach[i] if i in reach[j]) for i in used}
        df = spark.createDataFrame(edges, "src string, dst string")
        assert {r["id"]: r["component"] for r in graph.components(df).collect()} == comp
        level: dict = {}

        def up(c):
            if c not in level:
                level[c] = 1 + max((up(comp[b]) for a, b in edges if comp[a] == c and comp[b] != c), default=-1)
            return level[c]

        assert {r["id"]: r["level"] for r in graph.levels(df).collect()} == {i: up(comp[i]) for i in used}


def test_connected_families(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("y", "z"), ("z", "w")], "a string, b string")
    assert {r["id"]: r["family"] for r in graph.connected(df).collect()} == {"a": "a", "b": "a", "c": "a", "x": "w", "y": "w", "z": "w", "w": "w"}


def test_diff_keeps_each_side_payload(spark):
    base = spark.createDataFrame([("a", "b", "calls", "semantic")], SCHEMA)
    head = spark.createDataFrame([("a", "c", "calls", "syntactic")], SCHEMA)
    got = {(r["dst"], r["tier"], r["sign"]) for r in diff.diff_rows(base, head, ["src", "dst", "type"]).collect()}
    assert got == {("c", "syntactic", "+"), ("b", "semantic", "-")}


def test_coverage_delta(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    head = spark.createDataFrame([("old", False), ("new", False), ("data", True), ("kept", False), ("fine", False)], "id string, no_code boolean")
    got = {r["id"]: r["change"] for r in diff.coverage_delta(ids("old", "kept", "fine"), head, ids("old", "kept", "fine"), ids("fine"), ids("kept")).collect()}
    assert got == {"old": "lost-guard", "new": "new-unguarded", "data": "no-code", "kept": "accepted"}
