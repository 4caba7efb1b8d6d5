"""Greedy and folded operators against plain versions: layers, walks, affixes, refreshes, packs, terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evigraph.operators import eventlog, experiments, gate, impact, packs, stats, structure


def test_edges_against_the_layers_break_every_cycle(spark):
    rng = random.Random(4)
    rows = [(f"v{v}", f"n{rng.randrange(8)}", f"n{rng.randrange(8)}", rng.randrange(1, 9)) for v in range(4) for _ in range(14)]
    rows = [r for r in {(v, a, b): (v, a, b, w) for v, a, b, w in rows}.values() if r[1] != r[2]]
    df = spark.createDataFrame(rows, "view string, src string, dst string, weight int")
    back = {tuple(r) for r in structure.against_layers(df).collect()}
    level = {(r["view"], r["id"]): r["level"] for r in structure.layers(df).collect()}
    for v, a, b, _ in rows:
        if (v, a, b) not in back:
            assert level[v, a] > level[v, b]
    total = {v: sum(w for x, *_, w in rows if x == v) for v in {r[0] for r in rows}}
    for v in total:  # never more weight backwards than forwards
        assert sum(w for x, a, b, w in rows if x == v and (x, a, b) in back) <= total[v] / 2


def test_heavier_edges_stay_in_order(spark):
    df = spark.createDataFrame([("v", "a", "b", 5), ("v", "b", "c", 5), ("v", "c", "a", 1), ("v", "c", "d", 1)], "view string, src string, dst string, weight int")
    assert [tuple(r) for r in structure.against_layers(df).collect()] == [("v", "c", "a")]
    assert {r["id"]: r["level"] for r in structure.layers(df).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0}


def test_first_visits_are_a_depth_first_walk(spark):
    rng = random.Random(9)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.randrange(30)) for _ in range(30)]
    df = spark.createDataFrame(edges, "src string, dst string, line int")
    got = {(r["entry"], r["id"]): r["place"] for r in structure.first_visits(df, spark.createDataFrame([("n0",), ("n5",), ("zz",)], "id string")).collect()}
    first: dict = {}
    for a, b, line in edges:
        first[a, b] = min(line, first.get((a, b), line))

    def walk(n, seen):
        seen.setdefault(n, len(seen))
        for _, b in sorted((line, b) for (a, b), line in first.items() if a == n):
            if b not in seen:
                walk(b, seen)
        return seen

    want = {(s, i): k for s in ("n0", "n5", "zz") for i, k in walk(s, {}).items()}
    assert got == want


def test_affix_groups_against_plain_rounds(spark):
    rng = random.Random(3)
    names = [(f"b{k % 2}", str(k), rng.choice(["load", "read", "send"]) + rng.choice(["_graph", "_tests", "_docs", "x"]) + rng.choice(["", "er"])) for k in range(40)]
    room = 6
    want = {}
    for box in ("b0", "b1"):
        left = {i: s for b, i, s in names if b == box}
        done = 0
        while len(left) + done > room:
            by: dict = {}
            for i, s in left.items():
                for k in range(4, len(s)):
                    by.setdefault(s[:k] + "*", set()).add(i)
                    by.setdefault("*" + s[-k:], set()).add(i)
            best = min(((-len(v), -len(a), a) for a, v in by.items() if len(v) >= 3), default=None)
            if best is None:
                break
            for i in by[best[2]]:
                want[box, i] = best[2]
                del left[i]
            done += 1
    df = spark.createDataFrame(names, "box string, id string, stem string")
    assert {(r["box"], r["id"]): r["affix"] for r in structure.affix_groups(df, room).collect()} == want


def test_refreshes_run_one_at_a_time(spark):
    rng = random.Random(6)
    asks = {k: sorted({rng.randrange(120) for _ in range(rng.randrange(1, 25))}) for k in range(12)}
    want = set()
    for k, ats in asks.items():
        end, waits = None, False
        for at in ats:
            while end is not None and at >= end:  # a run is over
                if waits:
                    want.add((k, end))
                    end, waits = end + 10, False
                else:
                    end = None
            if end is None:
                want.add((k, at))
                end = at + 10
            else:
                waits = True
        if waits:
            want.add((k, end))
    df = spark.createDataFrame([(k, at) for k, ats in asks.items() for at in ats], "key int, at long")
    assert {tuple(r) for r in eventlog.refreshes(df, 10).collect()} == want


def test_packs_fail_alone_but_refusals_stop(spark):
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, type string")

    def refuse(context):
        raise packs.PackRefusal("no")

    fine = packs.Pack("fine", "dynamic", lambda c: True, lambda c: c["edges"])
    broken = packs.Pack("broken", "dynamic", lambda c: 1 / 0, lambda c: c["edges"])
    rows, failed = packs.run_packs(spark, {"edges": edges}, [broken, fine])
    assert [(r["pack"], r["tier"]) for r in rows.collect()] == [("fine", "dynamic")] and [tuple(r) for r in failed.collect()] == [("broken", "ZeroDivisionError")]
    with pytest.raises(packs.PackRefusal):
        packs.run_packs(spark, {"edges": edges}, [fine, packs.Pack("stop", "dynamic", lambda c: True, refuse)])
    registry = packs.Registry([fine])
    with pytest.raises(ValueError):
        registry.register(fine)


def test_code_shaped_terms(spark):
    words = ["input", "Input", "AltAz", "altAz", "IO", "a.b", "x_y", "foo2", "Foo2Bar", "Foo2bar", "a-b", "A", "ab1C", "HTTPServer"]
    want = {w: bool(re.search("[./:_-]", w)) or (w != w.lower() and w != w.title()) for w in words}
    df = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r[0]: r[1] for r in df.select("term", impact.code_shaped(F.col("term"))).collect()} == want


def test_medians_and_quantiles_of_any_group(spark):
    import statistics

    rng = random.Random(2)
    rows = [(g, float(rng.randrange(9)) if g == "hot" else rng.random()) for g, n in (("hot", 301), ("even", 40), ("one", 1), (None, 6)) for _ in range(n)] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in stats.medians(df, "g", "v").collect()}
    assert got == {g: pytest.approx(statistics.median(v for x, v in rows if x == g and v is not None)) for g in ("hot", "even", "one", None)}
    held = sorted(v for _, v in rows if v is not None)
    cuts = {r["share"]: r["cut"] for r in stats.quantile_cuts(df, "v", [0.1, 0.5, 1.0]).collect()}
    assert cuts == {s: held[max(1, -(-int(s * 1000) * len(held) // 1000)) - 1] for s in (0.1, 0.5, 1.0)}


def test_paired_bootstrap_covers_the_mean(spark):
    rng = random.Random(1)
    rows = [(k, rng.gauss(0.5, 1.0)) for k in range(200)]
    r = stats.paired_bootstrap(spark.createDataFrame(rows, "u long, d double"), "u", "d", 800).first()
    mean = sum(d for _, d in rows) / len(rows)
    spread = (sum((d - mean) ** 2 for _, d in rows) / len(rows)) ** 0.5 / len(rows) ** 0.5
    assert r["mean"] == pytest.approx(mean) and r["n"] == 200 and r["p"] < 0.01
    assert r["low"] == pytest.approx(mean - 1.96 * spread, abs=0.5 * spread) and r["high"] == pytest.approx(mean + 1.96 * spread, abs=0.5 * spread)


def test_outcomes_and_handoffs(spark):
    c = F.col
    rows = [(False, 1, True, True, 1, 1, "invented"), (False, 0, True, True, 1, 1, "compile"), (True, 0, False, True, 1, 1, "not-installed"), (True, 0, True, False, 2, 1, "wrong"), (True, 0, True, False, 0, 1, "edge"), (True, 3, True, False, 0, 0, "pass")]
    df = spark.createDataFrame(rows, "a boolean, i int, b boolean, x boolean, k int, e int, want string")
    assert all(r[0] == r[1] for r in df.select(gate.outcome(c("a"), c("i"), c("b"), c("x"), c("k"), c("e")), "want").collect())
    mail = spark.createDataFrame([("s", 1, "handoff", "one"), ("s", 2, "note", "two"), ("t", 1, "note", "a"), ("t", 5, None, "b")], "session string, seq int, kind string, body string")
    assert {r["session"]: (r["chosen"], r["set_aside"]) for r in gate.last_handoff(mail).collect()} == {"s": ("one", 1), "t": ("b", 1)}


def test_recall_probe_counts_from_the_start(spark):
    rows = [("a b c", "a b c d", 1.0), ("a b", "x b", 0.0), ("a b c d", " a  b x d", 0.5), ("", "x", 1.0), ("a b", "a", 0.5)]
    df = spark.createDataFrame(rows, "want string, got string, share double")
    assert all(r[0] == r[1] for r in df.select(experiments.recall_probe(F.col("want"), F.col("got")), "share").collect())
