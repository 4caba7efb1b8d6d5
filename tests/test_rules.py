"""Policies, scopes, grading and statistics."""

from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from evigraph.operators import grading, rules, stats

POLICY = "specificity int, file_order int, source string, pattern string, decision string, reason string"


def decide(spark, command, policy, defaults=()):
    d = spark.createDataFrame
    out = rules.resolve_policy(d([(command,)], "command string"), d(policy, POLICY), d(list(defaults), "specificity int, source string, decision string"))
    (row,) = out.collect()
    return row["decision"], row["source"]


def test_policy_order(spark):
    least_denies = [(0, 0, "floor", "git push*", "deny", ""), (2, 0, "repo", "git push*", "allow", "")]
    assert decide(spark, "git  push  x", least_denies) == ("deny", "floor")
    assert decide(spark, "ls a/b c", [(1, 0, "box", "ls *", "allow", ""), (1, 1, "box", "ls*", "escalate", "")]) == ("escalate", "box")
    assert decide(spark, "x", [(1, 0, "box", "y", "allow", "")], [(0, "floor", "deny"), (1, "box", "allow")]) == ("allow", "box")
    assert decide(spark, "x", [(1, 0, "box", "y", "allow", "")]) == ("escalate", "")
    assert decide(spark, "a.b", [(1, 0, "box", "a?b", "allow", "")])[0] == "allow"
    assert decide(spark, "axb", [(1, 0, "box", "a.b", "allow", "")])[0] == "escalate"


def test_compound_split():
    assert rules.split_segments("cd x && rm -rf y") == ["cd x", "rm -rf y"]
    assert rules.split_segments("echo 'a && b' | wc") == ["echo 'a && b'", "wc"]
    assert rules.split_segments("echo 'a && b") is None and rules.split_segments('a \\; b "x\\" ; c & d') == ['a \\; b "x\\"', "c & d"]
    assert rules.split_segments("a\\") == ["a\\"] and rules.split_segments(" ; ;") == []
    assert rules.without_assignments("A=1 B='x y' C=\"z\" run -x") == "run -x" and rules.without_assignments("a-b=1 x") == "a-b=1 x"
    assert [rules.is_neutral(x) for x in ("cd a", "A=1", "true", ":", "cdx", "A=1 ls")] == [True, True, True, True, False, False]


def test_scopes(spark):
    df = spark.createDataFrame([("a/b", "a/b/c"), ("a/b", "a/bc"), (".", "x"), ("", "x"), ("a", None)], "scope string, path string")
    assert [r[0] for r in df.select(rules.scope_matches(F.col("scope"), F.col("path"))).collect()] == [True, False, True, True, False]


EDGE = "seq long, path string, line int, t_path string, t_line int, t_kind string, tier string"
SITE = "site long, path string, line int, mode string, i_path string, i_line int, targets array<struct<path:string,line:int,name:string,external:boolean,closure:boolean,kind:string>>"


def t(path, line, name="f"):
    return (path, line, name, False, False, "")


@pytest.fixture
def key(spark):
    edges = [
        (0, "m", 1, "d", 1, "function", "semantic"), (1, "m", 2, "d", 9, "function", "semantic"), (2, "m", 3, "i", 5, "function", "semantic"), (3, "m", 4, "v", 2, "variable", "semantic"),
        (4, "x", 1, "d", 1, "function", "semantic"), (5, "m", 99, "d", 1, "function", "semantic"), (6, "m", 5, "d", 1, "function", "semantic"), (7, "m", 6, "d", 3, "function", "syntactic"),
    ]
    sites = [
        (1, "m", 1, "static", None, None, [t("d", 1)]), (2, "m", 2, "static", None, None, [t("d", 1)]), (3, "m", 3, "dynamic", "i", 5, [t("d", 1)]), (4, "m", 4, "dynamic", None, None, [t("d", 1)]),
        (5, "m", 5, "static", None, None, []), (6, "m", 6, "static", None, None, [t("d", 1)]), (7, "m", 6, "static", None, None, []),
    ]
    d = spark.createDataFrame
    return d(edges, EDGE), d(sites, SITE), d([("m",)], "path string")


def test_every_bucket(key):
    got = {r["seq"]: (r["bucket"], r["reason"]) for r in grading.grade(*key).collect()}
    assert got == {
        0: ("confirmed", ""), 1: ("contradicted", ""), 2: ("abstract", ""), 3: ("abstract", "func-value"), 4: ("silent", "not-loaded"),
        5: ("silent", "unreachable"), 6: ("silent", "no-targets"), 7: ("silent", "line-unresolved"),
    }


def test_precision_and_poison(key):
    (row,) = grading.precision(grading.grade(*key)).collect()
    assert (row["precision"], row["strict"]) == (0.5, round(1 / 3, 6))
    edges, sites, files = key
    bad = grading.poison(edges, sites)
    (check,) = grading.check_poison(grading.grade(bad, sites, files)).collect()
    assert check["passed"] and check["seeded"] == 8 and check["confirmed"] == 0


def test_poison_takes_the_first_free_target(key):
    edges, sites, _ = key
    own = [(r["t_path"], r["t_line"]) for r in edges.orderBy("seq").collect()]
    decls = list(dict.fromkeys(own))
    beside: dict = {}
    for r in sites.collect():
        s = beside.setdefault((r["path"], r["line"]), set())
        s |= {(x["path"], x["line"]) for x in r["targets"]}
        if r["i_path"]:
            s.add((r["i_path"], r["i_line"]))
    want = {}
    for r in edges.collect():
        for k in range(len(decls)):
            c = decls[(r["seq"] + 1 + k) % len(decls)]
            if c != (r["t_path"], r["t_line"]) and c not in beside.get((r["path"], r["line"]), set()):
                want[r["seq"]] = c
                break
    assert {r["seq"]: (r["t_path"], r["t_line"]) for r in grading.poison(edges, sites).collect()} == want


def test_mcnemar_and_pass_at_k(spark):
    df = spark.createDataFrame([(3, 9), (0, 0), (40, 60)], "a long, b long")
    for r in df.select("a", "b", stats.mcnemar(F.col("a"), F.col("b")).alias("p")).collect():
        n, k = r["a"] + r["b"], min(r["a"], r["b"])
        assert r["p"] == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n))
    df = spark.createDataFrame([(10, 3), (2, 1)], "n long, c long")
    got = [r[0] for r in df.select(stats.pass_at_k(F.col("n"), F.col("c"), 4)).collect()]
    assert got[0] == pytest.approx(1 - comb(7, 4) / comb(10, 4)) and got[1] is None


def test_sign_flip_is_exact():
    from itertools import product

    d = [Fraction(1, 2), Fraction(-1, 3), Fraction(2, 3), Fraction(0), Fraction(1, 6)]
    own = [x for x in d if x]
    seen = abs(sum(own))
    want = sum(abs(sum(s * x for s, x in zip(signs, own, strict=True))) >= seen for signs in product((1, -1), repeat=len(own))) / 2 ** len(own)
    assert stats.sign_flip_p(d) == pytest.approx(want, abs=1e-15)
    assert stats.sign_flip_p([]) == 1.0
    fine = [Fraction(1, 1_000_003), Fraction(-5, 999_983), Fraction(3, 7), Fraction(2, 11), Fraction(1, 5)]
    seen = abs(sum(fine))
    want = sum(abs(sum(s * x for s, x in zip(signs, fine, strict=True))) >= seen for signs in product((1, -1), repeat=5)) / 32
    assert stats.sign_flip_p(fine) == want


def test_sign_flip_on_any_grid():
    """Denominators whose common multiple is beyond 64 bits, and many differences of few sizes."""
    from itertools import product

    d = [Fraction((-1) ** k * (k + 2), p) for k, p in enumerate((10007, 10009, 10037, 10039, 10061, 10067, 10069, 10079))]
    seen = abs(sum(d))
    want = sum(abs(sum(s * x for s, x in zip(signs, d, strict=True))) >= seen for signs in product((1, -1), repeat=len(d))) / 2 ** len(d)
    assert stats.sign_flip_p(d) == pytest.approx(want, abs=1e-15)
    grown = d + [Fraction(k % 7, 3001 + 2 * k) for k in range(12)]
    assert 0 < stats.sign_flip_p(grown) <= 1
    same = [Fraction(1, 10_000_019)] * 60
    assert stats.sign_flip_p(same) == pytest.approx(2.0**-59)


def test_auc_with_ties(spark):
    rows = [(1.0, 0), (1.0, 1), (2.0, 1), (0.5, 0), (3.0, 0)]
    (auc,) = stats.rank_auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))


@pytest.fixture
def shuffled(spark):
    """Rows that collecting a DataFrame shuffles when no side is broadcast."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def total():
        none, gateway = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    def run(df):
        before = total()
        return df.collect(), sum(n for k, n in total().items() if k not in before)

    yield run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_fixtures_of_a_scope_are_not_paired_with_its_requests(spark, shuffled):
    from evigraph.operators import derived

    i = F.col("id")
    scopes = F.array(F.concat(F.lit("n"), i % 2), F.lit("far"))
    requests = spark.range(2000).select(F.concat(F.lit("c"), i).alias("src"), F.lit("x").alias("name"), scopes.alias("scopes"))
    fixtures = spark.range(600).select(F.lit("x").alias("name"), F.lit("n0").alias("scope"), F.concat(F.lit("s"), i).alias("dst")).union(spark.createDataFrame([("x", "far", "r"), ("x", "far", "r")], "name string, scope string, dst string"))
    rows, size = shuffled(derived.fixture_injections(requests, fixtures))
    assert sorted(map(tuple, rows)) == sorted((f"c{k}", "r", "x") for k in range(1, 2000, 2))
    assert size < 50_000


def test_misses_are_not_paired_with_their_line_s_shapes(spark, shuffled):
    from evigraph.operators import oracle

    i, c = F.col("id"), F.lit
    misses = spark.range(2000).select(i.alias("miss"), c("f").alias("path"), c(1).alias("line"), c("t").alias("t_path"), (i % 3).alias("t_line"), F.concat(c("q.n"), i % 5).alias("t_name"))
    shapes = spark.range(600).select(c("f").alias("path"), c(1).alias("line"), c(4).alias("col"), F.concat(c("n"), i % 3).alias("name"), F.when(i % 3 == 0, "call").when(i % 3 == 1, F.when(i % 2 == 0, "a").otherwise("b")).otherwise("call").alias("shape"), c(None).cast("string").alias("decl"), c(None).cast("string").alias("recv"))
    sites = spark.createDataFrame([("f", 1, "t", 0, 5), ("f", 1, "t", 0, 5)], "path string, line int, t_path string, t_line long, col int")
    confirmed = spark.createDataFrame([("f", 1, "t", 2, "q.n4"), ("f", 1, "t", 2, "q.n4"), ("f", 1, "t", 1, "q.n3"), ("f", 1, "t", None, "q.n0")], "path string, line int, t_path string, t_line long, t_name string")
    rows, size = shuffled(oracle.bucket_misses(misses, shapes, sites, confirmed))

    def want(k):
        at, own = k % 3 == 0, k % 5
        if own == 4 and k % 3 != 2 or own == 3 and k % 3 != 1:
            return "sibling", "sibling"
        if own in (0, 2):
            return "call", "exact" if at else "name"
        return ("ambiguous", "ambiguous") if own == 1 or at else ("no-record", "none")

    assert {r["miss"]: (r["bucket"], r["how"]) for r in rows} == {k: want(k) for k in range(2000)} and len(rows) == 2000
    assert size < 50_000


@pytest.mark.parametrize("name", ["literal_anchors", "score_anchors"])
def test_anchors_have_no_numbers_that_change_when_computed_again(spark, name):
    from evigraph.operators import templates

    symbols = spark.createDataFrame([("f", "s1", 1, 9), ("f", "s2", 3, 5)], "path string, scope string, start int, end int")
    if name == "literal_anchors":
        df = templates.literal_anchors(spark.createDataFrame([("a", "f", 4), (None, "f", 4), ("a", "f", 8), ("a", "f", 8), ("a", None, 4), ("a", "g", 1)], "literal string, path string, line int"), symbols)
        want = {("a", "f", 4, "s2"), (None, "f", 4, "s2"), ("a", "f", 8, "s1"), ("a", None, 4, None), ("a", "g", 1, None)}
    else:
        anchors = spark.createDataFrame([(1, "name", "s2"), (1, "name", "f"), (2, "literal", "s1")], "template int, matcher string, node string")
        paths = spark.createDataFrame([("s1", "f"), ("s2", "f"), ("f", "f")], "node string, path string")
        df = templates.score_anchors(anchors, paths, symbols, spark.createDataFrame([(1, "f", 4), (2, "f", 4)], "template int, path string, line int"))
        want = {("name", 2, 2, 1), ("literal", 1, 1, 0)}
    assert {tuple(r) for r in df.collect()} == want
    assert "monotonically_increasing_id" not in df._jdf.queryExecution().toString()


def test_sites_of_many_references_at_a_place(spark, monkeypatch):
    """Symbols meet a place once, however many references stand there and symbols have the same lines."""
    from evigraph.operators import gate

    met = []
    real = gate.inside_interval
    monkeypatch.setattr(gate, "inside_interval", lambda *a: met.append(real(*a)) or met[-1])
    refs = spark.range(400).selectExpr("id ref", "'a' path", "if(id % 2 = 0, 'insert', 'replace') action", "8L parent", "false whole")
    files = spark.createDataFrame([("a", True, None)], "path string, captured boolean, reason string")
    symbols = spark.range(60).selectExpr("'a' path", "'y' || id id", "5L start", "8 + id % 3 as end", "id % 2 = 0 captured", "'q' || id reason", "id place")
    lines = spark.createDataFrame([], "path string, line long, reason string")
    got = {(r["ref"] % 2, r["id"], r["captured"], r["reason"]) for r in gate.sites_of(refs, files, symbols, lines).collect()}
    assert got == {(0, "y58", True, None), (1, "y57", False, "q57")}
    assert met[0].count() <= 6


def test_sites_of_symbols_with_the_same_lines(spark):
    from evigraph.operators import gate

    refs = spark.createDataFrame([(1, "f", "replace", 4, False)], "ref int, path string, action string, parent int, whole boolean")
    files = spark.createDataFrame([("f", True, "r")], "path string, captured boolean, reason string")
    symbols = spark.createDataFrame([("f", "y10", 3, 6, False, "q10", 10), ("f", "y9", 3, 6, False, "q9", 9), ("f", "y11", 2, 6, False, "q11", 11)], "path string, id string, start int, end int, captured boolean, reason string, place int")
    lines = spark.createDataFrame([], "path string, line int, reason string")
    assert tuple(gate.sites_of(refs, files, symbols, lines).first()) == (1, "symbol", "y10", False, "q10")
    more = symbols.union(spark.createDataFrame([("f", "y7", 3, 6, True, "q7", 12)], symbols.schema))
    assert gate.sites_of(refs, files, more, lines).first()["id"] == "y7"
    assert gate.sites_of(refs, files, more.drop("place"), lines).first()["id"] == "y10"


def test_hunks_without_a_part_or_tax_count_as_in_the_sql(spark, tmp_path):
    import duckdb

    from evigraph.plans import ORACLE_SQL, QUERIES

    rows = [
        (40, 20, 15, 3, 50.0, 0.0), (41, 20, 15, 4, 50.0, 0.0),  # a body's hole of template 0, a region of template 1
        (80, None, 1, 1, 5.0, 0.0), (80, 20, 1, 1, 5.0, 0.0),  # of a hunk's rows one without a part comes last
        (81, 38, 1, 2, 5.0, 0.08), (81, 20, 1, 2, 5.0, 0.0), (81, None, 1, 2, 5.0, 0.08),
        (120, 20, 1, 1, 5.0, None), (121, 20, 1, 1, 5.0, None), (122, 20, 1, 1, 5.0, None),  # without a tax: not known to be new
        (160, None, 1, 1, 5.0, 0.08), (200, 20, 1, None, 5.0, 0.08), (None, 20, 1, 1, 5.0, 0.0), (240, 20, 1, 1, None, 0.08),
    ]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {(t, b): n for t, b, n in con.sql(ORACLE_SQL["template_coverage"]).fetchall()}
    assert want[0, "symbol"] == 2 and want[1, "region"] == 2
    assert {(r["template"], r["bucket"]): r["n"] for r in QUERIES["template_coverage"](spark, str(tmp_path)).collect()} == want
