"""Joins and searches against brute force: near copies, leaks, neighbours, quotes, licences."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.llm import ann_search, decontamination, jaccard_join, licenses, quotes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def found_components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}


def edited(rng, words, rate):
    return [rng.choice(["qq", "zz", "vv", "ww"]) + str(rng.randrange(999)) if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("seed, rate", [(1, 0.01), (2, 0.02), (3, 0.04)])
def test_near_copies_in_large_groups(docs, seed, rate):
    """Groups whose members link in part only, copies, shared passages, and short texts."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(500)]
    base = [[rng.choice(vocab) for _ in range(n)] for n in (60, 61, 90, 30)]
    passage = [rng.choice(vocab) for _ in range(55)]
    texts = [" ".join(edited(rng, base[k % 4], rate)) for k in range(150)]
    texts += [" ".join(base[0])] * 5 + [" ".join([rng.choice(vocab) for _ in range(20 + k)] + passage) for k in range(40)]
    texts += [" ".join(rng.choice("abc") for _ in range(k % 8)) for k in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert found_components(docs(rows)) == brute_components(rows)


def test_families_and_blocks_are_opened(docs, monkeypatch):
    """The same with small blocks, so that many blocks, turns and cells take part."""
    for name, n in (("ALL", 3), ("LEADERS", 1), ("SMALL", 2), ("GROUP", 8), ("QUERIES", 8)):
        monkeypatch.setattr(jaccard_join, name, n)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = list(enumerate(" ".join(edited(rng, base, 0.03)) for _ in range(120)))
    assert found_components(docs(rows)) == brute_components(rows)


def test_families_opened_by_pairs(docs, monkeypatch):
    """The same by listed pairs, dealt to many small blocks."""
    for name, n in (("ALL", 3), ("LEADERS", 1), ("SMALL", 2), ("GROUP", 8), ("QUERIES", 8), ("PAIR_WORDS", 0), ("LEAST_CELL", 0), ("BLOCK_TOKENS", 300)):
        monkeypatch.setattr(jaccard_join, name, n)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(80)]
    rows = list(enumerate(" ".join(edited(rng, base, 0.03)) for _ in range(120)))
    assert found_components(docs(rows)) == brute_components(rows)


def test_candidates_in_cells_and_by_joins(docs, monkeypatch):
    """Several passes over the documents; components too large for a cell."""
    monkeypatch.setattr(jaccard_join, "WANTED", 20)
    monkeypatch.setattr(jaccard_join, "LEAST_CELL", 0)
    rng = random.Random(4)
    bases = [[f"{b}w{k}" for k in range(60)] for b in range(30)]
    rows = list(enumerate(" ".join(edited(rng, bases[min(29, k % 45)], 0.02)) for k in range(150)))
    assert found_components(docs(rows)) == brute_components(rows)


def test_texts_are_not_shuffled(spark, docs):
    """Long words make texts that are large beside their sets; no join of a large table moves them."""
    from bench import totals

    rng = random.Random(5)
    long = ["".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=100_000)) for _ in range(20)]
    base = [f"w{k}" for k in range(60)]
    rows = list(enumerate(" ".join([*base, x]) for x in long))
    before, kept = totals(spark)[1], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = found_components(docs(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert {c for _, c in got.values()} == {0}
    assert totals(spark)[1] - before < sum(map(len, long)) / 2


def test_pairs_that_share_late_tokens_of_long_lists(docs):
    """A passage's tokens come late in all of its many sets; a pair that links needs them in its count."""
    passage = " ".join(f"p{k}" for k in range(20))
    texts = [f"{passage} x y z w", f"{passage} x y q r"] + [passage + "".join(f" o{k}v{j}" for j in range(4)) for k in range(30)]
    rows = list(enumerate(texts))
    want = brute_components(rows)
    assert want[1] == (20, 0) and len({c for _, c in want.values()}) == len(rows) - 1
    assert found_components(docs(rows)) == want


def test_exactly_at_the_threshold(docs):
    a = [f"w{k}" for k in range(11)]  # 7 shingles
    rows = [(5, " ".join(a)), (9, " ".join(a[:10])), (2, " ".join(a[:9])), (7, "x y z"), (8, "X  y\tz")]
    assert found_components(docs(rows)) == brute_components(rows)


def test_near_copies_odd_rows(docs, awkward):
    rows = list(enumerate(awkward))
    assert found_components(docs(rows)) == brute_components(rows)
    assert jaccard_join.jaccard_components(docs(rows).limit(0)).count() == 0
    with_null = docs([(None, "a b c"), (3, "a b c"), (None, None), (3, "a b c")])
    assert sorted(map(str, (tuple(r) for r in jaccard_join.jaccard_components(with_null).collect()))) == sorted(map(str, [(None, 1, 3), (3, 1, 3), (None, 0, None), (3, 1, 3)]))


def test_leaks_exact_edited_and_clean(spark, docs):
    rng = random.Random(2)
    vocab = [f"v{k}" for k in range(3000)]
    items = [[rng.choice(vocab) for _ in range(30)] for _ in range(12)]
    bench = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (90, None), (91, ""), (92, "only two"), (0, " ".join(items[0]))], "item_id long, text string")
    filler = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts, want = [], set()
    for k in range(60):
        own = filler(80)
        if k % 3 == 0:
            copy = list(items[k % 12])
            if k % 2:
                for at in (4, 11, 19, 26):
                    copy[at] = "changed"
                del copy[15]
            own[40:40] = copy
            want.add((k, k % 12))
        texts.append(" ".join(own))
    texts += ["it says: Only   two, words", None, "", " ".join(items[3]) + " " + " ".join(items[4])]
    want |= {(60, 92), (63, 3), (63, 4)}
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.leaks(docs(texts), bench).collect()}
    assert set(got) == want
    assert got[0, 0]["score"] == 1.0 and (got[0, 0]["first_word"], got[0, 0]["last_word"]) == (40, 69)
    kept = {r["doc_id"] for r in decontamination.decontaminate(docs(texts), bench).collect()}
    assert kept == set(range(64)) - {d for d, _ in want}


def test_leaks_with_a_single_seed(spark, docs):
    """Copies so edited that one pair or trigram is left, at scores over and under the threshold."""
    items, texts, want = [], [], {}
    for k, (n, changed) in enumerate([(9, (2, 6)), (8, (2, 6)), (10, (1, 4, 6)), (15, (2, 5, 8, 11)), (15, (2, 4, 7, 9, 11)), (9, (0, 1, 5, 6, 7)), (8, (2, 5)), (11, (2, 5, 8)), (3, (1,)), (2, ())]):
        item = [f"i{k}w{j}" for j in range(n)]
        copy = [f"other{j}" if j in changed else w for j, w in enumerate(item)]
        items.append((k, " ".join(item)))
        texts.append(" ".join([f"a{j}" for j in range(30)] + copy + [f"b{j}" for j in range(30)]))
        score, _ = decontamination.align(*(np.array([hash(w) & (1 << 62) - 1 for w in x], np.uint64).reshape(shape) for x, shape in ((item, -1), (copy, (1, -1)))), np.array([n]))
        if score[0] >= 0.5 * n:
            want[k] = pytest.approx(score[0] / n, abs=1e-6)
    assert set(want) == {0, 1, 2, 3, 4, 6, 7, 8, 9}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(docs(texts), bench).collect()
    assert all(r["doc_id"] == r["item_id"] for r in got) and {r["doc_id"]: r["score"] for r in got} == want
    assert [r["doc_id"] for r in decontamination.decontaminate(docs(texts), bench).collect()] == [5]


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_all_pairs_alignment(spark, docs, seed):
    """Every pair of document and item at the threshold is found, and no other."""
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(300)]
    items = [[rng.choice(vocab) for _ in range(rng.randrange(2, 16))] for _ in range(25)]
    texts = []
    for _ in range(60):
        own = [rng.choice(vocab) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = [w if rng.random() > 0.2 else rng.choice(vocab) for w in rng.choice(items) if rng.random() > 0.05]
        texts.append(own)
    number = {w: np.uint64(k + 1) for k, w in enumerate(vocab)}
    want = set()
    for i, item in enumerate(items):
        for d, own in enumerate(texts):
            if own:
                best, _ = decontamination.align(np.array([number[w] for w in item]), np.array([[number[w] for w in own]]), np.array([len(own)]))
                if best[0] >= 0.5 * len(item) - 1e-9:
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs([" ".join(x) for x in texts]), bench).collect()}
    assert got == want


def test_leaks_with_null_ids_and_clashing_columns(spark, docs):
    text = "Ωμέγα Привет мир und noch ein Satz dazu"
    bench = spark.createDataFrame([(None, text.lower()), (None, None), (3, "")], "item_id long, text string").withColumn("score", F.lit(1))
    df = docs([(None, "a " + text.upper() + " b"), (4, "nothing here")]).withColumn("score", F.lit("x")).withColumn("item_id", F.lit(7))
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in decontamination.leaks(df, bench).collect()] == [(None, None, 1.0)]
    assert [r["doc_id"] for r in decontamination.decontaminate(df, bench).collect()] == [4]


def test_leaks_in_other_unicode_forms(spark, docs):
    text = "el niño pasó después del colegio más rápido según él"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    df = docs(["x y " + unicodedata.normalize("NFD", text) + " z", "plain"])
    assert [(r["doc_id"], r["score"]) for r in decontamination.leaks(df, bench).collect()] == [(0, 1.0)]


def test_leaks_in_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 40)
    bench = spark.createDataFrame([(k, " ".join(f"i{k}x{j}" for j in range(9))) for k in range(6)], "item_id long, text string")
    df = docs([" ".join(f"i{k}x{j}" for j in range(9)) for k in range(6)])
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()} == {(k, k) for k in range(6)}


def test_leaks_odd_rows(spark, docs, awkward):
    bench = spark.createDataFrame([(1, "nothing of this is there at all")], "item_id long, text string")
    assert decontamination.leaks(docs(awkward), bench).count() == 0
    assert decontamination.decontaminate(docs(awkward), bench.limit(0)).count() == len(awkward)
    assert decontamination.leaks(docs(awkward).limit(0), bench).count() == 0


def test_alignment_against_plain_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(20):
        item, window = rng.integers(1, 6, 9, dtype=np.uint64), rng.integers(1, 6, 14, dtype=np.uint64)
        h = np.zeros((len(item) + 1, len(window) + 1))
        for i, a in enumerate(item, 1):
            for j, b in enumerate(window, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if a == b else decontamination.MISMATCH), h[i - 1, j] + decontamination.GAP, h[i, j - 1] + decontamination.GAP)
        best, _ = decontamination.align(item, window[None, :], np.array([len(window)]))
        assert best[0] == pytest.approx(h.max())


def brute_nearest(rows, queries, k):
    fine = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    out = {}
    for q in queries:
        if q in fine:
            d = sorted((float(np.sqrt(((fine[q] - x) ** 2).sum())), i) for i, x in fine.items() if i != q)[:k]
            out[q] = d
    return out


@pytest.mark.parametrize("between", [None, 9, 7])
def test_components_through_rows_without_an_id_or_with_a_repeated_one(docs, between):
    """A and C are linked by B only, whatever B's id is."""
    longer = [f"w{k}" for k in range(60)]
    texts = [" ".join(longer[:50]), " ".join(longer[5:55]), " ".join(longer[10:])]
    near = [100 * len(shingle_set(texts[a]) & shingle_set(texts[b])) >= 75 * len(shingle_set(texts[a]) | shingle_set(texts[b])) for a, b in ((0, 1), (1, 2), (0, 2))]
    assert near == [True, True, False]
    df = docs([(3, texts[0]), (between, texts[1]), (7, texts[2]), (3, "other words of a repeated id here"), (None, None), (None, "alone without an id"), (7, "")])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df.withColumn("sid", F.lit("clash"))).collect()}
    assert {c for i, n, c in got if n == 46} == {3}
    assert (None, 0, None) in got and (None, 1, None) in got and (7, 0, 7) in got and (3, 3, 3) in got


@pytest.mark.parametrize("copies", [0, 700])
def test_neighbours_against_brute_force(spark, copies):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.normal(size=12)]) for k in range(1500)]
    rows += [(2000 + k, [1.0] * 12) for k in range(copies)]
    rows += [(3000, None), (3100, [0.0] * 12), (3200, [float("nan")] * 12), (3300, [None] * 12), (3400, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann_search.search(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    want = brute_nearest(rows, [i for i, _ in rows if i % 100 == 0], 10)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [got[q][k][1] for k in range(1, 11)] == [i for _, i in near]
        assert [got[q][k][0] for k in range(1, 11)] == pytest.approx([d for d, _ in near], abs=1e-12)


def test_neighbours_of_repeated_ids(spark):
    """Rows of one id are candidates each, and leave room for the others."""
    rng = np.random.default_rng(2)
    rows = [(0, [0.0, 0.0, 0.1])] + [(5, [0.1, 0.0, 0.1 + k / 1000]) for k in range(4)] + [(5, [50.0, 50.0, float(k)]) for k in range(1, 37)]
    rows += [(1000 + k, [float(x) for x in rng.normal(size=3)]) for k in range(1, 31)]
    got = ann_search.search(df := spark.createDataFrame(rows, "vec_id long, embedding array<double>"), df.filter("vec_id = 0")).orderBy("rank").collect()
    q = np.array(rows[0][1])
    want = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows[1:])[:10]
    assert [(r["score"], r["vec_id"]) for r in got] == [(pytest.approx(d, abs=1e-12), i) for d, i in want]


def test_curves_alone_reach_the_recall(spark, small):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    near = {(r["query_id"], r["vec_id"]) for r in ann_search.search(vectors, vectors.filter("vec_id % 100 = 0"), exact=False).collect()}
    full = {(r["query_id"], r["vec_id"]) for r in ann_search.search(vectors, vectors.filter("vec_id % 100 = 0")).collect()}
    assert len(near & full) >= 0.9 * len(full)


def test_neighbours_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (9, [1.0])], schema)
    rows = ann_search.search(few, few.filter("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in rows] == [(1, 1), (2, 2)]
    assert ann_search.search(few.limit(0), few).count() == 0
    assert ann_search.search(few, few.filter("vec_id = 77")).count() == 0


def test_hilbert_keys_are_a_curve():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    key = ann_search.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_quotes_are_linked_and_removed(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow do I sort a list?"), (1, 1, "assistant", "Use sorted().\n\nIt returns a new list."),
        (1, 2, "user", "Ann wrote:\n> It returns a NEW list!\nGood. And in place?"), (1, 3, "assistant", "> Good. And in place?\n>> It returns a new list.\nlist.sort() does."),
        (2, 0, "user", "> How do I sort a list?\nSee above."), (2, 1, "user", "> never said\nok"), (2, 2, "user", None), (2, 3, "user", ""), (None, 4, "user", "> Hello there."), (2, 4, "user", "> ...\nx"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash"))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 2]["text"] == "Good. And in place?" and (got[1, 2]["reply_conv"], got[1, 2]["reply_turn"]) == (1, 1)
    r = got[1, 3]
    assert (r["quotes"], r["linked"], r["reply_turn"], r["depth"], r["thread_turn"], r["text"]) == (2, 2, 2, 2, 1, "list.sort() does.")
    assert (got[2, 0]["reply_conv"], got[2, 0]["reply_turn"], got[2, 0]["depth"]) == (1, 0, 1)
    assert (got[2, 1]["quotes"], got[2, 1]["linked"], got[2, 1]["reply_turn"]) == (1, 0, None)
    assert got[2, 2]["text"] is None and got[2, 3]["text"] == "" and got[None, 4]["place"] is None and got[2, 4]["linked"] == 0
    assert [got[1, k]["place"] for k in range(4)] == [1, 2, 3, 4]
    assert quotes.link(df.limit(0)).count() == 0


def test_trimmed_quotes_are_linked(spark):
    """Two of three paragraphs, lines of a longer paragraph, a sentence of a line, part of one, and what isn't held."""
    first = "The first part is about trees.\n\nThe second part is about rivers.\n\nThe third part is about clouds."
    long = "Line one tells of apples and\nline two of pears and plums,\nline three of nuts. It works now. Also line four of figs"
    asks = [
        ("> The first part is about trees.\n>\n> The second part is about rivers.\nyes", 0), ("> The first part is about trees.\n>\n> The third part is about clouds.\nno", 0),
        ("> Line one tells of apples and\n> line two of pears and plums,\nso", 1), ("> It works now.\nfine", 1), ("> Also line four of figs\ngood", 1), ("> line two of pears\n> and plums, line three of nuts.\nwrapped", 1),
        ("> The first part is about rivers.\nno such", None), ("> The first part is about trees.\n> line two of pears and plums\nof two messages", None), ("> works\nof no sentence", None), ("> ine two of pears and plum\npart of words", None),
    ]
    rows = [(1, 0, "user", first), (1, 1, "assistant", long)] + [(1 + k % 2, 10 + k, "user", text) for k, (text, _) in enumerate(asks)]
    rows += [(3, 0, "user", long)]  # later ones don't matter
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.link(df).collect()
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert len(out) == len(rows)
    assert [got[1 + k % 2, 10 + k]["reply_turn"] for k in range(len(asks))] == [turn for _, turn in asks]
    assert all(r["reply_conv"] in (None, 1) and r["quotes"] == (r["turn"] >= 10) for r in out)
    assert (got[2, 11]["thread_conv"], got[2, 11]["thread_turn"], got[2, 11]["depth"]) == (1, 0, 1)


def test_quotes_query_keeps_every_message(spark, small):
    table = spark.read.parquet(f"{small}/conversations.parquet")
    out = quotes.op2_quote_linking(spark, small)
    assert out.count() == table.count() and out.filter("quotes > 0").count() == table.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).count()


def test_licences_and_inheritance(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a.py", "x = 1"), ("lib/LICENSE", "Licensed under the Apache License, Version 2.0."), ("lib/deep/er/b.py", "y = 2"), ("lib/c.py", "# Licensed under CC BY-NC 4.0.\nz = 3\n" + "w " * 50),
        ("lib/d.py", None), ("lib/e.py", ""), (None, "Released under the MIT License."), (None, "none"), ("lib/f.py", "the license of the public is under the version"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("dir", F.lit("clash"))
    got = {(r["path"], k): r for k, r in enumerate(licenses.inherit(licenses.scan(df, licenses.fit(df), ["path", "dir"])).orderBy("path", "declared").collect())}
    by = {p: r for (p, _), r in got.items()}
    assert by["a.py"]["license"] == "MIT" and by["a.py"]["license_from"] == ""
    assert by["lib/deep/er/b.py"]["license"] == "Apache-2.0" and by["lib/deep/er/b.py"]["license_from"] == "lib"
    assert by["lib/c.py"]["license"] == "CC-BY-NC-4.0" and by["lib/c.py"]["license_from"] == "file"
    assert by["lib/d.py"]["license"] == by["lib/e.py"]["license"] == "Apache-2.0"
    assert sorted(str(r["license"]) for (p, _), r in got.items() if p is None) == ["MIT", "None"]
    none = df.limit(0)
    assert licenses.inherit(licenses.scan(none, licenses.fit(none), ["path"])).count() == 0


def test_licence_query_against_plain_search(spark, small):
    names = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in licenses.op10_license_scan(spark, small).collect():
        lines = [names[x] for x in text[r["doc_id"]].split("\n") if x in names]
        assert r["declared"] == (lines[0] if lines else None)


@pytest.mark.parametrize("per_line", [1, 3, 6, 8, 40])
def test_wrapped_notices_in_long_files(spark, per_line):
    """A notice's licence doesn't depend on its line breaks or on what follows it."""
    wrapped = []
    for name, notice in licenses.TEMPLATES:
        w = notice.split()
        block = "\n".join("# " + " ".join(w[k : k + per_line]) for k in range(0, len(w), per_line))
        wrapped.append((name, block, block + "\n" + "\n".join(f"call_{k}(arg{k}, value{k})" for k in range(400))))
    df = spark.createDataFrame([(f"f{k}/{kind}.py", text) for k, (_, *both) in enumerate(wrapped) for kind, text in zip(("short", "long"), both, strict=True)], "path string, text string")
    got = {r["path"]: r for r in licenses.scan(df, licenses.fit(df), ["path"]).collect()}
    for k, (name, *_) in enumerate(wrapped):
        assert got[f"f{k}/short.py"]["declared"] == got[f"f{k}/long.py"]["declared"] == name
        assert got[f"f{k}/short.py"]["cosine"] == pytest.approx(1) and got[f"f{k}/long.py"]["cosine"] == pytest.approx(1)


def test_licence_cosines_against_plain_version(spark):
    """Best cosine over lines and runs of lines, with dictionaries."""
    rng = random.Random(9)
    vocab = " ".join(t for _, t in licenses.TEMPLATES).split() + [f"other{k}" for k in range(40)]
    texts = ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += ["\n".join(t.split()) for _, t in licenses.TEMPLATES[::3]]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    got = {r["path"]: r["cosine"] for r in licenses.scan(df, licenses.fit(df), ["path"]).collect()}
    word = re.compile(r"[a-z0-9]+")
    templates = [word.findall(t.lower()) for _, t in licenses.TEMPLATES]
    known = {w for t in templates for w in t}
    held = [set(word.findall(t.lower())) for t in texts]
    idf = {w: np.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1 for w in known}
    other = np.log(len(texts) + 1) + 1

    def cosine(own, template):
        a, b = {w: own.count(w) * idf[w] for w in set(own) & known}, {w: template.count(w) * idf[w] for w in set(template)}
        norm = np.sqrt(sum(x * x for x in a.values()) + sum(w not in known for w in own) * other**2) * np.sqrt(sum(x * x for x in b.values()))
        return sum(a[w] * b[w] for w in set(a) & set(b)) / norm if norm else 0.0

    for k, t in enumerate(texts):
        lines = [word.findall(x) for x in t.lower().split("\n")]
        best = 0.0
        for i in range(len(lines)):
            units = [lines[i]]
            for length in licenses.RUNS:
                run: list = []
                for own in lines[i:]:
                    run = run + own
                    if len(run) >= length:
                        break
                units.append(run)
            best = max([best, *(cosine(u, x) for u in units for x in templates)])
        assert got[str(k)] == pytest.approx(best, abs=1e-9) if best >= licenses.THRESHOLD else got[str(k)] < licenses.THRESHOLD


@pytest.mark.parametrize("few", [50_000, 0])
def test_nearest_ancestor_against_plain_walk(spark, monkeypatch, few):
    monkeypatch.setattr(licenses, "FEW_DIRS", few)
    rng = random.Random(3)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) for _ in range(60)]
    rows = [(f"{p}/LICENSE" if p else "LICENSE", rng.choice(licenses.TEMPLATES)[1]) if k % 5 == 0 else (f"{p}/x{k}.py" if p else f"x{k}.py", "code") for k, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "path string, text string")
    given: dict = {}
    for r in licenses.scan(df, licenses.fit(df), ["path"]).collect():
        if r["declared"]:
            d = r["path"].rpartition("/")[0]
            given[d] = min(given.get(d, (0, "", "")), (-r["cosine"], r["path"], r["declared"]))
    for r in licenses.inherit(licenses.scan(df, licenses.fit(df), ["path"])).collect():
        if not r["declared"]:
            d = r["path"].rpartition("/")[0]
            while d and d not in given:
                d = d.rpartition("/")[0]
            assert (r["license"], r["license_from"]) == ((given[d][2], d) if d in given else (None, None))
