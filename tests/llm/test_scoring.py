"""Language ID, toxicity, quality and language-model scores: held-out accuracy, exact parts, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evigraph.llm import context_mixing, cotraining, language_id, toxicity
from evigraph.llm._text import text_blocks, words

BIG = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def big(small):
    return BIG


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_words_never_cross_documents():
    texts = ["ab", "cd ef", "", "g"]
    (_, _, buf, offs), = text_blocks(pa.array(texts))
    w = words(buf, offs)
    assert w.counts.tolist() == [1, 2, 0, 1]
    (_, _, buf2, offs2), = text_blocks(pa.array(["cd", "g", "ab"]))
    assert set(words(buf2, offs2).hashes().tolist()) <= set(w.hashes().tolist())


def test_language_accuracy_on_held_out(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet")
    rows = language_id.op1_language_id(spark, big).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)


def test_language_mixture(spark, docs):
    train = docs([(k, ("der die und nicht schön " if k % 2 else "the and with which thing ") * 20) for k in range(40)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    model = language_id.fit(train, F.lit(True))
    ask = docs(["the thing with which " * 30 + "nicht schön und die " * 10, "the and thing"])
    rows = {r["doc_id"]: r for r in language_id.predict(ask, model, ["doc_id"]).collect()}
    assert rows[0]["lang_pred"] == "en" and 0.6 < rows[0]["score"] < 0.9 and "de:" in rows[0]["mixture"]
    assert rows[1]["mixture"] == "en:1.000"


def test_language_odd_rows(spark, docs, awkward):
    df = docs(awkward)
    out = {r["doc_id"]: r for r in language_id.predict(df, language_id.fit(df, F.lit(True)), ["doc_id"]).collect()}
    assert len(out) == len(awkward)
    assert all(out[k]["lang_pred"] == "und" and out[k]["score"] == 0 for k in range(4))
    assert all(out[k]["lang_pred"] == "en" for k in range(4, 10))
    none = language_id.predict(df, language_id.fit(df.limit(0), F.lit(True)), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert language_id.predict(df.limit(0), language_id.fit(df, F.lit(True)), ["doc_id"]).count() == 0


def test_toxicity_learns_and_generalises(spark, docs):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["blorgh", "snarkit"]
    texts = []
    for k in range(900):
        ws = [rng.choice(plain) for _ in range(40)]
        if k % 4 == 0:
            for _ in range(3):
                ws[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(ws))
    df = docs(texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(900)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels.filter("doc_id < 700"), F.lit(True))
    rows = toxicity.score(df.filter("doc_id >= 700"), model, ["doc_id"]).collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows) >= 0.97 * len(rows)


def test_toxicity_odd_rows(spark, docs, awkward):
    df = docs(awkward)
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 0), (6, None), (7, 3), (None, 1)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        rows = toxicity.score(df, toxicity.fit(df, given, F.lit(True)), ["doc_id"]).collect()
        assert len(rows) == len(awkward) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(df.limit(0), toxicity.fit(df, labels, F.lit(True)), df.columns).count() == 0


def test_toxicity_query(spark, big):
    rows = toxicity.op5_toxicity(spark, big).collect()
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_separates_junk(spark, docs, awkward):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["tree", "house", "river", "cloud", "stone"]) + ("%%%" if k % 3 == 0 else "") for _ in range(50)) for k in range(300)]
    df = docs(texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "farm").otherwise("site"))
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(0, 200)], "doc_id long, quality int")
    model = cotraining.fit(df, labels, F.lit(True))
    rows = cotraining.score(df.filter("doc_id >= 200"), model, ["doc_id"]).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in rows)
    odd = docs(awkward).withColumn("source", F.lit(None).cast("string"))
    assert cotraining.score(odd, model, ["doc_id"]).count() == len(awkward)
    assert cotraining.score(odd, cotraining.fit(odd, labels.limit(0), F.lit(True)), ["doc_id"]).filter("score = 0.5").count() == len(awkward)


def test_pseudo_labels_are_the_surest_of_all_rows(spark):
    """Each view hands over its surest rows of the whole table, one of each content, whatever the partitions."""
    rng = np.random.default_rng(4)
    x = [rng.normal(size=(400, 3)), rng.normal(size=(400, 2))]
    for v in x:
        v[300:] = v[:100]  # copies
    y = (x[0][:, 0] + 0.3 * x[1][:, 1] > 0).astype(float)
    trees = [cotraining.fit_boosted(v[:150], y[:150], np.ones(150)) for v in x]
    shared = spark.sparkContext.broadcast(trees)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(*x, strict=True)], "content array<double>, meta array<double>")
    want = {}
    for v in (0, 1):
        p = 1 / (1 + np.exp(-trees[v].margin(x[v])))
        for label, sure in ((1, p), (0, 1 - p)):
            own = {(x[0][k].tobytes(), x[1][k].tobytes()): float(sure[k]) for k in np.flatnonzero(sure >= cotraining.SURE)}
            want[v, label] = sorted(own.values(), reverse=True)[:20]
    for parts in (1, 5):
        rows = df.repartition(parts).mapInArrow(cotraining._surest(shared, 20), cotraining.SURE_ROWS).dropDuplicates(["view", "y", "mark"]).collect()
        for key, values in want.items():
            assert sorted((r["sure"] for r in rows if (r["view"], r["y"]) == key), reverse=True)[:20] == pytest.approx(values)


def test_quality_query(spark, big):
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = cotraining.op7_quality_cotraining(spark, big).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_prefix_code_is_complete():
    first, length, _, bit = context_mixing.prefix_code(np.array([5, 1, 1, 9, 3]))
    paths = [tuple(bit[f : f + n]) for f, n in zip(first, length, strict=True)]
    assert sum(2.0 ** -len(p) for p in paths) == 1
    assert not any(a != b and b[: len(a)] == a for a in paths for b in paths)


def test_model_is_a_distribution_over_next_words():
    """All coded words and the escape share the probability of one after the same history."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 30, dtype=np.uint64))
    code = context_mixing.make_code(keys, np.arange(1, len(keys) + 1), 2000, np.ones(256, int))
    tables = [rng.integers(0, 1 << 12, 1 << b).astype(np.uint16) for b in code.sizes]
    mixer = context_mixing.Mixer(rate=0.001)
    terms = mixer.terms(0)
    total = 0.0
    begin, length, node, bit = code.word
    for symbol in range(len(code.counts)):
        own = slice(begin[symbol], begin[symbol] + length[symbol])
        slots = [context_mixing._slots(np.full(length[symbol], 77, np.uint32), node[own], b) for b in code.word_bits]
        b = context_mixing.Bits(np.zeros(length[symbol], np.int32), bit[own], slots, 0, np.zeros(1, int))
        v, gate = mixer.states(tables, b)
        total += 2.0 ** float(np.sum(context_mixing._log2(mixer.refine(mixer.mix(v, gate, terms), gate, 0), b.bit.astype(np.float32), b.start, 0.001)))
    assert total == pytest.approx(1, abs=1e-4)


def test_mixing_query_against_brute_force(spark, big):
    rows = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r["doc_id"]: WORD.findall(lower(r["text"] or "")) + [None] for r in rows}
    counts = Counter(t for i, own in tokens.items() if not held(i, 5, 1) for t in own)
    n, v = sum(counts.values()), len(counts)
    got = context_mixing.op8_context_mixing(spark, big).collect()
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == held(r["doc_id"], 5, 1) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(counts[t] > 0 for t in own))
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel=1e-9)
        assert r["score"] < 0
    kept = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in kept) > sum(r["base_score"] for r in kept)


def plain_successors(tokens):
    """(context, (successor, state)), and misses and hits of each token under the counts of all the others."""
    seen: dict = {}
    for ctx, x in tokens:
        seen.setdefault(ctx, Counter())[x] += 1

    def best(own):
        coded = [(-n, x) for x, n in own.items() if x and n]
        return (min(coded)[1], -min(coded)[0]) if coded else (None, 0)

    hits = np.zeros((2, context_mixing.SURE), int)
    for ctx, x in tokens:
        own = Counter(seen[ctx])
        top = best(own)[0]
        own[x] -= 1
        successor, right = best(own)
        if successor:
            same = top if own[top] == right else successor  # of equal ones, the one that leads with it counted stays
            hits[int(x == same), context_mixing._pair_state(np.array([right]), np.array([own.total()]))[0]] += 1
    table = {ctx: (best(own)[0], int(context_mixing._pair_state(np.array([best(own)[1]]), np.array([own.total()]))[0])) for ctx, own in seen.items() if best(own)[0]}
    return table, hits


@pytest.mark.parametrize("seed", range(3))
def test_successors_against_plain_counts(seed):
    rng = random.Random(seed)
    tokens = [(rng.randrange(1, 30), int(rng.paretovariate(0.8)) % 9) for _ in range(400)]
    pairs = Counter(tokens)
    keys, states, hits = context_mixing._successors(np.array([c << 16 | x for c, x in pairs], np.uint64), np.array(list(pairs.values()), np.uint32))
    table, want = plain_successors(tokens)
    assert {int(k) >> 16: (int(k) & 0xFFFF, int(v)) for k, v in zip(keys, states, strict=True)} == table
    assert (hits == want).all()


def test_mixing_scores_dont_depend_on_partitions_or_neighbours(spark, docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "and", f"w{rng.randrange(300)}", f"rare{rng.randrange(10**6)}"]) for _ in range(rng.randrange(1, 3000))) for _ in range(40)] + ["word " * 50_000, "word " * 90_000]
    df = docs(texts).withColumn("held_out", F.col("doc_id") % 5 == 1)
    train = df.filter("not held_out")
    counts = context_mixing.count_tokens(train)
    model, pairs = context_mixing.fit(train, counts)
    want = {r["doc_id"]: r for r in context_mixing.score_documents(df, model, counts, pairs).collect()}
    for other in (df.repartition(7, "text"), df.orderBy(F.desc("doc_id")).coalesce(1), df.filter("doc_id in (3, 41)")):
        for r in context_mixing.score_documents(other, model, counts, pairs).collect():
            assert r["score"] == pytest.approx(want[r["doc_id"]]["score"], rel=1e-12) and r["base_score"] == pytest.approx(want[r["doc_id"]]["base_score"], rel=1e-12)
    for k, r in want.items():
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / len(texts[k].encode()))


def test_a_copy_of_a_training_text_costs_less(spark, docs):
    """What the model gathers of a text seen twice is in its score."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(200)) for _ in range(200)]
    df = docs([*texts[:150], *texts[100:]]).withColumn("held_out", F.col("doc_id") >= 150)
    train = df.filter("not held_out")
    counts = context_mixing.count_tokens(train)
    model, pairs = context_mixing.fit(train, counts)
    rows = {r["doc_id"]: r["score"] for r in context_mixing.score_documents(df, model, counts, pairs).collect() if r["held_out"]}
    copies, others = [rows[k] for k in range(150, 200)], [rows[k] for k in range(200, 250)]
    assert max(others) < min(copies)


def test_mixing_odd_rows(spark, docs, awkward):
    def given(df, counts):
        model, pairs = context_mixing.fit(df, counts)
        return model, counts, pairs

    df = docs(awkward).withColumn("held_out", F.lit(False)).withColumn("keys", F.lit("clash"))
    df = df.union(df.filter("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    counts = context_mixing.count_tokens(df)
    got = {r["doc_id"]: r for r in context_mixing.score_documents(df, *given(df, counts)).collect()}
    assert len(got) == len(awkward) + 1 and got[None]["score"] == got[5]["score"] and got[0]["n_tokens"] == got[1]["n_tokens"] == 1 and got[5]["score"] == got[6]["score"]
    none = df.limit(0)
    counts = context_mixing.count_tokens(none)
    model = given(none, counts)
    assert context_mixing.score_documents(none, *model).count() == 0
    assert all(abs(r["base_score"]) < 1e-6 for r in context_mixing.score_documents(df, *model).collect())


def test_every_two_word_context_takes_part():
    from evigraph.llm import context_mixing as cm

    raw = np.frombuffer(b"a b c d e f g h i j k l m n o p", np.uint8)
    t = cm.Tokens.of(raw, np.array([0, len(raw)]))
    at, part, keys = cm.pair_keys(t, np.zeros(len(t.h), np.int64))
    assert at.tolist() == list(range(17)) and len(part) == len(keys) == 17 and part.max() < 1 << 15


def test_questions_are_what_is_learned_from_and_stay_small(spark, docs):
    """Sent once, the tokens of a corpus serve both; a token takes some ten bytes, where it took fourteen and those of the training pass."""
    from evigraph.llm import context_mixing as cm

    rng = random.Random(9)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(400)) for _ in range(200)]
    df = docs([*texts, *texts[:40]]).withColumn("held_out", F.col("doc_id") % 5 == 1).coalesce(1)
    train = df.filter("not held_out")
    counts = cm.count_tokens(train)
    model, pairs = cm.fit(train, counts)
    once, apart = ({r["doc_id"]: r for r in cm.score_documents(df, model, counts, *given).collect()} for given in ((), (pairs,)))
    assert once == apart and len(once) == 240
    asked = df.select("doc_id", "held_out", "text").mapInArrow(cm._score(spark.sparkContext.broadcast(model)), cm.ASKED)
    size = asked.select(sum(F.sum(F.coalesce(F.octet_length(b), F.lit(0))) for b in cm.BLOBS)).first()[0]
    assert size < 12 * sum(r["n_tokens"] for r in once.values())


def test_packed_numbers_and_gathered_counts(monkeypatch):
    from evigraph.llm import context_mixing as cm

    rng = np.random.default_rng(3)
    for n, width in ((0, 8), (1, 8), (1000, 8), (1000, 2), (1000, 1)):
        x = rng.integers(0, 2 ** min(63, 8 * width), n).astype(np.uint64)
        assert (cm.unpacked(cm.packed(x, width), width) == x).all() and (cm.unpacked_rising(cm.packed_rising(np.sort(x))) == np.sort(x)).all()
    monkeypatch.setattr(cm, "_FLUSH", 50)
    keys, seen = rng.integers(0, 40, 5000).astype(np.uint64), cm.Gathered()
    for own in np.split(keys, 100):
        seen.add(own)
    got = seen.counts()
    assert sum(len(k) for k, _ in seen.held) <= 40
    assert all((a == b).all() for a, b in zip(got, np.unique(keys, return_counts=True), strict=True))


def test_pair_contexts_of_coded_words_travel_as_symbols():
    """The share finds the same contexts, in fewer bytes than the hashes took."""
    from evigraph.llm import context_mixing as cm

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(2000)}" if rng.random() < 0.9 else f"rare{rng.random()}" for _ in range(rng.randrange(900))) for _ in range(40)] + ["", "w1"]
    (_, _, raw, offs), = text_blocks(pa.array(texts), 1 << 22)
    t = cm.Tokens.of(raw, offs)
    keys, counts = np.unique(t.h, return_counts=True)
    own = counts > 1
    code = cm.make_code(keys[own], counts[own], len(t.h), np.ones(256, int))
    symbol = code.lookup(t.h)
    asked = cm.pair_keys(t, symbol)[2]
    for some in (slice(None), slice(0, 1000), slice(0, 1), slice(0, 0)):
        blobs = cm.packed_pairs(asked[some], *(x[some] for x in cm.pair_symbols(t, symbol)))
        assert (cm.unpacked_pairs(*blobs, code.hashes()) == asked[some]).all()
    assert sum(map(len, cm.packed_pairs(asked, *cm.pair_symbols(t, symbol)))) < 0.85 * len(cm.packed(asked))


def test_the_driver_makes_neither_paths_of_objects_nor_whole_tables(spark, docs):
    """What the driver holds beside the tables grows with the sample; before, a code took 180 MB in objects and its sample's counts 48 MB."""
    import tracemalloc

    from evigraph.llm import context_mixing as cm

    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(300)) for _ in range(60)]
    many = np.sort((1e6 / np.arange(1, cm.CODE_WORDS + 1)).astype(np.int64) + 1)[::-1]
    tracemalloc.start()
    cm.prefix_code(many)
    path_peak = tracemalloc.get_traced_memory()[1]
    (_, _, raw, offs), = text_blocks(pa.array(texts), 1 << 22)
    t = cm.Tokens.of(raw, offs)
    keys, counts = np.unique(t.h, return_counts=True)
    code = cm.make_code(keys, counts, len(t.h), np.ones(256, int))
    tracemalloc.reset_peak()
    sample = [(x, 1 + k % 2) for k, x in enumerate(texts[:5])]
    segments = cm.sample_counts(sample, code)
    sample_peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert path_peak < 60e6 and sample_peak < 30e6

    def dense(rows):
        tables = cm._tables(code.sizes)
        for x, n in rows:
            (_, _, raw, offs), = text_blocks(pa.array([x]), 1 << 22)
            own = cm.Tokens.of(raw, offs)
            for _ in range(n):
                cm.add_bits(tables, own, code, code.lookup(own.h))
        return tables

    rest = [(x, 1) for x in texts[5:]]
    counted = cm._count(spark.sparkContext.broadcast(code))
    shared = spark.sparkContext.broadcast(segments)
    merged = docs([x for x, _ in rest]).select("text").mapInArrow(counted, "k int, segment int, counts binary").groupBy("k", "segment").applyInArrow(cm._merge_counts(shared), cm.MERGED).toArrow()
    tables, before = cm.read_tables(merged, code, segments)
    drawn, others = dense(sample), dense(rest)
    for k in range(len(tables)):
        assert (tables[k] == cm._state(drawn[k] + others[k])).all()
        at = np.flatnonzero(drawn[k].reshape(-1, 2).sum(axis=1))
        assert (before[k][at] == cm._state(others[k])[at]).all()
