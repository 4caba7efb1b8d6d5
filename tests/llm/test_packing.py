"""Packing: exact round trip against the tokenizer, window rules, odd rows; and the pipeline against brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evigraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(texts, rows):
    """Pieces give back every document's ids; sequences are gapless and exactly full."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts}
    seen = {k: 0 for k in ids}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(own)
        piece = np.array(own[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: len(v) for k, v in ids.items()}
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["tier"]))
    for own in sequences.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at == own[0][2] <= 2048 and at & (at - 1) == 0


def test_round_trip(docs, awkward):
    rng = np.random.default_rng(2)
    texts = [*awkward, *(" ".join(rng.choice(["alpha,", "Beta.", "it's", "gamma!", "É.", "don't.", "x1", "…."], n)) for n in rng.integers(1, 900, 120))]
    rows = packing.pack(docs(texts).repartition(3), PATH).collect()
    check(list(enumerate(texts)), rows)


def test_ids_come_along(docs):
    (row,) = packing.pack(docs(["hello world"]).repartition(1), PATH, with_ids=True).filter("start = 0").collect()
    assert row["ids"][: row["length"]] == (Tokenizer.from_file(PATH).encode("hello world", add_special_tokens=False).ids + [1])[: row["length"]]


def test_packing_odd_tables(docs):
    assert packing.pack(docs([]), PATH).count() == 0
    rows = packing.pack(docs([(None, "a b"), (4, "a b"), (4, "a b")]), PATH).collect()
    assert sum(r["length"] for r in rows) == 9


def test_word_cache_survives_being_cleared(monkeypatch, docs):
    monkeypatch.setattr(packing, "_TABLE_WORDS", 50)
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(20)]
    coder = packing.WordIds(Tokenizer.from_file(PATH))
    import pyarrow as pa

    from evigraph.llm._text import text_blocks

    tokenizer = Tokenizer.from_file(PATH)
    for i, j, buf, offs in text_blocks(pa.array(texts), 400):
        ids, bounds = coder.encode(buf, offs)
        for d in range(i, j):
            assert ids[bounds[d - i] : bounds[d - i + 1]].tolist() == tokenizer.encode(texts[d], add_special_tokens=False).ids + [1]


def test_steps_are_balanced(docs):
    texts = [" ".join(["word"] * n) for n in range(1, 400)]
    rows = packing.pack(docs(texts).repartition(1), PATH).collect()
    steps: dict = {}
    for r in rows:
        steps[r["step_group"]] = steps.get(r["step_group"], 0) + r["length"]
    assert sum(v != packing.STEP_TOKENS for v in steps.values()) <= 1


@pytest.fixture(scope="module")
def stages(spark, small):
    """Each stage's rows, as the pipeline hands them on."""
    import corpus_pipeline as p

    from evigraph.llm._text import cut

    out, docs = [spark.read.parquet(f"{small}/documents.parquet")], None
    for name, stage in p.STAGES:
        out.append(cut(stage(spark, out[-1], small), name.replace(" ", "-")))
    return out


def test_pipeline_stages_keep_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_pipeline_filters(spark, small, stages):
    rows = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:-1]]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [i for i in rows[0] if labels.get(i) == 0]
    assert sum(i in rows[1] for i in clean) >= 0.97 * len(clean)
    assert all(any(c.isalpha() for c in t) for t in rows[2].values())
    assert sum(i in rows[2] for i in rows[1]) >= 0.95 * len(rows[1])


def test_pipeline_near_copies_and_benchmark(spark, small, stages):
    from test_matching import brute_components

    rows = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:-1]]
    brute = brute_components(list(rows[2].items()))
    assert set(rows[3]) == {i for i, (_, c) in brute.items() if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    leaking = {i for i, t in rows[3].items() if any(x in t for x in items)}
    assert not leaking & set(rows[4])
    assert len(set(rows[3]) - leaking - set(rows[4])) <= 0.01 * len(rows[3]) + 1


def test_pipeline_packs_what_is_left(stages):
    check([(r["doc_id"], r["text"]) for r in stages[4].collect()], stages[5].collect())


def test_run_is_the_stages(spark, small, stages):
    import corpus_pipeline as p

    assert p.run(spark, small).count() == stages[5].count()


def test_pipeline_stages_take_odd_rows_and_clashing_columns(spark, small, docs, awkward):
    """Columns named as the operators' own, null ids, repeated rows and an empty table."""
    import corpus_pipeline as p

    names = ("predicted", "score", "lang_pred", "mixture", "held_out", "component_id", "sid", "tokens")
    odd = docs([*((k, t) for k, t in enumerate(awkward)), (None, "same text here for you"), (None, None), (5, "same text here for you")])
    odd = odd.withColumns({c: F.lit(c) for c in names})
    for df, some in ((odd, True), (odd.limit(0), False)):
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, df, small)
            assert out.columns == odd.columns and (out.count() > 0) == some, name
        assert (p.STAGES[-1][1](spark, df, small).count() > 0) == some
    kept = [r["doc_id"] for r in p.STAGES[1][1](spark, odd, small).collect()]
    assert kept.count(None) == 1 and kept.count(5) == 2 and not set(kept) & {0, 1, 2, 3}


def test_near_copy_stage_shuffles_no_texts(spark, docs, monkeypatch):
    import random

    import corpus_pipeline as p
    from bench import totals

    monkeypatch.setattr(p, "PASS_IDS", 3)
    rng = random.Random(6)
    long = ["".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=100_000)) for _ in range(20)]
    rows = [(k, " ".join(["one two three four five"] * (k < 3) + [f"w{k // 2}x{j}" for j in range(60)] + [long[k]])) for k in range(20)] + [(None, "no id"), (0, "id again"), (99, None)]
    before, kept = totals(spark)[1], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = p.near_copy_stage(spark, docs(rows), "").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sorted((r["doc_id"] for r in got), key=str) == sorted([*range(0, 20, 2), None, 0, 99], key=str)
    assert totals(spark)[1] - before < sum(map(len, long)) / 2
