"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

Features of a text: densities of a lexicon learned from labelled rows (whole
words and word beginnings, after undoing character substitutions), how near
lexicon words stand to second-person words, capitals, punctuation, repetition
and obfuscation rates, and size. The lexicon, the trees and the calibration are
learned from disjoint parts of a bounded sample of labelled rows.

Results in odd cases: a null or empty text gets the score of a text without any
lexicon word and without words. Without labels of both classes every score is
the labels' mean (0 where there are none). Every row gives one row, repeated
ids included; repeated labels of an id count once, 1 if any is 1; labels other
than 0 and 1, null included, aren't used. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm._text import IS_LETTER, IS_SPACE, LOWER, Lookup, Spans, in_fold, look, read, segment_sum, text_blocks, trimmed, unit, with_text
from evigraph.llm._trees import Boosted, fit_boosted, fit_isotonic

#: Most labelled rows of a class, in expectation, for the lexicon and for trees with calibration.
MAX_LEXICON_DOCS, MAX_TREE_DOCS = 3000, 6000
THRESHOLD = 0.7
WHOLE, PREFIXES = 1, (4, 5, 6)

# Second-person words of English, German, French, Spanish, Italian, Portuguese and Dutch.
SECOND_PERSON = """you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos
usted ustedes tú ti tus vosotros voi tuo tua você teu sua jij je jouw""".split()
# Characters written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

_LEET = np.zeros(256, np.uint8)
for _k, _v in LOOKALIKES.items():
    _LEET[ord(_k)] = ord(_v)
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
FEATURES = ["hits", "density", "strength", "top", "whole", "begin", "near", "near_share", "capitals", "shouted", "punctuation", "marks", "obfuscated", "digits", "repeats", "size"]


def _units(buf: np.ndarray, offs: np.ndarray) -> tuple[Spans, np.ndarray]:
    """Runs of letters with substitutions undone, and where those were."""
    letter = look(IS_LETTER, buf)
    inner = np.zeros(len(buf), bool)
    if len(buf) > 2:
        inner[1:-1] = (look(_LEET, buf[1:-1]) > 0) & letter[:-2] & letter[2:]
    return Spans(np.where(inner, look(_LEET, buf), look(LOWER, buf)), letter | inner, offs), inner


def _keys(u: Spans) -> list[tuple[np.ndarray, np.ndarray]]:
    """(unit, hash) of whole units, and of the beginnings of longer ones."""
    out = [(np.arange(len(u)), u.hashes(WHOLE))]
    for k in PREFIXES:
        at = np.flatnonzero(u.ends - u.starts > k)
        out.append((at, u.hashes(10 + k, u.starts[at], u.starts[at] + k)))
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    return Spans(buf, np.ones(len(buf), bool), offs).hashes(WHOLE)


_SECOND = Lookup(_hash_words(SECOND_PERSON), np.ones(len(SECOND_PERSON)))


def features(buf: np.ndarray, offs: np.ndarray, lexicon: Lookup) -> np.ndarray:
    """The dense features of a block's documents."""
    u, inner = _units(buf, offs)
    n, docs = len(u), len(offs) - 1
    strength, whole, begin = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
    keys = _keys(u)
    for k, (at, h) in enumerate(keys):
        hit, value = lexicon.find(h)
        strength[at[hit]] = np.maximum(strength[at[hit]], value)
        (begin if k else whole)[at[hit]] = True
    second = np.zeros(n + 1)
    second[_SECOND.find(keys[0][1])[0] + 1] = 1
    second = second.cumsum()
    hits = np.flatnonzero(strength > 0)
    owner = u.owner()
    lo, hi = u.first[owner[hits]], u.first[owner[hits] + 1]
    near = np.zeros(n)
    near[hits] = second[np.minimum(hits + 7, hi)] > second[np.maximum(hits - 6, lo)]
    sums = segment_sum(np.stack([strength > 0, strength, whole, begin, near], 1).astype(float), u.first)
    top = np.zeros(docs)
    np.maximum.at(top, owner[hits], strength[hits])
    upper = (buf >= 65) & (buf <= 90)
    caps = np.concatenate(([0], upper.cumsum()))
    shouted = (caps[u.ends] - caps[u.starts] == u.ends - u.starts) & (u.ends - u.starts > 1)
    h = keys[0][1]
    same = np.zeros(n)
    if n > 1:
        same[1:] = h[1:] == h[:-1]
    more = segment_sum(np.stack([shouted, same], 1).astype(float), u.first)
    per_byte = np.stack([upper, look(IS_LETTER, buf), look(_PUNCT, buf), (buf == 33) | (buf == 63), inner, (buf >= 48) & (buf <= 57), ~look(IS_SPACE, buf)], 1)
    b = segment_sum(per_byte.astype(np.int64), np.asarray(offs))
    words, size = np.maximum(u.counts, 1), np.maximum(b[:, 6], 1)
    return np.stack(
        [np.log1p(sums[:, 0]), sums[:, 0] / words, sums[:, 1] / words, top, np.log1p(sums[:, 2]), np.log1p(sums[:, 3]), np.log1p(sums[:, 4]), sums[:, 4] / np.maximum(sums[:, 0], 1), b[:, 0] / np.maximum(b[:, 1], 1), more[:, 0] / words, b[:, 2] / size, b[:, 3] / size, b[:, 4] / words, b[:, 5] / size, more[:, 1] / words, np.log1p(u.counts)],
        axis=1,
    )


@dataclass
class ToxicityModel:
    lexicon: Lookup
    trees: Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, toxic documents, other documents), summed within the task."""
    found: list[np.ndarray] = []
    labels: list[np.ndarray] = []

    def total() -> pa.RecordBatch:
        h, y = np.concatenate(found), np.concatenate(labels)
        order = np.argsort(h)
        h, y = h[order], y[order]
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        toxic = np.add.reduceat(y, at)
        return pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(toxic), pa.array(np.diff(np.append(at, len(h))) - toxic)], ["key", "toxic", "other"])

    for batch in batches:
        y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), np.int64)
        for i, _, buf, offs in text_blocks(batch.column(0)):
            u, _ = _units(buf, offs)
            owner = u.owner()
            for at, h in _keys(u):
                order = np.lexsort((h, owner[at]))
                own, d = h[order], owner[at][order]
                once = np.concatenate(([True], (own[1:] != own[:-1]) | (d[1:] != d[:-1])))[: len(own)]
                found.append(own[once])
                labels.append(y[i + d[once]])
        if sum(map(len, found)) > 4_000_000:
            yield total()
            found, labels = [], []
    if any(map(len, found)):
        yield total()


def _featurise(lexicon) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(buf, offs, lexicon.value) for _, _, buf, offs in text_blocks(batch.column(0))]
            if rows:
                x = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), *batch.columns[1:]], ["x", *batch.schema.names[1:]])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> ToxicityModel:
    """Learn from labelled documents whose label row passes train.

    The sample is bounded: up to MAX_LEXICON_DOCS rows of each class for the
    lexicon and MAX_TREE_DOCS for trees and calibration, chosen by hashes of
    the id; its size is therefore bounded wherever it is sent.
    """
    spark = docs.sparkSession
    known = labels.filter(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicityModel(Lookup(np.zeros(0, np.uint64), np.zeros(0)), None, (np.zeros(1), np.zeros(1)), float(max(sizes, default=0)))
    share = min(0.5, MAX_LEXICON_DOCS / max(1, min(sizes.values())))

    def part(low: float, most: int, room: float) -> DataFrame:
        rate = F.when(F.col("toxic") == 1, min(room, most / sizes[1])).otherwise(min(room, most / sizes[0]))
        return F.broadcast(known.filter((F.col("__u") >= low) & (F.col("__u") < low + rate)))  # at most about 2 x most rows

    known = known.withColumn("__u", unit("doc_id", 7))
    texts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text")
    grams = texts.join(part(0.0, MAX_LEXICON_DOCS, share), "doc_id").select("text", "toxic").mapInArrow(trimmed(_count_keys), "key long, toxic long, other long")
    grams = grams.groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    rate = [min(share * sizes[k], MAX_LEXICON_DOCS) for k in (1, 0)]
    odds = F.log((F.col("a") + 0.5) / (rate[0] + 1)) - F.log((F.col("b") + 0.5) / (rate[1] + 1))
    top = grams.filter(F.col("a") >= 3).withColumn("odds", odds).filter(F.col("odds") > 3.0).select("key", "odds").orderBy("key").toPandas()  # of at most about MAX_LEXICON_DOCS texts
    lexicon = Lookup(top["key"].to_numpy(np.int64).view(np.uint64), top["odds"].to_numpy(float))
    shared = spark.sparkContext.broadcast(lexicon)
    rows = texts.join(part(share, MAX_TREE_DOCS, 1 - share), "doc_id").select("text", "toxic", F.col("__u").alias("u"))
    found = rows.mapInArrow(trimmed(_featurise(shared)), "x array<double>, toxic long, u double").toPandas()
    if found["toxic"].nunique() < 2:
        return ToxicityModel(lexicon, None, (np.zeros(1), np.zeros(1)), float(sizes[1] / sum(sizes.values())))
    found = found.sort_values("u", kind="stable")
    x, y = np.array(found["x"].tolist()), found["toxic"].to_numpy(float)
    w = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    w *= len(w) / w.sum()
    half = np.arange(len(y)) % 2 == 0
    margin = np.zeros(len(y))
    prior = float(np.average(y, weights=w))
    for own in (half, ~half):  # each half's margins come from trees that haven't seen it
        other = ~own if len(set(y[~own])) == 2 else np.ones(len(y), bool)
        margin[own] = fit_boosted(x[other], y[other], w[other]).margin(x[own])
    return ToxicityModel(lexicon, fit_boosted(x, y, w), fit_isotonic(margin, y, w, prior), prior)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that aren't predicted toxic, all columns as they were; extra columns may have any names."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [m.score(features(buf, offs, m.lexicon)) for _, _, buf, offs in text_blocks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(rows) < THRESHOLD if rows else np.zeros(0, bool)))

    return docs.mapInArrow(trimmed(run), docs.schema)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The columns in keep, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")
    rows_in, at = with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [m.score(features(buf, offs, m.lexicon)) for _, _, buf, offs in text_blocks(batch.column(at))]
            s = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    return rows_in.mapInArrow(trimmed(run), out)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", in_fold("doc_id", 3, 1).alias("held_out"))
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels, ~in_fold("doc_id", 3, 1))
    return score(docs, model, ["doc_id", "held_out"])
