"""Multilingual mixture inference (language identification).

Each word of a document is drawn from one of the document's languages. Its
likelihood under a language is the product of that language's probabilities of
the word's letter trigrams (word edges included). Expectation-maximisation
estimates the proportions of the languages in a document from these word
likelihoods; the language set is then selected by penalised likelihood:
starting from all languages, the least one goes while the penalised
log-likelihood doesn't fall.

Results in odd cases: a null text, or one without any letter, is ``und`` with
score 0 and an empty mixture; so is every text when nothing was learned. Equal
proportions go to the language whose name sorts first; letters are those of the
whole of Unicode. Every row gives one row,
repeated ids included; a null id is never held out and never learned from.
Columns besides ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.llm._text import BLOCK_BYTES, in_fold, read, trimmed, unit, with_text

BUCKETS = 1 << 17
#: Most documents of a language that are learned from, in expectation: the classifier's sample bound.
MAX_TRAIN_DOCS = 4000

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letters, the first trigram of each word, and the first word of each text."""
    lowered = [(t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters().take(points)
    c = np.zeros(len(points) + 2, np.uint32)
    c[1:-1] = np.where(inside, points, 0)
    at = np.flatnonzero(inside) + 1
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ c[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    buckets = (h >> np.uint32(32 - 17)).astype(np.int64)
    begins = np.flatnonzero(c[at - 1] == 0)  # trigrams at a word's first letter
    lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    text_at = np.concatenate(([0], np.cumsum(lengths)))
    first = np.searchsorted(at[begins] - 1, text_at)
    return buckets, begins, first


@dataclass
class LanguageModel:
    names: list[str]
    logp: np.ndarray  # languages x buckets, float32
    iterations: int = 8
    penalty: float = 2.0

    def word_likelihoods(self, buckets: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """languages x words, each word's best language at 1."""
        ll = np.stack([np.add.reduceat(row[buckets], begins) for row in self.logp])
        ll -= ll.max(axis=0)
        return np.exp(ll, out=ll)

    def mixtures(self, texts: list[str]) -> np.ndarray:
        """Proportions, texts x languages; a row of zeros for a text without letters."""
        out = np.zeros((len(texts), len(self.names)))
        buckets, begins, first = units(texts)
        if not len(begins) or not self.names:
            return out
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        out[full] = self.infer(self.word_likelihoods(buckets, begins), counts[full])
        return out

    def infer(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """EM and backward selection for texts of the given numbers of words."""
        kinds, n = p.shape[0], counts.astype(np.float32)
        active = np.ones((kinds, len(counts)), bool)
        pi, ll = _em(p, counts, np.full((kinds, len(counts)), 1 / kinds, np.float32), self.iterations)
        price = self.penalty + 0.5 * np.log(n)
        todo = np.arange(len(counts))
        for _ in range(kinds - 1):
            if not len(todo):
                break
            weakest = np.where(active[:, todo], pi[:, todo], 2).argmin(axis=0)
            trial = pi[:, todo].copy()
            trial[weakest, np.arange(len(todo))] = 0
            trial += np.where(active[:, todo], 1e-6, 0)
            trial[weakest, np.arange(len(todo))] = 0
            trial /= trial.sum(axis=0)
            mine = np.repeat(np.isin(np.arange(len(counts)), todo), counts)
            new, new_ll = _em(p[:, mine] if len(todo) < len(counts) else p, counts[todo], trial.astype(np.float32), 4)
            good = new_ll + price[todo] >= ll[todo]
            kept = todo[good]
            pi[:, kept], ll[kept] = new[:, good], new_ll[good]
            active[weakest[good], kept] = False
            todo = kept[active[:, kept].sum(axis=0) > 1]
        return (np.where(active, pi, 0) / np.where(active, pi, 0).sum(axis=0)).T


def _em(p: np.ndarray, counts: np.ndarray, pi: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(counts) - counts
    for step in range(iterations + 1):
        joint = np.repeat(pi, counts, axis=1)
        joint *= p
        total = joint.sum(axis=0)
        np.maximum(total, 1e-30, out=total)
        if step == iterations:
            return pi, np.add.reduceat(np.log(total), starts)
        joint /= total
        pi = np.add.reduceat(joint, starts, axis=1) / counts
    raise AssertionError


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            for part in _parts(own):
                buckets, _, _ = units(part)
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(buckets, minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > BLOCK_BYTES // 2:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(docs: DataFrame, train: Column, max_docs: int = MAX_TRAIN_DOCS) -> LanguageModel:
    """Learn trigram probabilities by language from rows that pass train and have text and lang.

    The sample is bounded: a language with more than max_docs such rows gives
    about max_docs of them, chosen by a hash of the id.
    """
    rows = docs.filter(train & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32))
    rates = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, max_docs / sizes[k])))])
    sample = rows.filter(unit("doc_id", 101) < rates[F.col("lang")]).select("lang", "text")
    grams = sample.mapInArrow(_count_grams, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts[[names.index(x) for x in grams["lang"]], grams["bucket"].to_numpy(np.int64)] = grams["n"].to_numpy()
    seen = max(1, int((counts.sum(axis=0) > 0).sum()))
    alpha = 0.2
    logp = np.log(counts + alpha) - np.log(counts.sum(axis=1, keepdims=True) + alpha * (seen + 1))
    return LanguageModel(names, logp.astype(np.float32))


def keep_dominated(docs: DataFrame, model: LanguageModel, min_share: float) -> DataFrame:
    """The rows of docs in which one learned language has at least min_share of the words, all columns as they were.

    A null text, or one without letters, has no language and goes; extra columns
    may have any names.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            best = [row for part in _parts(texts) for row in shared.value.mixtures(part).max(axis=1, initial=0)]
            yield batch.filter(pa.array([0 < b and b >= min_share for b in best], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns in keep, and lang_pred, score and mixture (``name:share`` by falling share)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, (rows_in, at) = docs.select(*keep).schema, with_text(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            rows = [m.mixtures(part) for part in _parts(texts)]
            pi = np.concatenate(rows) if rows else np.zeros((0, max(1, len(m.names))))
            found = pi.sum(axis=1) > 0 if len(m.names) else np.zeros(len(texts), bool)
            best = pi.argmax(axis=1) if len(m.names) and len(pi) else np.zeros(len(texts), int)
            pred = [m.names[b] if f else "und" for b, f in zip(best, found, strict=True)]
            score = np.clip(pi.max(axis=1), 0, 1) if len(m.names) and len(pi) else np.zeros(len(texts))
            mixed = [",".join(f"{m.names[k]}:{row[k]:.3f}" for k in np.argsort(-row, kind="stable") if row[k] > 0) if f else "" for row, f in zip(pi, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string())], [*keep, "lang_pred", "score", "mixture"])

    out = schema.add("lang_pred", "string").add("score", "double").add("mixture", "string")
    return rows_in.mapInArrow(trimmed(run), out)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", in_fold("doc_id", 4, 2).alias("held_out"))
    model = fit(docs, F.col("doc_id").isNotNull() & ~F.col("held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
