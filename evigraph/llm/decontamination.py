"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Test items and documents are sequences of words (runs of letters and digits,
in lower case, combining marks composed). Word pairs of an item that are rare among
all documents are its seeds: an alignment of four words or more that reaches a
threshold of 0.5 holds two adjacent words of its item unchanged (unless words are
inserted at nearly every place). A document region where seeds of an item fall on near diagonals,
or a single one does, is aligned with the item, words matching at 1, differing at
MISMATCH, skipped at GAP; the score is the best local alignment's over the item's
length, so 1 is an exact copy and edits lower it. Only regions with too few of
the item's words for the threshold aren't aligned. Pairs at or above a threshold
are leaks, unless all unchanged pairs of the copy are common ones.

A gram is common only if it is frequent among the documents and far more so than
its item's other grams, so a passage that many documents copied keeps its seeds.
Items go to the tasks in blocks of at most BLOCK_CHARS characters; a larger
benchmark takes more passes over the documents.

Results in odd cases: null or empty items and documents match nothing; items of
fewer than four words have their single words as seeds; repeated items
count by item_id, the best score of a (document row, item) pair is kept, ties
going to the earliest region. A null doc_id or item_id is kept as null. Columns
besides those named are not read, but decontaminate() returns all of its rows'.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evigraph.llm._text import IS_LETTER, LOWER, Lookup, Spans, expand, look, mix64, read, text_blocks, trimmed, window_hash

K, SLACK = 2, 8
#: A gram is common if it occurs more often than in this share of documents, and so many times the item's median.
COMMON_SHARE, LEAST_COMMON, TIMES_MEDIAN = 0.01, 16, 8.0
MISMATCH, GAP = -0.4, -0.5
THRESHOLD = 0.5
BLOCK_CHARS = 8_000_000
_REGION_WORDS = 1 << 18

_INSIDE = IS_LETTER.copy()
_INSIDE[48:58] = True
#: Lead bytes of combining marks and of the cased scripts beyond Latin-1.
_CASED = np.zeros(256, bool)
_CASED[[*range(0xC4, 0xD7), 0xE1, 0xE2, 0xEA, 0xEF, 0xF0]] = True


def _composed(column: pa.Array) -> pa.Array:
    """The texts, those with combining marks in composed form (NFC), those with capitals beyond Latin-1 in lower case."""
    found = []
    for i, _, buf, offs in text_blocks(column):
        marks = np.flatnonzero(look(_CASED, buf))
        found.append(np.unique(np.searchsorted(offs, marks, "right") - 1) + i)
    rows = np.concatenate(found) if found else np.zeros(0, np.int64)
    if not len(rows):
        return column
    mask = np.zeros(len(column), bool)
    mask[rows] = True
    own = [unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).lower()) for t in column.take(pa.array(rows)).to_pylist()]
    return pc.replace_with_mask(column, pa.array(mask), pa.array(own, column.type))


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[Spans, np.ndarray]:
    low = look(LOWER, buf).copy()
    if len(low) > 1:  # capitals of Latin-1: the second of two bytes
        low[1:] += np.where((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97), np.uint8(32), np.uint8(0))
    w = Spans(low, look(_INSIDE, buf), offs)
    return w, w.hashes()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k-1 are meaningless."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[i : len(h) - k + 1 + i]
    return mix64(out)


@dataclass
class Seeds:
    """A block of items: words of each, and where each seed gram stands in which items."""

    items: list  # item ids
    words: list[np.ndarray]
    grams: dict[int, Lookup]  # by gram length: hash to gram number
    begin: np.ndarray  # first place of each gram
    count: np.ndarray
    item: np.ndarray  # places: item number
    at: np.ndarray  # places: word number
    rare: np.ndarray  # by place
    bag: Lookup  # distinct words of each item, by bag_key, to their number
    times: np.ndarray  # how often the item has each of these

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number in the block, gram number) of all grams inside documents."""
        where, what = [], []
        for k, lookup in self.grams.items():
            pos, number = lookup.find(_grams(h, k))
            if len(pos):
                ok = pos + k <= first[np.searchsorted(first, pos, "right")]
                where.append(pos[ok])
                what.append(number[ok])
        return (np.concatenate(where), np.concatenate(what)) if where else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bag_key(word: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix64(word + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def build_seeds(ids: list, texts: list[str | None]) -> Seeds:
    column = pa.array(texts, pa.large_string())
    words: list[np.ndarray] = []
    for _, _, buf, offs in text_blocks(_composed(column)):
        w, h = _words(buf, offs)
        words += [h[w.first[d] : w.first[d + 1]] for d in range(len(offs) - 1)]
    hashes, lengths, item, at = [], [], [], []
    for n, own in enumerate(words):
        k = K if len(own) >= 4 else min(1, len(own))
        if k:
            g = window_hash(own, np.arange(len(own) - k + 1), k)
            hashes.append(g)
            lengths.append(np.full(len(g), k))
            item.append(np.full(len(g), n))
            at.append(np.arange(len(g)))
    if not hashes:
        none = np.zeros(0, np.int64)
        return Seeds(ids, words, {}, none, none, none, none, none.astype(bool), Lookup(none.astype(np.uint64), none), none)
    keys, times = np.unique(bag_key(np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])), return_counts=True)
    h, k, item_, at_ = (np.concatenate(x) for x in (hashes, lengths, item, at))
    order = np.lexsort((h, k))
    h, k, item_, at_ = h[order], k[order], item_[order], at_[order]
    begin = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]))))
    grams = {int(x): Lookup(h[begin[k[begin] == x]], np.flatnonzero(k[begin] == x)) for x in np.unique(k)}
    return Seeds(ids, words, grams, begin, np.diff(np.append(begin, len(h))), item_, at_, np.ones(len(h), bool), Lookup(keys, np.arange(len(keys))), times)


def choose_rare(seeds: Seeds, frequency: np.ndarray, docs: int) -> None:
    """Keep as seeds the grams that aren't common, by their frequency among so many documents."""
    f = np.repeat(frequency, seeds.count)
    order = np.lexsort((f, seeds.item))
    order = order[f[order] > 0]
    first = np.searchsorted(seeds.item[order], np.arange(len(seeds.words) + 1))
    n = np.diff(first)
    median = np.zeros(len(n))
    full = np.flatnonzero(n)
    median[full] = f[order][first[full] + (n[full] - 1) // 2]
    seeds.rare = (f <= max(COMMON_SHARE * docs, LEAST_COMMON)) | (f <= TIMES_MEDIAN * median[seeds.item])
    rare = np.add.reduceat(seeds.rare.astype(np.int64), seeds.begin) > 0
    for k, lookup in seeds.grams.items():
        kept = rare[lookup.values]
        seeds.grams[k] = Lookup(lookup.keys[kept], lookup.values[kept])


def align(item: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of an item with each window: (score, window word where it ends)."""
    rows, width = windows.shape
    inside = np.arange(width) < lengths[:, None]
    slope = -GAP * np.arange(width + 1)
    prev = np.zeros((rows, width + 1))
    best, end = np.zeros(rows), np.zeros(rows, np.int64)
    for word in item:
        now = np.zeros((rows, width + 1))
        np.maximum(prev[:, :-1] + np.where((windows == word) & inside, 1.0, MISMATCH), prev[:, 1:] + GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # runs of skipped window words
        now[:, 1:] *= inside
        at = now.argmax(axis=1)
        top = now[np.arange(rows), at]
        better = top > best + 1e-9
        best[better], end[better] = top[better], at[better] - 1
        prev = now
    return best, end


def most_matches(seeds: Seeds, h: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many words of its item each region h[lo:hi] has, repeats counted: no alignment scores more."""
    out = np.zeros(len(item), np.int64)
    turn = np.cumsum(hi - lo) // _REGION_WORDS
    for k in np.unique(turn):
        own = np.flatnonzero(turn == k)
        n = hi[own] - lo[own]
        region = np.repeat(own, n)
        at, word = seeds.bag.find(bag_key(h[expand(lo[own], n)], item[region]))
        pair, many = np.unique(region[at] * len(seeds.times) + word, return_counts=True)
        out += np.bincount(pair // len(seeds.times), np.minimum(many, seeds.times[pair % len(seeds.times)]), len(out)).astype(np.int64)
    return out


def find_leaks(seeds: Seeds, h: np.ndarray, first: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
    """(document, item number, score, seeds, first word, last word) of a block's leaks."""
    pos, gram = seeds.hits(h, first)
    if not len(pos):
        return []
    n = seeds.count[gram]
    place, pos = expand(seeds.begin[gram], n), np.repeat(pos, n)
    rare = seeds.rare[place]
    place, pos = place[rare], pos[rare]
    doc = np.searchsorted(first, pos, "right") - 1
    item, start = seeds.item[place], pos - seeds.at[place]
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    size = np.array([len(w) for w in seeds.words])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > SLACK + size[item[1:]] // 4)
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(doc)))
    lo = np.maximum(np.minimum.reduceat(start, begin) - SLACK, first[doc[begin]]) if len(begin) else begin
    hi = np.minimum(np.maximum.reduceat(start, begin) + size[item[begin]] * 5 // 4 + SLACK, first[doc[begin] + 1]) if len(begin) else begin
    out: dict[tuple[int, int], tuple] = {}
    regions = np.flatnonzero(most_matches(seeds, h, item[begin], lo, hi) >= threshold * size[item[begin]] - 1e-9)
    regions = regions[np.argsort(item[begin[regions]], kind="stable")]
    for k in range(0, len(regions), 64):
        part = regions[k : k + 64]
        for number in np.unique(item[begin[part]]):
            own = part[item[begin[part]] == number]
            lengths = hi[own] - lo[own]
            windows = np.zeros((len(own), int(lengths.max())), np.uint64)
            for r, x in enumerate(own):
                windows[r, : lengths[r]] = h[lo[x] : hi[x]]
            target = seeds.words[number]
            best, end = align(target, windows, lengths)
            for r in np.flatnonzero(best >= threshold * len(target) - 1e-9):
                x, d = own[r], int(doc[begin[own[r]]])
                back = windows[r : r + 1, : end[r] + 1][:, ::-1]
                _, turn = align(target[::-1], back, np.array([end[r] + 1]))
                row = (d, int(number), round(float(best[r]) / len(target), 6), int(many[x]), int(lo[x] + end[r] - turn[0] - first[d]), int(lo[x] + end[r] - first[d]))
                old = out.get((d, int(number)))
                if old is None or (-row[2], row[4]) < (-old[2], old[4]):
                    out[d, int(number)] = row
    return [out[k] for k in sorted(out)]


def _scan(column: pa.Array, seeds: Seeds, threshold: float) -> list[tuple[int, int, float, int, int, int]]:
    found = []
    for i, _, buf, offs in text_blocks(_composed(column)):
        w, h = _words(buf, offs)
        found += [(d + i, *rest) for d, *rest in find_leaks(seeds, h, w.first, threshold)]
    return found


def fit(docs: DataFrame, benchmark: DataFrame) -> list[Seeds]:
    """Seeds of each block of items, rare by their counts over all documents."""
    sizes = benchmark.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    blocks = max(1, -(-(sizes["chars"] or 0) // BLOCK_CHARS))
    out = []
    for b in range(blocks):
        own = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        seeds = build_seeds(own["item_id"].to_pylist(), own["text"].to_pylist())
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total, rows = np.zeros(len(shared.value.begin), np.int64), 0
            for batch in batches:
                rows += batch.num_rows
                for _, _, buf, offs in text_blocks(_composed(batch.column(0))):
                    w, h = _words(buf, offs)
                    total += np.bincount(shared.value.hits(h, w.first)[1], minlength=len(total))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["gram", "n"])

        frequency = np.zeros(len(seeds.begin))
        if len(frequency):
            rows = docs.select("text").mapInArrow(trimmed(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
            gram, n = rows["gram"].to_numpy(np.int64), rows["n"].to_numpy(float)
            frequency[gram[gram >= 0]] = n[gram >= 0]
            choose_rare(seeds, frequency, int(n[gram < 0].sum()))
        out.append(seeds)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per leak: doc_id, item_id, score, seeds, first_word, last_word, item_words."""
    schema = docs.select("doc_id").schema.add("item_id", benchmark.schema["item_id"].dataType)
    for name, kind in (("score", "double"), ("seeds", "long"), ("first_word", "long"), ("last_word", "long"), ("item_words", "long")):
        schema = schema.add(name, kind)
    out = None
    for seeds in fit(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            for batch in batches:
                found = _scan(batch.column(1), s, threshold)
                if found:
                    doc, item, *rest = zip(*found, strict=True)
                    ids = pa.array([s.items[x] for x in item], to_arrow_type(schema["item_id"].dataType))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), ids, *map(pa.array, rest), pa.array([len(s.words[x]) for x in item])], [f.name for f in schema])

        part = docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without any leak, all columns as they were."""
    at = docs.columns.index("text")
    for seeds in fit(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in _scan(batch.column(at), shared.value, threshold)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(trimmed(run), docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
