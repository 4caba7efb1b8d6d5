"""Quality by co-training of two views.

The content view sees the text (repetition, symbols, case, word and line
shapes); the metadata view sees what a page comes with (source, language, sizes
as recorded). Each view trains boosted trees on labelled rows. Then, for some
rounds, each view scores all unlabelled rows and hands those it is most sure of to
the other view: the surest of each label over the whole table, rows of one content
once, up to a bound on what the next fit takes. Both views are calibrated on labelled rows kept aside,
and their calibrated log-odds are added (less the prior's) to score every row.

Results in odd cases: null or empty texts have zero content features; null
metadata is a value of its own; a null or negative size is 0. Without labels of
both classes every score is the labels' mean (0.5 without labels). Every row
gives one row, repeated ids included; repeated labels of an id count once, 1 if
any is 1. Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evigraph.llm._text import IS_LETTER, IS_SPACE, LOWER, Spans, cut, in_fold, look, read, segment_sum, text_blocks, trimmed, unit, words
from evigraph.llm._trees import Boosted, fit_boosted, fit_isotonic

#: Most labelled rows of a class, in expectation, that are learned from, and most pseudo-labels that a view hands over in a round.
MAX_LABELLED, GIVEN = 4000, 600
#: Rounds; the share of the unlabelled rows that a view may hand over in a round, and how sure it must be.
ROUNDS, SHARE, SURE = 3, 0.05, 0.9
META_BINS = 16

_MARK = np.zeros(256, bool)
_MARK[[ord(x) for x in "#$%&*+<=>@^_`{|}~\\"]] = True


def _distinct(owner: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each document."""
    order = np.lexsort((h, owner))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[1:] != owner[:-1])
    return segment_sum(new, first)


def content_features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    w = words(look(LOWER, buf), offs)
    lines = Spans(look(LOWER, buf), buf != 10, offs)
    h, lh = w.hashes(), lines.hashes()
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    marked = look(_MARK, buf) | (buf == 33)
    upper = (buf >= 65) & (buf <= 90)
    b = segment_sum(np.stack([~look(IS_SPACE, buf), look(IS_LETTER, buf), marked, upper, (buf >= 48) & (buf <= 57), buf == 124], 1).astype(np.int64), np.asarray(offs))
    sums = np.concatenate(([0], np.cumsum(marked)))
    tail = segment_sum(((sums[w.ends] - sums[w.starts] > 0)).astype(float), w.first)
    n, size, rows = np.maximum(w.counts, 1), np.maximum(b[:, 0], 1), np.maximum(lines.counts, 1)
    return np.stack(
        [_distinct(w.owner(), h, w.first) / n, segment_sum(same, w.first) / n, _distinct(lines.owner(), lh, lines.first) / rows, b[:, 1] / size, b[:, 2] / size, tail / n, b[:, 3] / np.maximum(b[:, 1], 1), b[:, 4] / size, b[:, 5] / size, size / n, np.log1p(w.counts), w.counts / rows],
        axis=1,
    )


def _bucket(value: object, salt: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(value).encode(), salt) % META_BINS


def meta_features(columns: list[list], sizes: list) -> np.ndarray:
    """Indicators of hashed values of each column, and the recorded size."""
    out = np.zeros((len(sizes), META_BINS * len(columns) + 1))
    for k, column in enumerate(columns):
        known: dict = {}
        at = [known.setdefault(v, _bucket(v, k)) for v in column]
        out[np.arange(len(at)), META_BINS * k + np.array(at, int)] = 1
    out[:, -1] = np.log1p([max(0, x or 0) for x in sizes])
    return out


@dataclass
class View:
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), *self.knots)


@dataclass
class QualityModel:
    views: list[View]
    prior: float

    def score(self, x: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.views:
            flat = np.full(len(x[0]), self.prior)
            return [flat, flat], flat
        p = [np.clip(v.probability(own), 0.001, 0.999) for v, own in zip(self.views, x, strict=True)]
        odds = sum(np.log(q / (1 - q)) for q in p) - np.log(self.prior / (1 - self.prior))
        return p, 1 / (1 + np.exp(-odds))


def _features(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Views of a batch with columns text, source, lang and n_chars at its end."""
    rows = [content_features(buf, offs) for _, _, buf, offs in text_blocks(batch.column(batch.num_columns - 4))]
    content = np.concatenate(rows) if rows else np.zeros((0, 12))
    return [content, meta_features([batch.column(k).to_pylist() for k in (batch.num_columns - 3, batch.num_columns - 2)], batch.column(batch.num_columns - 1).to_pylist())]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [pa.array(list(v), pa.list_(pa.float64())) for v in _features(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *x], ["y", "u", "content", "meta"])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64())) for v in _features(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *x], ["doc_id", "content", "meta"])


def _surest(views, most: int):
    """Per task: of its rows, the surest of each view and label, with the features of both views; rows of one content count once.

    The surest of all rows are among the surest of every task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[bytes, tuple]] = {(v, y): {} for v in (0, 1) for y in (0, 1)}
        for batch in batches:
            x = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in batch.columns]
            mark = [xxhash.xxh3_128_digest(c.tobytes() + m.tobytes()) for c, m in zip(*x, strict=True)]
            for v in (0, 1):
                p = 1 / (1 + np.exp(-views.value[v].margin(x[v])))
                for y, sure in ((1, p), (0, 1 - p)):
                    own = held[v, y]
                    for k in np.flatnonzero(sure >= SURE):
                        own[mark[k]] = (float(sure[k]), x[0][k], x[1][k])
                    if len(own) > 4 * most:
                        held[v, y] = dict(sorted(own.items(), key=lambda kv: (-kv[1][0], kv[0]))[:most])
        rows = [(v, y, m, *r) for (v, y), own in held.items() for m, r in sorted(own.items(), key=lambda kv: (-kv[1][0], kv[0]))[:most]]
        for lo in range(0, len(rows), 500):
            part = rows[lo : lo + 500]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary()), pa.array([r[3] for r in part], pa.float64()), *(pa.array([list(r[k]) for r in part], pa.list_(pa.float64())) for k in (4, 5))], ["view", "y", "mark", "sure", "content", "meta"])

    return run


SURE_ROWS = "view int, y int, mark binary, sure double, content array<double>, meta array<double>"


def cotrain(x: list[np.ndarray], y: np.ndarray, w: np.ndarray, loose: DataFrame, total: int) -> list[Boosted]:
    """Two views' trees after ROUNDS exchanges of confident pseudo-labels over all of loose (content and meta of rows without a label)."""
    spark = loose.sparkSession
    sets = [(own, y, w) for own in x]
    trees = [fit_boosted(*s) for s in sets]
    most = min(GIVEN, max(1, int(SHARE * total)))
    used: set[bytes] = set()
    for _ in range(ROUNDS if total else 0):
        shared = spark.sparkContext.broadcast(trees)
        # at most ROUNDS x 4 x GIVEN rows have been used before, so the first of so many more hold the next ones
        rank = F.row_number().over(Window.partitionBy("view", "y").orderBy(F.desc("sure"), "mark"))
        found = loose.mapInArrow(_surest(shared, most + len(used)), SURE_ROWS).dropDuplicates(["view", "y", "mark"])
        found = found.withColumn("r", rank).filter(F.col("r") <= most + len(used)).toPandas()
        found = found[[m not in used for m in found["mark"]]].sort_values(["view", "y", "r"])
        found = found[found.groupby(["view", "y"]).cumcount() < most]
        if not len(found):
            break
        used |= set(found["mark"])
        for to in (0, 1):
            own = found[found["view"] == 1 - to]
            if len(own):
                more = np.array(own["meta" if to else "content"].tolist())
                old, ys, ws = sets[to]
                sets[to] = (np.concatenate([old, more]), np.concatenate([ys, own["y"].to_numpy(float)]), np.concatenate([ws, np.full(len(own), 0.5)]))
        trees = [fit_boosted(*s) for s in sets]
    return trees


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> QualityModel:
    """Learn from a bounded sample of labelled rows that pass train, and from all rows without a label."""
    known = labels.filter(train & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("long").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return QualityModel([], float(max(sizes)) if sizes else 0.5)
    u = unit("doc_id", 23)
    total = docs.count()
    picked = known.filter(u < F.when(F.col("y") == 1, min(1.0, MAX_LABELLED / sizes[1])).otherwise(min(1.0, MAX_LABELLED / sizes[0])))
    columns = [F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("double")]
    rows = docs.filter(F.col("doc_id").isNotNull())
    labelled = rows.join(F.broadcast(picked), "doc_id").select("y", u.alias("u"), *columns)  # at most about 2 x MAX_LABELLED rows
    found = labelled.mapInArrow(_sample, "y long, u double, content array<double>, meta array<double>").toPandas().sort_values("u", kind="stable")
    views = [np.array(found[c].tolist()) for c in ("content", "meta")]
    y = found["y"].to_numpy()
    # each text is read once: the features of the rows without a label are kept for the rounds
    features = rows.select("doc_id", *columns).mapInArrow(trimmed(_feature_rows), rows.select("doc_id").schema.add("content", ArrayType(DoubleType())).add("meta", ArrayType(DoubleType())))
    loose = cut(features.join(known.select("doc_id"), "doc_id", "left_anti").select("content", "meta"), "features")
    own = np.flatnonzero(y >= 0)
    aside = own[np.arange(len(own)) % 3 == 0]
    taught = own[np.arange(len(own)) % 3 != 0]
    if len(set(y[taught])) < 2 or len(set(y[aside])) < 2:
        taught = aside = own
    weight = {k: sizes[k] / max(1, int((y[own] == k).sum())) for k in (0, 1)}
    w = np.array([weight[k] for k in y[taught]])
    w *= len(w) / w.sum()
    trees = cotrain([v[taught] for v in views], y[taught].astype(float), w, loose, total)
    wa = np.array([weight[k] for k in y[aside]])
    prior = float(np.clip(sizes[1] / sum(sizes.values()), 0.01, 0.99))
    fitted = [View(t, fit_isotonic(t.margin(v[aside]), y[aside].astype(float), wa * len(wa) / wa.sum(), prior)) for t, v in zip(trees, views, strict=True)]
    return QualityModel(fitted, prior)


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The columns in keep, content_score, meta_score, score and predicted (1 for score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*keep).schema
    for name in ("content_score", "meta_score", "score"):
        out = out.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, total = shared.value.score(_features(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *(pa.array(v) for v in (*p, total)), pa.array((total >= 0.5).astype(np.int32))], [f.name for f in out])

    out = out.add("predicted", "integer")
    columns = [F.col("text").alias("__t"), F.col("source").cast("string").alias("__s"), F.col("lang").cast("string").alias("__l"), F.col("n_chars").cast("double").alias("__n")]
    return docs.select(*keep, *columns).mapInArrow(run, out)


def op7_quality_cotraining(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", in_fold("doc_id", 3, 1))
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return score(docs, fit(docs, labels, ~in_fold("doc_id", 3, 1)), ["doc_id", "held_out"])
