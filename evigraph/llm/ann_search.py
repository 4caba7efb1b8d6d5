"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few orthonormal directions, shifted, quantised, and
ordered along a Hilbert curve; several rotations and shifts give several
orderings. Spark range-partitions each ordering, and its rows are cut into
blocks of equal length. A query joins the blocks around its own place on every
curve, each block is reranked by true distance, and the blocks' nearest merge.

Where distances hardly differ between neighbours (high intrinsic dimension), the
windows' recall falls with the number of vectors, so an exact remainder follows:
each block of the first curve has a centre and a radius, and a query opens every
block that could hold a vector nearer than its present k-th one (at equal
distance: one of a smaller id). Blocks stay where they are; the queries come to
them in broadcast turns of at most QUERY_ROWS, and no pair of query and block is
ever a row.

Results in odd cases: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, neither as queries nor as candidates; the
same holds for a null id, and for vectors whose length differs from the most
common one (the smallest of several): they have no distance to the others. Rows
of a repeated id are separate candidates of the same id, and never candidates of
their own id's query. With fewer
candidates than k, all are returned. Equal distances go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evigraph.llm._text import cut, read, shuffle_partitions, trimmed

TOP = 10
CURVES, DIMS, BITS = 12, 8, 7
BLOCK = 256  # vectors of a block
SIDE = 2  # blocks of the window on either side of a query's own
FIT_ROWS = 4096  # most vectors, in expectation, that the projection's scale is fitted on
QUERY_TURN = 512  # most queries, in expectation, of a block's task
QUERY_ROWS = 16_384  # queries of a turn of the exact remainder, in expectation: 8 MB of 64 dimensions


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows x dims); dims * bits may be at most 62."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the excess work of the transposed Gray code
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(fine)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0))


ROW = "row long, vec_id long, v array<double>"


def _curves(sample: np.ndarray, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(directions, origin, cell width) of each curve; the sample sets the scale."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    out = []
    for _ in range(CURVES):
        basis = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, : min(DIMS, dim)]
        y = sample @ basis
        width = np.maximum((y.max(0) - y.min(0)) / ((1 << BITS) - 2), 1e-12)
        out.append((basis, y.min(0) - (0.5 + rng.random(basis.shape[1])) * width, width))
    return out


def _place(model: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column(2))
        for c, (basis, origin, width) in enumerate(model):
            cells = np.clip(np.floor((x @ basis - origin) / width), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(hilbert_key(cells, BITS)), *batch.columns], ["curve", "key", "row", "vec_id", "v"])


def ordered_blocks(vectors: DataFrame) -> DataFrame:
    """(curve, block, row, vec_id, v): every vector on every curve, cut into blocks of BLOCK along it."""
    spark = vectors.sparkSession
    total = vectors.count()
    sample = [np.array(r["v"]) for r in vectors.filter(F.pmod(F.xxhash64("row", F.lit(3)), F.lit(1 << 30)) < F.lit(int(min(1.0, FIT_ROWS / max(1, total)) * (1 << 30)))).select("v").collect()]
    sample = np.array(sample) if sample else np.array([vectors.first()["v"]])
    model = _curves(sample)
    placed = vectors.mapInArrow(lambda it: _place(model, it), f"curve int, key long, {ROW}")
    parts = shuffle_partitions(vectors)
    ranged = cut(placed.repartitionByRange(parts, "curve", "key", "vec_id", "row").withColumn("part", F.spark_partition_id()), "curves")
    # a row's place: rows of the curve in earlier parts (one row for each part and curve), and rows before it in its own
    sizes = ranged.groupBy("part", "curve").agg(F.count("*").alias("n"))
    before = sizes.select("part", "curve", (F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part", "curve").orderBy("key", "vec_id", "row"))
    placed = ranged.withColumn("own", own).join(F.broadcast(before), ["part", "curve"])
    return cut(placed.select("curve", F.floor((F.col("before") + F.col("own") - 1) / BLOCK).alias("block"), "row", "vec_id", "v"), "blocks")


def _first(near: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest, ties to the smaller id."""
    few = np.arange(len(near)) if len(near) <= 4 * k else np.flatnonzero(near <= np.partition(near, k - 1)[k - 1])
    return few[np.lexsort((ids[few], near[few]))[:k]]


def _rerank(k: int):
    def run(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy(zero_copy_only=False).astype(bool)
        ids, rows, x = table["vec_id"].to_numpy(), table["row"].to_numpy(), _matrix(table["v"].combine_chunks())
        held = np.flatnonzero(~query)
        a, b, d = [], [], []
        for at in np.flatnonzero(query) if len(held) else ():
            near = np.sqrt(((x[held] - x[at]) ** 2).sum(axis=1))
            near[ids[held] == ids[at]] = np.inf
            pick = _first(near, ids[held], k)
            pick = pick[np.isfinite(near[pick])]
            a += [ids[at]] * len(pick)
            b += held[pick].tolist()
            d += near[pick].tolist()
        return pa.table({"query_id": pa.array(a, pa.int64()), "row": pa.array(rows[b], pa.int64()), "vec_id": pa.array(ids[b], pa.int64()), "score": pa.array(d, pa.float64())})

    return run


RESULT = "query_id long, row long, vec_id long, score double"


def _visit(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Rerank: asked has (curve, block, vec_id, v) of queries; many queries of a block take several turns."""
    load = asked.groupBy("curve", "block").agg(F.ceil(F.count("*") / QUERY_TURN).cast("int").alias("turns"))
    asked = asked.join(load, ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int").alias("turn"), F.lit(None).cast("long").alias("row"), "vec_id", "v", F.lit(True).alias("query"))
    held = blocks.join(load, ["curve", "block"]).select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "row", "vec_id", "v", F.lit(False).alias("query"))
    return held.union(asked).groupBy("curve", "block", "turn").applyInArrow(_rerank(k), RESULT)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query; a row that several blocks gave counts once.

    A query has at most k rows from each of its blocks, so its group stays
    small: blocks are first merged in shares.
    """
    best = found.groupBy("query_id", "row").agg(F.min("vec_id").alias("vec_id"), F.min("score").alias("score"))

    def top(df: DataFrame, *by) -> DataFrame:
        return df.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id", "row"))), 1, k).alias("near")).select("query_id", F.explode("near").alias("near")).select("query_id", "near.row", "near.vec_id", "near.score")

    return top(top(best, "query_id", F.pmod(F.xxhash64("row"), F.lit(16))), "query_id")


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    queries holds rows (vec_id, embedding) of vectors; of a repeated id, the
    least vector is the query.

    exact=False leaves out the remainder after the windows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = cut(usable(vectors).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")
    asked = usable(queries)
    if not rows.limit(1).count() or not asked.limit(1).count():
        return spark.createDataFrame([], schema)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = ordered_blocks(rows)
    own = blocks.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("curve", "vec_id").agg(F.min(F.struct("v", "block")).alias("m")).select("curve", "m.block", "vec_id", "m.v")
    near = own.withColumn("block", F.explode(F.sequence(F.col("block") - SIDE, F.col("block") + SIDE)))
    found = cut(_merge(_visit(near, blocks, k), k), "found")
    if exact:
        found = cut(_remainder(found, own, blocks, k), "checked")
    order = F.array_sort(F.collect_list(F.struct("score", "vec_id", "row")))
    ranked = found.groupBy("query_id").agg(F.slice(order, 1, k).alias("near")).select("query_id", F.posexplode("near").alias("rank", "near"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "near.vec_id", "near.score")


def _remainder(found: DataFrame, own: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """found, improved by every run of the first curve that could hold something nearer.

    Each task passes over its vectors, a run of BLOCK at a time, in the curve's
    order; of each query's turn it keeps the k nearest rows before the bound.
    """
    spark = blocks.sparkSession
    worst = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.struct("score", "vec_id")).alias("last"))
    asked = own.filter("curve = 0").join(worst.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    asked = cut(asked.select("vec_id", "v", F.when(F.col("n") >= k, F.col("last.score")).alias("bound"), F.when(F.col("n") >= k, F.col("last.vec_id")).alias("bound_id")), "asked")
    turns = max(1, -(-asked.count() // QUERY_ROWS))
    first = blocks.filter("curve = 0").repartitionByRange(shuffle_partitions(blocks), "block").sortWithinPartitions("block").select("row", "vec_id", "v")
    out = found
    for turn in range(turns):
        held = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(turns)) == turn).toArrow().combine_chunks()  # about QUERY_ROWS rows
        if not held.num_rows:
            continue
        limit, limit_id = (held[c].to_numpy(zero_copy_only=False).astype(float) for c in ("bound", "bound_id"))
        queries = spark.sparkContext.broadcast((held["vec_id"].to_numpy(), _matrix(held["v"].combine_chunks()), np.where(np.isnan(limit), np.inf, limit), np.where(np.isnan(limit_id), np.inf, limit_id)))
        out = out.union(first.mapInArrow(_improve(queries, k), RESULT))
    return _merge(out, k)


def _improve(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q, limit, limit_id = queries.value
        q2 = (q * q).sum(axis=1)
        found: list[np.ndarray] = []  # (query, row, id, distance) tables
        pending = 0

        def emit() -> pa.RecordBatch:
            n, row, ids, d = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((ids, d, n))
            n, row, ids, d = n[order], row[order], ids[order], d[order]
            start = np.searchsorted(n, n)
            kept = np.arange(len(n)) - start < k
            return pa.RecordBatch.from_arrays([pa.array(own[n[kept]]), pa.array(row[kept]), pa.array(ids[kept]), pa.array(d[kept])], ["query_id", "row", "vec_id", "score"])

        for batch in batches:
            rows, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            for lo in range(0, len(x), BLOCK):
                part = x[lo : lo + BLOCK]
                centre = part.mean(axis=0)
                radius = np.sqrt(((part - centre) ** 2).sum(axis=1).max())
                gap = np.sqrt(np.maximum(0, q2 - 2 * (q @ centre) + centre @ centre)) - radius
                opened = np.flatnonzero(gap - 1e-6 * (1 + np.sqrt(q2)) <= limit)
                square = q2[opened][:, None] + (part * part).sum(axis=1) - 2 * (q[opened] @ part.T)
                slack = 1e-9 * (1 + q2[opened] + (part * part).sum(axis=1).max())
                a, b = np.nonzero(square <= (limit[opened] ** 2 + slack)[:, None])
                a = opened[a]
                near = np.sqrt(((part[b] - q[a]) ** 2).sum(axis=1))
                mine = ids[lo + b]
                good = (mine != own[a]) & ((near < limit[a]) | (near == limit[a]) & (mine < limit_id[a]))
                if good.any():
                    found.append((a[good], rows[lo + b[good]], mine[good], near[good]))
                    pending += int(good.sum())
                if pending > 500_000:
                    yield emit()
                    found, pending = [], 0
        if pending:
            yield emit()

    return trimmed(run)


def op6_curve_search(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
