"""Vectorised text primitives over Arrow string buffers.

Everything here works on the UTF-8 bytes of many documents at once: a block of
documents is one byte array plus document offsets, and words are found and
hashed with a handful of numpy passes, so no Python object is made per word.
Blocks are bounded by bytes (a longer document is a block of its own), which
bounds the memory of a worker whatever the Arrow batch holds.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_LETTER = np.zeros(256, bool)  # ASCII letters and every byte of a non-ASCII character
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True

_BYTE_MIX = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64, for 0..n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 4096)
        for k, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def look(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """table[buf] of a byte array; far faster than indexing by bytes."""
    if table.itemsize == 1:
        return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype)
    return table.take(buf)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Spans:
    """Runs of bytes (words, lines) of a block: starts, ends, and the first run of each document."""

    __slots__ = ("buf", "starts", "ends", "first", "counts", "_sums", "_inv")

    def __init__(self, buf: np.ndarray, inside: np.ndarray, offs: np.ndarray):
        self.buf, n = buf, len(buf)
        edge = np.zeros(n + 1, bool)  # a run never crosses a document's edge
        edge[offs] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)
        self._sums = None

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, salt: int = 0, starts=None, ends=None) -> np.ndarray:
        """A 64-bit hash of each run's bytes (or of the given byte ranges)."""
        power, inverse = _power_tables(len(self.buf) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(look(_BYTE_MIX, self.buf) * power[: len(self.buf)], out=self._sums[1:])
        starts = self.starts if starts is None else starts
        ends = self.ends if ends is None else ends
        h = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(salt)
        return mix64(h)

    def owner(self) -> np.ndarray:
        """The document of each run, counted within the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(buf: np.ndarray, offs: np.ndarray) -> Spans:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block."""
    return Spans(buf, ~look(IS_SPACE, buf), offs)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside each document and the first window of each.

    A document of fewer than k words has none.
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    return window_hash(h, at, k), begin


def window_hash(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[at + i]
    return mix64(out)


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + block_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's run of values; documents without any get 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


class Lookup:
    """A map from 64-bit hashes to numbers behind a bitmap that turns most others away."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        bits = min(24, max(18, len(keys).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[keys >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, values)"""
        if not len(self.keys):
            return np.zeros(0, np.int64), self.values[:0]
        at = np.flatnonzero(self.bits.take(h >> self.shift))
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], self.values[k[ok]]


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, concatenated."""
    ends = np.cumsum(counts, dtype=starts.dtype)
    return np.arange(ends[-1] if len(ends) else 0, dtype=starts.dtype) + np.repeat(starts - (ends - counts), counts)


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % mod


def in_fold(doc_id: str, mod: int, remainder: int) -> Column:
    """Whether the id falls into the fold; a null id doesn't."""
    return F.coalesce(fold(doc_id, mod) == remainder, F.lit(False))


def unit(doc_id: str, salt: int) -> Column:
    """A number in [0, 1) that depends on the id only."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


#: Rows of an Arrow batch for texts; with Spark's default of 10,000, batches of long texts take a worker's memory.
BATCH_ROWS = "1000"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    """A table; the session's Arrow batches are kept small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Give what numpy and Arrow have freed back to the system: a worker's next task may be of another kind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run):
    """A task's function that releases memory at its end."""

    @functools.wraps(run)
    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return to_the_end


def scratch(spark, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only where it is unset,
    as in a local test session, a folder under the warehouse stands in.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def with_text(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int]:
    """The columns in keep, and the text's place; the text follows them if it isn't among them."""
    if "text" in keep:
        return docs.select(*keep), keep.index("text")
    return docs.select(*keep, F.col("text").alias("__text")), len(keep)


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends here, and lost executors don't matter.

    With release, the shuffle files of the write are removed at its end.
    """
    path = scratch(df.sparkSession, name)
    with _released_shuffles(df.sparkSession) if release else contextlib.nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _released_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
