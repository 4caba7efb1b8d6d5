"""Hierarchical multi-length packing of token ids into context windows.

Documents become ids; full windows of the longest tier are cut off long ones,
and what is left is routed to the smallest tier that holds it. Tiers are packed
from the longest down: a window takes an item of its own tier, then its gap is
filled from shorter tiers, cutting the last filler to fit. So every window of a
tier is exactly full; what no filler is left for at a task's end goes out in
sequences of falling powers of two. Sequences are then dealt to step groups of
equal token counts. Each task packs the rows it reads and nothing is shuffled;
sequence and step numbers carry the partition number above 2^40.

Results in odd cases: a null or empty text is the end id alone. A null id is
kept as null. Repeated ids are packed once per row. A table without rows gives
no piece. Columns besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from evigraph.llm._text import IS_LETTER, LOWER, Spans, expand, look, read, segment_sum, text_blocks, trimmed, words

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 8 * 2048
GROUP_TOKENS = 1 << 20
_TABLE_BITS, _TABLE_WORDS = 21, 1 << 20


_MARKS = np.zeros(256, bool)
_MARKS[[ord(x) for x in ".,;:!?"]] = True
_coders: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """The tokenizer of a file with its cache; tasks of a Python worker share it."""
    if path not in _coders:
        from tokenizers import Tokenizer

        _coders.clear()
        _coders[path] = WordIds(Tokenizer.from_file(path))
    return _coders[path]


class WordIds:
    """Token ids of words, cached by hash; the tokenizer sees a cached word once.

    It may be used only for tokenizers that drop white space and never join
    across it, as those of whole-word BPE with word ends do. Where the
    tokenizer ignores case, words are cached in lower case, and where it cuts
    letters from other characters, without a closing punctuation mark.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        said = tokenizer.to_str()
        self.ignores_case, self.cuts = '"Lowercase"' in said, "[^\\\\s\\\\p{L}\\\\p{N}]+" in said
        self.keys = np.zeros(1 << _TABLE_BITS, np.uint64)
        self.slots = np.zeros(1 << _TABLE_BITS, np.int32)
        kind = np.uint16 if tokenizer.get_vocab_size() <= 1 << 16 else np.int32
        self.begins, self.lengths, self.pool = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, kind)
        self.count, self.used = 0, 0

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, -1 where not cached."""
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), h & mask
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.slots[slot[hit]]
            more = ~hit & (k != 0)
            todo, slot = todo[more], (slot[more] + np.uint64(1)) & mask
        return out

    def _insert(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n, (lengths, flat) = len(h), _flatten(ids)
        while self.count + n > len(self.begins):
            self.begins, self.lengths = np.resize(self.begins, 2 * len(self.begins)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.lengths[self.count : self.count + n] = lengths
        self.begins[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        todo, slot = np.arange(n), h & mask
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            own = free[one]
            self.keys[slot[own]], self.slots[slot[own]] = h[todo[own]], self.count + todo[own]
            left = np.ones(len(todo), bool)
            left[own] = False
            todo, slot = todo[left], (slot[left] + np.uint64(1)) & mask
        self.count, self.used = self.count + n, self.used + len(flat)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's documents, each ended by END_ID, and document offsets in them."""
        if self.ignores_case and b"<|" not in buf.tobytes():  # special tokens keep their case
            buf = look(LOWER, buf)
        w = words(buf, offs)
        if self.cuts:
            w = _without_marks(w, offs)
        h = np.maximum(w.hashes(), np.uint64(1))
        number = self._probe(h)
        missed = np.flatnonzero(number < 0)
        extra = (np.zeros(0, np.int64),) * 2
        if len(missed):
            new, at = np.unique(h[missed], return_index=True)
            at = missed[at]
            raw = buf.tobytes()
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            room = max(0, min(len(new), _TABLE_WORDS - self.count, (2**31 - self.used) // 64))
            self._insert(new[:room], ids[:room])  # the first words met are mostly the frequent ones; a full cache keeps them
            number[missed] = self._probe(h[missed])
            extra = _flatten(ids[room:])
            missed = missed[number[missed] < 0]
        lengths = self.lengths.take(np.maximum(number, 0)).astype(np.int64)
        if len(missed):
            rank = np.searchsorted(new[room:], h[missed])
            lengths[missed] = extra[0][rank]
        kept = number >= 0
        if len(missed):
            flat = np.zeros(int(lengths.sum()), np.int32)
            mine = np.repeat(kept, lengths)
            flat[mine] = self.pool.take(expand(self.begins.take(number[kept]).astype(np.int64), lengths[kept]))
            flat[~mine] = extra[1].take(expand((np.cumsum(extra[0]) - extra[0])[rank], extra[0][rank]))
        else:
            flat = self.pool.take(expand(self.begins.take(number).astype(np.int64), lengths))
        counts = segment_sum(lengths, w.first) + 1
        bounds = np.concatenate(([0], np.cumsum(counts)))
        out = np.full(bounds[-1], END_ID, np.int32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts - 1)] = flat
        return out, bounds


def _flatten(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists of ids, and all ids in a row."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return lengths, np.fromiter((x for row in ids for x in row), np.int32, int(lengths.sum()))


def _without_marks(w: Spans, offs: np.ndarray) -> Spans:
    """The same runs, with one closing mark after a Latin letter as a run of its own."""
    buf, last, length = w.buf, w.ends - 1, w.ends - w.starts
    before, lead = buf[np.maximum(last - 1, 0)], buf[np.maximum(last - 2, 0)]
    ascii_letter = look(IS_LETTER, before) & (before < 128)
    latin_letter = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7) & (length > 2)
    own = look(_MARKS, buf[last]) & (length > 1) & (ascii_letter | latin_letter)
    at = np.flatnonzero(own) + 1
    w.starts, ends = np.insert(w.starts, at, last[own]), w.ends - own
    w.ends = np.insert(ends, at, w.ends[own])
    w.first = np.searchsorted(w.starts, offs)
    w.counts = np.diff(w.first)
    return w


class Packer:
    """Packs items (document number, first id, length) of one task into exactly full windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # heaps by falling length
        self.out: list[tuple[list[tuple[int, int, int]], int]] = []  # pieces of a sequence, its length

    def add(self, doc: int, length: int) -> None:
        top, start = self.tiers[-1], 0
        while length - start >= top:
            self.out.append(([(doc, start, top)], top))
            start += top
        self._route(doc, start, length - start)

    def _route(self, doc: int, start: int, length: int) -> None:
        if length:
            k = next(k for k, t in enumerate(self.tiers) if length <= t)
            heapq.heappush(self.pools[k], (-length, doc, start))

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The longest item of the tiers up to most; of the next tier up if those are empty."""
        for k in (*range(most, -1, -1), *range(most + 1, len(self.tiers))):
            if self.pools[k]:
                length, doc, start = heapq.heappop(self.pools[k])
                return doc, start, -length
        return None

    def pack(self, last: bool) -> None:
        """Fill windows while there are fillers; at the end, powers of two take the rest."""
        for k in range(len(self.tiers) - 1, -1, -1):
            while self.pools[k] and (last or sum(-x[0] for p in self.pools[: k + 1] for x in p[:64]) >= self.tiers[k]):
                doc, start, length = self._take(k)
                window, gap = [(doc, start, length)], self.tiers[k] - length
                while gap:
                    item = self._take(k - 1 if k else 0)
                    if item is None:
                        break
                    doc, start, length = item
                    used = min(gap, length)
                    window.append((doc, start, used))
                    self._route(doc, start + used, length - used)
                    gap -= used
                if gap == 0:
                    self.out.append((window, self.tiers[k]))
                elif last:
                    self._powers(window)
                else:
                    for doc, start, length in window:
                        self._route(doc, start, length)
                    return

    def _powers(self, window: list[tuple[int, int, int]]) -> None:
        left = sum(x[2] for x in window)
        while left:
            size = 1 << (left.bit_length() - 1)
            own, room = [], size
            while room:
                doc, start, length = window.pop(0)
                used = min(room, length)
                own.append((doc, start, used))
                if used < length:
                    window.insert(0, (doc, start + used, length - used))
                room -= used
            self.out.append((own, size))
            left -= size


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; with_ids adds their token ids.

    Columns: doc_id, start (ids of the document before the piece), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset (in the sequence), tier (length of the sequence) and step_group.
    """
    schema = docs.select("doc_id").schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("tier", "long"), ("step_group", "long")):
        schema = schema.add(name, kind)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = coder(tokenizer_path)
        packer, above = Packer(), TaskContext.get().partitionId() << 40
        ids: dict[int, np.ndarray] = {}
        names: dict[int, object] = {}
        left: dict[int, int] = {}
        state = {"doc": 0, "sequence": 0, "step": 0, "held": 0}
        steps: dict[int, int] = {}  # open step groups and the tokens they have room for

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for pieces, size in sorted(packer.out, key=lambda x: -x[1]):
                fits = [s for s in steps if steps[s] >= size]
                step = min(fits, key=lambda s: (steps[s], s)) if fits else state["step"]
                state["step"] += not fits
                steps[step] = steps.get(step, STEP_TOKENS) - size
                if not steps[step]:
                    del steps[step]
                offset = 0
                for doc, start, length in pieces:
                    own = ids[doc][start : start + length]
                    rows.append((names[doc], start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids[doc]), above | state["sequence"], offset, size, above | step, *([own] if with_ids else [])))
                    offset += length
                    left[doc] -= length
                    if not left[doc]:
                        del left[doc]
                        names.pop(doc)
                        state["held"] -= len(ids[doc])
                        gone.append(doc)
                state["sequence"] += 1
            packer.out.clear()
            for doc in gone:
                ids.pop(doc)
            gone.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [f.name for f in schema])

        gone: list[int] = []
        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = kinds or [batch.schema.types[0], *[pa.int64()] * 8, *([pa.list_(pa.int32())] if with_ids else [])]
            keys = batch.column(0).to_pylist()
            for i, _, buf, offs in text_blocks(batch.column(1)):
                flat, bounds = encoder.encode(buf, offs)
                for d in range(len(bounds) - 1):
                    doc = state["doc"]
                    state["doc"] += 1
                    own = flat[bounds[d] : bounds[d + 1]].copy()
                    ids[doc], names[doc], left[doc] = own, keys[i + d], len(own)
                    state["held"] += len(own)
                    packer.add(doc, len(own))
                if state["held"] > GROUP_TOKENS:
                    packer.pack(False)
                    yield from flush()
        packer.pack(True)
        yield from flush()

    return docs.select("doc_id", F.col("text")).mapInArrow(trimmed(run), schema)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
