"""Packed token matrices: best-fit-decreasing bin packing of whole documents, with a segment tree over capacities.

A task packs its documents in blocks of BLOCK tokens, so that memory is bounded and no text is shuffled. Documents
longer than a sequence are split into full sequences and a rest; rests and shorter documents go, longest first, to the
open sequence with the least room that still holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.bpe import SLICE
from papyra.llm.common import id_text, int_lists, slices, texts_of
from papyra.llm.token_counts import encode_special

BLOCK = 1 << 21
PACKED = "sequence_id long, n_tokens long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


class Capacities:
    """A segment tree over 0..size: finds the least capacity of at least n that some open bin has."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.some = bytearray(2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, bin_: int) -> None:
        self.bins[capacity].append(bin_)
        k = self.width + capacity
        while k and not self.some[k]:
            self.some[k] = 1
            k >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(capacity, bin) of the fullest bin with room for n, which is taken out."""
        k = self.width + n
        if not self.some[k]:
            while k > 1 and (k & 1 or not self.some[k + 1]):  # climb to the first right neighbour that has bins
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.some[2 * k] else 2 * k + 1
        capacity = k - self.width
        bin_ = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self.some[k] = 0
            k >>= 1
            while k and not (self.some[2 * k] or self.some[2 * k + 1]):
                self.some[k] = 0
                k >>= 1
        return capacity, bin_


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item, all of at most `length`; items are taken longest first, the earliest among equals."""
    out, open_, bins = np.empty(len(sizes), np.int64), Capacities(length), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        if n == length or (found := open_.take(n)) is None:
            found, bins = (length, bins), bins + 1
        capacity, out[k] = found
        if capacity > n:
            open_.add(capacity - n, found[1])
    return out


def pack(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray, length: int, first: int) -> pa.RecordBatch:
    """The packed rows of some documents; sequences are numbered from `first`."""
    pieces = np.maximum(1, -(-counts // length))
    doc = np.repeat(np.arange(len(counts)), pieces)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
    size = np.minimum(length, counts[doc] - start)
    bin_ = best_fit(size, length)
    order = np.lexsort((np.arange(len(bin_)), bin_))
    doc, start, size, bin_ = doc[order], start[order], size[order], bin_[order]
    n = int(bin_.max()) + 1
    per_bin, filled = np.bincount(bin_, minlength=n), np.bincount(bin_, size, minlength=n).astype(np.int64)
    ends = np.cumsum(size)
    inner = np.arange(ends[-1]) - np.repeat(ends - size, size)  # position within its piece: resets at each segment
    offset = (ends - size) - np.repeat(np.cumsum(filled) - filled, per_bin)
    at = np.repeat(bin_ * length + offset, size) + inner
    begins = np.cumsum(counts) - counts
    matrix, positions = np.zeros(n * length, "<u4"), np.zeros(n * length, "<u4")
    matrix[at] = ids[np.repeat(begins[doc] + start, size) + inner]
    positions[at] = inner
    bounds = np.insert(offset + size, np.cumsum(per_bin) - per_bin, 0)
    rows = lambda x: pa.array([r.tobytes() for r in x.reshape(n, length)], pa.binary())
    columns = [pa.array(first + np.arange(n)), pa.array(filled), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_bin)), pa.int32()), doc_ids.take(pa.array(doc))), int_lists(start, per_bin, pa.int64()), int_lists(bounds, per_bin + 1, pa.int32()), rows(matrix), rows(positions)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PACKED.split(", ")])


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 1024, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per sequence: its documents, the place where each begins in its document, cumulative segment lengths from 0, and ids and position resets as rows of `length` little-endian unsigned 32-bit numbers, 0 beyond n_tokens.

    A document's ids are those of its text and end_id; every id lies in exactly one segment. A null text counts as
    empty (its end id alone); repeated rows are packed once each; an empty table gives no rows; a null doc_id is
    null in its segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            if held:
                doc_ids, *rest = zip(*held, strict=True)
                rows = pack(pa.concat_arrays(doc_ids), *map(np.concatenate, rest), length, first)
                held.clear()
                first += rows.num_rows
                yield from (rows.slice(k, 512) for k in range(0, rows.num_rows, 512))

        tokens = 0
        for batch in slices(batches, size=SLICE):
            ids, counts = encode_special(texts_of(batch.column("text")), vocabulary)
            held.append((batch.column("doc_id"), counts + 1, np.insert(ids, np.cumsum(counts), end_id)))
            tokens += len(held[-1][2])
            if tokens >= block:
                yield from packed()
                tokens = 0
        yield from packed()

    return id_text(docs, id_col, text_col).mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet."""
    packed.write.mode("overwrite").parquet(path)


def crc_of(values: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(values.astype("<u4").tobytes())


def summary(packed: DataFrame) -> DataFrame:
    """The packed rows with checksums in place of the two matrices' rows."""
    return packed.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))
