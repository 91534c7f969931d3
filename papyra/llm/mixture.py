"""Mixture-controlled packing by deficit round-robin over source queues.

Every source has a queue, its documents in table order. Each window takes from every queue the tokens that its target
proportion earns; fractions that a window can't pay are carried on as deficits. Within a cycle of ROUNDS windows all
deficits return to zero, so the tokens that a queue has given after any number of windows have a closed form: every
document finds its windows and offsets from its own place in its queue, in any partition, and deficits carry over from
partition to partition without a pass in order. When a queue runs dry, the others share its part from then on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.bpe import SLICE
from papyra.llm.common import int_lists, slices, texts_of, written
from papyra.llm.token_counts import encode_special

#: Windows of a cycle: proportions are kept to 1 / (1024 * ROUNDS).
ROUNDS = 64
END_ID = 0
QUEUED = "doc_id long, source string, part long, before long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, {}, doc_tokens long, sequence_id long, offset long, source string"


class Phase(NamedTuple):
    """Windows in which the same queues serve. base: tokens that each queue has given before; quota: those that it gives in a cycle of `rounds` windows."""

    first: int
    base: np.ndarray
    quota: np.ndarray
    rounds: int


def shares(weights: np.ndarray, total: int) -> np.ndarray:
    """Whole parts of `total` in proportion to the weights, by largest remainder (the first among equals)."""
    exact = weights / weights.sum() * total
    out = np.floor(exact).astype(np.int64)
    out[np.argsort(-(exact - out), kind="stable")[: total - int(out.sum())]] += 1
    return out


def cycle(quota: np.ndarray, window: int, rounds: int) -> np.ndarray:
    """Tokens that each queue has given after 0, 1, ... rounds windows; quota: tokens of each queue in all of them."""
    deficit, given = np.zeros(len(quota), np.int64), [np.zeros(len(quota), np.int64)]
    for _ in range(rounds):
        deficit += quota  # in units of 1 / rounds tokens
        take = np.maximum(deficit // rounds, 0)
        order = np.argsort(-(deficit - take * rounds), kind="stable")
        take[order[: window - int(take.sum())]] += 1
        deficit -= take * rounds
        given.append(given[-1] + take)
    return np.array(given)


def schedule(totals: np.ndarray, weights: np.ndarray, window: int, rounds: int = ROUNDS) -> list[Phase]:
    """Phases that empty all queues; every window but the last is full."""
    left, base, first, phases = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []
    while left.sum():
        open_ = left > 0
        w = np.where(open_, weights, 0.0)
        if not w.sum():
            w = open_.astype(float)
        quota = shares(w, window * rounds)
        given = cycle(quota, window, rounds)
        # windows until each queue has too little for the next one
        serves = quota > 0
        cycles, rest = np.divmod(left[serves], quota[serves])
        full = int((cycles * rounds + (given[:, serves] <= rest).sum(0) - 1).min())
        if full:
            phases.append(Phase(first, base, quota, rounds))
            served = full // rounds * quota + given[full % rounds]
            first, base, left = first + full, base + served, left - served
        if left.sum():  # a window for which some queue has too little
            take = np.minimum(left, given[full % rounds + 1] - given[full % rounds])
            while (short := min(window, int(left.sum())) - int(take.sum())) > 0:
                spare = left - take
                extra = np.where(spare > 0, w, 0.0)
                take += np.minimum(spare, shares(extra if extra.sum() else (spare > 0).astype(float), short))
            phases.append(Phase(first, base, take, 1))
            first, base, left = first + 1, base + take, left - take
    return phases


class Schedule:
    """Where the tokens of each queue go. A phase's cycle is worked out where a document lies in it, so what is sent has two numbers for each phase and queue."""

    def __init__(self, phases: list[Phase], window: int):
        self.phases, self.window = phases, window
        self.first = np.array([p.first for p in phases])
        self.base = np.array([p.base for p in phases])
        self.cycle = lru_cache(64)(self._cycle)

    def _cycle(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens each queue has given after each window of the cycle, tokens of earlier queues in each window)."""
        _, _, quota, rounds = self.phases[p]
        given = cycle(quota, self.window, rounds) if rounds > 1 else np.array([np.zeros_like(quota), quota])
        took = np.diff(given, axis=0)
        return given, np.cumsum(took, axis=1) - took

    def window_of(self, s: int, x: np.ndarray) -> np.ndarray:
        """The window that takes token x of queue s."""
        phase = np.searchsorted(self.base[:, s], x, "right") - 1
        out = np.empty(len(x), np.int64)
        for p in np.unique(phase).tolist():
            at, (first, base, quota, rounds), (given, _) = phase == p, self.phases[p], self.cycle(p)
            cycles, rest = np.divmod(x[at] - base[s], quota[s])
            out[at] = first + cycles * rounds + np.searchsorted(given[:, s], rest, "right") - 1
        return out

    def spans(self, s: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of queue s in each window, first and one past the last, and the offset of the first there."""
        phase = np.searchsorted(self.first, w, "right") - 1
        out = np.empty((3, len(w)), np.int64)
        for p in np.unique(phase).tolist():
            at, (first, base, quota, rounds), (given, ahead) = phase == p, self.phases[p], self.cycle(p)
            cycles, r = np.divmod(w[at] - first, rounds)
            start = base[s] + cycles * quota[s]
            out[:, at] = start + given[r, s], start + given[r + 1, s], ahead[r, s]
        return out[0], out[1], out[2]

    def cut(self, s: int, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, start, length, window, offset) of each piece of documents that lie at `begin` in queue s."""
        low, high = self.window_of(s, begin), self.window_of(s, begin + size - 1)
        doc = np.repeat(np.arange(len(begin)), high - low + 1)
        w = np.arange(len(doc)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[doc]
        a, b, at = self.spans(s, w)
        x, y = np.maximum(a, begin[doc]), np.minimum(b, (begin + size)[doc])
        some = y > x
        doc, x, y, w, a, at = (v[some] for v in (doc, x, y, w, a, at))
        return doc, x - begin[doc], y - x, w, at + x - a


def queued(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every document's ids with an end id, and its place among the tokens of its source in its partition. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in slices(batches, size=SLICE):
            ids, counts = encode_special(texts_of(batch.column("text")), vocabulary)
            ends = np.cumsum(counts)
            data = np.insert(ids, ends, END_ID).astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4")
            wide = data.dtype.itemsize
            cuts = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32) * wide
            sources, before = batch.column("source").to_pylist(), []
            for source, n in zip(sources, (counts + 1).tolist(), strict=True):
                before.append(seen.get(source, 0))
                seen[source] = before[-1] + n
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array([part] * len(counts), pa.int64()), pa.array(before, pa.int64()), pa.array(counts + 1, pa.int64()), raw], [x.split()[0] for x in QUEUED.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, QUEUED), "queued")


def pack_mixture(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", window: int = 1024, target: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", checksums: bool = False) -> DataFrame:
    """doc_id, start, length, ids array<int>, doc_tokens, sequence_id, offset, source of each piece of each document.

    A document's ids are those of its whole text and an end id; every id lies in exactly one piece, and every sequence
    but the last is full. target: the tokens that each source is to have of every window, as weights; a source that it
    doesn't name gets weight 0 and fills in when the others have run dry. Without a target the sources' own token
    totals are the weights, so that all run dry together. A null text counts as empty, a null source as ''. Repeated
    rows are packed once each. An empty table gives no rows. The driver gets one total for each source; the number of
    sources is a property of the mixture and doesn't grow with the documents. checksums: ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers) takes the place of ids.
    """
    rows = queued(docs, vocabulary, id_col, text_col, source_col)
    sums = written(rows.groupBy("part", "source").agg(F.sum("doc_tokens").alias("tokens")), "sums")
    found = sums.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").collect()
    spark, kind = docs.sparkSession, "ids_crc32 long" if checksums else "ids array<int>"
    schema = PIECES.format(kind)
    if not found:
        return spark.createDataFrame([], schema)
    totals = np.array([r.tokens for r in found], np.int64)
    weights = totals.astype(float) if target is None else np.array([float(target.get(r.source, 0)) for r in found])
    plan, number = spark.sparkContext.broadcast(schedule(totals, weights, window)), {r.source: k for k, r in enumerate(found)}
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(sums.select("part", "source", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    placed = rows.join(bases, ["part", "source"]).select("doc_id", "source", (F.col("base") + F.col("before")).alias("begin"), "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = Schedule(plan.value, window)
        for batch in slices(batches, "ids"):
            sources = np.array([number[x] for x in batch.column("source").to_pylist()])
            for s in np.unique(sources):
                rows_of = np.flatnonzero(sources == s)
                part = batch.take(pa.array(rows_of))
                size, raw = part.column("doc_tokens").to_numpy(), part.column("ids").to_pylist()
                ids = np.concatenate([np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(raw, size.tolist(), strict=True)])
                doc, start, length, w, offset = where.cut(s, part.column("begin").to_numpy(), size)
                first = np.cumsum(size) - size
                if checksums:
                    data, at = memoryview(ids.tobytes()), ((first[doc] + start) * 4).tolist()
                    column = pa.array([zlib.crc32(data[a : a + n]) for a, n in zip(at, (length * 4).tolist(), strict=True)], pa.int64())
                else:  # pieces follow one another as the ids do
                    column = int_lists(ids.astype(np.int32), length, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), column, pa.array(size[doc]), pa.array(w), pa.array(offset), pa.array([found_names[s]] * len(doc), pa.string())], names)

    found_names, names = [r.source for r in found], [x.split()[0] for x in schema.split(", ")]
    return placed.mapInArrow(run, schema)
