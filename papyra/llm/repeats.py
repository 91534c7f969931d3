"""Repeated passages by the hashes of their windows of LEAST words.

Every window of LEAST consecutive words has a key: the GRAM_WORDS words that hash lowest in it, the first among equals.
Windows that follow one another and have their key at the same place form a run, so a text has about two runs for each
WINDOW words. Equal windows have equal keys. Runs whose key occurs once are dropped; the others are dealt out by key, and
their windows are compared as hashes: two rows share a passage of LEAST words exactly where they hold the same window.
Windows of the keys that more than HOT runs have are gathered by task instead, each task keeps the first two holders of
each of its windows, and those are dealt out by the windows' own hashes. So a window counts once or twice for each task,
and no task gets a whole group, however large it is.

Comparing neighbours in the order of sparse suffixes alone can't give whole results: two rows whose common passage lies
before the key stand anywhere among those with the same key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import bit_slice, bucket_bits, dealt_by_range, gathered_bits, has_bit, slices, texts_of, unused, written
from papyra.llm.words import BASE, GRAM, grams, hash_words, joined, mix, word_spans

#: Words of the least passage; words of a key; places that a key can have in a window.
LEAST, GRAM_WORDS = 50, 20
WINDOW = LEAST - GRAM_WORDS + 1
#: Runs of a key that one task compares at most; windows of hot keys that a task gathers before it passes them on.
HOT, GATHERED = 2048, 1 << 17
#: A table of 2^KEY_BITS bits holds the keys that may repeat. A full table lets more runs through, and loses none.
KEY_BITS = 26
SLICE = 1 << 19
#: Runs that are compared at once.
ROWS = 1 << 13
RUN = "key long, doc_id long, row long, begin long, windows binary"
SPAN = "doc_id long, row long, begin long, end long, other long"
CHUNK = "chunk long, ids array<long>, rows array<long>, owner binary, begin binary, hashes binary"
#: A holder of a window; what is known of a window that several rows hold: its first holder, and the id of its second.
HOLDER = np.dtype([("hash", "<u8"), ("null", "?"), ("id", "<i8"), ("row", "<i8")])
KNOWN = np.dtype([("hash", "<u8"), ("null", "?"), ("id", "<i8"), ("row", "<i8"), ("null2", "?"), ("id2", "<i8")])


class Runs(NamedTuple):
    """Of each run its key, its first window as a position in the array of all words, and its number of windows; the hashes of all windows."""

    keys: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    hashes: np.ndarray


def runs(words: np.ndarray, counts: np.ndarray) -> Runs:
    """The runs of texts with these numbers of words."""
    g = grams(words, GRAM_WORDS)
    n = len(g) - WINDOW + 1
    if n <= 0:
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    at, width = np.arange(len(g)), 1
    while width < WINDOW:  # position of the least of `width` grams from each place, the first among equals
        step = min(width, WINDOW - width)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(g[a] <= g[b], a, b)
        width += step
    ends = np.repeat(np.cumsum(counts), counts)[:n]
    whole = np.flatnonzero(np.arange(n) + LEAST <= ends)
    at = at[whole]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    starts = np.flatnonzero(new)
    # three grams cover a window's words
    hashes = mix((g[whole] * GRAM + g[whole + GRAM_WORDS]) * BASE + g[whole + LEAST - GRAM_WORDS])
    return Runs(g[at[starts]].view(np.int64), whole[starts], np.diff(np.append(starts, len(at))), hashes)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"))


def repeated_keys(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(a table of fixed size with a bit set for every key that occurs twice or more, the keys of more than HOT runs, ascending).

    The driver gets the table in pieces, and at most one key for each HOT runs.
    """
    wide, most = bucket_bits(rows.sparkSession), HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=2 * SLICE):
            keys = runs(*hash_words(texts_of(batch.column("text")))).keys
            unique, counts = np.unique(keys.view(np.uint64), return_counts=True)
            counts = np.minimum(counts, (1 << 16) - 1).astype(np.uint16)
            _, bounds = dealt_by_range(unique, wide)
            some = [(b, unique[x:y].tobytes(), counts[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
            b, k, m = zip(*some, strict=True) if some else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(k, pa.binary()), pa.array(m, pa.binary())], ["bucket", "keys", "many"])

    def twice(bucket: tuple, table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        many = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("many").to_pylist()])
        unique, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place, many)
        arrays = [pa.array([bucket[0].as_py()], pa.int64()), pa.array([bit_slice(unique[counts > 1], wide, KEY_BITS)], pa.binary()), pa.array([unique[counts > most].tobytes()], pa.binary())]
        return pa.table(arrays, ["bucket", "bits", "hot"])

    found = rows.select("text").mapInArrow(run, "bucket long, keys binary, many binary").groupBy("bucket").applyInArrow(twice, "bucket long, bits binary, hot binary").toArrow()
    return gathered_bits(found, KEY_BITS), np.sort(np.frombuffer(b"".join(found.column("hot").to_pylist()), np.int64))


def kept_runs(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """The runs whose keys may repeat and aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_keys = shared.value
        for batch in slices(batches, size=SLICE):
            words, counts = hash_words(texts_of(batch.column("text")))
            keys, first, windows, hashes = runs(words, counts)
            keep = has_bit(bits, keys.view(np.uint64), KEY_BITS) & ~np.isin(keys, hot_keys)
            hashes = hashes[np.repeat(keep, windows)]
            keys, first, windows = keys[keep], first[keep], windows[keep]
            starts = np.cumsum(counts) - counts
            # texts without words share their start with the next one
            owner = np.searchsorted(starts, first, "right") - 1
            ends = np.append(0, np.cumsum(windows))
            take = pa.array(owner)
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((8 * ends).astype(np.int32).tobytes()), pa.py_buffer(hashes.tobytes())])
            columns = [pa.array(keys), batch.column("doc_id").take(take), batch.column("row").take(take), pa.array(first - starts[owner]), raw]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RUN.split(", ")])

    return rows.mapInArrow(run, RUN)


def hot_windows(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """CHUNK: the windows of hot keys, GATHERED or more of them together, with the rows that hold them. Written once."""
    gathered = GATHERED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, seen = TaskContext.get().partitionId() << 24, [], 0, 0

        def flush() -> pa.RecordBatch:
            ids, row, owner, begin, hashes = zip(*held, strict=True)
            base = np.cumsum([0, *map(len, ids)])
            owner = np.concatenate([x + k for x, k in zip(owner, base, strict=False)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array([0, base[-1]], pa.int32()), pa.concat_arrays(x)) for x in (ids, row)]
            raw = [pa.array([x.tobytes()], pa.binary()) for x in (owner, np.concatenate(begin), np.concatenate(hashes))]
            return pa.RecordBatch.from_arrays([pa.array([number + seen]), *lists, *raw], [x.split()[0] for x in CHUNK.split(", ")])

        for batch in slices(batches, size=SLICE):
            words, counts = hash_words(texts_of(batch.column("text")))
            keys, first, windows, hashes = runs(words, counts)
            keep = np.isin(keys, shared.value[1])
            if not keep.any():
                continue
            starts = np.cumsum(counts) - counts
            at = np.repeat(first - np.cumsum(windows) + windows, windows) + np.arange(len(hashes))
            at, hashes = at[np.repeat(keep, windows)], hashes[np.repeat(keep, windows)]
            owner = np.searchsorted(starts, at, "right") - 1
            docs, place = np.unique(owner, return_inverse=True)
            take = pa.array(docs)
            held.append((batch.column("doc_id").take(take), batch.column("row").take(take), place, at - starts[owner], hashes))
            size += len(at)
            if size >= gathered:
                yield flush()
                held, size, seen = [], 0, seen + 1
        if held:
            yield flush()

    return written(rows.mapInArrow(run, CHUNK), "windows")


def _holders(row: dict) -> np.ndarray:
    """HOLDER of each window of a chunk."""
    owner = np.frombuffer(row["owner"], np.int32)
    ids, out = pa.array(row["ids"], pa.int64()), np.zeros(len(owner), HOLDER)
    out["hash"] = np.frombuffer(row["hashes"], np.uint64)
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)[owner]
    out["id"] = ids.fill_null(0).to_numpy()[owner]
    out["row"] = np.array(row["rows"], np.int64)[owner]
    return out


def _first_two(holders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct holders by window, rank and row; where each window begins among them; whether it has a second holder)."""
    holders = holders[np.lexsort((holders["row"], holders["id"], holders["null"], holders["hash"]))]
    holders = holders[np.append(True, holders[1:] != holders[:-1])] if len(holders) else holders
    first = np.flatnonzero(np.append(True, holders["hash"][1:] != holders["hash"][:-1])) if len(holders) else np.zeros(0, np.int64)
    return holders, first, np.diff(np.append(first, len(holders))) > 1


def hot_spans(windows: DataFrame, later: bool) -> DataFrame:
    """SPAN of the windows of hot keys."""
    wide = max(4, bucket_bits(windows.sparkSession) - 2)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                holders, first, second = _first_two(_holders(row))
                some = np.sort(np.append(first, first[second] + 1))
                order, bounds = dealt_by_range(holders["hash"][some], wide)
                parts = [(b, holders[some[order[x:y]]].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
                b, h = zip(*parts, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([row["chunk"]] * len(b), pa.int64()), pa.array(h, pa.binary())], ["bucket", "chunk", "holders"])

    def answer(table: pa.Table) -> pa.Table:
        told = [np.frombuffer(x, HOLDER) for x in table.column("holders").to_pylist()]
        holders, first, second = _first_two(np.concatenate(told))
        first = first[second]
        known = np.zeros(len(first), KNOWN)
        for name in HOLDER.names:
            known[name] = holders[name][first]
        known["null2"], known["id2"] = holders["null"][first + 1], holders["id"][first + 1]
        replies = [known[np.isin(known["hash"], x["hash"])].tobytes() for x in told]
        return pa.table([table.column("chunk"), pa.array(replies, pa.binary())], ["chunk", "known"])

    def finish(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        known = np.frombuffer(b"".join(replies.column("known").to_pylist()), KNOWN)
        known = known[np.argsort(known["hash"])]
        out = []
        for row in chunk.to_pylist() if len(known) else []:
            own, begin, owner = _holders(row), np.frombuffer(row["begin"], np.int64), np.frombuffer(row["owner"], np.int32)
            of = known[np.minimum(np.searchsorted(known["hash"], own["hash"]), len(known) - 1)]
            leads = (of["row"] == own["row"]) & (of["id"] == own["id"]) & (of["null"] == own["null"])
            hit = np.flatnonzero((of["hash"] == own["hash"]) & ~(leads & later))
            if not len(hit):
                continue
            hit = hit[np.lexsort((begin[hit], owner[hit]))]
            null, other = (np.where(leads, of[a], of[b])[hit] for a, b in (("null2", "null"), ("id2", "id")))
            new = np.flatnonzero(np.append(True, (np.diff(begin[hit]) != 1) | (np.diff(owner[hit]) != 0)))
            last = np.append(new[1:], len(hit)) - 1
            none = np.minimum.reduceat(null, new)
            other = np.minimum.reduceat(np.where(null, np.iinfo(np.int64).max, other), new)
            at = hit[new]
            columns = [pa.array(own["id"][at], mask=own["null"][at]), pa.array(own["row"][at]), pa.array(begin[at]), pa.array(begin[hit[last]] + LEAST), pa.array(other, mask=none)]
            out.append(pa.table(columns, [x.split()[0] for x in SPAN.split(", ")]))
        return pa.concat_tables(out) if out else pa.schema([(x.split()[0], pa.int64()) for x in SPAN.split(", ")]).empty_table()

    told = windows.mapInArrow(tell, "bucket long, chunk long, holders binary")
    known = told.groupBy("bucket").applyInArrow(answer, "chunk long, known binary")
    return windows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(finish, SPAN)


def compared(table: pa.Table, later: bool) -> pa.RecordBatch:
    """The spans (SPAN) of these runs, with all runs of their keys."""
    ids = table.column("doc_id").combine_chunks()
    null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    row, first = table.column("row").to_numpy(), table.column("begin").to_numpy()
    # rows numbered by id, null last
    order = np.lexsort((row, value, null))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[order[1:]] != row[order[:-1]]) | (value[order[1:]] != value[order[:-1]]) | (null[order[1:]] != null[order[:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    one = order[fresh]

    raw = table.column("windows").to_pylist()
    counts = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
    hashes = np.frombuffer(b"".join(raw), np.uint64)
    run = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((rank[run], hashes))
    h, r = hashes[order], rank[run[order]]
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    group = np.cumsum(fresh) - 1
    lead = r[fresh][group]
    follows = r != lead
    step = np.flatnonzero(follows[1:] & ~follows[:-1]) + 1
    second = np.full(len(h), -1)
    second[group[step]] = r[step]
    partner = np.empty(len(h), np.int64)
    partner[order] = np.where(follows, lead, -1 if later else second[group])

    hit = np.flatnonzero(partner >= 0)
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (run[hit[1:]] != run[hit[:-1]])
    b = np.flatnonzero(new)
    begin = (first[run] + np.arange(len(h)) - (np.cumsum(counts) - counts)[run])[hit]
    least = np.minimum.reduceat(partner[hit], b) if len(b) else b
    take = pa.array(run[hit[b]])
    columns = [ids.take(take), pa.array(row[run[hit[b]]]), pa.array(begin[b]), pa.array(begin[np.append(b[1:], len(hit))[: len(b)] - 1] + LEAST), ids.take(pa.array(one[least]))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SPAN.split(", ")])


def dealt_spans(found: DataFrame, later: bool) -> DataFrame:
    """The spans of runs, dealt out by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= ROWS:
                some = pa.Table.from_batches(held)
                key = some.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))
                if whole:
                    yield compared(some.slice(0, whole), later)
                    held = some.slice(whole).to_batches()
        if held:
            yield compared(pa.Table.from_batches(held), later)

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(run, SPAN)


def shared_spans(rows: DataFrame, later: bool = False) -> DataFrame:
    """doc_id, row, begin, end, other: windows that another row holds, or an earlier one (by id, null last), joined within runs."""
    table, hot = repeated_keys(rows)
    shared = rows.sparkSession.sparkContext.broadcast((table, hot))
    out = dealt_spans(kept_runs(rows, shared), later)
    return out.unionByName(hot_spans(hot_windows(rows, shared), later)) if len(hot) else out


def merged(spans: DataFrame, *group: str) -> DataFrame:
    """Overlapping and touching spans (begin, end) of each group as one, with the least `other` of them."""
    w = Window.partitionBy(*group).orderBy("begin", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("begin") <= reach, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("papyra_island", island).groupBy(*group, "papyra_island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("other").alias("other")).drop("papyra_island")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, begin, end, n_words, other: the passages of 50 words or more that a document shares with another one.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; begin and end (one past the last) count them from 0. The spans
    cover exactly the passages of at least 50 words that two rows share; `other` is the least id of another row that holds
    50 words of a span. A text that repeats under the same id is one row; texts that differ under one id are held apart
    and may give overlapping spans. Rows without an id are rows like others, told apart by their texts: their spans have a
    null doc_id, and `other` is null where only such rows hold the words. Repeats within one text alone aren't reported.
    Null, empty and shorter texts have no spans; empty tables give no rows.
    """
    spans = merged(shared_spans(_rows(docs, id_col, text_col)), "doc_id", "row")
    return spans.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "other")


def later_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, begin, end: the passages that an earlier row (by id, null last) holds too.

    Of the rows that hold a window the first one keeps it, and all others lose it. What the first row itself loses to an
    earlier one is there, so every word that goes remains in some row.
    """
    return merged(shared_spans(_rows(docs, id_col, text_col), later=True), "row").drop("other")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, all their columns, without the passages that an earlier document holds too.

    A text of which nothing but white space is left goes with its row; all other rows stay. length_col, where docs have
    it, is set to the new length of the texts that change.
    """
    mark, spans, whole = (unused(docs, f"papyra_{x}") for x in ("row", "spans", "text"))
    gone = later_occurrences(docs, id_col, text_col).groupBy(F.col("row").alias(mark)).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(spans))
    text = F.col(text_col).cast("string")
    both = docs.withColumn(mark, F.xxhash64(F.col(id_col).cast("long"), text)).join(gone, mark, "left")

    @F.pandas_udf("string")
    def cut(texts, spans_of):
        return texts.combine(spans_of, cut_words)

    rest = F.when(F.col(spans).isNotNull(), cut(text, F.col(spans))).otherwise(text)
    columns = [rest.alias(c) if c == text_col else F.when(F.col(spans).isNotNull(), F.length(whole)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    out = both.withColumn(whole, rest).where(F.col(spans).isNull() | F.col(whole).rlike("[^\\x20\\x09-\\x0D]"))
    return out.select(*[F.col(whole).alias(c) if c == text_col else x for c, x in zip(docs.columns, columns, strict=True)])


def cut_words(text: str, spans) -> str:
    """The text without its words begin..end of each span, and without the white space after them."""
    if spans is None or not len(spans):
        return text
    raw, kept, at = text.encode(), [], 0
    begins = np.append(word_spans(np.frombuffer(joined([text])[0], np.uint8))[0], len(raw))
    for span in spans:
        begin, end = (span["begin"], span["end"]) if isinstance(span, dict) else (span[0], span[1])
        kept.append(raw[at : begins[begin]])
        at = begins[end]
    return b"".join([*kept, raw[at:]]).decode()
