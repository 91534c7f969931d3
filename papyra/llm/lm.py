"""Language-model scores by Brown-style class bigrams.

Every word has a class; a text's probability is the product of class transitions and of word emissions from classes.
Classes come from exchange clustering in two steps. First the UNITS most frequent words are exchanged in rounds
(Uszkoreit and Brants, 2008): the whole corpus gives, for each of them, how often each class stands before and after it,
words move to the classes that raise the likelihood most, and a round whose likelihood is lower than the best so far is
taken back and repeated with fewer moves. Then every other word of the corpus moves once, by its own contexts among these
classes, gathered over all documents in tasks dealt out by hash. The driver holds the frequent words and sums by class;
the other words' classes and all counts stay in tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import bucket_bits, dealt_by_range, discard, id_text, release, slices, texts_of, written
from papyra.llm.words import hash_spans, joined, word_spans

#: Words that are exchanged in rounds; classes, of which the last is the end's own.
UNITS, CLASSES = 16_384, 64
ROUNDS = 6
#: Bytes of text in a chunk (a longer text is a chunk of its own), tokens that are counted at once, words at once.
CHUNK, TOKENS, WORDS = 4 << 20, 1 << 18, 1 << 13
#: The hash that stands for the end of a text; the class of a word that training documents don't hold.
END, UNSEEN = -1, 255
#: Weight of the class model against word frequencies; pseudo-counts of emissions and of transitions.
WEIGHT, DELTA, ALPHA = 0.95, 0.1, 2.0
CHUNKS = "chunk long, ids array<long>, held_out binary, counts binary, hashes binary, trained binary, codes binary"


class Clustering(NamedTuple):
    """tops: hashes of the frequent words, ascending; counts: theirs in training; kind: their classes, then that of all other words (one more than there are classes), then the end's."""

    tops: np.ndarray
    counts: np.ndarray
    kind: np.ndarray

    def units(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word among tops; the number of tops for others, one more for the end."""
        n = len(self.tops)
        at = np.searchsorted(self.tops, hashes)
        own = (self.tops[np.minimum(at, n - 1)] == hashes) if n else np.zeros(len(hashes), bool)
        return np.where(hashes == END, n + 1, np.where(own, at, n)).astype(np.int32)


class Model(NamedTuple):
    """What scoring needs besides words' counts and classes. transition: by the class before (the last row: a word never seen), then by class."""

    transition: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    tokens: int
    types: int


def planes(codes: np.ndarray) -> bytes:
    """32-bit numbers by bytes of equal weight, which compress better."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents as word numbers of a dictionary of their chunk, with the words' counts in training documents. Written once."""

    def close(rows: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column("doc_id") for b in rows])
        held = np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in rows])
        data, begins = joined([x for b in rows for x in texts_of(b.column("text"))])
        raw = np.frombuffer(data, np.uint8)
        a, b = word_spans(raw)
        words = hash_spans(raw, a, b).view(np.int64)
        words[words == END] = 0
        counts = np.diff(np.searchsorted(a, begins))
        words = np.insert(words, np.cumsum(counts), END)
        unique, code = np.unique(words, return_inverse=True)
        trained = np.bincount(code[~np.repeat(held, counts + 1)], minlength=len(unique))
        # frequent words get small numbers
        order = np.argsort(-np.bincount(code, minlength=len(unique)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        parts = [held.tobytes(), (counts + 1).astype(np.int64).tobytes(), unique[order].tobytes(), trained[order].astype(np.int64).tobytes(), planes(place[code])]
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number]), lists, *(pa.array([x], pa.binary()) for x in parts)], [x.split()[0] for x in CHUNKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in slices(batches, size=CHUNK // 8):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK:
                yield close(held, number)
                number, held, size = number + 1, [], 0
        if held:
            yield close(held, number)
        release()

    rows = id_text(docs, id_col, text_col)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    return written(rows.withColumn("held_out", held_out).mapInArrow(run, CHUNKS), "chunks")


KINDS = {"held_out": bool, "counts": np.int64, "hashes": np.int64, "trained": np.int64, "classes": np.uint8, "word_counts": np.int64}


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of chunks as arrays, by name."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in batch.schema.names}
            yield {c: from_planes(v.as_buffer()) if c == "codes" else np.frombuffer(v.as_buffer(), KINDS[c]) if c in KINDS else v for c, v in row.items()}
    release()


def word_counts(table: DataFrame) -> DataFrame:
    """bucket, hashes, counts: the words of training documents, a row for each range of hashes. Written once."""
    wide = max(4, bucket_bits(table.sparkSession) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            hashes, counts = summed([x for x, _ in held], [x for _, x in held])
            held.clear()
            order, bounds = dealt_by_range(hashes.view(np.uint64), wide)
            some = [(b, hashes[order[x:y]].tobytes(), counts[order[x:y]].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
            b, h, n = zip(*some, strict=True) if some else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(h, pa.binary()), pa.array(n, pa.binary())], ["bucket", "hashes", "counts"])

        for row in arrays(batches):
            seen = row["trained"] > 0
            held.append((row["hashes"][seen], row["trained"][seen]))
            if sum(len(x) for x, _ in held) > 1 << 20:
                yield flush()
        if held:
            yield flush()

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        hashes, counts = summed(*([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()] for c in ("hashes", "counts")))
        return pa.table([pa.array([key[0].as_py()]), pa.array([hashes.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["bucket", "hashes", "counts"])

    kind = "bucket long, hashes binary, counts binary"
    return written(table.select("hashes", "trained").mapInArrow(run, kind).groupBy("bucket").applyInArrow(fold, kind), "words")


def summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes and their summed counts."""
    unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts), len(unique)).astype(np.int64)


def frequent(words: DataFrame, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the `units` most frequent words, ascending; their counts; numbers of types, tokens and ends in training documents)."""

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, all_ = np.zeros(64, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for h, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                hashes, counts = np.frombuffer(h, np.int64), np.frombuffer(n, np.int64)
                total += np.bincount(np.log2(counts).astype(int), minlength=64)
                all_ += [len(counts), counts.sum(), counts[hashes == END].sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(67)), pa.array(np.append(total, all_))], ["level", "n"])

    sums = {r["level"]: r["n"] for r in words.mapInArrow(levels, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()}
    total = np.array([sums.get(k, 0) for k in range(67)])
    # the least power of two that enough words reach
    above = np.cumsum(total[63::-1])[::-1] if len(sums) else np.zeros(64)
    least = 1 << int(max(np.flatnonzero(above > units), default=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                hashes, counts = np.frombuffer(h, np.int64), np.frombuffer(n, np.int64)
                some = (counts >= least) & (hashes != END)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[some]), pa.array(counts[some])], ["hash", "trained"])

    top = words.mapInArrow(run, "hash long, trained long").orderBy(F.desc("trained"), "hash").limit(units).toArrow()
    hashes, counts = top.column("hash").to_numpy(), top.column("trained").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order], total[64:]


def column_sums(df: DataFrame, column: str) -> np.ndarray:
    """The sum of a binary column's arrays of 64-bit numbers, all of one length. Sums travel in 64 pieces, so that no task gets all of every task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x is not None:
                    x = np.frombuffer(x, np.int64)
                    total = x.copy() if total is None else total + x
        if total is not None:
            pieces = np.array_split(total, 64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())
        return pa.table([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["piece", "sums"])

    kind = "piece long, sums binary"
    got = sorted(df.select(column).mapInArrow(run, kind).groupBy("piece").applyInArrow(add, kind).toArrow().to_pylist(), key=lambda x: x["piece"])
    return np.concatenate([np.frombuffer(x["sums"], np.int64) for x in got]) if got else np.zeros(0, np.int64)


def neighbours(row: dict, of_word: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(what of_word has of each training token of a chunk, and of the token before it), some tokens at a time. An end stands before each text's first token."""
    codes, train = row["codes"], ~np.repeat(row["held_out"], row["counts"])
    for k in range(0, len(codes), size):
        # the end of the text before, of whichever text, is the same token; the chunk's last end stands before its first
        here = of_word[codes[k : k + size]]
        before = np.append(of_word[codes[k - 1]], here[:-1])
        keep = train[k : k + size]
        yield here[keep], before[keep]


def contexts(table: DataFrame, state: Clustering, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(units x classes after, units x classes before) over all training documents."""
    n, width = len(state.kind), classes + 1
    shared = table.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros((2, n * width), np.int64), shared.value.kind.astype(np.int32)
        for row in arrays(batches):
            for unit, before in neighbours(row, shared.value.units(row["hashes"]), TOKENS):
                total[0] += np.bincount(before * width + kind[unit], minlength=n * width)
                total[1] += np.bincount(unit * width + kind[before], minlength=n * width)
        total = total.reshape(2, n, width)
        for k in range(0, n, 2048):
            some = k + np.flatnonzero(total[:, k : k + 2048].any((0, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[:, x].tobytes() for x in some], pa.binary())], ["unit", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for unit, raw in zip(batch.column("unit").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.int64)
                sums[unit] = sums[unit] + x if unit in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["unit", "counts"])

    kind = "unit long, counts binary"
    got = table.select("held_out", "counts", "hashes", "codes").mapInArrow(run, kind).repartition("unit").mapInArrow(add, kind).toArrow()
    out = np.zeros((n, 2, width), np.int64)
    for unit, raw in zip(got.column("unit").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[unit] = np.frombuffer(raw, np.int64).reshape(2, width)
    return out[:, 0], out[:, 1]


def class_pairs(after: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How often each class follows each other one."""
    out = np.zeros((after.shape[1],) * 2, np.int64)
    np.add.at(out, kind, after)
    return out


def likelihood(pairs: np.ndarray) -> float:
    """The part of the corpus' log likelihood that depends on the classes."""
    term = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return term(pairs) - term(pairs.sum(0)) - term(pairs.sum(1))


def gains(after: np.ndarray, before: np.ndarray, pairs: np.ndarray, classes: int) -> np.ndarray:
    """What each class gives to the likelihood of words with these contexts; the end's class and that of other words take none."""
    logs = np.log(pairs + 0.5)
    left, right = np.log(pairs.sum(1) + 0.5 * len(pairs)), np.log(pairs.sum(0) + 0.5 * len(pairs))
    out = after @ logs.T + before @ logs - np.outer(after.sum(1), left) - np.outer(before.sum(1), right)
    return out[:, : classes - 1]


def exchange(after: np.ndarray, before: np.ndarray, kind: np.ndarray, classes: int, turn: int, share: int) -> np.ndarray:
    """New classes: one unit of each `share` moves to the class that gains most."""
    gain, n = gains(after, before, class_pairs(after, kind), classes)[:-2], len(kind) - 2
    best = np.argmax(gain, axis=1)
    move = (gain[np.arange(n), best] > gain[np.arange(n), kind[:n]]) & (np.arange(n) % share == turn % share)
    return np.append(np.where(move, best, kind[:n]), kind[n:])


def clustered(table: DataFrame, tops: np.ndarray, counts: np.ndarray, classes: int, rounds: int) -> tuple[Clustering, np.ndarray]:
    """(the clustering of highest likelihood, how often its classes follow one another). Frequent words are dealt out by rank at first."""
    kind = np.empty(len(tops) + 2, np.int64)
    kind[np.argsort(-counts, kind="stable")] = np.arange(len(tops)) % (classes - 1)
    kind[-2:] = classes, classes - 1
    best, share = None, 2
    for turn in range(rounds + 1):
        after, before = contexts(table, Clustering(tops, counts, kind), classes)
        value = likelihood(class_pairs(after, kind))
        if best is None or value > best[0]:
            best = value, kind, after, before
        else:
            share *= 2
        kind = exchange(best[2], best[3], best[1], classes, turn, share)
    return Clustering(tops, counts, best[1]), class_pairs(best[2], best[1])


def placed_words(table: DataFrame, shared: Broadcast, pairs: np.ndarray, classes: int) -> DataFrame:
    """chunk, bucket, counts, classes, sums: count and class of each word of each chunk that isn't frequent, by hash. Written once.

    A word goes to the class that its contexts in all training documents gain most in. sums, in one row of each bucket:
    types and tokens by class.
    """
    wide, width = max(4, bucket_bits(table.sparkSession) - 2), classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for row in arrays(batches):
            unit = state.units(row["hashes"])
            rare = np.flatnonzero(unit == len(state.tops))
            if not len(rare):
                continue
            rare = rare[np.argsort(row["hashes"][rare].view(np.uint64))]
            place = np.full(len(unit), -1, np.int64)
            place[rare] = np.arange(len(rare))
            kind, found = state.kind[unit], []
            both = place * width + kind  # a word's place and its class in one number
            for here, before in neighbours(row, both, TOKENS):
                a, b = here // width, before // width
                ahead, behind = here[b >= 0] % width, before[a >= 0] % width
                found.append(b[b >= 0] * (2 * width) + ahead)
                found.append(a[a >= 0] * (2 * width) + width + behind)
            context, many = np.unique(np.concatenate(found), return_counts=True)
            owner, context = context // (2 * width), (context % (2 * width)).astype(np.uint8)
            each = np.bincount(owner, minlength=len(rare))
            ends = np.append(0, np.cumsum(each))
            hashes, trained = row["hashes"][rare], row["trained"][rare]
            _, bounds = dealt_by_range(hashes.view(np.uint64), wide)
            some = [(b, x, y) for b, (x, y) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)) if y > x]
            parts = zip(*((b, hashes[x:y].tobytes(), trained[x:y].tobytes(), each[x:y].astype(np.uint32).tobytes(), context[ends[x] : ends[y]].tobytes(), many[ends[x] : ends[y]].astype(np.uint32).tobytes()) for b, x, y in some), strict=True)
            b, *raw = parts
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"].as_py()] * len(b), pa.int64()), pa.array(b, pa.int64()), *(pa.array(x, pa.binary()) for x in raw)], ["chunk", "bucket", "hashes", "trained", "each", "context", "many"])

    def fold(told: pa.Table) -> pa.Table:
        of = {c: [np.frombuffer(x, t) for x in told.column(c).to_pylist()] for c, t in (("hashes", np.int64), ("trained", np.int64), ("each", np.uint32), ("context", np.uint8), ("many", np.uint32))}
        unique, place = np.unique(np.concatenate(of["hashes"]), return_inverse=True)
        counts = np.bincount(place, np.concatenate(of["trained"]), len(unique)).astype(np.int64)
        owner = np.repeat(place, np.concatenate(of["each"]))
        order = np.argsort(owner, kind="stable")
        owner, context, many = owner[order], np.concatenate(of["context"])[order], np.concatenate(of["many"])[order]
        kind = np.full(len(unique), UNSEEN, np.uint8)
        for k in range(0, len(unique), WORDS):
            x, y = np.searchsorted(owner, [k, k + WORDS])
            n = min(WORDS, len(unique) - k)
            total = np.bincount((owner[x:y] - k) * (2 * width) + context[x:y], many[x:y], n * 2 * width).reshape(n, 2 * width)
            kind[k : k + n] = np.argmax(gains(total[:, :width], total[:, width:], pairs, classes), axis=1)
        kind[counts == 0] = UNSEEN
        seen = counts > 0
        sums = np.append(np.bincount(kind[seen], minlength=classes), np.bincount(kind[seen], counts[seen], classes).astype(np.int64))
        cuts = np.cumsum([len(x) for x in of["hashes"]])[:-1]
        raw = [[x.tobytes() for x in np.split(v[place], cuts)] for v in (counts, kind)]
        return pa.table([told.column("chunk"), told.column("bucket"), *(pa.array(x, pa.binary()) for x in raw), pa.array([sums.tobytes(), *[None] * (told.num_rows - 1)], pa.binary())], ["chunk", "bucket", "word_counts", "classes", "sums"])

    told = table.select("chunk", "held_out", "counts", "hashes", "trained", "codes").mapInArrow(run, "chunk long, bucket long, hashes binary, trained binary, each binary, context binary, many binary")
    return written(told.groupBy("bucket").applyInArrow(fold, "chunk long, bucket long, word_counts binary, classes binary, sums binary"), "placed")


CODED = "ids array<long>, held_out binary, counts binary, word_counts binary, classes binary, codes binary, pairs binary"


def coded(table: DataFrame, placed: DataFrame, shared: Broadcast, ends: int, classes: int) -> DataFrame:
    """CODED: chunks with the count and class of each word of their dictionaries, and how often classes follow one another in them. Written once."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        state, out = shared.value, []
        right = right.sort_by("bucket")
        for row in arrays(left.to_batches()):
            unit = state.units(row["hashes"])
            kind, counts = state.kind[unit].astype(np.uint8), np.append(state.counts, [0, ends])[unit]
            rare = np.flatnonzero(unit == len(state.tops))
            rare = rare[np.argsort(row["hashes"][rare].view(np.uint64))]
            for x, name in ((counts, "word_counts"), (kind, "classes")):
                x[rare] = np.frombuffer(b"".join(right.column(name).to_pylist()), KINDS[name])
            pairs = sum((np.bincount(before.astype(np.int64) * classes + here, minlength=classes**2) for here, before in neighbours(row, kind, TOKENS)), np.zeros(classes**2, np.int64))
            raw = [row["held_out"].tobytes(), row["counts"].tobytes(), counts.tobytes(), kind.tobytes(), planes(row["codes"]), pairs.tobytes()]
            out.append(pa.table([pa.array([row["ids"].as_py()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in raw)], [x.split()[0] for x in CODED.split(", ")]))
        return pa.concat_tables(out)

    return written(table.drop("trained").groupBy("chunk").cogroup(placed.drop("sums").groupBy("chunk")).applyInArrow(run, CODED), "coded")


def model_of(pairs: np.ndarray, class_types: np.ndarray, class_tokens: np.ndarray) -> Model:
    """The smoothed model of these counts."""
    tokens = pairs.sum(0)
    overall = (tokens + 1) / (tokens.sum() + len(pairs))
    transition = (pairs + ALPHA * overall) / (pairs.sum(1, keepdims=True) + ALPHA)
    return Model(np.vstack([transition, overall]), class_tokens, class_types, int(class_tokens.sum()), int(class_types.sum()))


def log_scores(m: Model, kind: np.ndarray, before: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base, model) log10 probabilities of tokens, from their classes, the classes before them (one past the last: never seen) and their counts in training."""
    base = (count + 0.1) / (m.tokens + 0.1 * (m.types + 1))
    room = m.class_tokens + DELTA * (m.class_types + 1)
    unknown = m.transition @ (DELTA / room)  # a word never seen, after each class
    kind = np.where(count > 0, kind, 0)
    p = np.where(count > 0, m.transition[before, kind] * ((count + DELTA) / room[kind]), unknown[before])
    return np.log10(base), np.log10(WEIGHT * p + (1 - WEIGHT) * base)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, units: int = UNITS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of each text.

    The model learns from the texts whose crc32(id as text) modulo 10 is not 0. A null text counts as empty: its one
    token is the end. Repeated rows count and are scored each. A null id counts as training text and comes back as null.
    Where no text is left to learn from, every token is unknown. An empty table gives no rows.
    """
    sc = docs.sparkSession.sparkContext
    table = chunks(docs, id_col, text_col)
    words = word_counts(table)
    tops, counts, (_, _, ends) = frequent(words, units)
    discard(words)
    state, pairs = clustered(table, tops, counts, classes, rounds)
    shared = sc.broadcast(state)
    placed = placed_words(table, shared, pairs, classes)
    rows = coded(table, placed, shared, int(ends), classes)
    sums = column_sums(placed, "sums").reshape(2, -1) if tops.size or ends else np.zeros((2, 0))
    sums = sums.copy() if sums.size else np.zeros((2, classes), np.int64)
    sums += [np.bincount(state.kind[:-2], minlength=classes), np.bincount(state.kind[:-2], counts, classes).astype(np.int64)]
    sums[:, -1] += [ends > 0, ends]
    pairs = column_sums(rows, "pairs")
    discard(table)
    discard(placed)
    model = sc.broadcast(model_of(pairs.reshape(classes, classes) if pairs.size else np.zeros((classes, classes)), sums[0], sums[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for x in arrays(batches):
            sizes = x["counts"]
            starts, last = np.cumsum(sizes) - sizes, classes - 1
            known, base, own = (np.zeros(len(sizes), t) for t in (np.int64, np.float64, np.float64))
            # whole texts, of TOKENS tokens or more together
            first = 0
            while first < len(sizes):
                end = max(first + 1, int(np.searchsorted(starts + sizes, starts[first] + TOKENS, "right")))
                codes = x["codes"][starts[first] : starts[end - 1] + sizes[end - 1]]
                kind, count = np.minimum(x["classes"][codes], classes), x["word_counts"][codes]
                scores = log_scores(m, kind, np.append(last, kind[:-1]), count)
                at = starts[first:end] - starts[first]
                known[first:end], base[first:end], own[first:end] = (np.add.reduceat(v, at) for v in ((count > 0).astype(np.int64), *scores))
                first = end
            columns = [pa.array(x["ids"].as_py(), pa.int64()), pa.array(x["held_out"]), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), m.tokens)), pa.array(base), pa.array(own), pa.array(10 ** np.minimum(-own / sizes, 300))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])

    return rows.drop("pairs").mapInArrow(run, SCORES)


def bits(total: float, tokens: int) -> float:
    """Bits a token of a log10 score."""
    return -total / math.log10(2) / tokens
