"""Exact n-gram Jaccard join through a token-group matrix.

Documents are sets of hashed word shingles; equal sets count once. The documents that share a token of their prefixes
(the tokens of which two linked sets must have one in common) are partitioned into groups of similar documents, at most
GROUP of them each. Within groups all pairs are compared. Across groups, a document is first held against the union of
a group's tokens: only where the overlap is large enough for some link is the group opened and its members compared.

Frequent tokens come last in the order that prefixes follow, so that a passage of many documents draws no candidates.
Tokens travel between tasks as arrays, one row for each task and hash range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import bit_slice, bit_table, bucket_bits, dealt_by_range, discard, gathered_bits, has_bit, id_text, packed_rest, release, slices, texts_of, unpacked_rest, unused, written
from papyra.llm.graph import components
from papyra.llm.words import mix, shingle_sets

#: Members of a group, and their tokens; a larger set of documents with one key is dealt out to several groups.
GROUP, GROUP_TOKENS = 256, 1 << 21
#: Documents, and their tokens, that one task holds against a group.
LOT, LOT_TOKENS = 2048, 1 << 20
#: A prefix holds 1 / EXTRA of a set's tokens more than linked sets need to have one token of it in common; they then
#: have so many more in common.
EXTRA = 20
#: Documents (counted by task) from which a token is frequent.
FREQUENT = 64
#: Tokens with hashes below SAMPLED, a quarter of 2^64, can be frequent; one bit for each of 2^FREQUENT_BITS ranges of
#: them says so. A range is frequent if one of its tokens is. A full table makes the join slower, not wrong.
SAMPLED, FREQUENT_BITS = 1 << 62, 22
#: A table of 2^INVOLVED_BITS bits says which documents have candidates; false positives are sorted out by a join.
INVOLVED_BITS = 26
#: Tokens of a group from which the worker gives freed memory back.
FREED = 1 << 17
SLICE = 1 << 19
SETS = "digest long, n long, tokens binary"


def _digest(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, never that of another but by a collision of hashes."""
    ends = np.cumsum(sizes)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(0x632BE59BD9B4E019)))])
    return mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)


def _least_overlap(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of this size can have with a set that it is linked to."""
    return -(-sizes * percent // 100)


def _new(digest: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which digests come up for the first time, the digests to remember, the last 100,000 of them)."""
    new = np.zeros(len(digest), bool)
    new[np.unique(digest, return_index=True)[1]] = True
    new &= ~np.isin(digest, seen)
    return new, np.concatenate([seen, digest[new]])[-100_000:]


def memberships(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest, n_shingles of each row. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            tokens, sizes = shingle_sets(texts_of(batch.column("text")), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_digest(tokens, sizes)), pa.array(sizes.astype(np.int64))], ["doc_id", "digest", "n_shingles"])

    return written(docs.mapInArrow(run, "doc_id long, digest long, n_shingles long"), "members")


def frequent_table(docs: DataFrame, n: int) -> np.ndarray:
    """The table of frequent tokens. Tokens are told apart by their bucket and 40 bits more: at worst too many are frequent."""
    wide = bucket_bits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], np.zeros(0, np.int64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                tokens, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                _, bounds = dealt_by_range(tokens, wide)
                counts = np.minimum(counts, FREQUENT).astype(np.uint8)
                rows = [(b, packed_rest(tokens[x:y], wide), counts[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
                b, t, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(t, pa.binary()), pa.array(c, pa.binary())], ["bucket", "tokens", "counts"])

        for batch in slices(batches, size=SLICE):
            tokens, sizes = shingle_sets(texts_of(batch.column("text")), n)
            new, seen = _new(_digest(tokens, sizes), seen)
            keep = np.repeat(new, sizes) & (tokens < np.uint64(SAMPLED))
            held.append(tokens[keep] << np.uint64(2))
            size += len(held[-1])
            if size > 1 << 20:
                yield from flush()
                size = 0
        yield from flush()

    def often(bucket: tuple, table: pa.Table) -> pa.Table:
        rest = unpacked_rest(table.column("tokens").to_pylist())
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        unique, place = np.unique(rest, return_inverse=True)
        hot = unique[np.bincount(place, counts) >= FREQUENT] << np.uint64(24) >> np.uint64(wide) | np.uint64(bucket[0].as_py()) << np.uint64(64 - wide)
        return _freed(pa.table({"bucket": pa.array([bucket[0].as_py()], pa.int64()), "bits": pa.array([bit_slice(hot, wide, FREQUENT_BITS)], pa.binary())}), len(rest))

    found = docs.select("text").mapInArrow(run, "bucket long, tokens binary, counts binary").groupBy("bucket").applyInArrow(often, "bucket long, bits binary")
    return gathered_bits(found.toArrow(), FREQUENT_BITS)


def shared_tokens(docs: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """token, digest, many: the prefix tokens that several sets have, where sizes allow a link. Written once.

    Tokens are told apart by their bucket and 40 bits more: at worst there are candidates too many. Sizes travel as
    steps of a hundredth, which lets pairs near the bound through.
    """
    spark = docs.sparkSession
    wide, packed = bucket_bits(spark), spark.sparkContext.broadcast(frequent)
    reach = int(np.ceil(np.log(100 / percent) / np.log(1.03))) + 1  # steps between sizes that may be linked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, size = [], np.zeros(0, np.int64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                tokens, digest, steps = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                order, bounds = dealt_by_range(tokens, wide)
                tokens, digest, steps = tokens[order], digest[order], steps[order]
                rows = [(b, packed_rest(tokens[i:j], wide), digest[i:j].tobytes(), steps[i:j].tobytes()) for b, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)) if j > i]
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "tokens", "digests", "steps"])

        for batch in slices(batches, size=SLICE):
            tokens, sizes = shingle_sets(texts_of(batch.column("text")), n)
            digest = _digest(tokens, sizes)
            new, seen = _new(digest, seen)
            keep = np.repeat(new, sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
            tokens = tokens[keep]
            low = tokens < np.uint64(SAMPLED)
            last = np.zeros(len(tokens), bool)
            last[low] = has_bit(packed.value, tokens[low] << np.uint64(2), FREQUENT_BITS)
            order = np.lexsort((tokens, last, owner))
            owner, tokens = owner[order], tokens[order]
            counts = sizes * new
            rank = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            prefix = rank < (sizes - _least_overlap(sizes, percent) + sizes // EXTRA + 1)[owner]
            steps = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.03)).astype(np.uint16)
            held.append((tokens[prefix], digest[owner[prefix]], steps[owner[prefix]]))
            size += int(prefix.sum())
            if size > 1 << 20:
                yield from flush()
                size = 0
        yield from flush()

    def runs(bucket: tuple, table: pa.Table) -> pa.Table:
        token = unpacked_rest(table.column("tokens").to_pylist())
        digest, step = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("digests", np.int64), ("steps", np.uint16)))
        step = step.astype(np.int64)
        order = np.lexsort((digest, step, token))
        token, digest, step = token[order], digest[order], step[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])
        token, digest, step = token[new], digest[new], step[new]
        # a set stays if its neighbour by size, before or behind, may be linked to it
        near = np.zeros(len(token) + 1, bool)
        near[1:-1] = (token[1:] == token[:-1]) & (step[1:] - step[:-1] <= reach)
        keep = near[1:] | near[:-1]
        token, digest = token[keep], digest[keep]
        _, place, counts = np.unique(token, return_inverse=True, return_counts=True)
        name = (token | np.uint64(bucket[0].as_py()) << np.uint64(40)).view(np.int64)
        return _freed(pa.table({"token": name, "digest": digest, "many": counts[place] >= FREQUENT if len(token) else np.zeros(0, bool)}), len(new))

    rows = docs.select("text").mapInArrow(run, "bucket long, tokens binary, digests binary, steps binary")
    return written(rows.groupBy("bucket").applyInArrow(runs, "token long, digest long, many boolean"), "shared")


def reaches(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """digest, n, reach, start of the sets of the rows (token, digest): a linked set that isn't larger has `reach` tokens at most, one that isn't smaller has `start` at least.

    Linked sets of overlap o list the first o - g tokens that they have in common in both prefixes, where g is the larger
    one's number of tokens beyond its prefix; a token of the smaller one's prefix may lie beyond the prefix of the larger.
    So each lists o - g tokens at least, and o follows from their sizes. Sets without a possible partner are left out.
    """
    sizes = members.groupBy("digest").agg(F.first("n_shingles").alias("n"))
    prefix = F.expr(f"n - (n * {percent} + 99) div 100 + n div {EXTRA} + 1")
    # where n div EXTRA has just grown, a slightly smaller set may have one more token beyond its prefix
    more = F.expr(f"CASE WHEN n % {EXTRA} < {-(-100 // percent)} THEN 1 ELSE 0 END")
    rest = F.col("n") - (F.least(prefix, F.col("n")) - F.col("common")) + more
    share = percent / (100 + percent)
    slope, most = percent / 100 - 1 / EXTRA - share, 0.99 - 1 / EXTRA  # g is below size * (percent / 100 - 1 / EXTRA) + most
    start = F.ceil((share * F.col("n") - most - F.col("common")) / slope - 1e-6) if slope > 0 else F.col("n")
    found = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("common")).join(sizes, "digest").withColumn("rest", rest)
    found = found.select("digest", "n", F.least("n", F.expr(f"(rest * {100 + percent}) div {percent} - n")).alias("reach"), F.greatest("n", start).alias("start"))
    return found.where((F.col("reach") * 100 >= F.col("n") * percent) | (F.col("start") * percent <= F.col("n") * 100))


def overlapping(shared: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The rows of sets that may be linked to another set of one of their prefix tokens, with n, reach and start. Written once.

    Two sets can only be linked if the smaller one's size is within the larger one's reach, and the larger one's from the
    smaller one's start on. For each token these are summed up by steps of a hundredth in size, so a token of any number
    of sets is held against a few hundred steps. What a set that falls out leaves behind may leave others short, so all
    of this is done twice.
    """
    shared = shared.withColumns({c: F.lit(0).cast("long") for c in ("n", "reach", "start")})
    step = F.floor(F.log("n") / np.log(1.03))
    for _ in range(2):
        wide = shared.drop("n", "reach", "start").join(reaches(shared, members, percent), "digest").withColumn("step", step)
        # whether a set may be the larger or the smaller one of a pair within its step; a step's sizes go by floating point, so a token more
        wide = wide.withColumns({"larger": F.col("reach") >= F.floor(F.pow(F.lit(1.03), "step")) - 1, "smaller": F.col("start") <= F.ceil(F.pow(F.lit(1.03), F.col("step") + 1)) + 1})
        # of each step: its sizes, largest reach, least start, and how many of its sets may be the one or the other
        steps = wide.groupBy("token", "step").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("top"), F.min("start").alias("low"), F.count_if("larger").alias("larger"), F.count_if("smaller").alias("smaller"))
        steps = steps.groupBy("token").agg(F.collect_list(F.struct("step", "least", "most", "top", "low", "larger", "smaller")).alias("steps"))
        others = lambda x, name: x[name] - F.col(name).cast("long") > 0
        beside = lambda x: F.col("smaller") & others(x, "larger") | F.col("larger") & others(x, "smaller")
        above = lambda x: (x["top"] >= F.col("n")) & (x["most"] >= F.col("start")) & (x["least"] * percent <= F.col("n") * 100)
        below = lambda x: (x["least"] <= F.col("reach")) & (x["low"] <= F.col("n")) & (x["most"] * 100 >= F.col("n") * percent)
        partner = F.exists("steps", lambda x: F.when(x["step"] == F.col("step"), beside(x)).otherwise(above(x) | below(x)))
        before, shared = shared, written(wide.join(steps, "token").where(partner).select("token", "digest", "many", "n", "reach", "start"), "overlapping")
        discard(before)
    return shared


def involved_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """digest, n, tokens (ascending unsigned 64-bit numbers) of the wanted digests. Written once."""

    packed = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "digest", INVOLVED_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, size=SLICE):
            tokens, sizes = shingle_sets(texts_of(batch.column("text")), n)
            digest, ends = _digest(tokens, sizes), np.cumsum(sizes)
            rows = []
            for k in np.flatnonzero(has_bit(packed.value, digest.view(np.uint64), INVOLVED_BITS) & (sizes > 0)).tolist():
                if (d := int(digest[k])) not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(d)
                    rows.append((d, int(sizes[k]), tokens[ends[k] - sizes[k] : ends[k]].tobytes()))
            d, m, t = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(m, pa.int64()), pa.array(t, pa.binary())], ["digest", "n", "tokens"])

    found = docs.mapInArrow(run, SETS).join(wanted, "digest", "left_semi")
    return written(found.groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")


class Group:
    """Sets of one group as a matrix over the union of their tokens, its entries in order of the union: the sets as 32-bit numbers, and where each token's begin."""

    def __init__(self, digests: np.ndarray, sizes: np.ndarray, raw: list[bytes]):
        self.digests, self.sizes = digests, sizes
        tokens = np.frombuffer(b"".join(raw), np.uint64)
        order = np.argsort(tokens)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        tokens = tokens[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)])
        self.union, self.starts = tokens[starts], np.append(starts, len(tokens)).astype(np.int32)

    def overlaps(self, sizes: np.ndarray, raw: list[bytes], low: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of other sets overlap the union by `low` percent of their own size; overlaps of those with each member)."""
        tokens = np.frombuffer(b"".join(raw), np.uint64)
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        here = self.union[at] == tokens
        opens = np.bincount(owner[here], minlength=len(sizes)) >= _least_overlap(sizes, low)
        keep = here & opens[owner]
        rows, columns = (np.cumsum(opens) - 1)[owner[keep]], at[keep]
        order = np.argsort(columns)
        return opens, self._product(rows[order], columns[order], int(opens.sum()))

    def _product(self, rows: np.ndarray, columns: np.ndarray, n: int, width: int = 1 << 13) -> np.ndarray:
        """Members that share each token of other sets, given in order of columns, summed in bands of the union."""
        out = np.zeros((n, len(self.sizes)), np.float32)
        for x in range(0, len(self.union), width):
            i = slice(*np.searchsorted(columns, [x, x + width]))
            if i.stop == i.start:
                continue
            starts = self.starts[x : x + width + 1]
            left, right = np.zeros((n, width), np.float32), np.zeros((len(self.sizes), width), np.float32)
            left[rows[i], columns[i] - x] = 1
            right[self.owner[starts[0] : starts[-1]], np.repeat(np.arange(len(starts) - 1), np.diff(starts))] = 1
            out += left @ right.T
        return out.astype(np.int64)

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Digests of the linked pairs, reduced to those that connect the group's components."""
        both = self._product(self.owner, np.repeat(np.arange(len(self.union), dtype=np.int32), np.diff(self.starts)), len(self.sizes))
        linked = both * 100 >= percent * (self.sizes[:, None] + self.sizes - both)
        return self.forest(*np.nonzero(np.triu(linked, 1)))

    def forest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = list(range(len(self.sizes)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        keep = []
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            if (x := find(x)) != (y := find(y)):
                root[y] = x
                keep.append(k)
        return self.digests[a[keep]], self.digests[b[keep]]


def _freed(made: pa.Table, n: int) -> pa.Table:
    """made, after a group of n tokens: what a large one has freed goes back at once, as groups come in one task after the other."""
    if n > FREED:
        release()
    return made


def _group(table: pa.Table) -> Group:
    return Group(table.column("digest").to_numpy(), table.column("n").to_numpy(), table.column("tokens").to_pylist())


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def within_groups(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links that connect the members of each group (digest, key, part), all pairs compared."""

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return LINKS.empty_table()
        group = _group(table)
        a, b = group.pairs(percent)
        return _freed(pa.table([pa.array(a), pa.array(b)], schema=LINKS), len(group.owner))

    return sets.join(groups, "digest").groupBy("key", "part").applyInArrow(run, "a long, b long")


def dealt(keys: DataFrame, turn: int) -> DataFrame:
    """digest, key, part, parts: documents with one key dealt out to groups of about GROUP."""
    key = F.col(f"key{turn}")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / (0.8 * GROUP), F.sum("n") / GROUP_TOKENS)).alias("parts")
    parts = keys.groupBy(key.alias("key")).agg(parts, F.count(F.lit(1)).alias("members")).where("members > 1")
    return keys.select("digest", key.alias("key")).join(parts, "key").select("digest", "key", F.pmod(F.xxhash64("digest", F.lit(turn)), "parts").alias("part"), "parts")


def unique_columns(x: np.ndarray) -> np.ndarray:
    """The distinct columns of a matrix."""
    x = x[:, np.lexsort(x)]
    new = np.ones(x.shape[1], bool)
    new[1:] = (x[:, 1:] != x[:, :-1]).any(0)
    return x[:, new]


def across_groups(shared: DataFrame, sets: DataFrame, groups: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different groups and components.

    Of two components the one with fewer sets (of equal ones the one with the lesser label) asks: its documents are held
    against the groups of the other's that share a prefix token with them.
    """
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    label = labels.join(sizes, "root").select(F.col("node").alias("digest"), "root", "members")
    # a document in no group is a group of its own
    where = sets.select("digest").join(groups.select("digest", "key", "part"), "digest", "left").join(label, "digest", "left")
    where = written(where.select("digest", F.coalesce("key", "digest").alias("key"), F.coalesce("part", F.lit(-1).cast("long")).alias("part"), F.coalesce("root", "digest").alias("root"), F.coalesce("members", F.lit(1).cast("long")).alias("members")), "where")
    rows = shared.select("token", "digest", "n", "reach", "start").join(where, "digest")
    number, spark = ["token", "digest", "n", "reach", "start", "key", "part", "root", "members"], shared.sparkSession

    wide = max(4, bucket_bits(spark) - 2)

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document with the groups of components of higher rank in which one of a token's sets may be linked to it, by size, reach and start."""
        rest, found = np.zeros((len(number), 0), np.int64), []

        def close(rows: np.ndarray) -> None:
            digest, n, reach, start, key, part, root, members = rows[1:]
            least, most = -(-n * percent // 100), n * 100 // percent
            order = np.lexsort((n, part, key))
            starts = np.flatnonzero(np.append(True, (np.diff(key[order]) != 0) | (np.diff(part[order]) != 0)))
            for group in np.split(order, starts[1:]):
                rank = max(zip(members[group].tolist(), root[group].tolist(), strict=True))
                lower = (members < rank[0]) | ((members == rank[0]) & (root < rank[1]))
                lower &= (key != key[group[0]]) | (part != part[group[0]])
                # larger ones: the largest reach of those that aren't too large, and whether one is large enough
                high = np.searchsorted(n[group], most, "right")
                top = np.append(np.int64(-1), np.maximum.accumulate(reach[group]))[high]
                above = (top >= n) & (np.searchsorted(n[group], start) < high)
                # smaller ones: whether there is one within the reach
                below = np.searchsorted(n[group], reach, "right") > np.searchsorted(n[group], least)
                some = digest[lower & (above | below)]
                found.append(np.stack([some, np.full(len(some), key[group[0]]), np.full(len(some), part[group[0]])]))

        def close_all(rows: np.ndarray, starts: np.ndarray) -> None:
            """Of the tokens that begin at `starts`, those that several components have."""
            ends = np.append(starts[1:], rows.shape[1])
            several = np.maximum.reduceat(rows[7], starts) != np.minimum.reduceat(rows[7], starts)
            for x, y in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                close(rows[:, x:y])

        def flush() -> pa.RecordBatch:
            out = unique_columns(np.concatenate(found, axis=1)) if found else np.zeros((3, 0), np.int64)
            found.clear()
            order, bounds = dealt_by_range(out[0].view(np.uint64), wide)
            some = [(b, out[:, order[x:y]].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
            b, t = zip(*some, strict=True) if some else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(t, pa.binary())], ["bucket", "asks"])

        for batch in batches:
            rows = np.concatenate([rest, np.stack([batch.column(c).to_numpy() for c in number])], axis=1)
            starts = np.flatnonzero(np.append(True, np.diff(rows[0]) != 0)) if rows.shape[1] else np.zeros(0, np.int64)
            if len(starts) > 1:
                close_all(rows[:, : starts[-1]], starts[:-1])
                rows = rows[:, starts[-1] :].copy()
            rest = rows
            if sum(x.shape[1] for x in found) > 500_000:
                yield flush()
        if rest.shape[1]:
            close_all(rest, np.zeros(1, np.int64))
        yield flush()
        release()

    def once(table: pa.Table) -> pa.Table:
        out = unique_columns(np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in table.column("asks").to_pylist()], axis=1))
        return _freed(pa.table([pa.array(x) for x in out], ["digest", "key", "part"]), out.size)

    named = rows.select(*(F.col(c).cast("long").alias(c) for c in number)).repartition("token").sortWithinPartitions("token").mapInArrow(asks, "bucket long, asks binary")
    named = named.groupBy("bucket").applyInArrow(once, "digest long, key long, part long")
    tops = where.groupBy("key", "part").agg(F.max(F.struct("members", "root")).alias("top"))
    own = where.select("digest", F.struct("members", "root").alias("rank"))
    asked = named.join(tops, ["key", "part"]).join(own, "digest")
    asked = written(asked.where(F.col("top") > F.col("rank")).select("digest", "key", "part"), "asked")
    discard(shared)
    # the documents that ask one group are dealt out too; its members go to each lot
    lots = asked.join(sets.select("digest", "n"), "digest").groupBy("key", "part").agg(F.ceil(F.greatest(F.count(F.lit(1)) / LOT, F.sum("n") / LOT_TOKENS)).alias("lots"))
    asking = asked.join(lots, ["key", "part"]).select("digest", "key", "part", F.pmod(F.xxhash64("digest"), "lots").alias("lot")).join(sets, "digest").join(where.select("digest", "root"), "digest")
    members = where.join(lots, ["key", "part"]).select("digest", "key", "part", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("lot")).join(sets, "digest")

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LINKS.empty_table()
        group, roots = _group(right), right.column("root").to_numpy()
        a, b = [], []
        for k in range(0, left.num_rows, 256):
            part = left.slice(k, 256)
            digests, sizes, own = part.column("digest").to_numpy(), part.column("n").to_numpy(), part.column("root").to_numpy()
            opens, both = group.overlaps(sizes, part.column("tokens").to_pylist(), percent)
            digests, sizes, own = digests[opens], sizes[opens], own[opens]
            linked = (both * 100 >= percent * (sizes[:, None] + group.sizes - both)) & (own[:, None] != roots)
            i, j = np.nonzero(linked)
            _, first = np.unique(np.stack([own[i], roots[j]]), axis=1, return_index=True) if len(i) else (None, [])
            a.append(digests[i[first]])
            b.append(group.digests[j[first]])
        return _freed(pa.table([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], schema=LINKS), len(group.owner))

    grouping = ["key", "part", "lot"]
    members = members.toDF(*(f"member_{c}" for c in members.columns)).toDF(*members.columns)  # columns of its own, for the cogroup
    return asking.groupBy(*grouping).cogroup(members.groupBy(*grouping)).applyInArrow(opened, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the least doc_id that links lead to, the row's own included.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct n-word shingles, or all its
    words as one if they are fewer. Sets are linked if 100 * intersection >= percent * union, exactly. A null or blank
    text has an empty set, linked with nothing. Repeated rows come back once each. A null id comes back as null and
    counts in no minimum unless all its component's ids are null. Empty tables give no rows.
    """
    docs = id_text(docs, id_col, text_col)
    members = memberships(docs, n)
    shared = overlapping(shared_tokens(docs, n, percent, frequent_table(docs, n)), members, percent)
    first = lambda turn: F.min(F.struct(~F.col("many"), F.xxhash64("token", F.lit(turn)), "token"))["token"].alias(f"key{turn}")
    keys = written(shared.groupBy("digest").agg(F.first("n").alias("n"), first(1), first(2), first(3)), "keys")
    sets = involved_sets(docs, n, keys.select("digest"))
    groups = written(dealt(keys, 1), "groups")
    links = within_groups(sets, groups, percent)
    split = groups.where("parts > 1").select("digest")  # only these need other groups to find their component
    for turn in (2, 3):
        links = links.unionByName(within_groups(sets, dealt(keys.join(split, "digest", "left_semi"), turn), percent))
    links = written(links, "within")
    more = across_groups(shared, sets, groups, components(links), percent)
    labels = components(links.unionByName(more))
    rows = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "digest")).alias("label"))
    least = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that bear the least id of their component. Rows of null ids stay."""
    name = unused(docs, "papyra_kept_id")
    found = jaccard_components(docs, n, percent, id_col, text_col)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
