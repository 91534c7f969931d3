"""Nearest neighbours by a block matrix product over int8 tiles with error bounds.

Groups of queries meet lanes of candidates in a grid of cells, one task each. A task packs its vectors into int8 codes,
one step width per vector, with the exact norm of what rounding lost. A tile of queries and candidates is one product of
codes and norms, which gives each inner product's upper bound; pairs whose bound reaches the query's k-th best so far are
computed again in double precision and kept in heaps, which a last shuffle merges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import int_lists, release

#: Vectors of a tile's sides. A tile takes some 5 bytes for each pair of a query and a candidate.
CANDIDATES, QUERIES = 2048, 1024
#: Numbers (vectors times dimensions) that travel as one row.
CHUNK = 1 << 16
#: Numbers that the queries of a task and their heaps may have: some 200 MB.
HELD = 1 << 24
#: Multiplications that a task should have, at least (else fewer tasks than cores) and at most.
LEAST, MOST = 1 << 29, 1 << 41
#: Candidates that tell a query's first bound.
FIRST = 1024
#: Pairs that are merged at once, numbers that are multiplied at once, rows that the last merge holds beside its heaps.
PAIRS, NUMBERS, ROWS = 1 << 18, 1 << 19, 1 << 20
LARGEST, SMALLEST = np.finfo(float).max, np.finfo(float).smallest_subnormal
#: What stands after all ids in a heap that isn't full.
NO_ID = np.iinfo(np.int64).max


def _narrow(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector; single precision stays so, everything else becomes double."""
    kind = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))


def usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each dimension, of the rows that take part: not null, of finite components, not all zero."""
    batch = batch.filter(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("vector"))))
    lists, ids = batch.column("vector"), batch.column("vec_id").to_numpy()
    lengths, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        v = flat.reshape(len(ids), dim) if len(rows) == len(ids) else flat[starts[rows, None] + np.arange(dim)]
        ok = np.isfinite(v).all(1) & v.any(1)
        yield ids[rows[ok]], v[ok]


def chunks(vectors: DataFrame, parts: int) -> DataFrame:
    """part, dim, ids, vectors: the usable vectors of each partition packed by dimension, without a shuffle; packs go to the parts in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part = TaskContext.get().partitionId()

        def closed(dim: int) -> pa.RecordBatch:
            nonlocal part
            ids, v = map(np.concatenate, zip(*open_.pop(dim), strict=True))
            part += 1
            row = [([part % parts], pa.int32()), ([dim], pa.int32()), ([ids.tobytes()], pa.binary()), ([v.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in row], ["part", "dim", "ids", "vectors"])

        for batch in batches:
            for ids, v in usable(batch):
                dim, first = v.shape[1], 0
                while first < len(ids):
                    got = open_.setdefault(dim, [])
                    end = first + max(1, CHUNK // dim) - sum(len(x) for x, _ in got)
                    got.append((ids[first:end], v[first:end]))
                    if end <= len(ids):
                        yield closed(dim)
                    first = end
        for dim in list(open_):
            yield closed(dim)
        release()

    return vectors.mapInArrow(run, "part int, dim int, ids binary, vectors binary")


def best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query with their ranks from 0, ordered by query, descending score and ascending id."""
    order = np.lexsort((vec_id, -score, query))
    query, score, vec_id = query[order], score[order], vec_id[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
    keep = rank < k
    return query[keep], score[keep], vec_id[keep], rank[keep]


class Side:
    """Vectors of one dimension: ids, the vectors, and in units of 2^exps (so that nothing overflows) what their int8 codes stand for, its norm, and the norm of what rounding lost."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray]]):
        self.ids, self.vectors = map(np.concatenate, zip(*packs, strict=True))
        self.dim = self.vectors.shape[1]
        self.kind = np.float32 if self.dim <= 1 << 16 else np.float64

    def coded(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        self.exps = np.zeros(len(self.ids), np.int32)
        norm = lambda x: np.sqrt((x * x).sum(1))
        step = max(1, NUMBERS // self.dim)
        for part in (slice(k, k + step) for k in range(0, len(self.ids), step)):
            v = self.vectors[part].astype(float)
            self.exps[part] = np.frexp(np.abs(v).max(1))[1]
            v = np.ldexp(v, -self.exps[part, None])
            steps = np.abs(v).max(1, keepdims=True) / 127
            near = np.rint(v / steps).astype(np.int8) * steps
            yield part, near, norm(near), norm(v - near)


class Candidates(Side):
    """rows: code values, norm of the vector at most, lost; in units of 2^top."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray]]):
        super().__init__(packs)
        self.rows = np.empty((len(self.ids), self.dim + 2), self.kind)
        parts = list(self.coded())
        self.top = int(self.exps.max())
        for part, near, norm, lost in parts:
            self.rows[part] = np.ldexp(np.column_stack([near, norm + lost, lost]), (self.exps[part] - self.top)[:, None])
        self.vectors = self.vectors.astype(float)


class Queries(Side):
    """rows: code values, lost, norm; times a candidate's row, the inner product's upper bound. scores and found: each query's heap, best first."""

    def __init__(self, packs: list[tuple[np.ndarray, np.ndarray]], k: int):
        super().__init__(packs)
        self.rows = np.empty((len(self.ids), self.dim + 2), self.kind)
        slack = 1e-9 + 1.1 * (self.dim + 16) * float(np.finfo(self.kind).eps)  # rounding of the sums, here and in scores
        for part, near, norm, lost in self.coded():
            self.rows[part] = np.column_stack([near, lost + slack * (norm + lost), norm])
        self.k, self.counts = k, np.zeros(len(self.ids), np.int64)
        self.scores, self.found = np.full((len(self.ids), k), -np.inf), np.full((len(self.ids), k), NO_ID)

    def _floor(self, part: slice, c: Candidates) -> np.ndarray:
        """What a pair's upper bound has to reach, in units of 2^(exps + top)."""
        k, full, away = self.k, self.counts[part] == self.k, -(self.exps[part].astype(np.int64) + c.top)
        floor = np.full(len(full), -np.inf)
        if not full.all() and min(FIRST, len(c.ids)) > k:
            rows = self.rows[part].copy()
            rows[:, self.dim :] *= -1
            low = rows @ c.rows[:FIRST].T
            low[self.ids[part, None] == c.ids[:FIRST]] = -np.inf
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k].astype(float)
            most = np.ldexp(LARGEST, away)  # what lies beyond is infinite and ranks by id
            floor = np.where(floor <= -most, -np.inf, np.minimum(floor, most))
        floor[full] = np.ldexp(np.minimum(self.scores[part, k - 1], LARGEST), away)[full]
        floor -= np.ldexp(8 * self.dim * SMALLEST, away) + 1e-30  # what underflows, in scores and in the tile
        floor[np.isnan(floor)] = -np.inf
        return np.nextafter(floor.astype(self.kind), self.kind(-np.inf))[:, None]

    def meet(self, c: Candidates) -> None:
        """Every query meets every candidate."""
        room = [np.empty(min(QUERIES, len(self.ids)) * len(c.ids), t) for t in (self.kind, bool)]
        for first in range(0, len(self.ids), QUERIES):
            part = slice(first, first + QUERIES)
            rows = self.rows[part]
            size = len(rows) * len(c.ids)
            tile, reach = room[0][:size], room[1][:size]
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                np.matmul(rows, c.rows.T, out=tile.reshape(len(rows), -1))
                np.greater_equal(tile.reshape(len(rows), -1), self._floor(part, c), out=reach.reshape(len(rows), -1))
            if len(reach) % 8:
                places = np.flatnonzero(reach)
            else:  # eight pairs at a time, as most don't
                some = np.flatnonzero(reach.view(np.uint64))
                word, at = np.nonzero(reach.reshape(-1, 8)[some])
                places = some[word] * 8 + at
            for k in range(0, len(places), PAIRS):
                row, column = np.divmod(places[k : k + PAIRS], len(c.ids))
                row += first
                other = self.ids[row] != c.ids[column]
                self._keep(row[other], column[other], c)

    def _scores(self, row: np.ndarray, column: np.ndarray, c: Candidates) -> np.ndarray:
        out, step = np.empty(len(row)), max(1, NUMBERS // self.dim)
        with np.errstate(over="ignore", invalid="ignore"):
            for k in range(0, len(row), step):
                some = slice(k, k + step)
                out[some] = (self.vectors[row[some]] * c.vectors[column[some]]).sum(1)
            large = np.flatnonzero(~np.isfinite(out))
            for k in range(0, len(large), step):  # products that overflow may cancel out
                some = large[k : k + step]
                small = (np.ldexp(self.vectors[row[some]].astype(float), -540) * np.ldexp(c.vectors[column[some]], -540)).sum(1)
                out[some] = np.ldexp(small, 1080)
        return out

    def _keep(self, row: np.ndarray, column: np.ndarray, c: Candidates) -> None:
        """Pairs, ordered by query, join the heaps."""
        score, vec_id = self._scores(row, column, c), c.ids[column]
        last, its_id = self.scores[row, -1], self.found[row, -1]
        keep = (self.counts[row] < self.k) | (score > last) | ((score == last) & (vec_id < its_id))
        row, score, vec_id = row[keep], score[keep], vec_id[keep]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        counts = np.diff(first, append=len(row))
        at = np.arange(len(row)) - np.repeat(first, counts)
        width = max(self.k, 2 * len(row) // max(1, len(first)))
        for k in range(0, counts.max(initial=0), width):  # a query with many more pairs than others takes further turns
            some = (at >= k) & (at < k + width)
            self._merge(row[some], at[some] - k, score[some], vec_id[some])

    def _merge(self, row: np.ndarray, at: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        """at: a pair's place, from 0, among its query's pairs."""
        new, k = at == 0, self.k
        touched, line = row[new], np.cumsum(new) - 1
        scores, found = (np.concatenate([x[touched], np.full((len(touched), at.max() + 1), none)], axis=1) for x, none in ((self.scores, -np.inf), (self.found, NO_ID)))
        scores[line, k + at], found[line, k + at] = score, vec_id
        order = np.lexsort((found, -scores), axis=-1)[:, :k]
        self.scores[touched], self.found[touched] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
        self.counts[touched] = np.minimum(k, self.counts[touched] + np.bincount(line))

    def out(self) -> Iterator[pa.RecordBatch]:
        """query_id, vec_ids, scores."""
        for k in range(0, len(self.ids), QUERIES):
            part = slice(k, k + QUERIES)
            held = np.arange(self.k) < self.counts[part, None]
            some, counts = self.counts[part] > 0, self.counts[part]
            lists = [int_lists(x[part][held], counts[some], t) for x, t in ((self.found, pa.int64()), (self.scores, pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[part][some]), *lists], ["query_id", "vec_ids", "scores"])


def grid(candidates: DataFrame, queries: DataFrame, k: int) -> tuple[int, int]:
    """(groups of queries, lanes of candidates): as many cells as there is work for, each group small enough for a task, and as little as possible to shuffle."""
    n_queries, of_queries = queries.agg(F.count("vector"), F.sum(F.size("vector")).cast("double")).first()
    n = candidates.count()
    if not n or not of_queries:
        return 1, 1
    work, heaps = n * of_queries, k * n_queries
    cells = max(work / MOST, min(3 * candidates.sparkSession.sparkContext.defaultParallelism, work / LEAST), 1)
    # a lane more costs each query its way through the shuffle, and filling another heap; a group more costs the candidates' way
    groups = max(1, math.ceil((of_queries + 2 * heaps) / HELD), round(min(cells, math.sqrt(cells * (of_queries + 16 * heaps) * n_queries / (n * of_queries)))))
    return groups, math.ceil(cells / groups)


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lanes: int | None = None, groups: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest candidates by largest inner product, exact.

    All candidates if there are fewer than k. Ties go to the smaller vec_id. A candidate with the query's own id takes
    no part, nor do vectors that are null, all zero, or hold null or non-finite components. Only vectors of equal length
    meet. An inner product beyond the range of doubles counts as infinite. A repeated candidate row counts each time, a repeated query row
    once; an id with several query vectors gets the best over all of them. Empty tables give no rows.

    Queries travel once for each lane of candidates and candidates once for each group of queries; both follow from the
    tables' sizes unless given. A task holds its group's queries and heaps, and a tile.
    """
    c, q = _narrow(candidates, id_col, vector_col), _narrow(queries, id_col, vector_col)
    kinds = [np.dtype(np.float32 if dict(x.dtypes)["vector"] == "array<float>" else float) for x in (q, c)]
    if lanes is None or groups is None:
        own = grid(c, q, k)
        groups, lanes = groups or own[0], lanes or own[1]

    group, lane = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(lanes - 1))
    packed = lambda side, rows, parts, cells: chunks(rows, parts).select(F.lit(side).alias("side"), F.explode(cells).alias("cell"), "dim", "ids", "vectors")
    both = packed(0, q.distinct(), groups, F.transform(lane, lambda x: F.col("part") * lanes + x)).union(packed(1, c, lanes, F.transform(group, lambda x: x * lanes + F.col("part"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell, queries first."""
        open_: tuple[dict[int, list], dict[int, list]] = ({}, {})
        met: dict[int, Queries] = {}

        def meet(dim: int) -> None:
            packs = open_[1].pop(dim)
            if dim in open_[0]:
                met[dim] = Queries(open_[0].pop(dim), k)
            if dim in met:
                met[dim].meet(Candidates(packs))

        def closed() -> Iterator[pa.RecordBatch]:
            for dim in list(open_[1]):
                meet(dim)
            open_[0].clear()
            while met:
                yield from met.popitem()[1].out()

        now = None
        for batch in batches:
            for n, (cell, side, dim) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("cell", "side", "dim")), strict=True)):
                if cell != now:
                    yield from closed()
                    now = cell
                ids, vectors = (batch.column(x)[n].as_buffer() for x in ("ids", "vectors"))
                got = open_[side].setdefault(dim, [])
                got.append((np.frombuffer(ids, np.int64), np.frombuffer(vectors, kinds[side]).reshape(-1, dim)))
                if side and sum(len(x) for x, _ in got) >= CANDIDATES:
                    meet(dim)
        yield from closed()
        release()

    tiles = both.repartitionById(groups * lanes, "cell").sortWithinPartitions("cell", "side").mapInArrow(run, "query_id long, vec_ids array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        most = ROWS

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            return best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)

        for batch in batches:
            lists = batch.column("vec_ids")
            parts.append((np.repeat(batch.column("query_id").to_numpy(), lists.value_lengths().to_numpy()), batch.column("scores").flatten().to_numpy(), lists.flatten().to_numpy()))
            if sum(len(x[0]) for x in parts) > most:
                parts[:] = [merged()[:3]]
                most = max(ROWS, 2 * len(parts[0][0]))
        query, score, vec_id, rank = merged()
        for k_ in range(0, len(query), 10_000):
            part = slice(k_, k_ + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(query[part]), pa.array(rank[part] + 1, pa.int32()), pa.array(vec_id[part]), pa.array(score[part])], ["query_id", "rank", "vec_id", "score"])
        release()

    return tiles.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
