"""Languages by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs, drawn from its code point. An n-gram's vector binds the vectors of
its letters, each permuted by its place, by multiplication. A document bundles the vectors of its n-grams; a language's
profile bundles those of all its training texts, each weighted by the root of how often it occurs there, so that copies
and frequent lines don't drown the rest. The language whose profile has the largest cosine with the document is told.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import slices, texts_of, written
from papyra.llm.terms import folded, in_parts
from papyra.llm.words import GRAM, mix

#: Signs of a vector; letters of an n-gram, word boundaries among them.
DIMENSIONS, LETTERS = 2048, 3
#: Profiles that are broadcast together (8 bytes a sign: 16 MB at most); further languages take a further turn.
PROFILES = 1024
#: Text that is read at once when learning and when documents are compared; documents and n-grams of one matrix product.
LEARNED, SLICE, DOCUMENTS, GRAMS = 4 << 20, 1 << 19, 256, 4096
#: Weights are whole numbers of this fraction, so that sums don't depend on their order.
FINE = 16
#: A profile travels in pieces of this many signs.
PIECE = 256
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(texts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of the distinct n-grams of texts: three letters of a word in lower case, or two beside its begin or end, as 21 bits each."""
    lower = [x.lower() for x in texts]
    begins = np.cumsum([1, *(len(x) + 1 for x in lower)])
    points = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le"), np.uint32).astype(np.int64)
    is_letter = letters()[points]
    keep = np.append(True, is_letter[1:] | is_letter[:-1])  # of several characters between words one stands for all
    at = np.flatnonzero(keep)
    points = np.where(is_letter, points, 0)[at]
    middle = np.flatnonzero(points[1:-1] > 0) + 1
    codes = points[middle - 1] << 42 | points[middle] << 21 | points[middle + 1]
    owner = np.array(owners, np.int64)[np.searchsorted(begins, at[middle], "right") - 1]
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return owner[first], codes[first], np.diff(np.append(first, len(codes)))


def gathered(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """grams() of texts that may be long: they are read in parts of about `size` bytes. Owners are positions."""
    held, owners, total, found = [], [], 0, []
    for k, text in enumerate(texts):
        for part in in_parts(text, size, bytes(range(65))):
            held.append(part)
            owners.append(k)
            total += len(part)
            if total >= size:
                found.append(grams(held, owners))
                held, owners, total = [], [], 0
    if held:
        found.append(grams(held, owners))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    owner, codes, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((codes, owner))
    owner, codes, counts = owner[order], codes[order], counts[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return owner[first], codes[first], np.add.reduceat(counts, first) if len(first) else counts


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The signs of each code point (0: the boundary of a word), as int8 rows."""
    words = np.arange(dimensions // 64, dtype=np.uint64)
    bits = mix(mix(points.astype(np.uint64) + GRAM)[:, None] + words * GRAM)
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def bound(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of each n-gram: its letters' vectors, rolled by their places, multiplied."""
    points, place = np.unique(np.concatenate([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]), return_inverse=True)
    own, place = letter_vectors(points, dimensions), place.reshape(3, -1)
    out = own[place[2]]
    for k in (1, 2):
        out *= np.roll(own, k, axis=1)[place[2 - k]]
    return out


def learned_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over documents (lang, text); both aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=LEARNED):
            column = batch.column("lang").dictionary_encode()
            lang, names = column.indices.to_numpy().astype(np.int64), column.dictionary
            owner, codes, counts = gathered(texts_of(batch.column("text")), LEARNED)
            unique, place = np.unique(codes, return_inverse=True)
            keys, n = folded(lang[owner] * max(1, len(unique)) + place, counts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(keys // max(1, len(unique)))), pa.array(unique[keys % max(1, len(unique))]), pa.array(n)], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """lang, piece, signs: the profile of each language, in pieces of PIECE sums of 64 bits; written once.

    Rows whose language or text is null teach nothing; languages of which no text has a letter have no profile. All rows
    are learned from, and repeated rows count each.
    """
    pairs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    weight = F.round(F.sqrt("n") * FINE).cast("long").alias("weight")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            column = batch.column("lang").dictionary_encode()
            codes, lang, weights = batch.column("gram").to_numpy(), column.indices.to_numpy(), batch.column("weight").to_numpy()
            for a in range(0, len(codes), GRAMS):
                vectors = bound(codes[a : a + GRAMS], dimensions)
                for k in np.unique(lang[a : a + GRAMS]).tolist():
                    of = lang[a : a + GRAMS] == k
                    name = column.dictionary[k].as_py()
                    # sums of whole numbers below 2^53 are exact
                    sums[name] = sums.get(name, 0) + (weights[a : a + GRAMS][of].astype(np.float64) @ vectors[of].astype(np.float64)).astype(np.int64)
            if len(sums) >= PROFILES:
                yield pieces(sums)
                sums = {}
        if sums:
            yield pieces(sums)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("signs").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "piece": pa.array([key[1].as_py()], pa.int64()), "signs": pa.array([total.tobytes()], pa.binary())})

    kind = "lang string, piece long, signs binary"
    partial = learned_grams(pairs).select("lang", "gram", weight).mapInArrow(bundle, kind)
    return written(partial.groupBy("lang", "piece").applyInArrow(add, kind), "profiles")


def pieces(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The sums of each language, cut in pieces."""
    rows = [(name, k, x[a : a + PIECE].tobytes()) for name, x in sums.items() for k, a in enumerate(range(0, len(x), PIECE))]
    name, k, raw = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(k, pa.int64()), pa.array(raw, pa.binary())], ["lang", "piece", "signs"])


def profile_blocks(profiles: DataFrame, most: int = PROFILES) -> Iterator[tuple[list[str], np.ndarray]]:
    """(languages, their profiles as unit rows), in blocks of about `most` languages, each ordered by name in UTF-8."""
    languages = profiles.select("lang").distinct().count()
    blocks = -(-languages // most)
    for b in range(blocks):
        rows = profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).toArrow().to_pylist()
        if names := sorted({x["lang"] for x in rows}, key=str.encode):
            parts = {(x["lang"], x["piece"]): np.frombuffer(x["signs"], np.int64) for x in rows}
            whole = [np.concatenate([parts[name, k] for k in range(sum(x[0] == name for x in parts))]) for name in names]
            matrix = np.array(whole, np.float64)
            yield names, (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def cosines(texts: list[str], profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cosines of each text with each profile, whether it has a letter)."""
    owner, codes, counts = gathered(texts, LEARNED)
    out, some = np.zeros((len(texts), len(profiles))), np.zeros(len(texts), bool)
    some[owner] = True
    for first in range(0, len(texts), DOCUMENTS):
        a, b = np.searchsorted(owner, [first, first + DOCUMENTS])
        unique, place = np.unique(codes[a:b], return_inverse=True)
        documents = np.zeros((min(DOCUMENTS, len(texts) - first), profiles.shape[1]), np.float32)
        for g in range(0, len(unique), GRAMS):
            of = (place >= g) & (place < g + GRAMS)
            times = np.zeros((len(documents), min(GRAMS, len(unique) - g)), np.float32)
            times[owner[a:b][of] - first, place[of] - g] = counts[a:b][of]
            documents += times @ bound(unique[g : g + GRAMS], profiles.shape[1]).astype(np.float32)
        norm = np.sqrt(np.einsum("ij,ij->i", documents, documents, dtype=np.float64))
        out[first : first + len(documents)] = (documents @ profiles.T) / np.maximum(norm, 1e-300)[:, None]
    return out, some


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PROFILES) -> DataFrame:
    """doc_id, lang_pred, score: the language whose profile lies nearest to each text, and the cosine, 0 at least; one row per input row.

    Null texts and texts without a letter, and all texts where nothing was learned, are `und` with a score of 0. Of equal
    cosines the lesser name in UTF-8 order counts. Ids aren't looked at: null and repeated ones keep their rows. Profiles
    are broadcast in blocks of a bounded size, each compared in turn where the documents lie.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(-2.0).alias("score"))
    kind = "doc_id long, text string, lang_pred string, score double"
    for block in profile_blocks(profiles, most):
        rows = rows.mapInArrow(_compare(docs.sparkSession.sparkContext.broadcast(block)), kind)
    return rows.select("doc_id", "lang_pred", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))


def _compare(shared):
    """The task that keeps the better of what a row has and the best of one block of profiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in slices(batches, size=SLICE):
            found, some = cosines(texts_of(batch.column("text")), matrix)
            best = found.argmax(axis=1)
            value = np.round(found[np.arange(len(best)), best], 6)
            before, held = batch.column("score").to_numpy(), batch.column("lang_pred").to_pylist()
            own = [names[k] for k in best]
            better = [bool(s) and (v > b or v == b and n.encode() < h.encode()) for s, v, b, n, h in zip(some, value, before, own, held, strict=True)]
            lang = [n if x else h for x, n, h in zip(better, own, held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(lang, pa.string()), pa.array(np.where(better, value, before))], ["doc_id", "text", "lang_pred", "score"])

    return run


def training(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 5, is not 0."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
