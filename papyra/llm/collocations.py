"""Collocations by generalised suffix automata over shards of documents.

A shard is a bounded run of documents whose words are numbered by language. Its automaton holds every substring of up to
DEPTH words of its pieces as a node: the node of its first words is its parent, the node without its first word its
suffix link, and its count the size of its set of end positions, summed over suffix links. A node with the same count as
its link has the same end positions, so both are one state.

Shards tell the hashes and counts of their nodes by ranges of hashes, as packed differences of as many bits as the number
of all nodes asks for; the answer is a bit for each, whether it may reach LEAST in all. Only such nodes go on as strings,
whose counts are then exact: hashes decide what is sent, never what is counted. Candidates find their parts, and the shorter phrases that they subsume, along parents and suffix links.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import bucket_bits, release, slices, written
from papyra.llm.terms import coded, encoded, in_parts, spans
from papyra.llm.words import GRAM, hash_spans, mix

#: Words of the longest phrase, the least count of a candidate, rows of a language, and the percentage of subsumption.
DEPTH, LEAST, TOP, SHARE = 3, 10, 2000, 50
#: Words of a shard, about; bytes of text that are read into it at once.
SHARD, SLICE = 1 << 20, 4 << 20
#: Shards whose phrases one task sends, about: what several of them hold is sent once.
TOGETHER = 6
#: Nodes that one task answers for, about; hashes have SPARE bits more than nodes need to be numbered.
ANSWERED, SPARE = 1 << 19, 8
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(STOPS)] = 2
SHARD_ROW = "shard long, langs array<string>, words array<string>, lang_of binary, letters binary, begins binary"
#: A language and a phrase in one string; phrases hold no line feed.
PHRASE = "key string, n long"


class Automaton(NamedTuple):
    """Nodes by depth, those of one word first: the word each ends with, parent, suffix link and count; both are -1 for the root."""

    depth: np.ndarray
    letter: np.ndarray
    parent: np.ndarray
    link: np.ndarray
    count: np.ndarray

    def state(self) -> np.ndarray:
        """The longest node of each node's state."""
        out = np.arange(len(self.depth))
        same = np.flatnonzero((self.link >= 0) & (self.count == self.count[self.link]))
        for depth in range(2, int(self.depth.max(initial=0)) + 1):
            longer = same[self.depth[same] == depth]
            out[self.link[longer]] = longer
        for _ in range(int(self.depth.max(initial=0))):
            out = out[out]
        return out


def automaton(letters: np.ndarray, begins: np.ndarray, alphabet: int, depth: int = DEPTH) -> Automaton:
    """The automaton of pieces: letters (below alphabet) one piece after the other, begins: whether a piece begins at each."""
    piece = np.cumsum(begins)
    letters, node = letters.astype(np.int64), letters.astype(np.int64)  # node: of the substring of the present depth from each place, -1 across an end
    columns = [(np.ones(alphabet, np.int8), np.arange(alphabet, dtype=np.int32), np.full(alphabet, -1, np.int32), np.full(alphabet, -1, np.int32))]
    before, total, initial = np.full(len(letters), -1), alphabet, [np.bincount(letters[begins], minlength=alphabet)]
    for k in range(1, depth):
        n = max(0, len(letters) - k)
        at = np.flatnonzero((piece[:n] == piece[k:]) & (node[:n] >= 0))
        keys = node[at] * alphabet + letters[at + k]
        unique, place = np.unique(keys, return_inverse=True)
        before, node = node, np.full(len(letters), -1)
        node[at] = place + total
        link = np.zeros(len(unique), np.int32)
        link[place] = before[at + 1]
        columns.append((np.full(len(unique), k + 1, np.int8), (unique % alphabet).astype(np.int32), (unique // alphabet).astype(np.int32), link))
        initial.append(np.bincount(place[begins[at]], minlength=len(unique)))
        total += len(unique)
    out = [np.concatenate(x) for x in zip(*columns, strict=True)]
    # end positions: occurrences with which a piece begins, and those of the nodes that link here
    count = np.concatenate(initial)
    for k in range(depth, 1, -1):
        longer = np.flatnonzero(out[0] == k)
        if k == depth:  # the deepest nodes are linked to by none: they are counted where they lie
            count[longer] = np.bincount(node[node >= 0], minlength=total)[longer]
        count += np.bincount(out[3][longer], count[longer], total).astype(np.int64)
    if depth == 1:
        count = np.bincount(letters, minlength=alphabet)
    return Automaton(*out, count)


def hashes_of(found: Automaton, words: pa.Array, langs: pa.Array, lang_of: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each node's language and words, the same in all shards."""
    raw, offsets = _bytes(words)
    out = np.zeros(len(found.depth), np.uint64)
    lang_raw, lang_offsets = _bytes(langs)
    own = mix(hash_spans(raw, offsets[:-1], offsets[1:]) + mix(hash_spans(lang_raw, lang_offsets[:-1], lang_offsets[1:]))[lang_of])
    for depth in range(1, int(found.depth.max(initial=0)) + 1):
        at = np.flatnonzero(found.depth == depth)
        out[at] = own[found.letter[at]] if depth == 1 else mix(out[found.parent[at]] * GRAM + own[found.letter[at]])
    return out


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, with one more, and offsets."""
    whole = strings.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.append(data, np.uint8(10)), offsets - offsets[0]


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as their lowest bytes, then their second bytes and so on: the high ones of small numbers compress to nothing."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    """The numbers of planes()."""
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def shards(docs: DataFrame) -> DataFrame:
    """SHARD_ROW of documents (lang, text), written once: languages, distinct words by language, numbers of all words, and where pieces begin."""
    most = SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, held, size = TaskContext.get().partitionId() << 24, 0, [], 0
        for batch in slices(batches, size=SLICE):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").fill_null("").to_pylist(), strict=True):
                for part in in_parts(text, SLICE, STOPS):
                    held.append((lang, part))
                    size += len(part) // 5 + 1
            if size >= most:
                yield shard(number + seen, held)
                seen, held, size = seen + 1, [], 0
        if held:
            yield shard(number + seen, held)

    return written(docs.mapInArrow(run, SHARD_ROW), "shards")


def shard(number: int, held: list[tuple[str, str]]) -> pa.RecordBatch:
    """SHARD_ROW of these documents (lang, text)."""
    langs = sorted({x for x, _ in held})
    at = {x: k for k, x in enumerate(langs)}
    data, begins = encoded([x for _, x in held])
    kind = KIND[data]
    inside = kind == 0
    first, last = spans(inside)
    codes, words = coded(data, inside, first, last)
    lang = np.array([at[x] for x, _ in held], np.int64)[np.searchsorted(begins, first, "right") - 1]
    unique, letters, times = np.unique(lang * max(1, len(words)) + codes, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")  # frequent words have small numbers
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    unique = unique[order]
    stops = np.cumsum(kind == 2)[first]  # the line feed after each text is a stop
    new = np.append(True, stops[1:] != stops[:-1])[: len(first)]
    own = words.take(pa.array(unique % max(1, len(words))))
    columns = [pa.array([number]), pa.array([langs], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
    columns += [pa.array([x], pa.binary()) for x in (planes(unique // max(1, len(words))), planes(rank[letters]), np.packbits(new).tobytes())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SHARD_ROW.split(", ")])


def _read(rows: pa.RecordBatch | pa.Table, k: int) -> tuple[Automaton, pa.Array, pa.Array, np.ndarray]:
    """(automaton, words, languages, language of each word) of a shard."""
    words, langs = (rows.column(c)[k].values for c in ("words", "langs"))
    letters = from_planes(rows.column("letters")[k].as_py())
    begins = np.unpackbits(np.frombuffer(rows.column("begins")[k].as_py(), np.uint8), count=len(letters)).astype(bool)
    return automaton(letters, begins, len(words)), words, langs, from_planes(rows.column("lang_of")[k].as_py())


def told(hashes: np.ndarray, counts: np.ndarray, wide: int, bits: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct first `bits` bits of hashes, ascending; their counts, at most what `kind` holds; bounds of the 2^wide ranges)."""
    keys = np.sort(hashes >> np.uint64(64 - bits) << np.uint64(16) | counts.astype(np.uint64))
    short = keys >> np.uint64(16)
    first = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
    counts = np.add.reduceat((keys & np.uint64(0xFFFF)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    edges = np.arange(1, 1 << wide, dtype=np.uint64) << np.uint64(bits - wide)
    return short[first], np.minimum(counts, np.iinfo(kind).max).astype(kind), np.concatenate([[0], np.searchsorted(short[first], edges), [len(first)]])


def frequent_phrases(shard_rows: DataFrame, number: int, nodes: int, least: int = LEAST) -> DataFrame:
    """number, lang, phrase, size, n: the phrases of up to DEPTH words that occur `least` times and more, numbered as they are written. number: of shards; nodes: of all shards, about."""
    wide = max(bucket_bits(shard_rows.sparkSession), (nodes // ANSWERED).bit_length())
    bits = min(wide + 32, 48, max(wide + 16, nodes.bit_length() + SPARE))
    enough = min(least, 0xFFFF)  # counts beyond it needn't be told: sums are compared with it alone
    kind = np.dtype(np.uint8 if enough < 256 else np.uint16)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found, *rest = _read(batch, k)
                short, counts, bounds = told(hashes_of(found, *rest), np.minimum(found.count, enough), wide, bits, kind)
                some = [(b, planes(np.diff(short[x:y], prepend=np.uint64(b << bits - wide))), counts[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
                b, h, n = zip(*some, strict=True) if some else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([batch.column("shard")[k].as_py()] * len(b), pa.int64()), pa.array(h, pa.binary()), pa.array(n, pa.binary())], ["bucket", "shard", "hashes", "counts"])
                del found, rest, short, counts, some, h, n
                release()

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(from_planes(x), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), kind)
        unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
        marks = np.split((np.bincount(place, counts, len(unique)) >= enough)[place], np.cumsum([len(x) for x in hashes])[:-1])
        return pa.table([table.column("shard"), table.column("bucket"), pa.array([np.packbits(x).tobytes() for x in marks], pa.binary())], ["shard", "bucket", "marks"])

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = [pa.schema([("key", pa.string()), ("n", pa.int64())]).empty_table()]
        for k in range(rows.num_rows):
            out.append(phrases_of(rows, k, replies.filter(pc.equal(replies.column("shard"), rows.column("shard")[k]))))
            release()
        return pa.concat_tables(out)

    def phrases_of(rows: pa.Table, k: int, replies: pa.Table) -> pa.Table:
        found, words, langs, lang_of = _read(rows, k)
        hashes = hashes_of(found, words, langs, lang_of)
        short, _, bounds = told(hashes, found.count * 0, wide, bits, kind)
        marked = np.zeros(len(short), bool)
        for bucket, marks in zip(replies.column("bucket").to_pylist(), replies.column("marks").to_pylist(), strict=True):
            x, y = bounds[bucket : bucket + 2]
            marked[x:y] = np.unpackbits(np.frombuffer(marks, np.uint8), count=y - x).astype(bool)
        frequent, hashes = short[marked], hashes >> np.uint64(64 - bits)
        place = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
        at = np.flatnonzero(frequent[place] == hashes) if len(frequent) else np.zeros(0, np.int64)
        phrases, root = [], []
        for depth in range(1, DEPTH + 1):
            node, columns = at[found.depth[at] == depth], []
            for _ in range(depth):
                columns.append(words.take(pa.array(found.letter[node])))
                root.append(node)
                node = found.parent[node]
            root[-depth:] = [root[-1]]
            phrases.append(columns[0] if depth == 1 else pc.binary_join_element_wise(*columns[::-1], " "))
        root = np.concatenate(root)
        lang = langs.take(pa.array(lang_of[found.letter[root]].astype(np.int64)))
        return pa.table([pc.binary_join_element_wise(lang, pa.concat_arrays(phrases), "\n"), pa.array(found.count[at].astype(np.int64))], ["key", "n"])

    asked = shard_rows.mapInArrow(tell, "bucket long, shard long, hashes binary, counts binary")
    replies = asked.groupBy("bucket").applyInArrow(answer, "shard long, bucket long, marks binary")
    pack = F.pmod(F.xxhash64("shard"), F.lit(max(1, number // TOGETHER)))
    found = shard_rows.groupBy(pack).cogroup(replies.groupBy(pack)).applyInArrow(finish, PHRASE)
    exact = found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    return exact.select(F.monotonically_increasing_id().alias("number"), lang.alias("lang"), phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("size"), "n")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to DEPTH words that occur `least` times and more.

    Texts, A-Z lower-cased, are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`. a counts a
    phrase within pieces, l and r the two sides of the cut with the least score floor(1000000 * a * a / (l * r)), n all
    words of the language. A phrase goes if a longer one holds it and has `share` percent of its count or more. Order: score
    and a descending, then the phrase in UTF-8 order. A null language counts as `und`, null texts as empty; repeated rows
    count each; empty tables give no rows. Further columns aren't read. Products are decimals of 38 digits: exact while
    a phrase occurs less than 10^16 times.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = shards(rows)
    number, nodes = parts.select(F.count(F.lit(1)), F.coalesce(F.sum(F.length("letters") / 4 * DEPTH), F.lit(0)).cast("long")).first()
    counts = written(frequent_phrases(parts, number, nodes, least), "phrases")
    return ranked(counts, totals(parts), least, top, share)


def totals(shard_rows: DataFrame) -> DataFrame:
    """lang, total: occurrences of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                langs = batch.column("langs")[k].as_py()
                lang_of, letters = (from_planes(batch.column(c)[k].as_py()).astype(np.int64) for c in ("lang_of", "letters"))
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.bincount(lang_of[letters], minlength=len(langs)))], ["lang", "total"])

    return shard_rows.mapInArrow(run, "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))


def ranked(counts: DataFrame, total: DataFrame, least: int, top: int, share: int) -> DataFrame:
    """The result of collocations() from written exact counts of phrases and from those of all words.

    Candidates go to their parts by number; what a part knows comes back as numbers alone, and phrases are looked up again
    for those that may rank.
    """
    # each cut after k words has the parent side (2k) and the side along suffix links (2k + 1)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct((2 * k).alias("side"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("part")),
        F.struct((2 * k + 1).alias("side"), F.array_join(F.slice("words", k + 1, F.col("size") - k), " ").alias("part")),
    )))
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    sides = candidates.select("lang", F.col("number").alias("whole"), F.col("n").alias("a"), F.inline(parts))
    of = counts.select("lang", F.col("phrase").alias("part"), F.col("size").alias("part_size"), F.col("n").alias("of"), "number")
    known = sides.join(of, ["lang", "part"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    subsumes = (F.col("part_size") > 1) & (100 * wide("a") >= share * wide("of"))
    # a candidate's own sides, and word from the longer ones that it goes
    told = F.array(F.struct(F.col("whole").alias("to"), "side", "of", F.lit(False).alias("gone")), F.struct(F.col("number").alias("to"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("of"), F.lit(True).alias("gone")))
    news = known.select("lang", "a", F.inline(F.filter(told, lambda x: ~x["gone"] | subsumes)))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("of")))
    facts = [side(k).alias(f"of_{k}") for k in range(2, 2 * DEPTH)]
    found = news.groupBy("lang", "to").agg(F.max(F.when(~F.col("gone"), F.col("a"))).alias("a"), F.max("gone").alias("gone"), *facts).where("NOT gone")
    score = lambda k: F.expr(f"CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) * CAST(1000000 AS DECIMAL(7,0)) div (CAST(of_{2 * k} AS DECIMAL(19,0)) * CAST(of_{2 * k + 1} AS DECIMAL(19,0)))")
    cuts = [F.when(F.col(f"of_{2 * k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"of_{2 * k}").alias("l"), F.col(f"of_{2 * k + 1}").alias("r"))) for k in range(1, DEPTH)]
    best = found.select("lang", "to", "a", F.array_min(F.array(*cuts)).alias("best")).select("lang", "to", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a")]
    near = best.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    named = near.drop("rank").join(counts.select(F.col("number").alias("to"), "phrase"), "to")
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
