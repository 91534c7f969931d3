"""Byte-level BPE encoding and decoding, as DataFrame operators.

Texts are cut into slices without a regular expression. Every code point gets a symbol from a class table and from a
look at its successor; a small automaton over the symbols says where slices begin. Its transition functions form a
finite monoid, so composing them is associative: the codes of a batch are scanned in blocks that advance side by side,
the blocks' totals are scanned in turn, and a second sweep reads off the boundaries. Each slice is then merged by
ranks; merged slices stay in a cache of bounded size.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import id_text, int_lists, slices, texts_of

# Symbols of the automaton.
LETTER, CLOSER, OPENER, NUMBER, APOSTROPHE, OTHER, LAST_SPACE, LAST_WHITE, WHITE = range(9)
SYMBOLS = 9
#: Added to the symbol of a text's first code point: there the automaton starts anew.
FIRST = SYMBOLS
# Code point classes that the symbols are made from.
_R_OR_V, _L, _E, _SPACE, _WHITE = 10, 11, 12, 13, 14
# States: a slice begins here; within letters, numbers or others; after an apostrophe that began a slice; within white
# space; after a space that the next slice takes; within a two-letter contraction.
BEGIN, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTE, IN_WHITE, TAKEN, HALF = range(8)
STATES = 8
#: White space by the Unicode property White_Space (fixed values).
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16, which the library knows and Python's tables (15.1) don't (fixed values).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
BLOCK = 256
#: The rank of a pair that doesn't merge.
NO_PAIR = 1 << 40
#: Bytes of text that are encoded at once.
SLICE = 1 << 20


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    letters = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((letters.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[WHITE_SPACE] = _WHITE
    for c, kind in ((" ", _SPACE), ("'", APOSTROPHE), ("s", CLOSER), ("t", CLOSER), ("m", CLOSER), ("d", CLOSER), ("r", _R_OR_V), ("v", _R_OR_V), ("l", _L), ("e", _E)):
        out[ord(c)] = kind
    return out


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, whether a slice begins) by state and symbol; (the monoid's functions, their products)."""
    fresh = {LETTER: IN_LETTERS, CLOSER: IN_LETTERS, OPENER: IN_LETTERS, NUMBER: IN_NUMBERS, APOSTROPHE: QUOTE, OTHER: IN_OTHERS, LAST_SPACE: TAKEN, LAST_WHITE: BEGIN, WHITE: IN_WHITE}
    on, begins = np.zeros((STATES, 2 * SYMBOLS), np.uint8), np.ones((STATES, 2 * SYMBOLS), np.uint8)
    for symbol, state in fresh.items():
        on[:, symbol] = on[:, symbol + FIRST] = state

    def joins(state: int, symbols: tuple[int, ...], to: int) -> None:
        for symbol in symbols:
            on[state, symbol], begins[state, symbol] = to, 0

    letters = (LETTER, CLOSER, OPENER)
    for state in (IN_LETTERS, TAKEN):
        joins(state, letters, IN_LETTERS)
    for state in (IN_NUMBERS, TAKEN):
        joins(state, (NUMBER,), IN_NUMBERS)
    for state in (IN_OTHERS, QUOTE, TAKEN):
        joins(state, (OTHER, APOSTROPHE), IN_OTHERS)
    joins(IN_WHITE, (WHITE,), IN_WHITE)
    joins(QUOTE, (CLOSER,), BEGIN)
    joins(QUOTE, (OPENER,), HALF)
    joins(HALF, letters, BEGIN)

    functions = {tuple(range(STATES)): 0} | {}
    for symbol in range(2 * SYMBOLS):
        functions.setdefault(tuple(on[:, symbol].tolist()), len(functions))
    generators = list(functions)
    todo = list(functions)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in functions:
                functions[h] = len(functions)
                todo.append(h)
    table = np.array(list(functions), np.uint8)
    products = np.array([[functions[tuple(g[x] for x in f)] for g in functions] for f in functions], np.uint16)
    return on, begins, table, products


@cache
def _symbol_functions() -> np.ndarray:
    on, _, table, _ = automaton()
    index = {tuple(f): k for k, f in enumerate(table.tolist())}
    return np.array([index[tuple(on[:, s].tolist())] for s in range(2 * SYMBOLS)], np.uint16)


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol at each code point; first: positions where a text begins."""
    kind = classes()[points]
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    ends = first[1:] - 1
    after[ends] = OTHER
    after[-1:] = OTHER
    closing = np.zeros(len(kind), bool)
    closing[ends] = True
    closing[-1:] = True
    white, next_white = kind >= _SPACE, (after >= _SPACE) | closing
    out = np.where(kind >= _R_OR_V, LETTER, kind).astype(np.uint8)
    out[((kind == _R_OR_V) & (after == _E)) | ((kind == _L) & (after == _L))] = OPENER
    out[white] = np.where(next_white[white], WHITE, np.where(kind[white] == _SPACE, LAST_SPACE, LAST_WHITE))
    out[first] += FIRST
    return out


def slice_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where a slice begins, by scanning transition functions block by block."""
    on, begins, table, products = automaton()
    n, blocks = len(symbol), -(-len(symbol) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    steps, size, flat = _symbol_functions(), len(table), products.ravel()
    total = steps[columns[0]].astype(np.intp)
    for k in range(1, BLOCK):
        total = flat[total * size + steps[columns[k]]].astype(np.intp)
    # exclusive scan over the blocks' functions, by doubling
    scan = np.zeros(blocks, np.intp)
    scan[1:] = total[:-1]
    step = 1
    while step < blocks:
        scan[step:] = flat[scan[:-step] * size + scan[step:]]
        step *= 2
    state = table[scan, BEGIN].astype(np.intp)
    flat_on, flat_begins, width = on.ravel(), begins.ravel(), 2 * SYMBOLS
    marks = np.empty((BLOCK, blocks), np.uint8)
    for k in range(BLOCK):
        at = state * width + columns[k]
        marks[k] = flat_begins[at]
        state = flat_on[at].astype(np.intp)
    return np.flatnonzero(marks.T.ravel()[:n])


class Ranks:
    """Ranks of one vocabulary, with the merges of slices seen before. One per worker and vocabulary."""

    #: Slices kept in the cache; beyond it the cache starts anew. Slices of over 64 bytes are never kept.
    CACHED, CACHED_BYTES = 400_000, 64
    #: Slices of up to 15 bytes are found by two numbers, which hold their bytes and their length.
    PACKED_BYTES = 15

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 1
        vocabulary = [b""] * self.size
        for token, k in self.ranks.items():
            vocabulary[k] = token
        self.vocabulary = vocabulary
        self.lengths = np.array([len(x) for x in vocabulary], np.int32)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        of, pairs = self.ranks.get, []
        for token, k in self.ranks.items():
            for cut in range(1, len(token)):
                if (left := of(token[:cut])) is not None and (right := of(token[cut:])) is not None:
                    pairs.append((left * self.size + right, k))
        keys, found = np.array(pairs, np.int64).T
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], found[order]
        bytes_low = np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)
        self.byte_pairs = np.full((int(self.byte_ids.max()) + 1,) * 2, NO_PAIR, np.int64)
        self.byte_pairs[bytes_low] = self.rank_of(*bytes_low)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.keys, self.at_slot = np.zeros((2, 1 << 18), np.uint64), np.full(1 << 18, -1, np.int32)
        self.placed = 0
        self.starts, self.counts, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), 0
        self.tokens, self.filled = np.zeros(1 << 18, np.int32), 0

    def packed(self, data: bytes, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Two numbers for each slice of up to PACKED_BYTES, the same for the same slice alone."""
        every = np.ndarray(len(data) + 1, "<u8", data + bytes(16), 0, (1,))  # eight bytes from each place on
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low = every[at] & masks[np.minimum(lengths, 8)]
        high = every[np.minimum(at + 8, len(data))] & masks[np.maximum(lengths - 8, 0)] | lengths.astype(np.uint64) << np.uint64(56)
        return np.stack([low, high])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot at which the search for each key begins."""
        mixed = (keys[0] ^ (keys[1] << np.uint64(23) | keys[1] >> np.uint64(41))) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - (len(self.at_slot) - 1).bit_length())).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of packed slices, -1 of those that aren't kept: each goes on from slot to slot until it meets itself or a free one."""
        slot, out = self.slots(keys), np.full(keys.shape[1], -1, np.int64)
        left = np.arange(len(slot))
        while len(left):
            number = self.at_slot[slot]
            same = (self.keys[0, slot] == keys[0]) & (self.keys[1, slot] == keys[1]) & (number >= 0)
            out[left[same]] = number[same]
            on = ~same & (number >= 0)
            left, keys, slot = left[on], keys[:, on], (slot[on] + 1) & (len(self.at_slot) - 1)
        return out

    def place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Keep the numbers of packed slices that aren't kept yet, each once; at most half of the slots are taken."""
        self.placed += len(numbers)
        if 2 * self.placed > (size := len(self.at_slot)):
            taken = self.at_slot >= 0
            keys, numbers = np.concatenate([self.keys[:, taken], keys], axis=1), np.concatenate([self.at_slot[taken], numbers])
            while 2 * self.placed > size:
                size *= 2
            self.keys, self.at_slot = np.zeros((2, size), np.uint64), np.full(size, -1, np.int32)
        slot, numbers = self.slots(keys), numbers.astype(np.int32)
        while len(slot):
            free = self.at_slot[slot] < 0
            self.at_slot[slot[free]] = numbers[free]
            mine = self.at_slot[slot] == numbers  # of several for one free slot the last has it
            self.keys[:, slot[mine]] = keys[:, mine]
            keys, numbers, slot = keys[:, ~mine], numbers[~mine], (slot[~mine] + 1) & (size - 1)

    def keep(self, ids: list[int]) -> int:
        """Store the merge of one slice; returns its number."""
        return self.keep_all(np.array(ids, np.int32), np.array([len(ids)]))[0]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of lowest rank is merged first, the leftmost among equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 96:
            return self._merge_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        pairs = [ranks.get(piece[k : k + 2], 1 << 30) for k in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < 1 << 30:
            k = pairs.index(low)
            parts[k] += parts.pop(k + 1)
            pairs.pop(k)
            if k < len(pairs):
                pairs[k] = ranks.get(parts[k] + parts[k + 1], 1 << 30)
            if k:
                pairs[k - 1] = ranks.get(parts[k - 1] + parts[k], 1 << 30)
        return [ranks[x] for x in parts]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NO_PAIR where they don't merge."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NO_PAIR)

    def merge_all(self, pieces: list[bytes]) -> list[int]:
        """Numbers of many short slices, merged side by side: each round merges one pair in every slice that has one."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        last = np.zeros(len(ids), bool)
        last[np.cumsum(lengths) - 1] = True
        pair = np.full(len(ids), NO_PAIR, np.int64)
        pair[:-1] = self.byte_pairs[ids[:-1], ids[1:]]
        pair[last] = NO_PAIR
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            low = np.minimum.reduceat(pair, starts)
            sizes = np.diff(starts, append=len(ids))
            over = low == NO_PAIR
            if over.any():
                out = np.repeat(over, sizes)
                done.append((owner[out], ids[out]))
                stay = ~out
                ids, owner, last, pair = ids[stay], owner[stay], last[stay], pair[stay]
                low, sizes = low[~over], sizes[~over]
                if not len(ids):
                    break
            hits = np.flatnonzero(pair == np.repeat(low, sizes))
            hits = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]
            ids[hits] = pair[hits]
            last[hits] = last[hits + 1]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, owner, last, pair = ids[keep], owner[keep], last[keep], pair[keep]
            at = hits - np.arange(len(hits))
            before = at[at > 0] - 1
            for x in (at, before):
                inner = x[~last[x]]
                pair[inner] = self.rank_of(ids[inner], ids[inner + 1])
                pair[x[last[x]]] = NO_PAIR
        owners, tokens = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(owners, kind="stable")
        counts = np.bincount(owners, minlength=len(pieces))
        return self.keep_all(tokens[order], counts)

    def keep_all(self, tokens: np.ndarray, counts: np.ndarray) -> list[int]:
        """Store many merges; returns their numbers."""
        k, end, filled = self.used, self.used + len(counts), self.filled + len(tokens)
        while end > len(self.starts):
            self.starts, self.counts = np.concatenate([self.starts, self.starts]), np.concatenate([self.counts, self.counts])
        while filled > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, self.tokens])
        self.tokens[self.filled : filled] = tokens
        self.counts[k:end] = counts
        self.starts[k:end] = self.filled + np.cumsum(counts) - counts
        self.used, self.filled = end, filled
        return list(range(k, end))

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, for slices of any length."""
        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, a, mid, last = heapq.heappop(heap)
            b = after[a]
            if not alive[a] or end[a] != mid or b < 0 or end[b] != last:
                continue
            end[a], after[a], alive[b] = last, after[b], 0
            if after[a] >= 0:
                before[after[a]] = a
                if (r := ranks.get(piece[a : end[after[a]]])) is not None:
                    heapq.heappush(heap, (r, a, last, end[after[a]]))
            if (p := before[a]) >= 0 and (r := ranks.get(piece[p:last])) is not None:
                heapq.heappush(heap, (r, p, a, last))
        out, k = [], 0
        while k >= 0:
            out.append(ranks[piece[k : end[k]]])
            k = after[k]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text, byte offsets of all slices in their texts, slices of each text)."""
        if not (joined := "".join(texts)):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        text_lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.cumsum(text_lengths)
        first = (text_ends - text_lengths)[text_lengths > 0]
        starts = slice_starts(symbols(points, first))
        data = joined.encode()
        if len(data) == len(points):
            at, text_bytes = starts, text_ends
        else:
            ends = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int8) + (points >= 0x10000), out=ends[1:])
            at, text_bytes = ends[starts], ends[text_ends]
        lengths = np.diff(at, append=len(data))
        if self.used > self.CACHED:
            self.clear()
        numbers = np.full(len(at), -1, np.int64)
        small = np.flatnonzero(lengths <= self.PACKED_BYTES)
        keys = self.packed(data, at[small], lengths[small])
        numbers[small] = self.look_up(keys)
        large = np.flatnonzero(lengths > self.PACKED_BYTES)
        numbers[large] = [self.index.get(data[a : a + n], -1) for a, n in zip(at[large].tolist(), lengths[large].tolist(), strict=True)]
        missed = np.flatnonzero(numbers < 0)
        if len(missed):
            pieces = [data[a : a + n] for a, n in zip(at[missed].tolist(), lengths[missed].tolist(), strict=True)]
            fresh = dict(zip(pieces, missed.tolist(), strict=True))
            short = [x for x in fresh if len(x) <= self.CACHED_BYTES]
            found = dict(zip(short, self.merge_all(short), strict=True))
            self.index |= {x: k for x, k in found.items() if len(x) > self.PACKED_BYTES}
            found |= {x: self.keep(self.merge(x)) for x in fresh if len(x) > self.CACHED_BYTES}
            numbers[missed] = [found[x] for x in pieces]
            new = np.array([k for x, k in fresh.items() if len(x) <= self.PACKED_BYTES], np.int64)
            self.place(keys[:, np.searchsorted(small, new)], numbers[new])
        counts = self.counts[numbers].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.tokens[np.repeat(self.starts[numbers] - (ends - counts), counts) + np.arange(ends[-1])]
        upto = np.searchsorted(starts, text_ends)  # slices before each text's end
        id_ends = np.concatenate([[0], ends])[upto]
        slice_counts = np.diff(upto, prepend=0)
        offsets = at - np.repeat(np.concatenate([[0], text_bytes[:-1]]), slice_counts)
        return ids, np.diff(id_ends, prepend=0), offsets.astype(np.int32), slice_counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text from the ids of all."""
        data = b"".join(map(self.vocabulary.__getitem__, ids.tolist()))
        lengths = np.concatenate([[0], np.cumsum(self.lengths[ids], dtype=np.int64)])
        cuts = lengths[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def ranks(vocabulary: str) -> Ranks:
    """The ranks of a vocabulary file in a worker: a file of public_tokenizers, a file sent by SparkContext.addFile, or a path that every worker has."""
    if "/" not in vocabulary:
        return Ranks(public_tokenizers.path(vocabulary))
    if vocabulary.startswith("files/"):
        return Ranks(SparkFiles.get(vocabulary.removeprefix("files/")))
    return Ranks(vocabulary)


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """What encode() does inside a task."""
    known = ranks(vocabulary)
    for batch in slices(batches, size=SLICE):
        ids, counts, offsets, cuts = known.encode(texts_of(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), int_lists(ids, counts, pa.int32()), int_lists(offsets, cuts, pa.int32())], ["doc_id", "ids", "offsets"])


def decoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """What decode() does inside a task."""
    known = ranks(vocabulary)
    for batch in batches:
        for part in [batch.slice(k, 512) for k in range(0, batch.num_rows, 512)]:
            lists = part.column("ids")
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data = known.decode(lists.flatten().to_numpy(), counts)
            cuts = part.column("offsets").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            last = part.column("offsets").flatten().to_numpy()[np.cumsum(cuts)[cuts > 0] - 1]
            if (last >= np.fromiter(map(len, data), np.int64, len(data))[cuts > 0]).any():
                raise ValueError("a slice begins past the end of its decoded text")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids", "data"])


ENCODED, DECODED = "doc_id long, ids array<int>, offsets array<int>", "doc_id long, n_tokens long, ids array<int>, data binary"


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>: the ids of each text, and the byte offset of each of its slices.

    One row per input row, repeated rows included. A null text counts as empty; an empty text has no ids. No special
    tokens are added or recognised. Texts are whole: a long one is encoded in one piece. Other columns are not read.
    Letters and numbers are those of Unicode 16, as the library has them.
    """
    return id_text(df, id_col, text_col).mapInArrow(lambda batches: encoded(batches, vocabulary), ENCODED)


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids, data binary: the bytes of each row of encode().

    The retained offsets are held against the decoded bytes: an offset past the decoded end fails the row's task. Null
    ids count as none.
    """
    return rows.select("doc_id", "ids", "offsets").mapInArrow(lambda batches: decoded(batches, vocabulary), DECODED)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(df)) in one pass: both run in the same Python worker, so that the ids cross to it and back once."""
    return id_text(df, id_col, text_col).mapInArrow(lambda batches: decoded(encoded(batches, vocabulary), vocabulary), DECODED)


def round_trip_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text: encoded, then decoded from the ids."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return round_trip(df, vocabulary).select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
