"""Words and word shingles as 64-bit hashes, for whole batches at once.

Words are the runs `[^\\x20\\x09-\\x0D]+` of a text's UTF-8 bytes with A-Z lower-cased. A word's hash sums its blocks of
eight bytes, each mixed with its place before, so no words share one by the structure of the sum; the total is mixed with
the word's length. Two different words, or two different shingles, share a hash with a probability of about 2^-64 a pair.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed at once; a longer word is a turn of its own.
BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
GRAM = np.uint64(0xC2B2AE3D27D4EB4F)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


#: Maps ASCII punctuation to blanks and A-Z to a-z, for joined(..., plain=True).
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def joined(texts: list[str], plain: bool = False) -> tuple[bytes, np.ndarray]:
    """All texts as lower-cased bytes with a line feed after each, and where each text begins (one more at the end). plain: ASCII punctuation becomes blanks."""
    parts = [x.encode() for x in texts]
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=begins[1:])
    parts.append(b"")
    data = b"\n".join(parts)
    return data.translate(PLAIN) if plain else data.lower(), begins


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word in bytes that end with white space."""
    white = WHITE[data]
    change = np.flatnonzero(white[1:] != white[:-1]) + 1
    if len(white) and not white[0]:
        change = np.concatenate([[0], change])
    return change[::2], change[1::2]


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word; words have a byte at least and follow one another."""
    out = np.empty(len(begins), np.uint64)
    k = 0
    while k < len(begins):
        last = max(k + 1, int(np.searchsorted(ends, begins[k] + BLOCK_BYTES, "right")))
        out[k:last] = _hash_some(data[begins[k] : ends[last - 1]], begins[k:last] - begins[k], ends[k:last] - begins[k])
        k = last
    return out


def _hash_some(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = data
    window = np.ndarray(len(data) + 1, "<u8", raw.data, strides=(1,))  # the eight bytes from each place
    sizes = ends - begins
    blocks = (sizes + 7) >> 3
    first = np.cumsum(blocks) - blocks
    place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    rest = np.repeat(sizes, blocks) - (place << 3)
    values = window[np.repeat(begins, blocks) + (place << 3)]
    values &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - np.minimum(rest, 8).astype(np.uint64)))
    values = mix(values ^ mix((place + 1).astype(np.uint64) * BASE))
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * GRAM)


def hash_words(texts: list[str], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    data, text_begins = joined(texts, plain)
    raw = np.frombuffer(data, np.uint8)
    begins, ends = word_spans(raw)
    return hash_spans(raw, begins, ends), np.diff(np.searchsorted(begins, text_begins))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each word but the last n - 1 of the whole array."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out *= GRAM
        out += words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_sets(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending and one text after the other; the size of each set).

    A text of fewer than n words has one shingle, all its words; a text without words has none.
    """
    words, counts = hash_words(texts)
    ends = np.cumsum(counts)
    at = np.arange(len(words))
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = at + n <= np.repeat(ends, counts)
    values, owners = grams(words, n), owner[: max(0, len(words) - n + 1)]
    keep = whole[: len(values)]
    values, owners = values[keep], owners[keep]
    for k in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        short = words[ends[k] - counts[k] : ends[k]]
        values = np.append(values, grams(np.append(short, np.uint64(counts[k])), len(short) + 1))
        owners = np.append(owners, k)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    return values[new], np.bincount(owners[new], minlength=len(texts))
