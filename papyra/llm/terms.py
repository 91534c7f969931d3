"""Terms of whole batches as exact strings: spans of bytes become a dictionary and a code for each span, without a Python object a term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes with A-Z lower-cased and a line feed after each, and where each text begins (one more at the end)."""
    parts = [x.encode() for x in texts]
    begins = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=begins[1:])
    parts.append(b"")
    return np.frombuffer(b"\n".join(parts).lower(), np.uint8), begins


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that are inside a term; the last byte isn't."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        change = np.concatenate([[0], change])
    return change[::2], change[1::2]


def coded(data: np.ndarray, inside: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each span, the distinct terms as strings); two spans share a code exactly if their bytes are equal."""
    offsets = np.zeros(len(begins) + 1, np.int64)
    np.cumsum(ends - begins, out=offsets[1:])
    kept = data[inside]
    terms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
    found = terms.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.large_string()).cast(pa.string())


def folded(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sum of each array of weights by key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], *(np.add.reduceat(w[order], first) if len(first) else w[:0] for w in weights)


def in_parts(text: str, most: int, at: bytes) -> Iterator[str]:
    """The text cut after bytes of `at`, into parts of about `most` bytes; a part without such a byte stays whole."""
    if len(text) <= most // 4 or len(raw := text.encode()) <= most:
        yield text
        return
    stops = np.flatnonzero(np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(at, np.uint8))) + 1
    begin = 0
    while len(raw) - begin > most:
        k = int(np.searchsorted(stops, begin + most, "right"))
        k = k - 1 if k and stops[k - 1] > begin else k
        if k >= len(stops):
            break
        yield raw[begin : stops[k]].decode()
        begin = int(stops[k])
    yield raw[begin:].decode()
