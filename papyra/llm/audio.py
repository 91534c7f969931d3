"""MPEG audio columns: payloads stored in valid MPEG-1 Layer III streams, and a parser for streams in general.

A stored stream is an ID3v2.3 tag, a frame with a variable-bitrate table, frames that carry the payload as ancillary
data (each with a checksum), and an ID3v1 tag. The parser takes any bytes: it reads both kinds of tags, finds frame
headers again after damage, reads the variable-bitrate table, verifies checksums, and gives the exact duration as
samples over sample rate with the offset of every frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import id_text, int_lists, slices, texts_of

# Fixed values of ISO/IEC 11172-3 and 13818-3: kilobits a second by version, layer and index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
PAYLOAD_UNIT = 192
#: Stored frames: MPEG-1 Layer III, one channel, 44.1 kHz. Header, checksum and side information take 23 bytes.
SIDE, OVERHEAD = 17, 4 + 2 + 17


class Header(NamedTuple):
    """What a frame header says."""

    version: int
    layer: int
    protected: bool
    bitrate: int
    sample_rate: int
    channels: int
    length: int
    samples: int
    side: int


@lru_cache(4096)
def header(word: int) -> Header | None:
    """The header in 32 bits, or None where they are none. Free-format frames aren't taken."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, sampling = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or sampling == 3 or word & 3 == 2:
        return None
    kind = 1 if version == 3 else 2
    bits, sample_rate = BITRATES[kind, layer][rate] * 1000, SAMPLE_RATES[version][sampling]
    padding, channels = word >> 9 & 1, 1 if word >> 6 & 3 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or kind == 1 else 576
    length = (12 * bits // sample_rate + padding) * 4 if layer == 1 else samples // 8 * bits // sample_rate + padding
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if kind == 1 else (9 if channels == 1 else 17)
    return Header(kind, layer, not word >> 16 & 1, bits, sample_rate, channels, length, samples, side)


@lru_cache(1 << 16)
def crc16(data: bytes) -> int:
    """The checksum of frame headers: polynomial 0x8005, all ones at first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


@lru_cache(64)
def _head(index: int) -> bytes:
    """Header, checksum and silent side information of a stored frame with that bitrate index."""
    word = struct.pack(">I", 0xFFFA0000 | index << 12 | 0b11 << 6 | 1 << 2)
    side = bytes(SIDE)
    return word + struct.pack(">H", crc16(word[2:] + side)) + side


@lru_cache(64)
def _room(index: int) -> int:
    return 144 * BITRATES[1, 3][index] * 1000 // 44100 - OVERHEAD


def pad(data: bytes, unit: int = PAYLOAD_UNIT) -> bytes:
    """The bytes with blanks up to a positive multiple of the unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def store(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds a payload; n_bytes: its length without padding."""
    full, room = 14, _room(14)
    head = _head(full)
    frames = [head + payload[k : k + room] for k in range(0, len(payload) - room + 1, room)]
    if rest := payload[len(frames) * room :]:
        index = next(k for k in range(1, 15) if _room(k) >= len(rest))
        frames.append(_head(index) + rest.ljust(_room(index), b"\0"))
    sizes = np.array([len(x) for x in frames])
    tag_text = b"".join(_text_frame(k, v) for k, v in ((b"payload_bytes", len(payload)), (b"text_bytes", n_bytes)))
    tag = b"ID3\3\0\0" + _synchsafe(len(tag_text)) + tag_text
    index = 5  # 64 kilobits a second: 208 bytes hold the table
    length = 144 * BITRATES[1, 3][index] * 1000 // 44100
    total = int(sizes.sum()) + length
    starts = np.concatenate([[0], np.cumsum(sizes)]) + length
    toc = (starts[np.arange(100) * len(frames) // 100] * 256 // total).astype(np.uint8).tobytes()
    table = struct.pack(">I", 0xFFFB0000 | index << 12 | 0b11 << 6 | 1 << 2) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return b"".join([tag, table.ljust(length, b"\0"), *frames, b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"])


def _text_frame(name: bytes, value: int) -> bytes:
    body = b"\0" + name + b"\0" + str(value).encode()
    return b"TXXX" + struct.pack(">I", len(body)) + b"\0\0" + body


class Stream(NamedTuple):
    """What a stream holds."""

    tags: dict[str, str]
    samples: int
    sample_rate: int
    seek: list[int]
    bitrates: set[int]
    vbr_frames: int | None
    vbr_bytes: int | None
    checksums_good: int
    checksums_bad: int
    resyncs: int
    payload: bytes


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Tags, and where audio begins and ends."""
    tags, begin, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and not any(x & 128 for x in data[6:10]):
        size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
        begin = min(len(data), 10 + size + 10 * bool(data[5] & 16))
        at, modern = 10, data[3] == 4
        while at + 10 <= min(begin, 10 + size) and data[at : at + 1] != b"\0":
            raw = data[at + 4 : at + 8]
            n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if modern else int.from_bytes(raw, "big")
            name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + n]
            if name[0] == "T" and body:
                codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
                text = body[1:].decode(codec, "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[f"TXXX:{key}" if name == "TXXX" else key] = value.rstrip("\0")
            at += 10 + n
    if end - begin >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        tags["title"] = data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1").rstrip()
    return tags, begin, end


def parse(data: bytes) -> Stream:
    """Tags, table, frames and payload of a stream. Bytes that hold no frame give a stream of no samples.

    A header counts if it fits the stream's version, layer and sample rate and its frame ends at the audio's end or at
    another such header; otherwise the next place where one does is sought, which counts as one resynchronisation.
    """
    tags, begin, end = _tags(data)
    at, kind, samples, rate = begin, None, 0, 0
    seek, bitrates, parts, good, bad, resyncs, lost = [], set(), [], 0, 0, 0, False
    vbr_frames = vbr_bytes = None

    def fits(k: int) -> Header | None:
        if k + 4 > end:
            return None
        h = header(int.from_bytes(data[k : k + 4], "big"))
        return h if h and (kind is None or kind == (h.version, h.layer, h.sample_rate)) else None

    while at + 4 <= end:
        h = fits(at)
        after = at + h.length if h else 0
        if not h or after > end or (after < end and (lost or kind is None) and not fits(after)):
            if not lost:
                resyncs, lost = resyncs + 1, True
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost, kind = False, (h.version, h.layer, h.sample_rate)
        skip = at + 4 + 2 * h.protected + h.side
        if not seek and vbr_frames is None and data[skip : skip + 4] in (b"Xing", b"Info"):
            flags, place = int.from_bytes(data[skip + 4 : skip + 8], "big"), skip + 8
            vbr_frames = int.from_bytes(data[place : place + 4], "big") if flags & 1 else -1
            place += 4 * (flags & 1)
            vbr_bytes = int.from_bytes(data[place : place + 4], "big") if flags & 2 else None
        elif not seek and vbr_frames is None and data[at + 36 : at + 40] == b"VBRI":
            vbr_bytes, vbr_frames = struct.unpack(">II", data[at + 46 : at + 54])
        else:
            if h.protected and h.layer == 3:
                if crc16(data[at + 2 : at + 4] + data[at + 6 : skip]) == int.from_bytes(data[at + 4 : at + 6], "big"):
                    good += 1
                else:
                    bad += 1
            seek.append(at)
            bitrates.add(h.bitrate)
            samples, rate = samples + h.samples, h.sample_rate
            parts.append(data[skip:after])
        at = after
    payload = b"".join(parts)
    size = tags.get("TXXX:payload_bytes", "")
    return Stream(tags, samples, rate, seek, bitrates, vbr_frames, vbr_bytes, good, bad, resyncs, payload[: int(size)] if size.isdigit() else payload)


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media binary: the stream that holds each text's UTF-8 bytes, padded with blanks to a positive multiple of 192.

    One row per input row; a null text counts as empty and becomes 192 blanks. Texts are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [x.encode() for x in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([store(pad(x), len(x)) for x in raw], pa.binary())], ["doc_id", "media"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, media binary")


AUDIO = "doc_id long, media binary, tags map<string,string>, samples long, sample_rate int, duration double, seek array<long>, bitrates array<int>, vbr_frames long, vbr_bytes long, checksums_good long, checksums_bad long, resyncs long, payload binary"


def read_audio(df: DataFrame) -> DataFrame:
    """Each row's stream (doc_id, media) with its tags, exact duration, frame offsets, table, checksums and payload.

    Null media count as no bytes. Any bytes are taken; what holds no frame has no samples and duration 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            found = [parse(x or b"") for x in batch.column("media").to_pylist()]
            longs = lambda name: pa.array([getattr(x, name) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("media"),
                    pa.array([list(x.tags.items()) for x in found], pa.map_(pa.string(), pa.string())),
                    longs("samples"),
                    pa.array([x.sample_rate for x in found], pa.int32()),
                    pa.array([x.samples / x.sample_rate if x.sample_rate else 0.0 for x in found]),
                    int_lists(np.array([k for x in found for k in x.seek], np.int64), np.array([len(x.seek) for x in found]), pa.int64()),
                    pa.array([sorted(x.bitrates) for x in found], pa.list_(pa.int32())),
                    *map(longs, ("vbr_frames", "vbr_bytes", "checksums_good", "checksums_bad", "resyncs")),
                    pa.array([x.payload for x in found], pa.binary()),
                ],
                [x.split()[0] for x in AUDIO.split(", ")],
            )

    return df.select("doc_id", "media").mapInArrow(run, AUDIO)


def digests(audio: DataFrame) -> DataFrame:
    """Digest columns of read_audio()'s rows; feature: frames, exact duration, checksums, table and seek offsets."""
    joined = lambda c, sep: F.concat_ws(sep, F.col(c).cast("array<string>"))
    return audio.select(
        "doc_id",
        F.col("tags")["TXXX:text_bytes"].cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("frames="), F.size("seek")),
            F.concat(F.lit("duration="), "samples", F.lit("/"), "sample_rate"),
            F.concat(F.lit("bitrates="), joined("bitrates", "+")),
            F.concat(F.lit("checksums="), "checksums_good", F.lit("+"), "checksums_bad"),
            F.concat(F.lit("resyncs="), "resyncs"),
            F.concat(F.lit("table="), "vbr_frames", F.lit("/"), "vbr_bytes"),
            F.concat(F.lit("seek="), F.md5(joined("seek", ","))),
        ).alias("feature"),
    )
