"""Server-sent events out of streams of bytes that are cut anywhere, and a cache whose entries run out by event time."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that stateful processors need, and the setting that chooses it.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "place long, event string, data string"
ANSWER = "at timestamp, status string, value string"


def use_store(spark: SparkSession) -> None:
    """Choose the state store that the processors here need, where the session hasn't chosen it already."""
    if spark.conf.get(STORE_SETTING, None) != STORE:
        spark.conf.set(STORE_SETTING, STORE)


def event_of(block: bytes) -> tuple[str, str | None] | None:
    """(name, data) of one event's lines: the last name counts, `message` where there is none, and lines of data are joined; None for a blank block."""
    name, data = "message", []
    text = block.decode("utf-8", "replace").strip()
    if not text:
        return None
    for line in text.split("\n"):
        field, colon, value = line.partition(":")
        if colon and field == "event":
            name = value.strip()
        elif colon and field == "data":
            data.append(value.lstrip())
    return name, "\n".join(data) or None


def events_of(held: bytes, more: bytes, last: bool = False) -> tuple[list[tuple[str, str | None]], bytes]:
    """(the events that are complete, the bytes of one that isn't yet); at the end what is left is an event too."""
    *blocks, rest = (held + more).split(b"\n\n")
    if last:
        blocks, rest = [*blocks, rest], b""
    return [e for e in map(event_of, blocks) if e], rest


class _Parser(StatefulProcessor):
    """Keeps a stream's bytes after its last complete event, and how many events it has had."""

    def __init__(self, place: str, chunk: str, last: str) -> None:
        self.place, self.chunk, self.last = place, chunk, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rest", "rest binary, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, seen = self.state.get() if self.state.exists() else (b"", 0)
        held, out = bytes(held), []
        whole = pd.concat(list(rows)).sort_values(self.place, kind="stable")
        for chunk, last in zip(whole[self.chunk], whole[self.last], strict=True):
            found, held = events_of(held, bytes(chunk) if chunk is not None else b"", bool(last))
            for name, data in found:
                seen += 1
                out.append((*key, seen, name, data))
        self.state.update((held, seen))
        yield pd.DataFrame(out, columns=self.columns(key))

    def columns(self, key) -> list[str]:
        return [*self.names, "place", "event", "data"]

    def close(self) -> None:
        pass


def parsed_events(chunks: DataFrame, stream: str, place: str, chunk: str, last: str) -> DataFrame:
    """stream, place, event, data of the events of each stream of bytes, wherever its chunks were cut (append mode).

    chunks: a streaming table of (stream, place, chunk, last); within a batch chunks are taken in the order of place, and
    batches as they come. Characters may be cut too. A chunk that is the last one ends its stream, and null ones are empty.
    """
    kind = chunks.schema[stream].dataType.simpleString()
    parser = _Parser(place, chunk, last)
    parser.names = [stream]
    return chunks.select(stream, place, chunk, last).groupBy(stream).transformWithStateInPandas(statefulProcessor=parser, outputStructType=f"{stream} {kind}, {EVENT}", outputMode="Append", timeMode="None")


class _Cache(StatefulProcessor):
    """One entry: its value and when it runs out."""

    def __init__(self, name: str, at: str, value: str, ttl: timedelta) -> None:
        self.name, self.at, self.value, self.ttl = name, at, value, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("entry", "value string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entry = self.state.get() if self.state.exists() else None
        whole, out, timer = pd.concat(list(rows)).sort_values(self.at, kind="stable"), [], None
        for at, value in zip(whole[self.at], whole[self.value], strict=True):
            now = _millis(at)
            if value is not None and not pd.isna(value):
                timer = now + int(self.ttl.total_seconds() * 1000)
                entry = (value, timer)
                out.append((key[0], at, "stored", value))
            elif entry is not None and now < entry[1]:
                out.append((key[0], at, "hit", entry[0]))
            else:
                out.append((key[0], at, "miss", None))
        if timer is not None:
            self.state.update(entry)
            self.handle.registerTimer(timer)
        yield pd.DataFrame(out, columns=[self.name, "at", "status", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, when = [], expiredTimerInfo.getExpiryTimeInMs()
        if self.state.exists() and self.state.get()[1] <= when:  # a later one may have been stored since
            self.state.clear()
            out.append((key[0], pd.Timestamp(when, unit="ms"), "expired", None))
        yield pd.DataFrame(out, columns=[self.name, "at", "status", "value"])

    def close(self) -> None:
        pass


def _millis(at) -> int:
    stamp = pd.Timestamp(at)
    moment = stamp.to_pydatetime()
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return int((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(milliseconds=1))


def ttl_cache(requests: DataFrame, key: str, at: str, value: str, ttl: timedelta, late: str = "0 seconds") -> DataFrame:
    """key, at, status, value: what a cache answers to each request (append mode).

    A request with a value stores it (`stored`), one without asks (`hit` with the value before it is `ttl` old, else
    `miss`). Entries go from the state once the watermark has passed their end (`expired`). Requests later than `late`
    aren't answered.
    """
    kind = requests.schema[key].dataType.simpleString()
    rows = requests.select(key, at, value).withWatermark(at, late)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Cache(key, at, value, ttl), outputStructType=f"{key} {kind}, {ANSWER}", outputMode="Append", timeMode="eventTime")
