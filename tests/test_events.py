"""Event streams cut anywhere, and a cache that runs out by event time."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.streaming import events

TEXT = 'event: evidence\ndata: {"n": 1}\n\n: note\n\ndata: héllo 漢\ndata:  two\n\n\n\nevent: a\nevent: delta\nid: 7\ndata:\n\nevent: done\ndata: {"ok": true}'.encode()
WANT = [("evidence", '{"n": 1}'), ("message", None), ("message", "héllo 漢\ntwo"), ("delta", None), ("done", '{"ok": true}')]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(TEXT)), max_size=12))
def test_any_cut_gives_the_same_events(cuts):
    held, got = b"", []
    bounds = [0, *sorted(cuts), len(TEXT)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        found, held = events.events_of(held, TEXT[a:b], k == len(bounds) - 2)
        got += found
    assert got == WANT and held == b""


@pytest.fixture(scope="module")
def store(spark):
    before = spark.conf.get(events.STORE_SETTING, None)
    events.use_store(spark)
    yield
    if before is None:
        spark.conf.unset(events.STORE_SETTING)
    else:
        spark.conf.set(events.STORE_SETTING, before)


def run(stream, path):
    """One run of a query that goes on from the state that earlier ones left."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_of_chunks(spark, store, tmp_path):
    schema = "stream string, place long, chunk binary, last boolean"
    draw, source = random.Random(3), tmp_path / "in"
    chunks = {s: sorted(draw.sample(range(1, len(TEXT)), 9)) for s in ("x", "y")}
    pieces = {s: [TEXT[a:b] for a, b in zip([0, *c], [*c, len(TEXT)], strict=True)] for s, c in chunks.items()}
    for batch in range(5):  # each batch has two chunks of a stream, in any order
        rows = [(s, k, pieces[s][k], k == 9) for s in pieces for k in (2 * batch + 1, 2 * batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        out = events.parsed_events(spark.readStream.schema(schema).parquet(str(source)), "stream", "place", "chunk", "last")
        run(out, tmp_path)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("stream", "place").collect()]
    for s in pieces:
        assert [(e, d) for x, _, e, d in got if x == s] == WANT and [p for x, p, *_ in got if x == s] == [1, 2, 3, 4, 5]


def test_cache_by_event_time(spark, store, tmp_path):
    schema, source = "key string, at timestamp, value string", tmp_path / "in"
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [
        [("a", hour(0), "one"), ("a", hour(11), None), ("b", hour(1), None)],
        [("a", hour(12), None), ("a", hour(11.5), None), ("b", hour(13), "two")],
        [("a", hour(14), None), ("b", hour(14), "three"), ("b", hour(24.5), None)],
        [("c", hour(40), None)], [("b", hour(41), None), ("c", hour(60), None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        run(events.ttl_cache(spark.readStream.schema(schema).parquet(str(source)), "key", "at", "value", dt.timedelta(hours=12), "2 hours"), tmp_path)
    got = [(r.key, r.status, r.value) for r in spark.read.parquet(f"{tmp_path}/out").where("status <> 'expired'").orderBy("key", "at").collect()]
    a = [("a", "stored", "one"), ("a", "hit", "one"), ("a", "hit", "one"), ("a", "miss", None), ("a", "miss", None)]
    b = [("b", "miss", None), ("b", "stored", "two"), ("b", "stored", "three"), ("b", "hit", "three"), ("b", "miss", None)]
    assert got == [*a, *b, ("c", "miss", None), ("c", "miss", None)]
    gone = {(r.key, r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").where("status = 'expired'").collect()}
    assert gone == {("a", hour(12)), ("b", hour(26))}
