"""Several tables that change together: faults between them, conflicts, buckets, and what replacing leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from papyra.operators import documents
from papyra.sources.snapshots import Conflict, Snapshots


def blocks(spark, rows):
    return spark.createDataFrame(rows, "id long, revision long, uid string, hash string, text string, created long")


@pytest.fixture()
def store(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/library", buckets=4)
    rows = blocks(spark, [(k, k % 6, f"u{k}", f"h{k}", f"t{k}", 0) for k in range(30)])
    variants = rows.select("id", F.col("id").alias("block_id"), "revision")
    assert s.commit({"blocks": (rows, "revision"), "variants": (variants, "revision")}) == 1
    return s


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


def test_changes_of_touched_buckets(spark, store):
    keys = {r.revision: r.b for r in store.read("blocks").select("revision", store.bucket(F.col("revision")).alias("b")).distinct().collect()}
    hit = keys[3]
    own = store.read("blocks", buckets=[hit])
    assert {r.revision for r in own.select("revision").distinct().collect()} == {k for k, b in keys.items() if b == hit}
    after = own.where("revision <> 3 OR id < 10")
    assert store.commit({"blocks": (after, "revision")}, touched=[hit]) == 2
    assert ids(store.read("blocks")) == [k for k in range(30) if k % 6 != 3 or k < 10]
    assert ids(store.read("blocks", version=1)) == list(range(30)) and ids(store.read("variants")) == list(range(30))
    with pytest.raises(ValueError, match="doesn't touch"):
        store.commit({"blocks": (store.read("blocks"), "revision")}, touched=[hit])
    assert store.versions() == [1, 2]


def test_fault_between_tables_changes_nothing(store, monkeypatch):
    write, seen = DataFrameWriter.parquet, []

    def breaks(self, path, *args, **more):
        seen.append(path)
        if len(seen) == 2:
            raise KeyboardInterrupt
        return write(self, path, *args, **more)

    rows = store.read("blocks").where("id < 5")
    with monkeypatch.context() as patch:
        patch.setattr(DataFrameWriter, "parquet", breaks)
        with pytest.raises(KeyboardInterrupt):
            store.commit({"blocks": (rows, "revision"), "variants": (store.read("variants").where("id < 5"), "revision")})
    assert seen[0].endswith("/blocks") and ids(store.read("blocks")) == list(range(30)) and store.versions() == [1]
    assert store.commit({"blocks": (rows, "revision"), "variants": (store.read("variants").where("id < 5"), "revision")}) == 2
    assert ids(store.read("blocks")) == ids(store.read("variants")) == list(range(5))
    assert store.clean(keep=1) == 2 and ids(store.read("blocks")) == list(range(5)) and store.versions() == [2]


def test_a_failing_task_and_a_conflict_change_nothing(spark, store):
    @F.udf("string")
    def fails(x):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        store.commit({"blocks": (store.read("blocks").withColumn("text", fails("text")), "revision")})
    assert store.versions() == [1] and ids(store.read("blocks")) == list(range(30))
    some = store.read("blocks").where("id = 1")
    assert store.commit({"blocks": (some, "revision")}, base=1) == 2
    with pytest.raises(Conflict):
        store.commit({"blocks": (store.read("blocks", version=1), "revision")}, base=1)
    assert ids(store.read("blocks")) == [1] and store.versions() == [1, 2]
    assert store.commit({"blocks": (store.read("blocks").where("false"), "revision")}) == 3
    assert store.read("blocks").count() == 0 and store.read("blocks").columns == ["id", "revision", "uid", "hash", "text", "created"]


def test_replacing_a_document(spark):
    old = blocks(spark, [(1, 1, "a", "ha", "A", 5), (2, 1, "b", "hb", "B", 5), (3, 1, "c", "hc", "C", 5), (9, 2, "a", "ha", "A", 5)])
    new = blocks(spark, [(101, 1, "a", "hb", "B", 7), (102, 1, "b", "hx", "X", 7), (103, 1, "d", "hd", " ", 7), (104, 1, "e", "hy", "Y", 7), (105, 1, "f", "hy", "Y", 7)])
    variants = spark.createDataFrame([(1, 1, "ha", "a", 0), (2, 2, "hb", "b", 0), (3, 3, "hc", "c", 0), (4, 1, None, "a", 0), (5, 2, "hx", None, 0), (6, 2, "hy", "b", 0), (7, 9, "hq", "a", 0), (8, 1, "", "z", 0)], "id long, block_id long, seen_hash string, seen_uid string, updated long")
    tables = {
        "blocks": old, "variants": variants, "embeddings": spark.createDataFrame([(1,), (3,), (9,)], "block_id long"),
        "assets": spark.createDataFrame([(1, "old"), (2, "other")], "revision long, asset string"), "index": old.select(F.col("id").alias("block_id"), "revision", "uid", "text"),
        "revisions": spark.createDataFrame([(1, "new", 0), (2, "new", 0)], "id long, status string, updated long"),
    }
    touched = spark.createDataFrame([(1,)], "revision long")
    after = documents.replaced(tables, new, spark.createDataFrame([(1, "fresh")], "revision long, asset string"), touched, F.lit(9).cast("long"))
    got = {n: sorted(map(tuple, rows.collect()), key=str) for n, rows in after.items()}
    assert [(r[0], r[2], r[5]) for r in got["blocks"]] == [(1, "a", 5), (103, "d", 7), (104, "e", 7), (105, "f", 7), (2, "b", 5), (9, "a", 5)]
    assert got["variants"] == sorted([(1, 1, "ha", "a", 0), (2, 1, "hb", "a", 9), (4, 1, None, "a", 0), (5, 2, "hx", "b", 9), (6, 2, "hy", "b", 0), (7, 9, "hq", "a", 0), (8, 1, "", "z", 0)], key=str)
    assert got["embeddings"] == [(1,), (9,)] and got["assets"] == [(1, "fresh"), (2, "other")]
    assert got["index"] == [(1, 1, "a", "B"), (104, 1, "e", "Y"), (105, 1, "f", "Y"), (2, 1, "b", "X"), (9, 2, "a", "A")]
    assert got["revisions"] == [(1, "parsed", 9), (2, "new", 0)]
    none = documents.replaced(tables, new.where("false"), spark.createDataFrame([], "revision long, asset string"), touched, F.lit(9).cast("long"))
    assert [r.id for r in none["blocks"].collect()] == [9] and none["variants"].count() == 1
