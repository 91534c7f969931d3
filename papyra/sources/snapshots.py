"""Several tables that change together: new files are staged, and one file that names them all makes them visible.

A table is split in buckets by a hash of its key. A change writes the buckets it touches as ordinary Parquet under a name
of its own, then a list of every table's buckets, and gives that list the next number by a rename that fails if the number
is taken. Readers take the last list. So a change that breaks off leaves files that no list names, and of two changes that
began from the same list one fails whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another change came first."""


class Snapshots:
    """Tables in a folder that Spark and Hadoop's file systems know."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all lists, ascending."""
        place = self._path(f"{self.root}/log")
        if not self._fs.exists(place):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(place))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def _list(self, version: int | None = None) -> tuple[int, dict]:
        found = self.versions()
        version = found[-1] if version is None and found else version
        if not version:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/log/{version:012}.json", wholetext=True).first()[0]
        return version, json.loads(text)

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table as of a version (the last), all of it or some buckets."""
        table = self._list(version)[1][name]
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.root}/data/{change}/{name}/papyra_bucket={b}" for b, change in table["buckets"].items() if wanted is None or int(b) in wanted]
        schema = StructType.fromJson(table["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, key: Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def commit(self, changes: dict[str, tuple[DataFrame, str]], touched: Iterable[int] | None = None, base: int | None = None) -> int:
        """The number under which the changed tables (rows, the column that deals them out) become visible together.

        touched: the buckets that the rows stand for, all if not given; what other buckets hold stays. base: the version that
        the change was made from (the last): if another one has come since, nothing changes and Conflict is raised.
        """
        version, known = self._list(base)
        change, new = uuid.uuid4().hex, {name: {**t, "buckets": dict(t["buckets"])} for name, t in known.items()}
        scope = range(self.buckets) if touched is None else sorted(set(touched))
        for name, (rows, key) in changes.items():
            path = f"{self.root}/data/{change}/{name}"
            rows.withColumn("papyra_bucket", self.bucket(F.col(key))).repartition("papyra_bucket").write.partitionBy("papyra_bucket").parquet(path)
            held = {int(x.getPath().getName().partition("=")[2]) for x in self._fs.listStatus(self._path(path)) if "=" in x.getPath().getName()}
            if not held <= set(scope):
                raise ValueError(f"{name} has rows of buckets that the change doesn't touch")
            table = new.setdefault(name, {"buckets": {}})
            table["schema"] = json.loads(rows.schema.json())
            table["buckets"] = {b: c for b, c in table["buckets"].items() if int(b) not in scope} | {str(b): change for b in sorted(held)}
        return self._publish(version + 1, new)

    def _publish(self, version: int, tables: dict) -> int:
        jvm = self.spark.sparkContext._jvm
        staged, final = self._path(f"{self.root}/log/.{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{version:012}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), none)
        except Exception as error:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} is taken") from None
            raise
        return version

    def clean(self, keep: int = 1) -> int:
        """Removes all but the last `keep` lists and the files that none of them names; the number of removed changes. Not while a change is under way."""
        found = self.versions()
        kept = {c for v in found[-keep:] for t in self._list(v)[1].values() for c in t["buckets"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{v:012}.json"), False)
        place, gone = self._path(f"{self.root}/data"), 0
        for x in self._fs.listStatus(place) if self._fs.exists(place) else []:
            if x.getPath().getName() not in kept:
                self._fs.delete(x.getPath(), True)
                gone += 1
        return gone
