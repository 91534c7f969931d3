"""Packages: one zip for each document, its entries in a fixed order, written where the rows are and shown at the end."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from papyra.functions.text import slug
from papyra.sources.sinks import with_assets

#: What a package's rows have.
ENTRY = "package string, place int, path string, content binary"
FORMAT = "papyra_zip"
#: The time that all entries bear, so that equal contents give equal bytes.
EPOCH = (1980, 1, 1, 0, 0, 0)


@dataclass
class Written(WriterCommitMessage):
    """The packages of a task: names, and where they wait."""

    found: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}/.papyra-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        """Zips of a task's rows, which come by package and in the order of entries; each waits under a name that no other attempt has."""
        found, archive, stream, seen, store = [], None, None, set(), None
        try:
            for row in iterator:
                if not found or row["package"] != found[-1][0]:
                    if archive:
                        archive.close()
                        stream.close()
                    name = row["package"]
                    if not name or "/" in name or "\\" in name or name.startswith("."):
                        raise ValueError(f"refused: {name!r}")
                    staged = f"{self.staging}/{uuid.uuid4().hex}"
                    store, place = fs.FileSystem.from_uri(staged)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(place)
                    archive, seen = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), set()
                    found.append((name, staged))
                path = row["path"]
                if path in seen or path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"refused: {path!r}")
                seen.add(path)
                entry = zipfile.ZipInfo(path, EPOCH)
                entry.compress_type, entry.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
                archive.writestr(entry, bytes(row["content"] or b""))
            if archive:
                archive.close()
                stream.close()
        except BaseException:
            if stream and not stream.closed:
                archive.fp = None
                stream.close()
            raise
        return Written(found)

    def commit(self, messages: list[Written | None]) -> None:
        """Every package gets its name; one of the same name is replaced. What failed attempts have left goes."""
        store, root = fs.FileSystem.from_uri(self.path)
        found = [x for m in messages if m for x in m.found]
        if len({n for n, _ in found}) < len(found):
            self.abort(messages)
            raise ValueError("a package was written by several tasks")
        for name, staged in found:
            store.move(fs.FileSystem.from_uri(staged)[1], f"{root}/{name}.zip")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, place = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)


class ZipPackages(DataSource):
    """The format papyra_zip: rows of ENTRY in, a zip a package out."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ENTRY

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_packages(entries: DataFrame, path: str) -> None:
    """A zip for each package of entries (ENTRY) under a path that all executors reach (file, hdfs, s3 and what else pyarrow knows).

    A package's rows meet in one task, sorted by place and path, and stream through it one entry at a time. Zips get their
    names when all of them are written; a run that fails leaves none. Equal entries give equal bytes, however rows lie.
    Names that leave the folder, and paths that leave the package or come twice, are refused.
    """
    spark: SparkSession = entries.sparkSession
    spark.dataSource.register(ZipPackages)
    rows = entries.select("package", F.col("place").cast("int").alias("place"), "path", F.col("content").cast("binary").alias("content"))
    rows.repartition("package").sortWithinPartitions("package", "place", "path").write.format(FORMAT).mode("append").save(path)


def _stems(assets: DataFrame) -> DataFrame:
    """Assets with stem, what their names begin with, and papyra_doubt: whether a name may look like another's with a number."""
    rows = assets.withColumns({"package": F.col("package").cast("string"), "asset": F.col("asset").cast("string"), "place": F.col("place").cast("long"), "suffix": F.coalesce("suffix", F.lit(""))})
    rows = rows.withColumn("stem", slug(F.col("asset"))).withColumn("stem", F.when(F.col("stem") == "", "asset").otherwise(F.col("stem")))
    ends = F.contains(F.translate("asset", "123456789", "000000000"), F.lit("0")) & F.col("stem").rlike("-[0-9]+$")
    return rows.withColumn("papyra_doubt", F.coalesce(ends | ~((F.col("suffix") == "") | F.col("suffix").startswith(".")), F.lit(False)))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with file: the first of a stem and suffix has no number, the others are counted from 2."""
    number = F.row_number().over(Window.partitionBy("package", "stem", "suffix").orderBy("place", "asset"))
    named = rows.withColumn("papyra_n", number)
    return named.withColumn("file", F.concat("stem", F.when(F.col("papyra_n") > 1, F.concat(F.lit("-"), F.col("papyra_n").cast("string"))).otherwise(""), "suffix"))


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of packages without doubt, with file, and package, asset, place, file of the others, None if there are none.

    Stems without a number at their end, and suffixes from a point on, part again in one way, so no two names are equal.
    """
    if rows.where("papyra_doubt").isEmpty():
        return _numbered(rows), None
    doubt = F.max("papyra_doubt").over(Window.partitionBy("package"))
    return _numbered(rows.withColumn("papyra_doubt", doubt).where(~F.col("papyra_doubt"))), _careful(rows)


def _careful(rows: DataFrame) -> DataFrame:
    """package, asset, place, file of packages with rows in doubt."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for row in group.sort_values(["place", "asset"]).itertuples(index=False):
            number, name = 2, f"{row.stem}{row.suffix}"
            while name in taken:
                name, number = f"{row.stem}-{number}{row.suffix}", number + 1
            taken.add(name)
            out.append((row.package, row.asset, row.place, name))
        return pd.DataFrame(out, columns=["package", "asset", "place", "file"])

    some = rows.select("package", "asset", "place", "stem", "suffix").join(rows.where("papyra_doubt").select("package").distinct(), "package", "left_semi")
    named = _numbered(some)
    # only where a numbered name is another asset's own are names given one after the other
    odd = named.groupBy("package", "file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("package").distinct()
    plain = named.join(odd, "package", "left_anti").select("package", "asset", "place", "file")
    loop = some.join(odd, "package", "left_semi").select(*some.columns).groupBy("package").applyInPandas(run, "package string, asset string, place long, file string")
    return plain.unionByName(loop)


def file_names(assets: DataFrame) -> DataFrame:
    """package, asset, place, file: safe names of assets (package, asset, place, suffix), in order of place; a name that is taken gets the next number that is free."""
    plain, careful = _parted(_stems(assets))
    names = plain.select("package", "asset", "place", "file")
    return names if careful is None else names.unionByName(careful)


def package_entries(bodies: DataFrame, assets: DataFrame, mark: str) -> DataFrame:
    """ENTRY of documents (package, body) with their assets (package, asset, place, suffix, content): the text first, its marks of assets as links, then the files by name.

    mark: what marks of assets begin with. Documents without assets are packages of a text; assets of no document are left
    out. Contents go along with their rows while these are named; only where names are in doubt do they meet by package, asset
    and place. Where assets lie by package already, as after a window over it, they aren't shuffled again.
    """
    rows, kept = _stems(assets), ["package", "asset", "place", "file"]
    files, careful = _parted(rows)
    names = files.select(*kept)
    if careful is not None:
        names, files = names.unionByName(careful), files.select(*kept, "content").unionByName(rows.join(careful, kept[:3]).select(*kept, "content"))
    links = names.groupBy("package", "asset").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]).alias("files"))
    links = links.groupBy("package").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "files")))).alias("papyra_links"))
    folder: Column = F.concat(F.col("package"), F.lit(".assets"))
    text = with_assets(F.col("body"), F.col("papyra_links"), folder, mark)
    texts = bodies.join(links, "package", "left").select("package", F.lit(0).alias("place"), F.concat("package", F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content"))
    files = files.where("asset IS NOT NULL AND place IS NOT NULL").join(bodies.select("package"), "package", "left_semi")
    return texts.unionByName(files.select("package", F.lit(1).alias("place"), F.concat(folder, F.lit("/"), F.col("file")).alias("path"), F.col("content").cast("binary").alias("content")))
