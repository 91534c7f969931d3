"""What the operators share: tables, the shared work folder, and written intermediate tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.tables import dealt

#: Texts are handled inside a task in slices of about this many bytes, whatever size the Arrow batches have.
SLICE_BYTES = 4 << 20
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark alone (the folder may be in any store that Spark knows).

    Where the session doesn't say how many rows an Arrow batch holds, it is set to 1,000: rows are texts here, and a
    batch is held in memory on both sides of the pipe. Tables of a few files are dealt out over all cores, as a file may
    be a single row group; larger ones are read where they lie.
    """
    if spark.conf.get(ROWS_A_BATCH, None) is None:
        spark.conf.set(ROWS_A_BATCH, "1000")
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session that runs in one process gets a new folder; on a cluster it is an error.
    """
    if (found := spark.conf.get("spark.checkpoint.dir", None)) is None:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='papyra-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared work folder, removed when the driver ends."""
    path = f"{work_dir(spark)}/papyra-{uuid.uuid4().hex}"
    place, store = _place(spark, path)
    store.mkdirs(place)
    store.deleteOnExit(place)
    return f"{path}/{name}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared work folder, read again: cuts lineage and survives lost executors.

    The table is removed when the driver ends.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    writer.partitionBy(*partition_by).parquet(path) if partition_by else writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
    out.papyra_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table of written() that nothing will read again."""
    if path := vars(table).pop("papyra_path", None):
        place, store = _place(table.sparkSession, path)
        store.delete(place, True)


def bucket_bits(spark: SparkSession) -> int:
    """Bits that number the ranges of hashes which arrays are dealt out by: four ranges or more for each shuffle partition."""
    return max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def dealt_by_range(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the unsigned 64-bit hashes, bounds of the 2^bits ranges in it)."""
    order = np.argsort(hashes)
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return order, np.concatenate([[0], np.searchsorted(hashes[order], edges), [len(hashes)]])


def packed_rest(hashes: np.ndarray, bits: int) -> bytes:
    """The 40 bits after the first `bits` of each unsigned hash, as 32-bit numbers followed by bytes."""
    rest = hashes << np.uint64(bits) >> np.uint64(24)
    return (rest >> np.uint64(8)).astype(np.uint32).tobytes() + rest.astype(np.uint8).tobytes()


def unpacked_rest(data: list[bytes]) -> np.ndarray:
    """The 40-bit numbers of packed_rest(), of one value after the other."""
    parts = []
    for x in data:
        n = len(x) // 5
        parts.append(np.frombuffer(x, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(x, np.uint8, n, 4 * n))
    return np.concatenate(parts)


def bit_slice(hashes: np.ndarray, bucket_bits_: int, bits: int) -> bytes:
    """The piece of a table of 2^bits bits that hashes of one range set."""
    out = np.zeros(1 << (bits - bucket_bits_), bool)
    out[(hashes << np.uint64(bucket_bits_) >> np.uint64(64 - bits + bucket_bits_)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def gathered_bits(pieces: pa.Table, bits: int) -> np.ndarray:
    """The whole table from its pieces (bucket, bits): 2^bits / 8 bytes, whatever the input's size."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, piece in zip(pieces.column("bucket").to_pylist(), pieces.column("bits").to_pylist(), strict=True):
        out[bucket * len(piece) : (bucket + 1) * len(piece)] = np.frombuffer(piece, np.uint8)
    return out


def has_bit(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which unsigned hashes fall on a bit that is set."""
    place = hashes >> np.uint64(64 - bits)
    return table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0


def bit_table(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A table of 2^bits bits with those set on which values of a long column fall."""
    wide = bucket_bits(rows.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.unique(batch.column(column).to_numpy().view(np.uint64))
            _, bounds = dealt_by_range(hashes, wide)
            some = [(b, hashes[x:y].tobytes()) for b, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]
            b, h = zip(*some, strict=True) if some else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(h, pa.binary())], ["bucket", "hashes"])

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([bit_slice(hashes, wide, bits)], pa.binary())})

    return gathered_bits(rows.select(column).mapInArrow(split, "bucket long, hashes binary").groupBy("bucket").applyInArrow(fold, "bucket long, bits binary").toArrow(), bits)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names of its own, so that further columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about `size` bytes of `column`; one longer row is a run of its own. Then the worker gives back the memory it has freed."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = np.cumsum(lengths, dtype=np.int64), 0
        while first < batch.num_rows:
            base = total[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(total, base + size, "right")))
            yield batch.slice(first, end - first)
            first = end
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and would keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a column; null counts as empty."""
    return column.fill_null("").to_pylist()


def int_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
