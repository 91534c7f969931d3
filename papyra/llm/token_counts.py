"""Token counts through a digest cache.

Texts are looked up by the digest of their content and of the tokenizer's version; only distinct texts that the cache
doesn't hold are encoded, and their counts are appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.bpe import SLICE, Ranks
from papyra.llm.common import id_text, slices, texts_of

CACHE = "content binary, version string, n_tokens long"


@cache
def special_ranks(vocabulary: str) -> Ranks:
    """The byte-level ranks that a .json vocabulary is published with as well (the same ids, but for special tokens)."""
    return Ranks(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")))


@cache
def version(vocabulary: str) -> str:
    """Digest of a tokenizer file and of the way it is applied."""
    with open(public_tokenizers.path(vocabulary), "rb") as file:
        return hashlib.sha256(file.read() + b"|no special tokens added|no truncation").hexdigest()


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts, one row for a content and version; none where nothing is stored yet."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    stored = spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)
    return stored.groupBy("content", "version").agg(F.min("n_tokens").alias("n_tokens"))


def count_ids(texts: list[str], vocabulary: str) -> np.ndarray:
    """The number of ids of each text; the vocabulary's special string within a text is one id, as the library has it."""
    return encode_special(texts, vocabulary)[1]


#: The special string of the byte-level vocabularies and its id (fixed values).
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


def encode_special(texts: list[str], vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each), with the special string as its one id."""
    known = special_ranks(vocabulary)
    if not any(SPECIAL in x for x in texts):
        ids, counts, _, _ = known.encode(texts)
        return ids, counts
    parts = [x.split(SPECIAL) for x in texts]
    ids, counts, _, _ = known.encode([x for p in parts for x in p])
    last = np.zeros(len(counts), bool)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    last[np.cumsum(sizes) - 1] = True
    ends = np.cumsum(counts)
    out = np.insert(ids, ends[~last], SPECIAL_ID)
    per_text = np.add.reduceat(counts, np.cumsum(sizes) - sizes) + sizes - 1
    return out, per_text


def token_counts(df: DataFrame, vocabulary: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of each text.

    One row per input row. A null text counts as empty, of 0 bytes and tokens. The content's normal form is the text
    itself with null as empty, as the byte-level tokenizers have no normaliser. The missing texts are encoded and
    appended to the cache at once, before the result is read; appending the same text twice does no harm. Copies of
    a text are reduced within each task before the one shuffle of texts.
    """
    spark = df.sparkSession
    text = F.coalesce("text", F.lit(""))
    docs = id_text(df, id_col, text_col).select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    stamp = version(vocabulary)
    stored = open_cache(spark, cache_path).where(F.col("version") == stamp).select("content", "n_tokens")
    missing = docs.groupBy("content").agg(F.first("text").alias("text")).join(stored, "content", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            counts = count_ids(texts_of(batch.column("text")), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array([stamp] * len(counts)), pa.array(counts, pa.int64())], ["content", "version", "n_tokens"])

    missing.mapInArrow(run, CACHE).write.mode("append").parquet(cache_path)
    known = open_cache(spark, cache_path).where(F.col("version") == stamp).select("content", "n_tokens")
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content").join(known, "content")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
