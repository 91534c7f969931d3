"""Retrieval: BM25, substring search, hashed embeddings, vector top-k and the fusion of both."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import fold_lower, occurrences, once, tokens
from papyra.functions.values import bm25, dot, idf


def query_terms(query: str, most: int = 12) -> list[str]:
    """The first terms of a query, as tokens() would give them."""
    import re

    return [w for w in re.findall(r"\w+", query.lower()) if len(w) > 1][:most]


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf.

    A row's terms are counted where it lies; only where an id has several rows are their counts shuffled and summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, words = batch.columns
            coded = words.flatten().dictionary_encode()
            if terms := len(coded.dictionary):
                pairs, tf = np.unique(pc.list_parent_indices(words).to_numpy() * np.int64(terms) + coded.indices.to_numpy(), return_counts=True)
                row, term = np.divmod(pairs, terms)
                yield pa.record_batch([key.take(pa.array(row)), coded.dictionary.take(pa.array(term)), pa.array(tf)], ["papyra_key", "term", "tf"])

    split = docs.select(F.col(id_col).alias("papyra_key"), tokens(F.col(text_col)).alias("papyra_words"))
    schema = T.StructType([T.StructField("papyra_key", docs.schema[id_col].dataType), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    counts = split.mapInArrow(run, schema).withColumnRenamed("papyra_key", id_col)
    several = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return counts.groupBy(id_col, "term").agg(F.sum("tf").alias("tf")) if several else counts


def term_uses(folded: Column, term: str) -> Column:
    """How often a term is a word of a lower-case text; the pattern runs only where the text holds the term at all."""
    return F.when(F.contains(folded, F.lit(term)), F.regexp_count(folded, F.lit(rf"(?U)(?<!\w){term}(?!\w)"))).otherwise(0)


def bm25_scores(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """id, score of every document that holds a term of the query; statistics over all documents.

    Only the query's terms leave the scan: lengths and frequencies are counted per document, so what is shuffled are
    three sums and one row for each term.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    folded = F.lower(F.col(text_col))
    rows = docs.select(id_col, F.regexp_count(folded, F.lit(r"(?U)\w{2,}")).alias("length"), F.array(*[term_uses(folded, t) for t in terms]).alias("tf"))
    stats = rows.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[k] > 0).alias(f"df{k}") for k in range(len(terms))])
    hits = rows.where(F.exists("tf", lambda n: n > 0)).crossJoin(F.broadcast(stats))  # one row of sums
    part = lambda k: F.when(F.col("tf")[k] > 0, bm25(F.col("tf")[k], F.col("length"), F.col("mean"), idf(F.col("documents"), F.col(f"df{k}")))).otherwise(0.0)
    return hits.select(id_col, sum((part(k) for k in range(1, len(terms))), part(0)).alias("score"))


def top(scored: DataFrame, id_col: str, k: int) -> DataFrame:
    """The k rows of highest score with their rank, ties by id."""
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    from pyspark.sql import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def substring_scores(docs: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """id, score: how often the query's terms occur in a text, within words too; where none does, no row."""
    total = lambda text: sum((occurrences(text, F.lit(t)) for t in query_terms(query)), F.lit(0))
    score = once(once(F.lower(F.col(text_col)), fold_lower), total)
    return docs.select(id_col, F.explode(F.filter(F.array(score), lambda n: n > 0)).alias("score"))  # a filter on top would work it out again


def slices(batches: Iterator[pa.RecordBatch], most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The rows of batches (key, words) in runs of about `most` words; a row of more is a run of its own."""
    for batch in batches:
        ends, start = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, done + most, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def hashed_embeddings(docs: DataFrame, id_col: str, text_col: str, dimensions: int = 64) -> DataFrame:
    """id, slot, value: signed hashed term frequencies of unit length, without the zeros.

    A row is folded where it lies, without a shuffle; each distinct term of a batch is hashed once. Rows without terms
    and null texts have no slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            key, words = batch.columns
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            terms = len(coded.dictionary)
            digests = [sha256(t.encode()).digest() for t in coded.dictionary.to_pylist()]
            slot = np.array([int.from_bytes(d[:4]) % dimensions for d in digests], "int64")
            sign = np.array([-1.0 if d[4] % 2 else 1.0 for d in digests])
            pairs, tf = np.unique(pc.list_parent_indices(words).to_numpy() * np.int64(terms) + coded.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(pairs, terms)
            cells, cell = np.unique(row * dimensions + slot[term], return_inverse=True)
            value = np.bincount(cell, sign[term] * (1 + np.log(tf)))
            kept = np.abs(value) > 1e-12
            row, value = cells[kept] // dimensions, value[kept]
            length = np.sqrt(np.bincount(row, value * value, minlength=batch.num_rows))
            yield pa.record_batch([key.take(pa.array(row)), pa.array(cells[kept] % dimensions, pa.int32()), pa.array(value / length[row])], ["papyra_key", "slot", "value"])

    split = docs.select(F.col(id_col).alias("papyra_key"), tokens(F.col(text_col)).alias("papyra_words"))
    schema = T.StructType([T.StructField("papyra_key", docs.schema[id_col].dataType), T.StructField("slot", T.IntegerType()), T.StructField("value", T.DoubleType())])
    return split.mapInArrow(run, schema).withColumnRenamed("papyra_key", id_col)


def vector_scores(vectors: DataFrame, probe: list[float], id_col: str, vector_col: str, weight: Column | None = None) -> DataFrame:
    """id, score: weighted inner products with a probe, those above zero."""
    score = dot(F.col(vector_col), F.array(*[F.lit(float(x)) for x in probe])) * (F.lit(1.0) if weight is None else weight)
    return vectors.select(id_col, score.alias("score")).where("score > 0")


def fused(words: DataFrame, vectors: DataFrame, id_col: str, weight_col: str | None = None) -> DataFrame:
    """id, score of two ranked lists (id, rank, score): reciprocal ranks of a word hit alone, else a mix of both.

    weight_col, in both lists, weighs a row's word part and then the mix that holds it.
    """
    weight = F.lit(1.0) if weight_col is None else F.col(weight_col)
    a = words.select(id_col, (weight / (F.col("rank") + 1)).alias("word_part"))
    b = vectors.select(id_col, weight.alias("weight"), F.col("score").alias("vector_score"), (1 / (F.col("rank") + 1)).alias("vector_part"))
    mix = F.col("weight") * (0.65 * F.coalesce("word_part", F.lit(0.0)) + 0.35 * (F.greatest("vector_score", F.lit(0.0)) + F.col("vector_part")))
    return a.join(b, id_col, "full_outer").select(id_col, F.when(F.col("vector_part").isNull(), F.col("word_part")).otherwise(mix).alias("score"))


def best_title(pages: DataFrame, wanted: str, id_col: str, title: Column) -> DataFrame:
    """id, tier of each title: 0 equal, 1 one holds the other, 2 neither."""
    from papyra.functions.text import title_key

    key, want = title_key(title), title_key(F.lit(wanted))
    return pages.select(id_col, F.when(key == want, 0).when((key != "") & (F.contains(key, want) | F.contains(want, key)), 1).otherwise(2).alias("tier"))


def picked_title(candidates: DataFrame, group: str, wanted: Column, title: Column, order: str) -> DataFrame:
    """group, order, tier: of each group's candidates the first whose folded title is the wanted one, else the first of which one holds the other, else the first of all."""
    from papyra.functions.text import title_key

    key, want = title_key(F.coalesce(title, F.lit(""))), title_key(wanted)
    tier = F.when(key == want, 0).when(F.contains(key, want) | F.contains(want, key), 1).otherwise(2)
    return candidates.select(group, order, tier.alias("tier")).groupBy(group).agg(F.min(F.struct("tier", order)).alias("best")).select(group, f"best.{order}", "best.tier")
