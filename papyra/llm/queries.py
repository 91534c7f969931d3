"""The queries of this subpackage, by name: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import ann, audio, binary_pack, bpe, collocations, divergence, jaccard, language, lm, mixture, repeats, token_counts, toxicity
from papyra.llm.common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents, encoded and decoded by the multilingual ranks."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of each whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-bigram scores of every text of documents."""
    return lm.score(table(spark, sf_dir, "documents"))


def op4_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed id matrices with segment lengths and position resets, the matrices as checksums."""
    return binary_pack.summary(binary_pack.pack_documents(table(spark, sf_dir, "documents")))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text of documents, through a cache that is empty at first: each call stands for itself."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", fresh_path(spark, "token-counts"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by deficit round-robin over their sources."""
    return mixture.pack_mixture(table(spark, sf_dir, "documents"), checksums=True)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of 0.8 and more over five-word shingles."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as MPEG audio, read back and digested."""
    return audio.digests(audio.read_audio(audio.store_audio(table(spark, sf_dir, "documents"))))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words and more that documents share."""
    return repeats.repeated_passages(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of documents, learned from the labels of two thirds of the ids."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels"))))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations of 2 and 3 words, over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


#: DuckDB SQL of op11_collocations.
COLLOCATIONS = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d)),
g AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
f AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, size, count(*)::HUGEINT AS n FROM g GROUP BY ALL),
total AS (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY 1),
c AS (SELECT lang, phrase, size, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
cut AS (SELECT c.lang, c.phrase, c.size, a, k, x.n AS l, y.n AS r, 1000000 * a * a // (x.n * y.n) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1 : c.size], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT s.lang, s.phrase FROM c s JOIN c t ON s.lang = t.lang AND s.size = 2 AND t.size = 3 AND (s.w = t.w[1 : 2] OR s.w = t.w[2 : 3]) AND 100 * t.a >= 50 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, total.n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT * FROM best ANTI JOIN gone USING (lang, phrase)) JOIN total USING (lang) QUALIFY rank <= 2000
"""


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of documents, learned from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(language.training(docs)))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ in terms, over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


#: DuckDB SQL of op13_divergence.
DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT k, lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY ALL HAVING sum(docs) >= 3),
size AS (SELECT lang, coalesce(v, 0) AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY 1) USING (lang)),
own AS (SELECT lang, source, term, n FROM w SEMI JOIN kept USING (lang, term)),
g AS (SELECT lang, source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM own GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(own.n, 0) AS count, 1 + 1000000000::HUGEINT * (coalesce(own.n, 0) + 1) // (g.n + size.v) AS p
  FROM g JOIN size USING (lang) JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND s = a.source AND o = b.source),
best AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value
  FROM p JOIN (SELECT lang, term, 1 + 1000000000::HUGEINT * (kept.n + 1) // (size.n + size.v) AS q FROM kept JOIN size USING (lang)) USING (lang, term) WHERE count > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM best))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Query]:
    """Every query of this subpackage by its registered name."""
    return {f.__name__: f for f in (op1_bpe, op2_ann, op3_brown_lm, op4_packed, op5_token_counts, op6_mixture, op7_jaccard, op8_audio, op9_repeats, op10_toxicity, op11_collocations, op12_language, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express over whole tables."""
    return {"op11_collocations": COLLOCATIONS, "op13_divergence": DIVERGENCE}
