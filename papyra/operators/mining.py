"""Text mining: glossary candidates, term cards, library profiles, category hints and recommendations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import canonical_key, collapse, fold, mentions, replace_term, tokens

#: Words that neither begin nor end a phrase (fixed values).
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "we", "with"]
#: Phrases are dealt into 2 to this number of buckets, which are summed one after the other.
BUCKET_BITS = 12


def bare_phrases(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """id, phrase of every n-gram without a stopword at its ends. Longer ones are built from shorter ones, one word at a time."""
    words = F.col("papyra_words")
    grams, now = [], words
    for n in range(2, max(sizes) + 1):
        now = F.zip_with(now, F.slice(words, n, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))  # null past the last one
        grams += [now] if n in sizes else []
    rows = docs.select(id_col, tokens(F.col(text_col), 1).alias("papyra_words")).select(id_col, F.explode(F.flatten(F.array(*grams))).alias("phrase"))
    ends = [F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)]
    return rows.where(F.length("phrase").between(4, 100) & ~ends[0].isin(STOPWORDS) & ~ends[1].isin(STOPWORDS))


def phrases(docs: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """id, phrase of every n-gram without a stopword at its ends and with two words or more of letters."""
    return bare_phrases(docs, id_col, text_col, sizes).where(worded(F.col("phrase")))


def worded(phrase: Column) -> Column:
    """Whether a phrase has two words or more of letters."""
    return F.regexp_count(phrase, F.lit(r"(?U)(?<!\w)[\p{L}]{2,}(?!\w)")) >= 2


def _spans(words: pa.ListArray, most: int = 500_000) -> Iterator[pa.ListArray]:
    """Slices of whole rows, of `most` words in all unless one row has more."""
    ends, start = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(words):
        done = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, done + most, "right")), start + 1)
        yield words.slice(start, stop - start)
        start = stop


def _phrase_sums(words: pa.ListArray, sizes: tuple[int, ...]) -> tuple[np.ndarray, pa.StringArray, np.ndarray, np.ndarray] | None:
    """bucket, phrase, uses, documents of the n-grams of rows of words, by bucket.

    Words have numbers, and n-grams those of their first n - 1 words and their last; only phrases that are told become text.
    """
    coded, row = words.flatten().dictionary_encode(), pc.list_parent_indices(words).to_numpy().astype("int64")
    known, code = coded.dictionary, coded.indices.to_numpy().astype("int64")
    inner = ~pc.is_in(known, value_set=pa.array(STOPWORDS, known.type)).to_numpy(zero_copy_only=False)[code]
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(known).to_numpy().astype("int64")[code])])
    hashed = np.fromiter((crc32(w.encode()) for w in known.to_pylist()), "uint64", len(known))
    rows, levels, now, out = len(words), [], code, []
    for n in range(2, max(sizes) + 1):
        count = len(code) - n + 1
        if count <= 0:
            break
        key = now[:count] * len(known) + code[n - 1 :]
        if n in sizes:
            size = ends[n:] - ends[:count] + n - 1
            good = inner[:count] & inner[n - 1 :] & (size >= 4) & (size <= 100) & (row[:count] == row[n - 1 :])
            held, uses = np.unique(key[good] * rows + row[:count][good], return_counts=True)  # a phrase and row once
            rest, at, documents = np.unique(held // rows, return_index=True, return_counts=True)
            parts = []
            for level in reversed(levels):
                rest, last = np.divmod(rest, len(known))
                parts, rest = [last, *parts], level[rest]
            parts = [*np.divmod(rest, len(known)), *parts]
            mixed = np.zeros(len(at), "uint64")
            for x in parts:
                mixed = (mixed + hashed[x]) * np.uint64(0x9E3779B97F4A7C15)
            if len(at):
                out.append(((mixed >> np.uint64(64 - BUCKET_BITS)).astype("uint16"), parts, np.add.reduceat(uses, at), documents))
        if n < max(sizes):
            level, now = np.unique(key, return_inverse=True)
            levels.append(level)
    if not out:
        return None
    bucket = np.concatenate([x[0] for x in out])
    order = np.argsort(bucket, kind="stable")
    phrase = pa.concat_arrays([pc.binary_join_element_wise(*[known.take(pa.array(x)) for x in parts], " ") for _, parts, _, _ in out])
    return bucket[order], phrase.take(pa.array(order)), np.concatenate([x[2] for x in out])[order], np.concatenate([x[3] for x in out])[order]


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _phrase_counts(docs: DataFrame, text_col: str, least: int, sizes: tuple[int, ...], group: str | None = None) -> DataFrame:
    """(group,) phrase, uses, documents of the phrases used `least` times or more, before their words are looked at; each row is a document.

    Counts are taken within slices of half a million words of a batch. Most phrases are used once, so they are shuffled
    packed, one row a slice and bucket of phrases, and only what is used often enough leaves the sums as rows.
    """
    owner = f"papyra_group {docs.schema[group].dataType.simpleString()}" if group else "papyra_group int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners = batch.column(1).dictionary_encode("encode")
            for k, value in enumerate(owners.dictionary):
                for part in _spans(batch.column(0).filter(pc.equal(owners.indices, k)) if len(owners.dictionary) > 1 else batch.column(0)):
                    if (sums := _phrase_sums(part, sizes)) is None:
                        continue
                    starts = np.flatnonzero(np.diff(sums[0].astype("int32"), prepend=-1))
                    counts = pa.record_batch({"phrase": sums[1], "uses": pa.array(sums[2], pa.int32()), "documents": pa.array(sums[3], pa.int32())})
                    packed = [_packed(counts.slice(first, stop - first)) for first, stop in zip(starts, [*starts[1:], len(counts)], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(value, len(starts)), pa.array(sums[0][starts].astype("int32")), pa.array(packed, pa.binary())], ["papyra_group", "bucket", "sums"])

    def summed(parts: list[pa.Table]) -> pa.RecordBatch:
        sums = pa.concat_tables(parts).group_by(["papyra_group", "phrase"]).aggregate([("uses", "sum"), ("documents", "sum")]).rename_columns({"uses_sum": "uses", "documents_sum": "documents"})
        sums = sums.filter(pc.greater_equal(sums["uses"], least)).select(["papyra_group", "phrase", "uses", "documents"]).combine_chunks()
        return sums.to_batches()[0] if len(sums) else pa.RecordBatch.from_pylist([], sums.schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, last = [], 0, None
        for batch in batches:
            for owner, bucket, sums in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if held > 500_000 and bucket != last:  # all of a bucket's rows have come
                    yield summed(parts)
                    parts, held = [], 0
                part = pa.ipc.open_stream(sums.as_buffer()).read_all()
                parts.append(part.append_column("papyra_group", pa.repeat(owner, len(part))))
                held, last = held + len(part), bucket
        if parts:
            yield summed(parts)

    split = docs.select(tokens(F.col(text_col), 1).alias("papyra_words"), (F.col(group) if group else F.lit(0)).alias("papyra_group"))
    packed = split.mapInArrow(run, f"{owner}, bucket int, sums binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, f"{owner}, phrase string, uses long, documents long")


def glossary_candidates(docs: DataFrame, text_col: str, least: int = 2, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """phrase, uses, documents of phrases used `least` times or more; each row is a document, and null texts have none.

    The words of a phrase are looked at once for each phrase that is left.
    """
    return _phrase_counts(docs, text_col, least, sizes).where(worded(F.col("phrase"))).drop("papyra_group")


def phrase_uses(docs: DataFrame, group: str, text_col: str, least: int = 2, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """group, phrase, uses of phrases() used `least` times or more in a group."""
    return _phrase_counts(docs, text_col, least, sizes, group).where(worded(F.col("phrase"))).select(F.col("papyra_group").alias(group), "phrase", "uses")


def apply_glossary(text: Column, terms: dict[str, str], apart: bool = False) -> Column:
    """Terms replaced by their targets, the longest first; apart: as replace_term() has it."""
    for source in sorted(terms, key=lambda s: (-len(s), s)):
        text = replace_term(text, source, terms[source], apart=apart)
    return text


def affected(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, term for each term that a text mentions; the terms are constants, so nothing is joined."""
    found = F.filter(F.array(*[F.when(mentions(F.col(text_col), t), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    return docs.select(id_col, F.explode(found).alias("term"))


def protected_glossary(terms: dict[str, str]):
    """A pandas UDF that replaces terms outside code and math."""
    guard = re.compile(r"(```.*?```|`[^`]*`|\$\$.*?\$\$|\$[^$]*\$)", re.S)
    ordered = [(re.compile(rf"(?<![\w-]){re.escape(s)}(?![\w-])", re.I), terms[s]) for s in sorted(terms, key=lambda s: (-len(s), s))]

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        parts = guard.split(text)
        for k in range(0, len(parts), 2):
            for pattern, target in ordered:
                parts[k] = pattern.sub(lambda _, t=target: t, parts[k])
        return "".join(parts)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run


def acronyms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, acronym: runs of three capitals or more, by place in the text."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![A-Za-z0-9_])[A-Z]{3,}(?![A-Za-z0-9_])"), F.lit(0))
    return docs.select(id_col, F.posexplode(found).alias("at", "acronym"))


def term_cards(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, abbreviation, title, uses, documents: spelled-out acronyms, such as `Full Form (FF)`, folded by key.

    The title is that of the first document, and within it of the first place.
    """
    pair = F.lit(r"((?:[A-Z][\w-]+ ){1,6})\(([A-Z][A-Z0-9-]{1,9})\)")
    rows = docs.select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), pair, F.lit(0))).alias("at", "found"))
    rows = rows.select(id_col, "at", F.regexp_extract("found", r"\(([^)]*)\)", 1).alias("abbreviation"), collapse(F.regexp_replace("found", r"\([^)]*\)", "")).alias("title"))
    keyed = rows.withColumn("key", canonical_key(F.col("abbreviation"), F.col("title")))
    first = lambda c: F.min_by(c, F.struct(id_col, "at")).alias(c)
    return keyed.groupBy("key").agg(first("abbreviation"), first("title"), F.count(F.lit(1)).alias("uses"), F.countDistinct(id_col).alias("documents"))


def weighted_top(rows: DataFrame, key: str, weight: Column, place: Column, k: int) -> DataFrame:
    """The k keys of greatest weight; ties go to the one that came first."""
    sums = rows.groupBy(key).agg(F.sum(weight).alias("weight"), F.min(place).alias("first"))
    best = sums.orderBy(F.desc("weight"), "first", key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "first", key)))


def hint_scores(docs: DataFrame, hints: dict[str, dict[str, float]], id_col: str, text_col: str) -> DataFrame:
    """id, category, score: weighted counts of each category's hints in a text, those above zero."""
    text = F.lower(F.col(text_col))
    spaced = lambda h: r"\s+".join(re.escape(w) for w in h.split())
    count = lambda h: F.regexp_count(text, F.lit(rf"(?<![\w-]){spaced(h)}(?![\w-])"))
    scores = F.array(*[F.struct(F.lit(c).alias("category"), sum((count(h) * w for h, w in hs.items()), F.lit(0.0)).alias("score")) for c, hs in hints.items()])
    return docs.select(id_col, F.explode(scores).alias("s")).select(id_col, "s.category", "s.score").where("score > 0")


def recommended(candidates: DataFrame, owned: Column, primary: Column, overlap: Column, keywords: Column, terms: Column) -> DataFrame:
    """The candidates with a score: 1.6 for the primary category and bounded shares of the other signals, less 5 if owned."""
    score = 1.6 * primary.cast("double") + 0.35 * F.least(overlap, F.lit(4)) + 0.8 * F.least(keywords, F.lit(6)) + 0.12 * F.least(terms, F.lit(12)) - 5.0 * owned.cast("double")
    return candidates.withColumn("score", F.bround(score, 4))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many of the keywords, folded, stand anywhere in a folded text; repeated and blank ones don't count."""
    known = [k for k in dict.fromkeys(" ".join(k.split()).casefold() for k in keywords) if k]
    return sum((F.contains(fold(text), F.lit(k)).cast("int") for k in known), F.lit(0))


def seed_keywords(counts: DataFrame, library: str, most: int = 8, words: int = 4) -> DataFrame:
    """library, phrase, place: phrases picked by count, then length; one whose words earlier picks hold is passed over.

    counts: (library, phrase, uses) with a row for each phrase; those of more than `words` words take no part. Each
    partition goes through its phrases in order and keeps those that bring a word its earlier ones lack, which are all
    that can be picked: what it passes over, the picks hold too. It is done when it has more words than the picks can.
    """
    order = [F.desc("uses"), F.desc("papyra_n"), F.asc("phrase")]
    sized = counts.select(library, "phrase", "uses", F.size(F.split("phrase", " ")).alias("papyra_n")).where((F.col("papyra_n") <= words) & (F.col("phrase") != ""))

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, set()
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False, name=None):
                if (row[0],) != last:
                    last, held = (row[0],), set()
                if len(held) <= (most - 1) * words and not (new := set(row[1].split(" "))) <= held:
                    held |= new
                    rows.append(row)
            yield pd.DataFrame(rows, columns=batch.columns)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        held: set[str] = set()
        rows = []
        for row in group.sort_values(["uses", "papyra_n", "phrase"], ascending=[False, False, True]).itertuples(index=False, name=None):
            if len(rows) < most and not set(row[1].split(" ")) <= held:
                held |= set(row[1].split(" "))
                rows.append((row[0], row[1], len(rows) + 1))
        return pd.DataFrame(rows, columns=[library, "phrase", "place"])

    short = sized.sortWithinPartitions(library, *order).mapInPandas(kept, sized.schema)
    return short.groupBy(library).applyInPandas(pick, f"{library} string, phrase string, place long")
