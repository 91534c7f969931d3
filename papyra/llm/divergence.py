"""How the sources of a language differ in their use of terms, and by which terms each stands out.

Terms are counted where documents lie, as exact strings, and shuffled once by language and term. The terms that at least
LEAST documents of a language use are dealt out in blocks. A block is a dense matrix of its language's sources by its
terms: probabilities in parts of 10^9, all pairs of sources by broadcasting, all in numpy's int64. The partial matrices
of pairs are summed, and each block's best terms of a source are merged into the source's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm.common import slices, texts_of, written
from papyra.llm.terms import coded, encoded, folded, in_parts, spans

#: Documents that must use a term, terms that are told of a group.
LEAST, TOP = 3, 200
#: Probabilities are integers of this unit.
UNIT = 1_000_000_000
#: Numbers in a block's matrix, about; numbers that are worked on at once.
TILE, AT_ONCE = 1 << 17, 1 << 20
#: Text that is counted together.
SLICE = 8 << 20
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
COUNT = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def counted(docs: DataFrame) -> DataFrame:
    """COUNT: occurrences and documents of each term in each slice of documents (lang, source, text), and a row of the empty term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            groups = pa.StructArray.from_arrays([batch.column(c) for c in ("lang", "source")], ["lang", "source"])
            pairs = sorted({(x["lang"], x["source"]) for x in groups.to_pylist()})
            number = {x: k for k, x in enumerate(pairs)}
            of = np.array([number[x["lang"], x["source"]] for x in groups.to_pylist()], np.int64)
            texts, owner = [], []
            for k, text in enumerate(texts_of(batch.column("text"))):
                for part in in_parts(text, SLICE, bytes(range(65))):
                    texts.append(part)
                    owner.append(k)
            data, begins = encoded(texts)
            inside = LETTER[data]
            first, last = spans(inside)
            codes, terms = coded(data, inside, first, last)
            size = max(1, len(terms))
            row = np.array(owner, np.int64)[np.searchsorted(begins, first, "right") - 1]
            by_row, n = folded(row * size + codes, np.ones(len(codes), np.int64))
            by_group, n, docs_of = folded(of[by_row // size] * size + by_row % size, n, np.ones(len(by_row), np.int64))
            group, term = by_group // size, terms.take(pa.array(by_group % size))
            take, zero = np.append(group, np.arange(len(pairs))), np.zeros(len(pairs), np.int64)
            names = [pa.array([x[k] for x in pairs], pa.string()).take(pa.array(take)) for k in (0, 1)]
            numbers = [pa.array(np.append(x, zero)) for x in (n, docs_of)]
            yield pa.RecordBatch.from_arrays([*names, pa.concat_arrays([term, pa.array([""] * len(pairs), pa.string())]), *numbers], [x.split()[0] for x in COUNT.split(", ")])

    return docs.mapInArrow(run, COUNT)


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, n, lead: the terms that `least` documents of the language use; lead is 1 in one row of each term. Rows of the empty term stand for the groups. Written once."""
    of_term = Window.partitionBy("lang", "term")
    rows = counted(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = rows.withColumn("docs", F.sum("docs").over(of_term)).where((F.col("docs") >= least) | (F.col("term") == ""))
    lead = (F.row_number().over(of_term.orderBy("source")) == 1) & (F.col("term") != "")
    return written(rows.select("lang", "source", "term", "n", lead.cast("long").alias("lead")), "terms")


def parts_of(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), digit by digit so that products stay below 2^63 (total below 9 * 10^15)."""
    rest, out = count + 1, np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        rest = rest - digit * total
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); both are at most UNIT + 1, so squares stay below 2^63."""
    return (p - q) ** 2 // q


def block(lang: str, terms: pa.Table, totals: pa.Table, top: int = TOP) -> pa.Table:
    """FOUND of one block: partial sums of all pairs of sources, and the best terms of each source. totals: source, total (of its kept terms), size (terms of the language)."""
    sources = sorted(totals.column("source").to_pylist())
    at = {x: k for k, x in enumerate(sources)}
    by_source = dict(zip(totals.column("source").to_pylist(), totals.column("total").to_pylist(), strict=True))
    size = totals.column("size")[0].as_py()
    total = np.array([by_source[x] + size for x in sources], np.int64)
    found = terms.column("term").combine_chunks().dictionary_encode()
    names, code = found.dictionary.to_pylist(), found.indices.to_numpy()
    count = np.zeros((len(sources), len(names)), np.int64)
    row = np.array([at[x] for x in terms.column("source").to_pylist()], np.int64)
    count[row, code] = terms.column("n").to_numpy()
    p = parts_of(count, total[:, None])
    out = []
    step = max(1, AT_ONCE // max(1, p.size))
    for a in range(0, len(sources), step):
        pairs = divergence(p[a : a + step, None], p[None]).sum(axis=2)
        other = np.tile(np.arange(len(sources)), len(pairs))
        own = np.repeat(np.arange(a, a + len(pairs)), len(sources))
        keep = own != other
        out.append((own[keep], "pair", pa.array(sources, pa.string()).take(pa.array(other[keep])), pairs.ravel()[keep]))
    whole = parts_of(count.sum(axis=0), np.array(sum(by_source.values()) + size, np.int64)) if len(names) else np.zeros(0, np.int64)
    rank = np.argsort(np.argsort(np.array([x.encode() for x in names], object))) if names else np.zeros(0, np.int64)
    for k in range(len(sources)):
        own = np.flatnonzero((count[k] > 0) & (p[k] > whole))
        value = divergence(p[k, own], whole[own])
        best = np.lexsort((rank[own], -value))[:top]
        out.append((np.full(len(best), k), "term", pa.array([names[x] for x in own[best]], pa.string()), value[best]))
    rows = sum(len(x[0]) for x in out)
    columns = [pa.array([lang] * rows, pa.string()), pa.array(sources, pa.string()).take(pa.array(np.concatenate([x[0] for x in out]))), pa.array([x[1] for x in out for _ in x[0]], pa.string()), pa.concat_arrays([x[2] for x in out]), pa.array(np.concatenate([x[3] for x in out]))]
    return pa.table(columns, [x.split()[0] for x in FOUND.split(", ")])


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language lies from each other one (part `pair`), and the `top` terms it uses more than its language does (part `term`).

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII. Null texts, languages and sources count as
    empty ones; every row is a document, repeated rows too. Groups without terms, and languages of which no term is kept,
    take part with counts of 0. Of equal values the lesser item in UTF-8 order ranks first. Empty tables give no rows.
    Columns besides the three aren't read.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    kept = kept_terms(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")), least)
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang").agg(F.sum("lead").alias("size"), F.count_if(F.col("term") == "").alias("sources"))
    width = F.greatest(F.lit(16), F.floor(F.lit(TILE) / F.col("sources")))
    size = size.select("lang", "size", F.greatest(F.lit(1), F.ceil(F.col("size") / width)).cast("long").alias("blocks"))
    terms = kept.where("term <> ''").join(size, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n")
    everywhere = totals.join(size, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "size")
    everywhere = everywhere.toDF(*everywhere.columns)  # columns of its own, as both sides come from one table

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return block(key[0].as_py(), left, right, top)

    found = terms.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(run, FOUND)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
