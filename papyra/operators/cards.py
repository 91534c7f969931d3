"""Reader cards: terms that papers introduce, found by ordered patterns, cleaned until nothing changes, folded by key and freed of redundant ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Patterns, word lists and edges.
FULL_THEN_SHORT = r"\b(?P<full>[A-Z][A-Za-z0-9][A-Za-z0-9 /,\-]{2,120}?)\s*\((?P<abbr>[A-Z][A-Z0-9\-]{1,16})\)"
SHORT_THEN_FULL = r"\b(?P<abbr>[A-Z][A-Z0-9\-]{1,16})\s*\((?P<full>[A-Z][A-Za-z0-9][A-Za-z0-9 /,\-]{2,120}?)\)"
CAPITALISED = r"\b(?:[A-Z][A-Za-z0-9+\-]+)(?:\s+(?:of|and|for|in|with|to|the|[A-Z][A-Za-z0-9+\-]+)){1,5}\b"
ACRONYM = r"\b[A-Z][A-Z0-9]{2,12}(?:-[A-Z0-9]{1,8})?\b"
CAMEL = r"\b[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]+)+\b"
PROTECTED = r"(`[^`]*`|\$\$.*?\$\$|\$[^$]*\$|!\[[^\]]*]\([^)]*\)|\[[^\]]+]\([^)]*\))"
CITATION = r"[A-Z][A-Za-z]+[12][0-9]{3}[a-z]?"
LEADING = ["and", "or", "of", "for", "with", "without", "using", "via", "as", "in", "to", "from", "by", "on", "the", "a", "an", "this", "that", "these", "those", "our", "their"]
TRAILING = ["and", "or", "of", "for", "with", "without", "using", "via", "as", "in", "to", "from", "by", "on", "the", "a", "an"]
CONNECTORS = ["and", "as", "by", "for", "from", "in", "of", "on", "the", "to", "via", "with", "without"]
NO_ACRONYMS = ["AND", "APPENDIX", "ARE", "FIG", "FOR", "FROM", "HAS", "HAVE", "HTTP", "HTTPS", "IMG", "NOT", "OUR", "SEC", "SECTION", "TABLE", "THE", "THIS", "THAT", "WITH"]
NO_TERMS = ["This paper", "The paper", "In this", "We", "For", "This", "Figure", "Table", "Section", "Appendix"]
NO_FOLDED_TERMS = ["this paper", "the model", "the authors"]
EDGES = " \t\r\n.,;:()[]{}"
KINDS = ["paragraph", "abstract", "figure", "table"]
LONGEST, SHORTEST = 7, 3

_PAIRS = [re.compile(FULL_THEN_SHORT), re.compile(SHORT_THEN_FULL)]
_NAMES = [(re.compile(CAPITALISED), "technical_name"), (re.compile(ACRONYM), "acronym_or_dataset"), (re.compile(CAMEL), "method_name")]
_PROTECTED = re.compile(PROTECTED, re.S)
_CITATION, _CITATIONS = re.compile(CITATION), re.compile(rf"(?:\s+{CITATION})+$")
_ACRONYM, _CAMEL, _WORD = re.compile(ACRONYM), re.compile(CAMEL), re.compile(r"[A-Z][A-Za-z+\-]{2,}")
_LEADING = re.compile(rf"(?:{'|'.join(LEADING)})\s+", re.I)
_TRAILING = re.compile(rf"\b(?:{'|'.join(TRAILING)})\s*$", re.I)

FOUND = "key string, norm string, kind string, anchor string, title string, abbreviation string, full_form string, uid string, place long, at int"


def plain_text(markdown: str) -> str:
    """Markdown without code, formulas, links and marks, on one line."""
    return " ".join(re.sub(r"[*_#>|]+", " ", _PROTECTED.sub(" ", markdown)).split())


def clean_term(value: str) -> str:
    """A term without what stands at its edges: citations at its end once, words that lead in as long as there are any, then one that leads out."""
    term = _CITATIONS.sub("", re.sub(r"\s+", " ", value.strip(EDGES))).strip(EDGES)
    while lead := _LEADING.match(term):
        term = term[lead.end() :].strip(EDGES)
    return _TRAILING.sub("", term).strip(EDGES)


def clean_abbreviation(value: str) -> str:
    return re.sub(r"[^A-Za-z0-9-]+", "", value).upper()


def is_acronym(term: str) -> bool:
    return bool(_ACRONYM.fullmatch(term)) and term.upper() not in NO_ACRONYMS


def has_digit(term: str) -> bool:
    return any(c.isdigit() for c in term)


def is_valuable(value: str) -> bool:
    """Whether a term is worth a card: an acronym, something with a number, a compound name, or words that are all shaped like names."""
    term = clean_term(value)
    words = term.split()
    if len(term) < SHORTEST or not words or len(words) > LONGEST or term in NO_TERMS or term.casefold() in NO_FOLDED_TERMS:
        return False
    folded = [w.casefold() for w in words]
    if any(map(_CITATION.fullmatch, words)) or folded[0] in CONNECTORS or folded[-1] in CONNECTORS:
        return False
    if is_acronym(term) or has_digit(term):
        return True
    if len(words) == 1:
        return bool(_CAMEL.fullmatch(term))
    return not any(w in CONNECTORS for w in folded) and all(is_acronym(w) or has_digit(w) or _CAMEL.fullmatch(w) or _WORD.fullmatch(w) for w in words)


def singular(word: str) -> str:
    """An English noun's singular by its ending."""
    if len(word) <= 3 or word.endswith("ss") or not word.endswith("s"):
        return word
    if word.endswith("ies"):
        return word[:-3] + "y"
    return word[: -2 if word.endswith(("ses", "xes", "ches", "shes")) else -1]


def norm(full_form: str) -> str:
    """A full form's folded words in the singular, letters and digits alone."""
    letters = re.sub(r"[^a-z0-9\s]+", "", re.sub(r"[-_/]+", " ", full_form.casefold()))
    return " ".join(map(singular, letters.split()))


def candidates_of(markdown: str | None) -> Iterator[tuple]:
    """(key, norm, kind, anchor, title, abbreviation, full form) of each candidate of a block: pairs in either order first, then names, acronyms and compounds."""
    text = plain_text(markdown or "")
    for pattern in _PAIRS:
        for m in pattern.finditer(text):
            full, short = clean_term(m["full"]), clean_abbreviation(m["abbr"])
            words = norm(full)
            if full and short and words and full not in NO_TERMS:
                yield f"{short}::{words}", words, "abbreviation_pair", short, full, short, full
    for pattern, kind in _NAMES:
        for m in pattern.finditer(text):
            term = clean_term(m[0])
            words = norm(term)
            if words and is_valuable(term):
                yield f"term::{words}", words, kind, term, term, None, term


def found_candidates(blocks: DataFrame, group: str, uid: str, place: str, kind: str, text: str) -> DataFrame:
    """group and FOUND of the candidates of blocks of the KINDS; nothing is shuffled."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                rows = []
                for owner, u, p, markdown in batch.iloc[first : first + 512].itertuples(index=False, name=None):
                    rows += [(owner, *x, u, p, k) for k, x in enumerate(candidates_of(markdown))]
                yield pd.DataFrame(rows, columns=["papyra_group", *names])

    read = blocks.where(F.col(kind).isin(KINDS) & F.col(text).isNotNull()).select(F.col(group).alias("papyra_group"), F.col(uid).cast("string"), F.col(place).cast("long"), text)
    type_ = blocks.schema[group].dataType.simpleString()
    return read.mapInPandas(run, f"papyra_group {type_}, {FOUND}").withColumnRenamed("papyra_group", group)


def folded(found: DataFrame, group: str) -> DataFrame:
    """group, key, norm, kind, anchor, title, abbreviation, full_form, uses, uids: one row a key. Everything but the counts comes from the first candidate by place, the first abbreviation and full form from whoever has one."""
    order = F.struct("place", "at")
    first = lambda c: F.min_by(c, order).alias(c)
    some = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return found.groupBy(group, "key").agg(*[first(c) for c in ("norm", "kind", "anchor", "title")], some("abbreviation"), some("full_form"), F.count(F.lit(1)).alias("uses"), F.array_sort(F.collect_set("uid")).alias("uids"), F.min(order).alias("papyra_first"))


def reader_cards(blocks: DataFrame, group: str, uid: str, place: str, kind: str, text: str, limit: int | None = None) -> DataFrame:
    """group, key, kind, anchor, title, abbreviation, full_form, uses, uids, rank of each group's cards.

    Terms that a pair of the group spells out go unless they are pairs themselves, and pairs whose full form isn't worth a
    card go too. Order: pairs first, then by uses, then by folded title, then by place. Null texts have no candidates.
    """
    cards = folded(found_candidates(blocks, group, uid, place, kind, text), group)
    spelled = F.max(F.col("abbreviation").isNotNull()).over(Window.partitionBy(group, "norm"))  # blocks are gone through once

    @F.pandas_udf("boolean")
    def valuable(terms: pd.Series) -> pd.Series:
        return terms.map(is_valuable)

    @F.pandas_udf("string")
    def casefold(titles: pd.Series) -> pd.Series:
        return titles.map(str.casefold)

    rows = cards.withColumn("papyra_spelled", spelled).where(F.col("abbreviation").isNotNull() | ~F.col("papyra_spelled"))
    rows = rows.where(valuable(F.coalesce("full_form", "title")))
    order = [F.col("abbreviation").isNull(), F.desc("uses"), casefold(F.col("title")), "papyra_first", "key"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select(group, "key", "kind", "anchor", "title", "abbreviation", "full_form", "uses", "uids", "rank")


def visible_cards(cards: DataFrame) -> DataFrame:
    """The cards (source, status, card_type, full_form, title) that readers see: automatic candidates only while their term is clean and worth a card."""

    @F.pandas_udf("boolean")
    def stands(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: clean_term(t) == t.strip() and is_valuable(t))

    automatic = (F.col("source") == "auto_extract") & (F.col("status") == "candidate") & (F.col("card_type") == "term")
    term = F.coalesce(F.nullif("full_form", F.lit("")), "title", F.lit(""))
    return cards.withColumn("papyra_term", term).where(~F.coalesce(automatic, F.lit(False)) | stands(F.col("papyra_term"))).drop("papyra_term")


def summary(text, longest: int = 520):
    """The first two sentences of a text as plain lines, shortened to `longest` characters: markers of lists and headings go."""
    one = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    two = F.array_join(F.slice(F.split(one, r"(?<=[。.!?])\s+"), 1, 2), " ")
    cut = F.when(F.length(two) > longest, F.concat(F.rtrim(F.substring(two, 1, longest - 3)), F.lit("..."))).otherwise(two)
    return card_body(cut)


def card_body(text):
    """A card's text without markers of lists and headings at its lines, and without runs of empty lines."""
    for pattern, by in ((r"(?m)^\s*(?:[-*]|\d+[.)])\s+", ""), (r"(?m)^#{1,6}\s+", ""), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"^\s+|\s+$", "")
