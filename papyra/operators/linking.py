"""Terms and references from tables, found in texts: many patterns at once by an automaton or by their first words, replaced by the longest first."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code and formulas, which nothing is replaced in (fixed value).
GUARD = re.compile(r"(`[^`]*`|\$\$.*?\$\$|\$[^$]*\$)", re.S)
#: Bytes of sources and targets up to which a table of terms is broadcast; a larger one is joined by words.
BROADCAST_BYTES = 32 << 20
RUN = re.compile(r"[\w-]+")


@cache
def _even(c: str) -> str:
    """A character that stands for all that a pattern blind to case takes for c."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


def even(text: str) -> str:
    """A text with one spelling for what patterns blind to case can't tell apart."""
    return text.lower() if text.isascii() else "".join(map(_even, text))


class Matcher:
    """All terms as one automaton."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        kept = sorted(((s, t) for s, t in pairs if s), key=lambda x: -len(x[0]))
        self.pairs, self.automaton, at = kept, ahocorasick.Automaton(), {}
        for k, (s, _) in enumerate(kept):
            at.setdefault(even(s), []).append(k)
        for s, places in at.items():
            self.automaton.add_word(s, places)
        if at:
            self.automaton.make_automaton()
        self.patterns: dict[int, re.Pattern] = {}

    def pattern(self, k: int) -> re.Pattern:
        """The pattern of term k, compiled when it is first needed."""
        if (found := self.patterns.get(k)) is None:
            if len(self.patterns) > 50_000:
                self.patterns.clear()
            found = self.patterns[k] = re.compile(rf"(?<![\w-]){re.escape(self.pairs[k][0])}(?![\w-])", re.I)
        return found

    def near(self, text: str, after: int = -1) -> list[int]:
        """Places of the terms beyond `after` whose letters stand somewhere in a text, in order."""
        if not self.pairs:
            return []
        return sorted({k for _, places in self.automaton.iter(even(text)) for k in places if k > after})

    def mentioned(self, text: str) -> list[int]:
        """Places of the terms that a text holds whole."""
        return [k for k in self.near(text) if self.pattern(k).search(text)]

    def replaced(self, text: str) -> str:
        """The text after every term in turn has been replaced, as going through all of them would leave it: whatever a target brings is met by the terms that follow."""
        todo, last = self.near(text), -1
        while todo:
            k = todo.pop(0)
            target = self.pairs[k][1]
            changed = self.pattern(k).sub(lambda _, t=target: t, text)
            last = k
            if changed != text:
                text = changed
                todo = self.near(text, last)
        return text

    def replaced_outside(self, markdown: str) -> str:
        """replaced() for what is neither code nor a formula."""
        parts = GUARD.split(markdown)
        parts[::2] = map(self.replaced, parts[::2])
        return "".join(parts)


def first_run(text: str) -> str | None:
    """The first word of a term, by which it is looked for; None for a term without one."""
    found = RUN.search(text)
    return even(found[0]) if found else None


def _fits(terms: DataFrame, most: int) -> bool:
    """Whether a table (source, target) has at most `most` bytes."""
    return (terms.select(F.sum(F.octet_length("source") + F.octet_length(F.coalesce("target", F.lit(""))) + 64)).first()[0] or 0) <= most


def _clean(terms: DataFrame, source: str, target: str | None) -> DataFrame:
    """source, target: the terms that aren't empty, each source once (the least target)."""
    rows = terms.select(F.col(source).cast("string").alias("source"), (F.col(target).cast("string") if target else F.lit("")).alias("target"))
    return rows.where("source <> '' AND target IS NOT NULL").groupBy("source").agg(F.min("target").alias("target"))


def _runs():
    """Distinct words of texts, evened, as a column of arrays."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({even(x) for x in RUN.findall(t or "")}))

    return run


def _pairs_of(rows: list) -> list[tuple[str, str]]:
    """Terms in an order of their own where lengths are equal."""
    return sorted((r["source"], r["target"]) for r in rows)


def _shared_matcher(terms: DataFrame):
    """A function for tasks that gives the matcher of a broadcast table, built once a worker."""
    shared = terms.sparkSession.sparkContext.broadcast(_pairs_of(terms.collect()))
    held: list[Matcher] = []

    def get() -> Matcher:
        if not held:
            held.append(Matcher(shared.value))
        return held[0]

    return get


def _matchers(most: int = 20_000):
    """A function that gives the matcher of terms (sources, targets) and keeps those of up to about `most` terms for others with the same."""
    held: dict[tuple, Matcher] = {}
    size = 0

    def get(sources, targets) -> Matcher:
        nonlocal size
        if (found := held.get(key := (*sources, *targets))) is None:
            if (size := size + len(sources)) > most:
                held.clear()
                size = len(sources)
            found = held[key] = Matcher(sorted(zip(sources, targets, strict=True)))
        return found

    return get


def with_terms(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, papyra_terms: of each id the terms (source, target) that may come up while they are replaced.

    A term comes up only if its first word stands in the text or in the target of a term that comes up. Which words lead to
    which is worked out over words alone, those that texts hold; texts meet a word's terms as one row, so what is moved are a
    few rows for each text, not one for each of its terms. Texts that share all their words with nothing have no row.
    """
    runs = _runs()
    keyed = _kept(terms.select("source", "target", F.get(_first_runs()(F.col("source")), F.lit(0)).alias("run")))
    if not keyed.where("run IS NULL").isEmpty():
        raise ValueError("terms without a word are replaced only where the table is small enough to be broadcast")
    firsts = keyed.select("run").distinct().hint("merge")
    words = docs.select(id_col, F.explode(runs(F.col(text_col))).alias("run"))
    steps = keyed.select(F.col("run").alias("papyra_from"), F.explode(runs(F.col("target"))).alias("run")).distinct().join(firsts, "run", "left_semi")
    steps = _kept(steps.select("papyra_from", "run"))
    found = _kept(words.select("run").distinct().join(firsts, "run").select(F.col("run").alias("papyra_word"), "run"))  # a semi join would go before distinct
    more = found
    while True:
        more = more.select("papyra_word", F.col("run").alias("papyra_from")).join(steps, "papyra_from").select("papyra_word", "run").distinct()
        more = _kept(more.join(found, ["papyra_word", "run"], "left_anti"))
        if more.isEmpty():
            break
        found = found.unionByName(more)
    own = found.join(keyed.hint("merge"), "run").groupBy("papyra_word").agg(F.array_sort(F.collect_set(F.struct("source", "target"))).alias("papyra_own"))
    # neither side is broadcast: what texts grow to by their words isn't known beforehand
    met = words.join(own.hint("merge"), F.col("run") == F.col("papyra_word")).groupBy(id_col).agg(F.collect_set("papyra_own").alias("papyra_own"))
    return met.select(id_col, F.array_distinct(F.flatten("papyra_own")).alias("papyra_terms"))


def _kept(rows: DataFrame) -> DataFrame:
    """Rows that are worked out once."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows.cache()


def _first_runs():
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [x] if (x := first_run(t or "")) is not None else [])

    return run


def glossary_applied(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, source: str = "source", target: str = "target", most: int = BROADCAST_BYTES) -> DataFrame:
    """docs with every term of a table replaced in a text, outside code and formulas, blind to case, the longest source first.

    The result is that of going through all terms one after the other (equal lengths by source). Null texts stay null;
    terms without a source or target take no part, and of repeated sources the least target counts. A table of up to `most`
    bytes is broadcast; a larger one meets the texts by its terms' first words. ids tell rows apart on that way.
    """
    table = _clean(terms, source, target)
    if _fits(table, most):
        get = _shared_matcher(table)

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: get().replaced_outside(t), na_action="ignore")

        return docs.withColumn(text_col, run(F.col(text_col)))

    @F.pandas_udf("string")
    def own(texts: pd.Series, sources: pd.Series, targets: pd.Series) -> pd.Series:
        get = _matchers()
        return pd.Series([t if t is None or s is None else get(s, u).replaced_outside(t) for t, s, u in zip(texts, sources, targets, strict=True)], dtype="object")

    joined = docs.join(with_terms(docs, table, id_col, text_col).hint("merge"), id_col, "left")
    return joined.withColumn(text_col, own(F.col(text_col), F.col("papyra_terms.source"), F.col("papyra_terms.target"))).select(*docs.columns)


def mentions(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, source: str = "source", most: int = BROADCAST_BYTES) -> DataFrame:
    """id, source for each term of a table that a text holds whole, blind to case; repeated ids give a pair once."""
    table = _clean(terms, source, None)
    kind = f"papyra_id {docs.schema[id_col].dataType.simpleString()}, source string"
    rows = docs.select(F.col(id_col).alias("papyra_id"), F.col(text_col).cast("string").alias("papyra_text"))
    if _fits(table, most):
        get = _shared_matcher(table)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                m = get()
                found = [(i, m.pairs[k][0]) for i, t in zip(batch["papyra_id"], batch["papyra_text"], strict=True) if t for k in m.mentioned(t)]
                yield pd.DataFrame(found, columns=["papyra_id", "source"])

        return rows.mapInPandas(run, kind).distinct().withColumnRenamed("papyra_id", id_col)
    found = with_terms(rows, table.withColumn("target", F.lit("")), "papyra_id", "papyra_text").select("papyra_id", F.col("papyra_terms.source").alias("papyra_sources"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = _matchers()
        for batch in batches:
            out = []
            for i, t, f in zip(batch["papyra_id"], batch["papyra_text"], batch["papyra_sources"], strict=True):
                m = get(f, [""] * len(f))
                out += [(i, m.pairs[k][0]) for k in m.mentioned(t or "")]
            yield pd.DataFrame(out, columns=["papyra_id", "source"])

    return rows.join(found.hint("merge"), "papyra_id").mapInPandas(check, kind).distinct().withColumnRenamed("papyra_id", id_col)


#: How a text names a block by its kind (fixed values).
NAMED = {"figure": [r"\bFigure\s+{}\b", r"\bFig\.\s*{}\b"], "table": [r"\bTable\s+{}\b"], "section": [r"\b[Ss]ection\s+{}\b"], "subsection": [r"\b[Ss]ection\s+{}\b"], "subsubsection": [r"\b[Ss]ection\s+{}\b"], "equation": [r"\b[Ee]quation\s+{}\b"]}
CITED = re.compile(r"\[([0-9,\s–-]+)\]")


def linked_text(text: str, refs: list[tuple]) -> str:
    """A text whose references become links. refs: (href, label, kind of the block it names or `citation`), in order.

    Numbers of citations within brackets are linked each; other references where the text first names their block by
    the kind's first spelling that occurs.
    """
    cited = {label.strip(): href for href, label, kind in refs if kind == "citation"}

    def one(m: re.Match) -> str:
        pieces = re.split(r"(\s*,\s*)", m[1])
        return "".join(f"[\\[{p.strip()}\\]]({cited[p.strip()]})" if p.strip() in cited else p for p in pieces)

    if cited:
        text = CITED.sub(one, text)
    for href, label, kind in refs:
        for spelled in NAMED.get(kind, ()):
            changed = re.sub(spelled.format(re.escape(label)), lambda m, h=href: f"[{m[0]}]({h})", text, count=1, flags=re.A)
            if changed != text:
                text = changed
                break
    return text


def linked(blocks: DataFrame, refs: DataFrame, targets: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """blocks with references in their text as links.

    refs: (id_cols, place, href, label); targets: (the first of id_cols, href, kind), where kind is that of a block or
    `citation`. References to nothing are left as they are. Each text is worked on once, with the references of its own
    block alone.
    """
    owner = id_cols[0]
    known = refs.join(targets.select(owner, "href", F.col("kind").alias("papyra_kind")).dropDuplicates([owner, "href"]), [owner, "href"])
    known = known.where("trim(label) <> ''").groupBy(*id_cols).agg(F.array_sort(F.collect_list(F.struct("place", "href", "label", "papyra_kind"))).alias("papyra_refs"))

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or f is None else linked_text(t, [(x["href"], x["label"], x["papyra_kind"]) for x in f]) for t, f in zip(texts, found, strict=True)], dtype="object")

    return blocks.join(known, id_cols, "left").withColumn(text_col, run(F.col(text_col), F.col("papyra_refs"))).select(*blocks.columns)
