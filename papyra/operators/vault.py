"""Notes of a vault: clips and term cards as Markdown, notes as entries, and notes with entries replaced or added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.text import collapse

#: Stands behind every place of an entry.
LAST = (1 << 31) - 1


def stripped(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def quoted(text: Column) -> Column:
    """A text's lines as a quotation; nothing for a blank text."""
    lines = F.transform(F.split(stripped(text), r"\r?\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x)))
    return F.when(stripped(text) == "", "").otherwise(F.array_join(lines, "\n"))


def anchor(prefix: str, *parts: Column) -> Column:
    """A block anchor: the parts in letters, digits and hyphens."""
    token = F.regexp_replace(F.concat_ws("-", F.lit(prefix), *parts), r"[^A-Za-z0-9-]+", "-")
    return F.concat(F.lit("^"), F.regexp_replace(token, r"^-+|-+$", ""))


def file_name(title: Column, default: str) -> Column:
    """A title as the name of a file."""
    name = F.regexp_replace(F.regexp_replace(stripped(title), r'[\\/:*?"<>|]+', "-"), r"\s+", " ")
    return F.coalesce(F.nullif(F.regexp_replace(name, r"^[ .]+|[ .]+$", ""), F.lit("")), F.lit(default))


def heading(*titles: Column, default: str = "Untitled paper") -> Column:
    """The first title that isn't blank, in one line."""
    return F.coalesce(*[F.nullif(collapse(t), F.lit("")) for t in titles], F.lit(default))


def clip(uid: Column, source: Column, translation: Column, article: Column, language: str, callout: str, title: str, tag: str, mark: Column) -> Column:
    """A block with its translation as a callout that ends with its anchor (fixed wording)."""
    lines = [F.concat(F.lit("### "), uid), F.lit(""), F.concat(F.lit(f"> [!{callout}] {title} · "), uid), F.lit("> **Source**"), quoted(F.coalesce(source, F.lit(""))), F.lit(">")]
    pending = F.coalesce(F.nullif(translation, F.lit("")), F.lit("_Translation pending._"))
    lines += [F.lit(f"> **Translation ({language})**"), quoted(pending), F.lit(">"), F.concat(F.lit("> Article: [[#"), article, F.lit("]]")), F.lit(f"> {tag}"), mark]
    return F.concat_ws("\n", *lines)


def card_entry(title: Column, body: Column, origin: Column, url: Column, tag: str, mark: Column) -> Column:
    """A term card as an entry that names where it comes from (fixed wording)."""
    made = F.when(origin == "ai_search", "_AI generated from this paper/search context._").otherwise("_AI generated from this paper context._")
    linked = (origin == "wikipedia") & (F.coalesce(url, F.lit("")) != "")
    source = F.when(linked, F.concat(F.lit("来源：[Wikipedia]("), url, F.lit(")"))).otherwise(made)
    return F.concat_ws("\n", F.concat(F.lit("### "), title), F.lit(""), stripped(F.coalesce(body, F.lit(""))), F.lit(""), source, F.lit(""), F.lit(tag), mark)


def entries(notes: DataFrame, note: str, text: str) -> DataFrame:
    """note, place, section, anchor, body: a note cut before each heading of the second and third level.

    section is the heading of the second level above an entry, empty before the first; anchor is null where there is none.
    """
    parts = notes.select(note, F.posexplode(F.split(text, r"\n(?=#{2,3} )")).alias("place", "body"))
    rows = parts.withColumn("body", stripped(F.col("body"))).where("body <> ''")
    top = F.when(F.col("body").startswith("## "), F.substring_index(F.substring("body", 4, LAST), "\n", 1))
    above = F.last(top, True).over(Window.partitionBy(note).orderBy("place"))
    mark = F.nullif(F.regexp_extract("body", r"(?m)^(\^[A-Za-z0-9-]+)\s*$", 1), F.lit(""))
    return rows.select(note, "place", F.coalesce(above, F.lit("")).alias("section"), mark.alias("anchor"), "body")


def upserted(old: DataFrame, new: DataFrame, note: str) -> DataFrame:
    """note, body of notes whose entries (as of entries()) are replaced by new ones (note, section, anchor, body, title).

    A new entry takes the place of the one with its anchor in the same section; others follow the section's last entry
    by folded title, and sections that a note lacks are added at its end. Entries without an anchor replace nothing.
    """
    fresh = new.select(note, "section", "anchor", F.col("body").alias("papyra_body"), F.lower("title").alias("papyra_title"))
    both = old.join(fresh, [note, "section", "anchor"], "full_outer")
    group = Window.partitionBy(note, "section")
    both = both.withColumn("papyra_at", F.min("place").over(group))
    order = ["papyra_at", "section", "place", "papyra_title", "anchor"]
    rank = F.row_number().over(group.orderBy(F.col("place").asc_nulls_last(), "papyra_title", "anchor"))
    title = F.when(F.col("papyra_at").isNull() & (rank == 1) & (F.col("section") != ""), F.concat(F.lit("## "), F.col("section"), F.lit("\n\n"))).otherwise("")
    body = F.concat(title, stripped(F.coalesce("papyra_body", "body")))
    far = lambda c: F.coalesce(F.col(c), F.lit(LAST)).alias(c)
    rows = both.select(note, F.struct(*[far(c) if c in ("papyra_at", "place") else F.col(c) for c in order], body.alias("body")).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["body"]), "\n\n")
    return rows.groupBy(note).agg(F.concat(text, F.lit("\n")).alias("body"))
