"""Notes: patches from answers, their review, and the document that accepted ones make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.rules import filled

#: Words of notes that must agree wherever they are written and read (fixed values).
HEADING, NO_REFS, CHAT_TITLE, OUTSIDE = "# Lecture Notes", "none", "Chat note", "external citation"
#: Letters of a title taken from an answer, and messages of a chat that go along (fixed values).
TITLE, LAST = 80, 12


def stripped(text: Column) -> Column:
    """A text without white space at its ends, line feeds too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def answer_title(content: Column) -> Column:
    """The first line of an answer, TITLE letters of it; of a blank one CHAT_TITLE."""
    first = F.element_at(F.split(stripped(content), r"\r\n|[\n\r\x0b\f]"), 1)
    return F.when(F.coalesce(stripped(content), F.lit("")) == "", CHAT_TITLE).otherwise(F.substring(first, 1, TITLE))


def note_of(title: Column, content: Column, refs: Column, outside: Column) -> Column:
    """An answer as Markdown: title, text, the blocks it refers to, and what it cites besides (an array of title, url, doi, arxiv_id)."""
    evidence = F.concat(F.lit("\n\nCurrent-paper evidence: "), F.array_join(F.transform(refs, lambda r: F.concat(F.lit("["), r, F.lit("]"))), ", "))
    label = lambda x: F.coalesce(*[F.nullif(x[c], F.lit("")) for c in ("title", "url", "doi", "arxiv_id")], F.lit(OUTSIDE))
    line = lambda x: F.concat(F.lit("- "), label(x), F.coalesce(F.concat(F.lit(" ("), F.nullif(x["url"], F.lit("")), F.lit(")")), F.lit("")))
    cited = F.concat(F.lit("\n\nExternal evidence:\n"), F.array_join(F.transform(outside, line), "\n"))
    text = F.concat(F.lit("## "), title, F.lit("\n\n"), stripped(content), F.when(F.size(refs) > 0, evidence).otherwise(""), F.when(F.size(outside) > 0, cited).otherwise(""))
    return F.concat(stripped(text), F.lit("\n"))


def patches_from_chat(messages: DataFrame, title: Column | None = None) -> DataFrame:
    """revision, message, title, patch, refs of the answers among messages (id, revision, role, content, refs, outside); other roles make no notes, and titles that are given go before the answer's own."""
    own = answer_title(F.col("content"))
    rows = messages.where("role = 'assistant'").withColumn("title", own if title is None else F.when(filled(title), title).otherwise(own))
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    outside = F.coalesce("outside", F.array().cast(messages.schema["outside"].dataType))
    return rows.select("revision", F.col("id").alias("message"), "title", note_of(F.col("title"), F.coalesce("content", F.lit("")), refs, outside).alias("patch"), refs.alias("refs"))


def reviewed(patches: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """patches (id, status, updated, ...) after decisions (id, status): the decided ones have that status as of now; the last decision of an id by `place` counts."""
    last = decisions.groupBy("id").agg(F.max_by("status", "place").alias("papyra_status"))
    rows = patches.join(last, "id", "left")
    decided = F.col("papyra_status").isNotNull()
    return rows.withColumns({"status": F.coalesce("papyra_status", "status"), "updated": F.when(decided, now).otherwise(F.col("updated"))}).select(*patches.columns)


def lecture_notes(revisions: DataFrame, patches: DataFrame, mark: str) -> DataFrame:
    """revision, body: a document for each revision (id), its accepted patches (id, revision, title, patch, refs, status, updated) in the order of their last change, each between marks."""
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("`"), r, F.lit("`"))), ", ")
    ends = [F.concat(F.lit(f"<!-- {slash}{mark}-note-patch:"), F.col("id").cast("string"), F.lit(" -->")) for slash in ("", "/")]
    said = F.when(F.size("refs") > 0, refs).otherwise(NO_REFS)
    part = F.concat(ends[0], F.lit("\n## "), "title", F.lit("\n\n"), stripped(F.col("patch")), F.lit("\n\nSource refs: "), said, F.lit("\n"), ends[1])
    accepted = patches.where("status = 'accepted'").select("revision", F.struct("updated", "id", part.alias("part")).alias("x"))
    parts = accepted.groupBy("revision").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]).alias("parts"))
    rows = revisions.select(F.col("id").alias("revision")).join(parts, "revision", "left")
    head = F.concat(F.lit(f"{HEADING}\n\nArticle revision: `"), F.col("revision").cast("string"), F.lit("`"))
    whole = F.array_join(F.concat(F.array(head), F.coalesce("parts", F.array().cast("array<string>"))), "\n\n")
    return rows.select("revision", F.concat(whole, F.lit("\n")).alias("body"))


def chat_lines(messages: DataFrame, last: int = LAST) -> DataFrame:
    """revision, chat: the last messages (revision, place, role, content, refs) of each chat, a line each, with what they refer to."""
    refs = F.array_join(F.transform("refs", lambda r: F.concat(F.lit("["), r, F.lit("]"))), ", ")
    line = F.concat("role", F.lit(": "), "content", F.when(F.size("refs") > 0, F.concat(F.lit(" refs: "), refs)).otherwise(""))
    recent = messages.withColumn("papyra_n", F.row_number().over(Window.partitionBy("revision").orderBy(F.desc("place")))).where(F.col("papyra_n") <= last)
    rows = recent.groupBy("revision").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("xs"))
    return rows.select("revision", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("chat"))


def evidence_around(blocks: DataFrame, group: str, place: str, uid: str, text: str) -> DataFrame:
    """group, uid, evidence: each block with the one before and the one after it, named and blank ones named alone."""
    one = F.concat(F.lit("["), uid, F.lit("] "), stripped(F.coalesce(text, F.lit(""))))
    near = Window.partitionBy(group).orderBy(place).rowsBetween(-1, 1)
    return blocks.select(group, uid, F.array_join(F.collect_list(one).over(near), "\n\n").alias("evidence"))
