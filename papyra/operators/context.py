"""Computations along an order: neighbours, fills, islands, ordinals, chunks and renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(rows: DataFrame, group: str, order: str, text: str, reach: int = 2) -> DataFrame:
    """rows with `context`: the texts of `reach` rows before and after, without blanks and the row itself, line by line."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-reach, reach)
    near = F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))).over(w)
    kept = F.filter("papyra_near", lambda x: (F.trim(x["t"]) != "") & (x["o"] != F.col(order)))
    return rows.withColumn("papyra_near", near).withColumn("context", F.array_join(F.transform(kept, lambda x: x["t"]), "\n")).drop("papyra_near")


def filled(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last value that isn't null up to each, or the group's first where none came yet."""
    w = Window.partitionBy(group).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(before, F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def last_rows(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group, numbered from the oldest of them."""
    back = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    kept = rows.withColumn("papyra_back", back).where(F.col("papyra_back") <= n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).drop("papyra_back")


def islands(rows: DataFrame, group: str, order: str, breaks: Column, name: str = "island") -> DataFrame:
    """rows with the number of the run each is in; a run begins where `breaks` holds."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(breaks.cast("int")).over(w))


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, place, block_type, block_uid, markdown: headings, code and paragraphs of Markdown texts.

    A heading is a block; lines between blank lines or headings are one paragraph; a fenced block is one, blank lines
    and all.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("at", "line"))
    w = Window.partitionBy(id_col).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(upto)).withColumn("coded", fence | (F.col("fences") % 2 == 1))
    heading = ~F.col("coded") & F.col("line").rlike(r"^#{1,6}\s+\S")
    blank = ~F.col("coded") & (F.trim("line") == "")
    kind = F.when(F.col("coded"), "code").when(heading, "section").when(blank, "blank").otherwise("paragraph")
    lines = lines.withColumn("kind", kind)
    before = F.lag("kind").over(w)
    opens = F.col("coded") & fence & (F.col("fences") % 2 == 1)
    breaks = before.isNull() | (F.col("kind") == "section") | (before != F.col("kind")) | opens
    runs = lines.withColumn("run", F.sum(breaks.cast("int")).over(upto)).where("kind <> 'blank'")
    blocks = runs.groupBy(id_col, "run").agg(F.first("kind").alias("block_type"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    return numbered(blocks, id_col, "run", "block_type").drop("run").select(id_col, "place", "block_type", "block_uid", "markdown")


#: Letters that begin the identifiers of block types.
PREFIXES = {"section": "s", "paragraph": "p", "code": "c", "equation": "e", "figure": "f", "table": "t", "list": "l"}


def numbered(blocks: DataFrame, group: str, order: str, kind: str) -> DataFrame:
    """blocks with their place (five digits) and an identifier of a letter for the kind and its ordinal."""
    prefix = F.coalesce(F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[F.col(kind)], F.lit("b"))
    ordinal = F.row_number().over(Window.partitionBy(group, kind).orderBy(order))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return blocks.withColumn("block_uid", F.format_string("%s-%04d", prefix, ordinal)).withColumn("place", F.format_string("%05d", place))


def joined_text(rows: DataFrame, group: str, order: str, text: Column, between: str = "\n\n") -> DataFrame:
    """group, body: each group's texts in order."""
    items = rows.select(group, F.struct(F.col(order).alias("o"), text.alias("t")).alias("x"))
    return items.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), between).alias("body"))


def read_percent(rows: DataFrame, group: str, order: str, active: Column) -> DataFrame:
    """group, percent: how far the last active row of each group is."""
    w = Window.partitionBy(group).orderBy(order)
    placed = rows.withColumn("papyra_n", F.row_number().over(w)).withColumn("papyra_a", active)
    sums = placed.groupBy(group).agg(F.max(F.when(F.col("papyra_a"), F.col("papyra_n"))).alias("at"), F.count(F.lit(1)).alias("n"))
    return sums.select(group, F.least(F.lit(100), F.round(F.coalesce("at", F.lit(0)) * 100.0 / F.col("n")).cast("int")).alias("percent"))


def reading_time(events: DataFrame, keys: list[str], seconds: str, longest: float = 3600) -> DataFrame:
    """keys, seconds: reading time per key, each part kept within 0 and `longest`; keys without time are left out."""
    return events.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(float(longest)), F.col(seconds)))).alias("seconds")).where("seconds > 0")
