"""Sinks: documents as text, snapshots, and change feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.operators.context import joined_text

#: The line that marks generated documents.
NOTICE = "> Generated document."


def with_notice(body: Column, notice: str = NOTICE) -> Column:
    """A body that begins with the notice, once."""
    return F.when(body.startswith(notice), body).otherwise(F.concat(F.lit(notice + "\n\n"), body))


def with_assets(body: Column, files: Column, folder: Column, mark: str) -> Column:
    """A body whose asset marks become links to the asset's files, by lines; marks of assets without files go.

    files: a map from asset to the names of its files; mark: what asset comments begin with.
    """
    token = lambda e: F.concat(F.lit(f"<!-- {mark}-asset:"), e["key"], F.lit(" -->"))
    links = lambda e: F.array_join(F.transform(e["value"], lambda f: F.concat(F.lit("!["), e["key"], F.lit("]("), folder, F.lit("/"), f, F.lit(")"))), "\n")
    some = F.filter(F.map_entries(F.coalesce(files, F.create_map().cast("map<string,array<string>>"))), lambda e: F.size(e["value"]) > 0)
    linked = F.aggregate(some, body, lambda text, e: F.replace(text, token(e), links(e)))
    return F.regexp_replace(linked, rf"\n?<!-- {mark}-asset:[^>]+ -->\n?", "\n")


def rendered(blocks: DataFrame, group: str, order: str, kind: str, text: str, level: str | None = None) -> DataFrame:
    """group, body: blocks as one Markdown document each; sections get their level's number signs, code its fences."""
    marks = F.repeat(F.lit("#"), F.coalesce(F.col(level), F.lit(2)) if level else F.lit(2))
    markdown = F.when((F.col(kind) == "section") & ~F.col(text).startswith("#"), F.concat(marks, F.lit(" "), F.col(text))).when((F.col(kind) == "equation") & ~F.col(text).startswith("$$"), F.concat(F.lit("$$\n"), F.col(text), F.lit("\n$$"))).otherwise(F.col(text))
    return joined_text(blocks, group, order, markdown)


def bilingual(blocks: DataFrame, translations: DataFrame, group: str, order: str, uid: str, text: str) -> DataFrame:
    """group, body: every block followed by its translation, where there is one. translations: (group, uid, translation)."""
    both = blocks.join(translations, [group, uid], "left")
    return joined_text(both, group, order, F.concat_ws("\n\n", F.col(text), F.col("translation")))


def write_documents(bodies: DataFrame, path: str, group: str) -> None:
    """Bodies as text files, one folder a document group."""
    bodies.select(F.col("body").alias("value"), group).write.partitionBy(group).mode("overwrite").text(path)


def write_snapshot(rows: DataFrame, path: str, *partition_by: str) -> None:
    """A table's next snapshot as Parquet."""
    (rows.write.partitionBy(*partition_by) if partition_by else rows.write).mode("overwrite").parquet(path)


def event_text(name: str, payload: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit(f"event: {name}\ndata: "), F.to_json(payload), F.lit("\n\n"))
