"""Feeds, taxonomies, bibliographies and manifests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions.text import attribute, collapse, html_text, last_year, preprint_id


def feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: entry_id, preprint, title, summary, published, updated, authors, categories."""
    schema = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return raw.select(
        F.col("id").alias("entry_id"),
        preprint_id(F.col("id")).alias("preprint"),
        collapse(F.col("title")).alias("title"),
        collapse(F.col("summary")).alias("summary"),
        F.try_to_timestamp("published").alias("published"),
        F.try_to_timestamp("updated").alias("updated"),
        F.transform("author", lambda a: collapse(a["name"])).alias("authors"),
        F.transform("category", lambda c: c["_term"]).alias("categories"),
    )


def taxonomy(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, place, area, category, name, description: `<h4>id (name)</h4>` under `<h2>area</h2>`, each with the paragraph after it."""
    tag = F.lit(r"(?s)<h2[^>]*>.*?</h2>|<h4[^>]*>.*?</h4>|<p[^>]*>.*?</p>")
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, tag, F.lit(0))).alias("place", "tag"))
    rows = rows.withColumn("kind", F.lower(F.regexp_extract("tag", r"^<(\w+)", 1))).withColumn("text", html_text(F.col("tag")))
    w = Window.partitionBy(id_col).orderBy("place")
    area = F.last(F.when(F.col("kind") == "h2", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.when(F.lead("kind").over(w) == "p", F.lead("text").over(w))
    found = rows.withColumn("area", area).withColumn("description", after).where("kind = 'h4'")
    return found.select(id_col, "place", "area", F.regexp_extract("text", r"^(\S+)\s*\(", 1).alias("category"), F.regexp_extract("text", r"\((.*)\)", 1).alias("name"), "description")


def bibliography(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, place, label, title, year, preprint, raw_text of `<li class="...bibitem...">` items."""
    item = F.lit(r'(?s)<li[^>]*class="[^"]*bibitem[^"]*"[^>]*>.*?</li>')
    rows = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, item, F.lit(0))).alias("place", "item"))
    blocks = F.regexp_extract_all("item", F.lit(r'(?s)<span[^>]*class="[^"]*bibblock[^"]*"[^>]*>(.*?)</span>'), F.lit(1))
    text = html_text(F.col("item"))
    second = html_text(F.try_element_at(F.col("blocks"), F.lit(2)))
    sentence = F.try_element_at(F.split(text, r"\.\s+"), F.lit(2))
    return rows.withColumn("blocks", blocks).select(id_col, "place", attribute(F.regexp_extract("item", r"^<li[^>]*>", 0), "id").alias("label"), F.coalesce(F.nullif(second, F.lit("")), sentence).alias("title"), last_year(text).alias("year"), preprint_id(text).alias("preprint"), text.alias("raw_text"))


def links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, place, href of every link."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("place", "href"))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """JSON manifests, one a file."""
    return spark.read.option("multiLine", True).json(path)


def first_full_day(rows: DataFrame, day: str, wanted: str, back: int = 7) -> DataFrame:
    """day, n of the latest day with rows, from the wanted one up to `back` days before it."""
    last = F.to_date(F.lit(wanted))
    found = rows.where(F.col(day).between(F.date_sub(last, back), last)).groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.desc("day")).limit(1)
