"""Files that documents name, looked up in listings: candidates by root and ending, ranked, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of graphics, in the order they are tried (fixed values).
SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".eps", ".svg", ".webp", ".gif"]
#: Archives of sources, in the order they are taken.
ARCHIVES = [".tar", ".tar.gz", ".tgz", ".zip", ".gz"]


def resolved(references: DataFrame, listing: DataFrame, id_col: str, reference: str, roots: list[str]) -> DataFrame:
    """references with path and status: the first file of a listing (id, path) that a reference may mean.

    Tried in order: each root, and in it the name as it is, then, for a name without an ending, with each of SUFFIXES.
    Absolute names are tried as they are and must lie within a root. status: found, missing, remote (with a scheme or host),
    empty, or refused (names that leave their root). Percent signs are decoded; queries and fragments don't count.
    """
    name = F.col(reference)
    bare = F.regexp_replace(name, r"[?#].*$", "")
    decoded = F.coalesce(F.expr("try_url_decode(replace(papyra_bare, '+', '%2B'))"), F.col("papyra_bare"))
    clean = F.regexp_replace(F.regexp_replace(decoded, "/(?:\\./)+", "/"), "^(?:\\./)+", "")
    remote, absolute = name.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), F.col("papyra_name").startswith("/")
    parts = F.split("papyra_name", "/")
    leaf = F.element_at(parts, -1)
    rows = references.withColumn("papyra_row", F.monotonically_increasing_id()).withColumn("papyra_bare", bare).withColumn("papyra_name", clean)
    status = F.when(remote, "remote").when(F.coalesce(F.col("papyra_name"), F.lit("")) == "", "empty").when(F.array_contains(parts, ".."), "refused").when(absolute & ~F.exists(F.array(*[F.lit(r.rstrip("/") + "/") for r in roots]), lambda r: F.startswith(F.col("papyra_name"), r)), "refused")
    rows = rows.withColumn("papyra_status", status)
    endings = F.when(leaf.rlike(r"^.+\.[^.]+$"), F.array(F.lit(""))).otherwise(F.array(F.lit(""), *[F.lit(s) for s in SUFFIXES]))
    bases = F.when(absolute, F.array(F.lit(""))).otherwise(F.array(*[F.lit(r.rstrip("/") + "/") for r in roots]))
    tried = F.flatten(F.transform(bases, lambda b: F.transform(endings, lambda e: F.concat(b, F.col("papyra_name"), e))))
    asked = rows.where("papyra_status IS NULL").select(F.col(id_col).alias("papyra_id"), "papyra_row", F.posexplode(tried).alias("papyra_rank", "papyra_path"))
    # a file that is listed twice needs no distinct in a semi join; Spark takes a listing or answer made from a small file for small, and would broadcast it
    known = listing.select(F.col(id_col).alias("papyra_known"), F.col("path").alias("papyra_there")).hint("merge")
    there = asked.join(known, (F.col("papyra_id") == F.col("papyra_known")) & (F.col("papyra_path") == F.col("papyra_there")), "left_semi")
    first = there.groupBy("papyra_row").agg(F.min("papyra_rank").alias("papyra_rank"))
    out = rows.join(first.hint("merge"), "papyra_row", "left").withColumn("papyra_path", F.get(tried, F.col("papyra_rank")))
    return out.select(*references.columns, F.col("papyra_path").alias("path"), F.coalesce("papyra_status", F.when(F.col("papyra_path").isNotNull(), "found").otherwise("missing")).alias("status"))


def source_archives(listing: DataFrame, id_col: str, stem: str = "source", endings: list[str] = ARCHIVES) -> DataFrame:
    """id, path of each document's archive of sources: the file called `stem` with the first ending that there is."""
    leaf = F.substring_index("path", "/", -1)
    rank = F.array_position(F.array(*[F.lit(stem + e) for e in endings]), leaf)
    return listing.withColumn("papyra_rank", rank).where("papyra_rank > 0").groupBy(id_col).agg(F.min_by("path", F.struct("papyra_rank", "path")).alias("path"))
