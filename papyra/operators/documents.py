"""Documents replaced and deleted: what every table of a library holds afterwards, from what it held before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.rules import filled

#: What a revision is marked as once its document is stored (fixed value).
PARSED = "parsed"


def stored_blocks(blocks: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming blocks (id, revision, uid, ..., created), with the id and the creation of the block that has their uid already."""
    old = blocks.select("revision", "uid", F.col("id").alias("papyra_id"), F.col("created").alias("papyra_created"))
    rows = incoming.join(old, ["revision", "uid"], "left")
    now = {"id": F.coalesce("papyra_id", "id"), "created": F.coalesce("papyra_created", "created")}
    return rows.withColumns(now).select(*incoming.columns)


def rehomed(variants: DataFrame, blocks: DataFrame, now: Column) -> DataFrame:
    """variants (block_id, seen_uid, seen_hash, updated, ...) after their blocks (id, revision, uid, hash) were replaced.

    One that has seen its block's content takes the block's uid; one that has seen another content moves to the only block
    of the revision that has it, if there is one; all others, and those that remember no content, stay as they are.
    """
    here = blocks.select(F.col("id").alias("block_id"), "revision", F.col("uid").alias("papyra_uid"), F.col("hash").alias("papyra_hash"))
    once = blocks.groupBy("revision", "hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "uid")).alias("papyra_to")).where("n = 1").select("revision", F.col("hash").alias("seen_hash"), "papyra_to")
    rows = variants.join(here, "block_id", "left").join(once, ["revision", "seen_hash"], "left")
    known = filled(F.col("seen_hash")) & F.col("papyra_hash").isNotNull()
    same = known & (F.col("seen_hash") == F.col("papyra_hash"))
    renamed = same & ~F.col("seen_uid").eqNullSafe(F.col("papyra_uid"))
    moved = known & ~same & F.col("papyra_to").isNotNull()
    new = {
        "block_id": F.when(moved, F.col("papyra_to.id")).otherwise(F.col("block_id")),
        "seen_uid": F.when(moved, F.col("papyra_to.uid")).when(renamed, F.col("papyra_uid")).otherwise(F.col("seen_uid")),
        "updated": F.when(moved | renamed, now).otherwise(F.col("updated")),
    }
    return rows.withColumns(new).select(*variants.columns)


def replaced(tables: dict[str, DataFrame], incoming: DataFrame, assets: DataFrame, touched: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The tables after the documents of the touched revisions are the incoming blocks and assets.

    tables: revisions (id, status, updated), blocks (id, revision, uid, hash, text, created, ...), variants, embeddings
    (block_id), assets (revision) and index (block_id, revision, uid, text), some of them or all; touched: (revision).
    Blocks keep their ids by uid; those without a successor go, with their variants and embeddings. Other revisions stay
    as they are. A revision without incoming blocks loses all of its own.
    """
    other = lambda rows: rows.join(touched, "revision", "left_anti").select(*rows.columns)
    blocks = tables["blocks"]
    own = blocks.join(touched, "revision", "left_semi").select(*blocks.columns)
    stored = stored_blocks(own, incoming)
    stale = own.join(incoming, ["revision", "uid"], "left_anti").select(F.col("id").alias("block_id"))
    after = {"blocks": other(blocks).unionByName(stored)}
    left = lambda rows: rows.join(stale, "block_id", "left_anti").select(*rows.columns)
    if "variants" in tables:
        after["variants"] = rehomed(left(tables["variants"]), stored, now)
    if "embeddings" in tables:
        after["embeddings"] = left(tables["embeddings"])
    if "assets" in tables:
        after["assets"] = other(tables["assets"]).unionByName(assets)
    if "index" in tables:
        after["index"] = other(tables["index"]).unionByName(stored.where(filled(F.col("text"))).select(F.col("id").alias("block_id"), "revision", "uid", "text"))
    if "revisions" in tables:
        hit = tables["revisions"].join(touched.select(F.col("revision").alias("id"), F.lit(True).alias("papyra_hit")).distinct(), "id", "left")
        new = {"status": F.when(F.col("papyra_hit"), PARSED).otherwise(F.col("status")), "updated": F.when(F.col("papyra_hit"), now).otherwise(F.col("updated"))}
        after["revisions"] = hit.withColumns(new).select(*tables["revisions"].columns)
    return after


def deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after revisions are deleted: gone (revision) with all rows that name them or their blocks; families that have no revision left go too.

    tables: revisions (id, family), families (id), blocks (id, revision), and any others by a column `revision`, else
    `block_id`.
    """
    blocks = tables["blocks"].join(gone, "revision", "left_semi").select(F.col("id").alias("block_id"))
    after = {}
    for name, rows in tables.items():
        if name == "revisions":
            after[name] = rows.join(gone.select(F.col("revision").alias("id")), "id", "left_anti").select(*rows.columns)
        elif name != "families":
            key, what = ("revision", gone) if "revision" in rows.columns else ("block_id", blocks)
            after[name] = rows.join(what, key, "left_anti").select(*rows.columns)
    if "families" in tables:
        lost = tables["revisions"].join(gone.select(F.col("revision").alias("id")), "id", "left_semi").select(F.col("family").alias("id")).join(after["revisions"].select(F.col("family").alias("id")), "id", "left_anti")
        after["families"] = tables["families"].join(lost, "id", "left_anti").select(*tables["families"].columns)
    return after


def without_jobs_of(jobs: DataFrame, gone: DataFrame, payload: str, key: str = "library_id") -> DataFrame:
    """jobs whose JSON payload doesn't name one of the gone libraries (library_id) under `key`."""
    named = jobs.withColumn("papyra_named", F.get_json_object(payload, f"$.{key}"))
    return named.join(gone.select(F.col("library_id").alias("papyra_named")), "papyra_named", "left_anti").select(*jobs.columns)
