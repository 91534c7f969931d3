"""Documents that are replaced and deleted: documents as blocks of ten a revision, labels as their renderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import documents
from papyra.plans.registry import query


def tables_of(t):
    """A library: revisions of ten blocks in families of three revisions, renderings that have seen their block's text, another one or none, embeddings, and an index."""
    k = F.col("doc_id")
    ten = F.floor(k / 10)
    blocks = t("documents").select(k.alias("id"), ten.alias("revision"), F.concat(F.lit("b"), k.cast("string")).alias("uid"), F.sha2("text", 256).alias("hash"), "text", k.alias("created"))
    seen = F.when(k % 3 == 0, F.sha2("text", 256)).when(k % 3 == 2, F.sha2(F.concat("text", F.lit("x")), 256))
    variants = t("labels").join(t("documents").select("doc_id", "text"), "doc_id").select(k.alias("id"), k.alias("block_id"), seen.alias("seen_hash"), F.when(k % 4 > 0, F.concat(F.lit("b"), k.cast("string"))).alias("seen_uid"), F.lit(0).cast("long").alias("updated"))
    revisions = blocks.select(F.col("revision").alias("id")).distinct().select("id", F.floor(F.col("id") / 3).alias("family"), F.lit("imported").alias("status"), F.lit(0).cast("long").alias("updated"))
    index = blocks.where("trim(text) <> ''").select(F.col("id").alias("block_id"), "revision", "uid", "text")
    embeddings = t("embeddings").join(blocks.select(F.col("id").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("block_id"))
    families = revisions.select(F.col("family").alias("id")).distinct()
    return {"blocks": blocks, "variants": variants, "revisions": revisions, "index": index, "embeddings": embeddings, "families": families}


def incoming_of(t):
    """What a new parse brings for every other revision: of its ten blocks the first is gone, the second edited, the third and fourth have changed texts, the sixth came twice."""
    blocks = tables_of(t)["blocks"].where("revision % 2 = 1")
    place = F.col("id") % 10
    swap = F.when(place == 2, F.col("id") + 1).when(place == 3, F.col("id") - 1).otherwise(F.col("id"))
    other = blocks.select(F.col("id").alias("of"), F.col("text").alias("their"))
    rows = blocks.where("id % 10 > 0").withColumn("of", swap).join(other, "of", "left")
    text = F.when(place == 1, F.concat("text", F.lit(" edited"))).otherwise(F.coalesce("their", "text"))
    rows = rows.select((F.col("id") + 10_000_000).alias("id"), "revision", "uid", text.alias("text"))
    twice = rows.where("id % 10 = 5").select((F.col("id") + 10_000_000).alias("id"), "revision", F.concat(F.lit("n"), F.col("uid")).alias("uid"), "text")
    return rows.unionByName(twice).select("id", "revision", "uid", F.sha2("text", 256).alias("hash"), "text", F.lit(1).cast("long").alias("created"))


def after_replacing(t):
    tables = tables_of(t)
    touched = tables["revisions"].where("id % 2 = 1").select(F.col("id").alias("revision"))
    return documents.replaced(tables, incoming_of(t), None, touched, F.lit(9).cast("long"))


B = """b AS (SELECT doc_id AS id, doc_id // 10 AS revision, 'b' || doc_id AS uid, text FROM documents),
i AS (SELECT b.id, b.revision, b.uid, CASE WHEN b.id % 10 = 1 THEN b.text || ' edited' ELSE coalesce(o.text, b.text) END AS text FROM b LEFT JOIN b o ON o.id = CASE b.id % 10 WHEN 2 THEN b.id + 1 WHEN 3 THEN b.id - 1 ELSE b.id END WHERE b.revision % 2 = 1 AND b.id % 10 > 0),
j AS (SELECT id, revision, uid, text, id AS created FROM i UNION ALL SELECT id + 20000000, revision, 'n' || uid, text, 1 FROM i WHERE id % 10 = 5),
s AS (SELECT *, sha256(text) AS hash FROM j),
a AS (SELECT id, revision, uid, sha256(text) AS hash, id AS created FROM b WHERE revision % 2 = 0 UNION ALL SELECT id, revision, uid, hash, created FROM s)"""


@query(f"WITH {B} SELECT id, revision, uid, hash, created FROM a")
def replace_blocks(t):
    """Blocks after half of the documents were parsed again: ids stay by uid, stale ones are gone."""
    return after_replacing(t)["blocks"].select("id", "revision", "uid", "hash", "created")


@query(f"""WITH {B}, v AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN sha256(text) WHEN 2 THEN sha256(text || 'x') END AS seen_hash, CASE WHEN doc_id % 4 > 0 THEN 'b' || doc_id END AS seen_uid FROM labels JOIN documents USING (doc_id) WHERE NOT (doc_id // 10 % 2 = 1 AND doc_id % 10 = 0)),
u AS (SELECT revision, hash, min(id) AS id, min(uid) AS uid FROM s GROUP BY 1, 2 HAVING count(*) = 1)
SELECT v.id, CASE WHEN v.seen_hash <> s.hash AND u.id IS NOT NULL THEN u.id ELSE v.id END AS block_id, v.seen_hash,
  CASE WHEN v.seen_hash <> s.hash AND u.id IS NOT NULL THEN u.uid WHEN v.seen_hash = s.hash THEN s.uid ELSE v.seen_uid END AS seen_uid,
  CASE WHEN v.seen_hash <> s.hash AND u.id IS NOT NULL OR v.seen_hash = s.hash AND v.seen_uid IS DISTINCT FROM s.uid THEN 9 ELSE 0 END::BIGINT AS updated
FROM v LEFT JOIN s ON s.id = v.id LEFT JOIN u ON u.revision = s.revision AND u.hash = v.seen_hash""")
def replace_variants(t):
    """Renderings after the documents were replaced: moved to the block that has the text they have seen, or named anew."""
    return after_replacing(t)["variants"]


@query("""WITH b AS (SELECT doc_id AS id, doc_id // 10 AS revision FROM documents), r AS (SELECT DISTINCT revision AS id, revision // 3 AS family FROM b), k AS (SELECT * FROM r WHERE NOT (id % 5 = 0 OR family % 4 = 1))
SELECT 'blocks' AS name, count(*) AS n FROM b WHERE revision IN (SELECT id FROM k) UNION ALL SELECT 'revisions', count(*) FROM k UNION ALL SELECT 'families', count(DISTINCT family) FROM k
UNION ALL SELECT 'variants', count(*) FROM labels WHERE doc_id // 10 IN (SELECT id FROM k) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (SELECT id FROM b WHERE revision IN (SELECT id FROM k))
UNION ALL SELECT 'index', count(*) FROM documents WHERE trim(text) <> '' AND doc_id // 10 IN (SELECT id FROM k)""")
def delete_documents(t):
    """Rows of every table after revisions were deleted, and families that have none left with them."""
    tables = tables_of(t)
    gone = tables["revisions"].where("id % 5 = 0 OR family % 4 = 1").select(F.col("id").alias("revision"))
    after = documents.deleted(tables, gone)
    counts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in after.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT event_id, json_extract_string(props, '$.k') AS library FROM events WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k')::BIGINT % 3 > 0")
def delete_jobs(t):
    """Jobs that name none of the deleted libraries in their payload."""
    jobs = t("events").select("event_id", "props", F.get_json_object("props", "$.k").alias("library"))
    gone = jobs.where("CAST(library AS BIGINT) % 3 = 0").select(F.col("library").alias("library_id")).distinct()
    return documents.without_jobs_of(jobs, gone, "props", "k").drop("props")
