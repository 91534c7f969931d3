"""A reader's desk: notes, requests for renderings, article lists, seeds and keys, over documents, labels, conversations, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import library, notes, translation
from papyra.plans.registry import query

PATCHES = "p AS (SELECT doc_id AS id, source AS revision, 'T' || doc_id AS title, lang AS patch, ['b1', 'b2'][1 : doc_id % 3] AS refs, doc_id * 7919 % 1000 AS updated, CASE WHEN doc_id % 7 = 0 THEN 'rejected' WHEN doc_id % 4 < 2 THEN 'accepted' ELSE 'pending' END AS status FROM documents)"


def patches(t):
    """Documents as patches of notes for their source; one in seven is rejected in a review after all others."""
    k = F.col("doc_id")
    refs = F.slice(F.array(F.lit("b1"), F.lit("b2")), F.lit(1), (k % 3).cast("int"))
    rows = t("documents").select(k.alias("id"), F.col("source").alias("revision"), F.concat(F.lit("T"), k.cast("string")).alias("title"), F.concat(F.lit(" "), "lang", F.lit("\n")).alias("patch"), refs.alias("refs"), F.when(k % 4 < 2, "accepted").otherwise("pending").alias("status"), (k * 7919 % 1000).alias("updated"))
    decisions = rows.where("id % 7 = 0").select("id", F.explode(F.array(F.struct(F.lit(1).alias("place"), F.lit("accepted").alias("status")), F.struct(F.lit(2).alias("place"), F.lit("rejected").alias("status")))).alias("d")).select("id", "d.place", "d.status")
    return notes.reviewed(rows, decisions, F.lit(5000).cast("long"))


@query(f"""WITH {PATCHES}, a AS (SELECT revision, string_agg('<!-- papyra-note-patch:' || id || ' -->' || chr(10) || '## ' || title || chr(10) || chr(10) || patch || chr(10) || chr(10) || 'Source refs: ' || CASE len(refs) WHEN 0 THEN 'none' WHEN 1 THEN '`b1`' ELSE '`b1`, `b2`' END || chr(10) || '<!-- /papyra-note-patch:' || id || ' -->', chr(10) || chr(10) ORDER BY updated, id) AS parts FROM p WHERE status = 'accepted' GROUP BY 1)
SELECT r.revision, '# Lecture Notes' || chr(10) || chr(10) || 'Article revision: `' || r.revision || '`' || coalesce(chr(10) || chr(10) || parts, '') || chr(10) AS body FROM (SELECT DISTINCT revision FROM p) r LEFT JOIN a USING (revision)""")
def lecture_notes(t):
    """Notes of each revision from its accepted patches after a review."""
    rows = patches(t)
    return notes.lecture_notes(rows.select(F.col("revision").alias("id")).distinct(), rows, "papyra")


@query("""SELECT conv_id AS revision, turn AS message, 'Line ' || conv_id AS title, '## Line ' || conv_id || chr(10) || chr(10) || 'Line ' || conv_id || chr(10) || 'more' ||
  CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || 'Current-paper evidence: [b1]' ELSE chr(10) || chr(10) || 'Current-paper evidence: [b1], [b2]' END ||
  CASE WHEN conv_id % 2 = 0 THEN chr(10) || chr(10) || 'External evidence:' || chr(10) || '- T (u' || turn || ')' || chr(10) || '- u' || turn || ' (u' || turn || ')' || chr(10) || '- external citation' ELSE '' END || chr(10) AS patch FROM conversations WHERE role = 'assistant'""")
def chat_notes(t):
    """Answers of conversations as patches of notes."""
    turn = F.col("turn").cast("string")
    url = F.concat(F.lit("u"), turn)
    cited = F.array(*[F.struct(a.alias("title"), b.alias("url"), F.lit(None).cast("string").alias("doi"), F.lit("").alias("arxiv_id")) for a, b in ((F.lit("T"), url), (F.lit(""), url), (F.lit(None).cast("string"), F.lit(None).cast("string")))])
    outside = F.when(F.col("conv_id") % 2 == 0, cited)
    content = F.concat(F.lit("\n Line "), F.col("conv_id").cast("string"), F.lit("\nmore \n"))
    rows = t("conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("revision"), "role", content.alias("content"), F.slice(F.array(F.lit("b1"), F.lit("b2")), F.lit(1), (F.col("turn") % 3).cast("int")).alias("refs"), outside.alias("outside"))
    return notes.patches_from_chat(rows).drop("refs")


@query("""SELECT source, 'b' || doc_id AS uid, coalesce(lag(x) OVER w || chr(10) || chr(10), '') || x || coalesce(chr(10) || chr(10) || lead(x) OVER w, '') AS evidence
FROM (SELECT source, doc_id, '[b' || doc_id || '] ' || CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END AS x FROM documents) WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def card_evidence(t):
    """Blocks with their neighbours as evidence for a card."""
    text = F.when(F.col("doc_id") % 9 == 0, F.lit(" ")).otherwise(F.concat("lang", F.lit("\n")))
    rows = t("documents").select("source", "doc_id", F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("uid"), text.alias("text"))
    return notes.evidence_around(rows, "source", "doc_id", F.col("uid"), F.col("text"))


@query("""WITH b AS (SELECT doc_id AS id, source, lang, ['section', 'paragraph', 'list', 'code'][1 + doc_id % 4] AS kind, doc_id % 50 AS uid, CASE WHEN doc_id % 3 > 0 THEN 'v' || doc_id % 3 END AS version FROM documents),
j AS (SELECT event_id, event_id % 50 AS uid, CASE WHEN event_id % 3 > 0 THEN 'v' || event_id % 3 END AS version, ['queued', 'done', 'paused', 'failed'][1 + event_id % 4] AS status FROM events WHERE event_id < 40),
d AS (SELECT b.*, CASE WHEN kind NOT IN ('paragraph', 'list', 'figure', 'table') THEN 'skipped' WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'cached' WHEN EXISTS (SELECT 1 FROM j WHERE j.uid = b.uid AND j.version IS NOT DISTINCT FROM b.version AND status IN ('queued', 'paused')) THEN 'existing' ELSE 'queued' END AS decision FROM b)
SELECT source, count(*) FILTER (decision = 'queued') AS jobs_created, count(*) FILTER (decision = 'existing') AS existing_jobs, count(*) FILTER (decision = 'cached') AS cached_blocks, count(*) FILTER (decision = 'skipped') AS skipped_blocks FROM d GROUP BY 1""")
def translation_batch(t):
    """What becomes of the blocks of a request, by source: skipped, cached, already on their way, or queued."""
    k = F.col("doc_id")
    version = lambda c: F.when(c % 3 > 0, F.concat(F.lit("v"), (c % 3).cast("string")))
    kind = F.get(F.array(*[F.lit(x) for x in ("section", "paragraph", "list", "code")]), (k % 4).cast("int"))
    blocks = t("documents").select(k.alias("id"), "source", kind.alias("kind"), F.lit("x").alias("text"), (k % 50).alias("uid"), version(k).alias("version"))
    e = F.col("event_id")
    jobs = t("events").where("event_id < 40").select(e.alias("job"), e.alias("created"), F.get(F.array(*[F.lit(x) for x in ("queued", "done", "paused", "failed")]), (e % 4).cast("int")).alias("status"), (e % 50).alias("uid"), version(e).alias("version"))
    cached = t("labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return translation.batch_result(translation.decided(blocks, cached, jobs, ["uid", "version"]), "source")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS m, p_name AS n FROM part)
SELECT k AS p_partkey, CASE m WHEN 0 THEN 'neu ' || n WHEN 1 THEN 'neu' WHEN 2 THEN upper(n) WHEN 3 THEN 'GPT ' || k WHEN 4 THEN '' WHEN 5 THEN '```x' WHEN 6 THEN 'neu' ELSE n || '-' || n END AS target,
  CASE m WHEN 2 THEN 'unchanged_source' WHEN 4 THEN 'empty' WHEN 5 THEN 'unbalanced_code_fence' WHEN 6 THEN 'code_fence_count_changed' ELSE 'ok' END AS status,
  m IN (2, 4, 5, 6) AND k % 5 < 3 AS requeue, m NOT IN (2, 4, 5, 6) AND k % 2 = 0 AS remember FROM p""")
def reply_outcomes(t):
    """What replies are worth, whether another attempt is due, and whether they are remembered."""
    n, k, m = F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_partkey") % 8
    source = F.when(m == 3, F.concat(F.lit("GPT "), k)).when(m == 6, F.concat(F.lit("```"), n, F.lit("```"))).otherwise(n)
    reply = F.when(m == 0, F.concat(F.lit("\nneu "), n, F.lit(" "))).when(m == 1, F.concat(n, F.lit("\n\n: — neu"))).when(m == 2, F.upper(n)).when(m == 3, source).when(m == 4, F.lit(" \n")).when(m == 5, F.lit("```x")).when(m == 6, F.lit("neu")).otherwise(F.concat(n, F.lit("-"), n))
    rows = t("part").select("p_partkey", source.alias("source"), reply.alias("reply"), (F.col("p_partkey") % 5).alias("attempt"), F.when(F.col("p_partkey") % 2 == 1, "own words").alias("custom_prompt"), F.lit(1).alias("block_id"))
    return translation.outcomes(rows).select("p_partkey", "target", "status", "requeue", "remember")


ARTICLES = "a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN 'title ' || o_orderkey % 97 END AS title, o_orderpriority AS source, CASE WHEN o_orderkey % 6 = 0 THEN 'archived' ELSE 'parsed' END AS status, o_orderkey % 11 AS translatable, o_orderkey % 7 AS translated, CASE WHEN o_orderkey % 7 >= o_orderkey % 11 THEN 'translated' ELSE 'partial' END AS state, o_orderkey % 5 AS seconds, o_orderkey % 40 AS segments, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 45 END AS active FROM orders)"


def articles(t):
    k = F.col("o_orderkey")
    return t("orders").select(k.alias("id"), F.when(k % 4 > 0, F.concat(F.lit("title "), (k % 97).cast("string"))).alias("title"), F.lit("none").alias("external_id"), F.col("o_orderpriority").alias("source"), F.when(k % 6 == 0, "archived").otherwise("parsed").alias("status"), (k % 11).alias("translatable"), (k % 7).alias("translated"), F.when(k % 7 >= k % 11, "translated").otherwise("partial").alias("state"), (k % 5).alias("seconds"), (k % 40).alias("segments"), F.when(k % 3 > 0, k % 45).alias("active"), k.alias("updated"))


@query(f"WITH {ARTICLES}, r AS (SELECT *, CASE WHEN segments > 0 AND seconds > 0 AND active IS NOT NULL THEN least(100, floor((active + 1) * 100.0 / segments + 0.5)) ELSE 0 END::BIGINT AS read_percent FROM a) SELECT id, read_percent, row_number() OVER (ORDER BY read_percent DESC, id)::INTEGER AS place FROM r WHERE translatable > translated QUALIFY place <= 500")
def articles_by_progress(t):
    """Articles that need a translation, those read furthest first."""
    return library.listed(articles(t), "needs_translation", "progress").select("id", "read_percent", "place")


@query(f"WITH {ARTICLES} SELECT id, row_number() OVER (ORDER BY coalesce(title, 'none'), id)::INTEGER AS place FROM a WHERE state = 'translated' QUALIFY place <= 300")
def articles_by_title(t):
    """Translated articles by title, or by their number where they have none."""
    return library.listed(articles(t), "translated", "title", 300).select("id", "place")


@query(f"WITH {ARTICLES} SELECT source, count(*) AS articles, count(*) FILTER (seconds > 0) AS reading, count(*) FILTER (state = 'translated') AS translated, count(*) FILTER (status = 'archived') AS archived FROM a GROUP BY 1")
def article_counts(t):
    """Articles of each source, those read, translated and archived."""
    return library.list_counts(articles(t))


@query("""WITH c AS (SELECT lang AS library, doc_id * 4 AS spot, source AS category, 2 AS weight FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT lang, doc_id * 4 + 1, source, 1 FROM documents UNION ALL SELECT lang, doc_id * 4 + 2, 'src' || doc_id % 3, 1 FROM documents)
SELECT library, category, sum(weight)::BIGINT AS weight, row_number() OVER (PARTITION BY library ORDER BY sum(weight) DESC, min(spot))::INTEGER AS rank FROM c GROUP BY 1, 2 QUALIFY rank <= 8""")
def seed_categories(t):
    """The first categories of each library, primary ones counting twice besides."""
    primary = F.when(F.col("doc_id") % 5 > 0, F.col("source")).otherwise("")
    rows = t("documents").select(F.col("lang").alias("library"), "doc_id", primary.alias("primary"), F.array("source", F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string"))).alias("categories"))
    return library.seed_categories(rows, "library", "doc_id")


@query("""SELECT c_custkey, 'recs:' || sha256('{"categories": ["cs.CL", "' || c_mktsegment || '"], "library_id": "l' || c_custkey || '", "max_results": ' || c_custkey % 20 || ', "model": null, "note": "\\u00e9\\"x"}') AS key,
  'recs:' || sha256('{"categories": ["cs.CL", "' || c_mktsegment || '"], "library_id": "l' || c_custkey || '", "max_results": ' || c_custkey % 20 || ', "model": null, "note": "é\\"x"}') AS plain_key FROM customer""")
def cache_keys(t):
    """Keys of what is asked for, with other characters as escapes or as they are."""
    fields = F.struct(F.concat(F.lit("l"), F.col("c_custkey").cast("string")).alias("library_id"), F.array(F.lit("cs.CL"), "c_mktsegment").alias("categories"), (F.col("c_custkey") % 20).alias("max_results"), F.lit(None).cast("string").alias("model"), F.lit('é"x').alias("note"))
    return t("customer").select("c_custkey", library.cache_key("recs:", fields).alias("key"), library.cache_key("recs:", fields, ascii=False).alias("plain_key"))
