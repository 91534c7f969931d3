"""The library's layers over the test tables: documents as blocks, labels as renderings, customers as cards, parts as terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions import rules
from papyra.operators import library, mining, search, tables, vault
from papyra.plans.registry import query
from papyra.sources import sinks

UID = "'p-' || lpad({}::VARCHAR, 6, '0')"
B = f"b AS (SELECT doc_id AS id, lang AS revision, {UID.format('doc_id')} AS uid, ['section', 'paragraph', 'list', 'code', 'figure', 'equation'][1 + doc_id % 6] AS kind, sha256(text) AS hash, text FROM documents)"
V = f"v AS (SELECT doc_id AS block_id, CASE WHEN toxic = 1 THEN 'ja' ELSE 'zh' END AS language, CASE WHEN quality = 1 THEN 'ok' ELSE 'empty' END AS status, doc_id % 4 = 0 AS is_default, doc_id * 7919 % 1000 AS updated, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256(text) ELSE sha256(text || 'x') END AS seen_hash, CASE doc_id % 5 WHEN 0 THEN {UID.format('doc_id')} WHEN 1 THEN NULL ELSE 'p-old' END AS seen_uid FROM labels JOIN documents USING (doc_id))"


def uid(c):
    return F.concat(F.lit("p-"), F.lpad(F.col(c).cast("string"), 6, "0"))


def blocks(t):
    kinds = F.array(*[F.lit(x) for x in ("section", "paragraph", "list", "code", "figure", "equation")])
    return t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("revision"), uid("doc_id").alias("uid"), F.get(kinds, (F.col("doc_id") % 6).cast("int")).alias("kind"), F.sha2("text", 256).alias("hash"), "text")


def variants(t):
    rows, k = t("labels").join(t("documents").select("doc_id", "text"), "doc_id"), F.col("doc_id")
    seen = F.when(k % 3 == 1, F.sha2("text", 256)).when(k % 3 == 2, F.sha2(F.concat("text", F.lit("x")), 256))
    name = F.when(k % 5 == 0, uid("doc_id")).when(k % 5 > 1, "p-old")
    language, status = F.when(F.col("toxic") == 1, "ja").otherwise("zh"), F.when(F.col("quality") == 1, "ok").otherwise("empty")
    return rows.select(k.alias("block_id"), language.alias("language"), status.alias("status"), (k % 4 == 0).alias("is_default"), (k * 7919 % 1000).alias("updated"), seen.alias("seen_hash"), name.alias("seen_uid"))


@query(f"WITH {B} SELECT kind, count(*) AS blocks, count(*) FILTER (WHERE kind IN ('paragraph', 'list', 'figure', 'table') AND trim(text) <> '') AS translatable, count(*) FILTER (WHERE kind IN ('paragraph', 'section', 'figure', 'table', 'equation') AND trim(text) <> '') AS eligible FROM b GROUP BY 1")
def block_kinds(t):
    """Blocks of each kind, those that are translated and those that are embedded."""
    k, x = F.col("kind"), F.col("text")
    return blocks(t).groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(rules.translatable(k, x)).alias("translatable"), F.count_if(rules.embeddable(k, x)).alias("eligible"))


@query(f"WITH {B}, {V} SELECT block_id, revision, uid, language, status FROM v JOIN b ON id = block_id WHERE seen_hash IS NULL OR seen_hash = hash OR coalesce(seen_uid = uid, false)")
def variants_shown(t):
    """Renderings that may still be shown."""
    return library.current_variants(variants(t), blocks(t)).select("block_id", "revision", "uid", "language", "status")


@query(f"WITH {B}, {V} SELECT block_id, language, status = 'ok' AND (seen_uid IS NULL OR seen_uid = uid) AND (seen_hash IS NULL OR seen_hash = hash) AS matches FROM v JOIN b ON id = block_id")
def variants_match(t):
    """Whether renderings are ok and contradict nothing."""
    rows = variants(t).join(blocks(t).select(F.col("id").alias("block_id"), "uid", "hash"), "block_id")
    return rows.select("block_id", "language", rules.matches_now(*(F.col(c) for c in ("status", "seen_hash", "seen_uid", "hash", "uid"))).alias("matches"))


@query(f"WITH {B}, {V} SELECT revision, language, block_id, is_default FROM v JOIN b ON id = block_id WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY revision, language ORDER BY NOT is_default, updated DESC, block_id) = 1")
def variant_choice(t):
    """The rendering that stands for each revision and language."""
    rows = variants(t).join(blocks(t).select(F.col("id").alias("block_id"), "revision"), "block_id")
    return library.chosen_variants(rows, "revision", "language").select("revision", "language", "block_id", "is_default")


@query(f"WITH {B}, {V}, w AS (SELECT id, hash, CASE WHEN id % 2 = 0 THEN 'ja' ELSE 'zh' END AS language, CASE WHEN id % 5 > 1 THEN 'p-old' END AS name FROM b) SELECT id, max(v.updated) IS NOT NULL AS hit, max(v.updated) AS updated FROM w LEFT JOIN v ON status = 'ok' AND id = block_id AND seen_hash = hash AND v.language = w.language AND seen_uid IS NOT DISTINCT FROM name GROUP BY 1")
def variant_cache(t):
    """Which blocks have a rendering that agrees in every attribute, null with null."""
    wanted = blocks(t).select("id", F.col("id").alias("block_id"), F.col("hash").alias("seen_hash"), F.when(F.col("id") % 2 == 0, "ja").otherwise("zh").alias("language"), F.when(F.col("id") % 5 > 1, "p-old").alias("seen_uid"))
    return library.cached(variants(t), wanted, ["block_id", "seen_hash", "language"], ["seen_uid"])


@query(f"WITH {B}, {V} SELECT block_id, status FROM v SEMI JOIN (SELECT * FROM b WHERE revision = 'de') x ON id = block_id")
def variants_owned(t):
    """Renderings of one revision's blocks."""
    return library.owned(variants(t), blocks(t), "block_id", "id", F.col("revision") == "de").select("block_id", "status")


E = "e AS (SELECT doc_id AS block_id, CASE WHEN lang = 'fr' OR doc_id % 4 > 0 THEN sha256(text) ELSE sha256('') END AS source_hash, doc_id % 977 AS updated FROM documents JOIN embeddings ON vec_id = doc_id WHERE lang <> 'es')"


@query(f"WITH {B}, {E} SELECT revision, count(*) AS eligible, count(*) FILTER (WHERE source_hash = hash) AS embedded, count(*) FILTER (WHERE source_hash <> hash) AS stale, max(updated) FILTER (WHERE source_hash = hash) AS latest, CASE WHEN count(*) FILTER (WHERE source_hash = hash) > 0 AND count(*) FILTER (WHERE source_hash <> hash) = 0 THEN 'hybrid' ELSE 'fts' END AS mode FROM b LEFT JOIN e ON id = block_id WHERE kind IN ('paragraph', 'section', 'figure', 'equation') AND trim(text) <> '' GROUP BY 1")
def retrieval_modes(t):
    """How each revision is searched, by the freshness of its embeddings' hashes."""
    rows = t("documents").where("lang <> 'es'").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    fresh = F.when((F.col("lang") == "fr") | (F.col("doc_id") % 4 > 0), F.sha2("text", 256)).otherwise(F.sha2(F.lit(""), 256))
    return library.retrieval_modes(blocks(t), rows.select(F.col("doc_id").alias("block_id"), fresh.alias("source_hash"), (F.col("doc_id") % 977).alias("updated")))


@query("""WITH q AS (SELECT * FROM (VALUES (1, 'whing'), (2, 'ation'), (3, 'zzzzzz')) x(q, term)), d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS x, lower(text) AS t FROM documents),
a AS (SELECT q, doc_id, len(list_filter(regexp_extract_all(t, '[\\w\\p{L}\\p{M}\\p{N}]+'), lambda w: w = term)) AS score FROM d CROSS JOIN q), f AS (SELECT * FROM a WHERE score > 0),
s AS (SELECT q, doc_id, (length(x) - length(replace(x, term, ''))) // length(term) AS score FROM d CROSS JOIN q)
SELECT q, doc_id, score::INT AS score FROM f UNION ALL SELECT q, doc_id, score::INT FROM s WHERE score > 0 AND q NOT IN (SELECT q FROM f)""")
def search_or_substring(t):
    """Word search for several questions, and substring search for those without a hit."""
    docs, found, other = t("documents"), None, None
    for q, term in ((1, "whing"), (2, "ation"), (3, "zzzzzz")):
        words = docs.select(F.lit(q).alias("q"), "doc_id", search.term_uses(F.lower(F.col("text")), term).alias("score")).where("score > 0")
        parts = search.substring_scores(docs, term, "doc_id", "text").select(F.lit(q).alias("q"), "doc_id", "score")
        found, other = (words, parts) if found is None else (found.unionByName(words), other.unionByName(parts))
    return library.with_fallback(found, other, "q")


@query("SELECT p_partkey, CASE WHEN n = '' THEN 64 ELSE greatest(8, least(4096, n::BIGINT))::INT END AS dimensions FROM (SELECT p_partkey, regexp_extract(CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'model-' || (p_size * p_size * p_size) || '-v2' END, '(\\d+)', 1) AS n FROM part)")
def model_dimensions(t):
    """Dimensions that models' names state."""
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit("model-"), F.expr("cast(p_size as int) * p_size * p_size").cast("string"), F.lit("-v2")))
    return t("part").select("p_partkey", rules.model_dimensions(name).alias("dimensions"))


T = "t AS (SELECT p_partkey AS id, p_name AS source, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_type END AS target, CASE WHEN p_size % 2 = 0 THEN 'en->zh' ELSE 'en->ja' END AS direction, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'zh' ELSE 'ja' END AS language, CASE WHEN p_size % 5 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_size % 4 = 0 THEN 'library' ELSE 'article' END AS scope, p_brand AS owner, p_partkey % 97 AS updated FROM part)"


def terms(t):
    s = F.col("p_size")
    return t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("source"), F.when(s % 7 == 0, " ").otherwise(F.col("p_type")).alias("target"), F.when(s % 2 == 0, "en->zh").otherwise("en->ja").alias("direction"),
        F.when(s % 3 == 1, "zh").when(s % 3 == 2, "ja").alias("language"), F.when(s % 5 == 0, "archived").otherwise("active").alias("status"), F.when(s % 4 == 0, "library").otherwise("article").alias("scope"), F.col("p_brand").alias("owner"), (F.col("p_partkey") % 97).alias("updated"),
    )


@query(f"WITH {T} SELECT id, source, target FROM t WHERE (owner = 'Brand#12' OR scope <> 'article') AND (language IS NULL OR language = 'zh' OR direction LIKE '%->zh') AND status = 'active' AND trim(target) <> ''")
def glossary_active(t):
    """Terms that hold for an article and a language."""
    return library.active_terms(terms(t), "Brand#12", "zh").select("id", "source", "target")


@query(f"WITH {T} SELECT owner, 'glossary:' || coalesce(substr(sha256(string_agg(source || chr(31) || target || chr(31) || direction || chr(31) || updated, chr(30) ORDER BY replace(lower(source), 'ß', 'ss'), source || chr(31) || target || chr(31) || direction || chr(31) || updated) FILTER (WHERE status = 'active' AND trim(target) <> '')), 1, 16), 'none') AS version FROM t GROUP BY 1")
def glossary_versions(t):
    """The version of each glossary."""
    return library.glossary_versions(terms(t), "owner")


@query(f"WITH {T}, o AS (SELECT lower(source) AS k, min(source) AS source, min(target) AS target FROM t WHERE id % 3 < 2 GROUP BY 1), n AS (SELECT lower(source) AS k, min(upper(source)) AS source, max(target) AS target FROM t WHERE id % 3 > 0 GROUP BY 1) SELECT coalesce(o.source, n.source) AS source, coalesce(n.target, o.target) AS target, CASE WHEN n.target <> o.target AND trim(o.target) <> '' THEN o.target ELSE '' END AS previous FROM o FULL JOIN n USING (k)")
def glossary_upsert(t):
    """A glossary after an import: changed targets are kept as previous ones."""
    rows, key = terms(t), F.lower("source").alias("k")
    old = rows.where("id % 3 < 2").groupBy(key).agg(F.min("source").alias("source"), F.min("target").alias("target")).withColumn("previous", F.array().cast("array<string>"))
    new = rows.where("id % 3 > 0").groupBy(key).agg(F.min(F.upper("source")).alias("source"), F.max("target").alias("target"))
    return library.upserted_terms(old, new).select("source", "target", F.array_join("previous", "|").alias("previous"))


C = "c AS (SELECT c_custkey AS id, c_mktsegment || '::' || c_nationkey AS \"key\", ['pinned', 'exported', 'candidate', 'archived'][1 + c_custkey % 4] AS status, c_name AS title, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'AB' END AS abbreviation, 'full form' AS full_form, CASE WHEN c_custkey % 2 = 0 THEN 'zh' ELSE 'ja' END AS language, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE 'body' END AS body, CASE WHEN c_custkey % 5 = 0 THEN 'figure' ELSE 'term' END AS card_type, (c_custkey * 31) % 1009 AS updated, c_nationkey FROM customer)"


def cards(t):
    k = F.col("c_custkey")
    states = F.array(*[F.lit(x) for x in ("pinned", "exported", "candidate", "archived")])
    return t("customer").select(
        k.alias("id"), F.concat("c_mktsegment", F.lit("::"), F.col("c_nationkey").cast("string")).alias("key"), F.get(states, (k % 4).cast("int")).alias("status"), F.col("c_name").alias("title"), F.when(k % 9 > 0, "AB").alias("abbreviation"), F.lit("full form").alias("full_form"),
        F.when(k % 2 == 0, "zh").otherwise("ja").alias("language"), F.when(k % 6 == 0, " ").otherwise("body").alias("body"), F.when(k % 5 == 0, "figure").otherwise("term").alias("card_type"), (k * 31 % 1009).alias("updated"), "c_nationkey",
    )


@query(f"WITH {C} SELECT \"key\", id, status FROM c WHERE status <> 'archived' AND language = 'zh' AND abbreviation IS NOT NULL QUALIFY row_number() OVER (PARTITION BY \"key\" ORDER BY CASE status WHEN 'pinned' THEN 0 WHEN 'exported' THEN 1 ELSE 2 END, updated DESC, id) = 1")
def cards_shared(t):
    """The card that serves each key."""
    return library.shared_cards(cards(t), "zh")


@query(f"WITH {C} SELECT id, title FROM c WHERE card_type = 'term' AND trim(body) <> '' AND status <> 'archived'")
def cards_exportable(t):
    """Cards that are exported."""
    return library.exportable_cards(cards(t)).select("id", "title")


@query(f"WITH {C} SELECT id, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE status WHEN 'pinned' THEN 0 WHEN 'exported' THEN 1 WHEN 'candidate' THEN 2 ELSE 3 END, title, id) AS place FROM c")
def cards_ordered(t):
    """Cards in the order of their panel."""
    return library.ordered_cards(cards(t), "c_nationkey").select("id", "c_nationkey", "place")


@query(f"WITH {C} SELECT id, id % 3 = 0 AS edited, CASE WHEN id % 3 = 0 THEN body WHEN id % 2 = 0 THEN 'new ' || id ELSE body END AS body, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new ' || id END AS suggested FROM c")
def cards_generated(t):
    """Generated bodies, which edited cards take as suggestions."""
    rows = cards(t).select("id", "body", (F.col("id") % 3 == 0).alias("edited"))
    return library.generated(rows, rows.where("id % 2 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("text")))


@query(f"WITH {C} SELECT id, CASE WHEN id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'archived' ELSE status END AS status FROM c")
def cards_archived(t):
    """Cards of some owners archived."""
    marks = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return library.set_status(cards(t).select("id", "status"), marks, "id", "status", "archived")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 < 3 THEN CASE WHEN c_custkey % 4 < 2 THEN 'approved' ELSE 'rejected' END WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'approved' END AS review, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 < 3 THEN c_custkey % 4 < 2 ELSE c_custkey % 3 > 0 END AS reuse FROM customer")
def memory_review(t):
    """Memory entries after a review."""
    k = F.col("c_custkey")
    memory = t("customer").select(k.alias("id"), F.when(k % 3 == 0, "pending").otherwise("approved").alias("review"), (k % 3 > 0).alias("reuse"))
    return library.reviewed(memory, t("customer").where("c_custkey % 4 < 3").select(k.alias("id"), (k % 4 < 2).alias("approve")))


@query(f"WITH {B} SELECT revision, uid, row_number() OVER (PARTITION BY revision ORDER BY uid) AS place FROM b WHERE kind IN ('paragraph', 'section', 'figure', 'equation') AND trim(text) <> '' QUALIFY place <= 12")
def evidence_first(t):
    """The first blocks of each revision that serve as evidence."""
    return library.evidence_blocks(blocks(t), 12)


@query("SELECT lang, list_sort(list(DISTINCT doc_id)) AS refs FROM (SELECT lang, doc_id FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE toxic = 1) GROUP BY 1")
def source_refs(t):
    """References of evidence and of chats together."""
    docs = t("documents").select("lang", "doc_id")
    out = library.source_refs(docs.where("doc_id % 5 = 0"), docs.join(t("labels").where("toxic = 1"), "doc_id"), "lang", "doc_id")
    return out


@query("SELECT s AS o_custkey, cat AS category, score, place FROM (SELECT o_custkey AS s, o_orderpriority AS cat, count(*) * 1.5 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS place FROM orders GROUP BY 1, 2) WHERE place <= 3 AND score >= 3.0")
def categories_inferred(t):
    """Each owner's best categories that score enough."""
    scores = t("orders").groupBy("o_custkey", F.col("o_orderpriority").alias("category")).agg((F.count(F.lit(1)) * 1.5).alias("score"))
    return library.inferred_categories(scores, "o_custkey", 3)


STOP = "[" + ", ".join(f"'{w}'" for w in mining.STOPWORDS) + "]"


@query(f"""WITH w AS (SELECT item_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z][a-z0-9-]+') AS x FROM benchmark)),
r AS (SELECT *, list_contains({STOP}, word) AS stop, count(*) FILTER (WHERE list_contains({STOP}, word)) OVER (PARTITION BY item_id ORDER BY pos) AS n FROM w)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY n) AS run, words FROM (SELECT item_id, n, string_agg(word, ' ' ORDER BY pos) AS words FROM r WHERE NOT stop GROUP BY 1, 2)""")
def term_runs(t):
    """Runs of words between stop words."""
    return library.term_runs(t("benchmark"), "item_id", "text", mining.STOPWORDS).select("item_id", "run", F.array_join("words", " ").alias("words"))


@query(f"""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '^[ \\-_:;,.()\\[\\]{{}}]+|[ \\-_:;,.()\\[\\]{{}}]+$', '', 'g'), '\\s+', ' ', 'g')) AS phrase FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.,;:\\n]+')) AS x FROM documents)),
q AS (SELECT *, list_transform(list_filter(string_split_regex(phrase, '\\s+'), lambda w: w <> ''), lambda w: regexp_replace(replace(lower(w), 'ß', 'ss'), '^-+|-+$', '', 'g')) AS w FROM p)
SELECT phrase, count(*) AS uses FROM q WHERE len(w) BETWEEN 2 AND 6 AND length(phrase) BETWEEN 4 AND 100 AND NOT list_contains({STOP}, w[1]) AND NOT list_contains({STOP}, w[-1]) AND len(list_filter(w, lambda x: regexp_matches(x, '[a-z]'))) >= 2 GROUP BY 1""")
def phrase_candidates(t):
    """Clauses that can be terms."""
    clauses = F.transform(F.regexp_extract_all("text", F.lit(r"[^.,;:\n]+"), F.lit(0)), rules.candidate)
    kept = F.filter(clauses, lambda p: rules.is_candidate(p, mining.STOPWORDS))  # within the array, where a clause is cleaned once
    return tables.dealt(t("documents")).select(F.explode(kept).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("uses"))


@query("""SELECT event_id, sha256('{"content_hash": "' || sha256(props) || '", "context_markdown_hash": "' || sha256(event_type) || '", "custom_prompt_hash": ' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '"' || sha256('be brief') || '"' END || ', "glossary_version": "g1", "model": ' || CASE WHEN user_id % 3 = 0 THEN 'null' ELSE '"m"' END || ', "prompt_version": "translation.v1", "provider_profile_id": "' || user_id || '", "target_language": "zh"}') AS "hash" FROM events""")
def context_hashes(t):
    """What renderings depend on, as hashes."""
    u = F.col("user_id")
    prompt = F.when(u % 2 == 0, " ").otherwise(" be brief ")
    found = rules.context_hash(F.sha2("props", 256), F.lit("zh"), u.cast("string"), F.when(u % 3 > 0, "m"), F.lit("g1"), F.col("event_type"), prompt)
    return t("events").select("event_id", found.alias("hash"))


@query("SELECT c_custkey, lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(c_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: xor(h * 33, c) & 4294967295), 36)) AS code FROM customer")
def cache_codes(t):
    """Names as 32-bit codes in base 36."""
    return t("customer").select("c_custkey", rules.string_hash(F.col("c_name")).alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type || chr(10) || user_id END AS chat, CASE WHEN event_id % 3 = 2 THEN event_type END AS message FROM events")
def reply_texts(t):
    """Texts of replies of three shapes."""
    k, e, u = F.col("event_id"), F.col("event_type"), F.col("user_id").cast("string")
    one = F.concat(F.lit('{"choices": [{"message": {"content": " '), e, F.lit(' "}}]}'))
    two = F.concat(F.lit('{"choices": [{"message": {"content": [{"text": "'), e, F.lit('"}, {"type": "image"}, {"text": "'), u, F.lit('"}]}}]}'))
    three = F.concat(F.lit('{"content": [{"type": "text", "text": "'), e, F.lit('"}, {"type": "tool", "text": "no"}]}'))
    payload = F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise(three)
    return t("events").select("event_id", rules.chat_text(payload).alias("chat"), rules.message_text(payload).alias("message"))


KINDS = "['click', 'error', 'purchase', 'signup', 'view']"


@query(f"""WITH s AS (SELECT user_id, list_transform({KINDS}, lambda k: coalesce(map_from_entries(list((event_type, n)))[k], 0)) AS x FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT user_id, array_to_string(x, ',') AS segments, list_sum(x)::INT AS total, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 5 END AS active, len(list_filter(x, lambda y: y > 0)) AS seen FROM s)
SELECT user_id, segments, active, total, CASE WHEN total > 0 THEN least(100, floor(coalesce(active + 1, seen) * 100.0 / 5 + 0.5))::INT ELSE 0 END AS percent FROM a""")
def progress_aligned(t):
    """Counts of each user in a fixed order of kinds, and how far the user has come."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = t("events").where("event_type <> 'view'").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    names = F.array(*[F.lit(k) for k in kinds])
    uid_ = F.when(F.col("user_id") % 7 > 0, F.get(names, (F.col("user_id") % 5).cast("int"))).otherwise("gone")
    seconds = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("seconds")).withColumn("active_uid", uid_)
    users = seconds.select("user_id", F.explode(names).alias("uid"))
    return library.aligned_progress(seconds, users, "user_id", "uid").withColumn("segments", F.array_join(F.transform("segments", lambda x: x.cast("string")), ","))


@query("SELECT p_partkey, greatest(60.0, least(200.0 + p_retailprice * 1000 / 1048576 * 120.0 + least(720.0, p_size * 3.0 + p_partkey % 90 * 8.0), 2400.0)) AS convert_s, greatest(60.0, least(110.0 + p_retailprice * 1000 / 1048576 * 45.0 + least(240.0, p_size * 1.5 + p_partkey % 90 * 4.0), 2400.0)) AS post_s FROM part")
def timeout_budgets(t):
    """Seconds for both steps of conversions."""
    size, tex, graphics = F.col("p_retailprice") * 1000, F.col("p_size"), F.col("p_partkey") % 90
    return t("part").select("p_partkey", rules.timeout_budget(size, tex, graphics).alias("convert_s"), rules.timeout_budget(size, tex, graphics, post=True).alias("post_s"))


@query("""SELECT p_partkey, CASE WHEN kind = 'table' AND regexp_matches(p_name, '(?i)an') THEN 'equation' WHEN kind = 'figure' AND regexp_matches(label, '(?i)(^tab:|\\.T\\d+$)') THEN 'table' ELSE kind END AS kind FROM
(SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'figure' END AS kind, CASE p_size % 3 WHEN 0 THEN 'S1.T' || p_size WHEN 1 THEN 'Tab:' || p_size ELSE 'fig:' || p_size END AS label FROM part)""")
def reference_kinds(t):
    """What references point at."""
    s = F.col("p_size")
    text = s.cast("string")
    label = F.when(s % 3 == 0, F.concat(F.lit("S1.T"), text)).when(s % 3 == 1, F.concat(F.lit("Tab:"), text)).otherwise(F.concat(F.lit("fig:"), text))
    fragment = F.when(F.col("p_name").rlike("(?i)an"), "<td class='ltx_eqn_cell'>").otherwise("<td>")
    return t("part").select("p_partkey", rules.reference_kind(F.when(s % 2 == 0, "table").otherwise("figure"), label, fragment, F.col("p_name")).alias("kind"))


@query("SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'q1' WHEN quality IS NOT NULL THEN 'q0' END, lang) AS lang, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def enriched(t):
    """Rows with what a later step found out about them."""
    found = t("labels").select("doc_id", F.when(F.col("quality") == 1, "q1").otherwise("q0").alias("lang"))
    unknown = found.sparkSession.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("q0").alias("lang"))
    return library.merged_by_id(t("documents").select("doc_id", "lang", "source"), found.unionByName(unknown), "doc_id", "lang")


@query("""SELECT doc_id, sha256(concat_ws(chr(10), '### p-' || doc_id, '', '> [!note] Idea · p-' || doc_id, '> **Source**', '> ' || replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10), chr(10) || '> '), '>', '> **Translation (zh)**',
'> _Translation pending._', '>', '> Article: [[#' || lang || ']]', '> #idea', '^n-' || lang || '-p-' || doc_id)) AS clip FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""")
def vault_clips(t):
    """Each document that isn't blank as a clip of its article."""
    name, line = F.concat(F.lit("p-"), F.col("doc_id").cast("string")), F.trim(F.regexp_replace("text", r"\s+", " "))
    body = vault.clip(name, line, F.lit(None).cast("string"), F.col("lang"), "zh", "note", "Idea", "#idea", vault.anchor("n", F.col("lang"), name))
    return t("documents").where(line != "").select("doc_id", F.sha2(body, 256).alias("clip"))


@query("""WITH c AS (SELECT c_custkey // 50 AS note, c_custkey AS k, c_custkey % 3 = 0 AS old, c_custkey % 2 = 0 AS new, c_name AS n, c_mktsegment AS s FROM customer)
SELECT note, concat(CASE WHEN count(*) FILTER (WHERE old) > 0 THEN '# Note' || chr(10) || chr(10) END, '## Terms' || chr(10) || chr(10), string_agg(concat('### ', n, chr(10), chr(10), CASE WHEN new THEN 'now ' || s ELSE 'was ' || s END, chr(10), chr(10), '^k-', k), chr(10) || chr(10) ORDER BY NOT old, CASE WHEN old THEN k ELSE 0 END, lower(n)), chr(10)) AS body FROM c WHERE old OR new GROUP BY 1""")
def vault_notes(t):
    """Notes of a third of the customers, fifty keys each, after entries for every second one."""
    key = F.col("c_custkey")
    entry = lambda word: F.concat(F.lit("### "), F.col("c_name"), F.lit(f"\n\n{word} "), F.col("c_mktsegment"), F.lit("\n\n"), vault.anchor("k", key.cast("string")))
    rows = t("customer").withColumn("note", F.floor(key / 50))
    bodies = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", entry("was").alias("x")))), lambda e: e["x"]), "\n\n")
    notes = rows.where(key % 3 == 0).groupBy("note").agg(F.concat(F.lit("# Note\n\n## Terms\n\n"), bodies, F.lit("\n")).alias("text"))
    new = rows.where(key % 2 == 0).select("note", F.lit("Terms").alias("section"), vault.anchor("k", key.cast("string")).alias("anchor"), entry("now").alias("body"), F.col("c_name").alias("title"))
    return vault.upserted(vault.entries(notes, "note", "text"), new, "note")


@query("""SELECT doc_id, sha256(concat(text, chr(10), CASE WHEN doc_id % 2 = 0 THEN '![a' || doc_id || '](x.assets/1.png)' || chr(10) || '![a' || doc_id || '](x.assets/2.png)' || chr(10) END, 'end')) AS body FROM documents""")
def asset_links(t):
    """Documents with a mark each, half of which have two files."""
    name = F.concat(F.lit("a"), F.col("doc_id").cast("string"))
    files = F.when(F.col("doc_id") % 2 == 0, F.create_map(name, F.array(F.lit("1.png"), F.lit("2.png"))))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n<!-- doc-asset:"), name, F.lit(" -->\nend"))
    return t("documents").select("doc_id", F.sha2(sinks.with_assets(text, files, F.lit("x.assets"), "doc"), 256).alias("body"))
