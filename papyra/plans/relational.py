"""Listings, roll-ups, work finding, snapshots and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions.text import content_hash, fold
from papyra.operators import context, jobs, tables
from papyra.plans.registry import query


@query("SELECT o_orderstatus AS status, count(*) AS jobs, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def job_summary(t):
    """Jobs in each status and their latest change."""
    return jobs.summary(t("orders"), "o_orderstatus", "o_orderdate")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus IN ('O','P')) AS active, max(o_orderdate) AS latest FROM orders")
def job_totals(t):
    """All jobs, active ones, and the latest change."""
    return t("orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("active"), F.max("o_orderdate").alias("latest"))


@query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place, o_orderkey, o_orderpriority FROM orders ORDER BY place LIMIT 50")
def job_claim_order(t):
    """The 50 jobs that are claimed next."""
    return jobs.claim_order(t("orders"), [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")], 50, "o_orderkey", "o_orderpriority")


@query("SELECT o_orderpriority, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def job_lane_heads(t):
    """The next job of each lane."""
    return jobs.lane_heads(t("orders"), "o_orderpriority", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderpriority", "o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def job_list_limited(t):
    """The newest 25 jobs of given statuses and priority."""
    rows = tables.where_given(t("orders"), o_orderstatus=["O", "F"], o_orderpriority="1-URGENT", o_custkey=None)
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT c.c_mktsegment AS segment, count(*) FILTER (WHERE o_orderstatus='F') AS n_f, count(*) FILTER (WHERE o_orderstatus='O') AS n_o, count(*) FILTER (WHERE o_orderstatus='P') AS n_p FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1")
def job_pivot_by_owner(t):
    """Jobs by state for each segment; counted per owner before the join."""
    per = jobs.status_counts(t("orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])
    return per.join(t("customer"), per.o_custkey == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(*[F.sum(c).alias(c) for c in ("n_f", "n_o", "n_p")])


@query("""SELECT c.c_custkey, c.c_name, coalesce(o.n, 0) AS orders, coalesce(l.n, 0) AS items FROM customer c
LEFT JOIN (SELECT o_custkey, count(*) n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, count(*) n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) l ON l.o_custkey = c.c_custkey""")
def article_list(t):
    """Parents with the numbers of their two kinds of children."""
    items = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("n").alias("items"))
    listed = tables.with_counts(t("customer").select("c_custkey", "c_name"), "c_custkey", orders=(t("orders"), "o_custkey"))
    return listed.join(items, "c_custkey", "left").withColumn("items", F.coalesce("items", F.lit(0).cast("long")))


@query("""SELECT source, count(*) AS items, count(*) FILTER (WHERE quality = 1) AS done, count(*) FILTER (WHERE quality = 0) AS failed,
CASE WHEN count(*) FILTER (WHERE quality = 1) >= count(*) THEN 'translated' WHEN count(*) FILTER (WHERE quality = 0) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE quality = 1) > 0 THEN 'partial' ELSE 'not_started' END AS state
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def status_classifier(t):
    """The translation state of each source."""
    rows = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    sums = rows.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("quality") == 1).alias("done"), F.count_if(F.col("quality") == 0).alias("failed"))
    return sums.withColumn("state", tables.translation_state(F.col("items"), F.col("done"), F.lit(0), F.col("failed")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_items(t):
    """Documents without a label."""
    return tables.missing(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")


@query("SELECT lang, count(*) AS documents, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def library_missing_rollup(t):
    """Missing labels by language."""
    rows = t("documents").join(t("labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("there").isNull()).alias("missing"), F.sum("n_chars").alias("chars"))


@query("SELECT content, doc_id, copies FROM (SELECT sha256(text) AS content, doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE n = 1")
def default_variant(t):
    """The first document of each text and how many have it; texts travel as hashes."""
    return t("documents").select(F.sha2("text", 256).alias("content"), "doc_id").groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content FROM documents")
def content_hashes(t):
    """Hashes that are blind to the amount of white space."""
    return t("documents").select("doc_id", content_hash(F.col("text")).alias("content"))


@query("SELECT sha256(text) AS \"key\", min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1")
def unique_by_hash(t):
    """Texts that one document alone has."""
    return tables.unique_by(t("documents"), F.sha2("text", 256), "doc_id")


@query("SELECT sha256(text) AS \"key\", count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_values(t):
    """Texts that several documents have."""
    return tables.repeated(t("documents"), F.sha2("text", 256))


@query("""WITH old AS (SELECT doc_id AS uid, sha256(text) AS content FROM documents), new AS (SELECT doc_id + 1 AS uid, sha256(text) AS content FROM documents WHERE lang <> 'de'),
u AS (SELECT a.content, b.uid AS moved_to FROM (SELECT content FROM old GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT content, min(uid) uid FROM new GROUP BY 1 HAVING count(*) = 1) b USING (content)),
j AS (SELECT old.uid, CASE WHEN n.content = old.content THEN 'kept' WHEN u.moved_to IS NOT NULL AND u.moved_to <> old.uid THEN 'moved' WHEN n.uid IS NOT NULL THEN 'edited' ELSE 'gone' END AS fate, u.moved_to FROM old LEFT JOIN new n ON n.uid = old.uid LEFT JOIN u ON u.content = old.content)
SELECT uid, CASE fate WHEN 'moved' THEN moved_to WHEN 'gone' THEN NULL ELSE uid END AS new_uid, fate FROM j""")
def rehome_by_hash(t):
    """What becomes of items after a reparse that shifts ids and drops a language."""
    rows = t("documents").select(F.col("doc_id").alias("uid"), F.sha2("text", 256).alias("content"), "lang")
    return tables.reconciled(rows.drop("lang"), rows.where("lang <> 'de'").select((F.col("uid") + 1).alias("uid"), "content"), "uid", "content")


@query("""SELECT i.doc_id AS item_id, m.doc_id AS entry_id FROM (SELECT doc_id, sha256(text) AS content, lang FROM documents) i JOIN (SELECT d.doc_id, sha256(text) AS content, lang, quality FROM documents d JOIN labels USING (doc_id) WHERE quality = 1) m
ON i.content = m.content AND i.lang IS NOT DISTINCT FROM m.lang QUALIFY row_number() OVER (PARTITION BY i.doc_id ORDER BY m.doc_id DESC) = 1""")
def tm_lookup(t):
    """Each document's newest approved entry of the same content and language; the memory keeps one entry for each first."""
    rows = t("documents").select("doc_id", F.sha2("text", 256).alias("content"), "lang")
    approved = rows.join(t("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    memory = approved.groupBy("content", "lang").agg(F.max("doc_id").alias("entry_id"))  # one entry a key: hot contents don't multiply
    same = (F.col("i.content") == F.col("m.content")) & F.col("i.lang").eqNullSafe(F.col("m.lang"))
    return rows.alias("i").join(memory.alias("m"), same).select(F.col("i.doc_id").alias("item_id"), "m.entry_id")


@query("""SELECT s_suppkey, s_name, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY v DESC) n FROM (
SELECT s_suppkey, s_name, s_acctbal, 1 AS v FROM supplier UNION ALL SELECT s_suppkey, s_name || '*', s_acctbal + 1, 2 FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT s_suppkey + 1000000, s_name, 0, 2 FROM supplier WHERE s_nationkey = 3)) WHERE n = 1""")
def upsert_snapshot(t):
    """A snapshot after changes and additions."""
    old = t("supplier").select("s_suppkey", "s_name", "s_acctbal", F.lit(1).alias("v"), "s_nationkey")
    changed = old.where("s_nationkey < 10").select("s_suppkey", F.concat("s_name", F.lit("*")).alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(2).alias("v"))
    added = old.where("s_nationkey = 3").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_name", F.lit(0.0).alias("s_acctbal"), F.lit(2).alias("v"))
    return tables.upserted(old.drop("s_nationkey"), changed.unionByName(added), ["s_suppkey"], "v").drop("v")


@query("SELECT p_partkey, p_name, coalesce(CASE WHEN p_size > 25 THEN p_retailprice * 2 END, p_retailprice) AS p_retailprice FROM part")
def partial_update(t):
    """Values that a change leaves out stay as they are."""
    old = t("part").select("p_partkey", "p_name", "p_retailprice")
    changes = t("part").where("p_size > 20").select("p_partkey", F.lit(None).cast("string").alias("p_name"), F.when(F.col("p_size") > 25, F.col("p_retailprice") * 2).alias("p_retailprice"))
    return tables.merged_update(old, changes, "p_partkey")


@query("SELECT o_orderstatus, count(*) AS orders, coalesce(sum(items), 0)::BIGINT AS items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def cascade_delete(t):
    """What remains of orders and items when a segment's customers go."""
    gone = t("customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    (orders,) = tables.cascade(gone, "c_custkey", (t("orders"), "o_custkey"))
    items = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("items"))
    left = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return left.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))


@query("(SELECT doc_id, 'missing' AS side FROM documents EXCEPT SELECT doc_id, 'missing' FROM labels) UNION ALL (SELECT doc_id, 'unexpected' FROM labels EXCEPT SELECT doc_id, 'unexpected' FROM documents)")
def set_reconcile(t):
    """Ids that one of two tables lacks."""
    return tables.both_differences(t("documents").select("doc_id").distinct(), t("labels").select("doc_id").distinct())


@query("SELECT text, p_partkey FROM (SELECT trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS text, p_partkey, row_number() OVER (PARTITION BY lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) ORDER BY p_partkey) n FROM part) WHERE n = 1 AND text <> '' ORDER BY p_partkey LIMIT 80")
def dedupe_clean(t):
    """The first 80 different names by order of appearance, blind to case."""
    return tables.first_spellings(t("part"), F.col("p_name"), "p_partkey")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE instr(lower(concat_ws(' ', c_name, c_mktsegment, n_name)), 'building nation_1') > 0")
def client_article_search(t):
    """Rows whose joined fields hold the query."""
    both = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.where(F.instr(fold(F.concat_ws(" ", "c_name", "c_mktsegment", "n_name")), "building nation_1") > 0).select("c_custkey", "c_name", "n_name")


@query("SELECT user_id, event_type, json_extract_string(props, '$.k') AS k, min_by(event_id, (ts, event_id)) AS event_id, count(*) AS copies FROM events GROUP BY 1, 2, 3")
def dedupe_jobs(t):
    """The first event of each user, type and key."""
    return jobs.first_of_each(t("events").withColumn("k", F.get_json_object("props", "$.k")), ["user_id", "event_type", "k"], "ts", "event_id")


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '69' AND event_type = 'click'")
def json_filter(t):
    """Rows by a field of their JSON."""
    return t("events").where((F.get_json_object("props", "$.k") == "69") & (F.col("event_type") == "click")).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE coalesce(ts <= TIMESTAMP '2024-01-15 00:00:00', true)")
def ttl_filter(t):
    """Entries that have expired at a given time."""
    from papyra.functions.values import expired

    return t("events").where(expired(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp"))).select("event_id", "user_id")


@query("SELECT event_id, lane_ms AS start_ms FROM (SELECT event_id, p + max(t - p) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS lane_ms FROM (SELECT event_id, event_type, epoch_us(ts) // 1000 AS t, (row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) - 1) * 60000 AS p FROM events))")
def rate_limit_slots(t):
    """When each request starts if a lane takes one a minute."""
    return jobs.slots(t("events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))), "event_type", "at", "event_id", 60_000).select("event_id", "start_ms")


@query("SELECT user_id, event_type, round(sum(greatest(0, least(3600, value))), 6) AS seconds, arg_max(event_id, (ts, event_id)) AS active FROM events GROUP BY 1, 2 HAVING sum(greatest(0, least(3600, value))) > 0")
def reading_progress(t):
    """Reading time of each user and type, and the last event."""
    time = context.reading_time(t("events"), ["user_id", "event_type"], "value").withColumn("seconds", F.round("seconds", 6))
    return time.join(t("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("active")), ["user_id", "event_type"])


@query("SELECT user_id, least(100, CAST(round(coalesce(max(n) FILTER (WHERE event_type = 'purchase'), 0) * 100.0 / count(*)) AS INT)) AS percent FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) n FROM events) GROUP BY 1")
def read_percent(t):
    """How far each user's last purchase is among their events."""
    rows = t("events").withColumn("o", F.struct("ts", "event_id"))
    return context.read_percent(rows, "user_id", "o", F.col("event_type") == "purchase")


@query("SELECT user_id, round(greatest(avg(value) + (max(value) - avg(value)) * 0.5, 60), 6) AS heat FROM events GROUP BY 1")
def heat_limit(t):
    """The upper end of each user's heat scale."""
    return t("events").groupBy("user_id").agg(F.round(F.greatest(F.avg("value") + (F.max("value") - F.avg("value")) * 0.5, F.lit(60.0)), 6).alias("heat"))


@query("SELECT event_id, '{\"k\":' || json_extract(props, '$.k') || ',\"type\":\"' || event_type || '\"}' AS metadata FROM events")
def metadata_merge(t):
    """JSON with a second object's values over it."""
    from papyra.functions.values import merged

    new = F.to_json(F.struct(F.col("event_type").alias("type")))
    return t("events").select("event_id", F.to_json(merged(F.col("props"), new)).alias("metadata"))


@query("SELECT day, n FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate::DATE BETWEEN DATE '1997-03-25' AND DATE '1997-04-01' GROUP BY 1) ORDER BY day DESC LIMIT 1")
def submitted_window(t):
    """The latest day with rows within a week before a date."""
    from papyra.sources.feeds import first_full_day

    return first_full_day(t("orders").where("o_orderpriority = '1-URGENT'").withColumn("d", F.to_date("o_orderdate")), "d", "1997-04-01").select("day", "n")


@query("SELECT o_custkey, o_orderkey, o_orderkey = 42 AS is_default FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 42)")
def single_default(t):
    """One row of a group is the default, the others aren't."""
    rows = t("orders").select("o_custkey", "o_orderkey", F.lit(None).cast("boolean").alias("is_default"))
    return tables.single_default(rows, ["o_custkey"], "o_orderkey", 42, "is_default").where("is_default is not null")


@query("SELECT source, n, first_value(source) OVER (ORDER BY n DESC, source) AS busiest FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def source_counts(t):
    """Documents by source, with the busiest."""
    sums = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    busiest = sums.agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("busiest"))  # one row
    return sums.crossJoin(F.broadcast(busiest))


@query("SELECT lang, collapse AS lines, count(*) AS n FROM (SELECT lang, len(string_split(trim(text), chr(10))) AS collapse FROM documents) GROUP BY 1, 2")
def line_counts(t):
    """How many lines documents have, by language."""
    return t("documents").groupBy("lang", F.size(F.split(F.trim("text"), "\n")).alias("lines")).agg(F.count(F.lit(1)).alias("n"))

