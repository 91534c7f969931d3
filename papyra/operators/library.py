"""The library's layers: renderings and their choice, glossaries, cards, retrieval control, and changes as new snapshots."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import rules
from papyra.functions.text import fold


def current_variants(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """The renderings (block_id, seen_hash, seen_uid, ...) of blocks (id, uid, hash, ...) that may still be shown, with the block's uid, hash and revision."""
    now = blocks.select(F.col("id").alias("block_id"), "uid", "hash", "revision")
    return variants.join(now, "block_id").where(rules.still_valid(F.col("seen_hash"), F.col("seen_uid"), F.col("hash"), F.col("uid")))


def chosen_variants(variants: DataFrame, *key: str) -> DataFrame:
    """One rendering for each key: of those that are ok the default, then the newest, then the least block."""
    best = F.min_by(F.struct(*variants.columns), F.struct(~F.col("is_default"), -F.col("updated"), "block_id")).alias("best")
    return variants.where("status = 'ok'").groupBy(*key).agg(best).select("best.*")


def cached(variants: DataFrame, wanted: DataFrame, exact: list[str], nullable: list[str]) -> DataFrame:
    """The wanted rows (id, attributes) with the ok rendering that agrees in all attributes; in nullable ones null equals null."""
    v, w = variants.where("status = 'ok'").alias("v"), wanted.alias("w")
    same = [F.col(f"v.{c}") == F.col(f"w.{c}") for c in exact] + [F.col(f"v.{c}").eqNullSafe(F.col(f"w.{c}")) for c in nullable]
    hit = w.join(v, same, "left").groupBy("w.id").agg(F.max("v.updated").alias("updated"))
    return hit.select("id", F.col("updated").isNotNull().alias("hit"), "updated")


def owned(children: DataFrame, parents: DataFrame, key: str, parent_key: str, owner: Column) -> DataFrame:
    """The children whose parent belongs to an owner."""
    return children.join(parents.where(owner).select(F.col(parent_key).alias(key)), key, "left_semi")


def retrieval_modes(blocks: DataFrame, embeddings: DataFrame, asked: str = "auto") -> DataFrame:
    """revision, eligible, embedded, stale, latest, mode: as asked, else hybrid where embeddings exist and none is stale, else by words.

    An embedding (block_id, source_hash, updated) is current while its hash is the block's.
    """
    rows = blocks.where(rules.embeddable(F.col("kind"), F.col("text"))).join(embeddings.withColumnRenamed("block_id", "id"), "id", "left")
    fresh, some = F.col("source_hash") == F.col("hash"), F.col("source_hash").isNotNull()
    sums = rows.groupBy("revision").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(fresh).alias("embedded"), F.count_if(some & ~fresh).alias("stale"), F.max(F.when(fresh, F.col("updated"))).alias("latest"))
    mode = F.when((F.col("embedded") > 0) & (F.col("stale") == 0), "hybrid").otherwise("fts") if asked == "auto" else F.lit(asked)
    return sums.withColumn("mode", mode)


def with_fallback(found: DataFrame, other: DataFrame, *key: str) -> DataFrame:
    """The rows found, and for the keys that have none those of another search."""
    return found.unionByName(other.join(found.select(*key).distinct(), list(key), "left_anti"))


def active_terms(terms: DataFrame, article: str, language: str) -> DataFrame:
    """The active terms with a target that hold for an article and a language."""
    scope = rules.in_scope(F.col("owner"), F.col("scope"), article) & rules.for_language(F.col("language"), F.col("direction"), language)
    return terms.where(scope & (F.col("status") == "active") & rules.filled(F.col("target")))


def glossary_versions(terms: DataFrame, *key: str) -> DataFrame:
    """key, version: a digest of a glossary's active terms in the order of their folded sources; glossary:none without any."""
    row = F.struct(fold(F.col("source")).alias("k"), F.concat_ws("\x1f", "source", "target", "direction", F.col("updated").cast("string")).alias("v"))
    active = F.when((F.col("status") == "active") & rules.filled(F.col("target")), row)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(active)), lambda x: x["v"]), "\x1e")
    sums = terms.groupBy(*key).agg(text.alias("text"))
    return sums.select(*key, F.concat(F.lit("glossary:"), F.when(F.col("text") == "", "none").otherwise(F.substring(F.sha2("text", 256), 1, 16))).alias("version"))


def shared_cards(cards: DataFrame, language: str) -> DataFrame:
    """key, id, status of the card that serves a key in all articles: not archived, with both forms; pinned before exported, then the newest."""
    usable = cards.where((F.col("status") != "archived") & (F.col("language") == language) & rules.filled(F.col("abbreviation")) & rules.filled(F.col("full_form")))
    order = F.struct(F.least(rules.card_rank(F.col("status")), F.lit(2)), -F.col("updated"), "id")
    return usable.groupBy("key").agg(F.min_by(F.struct("id", "status"), order).alias("c")).select("key", "c.id", "c.status")


def exportable_cards(cards: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Term cards with a body that aren't archived, all or those of given ids."""
    rows = cards.where((F.col("card_type") == "term") & rules.filled(F.col("body")) & (F.col("status") != "archived"))
    return rows if ids is None else rows.where(F.col("id").isin(ids))


def ordered_cards(cards: DataFrame, *group: str) -> DataFrame:
    """Cards with their place in each group: by status, then title, then id."""
    return cards.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(rules.card_rank(F.col("status")), "title", "id")))


def evidence_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """revision, uid, place of each revision's first blocks that serve as evidence."""
    rows = blocks.where(rules.embeddable(F.col("kind"), F.col("text"))).select("revision", "uid")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("revision").orderBy("uid"))).where(F.col("place") <= most)


def source_refs(evidence: DataFrame, chat: DataFrame, owner: str, uid: str) -> DataFrame:
    """owner, refs: the distinct uids of evidence and of chat messages (each owner, uid), in order."""
    both = evidence.select(owner, uid).unionByName(chat.select(owner, uid)).where(F.col(uid).isNotNull()).distinct()
    return both.groupBy(owner).agg(F.array_sort(F.collect_list(uid)).alias("refs"))


def inferred_categories(scores: DataFrame, owner: str, most: int = 8, least: float = 3.0) -> DataFrame:
    """owner, category, score, place: the best `most` categories first, of those the ones that score enough."""
    ranked = scores.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("score"), "category")))
    return ranked.where((F.col("place") <= most) & (F.col("score") >= least))


def term_runs(docs: DataFrame, id_col: str, text_col: str, stopwords: list[str]) -> DataFrame:
    """id, run, words: the words of a text between stop words and numbers, in order."""
    words = F.regexp_extract_all(fold(F.col(text_col)), F.lit(r"[a-z][a-z0-9-]+"), F.lit(0))
    rows = docs.select(id_col, F.posexplode(words).alias("at", "word")).withColumn("stop", F.col("word").isin(stopwords))
    run = F.count_if(F.col("stop")).over(Window.partitionBy(id_col).orderBy("at"))
    kept = rows.withColumn("run", run).where(~F.col("stop")).groupBy(id_col, "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    return kept.withColumn("run", F.row_number().over(Window.partitionBy(id_col).orderBy("run")))


def merged_by_id(rows: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with the columns of later findings where they have any; findings of unknown keys are left out."""
    found = new.select(key, *[F.col(c).alias(f"papyra_{c}") for c in columns])
    both = rows.join(found, key, "left")
    return both.select(*[F.coalesce(f"papyra_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def reviewed(memory: DataFrame, decisions: DataFrame) -> DataFrame:
    """Memory entries (id, review, reuse) after decisions (id, approve): those that are pending become approved and reusable, or rejected."""
    both = memory.join(decisions, "id", "left")
    decided = (F.col("review") == "pending") & F.col("approve").isNotNull()
    review = F.when(decided & F.col("approve"), "approved").when(decided, "rejected").otherwise(F.col("review"))
    return both.select("id", review.alias("review"), F.when(decided, F.col("approve")).otherwise(F.col("reuse")).alias("reuse"))


def generated(cards: DataFrame, new: DataFrame) -> DataFrame:
    """Cards (id, body, edited) with generated bodies (id, text): an edited card keeps its body and gets the text as a suggestion."""
    both = cards.join(new, "id", "left")
    body = F.when(~F.col("edited"), F.coalesce("text", "body")).otherwise(F.col("body"))
    return both.select("id", "edited", body.alias("body"), F.when(F.col("edited"), F.col("text")).alias("suggested"))


def upserted_terms(terms: DataFrame, new: DataFrame) -> DataFrame:
    """Terms (source, target, previous) after others (source, target): one for each folded source; a target that changes joins the previous ones."""
    old = terms.select(fold(F.col("source")).alias("k"), F.col("source").alias("old_source"), F.col("target").alias("old"), "previous")
    got = new.select(fold(F.col("source")).alias("k"), F.col("source").alias("new_source"), F.col("target").alias("new"))
    both = old.join(got, "k", "full_outer")
    changed = F.col("new").isNotNull() & F.col("old").isNotNull() & (F.col("new") != F.col("old"))
    none = F.array().cast("array<string>")
    previous = F.when(changed, rules.appended_once(F.col("previous"), F.col("old"))).otherwise(F.coalesce("previous", none))
    return both.select(F.coalesce("old_source", "new_source").alias("source"), F.coalesce("new", "old").alias("target"), previous.alias("previous"))


def set_status(rows: DataFrame, changed: DataFrame, key: str, status: str, to: str) -> DataFrame:
    """Rows with a new status where changed has their key."""
    marks = changed.select(key).distinct().withColumn("papyra_hit", F.lit(True))
    return rows.join(marks, key, "left").withColumn(status, F.when(F.col("papyra_hit"), to).otherwise(F.col(status))).drop("papyra_hit")


def aligned_progress(progress: DataFrame, blocks: DataFrame, owner: str, uid: str) -> DataFrame:
    """owner, segments, active, total, percent: seconds by block in block order. progress: (owner, seconds map, active uid)."""
    order = blocks.groupBy(owner).agg(F.array_sort(F.collect_list(uid)).alias("uids"))
    rows = order.join(progress, owner, "left").withColumn("segments", rules.aligned(F.coalesce("seconds", F.create_map().cast("map<string,int>")), F.col("uids")))
    rows = rows.withColumn("active", rules.position(F.col("uids"), F.col("active_uid"))).withColumn("total", F.aggregate("segments", F.lit(0), lambda s, x: s + x))
    return rows.select(owner, "segments", "active", "total", rules.read_percent(F.col("active"), F.col("segments"), F.col("total")).alias("percent"))


def listed(articles: DataFrame, shown: str = "all", sort: str = "updated", most: int = 500) -> DataFrame:
    """The first `most` articles of one filter in one order, with read_percent and place.

    articles: (id, title, external_id, status, updated, translatable, translated, state, seconds, segments, active). shown:
    all, reading (read for some time), needs_translation or translated; sort: updated (newest first), title (blind to case
    and accents first, as readers sort) or progress (furthest first). Ties go by id.
    """
    seconds, segments = F.coalesce("seconds", F.lit(0)), F.coalesce("segments", F.lit(0))
    # halves go up
    done = F.least(F.lit(100), F.floor((F.col("active") + 1) * 100.0 / segments + 0.5))
    rows = articles.withColumn("read_percent", F.when((segments > 0) & (seconds > 0) & F.col("active").isNotNull(), done).otherwise(0).cast("long"))
    tests = {"all": F.lit(True), "reading": seconds > 0, "needs_translation": F.greatest(F.col("translatable") - F.col("translated"), F.lit(0)) > 0, "translated": F.col("state") == "translated"}
    name = F.coalesce("title", "external_id")
    orders = {"updated": [F.desc_nulls_last("updated")], "title": [F.collate(name, "UNICODE_CI_AI"), F.collate(name, "UNICODE")], "progress": [F.desc("read_percent")]}
    first = rows.where(tests[shown]).orderBy(*orders[sort], "id").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*orders[sort], "id")))


def list_counts(articles: DataFrame) -> DataFrame:
    """source, articles, reading, translated, archived of listed() articles (source)."""
    return articles.groupBy("source").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.coalesce("seconds", F.lit(0)) > 0).alias("reading"), F.count_if(F.col("state") == "translated").alias("translated"), F.count_if(F.col("status") == "archived").alias("archived"))


def usable_variants(variants: DataFrame) -> DataFrame:
    """The renderings that a reader can show: ok, with the uid of a block."""
    return variants.where((F.col("status") == "ok") & rules.filled(F.col("seen_uid")))


def seed_categories(articles: DataFrame, library: str, place: str, most: int = 8) -> DataFrame:
    """library, category, weight, rank of each library's first categories: 2 for each article's primary one, 1 for each of its categories; ties go to the one that was met first.

    articles: (library, place, primary, categories). An article's primary category is met before its others.
    """
    main = F.array(F.struct(F.lit(0).alias("at"), F.col("primary").alias("category"), F.lit(2).alias("weight")))
    others = F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c, k: F.struct((k + 1).alias("at"), c.alias("category"), F.lit(1).alias("weight")))
    rows = articles.select(library, place, F.inline(F.concat(main, others))).where(rules.filled(F.col("category")))
    sums = rows.groupBy(library, "category").agg(F.sum("weight").alias("weight"), F.min(F.struct(place, "at")).alias("papyra_first"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(library).orderBy(F.desc("weight"), "papyra_first")))
    return ranked.where(F.col("rank") <= most).drop("papyra_first")


def cache_key(prefix: str, fields: Column, ascii: bool = True) -> Column:
    """A key for what was asked: the prefix and the SHA-256 of a struct's fields as JSON with sorted keys, null ones too, other characters than ASCII as escapes if asked for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        plain = texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, ensure_ascii=ascii))
        return prefix + plain.map(lambda t: hashlib.sha256(t.encode()).hexdigest())

    return run(F.to_json(fields, {"ignoreNullFields": "false"}))
