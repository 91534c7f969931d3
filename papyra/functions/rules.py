"""Rules of the library's rows as columns: what is translatable, valid, shared or visible; ranks, hashes and small repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.functions.text import collapse, fold, once

#: Kinds of blocks that are translated, and those that are embedded or serve as evidence (fixed values).
TRANSLATABLE = ["paragraph", "list", "figure", "table"]
ELIGIBLE = ["paragraph", "section", "figure", "table", "equation"]
#: Weight of headings in searches; dimensions of a model that names none, and their bounds (fixed values).
SECTION_WEIGHT, DIMENSIONS, LEAST_DIMENSIONS, MOST_DIMENSIONS = 0.35, 64, 8, 4096


def filled(text: Column) -> Column:
    """Whether a text has more than white space."""
    return F.coalesce(F.trim(text) != "", F.lit(False))


def translatable(kind: Column, text: Column) -> Column:
    """Whether a block is translated."""
    return kind.isin(TRANSLATABLE) & filled(text)


def embeddable(kind: Column, text: Column) -> Column:
    """Whether a block is embedded."""
    return kind.isin(ELIGIBLE) & filled(text)


def still_valid(seen_hash: Column, seen_uid: Column, now_hash: Column, now_uid: Column) -> Column:
    """Whether a rendering may still be shown: it names no content, or the block's, or it names the block."""
    return seen_hash.isNull() | F.coalesce(seen_hash == now_hash, F.lit(False)) | F.coalesce(seen_uid == now_uid, F.lit(False))


def matches_now(status: Column, seen_hash: Column, seen_uid: Column, now_hash: Column, now_uid: Column) -> Column:
    """Whether a rendering is ok and contradicts neither the block's name nor its content."""
    agrees = lambda seen, now: F.coalesce(seen == now, F.coalesce(seen, F.lit("")) == "")
    return (status == "ok") & agrees(seen_uid, now_uid) & agrees(seen_hash, now_hash)


def in_scope(owner: Column, scope: Column, wanted: str) -> Column:
    """Whether a term belongs to an article or to more than one."""
    return F.coalesce(owner == wanted, F.lit(False)) | (scope != "article")


def for_language(target: Column, direction: Column, wanted: str) -> Column:
    """Whether a term is for a language: it names none, or that one, or its direction ends there."""
    return target.isNull() | (target == wanted) | F.coalesce(direction.endswith(f"->{wanted}"), F.lit(False))


def search_weight(kind: Column) -> Column:
    """Weight of a block in searches."""
    return F.when(kind == "section", SECTION_WEIGHT).otherwise(1.0)


def model_dimensions(model: Column) -> Column:
    """The dimensions that a model's name states, within bounds; 64 where it states none."""
    number = F.nullif(F.regexp_extract(model, r"(\d+)", 1), F.lit("")).cast("decimal(38,0)")
    return F.when(number.isNotNull(), F.greatest(F.lit(LEAST_DIMENSIONS), F.least(number, F.lit(MOST_DIMENSIONS))).cast("int")).otherwise(DIMENSIONS)


def card_rank(status: Column) -> Column:
    """Order of cards by status."""
    return F.when(status == "pinned", 0).when(status == "exported", 1).when(status == "candidate", 2).otherwise(3)


def reference_kind(kind: Column, label: Column, fragment: Column, text: Column) -> Column:
    """What a reference to a block points at: a table that holds an equation, and a figure that is labelled as a table, count as those."""
    says = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False))
    equation = (kind == "table") & says(fragment, r"(?i)ltx_(?:equation|equationgroup|eqn_)")
    return F.when(equation, "equation").when((kind == "figure") & (says(label, r"(?i)(^tab:|\.T\d+$)") | says(text, r"(?i)^\*\*Table\s+\d+")), "table").otherwise(kind)


def candidate(phrase: Column) -> Column:
    """A phrase without punctuation at its ends and with single blanks."""
    return collapse(F.regexp_replace(phrase, r"^[ \-_:;,.()\[\]{}]+|[ \-_:;,.()\[\]{}]+$", ""))


def is_candidate(phrase: Column, stopwords: list[str]) -> Column:
    """Whether a phrase has two to six words and 4 to 100 characters, no stop word at its ends, and two words with letters."""
    words = F.transform(F.filter(F.split(phrase, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(fold(w), "^-+|-+$", ""))
    stop = lambda w, at: F.element_at(w, at).isin(stopwords)
    fits = lambda w: F.size(w).between(2, 6) & ~stop(w, 1) & ~stop(w, -1) & (F.size(F.filter(w, lambda x: x.rlike("[a-z]"))) >= 2)
    return F.length(phrase).between(4, 100) & once(words, fits)


def sorted_json(**values: Column | str | None) -> Column:
    """A JSON object of strings with its keys in order, null where a value is null."""
    text = lambda v: F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')), F.lit("null"))
    parts = [F.concat(F.lit(f'"{k}": '), text(v) if isinstance(v, Column) else F.lit("null" if v is None else f'"{v}"')) for k, v in sorted(values.items())]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def context_hash(content_hash: Column, language: Column, provider: Column, model: Column, glossary: Column, context: Column, prompt: Column) -> Column:
    """The hash of all that a rendering depends on."""
    prompt_hash = F.when(filled(prompt), F.sha2(F.trim(prompt), 256))
    return F.sha2(sorted_json(content_hash=content_hash, target_language=language, provider_profile_id=provider, model=model, glossary_version=glossary, context_markdown_hash=F.sha2(context, 256), custom_prompt_hash=prompt_hash, prompt_version="translation.v1"), 256)


def string_hash(text: Column) -> Column:
    """A 32-bit hash in base 36: times 33, exclusive or with each character, from 5381."""
    step = lambda h, c: (h * 33).bitwiseXOR(F.ascii(c).cast("long")).bitwiseAND(F.lit((1 << 32) - 1))
    return F.lower(F.conv(F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(5381).cast("long"), step).cast("string"), 10, 36))


def appended_once(values: Column, value: Column) -> Column:
    """A list with one more value, unless it is empty or there already."""
    known = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(~filled(value) | F.array_contains(known, value), known).otherwise(F.concat(known, F.array(value)))


def chat_text(payload: Column) -> Column:
    """The text of a chat reply: a message's text, or the texts of its parts by lines; null where there is none."""
    content = F.get_json_object(payload, "$.choices[0].message.content")
    parts = F.from_json(content, "array<struct<text string>>")
    return F.nullif(F.trim(F.coalesce(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull()), "\n"), content)), F.lit(""))


def message_text(payload: Column) -> Column:
    """The text parts of a message reply by lines; null where there is none."""
    parts = F.from_json(F.get_json_object(payload, "$.content"), "array<struct<type string, text string>>")
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    return F.nullif(F.trim(F.array_join(texts, "\n")), F.lit(""))


def aligned(seconds: Column, uids: Column) -> Column:
    """A map's values in the order of uids, 0 where it has none."""
    return F.transform(uids, lambda u: F.coalesce(F.element_at(seconds, u), F.lit(0)))


def position(uids: Column, uid: Column) -> Column:
    """Place of a uid from 0, null where it is missing."""
    return F.nullif(F.array_position(uids, uid), F.lit(0).cast("long")) - 1


def timeout_budget(source_bytes: Column, tex_files: Column, graphics: Column, post: bool = False, base: float = 200.0, most: float = 2400.0) -> Column:
    """Seconds that a conversion may take, by the size of its sources; post: its second step (fixed rates)."""
    mib = source_bytes / 1_048_576
    if post:
        estimate = max(90.0, base * 0.55) + mib * 45.0 + F.least(F.lit(240.0), tex_files * 1.5 + graphics * 4.0)
    else:
        estimate = base + mib * 120.0 + F.least(F.lit(720.0), tex_files * 3.0 + graphics * 8.0)
    return F.greatest(F.lit(60.0), F.least(estimate, F.lit(most)))


def backoff(seconds: Column, most: float) -> Column:
    """The next wait of an idle worker: half as long again, up to a bound."""
    return F.least(seconds * 1.5, F.lit(most))


def read_percent(active: Column, segments: Column, total: Column) -> Column:
    """How much of an article is read: by its active place (from 0), else by the places that were visited."""
    n = F.size(segments)
    done = F.coalesce(active + 1, F.size(F.filter(segments, lambda s: s > 0)))
    return F.when((n > 0) & (total > 0), F.least(F.lit(100), F.floor(done * 100.0 / n + 0.5).cast("int"))).otherwise(0)
