"""Columns of vectors, JSON, maps, dates and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; 0 where their lengths differ or one is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    """A number kept between two bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, half up, 100 at most; 0 of nothing."""
    return F.when(whole > 0, F.least(F.lit(100), F.round(part * 100.0 / whole).cast("int"))).otherwise(F.lit(0))


def hashed_slot(token: Column, dimensions: int) -> Column:
    """The coordinate of a token: the first four bytes of its SHA-256, modulo the dimensions."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def hashed_sign(token: Column) -> Column:
    """-1 where the fifth byte of a token's SHA-256 is odd, else 1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)


def idf(documents: Column, containing: Column) -> Column:
    """Inverse document frequency of BM25, never below a millionth."""
    return F.greatest(F.lit(1e-6), F.log((documents - containing + 0.5) / (containing + 0.5)))


def bm25(tf: Column, length: Column, mean: Column, weight: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """One term's part of a BM25 score."""
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def expired(until: Column, now: Column) -> Column:
    """Whether a time has come; an entry without one counts as expired."""
    return F.coalesce(until <= now, F.lit(True))


def json_map(text: Column) -> Column:
    """A JSON object's values by key, each of its own kind; null for anything but an object."""
    return F.from_json(text, "map<string,variant>")


def merged(old: Column, new: Column) -> Column:
    """Two JSON objects as one map of variants, the newer value where both have a key; numbers, lists and objects stay what they are. What isn't an object counts as an empty one."""
    left, right = (F.coalesce(json_map(x), F.create_map().cast("map<string,variant>")) for x in (old, new))
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def without_low(preferences: Column, key: str, low: Column) -> Column:
    """A JSON object of preferences whose list of strings under `key` lacks the items that `low`, an array, has; null where it isn't an object."""
    kept = F.filter(F.from_json(F.get_json_object(preferences, f"$.{key}"), "array<string>"), lambda x: ~F.array_contains(low, F.lower(x)))
    return F.when(json_map(preferences).isNotNull(), F.when(kept.isNull(), preferences).otherwise(F.to_json(merged(preferences, F.to_json(F.create_map(F.lit(key), kept))))))


#: Names under which replies give what a citation has, the first that holds text (fixed values).
REFERENCE_KEYS = {"title": ["title"], "url": ["url"], "doi": ["doi"], "arxiv_id": ["arxiv_id", "arxivId", "arxiv"], "raw_snippet": ["raw_snippet", "snippet", "text"]}
#: Names under which replies give their citations, the first that holds any (fixed values).
REFERENCE_LISTS = ["citations", "external_refs"]


def external_refs(reply: Column) -> Column:
    """The citations of a JSON reply as structs: title, url, doi, arxiv_id and raw_snippet, with what else they say, of whatever kind, in `metadata` as JSON.

    Items that aren't objects are left out; blank and other values than text are null (a snippet is empty). Replies without
    a list of citations have none.
    """
    lists = [F.from_json(F.get_json_object(reply, f"$.{k}"), "array<variant>") for k in REFERENCE_LISTS]
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))
    known = [k for keys in REFERENCE_KEYS.values() for k in keys]

    def text(item: Column, keys: list[str]) -> Column:
        values = [F.when(F.schema_of_variant(F.try_element_at(item, F.lit(k))) == "STRING", F.trim(F.try_element_at(item, F.lit(k)).cast("string"))) for k in keys]
        return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])

    def one(item: Column) -> Column:
        rest = F.map_filter(item, lambda k, _: ~k.isin(known))
        fields = [text(item, keys).alias(name) for name, keys in REFERENCE_KEYS.items()]
        fields[-1] = F.coalesce(text(item, REFERENCE_KEYS["raw_snippet"]), F.lit("")).alias("raw_snippet")
        return F.struct(*fields, F.to_json(rest).alias("metadata"))

    maps = F.filter(F.transform(found, lambda x: json_map(F.to_json(x))), lambda m: m.isNotNull())
    return F.transform(maps, one)


def repaired_json(text: Column) -> Column:
    """The object that a reply holds: that of a fenced block, else what lies between the outermost braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def duration_label(seconds: Column) -> Column:
    """Seconds as a short label."""
    minutes = F.floor(seconds / 60)
    return F.when(seconds < 60, F.concat(seconds.cast("int").cast("string"), F.lit("s"))).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))


def log_tf(count: Column) -> Column:
    """Damped term frequency."""
    return 1 + F.log(count.cast("double"))


#: What errors say that don't pass by themselves (fixed values).
TERMINAL = ["400", "401", "403", "404", "unauthorized", "forbidden", "authentication", "api key", "invalid_api_key", "model_not_found", "context_length", "maximum context"]


def transient(message: Column) -> Column:
    """Whether an error may pass by itself."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return ~F.exists(F.array(*[F.lit(x) for x in TERMINAL]), lambda x: F.contains(text, x))


LOG_2 = math.log(2)
