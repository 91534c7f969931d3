"""Nested values compared piece by piece: a row for each difference, with its path."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIFFERENCE = "path string, kind string, expected string, actual string"
#: Stands for a key or an item that there isn't; one object in every process.
_NONE = ...


def _text(value) -> str | None:
    return None if value is _NONE else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _step(path: str, key) -> str:
    return f"{path}[{key}]" if isinstance(key, int) else f"{path}.{key}" if str(key).isidentifier() else f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def _kind(value) -> str:
    """number, text, flag, null, list or object."""
    return {bool: "flag", int: "number", float: "number", str: "text", list: "list", dict: "object"}.get(type(value), "null")


def differences_of(expected, actual, lenient: bool = False) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(path, kind, expected, actual) of each difference, in the order of paths: `missing` and `extra` keys and items, `type`, `value`, and `duplicate` items that a list of `actual` has more often than that of `expected`.

    Objects are compared by key, lists by place; values of different kinds aren't looked into. lenient: keys that the
    expected object at the top lacks, or has as null, aren't compared.
    """
    todo = [("$", expected, actual)]
    while todo:
        path, a, b = todo.pop()
        if a is _NONE or b is _NONE:
            yield path, "extra" if a is _NONE else "missing", _text(a), _text(b)
        elif _kind(a) != _kind(b):
            yield path, "type", _text(a), _text(b)
        elif isinstance(a, dict):
            keys = [k for k in a if a[k] is not None] if lenient and path == "$" else a.keys() | b.keys()
            todo += [(_step(path, k), a.get(k, _NONE), b.get(k, _NONE)) for k in sorted(keys, reverse=True)]
        elif isinstance(a, list):
            more = Counter(map(_text, b)) - Counter(map(_text, a))
            yield from ((path, "duplicate", None, x) for x in sorted(more) if more[x] and Counter(map(_text, b))[x] > 1)
            todo += [(_step(path, k), a[k] if k < len(a) else _NONE, b[k] if k < len(b) else _NONE) for k in range(max(len(a), len(b)) - 1, -1, -1)]
        elif a != b:
            yield path, "value", _text(a), _text(b)


def differences(pairs: DataFrame, id_col: str, expected: str, actual: str, lenient: bool = False) -> DataFrame:
    """id and DIFFERENCE for two columns of JSON; nothing is shuffled.

    A null on one side is a missing or an extra value at the root, on both sides no difference; text that isn't JSON is a
    difference of kind `unreadable`.
    """
    names = [x.split()[0] for x in DIFFERENCE.split(", ")]

    def read(text: str | None):
        return _NONE if text is None else json.loads(text)

    def one(a: str | None, b: str | None) -> list[tuple]:
        if a is None and b is None:
            return []
        try:
            return list(differences_of(read(a), read(b), lenient))
        except (ValueError, RecursionError):
            return [("$", "unreadable", a, b)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *d) for key, a, b in batch.itertuples(index=False, name=None) for d in one(a, b)]
            yield pd.DataFrame(rows, columns=["papyra_id", *names])

    kind = pairs.schema[id_col].dataType.simpleString()
    found = pairs.select(F.col(id_col).alias("papyra_id"), F.col(expected), F.col(actual)).mapInPandas(run, f"papyra_id {kind}, {DIFFERENCE}")
    return found.withColumnRenamed("papyra_id", id_col)


def passed(pairs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """id, failures, passed: the outcome for every pair, those without a difference too."""
    sums = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("failures"))
    return pairs.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce("failures", F.lit(0)).cast("long").alias("failures"), F.col("failures").isNull().alias("passed"))
