"""Markdown of converted papers without what conversion leaves: undefined citations, doubled keys, bare addresses, long labels, loose blanks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a sentence and not an address (fixed value).
AFTER_URL = ".,;:"
_CITEAUTHOR = re.compile(r"\\citeauthor\*?(?:\s*\[[^\]]*\])*\s*\{?[\w:./-]+\}?\s*")
_KEY = re.compile(r"(?<!\w)([A-Za-z0-9][\w:./-]*)\s+(\[\1\])")
#: What holds or is an address: a link, an address in angle brackets, a bare one.
_ADDRESS = re.compile(r"(?P<link>\[[^\]]+\]\(https?://[^)\s]+\))|<(?P<angle>https?://[^<>\s]+)>|(?P<bare>https?://[^\s<>)\]]+)")
_CITED = re.compile(r"\[(?P<label>[^\]]*)\]\((?P<href>#bib\.[^)]+)\)")
_YEAR = re.compile(r"\s*\((\d{4}[a-z]?)\)")
_LIST_LINE = re.compile(r"\s*(?:[-+*]|\d+[.)])\s+")


def compact_label(label: str) -> str:
    """A citation's label up to its first year in brackets, with one blank before it; labels without one only on one line."""
    text = " ".join(label.replace("\xa0", " ").split())
    year = _YEAR.search(text)
    return text[: year.start()].rstrip() + f" ({year[1]})" if year and year.start() else text


def linked_addresses(text: str) -> str:
    """Addresses as links to themselves, those that are links already as they are; punctuation at an address's end stays outside."""

    def one(m: re.Match) -> str:
        if m["link"] or m.start() >= 2 and text[m.start() - 2 : m.start()] == "](":
            return m[0]
        url = m["angle"] or m["bare"].rstrip(AFTER_URL)
        rest = "" if m["angle"] else m["bare"][len(url) :]
        return f"[{url}]({url}){rest}"

    return _ADDRESS.sub(one, text)


def without_artefacts(text: str, lines: bool = False) -> str:
    """A text without undefined authors and doubled keys, its addresses linked and its citations' labels short, with single blanks and none before punctuation. lines: line feeds stay."""
    text = _CITEAUTHOR.sub("", text)
    text = _KEY.sub(lambda m: m[2] if any(c.isdigit() for c in m[1]) else m[0], text)
    text = linked_addresses(text)
    text = _CITED.sub(lambda m: f"[{compact_label(m['label'])}]({m['href']})" if _YEAR.search(m["label"]) else m[0], text)
    if not lines:
        return re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.;:])", r"\1", text)).strip()
    text = re.sub(r"[ \t]+([,.;:])", r"\1", text)
    return "\n".join(re.sub(r"(?<=\S)[ \t]{2,}", " ", line).rstrip() for line in text.splitlines()).strip()


def compacted(markdown: str) -> str:
    """Lines without blanks at their ends, one empty line between paragraphs, and none before an item of a list."""
    out: list[str] = []
    gap = False
    for line in (x.rstrip() for x in markdown.replace("\r\n", "\n").split("\n")):
        if line and gap and out and not _LIST_LINE.match(line):
            out.append("")
        if line:
            out.append(line)
        gap = not line
    return "\n".join(out).strip()


def _column(one: Callable[[str], str], text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(text)


def clean(text: Column, lines: bool = False) -> Column:
    """without_artefacts() of a column. Null stays null."""
    return _column(lambda t: without_artefacts(t, lines), text)


def compact(markdown: Column) -> Column:
    """compacted() of a column. Null stays null."""
    return _column(compacted, markdown)
