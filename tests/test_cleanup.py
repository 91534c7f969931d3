"""Markdown without what conversion leaves, and notes and citations within lines."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import cleanup
from papyra.sources import tree


@pytest.mark.parametrize(("text", "want"), [
    (r"As \citeauthor*[see][p. 2]{Smith:2020} says , \citeauthor key yes", "As says, yes"), ("see Smith2020 [Smith2020] and Net [Net]", "see [Smith2020] and Net [Net]"),
    ("<https://a.org/x> https://b.org/y, (https://c.org). [t](https://d.org/z)", "[https://a.org/x](https://a.org/x) [https://b.org/y](https://b.org/y), ([https://c.org](https://c.org)). [t](https://d.org/z)"),
    ("[Smith\xa0et al.(2020a), p. 3](#bib.b1) [12](#bib.b2) [x (2020)](u)", "[Smith et al. (2020a)](#bib.b1) [12](#bib.b2) [x (2020)](u)"), ("a  b\n c ;", "a b c;"), ("", ""),
])
def test_artefacts(text, want):
    assert cleanup.without_artefacts(text) == want


def test_lines_stay(spark):
    text = "a  b ,\n  - x   y\n\nhttps://a.org.\n"
    assert cleanup.without_artefacts(text, lines=True) == "a b,\n  - x y\n\n[https://a.org](https://a.org)."
    rows = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in rows.select(cleanup.clean(F.col("t"), True)).collect()] == [cleanup.without_artefacts(text, True), None]
    assert [r[0] for r in rows.select(cleanup.compact(F.col("t"))).collect()] == ["a  b ,\n  - x   y\n\nhttps://a.org.", None]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "- x", "  2) y", "", "  ", "b \t", "\r"]), max_size=10))
def test_compacted(lines):
    got = cleanup.compacted("\n".join(lines)).split("\n")
    kept = [x.rstrip() for x in "\n".join(lines).replace("\r\n", "\n").split("\n") if x.strip()]
    assert [x for x in got if x] == [kept[0].lstrip(), *kept[1:]] if kept else got == [""]
    assert not any(a == b == "" for a, b in zip(got, got[1:], strict=False))
    assert not any(a == "" and b.lstrip().startswith(("- x", "2) y")) for a, b in zip(got, got[1:], strict=False))
    assert cleanup.compacted("\n".join(got)) == "\n".join(got)


@pytest.mark.parametrize(("html", "want"), [
    ('<p>A<span class="ltx_note ltx_role_footnote"><sup class="ltx_note_mark">1</sup><span class="ltx_note_outer"><span class="ltx_note_content"><sup class="ltx_note_mark">1</sup><span class="ltx_tag ltx_tag_note">1</span>See <b>x</b>.</span></span></span>, b</p>', "A (See **x**), b"),
    ('<p>by <cite class="ltx_cite">[<a href="#bib.b1">Smith et al.\xa0(2020), p. 1</a>; <a href="#bib.b2">3</a>]</cite>.</p>', "by [Smith et al. (2020)](#bib.b1); [3](#bib.b2)."),
    ('<p>by <cite>[<span class="ltx_ref ltx_missing_citation ltx_ref_self">Doe2020 ,Roe;X</span>]</cite> <cite>[7]</cite></p>', "by [Doe2020, Roe; X] [7]"),
    ('<p>x<span class="ltx_note ltx_role_footnote"></span> y</p>', "x y"),
])
def test_notes_and_citations(html, want):
    assert tree.inline(ET.fromstring(html)) == want
