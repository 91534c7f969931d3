"""Notes, replies, lists, keys, clean-up of exports and folding on odd rows."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from papyra.functions.text import casefolded, fold
from papyra.operators import library, mining, notes, tables, translation
from papyra.sources.html import export_text

CLEANED = [
    ("a<!-- m-content-notice:v1 -->\nnotice\n<!-- x --><!-- /m-content-notice:v1 -->b", "ab"), ("a<!-- m-content-notice:v1 open", "a<!-- m-content-notice:v1 open"),
    ("a <!-- m-note-patch:7 -->b<!-- /m-note-patch:7 --><!-- untranslated: p -->c<!-- kept -->", "a bc<!-- kept -->"), ('x<a id="s1"></a>y<A ID=\'s\'></A><a id="k">z</a><a href="u"></a>', 'xy<a id="k">z</a><a href="u"></a>'),
    ("Article revision: `r1`\nSource refs: `a`, `b`\nArticle revision: r2\ntext", "Article revision: r2\ntext"), ("a<br>b<BR/>c<p class=x>d</p>e", "a\nb\ncd\n\ne"),
    ("<div><span>a</span> &lt;b&gt; &amp;amp;</div><b>c</b>", "a <b> &amp;<b>c</b>"), ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 |  |"),
    ("<table>open", "<table>open"), ("a\n\n\n\nb", "a\n\nb"), ("1 < 2 > 0", "1 < 2 > 0"), ("", ""), ("<!-- /m-content-notice:v1 -->", "<!-- /m-content-notice:v1 -->"),
]


@pytest.mark.parametrize(("markdown", "want"), CLEANED)
def test_export_text(markdown, want):
    assert export_text(markdown, "m") == want


def test_folding(spark):
    words = ["Straße", "STRASSE", "ẞ", "ΣΊΣΥΦΟΣ", "σίσυφος", "ſ", "ﬁn", "µ", "İ", "plain", "", None, "Ǆ"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f"), casefolded(F.col("w")).alias("c")).collect()
    assert [r.c for r in rows] == [None if w is None else w.casefold() for w in words]
    assert [r.f for r in rows] == [r.c for r in rows]


def test_hints_are_quoted(spark):
    docs = spark.createDataFrame([(1, "We use C++ and a.b but not aXb (c++)"), (2, None)], "id int, text string")
    got = mining.hint_scores(docs, {"lang": {"c++": 1.0, "a.b": 10.0, "we  use": 100.0}}, "id", "text").collect()
    assert [tuple(r) for r in got] == [(1, "lang", 112.0)]


def test_differences_of_tables(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([("x", 2), (None, 1), ("y", 3)], "v string, k int")
    got = sorted((tuple(r) for r in tables.both_differences(a, b).collect()), key=str)
    assert got == [(1, None, "missing"), (3, "y", "unexpected")]
    assert tables.both_differences(a, a).count() == 0


def test_answers_as_notes(spark):
    refs, outside = "array<string>", "array<struct<title:string,url:string,doi:string,arxiv_id:string>>"
    rows = [(1, 1, "assistant", "\n  First " + "x" * 100 + "\r\nsecond", ["b"], [(None, None, "d", None), (None, None, None, None)]), (2, 1, "user", "q", None, None), (3, 1, "assistant", " \n ", None, []), (4, 2, "assistant", None, [], None)]
    table = spark.createDataFrame(rows, f"id int, revision int, role string, content string, refs {refs}, outside {outside}")
    got = {r.message: (r.title, r.patch) for r in notes.patches_from_chat(table).collect()}
    assert got[1][0] == ("First " + "x" * 100)[:80] and got[1][1].endswith("second\n\nCurrent-paper evidence: [b]\n\nExternal evidence:\n- d\n- external citation\n")
    assert got[3] == got[4] == ("Chat note", "## Chat note\n") and 2 not in got
    lines = notes.chat_lines(table.withColumn("place", F.col("id")).where("content is not null"), last=2).collect()
    assert {r.revision: r.chat for r in lines} == {1: "user: q\nassistant:  \n "}


def test_replies(spark):
    cases = [("A b", "A b\n\n: neu", "neu", "ok"), ("A b", "a  B", "a  B", "unchanged_source"), ("GPT 4", "GPT 4", "GPT 4", "ok"), ("$x$", "$x$", "$x$", "unchanged_source"), ("1 + 2", "1 + 2", "1 + 2", "ok"), ("A b", "A b", "A b", "unchanged_source"), ("A b", None, "", "empty"), (None, "neu", "neu", "ok"), ("", "", "", "empty"), ("A b", "A bA b", "A bA b", "ok"), ("[BERT](x y)", "[BERT](x y)", "[BERT](x y)", "ok"), ("x ```a```", "neu ```a``` ```b```", "neu ```a``` ```b```", "code_fence_count_changed"), ("x", "``` neu", "``` neu", "unbalanced_code_fence")]
    rows = spark.createDataFrame([(k, s, r, 3, " ") for k, (s, r, *_) in enumerate(cases)], "block_id int, source string, reply string, attempt int, custom_prompt string")
    got = {r.block_id: (r.target, r.status, r.requeue, r.remember) for r in translation.outcomes(rows).collect()}
    assert got == {k: (t, s, False, s == "ok") for k, (_, _, t, s) in enumerate(cases)}
    again = {r.block_id: r.requeue for r in translation.outcomes(rows.withColumn("attempt", F.lit(1))).collect()}
    assert again == {k: s != "ok" for k, (*_, s) in enumerate(cases)}


def test_decisions(spark):
    blocks = spark.createDataFrame([(1, "paragraph", "x", "u1", None), (2, "code", "x", "u2", "v"), (3, "paragraph", " ", "u3", "v"), (4, "paragraph", "x", "u4", "v"), (5, "paragraph", "x", "u5", "v")], "id int, kind string, text string, uid string, version string")
    jobs = spark.createDataFrame([(9, "queued", 2, "u1", None), (8, "running", 1, "u1", None), (7, "done", 0, "u1", None), (6, "queued", 0, "u5", "w")], "job int, status string, created int, uid string, version string")
    cached = spark.createDataFrame([(4,), (4,)], "id int")
    got = {r.id: (r.decision, r.job) for r in translation.decided(blocks, cached, jobs, ["uid", "version"]).collect()}
    assert got == {1: ("existing", 8), 2: ("skipped", None), 3: ("skipped", None), 4: ("cached", None), 5: ("queued", None)}
    forced = {r.id: r.decision for r in translation.decided(blocks, cached, jobs, ["uid", "version"], force=True).collect()}
    assert forced == {1: "queued", 2: "skipped", 3: "skipped", 4: "queued", 5: "queued"}


def test_lists(spark):
    schema = "id int, title string, external_id string, source string, status string, updated long, translatable int, translated int, state string, seconds int, segments int, active int"
    rows = [(1, "beta", "e", "s", "parsed", 5, 4, 4, "translated", 10, 8, 3), (2, "Älpha", "e", "s", "archived", 9, 4, 1, "partial", None, 0, None), (3, None, "alpha", "s", "parsed", None, 0, 0, "not_required", 5, 2, 5), (4, "Beta", "e", None, "parsed", 7, 1, 2, "partial", 0, 4, 1)]
    table = spark.createDataFrame(rows, schema)
    order = lambda **how: [r.id for r in library.listed(table, **how).orderBy("place").collect()]
    assert order() == [2, 4, 1, 3] and order(sort="title")[:2] == [3, 2] and order(sort="progress") == [3, 1, 2, 4] and order(most=1) == [2]
    assert order(shown="reading") == [1, 3] and order(shown="needs_translation") == [2] and order(shown="translated") == [1]
    assert {r.id: r.read_percent for r in library.listed(table).collect()} == {1: 50, 2: 0, 3: 100, 4: 0}
    assert {r.source: tuple(r)[1:] for r in library.list_counts(table).collect()} == {"s": (3, 2, 1, 1), None: (1, 0, 0, 0)}
    variants = spark.createDataFrame([("ok", "u"), ("ok", None), ("ok", " "), ("bad", "u")], "status string, seen_uid string")
    assert library.usable_variants(variants).count() == 1


def test_keys(spark):
    row = spark.createDataFrame([(["a", "é"], 3, None, True)], "z array<string>, n int, m string, f boolean")
    for ascii in (True, False):
        text = json.dumps({"z": ["a", "é"], "n": 3, "m": None, "f": True}, sort_keys=True, ensure_ascii=ascii)
        assert row.select(library.cache_key("p:", F.struct("*"), ascii)).first()[0] == "p:" + hashlib.sha256(text.encode()).hexdigest()


def test_sentences(spark):
    from papyra.functions.text import read_sentences, spoken

    cases = {
        "One. Two!Three?": ["One.", "Two!", "Three?"], "Pi is 3.14. See Fig. 2, eq. 1.2.3; no.": ["Pi is 3.14.", "See Fig. 2, eq. 1.2.3;", "no."], 'He said "so." Then (yes!) left': ['He said "so."', "Then (yes!)", "left"],
        "一。二！三": ["一。", "二！", "三"], "config. Next": ["config.", "Next"], "Et al. write": ["Et al. write"], "a...": ["a.", ".", "."], "": [], "  ": [], "no end": ["no end"],
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", read_sentences(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases | {None: None}
    text = "a `code` ```x\ny``` ![alt](u) [link](v) **b**"
    assert spark.range(1).select(spoken(F.lit(text))).first()[0] == "a code alt link b"


def test_picked_titles(spark):
    from papyra.operators import search

    rows = [(1, 3, "The Net"), (1, 1, "other"), (1, 2, "the net!"), (2, 1, "x"), (2, 2, "a the net b"), (3, 5, "y"), (3, 4, "x"), (4, 1, "x"), (4, 2, None)]
    table = spark.createDataFrame(rows, "search int, id int, title string")
    got = {r.search: (r.id, r.tier) for r in search.picked_title(table, "search", F.lit("The net"), F.col("title"), "id").collect()}
    assert got == {1: (2, 0), 2: (2, 1), 3: (4, 2), 4: (2, 1)}
