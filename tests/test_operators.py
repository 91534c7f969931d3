"""Operators on small tables, against results worked out by hand or by a plain loop."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as tx
from papyra.functions import values
from papyra.operators import context, jobs, mining, search, tables
from papyra.sources import feeds, html, sinks
from papyra.streaming import progress


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_text_functions(spark):
    assert one(spark, tx.fold(F.lit("Straße"))) == "strasse"
    assert one(spark, tx.collapse(F.lit("  a \n b "))) == "a b"
    assert one(spark, tx.tokens(F.lit("Ein Ähm x_1 b"))) == ["ein", "ähm", "x_1"]
    assert one(spark, tx.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, tx.occurrences(F.lit("aaaa"), F.lit(""))) == 0
    assert one(spark, tx.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["a b", "b c"]
    assert one(spark, tx.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, tx.replace_term(F.lit("Net net-work net."), "net", "$N\\")) == "$N\\ net-work $N\\."
    assert one(spark, tx.html_text(F.lit("<p>a &amp; b<script>x</script><!-- c --></p>"))) == "a & b"
    assert one(spark, tx.markdown_text(F.lit("# T\n`code` [a](b) $x$ c"))) == "T a c"
    assert one(spark, tx.sentences(F.lit("One. Two?  Three"))) == ["One.", "Two?", "Three"]
    assert one(spark, tx.shortened(F.lit("abcdefgh"), 6)) == "abc..."
    assert one(spark, tx.canonical_key(F.lit("cnn"), F.lit("Convolutional Networks"))) == "CNN::convolutional network"
    assert one(spark, tx.canonical_key(F.lit(None).cast("string"), F.lit("Studies"))) == "term::study"
    assert one(spark, tx.last_year(F.lit("1999 and 2021, p. 20210"))) == "2021"
    assert one(spark, tx.preprint_id(F.lit("http://x.org/abs/2101.01234v2"))) == "2101.01234"
    assert one(spark, tx.preprint_id(F.lit("none"))) is None
    for source, target, want in (("a", "", "empty"), ("a b", "a  b", "unchanged_source"), ("a", "```\nb", "unbalanced_code_fence"), ("a", "```\nb\n```", "code_fence_count_changed"), ("a", "b", "ok")):
        assert one(spark, tx.validity(F.lit(source), F.lit(target))) == want


def test_values(spark):
    assert one(spark, values.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0
    assert one(spark, values.dot(F.array(F.lit(1.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 0.0
    assert one(spark, values.percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, values.percent(F.lit(1), F.lit(0))) == 0
    assert one(spark, F.to_json(values.merged(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}')))) == '{"a":"1","b":"3"}'
    assert one(spark, F.to_json(values.merged(F.lit(None).cast("string"), F.lit('{"b":"3"}')))) == '{"b":"3"}'
    assert one(spark, values.repaired_json(F.lit('x {"a": 1} y'))) == '{"a": 1}'
    assert one(spark, values.repaired_json(F.lit("none"))) is None
    assert one(spark, values.expired(F.lit(None).cast("timestamp"), F.current_timestamp())) is True
    assert one(spark, values.duration_label(F.lit(3700))) == "1h 1m"


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta"), (4, None)], "id int, text string")
    scores = dict(rows(search.bm25_scores(docs, "beta gamma", "id", "text")))
    assert set(scores) == {1, 2} and scores[2] > scores[1]
    assert rows(search.substring_scores(docs, "eta", "id", "text"), "id") == [(1, 2), (2, 1)]
    lengths = rows(search.hashed_embeddings(docs, "id", "text").groupBy("id").agg(F.round(F.sum(F.col("value") ** 2), 9)), "id")
    assert lengths == [(1, 1.0), (2, 1.0), (3, 1.0)]
    words = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    vectors = spark.createDataFrame([(2, 1, 0.5), (3, 2, 0.4)], "id int, rank int, score double")
    got = dict(rows(search.fused(words, vectors, "id")))
    assert got[1] == 0.5 and got[2] == pytest.approx(0.65 / 3 + 0.35 * (0.5 + 0.5)) and got[3] == pytest.approx(0.35 * (0.4 + 1 / 3))


def test_jobs(spark):
    found = jobs.slots(spark.createDataFrame([(1, 0), (2, 10), (3, 500), (4, 501)], "id int, at long").withColumn("lane", F.lit("a")), "lane", "at", "id", 100)
    assert rows(found.select("id", "start_ms"), "id") == [(1, 0), (2, 100), (3, 500), (4, 600)]
    events = [("a", 1, "claim"), ("a", 2, "pause"), ("a", 3, "resume"), ("a", 4, "complete"), ("a", 5, "cancel"), ("b", 1, "pause"), ("b", 2, "resume"), ("d", 1, "claim"), ("d", 2, "fail"), ("d", 3, "cancel"), ("d", 4, "pause"), ("c", 1, "claim"), ("c", 2, "fail"), ("c", 3, "requeue"), ("c", 4, "claim")]
    folded = jobs.fold(spark.createDataFrame(events, "job string, at long, event string"), "job", "at", "event")
    assert rows(folded, "job") == [("a", "succeeded", 1), ("b", "queued", 0), ("c", "running", 2), ("d", "paused", 1)]
    tried = jobs.retried(spark.createDataFrame([(1, "timeout"), (3, "timeout"), (1, "Unauthorized")], "attempts int, error string"), "attempts", "error")
    assert [r.next_state for r in tried.collect()] == ["queued", "failed", "failed"]
    assert one(spark, jobs.default_priority(F.lit("parse_article"))) == 100 and one(spark, jobs.default_priority(F.lit("?"))) == 0


def test_tables(spark):
    old = spark.createDataFrame([("p1", "A"), ("p2", "B"), ("p3", "C"), ("p4", "D")], "uid string, h string")
    new = spark.createDataFrame([("p1", "A"), ("p2", "X"), ("p3", "B"), ("p9", "C")], "uid string, h string")
    got = {r.uid: (r.new_uid, r.fate) for r in tables.reconciled(old, new, "uid", "h").collect()}
    assert got == {"p1": ("p1", "kept"), "p2": ("p3", "moved"), "p3": ("p9", "moved"), "p4": (None, "gone")}
    snapshot = tables.upserted(spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "k int, v string, n int"), spark.createDataFrame([(1, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, n int"), ["k"], "n")
    assert rows(snapshot, "k") == [(1, "c", 1), (2, "b", 3), (3, "e", 1)]
    update = tables.merged_update(spark.createDataFrame([(1, "a", 1)], "k int, v string, n int"), spark.createDataFrame([(1, None, 2), (2, "z", None)], "k int, v string, n int"), "k")
    assert rows(update, "k") == [(1, "a", 2), (2, "z", None)]
    memory = spark.createDataFrame([("h", None, 1), ("h", None, 2), ("h", "g", 3)], "h string, g string, n int")
    hits = tables.memory_hits(spark.createDataFrame([(7, "h", None)], "id int, h string, g string"), memory, ["h"], ["g"], [F.desc("n")], "id")
    assert [(r.item_id, r.n) for r in hits.collect()] == [(7, 2)]


def test_context(spark):
    docs = spark.createDataFrame([(1, "# T\none\ntwo\n\n```\nx\n\ny\n```\nlast"), (2, None)], "id int, text string")
    got = rows(context.markdown_blocks(docs, "id", "text"), "id", "place")
    assert got == [(1, "00001", "section", "s-0001", "# T"), (1, "00002", "paragraph", "p-0001", "one\ntwo"), (1, "00003", "code", "c-0001", "```\nx\n\ny\n```"), (1, "00004", "paragraph", "p-0002", "last")]
    near = context.neighbours(spark.createDataFrame([("g", k, t) for k, t in enumerate(["a", "", "c", "d"])], "g string, k int, t string"), "g", "k", "t", 2)
    assert [r["context"] for r in near.orderBy("k").collect()] == ["c", "a\nc\nd", "a\nd", "c"]
    runs = context.islands(spark.createDataFrame([("g", k, k in (0, 2)) for k in range(4)], "g string, k int, b boolean"), "g", "k", F.col("b"))
    assert [r["island"] for r in runs.orderBy("k").collect()] == [1, 1, 2, 2]


def test_mining(spark):
    docs = spark.createDataFrame([(1, "Graph Neural Network (GNN) and graph neural network"), (2, "the graph neural network. Use `graph` here")], "id int, text string")
    found = {r.phrase: (r.uses, r.documents) for r in mining.glossary_candidates(docs, "text").collect()}
    assert found["graph neural network"] == (3, 2) and "the graph" not in found
    assert rows(mining.term_cards(docs, "id", "text").select("key", "abbreviation", "uses")) == [("GNN::graph neural network", "GNN", 1)]
    guarded = docs.select(mining.protected_glossary({"graph": "G"})("text").alias("x")).collect()[1]["x"]
    assert guarded == "the G neural network. Use `graph` here"
    counts = spark.createDataFrame([("l", "a b", 5), ("l", "a", 5), ("l", "c", 1)], "lib string, phrase string, uses long")
    assert rows(mining.seed_keywords(counts, "lib"), "place") == [("l", "a b", 1), ("l", "c", 2)]


def test_seed_keywords_by_plain_loop(spark):
    import itertools
    import random

    rng = random.Random(7)
    phrases = [" ".join(p) for n in (2, 3, 4) for p in itertools.product("abcdefghijk"[: 12 - 2 * n], repeat=n)]
    data = [(lib, p, rng.choice([1, 2, 3, 3])) for lib in ("x", "y", None) for p in rng.sample(phrases, 150)] + [("x", "v w x y z", 9)]
    want = []
    for lib in ("x", "y", None):
        held, picks = set(), []
        for _, phrase, _ in sorted((r for r in data if r[0] == lib and len(r[1].split()) <= 4), key=lambda r: (-r[2], -len(r[1].split()), r[1])):
            if len(picks) < 8 and not set(phrase.split()) <= held:
                held |= set(phrase.split())
                picks.append((lib, phrase, len(picks) + 1))
        want += picks
    for parts in (1, 5):
        counts = spark.createDataFrame(data, "lib string, phrase string, uses long").repartition(parts)
        assert sorted(rows(mining.seed_keywords(counts, "lib")), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width", [1, 50, 1 << 40])
def test_slots_by_plain_loop(spark, width):
    import random

    rng = random.Random(3)
    data = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 7)])) for k in range(120)]
    want = {}
    for lane in ("a", "b", None):
        free, skipped = None, 0
        for key, _, at in sorted((r for r in data if r[1] == lane), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            if at is None:
                want[key], skipped = None, skipped + 1
                continue
            want[key] = at if free is None else max(free, at)
            free = want[key] + 10
    requests = spark.createDataFrame(data, "id long, lane string, at long").withColumn("papyra_other", F.lit(1))
    timed = requests.where("at IS NOT NULL")
    got = {r.id: r.start_ms for r in jobs.slots(timed, "lane", "at", "id", 10, width).collect()}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert jobs.slots(requests, "lane", "at", "id", 10, width).where("at IS NULL AND start_ms IS NULL").count() == requests.where("at IS NULL").count()
    assert jobs.slots(requests.limit(0), "lane", "at", "id", 10, width).count() == 0


def test_export_cleaned(spark):
    text = "<!-- m-content-notice:v1 a\nb /m-content-notice:v1 -->x<br/>y<a id='q'></a>\n<!-- untranslated: 1 -->\n\n\nSource refs: a, b\n<p class=c>a &lt; b</p><span>z</span><!-- kept -->\n<TABLE><tr><td>1<br>2</td></tr><tr><td> </td></tr></TABLE>"
    done = html.export_cleaned(F.col("t"), "m")
    got = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string").select("id", done.alias("t"))
    assert rows(got, "id") == [(1, "x\ny\n\na < b\n\nz<!-- kept -->\n| 1 2 |\n| --- |"), (2, None), (3, "")]


def test_vault(spark):
    from papyra.operators import vault

    assert one(spark, vault.quoted(F.lit(" a\n\nb\n"))) == "> a\n>\n> b" and one(spark, vault.quoted(F.lit(" "))) == ""
    assert one(spark, vault.anchor("p", F.lit("r/1"), F.lit("x_2-"))) == "^p-r-1-x-2"
    assert one(spark, vault.file_name(F.lit(' a/b:  "c". '), "L")) == "a-b- -c-" and one(spark, vault.file_name(F.lit(" . "), "L")) == "L"
    assert one(spark, vault.heading(F.lit(None).cast("string"), F.lit(" a  b "))) == "a b" and one(spark, vault.heading(F.lit(" "))) == "Untitled paper"
    card = vault.card_entry(F.lit("T"), F.lit(" b "), F.lit("wikipedia"), F.lit("u"), "#t", F.lit("^c"))
    assert one(spark, card) == "### T\n\nb\n\n来源：[Wikipedia](u)\n\n#t\n^c"
    notes = spark.createDataFrame([("n", "# L\n\n## A\nmeta\n\n### x\n\nold\n^k-1\n\n## B\n\n### z\n^k-1\n"), ("e", None)], "note string, text string")
    got = rows(vault.entries(notes, "note", "text"), "place")
    assert [r[2:4] for r in got] == [("", None), ("A", None), ("A", "^k-1"), ("B", None), ("B", "^k-1")]
    new = spark.createDataFrame([("n", "A", "^k-1", "### x\nnew\n^k-1", "x"), ("n", "A", "^k-2", "### y\n^k-2", "Y"), ("n", "C", "^k-3", "### c\n^k-3", "c"), ("m", "A", "^k-1", "### a\n^k-1", "a")], "note string, section string, anchor string, body string, title string")
    done = dict(rows(vault.upserted(vault.entries(notes, "note", "text"), new, "note")))
    assert done["n"] == "# L\n\n## A\nmeta\n\n### x\nnew\n^k-1\n\n### y\n^k-2\n\n## B\n\n### z\n^k-1\n\n## C\n\n### c\n^k-3\n"
    assert done["m"] == "## A\n\n### a\n^k-1\n" and set(done) == {"n", "m"}


def test_sources(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<feed><entry><id>http://x.org/abs/2101.01234v1</id><title> A\n title </title><summary>s</summary><published>2021-01-05T00:00:00Z</published><author><name>Ann</name></author><author><name>Bo</name></author><category term='cs.X'/></entry></feed>")
    (entry,) = feeds.feed_entries(spark, str(tmp_path / "feed.xml")).collect()
    assert (entry.preprint, entry.title, entry.authors, entry.categories) == ("2101.01234", "A title", ["Ann", "Bo"], ["cs.X"])
    pages = spark.createDataFrame([(1, "<h2>Physics</h2><h4>ph.X (Some Name)</h4><p>About <b>it</b></p><h4>ph.Y (Other)</h4>")], "id int, html string")
    assert rows(feeds.taxonomy(pages, "id", "html").select("area", "category", "name", "description"), "category") == [("Physics", "ph.X", "Some Name", "About it"), ("Physics", "ph.Y", "Other", None)]
    bib = spark.createDataFrame([(1, '<li class="ltx_bibitem" id="b1"><span class="ltx_bibblock">Ann.</span><span class="ltx_bibblock">A work</span> 2020</li>')], "id int, html string")
    assert rows(feeds.bibliography(bib, "id", "html").select("label", "title", "year")) == [("b1", "A work", "2020")]
    page = spark.createDataFrame([(1, '<nav><p>no</p></nav><h1 id="t">Title</h1><p>One <b>two</b><p>three<table><tr><td>c</td></tr></table>'), (2, None)], "id int, html string")
    assert [(r.block_type, r.level, r.label, r.text) for r in html.html_blocks(page, "id", "html").collect()][:3] == [("section", 1, "t", "Title"), ("paragraph", None, None, "One two"), ("paragraph", None, None, "three")]
    assert html.table_markdown("<table><tr><th>a</th><th>b|</th></tr><tr><td>1</td></tr></table>") == "| a | b\\| |\n| --- | --- |\n| 1 |  |"


def test_archives(spark):
    tar, zipped = io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("a/main.tex")
        info.size = 3
        t.addfile(info, io.BytesIO(b"tex"))
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("../out", "x")
    files = spark.createDataFrame([("t", tar.getvalue()), ("z", zipped.getvalue()), ("g", gzip.compress(b"one")), ("n", b"none")], "path string, content binary")
    got = {r.path: (r.member, bytes(r.content) if r.content is not None else None, r.problem) for r in html.unpacked(files).collect()}
    assert got["t"] == ("a/main.tex", b"tex", None) and got["g"][1] == b"one"
    assert got["z"][2] == "refused: ../out" and got["n"][2] == "not an archive"


def test_sinks(spark, tmp_path):
    blocks = spark.createDataFrame([("d", 1, "section", "T", 3), ("d", 2, "equation", "x", None), ("d", 3, "paragraph", "p", None)], "doc string, o int, kind string, t string, level int")
    body = sinks.rendered(blocks, "doc", "o", "kind", "t", "level")
    assert body.first()["body"] == "### T\n\n$$\nx\n$$\n\np"
    sinks.write_documents(body, str(tmp_path / "out"), "doc")
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"].strip() == "### T\n\n$$\nx\n$$\n\np"
    once = sinks.with_notice(F.lit("x"))
    assert one(spark, sinks.with_notice(once)) == one(spark, once)


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "claim"), ("b", 1, "pause")], "job string, at long, event string").write.parquet(source)
    stream = spark.readStream.schema("job string, at long, event string").parquet(source)
    q = progress.job_states(stream, "job", "at", "event").writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    spark.createDataFrame([("a", 2, "complete")], "job string, at long, event string").write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("states"), "job", "state") == [("a", "running", 1), ("a", "succeeded", 1), ("b", "paused", 0)]
    sent = []
    q = progress.on_change(stream.groupBy("event").count(), sent.append, str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert sent[-1] == [("claim", 1), ("complete", 1), ("pause", 1)]


@pytest.mark.parametrize("op", [lambda d: context.markdown_blocks(d, "id", "text"), lambda d: search.term_counts(d, "id", "text"), lambda d: mining.glossary_candidates(d, "text"), lambda d: html.html_blocks(d, "id", "text")])
def test_empty_tables(spark, op):
    assert op(spark.createDataFrame([], "id int, text string")).count() == 0


def test_latex(spark):
    from papyra.functions import latex

    files = spark.createDataFrame([("x/ms.tex", r"\documentclass{a}\begin{document}"), ("supp.tex", r"\documentclass{a}"), ("b.tex", "")], "path string, content string")
    best = files.orderBy(F.desc(latex.main_file_score(F.col("path"), F.col("content")))).first()
    assert best["path"] == "x/ms.tex"
    assert latex.main_files(files.withColumn("a", F.lit(1)), "a", "path", "content").collect() == [(1, "x/ms.tex", 30)]
    scores = {r.path: r.s for r in files.withColumn("s", latex.main_file_score(F.col("path"), F.col("content"))).collect()}
    assert scores == {"x/ms.tex": 30, "supp.tex": -6, "b.tex": -18}
    none, no = F.lit(None).cast("double"), F.lit(False)
    layouts = [latex.page_layout(F.lit(2), no, none, none, none), latex.page_layout(F.lit(1), no, F.lit(330.0), none, none), latex.page_layout(F.lit(1), no, F.lit(329.0), none, none)]
    layouts += [latex.page_layout(F.lit(1), no, none, F.lit(145.0), F.lit(100.0)), latex.page_layout(F.lit(1), no, none, F.lit(1.0), F.lit(0.0)), latex.page_layout(F.lit(0), F.lit(True), none, none, none)]
    assert [one(spark, x) for x in layouts] == ["multi-panel", "double-column", "single-column", "double-column", None, "multi-panel"]
    assert one(spark, values.transient(F.lit("Rate limit"))) is True and one(spark, values.transient(F.lit("HTTP 404"))) is False
    assert one(spark, latex.capabilities(F.lit("text-embedding-3"))) == ["embedding"]


def test_page_documents(spark):
    from papyra.plans.pipelines import page_documents

    page = spark.createDataFrame([(1, "<h1>T</h1><p>a</p>")], "id int, html string")
    assert rows(page_documents(page, "id", "html")) == [(1, "# T\n\na")]


PAPER = """<div class="ltx_toc"><ul><li>x</li></ul></div><h2 id="S1">Intro</h2><p>A <b>bold</b> <a href="#bib.b1">[Ann 2020]</a> , <math alttext="x"></math><p>[email=a, orcid=b]</p>
<ol class="ltx_enumerate"><li><span class="ltx_tag_item">1.</span> one<ul><li>in</li></ul> tail</li><li>two</li></ol>
<figure id="F1" class="ltx_figure"><img src="a.png"><figcaption>Figure 1: A cat</figcaption></figure>
<table class="ltx_eqn_table"><tr><td><math alttext="a"></math><math alttext="b"></math></td><td class="ltx_eqn_eqno">(1)</td></tr><tr><td><math alttext="c"></math></td></tr></table>
<figure><figcaption>Table 2: T</figcaption></figure><figure id="S1"><svg class="tikz"></svg></figure><figure class="ltx_algorithm"><p>code</p></figure>"""


def test_tree(spark):
    from papyra.sources import tree

    pages = spark.createDataFrame([(1, PAPER, "x"), (2, None, "y"), (3, "", "z"), (None, "<p>n", "w"), (4, "<b>" * 5000 + "<p>deep " + "</i>" * 9, "v")], "id int, html string, text string")
    found = {(r.id, r.block_uid): r for r in tree.document_blocks(pages, "id", "html", ("email", "ORCID")).collect()}
    assert {k: (r.level, r.label, r.text) for k, r in found.items() if k[0] == 1} == {
        (1, "sec-001"): (2, "S1", "Intro"),
        (1, "p-0001"): (None, None, "A **bold** [Ann 2020](#bib.b1), $x$"),
        (1, "lst-0001"): (None, None, "1. one tail\n  - in\n2. two"),
        (1, "fig-0001"): (None, "F1", "**Figure 1.** A cat"),
        (1, "eq-0001"): (None, None, "\\begin{aligned}\na b \\\\\nc\n\\end{aligned}"),
        (1, "tbl-0001"): (None, None, "**Table 1.** T"),
        (1, "fig-0002"): (None, "S1", "**Figure 2.** Figure 2"),
        (1, "alg-0001"): (None, None, "**Algorithm 1.** code"),
    }
    assert found[1, "fig-0001"].files == ["a.png"] and found[1, "fig-0002"].drawn == "tikz" and found[1, "eq-0001"].numbers == ["(1)"]
    assert (found[1, "lst-0001"].items, found[1, "lst-0001"].list_kind) == (2, "ordered") and found[1, "p-0001"].refs[0].text == "[Ann 2020]"
    assert {k for k in found if k[0] != 1} == {(None, "p-0001"), (4, "p-0001")} and tree.document_blocks(pages.limit(0), "id", "html").count() == 0
    asked = spark.createDataFrame([(1, "#S1"), (1, "fig-0001"), (1, "#no"), (9, "S1"), (1, None)], "id int, target string")
    at = {(r.id, r.target): r.block_uid for r in tree.located(asked, tree.document_blocks(pages, "id", "html"), "id", "target").collect()}
    assert at == {(1, "#S1"): "sec-001", (1, "fig-0001"): "fig-0001", (1, "#no"): None, (9, "S1"): None, (1, None): None}


def test_lines_and_sentences_keep_digits_of_their_place(spark):
    """What is trimmed from lines are blanks, not the digits of their number."""
    from papyra import bindings

    docs = spark.createDataFrame([(1, "0a0\n 1b1 \n\n 2c2")], "doc_id long, text string")
    got = bindings_over(bindings.queries()["line_blocks"], docs)
    assert sorted((r.place, r.digest) for r in got) == [(k, hashlib.md5(x.encode()).hexdigest()) for k, x in ((1, "0a0"), (2, "1b1"), (3, "2c2"))]
    assert one(spark, tx.sentences(F.lit("0 a. 1 b. 2"))) == ["0 a.", "1 b.", "2"]


def bindings_over(query, docs):
    """Rows of a registered query over one table."""
    folder = tempfile.mkdtemp()
    docs.write.parquet(f"{folder}/documents.parquet")
    return query(docs.sparkSession, folder).collect()


def test_terms_apart(spark):
    """As in the SQL of glossary_apply, each occurrence takes the characters beside it; whole terms otherwise."""
    text = F.lit("on moron moron Moron, moron-x\nmoron\n")
    assert one(spark, tx.replace_term(text, "moron", "$M", apart=True)) == "on $M moron $M, moron-x\n$M\n"
    assert one(spark, tx.replace_term(text, "moron", "$M")) == "on $M $M $M, moron-x\n$M\n"
