"""Figures of converted papers: nested panels, layout, files and images that a sibling XML names."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest

from papyra.sources import figures, tree

NESTED = """<html><body><p>text</p>
<figure class="ltx_figure ltx_flex_figure" id="F1" style="width: 300pt">
 <div style="width:120.5pt"><div><img src=" a.png " width="640px" height="400"></div>
  <div style="color:red;WIDTH : 60.25 pt"><object data="b.svg"></object></div></div>
 <img xlink:href="c.png" style="width:0pt"><img id="g1"><img id="g2" style="width:10pt"><img id="g3">
 <figcaption>Figure 1: panels</figcaption></figure>
<table class="ltx_table" id="T1"><tr><td style="width:50pt">x</td><td style="width:1.2.3pt">y</td></tr></table>
<figure><figcaption>Algorithm 1: steps</figcaption><img src="d.png" width="300" height="200"></figure>
<figure id="F2"><img src="e.png" width="290" height="200"></figure></body></html>"""
XML = """<?xml version="1.0"?><document xmlns="http://x" xmlns:xml="http://www.w3.org/XML/1998/namespace">
<graphics xml:id="g1" graphic="./one.pdf other" options="scale=2, width=77.5pt"/><graphics xml:id="g2" candidates="two.pdf" options="width=5pt"/>
<graphics xml:id="g3" graphic="old.pdf"/><graphics xml:id="g3" graphic=" " candidates="new.pdf"/><graphics graphic="none.pdf"/><graphics xml:id="g9"/></document>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, NESTED, XML), (2, None, None), (3, "", "<broken"), (1, "<p>again</p>", "<a/>")]
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, html string, xml string, block_uid string, images string").repartition(2)


def test_images_inherit_panels(pages):
    got = {(r.block_uid, r.place): r for r in figures.image_rows(figures.document_figures(pages, "page_id", "html"), "page_id").collect()}
    panels = [got["fig-0001", k].panel_pt for k in range(1, 7)]
    assert panels == [120.5, 60.25, 300.0, 300.0, 10.0, 300.0]
    assert [got["fig-0001", k].origin for k in range(1, 7)] == ["inherited"] * 4 + ["own", "inherited"]
    assert [got["fig-0001", k].reference for k in range(1, 7)] == ["a.png", "b.svg", "c.png", None, None, None]
    assert (got["fig-0001", 1].width, got["fig-0001", 1].height) == (640.0, 400.0)
    assert (got["alg-0001", 1].panel_pt, got["alg-0001", 1].origin) == (None, None)
    assert len(got) == 8


def test_layout(pages):
    got = {r.block_uid: r for r in figures.with_layout(figures.document_figures(pages, "page_id", "html")).collect()}
    one = got["fig-0001"]
    assert (one.image_count, one.image_width, one.max_panel_pt, one.total_panel_pt, one.display_pt, one.layout) == (6, 640.0, 300.0, 1090.75, 1090.75, "multi-panel")
    table = got["tbl-0001"]
    assert (table.image_count, table.max_panel_pt, table.display_pt, table.layout, table.label) == (0, 50.0, 50.0, "single-column", "T1")
    assert (got["alg-0001"].layout, got["alg-0001"].display_pt) == ("double-column", 300.0)
    assert (got["fig-0002"].layout, got["fig-0002"].display_pt) == ("double-column", 290.0)


def test_files(pages):
    rows = [r for r in figures.file_rows(figures.document_figures(pages, "page_id", "html"), "page_id").collect() if r.block_uid == "fig-0001"]
    got = [(r.place, r.file, r.width, r.panel_pt, r.group_pt, r.siblings, r.matched) for r in sorted(rows, key=lambda r: r.place)]
    assert got == [(1, "a.png", 640.0, 120.5, 1090.75, 3, True), (2, "b.svg", None, 60.25, 1090.75, 3, True), (3, "c.png", None, 300.0, 1090.75, 3, True)]


def test_hydrated(pages):
    images = figures.image_rows(figures.document_figures(pages, "page_id", "html"), "page_id")
    named = figures.graphics(pages, "page_id", "xml")
    assert {(r.element, r.reference, r.width_pt) for r in named.collect()} == {("g1", "one.pdf", 77.5), ("g2", "two.pdf", 5.0), ("g3", "new.pdf", None)}
    got = {r.element: (r.reference, r.panel_pt, r.origin, r.source) for r in figures.hydrated(images, named, "page_id").collect() if r.element}
    assert got == {"g1": ("one.pdf", 77.5, "own", "xml"), "g2": ("two.pdf", 10.0, "own", "xml"), "g3": ("new.pdf", 300.0, "inherited", "xml")}
    assert figures.document_figures(pages.where("false"), "page_id", "html").count() == 0


def test_well_formed_pages_are_xml():
    """Both parsers give the same blocks where a page is well-formed; elements that HTML forbids within paragraphs stay where XML has them."""
    page = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:xlink="http://www.w3.org/1999/xlink"><body><p>a <b>bold</b> &amp; c</p><figure><img xlink:href="f.png"/></figure><ul><li>x<ul><li>y</li></ul></li></ul></body></html>'
    assert tree.xml_tree(page) is not None and tree.xml_tree(page + "<br>") is None and tree.xml_tree("a &nbsp; b") is None
    assert list(tree.blocks_of(page)) == list(tree.blocks_of(page.replace("</body>", "<br></body>")))
    assert [b[2] for b in tree.blocks_of("<d><p>one<table><tr><td>z</td></tr></table></p></d>")] == ["paragraph"]


@pytest.mark.parametrize("close", [True, False])
def test_depth_has_no_bound(close):
    n = 20_000
    deep = "<div>" * n + "<p>" + "<span>" * n + "deep <b>text</b>" + ("</span>" * n + "</p>" + "</div>" * n if close else "")
    (block,) = tree.blocks_of(deep)
    assert block[2] == "paragraph" and block[5] == "deep **text**"
    lists = "<ul><li>x" * 300 + "</li></ul>" * 300
    (block,) = tree.blocks_of(lists)
    assert block[5].count("\n") == 299 and block[5].endswith("  " * 299 + "- x")


def test_inline_of_leaves():
    math = ET.fromstring('<math alttext="x$y"/>')
    assert tree.inline(math) == "$x\\$y$" and tree.inline(ET.fromstring("<br/>")) == ""
    mixed = '<p>see <a href="#S1">[<i>1</i>]</a> , <code>c</code><script>x</script></p>'
    assert tree.inline(ET.fromstring(mixed)) == "see [*1*](#S1), `c`"


def test_names_of_characters_without_semicolon():
    """Browsers read some without one; closed leaves them as they are written."""
    page = "<h1>a &amp;&amp</h1><p>&lt;b &#38; &#38 &copy &copy;<a href='/x?a=1&amp;b=2'>c</a>"
    assert [b[5] for b in tree.blocks_of(page)] == ["a &&", "<b & & © ©[c](/x?a=1&b=2)"]
    assert [b[5] for b in tree.blocks_of(page, closed=True)] == ["a &&amp", "<b & &#38 &copy ©[c](/x?a=1&b=2)"]


@pytest.mark.parametrize("page", [
    '<html><body><br><figure id="F1" class="ltx_figure" style="width: 9pt"><img src="a.png" width="5px"><img src="b.png"/><figcaption>Figure 1: x <b>y</b></figcaption></figure><hr></body></html>',
    '<div>a<br>b<img alt="c > d"><ul><li>x<br><li>y</ul></div>', "<div>a &amp; b<br></div>", "<DIV>a<BR></DIV>", '<div><br><img a:b="1" C="2"></div>', "<div><br></br>x</div>", "<div><p>a<br><div>b</div></p></div>",
    '<div title="a\tb"><br>\tc\n</div>', "<div><br><script>a<b></script></div>", "a<br>b", "<div><br>]]></div>", "<div><br><!-- x --><i>y</i></div>", "<div><br><br/><b/>x</div>", '<div><br><a href="x>y" xlink:href="z">w</a></div>',
])
def test_open_empty_elements_are_read_as_html(page):
    """The XML parser stands in for the HTML parser only where both give one tree."""
    flat = lambda root: [(e.tag, dict(e.attrib), e.text or "", e.tail or "") for e in root.iter() if e.tag != "document"]
    assert flat(tree.page_tree(page)) == flat(tree.tree_of(page))


def test_open_empty_elements_need_no_html_parser(monkeypatch):
    monkeypatch.setattr(tree, "tree_of", None)
    assert tree.page_tree('<div><br>a<img src="b"><hr/></div>').find("img").get("src") == "b"
