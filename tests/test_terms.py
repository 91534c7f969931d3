"""Reader cards, glossaries and references against plain loops."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.operators import cards, linking

TEXTS = [
    "Using the Graph Neural Network (GNN) and GNNs. Graph Neural Network works; GNN (Graph Neural Networks) too.",
    "ImageNet-21K and ResNet are used by BERT, the THE and TABLE. In `Hidden Name (HN)` and $Formula Name (FN)$",
    "Using the Adam Optimizer Smith2020 Jones2019a (AO), Attention Is All You Need; Attention Is All You Need.",
    "Of The Rings (OTR) and The This That (TTT). Convolutional Layers (CL)", "", None, "This paper. The Model GPT-4 Model GPT4 runs",
    "[Linked Name (LN)](x) ![Img Name (IN)](y) **Bold Term** Bold Term # Heading Term", "Mean Classes (MC) Mean Class. A B C", "État Moderne (EM) Étude Neuve",
]


def loop_clean(value):
    edges = " \t\r\n.,;:()[]{}"
    out = re.sub(r"(?:\s+[A-Z][A-Za-z]+[12][0-9]{3}[a-z]?)+$", "", re.sub(r"\s+", " ", value.strip(edges))).strip(edges)
    while True:
        words = out.split(" ", 1)
        if len(words) < 2 or words[0].lower() not in cards.LEADING:
            break
        out = words[1].strip(edges)
    words = re.split(r"\b", out.rstrip())
    tail = words[-2] if len(words) > 1 else ""
    return (out.rstrip()[: -len(tail)] if tail.lower() in cards.TRAILING and out.rstrip().endswith(tail) else out).strip(edges)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["the", "of", "Graph", "Net", "Smith2020", "using", "(", ")", "a", "An", "x.", ";", "OR"]), max_size=7))
def test_cleaning_reaches_a_fixpoint_of_leads(words):
    value = " ".join(words)
    got = cards.clean_term(value)
    assert got == loop_clean(value)
    first = got.split(" ", 1)[0].lower()
    assert not (" " in got and first in cards.LEADING)


def loop_cards(blocks):
    """One block after the other into a dictionary, filters afterwards."""
    found = {}
    for uid, kind, text in blocks:
        if kind not in cards.KINDS:
            continue
        for key, words, what, anchor, title, short, full in cards.candidates_of(text):
            if title in cards.NO_TERMS:
                continue
            if key not in found:
                found[key] = {"kind": what, "anchor": anchor, "title": title, "abbreviation": short, "full_form": full, "uids": set(), "uses": 0, "norm": words}
            found[key]["uids"].add(uid)
            found[key]["uses"] += 1
    spelled = {c["norm"] for c in found.values() if c["abbreviation"]}
    kept = [(k, c) for k, c in found.items() if (c["abbreviation"] or c["norm"] not in spelled) and cards.is_valuable(c["full_form"] or c["title"])]
    kept.sort(key=lambda x: (not x[1]["abbreviation"], -x[1]["uses"], x[1]["title"].casefold()))
    return [(k, c["kind"], c["anchor"], c["title"], c["abbreviation"], c["uses"], sorted(c["uids"])) for k, c in kept]


def test_reader_cards(spark):
    draw = random.Random(4)
    kinds = ["paragraph", "abstract", "figure", "table", "code"]
    rows = [(draw.choice("ab"), f"u{k}", k, draw.choice(kinds), draw.choice(TEXTS), "clash") for k in range(150)]
    blocks = spark.createDataFrame(rows, "owner string, uid string, place long, kind string, text string, norm string").repartition(5)
    got = defaultdict(list)
    for r in cards.reader_cards(blocks, "owner", "uid", "place", "kind", "text").orderBy("owner", "rank").collect():
        got[r.owner].append((r.key, r.kind, r.anchor, r.title, r.abbreviation, r.uses, r.uids))
    for owner in "ab":
        assert got[owner] == loop_cards([(u, k, t) for o, u, _, k, t, _ in rows if o == owner])
    titles = {c[3] for c in got["a"]} | {c[3] for c in got["b"]}
    assert {"Graph Neural Network", "Adam Optimizer", "ResNet"} <= titles and not titles & {"THE", "TABLE", "Hidden Name", "Formula Name", "Linked Name"}
    few = cards.reader_cards(blocks, "owner", "uid", "place", "kind", "text", limit=2)
    assert few.count() == 4 and cards.reader_cards(blocks.where("false"), "owner", "uid", "place", "kind", "text").count() == 0


def test_candidates_in_order():
    text = "Using the Graph Net (GN), RN (Residual Nets) on ImageNet-21K with `Hidden Name (HN)` of ResNet BERT."
    got = [(kind, title, short) for _, _, kind, _, title, short, _ in cards.candidates_of(text)]
    assert got[:2] == [("abbreviation_pair", "Graph Net", "GN"), ("abbreviation_pair", "Residual Nets", "RN")]
    assert ("technical_name", "Graph Net", None) in got and ("acronym_or_dataset", "BERT", None) in got and ("method_name", "ResNet", None) in got
    kinds = [k for k, _, _ in got]
    assert kinds == sorted(kinds, key=["abbreviation_pair", "technical_name", "acronym_or_dataset", "method_name"].index)
    assert not any("Hidden" in t for _, t, _ in got) and list(cards.candidates_of(None)) == []


def test_values():
    assert [cards.is_valuable(x) for x in ("GNN", "the", "GPT-4", "Net", "ResNet", "Graph of Nets", "Graph Nets", "Smith2020 Net", "A B C D E F G H", "This paper", "x")] == [True, False, True, False, True, False, True, False, False, False, False]
    assert [cards.singular(x) for x in ("studies", "classes", "boxes", "class", "nets", "gas", "branches")] == ["study", "class", "box", "class", "net", "gas", "branch"]
    assert cards.norm("Graph-Neural Networks (v2)/Nets") == "graph neural network v2 net" and cards.clean_abbreviation(" g.n-n ") == "GN-N"


def test_visible_cards(spark):
    rows = [(1, "auto_extract", "candidate", "term", "the Net", "x"), (2, "auto_extract", "candidate", "term", "GNN", ""), (3, "auto_extract", "pinned", "term", "the", "x"), (4, None, "candidate", "term", "the", "x"), (5, "auto_extract", "candidate", "note", "the", "x"), (6, "auto_extract", "candidate", "term", None, "ResNet"), (7, "auto_extract", "candidate", "term", "", None)]
    table = spark.createDataFrame(rows, "id int, source string, status string, card_type string, full_form string, title string")
    assert {r.id for r in cards.visible_cards(table).collect()} == {2, 3, 4, 5, 6}


def test_summaries(spark):
    rows = [(1, "One.  Two!\nThree?"), (2, "- a point\n\n\n\n# Head\n1. x"), (3, "x" * 600 + ". y"), (4, None), (5, "一。 二。 三。")]
    table = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.s, r.b) for r in table.select("id", cards.summary(table.text).alias("s"), cards.card_body(table.text).alias("b")).collect()}
    assert got[1][0] == "One. Two!" and got[2][1] == "a point\n\nHead\nx" and got[3][0] == "x" * 517 + "..." and got[4] == (None, None) and got[5][0] == "一。 二。"


def loop_glossary(text, terms):
    """Every term in turn over whole texts."""
    parts = re.split(r"(`[^`]*`|\$\$.*?\$\$|\$[^$]*\$)", text, flags=re.S)
    for k in range(0, len(parts), 2):
        for source, target in sorted(sorted(terms), key=lambda x: -len(x[0])):
            parts[k] = re.sub(rf"(?<![\w-]){re.escape(source)}(?![\w-])", lambda _, t=target: t, parts[k], flags=re.I)
    return "".join(parts)


WORDS = ["net", "graph net", "Net", "ſtrasse", "STRASSE", "graph", "deep", "deep graph net", "a-b", "b", "x_y", "K", "`code`", "$net$", "µ", "μ", "(net)", "network", "-net", "ß", "é net"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["net", "graph net", "deep", "b", "graph", "strasse", "k", "µ", "a-b", "(net)", "ß"]), st.sampled_from(["graph", "net", "deep graph", "b a-b", "", "\\1 $x"])), max_size=6, unique_by=lambda x: x[0]), st.lists(st.sampled_from(WORDS), max_size=8))
def test_matcher_is_the_loop(terms, words):
    text = " ".join(words)
    m = linking.Matcher(sorted(terms))
    assert m.replaced_outside(text) == loop_glossary(text, terms)
    plain = {s for s, _ in terms if re.search(rf"(?<![\w-]){re.escape(s)}(?![\w-])", text, re.I)}
    assert {m.pairs[k][0] for k in m.mentioned(text)} == plain


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_glossary_by_either_route(spark, most):
    draw = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    pairs = {" ".join(draw.choices(words, k=draw.randint(1, 3))): " ".join(draw.choices([*words, "neu", "`x"], k=2)) for _ in range(80)}
    texts = [" ".join(draw.choice([*words, "`w1 w2`", "$w3$", "W4,", "w5-w6", "über"]) for _ in range(40)) for _ in range(40)] + [None, "", "nothing here"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id long, text string, source string").repartition(3)
    terms = spark.createDataFrame([*pairs.items(), (None, "x"), ("", "y"), ("gone", None)], "source string, target string").repartition(2)
    got = linking.glossary_applied(docs, terms, "id", "text", most=most)
    assert got.columns == docs.columns
    assert {r.id: r.text for r in got.collect()} == {k: None if t is None else loop_glossary(t, list(pairs.items())) for k, t in enumerate(texts)}
    found = {(r.id, r.source) for r in linking.mentions(docs, terms, "id", "text", most=most).collect()}
    assert found == {(k, s) for k, t in enumerate(texts) for s in [*pairs, "gone"] if t and re.search(rf"(?<![\w-]){re.escape(s)}(?![\w-])", t, re.I)}


def test_a_hundred_thousand_terms(spark):
    draw = random.Random(7)
    pairs = {f"term{k} of{k % 97}": f"T{k}" for k in range(100_000)}
    hits = [draw.sample(range(100_000), 5) for _ in range(30)]
    docs = spark.createDataFrame([(k, "; ".join(f"the Term{x} of{x % 97} `term{x} of{x % 97}`" for x in xs)) for k, xs in enumerate(hits)], "id long, text string")
    terms = spark.createDataFrame(list(pairs.items()), "source string, target string")
    want = {k: "; ".join(f"the T{x} `term{x} of{x % 97}`" for x in xs) for k, xs in enumerate(hits)}
    for most in (1 << 30, 0):
        assert {r.id: r.text for r in linking.glossary_applied(docs, terms, "id", "text", most=most).collect()} == want


def test_terms_without_words(spark):
    docs = spark.createDataFrame([(1, "a ++ b")], "id long, text string")
    terms = spark.createDataFrame([("++", "plus")], "source string, target string")
    assert linking.glossary_applied(docs, terms, "id", "text").first().text == "a plus b"
    with pytest.raises(ValueError, match="without a word"):
        linking.glossary_applied(docs, terms, "id", "text", most=0)


def test_linked_text():
    refs = [("#F1", "1", "figure"), ("#T2", "2", "table"), ("#b3", " 3 ", "citation"), ("#b4", "4", "citation"), ("#E1", "1.2", "equation"), ("#S1", "1", "subsection"), ("#x", "9", "paragraph")]
    text = "Figure 1 and Figure 1; Fig. 1, Table 2 [3, 4], [4–5], [5]; equation 1.2, Section 1. Paragraph 9"
    assert linking.linked_text(text, refs) == "[Figure 1](#F1) and Figure 1; Fig. 1, [Table 2](#T2) [\\[3\\]](#b3), [\\[4\\]](#b4), 4–5, 5; [equation 1.2](#E1), [Section 1](#S1). Paragraph 9"
    assert linking.linked_text("[1] Table 2", refs[:1]) == "[1] Table 2" and linking.linked_text("Fig. 1", refs) == "[Fig. 1](#F1)"
