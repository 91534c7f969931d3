"""Collocations, languages and divergence of sources against plain loops."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyra.llm import collocations, divergence, language, queries
from papyra.llm.terms import in_parts

DATA = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, phrase string, block int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], SCHEMA).repartition(parts)


def texts(n, seed=1):
    draw = random.Random(seed)
    words = ["the", "new", "york", "City", "of", "été", "漢字", "a", "b", "x\x00y"]
    out = []
    for k in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\t", ", ", ".", "\n"]) for _ in range(draw.randrange(60)))
        out.append((k, text, draw.choice(["en", "en", "fr", None]), draw.choice(["s1", "s1", "s1", "s2", "s3", None])))
    return out + [(None, "the new york city", "en", "s1"), (1, out[1][1], out[1][2], out[1][3]), (2, None, None, None), (3, "", "fr", "s9"), (4, "1234 --", "xx", "s1"), (5, None, "xx", "s2")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_collocations(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q))) for q, b in found.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for k, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "shard"), [(10, 2000, 1 << 20), (2, 5, 40), (1, 100, 7)])
def test_collocations(spark, monkeypatch, least, top, shard):
    rows = texts(120)
    monkeypatch.setattr(collocations, "SHARD", shard)
    got = collocations.collocations(table(spark, rows, 5), least=least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, top)


def test_collocations_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 1000)
    rows = [(1, "one two three. " * 700 + "word " * 300000, "en", "s"), (2, "ONE TWO three " * 20, "en", "s"), (3, "x" * 1_500_000 + " y", "en", "s")]
    got = collocations.collocations(table(spark, rows, 1))
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 10, 2000)


def test_collocations_empty(spark):
    got = collocations.collocations(table(spark, [(1, "a", "en", "s")]).where("false"))
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert collocations.collocations(table(spark, [(1, None, None, None), (2, " ,. ", "en", "s")])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=5))
def test_automaton(pieces):
    letters = np.array([x for p in pieces for x in p])
    begins = np.array([k == 0 for p in pieces for k in range(len(p))])
    found = collocations.automaton(letters, begins, 4)
    ends = defaultdict(set)
    for n, piece in enumerate(pieces):
        for size in (1, 2, 3):
            for k in range(len(piece) - size + 1):
                ends[tuple(piece[k : k + size])].add((n, k + size))

    def name(node):
        out = []
        while node >= 0:
            out.append(int(found.letter[node]))
            node = found.parent[node]
        return tuple(out[::-1])

    names = [name(k) for k in range(len(found.depth))]
    assert {x: c for x, c in zip(names, found.count.tolist(), strict=True) if c} == {x: len(e) for x, e in ends.items()}
    assert all(names[k][1:] == (names[x] if x >= 0 else ()) for k, x in enumerate(found.link.tolist()))
    for k, x in enumerate(found.state().tolist()):
        longest = max((y for y in ends if ends[y] == ends.get(names[k])), key=len, default=names[k])
        assert names[x] == longest or not found.count[k]


def plain_divergence(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(w for w, n in docs[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)
        totals = {s: sum(count[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (count[lang, s][w] + 1) // (totals[s] + len(kept)) for w in kept} for s in sources}
        whole = {w: 1 + 10**9 * (sum(count[lang, s][w] for s in sources) + 1) // (sum(totals.values()) + len(kept)) for w in kept}
        for s in sources:
            pairs = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][w] - whole[w]) ** 2 // whole[w]), w.encode()) for w in kept if count[lang, s][w] and p[s][w] > whole[w]]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, x in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])) for k, (v, item) in enumerate(x)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "tile", "at_once"), [(3, 200, 1 << 17, 1 << 20), (1, 2, 8, 3), (10**6, 5, 1 << 17, 1)])
def test_divergence(spark, monkeypatch, least, top, tile, at_once):
    rows = texts(150, 2)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "AT_ONCE", at_once)
    got = divergence.audit(table(spark, rows, 4), least=least, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows, least, top)


def test_divergence_of_long_texts_and_none(spark, monkeypatch):
    rows = [(k, "same " * 300000 + "x" * k, "en", f"s{k % 2}") for k in range(3)] + [(9, "y" * 1_200_000, "en", "s0")]
    assert sorted(tuple(r) for r in divergence.audit(table(spark, rows, 2)).collect()) == plain_divergence(rows, 3, 200)
    got = divergence.audit(table(spark, rows).where("false"))
    assert got.count() == 0 and got.columns == ["lang", "source", "part", "item", "value", "rank"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**13), st.integers(1, 10**15)), min_size=1))
def test_parts_are_exact(pairs):
    count = np.array([min(c, t - 1) for c, t in pairs])
    total = np.array([t for _, t in pairs])
    p = divergence.parts_of(count, total)
    assert p.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist(), strict=True)]
    assert divergence.divergence(p, p[::-1]).tolist() == [(a - b) ** 2 // b for a, b in zip(p.tolist(), p[::-1].tolist(), strict=True)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab é.,"), st.integers(1, 20))
def test_in_parts(text, most):
    parts = list(in_parts(text, most, b".,"))
    assert "".join(parts) == text
    assert all(x.endswith((".", ",")) for x in parts[:-1])
    assert all(len(x.encode()) <= most or not re.search("[.,].", x, re.S) for x in parts)


def plain_language(rows, dimensions):
    """The same model in plain loops: counts of n-grams, weights, profiles and cosines."""
    def grams(text):
        out = Counter()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            at = [0, *map(ord, word), 0]
            for k in range(len(word)):
                out[tuple(at[k : k + 3])] += 1
        return out

    def vector(gram):
        one, two, three = (language.letter_vectors(np.array([x]), dimensions)[0].astype(int) for x in gram)
        return np.roll(one, 2) * np.roll(two, 1) * three

    counts = defaultdict(Counter)
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
    profiles = {lang: sum(round(n**0.5 * 16) * vector(g) for g, n in c.items()) for lang, c in counts.items() if c}
    out = []
    for k, text, *_ in rows:
        if not (found := grams(text or "")) or not profiles:
            out.append((k, "und", 0.0))
            continue
        v = sum(n * vector(g) for g, n in found.items())
        near = {x: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for x, p in profiles.items()}
        best = max(sorted(near), key=near.get)
        out.append((k, best, max(0.0, near[best])))
    return out


WRITTEN = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, "the dog and the fox", "en", "a"), (3, "le renard brun saute par-dessus le chien", "fr", "a"),
    (4, "la forêt et la mer\nÉTÉ", "fr", None), (5, "der schnelle braune Fuchs", "de", "a"), (6, "漢字かな交じり文", "ja", "a"), (7, None, "fr", "a"), (8, "", "de", "a"),
    (9, "12 34 !?", "en", "a"), (10, "fox", None, "a"), (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (None, "chien", "fr", "a"), (11, "a", "en", "b"),
]


@pytest.mark.parametrize("most", [1024, 2, 1])
def test_language(spark, monkeypatch, most):
    monkeypatch.setattr(language, "GRAMS", 5)
    monkeypatch.setattr(language, "DOCUMENTS", 3)
    docs = table(spark, WRITTEN, 4)
    profiles = language.fit(docs)
    got = language.predict(docs, profiles, most=most).collect()
    want = plain_language(WRITTEN, language.DIMENSIONS)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_language_without_profiles_and_rows(spark):
    docs = table(spark, WRITTEN)
    none = language.fit(docs.where("false"))
    assert {tuple(r) for r in language.predict(docs, none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language.predict(docs.where("false"), language.fit(docs)).count() == 0


def test_language_of_long_texts(spark):
    rows = [*WRITTEN, (20, "the lazy dog jumps " * 100_000, None, "a"), (21, "le chien et le renard " * 70_000, None, "a"), (22, "é" * 1_500_000, None, "a")]
    got = {r.doc_id: r.lang_pred for r in language.predict(table(spark, rows), language.fit(table(spark, rows))).collect()}
    assert got[20] == "en" and got[21] == "fr"


needs_tables = pytest.mark.skipif(not DATA.exists(), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return con


@needs_tables
@pytest.mark.parametrize("name", ["op11_collocations", "op13_divergence"])
def test_sql(spark, duck, name):
    got = queries.queries()[name](spark, str(DATA))
    found = duck.execute(queries.oracle_sql()[name])
    assert [x[0] for x in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


@needs_tables
def test_held_out_languages(spark, duck):
    got = {r.doc_id: r for r in queries.queries()["op12_language"](spark, str(DATA)).collect()}
    truth = duck.execute("SELECT doc_id, lang FROM documents").fetchall()
    assert len(got) == len(truth)
    held = [(got[k].lang_pred, lang) for k, lang in truth if got[k].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
