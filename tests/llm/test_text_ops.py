"""Tokenisation, packing, audio, toxicity and language-model operators against libraries and plain loops."""

from __future__ import annotations

import hashlib
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyra.llm import audio, binary_pack, bpe, lm, mixture, token_counts, toxicity
from papyra.llm.common import fresh_path
from papyra.llm.words import hash_words, shingle_sets

TEXTS = [None, "", " ", "Hello there, it's 42!", "we'll  see\n\nthe 'rest' don't", "ÄÖ 漢字 😀 naïve", "x" * 5000, "<|endoftext|> a<|endoftext|>", "Hello there, it's 42!", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, "clash", 1) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ids string, n_tokens int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


ENCODING = {}


def encoding(name):
    if name not in ENCODING:
        ENCODING[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(name).ranks, special_tokens={})
    return ENCODING[name]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" '  \n\tstmdrevlLab19!?-é漢😀　")) | st.characters(max_codepoint=0x2FFF, categories=["L", "N", "P", "Z", "S", "M"])), max_size=5))
def test_encode_as_library(texts):
    name = "byte_bpe_multi_50k.tiktoken"
    ids, counts, offsets, cuts = bpe.ranks(name).encode(texts)
    want = [encoding(name).encode_ordinary(x) for x in texts]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    assert bpe.ranks(name).decode(ids, counts) == [x.encode() for x in texts]
    assert len(offsets) == cuts.sum()


def test_round_trip(spark, docs, empty):
    name = "byte_bpe_multi_50k.tiktoken"
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, name).collect()}
    for k, text in enumerate(TEXTS):
        ids = encoding(name).encode_ordinary(text or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    separate = bpe.decode(bpe.encode(docs, name), name)
    assert {r.doc_id: bytes(r.data).decode() for r in separate.collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert bpe.round_trip_digests(empty, name).count() == 0


def library_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_token_counts(spark, docs, empty):
    path = fresh_path(spark, "cache")
    for _ in range(2):  # the second time from the cache
        got = {r.doc_id: r for r in token_counts.token_counts(docs, "byte_bpe_50k.json", path).collect()}
        assert [got[k].n_tokens for k in range(len(TEXTS))] == [len(x) for x in library_ids()]
        assert [got[k].n_bytes for k in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())
        assert spark.read.parquet(path).count() == len({t or "" for t in TEXTS})
    assert token_counts.token_counts(empty, "byte_bpe_50k.json", fresh_path(spark, "cache")).count() == 0


@pytest.mark.parametrize("target", [None, {"s0": 3.0, "": 1.0}])
def test_mixture(docs, empty, target):
    want = {k: [*x, 0] for k, x in enumerate(library_ids())}
    pieces = mixture.pack_mixture(docs, window=64, target=target).collect()
    back, windows = {k: {} for k in want}, {}
    for p in pieces:
        assert len(p.ids) == p.length > 0 and p.doc_tokens == len(want[p.doc_id])
        back[p.doc_id][p.start] = p.ids
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length, p.source))
    for k, parts in back.items():
        assert sum((parts[s] for s in sorted(parts)), []) == want[k]
    sizes = []
    for w in range(len(windows)):
        at = 0
        for offset, length, _ in sorted(windows[w]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 64 for n in sizes[:-1]) and 0 < sizes[-1] <= 64
    if target:  # while both have tokens, three quarters come from s0
        share = [sum(n for _, n, s in windows[w] if s == "s0") for w in range(1)]
        assert all(abs(n - 48) <= 1 for n in share)
    crc = {(p.doc_id, p.start): p.ids_crc32 for p in mixture.pack_mixture(docs, window=64, target=target, checksums=True).collect()}
    assert crc == {(p.doc_id, p.start): zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces}
    assert mixture.pack_mixture(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=1, max_size=6), st.lists(st.floats(0, 5), min_size=6, max_size=6))
def test_schedule(totals, weights):
    """Every token of every queue lies in one place, and all windows but the last are full."""
    if not sum(totals):
        return
    where = mixture.Schedule(mixture.schedule(np.array(totals), np.array(weights[: len(totals)]), 100, 8), 100)
    seen = Counter()
    for s, n in enumerate(totals):
        if n:
            _, start, length, w, offset = where.cut(s, np.array([0]), np.array([n]))
            assert start.tolist() == (np.cumsum(length) - length).tolist() and length.sum() == n
            for a, b, c in zip(w.tolist(), offset.tolist(), length.tolist(), strict=True):
                seen.update((a, x) for x in range(b, b + c))
    assert len(seen) == sum(totals) == sum(seen.values())
    assert {a * 100 + x for a, x in seen} == set(range(sum(totals)))


def test_packed_matrices(docs, empty):
    want = {k: [*x, 50256] for k, x in enumerate(library_ids())}
    back = {k: {} for k in want}
    for r in binary_pack.pack_documents(docs, length=128, block=500).collect():
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128 and not ids[r.n_tokens :].any()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            back[doc][start] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    assert {k: sum((p[s] for s in sorted(p)), []) for k, p in back.items()} == want
    assert binary_pack.pack_documents(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit(sizes):
    """The tree chooses as a plain search does."""
    bins, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [c for c in bins if c[0] >= sizes[k]]
        if fits:
            least = min(c[0] for c in fits)
            chosen = [c for c in fits if c[0] == least][0]
        else:
            bins.append(chosen := [32])
        chosen[0] -= sizes[k]
        want[k] = chosen
    got = binary_pack.best_fit(np.array(sizes, np.int64), 32)
    assert sorted(np.bincount(got, np.array(sizes)).astype(int).tolist()) == sorted(32 - c[0] for c in bins) if sizes else len(got) == 0


def test_audio(docs, empty):
    got = {r.doc_id: r for r in audio.read_audio(audio.store_audio(docs)).collect()}
    for k, text in enumerate(TEXTS):
        raw, r = (text or "").encode(), got[k]
        assert bytes(r.payload) == raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert r.resyncs == 0 and r.checksums_bad == 0 and r.checksums_good == len(r.seek) == r.vbr_frames
        assert r.duration == len(r.seek) * 1152 / 44100 and r.tags["TXXX:text_bytes"] == str(len(raw))
    same = audio.digests(audio.read_audio(audio.store_audio(docs))).where("doc_id in (3, 8)").drop("doc_id").distinct()
    assert same.count() == 1
    assert audio.digests(audio.read_audio(audio.store_audio(empty))).count() == 0


def test_damaged_audio():
    whole = audio.store(b"abc" * 3000, 9000)
    clean = audio.parse(whole)
    at = clean.seek[3]
    damaged = audio.parse(whole[:at] + b"\0\xff\xfb junk" + whole[at:])
    assert damaged.resyncs == 1 and len(damaged.seek) == len(clean.seek)
    bad = bytearray(whole)
    bad[clean.seek[2] + 10] ^= 1
    assert audio.parse(bytes(bad)).checksums_bad == 1
    for junk in (b"", b"ID3", b"\xff" * 50, b"TAG", b"\xff\xfb"):
        assert audio.parse(junk).samples == 0


def test_words():
    words, counts = hash_words(["A b\x0bc", "", " a  B c ", "é"])
    assert counts.tolist() == [3, 0, 3, 1] and words[:3].tolist() == words[3:6].tolist() and len(set(words.tolist())) == 4
    tokens, sizes = shingle_sets(["a b c d e f", "", "a b", "a b c d e f a b c d e f", "a b a"])
    assert sizes.tolist() == [2, 0, 1, 6, 1]
    long = "w" * 600_000
    assert hash_words([f"x {long} y"])[0].tolist()[1] == hash_words([long])[0].tolist()[0]


def test_toxicity(spark):
    random.seed(5)
    names = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(900):
        words = [random.choice(names) for _ in range(random.randint(5, 60))]
        if toxic := k % 5 == 0:
            words[random.randrange(len(words))] = "slur"
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(9000, None, "x"), (9001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k] >= 0.7) == bool(y) for k, y in held) >= 0.97 * len(held)
    assert got[9000] == got[9001] < 0.5
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, s in got.items() if s < 0.7}
    assert toxicity.score(docs.where("false"), model).count() == 0
    none = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_mixture_of_many_sources():
    """Two hundred queues: every token in one place, full windows, and a plan of two numbers a phase and queue."""
    rng = np.random.default_rng(4)
    totals = rng.integers(1, 400, 200)
    phases = mixture.schedule(totals, rng.random(200), 1024)
    assert len(pickle.dumps(phases)) < 1 << 20
    where, seen = mixture.Schedule(phases, 1024), Counter()
    for s, n in enumerate(totals.tolist()):
        _, start, length, w, offset = where.cut(s, np.array([0]), np.array([n]))
        assert start[0] == 0 and (start[1:] == np.cumsum(length)[:-1]).all() and length.sum() == n
        for at, k, size in zip(w.tolist(), offset.tolist(), length.tolist(), strict=True):
            seen.update((at, x) for x in range(k, k + size))
    last = (int(totals.sum()) - 1) // 1024
    assert max(seen.values()) == 1 and len(seen) == totals.sum() and max(w for w, _ in seen) == last


def test_language_model(spark):
    random.seed(7)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    texts = [" ".join(random.choice(nouns if j % 2 else verbs) for j in range(random.randint(2, 40))) for _ in range(400)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1002, "unseen words here", "x"), (7, texts[7], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    got = lm.score(docs, classes=8, units=40, rounds=8).collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 10 == 0
    tokens = [[*(t or "").lower().split(), None] for _, t, _ in rows]
    counts = Counter(w for (k, _, _), ws in zip(rows, tokens, strict=True) if not held(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(r.doc_id for r in got) == sorted(k for k, _, _ in rows)
    for (k, _, _), ws in zip(rows, tokens, strict=True):
        r = by[k][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert math.isfinite(r.score)
    out = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score(docs.where("false"), rounds=1).count() == 0


@pytest.mark.parametrize("units", [12, 1000])
def test_language_model_scores_by_hand(spark, units):
    """Every score, from the classes that the operator finds: plain counts of classes, words and class pairs."""
    random.seed(8)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(random.choice(words[j % 3 :: 3]) for j in range(random.randint(0, 30))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "w1 w2 w3"), (None, None), (500, "never w1 seen"), (10, "only held out here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    classes, rounds = 8, 3
    table = lm.chunks(docs, "doc_id", "text")
    tops, counts, (types, tokens, ends) = lm.frequent(lm.word_counts(table), units)
    state, pairs = lm.clustered(table, tops, counts, classes, rounds)
    placed = lm.placed_words(table, spark.sparkContext.broadcast(state), pairs, classes).collect()
    kind = dict(zip(tops.tolist(), state.kind.tolist(), strict=False)) | {lm.END: classes - 1}
    for row in table.collect():
        hashes = np.frombuffer(row.hashes, np.int64)
        rare = np.sort(hashes[state.units(hashes) == len(tops)].view(np.uint64)).view(np.int64)
        found = b"".join(r.classes for r in sorted(placed, key=lambda r: r.bucket) if r.chunk == row.chunk)
        for h, c in zip(rare.tolist(), found, strict=True):
            assert kind.setdefault(h, c) == c  # the same one in every chunk
    hash_of = lambda w: lm.END if w is None else int(hash_words([w])[0].view(np.int64)[0])
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    tokens_of = [[hash_of(w) for w in [*(t or "").split(), None]] for _, t in rows]
    train = [x for (k, _), x in zip(rows, tokens_of, strict=True) if not held(k)]
    count, follow, n = Counter(w for x in train for w in x), Counter(), sum(map(len, train))
    assert (types, tokens, ends) == (len(count), n, len(train))
    for x in train:
        follow.update(zip([kind[w] for w in [lm.END, *x[:-1]]], [kind[w] for w in x], strict=True))
    of_class, types_of = Counter(), Counter()
    for w, c in count.items():
        of_class[kind[w]] += c
        types_of[kind[w]] += 1
    into = [sum(follow[a, c] for a in range(classes)) for c in range(classes)]
    overall = [(x + 1) / (n + classes) for x in into]
    outof = [sum(follow[a, c] for c in range(classes)) for a in range(classes)]
    step = lambda a, c: overall[c] if a is None else (follow[a, c] + lm.ALPHA * overall[c]) / (outof[a] + lm.ALPHA)
    room = [of_class[c] + lm.DELTA * (types_of[c] + 1) for c in range(classes)]
    want = []
    for (k, _), x in zip(rows, tokens_of, strict=True):
        total, last = 0.0, classes - 1
        for w in x:
            c = kind[w] if count[w] else None
            p = step(last, c) * (count[w] + lm.DELTA) / room[c] if count[w] else sum(step(last, d) * lm.DELTA / room[d] for d in range(classes))
            total += math.log10(lm.WEIGHT * p + (1 - lm.WEIGHT) * (count[w] + 0.1) / (n + 0.1 * (len(count) + 1)))
            last = c
        want.append((str(k), len(x), round(total, 6)))
    got = [(str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.score(docs, classes=classes, units=units, rounds=rounds).collect()]
    assert sorted(got) == sorted(want)


def test_model_is_a_distribution():
    """After every class, the probabilities of all known words and of the unseen one sum to one."""
    rng = np.random.default_rng(1)
    n, classes = 12, 4
    counts = rng.integers(1, 9, n + 1)  # words, and the end
    kinds = np.append(rng.integers(0, classes - 1, n), classes - 1)
    m = lm.model_of(rng.integers(0, 9, (classes, classes)), np.bincount(kinds, minlength=classes), np.bincount(kinds, counts, classes).astype(int))
    for before in range(classes + 1):
        base, own = lm.log_scores(m, np.append(kinds, classes), np.full(n + 2, before), np.append(counts, 0))
        assert (10**own).sum() == pytest.approx(1) and (10**base).sum() == pytest.approx(1)


def test_columns_may_clash(docs):
    odd = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("body"), F.lit("x").alias("doc_id"), F.lit("y").alias("text"))
    assert bpe.encode(odd, "byte_bpe_50k.tiktoken", "key", "body").count() == len(TEXTS)
    assert audio.store_audio(odd, "key", "body").count() == len(TEXTS)


def test_every_code_point_as_library():
    """All code points among letters, numbers, blanks and signs."""
    name = "byte_bpe_multi_50k.tiktoken"
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f" X{chr(c)}a1{chr(c)} {chr(c)}!" for c in points[k : k + 2048]) for k in range(0, len(points), 2048)]
    for k in range(0, len(texts), 32):
        ids, counts, _, _ = bpe.ranks(name).encode(texts[k : k + 32])
        want = [encoding(name).encode_ordinary(x) for x in texts[k : k + 32]]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def complements(size):
    """Two words whose polynomials in the bytes agree modulo 2^64, whatever the odd base."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(size))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [512, 1024, 2048, 4096])
def test_word_hashes_have_no_certain_collisions(size):
    one, two = complements(size)
    hashes = hash_words([f"{one} {two} {one}c {two}c"])[0].tolist()
    assert len(set(hashes)) == 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é \n", max_size=30)))
def test_word_hashes_follow_words(texts):
    hashes, counts = hash_words(texts)
    words = [x for t in texts for x in t.replace("\n", " ").split(" ") if x]
    assert counts.sum() == len(words)
    named = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def test_complements_are_different_words(spark):
    one, two = complements(1024)
    held = next(k for k in range(100, 999) if zlib.crc32(str(k).encode()) % 10 == 0)
    docs = spark.createDataFrame([(k, f"{one} seen", "x") for k in range(8)] + [(held, two, "x")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in lm.score(docs, classes=4, units=10, rounds=1).collect()}
    assert got[held].n_known == 1 and got[held].n_tokens == 2  # the end alone


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2):
    z, n = Counter(), Counter()

    def weight(k):
        penalty = 0.0 if k == toxicity.DIMENSIONS else l1
        return 0.0 if abs(z[k]) <= penalty else -(z[k] - math.copysign(penalty, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for row, label in zip(rows, labels, strict=True):
            ws = {k: weight(k) for k in row}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(ws.values()))))) - label
            for k in row:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * ws[k]
                n[k] += g * g
    return {k: weight(k) for k in z if weight(k)}


@pytest.mark.parametrize(("alpha", "l1", "l2"), [(1.0, 4.0, 0.0), (0.3, 0.5, 0.1), (0.1, 0.0, 1.0)])
def test_ftrl_by_hand(alpha, l1, l2):
    random.seed(3)
    texts = [" ".join(random.choice(["mild", "kind", "slur", "awfully", "bad"]) for _ in range(random.randint(0, 6))) for _ in range(60)]
    labels = [int("slur" in x) for x in texts]
    rows = [[*x.tolist(), toxicity.DIMENSIONS] for x in toxicity.documents(texts)]
    want = plain_ftrl(rows, labels, 3, alpha, 1.0, l1, l2)
    got = toxicity.ftrl(texts, labels, 3, alpha, 1.0, l1, l2)
    found = dict(zip(got.index.tolist(), got.weight.tolist(), strict=True)) | {toxicity.DIMENSIONS: got.bias}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: v for k, v in found.items() if v}
    weight = np.append(got.dense(), 0.0)
    for text, row, p in zip(texts, rows, toxicity.probabilities(texts, weight, got.bias), strict=True):
        assert p == pytest.approx(1 / (1 + math.exp(-sum(found.get(k, 0.0) for k in row)))), text


def test_features_by_hand():
    """Distinct words, pairs, pairs over a gap and stems of a text."""
    (one,) = toxicity.documents(["Awful awful words, here!"])
    assert len(one) == 3 + 3 + 2 + len({("awful"[:k], k) for k in toxicity.STEMS} | {(w[:k], k) for w in ("words", "here") for k in toxicity.STEMS})
    assert [len(x) for x in toxicity.documents(["", "a", "a a"])] == [0, 1 + len(toxicity.STEMS), 2 + len(toxicity.STEMS)]


def test_calibration():
    rng = np.random.default_rng(2)
    total = rng.normal(0, 3, 20_000)
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * total + 0.6)))).astype(int)
    slope, shift = toxicity.calibrated(total, label)
    assert abs(slope - 1.7) < 0.1 and abs(shift - 0.6) < 0.1
    assert toxicity.calibrated(total, label * 0) == (1.0, 0.0) and toxicity.calibrated(-total, label) == (1.0, 0.0)
    slope, shift = toxicity.calibrated(np.array([-5.0, -4.0, 4.0, 5.0]), np.array([0, 0, 1, 1]))
    assert 0 < slope < 10 and abs(shift) < 10


def test_slices_are_merged_once_while_the_cache_lasts(monkeypatch):
    known, merged = bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), []
    merge_all = known.merge_all
    monkeypatch.setattr(known, "merge_all", lambda pieces: merged.append(len(pieces)) or merge_all(pieces))
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 17576)}" for k in range(n, n + 60_000)) for n in range(0, 240_000, 60_000)]
    first = [known.encode([x])[0] for x in texts]
    assert sum(merged) > 200_000 and all((known.encode([x])[0] == y).all() for x, y in zip(texts, first, strict=True))
    assert sum(merged[4:]) == 0
    for x in ("\0", "\0" * 2, "\0" * 8, "\0" * 9, "\0" * 15, "\0" * 16, "a\0", "a" * 15, "a" * 16, "abcdefgh\0", "abcdefgh"):
        assert known.decode(*known.encode([x])[:2]) == [x.encode()]
