"""Nearest neighbours, the Jaccard join, repeated passages and the pipeline against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from papyra.llm import ann, jaccard, repeats
from papyra.llm.common import discard, written
from papyra.llm.graph import components
from papyra.llm.words import grams, hash_words


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 8)).round(2)
    vectors[40:90] = vectors[40]  # many equal vectors: ties go to the smaller id
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    rows += [(300, None, "x"), (301, [0.0] * 8, "x"), (302, [float("nan")] + [1.0] * 7, "x"), (303, [None] + [1.0] * 7, "x"), (304, [1e-310] * 8, "x"), (305, [1.0, 2.0], "x"), (320, [3.0, 1.0], "x"), (340, [float("inf")] * 8, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    usable = {k: np.array(v) for k, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    queries = [k for k in usable if k % 20 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        scores = {c: float((usable[q] * v).sum()) for c, v in usable.items() if c != q and len(v) == len(usable[q])}
        want = sorted(scores, key=lambda c: (-scores[c], c))[:20]
        assert [got[q][k + 1][0] for k in range(len(want))] == want and len(got[q]) == len(want)
        assert [got[q][k + 1][1] for k in range(len(want))] == pytest.approx([scores[c] for c in want])
    assert ann.nearest(table.where("false"), table.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200), (100, 101), (-5, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in (100, 101, 102)} | {-5: -9, -9: -9}
    table = written(spark.range(3), "x")
    discard(table)


def links_by_hand(rows, n=5):
    sets = {}
    for k, text in rows:
        w = (text or "").encode().lower().split()
        sets[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 8)  # families are dealt out to several groups
    monkeypatch.setattr(jaccard, "FREQUENT", 12)
    random.seed(11)
    word = lambda: f"w{random.randrange(2000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "a b", "A  b", "a b c", "one two three four five", "ONE two three four five"]
    for _ in range(6):
        base = [word() for _ in range(random.choice([8, 40, 120]))]
        for _ in range(9):
            copy = list(base)
            for _ in range(random.randrange(5)):
                copy[random.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    base = [word() for _ in range(100)]
    for k in range(40):  # a chain: neighbours are similar, ends aren't
        base[2 * k] = word()
        texts.append(" ".join(base))
    for _ in range(30):  # documents that share a passage only
        texts.append(" ".join([*(word() for _ in range(random.randrange(5, 60))), *passage]))
    texts += texts[20:60]
    rows = list(enumerate(texts))
    random.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, digest int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    want = links_by_hand(rows)
    assert got == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if c == k)


def test_jaccard_without_links(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m"), (None, "h i j k l m")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(0, 2), (1, 1), (2, 2)]
    assert jaccard.jaccard_components(docs.where("false")).count() == 0


def repeated_by_hand(texts, least=50):
    where = {}
    words = {k: (t or "").encode().lower().split() for k, t in texts.items()}
    for k, w in words.items():
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(k)
    out = {}
    for k, w in words.items():
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                out.setdefault(k, set()).update(range(i, i + least))
    return out


def test_repeats(spark):
    random.seed(13)
    word = lambda: f"w{random.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (50, 51, 80, 300, 49)]
    texts = {0: None, 1: "", 2: "short text", 3: "same " * 200, 4: "same " * 70}
    for k in range(5, 45):
        parts = [[word() for _ in range(random.randrange(0, 80))] for _ in range(3)]
        for p in random.sample(passages, 2):
            parts.insert(random.randrange(4), p)
        texts[k] = "  ".join(w.upper() if random.random() < 0.1 else w for part in parts for w in part)
    texts[45] = texts[44]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in texts.items()], "doc_id long, text string, n_chars int").repartition(5)
    spans = repeats.repeated_passages(docs).collect()
    got = {}
    for s in spans:
        assert s.n_words == s.end - s.begin >= 50 and s.other != s.doc_id
        got.setdefault(s.doc_id, set()).update(range(s.begin, s.end))
    assert got == repeated_by_hand(texts)

    cut = {r.doc_id: r for r in repeats.cut_repeats(docs).collect()}
    assert set(texts) - set(cut) <= {4, 45}  # only documents that others hold as a whole may go
    assert 45 not in cut and all(cut[k].text == texts[k] for k in (0, 1, 2))
    assert all(r.n_chars == len(r.text or "") for r in cut.values())
    left = " | ".join((r.text or "").lower() for r in cut.values())
    for p in passages:
        assert " ".join(p) in " ".join(left.split())  # one occurrence stays
    assert not repeated_by_hand({k: r.text for k, r in cut.items()})
    assert repeats.repeated_passages(docs.where("false")).count() == 0
    assert repeats.cut_repeats(docs.where("false")).count() == 0


def frequent_line(word):
    """Twenty words that hash lower than most, so that they are the key of the windows that hold them."""
    lines = [[word() for _ in range(20)] for _ in range(3000)]
    return min(lines, key=lambda w: int(grams(hash_words([" ".join(w)])[0], 20)[0]))


def words_and_others(spans):
    covered, others = {}, {}
    for s in spans:
        covered.setdefault(s.doc_id, set()).update(range(s.begin, s.end))
        others.setdefault(s.doc_id, set()).add(s.other)
    return covered, others


@pytest.mark.parametrize("hot", [2048, 4])
def test_repeats_left_of_a_frequent_line(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GATHERED", 6)
    random.seed(17)
    word = lambda: f"w{random.randrange(5000)}"
    line, same = frequent_line(word), [word() for _ in range(45)]
    texts, want = {}, {}
    for k in range(40):  # two documents share 30 words before the line, and go on differently
        left = [word() for _ in range(30)]
        for i in (k, 40 + k):
            texts[i] = " ".join([*(word() for _ in range(k % 7)), *left, *line, *(word() for _ in range(40))])
        want[k], want[40 + k] = {40 + k}, {k}
    for i in range(80, 90):  # a window that many hold
        texts[i], want[i] = " ".join([word(), *line, *same, word()]), {80}
    want[80] = {81}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    covered, others = words_and_others(repeats.repeated_passages(docs).collect())
    assert covered == repeated_by_hand(texts) and others == want
    cut = {r.doc_id: r.text for r in repeats.cut_repeats(docs).collect()}
    assert all(cut[k] == texts[k] for k in (*range(40), 80)) and not repeated_by_hand(cut)


def test_cut_repeats_of_a_key_twice_in_the_first_document(spark):
    random.seed(19)
    word = lambda: f"w{random.randrange(5000)}"
    template = [word() for _ in range(20)] + frequent_line(word)
    ends = [[word() for _ in range(40)] for _ in range(3)]
    first = [x for end in ends for x in (*template, *end, *(word() for _ in range(60)))]
    texts = {0: " ".join(first)} | {k + 1: " ".join([f"start{k}", *template, *end[:20], f"rest{k}"]) for k, end in enumerate(ends)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert repeats.repeated_passages(docs.where("doc_id = 0")).count() == 0
    cut = {r.doc_id: " ".join(r.text.split()) for r in repeats.cut_repeats(docs).collect()}
    assert cut == {0: texts[0]} | {k: f"start{k - 1} rest{k - 1}" for k in (1, 2, 3)}


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_repeats_by_any_number_of_partitions(spark, parts):
    random.seed(23)
    word = lambda: f"w{random.randrange(5000)}"
    line, texts = frequent_line(word), {}
    for k in range(12):  # sorted by what follows the line, a text that shares too little to its left stands between two that share enough
        left, right = [word() for _ in range(25)], [word() for _ in range(10)]
        for i, own in enumerate((False, True, False)):
            texts[3 * k + i] = " ".join([*([word() for _ in range(25)] if own else left), *line, *right, *[word() for _ in range(20)]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert words_and_others(repeats.repeated_passages(docs).collect())[0] == repeated_by_hand(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nearest_beyond_the_range_of_doubles(spark):
    """Inner products that overflow are infinite, and rank by id among themselves; sums that cancel out are exact."""
    rows = [(k, [1e155 * (k % 3 - 1), 1e155]) for k in range(60)] + [(60, [1e200, -1e200])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(100, [1e200, 1e200])], "vec_id long, embedding array<double>"), k=61).orderBy("rank").collect()
    want = [k for k in range(60) if k % 3] + [k for k in range(61) if k % 3 == 0]
    assert [r.vec_id for r in got] == want and {r.score for r in got} == {float("inf"), 0.0}


def nearest_by_hand(own, q, ids, vectors, k):
    """The k best of vectors for one query as (score, id): sums in double precision, again in small units where they overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = (vectors * q).sum(1)
        small = np.ldexp((np.ldexp(vectors, -540) * np.ldexp(q, -540)).sum(1), 1080)
    scores = np.where(np.isfinite(scores), scores, small)
    return sorted(((-s, c) for s, c in zip(scores.tolist(), ids.tolist(), strict=True) if c != own))[:k]


@pytest.mark.parametrize("kind", ["near", "far", "tiny", "huge", "equal", "single"])
def test_nearest_tiles_against_plain_loops(monkeypatch, kind):
    monkeypatch.setattr(ann, "QUERIES", 16)
    monkeypatch.setattr(ann, "FIRST", 24)
    monkeypatch.setattr(ann, "PAIRS", 50)
    rng = np.random.default_rng(31)
    vectors = rng.normal(size=(400, 6))
    vectors[100:160] = vectors[7]
    with np.errstate(over="ignore", under="ignore"):
        vectors *= 10.0 ** {"near": 0, "far": rng.uniform(-160, 160, (400, 1)), "tiny": rng.uniform(-322, -150, (400, 1)), "huge": rng.uniform(100, 307, (400, 1)), "equal": 0, "single": -3}[kind]
    if kind == "equal":
        vectors[:] = vectors[0]
    if kind == "single":
        vectors = vectors.astype(np.float32)
    vectors[~vectors.any(1)] = 1
    ids = rng.permutation(400)
    for k in (1, 20, 500):
        own = np.flatnonzero(ids % 8 == 0)
        queries = ann.Queries([(ids[own], vectors[own])], k)
        for first, end in ((0, 5), (5, 85), (85, 93), (93, 360), (360, 400)):
            queries.meet(ann.Candidates([(ids[first:end], vectors[first:end])]))
        got = {}
        for batch in queries.out():
            for r in batch.to_pylist():
                got[r["query_id"]] = [(-s, c) for s, c in zip(r["scores"], r["vec_ids"], strict=True)]
        assert got == {int(ids[x]): nearest_by_hand(ids[x], vectors[x].astype(float), ids, vectors.astype(float), k) for x in own}


@pytest.mark.parametrize(("groups", "lanes", "kind"), [(1, 1, "double"), (3, 4, "float"), (2, 1, "double"), (1, 5, "float")])
def test_nearest_in_any_grid(spark, monkeypatch, groups, lanes, kind):
    """Vectors travel once for each group or lane and queries' heaps once for each lane: blocks aren't joined in pairs."""
    monkeypatch.setattr(ann, "CHUNK", 40)
    monkeypatch.setattr(ann, "CANDIDATES", 30)
    rng = np.random.default_rng(37)
    rows = [(k, rng.normal(size=8 if k % 3 else 5).astype(np.float32).tolist()) for k in range(300)] + [(300, None), (None, [1.0] * 8), (20, [2.0] * 8), (20, [2.0] * 8), (320, []), (340, [1.0, None, 2.0, 3.0, 1.0])]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    found = ann.nearest(table, table.where("vec_id % 20 = 0"), k=7, groups=groups, lanes=lanes)
    said = found._jdf.queryExecution().toString()
    assert "Join" not in said and "CartesianProduct" not in said
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    sets = {k: np.array([x for x in rows if x[0] is not None and x[1] and None not in x[1] and len(x[1]) == k], object) for k in (5, 8)}
    want = {}
    for part in sets.values():
        ids, vectors = part[:, 0].astype(int), np.array(part[:, 1].tolist())
        for q in {(k, tuple(v)) for k, v in part if k % 20 == 0}:
            want.setdefault(q[0], []).extend(nearest_by_hand(q[0], np.array(q[1]), ids, vectors, 7))
    assert got == {q: sorted(x)[:7] for q, x in want.items()}


@pytest.mark.parametrize("hot", [2048, 2])
def test_repeats_without_id(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    random.seed(29)
    passages = [[f"w{random.randrange(5000)}" for _ in range(60)] for _ in range(2)]
    big = (1 << 53) + 1  # not a double
    ids = [None, None, big, big + 2, None, None]
    texts = [" ".join([f"a{k}", *passages[k > 3], f"b{k}"]) for k in range(6)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.begin, r.end, r.other) for r in repeats.repeated_passages(docs).collect()), key=str)
    assert got == sorted([(None, 1, 61, big), (None, 1, 61, big), (big, 1, 61, big + 2), (big + 2, 1, 61, big), (None, 1, 61, None), (None, 1, 61, None)], key=str)
    cut = [r.text.split() for r in repeats.cut_repeats(docs).collect()]
    assert sorted(len(x) for x in cut) == [2, 2, 2, 2, 62, 62] and [x for x in cut if x[0] == "a2"] == [texts[2].split()]


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    sizes = [r.n for r in out.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").orderBy("sequence_id").collect()]
    assert sizes and all(n == 1024 for n in sizes[:-1]) and 0 < sizes[-1] <= 1024
    assert out.select("doc_id").distinct().count() > 100


def test_words_whose_polynomials_agree(spark):
    """A word of 1,024 bytes and its complement are different words to either operator."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{k}" for k in range(49))
    docs = spark.createDataFrame([(1, one), (2, two), (3, two), (4, f"{one} {rest}"), (5, f"{two} {rest}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs.where("doc_id < 4")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}
    assert repeats.repeated_passages(docs.where("doc_id > 3")).count() == 0


def test_pipeline_stages_with_odd_rows_and_clashing_columns(spark):
    """Each filtering stage on nulls, empty and repeated texts, and columns of the names that it would use itself."""
    from papyra.llm import toxicity

    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text), (2, text), (2, text), (3, None), (None, "some words"), (4, ""), (5, text + " and more words here"), (6, "same " * 5000), (7, " ")]
    names = ["papyra_kept_id", "papyra_row", "papyra_spans", "papyra_text", "papyra_text_", "label", "begin", "end"]
    docs = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    model = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    for stage in (lambda d: toxicity.keep_clean(d, model), jaccard.keep_one, repeats.cut_repeats):
        out = stage(docs)
        assert out.columns == docs.columns and stage(docs.where("false")).count() == 0
        kept = out.collect()
        assert {r.label for r in kept} == {"f"} and {r.papyra_text_ for r in kept} == {"e"}
    ids = lambda d: sorted(str(r.doc_id) for r in d.select("doc_id").collect())
    assert ids(toxicity.keep_clean(docs, model)) == sorted(str(k) for k, _ in rows)
    assert ids(jaccard.keep_one(docs)) == ["1", "3", "4", "6", "7", "None"]
    cut = {r.doc_id: r.text for r in repeats.cut_repeats(docs).collect()}
    assert cut[1] == text and 2 not in cut and cut[5].split() == ["and", "more", "words", "here"] and cut[6] == "same " * 5000


def test_jaccard_at_the_threshold(spark):
    """Pairs that just meet the threshold, of which the larger text has tokens of its own before or behind those in common."""
    random.seed(5)
    rows = []
    for k in range(120):
        more = random.choice([5, 10, 20, 60])  # 4 * more of 5 * more shingles are in common
        words = [f"w{k}x{i}" for i in range(5 * more + 4)]
        part = words[more:] if k % 2 else words[: 4 * more + 4]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(part[1:] if k % 5 == 4 else part))]  # every fifth has a shingle too few
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(table).collect()}
    assert got == links_by_hand(rows)


def test_group_holds_little_beside_its_tokens():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (900, 1000, 1100, 40, 1)]
    sets += [np.sort(np.append(sets[0][:-20], np.arange(20, dtype=np.uint64))), sets[3]]
    sizes = np.array([len(x) for x in sets])
    group = jaccard.Group(np.arange(len(sets)), sizes, [x.tobytes() for x in sets])
    assert sum(x.nbytes for x in (group.union, group.starts, group.owner)) <= 16 * sizes.sum() + 4
    assert sorted(zip(*(x.tolist() for x in group.pairs(80)), strict=True)) == [(0, 5), (3, 6)]
    opens, both = group.overlaps(sizes[:4], [np.sort(np.append(x[: len(x) // 2], x[: len(x) // 2] ^ np.uint64(1 << 63))).tobytes() for x in sets[:4]], 40)
    assert opens.all() and both.tolist() == [[len(np.intersect1d(x[: len(x) // 2], y)) for y in sets] for x in sets[:4]]
    assert jaccard.Group(np.zeros(0, int), np.zeros(0, int), []).pairs(80)[0].tolist() == []
