"""Work that must not be done twice, in one task or in one piece, however the tables lie."""

from __future__ import annotations

import contextlib
import io

import pyarrow as pa
from pyspark.sql import functions as F

from papyra import bindings
from papyra.operators import cards, linking, mining, search
from papyra.plans import terms
from papyra.sources import html, lookup, packages, tree


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_substring_scores_lowers_a_text_once(spark):
    docs = spark.createDataFrame([(1, "Nation STRASSE traß"), (2, "none"), (3, None)], "id long, text string")
    found = search.substring_scores(docs, "ation tr tra", "id", "text")
    assert [tuple(r) for r in found.collect()] == [(1, 5)]
    made = docs.repartition(2)  # else the plan is a table of constants
    assert plan(search.substring_scores(made, "ation tr tra", "id", "text")).count("lower(") == 1


def test_reader_cards_read_blocks_once_and_over_all_cores(spark):
    blocks = terms.introductions(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet"))
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert plan(cards.reader_cards(blocks, "p_brand", "uid", "place", "kind", "text")).count("MapInPandas") == 1


def odd_texts(spark):
    rows = [(1, "en", "fast sparse models of fast sparse models"), (2, "en", "Fast sparse 2 models, the a b c"), (3, None, "sparse models x " * 30), (4, "de", None), (5, "de", ""), (6, None, "of sparse models"), (7, "fr", "été à été à " + "w" * 101 + " w")]
    return spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)


def test_glossary_candidates_shuffle_no_row_for_each_phrase(spark):
    docs = odd_texts(spark)
    found = mining.glossary_candidates(docs, "text")
    want = mining.phrases(docs, "id", "text").groupBy("phrase").agg(F.count("id").alias("uses"), F.countDistinct("id").alias("documents")).where("uses >= 2")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    assert "HashAggregate" not in plan(found)


def test_seed_keywords_count_phrases_by_language_where_they_lie(spark):
    docs = odd_texts(spark)
    found = mining.phrase_uses(docs, "lang", "text")
    want = mining.phrases(docs, "lang", "text").groupBy("lang", "phrase").agg(F.count("phrase").alias("uses")).where("uses > 1")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) != []
    assert "HashAggregate" not in plan(found)


def test_phrase_candidates_clean_a_clause_once(spark, tmp_path):
    texts = ["(Fast  Models), of it; -sparse\tnets-: a b: the end of. x1 y2.", None, "Fast Models.\nFast Models"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = bindings.queries()["phrase_candidates"](spark, str(tmp_path))
    assert plan(found).count("split(") == 1
    assert sorted(map(tuple, found.collect())) == [("Fast Models", 3), ("sparse nets", 1), ("x1 y2", 1)]


def test_tokens_tf_are_counted_within_a_row(spark):
    docs = spark.createDataFrame([(1, "b aa aa cc"), (2, None), (3, "aa")], "id long, text string").repartition(2)
    found = search.term_counts(docs, "id", "text")
    assert "Exchange hashpartitioning" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(1, "aa", 2), (1, "cc", 1), (3, "aa", 1)]
    assert sorted(map(tuple, search.term_counts(docs.unionByName(docs), "id", "text").collect())) == [(1, "aa", 4), (1, "cc", 2), (3, "aa", 2)]


def test_pages_come_to_python_in_small_pieces(spark):
    batch = pa.record_batch({"k": list(range(300)), "html": ["<p>x</p>"] * 300})
    assert [p.num_rows for p in html.pieces(iter([batch]))] == [128, 128, 44]
    pages = spark.createDataFrame([(k, "<h2 id='a'>T</h2><p>x <a href='#b'>y</a></p>" if k % 2 else None) for k in range(300)], "id long, html string").coalesce(1)
    assert html.html_blocks(pages, "id", "html").groupBy("block_type", "level", "label").count().orderBy("block_type").collect() == [("paragraph", None, None, 150), ("section", 2, "a", 150)]
    assert tree.document_blocks(pages, "id", "html").where("place = 2").select("level", F.col("refs")[0]["href"]).distinct().collect() == [(None, "#b")]


def test_hash_embedding_takes_words_in_bounded_runs():
    batch = pa.record_batch({"k": list(range(6)), "w": pa.array([["w"] * 100_000] * 6)})
    assert [b.num_rows for b in search.slices(iter([batch]))] == [2, 2, 2]


def test_listings_are_joined_without_distinct_or_broadcast(spark):
    refs = spark.createDataFrame([(1, "fig"), (1, "fig"), (2, "fig")], "id int, reference string")
    listing = spark.createDataFrame([(1, "/r/fig.png"), (1, "/r/fig.png"), (1, "/r/fig.gif")], "id int, path string")
    found = lookup.resolved(refs, listing, "id", "reference", ["/r"])
    assert "Broadcast" not in plan(found) and plan(found).count("Aggregate(") == 2
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "fig", "/r/fig.png", "found")] * 2 + [(2, "fig", None, "missing")]


def test_assets_are_shuffled_once_by_package(spark):
    found = bindings.queries()["package_files"](spark, "/root/testdata/sf0.001")
    lines = [x for x in plan(found).splitlines() if "Exchange hashpartitioning" in x]
    assert 2 <= len(lines) <= 4 and not any("asset" in x or "stem" in x for x in lines)


def test_names_in_doubt_are_given_with_care_and_others_by_windows(spark):
    rows = [("a", "Fig", 1, ".png"), ("a", "fig", 2, ".png"), ("a", "fig 2", 3, ".png"), ("b", "fig", 1, ".png"), ("b", "FIG", 2, ".png"), ("c", "a", 1, "b.png"), ("c", "ab", 2, ".png"), ("d", "fig-7", 1, ""), ("e", "--", 1, None), ("f", "x", 1, "")]
    assets = spark.createDataFrame([(*r, f"{r[0]}{r[2]}") for r in rows], "package string, asset string, place long, suffix string, content string")
    bodies = spark.createDataFrame([(p, "<!-- m-asset:fig --> <!-- m-asset:FIG -->") for p in "abcde"], "package string, body string")
    got = {(r.path, bytes(r.content).decode()) for r in packages.package_entries(bodies, assets, "m").where("place = 1").collect()}
    want = {("a", "fig.png", "a1"), ("a", "fig-2.png", "a2"), ("a", "fig-2-2.png", "a3"), ("b", "fig.png", "b1"), ("b", "fig-2.png", "b2"), ("c", "ab.png", "c1"), ("c", "ab-2.png", "c2"), ("d", "fig-7", "d1"), ("e", "asset", "e1")}
    assert got == {(f"{p}.assets/{f}", c) for p, f, c in want}
    texts = {r.package: bytes(r.content).decode() for r in packages.package_entries(bodies, assets, "m").where("place = 0").collect()}
    assert texts["a"] == "![fig](a.assets/fig-2.png) \n" and texts["b"] == "![fig](b.assets/fig.png) ![FIG](b.assets/fig-2.png)" and texts["e"] == "\n \n"


def test_texts_meet_the_terms_of_a_word_as_one_row_and_nothing_is_broadcast(spark):
    docs = spark.createDataFrame([(k, f"Deep nets {k}") for k in range(40)] + [(40, "none"), (41, None), (0, "Deep nets 0")], "id long, text string").repartition(2)
    terms = spark.createDataFrame([(f"deep x{k}", "wide") for k in range(30)] + [("nets", "<wide>"), ("wide", "x"), ("x", "nets"), ("y", "z")], "source string, target string")
    found = linking.with_terms(docs, terms, "id", "text")
    assert "Broadcast" not in plan(found)
    assert {r.id: len(r.papyra_terms) for r in found.collect()} == dict.fromkeys(range(40), 33)
    assert "collect_set(papyra_own" in plan(found)


def test_texts_with_the_same_terms_share_a_matcher():
    get = linking._matchers(3)
    one = get(["b", "a"], ["1", "2"])
    assert get(["b", "a"], ["1", "2"]) is one and one.pairs == [("a", "2"), ("b", "1")]
    assert get(["c", "d"], ["1", "2"]) is not one and get(["b", "a"], ["1", "2"]) is not one
