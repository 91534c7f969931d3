"""Packages, lookups of files, comparisons and typed JSON over orders, parts, customers and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import cleanup, values
from papyra.operators import compare
from papyra.plans.registry import query
from papyra.sources import lookup, packages


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 5 AS m FROM customer)
SELECT k AS c_custkey, '$.count' AS path, 'value' AS kind, k::VARCHAR AS expected, (k + 1)::VARCHAR AS actual FROM c WHERE m = 1
UNION ALL SELECT k, '$.list[2]', 'missing', '3', NULL FROM c WHERE m = 2 UNION ALL SELECT k, '$.name', 'missing', '"a"', NULL FROM c WHERE m = 3
UNION ALL SELECT k, '$["other key"]', 'extra', NULL, 'null' FROM c WHERE m = 3 UNION ALL SELECT k, '$.deep.x', 'type', '{"y": "t"}', '5' FROM c WHERE m = 4""")
def json_differences(t):
    """Differences of two nested values by path."""
    k = F.col("c_custkey").cast("string")
    say = lambda count, items, name, deep: F.concat(F.lit('{"count": '), count, F.lit(', "list": [1, '), k, F.lit(items + "]" + name + ', "deep": {"x": ' + deep + "}}"))
    plain = ', 3', ', "name": "a"', '{"y": "t"}'
    m = F.col("c_custkey") % 5
    actual = F.when(m == 1, say((F.col("c_custkey") + 1).cast("string"), *plain)).when(m == 2, say(k, "", *plain[1:])).when(m == 3, say(k, plain[0], ', "other key": null', plain[2])).when(m == 4, say(k, *plain[:2], "5")).otherwise(say(k, *plain))
    pairs = t("customer").select("c_custkey", say(k, *plain).alias("expected"), actual.alias("actual"))
    return compare.differences(pairs, "c_custkey", "expected", "actual")


@query("""WITH a AS (SELECT 'o' || l_orderkey AS package, 'Part ' || l_returnflag AS asset, 'part-' || lower(l_returnflag) AS stem, l_partkey::VARCHAR AS content, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS place FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
n AS (SELECT *, stem || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END || '.png' AS file FROM a WINDOW w AS (PARTITION BY package, asset ORDER BY place)),
l AS (SELECT package, string_agg('![Part A](' || package || '.assets/' || file || ')', chr(10) ORDER BY place) AS links FROM n WHERE asset = 'Part A' GROUP BY 1)
SELECT 'o' || o_orderkey AS package, 0 AS place, 'o' || o_orderkey || '.md' AS path, 'Text ' || coalesce(links, chr(10)) || ' and ' || chr(10) || ' end' AS content FROM orders LEFT JOIN l ON package = 'o' || o_orderkey
UNION ALL SELECT package, 1, package || '.assets/' || file, content FROM n""")
def package_files(t):
    """Entries of packages: texts with links to their files, and the files under names of their own."""
    order = Window.partitionBy("package").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = t("lineitem").withColumn("package", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")))
    assets = lines.select("package", F.concat(F.lit("Part "), "l_returnflag").alias("asset"), F.row_number().over(order).cast("long").alias("place"), F.lit(".png").alias("suffix"), F.col("l_partkey").cast("string").alias("content"))
    bodies = t("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("package"), F.lit("Text <!-- papyra-asset:Part A --> and <!-- papyra-asset:none --> end").alias("body"))
    return packages.package_entries(bodies, assets, "papyra").select("package", "place", "path", F.col("content").cast("string").alias("content"))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS m FROM part)
SELECT k AS p_partkey, CASE m WHEN 0 THEN '/r/doc/fig/p' || k || '.png' WHEN 1 THEN '/r/src/p' || k || '.svg' WHEN 5 THEN '/r/doc/a b' || k || '.png' WHEN 7 THEN '/r/src/z' || k || '.pdf' END AS path,
  CASE m WHEN 2 THEN 'remote' WHEN 3 THEN 'refused' WHEN 4 THEN 'empty' WHEN 6 THEN 'missing' ELSE 'found' END AS status FROM p""")
def asset_lookup(t):
    """Files that references mean, by root and ending, or why there are none."""
    k, m = F.col("p_partkey").cast("string"), F.col("p_partkey") % 8
    say = lambda a, b="": F.concat(F.lit(a), k, F.lit(b))
    name = F.when(m == 0, say("fig/p")).when(m == 1, say("./p", ".svg?x=1#f")).when(m == 2, say("http://x.org/p", ".png")).when(m == 3, say("a/../p", ".png")).when(m == 4, F.lit("#f")).when(m == 5, say("a%20b", ".png")).when(m == 6, say("gone")).otherwise(say("/r/src/z", ".pdf"))
    there = [say("/r/doc/fig/p", ".png"), say("/r/src/fig/p", ".pdf"), say("/r/src/p", ".svg"), say("/r/p", ".png"), say("/r/doc/a b", ".png"), say("/r/src/z", ".pdf")]
    listing = t("part").select("p_partkey", F.explode(F.array(*there)).alias("path"))
    return lookup.resolved(t("part").select("p_partkey", name.alias("reference")), listing, "p_partkey", "reference", ["/r/doc", "/r/src"]).drop("reference")


@query("""SELECT doc_id, 1 AS place, 'T' || doc_id AS title, NULL AS url, doc_id::VARCHAR AS arxiv_id, '' AS raw_snippet, '{"n":' || quality || ',"o":{"x":[1,"2"]}}' AS metadata FROM labels
UNION ALL SELECT doc_id, 2, NULL, NULL, NULL, 's', '{"flag":true}' FROM labels""")
def external_refs(t):
    """Citations of replies by their usual names, with what else they say."""
    k = F.col("doc_id").cast("string")
    reply = F.concat(F.lit('{"citations":[{"title":" T'), k, F.lit(' ","arxivId":"'), k, F.lit('","n":'), F.col("quality").cast("string"), F.lit(',"o":{"x":[1,"2"]}},3,{"text":"s","url":'), F.col("toxic").cast("string"), F.lit(',"flag":true}]}'))
    return t("labels").select("doc_id", F.posexplode(values.external_refs(reply)).alias("at", "r")).select("doc_id", (F.col("at") + 1).alias("place"), "r.title", "r.url", "r.arxiv_id", "r.raw_snippet", "r.metadata")


@query("""SELECT p_partkey, 'See [https://x.org/' || p_partkey || '](https://x.org/' || p_partkey || '). and [Key' || p_partkey || '], by [A et al. (2020)](#bib.b' || p_size || ') end' AS line, p_name || chr(10) || chr(10) || 'b' || chr(10) || '- ' || p_size || chr(10) || chr(10) || 'c' AS block FROM part""")
def markdown_clean(t):
    """Converted Markdown with its addresses linked and without what conversion leaves, and blocks with single gaps."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    line = F.concat(F.lit("See  https://x.org/"), k, F.lit(". and Key"), k, F.lit(" [Key"), k, F.lit("] ,\n by [A  et al.(2020), p. 1](#bib.b"), n, F.lit(") \\citeauthor{x}end "))
    block = F.concat("p_name", F.lit(" \r\n\n\n b \n \n- "), n, F.lit("\n\n\nc\n\n"))
    lines = F.regexp_replace(cleanup.compact(block), r"(?m)^ b", "b")
    return t("part").select("p_partkey", cleanup.clean(line).alias("line"), lines.alias("block"))
