"""Converted papers made from orders and their lines: a figure each, with nested panels, and a sibling XML that names what the page lacks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import texmath
from papyra.plans.registry import query
from papyra.sources import figures


def papers(t):
    """page_id, html, xml: of each order a figure whose panels are its lines; every other page isn't well-formed."""
    part, w = F.col("l_partkey").cast("string"), F.col("w").cast("string")
    place = F.col("place").cast("string")
    img = lambda more: F.concat(F.lit('<img id="i'), place, F.lit('" src="p'), part, F.lit(f'.png" {more}width="'), F.col("l_suppkey").cast("string"), F.lit('px" height="'), w, F.lit('"/>'))
    panel = F.concat(F.lit('<div style="color: red; width: '), w, F.lit('.5pt"><span>'), img(""), F.lit("</span></div>"))
    own = F.concat(F.lit('<img id="i'), place, F.lit('" src="p'), part, F.lit('.png" style="width:'), w, F.lit('pt;" width="'), F.col("l_suppkey").cast("string"), F.lit('px" height="'), w, F.lit('"/>'))
    bare = F.concat(F.lit('<img id="i'), place, F.lit('"/>'))
    line = F.when(F.col("l_partkey") % 4 == 0, panel).when(F.col("l_partkey") % 4 == 1, own).when(F.col("l_partkey") % 4 == 2, img("")).otherwise(bare)
    graphic = F.concat(F.lit('<graphics xml:id="i'), place, F.lit('" graphic="./g'), part, F.lit('.pdf rest" options="scale=1,width='), w, F.lit('pt"/>'))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = t("lineitem").withColumn("w", F.col("l_quantity").cast("int")).withColumn("place", F.row_number().over(order))
    lines = lines.select("l_orderkey", F.struct("place", line.alias("line"), graphic.alias("graphic")).alias("x"))
    own_lines = lines.groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    key = F.col("page_id")
    style = F.when(key % 5 == 0, F.lit(' style="width:400pt"')).otherwise(F.lit(""))
    flex = F.when(key % 3 == 0, F.lit(" ltx_flex_figure")).otherwise(F.lit(""))
    loose = F.when(key % 2 == 0, F.lit("<br>")).otherwise(F.lit(""))
    body = F.array_join(F.transform("xs", lambda x: x["line"]), "")
    html = F.concat(F.lit("<html><body>"), loose, F.lit('<figure id="F'), key.cast("string"), F.lit('" class="ltx_figure'), flex, F.lit('"'), style, F.lit(">"), body, F.lit("<figcaption>Figure 1: panels</figcaption></figure></body></html>"))
    xml = F.concat(F.lit('<document xmlns="http://example.org/paper">'), F.array_join(F.transform("xs", lambda x: x["graphic"]), ""), F.lit("</document>"))
    return own_lines.select("page_id", html.alias("html"), xml.alias("xml"))


L = """l AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INTEGER AS place, 'i' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS element, l_partkey % 4 AS k, l_quantity::INTEGER AS w,
  CASE WHEN l_partkey % 4 < 3 THEN 'p' || l_partkey || '.png' END AS reference, CASE WHEN l_partkey % 4 < 3 THEN nullif(l_suppkey, 0)::DOUBLE END AS width, CASE WHEN l_partkey % 4 < 3 THEN l_quantity::INTEGER::DOUBLE END AS height,
  CASE l_partkey % 4 WHEN 0 THEN l_quantity::INTEGER + 0.5 WHEN 1 THEN l_quantity::INTEGER ELSE CASE WHEN l_orderkey % 5 = 0 THEN 400 END END::DOUBLE AS panel_pt,
  CASE l_partkey % 4 WHEN 0 THEN 'inherited' WHEN 1 THEN 'own' ELSE CASE WHEN l_orderkey % 5 = 0 THEN 'inherited' END END AS origin, 'g' || l_partkey || '.pdf' AS graphic FROM lineitem)"""
F_ = f"""{L}, f AS (SELECT page_id, count(*)::INTEGER AS image_count, page_id % 3 = 0 AS flexible, min_by(coalesce(width, -1), place) AS w1, min_by(coalesce(height, -1), place) AS h1, max(panel_pt) AS max_panel_pt, sum(panel_pt) AS total_panel_pt,
  list(panel_pt ORDER BY place) FILTER (WHERE panel_pt IS NOT NULL) AS panels, list(reference ORDER BY place) FILTER (WHERE reference IS NOT NULL) AS files FROM l GROUP BY 1),
y AS (SELECT page_id, image_count, flexible, CASE WHEN w1 > 0 THEN w1 END AS image_width, CASE WHEN h1 > 0 THEN h1 END AS image_height, max_panel_pt, total_panel_pt, panels, files,
  coalesce(CASE WHEN image_count > 1 AND flexible THEN total_panel_pt ELSE max_panel_pt END, CASE WHEN w1 > 0 THEN w1 END) AS display_pt,
  CASE WHEN image_count > 1 OR flexible THEN 'multi-panel' WHEN max_panel_pt IS NOT NULL THEN CASE WHEN max_panel_pt >= 330 THEN 'double-column' ELSE 'single-column' END WHEN w1 > 0 AND h1 > 0 AND w1 / h1 >= 1.45 THEN 'double-column' END AS layout FROM f)"""


@query(f"WITH {L} SELECT page_id, 'fig-0001' AS block_uid, 'figure' AS block_type, place, element, reference, width, height, panel_pt, origin FROM l")
def figure_images(t):
    """Images of figures with their sizes and the panels they stand in."""
    return figures.image_rows(figures.document_figures(papers(t), "page_id", "html"), "page_id")


@query(f"WITH {F_} SELECT page_id, image_count, image_width, image_height, max_panel_pt, total_panel_pt, display_pt, layout FROM y")
def figure_layouts(t):
    """Layout of figures by their images and panels."""
    rows = figures.with_layout(figures.document_figures(papers(t), "page_id", "html"))
    return rows.select("page_id", "image_count", "image_width", "image_height", "max_panel_pt", "total_panel_pt", "display_pt", "layout")


@query(f"""WITH {F_}, n AS (SELECT page_id, layout, panels, coalesce(total_panel_pt, display_pt) AS group_pt, len(files)::INTEGER AS siblings, unnest(files) AS file, unnest(range(1, len(files) + 1))::INTEGER AS place FROM y WHERE files IS NOT NULL)
SELECT page_id, place, file, l.width, l.height, panels[place] AS panel_pt, group_pt, CASE WHEN group_pt IS NOT NULL THEN siblings END AS siblings, layout, coalesce(l.reference = file, false) AS matched FROM n LEFT JOIN l USING (page_id, place)""")
def figure_files(t):
    """Files of figures with the sizes and panels that their places give them."""
    return figures.file_rows(figures.document_figures(papers(t), "page_id", "html"), "page_id").drop("block_uid")


@query(f"WITH {L} SELECT page_id, place, coalesce(reference, graphic) AS reference, CASE WHEN k = 3 THEN w ELSE panel_pt END::DOUBLE AS panel_pt, CASE WHEN k = 3 THEN 'own' ELSE origin END AS origin, CASE WHEN k = 3 THEN 'xml' ELSE 'page' END AS source FROM l")
def figure_hydrated(t):
    """Images whose file only the sibling XML names, with that file and its width."""
    rows = papers(t)
    images = figures.image_rows(figures.document_figures(rows, "page_id", "html"), "page_id")
    return figures.hydrated(images, figures.graphics(rows, "page_id", "xml"), "page_id").select("page_id", "place", "reference", "panel_pt", "origin", "source")


#: Formulas with a number x in them, and what becomes of them.
FORMULAS = [
    (r"\mbox{if $x_{#}$ is}\mathds R", r"\text{if }x_{#}\text{ is}\mathbb{R}"), (r"\begin{eqnarray*}a_#\\[2pt]b\end{eqnarray*}\label{eq:#}", r"\begin{aligned}a_#\\b\end{aligned}"),
    (r"\cancelto{0}{\ensuremath{#}}+{\rm max}", r"\overset{0}{#}+\mathrm{max}"), (r"\buildrel #\over= \textsc{ab}", r"\buildrel #\over= \text{AB}"), (r"\big{(}\eqref{#}\raisebox{1pt}[2pt]{$#$}\cr\iddots", r"\big((\text{?})#\\\ddots"),
]


@query("WITH f AS (SELECT k, tex FROM (VALUES " + ", ".join(f"({k}, '{want}')" for k, (_, want) in enumerate(FORMULAS)) + ") x(k, tex)) SELECT p_partkey, replace(tex, '#', p_size::VARCHAR) AS tex FROM part JOIN f ON k = p_partkey % 5")
def math_rules(t):
    """Formulas after the rules for commands, by part."""
    k = F.col("p_partkey") % len(FORMULAS)
    tex = F.get(F.array(*[F.lit(x) for x, _ in FORMULAS]), k.cast("int"))
    return t("part").select("p_partkey", texmath.math(F.replace(tex, F.lit("#"), F.col("p_size").cast("string"))).alias("tex"))
