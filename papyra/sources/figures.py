"""What the environments of converted papers show: images with sizes and panel widths, their layout, and images that a sibling XML names."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.latex import page_layout
from papyra.sources.tree import FILE_KEYS, IDS, classed, classes, files, page_tree, tops, xml_tree

#: Elements that are images, environments that hold them, and names under which an element has its id (fixed values).
IMAGES, FLOATS, ID_KEYS = ("img", "image", "object"), ("figure", "table", "algorithm"), ("id", "xml:id")
#: Widths in points within a style or within the options of a graphic, leading numbers, and classes that arrange panels (fixed values).
STYLE_WIDTH, OPTION_WIDTH = re.compile(r"\bwidth\s*:\s*([0-9.]+)\s*pt\b", re.I), re.compile(r"(?:^|,)\s*width\s*=\s*([0-9.]+)\s*pt\b")
LEADING, FLEX = re.compile(r"\s*([0-9.]+)"), re.compile(r"\bltx_flex_(?:figure|cell|size_)")
#: Where a graphic's file is named in the XML, the first that is given (fixed values).
GRAPHIC_KEYS = ("graphic", "candidates")

IMAGE = "struct<place: int, element: string, reference: string, width: double, height: double, panel_pt: double, origin: string>"
COLUMNS = f"block_uid string, block_type string, label string, flexible boolean, files array<string>, style_widths array<double>, images array<{IMAGE}>"


def _number(pattern: re.Pattern, text: str | None) -> float | None:
    """The positive number that a pattern finds, None for anything else."""
    if not text:
        return None
    found = pattern.match(text) if pattern is LEADING else pattern.search(text)
    try:
        value = float(found[1]) if found else 0.0
    except ValueError:  # such as 1.2.3
        return None
    return value if value > 0 else None


def identifier(e: ET.Element) -> str | None:
    return next((e.get(k) for k in ID_KEYS if e.get(k)), None)


def images_of(e: ET.Element) -> list[tuple]:
    """IMAGE of every image within an element, in order: its own width and height, and the width of the panel it stands in, which a style gives to all below it until a nearer one does.

    origin: own, where the image's style has the width, inherited, where one around it has, else null.
    """
    found, todo = [], [(e, None)]
    while todo:
        x, around = todo.pop()
        own = _number(STYLE_WIDTH, x.get("style"))
        panel = around if own is None else own
        if x.tag in IMAGES:
            name = next((x.get(k).strip() for k in FILE_KEYS if x.get(k)), None)
            origin = "own" if own is not None else None if panel is None else "inherited"
            found.append((len(found) + 1, identifier(x), name or None, _number(LEADING, x.get("width")), _number(LEADING, x.get("height")), panel, origin))
        else:
            todo.extend((c, panel) for c in reversed(x))
    return found


def environments(html: str | None) -> Iterator[tuple]:
    """COLUMNS of each figure, table and algorithm of a page, numbered as blocks are."""
    counts = Counter()
    for kind, e in tops(page_tree(html)):
        if kind in FLOATS:
            counts[kind] += 1
            prefix, width = IDS[kind]
            widths = [w for w in (_number(STYLE_WIDTH, x.get("style")) for x in e.iter()) if w is not None]
            flexible = any(FLEX.search(classes(x)) for x in classed(e))
            yield f"{prefix}-{counts[kind]:0{width}}", kind, e.get("id") or e.get("label") or None, flexible, files(e), widths, images_of(e)


def document_figures(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id and COLUMNS of each environment of converted papers; a page is parsed in one call and nothing is shuffled. Null and empty pages have none."""
    names = ["papyra_key", "block_uid", "block_type", "label", "flexible", "files", "style_widths", "images"]
    image = {"place": pa.int32(), "element": pa.string(), "reference": pa.string(), "width": pa.float64(), "height": pa.float64(), "panel_pt": pa.float64(), "origin": pa.string()}
    kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.float64())]

    def columns(rows: list[tuple], size: int, types: list[pa.DataType]) -> list[pa.Array]:
        return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * size, types, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [(at, row) for at, html in enumerate(part.column(1).to_pylist()) for row in environments(html)]
                images = [x for _, row in found for x in row[-1]]
                parts = pa.StructArray.from_arrays(columns(images, len(image), list(image.values())), list(image))
                ends = pa.array(np.cumsum([0, *(len(row[-1]) for _, row in found)]), pa.int32())
                rest = columns([row[:-1] for _, row in found], len(kinds), kinds)
                yield pa.record_batch([part.column(0).take(pa.array([at for at, _ in found], pa.int64())), *rest, pa.ListArray.from_arrays(ends, parts)], names)

    kind = pages.schema[id_col].dataType.simpleString()
    found = pages.select(F.col(id_col).alias("papyra_key"), F.col(html_col).cast("string").alias("papyra_html")).mapInArrow(run, f"papyra_key {kind}, {COLUMNS}")
    return found.withColumnRenamed("papyra_key", id_col)


def image_rows(figures: DataFrame, id_col: str) -> DataFrame:
    """id, block_uid, block_type and the fields of each image of environments."""
    return figures.select(id_col, "block_uid", "block_type", F.inline("images"))


def _three(value: Column) -> Column:
    return F.bround(value, 3)


def with_layout(figures: DataFrame) -> DataFrame:
    """Environments with image_count, image_width, image_height, max_panel_pt, total_panel_pt, display_pt and layout.

    Panels are those of images; without any, all widths that styles give. Several images in a flexible arrangement are shown
    as wide as all panels, others as wide as the widest one, and without panels as wide as the first image.
    """
    panels = F.filter(F.transform("images", lambda x: x["panel_pt"]), lambda x: x.isNotNull())
    panels = F.when(F.size(panels) > 0, panels).otherwise(F.col("style_widths"))
    first = lambda name: F.get(F.transform("images", lambda x: x[name]), F.lit(0))
    rows = figures.withColumns({"image_count": F.greatest(F.size("files"), F.size("images")), "papyra_panels": panels, "image_width": first("width"), "image_height": first("height")})
    rows = rows.withColumns({"max_panel_pt": F.array_max("papyra_panels"), "total_panel_pt": F.when(F.size("papyra_panels") > 0, F.aggregate("papyra_panels", F.lit(0.0), lambda a, x: a + x))})
    wide = F.when((F.col("image_count") > 1) & F.col("flexible"), F.col("total_panel_pt")).otherwise(F.col("max_panel_pt"))
    layout = page_layout(F.col("image_count"), F.col("flexible"), F.col("max_panel_pt"), F.col("image_width"), F.col("image_height"))
    rows = rows.withColumns({"display_pt": _three(F.coalesce(wide, F.col("image_width"))), "layout": layout})
    return rows.withColumns({c: _three(F.col(c)) for c in ("max_panel_pt", "total_panel_pt")})


def file_rows(figures: DataFrame, id_col: str) -> DataFrame:
    """id, block_uid, place, file, width, height, panel_pt, group_pt, siblings, layout, matched of each file that an environment names.

    Files take the sizes of the image at the same place, and panels in their order; matched: whether that image names the file.
    """
    at = F.col("place") - 1
    of = lambda name: F.get(F.transform("images", lambda x: x[name]), at)
    rows = with_layout(figures).select("*", F.posexplode("files").alias("papyra_at", "file")).withColumn("place", F.col("papyra_at") + 1)
    group = F.coalesce("total_panel_pt", "display_pt")
    group = F.when(group > 0, group)
    siblings = F.when(group.isNotNull(), F.size("files"))
    return rows.select(id_col, "block_uid", "place", "file", of("width").alias("width"), of("height").alias("height"), _three(F.get("papyra_panels", at)).alias("panel_pt"), group.alias("group_pt"), siblings.alias("siblings"), "layout", F.coalesce(of("reference") == F.col("file"), F.lit(False)).alias("matched"))


def graphics(documents: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """id, element, reference, width_pt of the graphics that an XML beside a page describes: those with an id and a file. The last of an id counts; text that isn't XML has none."""

    def of(text: str | None) -> dict[str, tuple]:
        found, root = {}, xml_tree(text)
        for e in () if root is None else root.iter("graphics"):
            words = next((e.get(k).split() for k in GRAPHIC_KEYS if (e.get(k) or "").strip()), [""])
            if identifier(e) and words[0].removeprefix("./"):
                found[identifier(e)] = (words[0].removeprefix("./"), _number(OPTION_WIDTH, e.get("options")))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, element, *x) for key, text in zip(batch["papyra_key"], batch["papyra_xml"], strict=True) for element, x in of(text).items()]
            yield pd.DataFrame(rows, columns=["papyra_key", "element", "reference", "width_pt"])

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("papyra_key"), F.col(xml_col).alias("papyra_xml")).mapInPandas(run, f"papyra_key {kind}, element string, reference string, width_pt double")
    return rows.withColumnRenamed("papyra_key", id_col)


def hydrated(images: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    """image_rows() with the files and widths that graphics() knows for images without a file, by element; `source` says where a file's name is from.

    A width is taken only where the image's own style has none.
    """
    known = named.select(id_col, "element", F.col("reference").alias("papyra_reference"), F.col("width_pt").alias("papyra_width"))
    rows = images.join(known, [id_col, "element"], "left")
    bare = F.col("reference").isNull() & F.col("papyra_reference").isNotNull()
    wider = bare & F.col("papyra_width").isNotNull() & ~F.coalesce(F.col("origin") == "own", F.lit(False))
    source = F.when(F.col("reference").isNotNull(), "page").when(bare, "xml")
    new = {"source": source, "panel_pt": F.when(wider, F.col("papyra_width")).otherwise(F.col("panel_pt")), "origin": F.when(wider, "own").otherwise(F.col("origin")), "reference": F.coalesce("reference", "papyra_reference")}
    return rows.withColumns(new).select(*images.columns, "source")
