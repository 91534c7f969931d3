"""LaTeX in small: the main file of an archive, and layout of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stems of main files, and commands that speak for one (fixed values).
MAIN_STEMS = ["main", "paper", "article", "ms", "manuscript", "source", "submission", "arxiv"]
MAIN_COMMANDS = ["\\title", "\\author", "\\maketitle", "\\abstract", "\\bibliography"]
#: Score from which a file counts as a main one (fixed value).
MAIN_LEAST = 20


def main_file_score(path: Column, content: Column) -> Column:
    """How likely a TeX file is an archive's main one: points for what it begins with, its name and its front matter, and 20 off where no document begins."""
    has = lambda part: F.contains(content, F.lit(part))
    points = lambda test, n: F.when(test, n).otherwise(0)
    name = F.lower(F.substring_index(path, "/", -1))
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.when(suffix == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))
    begins = has(r"\begin{document}")
    score = points(has(r"\documentclass"), 12) + points(has(r"\documentstyle"), 12) + points(begins, 12)
    score += points(stem.isin(MAIN_STEMS), 4) + points(name.rlike(r"^\d{7}(v\d+)?$"), 4)
    score += F.when(suffix == ".tex", 2).when(suffix.isin("", ".ltx", ".latex"), 1).otherwise(0)
    score += sum((points(has(c), 1) for c in MAIN_COMMANDS), F.lit(0))
    return score - points(~(content.rlike(r"\\(documentclass|documentstyle)\b") & begins), 20)


def main_files(files: DataFrame, archive: str, path: str, content: str) -> DataFrame:
    """archive, path, score of each archive's main file: the highest score from MAIN_LEAST, then the shortest path. Contents aren't shuffled."""
    scored = files.select(archive, path, main_file_score(F.col(path), F.col(content)).alias("score")).where(F.col("score") >= MAIN_LEAST)
    best = scored.groupBy(archive).agg(F.min_by(F.struct(path, "score"), F.struct(-F.col("score"), F.length(path), path)).alias("best"))
    return best.select(archive, f"best.{path}", "best.score")


def page_layout(images: Column, flexible: Column, panel: Column, width: Column, height: Column) -> Column:
    """multi-panel, double-column, single-column or null, by the number of images, a flexible arrangement, the widest panel in points and the proportions."""
    by_panel = F.when(panel >= 330, "double-column").otherwise("single-column")
    return F.when((images > 1) | flexible, "multi-panel").when(panel.isNotNull(), by_panel).when((width > 0) & (height > 0) & (width / height >= 1.45), "double-column")


def capabilities(model: Column) -> Column:
    """What a model's name says it can do."""
    name = F.lower(model)
    embeds = name.rlike("embed|bge|e5-")
    return F.array_compact(F.array(F.when(embeds, "embedding"), F.when(~embeds & ~name.rlike("whisper|tts|dall|rerank|moderation"), "chat"), F.when(name.rlike("vision|-vl|4o|gemini"), "vision")))
