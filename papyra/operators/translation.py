"""Renderings to be made: what becomes of each block of a request, what a reply is worth, and the rows it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.rules import filled, translatable
from papyra.functions.text import casefolded
from papyra.operators.notes import stripped

#: States in which a job is still to be done, and the attempts it has (fixed values).
ACTIVE, ATTEMPTS = ["queued", "running", "paused", "paused_requested"], 3
#: What is cut between an echoed source and its rendering (fixed value).
BETWEEN = r"^[\n\r\t :：\-—–]+"


def echo_removed(source: Column, reply: Column) -> Column:
    """A reply without the source that it repeats at its beginning, unless nothing else would be left or it is all the same."""
    s, r = stripped(F.coalesce(source, F.lit(""))), stripped(F.coalesce(reply, F.lit("")))
    same = lambda a, b: casefolded(F.regexp_replace(a, r"(?U)\s+", " ")) == casefolded(F.regexp_replace(b, r"(?U)\s+", " "))
    rest = stripped(F.regexp_replace(F.regexp_replace(F.substring(r, F.length(s) + 1, F.length(r)), r"^\s+", ""), BETWEEN, ""))
    echoed = (s != "") & F.startswith(r, s) & ~same(s, r) & (rest != "") & ~same(rest, s)
    return F.when(echoed, rest).otherwise(r)


def invariant(source: Column) -> Column:
    """Whether a text stays as it is in any language: without words, or at most four of capitals. A blank one doesn't."""
    shown = F.regexp_replace(F.regexp_replace(stripped(source), r"\[([^\]]+)\]\([^)]*\)", "$1"), "[^A-Za-z0-9]+", " ")
    words = F.regexp_extract_all(shown, F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0))
    return (stripped(source) != "") & ((F.size(words) == 0) | (F.size(words) <= 4) & F.forall(words, lambda w: F.upper(w) == w))


def reply_status(source: Column, reply: Column) -> Column:
    """empty, unchanged_source (unless it is invariant), unbalanced_code_fence, code_fence_count_changed or ok."""
    count = lambda x: F.regexp_count(F.coalesce(x, F.lit("")), F.lit("```"))
    key = lambda x: casefolded(F.regexp_replace(stripped(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "))
    target = stripped(F.coalesce(reply, F.lit("")))
    return (
        F.when(target == "", "empty")
        .when((key(source) == key(target)) & ~invariant(F.coalesce(source, F.lit(""))), "unchanged_source")
        .when(count(target) % 2 != 0, "unbalanced_code_fence")
        .when((count(source) > 0) & (count(source) != count(target)), "code_fence_count_changed")
        .otherwise("ok")
    )


def decided(blocks: DataFrame, cached: DataFrame, jobs: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """blocks (id, kind, text and keys) with decision and job: skipped (nothing to translate), cached, existing (an active job with the same keys, null equal to null) or queued.

    cached: (id) of the blocks with a rendering that still holds; jobs: (job, status, created and keys). force: neither
    counts. Of several jobs the first counts.
    """
    todo = translatable(F.col("kind"), F.col("text"))
    held = cached.select("id", F.lit(True).alias("papyra_held")).distinct()
    first = jobs.where(F.col("status").isin(ACTIVE)).groupBy(*[F.col(k).alias(f"papyra_{k}") for k in keys]).agg(F.min_by("job", F.struct("created", "job")).alias("papyra_job"))
    rows = blocks.join(held, "id", "left").join(first, [F.col(k).eqNullSafe(F.col(f"papyra_{k}")) for k in keys], "left")
    hit, busy = (F.lit(False), F.lit(False)) if force else (F.col("papyra_held").isNotNull(), F.col("papyra_job").isNotNull())
    decision = F.when(~todo, "skipped").when(hit, "cached").when(busy, "existing").otherwise("queued")
    return rows.withColumn("decision", decision).select(*blocks.columns, "decision", F.when(F.col("decision") == "existing", F.col("papyra_job")).alias("job"))


def batch_result(decisions: DataFrame, *group: str) -> DataFrame:
    """group, jobs_created, existing_jobs, cached_blocks, skipped_blocks of decided()."""
    count = lambda d, name: F.count_if(F.col("decision") == d).alias(name)
    return decisions.groupBy(*group).agg(count("queued", "jobs_created"), count("existing", "existing_jobs"), count("cached", "cached_blocks"), count("skipped", "skipped_blocks"))


def outcomes(replies: DataFrame) -> DataFrame:
    """replies (block_id, source, reply, attempt, custom_prompt) with target, status, requeue and remember: whether another attempt is due, and whether the translation memory takes it."""
    rows = replies.withColumn("target", echo_removed(F.col("source"), F.col("reply")))
    rows = rows.withColumn("status", reply_status(F.col("source"), F.col("target")))
    ok = F.col("status") == "ok"
    return rows.withColumns({"requeue": ~ok & (F.col("attempt") < ATTEMPTS), "remember": ok & ~filled(F.col("custom_prompt"))})
