"""The relational layer: listings, roll-ups, work finding, snapshots and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(rows: DataFrame, **values) -> DataFrame:
    """Rows that equal every value given; a list stands for any of its items, None for no condition."""
    for name, value in values.items():
        if value is not None:
            rows = rows.where(F.col(name).isin(value) if isinstance(value, list) else F.col(name) == value)
    return rows


def with_counts(parents: DataFrame, key: str, **children: tuple[DataFrame, str]) -> DataFrame:
    """Parents with the number of each kind of child, 0 where there are none; children are counted before they are joined."""
    for name, (rows, child_key) in children.items():
        counts = rows.groupBy(F.col(child_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
        parents = parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def translation_state(items: Column, done: Column, running: Column, failed: Column) -> Column:
    """The state of a group of items, by tests in this order."""
    return F.when(items == 0, "not_required").when(done >= items, "translated").when(running > 0, "translating").when(failed > 0, "failed").when(done > 0, "partial").otherwise("not_started")


def missing(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The items without a row in `done`."""
    return items.join(done.select(key), key, "left_anti")


def chosen(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("papyra_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("papyra_n = 1").drop("papyra_n")


def unique_by(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """key, id of the keys that one row alone has."""
    return rows.groupBy(key.alias("key")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def repeated(rows: DataFrame, key: Column) -> DataFrame:
    """key, n of the keys that several rows have."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def reconciled(old: DataFrame, new: DataFrame, uid: str, content: str) -> DataFrame:
    """uid, new_uid, fate of each old item: kept (same id and content), edited (same id), moved (its content, unique in both, has another id now) or gone."""
    by_id = new.select(F.col(uid).alias("same_id"), F.col(content).alias("now"))
    once = lambda rows, name: rows.groupBy(content).agg(F.count(F.lit(1)).alias("n"), F.min(uid).alias(name)).where("n = 1").drop("n")
    unique = once(old, "only_old").join(once(new, "moved_to"), content).select(content, "moved_to")
    joined = old.join(by_id, old[uid] == by_id["same_id"], "left").join(unique, content, "left")
    fate = F.when(F.col("now") == F.col(content), "kept").when(F.col("moved_to").isNotNull() & (F.col("moved_to") != F.col(uid)), "moved").when(F.col("same_id").isNotNull(), "edited").otherwise("gone")
    return joined.withColumn("fate", fate).select(uid, F.when(F.col("fate") == "moved", F.col("moved_to")).when(F.col("fate") != "gone", F.col(uid)).alias("new_uid"), "fate")


def upserted(old: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The next snapshot: of every key the row of the highest version, changes before old rows of the same version."""
    both = old.withColumn("papyra_new", F.lit(0)).unionByName(changes.withColumn("papyra_new", F.lit(1)))
    return chosen(both, keys, [F.desc(version), F.desc("papyra_new")]).drop("papyra_new")


def merged_update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """old with the values that changes give; null keeps what is there, new keys are added."""
    names = [c for c in old.columns if c != key]
    both = old.join(changes.select(key, *[F.col(c).alias(f"papyra_{c}") for c in names]), key, "full_outer")
    return both.select(key, *[F.coalesce(f"papyra_{c}", c).alias(c) for c in names])


def cascade(gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """What is left of each child table when the parents in `gone` are deleted."""
    return [rows.join(gone.select(F.col(key).alias(name)), name, "left_anti") for rows, name in children]


def single_default(rows: DataFrame, group: list[str], id_col: str, chosen_id, flag: str) -> DataFrame:
    """rows with the flag set on one row and cleared on the others of its group."""
    target = rows.where(F.col(id_col) == F.lit(chosen_id)).select(*[F.col(c).alias(f"papyra_{c}") for c in group]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"papyra_{c}")) for c in group]
    joined = rows.join(F.broadcast(target), same, "left")  # one group at most
    inside = F.col(f"papyra_{group[0]}").isNotNull()
    return joined.withColumn(flag, F.when(F.col(id_col) == F.lit(chosen_id), True).when(inside, False).otherwise(F.col(flag))).drop(*[f"papyra_{c}" for c in group])


def both_differences(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """Rows that one side alone has, or has more often, with the side: both sides are counted in one aggregation, null equal to null."""
    side = lambda rows, sign: rows.select(*expected.columns).withColumn("papyra_sign", F.lit(sign))
    sums = side(expected, 1).unionByName(side(returned, -1)).groupBy(*expected.columns).agg(F.sum("papyra_sign").alias("papyra_sum")).where("papyra_sum <> 0")
    rows = sums.select(*expected.columns, F.when(F.col("papyra_sum") > 0, "missing").otherwise("unexpected").alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("papyra_sum"))).alias("papyra_n"))
    return rows.drop("papyra_n")


def first_spellings(rows: DataFrame, text: Column, place: str, most: int = 80) -> DataFrame:
    """text, place of the first spelling of each folded text, in order, `most` of them."""
    from papyra.functions.text import collapse, fold

    clean = rows.select(collapse(text).alias("text"), place).where("text <> ''")
    first = clean.groupBy(fold(F.col("text")).alias("papyra_key")).agg(F.min_by("text", F.col(place)).alias("text"), F.min(place).alias(place))
    return first.select("text", place).orderBy(place).limit(most)


def memory_hits(items: DataFrame, memory: DataFrame, keys: list[str], null_safe: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Each item's best entry in a memory, by keys that are equal and keys that may both be null."""
    on = [F.col(f"i.{k}") == F.col(f"m.{k}") for k in keys] + [F.col(f"i.{k}").eqNullSafe(F.col(f"m.{k}")) for k in null_safe]
    return chosen(items.alias("i").join(memory.alias("m"), on).select(F.col(f"i.{id_col}").alias("papyra_id"), "m.*"), ["papyra_id"], order).withColumnRenamed("papyra_id", "item_id")


#: Tables of this many files or more stay where they are.
FEW = 8


def dealt(rows: DataFrame) -> DataFrame:
    """The same rows, dealt out over all cores if they lie in a few files, less than FEW and less than cores; for work that takes longer for a row than moving it.

    A file may be a single row group, which one task reads. Larger tables have more files and aren't moved; columns and
    filters reach the scan in either case.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < min(cores, FEW) else rows
