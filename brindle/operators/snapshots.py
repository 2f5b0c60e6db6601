"""Differences of two snapshots of files, merging of changes, and rows that a later one replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(base: DataFrame, compare: DataFrame, path: str = "path", hash_: str = "hash") -> DataFrame:
    """Rows (path, status, moved_from): 'unchanged', 'changed', 'deleted', 'moved' or 'added'.

    A path that only ``compare`` has is 'moved' if ``base`` has a file of the same non-empty hash; of several, the
    greatest path is named. Paths are unique on either side.
    """
    b = base.select(F.col(path).alias("path"), F.col(hash_).alias("old"), F.lit(True).alias("in_base"))
    c = compare.select(F.col(path).alias("path"), F.col(hash_).alias("new"), F.lit(True).alias("in_compare"))
    both = b.join(c, "path", "full_outer")
    by_hash = b.where("old is not null and old <> ''").groupBy(F.col("old").alias("new")).agg(F.max("path").alias("origin"))
    found = both.join(by_hash, "new", "left")
    status = (
        F.when(F.col("in_compare").isNull(), "deleted").when(F.col("in_base").isNotNull(), F.when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")).when(F.col("origin").isNotNull(), "moved").otherwise("added")
    )
    return found.select("path", status.alias("status"), F.when(F.col("in_base").isNull(), F.col("origin")).alias("moved_from"))


def latest(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the last in ``order``. The rows are compared where they are, before the shuffle."""
    columns = [F.col(c) for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])).alias("row"))
    return best.select(*key, "row.*")


def merge(current: DataFrame, changes: DataFrame, key: Sequence[str], deleted: str | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` put in by key; those marked in ``deleted`` leave no row."""
    kept = current.join(changes.select(*key).distinct(), list(key), "left_anti")
    new = changes.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else changes
    return kept.unionByName(new.select(*current.columns))


def runs(df: DataFrame, group: Sequence[str], same: Sequence[str], *order: str) -> DataFrame:
    """Consecutive rows of a group that agree in ``same``: rows (group, same, run_no, rows, first and last of ``order``)."""
    line = Window.partitionBy(*group).orderBy(*order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(line))
    starts = F.when((F.row_number().over(line) == 1) | changed, 1).otherwise(0)
    numbered = df.withColumn("starts", starts).withColumn("run_no", F.sum("starts").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run_no", *same).agg(F.count(F.lit(1)).alias("rows"), F.min(order[-1]).alias("first"), F.max(order[-1]).alias("last"))
