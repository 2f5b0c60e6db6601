"""Totals and averages over trailing periods of days, days without activity included.

Every daily total is exploded onto each output day it influences and summed there; a calendar of each entity's days
is joined for the days that nothing influences. Rows are pre-aggregated to entity and day before the first shuffle, so
an entity that holds a third of all rows costs each task one row per day. The work after it depends on entities times
days only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rolling_totals(df: DataFrame, entity: Column, time: Column, value: Column, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and day from the entity's first to its last day.

    ``rows`` counts the day's rows and ``total`` sums their values. For each period of n days ending with the day:
    ``total_n``; ``avg_n``, the total divided by n, so days without activity count as zero; ``rows_n`` and
    ``avg_row_n``, the total per row that has a value (null if there is none). Rows whose entity or time is null are
    left out; null values add nothing but their row counts; repeated rows count as often as they occur. An empty table
    gives an empty result. Other columns of ``df`` are ignored, whatever their names.
    """
    spans = sorted({int(n) for n in periods})
    if not spans or spans[0] < 1:
        raise ValueError("periods are whole days of 1 or more")
    daily = (
        df.select(entity.alias("entity"), F.to_date(time).alias("day"), value.alias("value"))
        .where("entity is not null and day is not null")
        .groupBy("entity", "day")
        .agg(F.coalesce(F.sum("value"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("rows"), F.count("value").alias("valued"))
    )
    reach = daily.select("*", F.posexplode(F.expr(f"sequence(day, date_add(day, {spans[-1] - 1}))")).alias("ago", "out"))
    sums = [F.sum(F.when(F.col("ago") == 0, F.col(c)).otherwise(0)).alias(c) for c in ("rows", "total")]
    for n in spans:
        sums += [F.sum(F.when(F.col("ago") < n, F.col(c)).otherwise(0)).alias(f"{c}_{n}") for c in ("total", "rows", "valued")]
    influence = reach.groupBy("entity", F.col("out").alias("day")).agg(*sums)
    # Whole rows are compared, so that this branch reads the same columns and Spark reuses the exchange of ``daily``.
    row = F.struct("day", "total", "rows", "valued")
    ends = daily.groupBy("entity").agg(F.min(row)["day"].alias("a"), F.max(row)["day"].alias("b"))
    calendar = ends.select("entity", F.explode(F.expr("sequence(a, b)")).alias("day"))
    filled = calendar.join(influence, ["entity", "day"], "left").na.fill(0)
    out = ["entity", "day", "rows", "total"]
    for n in spans:
        total, valued = F.col(f"total_{n}"), F.col(f"valued_{n}")
        out += [f"rows_{n}", f"total_{n}", (total / F.lit(float(n))).alias(f"avg_{n}"), F.when(valued > 0, total / valued).alias(f"avg_row_{n}")]
    return filled.select(*out)


def silent_days(rolled: DataFrame, period: int = 7) -> DataFrame:
    """Of ``rolling_totals``, the days without a row whose period still holds one."""
    return rolled.where((F.col("rows") == 0) & (F.col(f"rows_{period}") > 0))
