"""Rankings of several retrievers or indexes made into one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def rank_within(df: DataFrame, group: Sequence[str], score: str, key: str) -> DataFrame:
    """Adds ``rank`` from 1 within each group: higher scores first, then smaller keys."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), key)))


def reciprocal_rank_fusion(ranked: Sequence[tuple[DataFrame, float]], group: Sequence[str], key: str) -> DataFrame:
    """Sum of weight / (60 + rank) per group and key over all rankings that hold the key.

    Rankings are added up by one aggregation, which is what their full outer joins come to.
    """
    parts = None
    for k, (df, weight) in enumerate(ranked):
        part = df.select(*group, key, (F.lit(float(weight)) / (RRF + F.col("rank"))).alias("part"), F.lit(k).alias("source"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*group, key).agg(F.round(F.sum("part"), 8).alias("rrf_score"), F.countDistinct("source").alias("sources"))


def min_max(df: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """Adds ``normalized``: scores between 0 and 1 within each group; 1 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("normalized", F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))
