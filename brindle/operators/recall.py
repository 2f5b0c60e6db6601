"""Earlier questions that resemble a new one, by what they begin with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _runs(text: str, n: int) -> Column:
    """All runs of ``n`` characters."""
    length = F.length(text)
    every = F.transform(F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n)))
    return F.when(length >= n, every).otherwise(F.array().cast("array<string>"))


def recalled(asked: DataFrame, known: DataFrame, asked_id: str, asked_text: str, known_text: str, known_id: str, leads: Sequence[int], most: int) -> DataFrame:
    """Rows (asked_id, known_id, class, place): for each asked text its ``most`` best known ones, newest (highest id) first within a class.

    Class 1 is the same text; class 1 + k holds the first ``leads[k - 1]`` characters of the asked one, or all of a
    shorter one, anywhere. Known texts are cut into their runs of just the lengths that leads have, so each lead meets
    the texts that hold it by an equal key. Empty asked texts recall nothing.
    """
    lead = F.explode(F.array(*[F.struct(F.lit(k + 2).alias("class"), F.substring(asked_text, 1, n).alias("lead")) for k, n in enumerate(leads)]))
    wanted = asked.where(F.length(asked_text) > 0).select(asked_id, asked_text, lead.alias("l")).select(asked_id, asked_text, "l.class", "l.lead", F.length("l.lead").alias("n"))
    sizes = [r.n for r in wanted.select("n").distinct().collect()]  # at most as many as the longest lead has characters
    if not sizes:
        sizes = [1]
    grams = known.select(known_id, F.explode(F.array_distinct(F.concat(*[_runs(known_text, n) for n in sizes]))).alias("lead"))
    # Of a lead's texts only the newest can be among the best: those that are in a better class fill the places themselves.
    newest = grams.join(wanted.select("lead").distinct(), "lead", "left_semi").withColumn("age", F.row_number().over(Window.partitionBy("lead").orderBy(F.desc(known_id)))).where(F.col("age") <= most)
    same = asked.where(F.length(asked_text) > 0).join(known, F.col(asked_text) == F.col(known_text)).select(asked_id, known_id, F.lit(1).alias("class"))
    met = same.unionByName(wanted.join(newest, "lead").select(asked_id, known_id, "class"))
    best = met.groupBy(asked_id, known_id).agg(F.min("class").alias("class"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy(asked_id).orderBy("class", F.desc(known_id)))).where(F.col("place") <= most)
