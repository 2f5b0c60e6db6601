"""Percentiles with a bounded relative error from counts in signed logarithmic buckets.

A value x falls into bucket ceil(log(|x|) / log(g)) of its sign, with g = (1 + a) / (1 - a); zero has a bucket of its
own. The middle of a bucket, in the relative sense, is at most the share ``a`` away from every value in it. Counts of
equal buckets add up, so sketches of partitions, days or shares of the rows merge by one sum, and the percentile of any
union is as good as one taken from all rows at once. Rows are reduced to bucket counts before the first shuffle; a
group has as many buckets as the range of its values needs (about 115 per decade at a = 0.01), however many rows it
holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest share by which a reported percentile may differ from the exact one.
RELATIVE_ERROR = 0.01


def ratio(error: float = RELATIVE_ERROR) -> float:
    if not 0 < error < 1:
        raise ValueError("the error is a share between 0 and 1")
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = RELATIVE_ERROR) -> Column:
    """Sign and magnitude of a value as struct<sign int, exp int>; they order as the values do if exp is negated below zero."""
    size = F.abs(value)
    exp = F.when(value == 0, 0).otherwise(F.ceil(F.log(size) / F.lit(math.log(ratio(error))))).cast("int")
    return F.struct(F.signum(value).cast("int").alias("sign"), exp.alias("exp"))


def bucket_value(sign: Column, exp: Column, error: float = RELATIVE_ERROR) -> Column:
    """The value a bucket stands for."""
    g = ratio(error)
    return F.when(sign == 0, F.lit(0.0)).otherwise(sign * F.pow(F.lit(g), exp) * F.lit(2 / (g + 1)))


def log_sketch(df: DataFrame, keys: Sequence[str], value: Column, error: float = RELATIVE_ERROR) -> DataFrame:
    """Rows (keys, sign, exp, n). Null, NaN and infinite values are no measurements; keys may be null.

    An empty table gives an empty sketch. Restrict ``value`` before where negative values are no measurements either.
    """
    kept = df.select(*keys, value.cast("double").alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('Infinity')")
    return kept.select(*keys, bucket(F.col("__v"), error).alias("__b")).groupBy(*keys, F.col("__b.sign").alias("sign"), F.col("__b.exp").alias("exp")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per ``keys`` (a part of the sketch's own keys) by adding the counts of equal buckets."""
    return sketch.groupBy(*keys, "sign", "exp").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketch: DataFrame, keys: Sequence[str], shares: Sequence[float] = (0.5, 0.9, 0.95, 0.99), error: float = RELATIVE_ERROR) -> DataFrame:
    """Per group: ``n``, and p50, p90 ... : the value of rank ceil(share * n), at most ``error`` of itself away.

    The window that adds the counts up holds buckets, not rows.
    """
    order = F.col("sign") * F.col("exp")
    line = Window.partitionBy(*keys).orderBy("sign", order)
    run = sketch.withColumn("__below", F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("n").over(Window.partitionBy(*keys)))
    value = bucket_value(F.col("sign"), F.col("exp"), error)
    at = [F.min(F.when(F.col("__below") >= F.ceil(F.lit(s) * F.col("__all")), F.struct("sign", order.alias("o"), value.alias("v"))))["v"].alias(f"p{100 * s:g}".replace(".", "_")) for s in shares]
    return run.groupBy(*keys).agg(F.max("__all").alias("n"), *at)
