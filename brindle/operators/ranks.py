"""Values at given places of a sorted group, without sorting the group's rows.

Values are counted in buckets that follow their order: the sign, the exponent and the first bits of a double's fraction.
A window over a group's buckets, of which there are some thousands at most, tells which bucket holds each place; only the
rows of those buckets are reduced to their distinct values and placed by a window for each bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets from one power of two to the next; more of them hold fewer rows each.
STEPS = 1024


def order_bucket(value: Column) -> Column:
    """A number that never falls as ``value`` (no NaN) rises, with ``STEPS`` steps from one power of two to the next."""
    size = F.abs(value)
    exponent = F.floor(F.log2(F.when(size > 0, size)))
    step = F.floor(F.least((size / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * STEPS, F.lit(STEPS - 1.0)))
    at = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(1100 * STEPS * 2)).otherwise((exponent + 1100) * STEPS + F.greatest(step, F.lit(0)))
    return F.when(value < 0, -at).otherwise(at).cast("bigint")


def picks(df: DataFrame, group: Sequence[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """Per group: n, mean, max, and for each name the value at index floor(share * n) of the sorted values, from 0.

    Null and NaN values are left out, and groups without others. A share of 1 or more has no value.
    """
    valued = df.select(*group, value.cast("double").alias("v")).where("v is not null and not isnan(v)").withColumn("bucket", order_bucket(F.col("v")))
    counted = valued.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.max("v").alias("m"))
    line = Window.partitionBy(*group)
    run = counted.withColumn("n", F.sum("c").over(line)).withColumn("before", F.sum("c").over(line.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    base = counted.groupBy(*group).agg(F.sum("c").alias("n"), (F.sum("s") / F.sum("c")).alias("mean"), F.max("m").alias("max"))
    place = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(s)).alias("share")) for name, s in shares.items()]))
    asked = run.withColumn("p", place).withColumn("k", F.floor(F.col("p.share") * F.col("n")) - F.coalesce("before", F.lit(0))).where("k >= 0 and k < c").select(*group, "bucket", F.col("p.name").alias("name"), "k")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    within = valued.alias("x").join(asked.alias("y"), [*same("x", "y"), F.col("x.bucket") == F.col("y.bucket")]).groupBy(*[F.col(f"x.{c}").alias(c) for c in group], "x.bucket", "name", "k", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group, "bucket", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = within.withColumn("upto", upto).where("upto > k").groupBy(*group).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
    return base.alias("x").join(found.alias("y"), same("x", "y"), "left").select(*[F.col(f"x.{c}").alias(c) for c in group], "x.n", "x.mean", *shares, "x.max")
