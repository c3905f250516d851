"""How far an object reaches on the detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extent(profile: DataFrame, group: str, order: str, value: str, least: float = 0.02) -> DataFrame:
    """First and last place above the baseline of the outer samples.

    Baseline: the median of the outer max(3, 2 %) samples of each side; threshold: baseline plus the
    larger of ``least`` and six robust deviations.
    """
    size = profile.groupBy(group).agg((F.max(order) + 1).alias("n"))
    edge = F.greatest(F.lit(3), F.rint(0.02 * F.col("n")).cast("int"))
    met = profile.join(size, group).withColumn("outer", (F.col(order) < edge) | (F.col(order) >= F.col("n") - edge))
    base = met.filter("outer").groupBy(group).agg(F.percentile(value, 0.5).alias("base"))
    spread = met.filter("outer").join(base, group).groupBy(group, "base").agg(F.percentile(F.abs(F.col(value) - F.col("base")), 0.5).alias("mad"))
    limit = spread.select(group, (F.col("base") + F.greatest(F.lit(least), 6 * 1.4826 * F.col("mad"))).alias("threshold"))
    above = met.join(limit, group)
    return above.groupBy(group).agg(F.first("threshold").alias("threshold"), F.min(F.when(F.col(value) > F.col("threshold"), F.col(order))).alias("first"), F.max(F.when(F.col(value) > F.col("threshold"), F.col(order))).alias("last"))
