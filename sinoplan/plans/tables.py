"""The given tables in the roles of scan data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Neighbouring keys that one task puts in order.
LOT = 1 << 16


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """The place (from 0) of each row in its group by an integer key, without sorting a group in one task.

    Rows are put in order within lots of ``LOT`` neighbouring keys; how many rows come before a lot is
    a running sum over counts, one row a lot.
    """
    rows = df.withColumn("__lot", F.floor(F.col(order) / LOT))
    counts = rows.groupBy(group, "__lot").agg(F.count("*").alias("__m"))
    before = Window.partitionBy(group).orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__lot", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(group, "__lot").orderBy(order))
    return rows.withColumn("__i", within).join(starts, [group, "__lot"]).withColumn(out, (F.col("__start") + F.col("__i") - 1).cast("int")).drop("__lot", "__i", "__start")


def vectors(spark, sf_dir: str) -> DataFrame:
    """The vectors with the frame k (label) and row b (place in its label) that they stand for."""
    return ranked(read(spark, sf_dir, "embeddings").withColumn("k", F.col("label").cast("int")), "k", "vec_id", "b")


def frames(spark, sf_dir: str) -> DataFrame:
    """Detector rows as arrays: frame k, row b, vals."""
    return vectors(spark, sf_dir).select("k", "b", F.transform("embedding", lambda x: x.cast("double")).alias("vals"))


def stack(spark, sf_dir: str) -> DataFrame:
    """Pixels: frame k, row b, column a, value v."""
    return frames(spark, sf_dir).select("k", "b", F.posexplode("vals").alias("a", "v"))


def box(spark, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """The stack as a volume (i, j, l, mu), and its shape; rows that a frame lacks and the longest has are zero."""
    rows = frames(spark, sf_dir)
    ends = rows.groupBy("k").agg((F.max("b") + 1).alias("nb"), F.max(F.size("vals")).alias("na"))
    n = ends.agg(F.max("k") + 1, F.max("nb"), F.max("na")).first()
    short = ends.filter(F.col("nb") < n[1]).select("k", F.explode(F.sequence(F.col("nb").cast("int"), F.lit(n[1] - 1))).alias("b"), F.array_repeat(F.lit(0.0), n[2]).alias("vals"))
    vox = rows.unionByName(short).select(F.col("k").alias("i"), F.col("b").alias("j"), F.posexplode("vals").alias("l", "mu"))
    return vox, tuple(n)


def lineitem(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


def daily(spark, sf_dir: str) -> DataFrame:
    """An ordered metric: the mean of value by day, iter = rank of the day."""
    days = read(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("m"))
    # One row a day: the only single-partition order in the library, and it grows with days alone.
    return days.select((F.row_number().over(Window.orderBy("day")) - 1).cast("int").alias("iter"), F.round("m", 6).alias("m"))
