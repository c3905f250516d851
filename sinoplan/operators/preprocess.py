"""From counts to corrected line integrals; all operators take pixels (k, b, a, value column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.columns import clamp_transmission, line_integral, transmission
from sinoplan.operators.lineage import checkpointed
from sinoplan.operators.statistics import named_quantiles


def flat_field(pix: DataFrame, field: DataFrame | None, counts: str = "v", mode: str = "none", hard: bool = False, ceiling: float | None = 1.05) -> DataFrame:
    """Counts to line integrals. ``field`` (b, a, bright, dark) is one frame, far smaller than the stack; None: pix carries both."""
    met = pix if field is None else pix.join(field, ["b", "a"])
    t = clamp_transmission(transmission(F.col(counts), F.col("bright"), F.col("dark")), ceiling=ceiling, hard=hard)
    return met.withColumn(counts, line_integral(t, mode)).drop("bright", "dark")


def air_columns(pix: DataFrame, value: str = "v", most: float = 0.05) -> DataFrame:
    """Columns whose 95th percentile in the middle band of rows shows no object."""
    rows = pix.agg((F.max("b") + 1).alias("nb"))
    half = F.greatest(F.lit(1), F.floor(F.col("nb") / 8))
    middle = F.floor(F.col("nb") / 2)
    # A quarter of the rows, read several times: they are made once.
    band = checkpointed(pix.crossJoin(F.broadcast(rows)).filter((F.col("b") >= middle - half) & (F.col("b") < middle + half)).drop("nb"))
    # A list of columns, no longer than a detector row, is read several times.
    air = checkpointed(named_quantiles(band, ["a"], value, {"p95": 0.95}).filter(F.col("p95") <= most).select("a"))
    return band.join(air, "a", "left_semi")


def air_offsets(pix: DataFrame, value: str = "v", most: float = 0.05, least_columns: int = 8) -> DataFrame:
    """The level of air of each frame; zero throughout if too few columns are air."""
    air = air_columns(pix, value, most)
    enough = air.agg((F.countDistinct("a") >= least_columns).alias("enough"))
    offsets = named_quantiles(air, ["k"], value, {"level": 0.5})
    return pix.select("k").distinct().join(offsets, "k", "left").crossJoin(F.broadcast(enough)).select("k", F.when(F.col("enough"), F.coalesce("level", F.lit(0.0))).otherwise(0.0).alias("offset"))


def air_normalise(pix: DataFrame, value: str = "v", most: float = 0.05) -> DataFrame:
    """Subtract each frame's level of air from all of it; one row a frame is joined back."""
    return pix.join(air_offsets(pix, value, most), "k").withColumn(value, F.col(value) - F.col("offset")).drop("offset")


def running_median(df: DataFrame, group: list[str], order: str, value: str, width: int, out: str) -> DataFrame:
    """Median over ``width`` neighbours along ``order`` (0 to n-1), reflected at the ends."""
    h = width // 2
    n = df.groupBy(*group).agg((F.max(order) + 1).alias("__n"))
    padded = df.select(*group, F.col(order).alias("__i"), F.col(value).alias("__v")).join(n, group)
    # A sample stands at its own place and at each mirror image within reach of the window.
    turns = F.ceil(F.lit(h) / F.col("__n")).cast("int") + 1
    images = F.flatten(F.transform(F.sequence(-turns, turns), lambda t: F.array(2 * F.col("__n") * t + F.col("__i"), 2 * F.col("__n") * t - 1 - F.col("__i"))))
    reach = F.filter(images, lambda p: (p >= -h) & (p < F.col("__n") + h))
    spread = padded.select(*group, "__n", "__v", F.explode(reach).alias("__p"))
    w = Window.partitionBy(*group).orderBy("__p").rowsBetween(-h, h)
    smooth = spread.withColumn(out, F.expr("percentile(__v, 0.5)").over(w)).filter((F.col("__p") >= 0) & (F.col("__p") < F.col("__n")))
    return df.join(smooth.select(*group, F.col("__p").cast("int").alias(order), out), [*group, order])


def ring_profile(pix: DataFrame, value: str = "v", width: int = 51) -> DataFrame:
    """What each detector pixel adds to all frames: its mean over frames less the running median of its row."""
    mean = pix.groupBy("b", "a").agg(F.avg(value).alias("mean"))
    return running_median(mean, ["b"], "a", "mean", width, "smooth").select("b", "a", (F.col("mean") - F.col("smooth")).alias("ring"))


def ring_correct(pix: DataFrame, value: str = "v", width: int = 51) -> DataFrame:
    return pix.join(ring_profile(pix, value, width), ["b", "a"]).withColumn(value, F.col(value) - F.col("ring")).drop("ring")


def pool(pix: DataFrame, f: int, value: str = "v") -> DataFrame:
    """Means of f by f pixels; a remainder at the end of rows and columns is dropped."""
    size = pix.agg((F.floor((F.max("b") + 1) / f) * f).alias("nb"), (F.floor((F.max("a") + 1) / f) * f).alias("na"))
    inside = pix.crossJoin(F.broadcast(size)).filter((F.col("b") < F.col("nb")) & (F.col("a") < F.col("na")))
    return inside.groupBy("k", F.floor(F.col("b") / f).cast("int").alias("b"), F.floor(F.col("a") / f).cast("int").alias("a")).agg(F.avg(value).alias(value))


def block_mean(vox: DataFrame, f: int, value: str = "mu") -> DataFrame:
    """Means of f by f by f voxels (i, j, l), remainders dropped."""
    axes = ["i", "j", "l"]
    size = vox.agg(*((F.floor((F.max(x) + 1) / f) * f).alias(f"n{x}") for x in axes))
    inside = vox.crossJoin(F.broadcast(size)).filter(" AND ".join(f"{x} < n{x}" for x in axes))
    return inside.groupBy(*(F.floor(F.col(x) / f).cast("int").alias(x) for x in axes)).agg(F.avg(value).alias(value))


def fill_gaps(pix: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Runs above a threshold replaced by a line between their neighbours in the row.

    At an end the one neighbour's value; a row that is all above stays.
    """
    w = Window.partitionBy("k", "b").orderBy("a")
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    good = F.when(F.col(value) <= threshold, F.col(value))
    place = F.when(F.col(value) <= threshold, F.col("a"))
    told = pix.withColumns({"__lv": F.last(good, True).over(back), "__la": F.last(place, True).over(back), "__rv": F.first(good, True).over(on), "__ra": F.first(place, True).over(on)})
    line = F.col("__lv") + (F.col("__rv") - F.col("__lv")) * (F.col("a") - F.col("__la")) / (F.col("__ra") - F.col("__la"))
    filled = F.when(F.col(value) <= threshold, F.col(value)).when(F.col("__lv").isNotNull() & F.col("__rv").isNotNull(), line)
    return told.withColumn(value, F.coalesce(filled, "__lv", "__rv", F.col(value))).drop("__lv", "__la", "__rv", "__ra")


