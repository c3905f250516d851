"""Phases of a scan: a frame meets the frame of another phase, and their difference tells the noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.operators.lineage import checkpointed
from sinoplan.operators.spectral import power_spectrum
from sinoplan.operators.statistics import smoothed_counts


def partners(frames: DataFrame) -> DataFrame:
    """For each frame (scan, phase, n) of a scan's first phase the frame that measured nearly the same: (scan, n, phase2, n2, source).

    That of the second phase in order with the same number (``phase``), else the next frame of its own phase (``adjacent``); a frame
    with neither is left out. One row a frame is what is worked on.
    """
    seen = frames.select("scan", "phase", "n").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy("scan").orderBy("phase")))
    own, other = seen.filter("place = 1"), seen.filter("place = 2").select("scan", F.col("phase").alias("phase2"), F.col("n").alias("n"), F.lit(True).alias("met"))
    met = own.withColumn("next", F.lead("n").over(Window.partitionBy("scan").orderBy("n"))).join(other, ["scan", "n"], "left")
    beside = F.col("next") == F.col("n") + 1
    met = met.withColumn("source", F.when(F.col("met"), "phase").when(beside, "adjacent")).filter("source IS NOT NULL")
    return met.select("scan", "phase", "n", F.coalesce("phase2", "phase").alias("phase2"), F.when(F.col("met"), F.col("n")).otherwise(F.col("next")).alias("n2"), "source")


def paired_rows(rows: DataFrame) -> DataFrame:
    """Detector rows (scan, phase, n, b, vals) beside those of their partner frame: (scan, n, b, vals, other); rows that one of them lacks are left out."""
    met = rows.join(partners(rows), ["scan", "phase", "n"])
    second = rows.select("scan", F.col("phase").alias("phase2"), F.col("n").alias("n2"), "b", F.col("vals").alias("other"))
    return met.join(second, ["scan", "phase2", "n2", "b"]).select("scan", "n", "b", "source", "vals", "other")


def phase_gate(rows: DataFrame, n: int, sigma: float = 3.0) -> DataFrame:
    """The share of each frequency that is signal, from all rows of the middle half of the detector: (scan, f, gate), f from 0 to n // 2.

    Noise: half the power of the difference to the partner frame. Rows are taken without their mean, so nothing is known of frequency 0, whose
    share before smoothing is 0. The gate is smoothed along the frequencies and kept within 0 and 1. ``n``: samples of a row. A scan without partners has no rows.
    """
    size = rows.groupBy("scan").agg((F.max("b") + 1).alias("nb"))
    middle = rows.join(size, "scan").filter((F.col("b") >= F.floor(F.col("nb") / 4)) & (F.col("b") < F.floor(F.col("nb") * 3 / 4))).select("scan", "phase", "n", "b", "vals")
    met = paired_rows(middle)
    both = met.select("scan", F.explode(F.array(F.struct(F.lit("all").alias("of"), "vals"), F.struct(F.lit("noise").alias("of"), F.zip_with("vals", "other", lambda x, y: x - y).alias("vals")))).alias("row")).select("scan", "row.*")
    power = power_spectrum(both, n, ["scan", "of"]).groupBy("scan", "f").agg(F.sum(F.when(F.col("of") == "all", F.col("power"))).alias("whole"), (0.5 * F.sum(F.when(F.col("of") == "noise", F.col("power")))).alias("noise"))
    signal = F.greatest(F.col("whole") - F.col("noise"), F.lit(0.0))
    raw = power.select("scan", F.col("f").alias("bin"), F.when(F.col("f") == 0, 0.0).otherwise(signal / F.greatest(signal + F.col("noise"), F.lit(1e-30))).alias("n"))
    raw = checkpointed(raw)  # one row a scan and frequency, which smoothing reads three times
    return smoothed_counts(raw, ["scan"], sigma).select("scan", F.col("bin").alias("f"), F.least(F.greatest("h", F.lit(0.0)), F.lit(1.0)).alias("gate"))
