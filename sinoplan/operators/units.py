"""Volumes of unknown grid and unit: evidence in order of weight, and which piece decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoplan.operators.statistics import find_anchors

#: Attenuation of water (1/mm) where nothing is known, and the levels of air, bulk tissue and water on the scale.
MU_WATER, AIR_HU, TISSUE_HU, WATER_HU = 0.0219, -1000.0, 120.0, 0.0


def bins_for_quantum(low: Column, high: Column, quantum: Column) -> Column:
    """Most bins that hold two steps of a quantiser each, 16 at least; null for values that were not quantised."""
    return F.when(quantum > 0, F.greatest(F.lit(16), F.floor((high - low) / (2.0 * quantum)).cast("int")))


def _first(rungs: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value that is there, and the name of its rung."""
    return F.coalesce(*(v for _, v in rungs)), F.coalesce(*(F.when(v.isNotNull(), F.lit(name)) for name, v in rungs))


def volume_grids(volumes: DataFrame, side: DataFrame, xy: float | None = None, z: float | None = None, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """Sizes and origins of volumes: (volume, dx, dz, ox, oy, oz, dx_from, dz_from, origin_from).

    ``volumes``: (volume, element), as headers tell it; ``side``: sidecars (volume, voxel_size_mm, vol_origin_mm). Order: what is given, the
    sidecar, the header; else voxels of 1 mm (``assumed``: axes in voxels), as deep as wide, about the isocentre.
    """
    met = volumes.select("volume", "element").join(side.select("volume", "voxel_size_mm", "vol_origin_mm"), "volume", "left")
    given = lambda x: F.lit(x).cast("double")
    dx, dx_from = _first([("given", given(xy)), ("sidecar", F.col("voxel_size_mm.xy")), ("header", F.col("element")), ("assumed", F.lit(1.0))])
    dz, dz_from = _first([("given", given(z)), ("sidecar", F.col("voxel_size_mm.z")), ("width", F.col("dx"))])
    told = F.when(F.size("vol_origin_mm") == 3, F.col("vol_origin_mm"))
    place, origin_from = _first([("given", F.array(*map(F.lit, origin)) if origin else F.lit(None).cast("array<double>")), ("sidecar", told), ("isocentre", F.array(*[F.lit(0.0)] * 3))])
    met = met.withColumns({"dx": dx, "dx_from": dx_from}).withColumns({"dz": dz, "dz_from": dz_from, "o": place, "origin_from": origin_from})
    return met.select("volume", "dx", "dz", *(F.col("o")[n].alias(f"o{x}") for n, x in enumerate("xyz")), "dx_from", "dz_from", "origin_from")


def volume_anchors(volumes: DataFrame, side: DataFrame, mu_water: float | None = None) -> DataFrame:
    """The map between attenuation and scale of each volume: (volume, air, tissue, air_hu, tissue_hu, scale, units_from).

    A volume's own anchors, both of them, decide (``sidecar``); else the one-point map through water, ``given`` or ``assumed``. Anchors that are
    equal tell no scale, and are passed over.
    """
    met = volumes.select("volume").join(side.select("volume", "hu_calibration"), "volume", "left")
    h = F.col("hu_calibration")
    own = F.coalesce(h["anchor_air_value"] != h["anchor_tissue_value"], F.lit(False))
    pick = lambda mine, other: F.when(own, mine).otherwise(F.lit(other).cast("double"))
    met = met.select("volume", pick(h["anchor_air_value"], 0.0).alias("air"), pick(h["anchor_tissue_value"], MU_WATER if mu_water is None else mu_water).alias("tissue"), pick(F.coalesce(h["target_air"], F.lit(AIR_HU)), AIR_HU).alias("air_hu"), pick(F.coalesce(h["target_tissue"], F.lit(TISSUE_HU)), WATER_HU).alias("tissue_hu"), F.when(own, "sidecar").otherwise("assumed" if mu_water is None else "given").alias("units_from"))
    return met.withColumn("scale", (F.col("tissue_hu") - F.col("air_hu")) / (F.col("tissue") - F.col("air")))


def resolved_anchors(vox: DataFrame, group: list[str], value: str, mode: str = "auto", mu_water: float | None = None) -> DataFrame:
    """Anchors of volumes in attenuation: found in their histograms (``auto``), or water's alone (``fixed``): (group, air, tissue, clear)."""
    if mode == "auto":
        return find_anchors(vox, group, value)
    if mode != "fixed":
        raise ValueError(f"unknown mode {mode!r}; known: auto, fixed")
    if mu_water is None:
        raise ValueError("mode fixed needs mu_water")
    return vox.select(*group).distinct().select(*group, F.lit(0.0).alias("air"), F.lit(float(mu_water)).alias("tissue"), F.lit(True).alias("clear"))


def as_attenuation(vox: DataFrame, anchors: DataFrame, value: str = "hu", level: bool = True) -> DataFrame:
    """Voxels of a scale as attenuation ``mu``; with ``level`` air is 0, as a projection of it takes for granted. Anchors are one row a volume."""
    met = vox.join(anchors.select("volume", "air", "air_hu", "scale"), "volume")
    mu = (F.col(value) - F.col("air_hu")) / F.col("scale")
    return met.withColumn("mu", mu if level else mu + F.col("air")).drop("air", "air_hu", "scale")
