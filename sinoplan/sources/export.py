"""Volumes on the scale of their anchors, each as a file with a sidecar that says how to go back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoplan.functions.columns import affine, anchor_scale
from sinoplan.operators.smooth import bilateral
from sinoplan.operators.units import AIR_HU, TISSUE_HU
from sinoplan.sources import vff


def on_scale(vox: DataFrame, anchors: DataFrame, key: str = "volume", air_hu: float = AIR_HU, tissue_hu: float = TISSUE_HU) -> DataFrame:
    """Voxels (key, i, j, l, mu) as (key, i, j, l, hu): the affine map that brings a volume's anchors (key, air, tissue) to their levels.

    Anchors that are null or equal tell no scale: their volume fails the query by name, since a file of it could not be read back.
    """
    told = F.coalesce(F.col("air") != F.col("tissue"), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("no scale for volume "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("double")
    scale = F.when(told, anchor_scale(F.col("air"), F.col("tissue"), air_hu, tissue_hu)).otherwise(wrong)
    met = vox.join(anchors.select(key, "air", scale.alias("__scale"), F.col("air").alias("__air")).drop("air"), key)
    return met.select(key, "i", "j", "l", affine(F.col("mu") - F.col("__air"), F.col("__scale"), F.lit(air_hu)).alias("hu"))


def volume_sidecars(anchors: DataFrame, key: str = "volume", xy: float = 1.0, z: float = 1.0, origin: tuple[float, float, float] | None = None, air_hu: float = AIR_HU, tissue_hu: float = TISSUE_HU, algorithm: str | None = None) -> DataFrame:
    """(key, content): the JSON beside each volume, as ``prepare.sidecars`` reads it."""
    size = F.struct(F.lit(float(xy)).alias("xy"), F.lit(float(z)).alias("z"))
    map_ = F.struct(F.col("air").cast("double").alias("anchor_air_value"), F.col("tissue").cast("double").alias("anchor_tissue_value"), F.lit(float(air_hu)).alias("target_air"), F.lit(float(tissue_hu)).alias("target_tissue"))
    place = F.array(*(F.lit(float(x)) for x in origin)) if origin is not None else F.lit(None).cast("array<double>")
    told = F.struct(F.lit(algorithm).cast("string").alias("algorithm"), F.col(key).cast("string").alias("scan"), size.alias("voxel_size_mm"), place.alias("vol_origin_mm"), map_.alias("hu_calibration"))
    return anchors.select(key, F.to_json(told).cast("binary").alias("content"))


def export_volumes(
    vox: DataFrame, anchors: DataFrame, folder: str, key: str = "volume", xy: float = 1.0, z: float = 1.0, origin: tuple[float, float, float] | None = None,
    air_hu: float = AIR_HU, tissue_hu: float = TISSUE_HU, smoothing: tuple[float, float] | None = None, shape: tuple[int, int, int] | None = None, algorithm: str | None = None, most: int = vff.SLAB_VOXELS,
) -> DataFrame:
    """Each volume (key, i, j, l, mu) with its anchors (key, air, tissue) as ``<key>.vff`` and ``<key>.json``: (path, bytes) of both.

    ``smoothing``: widths in mm and on the scale of a bilateral filter of slices of ``shape``; files are then named ``<key>_bilateral``. The header has one
    voxel size; sizes that differ along the axis, and the place, are in the sidecar. Volumes without anchors are left
    out, and anchors without a volume write no file.
    """
    anchors = anchors.join(vox.select(key).distinct(), key, "left_semi")
    rows = on_scale(vox, anchors, key, air_hu, tissue_hu)
    if smoothing is not None:
        if shape is None:
            raise ValueError("smoothing needs the shape of the volumes")
        rows = bilateral(rows, shape, smoothing[0] / xy, smoothing[1], [key], "hu")
    name = F.concat(F.col(key).cast("string"), F.lit("_bilateral" if smoothing is not None else ""))
    told = {"elementsize": f"{xy:g}", "spacing": f"{xy:g} {xy:g} {z:g}"}
    done = vff.save_volumes(rows.withColumn("__name", name), folder, "__name", "hu", fields=told, most=most)
    side = volume_sidecars(anchors, key, xy, z, origin, air_hu, tissue_hu, algorithm)
    return done.unionByName(vff.save_files(side.withColumn("__name", name), folder, "__name", ".json"))
