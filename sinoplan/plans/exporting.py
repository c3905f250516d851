"""Queries of volumes smoothed, brought to a scale, written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sinoplan.functions.columns import r6
from sinoplan.operators import units
from sinoplan.operators.lineage import checkpointed, remove_folder, shared_folder
from sinoplan.operators.smooth import bilateral
from sinoplan.plans.registry import query
from sinoplan.plans.tables import box
from sinoplan.sources import export, prepare, vff


@query("""WITH @STACK, @BOX, n AS (SELECT max(b) + 1 AS nb, max(a) + 1 AS na FROM x), d AS (SELECT p, q FROM (SELECT unnest(range(-2, 3)) AS p), (SELECT unnest(range(-2, 3)) AS q) WHERE p * p + q * q <= 4),
w AS (SELECT k, b, a, v, p, q, CASE WHEN b + p < 0 THEN -(b + p) WHEN b + p >= nb THEN 2 * (nb - 1) - b - p ELSE b + p END AS ob, CASE WHEN a + q < 0 THEN -(a + q) WHEN a + q >= na THEN 2 * (na - 1) - a - q ELSE a + q END AS oa FROM x, n, d),
g AS (SELECT w.k, w.b, w.a, o.v, exp(-(p * p + q * q) / (2 * 1.5 * 1.5) - (o.v - w.v) * (o.v - w.v) / (2 * 0.1 * 0.1)) AS g FROM w JOIN x o ON o.k = w.k AND o.b = w.ob AND o.a = w.oa)
SELECT k, b::INT AS b, a::INT AS a, round(sum(g * v) / sum(g), 6) + 0.0 AS v FROM g GROUP BY k, b, a""")
def bilateral_frames(spark, sf_dir):
    """The frames smoothed without blurring their edges: a Gaussian of 1.5 pixels and of 0.1 in value."""
    vox, (nk, nb, na) = box(spark, sf_dir)
    got = bilateral(vox.select(F.col("i").alias("l"), F.col("j").alias("i"), F.col("l").alias("j"), "mu"), (nb, na, nk), 1.5, 0.1)
    return got.select(F.col("l").alias("k"), F.col("i").alias("b"), F.col("j").alias("a"), r6(F.col("mu")).alias("v"))


@query("""WITH @STACK, @BOX, n AS (SELECT max(b) + 1 AS nb FROM x), h AS (SELECT 'v' || (k // 4) AS volume, k % 4 AS z, nb - 1 - b AS b, a, least(greatest(round_even(v * (1000.0::DOUBLE / 0.05::DOUBLE) - 1000.0, 0), -32768), 32767) + 0.0 AS hu FROM x, n)
SELECT volume, z::INT AS z, b::INT AS b, a::INT AS a, hu, round((hu + 1000) / (1000.0::DOUBLE / 0.05::DOUBLE), 6) + 0.0 AS mu FROM h""")
def volume_export(spark, sf_dir):
    """Four frames a volume, brought to the scale of water's anchor, written as files with sidecars, read again and brought back by what the sidecars say."""
    vox, _ = box(spark, sf_dir)
    vox = checkpointed(vox.select(F.concat(F.lit("v"), F.floor(F.col("i") / 4).cast("string")).alias("volume"), F.col("l").alias("i"), "j", (F.col("i") % 4).alias("l"), "mu"))
    anchors = units.resolved_anchors(vox, ["volume"], "mu", mode="fixed", mu_water=0.05)
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    export.export_volumes(vox, anchors, folder, xy=0.05, z=0.1, tissue_hu=units.WATER_HU, most=10_000).agg(F.sum("bytes")).first()
    name = lambda c: F.substring_index(F.substring_index(c, "/", -1), ".vff", 1)
    # Named before they are taken apart: once a row of a file, not once a voxel.
    rows = vff.read_vff(spark, folder).select(name("path").alias("volume"), "z", "b", "vals")
    rows = rows.select("volume", "z", "b", F.posexplode("vals").alias("a", "hu")).withColumn("hu", F.col("hu").cast("double"))
    side = prepare.sidecars(spark, folder).withColumn("volume", name("volume"))
    told = units.volume_anchors(side.select("volume"), side)
    # What is read again is kept, so that the files can go.
    got = checkpointed(units.as_attenuation(rows, told).select("volume", "z", "b", "a", "hu", r6(F.col("mu")).alias("mu")))
    remove_folder(spark, folder)
    return got
