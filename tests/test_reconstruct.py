import math

import numpy as np
from pyspark.sql import functions as F

from sinoplan.operators import geometry
from sinoplan.plans.reconstruct import Scan, fdk, iterative, prepare

SCAN = Scan(60.0, 100.0, 0.5, 48, 24, 23.5, 11.5)
CENTRE, RADIUS, MU = np.array([1.5, -1.0, 0.4]), 2.0, 0.2


def chord(theta, b, a):
    c, s = math.cos(theta), math.sin(theta)
    source = np.array([-SCAN.r_s * c, -SCAN.r_s * s, 0.0])
    u, v = (a - SCAN.cpa) * SCAN.pitch, (b - SCAN.cpb) * SCAN.pitch
    pixel = np.array([(SCAN.sdd - SCAN.r_s) * c - u * s, (SCAN.sdd - SCAN.r_s) * s + u * c, v])
    d = (pixel - source) / np.linalg.norm(pixel - source)
    off = CENTRE - source
    square = RADIUS**2 - (off @ off - (off @ d) ** 2)
    return 2 * MU * math.sqrt(square) if square > 0 else 0.0


def test_fdk_finds_a_sphere_and_its_density(spark):
    n = 36
    rows = spark.createDataFrame([(k, b, [chord(2 * math.pi * k / n, b, a) for a in range(SCAN.n_a)]) for k in range(n) for b in range(SCAN.n_b)], "k int, b int, vals array<double>")
    views = spark.createDataFrame([(k, 2 * math.pi * k / n) for k in range(n)], "k int, theta double")
    vox = spark.createDataFrame([(i, j, l, (i - 6) * 0.75, (j - 6) * 0.75, (l - 3) * 0.75) for i in range(13) for j in range(13) for l in range(7)], "i int, j int, l int, x double, y double, z double")
    out = fdk(rows, views, vox, SCAN, kind="ramp").join(vox, ["i", "j", "l"]).toPandas()
    dense = out[out.mu > 0.1]
    middle = np.array([np.average(dense[c], weights=dense.mu) for c in "xyz"])
    assert np.abs(middle - CENTRE).max() < 0.4
    core = out[((out[["x", "y", "z"]] - CENTRE) ** 2).sum(axis=1) < 1]
    assert abs(core.mu.mean() - MU) < 0.03


def test_iterative_reconstruction_explains_the_data(spark):
    pixels = [(k * 1000 + b * 24 + a, 2 * math.pi * k / 12, b * 2 + 5, a * 2 + 1) for k in range(12) for b in range(7) for a in range(23)]
    rays = spark.createDataFrame(pixels, "ray_id long, theta double, b int, a int")
    rays = geometry.ray_box(geometry.pixel_rays(rays, "theta", SCAN.r_s, SCAN.sdd - SCAN.r_s, SCAN.pitch, SCAN.pitch, SCAN.cpa, SCAN.cpb), (-4.0, -4.0, -4.0), (4.0, 4.0, 4.0))
    data = spark.createDataFrame([(i, chord(t, b, a)) for i, t, b, a in pixels], "ray_id long, p double")
    out = iterative(rays, data, (8, 8, 8), 1.0, steps=4, samples=16).toPandas()
    where = (out[["i", "j", "l"]] - 3.5).values
    assert np.abs(np.average(where, axis=0, weights=out.mu) - CENTRE).max() < 0.5


def test_prepare_runs_all_steps(spark):
    rng = np.random.default_rng(0)
    pix = spark.createDataFrame([(k, b, a, float(900 * math.exp(-(0.8 if 8 < a < 14 else 0.0)) + 100 + rng.normal())) for k in range(3) for b in range(8) for a in range(24)], "k int, b int, a int, v double")
    field = spark.range(8 * 24).select(F.floor(F.col("id") / 24).cast("int").alias("b"), (F.col("id") % 24).cast("int").alias("a"), F.lit(1000.0).alias("bright"), F.lit(100.0).alias("dark"))
    out = prepare(pix, field, ring_width=None).groupBy((F.col("a").between(9, 13)).alias("object")).agg(F.avg("v").alias("v")).collect()
    got = {r["object"]: r["v"] for r in out}
    assert abs(got[True] - 0.8) < 0.02 and abs(got[False]) < 0.01
