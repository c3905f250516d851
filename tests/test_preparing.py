import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.operators import patches, phases, units, variation


def cube(spark, x):
    i, j, l = np.indices(x.shape)
    return spark.createDataFrame([(int(a), int(b), int(c), float(v)) for a, b, c, v in zip(i.ravel(), j.ravel(), l.ravel(), x.ravel(), strict=True)], "i int, j int, l int, mu double")


def as_array(df, shape, value="mu"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"], r["l"]] = r[value]
    return out


def energy(u, f, weight):
    g = [np.diff(u, axis=a, append=np.take(u, [-1], axis=a)) for a in range(3)]
    return 0.5 * ((u - f) ** 2).sum() + weight * np.sqrt(sum(d * d for d in g)).sum()


def test_tiles_change_nothing_and_a_step_can_be_split(spark):
    f = np.random.default_rng(1).normal(size=(8, 7, 9))
    p = variation.dual_steps(f, np.zeros((3, *f.shape)), 0.3, 7)
    whole = f + variation.divergence(p)
    tiled = variation.tv_step(cube(spark, f), f.shape, 0.3, steps=7, tile=3, inner=2)
    assert np.allclose(as_array(tiled, f.shape), whole, atol=1e-12)
    half = variation.tv_step(cube(spark, f), f.shape, 0.3, steps=3, tile=4)
    assert np.allclose(as_array(variation.tv_step(half, f.shape, 0.3, steps=4, tile=5), f.shape), whole, atol=1e-12)


def test_variation_reaches_the_minimum(spark):
    """No small change of the result lowers the energy, and the gap to the dual bound is closed."""
    rng = np.random.default_rng(2)
    f = np.kron(rng.integers(0, 3, (2, 2, 2)), np.ones((4, 4, 4))) + rng.normal(0, 0.1, (8, 8, 8))
    p = variation.dual_steps(f, np.zeros((3, *f.shape)), 0.2, 3000)
    u = f + variation.divergence(p)
    assert energy(u, f, 0.2) - 0.5 * ((f * f).sum() - (u * u).sum()) < 1e-3
    assert all(energy(u + rng.normal(0, 1e-2, f.shape), f, 0.2) > energy(u, f, 0.2) for _ in range(20))
    got = as_array(variation.tv_step(cube(spark, f), f.shape, 0.2, steps=40, tile=8, inner=40), f.shape)
    assert abs(energy(got, f, 0.2) - energy(u, f, 0.2)) < 0.05 * energy(u, f, 0.2)


def test_variation_of_little(spark):
    flat = np.full((3, 3, 3), 2.0)
    assert np.allclose(as_array(variation.tv_step(cube(spark, flat), flat.shape, 0.1, steps=2, scaled=True), flat.shape), 2)
    empty = spark.createDataFrame([], "i int, j int, l int, mu double")
    assert variation.tv_step(empty, (3, 3, 3), 0.1, steps=2, scaled=True).count() == 0
    with pytest.raises(ValueError, match="below zero"):
        variation.tv_step(empty, (3, 3, 3), -1.0)


def test_patches_do_not_depend_on_partitions(spark):
    vox = cube(spark, np.random.default_rng(3).uniform(-1, 1, (6, 7, 8)))
    draw = lambda v, seed=5: [tuple(r) for r in patches.matter_patches(v, (6, 7, 8), (2, 3, 4), 9, seed).orderBy("patch").collect()]
    assert draw(vox.repartition(1)) == draw(vox.repartition(7)) != draw(vox, 6)
    assert len({t[1:] for t in draw(vox)}) == 9
    got = patches.patch_voxels(patches.matter_patches(vox, (6, 7, 8), (2, 3, 4), 9, 5), vox, (2, 3, 4), (6, 7, 8)).groupBy("patch").count().collect()
    assert {r["count"] for r in got} == {24}


def test_patches_come_as_often_as_their_weight(spark):
    """First draws of 4,000 seeds: each middle in proportion to its weight."""
    w = np.array([1.0, 2.0, 3.0, 4.0])
    rows = spark.createDataFrame([(n, float(x)) for n, x in enumerate(w)], "i int, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    key = -F.ln(patches.keyed_uniform(0, F.col("seed"), F.col("i"))) / F.col("w")
    first = rows.groupBy("seed").agg(F.min_by("i", key).alias("i")).groupBy("i").count().collect()
    share = {r["i"]: r["count"] / 4000 for r in first}
    assert all(abs(share[n] - x / w.sum()) < 4 * np.sqrt(x / w.sum() / 4000) for n, x in enumerate(w))


def test_patches_of_little(spark):
    vox = cube(spark, np.where(np.indices((3, 3, 3))[0] == 1, 1.0, 0.0))
    got = patches.matter_patches(vox, (3, 3, 3), (9, 1, 1), 50).collect()
    assert len(got) == 9 and {r["i0"] for r in got} == {0}
    assert patches.matter_patches(vox.filter("mu < 0"), (3, 3, 3), (1, 1, 1), 5).count() == 0


def test_partners_fall_back(spark):
    seen = [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("b", 3, 0), ("b", 3, 1), ("c", 0, 5)]
    got = {(r["scan"], r["n"]): (r["phase2"], r["n2"], r["source"]) for r in phases.partners(spark.createDataFrame(seen, "scan string, phase int, n int")).collect()}
    assert got == {("a", 0): (1, 0, "phase"), ("a", 1): (0, 2, "adjacent"), ("b", 0): (3, 1, "adjacent")}


def test_phase_gate_against_numpy(spark):
    rng = np.random.default_rng(4)
    a = np.cumsum(rng.normal(size=(3, 8, 32)), axis=2)
    b = a + rng.normal(0, 0.5, a.shape)
    rows = [("s", p, n, y, x[n, y].tolist()) for p, x in enumerate((a, b)) for n in range(3) for y in range(8)]
    got = phases.phase_gate(spark.createDataFrame(rows, "scan string, phase int, n int, b int, vals array<double>"), 32)
    power = lambda x: (np.abs(np.fft.rfft(x[:, 2:6], axis=2)) ** 2).mean(axis=(0, 1))
    noise = 0.5 * power(a - b)
    raw = np.maximum(power(a) - noise, 0) / np.maximum(np.maximum(power(a) - noise, 0) + noise, 1e-30)
    raw[0] = 0
    w = np.exp(-0.5 * (np.arange(-12, 13) / 3) ** 2)
    want = np.convolve(np.pad(raw, 12, "symmetric"), w / w.sum(), "valid")
    assert np.allclose([r["gate"] for r in got.orderBy("f").collect()], want)


def test_each_rung_of_evidence(spark):
    volumes = spark.createDataFrame([("own", 0.5), ("head", 0.5), ("none", None), ("flat", None)], "volume string, element double")
    hu = "struct<anchor_air_value: double, anchor_tissue_value: double, target_air: double, target_tissue: double>"
    side = spark.createDataFrame([("own", (0.2, 0.4), [1.0, 2.0, 3.0], (0.01, 0.03, None, 60.0)), ("flat", None, [1.0], (0.02, 0.02, None, None))], f"volume string, voxel_size_mm struct<xy: double, z: double>, vol_origin_mm array<double>, hu_calibration {hu}")
    grid = {r["volume"]: r for r in units.volume_grids(volumes, side).collect()}
    assert [(grid[v]["dx"], grid[v]["dz"], grid[v]["oz"], grid[v]["dx_from"], grid[v]["origin_from"]) for v in ("own", "head", "none", "flat")] == [(0.2, 0.4, 3, "sidecar", "sidecar"), (0.5, 0.5, 0, "header", "isocentre"), (1, 1, 0, "assumed", "isocentre"), (1, 1, 0, "assumed", "isocentre")]
    assert units.volume_grids(volumes, side, xy=9.0, origin=(1.0, 1.0, 1.0)).filter("dx = 9 AND ox = 1 AND dx_from = 'given'").count() == 4
    told = {r["volume"]: r for r in units.volume_anchors(volumes, side).collect()}
    assert told["own"]["units_from"] == "sidecar" and told["own"]["scale"] == pytest.approx(1060 / 0.02)
    assert told["flat"]["units_from"] == "assumed" and told["flat"]["scale"] == pytest.approx(1000 / units.MU_WATER)
    vox = spark.createDataFrame([("own", -1000.0), ("own", 60.0), ("none", 0.0)], "volume string, hu double")
    back = sorted(r["mu"] for r in units.as_attenuation(vox, units.volume_anchors(volumes, side), level=False).collect())
    assert back == pytest.approx([0.01, units.MU_WATER, 0.03])
    assert units.volume_anchors(volumes, side, 0.02).filter("units_from = 'given' AND tissue = 0.02").count() == 3


def test_bins_and_modes(spark):
    row = spark.createDataFrame([(0.0, 100.0, 1.0), (0.0, 10.0, 1.0), (0.0, 10.0, None)], "a double, b double, q double")
    assert [r[0] for r in row.select(units.bins_for_quantum(F.col("a"), F.col("b"), F.col("q"))).collect()] == [50, 16, None]
    assert units.resolved_anchors(row, ["a"], "b", "fixed", 0.02).first()["tissue"] == 0.02
    with pytest.raises(ValueError, match="unknown mode"):
        units.resolved_anchors(row, ["a"], "b", "other")


def test_radial_power_counts_every_pixel(spark):
    """All patches of an uneven frame, the last ones filled up with zeros, against plain transforms."""
    from sinoplan.operators import spectral

    x = np.random.default_rng(6).normal(size=(10, 9))
    rows = spark.createDataFrame([(0, b, x[b].tolist()) for b in range(10)], "k int, b int, vals array<double>")
    got = [r["power"] for r in spectral.radial_power(rows, 4, ["k"]).orderBy("f").collect()]
    padded = np.pad(x, ((0, 2), (0, 3)))
    tiles = [np.abs(np.fft.fftshift(np.fft.fft2(padded[r : r + 4, c : c + 4]))) ** 2 for r in range(0, 12, 4) for c in range(0, 12, 4)]
    far = np.hypot(*(np.mgrid[:4, :4] - 2)).round() >= 1
    assert np.allclose(got, [np.mean(tiles, axis=0)[~far].mean(), np.mean(tiles, axis=0)[far].mean()])
