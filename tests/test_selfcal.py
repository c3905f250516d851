"""Detector tilt and axis found again from projections of a phantom in which both are planted."""

import math

import numpy as np
import pyarrow as pa
import pytest

from sinoplan.operators import selfcal

D = selfcal.Detector(60.0, 100.0, 0.2, 121, 96, 60.0, 47.5)
#: Upright cylinders, or balls: x, y, z, radius, density.
RODS = [(1.5, 0.5, 0.0, 2.2, 0.3), (-2.0, 1.8, 0.0, 1.0, 0.5), (0.4, -2.6, 0.0, 1.3, 0.4), (-1.0, -1.0, 0.0, 0.5, 0.8)]
BALLS = [(2.0, 1.0, 3.0, 1.4, 0.6), (-2.5, 0.8, 3.2, 1.1, 0.8), (0.3, -2.4, 2.8, 0.9, 1.0), (1.6, -1.4, -3.0, 1.2, 0.7), (-1.8, -1.2, -2.7, 1.0, 0.9), (-0.6, 2.6, -3.3, 1.1, 0.8), (0.2, 0.3, 0.0, 1.0, 0.5)]


def projected(things, n_views, psi_deg, shift, upright):
    """(k, b, vals) of a turn: what a detector turned by psi whose axis falls on column cpa + shift at the central row sees."""
    c, s = math.cos(math.radians(psi_deg)), math.sin(math.radians(psi_deg))
    b, a = np.mgrid[0 : D.n_b, 0 : D.n_a].astype(float)
    da, db = (a - D.cpa - shift) * D.pitch, (b - D.cpb) * D.pitch
    u, v = c * da - s * db, s * da + c * db
    rows = []
    for k in range(n_views):
        t = 2 * math.pi * k / n_views
        ct, st = math.cos(t), math.sin(t)
        source = np.array([-D.r_s * ct, -D.r_s * st, 0.0])
        ray = np.stack([D.sdd * ct - u * st, D.sdd * st + u * ct, v], -1)
        ray /= np.linalg.norm(ray, axis=-1, keepdims=True)
        seen = np.zeros(u.shape)
        for x, y, z, r, mu in things:
            to = np.array([x, y, z]) - source
            if upright:
                flat = np.hypot(ray[..., 0], ray[..., 1])
                along = (ray[..., 0] * to[0] + ray[..., 1] * to[1]) / flat
                seen += mu * 2 * np.sqrt(np.maximum(r * r - (to[0] ** 2 + to[1] ** 2 - along**2), 0)) / flat
            else:
                along = ray @ to
                seen += mu * 2 * np.sqrt(np.maximum(r * r - (to @ to - along**2), 0))
        rows += [(k, i, seen[i].tolist()) for i in range(D.n_b)]
    return rows


def scan(spark, things, n_views, psi_deg, shift, upright):
    rows = spark.createDataFrame(projected(things, n_views, psi_deg, shift, upright), "k int, b int, vals array<double>").repartition(8)
    return rows, spark.createDataFrame([(k, 2 * math.pi * k / n_views) for k in range(n_views)], "k int, theta double")


@pytest.fixture(scope="module")
def tilted(spark):
    rows, views = scan(spark, RODS, 360, 0.7, 1.3, True)
    return rows.cache(), views


def test_bands_find_a_planted_tilt_and_axis(tilted):
    fit, bands = selfcal.tilt_by_bands(*tilted, D, bands=7, band_rows=9)
    assert abs(fit["psi_deg"] - 0.7) < 0.02 and abs(fit["cpa0"] - 61.3) < 0.05 and len(bands) == 7
    fit = selfcal.tilt_jointly(*tilted, D, bands=9)
    assert abs(fit["psi_deg"] - 0.7) < 0.02 and abs(fit["cpa0"] - 61.3) < 0.05 and not selfcal.doubts(fit["psi_deg"], fit["depth"])


def test_a_gain_that_drifts_and_a_missing_row_do_not_move_the_tilt(tilted):
    from pyspark.sql import functions as F

    rows, views = tilted
    odd = rows.filter((F.col("b") != 40) | (F.col("k") != 17)).withColumn("vals", F.transform("vals", lambda x: x + 0.02 * F.sin(F.col("k") / 60.0)))
    assert abs(selfcal.tilt_jointly(odd, views, D, bands=9)["psi_deg"] - 0.7) < 0.02


def test_costs_are_least_at_the_planted_axis(tilted):
    rows, views = tilted
    order = selfcal.view_order(views)
    costs = selfcal.conjugate_costs(rows, order, [(44, 52), (0, 2)], [[60.3, 61.3, 62.3], [60.3]], D).collect()
    by = {(r["band"], r["nth"]): r["cost"] for r in costs}
    assert by[0, 1] < 0.2 * min(by[0, 0], by[0, 2])


def test_flat_data_are_told(spark):
    rows = spark.createDataFrame([(k, b, [0.0] * D.n_a) for k in range(12) for b in range(D.n_b)], "k int, b int, vals array<double>")
    views = spark.createDataFrame([(k, 2 * math.pi * k / 12) for k in range(12)], "k int, theta double")
    for f in (lambda: selfcal.tilt_by_bands(rows, views, D, band_rows=9), lambda: selfcal.tilt_jointly(rows, views, D), lambda: selfcal.tilt_by_half_scans(rows, views, D, 8.0, 3.0)):
        with pytest.raises(selfcal.Undetermined):
            f()
    assert selfcal.doubts(2.5, 3.0) and selfcal.doubts(0.1, 0.4) and not selfcal.doubts(0.1, 3.0)


def test_half_scans_find_a_tilt_outside_the_first_grid(spark):
    rows, views = scan(spark, BALLS, 180, 0.9, 0.0, False)
    fit, curves = selfcal.tilt_by_half_scans(rows.cache(), views, D, 9.0, 3.0, pools=(2, 1), voxels=(0.2, 0.1), grids=(0.45, 0.15), steps=(0.15, 0.05))
    assert abs(fit["psi_deg"] - 0.9) < 0.06 and abs(fit["cpa0_offset"]) < 0.3
    assert max(c["psi_deg"] for c in curves if c["stage"] == 0) > 0.46


def test_a_grid_grows_to_where_the_top_is():
    asked = []

    def score(xs):
        asked.append(xs)
        return [-((x - 1.0) ** 2) for x in xs]

    xs, _, edge = selfcal.widened(score, [-0.2, 0.0, 0.2], 0.2, -2, 2)
    assert not edge and xs[0] == -0.2 and len(asked) == 3 and sum(map(len, asked)) == len(xs) == 9
    assert selfcal.widened(lambda xs: xs, [0.0, 1.0], 1.0, -2, 2)[2]


def test_planes_equal_plain_sums(spark):
    d = selfcal.Detector(20.0, 30.0, 0.5, 12, 10, 5.5, 4.5)
    draw = np.random.default_rng(2)
    data = draw.random((6, 10, 12))
    order = list(range(6)), 2 * math.pi * np.arange(6) / 6
    rows = spark.createDataFrame([(k, b, data[k, b].tolist()) for k in range(6) for b in range(10)], "k int, b int, vals array<double>")
    tries = [(0.0, 5.5), (0.05, 5.1)]
    vox = selfcal.plane_grid(spark, d, 3.0, 0.5, (0.7, -0.7))
    got = {(r["nth"], r["half"], r["plane"], r["i"], r["j"]): r["v"] for r in selfcal.half_scan_planes(vox, rows, order, tries, d, tile=4, lot=4).collect()}
    for v in vox.collect():
        for n, (psi, cpa) in enumerate(tries):
            for half in (0, 1):
                total = 0.0
                for k in range(3 * half, 3 * half + 3):
                    c, s = math.cos(order[1][k]), math.sin(order[1][k])
                    scale = d.sdd / (d.r_s + v["x"] * c + v["y"] * s) / d.pitch
                    u, w = scale * (v["y"] * c - v["x"] * s), scale * v["z"]
                    b, a = d.cpb + math.cos(psi) * w - math.sin(psi) * u, cpa + math.cos(psi) * u + math.sin(psi) * w
                    for i in (math.floor(b), math.floor(b) + 1):
                        for j in (math.floor(a), math.floor(a) + 1):
                            if 0 <= i < 10 and 0 <= j < 12:
                                total += data[k, i, j] * (1 - abs(b - i)) * (1 - abs(a - j))
                assert abs(total - got[n, half, v["plane"], v["i"], v["j"]]) < 1e-9


def test_planes_off_the_detector_have_the_score_of_flat_ones(spark):
    d = selfcal.Detector(20.0, 30.0, 0.5, 12, 10, 5.5, 4.5)
    data = np.random.default_rng(3).random((6, 10, 12))
    rows = spark.createDataFrame([(k, b, data[k, b].tolist()) for k in range(6) for b in range(10)], "k int, b int, vals array<double>")
    order = list(range(6)), 2 * math.pi * np.arange(6) / 6
    vox = selfcal.plane_grid(spark, d, 3.0, 0.5, (0.7, 90.0))
    for flat in ((), (math.nan,)):
        told = {r["plane"]: r["score"] for r in selfcal.half_scan_scores(vox, rows, order, [(0.0, 5.5)], d, *flat).collect()}
        assert len(told) == 2 and 0 < abs(told[0]) <= 1 and np.array_equal(told[1], *flat or (0.0,), equal_nan=True)
    planes = {(r["half"], r["i"], r["j"]): r["v"] for r in selfcal.half_scan_planes(vox.filter("plane = 0"), rows, order, [(0.0, 5.5)], d).collect()}
    e0, e1 = (np.hypot(*np.gradient(np.array([[planes[h, i, j] for j in range(6)] for i in range(6)]))).ravel() for h in (0, 1))
    assert abs(told[0] - np.corrcoef(e0, e1)[0, 1]) < 1e-9


def test_only_rows_that_voxels_fall_on_are_asked_for(spark):
    d = selfcal.Detector(20.0, 30.0, 0.5, 12, 4001, 5.5, 2000.0)
    order = list(range(6)), 2 * math.pi * np.arange(6) / 6
    vox = selfcal.plane_grid(spark, d, 3.0, 0.5, (0.7, 600.0)).toPandas()
    ask = selfcal._asked(order, [(0.0, 5.5)], d)
    found = {}
    for plane, z in enumerate((0.7, 600.0)):
        x, y = (vox.loc[vox["plane"] == plane, c].to_numpy() for c in "xy")
        told = ask([pa.scalar(plane), pa.scalar(0), pa.scalar(0)], pa.table({"x": x, "y": y, "z": np.full(len(x), z)})).to_pydict()
        assert set(told["box"]) == {plane} and set(told["k"]) == set(range(6))
        want = set()
        for k, t in zip(*order, strict=True):
            b = 2000 + d.sdd * z / (d.r_s + x * math.cos(t) + y * math.sin(t)) / d.pitch
            want |= {(k, int(r)) for r in np.concatenate([np.floor(b), np.floor(b) + 1])}
        assert set(zip(told["k"], told["b"], strict=True)) == want
        found[plane] = len(told["b"])
    assert found[1] <= 2 * 36 * 6  # its window is some two hundred rows wide in each view
