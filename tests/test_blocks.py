"""Samples read in blocks, rendering, and two-pass rays against plain computations."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.operators import align, blocks, project

DRAW = np.random.default_rng(7)
DATA = DRAW.random((9, 40, 35))


def volume(spark, data=DATA):
    return spark.createDataFrame([(*map(int, at), float(data[at])) for at in np.ndindex(data.shape)], "i int, j int, l int, mu double").repartition(4)


def plain(data, at):
    total = 0.0
    for corner in itertools.product(*((math.floor(p), math.floor(p) + 1) for p in at)):
        if all(0 <= c < n for c, n in zip(corner, data.shape, strict=True)):
            total += data[corner] * math.prod(1 - abs(p - c) for p, c in zip(at, corner, strict=True))
    return total


@pytest.mark.parametrize("clamp", [False, True])
def test_resampled_equals_plain_interpolation(spark, clamp):
    at = np.linspace(-1.5, 9.2, 13), np.linspace(0.0, 39.0, 61), np.linspace(3.3, 30.1, 5)
    got = {tuple(r)[:3]: r["mu"] for r in blocks.resampled(volume(spark), DATA.shape, at, -5.0, clamp).collect()}
    assert len(got) == 13 * 61 * 5
    for n in itertools.product(range(0, 13, 2), range(0, 61, 3), range(5)):
        p = [a[k] for a, k in zip(at, n, strict=True)]
        inside = all(0 <= x <= m - 1 for x, m in zip(p, DATA.shape, strict=True))
        want = plain(DATA, [min(max(x, 0), m - 1) for x, m in zip(p, DATA.shape, strict=True)]) if clamp or inside else -5.0
        assert abs(got[n] - want) < 1e-12


def test_a_volume_that_is_not_whole_counts_as_nothing_where_it_is_not(spark):
    got = blocks.resampled(volume(spark).filter("j < 20"), DATA.shape, tuple(np.arange(n) for n in DATA.shape), 0.0)
    assert got.count() == DATA.size and got.filter("j >= 20").agg(F.sum("mu")).first()[0] == 0
    assert blocks.resampled(volume(spark).limit(0), (2, 2, 2), tuple(np.arange(3) for _ in range(3)), 7.0).filter("mu = 7").count() == 27 - 8


def test_voxels_are_shuffled_little_more_than_once(spark):
    n = DATA.size
    assert blocks.haloed(volume(spark), (32, 32, 32)).count() <= 2 * n


@pytest.mark.parametrize("lot", [500_000, 50])
def test_samples_at_any_place(spark, monkeypatch, lot):
    monkeypatch.setattr(blocks, "LOT", lot)
    places = [tuple(map(float, p)) for p in DRAW.uniform(-2, 42, (400, 3)) * [0.25, 1, 0.9]] + [(3.0, 4.0, 5.0)] * 70 + [(8.0, 39.0, 34.0)]
    points = spark.createDataFrame([(n, "x", *p) for n, p in enumerate(places)], "n int, name string, x double, y double, z double").repartition(3)
    got = blocks.sampled(points, {"i": F.col("x"), "j": F.col("y"), "l": F.col("z")}, volume(spark))
    assert got.columns == ["n", "name", "x", "y", "z", "mu"]
    rows = got.collect()
    assert len(rows) == len(places) and all(abs(r["mu"] - plain(DATA, places[r["n"]])) < 1e-12 for r in rows)


def test_planes_read_the_voxels_beside_them(spark):
    grid, target = align.Grid(DATA.shape, (1.0, 0.5, 0.25)), align.Grid((7, 21, 11), (1.1, 0.7, 0.6), (0.1, 0.0, 0.3))
    whole = {tuple(r)[:3]: r["mu"] for r in align.render_volume(volume(spark), grid, target, 3.5).collect()}
    for direction, axis, index in (("axial", 2, None), ("coronal", 1, 4), ("sagittal", 0, 6)):
        rows = align.render_slice(volume(spark), grid, target, direction, index, 3.5).collect()
        index = target.n[axis] // 2 if index is None else index
        assert len(rows) == math.prod(target.n) // target.n[axis]
        assert all(tuple(r)[axis] == index and abs(whole[tuple(r)[:3]] - r["mu"]) < 1e-12 for r in rows)
    with pytest.raises(IndexError):
        align.render_slice(volume(spark), grid, target, "axial", 11)
    with pytest.raises(ValueError):
        align.render_slice(volume(spark), grid, target, "oblique")


def test_scores_of_tries_equal_plain_correlations(spark, monkeypatch):
    grid, other = align.Grid(DATA.shape, (1.0, 0.5, 0.25)), align.Grid((8, 36, 33), (1.0, 0.5, 0.25), (0.2, 0.0, 0.0))
    reference = DRAW.random(other.n)
    tries = [(0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 0.3, -0.7, 0.1, 1.0, 1.05, 0.97), (2, 50.0, 0.0, 0.0, 1.0, 1.0, 1.0)]
    got = align.alignment_scores(volume(spark), grid, volume(spark, reference), other, spark.createDataFrame(tries, "t int, o_i double, o_j double, o_l double, s_i double, s_j double, s_l double"), stride=2, least=10)
    for r in got.collect():
        _, *state = tries[r["t"]]
        pairs = []
        for at in itertools.product(*(range(0, n, 2) for n in other.n)):
            p = [s * ((x - (m - 1) / 2) * d + o + off - c) / e + (n - 1) / 2 for x, m, d, o, off, s, c, e, n in zip(at, other.n, other.d, other.o, state[:3], state[3:], grid.o, grid.d, grid.n, strict=True)]
            if all(0 <= x <= n - 1 for x, n in zip(p, grid.n, strict=True)):
                pairs.append((reference[at], plain(DATA, p)))
        assert r["n"] == len(pairs) and abs(r["ncc"] - (np.corrcoef(np.array(pairs).T)[0, 1] if pairs else -1)) < 1e-9


def test_two_passes_see_a_thin_shell_better_than_equal_pieces(spark):
    n, size = 64, 1 / 16
    x = (np.arange(n) - (n - 1) / 2) * size
    r = np.sqrt(x[:, None, None] ** 2 + x[None, :, None] ** 2 + x[None, None, :] ** 2)
    shell = np.exp(-(((r - 1.2) / 0.06) ** 2))
    vox = volume(spark, shell)
    rows = [(k, -3.0, float(y), float(z), 1.0, 0.0, 0.0, 1.0, 5.0, y < 1.9) for k, (y, z) in enumerate([*DRAW.uniform(-0.7, 0.7, (100, 2)).tolist(), (1.95, 0.0)])]
    rays = spark.createDataFrame(rows, "ray_id int, ox double, oy double, oz double, dx double, dy double, dz double, t_near double, t_far double, hit boolean")
    exact = {}
    for k, _, y, z, *_ in rows:
        t = np.linspace(-2, 2, 4001)
        exact[k] = float(np.mean([plain(shell, [p / size + (n - 1) / 2 for p in (s, y, z)]) for s in t[::20]]) * 4)
    error = {}
    for name, (coarse, fine) in {"two": (12, 8), "one": (20, 1)}.items():
        got = {r["ray_id"]: r for r in project.hierarchical_rays(rays, vox, (n, n, n), size, coarse, fine).collect()}
        assert got[100]["p"] == got[100]["p_coarse"] == 0 and len(got) == 101
        error[name] = np.mean([abs(got[k]["p" if name == "two" else "p_coarse"] - exact[k]) for k in range(100)])
    assert error["two"] < 0.9 * error["one"]
    again = {r["ray_id"]: r["p"] for r in project.hierarchical_rays(rays, vox, (n, n, n), size, 8, 8, better=vox).collect()}
    assert again.keys() == exact.keys()
