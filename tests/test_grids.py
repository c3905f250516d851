"""Quantiles, ranks, tiles, alignment and stopping against plain computations."""

import numpy as np
from pyspark.sql import functions as F

from sinoplan.operators import align, geometry, project, solve, statistics
from sinoplan.plans import tables


def test_quantiles_equal_numpy(spark):
    draw = np.random.default_rng(1)
    groups = {"a": draw.normal(size=501), "b": np.repeat([1.0, 1.0, 2.0, 5.0], 50), "c": np.array([3.0]), "d": np.append(draw.random(40), 1e9)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r["x"] for r in statistics.quantiles(df, ["g"], "v", at).collect()}
    assert all(np.allclose(got[g], np.quantile(v, at)) for g, v in groups.items())
    whole = statistics.quantiles(df, [], "v", at).first()["x"]
    assert np.allclose(whole, np.quantile(np.concatenate(list(groups.values())), at))
    gaps = {r["g"]: r["quantum"] for r in statistics.value_quantum(df, ["g"], "v").collect()}
    assert gaps["b"] == 1.0 and gaps["c"] is None and np.isclose(gaps["a"], np.diff(np.sort(groups["a"])).min())


def test_places_do_not_depend_on_lots(spark, monkeypatch):
    monkeypatch.setattr(tables, "LOT", 7)
    df = spark.createDataFrame([(i % 3, int(x)) for i, x in enumerate(np.random.default_rng(2).permutation(200) * 3 - 100)], "g int, id long")
    got = tables.ranked(df, "g", "id", "place").collect()
    for g in range(3):
        ids = sorted(r["id"] for r in got if r["g"] == g)
        assert all(ids[r["place"]] == r["id"] for r in got if r["g"] == g)


def test_tiles_and_lots_of_views_change_nothing(spark):
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, b, draw.random(12).tolist()) for k in range(5) for b in range(9)], "k int, b int, vals array<double>")
    views = spark.createDataFrame([(k, k * 1.2) for k in range(5)], "k int, theta double")
    vox = spark.createDataFrame([(i, j, l, i * 0.4 - 1.0, j * 0.4 - 1.0, l * 0.5 - 1.0) for i in range(6) for j in range(6) for l in range(5)], "i int, j int, l int, x double, y double, z double")
    one, two = ({(r["i"], r["j"], r["l"]): r["bp"] for r in project.backproject(vox, rows, views, 30.0, 50.0, 0.4, 5.5, 4.0, tile=t, lot=n).collect()} for t, n in ((64, 64), (2, 2)))
    assert len(one) == 180 and one.keys() == two.keys() and all(abs(one[p] - two[p]) < 1e-9 for p in one)


def test_alignment_finds_a_shift(spark):
    n = (8, 8, 8)
    value = lambda at: [F.exp(-((F.col(x) - a) * (F.col(x) - a)) / 4.0) for x, a in zip("ijl", at, strict=True)]
    cells = spark.range(512).select((F.col("id") % 8).cast("int").alias("i"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("j"), F.floor(F.col("id") / 64).cast("int").alias("l"))
    blob = lambda at: cells.withColumn("mu", value(at)[0] * value(at)[1] * value(at)[2])
    grid = align.Grid(n, (0.5, 0.5, 0.5))
    offset, scale, ncc = align.measure_alignment(blob((4.0, 3.0, 3.5)), grid, blob((3.0, 3.0, 3.5)), grid, schedule=((0.5, 0.5),), fit_scale=False, least=50)
    assert offset == [0.5, 0.0, 0.0] and scale == [1.0] * 3 and ncc > 0.99
    assert align.aligned_grid(grid, offset, scale).o == (-0.5, 0.0, 0.0)
    same = align.resample(blob((3.0, 3.0, 3.5)), grid, grid).join(blob((3.0, 3.0, 3.5)).withColumnRenamed("mu", "was"), ["i", "j", "l"])
    assert same.filter(F.abs(F.col("mu") - F.col("was")) > 1e-12).count() == 0


def test_affine_part_is_stripped():
    left = geometry.strip_affine([0.3, -0.2, 0.5, 0.4, 0.1, -0.3], 2)
    x, y = np.meshgrid(*[np.linspace(-1, 1, 401)] * 2)
    d = sum(c * x**i * y**j for c, (i, j) in zip(left, geometry.warp_terms(2), strict=True))
    assert all(abs((d * w).mean()) < 5e-3 for w in (1, x, y))


def test_a_run_stops_on_held_out_rays_and_hands_out_its_best(spark):
    m = spark.createDataFrame([(r, v, 0, 0, 1.0 + (r * v) % 3) for r in range(6) for v in range(3)], "ray_id long, i int, j int, l int, w double")
    data = spark.createDataFrame([(r, 1.0 + r) for r in range(6)], "ray_id long, p double")
    x0 = spark.createDataFrame([(v, 0, 0, 0.5) for v in range(3)], "i int, j int, l int, mu double")
    seen = []

    def score(vox):
        seen.append({r["i"]: r["mu"] for r in vox.collect()})
        return [1.0, 3.0, 2.0, 2.5, 9.0][len(seen) - 1]

    got = {r["i"]: r["mu"] for r in solve.iterate(m, x0, data, 5, "sirt", score=score, patience=2).collect()}
    assert len(seen) == 4 and got == seen[1]
    held = solve.held_out_score(m, data)
    assert held(x0) < 0


def test_quantiles_of_values_far_off_and_close_together(spark):
    rng = np.random.default_rng(4)
    sets = {"far": np.append(rng.random(3000), [1e12, -1e300]), "close": 1e6 + rng.normal(size=3000) * 1e-3, "equal": np.full(2000, 3.5), "zero": np.array([0.0, -0.0, 0.0, 5e-324]), "signs": rng.normal(size=999) ** 3, "one": np.array([7.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in sets.items() for x in xs] + [("nan", 1.0), ("nan", float("nan")), ("far", None)], "g string, v double").repartition(5)
    at = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = {r["g"]: r["x"] for r in statistics.quantiles(df, ["g"], "v", at).collect()}
    for g, xs in sets.items():
        assert np.allclose(got[g], np.quantile(xs, at), rtol=1e-12, atol=0), g
    assert got["nan"][0] == 1.0 and np.isnan(got["nan"][-1])
    quantum = {r["g"]: r["quantum"] for r in statistics.value_quantum(df.filter("g in ('far', 'equal', 'signs')"), ["g"], "v").collect()}
    assert quantum["equal"] is None and all(quantum[g] == np.diff(np.unique(sets[g])).min() for g in ("far", "signs"))
