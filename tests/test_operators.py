"""Invariants that no SQL states."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.operators import geometry, metrics, preprocess, project, solve, spectral, statistics, stopping
from sinoplan.streaming.stopping import stopping_stream


def pixels(spark, values):
    k, b, a = values.shape
    return spark.createDataFrame([(i, j, l, float(values[i, j, l])) for i in range(k) for j in range(b) for l in range(a)], "k int, b int, a int, v double")


def test_air_drift_is_removed_and_object_kept(spark):
    drift = np.linspace(0, 0.04, 4)
    values = np.zeros((4, 8, 24)) + drift[:, None, None]
    values[:, :, 9:14] += 1.0
    out = preprocess.air_normalise(pixels(spark, values)).toPandas().pivot_table(index="k", columns="a", values="v")
    assert np.allclose(out.values[:, :9], 0) and np.allclose(out.values[:, 10], 1)


def test_column_stripe_is_removed(spark):
    values = np.tile(np.sin(np.arange(64) / 20), (3, 2, 1))
    striped = values.copy()
    striped[:, :, 30] += 0.5
    out = preprocess.ring_correct(pixels(spark, striped), width=9).toPandas()
    assert abs(out[out.a == 30].v.iloc[0] - values[0, 0, 30]) < 0.02


def test_reflection_repeats_where_the_window_is_wider_than_the_row(spark):
    row = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([5, 1, 9])], "g int, a int, v double")
    got = [r["m"] for r in preprocess.running_median(row, ["g"], "a", "v", 9, "m").orderBy("a").collect()]
    x = np.pad([5.0, 1.0, 9.0], 6, mode="symmetric")
    assert got == [float(np.median(x[6 + i - 4 : 6 + i + 5])) for i in range(3)]


def test_anchors_follow_an_affine_map(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 0.003, 6000), rng.normal(0.02, 0.003, 4000)])
    df = spark.createDataFrame([("p", float(x)) for x in v] + [("q", float(3 * x + 1)) for x in v], "c string, v double")
    got = {r["c"]: r for r in statistics.find_anchors(df, ["c"], "v").collect()}
    assert abs(got["p"]["air"]) < 2e-3 and abs(got["p"]["tissue"] - 0.02) < 2e-3
    assert abs(got["q"]["air"] - (3 * got["p"]["air"] + 1)) < 1e-6 and abs(got["q"]["tissue"] - (3 * got["p"]["tissue"] + 1)) < 1e-6


def test_constant_volume_projects_to_chords_and_matrix_is_adjoint(spark):
    rays = spark.createDataFrame([(i, -20.0, -2.0 + i * 0.5, 0.3, 1.0, 0.0, 0.0) for i in range(9)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    met = geometry.ray_box(rays, (-3.5, -3.5, -3.5), (3.5, 3.5, 3.5))
    m = project.system_matrix(met, 16, (8, 8, 8), 1.0).cache()
    vox = spark.range(512).select((F.col("id") % 8).cast("int").alias("i"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("j"), F.floor(F.col("id") / 64).cast("int").alias("l"), F.lit(0.5).alias("mu"))
    p = project.forward(m, vox).collect()
    assert len(p) == 9 and all(abs(r["p"] - 3.5) < 1e-9 for r in p)
    y = spark.createDataFrame([(r["ray_id"], float(r["ray_id"] + 1)) for r in p], "ray_id long, e double")
    left = sum((r["ray_id"] + 1) * r["p"] for r in p)
    right = project.backward(m, y, "e").join(vox, ["i", "j", "l"]).agg(F.sum(F.col("v") * F.col("mu"))).first()[0]
    assert abs(left - right) < 1e-9


def residual(m, x, data):
    return project.forward(m, x).withColumnRenamed("p", "q").join(data, "ray_id").agg(F.sum(F.pow(F.col("p") - F.col("q"), 2))).first()[0]


@pytest.mark.parametrize("method,relax", [("sirt", 1.0), ("mlem", 1.0), ("landweber", 0.01)])
def test_solvers_lower_the_residual(spark, method, relax):
    rng = np.random.default_rng(1)
    a = rng.random((12, 8)) * (rng.random((12, 8)) < 0.6)
    truth = rng.random(8)
    m = spark.createDataFrame([(r, v, 0, 0, float(a[r, v])) for r in range(12) for v in range(8) if a[r, v]], "ray_id long, i int, j int, l int, w double")
    data = spark.createDataFrame([(r, float(a[r] @ truth)) for r in range(12)], "ray_id long, p double")
    x0 = spark.createDataFrame([(v, 0, 0, 0.3) for v in range(8)], "i int, j int, l int, mu double")
    assert residual(m, solve.iterate(m, x0, data, 3, method, relax), data) < residual(m, x0, data)


def test_conjugate_gradients_reach_least_squares(spark):
    a, truth = np.array([[2.0, 1], [0, 3], [1, 1]]), np.array([0.5, 0.25])
    m = spark.createDataFrame([(r, v, 0, 0, float(a[r, v])) for r in range(3) for v in range(2) if a[r, v]], "ray_id long, i int, j int, l int, w double")
    data = spark.createDataFrame([(r, float(a[r] @ truth)) for r in range(3)], "ray_id long, p double")
    x0 = spark.createDataFrame([(v, 0, 0, 0.0) for v in range(2)], "i int, j int, l int, mu double")
    got = {r["i"]: r["mu"] for r in solve.cgls(m, data, x0, 2).collect()}
    assert abs(got[0] - 0.5) < 1e-9 and abs(got[1] - 0.25) < 1e-9


def test_filter_forms_agree_and_padding_keeps_length(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, rng.random(16).tolist()) for i in range(5)], "k int, vals array<double>")
    a = {r["k"]: r["vals"] for r in spectral.filter_circulant(rows, 16, 0.1).collect()}
    b = {r["k"]: r["vals"] for r in spectral.filter_fft(rows, 0.1).collect()}
    assert all(np.allclose(a[k], b[k]) for k in a)
    assert all(len(r["vals"]) == 16 for r in spectral.filter_fft(rows, 0.1, padded=True).collect())


def test_parker_pairs_sum_to_one(spark):
    from sinoplan.functions.columns import parker_weight

    span = math.pi + 0.6
    pairs = spark.createDataFrame([(b / 50, g / 100) for b in range(0, 30) for g in range(-20, 21, 5)], "beta double, gamma double")
    w = pairs.select(parker_weight(F.col("beta"), F.col("gamma"), F.lit(span)).alias("w"), parker_weight(F.col("beta") + math.pi + 2 * F.col("gamma"), F.col("gamma"), F.lit(span)).alias("o"), (F.col("beta") + math.pi + 2 * F.col("gamma")).alias("b2"), "beta", "gamma")
    for r in w.filter((F.col("b2") <= span) & (F.col("beta") > 0) & (F.col("beta") < span - math.pi - 2 * F.col("gamma")) & (F.col("gamma") > -0.1)).collect():
        assert abs(r["w"] + r["o"] - 1) < 1e-9


def test_equal_frames_have_ssim_one(spark):
    p = pixels(spark, np.random.default_rng(3).random((1, 14, 14))).select("k", "b", "a", F.col("v").alias("p"), F.col("v").alias("t"))
    assert all(abs(r["ssim"] - 1) < 1e-9 for r in metrics.ssim_map(p, ["k"], F.lit(1.0)).collect())
    assert metrics.projection_metrics(p, ["k"]).first()["psnr"] == float("inf")


def trace_by_hand(ms, absolute, relative, patience, start):
    best, bad, out = None, 0, []
    for i, m in enumerate(ms):
        margin = max(absolute, relative * abs(best)) if best else absolute
        is_best, progress = best is None or m > best, best is None or m > best + margin
        best, bad = (m if is_best else best), (0 if progress else bad + 1)
        out.append((i, is_best, progress, bad, i >= start and bad >= patience))
    return out


def test_stopping_batch_and_stream_agree_with_a_loop(spark, tmp_path):
    ms = np.round(np.random.default_rng(4).random(40), 3).tolist()
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate(ms)], "run string, iter int, m double")
    want = trace_by_hand(ms, 0.01, 0.02, 4, 10)
    got = stopping.stopping_trace(df, 0.01, 0.02, patience=4, start=10).orderBy("iter").collect()
    assert [(r["iter"], r["is_best"], r["progress"], r["bad"], r["stop"]) for r in got] == want
    for n in range(2):
        df.filter(F.col("iter").between(20 * n, 20 * n + 19)).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stopping_stream(stream, 0.01, 0.02, 4, 10).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    seen = spark.table("stops").orderBy("iter").collect()
    assert [(r["iter"], r["is_best"], r["progress"], r["bad"], r["stop"]) for r in seen] == want


def test_raising_the_tolerance_stops_sooner(spark):
    ms = np.cumsum(np.random.default_rng(5).random(60) / (1 + np.arange(60))).tolist()
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate(ms)], "run string, iter int, m double")
    stops = [stopping.delivered(stopping.stopping_trace(df, t, 0.0, patience=3, start=0)).first()["stop_iter"] for t in (0.0, 0.05, 0.2)]
    assert [s if s is not None else 99 for s in stops] == sorted((s if s is not None else 99 for s in stops), reverse=True)


def test_msssim_has_the_scales_that_the_smaller_side_allows(spark):
    weights = np.array([0.0448, 0.2856, 0.3001, 0.2363, 0.1333])
    taps = np.array(metrics.gaussian_taps())

    def blurred(x):
        return np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), 0, np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), 1, x))

    def plain(p, t, scales):
        out, w = 1.0, weights[:scales] / weights[:scales].sum()
        for s in range(scales):
            x, y = blurred(p), blurred(t)
            contrast = (2 * (blurred(p * t) - x * y) + 0.0009) / (blurred(p * p) - x * x + blurred(t * t) - y * y + 0.0009)
            light = (2 * x * y + 0.0001) / (x * x + y * y + 0.0001)
            out *= max((contrast * light if s == scales - 1 else contrast).mean(), 1e-3) ** w[s]
            p, t = (z[: len(z) // 2 * 2, : z.shape[1] // 2 * 2] for z in (p, t))
            p, t = ((z[::2, ::2] + z[1::2, ::2] + z[::2, 1::2] + z[1::2, 1::2]) / 4 for z in (p, t))
        return out

    rng = np.random.default_rng(4)
    rows, want = [], {}
    for k, (shape, scales) in enumerate([((45, 64), 3), ((43, 47), 2), ((15, 60), 1), ((88, 90), 4)]):
        p = rng.random(shape)
        t = np.clip(p + rng.normal(0, 0.2, shape), 0, 1)
        want[k] = plain(p, t, scales)
        rows += [(k, b, a, float(p[b, a]), float(t[b, a])) for b in range(shape[0]) for a in range(shape[1])]
    pairs = spark.createDataFrame(rows, "k int, b int, a int, p double, t double")
    got = {r["k"]: r["msssim"] for r in metrics.msssim(pairs, ["k"], F.lit(1.0)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_losses_take_no_group_to_one_task(spark):
    draw = np.random.default_rng(4)
    rows = [("x", float(p), float(t), float(n)) for p, t, n in zip(draw.normal(2, 1, 400), draw.normal(2, 1, 400), draw.integers(0, 9, 400), strict=True)]
    rows += [("y", 1.0, 0.5, 0.25), ("y", 3.0, 1.0, 0.5), ("z", None, 1.0, 1.0), (None, 1.0, 2.0, 1.0)]
    pairs = spark.createDataFrame(rows, "g string, p double, t double, length double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of unknown size
    try:
        found = metrics.losses(pairs, ["g"]).withColumnRenamed("g", "h"), metrics.row_weighted_mse(pairs, ["g"])
        for f in found:
            plan = f._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "percentile" not in plan
        got = {r["g"]: r for r in found[0].join(found[1], F.col("h") == F.col("g")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert set(got) == {"x", "y", "z"} and got["z"]["huber"] is None
    for g in "xy":
        p, t, length = (np.array(c) for c in list(zip(*(r for r in rows if r[0] == g), strict=True))[1:])
        r, w = np.abs(p - t), np.divide(1.0, length, out=np.zeros(len(length)), where=length > 0)
        lower = lambda x: np.sort(x)[(len(x) - 1) // 2]
        d, m = 1.345 * lower(r) / 0.6745, lower(w)
        want = {"mse": r * r, "weighted": np.exp(-t) * r * r, "huber": np.where(r <= d, r * r, 2 * d * r - d * d), "row_weighted": np.clip(w, m / 4, m * 4) / m * r * r}
        assert all(abs(got[g][c] - x.mean()) < 1e-12 * max(1, x.mean()) for c, x in want.items())
