"""The stochastic solver: what it descends, that it goes on where it ended, and the fold that steers it."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sinoplan.operators import geometry, project, stochastic, stopping

SHAPE, SIZE = (6, 6, 6), 1 / 3
RNG = np.random.default_rng(11)


def problem(spark, n=300):
    """Rays through a box with a cube in it, and what they see."""
    d = RNG.normal(size=(n, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    o = RNG.uniform(-0.8, 0.8, (n, 3)) - 4 * d
    rays = spark.createDataFrame([(k, *map(float, o[k]), *map(float, d[k])) for k in range(n)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double")
    rays = geometry.ray_box(rays, (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)).cache()
    truth = spark.createDataFrame([(*at, 1.0 if all(1 < x < 4 for x in at) else 0.1) for at in itertools.product(range(6), repeat=3)], "i int, j int, l int, mu double")
    return rays, project.forward(project.system_matrix(rays, 8, SHAPE, SIZE), truth).cache(), truth.withColumn("mu", F.lit(0.3))


def values(df):
    return {(r["i"], r["j"], r["l"]): r["mu"] for r in df.collect()}


def test_a_run_that_is_taken_up_again_ends_as_an_unbroken_one(spark, tmp_path):
    rays, data, start = problem(spark)
    held = rays.filter("ray_id % 10 = 0").select("ray_id")
    run = lambda steps, name: stochastic.adam_run(rays, data, start, SHAPE, SIZE, steps, rate=0.05, variation=0.002, held_out=held, every=2, warmup=3, folder=f"{tmp_path}/{name}")
    whole = values(run(6, "whole"))
    values(run(3, "broken"))
    broken = values(run(6, "broken"))
    assert whole.keys() == broken.keys() and max(abs(whole[k] - broken[k]) for k in whole) < 1e-9
    left = sorted(p.name for p in tmp_path.glob("whole/volume-*"))
    assert 1 <= len(left) <= 2 and len(list(tmp_path.glob("whole/fold-*"))) == 6
    before = values(start)
    seen = lambda vox: {r["ray_id"]: r["p"] for r in project.forward(project.system_matrix(rays, 8, SHAPE, SIZE), spark.createDataFrame([(*k, v) for k, v in vox.items()], "i int, j int, l int, mu double")).collect()}
    target = {r["ray_id"]: r["p"] for r in data.collect()}
    loss = lambda vox: sum((p - target[k]) ** 2 for k, p in seen(vox).items())
    assert loss(whole) < 0.6 * loss(before) and min(whole.values()) >= 0


def test_gradients_agree_with_finite_differences(spark):
    rays, data, start = problem(spark, 60)
    rng = np.random.default_rng(3)
    vox = {at: float(v) for at, v in zip(itertools.product(range(6), repeat=3), rng.random(216), strict=True)}
    frame = lambda v: spark.createDataFrame([(*k, x) for k, x in v.items()], "i int, j int, l int, mu double")
    matrix = project.system_matrix(rays, 8, SHAPE, SIZE)
    rows, target = {}, {r["ray_id"]: r["p"] for r in data.collect()}
    for r in matrix.collect():
        rows.setdefault(r["ray_id"], []).append(((r["i"], r["j"], r["l"]), r["w"]))

    def loss(v, term):
        e = [(sum(w * v[at] for at, w in ws) - target[k], target[k]) for k, ws in rows.items()]
        return sum({"mse": d * d, "weighted_mse": math.exp(-t) * d * d, "mean_absolute": abs(d)}[term] for d, t in e) / len(e)

    for term in ("mse", "weighted_mse", "mean_absolute"):
        got = {(r["i"], r["j"], r["l"]): r["g"] for r in stochastic.batch_gradient(matrix, frame(vox), data, term).collect()}
        for at in [(0, 0, 0), (2, 3, 3), (5, 1, 4)]:
            up, down = (loss(vox | {at: vox[at] + h}, term) for h in (1e-6, -1e-6))
            assert abs((up - down) / 2e-6 - got.get(at, 0.0)) < 1e-5
    tv = {(r["i"], r["j"], r["l"]): r["tv"] for r in stochastic.variation_gradient(frame(vox), SHAPE).collect()}
    a = np.array([vox[at] for at in itertools.product(range(6), repeat=3)]).reshape(SHAPE)
    total = lambda a: sum(np.abs(np.diff(a, axis=k)).mean() for k in range(3))
    for at in [(0, 0, 0), (2, 3, 3), (5, 1, 4)]:
        e = np.zeros(SHAPE)
        e[at] = 1e-7
        assert abs((total(a + e) - total(a - e)) / 2e-7 - tv[at]) < 1e-6


def test_rays_are_drawn_alike_wherever_they_stand(spark):
    ids = spark.range(40000)
    drawn = lambda df, n: {r["id"] for r in df.filter(stochastic.drawn(F.col("id"), n, 4)).collect()}
    one = drawn(ids, 1)
    assert one == drawn(ids.repartition(5), 1) and one != drawn(ids, 2) and abs(len(one) / 40000 - 0.25) < 0.02
    assert abs(len(one & drawn(ids, 2)) / 40000 - 1 / 16) < 0.03


def test_the_fold_cuts_and_stops_as_the_ordered_operators_do(spark):
    scores = [0.1, 0.5, 0.4, 0.45, 0.3, 0.2, 0.2, 0.1, 0.6, 0.5, 0.5, 0.5, 0.5, 0.4, float("nan"), 0.3]
    now, scales, stops = stochastic.Progress(), [], []
    for n, score in enumerate(scores):
        now = now.told(n, score, 0.0, 0.5, 3, 1, 0.01, 8)
        scales.append(now.scale)
        stops.append(now.stopped)
    metric = spark.createDataFrame([("r", n, m) for n, m in enumerate(scores)], "run string, iter int, m double")
    trace = stopping.stopping_trace(metric, patience=8, start=0)
    assert [r["stop"] for r in trace.orderBy("iter").collect()] == stops
    assert [r["rate"] for r in stopping.reduce_on_plateau(trace, 1.0).orderBy("iter").collect()] == scales
    assert now.best == 0.6 and now.best_step == 8
