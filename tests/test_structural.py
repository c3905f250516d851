"""Gradients of structural losses against finite differences of plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.operators import metrics

TAPS = np.array(metrics.gaussian_taps())


def parts(x, y, span):
    """Means of SSIM and of its contrast part over all places of the window."""
    smooth = lambda z: np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, z, TAPS, "valid"), TAPS, "valid")
    mx, my, xx, yy, xy = map(smooth, (x, y, x * x, y * y, x * y))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    cs = (2 * (xy - mx * my) + c2) / (np.maximum(xx - mx * mx, 0) + np.maximum(yy - my * my, 0) + c2)
    return ((2 * mx * my + c1) / (mx * mx + my * my + c1) * cs).mean(), cs.mean()


def value(x, y, span, scales):
    if not scales:
        return parts(x, y, span)[0]
    weights = np.array([0.0448, 0.2856, 0.3001, 0.2363, 0.1333])
    n = sum(min(x.shape) >= 11 * 2**s for s in range(5))
    out = 1.0
    for s, w in enumerate(weights[:n] / weights[:n].sum()):
        if s:
            x, y = (z[: z.shape[0] // 2 * 2, : z.shape[1] // 2 * 2].reshape(z.shape[0] // 2, 2, z.shape[1] // 2, 2).mean(axis=(1, 3)) for z in (x, y))
        ssim, contrast = parts(x, y, span)
        out *= max(ssim if s == n - 1 else contrast, 1e-3) ** w
    return out


@pytest.mark.parametrize("scales", [False, True])
def test_gradient_agrees_with_finite_differences(spark, scales):
    draw = np.random.default_rng(5)
    frames = {}
    for k, (h, w) in enumerate([(25, 23), (14, 30), (47, 46)]):
        y = np.cumsum(draw.normal(size=(h, w)), axis=0) / 4
        frames[k] = y + 0.3 * draw.normal(size=(h, w)), y
    rows = [(k, b, a, float(x[b, a]), float(y[b, a])) for k, (x, y) in frames.items() for b in range(x.shape[0]) for a in range(x.shape[1])]
    pairs = spark.createDataFrame(rows, "k int, b int, a int, p double, t double").repartition(5)
    got = {(r["k"], r["b"], r["a"]): r for r in metrics.structural_gradient(pairs, ["k"], F.lit(2.0), scales, 0.7).collect()}
    assert len(got) == len(rows)
    for k, (x, y) in frames.items():
        loss = lambda z, y=y: 0.7 * (1 - value(z, y, 2.0, scales)) + ((z - y) ** 2).mean()
        assert abs(got[k, 0, 0]["loss"] - loss(x)) < 1e-10
        for b, a in [(0, 0), (5, 7), (x.shape[0] - 1, 3), (x.shape[0] // 2, x.shape[1] - 1)]:
            e = np.zeros_like(x)
            e[b, a] = 1e-5
            assert abs((loss(x + e) - loss(x - e)) / 2e-5 - got[k, b, a]["g"]) < 1e-7


def test_equal_frames_and_frames_too_small(spark):
    rows = [("same", b, a, float(b * a), float(b * a)) for b in range(15) for a in range(15)] + [("small", b, a, 1.0, 2.0) for b in range(5) for a in range(5)]
    got = metrics.structural_gradient(spark.createDataFrame(rows, "k string, b int, a int, p double, t double"), ["k"], F.lit(1.0)).collect()
    assert {r["k"] for r in got} == {"same"} and all(abs(r["loss"]) < 1e-9 and abs(r["g"]) < 1e-9 for r in got)
