"""Image metrics and losses: two inputs met on their pixels, then aggregated."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.columns import huber
from sinoplan.operators.lineage import at_hand, checkpointed
from sinoplan.operators.spectral import with_vals
from sinoplan.operators.statistics import lower_median


def projection_metrics(pairs: DataFrame, group: list[str], p: str = "p", t: str = "t") -> DataFrame:
    """MSE and PSNR in dB over the target's range (1 if it has none); infinite where equal."""
    found = pairs.groupBy(*group).agg(F.avg(F.pow(F.col(p) - F.col(t), 2)).alias("mse"), (F.max(t) - F.min(t)).alias("range"))
    span = F.when(F.col("range") > 0, F.col("range")).otherwise(1.0)
    return found.select(*group, "mse", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(span * span / F.col("mse"))).alias("psnr"))


def gaussian_taps(width: int = 11, sigma: float = 1.5) -> list[float]:
    raw = [math.exp(-0.5 * ((i - (width - 1) / 2) / sigma) ** 2) for i in range(width)]
    return [x / sum(raw) for x in raw]


def _window_sum(df: DataFrame, along: str, across: list[str], columns: list[str], taps: list[float]) -> DataFrame:
    """Weighted sums over the next ``len(taps)`` samples along an axis, where all of them are there."""
    w = Window.partitionBy(*across).orderBy(along)
    sums = {c: sum((F.lead(c, i).over(w) * x for i, x in enumerate(taps[1:], 1)), F.col(c) * taps[0]) for c in columns}
    return df.withColumns(sums | {"__last": F.lead(along, len(taps) - 1).over(w)}).filter(F.col("__last") == F.col(along) + len(taps) - 1).drop("__last")


def ssim_map(pairs: DataFrame, group: list[str], span: Column, p: str = "p", t: str = "t", width: int = 11, sigma: float = 1.5) -> DataFrame:
    """SSIM and its contrast part at each valid place of a separable Gaussian window over (b, a)."""
    taps = gaussian_taps(width, sigma)
    moments = pairs.select(*group, "b", "a", span.alias("__span"), F.col(p).alias("x"), F.col(t).alias("y"), (F.col(p) * F.col(p)).alias("xx"), (F.col(t) * F.col(t)).alias("yy"), (F.col(p) * F.col(t)).alias("xy"))
    names = ["x", "y", "xx", "yy", "xy"]
    m = _window_sum(_window_sum(moments, "a", [*group, "b"], names, taps), "b", [*group, "a"], names, taps)
    c1, c2 = F.pow(0.01 * F.col("__span"), 2), F.pow(0.03 * F.col("__span"), 2)
    vx, vy = F.greatest(F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0)), F.greatest(F.col("yy") - F.col("y") * F.col("y"), F.lit(0.0))
    contrast = (2 * (F.col("xy") - F.col("x") * F.col("y")) + c2) / (vx + vy + c2)
    light = (2 * F.col("x") * F.col("y") + c1) / (F.col("x") * F.col("x") + F.col("y") * F.col("y") + c1)
    return m.select(*group, "b", "a", (light * contrast).alias("ssim"), contrast.alias("contrast"))


def msssim(pairs: DataFrame, group: list[str], span: Column, weights: tuple[float, ...] = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)) -> DataFrame:
    """Multi-scale SSIM: contrast at each scale, SSIM at the last, 2 by 2 means between; means floored at 1e-3.

    Each group has as many scales, up to one a weight, as leave the window of 11 within its smaller
    side, one at least; the weights of those add up to one. A side under 11 has no valid place and
    gives no row.
    """
    sides = pairs.groupBy(*group).agg((F.max("b") + 1).alias("__h"), (F.max("a") + 1).alias("__w"))
    levels = sum((F.when(F.least("__h", "__w") >= 11 * 2**s, 1).otherwise(0) for s in range(1, len(weights))), F.lit(1))
    now = pairs.select(*group, "b", "a", "p", "t", span.alias("span")).join(sides.withColumn("__levels", levels), group)
    totals = F.array(*(F.lit(sum(weights[: s + 1])) for s in range(len(weights))))
    out = None
    for s, weight in enumerate(weights):
        if s:
            within = now.filter(F.col("__levels") > s).withColumns({"__h": F.floor(F.col("__h") / 2), "__w": F.floor(F.col("__w") / 2)}).filter((F.col("b") < 2 * F.col("__h")) & (F.col("a") < 2 * F.col("__w")))
            now = within.groupBy(*group, "__h", "__w", "__levels", F.floor(F.col("b") / 2).cast("int").alias("b"), F.floor(F.col("a") / 2).cast("int").alias("a")).agg(F.avg("p").alias("p"), F.avg("t").alias("t"), F.first("span").alias("span"))
        mean = F.avg(F.when(F.col("__levels") == s + 1, F.col("ssim")).otherwise(F.col("contrast")))
        found = ssim_map(now, [*group, "__levels"], F.col("span")).groupBy(*group, "__levels").agg(mean.alias("__mean"))
        found = found.select(*group, (weight / F.element_at(totals, F.col("__levels")) * F.ln(F.greatest(F.col("__mean"), F.lit(1e-3)))).alias("__log"))
        out = found if out is None else out.unionByName(found)
    return out.groupBy(*group).agg(F.exp(F.sum("__log")).alias("msssim"))


def gain(p: Column, t: Column) -> Column:
    """The factor on ``p`` that fits ``t`` best; 1 if p is zero throughout."""
    return F.coalesce(F.try_divide(F.sum(p * t), F.sum(p * p)), F.lit(1.0))


def _beside_median(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Rows with the lower median of their group; null where the group has no value, and without rows of no group."""
    known = df.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in group))) if group else df
    middle = at_hand(lower_median(known, group, value, out))
    return known.join(middle, group, "left") if group else known.crossJoin(middle)


def losses(pairs: DataFrame, group: list[str], p: str = "p", t: str = "t") -> DataFrame:
    """MSE, MSE weighted by exp(-t), and Huber's loss at 1.345 robust deviations (lower median)."""
    r = F.col(p) - F.col(t)
    met = _beside_median(pairs.withColumn("__r", F.abs(r)), group, "__r", "__m")
    return met.groupBy(*group).agg(F.avg(r * r).alias("mse"), F.avg(F.exp(-F.col(t)) * r * r).alias("weighted"), F.avg(huber(r, 1.345 * F.col("__m") / 0.6745)).alias("huber"))


def row_weighted_mse(pairs: DataFrame, group: list[str], length: str = "length", most: float = 4.0, p: str = "p", t: str = "t") -> DataFrame:
    """Residuals weighted by one over the path, within a factor of the (lower) median weight."""
    w = F.when(F.col(length) > 0, 1.0 / F.col(length)).otherwise(0.0)
    met = _beside_median(pairs.withColumn("__w", w), group, "__w", "__m")
    clamped = F.least(F.greatest(F.col("__w"), F.col("__m") / most), F.col("__m") * most) / F.col("__m")
    return met.groupBy(*group).agg(F.avg(clamped * F.pow(F.col(p) - F.col(t), 2)).alias("row_weighted"))


def forward_differences(vox: DataFrame, axes: list[str], value: str = "mu") -> DataFrame:
    """For each axis, the next voxel's value less one's own (null at the end): d_<axis>."""
    out = {}
    for x in axes:
        w = Window.partitionBy(*[y for y in axes if y != x]).orderBy(x)
        out[f"d_{x}"] = F.lead(value).over(w) - F.col(value)
    return vox.withColumns(out)


def gradient(vox: DataFrame, axes: list[str], value: str = "v", group: list[str] | None = None) -> DataFrame:
    """Central differences, one-sided at the ends: g_<axis>; ``group``: columns that tell one grid from another."""
    out = {}
    for x in axes:
        w = Window.partitionBy(*(group or []), *[y for y in axes if y != x]).orderBy(x)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        out[f"g_{x}"] = F.when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)
    return vox.withColumns(out)


def priors(vox: DataFrame, axes: list[str], value: str = "mu", low: float = 0.0, high: float = 0.1, eps: float = 0.05) -> DataFrame:
    """Total variation, double-well plus gradient, concave gradient, sparsity, mean square and gradient norm, in one pass of windows."""
    d = forward_differences(vox, axes, value)
    u = (F.col(value) - low) / (high - low)
    well = F.pow(u, 2) * F.pow(1 - u, 2)
    tv = sum((F.coalesce(F.avg(F.abs(F.col(f"d_{x}"))), F.lit(0.0)) for x in axes), F.lit(0.0))
    square = sum((F.coalesce(F.avg(F.pow(F.col(f"d_{x}") / (high - low), 2)), F.lit(0.0)) for x in axes), F.lit(0.0))
    concave = sum((F.coalesce(F.avg(F.pow(F.col(f"d_{x}"), 2) / (F.pow(F.col(f"d_{x}"), 2) + eps * eps)), F.lit(0.0)) for x in axes), F.lit(0.0))
    norm = sum((F.coalesce(F.sum(F.pow(F.col(f"d_{x}"), 2)), F.lit(0.0)) for x in axes), F.lit(0.0))
    return d.agg(tv.alias("tv"), (F.avg(well) / eps + eps * square).alias("double_well"), concave.alias("concave"), F.avg(F.abs(value)).alias("l1"), F.avg(F.pow(value, 2)).alias("l2"), F.sqrt(norm).alias("gradient_norm"), F.sqrt(F.sum(F.pow(value, 2))).alias("norm"))


def smooth_axis(vox: DataFrame, axes: list[str], axis: str, sigma: float, value: str = "mu") -> DataFrame:
    """Gaussian smoothing along an axis, reflected at its ends; lines along it are whole and go as arrays."""
    others = [x for x in axes if x != axis]
    lines = vox.groupBy(*others).agg(F.array_sort(F.collect_list(F.struct(axis, value))).alias("line"))
    lines = lines.select(*others, F.transform("line", lambda p: p[value]).alias("vals"))
    reach = int(4 * sigma + 0.5)
    taps = [math.exp(-0.5 * (t / sigma) ** 2) for t in range(-reach, reach + 1)]

    def change(column):
        for row in column:
            x = np.array(row.as_py(), float)
            n = len(x)
            at = np.arange(-reach, reach + 1)[:, None] + np.arange(n)[None, :]
            m = np.mod(at, 2 * n)
            yield np.array(taps) / sum(taps) @ x[np.where(m < n, m, 2 * n - 1 - m)]

    return with_vals(lines, change).select(*others, F.posexplode("vals").alias(axis, value)).select(*axes, value)


def edge_weight(vox: DataFrame, axes: list[str], sigma: float = 2.0, value: str = "mu") -> DataFrame:
    """Edges that stand out at all of three scales: geometric mean of gradient sizes, each over its largest, and over its own.

    Central differences of the volume smoothed by sigma / 4, sigma / 2 and sigma; at a face that of the
    voxel beside it.
    """
    out = None
    for n, s in enumerate((sigma / 4, sigma / 2, sigma)):
        smooth = vox.select(*axes, value)
        for x in axes:
            smooth = smooth_axis(smooth, axes, x, s, value)
        square = F.lit(0.0)
        for x in axes:
            w = Window.partitionBy(*[y for y in axes if y != x]).orderBy(x)
            smooth = smooth.withColumn(f"g_{x}", (F.lead(value).over(w) - F.lag(value).over(w)) / 2)
            smooth = smooth.withColumn(f"g_{x}", F.coalesce(f"g_{x}", F.lead(f"g_{x}").over(w), F.lag(f"g_{x}").over(w), F.lit(0.0)))
            square = square + F.col(f"g_{x}") * F.col(f"g_{x}")
        size = smooth.select(*axes, F.sqrt(square).alias(f"e{n}"))
        most = size.agg(F.max(f"e{n}").alias("most"))
        size = size.crossJoin(F.broadcast(most)).select(*axes, F.when(F.col("most") > 0, F.col(f"e{n}") / F.col("most")).otherwise(F.col(f"e{n}")).alias(f"e{n}"))
        out = size if out is None else out.join(size, axes)
    mean = out.select(*axes, F.pow(F.col("e0") * F.col("e1") * F.col("e2"), F.lit(1.0 / 3)).alias("weight"))
    most = mean.agg(F.max("weight").alias("most"))
    return mean.crossJoin(F.broadcast(most)).select(*axes, F.when(F.col("most") > 0, F.col("weight") / F.col("most")).otherwise(F.col("weight")).alias("weight"))


def _all_sums(df: DataFrame, along: str, across: list[str], columns: list[str], taps: list[float], back: bool = False) -> DataFrame:
    """Weighted sums over the next samples along an axis, null where one is missing; ``back``: the adjoint, over those before, which are nothing where missing."""
    w = Window.partitionBy(*across).orderBy(along)
    at = (lambda c, i: F.coalesce(F.lag(c, i).over(w), F.lit(0.0))) if back else (lambda c, i: F.lead(c, i).over(w))
    return df.withColumns({c: sum((at(c, i) * x for i, x in enumerate(taps[1:], 1)), F.col(c) * taps[0]) for c in columns})


def structure_slopes(pairs: DataFrame, group: list[str], span: Column, contrast: bool = False, width: int = 11, sigma: float = 1.5) -> DataFrame:
    """The mean SSIM of each group (or of its contrast part) and its slope at each pixel of ``p``: (group, b, a, mean, slope).

    SSIM at a place is a function of five windowed sums; its slopes in the three that hold p go back to the pixels
    by the adjoint of the sums: the same taps, turned round. A group without a valid place has no row.
    """
    taps, names = gaussian_taps(width, sigma), ["x", "y", "xx", "yy", "xy"]
    p, t = F.col("p"), F.col("t")
    m = pairs.select(*group, "b", "a", p.alias("__p"), t.alias("__t"), span.alias("__span"), p.alias("x"), t.alias("y"), (p * p).alias("xx"), (t * t).alias("yy"), (p * t).alias("xy"))
    m = _all_sums(_all_sums(m, "a", [*group, "b"], names, taps), "b", [*group, "a"], names, taps)
    x, y, c1, c2 = F.col("x"), F.col("y"), F.pow(0.01 * F.col("__span"), 2), F.pow(0.03 * F.col("__span"), 2)
    raw = F.col("xx") - x * x
    moves = F.when(raw > 0, 1.0).otherwise(0.0)
    m = m.withColumns({"__a": 2 * x * y + c1, "__b": x * x + y * y + c1, "__d": 2 * (F.col("xy") - x * y) + c2, "__e": F.greatest(raw, F.lit(0.0)) + F.greatest(F.col("yy") - y * y, F.lit(0.0)) + c2, "__moves": moves})
    a, b, d, e, moves = (F.col(f"__{n}") for n in ("a", "b", "d", "e", "moves"))
    light = F.when(a.isNotNull(), 1.0) if contrast else a / b  # null where a window is not whole
    by_x = light * (-2 * y / e + 2 * x * moves * d / (e * e))
    if not contrast:
        by_x = by_x + d / e * (2 * y * b - 2 * x * a) / (b * b)
    m = m.withColumns({"s": light * d / e, "g1": by_x, "g2": -light * moves * d / (e * e), "g3": 2 * light / e})
    means = m.groupBy(*group).agg(F.avg("s").alias("mean"), F.count("s").alias("__n")).filter("__n > 0")
    m = m.select(*group, "b", "a", "__p", "__t", *(F.coalesce(g, F.lit(0.0)).alias(g) for g in ("g1", "g2", "g3")))
    m = _all_sums(_all_sums(m, "a", [*group, "b"], ["g1", "g2", "g3"], taps, True), "b", [*group, "a"], ["g1", "g2", "g3"], taps, True)
    return m.join(means, group).select(*group, "b", "a", "mean", ((F.col("g1") + 2 * F.col("__p") * F.col("g2") + F.col("__t") * F.col("g3")) / F.col("__n")).alias("slope"))


def structural_gradient(pairs: DataFrame, group: list[str], span: Column, scales: bool = False, weight: float = 1.0, with_mse: bool = True, weights: tuple[float, ...] = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)) -> DataFrame:
    """Loss and exact gradient in ``p`` of weight * (1 - SSIM), or with ``scales`` (1 - multi-scale SSIM), plus the mean square: (group, b, a, loss, g).

    SSIM alone hardly tells a scale of the whole, so the mean square is part of it unless ``with_mse`` is false. At each coarser scale
    a slope goes back to the pixels whose mean was taken, in equal parts; pixels that a mean leaves out have none. A mean under 1e-3 counts as that and has no slope.
    """
    now = pairs.select(*group, "b", "a", "p", "t", span.alias("span"))
    size = now.groupBy(*group).agg(F.count("*").alias("__size"), F.avg(F.pow(F.col("p") - F.col("t"), 2)).alias("__mse"), (F.max("b") + 1).alias("__h"), (F.max("a") + 1).alias("__w"))
    if not scales:
        found = structure_slopes(now, group, F.col("span")).withColumnsRenamed({"mean": "value", "slope": "s"})
    else:
        levels = sum((F.when(F.least("__h", "__w") >= 11 * 2**s, 1).otherwise(0) for s in range(1, len(weights))), F.lit(1))
        level = checkpointed(now.join(size.select(*group, "__h", "__w", levels.alias("__levels")), group))
        now = level.select(*now.columns)
        present = {r[0] for r in level.select("__levels").distinct().collect()}  # at most as many as there are weights
        most = max(present, default=1)
        totals = F.array(*(F.lit(sum(weights[: s + 1])) for s in range(len(weights))))
        parts = None
        for s, share in enumerate(weights[:most]):
            if s:
                inner = level.filter(F.col("__levels") > s).withColumns({"__h": F.floor(F.col("__h") / 2), "__w": F.floor(F.col("__w") / 2)}).filter((F.col("b") < 2 * F.col("__h")) & (F.col("a") < 2 * F.col("__w")))
                level = inner.groupBy(*group, "__h", "__w", "__levels", F.floor(F.col("b") / 2).cast("int").alias("b"), F.floor(F.col("a") / 2).cast("int").alias("a")).agg(F.avg("p").alias("p"), F.avg("t").alias("t"), F.first("span").alias("span"))
                level = checkpointed(level)
            last, whole = level.filter(F.col("__levels") == s + 1), [*group, "__levels"]
            told = structure_slopes(last, whole, F.col("span")) if s + 1 in present or s + 1 == most else None
            if s + 1 < most:
                more = structure_slopes(level.filter(F.col("__levels") > s + 1), whole, F.col("span"), contrast=True)
                told = more if told is None else told.unionByName(more)
            told = told.withColumn("__share", share / F.element_at(totals, F.col("__levels")))
            log = F.col("__share") * F.ln(F.greatest(F.col("mean"), F.lit(1e-3)))
            slope = F.when(F.col("mean") > 1e-3, F.col("__share") / F.col("mean") * F.col("slope")).otherwise(0.0) / 4.0**s
            told = told.select(*group, F.lit(s).alias("__s"), "b", "a", log.alias("__log"), slope.alias("s"))
            told = checkpointed(told)  # read for its means and for its slopes
            parts = told if parts is None else parts.unionByName(told)
        logs = parts.groupBy(*group, "__s").agg(F.first("__log").alias("__log")).groupBy(*group).agg(F.exp(F.sum("__log")).alias("value"))
        # A pixel's slope is the sum over scales of that of the mean it is part of.
        pixels = now.select(*group, "b", "a", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("__s")).withColumns({"__b": F.floor(F.col("b") / F.pow(F.lit(2.0), F.col("__s"))).cast("int"), "__a": F.floor(F.col("a") / F.pow(F.lit(2.0), F.col("__s"))).cast("int")})
        met = pixels.join(parts.select(*group, "__s", F.col("b").alias("__b"), F.col("a").alias("__a"), "s"), [*group, "__s", "__b", "__a"])
        found = met.groupBy(*group, "b", "a").agg(F.sum("s").alias("s")).join(logs, group).withColumn("s", F.col("s") * F.col("value"))
    met = now.join(size.select(*group, "__size", "__mse"), group).join(found.select(*group, "b", "a", "value", "s"), [*group, "b", "a"])
    loss, g = weight * (1 - F.col("value")), -weight * F.col("s")
    if with_mse:
        loss, g = loss + F.col("__mse"), g + 2 * (F.col("p") - F.col("t")) / F.col("__size")
    return met.select(*group, "b", "a", loss.alias("loss"), g.alias("g"))
