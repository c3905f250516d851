"""Ordered state: when a metric stops improving, where a curve bends, when a rate is cut.

Input: one row an evaluation (run, iter, m). What depends on a running best is a window over earlier
rows; only the rate reducer is a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def patience_for(n: Column, closed_loop: bool = False) -> Column:
    return F.lit(4) if closed_loop else F.greatest(F.lit(8), F.ceil(0.25 * n)).cast("int")


def stopping_trace(metric: DataFrame, absolute: float = 0.0, relative: float = 0.0, patience: int | None = None, start: int | None = None, group: str = "run") -> DataFrame:
    """Best so far, progress and patience of each evaluation (higher is better).

    The best moves by any gain; progress needs more than ``absolute`` or ``relative`` of the best before,
    whichever is more. NaN is never better. ``stop`` holds from ``start`` on once ``patience``
    evaluations in a row made no progress. Null: a quarter of the evaluations, at least 8; half of them.
    """
    w = Window.partitionBy(group).orderBy("iter")
    value = F.when(~F.isnan("m"), F.col("m"))
    best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    count = F.count("*").over(Window.partitionBy(group))
    told = metric.withColumns({"__v": value, "best_before": best, "__n": count})
    margin = F.greatest(F.lit(absolute), F.when(F.col("best_before") != 0, relative * F.abs("best_before")).otherwise(F.lit(0.0)))
    told = told.withColumns({"is_best": F.coalesce(F.col("__v") > F.col("best_before"), F.col("__v").isNotNull()), "progress": F.coalesce(F.col("__v") > F.col("best_before") + margin, F.col("__v").isNotNull())})
    told = told.withColumn("__i", F.row_number().over(w))
    last = F.max(F.when(F.col("progress"), F.col("__i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    told = told.withColumn("bad", (F.col("__i") - F.coalesce(last, F.lit(0))).cast("int"))
    wait = patience_for(F.col("__n")) if patience is None else F.lit(patience)
    since = F.floor(0.5 * F.col("__n")) if start is None else F.lit(start)
    return told.withColumn("stop", (F.col("iter") >= since) & (F.col("bad") >= wait)).drop("__v", "__n", "__i")


def delivered(trace: DataFrame, group: str = "run") -> DataFrame:
    """Where each run stops, and what it delivers: the best evaluation so far, or the last if it never stops."""
    ends = trace.groupBy(group).agg(F.min(F.when(F.col("stop"), F.col("iter"))).alias("stop_iter"), F.max("iter").alias("last_iter"))
    seen = trace.join(ends, group).filter(F.col("stop_iter").isNull() | (F.col("iter") <= F.col("stop_iter")))
    best = seen.groupBy(group).agg(F.max_by("iter", F.struct("m", -F.col("iter"))).alias("best_iter"))
    return ends.join(best, group).select(group, "stop_iter", F.when(F.col("stop_iter").isNull(), F.col("last_iter")).otherwise(F.col("best_iter")).alias("delivered_iter"))


def menger_curvature(points: DataFrame, x: str, y: str, group: str = "run") -> DataFrame:
    """Signed curvature of the circle through each point and its neighbours; null at ends and where points coincide."""
    w = Window.partitionBy(group).orderBy("iter")
    x0, y0, x2, y2 = F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)
    told = points.withColumns({"__x0": x0, "__y0": y0, "__x2": x2, "__y2": y2})
    side = lambda a, b, c, d: F.sqrt(F.pow(a - c, 2) + F.pow(b - d, 2))
    d01, d12, d02 = side(F.col(x), F.col(y), F.col("__x0"), F.col("__y0")), side(F.col("__x2"), F.col("__y2"), F.col(x), F.col(y)), side(F.col("__x2"), F.col("__y2"), F.col("__x0"), F.col("__y0"))
    cross = (F.col(x) - F.col("__x0")) * (F.col("__y2") - F.col("__y0")) - (F.col(y) - F.col("__y0")) * (F.col("__x2") - F.col("__x0"))
    return told.withColumn("curvature", F.when(F.least(d01, d12, d02) >= 1e-12, 2 * cross / (d01 * d12 * d02))).drop("__x0", "__y0", "__x2", "__y2")


def l_curve(points: DataFrame, residual: str, norm: str, group: str = "run", edge: int = 1, least: float = 0.5) -> DataFrame:
    """Curvature of log residual against log norm, each scaled to 0 and 1, and whether a point can be the corner.

    A corner lies beyond ``edge`` points of either end, bends by ``least``, and has the residual not
    rising and the norm not falling across it. Where there is none the curve has no corner.
    """
    every, w = Window.partitionBy(group), Window.partitionBy(group).orderBy("iter")
    scaled = lambda c: F.coalesce(F.try_divide(F.log(c) - F.min(F.log(c)).over(every), F.max(F.log(c)).over(every) - F.min(F.log(c)).over(every)), F.lit(0.0))
    told = points.withColumns({"x": scaled(residual), "y": scaled(norm), "__i": F.row_number().over(w), "__n": F.count("*").over(every)})
    bent = menger_curvature(told, "x", "y", group)
    falls = (F.lead("x").over(w) <= F.lag("x").over(w)) & (F.lead("y").over(w) >= F.lag("y").over(w))
    inner = (F.col("__i") > edge) & (F.col("__i") <= F.col("__n") - edge) & (F.col("__n") >= 5)
    return bent.withColumn("corner", F.coalesce(inner & (F.abs("curvature") >= least) & falls, F.lit(False))).drop("__i", "__n")


def smoothed_curve(points: DataFrame, columns: list[str], group: str = "run", width: int = 9) -> DataFrame:
    """Columns smoothed along iter by the parabola through ``width`` neighbours that fits best; at the ends, that of the first or last.

    Runs of fewer evaluations stay as they are. The weights of a parabola at t of what stands at u, both
    counted from the middle, are a constant, a linear and a quadratic part.
    """
    half = width // 2
    squares = sum(t * t for t in range(-half, half + 1))
    mean = squares / width
    fourth = sum((t * t - mean) ** 2 for t in range(-half, half + 1))
    weight = lambda t, u: 1.0 / width + t * u / squares + (t * t - mean) * (u * u - mean) / fourth
    each, every = Window.partitionBy(group).orderBy("iter"), Window.partitionBy(group)
    placed = points.withColumns({"__i": F.row_number().over(each) - 1, "__n": F.count("*").over(every)})
    start = F.greatest(F.lit(0), F.least(F.col("__i") - half, F.col("__n") - width))
    met = placed.select("*", F.explode(F.sequence(start, F.least(start + width, F.col("__n")) - 1)).alias("__j"), start.alias("__s"))
    source = placed.select(group, F.col("__i").alias("__j"), *(F.col(c).alias(f"__{c}") for c in columns))
    met = met.join(source, [group, "__j"]).withColumn("__w", weight(F.col("__i") - F.col("__s") - half, F.col("__j") - F.col("__s") - half))
    out = met.groupBy(*points.columns, "__n").agg(*(F.sum(F.col("__w") * F.col(f"__{c}")).alias(f"__s_{c}") for c in columns))
    return out.select(*(F.when(F.col("__n") < width, F.col(c)).otherwise(F.col(f"__s_{c}")).alias(c) if c in columns else c for c in points.columns))


def l_curve_corner(points: DataFrame, residual: str, norm: str, group: str = "run", width: int = 9, least: float = 0.5) -> DataFrame:
    """The corner of each run's L-curve (group, corner_iter, curvature), null where there is none.

    The curve is scaled and smoothed; of the points away from its ends that bend by ``least`` and across
    which the residual does not rise and the norm does not fall, the sharpest is the corner.
    """
    every, w = Window.partitionBy(group), Window.partitionBy(group).orderBy("iter")
    scaled = lambda c: F.coalesce(F.try_divide(F.log(c) - F.min(F.log(c)).over(every), F.max(F.log(c)).over(every) - F.min(F.log(c)).over(every)), F.lit(0.0))
    told = points.withColumns({"x": scaled(residual), "y": scaled(norm)}).select(group, "iter", residual, norm, "x", "y")
    bent = menger_curvature(smoothed_curve(told, ["x", "y"], group, width), "x", "y", group)
    bent = bent.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(every), "__trade": (F.lead(residual).over(w) <= F.lag(residual).over(w)) & (F.lead(norm).over(w) >= F.lag(norm).over(w))})
    edge = F.when(F.col("__n") >= width, width // 2).otherwise(0)
    inner = (F.col("__i") >= F.greatest(F.lit(1), edge + 1)) & (F.col("__i") < F.least(F.col("__n") - 1, F.col("__n") - edge - 1)) & (F.col("__n") >= 5)
    good = F.when(inner & F.col("__trade") & (F.abs("curvature") >= least), F.struct(F.abs("curvature").alias("size"), (-F.col("iter")).alias("later")))
    top = bent.groupBy(group).agg(F.max(good).alias("top"))
    return top.select(group, (-F.col("top.later")).cast("int").alias("corner_iter"), F.col("top.size").alias("curvature"))


def reduce_on_plateau(trace: DataFrame, rate: float, factor: float = 0.5, patience: int = 3, cooldown: int = 1, floor: float = 0.01, group: str = "run") -> DataFrame:
    """The rate after each evaluation: cut by ``factor`` after ``patience`` ones without progress, then left alone for ``cooldown``.

    A fold over the ordered evaluations of a run, which are few; its state is four numbers.
    """
    least = rate * floor
    steps = trace.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("iter", "progress"))).alias("steps"))
    start = F.struct(F.lit(rate).alias("rate"), F.lit(0).alias("bad"), F.lit(0).alias("rest"), F.array().cast("array<struct<iter:int,rate:double,bad:int>>").alias("out"))

    def step(s, e):
        resting = s["rest"] > 0
        bad = F.when(e["progress"], 0).when(resting, s["bad"]).otherwise(s["bad"] + 1)
        cut = ~e["progress"] & ~resting & (bad >= patience) & (s["rate"] > least * (1 + 1e-9))
        now = F.when(cut, F.greatest(s["rate"] * factor, F.lit(least))).otherwise(s["rate"])
        left = F.when(cut, cooldown).when(~e["progress"] & resting, s["rest"] - 1).otherwise(s["rest"])
        bad = F.when(cut, 0).otherwise(bad)
        return F.struct(now.alias("rate"), bad.cast("int").alias("bad"), left.cast("int").alias("rest"), F.concat(s["out"], F.array(F.struct(e["iter"].cast("int").alias("iter"), now.alias("rate"), bad.cast("int").alias("bad")))).alias("out"))

    return steps.select(group, F.inline(F.aggregate("steps", start, step)["out"]))
