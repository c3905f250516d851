"""Histograms, modes, quantiles and calibration anchors of value populations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.columns import mirrored
from sinoplan.operators.lineage import at_hand, checkpointed


#: Bins of a factor e, and parts that each bin is split into.
PER_FOLD, BINS = 512, 1 << 12


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin 0 to bins-1 of a value within [low, high]; the right edge belongs to the last bin."""
    return F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def magnitude_bin(v: Column) -> Column:
    """A bin by sign and logarithm, in the order of values: it needs no ends to be known, and a value far off makes no other bin fuller. NaN is the last."""
    size = F.least(F.floor((F.ln(F.abs(v)) + 746.0) * PER_FOLD), F.lit(1 << 21)) + 1
    return F.when(F.isnan(v), F.lit(1 << 22)).when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("int")


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float], lower: bool = False, eager: bool = False) -> DataFrame:
    """Exact linear quantiles of each group, one row a group: (group, x), x in the order of ``at``; ``lower``: the value at or before each place instead.

    Two scans with small shuffles, and no task holds a group. The first counts values in bins by magnitude, which tells in which bin
    each rank lies; the second takes the values of those bins alone, counts equal ones, and puts them in order within 4096 parts of
    the bin's own range, of which only those with a rank go on. So neither a value far off nor very many values close together fill
    one task, unless they differ by less than 2^-20 of their size, or are equal: then they are one row. Nulls are left out.
    ``eager``: the first scan runs at once, and its few bins come to the rows, which are then not shuffled.
    """
    rows = df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()).withColumn("b0", magnitude_bin(F.col("v")))
    place = F.transform(F.lit([float(p) for p in at]), lambda p: p * (F.col("n") - 1))
    ends = [F.transform(place, lambda p: F.floor(p)), F.transform(place, lambda p: F.ceil(p))]
    ranks = F.array_distinct(F.concat(*ends[: 1 if lower else 2]))
    inside = lambda low, high: F.filter("ranks", lambda r: (r >= low) & (r < high))
    whole = Window.partitionBy(*group)
    upto = Window.unboundedPreceding, 0

    bins = rows.groupBy(*group, "b0").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("m"))
    bins = bins.withColumns({"upto": F.sum("m").over(whole.orderBy("b0").rowsBetween(*upto)), "n": F.sum("m").over(whole)}).withColumn("before", F.col("upto") - F.col("m"))
    first = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("upto")))
    bins = bins.withColumn("ranks", first).filter(F.size("ranks") > 0).select(*group, "b0", "lo", "hi", "before", "n", "ranks")
    bins = at_hand(bins) if eager else bins

    part = F.coalesce(F.least(F.floor(F.nanvl(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(1.0)) * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    some = rows.join(bins, [*group, "b0"]).groupBy(*group, "b0", part.alias("b1"), "v").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in ("before", "n", "ranks")))
    parts = some.groupBy(*group, "b0", "b1").agg(F.sum("m").alias("size"), *(F.first(c).alias(c) for c in ("before", "ranks")))
    parts = parts.withColumn("end", F.col("before") + F.sum("size").over(Window.partitionBy(*group, "b0").orderBy("b1").rowsBetween(*upto)))
    parts = parts.withColumn("start", F.col("end") - F.col("size")).filter(F.size(inside(F.col("start"), F.col("end"))) > 0).select(*group, "b0", "b1", "start")
    found = some.join(parts, [*group, "b0", "b1"]).withColumn("upto", F.col("start") + F.sum("m").over(Window.partitionBy(*group, "b0", "b1").orderBy("v").rowsBetween(*upto)))
    found = found.select(*group, "n", "v", F.explode(inside(F.col("upto") - F.col("m"), F.col("upto"))).alias("rank"))
    found = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("by"), F.first("n").alias("n"))
    read = lambda p: F.element_at("by", F.floor(p)) + (F.element_at("by", F.ceil(p)) - F.element_at("by", F.floor(p))) * (p - F.floor(p))
    return found.select(*group, F.transform(place, (lambda p: F.element_at("by", F.floor(p))) if lower else read).alias("x"))


def lower_median(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """The lower of the two middle values of each group, one row a group."""
    return quantiles(df, group, value, [0.5], lower=True, eager=True).select(*group, F.col("x")[0].alias(out))


def named_quantiles(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``quantiles`` as columns of their own."""
    found = quantiles(df, group, value, list(at.values()))
    return found.select(*group, *(F.col("x")[n].alias(name) for n, name in enumerate(at)))


def limits(df: DataFrame, group: list[str], value: str, low: float, high: float) -> DataFrame:
    """Two percentiles of each group, one row a group."""
    return named_quantiles(df, group, value, {"low": low, "high": high})


def histogram(df: DataFrame, group: list[str], value: str, edges: DataFrame | None = None, bins: int = 256, low: float | None = None, high: float | None = None) -> DataFrame:
    """Counts of all bins, empty ones too: (group, bin, low, high, n). ``edges`` (group, low, high) or fixed ones."""
    if edges is None:
        edges = df.select(*group).distinct().withColumns({"low": F.lit(float(low)), "high": F.lit(float(high))})
    met = df.join(edges, group) if group else df.crossJoin(F.broadcast(edges))
    inside = met.filter((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")) & (F.col("high") > F.col("low")))
    counts = inside.groupBy(*group, bin_of(F.col(value), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.filter("high > low").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*group, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mode(df: DataFrame, group: list[str], value: str, bins: int = 256) -> DataFrame:
    """Tallest bin between the percentiles 0.5 and 99.5, refined by a parabola; the median if they are equal."""
    told = named_quantiles(df, group, value, {"low": 0.005, "high": 0.995, "median": 0.5})
    told = checkpointed(told)  # one row a group
    edges = told.drop("median")
    hist = histogram(df, group, value, edges, bins)
    w = Window.partitionBy(*group).orderBy("bin")
    beside = hist.withColumns({"y0": F.lag("n").over(w), "y2": F.lead("n").over(w)})
    top = beside.groupBy(*group).agg(F.max_by(F.struct("bin", "n", "y0", "y2", "low", "high"), F.struct("n", -F.col("bin"))).alias("t")).select(*group, "t.*")
    size = (F.col("high") - F.col("low")) / bins
    bend = F.col("y0") - 2.0 * F.col("n") + F.col("y2")
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("y0") - F.col("y2")) / F.nullif(bend, F.lit(0.0))))
    peak = top.select(*group, (F.col("low") + (F.col("bin") + 0.5) * size + F.coalesce(shift, F.lit(0.0)) * size).alias("mode"))
    return told.select(*group, "median").join(peak, group, "left").select(*group, F.coalesce("mode", "median").alias("mode"))


def smoothed_counts(hist: DataFrame, group: list[str], sigma: float = 3.0) -> DataFrame:
    """Gaussian smoothing of a full histogram, reflected at the ends."""
    reach = int(4.0 * sigma + 0.5)
    weights = hist.sparkSession.range(-reach, reach + 1).select(F.col("id").cast("int").alias("d"), F.exp(-0.5 * F.pow(F.col("id") / sigma, 2)).alias("w"))
    weights = weights.crossJoin(weights.agg(F.sum("w").alias("all"))).select("d", (F.col("w") / F.col("all")).alias("w"))
    n = hist.groupBy(*group).agg((F.max("bin") + 1).alias("bins"))
    taps = hist.select(*group, "bin").join(n, group).crossJoin(F.broadcast(weights))
    taps = taps.withColumn("from", mirrored(F.col("bin") + F.col("d"), F.col("bins")).cast("int"))
    source = hist.select(*group, F.col("bin").alias("from"), F.col("n").alias("y"))
    return taps.join(source, [*group, "from"]).groupBy(*group, "bin").agg(F.sum(F.col("w") * F.col("y")).alias("h"))


def peaks(hist: DataFrame, group: list[str], height: str = "n") -> DataFrame:
    """Strict local maxima (the middle of a plateau) of a full histogram with their prominence and basin.

    Prominence: the height above the higher of the lowest points on the way to a higher bin on
    either side, or to the end. A histogram has at most some thousand bins, so bins meet bins.
    """
    w = Window.partitionBy(*group).orderBy("bin")
    runs = hist.withColumn("new", F.when(F.col(height) == F.lag(height).over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    flat = runs.groupBy(*group, "run").agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.first(height).alias("h"))
    v = Window.partitionBy(*group).orderBy("run")
    tops = flat.withColumns({"left": F.lag("h").over(v), "right": F.lead("h").over(v)}).filter("h > left AND h > right")
    tops = tops.select(*group, F.floor((F.col("b0") + F.col("b1")) / 2).cast("int").alias("peak"), "h")
    bins = hist.select(*group, "bin", F.col(height).alias("y"))
    reach = tops.join(bins, group).groupBy(*group, "peak", "h").agg(F.coalesce(F.max(F.when((F.col("bin") < F.col("peak")) & (F.col("y") > F.col("h")), F.col("bin"))), F.lit(-1)).alias("lo"), F.min(F.when((F.col("bin") > F.col("peak")) & (F.col("y") > F.col("h")), F.col("bin"))).alias("hi"))
    met = reach.join(bins, group).filter((F.col("bin") > F.col("lo")) & (F.col("hi").isNull() | (F.col("bin") < F.col("hi"))))
    left, right = F.col("bin") <= F.col("peak"), F.col("bin") >= F.col("peak")
    # Where several bins are lowest, the first on the way from the left end counts on either side.
    least = met.groupBy(*group, "peak", "h").agg(F.min(F.when(left, F.struct("y", "bin"))).alias("l"), F.min(F.when(right, F.struct("y", "bin"))).alias("r"))
    return least.select(*group, "peak", "h", (F.col("h") - F.greatest("l.y", "r.y")).alias("prominence"), F.col("l.bin").alias("left_base"), F.col("r.bin").alias("right_base"))


def value_quantum(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The smallest gap between different values of each group (null where there is but one).

    A range shuffle deals the order of values out, however they lie; gaps are looked for in each part, and from
    one part's last value to the next one's first.
    """
    values = df.select(*group, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()).distinct()
    parts = checkpointed(values.repartitionByRange(*group, "v").withColumn("part", F.spark_partition_id()))  # its ends are drawn by sampling
    gaps = parts.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy(*group, "part").orderBy("v")))
    bins = gaps.groupBy(*group, "part").agg(F.min("gap").alias("gap"), F.min("v").alias("low"), F.max("v").alias("high"))
    beside = F.col("low") - F.lag("high").over(Window.partitionBy(*group).orderBy("part"))
    return bins.withColumn("gap", F.least("gap", beside)).groupBy(*group).agg(F.min("gap").alias("quantum"))


def landmarks(df: DataFrame, group: list[str], value: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    shares = [F.avg(((F.col(value) >= a) & (F.col(value) < b)).cast("double")).alias(name) for name, (a, b) in bands.items()]
    at = {f"p{str(q * 100).rstrip('0').rstrip('.').replace('.', '_')}": q for q in (0.01, 0.5, 0.99, 0.999)}
    return df.groupBy(*group).agg(*shares, F.min(value).alias("low"), F.max(value).alias("high")).join(named_quantiles(df, group, value, at), group)


def statistics(df: DataFrame, group: list[str], value: str, split: float) -> DataFrame:
    """Quantiles, moments (population) and the modes on both sides of a value."""
    all_of = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    all_of = all_of.join(named_quantiles(df, group, value, {"p1": 0.01, "p50": 0.5, "p99": 0.99, "p99_9": 0.999}), group)
    below, above = mode(df.filter(F.col(value) < split), group, value), mode(df.filter(F.col(value) >= split), group, value)
    return all_of.join(below.withColumnRenamed("mode", "air_mode"), group, "left").join(above.withColumnRenamed("mode", "tissue_mode"), group, "left")


def find_anchors(df: DataFrame, group: list[str], value: str, bins: int = 256, least_mass: float = 0.005, air_ratio: float = 0.25, tissue_ratio: float = 0.2) -> DataFrame:
    """Air and tissue anchors of each population from the peaks of its smoothed histogram.

    Range: percentiles 0.02 and 99.98 with 3 % of the span beside them. Air: the lowest peak whose
    basin holds ``least_mass`` and whose prominence is ``air_ratio`` of its height. Tissue: of the
    peaks clearly above it with ``tissue_ratio``, the one of the largest basin, else the largest of all
    (flagged). Populations without either are left out.
    """
    # One row a group, and the bins of each: what follows reads both several times.
    edges = limits(df, group, value, 0.0002, 0.9998).select(*group, (F.col("low") - 0.03 * (F.col("high") - F.col("low"))).alias("low"), (F.col("high") + 0.03 * (F.col("high") - F.col("low"))).alias("high"))
    hist = checkpointed(histogram(df, group, value, checkpointed(edges), bins))
    smooth = smoothed_counts(hist, group)
    tops = peaks(smooth.withColumn("n", F.round("h", 9)), group)
    raw = hist.select(*group, "bin", "n", "low", "high")
    total = hist.groupBy(*group).agg(F.sum("n").alias("total"))
    mass = lambda t, start: t.join(raw, group).filter((F.col("bin") >= start) & (F.col("bin") <= F.col("right_base"))).groupBy(*group, "peak", "h", "prominence").agg(F.sum("n").alias("mass"), F.first("low").alias("low"), F.first("high").alias("high"))
    airs = mass(tops, F.col("left_base")).join(total, group).filter((F.col("mass") >= least_mass * F.col("total")) & (F.col("prominence") >= air_ratio * F.col("h")))
    air = airs.groupBy(*group).agg(F.min("peak").alias("air_bin"))
    later = tops.join(air, group).filter(F.col("peak") > F.col("air_bin") + max(1, int(0.02 * bins)))
    basins = mass(later, F.greatest("left_base", F.col("air_bin") + 1)).join(air, group)
    good = (F.col("prominence") >= tissue_ratio * F.col("h")).cast("int")
    tissue = basins.groupBy(*group, "air_bin").agg(F.max_by(F.struct(F.col("peak").alias("tissue_bin"), "low", "high", good.alias("clear")), F.struct(good, "mass", -F.col("peak"))).alias("t"))
    at = lambda b: F.col("t.low") + (F.col(b) + 0.5) * (F.col("t.high") - F.col("t.low")) / bins
    return tissue.select(*group, at("air_bin").alias("air"), at("t.tissue_bin").alias("tissue"), (F.col("t.clear") == 1).alias("clear"))


def quantile_function(df: DataFrame, group: list[str], value: str, n: int = 256) -> DataFrame:
    """n quantiles at the middles of equal shares: (group, q, value)."""
    at = [(i + 0.5) / n for i in range(n)]
    found = quantiles(df, group, value, at)
    return found.select(*group, F.posexplode("x").alias("q", "x"))


def quantile_distance(left: DataFrame, right: DataFrame, on: list[str], weight: Column | None = None) -> DataFrame:
    """(Weighted) mean distance of two quantile functions: the 1-Wasserstein distance in the limit."""
    w = F.lit(1.0) if weight is None else weight
    met = left.withColumnRenamed("x", "x1").join(right.withColumnRenamed("x", "x2"), [*on, "q"])
    return met.groupBy(*on).agg((F.sum(w * F.abs(F.col("x1") - F.col("x2"))) / F.sum(w)).alias("distance"))


def warnings_of(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


def any_of(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns)
