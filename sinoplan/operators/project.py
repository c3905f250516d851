"""Interpolation joins, forward projection and backprojection.

A sample meets the voxels around it by an equality of integer corners, never by a range: a theta
join would compare all samples with all voxels.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.columns import PI
from sinoplan.operators.blocks import sampled
from sinoplan.operators.lineage import checkpointed


def corners(df: DataFrame, at: dict[str, Column]) -> DataFrame:
    """A row for each integer corner around a place: the axes' indices and the weight ``w``; corners of no weight are left out."""
    for axis, place in at.items():
        base = F.floor(place).cast("int")
        df = df.withColumns({f"__b{axis}": base, f"__f{axis}": place - base})
    pairs = [F.struct(F.col(f"__b{x}").alias("i"), (1 - F.col(f"__f{x}")).alias("w")) for x in at], [F.struct((F.col(f"__b{x}") + 1).alias("i"), F.col(f"__f{x}").alias("w")) for x in at]
    options = []
    for n in range(1 << len(at)):
        picked = [pairs[n >> k & 1][k] for k in range(len(at))]
        options.append(F.struct(*(p["i"].alias(x) for p, x in zip(picked, at, strict=True)), reduce(lambda a, b: a * b, (p["w"] for p in picked)).alias("w")))
    out = df.withColumn("__c", F.explode(F.array(*options))).filter(F.col("__c.w") != 0)
    return out.withColumns({x: F.col(f"__c.{x}") for x in at} | {"w": F.col("__c.w")}).drop("__c", *(f"__{s}{x}" for s in "bf" for x in at))


def sample(points: DataFrame, keys: list[str], at: dict[str, Column], grid: DataFrame, value: str, factor: Column | None = None) -> DataFrame:
    """(Tri)linear samples of a grid summed by key: outside of it there is nothing."""
    met = corners(points, at).join(grid.select(*at, value), list(at), "left")
    each = F.col("w") * F.coalesce(F.col(value), F.lit(0.0))
    return met.groupBy(*keys).agg(F.sum(each if factor is None else each * factor).alias(value))


def quadrature(rays: DataFrame, samples: int) -> DataFrame:
    """Midpoints of equal pieces of each ray's segment: x, y, z and the piece's length dt."""
    pieces = rays.filter("hit").withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    dt = (F.col("t_far") - F.col("t_near")) / samples
    t = F.col("t_near") + (F.col("__s") + 0.5) * dt
    return pieces.withColumns({"dt": dt, "x": F.col("ox") + t * F.col("dx"), "y": F.col("oy") + t * F.col("dy"), "z": F.col("oz") + t * F.col("dz")}).drop("__s")


def system_matrix(rays: DataFrame, samples: int, shape: tuple[int, int, int], size: float, key: str = "ray_id") -> DataFrame:
    """Weights (ray, i, j, l, w) of each voxel in the line integral of each ray, grid centred on the origin."""
    points = quadrature(rays, samples)
    at = {axis: F.col(c) / size + (n - 1) / 2 for axis, c, n in zip("ijl", "xyz", shape, strict=True)}
    inside = reduce(lambda a, b: a & b, ((F.col(x) >= 0) & (F.col(x) < n) for x, n in zip("ijl", shape, strict=True)))
    return corners(points.select(key, "dt", "x", "y", "z"), at).filter(inside).groupBy(key, "i", "j", "l").agg(F.sum(F.col("w") * F.col("dt")).alias("w"))


def forward(matrix: DataFrame, vox: DataFrame, value: str = "mu", key: str = "ray_id") -> DataFrame:
    """Line integrals of a volume along the rays of a matrix."""
    return matrix.join(vox, ["i", "j", "l"]).groupBy(key).agg(F.sum(F.col("w") * F.col(value)).alias("p"))


def backward(matrix: DataFrame, rays: DataFrame, value: str, key: str = "ray_id") -> DataFrame:
    """The transpose: what rays spread over the voxels they cross."""
    return matrix.join(rays, key).groupBy("i", "j", "l").agg(F.sum(F.col("w") * F.col(value)).alias("v"))


def _footprint(c: Column, s: Column, r_s: float, sdd: float, pitch: float, cpa: float, cpb: float) -> dict[str, Column]:
    """The rows and columns of a detector that a box of voxels (x0..z1) can fall on: its corners bound it."""
    at = {"b": [], "a": []}
    for n in range(8):
        x, y, z = (F.col(f"{axis}{n >> k & 1}") for k, axis in enumerate("xyz"))
        scale = sdd / (r_s + x * c + y * s + 1e-8) / pitch
        at["b"].append(scale * z + cpb)
        at["a"].append(scale * (y * c - x * s) + cpa)
    return {f"{axis}{end}": F.floor(f(*places)).cast("int") + end for axis, places in at.items() for end, f in ((0, F.least), (1, F.greatest))}


def _accumulate(r_s: float, sdd: float, pitch: float, cpa: float, cpb: float, weighted: bool):
    def run(key, vox, seen):
        x, y, z = (vox[c].to_numpy() for c in "xyz")
        total = np.zeros(len(x))
        seen = seen.sort_by([("k", "ascending"), ("b", "ascending")])
        k, b, theta, a0 = (seen[c].to_numpy() for c in ("k", "b", "theta", "a0"))
        rows = seen["vals"].combine_chunks()
        for at in np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)]):
            end = at + int(np.searchsorted(k[at:], k[at], "right"))
            width = len(rows[int(at)])
            # The window with nothing around it, so that corners outside of it read as zero.
            window = np.zeros((int(b[end - 1] - b[at]) + 3, width + 2))
            window[b[at:end] - b[at] + 1, 1:-1] = rows.slice(int(at), end - int(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            s, c = np.sin(theta[at]), np.cos(theta[at])
            u = r_s + x * c + y * s + 1e-8
            pb, pa_ = sdd / u * z / pitch + cpb - b[at] + 1, sdd / u * (y * c - x * s) / pitch + cpa - a0[at] + 1
            fb, fa = np.floor(pb), np.floor(pa_)
            scale = (r_s / u) ** 2 if weighted else 1.0
            for db in (0, 1):
                for da in (0, 1):
                    i, j = (fb + db).astype(int), (fa + da).astype(int)
                    inside = (i >= 0) & (i < window.shape[0]) & (j >= 0) & (j < window.shape[1])
                    weight = np.abs(1 - db - (pb - fb)) * np.abs(1 - da - (pa_ - fa)) * scale
                    total += np.where(inside, window[np.where(inside, i, 0), np.where(inside, j, 0)], 0.0) * weight
        return pa.table([vox["i"], vox["j"], vox["l"], pa.array(total)], names=["i", "j", "l", "bp"])

    return run


def backproject(vox: DataFrame, rows: DataFrame, views: DataFrame, r_s: float, sdd: float, pitch: float, cpa: float, cpb: float, weighted: bool = True, tile: int = 32, lot: int = 512) -> DataFrame:
    """Voxel-driven backprojection: each voxel (i, j, l, x, y, z) takes from each view (k, theta) what its ray shows.

    ``rows``: detector rows (k, b, vals), all of one length in a view. A tile of ``tile`` voxels a side
    meets, of ``lot`` views at a time, only the window of the detector that it can fall on: rows are
    found by (k, b) and cut to the window's columns, and sums are made in the tile. What is shuffled
    are windows, not voxels times views. Every voxel has a row; nothing is outside the detector.
    """
    place = [F.floor(F.col(x) / tile).cast("int").alias(f"t{x}") for x in "ijl"]
    tiled = vox.select("i", "j", "l", *(F.col(c).cast("double").alias(c) for c in "xyz"), *place)
    names = ["ti", "tj", "tl"]
    boxes = tiled.groupBy(*names).agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in ((0, F.min), (1, F.max))))
    boxes = boxes.select(*(F.col(n).alias(n.replace("t", "s")) for n in names), *(f"{c}{n}" for c in "xyz" for n in (0, 1)))
    met = boxes.crossJoin(views.select("k", F.col("theta").cast("double").alias("theta")))
    met = met.withColumns(_footprint(F.cos("theta"), F.sin("theta"), r_s, sdd, pitch, cpa, cpb))
    boxed = ["si", "sj", "sl"]
    asked = met.select(*boxed, "k", "theta", "a0", "a1", F.explode(F.sequence(F.col("b0"), F.col("b1"))).alias("b"))
    first = F.greatest(F.col("a0"), F.lit(0))
    last = F.least(F.col("a1"), F.size("vals") - 1)
    seen = asked.join(rows.select("k", "b", "vals"), ["k", "b"]).filter(last >= first)
    seen = seen.select(*boxed, F.floor(F.col("k") / lot).cast("int").alias("lot"), "k", "b", "theta", first.alias("a0"), F.slice("vals", first + 1, last - first + 1).alias("vals"))
    lots = views.select(F.floor(F.col("k") / lot).cast("int").alias("lot")).distinct()
    parts = tiled.crossJoin(lots).groupBy(*names, "lot").cogroup(seen.groupBy(*boxed, "lot")).applyInArrow(_accumulate(r_s, sdd, pitch, cpa, cpb, weighted), "i int, j int, l int, bp double")
    return parts.groupBy("i", "j", "l").agg(F.sum("bp").alias("bp"))


def shift(vox: DataFrame, axes: dict[str, float], value: str = "mu") -> DataFrame:
    """Linear sub-voxel shift of a whole grid (i, j, l); beyond its edge the nearest voxel counts, and voxels that are not there count as nothing."""
    size = vox.agg(*(F.max(x) for x in "ijl")).first()
    last = [float(n or 0) for n in size]
    at = {x: F.least(F.greatest(F.col(x) + axes.get(x, 0.0), F.lit(0.0)), F.lit(n)) for x, n in zip("ijl", last, strict=True)}
    return sampled(vox.select(*"ijl"), at, vox, value)


def conjugate(beta: Column, gamma: Column) -> Column:
    """The view in which the same line is measured from the other side."""
    return F.pmod(beta + PI + 2 * gamma, F.lit(2 * PI))


def importance_samples(bins: DataFrame, key: str, count: int, eps: float = 1e-5) -> DataFrame:
    """Places along each ray drawn by weight: ``bins`` (key, s, lo, hi, w) in, (key, q, t) out.

    Place q is where the share (q + 0.5) / count of all weight lies below, on a straight line within
    its bin; ``eps`` keeps bins without weight open.
    """
    w = Window.partitionBy(key).orderBy("s")
    told = bins.withColumn("__w", F.col("w") + eps)
    share = F.col("__w") / F.sum("__w").over(Window.partitionBy(key))
    told = told.withColumn("__p", share).withColumn("__upto", F.sum("__p").over(w)).withColumn("__from", F.col("__upto") - F.col("__p"))
    first = F.greatest(F.ceil(F.col("__from") * count - 0.5 - 1e-12), F.lit(0))
    last = F.least(F.ceil(F.col("__upto") * count - 0.5 - 1e-12) - 1, F.lit(count - 1))
    placed = told.filter(last >= first).withColumn("q", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    part = ((F.col("q") + 0.5) / count - F.col("__from")) / F.greatest(F.col("__p"), F.lit(1e-5))
    return placed.select(key, "q", (F.col("lo") + part * (F.col("hi") - F.col("lo"))).alias("t"))


def hierarchical_rays(rays: DataFrame, vox: DataFrame, shape: tuple[int, int, int], size: float, coarse: int, fine: int, key: str = "ray_id", better: DataFrame | None = None) -> DataFrame:
    """Line integrals in two passes (key, p_coarse, p): equal pieces first, then more places where these found much.

    ``rays`` carry their segment (t_near, t_far, hit); ``vox`` is centred on the origin, its voxels ``size`` apart. Coarse pieces weigh by what
    they add to the integral; ``fine`` places are drawn from that by its quantiles. Both together, in order along the ray, each stand for what is nearer
    to them than to the next, out to the ends of the segment, so widths add up to it. ``better``: another volume to read in the second
    pass. Rays that miss count as 0; each ray's samples meet in one window of ``coarse`` + ``fine`` rows.
    """
    along = {c: F.col(f"o{c}") + F.col("t") * F.col(f"d{c}") for c in "xyz"}
    at = {x: F.col(c) / size + (n - 1) / 2 for x, c, n in zip("ijl", "xyz", shape, strict=True)}
    line = [key, "t_near", "t_far", *(f"{s}{c}" for s in "od" for c in "xyz")]
    dt = (F.col("t_far") - F.col("t_near")) / coarse
    pieces = rays.filter("hit").select(*line, F.explode(F.sequence(F.lit(0), F.lit(coarse - 1))).alias("s")).withColumns({"dt": dt, "lo": F.col("t_near") + F.col("s") * dt})
    pieces = pieces.withColumn("t", F.col("lo") + F.col("dt") / 2).withColumns(along)
    seen = checkpointed(sampled(pieces, at, vox))
    bins = seen.select(key, "s", "lo", (F.col("lo") + F.col("dt")).alias("hi"), F.greatest(F.col("mu") * F.col("dt"), F.lit(0.0)).alias("w"))
    more = importance_samples(bins, key, fine).join(rays.select(*line), key).withColumns(along)
    found = sampled(more, at, vox if better is None else better).withColumn("part", F.lit(0.0))
    first = seen.withColumn("part", F.col("mu") * F.col("dt"))
    if better is not None:
        first = sampled(first.drop("mu"), at, better)
    every = first.select(key, "t", "t_near", "t_far", "mu", "part").unionByName(found.select(key, "t", "t_near", "t_far", "mu", "part"))
    w = Window.partitionBy(key).orderBy("t")
    ends = F.coalesce((F.lead("t").over(w) + F.col("t")) / 2, F.col("t_far")), F.coalesce((F.lag("t").over(w) + F.col("t")) / 2, F.col("t_near"))
    total = every.withColumn("width", ends[0] - ends[1]).groupBy(key).agg(F.sum("part").alias("p_coarse"), F.sum(F.col("mu") * F.col("width")).alias("p"))
    return rays.select(key).join(total, key, "left").select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p_coarse", "p")))


def midplanes(vox: DataFrame, n: tuple[int, int, int], value: str = "mu") -> DataFrame:
    """The three planes through the middle voxel: (view, u, v, value); the filters reach the scan."""
    planes = {"axial": ("l", "i", "j"), "coronal": ("j", "i", "l"), "sagittal": ("i", "j", "l")}
    out = None
    for (view, (axis, u, v)), size in zip(planes.items(), (n[2], n[1], n[0]), strict=True):
        plane = vox.filter(F.col(axis) == size // 2).select(F.lit(view).alias("view"), F.col(u).alias("u"), F.col(v).alias("v"), value)
        out = plane if out is None else out.unionByName(plane)
    return out
