"""Volumes of different grids: alignment by shift and scale, moving one onto the grid of another.

A grid is (n, d, o): voxels, pitch and centre in mm of each axis i, j, l; volumes are (i, j, l, mu).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoplan.operators.blocks import AXES, SIZE, dense, plane, resampled
from sinoplan.operators.lineage import checkpointed


@dataclass(frozen=True)
class Grid:
    n: tuple[int, int, int]
    d: tuple[float, float, float]
    o: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def position(self, axis: int, index: Column) -> Column:
        """Where a voxel's centre is."""
        return (index - (self.n[axis] - 1) / 2.0) * self.d[axis] + self.o[axis]


def places(grid: Grid, target: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each axis, where the voxels of ``target`` are in the index space of ``grid``; what misses an end by rounding alone is on it."""
    out = []
    for k in range(3):
        at = ((np.arange(target.n[k]) - (target.n[k] - 1) / 2.0) * target.d[k] + target.o[k] - grid.o[k]) / grid.d[k] + (grid.n[k] - 1) / 2.0
        last = grid.n[k] - 1
        out.append(np.where((at < 0) & (at > -1e-6), 0.0, np.where((at > last) & (at < last + 1e-6), last, at)))
    return tuple(out)


def resample(vox: DataFrame, grid: Grid, target: Grid, fill: float = 0.0) -> DataFrame:
    """A volume on another grid, trilinearly; voxels that it does not reach are ``fill``, not its edge."""
    return resampled(vox, grid.n, places(grid, target), fill)


def render_volume(model: DataFrame, grid: Grid, target: Grid, radius: float | None = None) -> DataFrame:
    """A model of one grid at every voxel of any other; nothing outside of the model's grid, nor beyond ``radius`` mm of its axis if that is given."""
    return _masked(resampled(model, grid.n, places(grid, target)), grid, target, radius)


def render_slice(model: DataFrame, grid: Grid, target: Grid, direction: str = "axial", index: int | None = None, radius: float | None = None) -> DataFrame:
    """One plane of ``render_volume``, read from the voxels beside it alone: axial across l, coronal across j, sagittal across i; the middle one by default."""
    across = {"axial": "l", "coronal": "j", "sagittal": "i"}
    if direction not in across:
        raise ValueError(f"unknown direction {direction!r}; known: {', '.join(sorted(across))}")
    return _masked(plane(model, grid.n, places(grid, target), across[direction], index), grid, target, radius)


def _masked(vox: DataFrame, grid: Grid, target: Grid, radius: float | None) -> DataFrame:
    if radius is None:
        return vox
    away = sum(((target.position(k, F.col(x)) - grid.o[k]) * (target.position(k, F.col(x)) - grid.o[k]) for k, x in ((0, "i"), (1, "j"))), F.lit(0.0))
    return vox.withColumn("mu", F.when(away <= radius * radius, F.col("mu")).otherwise(0.0))


def _tiles(grid: Grid, other: Grid, tries: list, stride: int) -> list[list[tuple[int, int]]]:
    """For each axis and tile of the reference, the voxels of the volume that any of the tries may read."""
    out = []
    for k, x in enumerate(AXES):
        windows = []
        for first in range(0, other.n[k], SIZE * stride):
            ends = np.array([first, min(first + SIZE * stride, other.n[k]) - 1])
            at = [_moved(grid, other, k, ends, t[f"o_{x}"], t[f"s_{x}"]) for t in tries]
            low, high = int(np.floor(np.min(at))), int(np.floor(np.max(at))) + 1
            windows.append((max(low, 0), min(high, grid.n[k] - 1)))
        out.append(windows)
    return out


def _moved(grid: Grid, other: Grid, k: int, index: np.ndarray, offset: float, scale: float) -> np.ndarray:
    """Where a try looks for voxels of the reference along an axis."""
    return scale * ((index - (other.n[k] - 1) / 2.0) * other.d[k] + other.o[k] + offset - grid.o[k]) / grid.d[k] + (grid.n[k] - 1) / 2.0


def alignment_scores(vox: DataFrame, grid: Grid, reference: DataFrame, other: Grid, tries: DataFrame, stride: int = 1, least: int = 1000) -> DataFrame:
    """Correlation of a volume with a reference for each try (t, o_i, o_j, o_l, s_i, s_j, s_l), over their overlap alone.

    A voxel of the reference at p is looked for at o + s * (p + offset - o), o the volume's centre. Tries
    are few, a line of candidates of one axis; the reference is thinned by ``stride`` along each axis.
    An overlap of less than ``least`` voxels scores -1. A tile of the reference meets the window of the volume that any of the
    tries may read, once for all of them; what leaves a tile are six sums a try. Voxels that are not there count as 0.
    """
    told = [r.asDict() for r in tries.collect()]
    spark, windows = vox.sparkSession, _tiles(grid, other, told, stride)
    edge = SIZE * stride
    thin = reference.filter(reduce(lambda a, b: a & b, (F.col(x) % stride == 0 for x in AXES)))
    points = thin.select(*(F.floor(F.col(x) / edge).cast("int").alias(f"t{x}") for x in AXES), *(F.col(x).cast("int").alias(x) for x in AXES), F.col("mu").cast("double").alias("ref"))
    source = vox.select(*(F.col(x).cast("int").alias(x) for x in AXES), F.col("mu").cast("double").alias("mu"))
    for x, along in zip(AXES, windows, strict=True):
        # As many rows as the grid's side, times the tiles whose windows overlap.
        needs = [(n, tile) for tile, (low, high) in enumerate(along) for n in range(low, high + 1)]
        source = source.join(F.broadcast(spark.createDataFrame(needs, f"{x} int, w{x} int")), x)

    def run(key, table, voxels):
        tile = [k.as_py() for k in key]
        box = [along[n] for along, n in zip(windows, tile, strict=True)]
        first, shape = [low for low, _ in box], [max(high - low, 0) + 2 for low, high in box]
        window, ref = dense(voxels, first, shape, "mu"), table["ref"].to_numpy()
        index, out = [table[x].to_numpy() for x in AXES], []
        for t in told:
            at = [_moved(grid, other, k, index[k], t[f"o_{x}"], t[f"s_{x}"]) for k, x in enumerate(AXES)]
            inside = reduce(np.logical_and, ((p >= 0) & (p <= grid.n[k] - 1) for k, p in enumerate(at)))
            at = [p[inside] for p in at]
            low = [np.floor(p).astype(int) for p in at]
            got = np.zeros(int(inside.sum()))
            for n in range(8):
                corner = [n >> k & 1 for k in range(3)]
                weight = reduce(np.multiply, (p - i if c else 1 - (p - i) for p, i, c in zip(at, low, corner, strict=True)))
                got += weight * window[tuple(i + c - start for i, c, start in zip(low, corner, first, strict=True))]
            r = ref[inside]
            out.append((t["t"], len(r), r.sum(), got.sum(), r @ r, got @ got, r @ got))
        names = ["t", "n", "x", "y", "xx", "yy", "xy"]
        return pa.table([pa.array(c, pa.int32() if name == "t" else pa.int64() if name == "n" else pa.float64()) for name, c in zip(names, zip(*out, strict=True), strict=True)], names=names)

    sums = points.groupBy("ti", "tj", "tl").cogroup(source.groupBy("wi", "wj", "wl")).applyInArrow(run, "t int, n long, x double, y double, xx double, yy double, xy double")
    found = sums.groupBy("t").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    spread = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    size = F.sqrt(F.greatest(spread("x", "x", "xx"), F.lit(0.0)) * F.greatest(spread("y", "y", "yy"), F.lit(0.0)))
    found = found.filter(F.col("n") > 0).select("t", "n", F.try_divide(spread("x", "y", "xy"), size).alias("r"))
    return tries.join(found, "t", "left").select(*tries.columns, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= least, F.coalesce("r", F.lit(0.0))).otherwise(-1.0).alias("ncc"))


def measure_alignment(vox: DataFrame, grid: Grid, reference: DataFrame, other: Grid, schedule=((1.0, 0.25), (0.2, 0.05)), fit_scale: bool = True, stride: int = 1, least: int = 1000) -> tuple[list[float], list[float], float]:
    """Offset (mm) and scale of each axis that fit a volume to a reference best, and their correlation.

    Coordinate descent, coarse to fine: all candidates of an axis are scored in one job, and only their
    scores come back. Scale steps move the volume's edge as far as the offset steps do.
    """
    spark = vox.sparkSession
    vox, reference = checkpointed(vox), checkpointed(reference)
    offset, scale, best = [0.0] * 3, [1.0] * 3, -1.0
    names = [*(f"o_{x}" for x in AXES), *(f"s_{x}" for x in AXES)]
    schema = "t int, " + ", ".join(f"{n} double" for n in names)
    for span, step in schedule:
        for kind in ("offset", "scale") if fit_scale else ("offset",):
            for k in range(3):
                half = grid.n[k] * grid.d[k] / 2 if kind == "scale" else 1.0
                count = int(span / step + 1e-9)
                now = (offset if kind == "offset" else scale)[k]
                lines = []
                for m in range(-count, count + 1):
                    state = [*offset, *scale]
                    state[k + 3 * (kind == "scale")] = now + m * step / half
                    lines.append((m + count, *state))
                told = alignment_scores(vox, grid, reference, other, spark.createDataFrame(lines, schema), stride, least).collect()
                top = max(told, key=lambda r: (r["ncc"], -abs(r["t"] - count), -r["t"]))
                (offset if kind == "offset" else scale)[k] = top[names[k + 3 * (kind == "scale")]]
                best = top["ncc"]
    return offset, scale, best


def aligned_grid(grid: Grid, offset: list[float], scale: list[float]) -> Grid:
    """The grid that puts a volume where its alignment says, without touching a voxel."""
    xy = (scale[0] + scale[1]) / 2
    return replace(grid, d=(grid.d[0] / xy, grid.d[1] / xy, grid.d[2] / scale[2]), o=tuple(o - x for o, x in zip(grid.o, offset, strict=True)))


def parabolic_peak(x0, x1, x2, y0, y1, y2) -> Column:
    """The top of the parabola through the highest of equally spaced points and its neighbours; that point itself at an end or where it does not bend down."""
    bend = y0 - 2 * y1 + y2
    return F.when(y0.isNotNull() & y2.isNotNull() & (bend < 0), x1 + 0.5 * (x0 - x2) * (y0 - y2) / (2 * bend)).otherwise(x1)
