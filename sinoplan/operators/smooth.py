"""Edge-preserving smoothing of slices, in tiles that hold what their windows reach."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Voxels of a tile along an axis, at least, and voxels with their surroundings that one task holds.
TILE, HELD = 64, 1 << 21


def mirrored(at: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the ends of an axis of ``n``, folded back without doubling the end."""
    if n == 1:
        return np.zeros_like(at)
    at = np.mod(at, 2 * (n - 1))
    return np.where(at >= n, 2 * (n - 1) - at, at)


def bilateral(vox: DataFrame, shape: tuple[int, int, int], spatial: float, tonal: float, group: list[str] | None = None, value: str = "mu") -> DataFrame:
    """Each voxel as the mean of a disk around it in its slice l, weighted by distance and by difference: (group, i, j, l, value).

    Weights are Gaussian, ``spatial`` in voxels and ``tonal`` in units of the value. The disk's radius is 1.5 ``spatial``, rounded to even,
    one at least; places beyond the border of ``shape`` are mirrored. A voxel goes to each tile whose windows reach it: 2.25 rows
    where the radius is large, few more than one where it is small. Voxels that are not there, or null, count as 0; null ones and NaN stay null. Of a voxel that is there
    twice, one value is taken in windows and both rows stay.
    """
    if spatial <= 0 or tonal <= 0:
        raise ValueError("the widths of a bilateral filter are above zero")
    radius, keys = max(1, round(1.5 * spatial)), group or []
    tile = max(TILE, 4 * radius)
    depth = max(1, HELD // (tile + 2 * radius) ** 2)
    v = F.col(value).cast("double")
    state = vox.select(*keys, *(F.col(x).cast("int").alias(x) for x in "ijl"), F.nanvl(v, F.lit(None).cast("double")).alias(value)).withColumn("tl", F.floor(F.col("l") / depth).cast("int"))
    for x, n in zip("ij", shape, strict=False):
        low, high = F.greatest(F.floor((F.col(x) - radius) / tile), F.lit(0)), F.least(F.floor((F.col(x) + radius) / tile), F.lit((n - 1) // tile))
        state = state.withColumn(f"t{x}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    disk = [(p, q) for p in range(-radius, radius + 1) for q in range(-radius, radius + 1) if p * p + q * q <= radius * radius]

    def run(key, table):
        own = [key[len(keys) + n].as_py() * tile for n in (0, 1)]
        first_l = key[-1].as_py() * depth
        end = [min(n, a + tile) for a, n in zip(own, shape, strict=False)]
        first = [max(0, a - radius) for a in own]
        at = [table[x].to_numpy() - a for x, a in zip("ijl", [*first, first_l], strict=True)]
        held = np.zeros((*(min(n, b + radius) - a for a, b, n in zip(first, end, shape, strict=False)), int(at[2].max()) + 1))
        held[tuple(at)] = np.nan_to_num(table[value].to_numpy(zero_copy_only=False).astype(float))
        for axis in (0, 1):
            held = np.take(held, mirrored(np.arange(own[axis] - radius, end[axis] + radius), shape[axis]) - first[axis], axis=axis)
        n, m = (b - a for a, b in zip(own, end, strict=True))
        centre = held[radius : radius + n, radius : radius + m]
        total, weight = np.zeros_like(centre), np.zeros_like(centre)
        for p, q in disk:
            other = held[radius + p : radius + p + n, radius + q : radius + q + m]
            w = np.exp(-(p * p + q * q) / (2 * spatial * spatial) - (other - centre) ** 2 / (2 * tonal * tonal))
            total += w * other
            weight += w
        core = np.all([(table[x].to_numpy() >= a) & (table[x].to_numpy() < b) for x, a, b in zip("ij", own, end, strict=True)], axis=0)
        kept = table.filter(pa.array(core))
        where = tuple(kept[x].to_numpy() - a for x, a in zip("ijl", [*own, first_l], strict=True))
        gone = np.isnan(kept[value].to_numpy(zero_copy_only=False).astype(float))
        return pa.table({**{c: kept[c] for c in (*keys, *"ijl")}, value: pa.array((total / weight)[where], mask=gone)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vox.select(*keys).schema.fields] + ["i int", "j int", "l int", f"`{value}` double"])
    return state.groupBy(*keys, "ti", "tj", "tl").applyInArrow(run, schema)
