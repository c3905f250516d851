"""Total variation as a proximal step on tiles with halos: several iterations a shuffle, as exact as on the whole volume."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoplan.operators import solve
from sinoplan.operators.lineage import checkpointed

AXES, DUAL = "ijl", ("p_i", "p_j", "p_l")
#: Voxels of a tile along an axis, iterations between two shuffles, step on the dual state (below 1/6 in three dimensions).
TILE, INNER, STEP = 32, 8, 0.125


def divergence(p: np.ndarray) -> np.ndarray:
    """Minus the adjoint of forward differences, of fields (3, i, j, l) that are zero at the last voxel of their axis."""
    out = p.sum(axis=0)
    for axis in range(3):
        out[(slice(None),) * axis + (slice(1, None),)] -= p[axis][(slice(None),) * axis + (slice(None, -1),)]
    return out


def dual_steps(f: np.ndarray, p: np.ndarray, weight: float, steps: int) -> np.ndarray:
    """Projected gradient steps on the dual of min |u - f|^2 / 2 + weight * sum |grad u|; u is f + divergence(p)."""
    for _ in range(steps):
        u = f + divergence(p)
        g = np.zeros_like(p)
        for axis in range(3):
            g[axis][(slice(None),) * axis + (slice(None, -1),)] = np.diff(u, axis=axis)
        p = p + STEP * g
        p = p / np.maximum(1.0, np.sqrt((p * p).sum(axis=0)) / weight)
    return p


def tv_step(vox: DataFrame, shape: tuple[int, int, int], weight: float, steps: int = 50, tile: int = TILE, inner: int = INNER, scaled: bool = False) -> DataFrame:
    """Voxels (i, j, l, mu) after ``steps`` iterations towards the total variation's proximal point: (i, j, l, mu, p_i, p_j, p_l).

    A dual state (columns p_i, p_j, p_l) that comes with ``vox`` is gone on from, so a step may be split. A tile's task has ``inner`` + 1 voxels more on each side, as
    an iteration reads one voxel further, so tiles change no value. The state is checkpointed after each shuffle. ``scaled``: the weight is a
    share of the volume's range. Voxels that are not there count as 0 and stay away. A weight of 0 changes nothing.
    """
    if weight < 0:
        raise ValueError(f"the weight {weight} is below zero")
    if scaled:
        low, high = vox.agg(F.min("mu"), F.max("mu")).first()
        weight *= (high or 0.0) - (low or 0.0)
    has = set(DUAL) <= set(vox.columns)
    # The data are what the primal values would be without their dual state: u = f + div p.
    state = vox.select(*(F.col(x).cast("int").alias(x) for x in AXES), F.col("mu").cast("double").alias("u"), *((F.col(p) if has else F.lit(0.0)).cast("double").alias(p) for p in DUAL))
    if weight == 0 or steps == 0:
        return state.withColumnRenamed("u", "mu")
    if has:
        if "f" not in vox.columns:
            raise ValueError("a dual state needs the data f that it belongs to")
        state = vox.select(*(F.col(x).cast("int").alias(x) for x in AXES), F.col("f").cast("double").alias("f"), *(F.col(p).cast("double").alias(p) for p in DUAL))
    else:
        state = state.withColumnRenamed("u", "f")
    done = 0
    while done < steps:
        now = min(inner, steps - done)
        state = checkpointed(_shuffled(state, shape, weight, now, tile))
        done += now
        if done < steps:
            state = state.drop("mu")
    return state


def _shuffled(state: DataFrame, shape: tuple[int, int, int], weight: float, steps: int, tile: int) -> DataFrame:
    halo = steps + 1
    for x, n in zip(AXES, shape, strict=True):
        low, high = F.greatest(F.floor((F.col(x) - halo) / tile), F.lit(0)), F.least(F.floor((F.col(x) + halo) / tile), F.lit((n - 1) // tile))
        state = state.withColumn(f"t{x}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))

    def run(key, table):
        own = [k.as_py() * tile for k in key]
        first = [max(0, a - halo) for a in own]
        end = [min(n, a + tile + halo) for a, n in zip(own, shape, strict=True)]
        at = tuple(table[x].to_numpy() - a for x, a in zip(AXES, first, strict=True))
        held = np.zeros((4, *(b - a for a, b in zip(first, end, strict=True))))
        for n, c in enumerate(("f", *DUAL)):
            held[n][at] = table[c].to_numpy()
        p = dual_steps(held[0], held[1:], weight, steps)
        u = held[0] + divergence(p)
        core = np.all([(table[x].to_numpy() >= a) & (table[x].to_numpy() < a + tile) for x, a in zip(AXES, own, strict=True)], axis=0)
        kept, where = table.filter(pa.array(core)), tuple(a[core] for a in at)
        return pa.table({**{x: kept[x] for x in AXES}, "mu": pa.array(u[where]), "f": kept["f"], **{c: pa.array(p[n][where]) for n, c in enumerate(DUAL)}})

    schema = "i int, j int, l int, mu double, f double, p_i double, p_j double, p_l double"
    return state.groupBy("ti", "tj", "tl").applyInArrow(run, schema)


def iterate_with_tv(matrix: DataFrame, vox: DataFrame, data: DataFrame, shape: tuple[int, int, int], chunks: int, steps: int, weight: float, tv_steps: int = 50, **options) -> DataFrame:
    """Chunks of ``steps`` solver steps, a total variation step (weight: share of the range) and a clamp at 0 after each; a factor ``shrink`` runs on through the chunks."""
    relax, shrink = options.pop("relax", 1.0), options.get("shrink", 1.0)
    matrix = checkpointed(matrix)
    for chunk in range(chunks):
        vox = solve.iterate(matrix, vox, data, steps, relax=relax * shrink ** (chunk * steps), **options)
        vox = checkpointed(tv_step(vox, shape, weight, tv_steps, scaled=True).select(*AXES, F.greatest("mu", F.lit(0.0)).alias("mu")))
    return vox
