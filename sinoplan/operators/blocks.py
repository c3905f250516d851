"""Volumes in blocks with a halo of one voxel: each sample is read inside the block that it falls in.

A sample between voxels needs the eight around it. Meeting them one by one takes eight shuffled rows a
sample; here a voxel goes to its block, and one at a block's lower face also to the block below, so a volume is shuffled
little more than once, and samples once or, where they stand on a grid themselves, not at all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "ijl"
#: Voxels of a block along an axis, outputs of a block along an axis at most, and samples that one task reads in a block.
SIZE, MOST_OUT, LOT = 32, 64, 500_000


def haloed(vox: DataFrame, sizes: tuple[int, int, int], value: str = "mu") -> DataFrame:
    """Voxels (i, j, l, value) with the block (bi, bj, bl) that reads them; those at a lower face have a row for the block below too."""
    out = vox.select(*(F.col(x).cast("int").alias(x) for x in AXES), F.col(value).cast("double").alias(value))
    for x, size in zip(AXES, sizes, strict=True):
        own = F.floor(F.col(x) / size).cast("int")
        out = out.withColumn(f"b{x}", F.explode(F.when(F.col(x) % size == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    return out


def dense(table: pa.Table, first: list[int], shape: list[int], value: str) -> np.ndarray:
    """A window of a volume as an array; voxels that are not there are 0."""
    held = np.zeros(shape)
    if table.num_rows:
        held[tuple(table[x].to_numpy() - at for x, at in zip(AXES, first, strict=True))] = table[value].to_numpy()
    return held


def _weights(places: np.ndarray, first: int, size: int) -> np.ndarray:
    """A row for each place: what the voxels from ``first`` on count for in it."""
    low = np.floor(places).astype(int)
    out = np.zeros((len(places), size + 1))
    out[np.arange(len(places)), low - first] = 1 - (places - low)
    out[np.arange(len(places)), low - first + 1] += places - low
    return out


def resampled(vox: DataFrame, shape: tuple[int, int, int], at: tuple[np.ndarray, np.ndarray, np.ndarray], fill: float = 0.0, clamp: bool = False, value: str = "mu") -> DataFrame:
    """A volume at the places of another grid, trilinearly: output (i, j, l) stands at ``at[0][i], at[1][j], at[2][l]`` of the volume's index space.

    ``shape``: of the volume. Places along an axis ascend. What is outside the volume is ``fill``, or its edge if ``clamp``. A block's task makes
    the outputs that fall in it, as products of one matrix an axis, so only the volume is shuffled (1.1 times at 32 voxels a side). Every output has a row.
    """
    at = tuple(np.clip(p, 0, n - 1) if clamp else np.asarray(p, float) for p, n in zip(at, shape, strict=True))
    spark, m = vox.sparkSession, [len(p) for p in at]
    inside = [np.flatnonzero((p >= 0) & (p <= n - 1)) for p, n in zip(at, shape, strict=True)]
    step = [(p[-1] - p[0]) / max(len(p) - 1, 1) if len(p) else 1.0 for p in at]
    sizes = tuple(int(max(1, min(SIZE, MOST_OUT * abs(s)))) if s else SIZE for s in step)
    ends = [(int(i[0]), int(i[-1])) if len(i) else (1, 0) for i in inside]

    def run(key, _, table):
        block = [x.as_py() for x in key]
        mine = [i[np.floor(p[i]).astype(int) // size == b] for i, p, size, b in zip(inside, at, sizes, block, strict=True)]
        if not all(map(len, mine)):
            return pa.table({**{x: pa.array([], pa.int32()) for x in AXES}, value: pa.array([], pa.float64())})
        first = [b * size for b, size in zip(block, sizes, strict=True)]
        got = dense(table, first, [size + 1 for size in sizes], value)
        for p, i, start, size in zip(at, mine, first, sizes, strict=True):
            got = np.tensordot(got, _weights(p[i], start, size), axes=(0, 1))  # the axis goes last, so all three turn once
        index = np.meshgrid(*mine, indexing="ij")
        return pa.table({**{x: n.ravel().astype(np.int32) for x, n in zip(AXES, index, strict=True)}, value: got.ravel()})

    count = [-(-n // size) for n, size in zip(shape, sizes, strict=True)]
    ids = F.col("id")
    blocks = spark.range(count[0] * count[1] * count[2]).select((ids % count[0]).cast("int").alias("ti"), (F.floor(ids / count[0]) % count[1]).cast("int").alias("tj"), F.floor(ids / (count[0] * count[1])).cast("int").alias("tl"))
    found = blocks.groupBy("ti", "tj", "tl").cogroup(haloed(vox, sizes, value).groupBy("bi", "bj", "bl")).applyInArrow(run, f"i int, j int, l int, {value} double")
    if clamp:
        return found
    cells = spark.range(m[0] * m[1] * m[2]).select((ids % m[0]).cast("int").alias("i"), (F.floor(ids / m[0]) % m[1]).cast("int").alias("j"), F.floor(ids / (m[0] * m[1])).cast("int").alias("l"))
    met = reduce(lambda a, b: a & b, (F.col(x).between(*e) for x, e in zip(AXES, ends, strict=True)))
    return found.unionByName(cells.filter(~met).withColumn(value, F.lit(fill)))


def sampled(points: DataFrame, at: dict[str, Column], vox: DataFrame, value: str = "mu") -> DataFrame:
    """``points`` with the trilinear value of a volume at their places; where there is no voxel it is nothing.

    ``at``: for each axis the place in the volume's index space. A point is shuffled once, to its block; a block that more than ``LOT`` points fall in is
    dealt to several tasks, each with the block's voxels.
    """
    sizes, names = (SIZE,) * 3, points.columns
    placed = points.withColumns({f"p_{x}": at[x] for x in AXES})
    placed = placed.withColumns({f"t{x}": F.floor(F.col(f"p_{x}") / SIZE).cast("int") for x in AXES})
    most = placed.groupBy("ti", "tj", "tl").agg(F.count("*").alias("n"))
    full = [(r["ti"], r["tj"], r["tl"], -(-r["n"] // LOT)) for r in most.filter(F.col("n") > LOT).collect()]  # blocks of a volume beyond LOT points
    held = haloed(vox, sizes, value)
    if full:
        lots = F.broadcast(points.sparkSession.createDataFrame(full, "bi int, bj int, bl int, lots int"))
        placed = placed.join(lots.withColumnsRenamed({f"b{x}": f"t{x}" for x in AXES}), ["ti", "tj", "tl"], "left").withColumn("lot", F.pmod(F.xxhash64(*(f"p_{x}" for x in AXES)), F.coalesce("lots", F.lit(1))).cast("int")).drop("lots")
        held = held.join(lots, ["bi", "bj", "bl"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1))).drop("lots")
    else:
        placed, held = placed.withColumn("lot", F.lit(0)), held.withColumn("part", F.lit(0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields) + f", `{value}` double"

    def run(key, table, voxels):
        if not table.num_rows:
            return table.select(names).append_column(value, pa.array([], pa.float64()))
        first = [k.as_py() * SIZE for k in key[:3]]
        window = dense(voxels, first, [SIZE + 1] * 3, value)
        low, share = [], []
        for x, start in zip(AXES, first, strict=True):
            p = table[f"p_{x}"].to_numpy()
            low.append(np.floor(p).astype(int) - start)
            share.append(p - np.floor(p))
        total = np.zeros(table.num_rows)
        for n in range(8):
            corner = [n >> k & 1 for k in range(3)]
            weight = reduce(np.multiply, (s if c else 1 - s for s, c in zip(share, corner, strict=True)))
            total += weight * window[tuple(i + c for i, c in zip(low, corner, strict=True))]
        return table.select(names).append_column(value, pa.array(total))

    return placed.groupBy("ti", "tj", "tl", "lot").cogroup(held.groupBy("bi", "bj", "bl", "part")).applyInArrow(run, schema)


def plane(vox: DataFrame, shape: tuple[int, int, int], at: tuple[np.ndarray, np.ndarray, np.ndarray], axis: str, index: int | None = None, fill: float = 0.0, value: str = "mu") -> DataFrame:
    """One plane of ``resampled``, across an axis; by default the middle one. Only the voxels beside it are read: the filter reaches the scan."""
    k = AXES.index(axis)
    index = len(at[k]) // 2 if index is None else index
    if not 0 <= index < len(at[k]):
        raise IndexError(f"plane {index} of axis {axis} must be in [0, {len(at[k])})")
    place = float(at[k][index])
    near = vox.filter(F.col(axis).between(int(np.floor(place)), int(np.floor(place)) + 1))
    one = tuple(np.array([place]) if n == k else p for n, p in enumerate(at))
    return resampled(near, shape, one, fill, value=value).withColumn(axis, F.lit(index))
