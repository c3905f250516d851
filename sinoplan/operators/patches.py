"""Patches of a volume drawn where there is matter, the same however the volume is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "ijl"
DIGITS = 13


def keyed_uniform(seed: int, *parts: Column) -> Column:
    """A number above 0 and below 1 that a seed and a key alone decide: the first 52 bits of a digest."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def matter_patches(vox: DataFrame, shape: tuple[int, int, int], size: tuple[int, int, int], n: int, seed: int = 0, weight: Column | None = None) -> DataFrame:
    """``n`` corners of patches (patch, i0, j0, l0), their middles drawn without replacement in proportion to ``weight`` (default: mu above 0).

    Each middle has the key -ln(u) / weight and the smallest keys win, which is a weighted draw without replacement: tasks keep their ``n`` smallest,
    and no partitioning changes the result. A patch lies in the volume whole, and is as long as an axis that is shorter than it. Middles without weight
    are never drawn, so fewer than ``n`` may come.
    """
    size = tuple(min(s, m) for s, m in zip(size, shape, strict=True))
    w = F.greatest(F.col("mu"), F.lit(0.0)) if weight is None else weight
    middles = vox.withColumn("__w", w.cast("double")).filter("__w > 0")
    for x, s, m in zip(AXES, size, shape, strict=True):
        middles = middles.withColumn(f"{x}0", (F.col(x) - s // 2).cast("int")).filter(F.col(f"{x}0").between(0, m - s))
    keys = middles.select("i0", "j0", "l0", (-F.ln(keyed_uniform(seed, *(F.col(x) for x in AXES))) / F.col("__w")).alias("key"))
    drawn = keys.orderBy("key", "i0", "j0", "l0").limit(n)
    return drawn.agg(F.sort_array(F.collect_list(F.struct("key", "i0", "j0", "l0"))).alias("all")).select(F.posexplode("all").alias("patch", "p")).select("patch", "p.i0", "p.j0", "p.l0")  # n rows


def patch_voxels(patches: DataFrame, vox: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int], halo: int = 0) -> DataFrame:
    """The voxels of each patch (patch, i, j, l, mu, inside); ``halo``: voxels beyond the upper faces, where there are any, not ``inside``."""
    cells = patches
    inside = F.lit(True)
    for x, s, m in zip(AXES, size, shape, strict=True):
        s = min(s, m)
        cells = cells.withColumn(x, F.explode(F.sequence(F.col(f"{x}0"), F.least(F.col(f"{x}0") + s + halo, F.lit(m)) - 1)))
        inside = inside & (F.col(x) < F.col(f"{x}0") + s)
    return cells.withColumn("inside", inside).join(vox.select(*AXES, "mu"), list(AXES)).select("patch", *AXES, "mu", "inside")


def patch_variation(cells: DataFrame) -> DataFrame:
    """Total variation by patch (patch, tv): the mean size of forward differences of its voxels, summed over the axes."""
    found = None
    for x in AXES:
        after = cells.select("patch", *((F.col(y) - 1).alias(y) if y == x else F.col(y) for y in AXES), F.col("mu").alias("next"))
        met = cells.filter("inside").join(after, ["patch", *AXES]).groupBy("patch").agg(F.avg(F.abs(F.col("next") - F.col("mu"))).alias(x))
        found = met if found is None else found.join(met, "patch", "full")
    return found.select("patch", sum((F.coalesce(x, F.lit(0.0)) for x in AXES), F.lit(0.0)).alias("tv"))
