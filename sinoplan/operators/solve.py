"""Iterative solvers on a system matrix (ray_id, i, j, l, w); volumes are (i, j, l, mu), data (ray_id, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoplan.operators.lineage import checkpointed
from sinoplan.operators.project import backward, forward

VOXEL = ["i", "j", "l"]


def row_weights(matrix: DataFrame, least: float = 0.0) -> DataFrame:
    """One over each ray's path; none for rays that hardly touch the grid."""
    return matrix.groupBy("ray_id").agg(F.sum("w").alias("length")).select("ray_id", F.when(F.col("length") > least, 1 / F.col("length")).otherwise(0.0).alias("r"))


def column_weights(matrix: DataFrame) -> DataFrame:
    """One over the path that all rays have in each voxel."""
    return matrix.groupBy(*VOXEL).agg(F.sum("w").alias("c")).select(*VOXEL, F.when(F.col("c") > 0, 1 / F.col("c")).otherwise(0.0).alias("c"))


def transmission_weights(data: DataFrame) -> Column:
    """Rays that let more through count for more: a clipped transmission over its mean."""
    return F.least(F.greatest(F.exp(-F.col("p")), F.lit(1e-6)), F.lit(2.0))


def sirt_step(matrix: DataFrame, vox: DataFrame, data: DataFrame, relax: float = 1.0, nonnegative: bool = True, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """x + relax * C A^T R (b - A x); the weights R and C of the matrix are given, or worked out."""
    rows = row_weights(matrix) if rows is None else rows
    columns = column_weights(matrix) if columns is None else columns
    seen = forward(matrix, vox).withColumnRenamed("p", "ax")
    residual = data.join(seen, "ray_id").join(rows, "ray_id").select("ray_id", ((F.col("p") - F.col("ax")) * F.col("r")).alias("e"))
    moved = backward(matrix, residual, "e").join(columns, VOXEL).select(*VOXEL, (F.col("v") * F.col("c")).alias("step"))
    mu = F.col("mu") + relax * F.coalesce("step", F.lit(0.0))
    return vox.join(moved, VOXEL, "left").select(*VOXEL, (F.greatest(mu, F.lit(0.0)) if nonnegative else mu).alias("mu"))


def landweber_step(matrix: DataFrame, vox: DataFrame, data: DataFrame, relax: float) -> DataFrame:
    """x + relax * A^T (b - A x), which is a gradient step of the squared residual."""
    seen = forward(matrix, vox).withColumnRenamed("p", "ax")
    residual = data.join(seen, "ray_id").select("ray_id", (F.col("p") - F.col("ax")).alias("e"))
    return vox.join(backward(matrix, residual, "e"), VOXEL, "left").select(*VOXEL, (F.col("mu") + relax * F.coalesce("v", F.lit(0.0))).alias("mu"))


def mlem_step(matrix: DataFrame, vox: DataFrame, data: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """x * A^T(b / A x) / A^T 1, negative data counted as none."""
    columns = column_weights(matrix) if columns is None else columns
    seen = forward(matrix, vox).withColumnRenamed("p", "ax")
    ratio = data.join(seen, "ray_id").select("ray_id", F.coalesce(F.try_divide(F.greatest("p", F.lit(0.0)), F.col("ax")), F.lit(0.0)).alias("e"))
    factor = backward(matrix, ratio, "e").join(columns, VOXEL).select(*VOXEL, (F.col("v") * F.col("c")).alias("f"))
    return vox.join(factor, VOXEL, "left").select(*VOXEL, (F.col("mu") * F.coalesce("f", F.lit(1.0))).alias("mu"))


def adam_step(state: DataFrame, gradient: DataFrame, step: int, rate: float = 1e-3, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, clip: float | None = None) -> DataFrame:
    """One update of (i, j, l, mu, m, s) by a gradient (i, j, l, g), optionally clipped to a norm; mu stays non-negative."""
    g = F.coalesce("g", F.lit(0.0))
    if clip is not None:
        norm = gradient.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm"))
        gradient = gradient.crossJoin(F.broadcast(norm)).select(*VOXEL, (F.col("g") * F.least(F.lit(1.0), clip / (F.col("norm") + 1e-6))).alias("g"))
    m, s = b1 * F.col("m") + (1 - b1) * g, b2 * F.col("s") + (1 - b2) * g * g
    moved = state.join(gradient, VOXEL, "left").select(*VOXEL, "mu", m.alias("m"), s.alias("s"))
    update = rate * (F.col("m") / (1 - b1**step)) / (F.sqrt(F.col("s") / (1 - b2**step)) + eps)
    return moved.select(*VOXEL, F.greatest(F.col("mu") - update, F.lit(0.0)).alias("mu"), "m", "s")


def iterate(matrix: DataFrame, vox: DataFrame, data: DataFrame, steps: int, method: str = "sirt", relax: float = 1.0, shrink: float = 1.0, blocks: int = 1, score=None, patience: int = 4, margin: float = 0.0) -> DataFrame:
    """Run a solver; with ``blocks`` > 1 each step goes through ordered subsets of the rays in turn.

    The matrix and its weights are checkpointed once and the volume after each step, so that the plan
    does not grow and a lost executor costs one step. ``score``: a function of the volume, higher is
    better; the run stops when it made no progress beyond ``margin`` for ``patience`` steps in a row, and
    the volume of the best step is handed out.
    """
    matrix, data = checkpointed(matrix), checkpointed(data)
    parts = []
    for k in range(blocks):
        mine = F.pmod(F.col("ray_id"), F.lit(blocks)) == k if blocks > 1 else F.lit(True)
        some = matrix.filter(mine)
        rows = checkpointed(row_weights(some)) if method == "sirt" else None
        parts.append((some, data.filter(mine), rows, checkpointed(column_weights(some)) if method != "landweber" else None))
    best, kept, bad = None, vox, 0
    for n in range(steps):
        rate = relax * shrink**n
        for some, told, rows, columns in parts:
            if method == "sirt":
                vox = sirt_step(some, vox, told, rate, rows=rows, columns=columns)
            elif method == "mlem":
                vox = mlem_step(some, vox, told, columns)
            elif method == "landweber":
                vox = landweber_step(some, vox, told, rate)
            else:
                raise ValueError(f"unknown method {method!r}; known: landweber, mlem, sirt")
            vox = checkpointed(vox)
        if score is not None:
            now = score(vox)
            progress = best is None or now > best + margin
            if best is None or now > best:
                best, kept = now, vox
            bad = 0 if progress else bad + 1
            if bad >= patience:
                break
    return vox if score is None else kept


def held_out_score(matrix: DataFrame, data: DataFrame):
    """A score for ``iterate``: minus the mean squared residual of rays that the solver does not see."""
    matrix, data = checkpointed(matrix), checkpointed(data)

    def score(vox: DataFrame) -> float:
        met = data.join(forward(matrix, vox).withColumnRenamed("p", "ax"), "ray_id", "left")
        return -(met.agg(F.avg(F.pow(F.col("p") - F.coalesce("ax", F.lit(0.0)), 2))).first()[0] or 0.0)

    return score


def cgls(matrix: DataFrame, data: DataFrame, vox: DataFrame, steps: int) -> DataFrame:
    """Conjugate gradients on the normal equations, from a volume of zeros over the voxels of ``vox``."""
    matrix = checkpointed(matrix)
    r = checkpointed(data.select("ray_id", F.col("p").alias("r")))
    x = vox.select(*VOXEL, F.lit(0.0).alias("mu"))
    s = checkpointed(vox.select(*VOXEL).join(backward(matrix, r, "r"), VOXEL, "left").select(*VOXEL, F.coalesce("v", F.lit(0.0)).alias("s")))
    d = s.select(*VOXEL, F.col("s").alias("d"))
    gamma = s.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    for _ in range(steps):
        q = checkpointed(forward(matrix, d, "d").select("ray_id", F.col("p").alias("q")))
        size = q.agg(F.sum(F.col("q") * F.col("q"))).first()[0] or 0.0
        if gamma == 0 or size == 0:
            break
        alpha = gamma / size
        x = checkpointed(x.join(d, VOXEL).select(*VOXEL, (F.col("mu") + alpha * F.col("d")).alias("mu")))
        r = checkpointed(r.join(q, "ray_id", "left").select("ray_id", (F.col("r") - alpha * F.coalesce("q", F.lit(0.0))).alias("r")))
        s = vox.select(*VOXEL).join(backward(matrix, r, "r"), VOXEL, "left").select(*VOXEL, F.coalesce("v", F.lit(0.0)).alias("s"))
        s = checkpointed(s)
        new = s.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
        d = checkpointed(s.join(d, VOXEL).select(*VOXEL, (F.col("s") + new / gamma * F.col("d")).alias("d")))
        gamma = new
    return x
