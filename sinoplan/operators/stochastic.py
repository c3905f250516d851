"""Reconstruction from rays drawn anew at each step: a data term and a prior, Adam, a schedule, and a fold that cuts the rate and stops."""

from __future__ import annotations

import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.plugins import data_gradients
from sinoplan.operators.lineage import checkpointed, remove_folder, shared_folder
from sinoplan.operators.project import backward, forward, system_matrix
from sinoplan.operators.solve import VOXEL, adam_step


def drawn(ray: Column, step: int, one_in: int) -> Column:
    """Whether a ray is drawn at a step: each is with chance 1 / ``one_in``, by its number alone, so a step done again draws the same."""
    mixed = F.pmod(F.pmod(ray, F.lit(1 << 31)).cast("long") * 2654435761 + step * 40503, F.lit(1 << 32))
    mixed = F.pmod(mixed.bitwiseXOR(F.shiftright(mixed, 16)) * 1597334677, F.lit(1 << 32))
    return F.shiftright(mixed.bitwiseXOR(F.shiftright(mixed, 15)), 8) % one_in == 0


def variation_gradient(vox: DataFrame, shape: tuple[int, int, int], value: str = "mu") -> DataFrame:
    """What each voxel adds to the mean absolute difference of neighbours along each axis, summed (i, j, l, tv): the adjoint of differences on their signs."""
    out = F.lit(0.0)
    for k, x in enumerate(VOXEL):
        w = Window.partitionBy(*[y for y in VOXEL if y != x]).orderBy(x)
        pairs = (shape[k] - 1) * math.prod(n for n in (*shape[:k], *shape[k + 1 :]))
        if pairs:
            out = out + (F.coalesce(F.signum(F.col(value) - F.lag(value).over(w)), F.lit(0.0)) - F.coalesce(F.signum(F.lead(value).over(w) - F.col(value)), F.lit(0.0))) / pairs
    return vox.select(*VOXEL, out.alias("tv"))


def batch_gradient(matrix: DataFrame, vox: DataFrame, data: DataFrame, term: str = "mse") -> DataFrame:
    """Gradient (i, j, l, g) of a registered data term over rays ``data`` (ray_id, p): its slope at each ray, spread by the transpose."""
    met = data.join(forward(matrix, vox).withColumnRenamed("p", "seen"), "ray_id")
    met = met.crossJoin(F.broadcast(met.agg(F.count("*").alias("n"))))  # one row
    slope = data_gradients.get(term)(F.col("seen"), F.col("p")) / F.col("n")
    return backward(matrix, met.select("ray_id", slope.alias("e")), "e").withColumnRenamed("v", "g")


@dataclass(frozen=True)
class Progress:
    """What a run knows between steps besides its volume; one row of a table."""

    step: int = 0
    scale: float = 1.0
    best: float | None = None
    best_step: int = 0
    idle: int = 0
    bad: int = 0
    rest: int = 0
    stopped: bool = False

    def told(self, step: int, score: float, margin: float, factor: float, wait: int, cooldown: int, floor: float, patience: int) -> Progress:
        """After an evaluation: the best moves by any gain; one without progress beyond ``margin`` counts towards a cut of the rate and towards the end."""
        if math.isnan(score):
            progress = better = False
        else:
            better = self.best is None or score > self.best
            progress = self.best is None or score > self.best + margin
        idle = 0 if progress else self.idle + 1
        bad, rest, scale = self.bad, self.rest, self.scale
        if progress:
            bad = 0
        elif rest:
            rest -= 1
        else:
            bad += 1
            if bad >= wait and scale > floor * (1 + 1e-9):
                bad, rest, scale = 0, cooldown, max(scale * factor, floor)
        return Progress(step, scale, score if better else self.best, step if better else self.best_step, idle, bad, rest, idle >= patience)


_PROGRESS = "step int, scale double, best double, best_step int, idle int, bad int, rest int, stopped boolean"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def adam_run(
    rays: DataFrame, data: DataFrame, vox: DataFrame, shape: tuple[int, int, int], size: float, steps: int, one_in: int = 4, samples: int = 8, term: str = "mse", variation: float = 0.0, rate: float = 1e-3,
    warmup: int = 0, held_out: DataFrame | None = None, every: int = 10, margin: float = 0.0, factor: float = 0.5, wait: int = 3, cooldown: int = 1, floor: float = 0.01, patience: int = 8, clip: float | None = None, folder: str | None = None,
) -> DataFrame:
    """A volume (i, j, l, mu) fitted to rays drawn anew at each step.

    ``rays``: with their segments (ray_id, ox..dz, t_near, t_far, hit); ``data``: (ray_id, p); ``vox``: the volume to begin with. At step n one in ``one_in`` rays
    are projected; the gradient of the data term and ``variation`` times that of the total variation move the volume by Adam, which stays non-negative.
    The rate rises over ``warmup`` steps. Every ``every`` steps ``held_out`` rays (ray_id), which are never drawn, are scored by minus their mean squared residual: one fold
    keeps the best volume, cuts the rate on a plateau, and stops after ``patience`` evaluations without progress. With them the best volume evaluated is handed out, else the last.

    State is written after each step into ``folder`` (by default one of its own in the shared folder): volume and moments as a table, then the fold's row. A run with the folder of one that ended
    midway goes on after its last whole step, with the same result as if it had not ended. What neither the next step nor the result needs is deleted.
    """
    spark = vox.sparkSession
    folder = folder or f"{shared_folder(spark)}/adam-{uuid.uuid4().hex}"
    at = lambda n: f"{folder}/volume-{n}"
    fold = lambda n: f"{folder}/fold-{n}"
    rays, data = checkpointed(rays), checkpointed(data)
    seen, score = rays, None
    if held_out is not None:
        kept = rays.join(held_out.select("ray_id"), "ray_id", "left_semi")
        seen = checkpointed(rays.join(held_out.select("ray_id"), "ray_id", "left_anti"))
        matrix, target = checkpointed(system_matrix(kept, samples, shape, size)), checkpointed(data.join(held_out.select("ray_id"), "ray_id", "left_semi"))

        def score(now: DataFrame) -> float:
            met = target.join(forward(matrix, now).withColumnRenamed("p", "seen"), "ray_id", "left")
            return -(met.agg(F.avg(F.pow(F.col("p") - F.coalesce("seen", F.lit(0.0)), 2))).first()[0] or 0.0)

    done = 0
    while _exists(spark, f"{fold(done + 1)}/_SUCCESS"):
        done += 1
    if done:
        told = spark.read.schema(_PROGRESS).parquet(fold(done)).first()
        progress = Progress(**told.asDict())
    else:
        # A run that ended at its first step has no fold yet; the state to begin with is written again.
        vox.select(*(F.col(x).cast("int").alias(x) for x in VOXEL), F.col("mu").cast("double").alias("mu"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s")).write.mode("overwrite").parquet(at(0))
        progress = Progress()
    for n in range(done + 1, steps + 1):
        if progress.stopped:
            break
        state = spark.read.parquet(at(n - 1))
        some = seen.filter(drawn(F.col("ray_id"), n, one_in))
        gradient = batch_gradient(system_matrix(some, samples, shape, size), state, data.join(some.select("ray_id"), "ray_id", "left_semi"), term)
        if variation:
            prior = variation_gradient(state, shape)
            gradient = prior.join(gradient, VOXEL, "left").select(*VOXEL, (F.coalesce("g", F.lit(0.0)) + variation * F.col("tv")).alias("g"))
        now = rate * progress.scale * min(1.0, n / warmup if warmup else 1.0)
        adam_step(state, gradient, n, now, clip=clip).write.mode("overwrite").parquet(at(n))
        before = progress
        if score is not None and n % every == 0:
            progress = progress.told(n, score(spark.read.parquet(at(n))), margin, factor, wait, cooldown, floor, patience)
        else:
            progress = Progress(**{**asdict(progress), "step": n})
        spark.createDataFrame([tuple(asdict(progress).values())], _PROGRESS).coalesce(1).write.mode("overwrite").parquet(fold(n))
        for old in {n - 1, before.best_step} - {n, progress.best_step}:
            remove_folder(spark, at(old))
        done = n
    return spark.read.parquet(at(progress.best_step if score is not None and progress.best is not None else done)).select(*VOXEL, "mu")
