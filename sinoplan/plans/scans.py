"""The stack as a scan of a full turn, and a grid of voxels that covers its detector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoplan.functions.columns import PI
from sinoplan.plans.tables import frames


@dataclass(frozen=True)
class Scan:
    """What a scanner looks like; lengths in mm, centres in pixels."""

    r_s: float
    sdd: float
    pitch: float
    n_a: int
    n_b: int
    cpa: float
    cpb: float


#: The same in SQL: n (views, rows, columns), x (voxels of 0.8 by 0.8 by 0.5 mm), t (angles).
GRID = """n AS (SELECT count(DISTINCT k) AS nk, max(b) + 1 AS nb, max(a) + 1 AS na FROM s),
x AS (SELECT i::INT AS i, j::INT AS j, l::INT AS l, (i - (na // 6 - 1) / 2.0) * 0.8 AS x, (j - (na // 6 - 1) / 2.0) * 0.8 AS y, (l - (nb // 4 - 1) / 2.0) * 0.5 AS z
  FROM (SELECT na, nb, i, j, unnest(range(nb // 4)) AS l FROM (SELECT na, nb, i, unnest(range(na // 6)) AS j FROM (SELECT na, nb, unnest(range(na // 6)) AS i FROM n)))),
t AS (SELECT DISTINCT k, 2 * pi() * k / nk AS th FROM s, n)"""


def turn(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Scan]:
    """Detector rows (k, b, vals), views (k, theta), voxels (i, j, l, x, y, z) and the scanner; the grid grows with the frames."""
    rows = frames(spark, sf_dir)
    nk, nb, na = rows.agg(F.countDistinct("k"), F.max("b") + 1, F.max(F.size("vals"))).first()
    views = rows.select("k").distinct().withColumn("theta", 2 * PI * F.col("k") / nk)
    n, m = na // 6, nb // 4
    vox = spark.range(n * n * m).select((F.col("id") % n).cast("int").alias("i"), (F.floor(F.col("id") / n) % n).cast("int").alias("j"), F.floor(F.col("id") / (n * n)).cast("int").alias("l"))
    vox = vox.withColumns({"x": (F.col("i") - (n - 1) / 2) * 0.8, "y": (F.col("j") - (n - 1) / 2) * 0.8, "z": (F.col("l") - (m - 1) / 2) * 0.5})
    return rows, views, vox, Scan(50.0, 80.0, 0.2, na, nb, (na - 1) / 2, (nb - 1) / 2)
