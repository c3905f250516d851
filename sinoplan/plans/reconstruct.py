"""Whole reconstructions as one plan: counts or line integrals in, a volume out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoplan.functions.columns import PI, cone_weight, parker_weight, r6
from sinoplan.operators import preprocess, project, solve, spectral
from sinoplan.plans.registry import query
from sinoplan.plans.scans import GRID, Scan, turn
from sinoplan.plans.tables import vectors


def prepare(pix: DataFrame, field: DataFrame | None, air: float | None = 0.05, ring_width: int | None = 51) -> DataFrame:
    """Counts to corrected line integrals: flat field and logarithm, level of air, rings; None leaves a step out."""
    p = pix if field is None else preprocess.flat_field(pix, field)
    if air is not None:
        p = preprocess.air_normalise(p, most=air)
    return p if ring_width is None else preprocess.ring_correct(p, width=ring_width)


def fdk(rows: DataFrame, views: DataFrame, vox: DataFrame, scan: Scan, kind: str = "hamming", cutoff: float = 1.0, span: float | None = None) -> DataFrame:
    """Analytic reconstruction of voxels (i, j, l, x, y, z) from rows (k, b, vals) and views (k, theta).

    Cone weight, row filter, short-scan weights (``span``: radians of all views, for scans of less
    than a turn), distance-weighted backprojection, step of angle; a full scan sees each line twice.
    """
    count = views.agg(F.count("*").alias("n")).first()["n"]
    weighted = rows.withColumn("vals", F.transform("vals", lambda v, a: v * cone_weight(a, F.col("b"), scan.n_a, scan.n_b, scan.pitch, scan.sdd)))
    filtered = spectral.filter_fft(weighted, scan.pitch, kind, cutoff).select("k", "b", "vals")
    step = 2 * PI / count if span is None else span / max(count - 1, 1)
    if span is not None:
        first = views.agg(F.min("theta").alias("t0"))
        beta = views.crossJoin(F.broadcast(first)).select("k", (F.col("theta") - F.col("t0")).alias("beta"))
        gamma = lambda a: F.atan((a - scan.n_a / 2) * scan.pitch / scan.sdd)
        weight = lambda v, a: v * parker_weight(F.col("beta"), gamma(a), F.lit(span))
        filtered = filtered.join(beta, "k").withColumn("vals", F.transform("vals", weight)).drop("beta")
    out = project.backproject(vox, filtered, views, scan.r_s, scan.sdd, scan.pitch, scan.cpa, scan.cpb)
    # Filtering is done at the detector; lengths there are larger by the magnification.
    scale = step * (0.5 if span is None else 1.0) * scan.sdd / scan.r_s
    return out.select("i", "j", "l", (F.col("bp") * scale).alias("mu"))


def iterative(rays: DataFrame, data: DataFrame, shape: tuple[int, int, int], size: float, steps: int, method: str = "sirt", samples: int = 64, **options) -> DataFrame:
    """Iterative reconstruction on the grid around the origin from rays that hit it and their data."""
    matrix = project.system_matrix(rays, samples, shape, size)
    start = matrix.select("i", "j", "l").distinct().withColumn("mu", F.lit(0.0 if method != "mlem" else 1.0))
    return solve.iterate(matrix, start, data, steps, method, **options)


@query(f"""WITH @STACK, {GRID}, cw AS (SELECT k, b, a, v * 80 / (sqrt(6400 + ((a - na / 2.0) * 0.2) ** 2 + ((b - nb / 2.0) * 0.2) ** 2) + 1e-8) AS v FROM s, n),
w AS (SELECT f, na, CASE WHEN f / (na * 0.2) <= 2.5 THEN f / (na * 0.2) * (0.54 + 0.46 * cos(pi() * (f / (na * 0.2)) / 2.5)) ELSE 0 END AS h FROM (SELECT na, unnest(range(na // 2 + 1)) AS f FROM n)),
h AS (SELECT d, sum(h * cos(2 * pi() * ((d * f) % na) / na) * CASE WHEN f IN (0, na // 2) THEN 1 ELSE 2 END) / any_value(na) AS h FROM (SELECT w.*, unnest(range(na)) AS d FROM w) GROUP BY d),
fl AS (SELECT k, b, o.d AS a, sum(v * h.h) AS v FROM cw JOIN h o ON true JOIN n ON true JOIN h ON h.d = (o.d - cw.a + na) % na GROUP BY k, b, o.d),
u AS (SELECT x.*, k, 50 + x * cos(th) + y * sin(th) + 1e-8 AS u, th FROM x, t), q AS (SELECT i, j, l, k, (50 / u) ** 2 AS sc, 80 / u * z / 0.2 + (nb - 1) / 2.0 AS b, 80 / u * (y * cos(th) - x * sin(th)) / 0.2 + (na - 1) / 2.0 AS a FROM u, n),
c AS (SELECT i, j, l, k, sc, (floor(b) + p)::INT AS b, (floor(a) + o)::INT AS a, abs(1 - p - (b - floor(b))) * abs(1 - o - (a - floor(a))) AS w FROM q, range(2) r1(p), range(2) r2(o))
SELECT c.i, c.j, c.l, round(sum(w * sc * coalesce(v, 0)) * 2 * pi() / (SELECT count(*) FROM t) * 0.5 * 80 / 50, 6) + 0.0 AS mu FROM c LEFT JOIN fl USING (k, b, a) GROUP BY c.i, c.j, c.l""")
def fdk_volume(spark, sf_dir):
    """The stack as cone-beam views of a full turn, filtered and backprojected to a grid that covers the detector."""
    return fdk(*turn(spark, sf_dir)).withColumn("mu", r6(F.col("mu")))


@query("""WITH @STACK, h AS (SELECT s.*, hash FROM s JOIN (SELECT vec_id, label::INT AS k2, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS b2, vec_id % 5 AS hash FROM embeddings) g ON g.k2 = s.k AND g.b2 = s.b)
SELECT k, count(*) AS rays, round(avg(120 * cos(2 * pi() * k / 10)), 6) + 0.0 AS toward, round(sum(v), 6) + 0.0 AS target FROM h WHERE (a + hash) % 7 = 0 AND k <> 3 GROUP BY k""")
def sampled_rays(spark, sf_dir):
    """A repeatable sample of rays with one view withheld, with their targets gathered by pixel."""
    e = vectors(spark, sf_dir).select("k", "b", (F.col("vec_id") % 5).alias("h"), F.posexplode("embedding").alias("a", "v"))
    kept = e.filter((F.col("k") != 3) & ((F.col("a") + F.col("h")) % 7 == 0))
    return kept.groupBy("k").agg(F.count("*").alias("rays"), r6(F.avg(120 * F.cos(2 * PI * F.col("k") / 10))).alias("toward"), r6(F.sum(F.col("v").cast("double"))).alias("target"))
