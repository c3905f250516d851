"""Queries of metrics: neighbouring frames of the stack compared, and prices against quantities."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.columns import r6
from sinoplan.operators import metrics as op
from sinoplan.plans.registry import query
from sinoplan.plans.tables import lineitem, read, stack

_PAIRS = "WITH @STACK, p AS (SELECT x.k, x.b, x.a, x.v AS p, y.v AS t FROM s x JOIN s y ON y.k = x.k + 1 AND y.b = x.b AND y.a = x.a)"
_MEASURES = "m AS (SELECT l_returnflag AS g, l_quantity / 10 AS p, l_extendedprice / 10000 AS t, l_discount AS length FROM lineitem)"


def pairs(spark, sf_dir):
    """Frame k as prediction, frame k + 1 as target, on the same pixels."""
    s = stack(spark, sf_dir)
    return s.select("k", "b", "a", F.col("v").alias("p")).join(s.select((F.col("k") - 1).alias("k"), "b", "a", F.col("v").alias("t")), ["k", "b", "a"])


def measures(spark, sf_dir):
    return lineitem(spark, sf_dir).select(F.col("l_returnflag").alias("g"), (F.col("l_quantity") / 10).alias("p"), (F.col("l_extendedprice") / 10000).alias("t"), F.col("l_discount").alias("length"))


@query(_PAIRS + " SELECT k, round(avg((p - t) ** 2), 6) + 0.0 AS mse, round(10 * log10((max(t) - min(t)) ** 2 / avg((p - t) ** 2)), 6) AS psnr FROM p GROUP BY k")
def projection_metrics(spark, sf_dir):
    return op.projection_metrics(pairs(spark, sf_dir), ["k"]).select("k", r6(F.col("mse")).alias("mse"), F.round("psnr", 6).alias("psnr"))


_SSIM = _PAIRS + """, g AS (SELECT i, exp(-0.5 * ((i - 5) / 1.5) ** 2) / (SELECT sum(exp(-0.5 * ((j - 5) / 1.5) ** 2)) FROM range(11) u(j)) AS w FROM range(11) t(i)),
n AS (SELECT k, max(b) - 10 AS nb, max(a) - 10 AS na FROM p GROUP BY k),
h AS (SELECT p.k, p.b, p.a - i AS a, sum(w * p) AS x, sum(w * t) AS y, sum(w * p * p) AS xx, sum(w * t * t) AS yy, sum(w * p * t) AS xy FROM p, g WHERE p.a - i >= 0 GROUP BY ALL HAVING count(*) = 11),
m AS (SELECT h.k, h.b - i AS b, h.a, sum(w * x) AS x, sum(w * y) AS y, sum(w * xx) AS xx, sum(w * yy) AS yy, sum(w * xy) AS xy FROM h, g WHERE h.b - i >= 0 GROUP BY ALL HAVING count(*) = 11),
c AS (SELECT k, b, a, (2 * (xy - x * y) + 0.0009) / (greatest(xx - x * x, 0) + greatest(yy - y * y, 0) + 0.0009) AS cs, (2 * x * y + 0.0001) / (x * x + y * y + 0.0001) AS l FROM m)"""


@query(_SSIM + " SELECT k, b::INT AS b, a::INT AS a, round(l * cs, 6) + 0.0 AS ssim FROM c")
def ssim_map(spark, sf_dir):
    return op.ssim_map(pairs(spark, sf_dir), ["k"], F.lit(1.0)).select("k", "b", "a", r6(F.col("ssim")).alias("ssim"))


@query(_SSIM + " SELECT k, count(*) AS n, round(avg(l * cs), 6) + 0.0 AS ssim, round(avg(cs), 6) + 0.0 AS contrast FROM c GROUP BY k")
def ssim_mean(spark, sf_dir):
    return op.ssim_map(pairs(spark, sf_dir), ["k"], F.lit(1.0)).groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("ssim")).alias("ssim"), r6(F.avg("contrast")).alias("contrast"))


@query(_SSIM + """, o AS (SELECT *, 2 * x * y + 0.0001 AS fa, x * x + y * y + 0.0001 AS fb, 2 * (xy - x * y) + 0.0009 AS fd, greatest(xx - x * x, 0) + greatest(yy - y * y, 0) + 0.0009 AS fe, CASE WHEN xx - x * x > 0 THEN 1 ELSE 0 END AS mv FROM m),
z AS (SELECT k, b, a, fa / fb * fd / fe AS s, fa / fb * (-2 * y / fe + 2 * x * mv * fd / (fe * fe)) + fd / fe * (2 * y * fb - 2 * x * fa) / (fb * fb) AS g1, -fa / fb * mv * fd / (fe * fe) AS g2, 2 * fa / fb / fe AS g3 FROM o),
w AS (SELECT k, avg(s) AS mean, count(*) AS n FROM z GROUP BY k), e1 AS (SELECT k, b + i AS b, a, sum(w * g1) AS g1, sum(w * g2) AS g2, sum(w * g3) AS g3 FROM z, g GROUP BY ALL), e2 AS (SELECT k, b, a + i AS a, sum(w * g1) AS g1, sum(w * g2) AS g2, sum(w * g3) AS g3 FROM e1, g GROUP BY ALL),
q AS (SELECT k, avg((p - t) ** 2) AS mse, count(*) AS n FROM p GROUP BY k)
SELECT p.k, p.b, p.a, round(1 - mean + mse, 6) + 0.0 AS loss, round(1e4 * (2 * (p.p - p.t) / q.n - (coalesce(g1, 0) + 2 * p.p * coalesce(g2, 0) + p.t * coalesce(g3, 0)) / w.n), 6) + 0.0 AS g FROM p JOIN w USING (k) JOIN q USING (k) LEFT JOIN e2 ON e2.k = p.k AND e2.b = p.b AND e2.a = p.a""")
def ssim_gradient(spark, sf_dir):
    """The structural loss of neighbouring frames and ten thousand times its gradient at each pixel."""
    found = op.structural_gradient(pairs(spark, sf_dir), ["k"], F.lit(1.0))
    return found.select("k", "b", "a", r6(F.col("loss")).alias("loss"), r6(1e4 * F.col("g")).alias("g"))


@query()
def msssim_gradient(spark, sf_dir):
    """The same of the multi-scale loss."""
    found = op.structural_gradient(pairs(spark, sf_dir), ["k"], F.lit(1.0), scales=True)
    return found.select("k", "b", "a", r6(F.col("loss")).alias("loss"), r6(1e4 * F.col("g")).alias("g"))


@query()
def msssim(spark, sf_dir):
    return op.msssim(pairs(spark, sf_dir), ["k"], F.lit(1.0)).select("k", r6(F.col("msssim")).alias("msssim"))


@query(f"WITH {_MEASURES} SELECT g, round(sum(p * t) / sum(p * p), 6) AS gain, round(regr_slope(t, p), 6) AS slope, round(regr_intercept(t, p), 6) + 0.0 AS intercept, round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS std FROM m GROUP BY g")
def gain_affine(spark, sf_dir):
    p, t = F.col("p"), F.col("t")
    return measures(spark, sf_dir).groupBy("g").agg(F.round(op.gain(p, t), 6).alias("gain"), F.round(F.regr_slope(t, p), 6).alias("slope"), r6(F.regr_intercept(t, p)).alias("intercept"), F.round(F.avg(t), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(t), F.lit(0.0)), 6).alias("std"))


@query(f"WITH {_MEASURES}, d AS (SELECT g, 1.345 * quantile_disc(abs(p - t), 0.5) / 0.6745 AS d, quantile_disc(CASE WHEN length > 0 THEN 1 / length ELSE 0 END, 0.5) AS w FROM m GROUP BY g) "
       "SELECT m.g, round(avg((p - t) ** 2), 6) AS mse, round(avg(exp(-t) * (p - t) ** 2), 6) AS weighted, round(avg(CASE WHEN abs(p - t) <= d THEN (p - t) ** 2 ELSE 2 * d * abs(p - t) - d * d END), 6) AS huber, "
       "round(avg(least(greatest(CASE WHEN length > 0 THEN 1 / length ELSE 0 END, w / 4), w * 4) / w * (p - t) ** 2), 6) AS row_weighted FROM m JOIN d USING (g) GROUP BY m.g")
def losses(spark, sf_dir):
    m = measures(spark, sf_dir)
    found = op.losses(m, ["g"]).join(op.row_weighted_mse(m, ["g"]), "g")
    return found.select("g", *(F.round(c, 6).alias(c) for c in ("mse", "weighted", "huber", "row_weighted")))


@query("""WITH @STACK, o AS (SELECT k, b, a, v, coalesce(lead(v) OVER w, lag(v) OVER w) AS u FROM s WINDOW w AS (PARTITION BY b, a ORDER BY k)),
f AS (SELECT k, 0.5 * avg((v - u) ** 2) AS floor, max(v) - min(v) AS r FROM o WHERE u IS NOT NULL GROUP BY k)
SELECT k, round(floor, 6) + 0.0 AS mse_floor, round(10 * log10(r * r / floor), 6) AS psnr_ceiling FROM f WHERE r > 0""")
def noise_ceiling(spark, sf_dir):
    """The noise that a frame and its neighbour differ by bounds what any prediction can reach; constant frames are left out."""
    w = Window.partitionBy("b", "a").orderBy("k")
    other = stack(spark, sf_dir).withColumn("u", F.coalesce(F.lead("v").over(w), F.lag("v").over(w))).filter(F.col("u").isNotNull())
    found = other.groupBy("k").agg((0.5 * F.avg(F.pow(F.col("v") - F.col("u"), 2))).alias("floor"), (F.max("v") - F.min("v")).alias("r")).filter("r > 0")
    return found.select("k", r6(F.col("floor")).alias("mse_floor"), F.round(10 * F.log10(F.col("r") * F.col("r") / F.col("floor")), 6).alias("psnr_ceiling"))


@query("""WITH @STACK, d AS (SELECT v, lead(v) OVER (PARTITION BY b, a ORDER BY k) - v AS dk, lead(v) OVER (PARTITION BY k, a ORDER BY b) - v AS db, lead(v) OVER (PARTITION BY k, b ORDER BY a) - v AS da FROM s)
SELECT round(avg(abs(dk)) + avg(abs(db)) + avg(abs(da)), 6) AS tv, round(avg((v / 0.1) ** 2 * (1 - v / 0.1) ** 2) / 0.05 + 0.05 * (avg((dk / 0.1) ** 2) + avg((db / 0.1) ** 2) + avg((da / 0.1) ** 2)), 6) AS double_well,
  round(avg(dk ** 2 / (dk ** 2 + 0.0025)) + avg(db ** 2 / (db ** 2 + 0.0025)) + avg(da ** 2 / (da ** 2 + 0.0025)), 6) AS concave, round(avg(abs(v)), 6) AS l1, round(avg(v * v), 6) AS l2, round(sqrt(sum(dk ** 2) + sum(db ** 2) + sum(da ** 2)), 6) AS gradient_norm, round(sqrt(sum(v * v)), 6) AS norm FROM d""")
def volume_priors(spark, sf_dir):
    vox = stack(spark, sf_dir)
    found = op.priors(vox, ["k", "b", "a"], "v")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


_GRAD = "WITH @STACK, g AS (SELECT k, b, a, CASE WHEN lag(v) OVER x IS NULL THEN lead(v) OVER x - v WHEN lead(v) OVER x IS NULL THEN v - lag(v) OVER x ELSE (lead(v) OVER x - lag(v) OVER x) / 2 END AS ga, " \
    "CASE WHEN lag(v) OVER y IS NULL THEN lead(v) OVER y - v WHEN lead(v) OVER y IS NULL THEN v - lag(v) OVER y ELSE (lead(v) OVER y - lag(v) OVER y) / 2 END AS gb FROM s WINDOW x AS (PARTITION BY k, b ORDER BY a), y AS (PARTITION BY k, a ORDER BY b))"


@query(_GRAD + " SELECT k, b, a, round(sqrt(ga * ga + gb * gb), 6) AS magnitude FROM g")
def grad_magnitude(spark, sf_dir):
    g = op.gradient(stack(spark, sf_dir), ["k", "b", "a"]).select("k", "b", "a", F.round(F.sqrt(F.pow("g_a", 2) + F.pow("g_b", 2)), 6).alias("magnitude"))
    return g


@query(_GRAD + ", m AS (SELECT k, b, a, sqrt(ga * ga + gb * gb) AS m FROM g) SELECT x.k, round(corr(x.m, y.m), 6) + 0.0 AS ncc FROM m x JOIN m y ON y.k = x.k + 1 AND y.b = x.b AND y.a = x.a GROUP BY x.k")
def grad_ncc(spark, sf_dir):
    """Correlation of the gradient magnitudes of neighbouring frames."""
    g = op.gradient(stack(spark, sf_dir), ["k", "b", "a"]).select("k", "b", "a", F.sqrt(F.pow("g_a", 2) + F.pow("g_b", 2)).alias("m"))
    met = g.join(g.select((F.col("k") - 1).alias("k"), "b", "a", F.col("m").alias("m2")), ["k", "b", "a"])
    return met.groupBy("k").agg(r6(F.corr("m", "m2")).alias("ncc"))


@query("""WITH d AS (SELECT o_orderpriority AS g, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1)
SELECT g, n, round(n / c, 6) AS visits, round(1 - exp(-n / c), 6) AS random_coverage, round(least(1, greatest(0, n / c)), 6) AS sweep_coverage FROM d""")
def data_budget(spark, sf_dir):
    """How often each customer is visited by orders, and the share reached if visits were random or swept."""
    d = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("c"))
    visits = F.col("n") / F.col("c")
    return d.select("g", "n", F.round(visits, 6).alias("visits"), F.round(1 - F.exp(-visits), 6).alias("random_coverage"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), visits)), 6).alias("sweep_coverage"))
