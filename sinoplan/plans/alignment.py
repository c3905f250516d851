"""Queries of volumes on different grids, of edges and spectra of volumes, and of losses on filtered residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinoplan.functions.columns import r6
from sinoplan.operators import align, metrics, spectral, stopping
from sinoplan.plans.ordered import _RUNS, runs
from sinoplan.plans.registry import query
from sinoplan.plans.tables import box, frames

_MOVED = """WITH @STACK, @BOX, n AS (SELECT max(k) + 1 AS ni, max(b) + 1 AS nj, max(a) + 1 AS nl FROM x),
t(t, oj, sl) AS (VALUES (0, -0.5::DOUBLE, 1.0::DOUBLE), (1, 0.0, 1.0), (2, 0.5, 1.0), (3, 0.25, 1.02)),
p AS (SELECT t, k, b, a, v AS ref, (k - (ni - 1) / 2.0) + (ni - 1) / 2.0 AS pi_, ((b - (nj - 1) / 2.0) * 0.5 + oj) / 0.5 + (nj - 1) / 2.0 AS pj, sl * ((a - (nl - 1) / 2.0) * 0.25) / 0.25 + (nl - 1) / 2.0 AS pl, ni, nj, nl FROM x, n, t),
q AS (SELECT * FROM p WHERE pi_ BETWEEN 0 AND ni - 1 AND pj BETWEEN 0 AND nj - 1 AND pl BETWEEN 0 AND nl - 1),
c AS (SELECT t, k, b, a, ref, (floor(pi_) + d)::INT AS ci, (floor(pj) + e)::INT AS cj, (floor(pl) + f)::INT AS cl, abs(1 - d - (pi_ - floor(pi_))) * abs(1 - e - (pj - floor(pj))) * abs(1 - f - (pl - floor(pl))) AS w FROM q, range(2) r1(d), range(2) r2(e), range(2) r3(f)),
g AS (SELECT t, c.k, c.b, c.a, any_value(ref) AS ref, sum(w * coalesce(x.v, 0)) AS got FROM c LEFT JOIN x ON x.k = ci AND x.b = cj AND x.a = cl GROUP BY t, c.k, c.b, c.a)"""


def _grid(n):
    return align.Grid(n, (1.0, 0.5, 0.25))


@query(_MOVED + " SELECT t, count(*) AS n, round(corr(ref, got), 6) + 0.0 AS ncc FROM g GROUP BY t")
def align_ncc(spark, sf_dir):
    """The stack held against itself, moved and stretched by each of four tries; that without a move scores 1."""
    vox, n = box(spark, sf_dir)
    tries = spark.createDataFrame([(0, 0.0, -0.5, 0.0, 1.0, 1.0, 1.0), (1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 0.0, 0.5, 0.0, 1.0, 1.0, 1.0), (3, 0.0, 0.25, 0.0, 1.0, 1.0, 1.02)], "t int, o_i double, o_j double, o_l double, s_i double, s_j double, s_l double")
    return align.alignment_scores(vox, _grid(n), vox, _grid(n), tries, least=1).select("t", "n", r6(F.col("ncc")).alias("ncc"))


_TARGET = """WITH @STACK, @BOX, n AS (SELECT max(k) + 1 AS ni, max(b) + 1 AS nj, max(a) + 1 AS nl FROM x), m AS (SELECT ni, nj, nl, ni AS mi, nj * 2 // 3 AS mj, nl // 2 AS ml FROM n),
o AS (SELECT mi, mj, ml, ni, nj, nl, i, j, unnest(range(ml)) AS l FROM (SELECT *, unnest(range(mj)) AS j FROM (SELECT *, unnest(range(mi)) AS i FROM m))),
p AS (SELECT i::INT AS i, j::INT AS j, l::INT AS l, ni, nj, nl, ((i - (mi - 1) / 2.0) * 0.9 + 0.2) / 1.0 + (ni - 1) / 2.0 AS pi_, ((j - (mj - 1) / 2.0) * 0.75) / 0.5 + (nj - 1) / 2.0 AS pj, ((l - (ml - 1) / 2.0) * 0.6 - 0.5) / 0.25 + (nl - 1) / 2.0 AS pl FROM o),
q AS (SELECT *, CASE WHEN pi_ < 0 AND pi_ > -1e-6 THEN 0 WHEN pi_ > ni - 1 AND pi_ < ni - 1 + 1e-6 THEN ni - 1 ELSE pi_ END AS xi, CASE WHEN pj < 0 AND pj > -1e-6 THEN 0 WHEN pj > nj - 1 AND pj < nj - 1 + 1e-6 THEN nj - 1 ELSE pj END AS xj, CASE WHEN pl < 0 AND pl > -1e-6 THEN 0 WHEN pl > nl - 1 AND pl < nl - 1 + 1e-6 THEN nl - 1 ELSE pl END AS xl FROM p),
c AS (SELECT i, j, l, (floor(xi) + d)::INT AS ci, (floor(xj) + e)::INT AS cj, (floor(xl) + f)::INT AS cl, abs(1 - d - (xi - floor(xi))) * abs(1 - e - (xj - floor(xj))) * abs(1 - f - (xl - floor(xl))) AS w,
  xi BETWEEN 0 AND ni - 1 AND xj BETWEEN 0 AND nj - 1 AND xl BETWEEN 0 AND nl - 1 AS inside FROM q, range(2) r1(d), range(2) r2(e), range(2) r3(f))
SELECT i, j, l, round(CASE WHEN bool_and(inside) THEN sum(w * coalesce(x.v, 0)) ELSE -1 END, 6) + 0.0 AS mu FROM c LEFT JOIN x ON x.k = ci AND x.b = cj AND x.a = cl GROUP BY i, j, l"""


@query(_TARGET)
def resample_trilinear(spark, sf_dir):
    """The stack on a coarser grid of another centre; what it does not reach is -1."""
    vox, n = box(spark, sf_dir)
    target = align.Grid((n[0], n[1] * 2 // 3, n[2] // 2), (0.9, 0.75, 0.6), (0.2, 0.0, -0.5))
    return align.resample(vox, _grid(n), target, -1.0).select("i", "j", "l", r6(F.col("mu")).alias("mu"))


#: The stack as a model seen from a finer, smaller grid off its centre, inside a cylinder of 4 mm.
_VIEW = """WITH @STACK, @BOX, n AS (SELECT max(k) + 1 AS ni, max(b) + 1 AS nj, max(a) + 1 AS nl FROM x), o AS (SELECT ni, nj, nl, ni AS mi, nj // 2 AS mj, nl // 2 AS ml FROM n),
p AS (SELECT i::INT AS i, j::INT AS j, l::INT AS l, (i - (mi - 1) / 2.0) * 0.8 + 0.4 AS x, (j - (mj - 1) / 2.0) * 0.4 - 0.3 AS y, (l - (ml - 1) / 2.0) * 0.3 AS z, ni, nj, nl, mj FROM o, range(mi) a(i), range(mj) b(j), range(ml) c(l)),
q AS (SELECT i, j, l, mj, x * x + y * y <= 16 AS near, x + (ni - 1) / 2.0 AS px, y / 0.5 + (nj - 1) / 2.0 AS py, z / 0.25 + (nl - 1) / 2.0 AS pz, ni, nj, nl FROM p),
c AS (SELECT i, j, l, mj, near AND px BETWEEN 0 AND ni - 1 AND py BETWEEN 0 AND nj - 1 AND pz BETWEEN 0 AND nl - 1 AS inside, (floor(px) + d)::INT AS ci, (floor(py) + e)::INT AS cj, (floor(pz) + f)::INT AS cl, abs(1 - d - (px - floor(px))) * abs(1 - e - (py - floor(py))) * abs(1 - f - (pz - floor(pz))) AS w FROM q, range(2) r1(d), range(2) r2(e), range(2) r3(f)),
g AS (SELECT i, j, l, mj, round(CASE WHEN bool_and(inside) THEN sum(w * coalesce(x.v, 0)) ELSE 0 END, 6) + 0.0 AS mu FROM c LEFT JOIN x ON x.k = ci AND x.b = cj AND x.a = cl GROUP BY i, j, l, mj)"""


def _view(spark, sf_dir):
    vox, n = box(spark, sf_dir)
    return vox, _grid(n), align.Grid((n[0], n[1] // 2, n[2] // 2), (0.8, 0.4, 0.3), (0.4, -0.3, 0.0))


@query(_VIEW + " SELECT i, j, l, mu FROM g")
def render_volume(spark, sf_dir):
    """The stack as a model at the voxels of another grid; nothing beyond 4 mm of its axis."""
    return align.render_volume(*_view(spark, sf_dir), radius=4.0).select("i", "j", "l", r6(F.col("mu")).alias("mu"))


@query(_VIEW + " SELECT i, j, l, mu FROM g WHERE j = mj // 2")
def render_slice(spark, sf_dir):
    """The coronal plane through the middle of that grid, read from the voxels beside it."""
    return align.render_slice(*_view(spark, sf_dir), direction="coronal", radius=4.0).select("i", "j", "l", r6(F.col("mu")).alias("mu"))


def _mirror(i: str, n: str) -> str:
    m = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END)"


_EDGES = f"""WITH @STACK, @BOX, n AS (SELECT max(k) + 1 AS ni, max(b) + 1 AS nj, max(a) + 1 AS nl FROM x),
tap AS (SELECT sig, t, exp(-0.5 * (t / sig) ** 2) / sum(exp(-0.5 * (t / sig) ** 2)) OVER (PARTITION BY sig) AS w FROM (VALUES (0.5::DOUBLE), (1.0), (2.0)) g(sig), range(-8, 9) r(t) WHERE abs(t) <= floor(4 * sig + 0.5)),
s1 AS (SELECT sig, x.k, x.b, x.a, sum(w * y.v) AS v FROM x, n, tap JOIN x y ON y.b = x.b AND y.a = x.a AND y.k = {_mirror("x.k + t", "ni")} GROUP BY sig, x.k, x.b, x.a),
s2 AS (SELECT x.sig, x.k, x.b, x.a, sum(w * y.v) AS v FROM s1 x JOIN tap ON tap.sig = x.sig, n, s1 y WHERE y.sig = x.sig AND y.k = x.k AND y.a = x.a AND y.b = {_mirror("x.b + t", "nj")} GROUP BY x.sig, x.k, x.b, x.a),
s3 AS (SELECT x.sig, x.k, x.b, x.a, sum(w * y.v) AS v FROM s2 x JOIN tap ON tap.sig = x.sig, n, s2 y WHERE y.sig = x.sig AND y.k = x.k AND y.b = x.b AND y.a = {_mirror("x.a + t", "nl")} GROUP BY x.sig, x.k, x.b, x.a),
d AS (SELECT sig, k, b, a, (lead(v) OVER wk - lag(v) OVER wk) / 2 AS dk, (lead(v) OVER wb - lag(v) OVER wb) / 2 AS db, (lead(v) OVER wa - lag(v) OVER wa) / 2 AS da FROM s3 WINDOW wk AS (PARTITION BY sig, b, a ORDER BY k), wb AS (PARTITION BY sig, k, a ORDER BY b), wa AS (PARTITION BY sig, k, b ORDER BY a)),
f AS (SELECT sig, k, b, a, coalesce(dk, lead(dk) OVER wk, lag(dk) OVER wk, 0) AS dk, coalesce(db, lead(db) OVER wb, lag(db) OVER wb, 0) AS db, coalesce(da, lead(da) OVER wa, lag(da) OVER wa, 0) AS da FROM d WINDOW wk AS (PARTITION BY sig, b, a ORDER BY k), wb AS (PARTITION BY sig, k, a ORDER BY b), wa AS (PARTITION BY sig, k, b ORDER BY a)),
ge AS (SELECT sig, k, b, a, sqrt(dk * dk + db * db + da * da) AS e FROM f), r AS (SELECT sig, k, b, a, e / max(e) OVER (PARTITION BY sig) AS e FROM ge), m AS (SELECT k, b, a, pow(product(e), 1 / 3.0) AS w FROM r GROUP BY k, b, a)"""


@query(_EDGES + " SELECT k, b, a, round(w / (SELECT max(w) FROM m), 6) + 0.0 AS weight FROM m")
def edge_weight(spark, sf_dir):
    """Edges of the stack as a volume that stand out at three scales."""
    vox, _ = box(spark, sf_dir)
    return metrics.edge_weight(vox, ["i", "j", "l"]).select(F.col("i").alias("k"), F.col("j").alias("b"), F.col("l").alias("a"), r6(F.col("weight")).alias("weight"))


_DFT = """q AS (SELECT k, b, f, sum(d * cos(2 * pi() * ((a * f) % 64) / 64)) AS re, sum(d * sin(2 * pi() * ((a * f) % 64) / 64)) AS im FROM d, range(33) r(f) GROUP BY ALL), p AS (SELECT k, f::INT AS f, avg(re * re + im * im) AS power FROM q GROUP BY k, f)"""
_RESIDUAL = "WITH @STACK, d AS (SELECT x.k, x.b, x.a, x.v - y.v AS d FROM s x JOIN s y ON y.k = x.k + 1 AND y.b = x.b AND y.a = x.a)"


@query(f"""{_RESIDUAL}, {_DFT}, m AS (SELECT k, avg(d * d) AS mse FROM d GROUP BY k), g AS (SELECT k, f, power, greatest(f / 64 * cos(pi() * (f / 64) / (1.0 + 1e-8)), 0) AS ramp, f / 33 AS gate, CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END AS times FROM p)
SELECT k, round(any_value(mse) + 0.5 * sum(times * power * ramp * ramp) / 4096, 6) + 0.0 AS filtered, round(any_value(mse) + sum(times * power * gate * gate) / 4096, 6) + 0.0 AS gated FROM g JOIN m USING (k) GROUP BY k""")
def filtered_losses(spark, sf_dir):
    """Mean squared residual of neighbouring frames with that of the residual under a ramp, and under a gate by frequency, added."""
    rows = frames(spark, sf_dir)
    met = rows.join(rows.select((F.col("k") - 1).alias("k"), "b", F.col("vals").alias("next")), ["k", "b"])
    residual = met.select("k", "b", F.zip_with("vals", "next", lambda x, y: x - y).alias("vals"))
    ramp = spark.createDataFrame(list(enumerate(spectral.cosine_ramp(64))), "f int, gain double")
    gate = spark.createDataFrame([(f, f / 33) for f in range(33)], "f int, gain double")
    mse = residual.groupBy("k").agg((F.sum(F.aggregate("vals", F.lit(0.0), lambda s, v: s + v * v)) / F.sum(F.size("vals"))).alias("mse"))
    filtered, gated = (spectral.filtered_residual(residual, g, 64, ["k"]).withColumnRenamed("value", name) for g, name in ((ramp, "filtered"), (gate, "gated")))
    met = mse.join(filtered, "k").join(gated, "k")
    return met.select("k", r6(F.col("mse") + 0.5 * F.col("filtered")).alias("filtered"), r6(F.col("mse") + F.col("gated")).alias("gated"))


_RADIAL = """WITH @STACK, w AS (SELECT k, b // 16 AS pb, a // 16 AS pa, b % 16 AS b, a % 16 AS a, v FROM s),
r1 AS (SELECT k, pb, pa, b, fx, sum(v * cos(2 * pi() * ((a * fx) % 16) / 16)) AS re, -sum(v * sin(2 * pi() * ((a * fx) % 16) / 16)) AS im FROM w, range(16) r(fx) GROUP BY ALL),
r2 AS (SELECT k, pb, pa, fx, fy, sum(re * cos(2 * pi() * ((b * fy) % 16) / 16) + im * sin(2 * pi() * ((b * fy) % 16) / 16)) AS re, sum(im * cos(2 * pi() * ((b * fy) % 16) / 16) - re * sin(2 * pi() * ((b * fy) % 16) / 16)) AS im FROM r1, range(16) r(fy) GROUP BY ALL),
h AS (SELECT k, least(round_even(sqrt(((fx + 8) % 16 - 8) ** 2 + ((fy + 8) % 16 - 8) ** 2), 0), 7)::INT AS f, re * re + im * im AS power FROM r2), p AS (SELECT k, f, avg(power) AS power FROM h GROUP BY k, f)"""


@query(_RADIAL + " SELECT k, f, round(power, 6) + 0.0 AS power FROM p")
def radial_power(spark, sf_dir):
    """Power of all patches of sixteen by sixteen pixels of each frame by distance from zero frequency."""
    return spectral.radial_power(frames(spark, sf_dir), 16, ["k"]).withColumn("power", r6(F.col("power")))


@query(_RADIAL + """, t AS (SELECT f, avg(power) AS green FROM p GROUP BY f), g AS (SELECT k, p.f, f * 0.625 AS freq, power, green FROM p JOIN t USING (f)),
m AS (SELECT k, avg(CASE WHEN freq BETWEEN 0.5 AND 1.5 THEN power END) AS pa, avg(CASE WHEN freq BETWEEN 0.5 AND 1.5 THEN green END) AS ga, max(freq) AS top FROM g GROUP BY k),
d AS (SELECT k, abs(log10(greatest(power / pa, 1e-6)) - log10(greatest(green / ga, 1e-3))) AS d, CASE WHEN freq > 1.5 THEN 0.1 + 0.9 * least(greatest((freq - 1.5) / (top - 1.5), 0), 1) ELSE 0 END AS w FROM g JOIN m USING (k))
SELECT k, round(sum(w * d) / sum(w), 6) + 0.0 AS loss FROM d GROUP BY k""")
def spectral_match(spark, sf_dir):
    """How far the shape of each frame's spectrum is from that of all."""
    power = spectral.radial_power(frames(spark, sf_dir), 16, ["k"])
    target = power.groupBy("f").agg(F.avg("power").alias("power"))
    return spectral.spectral_match(power, target, ["k"], 0.625).withColumn("loss", r6(F.col("loss")))


_CORNER = f"""WITH {_RUNS}, z AS (SELECT run, iter, 0.05 + 0.2 / (1 + exp((iter - 14) * 0.9)) + 0.001 * (30 - iter) AS res, 1 + 0.02 * iter + 3 / (1 + exp((17 - iter) * 0.9)) + abs(m) / 5000 AS nrm FROM v),
l AS (SELECT *, (ln(res) - min(ln(res)) OVER w) / (max(ln(res)) OVER w - min(ln(res)) OVER w) AS x, (ln(nrm) - min(ln(nrm)) OVER w) / (max(ln(nrm)) OVER w - min(ln(nrm)) OVER w) AS y, row_number() OVER (PARTITION BY run ORDER BY iter) - 1 AS i, count(*) OVER w AS n FROM z WINDOW w AS (PARTITION BY run)),
pl AS (SELECT l.*, greatest(0, least(i - 4, n - 9)) AS st FROM l), e AS (SELECT *, unnest(range(st, st + 9)) AS j FROM pl WHERE n >= 9),
h AS (SELECT *, (i - st - 4) AS t, (j - st - 4) AS u FROM e),
s AS (SELECT h.run, h.iter, any_value(h.i) AS i, any_value(h.n) AS n, any_value(h.res) AS res, any_value(h.nrm) AS nrm, sum((1 / 9.0 + t * u / 60.0 + (t * t - 60 / 9.0) * (u * u - 60 / 9.0) / 308.0) * q.x) AS x, sum((1 / 9.0 + t * u / 60.0 + (t * t - 60 / 9.0) * (u * u - 60 / 9.0) / 308.0) * q.y) AS y FROM h JOIN l q ON q.run = h.run AND q.i = h.j GROUP BY h.run, h.iter),
g AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(res) OVER w <= lag(res) OVER w AND lead(nrm) OVER w >= lag(nrm) OVER w AS trade FROM s WINDOW w AS (PARTITION BY run ORDER BY iter)),
c AS (SELECT run, iter, i, n, trade, abs(2 * ((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)) / (sqrt((x - x0) ** 2 + (y - y0) ** 2) * sqrt((x2 - x) ** 2 + (y2 - y) ** 2) * sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2))) AS cv FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY cv DESC, iter) AS r FROM c WHERE i >= 5 AND i < n - 5 AND trade AND cv >= 0.5)
SELECT t.run, coalesce(o.iter, -1)::INT AS corner_iter, round(coalesce(o.cv, 0), 6) AS curvature FROM (SELECT DISTINCT run FROM v) t LEFT JOIN o ON o.run = t.run AND o.r = 1"""


@query(_CORNER)
def lcurve_corner(spark, sf_dir):
    """The corner of each run's smoothed L-curve."""
    i = F.col("iter")
    points = runs(spark, sf_dir).select("run", "iter", (0.05 + 0.2 / (1 + F.exp((i - 14) * 0.9)) + 0.001 * (30 - i)).alias("res"), (1 + 0.02 * i + 3 / (1 + F.exp((17 - i) * 0.9)) + F.abs("m") / 5000).alias("nrm"))
    found = stopping.l_curve_corner(points, "res", "nrm")
    return found.select("run", F.coalesce("corner_iter", F.lit(-1)).alias("corner_iter"), F.round(F.coalesce("curvature", F.lit(0.0)), 6).alias("curvature"))
