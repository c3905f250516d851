"""Queries of self-calibration: the stack as a turn whose tilt and axis are searched."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sinoplan.functions.columns import r6
from sinoplan.operators import selfcal
from sinoplan.plans.registry import query
from sinoplan.plans.scans import turn

#: What the smallest tables, with ten views of small values, can tell.
LEAST, PAIRS = 0.05, 50


def detector(spark, sf_dir):
    """Rows, views and the detector of the given turn."""
    rows, views, _, s = turn(spark, sf_dir)
    return rows, views, selfcal.Detector(s.r_s, s.sdd, s.pitch, s.n_a, s.n_b, s.cpa, s.cpb)


_VIEWS = """n AS (SELECT count(DISTINCT k) AS nk, (max(b) + 1)::INT AS nb, (max(a) + 1)::INT AS na FROM s), v AS (SELECT k, 2 * pi() * k / nk AS th, row_number() OVER (ORDER BY k) - 1 AS vi FROM (SELECT DISTINCT k FROM s), n),
q AS (SELECT vi, s.b, s.a, s.v FROM s JOIN v USING (k)), ex AS (SELECT min(th) AS t0, max(th) AS t1, count(*) AS nv, (SELECT median(d) FROM (SELECT th - lag(th) OVER (ORDER BY th) AS d FROM v)) AS dt FROM v)"""

#: Five bands of detector rows, as wide as a seventh of the detector.
_BANDS = """bd AS (SELECT (row_number() OVER (ORDER BY m) - 1)::INT AS band, m - h AS b0, m + h AS b1 FROM (SELECT round_even((-0.4::DOUBLE + i * 0.2::DOUBLE) * nb + (nb - 1) / 2.0::DOUBLE, 0)::INT AS m, (nb // 14)::INT AS h, nb FROM n, range(5) t(i)) WHERE m - h >= 0 AND m + h < nb)"""


def _costs(name: str, tries: str) -> str:
    """Costs (band, nth, cpa, n, cost) of candidates (band, nth, cpa)."""
    return f"""{name}_p AS (SELECT c.*, vi, j, 2 * cpa - j AS j2, th + pi() + 2 * atan((j - cpa) * 0.2::DOUBLE / 80) AS b2 FROM {tries} c, v, n, range(na) u(j)),
{name}_o AS (SELECT band, nth, cpa, vi, j, j2, CASE WHEN t1 - t0 > radians(350) THEN t0 + (b2 - t0) - (t1 - t0 + dt) * floor((b2 - t0) / (t1 - t0 + dt)) ELSE b2 END AS b3 FROM {name}_p, ex),
{name}_w AS (SELECT band, nth, cpa, vi, j, least(greatest(floor((b3 - t0) / dt), 0), nv - 2)::INT AS v0, (b3 - t0) / dt AS fp, least(floor(j2), na - 2)::INT AS c0, j2 FROM {name}_o, n, ex WHERE b3 >= t0 AND b3 <= t1 AND j2 >= 0 AND j2 <= na - 1),
{name}_d AS (SELECT w.band, nth, cpa, o.v AS one, (1 - least(greatest(fp - v0, 0), 1)) * ((1 - (j2 - c0)) * x00.v + (j2 - c0) * x01.v) + least(greatest(fp - v0, 0), 1) * ((1 - (j2 - c0)) * x10.v + (j2 - c0) * x11.v) AS two
 FROM {name}_w w JOIN bd ON bd.band = w.band JOIN q o ON o.vi = w.vi AND o.a = w.j AND o.b BETWEEN b0 AND b1 JOIN q x00 ON x00.vi = v0 AND x00.a = c0 AND x00.b = o.b JOIN q x01 ON x01.vi = v0 AND x01.a = c0 + 1 AND x01.b = o.b
 JOIN q x10 ON x10.vi = v0 + 1 AND x10.a = c0 AND x10.b = o.b JOIN q x11 ON x11.vi = v0 + 1 AND x11.a = c0 + 1 AND x11.b = o.b),
{name} AS (SELECT c.band, c.nth, c.cpa, coalesce(n, 0) AS n, CASE WHEN n >= 50 THEN cost END AS cost FROM {tries} c LEFT JOIN (SELECT band, nth, count(*) AS n, var_samp(one - two) AS cost FROM {name}_d WHERE abs(one) > 0.05 AND abs(two) > 0.05 GROUP BY band, nth) USING (band, nth))"""


_GRID = "g AS (SELECT band, i::INT AS nth, (na - 1) / 2.0::DOUBLE - 2 + 0.5::DOUBLE * i AS cpa FROM bd, n, range(9) t(i))"


def _cuts(d):
    return selfcal.even_bands(d, 5, 2 * (d.n_b // 14) + 1, 0.8)


@query(f"WITH @STACK, {_VIEWS}, {_BANDS}, {_GRID}, {_costs('k', 'g')} SELECT band, nth, round(cpa, 6) AS cpa, n, round(cost, 6) + 0.0 AS cost FROM k")
def psi_band_costs(spark, sf_dir):
    """How far conjugate rays disagree in five bands of rows for nine columns of the axis: one level of the search."""
    rows, views, d = detector(spark, sf_dir)
    cuts = _cuts(d)
    tries = [d.cpa - 2 + 0.5 * n for n in range(9)]
    costs = selfcal.conjugate_costs(rows, selfcal.view_order(views), cuts, [tries] * len(cuts), d, LEAST, PAIRS)
    return costs.select("band", "nth", F.round("cpa", 6).alias("cpa"), "n", r6(F.col("cost")).alias("cost"))


@query(f"""WITH @STACK, {_VIEWS}, {_BANDS}, {_GRID}, {_costs('k', 'g')}, m AS (SELECT band, arg_min(cpa, cost) AS best FROM k GROUP BY band HAVING count(cost) = 9), f AS (SELECT band, i::INT AS nth, best + 0.25::DOUBLE * (i - 3) AS cpa FROM m, range(7) t(i)), {_costs('r', 'f')},
y AS (SELECT *, lag(cost) OVER w AS c0, lead(cost) OVER w AS c2, min(cpa) OVER (PARTITION BY band) AS lo, max(cpa) OVER (PARTITION BY band) AS hi, row_number() OVER (PARTITION BY band ORDER BY cost, nth) AS rk, count(cost) OVER (PARTITION BY band) AS full_n FROM r WINDOW w AS (PARTITION BY band ORDER BY nth)),
z AS (SELECT (b0 + b1) / 2.0::DOUBLE AS r, n AS pairs, CASE WHEN c0 IS NULL OR c2 IS NULL OR c0 + c2 - 2 * cost <= 0 THEN cpa ELSE least(greatest(cpa + 0.25 * (c0 - c2) / (2 * (c0 + c2 - 2 * cost)), lo), hi) END AS cpa FROM y JOIN bd USING (band) WHERE rk = 1 AND full_n = 7),
l AS (SELECT regr_slope(cpa, r - (nb - 1) / 2.0) AS slope, regr_intercept(cpa, r - (nb - 1) / 2.0) AS cpa0 FROM z, n)
SELECT r AS "row", round(cpa, 5) AS cpa, pairs, round(degrees(asin(least(greatest(slope, -1), 1))), 4) + 0.0 AS psi_deg, round(cpa0, 5) AS cpa0 FROM z, l""")
def psi_bands(spark, sf_dir):
    """Tilt and axis by bands: the best of nine columns, of seven about it, a parabola, and a line through the bands."""
    rows, views, d = detector(spark, sf_dir)
    fit, bands = selfcal.tilt_by_bands(rows, views, d, 5, 2 * (d.n_b // 14) + 1, 0.8, 2.0, 0.5, LEAST, PAIRS)
    told = [(b["row"], round(b["cpa"], 5), b["pairs"], round(fit["psi_deg"], 4) + 0.0, round(fit["cpa0"], 5)) for b in bands]
    return spark.createDataFrame(told, "row double, cpa double, pairs long, psi_deg double, cpa0 double")


@query()
def psi_joint(spark, sf_dir):
    """Tilt and axis by the summed cost of twelve bands, and why they are not believed."""
    rows, views, d = detector(spark, sf_dir)
    fit = selfcal.tilt_jointly(rows, views, d, bands=12, least=LEAST, pairs=PAIRS)
    return spark.createDataFrame([(fit["psi_deg"], fit["cpa0"], fit["depth"], fit["bands"], selfcal.doubts(fit["psi_deg"], fit["depth"]))], "psi_deg double, cpa0 double, depth double, bands int, doubts array<string>")


@query(f"""WITH @STACK, {_VIEWS}, t AS (SELECT * FROM (VALUES (0, -0.02::DOUBLE, 0.0::DOUBLE), (1, 0.0, 0.0), (2, 0.02, 0.5)) t(nth, psi, off)), g AS (SELECT p::INT AS plane, i::INT AS i, j::INT AS j, (i + 0.5 - 10) * 0.3 AS x, (j + 0.5 - 10) * 0.3 AS y, p - (h - 1) / 2.0 AS z FROM (SELECT greatest(2, nb // 8) AS h FROM n) m, range(h) a(p), range(20) b(i), range(20) c(j)),
u AS (SELECT nth, plane, i, j, vi, (vi >= nv // 2)::INT AS half, psi, off, 400 * (y * cos(th) - x * sin(th)) / (50 + x * cos(th) + y * sin(th)) AS u, 400 * z / (50 + x * cos(th) + y * sin(th)) AS w FROM g, v, t, ex),
c AS (SELECT nth, plane, i, j, vi, half, (nb - 1) / 2.0 + cos(psi) * w - sin(psi) * u AS b, (na - 1) / 2.0 + off + cos(psi) * u + sin(psi) * w AS a FROM u, n), c4 AS (SELECT *, floor(b)::INT + d AS bi, floor(a)::INT + f AS ai FROM c, range(2) x(d), range(2) y(f)),
pl AS (SELECT nth, plane, i, j, coalesce(sum(CASE WHEN half = 0 THEN q.v * (1 - abs(c4.b - bi)) * (1 - abs(c4.a - ai)) END), 0) AS h0, coalesce(sum(CASE WHEN half = 1 THEN q.v * (1 - abs(c4.b - bi)) * (1 - abs(c4.a - ai)) END), 0) AS h1 FROM c4 LEFT JOIN q ON q.vi = c4.vi AND q.b = bi AND q.a = ai GROUP BY nth, plane, i, j),
d AS (SELECT nth, plane, coalesce((lead(h0) OVER x - lag(h0) OVER x) / 2, lead(h0) OVER x - h0, h0 - lag(h0) OVER x) AS a0, coalesce((lead(h0) OVER y - lag(h0) OVER y) / 2, lead(h0) OVER y - h0, h0 - lag(h0) OVER y) AS b0, coalesce((lead(h1) OVER x - lag(h1) OVER x) / 2, lead(h1) OVER x - h1, h1 - lag(h1) OVER x) AS a1, coalesce((lead(h1) OVER y - lag(h1) OVER y) / 2, lead(h1) OVER y - h1, h1 - lag(h1) OVER y) AS b1
 FROM pl WINDOW x AS (PARTITION BY nth, plane, j ORDER BY i), y AS (PARTITION BY nth, plane, i ORDER BY j))
SELECT nth, plane, round(corr(sqrt(a0 * a0 + b0 * b0), sqrt(a1 * a1 + b1 * b1)), 6) + 0.0 AS score FROM d GROUP BY nth, plane""")
def psi_half_scores(spark, sf_dir):
    """How far both halves of the turn show the same edges, in planes over the whole detector, for three tilts and axes: one level of the search; NaN where a half shows none."""
    rows, views, d = detector(spark, sf_dir)
    planes = max(2, d.n_b // 8)
    grid = selfcal.plane_grid(spark, d, 6.0, 0.3, tuple(p - (planes - 1) / 2 for p in range(planes)))
    scores = selfcal.half_scan_scores(grid, rows, selfcal.view_order(views), [(-0.02, d.cpa), (0.0, d.cpa), (0.02, d.cpa + 0.5)], d, math.nan)
    return scores.select("nth", "plane", r6(F.col("score")).alias("score"))


@query()
def psi_half_scans(spark, sf_dir):
    """The curve of a search by half scans whose grid grows to its top, on filtered rows."""
    rows, views, d = detector(spark, sf_dir)
    order = selfcal.view_order(views)
    filtered = selfcal.checkpointed(selfcal.filter_fft(rows, d.pitch, "ramp", padded=True))
    grid = selfcal.checkpointed(selfcal.plane_grid(spark, d, 6.0, 0.3, (d.n_b / 24, -d.n_b / 24)))

    def score(tries):
        found = selfcal.half_scan_scores(grid, filtered, order, [(math.radians(x), d.cpa) for x in tries], d).groupBy("nth").agg(F.avg("score").alias("score")).collect()
        by = {r["nth"]: r["score"] for r in found}
        return [by[n] for n in range(len(tries))]

    xs, ys, edge = selfcal.widened(score, [-0.5, -0.25, 0.0, 0.25, 0.5], 0.25, -selfcal.MOST_PSI, selfcal.MOST_PSI)
    top = selfcal.parabola_top(xs, ys)
    return spark.createDataFrame([(round(float(x), 6), round(float(y), 6), round(top, 6), edge) for x, y in zip(xs, ys, strict=True)], "psi_deg double, score double, top double, at_end boolean")
