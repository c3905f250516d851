"""Queries of ordered state, spectra and sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinoplan.functions.columns import filter_window, learning_rate, r6
from sinoplan.functions.sizing import needs, verdict
from sinoplan.operators import spectral, stopping
from sinoplan.plans.registry import query
from sinoplan.plans.tables import daily, frames, read

_RUNS = """d AS (SELECT event_type AS run, date_trunc('day', ts) AS day, round(avg(value), 6) AS m FROM events GROUP BY 1, 2), v AS (SELECT run, (row_number() OVER (PARTITION BY run ORDER BY day) - 1)::INT AS iter, m FROM d),
b AS (SELECT *, max(m) OVER (PARTITION BY run ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY iter) AS i FROM v),
p AS (SELECT *, coalesce(m > best_before, true) AS is_best, coalesce(m > best_before + greatest(0.01, 0.002 * abs(best_before)), true) AS progress FROM b),
t AS (SELECT *, (i - max(CASE WHEN progress THEN i END) OVER (PARTITION BY run ORDER BY iter))::INT AS bad FROM p)"""


def runs(spark, sf_dir):
    """A run for each type of event: the mean of its values by day."""
    from pyspark.sql.window import Window

    days = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("m"))
    return days.select("run", (F.row_number().over(Window.partitionBy("run").orderBy("day")) - 1).cast("int").alias("iter"), "m")


@query(f"WITH {_RUNS} SELECT run, iter, m, is_best, progress, bad, iter >= floor(0.5 * n) AND bad >= greatest(8, ceil(0.25 * n)) AS stop FROM t")
def early_stop_trace(spark, sf_dir):
    return stopping.stopping_trace(runs(spark, sf_dir), 0.01, 0.002).select("run", "iter", "m", "is_best", "progress", "bad", "stop")


@query(f"""WITH {_RUNS}, s AS (SELECT *, iter >= 5 AND bad >= 3 AS stop FROM t), e AS (SELECT run, min(CASE WHEN stop THEN iter END) AS s, max(iter) AS l FROM s GROUP BY run),
o AS (SELECT t.run, iter, row_number() OVER (PARTITION BY t.run ORDER BY m DESC, iter) AS r FROM t JOIN e USING (run) WHERE s IS NULL OR iter <= s)
SELECT run, coalesce(s, -1)::INT AS stop_iter, (CASE WHEN s IS NULL THEN l ELSE o.iter END)::INT AS delivered_iter FROM e JOIN o USING (run) WHERE r = 1""")
def delivered_iterate(spark, sf_dir):
    trace = stopping.stopping_trace(runs(spark, sf_dir), 0.01, 0.002, patience=3, start=5)
    return stopping.delivered(trace).select("run", F.coalesce("stop_iter", F.lit(-1)).alias("stop_iter"), "delivered_iter")


@query(f"""WITH {_RUNS}, z AS (SELECT run, iter, m, 10 / (iter + 1.0::DOUBLE) + 0.3 AS res, 1 + 0.05 * iter + m / 100 AS nrm FROM v),
l AS (SELECT *, (ln(res) - min(ln(res)) OVER w) / (max(ln(res)) OVER w - min(ln(res)) OVER w) AS x, (ln(nrm) - min(ln(nrm)) OVER w) / (max(ln(nrm)) OVER w - min(ln(nrm)) OVER w) AS y FROM z WINDOW w AS (PARTITION BY run)),
g AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY run ORDER BY iter))
SELECT run, iter, round(2 * ((x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)) / (sqrt((x - x0) ** 2 + (y - y0) ** 2) * sqrt((x2 - x) ** 2 + (y2 - y) ** 2) * sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2)), 6) + 0.0 AS curvature FROM g WHERE x0 IS NOT NULL AND x2 IS NOT NULL""")
def lcurve_curvature(spark, sf_dir):
    points = runs(spark, sf_dir).withColumns({"res": 10 / (F.col("iter") + 1.0) + 0.3, "nrm": 1 + 0.05 * F.col("iter") + F.col("m") / 100})
    return stopping.l_curve(points, "res", "nrm").filter(F.col("curvature").isNotNull()).select("run", "iter", r6(F.col("curvature")).alias("curvature"))


@query("WITH RECURSIVE " + _RUNS + """, f AS (SELECT run, iter, CASE WHEN progress THEN 0 ELSE 1 END AS bad, 0 AS rest, 0.1::DOUBLE AS rate FROM t WHERE iter = 0 UNION ALL
SELECT t.run, t.iter, CASE WHEN t.progress THEN 0 WHEN f.rest > 0 THEN f.bad WHEN f.bad + 1 >= 3 AND f.rate > 0.001 * (1 + 1e-9) THEN 0 ELSE f.bad + 1 END,
 CASE WHEN NOT t.progress AND f.rest > 0 THEN f.rest - 1 WHEN NOT t.progress AND f.bad + 1 >= 3 AND f.rate > 0.001 * (1 + 1e-9) THEN 1 ELSE f.rest END,
 CASE WHEN NOT t.progress AND f.rest = 0 AND f.bad + 1 >= 3 AND f.rate > 0.001 * (1 + 1e-9) THEN greatest(f.rate * 0.5, 0.001) ELSE f.rate END FROM f JOIN t ON t.run = f.run AND t.iter = f.iter + 1)
SELECT run, iter, round(rate, 9) AS rate, bad::INT AS bad FROM f""")
def lr_plateau_trace(spark, sf_dir):
    trace = stopping.stopping_trace(runs(spark, sf_dir), 0.01, 0.002)
    return stopping.reduce_on_plateau(trace, 0.1).withColumn("rate", F.round("rate", 9))


@query("""WITH i AS (SELECT o_orderkey, (o_orderkey % 1000)::INT AS i FROM orders) SELECT o_orderkey, round(CASE WHEN i < 50 THEN greatest(1e-8, (i + 1) / 50) ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1, greatest(0, (i - 50 - 190) / 760)))) END, 6) AS cosine,
round(CASE WHEN i < 50 THEN greatest(1e-8, (i + 1) / 50) ELSE pow(0.999, greatest(i - 50, 0)) END, 6) AS exponential FROM i""")
def lr_schedule(spark, sf_dir):
    i = F.col("o_orderkey") % 1000
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(learning_rate(i, "cosine", 50, 1000, hold=0.2, floor=0.1), 6).alias("cosine"), F.round(learning_rate(i, "exponential", 50, 1000), 6).alias("exponential"))


@query("""WITH e AS (SELECT vec_id, embedding, len(embedding) AS n FROM embeddings), f AS (SELECT DISTINCT unnest(range(n // 2 + 1)) AS f, n FROM e), g AS (SELECT f, n, f / (n * 0.1) AS fr, 5.0::DOUBLE AS top FROM f)
SELECT f::INT AS f, round(CASE WHEN fr <= top * 0.8 THEN fr END, 6) AS ramp, round(CASE WHEN fr <= top * 0.8 THEN fr * CASE WHEN fr = 0 THEN 1 ELSE sin(pi() * fr / (1.6 * top)) / (pi() * fr / (1.6 * top)) END END, 6) AS shepp_logan, round(CASE WHEN fr <= top * 0.8 THEN fr * cos(pi() * fr / (1.6 * top)) END, 6) + 0.0 AS cosine, round(CASE WHEN fr <= top * 0.8 THEN fr * (0.54 + 0.46 * cos(pi() * fr / (0.8 * top))) END, 6) AS hamming FROM g WHERE fr <= top * 0.8""")
def ramp_kernels(spark, sf_dir):
    """Filter responses at the frequencies of the vectors' length."""
    n = read(spark, sf_dir, "embeddings").select(F.size("embedding").alias("n")).distinct()
    f = n.withColumn("f", F.explode(F.expr("sequence(0, cast(n / 2 as int))"))).withColumn("fr", F.col("f") / (F.col("n") * 0.1)).filter("fr <= 4.0")
    return f.select("f", *(r6(filter_window(F.col("fr"), 5.0, k, 0.8)).alias(k.replace("-", "_")) for k in ("ramp", "shepp-logan", "cosine", "hamming"))).distinct()


_SPECTRUM = "WITH @STACK, q AS (SELECT k, b, f, sum(v * cos(2 * pi() * ((a * f) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((a * f) % 64) / 64)) AS im FROM s, range(33) r(f) GROUP BY ALL), p AS (SELECT k, f::INT AS f, avg(re * re + im * im) AS power FROM q GROUP BY k, f)"


@query(_SPECTRUM + " SELECT k, f, round(power, 6) + 0.0 AS power FROM p")
def row_power_spectrum(spark, sf_dir):
    return spectral.power_spectrum(frames(spark, sf_dir), 64, ["k"]).select("k", "f", r6(F.col("power")).alias("power"))


@query(_SPECTRUM + " SELECT p.k, round(avg(CASE WHEN p.f < 12 THEN greatest(-10 * log10(p.power / r.power), 0) END), 6) + 0.0 AS deficit, round(avg(CASE WHEN p.f >= 12 THEN greatest(10 * log10(p.power / r.power), 0) END), 6) + 0.0 AS excess FROM p JOIN p r ON r.k = p.k + 1 AND r.f = p.f WHERE p.f > 0 GROUP BY p.k")
def spectral_split(spark, sf_dir):
    p = spectral.power_spectrum(frames(spark, sf_dir), 64, ["k"])
    found = spectral.spectral_split(p, p.withColumn("k", F.col("k") - 1), ["k"], 12)
    return found.select("k", r6(F.col("deficit")).alias("deficit"), r6(F.col("excess")).alias("excess"))


@query("""WITH @STACK, d AS (SELECT x.k, x.b, x.a, x.v, (x.v - y.v) / sqrt(2) AS d FROM s x JOIN s y ON y.k = x.k + 1 AND y.b = x.b AND y.a = x.a),
q AS (SELECT k, b, f, sum(v * cos(2 * pi() * ((a * f) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((a * f) % 64) / 64)) AS im, sum(d * cos(2 * pi() * ((a * f) % 64) / 64)) AS nr, sum(d * sin(2 * pi() * ((a * f) % 64) / 64)) AS ni FROM d, range(33) r(f) GROUP BY ALL)
SELECT k, f::INT AS f, round(greatest((avg(re * re + im * im) - avg(nr * nr + ni * ni)) / avg(re * re + im * im), 0), 6) + 0.0 AS gain FROM q GROUP BY k, f""")
def wiener_gate(spark, sf_dir):
    """Signal share of each frequency, noise taken from the difference to the next frame."""
    rows = frames(spark, sf_dir)
    met = rows.join(rows.select((F.col("k") - 1).alias("k"), "b", F.col("vals").alias("next")), ["k", "b"])
    noise = met.select("k", "b", F.zip_with("vals", "next", lambda x, y: (x - y) / F.sqrt(F.lit(2.0))).alias("vals"))
    gains = spectral.wiener_gain(spectral.power_spectrum(met.select("k", "b", "vals"), 64, ["k"]), spectral.power_spectrum(noise, 64, ["k"]), ["k"])
    return gains.select("k", "f", r6(F.col("gain")).alias("gain"))


@query("""WITH @STACK, w AS (SELECT f, CASE WHEN f / 6.4 <= 5 THEN f / 6.4 * (0.54 + 0.46 * cos(pi() * (f / 6.4) / 5)) ELSE 0 END AS h FROM range(33) r(f)),
h AS (SELECT d, sum(h * cos(2 * pi() * ((d * f) % 64) / 64) * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) / 64 AS h FROM w, range(64) t(d) GROUP BY d)
SELECT k, b, o.a::INT AS a, round(sum(v * h), 6) + 0.0 AS v FROM s JOIN h ON true JOIN range(64) o(a) ON h.d = (o.a - s.a + 64) % 64 GROUP BY k, b, o.a""")
def ramp_filter_circulant(spark, sf_dir):
    return spectral.filter_circulant(frames(spark, sf_dir), 64, 0.1).select("k", "b", F.posexplode("vals").alias("a", "v")).select("k", "b", "a", r6(F.col("v")).alias("v"))


@query("""WITH @STACK, w AS (SELECT f, CASE WHEN f / 6.4 <= 5 THEN f / 6.4 * (0.54 + 0.46 * cos(pi() * (f / 6.4) / 5)) ELSE 0 END AS h FROM range(33) r(f)),
h AS (SELECT d, sum(h * cos(2 * pi() * ((d * f) % 64) / 64) * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END) / 64 AS h FROM w, range(64) t(d) GROUP BY d)
SELECT k, b, o.a::INT AS a, round(sum(v * h), 6) + 0.0 AS v FROM s JOIN h ON true JOIN range(64) o(a) ON h.d = (o.a - s.a + 64) % 64 GROUP BY k, b, o.a""")
def ramp_filter_fft(spark, sf_dir):
    return spectral.filter_fft(frames(spark, sf_dir), 0.1).select("k", "b", F.posexplode("vals").alias("a", "v")).select("k", "b", "a", r6(F.col("v")).alias("v"))


@query("""WITH g AS (SELECT p_partkey, (p_size * 4000000)::BIGINT AS s, (p_retailprice * 1000000)::BIGINT AS v FROM part),
n AS (SELECT *, floor((s + v // 8) * 1.15::DOUBLE)::BIGINT AS analytic, floor((4 * v + 3 * s) * 1.15::DOUBLE)::BIGINT AS split_host FROM g)
SELECT p_partkey, analytic, split_host, CASE WHEN analytic > 300000000 THEN 'insufficient' WHEN analytic > 0.8 * 300000000 THEN 'tight' ELSE 'ok' END AS verdict FROM n""")
def preflight(spark, sf_dir):
    """Bytes that a job of each part's size needs, and whether a machine of 300 MB would do."""
    s, v = (F.col("p_size") * 4000000).cast("long"), F.round(F.col("p_retailprice") * 1000000).cast("long")
    analytic, _ = needs("analytic", s, v)
    _, host = needs("split", s, v)
    return read(spark, sf_dir, "part").select("p_partkey", analytic.alias("analytic"), host.alias("split_host"), verdict(analytic, F.lit(300000000)).alias("verdict"))


@query("""WITH d AS (SELECT (row_number() OVER (ORDER BY day) - 1)::INT AS iter, round(m, 6) AS m FROM (SELECT date_trunc('day', ts) AS day, avg(value) AS m FROM events GROUP BY 1)) SELECT iter, m, round(max(m) OVER (ORDER BY iter), 6) AS best FROM d""")
def daily_metric(spark, sf_dir):
    """The ordered metric itself with its best so far."""
    from pyspark.sql.window import Window

    return daily(spark, sf_dir).select("iter", "m", F.round(F.max("m").over(Window.orderBy("iter")), 6).alias("best"))
