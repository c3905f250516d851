"""Queries of histograms and calibration over prices and quantities as value populations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinoplan.functions.columns import affine, anchor_scale, band_fraction, r6
from sinoplan.operators import statistics as op
from sinoplan.operators.lineage import checkpointed
from sinoplan.operators.preprocess import running_median
from sinoplan.operators.support import extent
from sinoplan.plans.registry import query
from sinoplan.plans.tables import lineitem, read, stack

_MODE = """e AS (SELECT g, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi, median(v) AS md FROM d GROUP BY g),
h AS (SELECT d.g, least(floor((v - lo) / (hi - lo) * 256), 255)::INT AS bin, count(*) AS n FROM d JOIN e USING (g) WHERE v BETWEEN lo AND hi AND hi > lo GROUP BY ALL),
f AS (SELECT e.g, lo, hi, md, b.bin, coalesce(n, 0) AS n FROM e CROSS JOIN range(256) b(bin) LEFT JOIN h ON h.g = e.g AND h.bin = b.bin),
y AS (SELECT *, lag(n) OVER w AS y0, lead(n) OVER w AS y2, row_number() OVER (PARTITION BY g ORDER BY n DESC, bin) AS r FROM f WINDOW w AS (PARTITION BY g ORDER BY bin)),
m AS (SELECT g, lo + (bin + 0.5) * (hi - lo) / 256 + coalesce(greatest(-0.5, least(0.5, 0.5 * (y0 - y2) / nullif(y0 - 2.0 * n + y2, 0))), 0) * (hi - lo) / 256 AS mode FROM y WHERE r = 1)"""


@query(f"WITH d AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem), {_MODE} SELECT g AS l_returnflag, round(mode, 6) + 0.0 AS mode FROM m")
def hist_mode(spark, sf_dir):
    return op.mode(lineitem(spark, sf_dir), ["l_returnflag"], "l_extendedprice").withColumn("mode", r6(F.col("mode")))


@query("""WITH h AS (SELECT l_linestatus, least(floor((l_extendedprice - 900) / 99100 * 256), 255)::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 100000 GROUP BY ALL)
SELECT g.l_linestatus, b.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT l_linestatus FROM lineitem) g CROSS JOIN range(256) b(bin) LEFT JOIN h ON h.l_linestatus = g.l_linestatus AND h.bin = b.bin""")
def histogram_hu(spark, sf_dir):
    return op.histogram(lineitem(spark, sf_dir), ["l_linestatus"], "l_extendedprice", bins=256, low=900.0, high=100000.0).select("l_linestatus", "bin", "n")


@query("""WITH h AS (SELECT l_returnflag AS g, least(floor((l_extendedprice - 900) / 99100 * 128), 127)::INT AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 900 AND 100000 GROUP BY ALL),
f AS (SELECT g.g, b.bin::INT AS bin, coalesce(n, 0) AS y FROM (SELECT DISTINCT l_returnflag AS g FROM lineitem) g CROSS JOIN range(128) b(bin) LEFT JOIN h ON h.g = g.g AND h.bin = b.bin),
r AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY bin) AS run FROM (SELECT *, CASE WHEN y = lag(y) OVER (PARTITION BY g ORDER BY bin) THEN 0 ELSE 1 END AS new FROM f)),
t AS (SELECT g, run, min(bin) AS b0, max(bin) AS b1, any_value(y) AS h FROM r GROUP BY g, run),
p AS (SELECT g, ((b0 + b1) // 2)::INT AS peak, h FROM (SELECT *, lag(h) OVER w AS l, lead(h) OVER w AS rr FROM t WINDOW w AS (PARTITION BY g ORDER BY run)) WHERE h > l AND h > rr),
q AS (SELECT p.*, coalesce((SELECT max(bin) FROM f WHERE f.g = p.g AND bin < peak AND y > h), -1) AS lo, coalesce((SELECT min(bin) FROM f WHERE f.g = p.g AND bin > peak AND y > h), 128) AS hi FROM p),
z AS (SELECT q.g, peak, h, min(CASE WHEN bin <= peak THEN y END) AS l, min(CASE WHEN bin >= peak THEN y END) AS rr FROM q JOIN f ON f.g = q.g AND bin > lo AND bin < hi GROUP BY q.g, peak, h)
SELECT g AS l_returnflag, peak, h::BIGINT AS height, (h - greatest(l, rr))::BIGINT AS prominence FROM z""")
def peak_prominence(spark, sf_dir):
    hist = op.histogram(lineitem(spark, sf_dir), ["l_returnflag"], "l_extendedprice", bins=128, low=900.0, high=100000.0)
    return op.peaks(hist, ["l_returnflag"]).select("l_returnflag", "peak", F.col("h").alias("height"), "prominence")


@query("""WITH d AS (SELECT l_returnflag, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, l_discount * 100 FROM lineitem)
SELECT l_returnflag, round(min(gap), 6) + 0.0 AS quantum FROM (SELECT l_returnflag, v - lag(v) OVER (PARTITION BY l_returnflag ORDER BY v) AS gap FROM (SELECT DISTINCT l_returnflag, round(v, 6) AS v FROM d)) GROUP BY l_returnflag""")
def value_quantum(spark, sf_dir):
    items = lineitem(spark, sf_dir)
    both = items.select("l_returnflag", F.col("l_quantity").alias("v")).unionByName(items.select("l_returnflag", (F.col("l_discount") * 100).alias("v")))
    return op.value_quantum(both.withColumn("v", F.round("v", 6)), ["l_returnflag"], "v").withColumn("quantum", r6(F.col("quantum")))


@query("""SELECT l_returnflag, round(avg((l_quantity >= 0 AND l_quantity < 10)::INT), 6) + 0.0 AS air, round(avg((l_quantity >= 10 AND l_quantity < 20)::INT), 6) + 0.0 AS fat, round(avg((l_quantity >= 20 AND l_quantity < 40)::INT), 6) + 0.0 AS soft, round(avg((l_quantity >= 40 AND l_quantity < 99)::INT), 6) + 0.0 AS bone,
  quantile_cont(l_quantity, 0.01) AS p1, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.99) AS p99, round(quantile_cont(l_quantity, 0.999), 6) AS p99_9, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag""")
def landmark_bands(spark, sf_dir):
    found = op.landmarks(lineitem(spark, sf_dir), ["l_returnflag"], "l_quantity", {"air": (0, 10), "fat": (10, 20), "soft": (20, 40), "bone": (40, 99)})
    return found.withColumns({c: r6(F.col(c)) for c in ("air", "fat", "soft", "bone", "p99_9")})


@query(f"""WITH d AS (SELECT l_linestatus || (l_extendedprice >= 30000)::INT AS g, l_extendedprice AS v FROM lineitem), {_MODE}
SELECT l.l_linestatus, round(quantile_cont(l_extendedprice, 0.01), 6) AS p1, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99, round(quantile_cont(l_extendedprice, 0.999), 6) AS p99_9,
  round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  round(any_value(m.mode), 6) AS air_mode, round(any_value(m2.mode), 6) AS tissue_mode,
  concat_ws(',', CASE WHEN any_value(m.mode) > 10000 THEN 'air off' END, CASE WHEN any_value(m2.mode) > 40000 THEN 'tissue off' END, CASE WHEN stddev_pop(l_extendedprice) < 1 THEN 'flat' END) AS warnings
FROM lineitem l JOIN m ON m.g = l.l_linestatus || '0' JOIN m m2 ON m2.g = l.l_linestatus || '1' GROUP BY l.l_linestatus""")
def volume_statistics(spark, sf_dir):
    found = op.statistics(lineitem(spark, sf_dir), ["l_linestatus"], "l_extendedprice", 30000.0)
    rules = {"air off": F.col("air_mode") > 10000, "tissue off": F.col("tissue_mode") > 40000, "flat": F.col("std") < 1}
    found = found.withColumn("warnings", F.concat_ws(",", op.warnings_of(rules)))
    return found.withColumns({c: F.round(c, 6) for c in ("p1", "p50", "p99", "p99_9", "air_mode", "tissue_mode")} | {c: F.round(c, 4) for c in ("mean", "std")})


@query("""WITH q AS (SELECT range AS q, (range + 0.5) / 64 AS p FROM range(64)),
a AS (SELECT l_returnflag AS g, quantile_cont(l_quantity, [(i + 0.5) / 64 for i in range(64)]) AS x FROM lineitem GROUP BY 1),
b AS (SELECT quantile_cont(l_quantity, [(i + 0.5) / 64 for i in range(64)]) AS x FROM lineitem),
m AS (SELECT g, abs(a.x[q + 1] - b.x[q + 1]) AS d, 0.2 + 0.8 * pow(least(greatest((p - 0.5) / 0.5, 0), 1), 2) AS w FROM a, b, q)
SELECT g AS l_returnflag, round(avg(d), 6) + 0.0 AS plain, round(sum(w * d) / sum(w), 6) + 0.0 AS weighted FROM m GROUP BY g""")
def census_w1(spark, sf_dir):
    """Distance of each flag's quantile function from that of all, plain and with a knee in the weights."""
    items = lineitem(spark, sf_dir)
    # Sixty-four rows a flag, read twice.
    left = checkpointed(op.quantile_function(items, ["l_returnflag"], "l_quantity", 64))
    right = left.select("l_returnflag").distinct().crossJoin(checkpointed(op.quantile_function(items, [], "l_quantity", 64)))
    share = (F.col("q") + 0.5) / 64
    weight = 0.2 + 0.8 * F.pow(F.least(F.greatest((share - 0.5) / 0.5, F.lit(0.0)), F.lit(1.0)), F.lit(2.0))
    plain, told = op.quantile_distance(left, right, ["l_returnflag"]), op.quantile_distance(left, right, ["l_returnflag"], weight)
    return plain.select("l_returnflag", r6(F.col("distance")).alias("plain")).join(told.select("l_returnflag", r6(F.col("distance")).alias("weighted")), "l_returnflag")


@query("""WITH a AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS air, quantile_cont(l_extendedprice, 0.6) AS tissue FROM lineitem GROUP BY 1),
h AS (SELECT l.l_returnflag, 1120 / (tissue - air) AS s, -1000 - 1120 / (tissue - air) * air AS o, l_extendedprice AS v, air, tissue FROM lineitem l JOIN a USING (l_returnflag))
SELECT l_returnflag, round(any_value(s), 6) AS scale, round(any_value(o), 6) AS "offset", round(avg(v * s + o), 4) AS mean_hu, round(max(abs((v * s + o - o) / s - v)), 6) + 0.0 AS inverse_error, round(avg(least(greatest((v - tissue) / (2 * tissue - tissue), 0), 1)), 6) AS bone, round(avg((v > tissue AND v < 2 * tissue)::INT), 6) AS partial FROM h GROUP BY l_returnflag""")
def anchor_map(spark, sf_dir):
    """Two anchors of each flag, the map they give, its inverse, and how far values lie through the bone band."""
    items = lineitem(spark, sf_dir)
    anchors = op.named_quantiles(items, ["l_returnflag"], "l_extendedprice", {"air": 0.05, "tissue": 0.6})
    anchors = anchors.withColumn("s", anchor_scale(F.col("air"), F.col("tissue"))).withColumn("o", -1000 - F.col("s") * F.col("air"))
    v, met = F.col("l_extendedprice"), items.join(anchors, "l_returnflag")
    hu = affine(v, F.col("s"), F.col("o"))
    beta = band_fraction(v, F.col("tissue"), 2 * F.col("tissue"))
    return met.groupBy("l_returnflag").agg(F.round(F.first("s"), 6).alias("scale"), F.round(F.first("o"), 6).alias("offset"), F.round(F.avg(hu), 4).alias("mean_hu"), r6(F.max(F.abs((hu - F.col("o")) / F.col("s") - v))).alias("inverse_error"), F.round(F.avg(beta), 6).alias("bone"), F.round(F.avg(((beta > 0) & (beta < 1)).cast("double")), 6).alias("partial"))


@query()
def find_anchors(spark, sf_dir):
    """Air and tissue of a two-material mixture that prices and quantities make, for two affine copies of it."""
    items = lineitem(spark, sf_dir)
    noise = (F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1000)) / 1000.0 - 0.5) * 0.004 + (F.col("l_discount") - 0.05) * 0.02
    mu = F.when(F.col("l_quantity") <= 25, 0.0).otherwise(0.02) + noise
    both = items.select(F.lit("plain").alias("copy"), mu.alias("mu")).unionByName(items.select(F.lit("affine").alias("copy"), (mu * 3 + 0.5).alias("mu")))
    return op.find_anchors(both, ["copy"], "mu").select("copy", r6(F.col("air")).alias("air"), r6(F.col("tissue")).alias("tissue"), "clear")


_SUPPORT = "WITH @STACK, c AS (SELECT k, a, quantile_cont(v, 0.98) AS p FROM s GROUP BY k, a), n AS (SELECT k, max(a) + 1 AS n FROM c GROUP BY k), " \
    "q AS (SELECT c.k, c.a, n, unnest(range(c.a - 4, c.a + 5)) AS i FROM c JOIN n USING (k)), " \
    "f AS (SELECT k, a, n, CASE WHEN i < 0 THEN -1 - i WHEN i >= n THEN 2 * n - 1 - i ELSE i END AS i FROM q), " \
    "m AS (SELECT f.k, f.a, any_value(f.n) AS n, median(c.p) AS m FROM f JOIN c ON c.k = f.k AND c.a = f.i GROUP BY f.k, f.a), " \
    "b AS (SELECT k, median(m) AS base FROM m WHERE a < 3 OR a >= n - 3 GROUP BY k), " \
    "t AS (SELECT m.k, base + greatest(0.002, 6 * 1.4826 * median(abs(m - base))) AS thr FROM m JOIN b USING (k) WHERE a < 3 OR a >= n - 3 GROUP BY m.k, base) "


@query(_SUPPORT + "SELECT m.k, round(any_value(thr), 6) AS threshold, coalesce(min(CASE WHEN m > thr THEN a END), -1)::INT AS first, coalesce(max(CASE WHEN m > thr THEN a END), -1)::INT AS last FROM m JOIN t USING (k) GROUP BY m.k")
def support_extent(spark, sf_dir):
    """First and last column of each frame that stands out of the level at its edges."""
    profile = stack(spark, sf_dir).groupBy("k", "a").agg(F.percentile("v", 0.98).alias("p"))
    smooth = running_median(profile, ["k"], "a", "p", 9, "m")
    return extent(smooth, "k", "a", "m", 0.002).select("k", F.round("threshold", 6).alias("threshold"), F.coalesce("first", F.lit(-1)).alias("first"), F.coalesce("last", F.lit(-1)).alias("last"))


@query("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 6) AS tissue, round(median(abs(p_retailprice - m)) * 1.4826 * 2.5 + any_value(m), 6) AS shoulder, round(quantile_cont(p_retailprice, 0.995), 6) AS dense
FROM part JOIN (SELECT p_brand, median(p_retailprice) AS m FROM part GROUP BY 1) USING (p_brand) GROUP BY p_brand""")
def bone_anchors(spark, sf_dir):
    """Median, the robust shoulder above it and the dense end of each population."""
    part = read(spark, sf_dir, "part")
    middle = part.groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("m"))
    met = part.join(middle, "p_brand")
    return met.groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.5), 6).alias("tissue"), F.round(F.percentile(F.abs(F.col("p_retailprice") - F.col("m")), 0.5) * 1.4826 * 2.5 + F.first("m"), 6).alias("shoulder"), F.round(F.percentile("p_retailprice", 0.995), 6).alias("dense"))
