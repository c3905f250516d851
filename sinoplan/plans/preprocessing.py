"""Queries of preprocessing over the vectors taken as a stack of frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sinoplan.functions.columns import clamp_transmission, r6, soft_clamp_lower, soft_clamp_upper
from sinoplan.operators import preprocess as op
from sinoplan.operators.lineage import checkpointed, shared_folder
from sinoplan.plans.registry import query
from sinoplan.plans.tables import frames, lineitem, stack
from sinoplan.sources import vff

_AIR = """h AS (SELECT greatest(1, (max(b) + 1) // 8) AS h, (max(b) + 1) // 2 AS m FROM p),
band AS (SELECT p.* FROM p, h WHERE b >= m - h AND b < m + h),
air AS (SELECT a FROM band GROUP BY a HAVING quantile_cont(v, 0.95) <= 0.207),
off AS (SELECT f.k, CASE WHEN (SELECT count(*) FROM air) >= 8 THEN coalesce((SELECT median(v) FROM band WHERE band.k = f.k AND a IN (FROM air)), 0.0) ELSE 0.0 END AS o FROM (SELECT DISTINCT k FROM p) f)"""


@query(f"""WITH @STACK,
p AS (SELECT k, b, a, -ln(least(greatest((100 + 900 * exp(-v) - 100) / (900 + 1e-6), 1e-6::DOUBLE), 5::DOUBLE)) AS v FROM s),
{_AIR}
SELECT k, count(*) AS n, round(min(o), 6) + 0.0 AS level, round(avg(v - o), 6) + 0.0 AS mean, round(min(v - o), 6) + 0.0 AS low, round(max(v - o), 6) + 0.0 AS high
FROM p JOIN off USING (k) GROUP BY k""")
def flat_field_log(spark, sf_dir):
    """Counts to levelled line integrals, summed up by frame."""
    counts = stack(spark, sf_dir).withColumns({"bright": F.lit(1000.0), "dark": F.lit(100.0)}).withColumn("v", F.col("dark") + 900.0 * F.exp(-F.col("v")))
    p = checkpointed(op.flat_field(counts, None, hard=True, ceiling=5.0))  # the stack is read for its levels and for what they are taken from
    levels = op.air_offsets(p, most=0.207)
    return p.join(levels, "k").groupBy("k").agg(F.count("*").alias("n"), r6(F.min("offset")).alias("level"), r6(F.avg(F.col("v") - F.col("offset"))).alias("mean"), r6(F.min(F.col("v") - F.col("offset"))).alias("low"), r6(F.max(F.col("v") - F.col("offset"))).alias("high"))


@query(f"WITH @STACK, p AS (SELECT * FROM s), {_AIR} SELECT k, round(o, 6) + 0.0 AS level FROM off")
def air_normalize(spark, sf_dir):
    return op.air_offsets(stack(spark, sf_dir), most=0.207).select("k", r6(F.col("offset")).alias("level"))


@query("""WITH t AS (SELECT l_returnflag, l_linestatus, l_extendedprice / 50000 AS t FROM lineitem),
c AS (SELECT *, CASE WHEN (t - 0.5) * 50 > 20 THEN t ELSE 0.5 + ln(1 + exp(greatest(least((t - 0.5) * 50, 20), -700))) / 50 END AS low,
  1.05 - CASE WHEN (1.05 - t) * 200 > 20 THEN 1.05 - t ELSE ln(1 + exp(greatest(least((1.05 - t) * 200, 20), -700))) / 200 END AS up,
  CASE WHEN (t - 1e-6::DOUBLE) * 200 > 20 THEN t ELSE 1e-6::DOUBLE + ln(1 + exp(greatest(least((t - 1e-6::DOUBLE) * 200, 20), -700))) / 200 END AS low2 FROM t)
SELECT l_returnflag, l_linestatus, round(avg(low), 6) + 0.0 AS lower, round(avg(up), 6) + 0.0 AS upper,
  round(avg(1.05 - CASE WHEN (1.05 - low2) * 200 > 20 THEN 1.05 - low2 ELSE ln(1 + exp(greatest(least((1.05 - low2) * 200, 20), -700))) / 200 END), 6) + 0.0 AS both FROM c GROUP BY ALL""")
def soft_clamps(spark, sf_dir):
    t = F.col("l_extendedprice") / 50000.0
    return lineitem(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(r6(F.avg(soft_clamp_lower(t, 0.5))).alias("lower"), r6(F.avg(soft_clamp_upper(t))).alias("upper"), r6(F.avg(clamp_transmission(t))).alias("both"))


@query("""WITH @STACK, m AS (SELECT b, a, avg(v) AS m FROM s GROUP BY b, a), n AS (SELECT b, max(a) + 1 AS n FROM m GROUP BY b),
q AS (SELECT m.b, m.a, m.m, unnest(range(m.a - 25, m.a + 26)) AS p, n FROM m JOIN n USING (b)),
f AS (SELECT b, a, m, CASE WHEN ((p % (2 * n)) + 2 * n) % (2 * n) < n THEN ((p % (2 * n)) + 2 * n) % (2 * n) ELSE 2 * n - 1 - ((p % (2 * n)) + 2 * n) % (2 * n) END AS p FROM q)
SELECT f.b, f.a, round(any_value(f.m) - median(m2.m), 6) + 0.0 AS ring FROM f JOIN m m2 ON m2.b = f.b AND m2.a = f.p GROUP BY f.b, f.a""")
def ring_correct(spark, sf_dir):
    return op.ring_profile(stack(spark, sf_dir)).select("b", "a", r6(F.col("ring")).alias("ring"))


@query("""WITH @STACK, z AS (SELECT (max(b) + 1) // 4 * 4 AS nb, (max(a) + 1) // 4 * 4 AS na FROM s)
SELECT k, (b // 4)::INT AS b, (a // 4)::INT AS a, round(avg(v), 6) + 0.0 AS v FROM s, z WHERE b < nb AND a < na GROUP BY k, b // 4, a // 4""")
def pool_frames(spark, sf_dir):
    return op.pool(stack(spark, sf_dir), 4).withColumn("v", r6(F.col("v")))


@query("""WITH @STACK, z AS (SELECT (max(k) + 1) // 2 * 2 AS ni, (max(b) + 1) // 2 * 2 AS nj, (max(a) + 1) // 2 * 2 AS nl FROM s)
SELECT (k // 2)::INT AS i, (b // 2)::INT AS j, (a // 2)::INT AS l, round(avg(v), 6) + 0.0 AS mu FROM s, z WHERE k < ni AND b < nj AND a < nl GROUP BY k // 2, b // 2, a // 2""")
def block_mean_3d(spark, sf_dir):
    vox = stack(spark, sf_dir).select(F.col("k").alias("i"), F.col("b").alias("j"), F.col("a").alias("l"), F.col("v").alias("mu"))
    return op.block_mean(vox, 2).withColumn("mu", r6(F.col("mu")))


@query("""WITH @STACK, g AS (SELECT *, CASE WHEN v <= 0.15 THEN v END AS good, CASE WHEN v <= 0.15 THEN a END AS ga FROM s),
t AS (SELECT *, last_value(good IGNORE NULLS) OVER l AS lv, last_value(ga IGNORE NULLS) OVER l AS la, first_value(good IGNORE NULLS) OVER r AS rv, first_value(ga IGNORE NULLS) OVER r AS ra FROM g
WINDOW l AS (PARTITION BY k, b ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY k, b ORDER BY a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k, b, a, round(CASE WHEN v <= 0.15 THEN v WHEN lv IS NOT NULL AND rv IS NOT NULL THEN lv + (rv - lv) * (a - la) / (ra - la) ELSE coalesce(lv, rv, v) END, 6) + 0.0 AS v FROM t""")
def metal_gap_fill(spark, sf_dir):
    return op.fill_gaps(stack(spark, sf_dir), 0.15).select("k", "b", "a", r6(F.col("v")).alias("v"))


@query("WITH @STACK SELECT k, b, a, least(greatest(round_even(v * 1000, 0), -32768), 32767)::DOUBLE + 0.0 AS v FROM s")
def vff_roundtrip(spark, sf_dir):
    """The frames written as VFF files, each by one task, and read again."""
    folder = f"{shared_folder(spark)}/vff-{uuid.uuid4().hex}"
    names = F.lpad(F.col("k").cast("string"), 6, "0")
    files = vff.encoded_frames(frames(spark, sf_dir).withColumn("scan", F.concat(F.lit("acq-00-"), names)), "scan", scale=1000.0)
    vff.save_files(files, folder).agg(F.sum("bytes")).first()
    rows = vff.frame_stack(vff.read_vff(spark, folder), step=1.0)
    return rows.select(F.col("k").cast("int").alias("k"), "b", F.posexplode("vals").alias("a", "v")).select("k", "b", "a", F.col("v").cast("double").alias("v"))
