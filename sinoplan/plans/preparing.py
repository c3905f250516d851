"""Queries of scan files, phases, patches, total variation and units over the vectors taken as a stack of frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sinoplan.functions.columns import r6
from sinoplan.operators import patches, phases, units, variation
from sinoplan.operators.lineage import checkpointed, shared_folder
from sinoplan.operators.statistics import value_quantum
from sinoplan.plans.geometry import _start
from sinoplan.plans.registry import query
from sinoplan.plans.tables import box, frames, stack
from sinoplan.sources import scans, vff


@query("""WITH @STACK SELECT 'acq-0' || (k % 2) || '-' || lpad(k::VARCHAR, 6, '0') || '.vff' AS name, '0' || (k % 2) AS phase, k::DOUBLE AS gantry, b, a, least(greatest(round_even(v * 1000, 0), -32768), 32767)::DOUBLE + 0.0 AS v FROM s WHERE k % 2 = 1 AND b >= 3""")
def scan_source(spark, sf_dir):
    """The frames written as files of two phases; one phase, from row 3 on, read through ``vff_scan``."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    named = F.concat(F.lit("acq-0"), (F.col("k") % 2).cast("string"), F.lit("-"), F.lpad(F.col("k").cast("string"), 6, "0"))
    files = vff.encoded_frames(frames(spark, sf_dir).withColumn("scan", named), "scan", scale=1000.0, columns={"gantryPosition": "k"})
    vff.save_files(files, folder).agg(F.sum("bytes")).first()
    got = scans.scan_rows(spark, folder, ["name", "phase", "gantry", "b", "vals"]).filter("phase = '01' AND b >= 3")
    return got.select("name", "phase", "gantry", "b", F.posexplode("vals").alias("a", "v")).withColumn("v", F.col("v").cast("double"))


@query("""WITH @STACK, r AS (SELECT k // 4 AS scan, (k % 4) // 2 AS phase, k % 2 AS n, b, a, v FROM s), d AS (SELECT DISTINCT scan, phase, n FROM r),
o AS (SELECT x.scan, x.n, CASE WHEN y.n IS NULL THEN 0 ELSE 1 END AS phase2, coalesce(y.n, z.n) AS n2 FROM d x LEFT JOIN d y ON y.scan = x.scan AND y.phase = 1 AND y.n = x.n LEFT JOIN d z ON z.scan = x.scan AND z.phase = 0 AND z.n = x.n + 1 WHERE x.phase = 0),
h AS (SELECT scan, max(b) + 1 AS nb FROM r GROUP BY scan),
m AS (SELECT x.scan, x.n, x.b, x.a, x.v, x.v - y.v AS e FROM r x JOIN o USING (scan, n) JOIN r y ON y.scan = x.scan AND y.phase = o.phase2 AND y.n = o.n2 AND y.b = x.b AND y.a = x.a JOIN h ON h.scan = x.scan WHERE x.phase = 0 AND x.b >= nb // 4 AND x.b < 3 * nb // 4),
q AS (SELECT scan, n, b, f, sum(v * cos(2 * pi() * ((a * f) % 64) / 64)) AS re, sum(v * sin(2 * pi() * ((a * f) % 64) / 64)) AS im, sum(e * cos(2 * pi() * ((a * f) % 64) / 64)) AS nr, sum(e * sin(2 * pi() * ((a * f) % 64) / 64)) AS ni FROM m, range(33) t(f) GROUP BY ALL),
p AS (SELECT scan, f, avg(re * re + im * im) AS whole, 0.5 * avg(nr * nr + ni * ni) AS noise FROM q GROUP BY scan, f),
g AS (SELECT scan, f, CASE WHEN f = 0 THEN 0 ELSE greatest(whole - noise, 0) / greatest(greatest(whole - noise, 0) + noise, 1e-30) END AS g FROM p),
w AS (SELECT d, exp(-0.5 * (d / 3.0) ** 2) / sum(exp(-0.5 * (d / 3.0) ** 2)) OVER () AS w FROM range(-12, 13) t(d)),
u AS (SELECT scan, f, w, CASE WHEN f + d < 0 THEN -1 - f - d WHEN f + d > 32 THEN 65 - f - d ELSE f + d END AS src FROM (SELECT DISTINCT scan, f FROM g), w)
SELECT u.scan::INT AS scan, u.f::INT AS f, round(least(greatest(sum(w * g.g), 0), 1), 6) + 0.0 AS gate FROM u JOIN g ON g.scan = u.scan AND g.f = u.src GROUP BY u.scan, u.f""")
def phase_gate(spark, sf_dir):
    """Four frames a scan, two of each phase; the last scan has one phase, and its frames meet their neighbours."""
    k = F.col("k")
    rows = frames(spark, sf_dir).select(F.floor(k / 4).cast("int").alias("scan"), F.floor(k % 4 / 2).cast("int").alias("phase"), (k % 2).alias("n"), "b", "vals")
    return phases.phase_gate(rows, 64).select("scan", "f", r6(F.col("gate")).alias("gate"))


@query("""WITH @STACK, @BOX, y AS (SELECT k AS i, b AS j, a AS l, v FROM x), n AS (SELECT max(j) + 1 AS nj, max(l) + 1 AS nl, max(i) + 1 AS ni FROM y),
m AS (SELECT i - 1 AS i0, j - 2 AS j0, l - 4 AS l0, -ln((('0x' || substr(md5('7:' || i || ':' || j || ':' || l), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(16::DOUBLE, 13)) / v AS key FROM y, n WHERE v > 0 AND i - 1 BETWEEN 0 AND ni - 2 AND j - 2 BETWEEN 0 AND nj - 4 AND l - 4 BETWEEN 0 AND nl - 8),
p AS (SELECT (row_number() OVER (ORDER BY key, i0, j0, l0) - 1)::INT AS patch, i0, j0, l0 FROM m ORDER BY key, i0, j0, l0 LIMIT 8),
c AS (SELECT patch, i, j, l, v, i < i0 + 2 AND j < j0 + 4 AND l < l0 + 8 AS inside FROM p JOIN y ON i BETWEEN i0 AND i0 + 2 AND j BETWEEN j0 AND j0 + 4 AND l BETWEEN l0 AND l0 + 8),
d AS (SELECT *, lead(v) OVER (PARTITION BY patch, j, l ORDER BY i) - v AS di, lead(v) OVER (PARTITION BY patch, i, l ORDER BY j) - v AS dj, lead(v) OVER (PARTITION BY patch, i, j ORDER BY l) - v AS dl FROM c)
SELECT patch, any_value(i0)::INT AS i0, any_value(j0)::INT AS j0, any_value(l0)::INT AS l0, round(coalesce(avg(abs(di)), 0) + coalesce(avg(abs(dj)), 0) + coalesce(avg(abs(dl)), 0), 6) + 0.0 AS tv FROM d JOIN p USING (patch) WHERE inside GROUP BY patch""")
def matter_patches(spark, sf_dir):
    """Eight patches of the stack drawn by its values, with their total variation."""
    vox, shape = box(spark, sf_dir)
    drawn = checkpointed(patches.matter_patches(vox, shape, (2, 4, 8), 8, seed=7))  # eight rows, read again below
    tv = patches.patch_variation(patches.patch_voxels(drawn, vox, (2, 4, 8), shape, halo=1))
    return drawn.join(tv, "patch").withColumn("tv", r6(F.col("tv")))


def _unrolled(steps: int, weight: float) -> str:
    """The dual steps in SQL, one set of tables a step; weight is the radius of the projection."""
    line = {"i": "j, l", "j": "i, l", "l": "i, j"}
    back = " + ".join(f"p{x} - coalesce(lag(p{x}) OVER (PARTITION BY {o} ORDER BY {x}), 0)" for x, o in line.items())
    out = "y0 AS (SELECT k AS i, b AS j, a AS l, v AS f, 0.0::DOUBLE AS pi, 0.0::DOUBLE AS pj, 0.0::DOUBLE AS pl FROM x)"
    for n in range(steps):
        ahead = ", ".join(f"p{x} + 0.125 * coalesce(lead(u) OVER (PARTITION BY {o} ORDER BY {x}) - u, 0) AS p{x}" for x, o in line.items())
        out += f", u{n} AS (SELECT *, f + {back} AS u FROM y{n}), g{n} AS (SELECT i, j, l, f, {ahead} FROM u{n}), r{n} AS (SELECT *, greatest(1, sqrt(pi * pi + pj * pj + pl * pl) / {weight}) AS r FROM g{n}), y{n + 1} AS (SELECT i, j, l, f, pi / r AS pi, pj / r AS pj, pl / r AS pl FROM r{n})"
    return out + f" SELECT i::INT AS i, j::INT AS j, l::INT AS l, round(f + {back}, 6) + 0.0 AS mu FROM y{steps}"


@query("WITH @STACK, @BOX, " + _unrolled(3, 0.05))
def tv_denoise(spark, sf_dir):
    """Three steps of total variation on the stack as a volume, two of them between shuffles."""
    vox, shape = box(spark, sf_dir)
    return variation.tv_step(vox, shape, 0.05, steps=3, inner=2).select("i", "j", "l", r6(F.col("mu")).alias("mu"))


@query()
def ordered_subsets_tv_run(spark, sf_dir):
    """Two chunks of ordered subsets with a total variation step after each."""
    m, x, data = _start(spark, sf_dir)
    shape = x.agg(*(F.max(c) + 1 for c in "ijl")).first()
    return variation.iterate_with_tv(m, x, data, tuple(shape), chunks=2, steps=1, weight=0.02, tv_steps=8, method="sirt", shrink=0.9, blocks=2).withColumn("mu", r6(F.col("mu")))


@query("""WITH @STACK, h AS (SELECT k, round(v * 1000) AS hu FROM s), q AS (SELECT k, min(gap) AS quantum FROM (SELECT k, hu - lag(hu) OVER (PARTITION BY k ORDER BY hu) AS gap FROM (SELECT DISTINCT k, hu FROM h)) GROUP BY k),
ev AS (SELECT k, avg(hu) AS mean, greatest(16, floor((max(hu) - min(hu)) / (2.0 * any_value(quantum)))::INT) AS bins FROM h JOIN q USING (k) GROUP BY k)
SELECT k AS volume, CASE k % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS dx, CASE WHEN k % 6 = 0 THEN 0.4 WHEN k % 3 = 0 THEN 0.2 WHEN k % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS dz, CASE k % 3 WHEN 0 THEN 'sidecar' WHEN 1 THEN 'header' ELSE 'assumed' END AS dx_from,
  CASE WHEN k % 6 = 0 THEN 'sidecar' ELSE 'width' END AS dz_from, CASE WHEN k % 6 = 3 THEN 'sidecar' ELSE 'assumed' END AS units_from, bins, round(CASE WHEN k % 6 = 3 THEN (mean + 1000) / (1120 / (0.02 + 0.001 * k)) ELSE (mean + 1000) / (1000 / 0.0219) END, 6) AS mu FROM ev""")
def volume_units(spark, sf_dir):
    """Each frame as a volume of unknown unit: some have a sidecar with a size or anchors, some a header with a size, some nothing."""
    vox = stack(spark, sf_dir).select(F.col("k").alias("volume"), F.round(F.col("v") * 1000).alias("hu"))
    k = F.col("volume")
    volumes = vox.select("volume").distinct().withColumn("element", F.when(k % 3 == 1, 0.5))
    own = F.when(k % 6 == 3, F.struct((0.001 * k).alias("anchor_air_value"), (0.02 + 0.002 * k).alias("anchor_tissue_value"), F.lit(None).cast("double").alias("target_air"), F.lit(None).cast("double").alias("target_tissue")))
    side = volumes.filter("volume % 3 = 0").select("volume", F.struct(F.lit(0.2).alias("xy"), F.when(k % 6 == 0, 0.4).alias("z")).alias("voxel_size_mm"), F.lit(None).cast("array<double>").alias("vol_origin_mm"), own.alias("hu_calibration"))
    anchors = units.volume_anchors(volumes, side)
    means = units.as_attenuation(vox, anchors).groupBy("volume").agg(F.avg("mu").alias("mu"), F.min("hu").alias("low"), F.max("hu").alias("high"))
    met = means.join(value_quantum(vox, ["volume"], "hu"), "volume").join(units.volume_grids(volumes, side), "volume").join(anchors, "volume")
    return met.select("volume", "dx", "dz", "dx_from", "dz_from", "units_from", units.bins_for_quantum(F.col("low"), F.col("high"), F.col("quantum")).alias("bins"), r6(F.col("mu")).alias("mu"))
