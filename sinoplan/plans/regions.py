"""Queries of regions, grids, rays through them and what is handed out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinoplan.functions.columns import r6
from sinoplan.operators import geometry as geo
from sinoplan.operators import metrics, regions, stochastic
from sinoplan.operators import project as pro
from sinoplan.plans.geometry import _BOX, _MATRIX, _RAYS, matrix, phantom, rays, scans
from sinoplan.plans.geometry import _SCANS as SCANS
from sinoplan.plans.registry import query
from sinoplan.plans.tables import box, read, stack

_CROP = f"""WITH {SCANS}, c AS (SELECT *, 5 + s_suppkey % 7 AS x0, 25 + s_suppkey % 11 AS x1, 4 + s_suppkey % 5 AS y0, 24 + s_suppkey % 13 AS y1, 2 + s_suppkey % 3 AS z0, 20 + s_suppkey % 9 AS z1, 15.5::DOUBLE AS lx, 14.25::DOUBLE AS ly, 11.0::DOUBLE AS lz FROM f),
b AS (SELECT *, -(x1 - lx) AS x_min, -(x0 - lx) AS x_max, y0 - ly AS y_min, y1 - ly AS y_max, z0 - lz AS z_min, z1 - lz AS z_max FROM c)"""


def crops(spark, sf_dir):
    """A crop box for each supplier's scan, about the isocentre, as the columns x_min to z_max."""
    g, k = geo.field_of_view(scans(spark, sf_dir)), F.col("s_suppkey")
    told = {"x_min": 5 + k % 7, "x_max": 25 + k % 11, "y_min": 4 + k % 5, "y_max": 24 + k % 13, "z_min": 2 + k % 3, "z_max": 20 + k % 9}
    return g.withColumns(regions.crop_bounds(told, {"x": F.lit(15.5), "y": F.lit(14.25), "z": F.lit(11.0)}))


@query(_CROP + """ SELECT s_suppkey, round(x_min, 6) AS x_min, round(x_max, 6) AS x_max, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max, round(z_min, 6) AS z_min, round(z_max, 6) AS z_max,
round_even((x_max - x_min) / 0.3, 0)::INT AS nx, round_even((y_max - y_min) / 0.3, 0)::INT AS ny, round_even((z_max - z_min) / 0.7, 0)::INT AS nz, round((x_min + x_max) / 2, 6) + 0.0 AS ox, round((y_min + y_max) / 2, 6) + 0.0 AS oy, round((z_min + z_max) / 2, 6) + 0.0 AS oz,
round(((n_a - 1) / 2.0 - 1) / 3, 6) AS cpa, round((cpb - 1) / 3, 6) AS cpb FROM b""")
def scan_regions(spark, sf_dir):
    """Crop boxes about the isocentre, the grids that they give, and the centre of rotation by both policies."""
    g = regions.bounds_grid(crops(spark, sf_dir), 0.3, 0.7)
    centre = {"cpa": regions.rotation_centre(F.col("cpa"), F.col("n_a"), "center", 3), "cpb": regions.rotation_centre(F.col("cpb"), F.col("n_b"), "xml", 3)}
    return g.withColumns(centre).select("s_suppkey", "nx", "ny", "nz", *(r6(F.col(c)).alias(c) for c in (*regions.BOUNDS, "ox", "oy", "oz", "cpa", "cpb")))


@query(_CROP + """, d AS (SELECT *, 6 + s_suppkey % 5 AS r, -5 - s_suppkey % 3 AS z_low, 6.5::DOUBLE AS z_high FROM b),
e AS (SELECT *, greatest(x_min, -r) AS ex0, least(x_max, r) AS ex1, greatest(y_min, -r) AS ey0, least(y_max, r) AS ey1, greatest(z_min, z_low) AS ez0, least(z_max, z_high) AS ez1 FROM d)
SELECT s_suppkey, round(ex0, 6) AS x_min, round(ex1, 6) AS x_max, round(ey0, 6) AS y_min, round(ey1, 6) AS y_max, round(ez0, 6) AS z_min, round(ez1, 6) AS z_max, round_even((ex1 - ex0) / 0.3, 0)::INT AS nx, round_even((ey1 - ey0) / 0.3, 0)::INT AS ny, round_even((ez1 - ez0) / 0.7, 0)::INT AS nz,
round((ex0 + ex1) / 2 / r, 6) + 0.0 AS unit_x, ((ex0 + ex1) / 2) ** 2 + ((ey0 + ey1) / 2) ** 2 <= r * r AND (ez0 + ez1) / 2 BETWEEN z_low AND z_high AS inside FROM e""")
def export_regions(spark, sf_dir):
    """What each scan hands out of the cylinder that its model fills, and whether the middle of it is inside."""
    g, k = crops(spark, sf_dir), F.col("s_suppkey")
    g = g.withColumns({"r": (6 + k % 5).cast("double"), "z_low": (-5 - k % 3).cast("double"), "z_high": F.lit(6.5)})
    domain = regions.cylinder_bounds(F.col("r"), F.col("z_low"), F.col("z_high"))
    g = regions.bounds_grid(g.withColumns(regions.export_bounds({c: F.col(c) for c in regions.BOUNDS}, domain)), 0.3, 0.7)
    return g.select("s_suppkey", *(r6(F.col(c)).alias(c) for c in regions.BOUNDS), "nx", "ny", "nz", r6(regions.to_unit_cube(F.col("ox"), -F.col("r"), F.col("r"))).alias("unit_x"), regions.inside_cylinder(F.col("ox"), F.col("oy"), F.col("oz"), F.col("r"), F.col("z_low"), F.col("z_high")).alias("inside"))


@query("""WITH g AS (SELECT p_partkey, 3 + p_size AS n, least(7, 3 + p_size) AS k FROM part), p AS (SELECT p_partkey, n, k, unnest(range(k)) AS i FROM g),
q AS (SELECT DISTINCT p_partkey, round_even(least(greatest(i * (n - 1) / greatest(k - 1, 1)::DOUBLE + n // 2 - (n - 1) / 2.0, 0), n - 1), 0)::INT AS idx FROM p),
o AS (SELECT p_partkey, unnest(range(n))::INT AS idx FROM g), m AS (SELECT o.p_partkey, o.idx, row_number() OVER (PARTITION BY o.p_partkey ORDER BY o.idx) AS r FROM o ANTI JOIN q ON q.p_partkey = o.p_partkey AND q.idx = o.idx),
a AS (SELECT * FROM q UNION ALL SELECT m.p_partkey, m.idx FROM m JOIN g USING (p_partkey) WHERE r <= k - (SELECT count(*) FROM q WHERE q.p_partkey = m.p_partkey))
SELECT p_partkey, count(*)::INT AS views, min(idx) AS first, max(idx) AS last, sum(idx)::BIGINT AS total FROM a GROUP BY p_partkey""")
def angle_choice(spark, sf_dir):
    """Seven views spread over each scan."""
    n = (3 + F.col("p_size")).cast("int")
    told = read(spark, sf_dir, "part").select("p_partkey", regions.spread_angles(n, 7).alias("at"))
    return told.select("p_partkey", F.size("at").alias("views"), F.array_min("at").alias("first"), F.array_max("at").alias("last"), F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"""WITH {_RAYS}, {_BOX}, h AS (SELECT vec_id, ox, oy, oz, dx, dy, dz, greatest(lo, 0) AS t0, hi AS t1 FROM b WHERE hi > lo AND hi > 0),
p AS (SELECT vec_id, (t1 - t0) / 16 AS dt, ox + (t0 + (i + 0.5) * (t1 - t0) / 16) * dx AS x, oy + (t0 + (i + 0.5) * (t1 - t0) / 16) * dy AS y, oz + (t0 + (i + 0.5) * (t1 - t0) / 16) * dz AS z FROM h, range(16) u(i))
SELECT vec_id, round(sum(dt * CASE WHEN (x - 0.1) * (x - 0.1) + (y + 0.2) * (y + 0.2) <= 0.36 AND z BETWEEN -0.7 AND 0.5 THEN 1 ELSE 0.25 END), 6) + 0.0 AS length FROM p GROUP BY vec_id""")
def ray_support(spark, sf_dir):
    """Path of each ray, what lies outside a cylinder counted for a quarter."""
    points = pro.quadrature(geo.ray_box(rays(spark, sf_dir), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)), 16)
    inside = regions.inside_cylinder(F.col("x"), F.col("y"), F.col("z"), 0.6, -0.7, 0.5, 0.1, -0.2)
    return points.groupBy("vec_id").agg(r6(F.sum(F.col("dt") * F.when(inside, 1.0).otherwise(0.25))).alias("length"))


@query(f"""WITH {_RAYS}, s AS (SELECT *, -ox / 120 AS sx, -oy / 120 AS sy, -oz / 120 AS sz FROM r), k AS (SELECT *, 200 / (dx * sx + dy * sy + dz * sz) AS k FROM s), p AS (SELECT *, dx * k AS px, dy * k AS py, dz * k AS pz FROM k),
a AS (SELECT *, -px * sy + py * sx AS a, pz AS b FROM p), n AS (SELECT *, 0.3 * 0.1 - 0.01 * b AS au, -0.2 * 0.2 + 0.01 * a AS av, 0.02 * a - 0.015 * b AS a_s FROM a),
m AS (SELECT *, px - au * sy + a_s * sx AS nx, py + au * sx + a_s * sy AS ny, pz + av + a_s * sz AS nz FROM n)
SELECT vec_id, round(ox * 1.01, 6) + 0.0 AS ox, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS dx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS dy, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) + 0.0 AS dz FROM m""")
def perturbed_rays(spark, sf_dir):
    """The rays of a detector that is shifted by parts of a pixel and tilted about all axes."""
    found = geo.perturb_rays(rays(spark, sf_dir), 120.0, 200.0, 0.1, 0.2, 0.3, -0.2, 0.01, -0.015, 0.02, 1.01)
    return found.select("vec_id", *(r6(F.col(c)).alias(c) for c in ("ox", "dx", "dy", "dz")))


@query("""WITH s AS (SELECT vec_id, unnest(range(8))::INT AS s, embedding FROM embeddings), w AS (SELECT vec_id, s, greatest(embedding[s + 1]::DOUBLE, 0) + 1e-5::DOUBLE AS w FROM s),
c AS (SELECT vec_id, s, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w), u AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY s) AS upto FROM c), f AS (SELECT *, upto - p AS lower FROM u),
q AS (SELECT vec_id, q, (q + 0.5) / 6 AS u, s, p, lower, row_number() OVER (PARTITION BY vec_id, q ORDER BY s) AS r FROM f, range(6) t(q) WHERE (q + 0.5) / 6 <= upto + 1e-12)
SELECT vec_id, q::INT AS q, round(2 + 0.5 * s + (u - lower) / greatest(p, 1e-5) * 0.5, 6) + 0.0 AS t FROM q WHERE r = 1""")
def importance_samples(spark, sf_dir):
    """Six places along each ray, dense where its eight coarse samples are large."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("s", "v"))
    bins = e.select("vec_id", "s", (2 + 0.5 * F.col("s")).alias("lo"), (2.5 + 0.5 * F.col("s")).alias("hi"), F.greatest(F.col("v").cast("double"), F.lit(0.0)).alias("w"))
    return pro.importance_samples(bins, "vec_id", 6).withColumn("t", r6(F.col("t")))


def _mu(name: str, points: str) -> str:
    """Values of the phantom at points (vec_id, s, t) of rays h."""
    return f"""{name}_p AS (SELECT c.*, (ox + t * dx) / 0.25 + 3.5 AS x, (oy + t * dy) / 0.25 + 3.5 AS y, (oz + t * dz) / 0.25 + 3.5 AS z FROM {points} c JOIN h USING (vec_id)),
{name}_c AS (SELECT vec_id, s, t, (floor(x) + p)::INT AS i, (floor(y) + q)::INT AS j, (floor(z) + o)::INT AS l, abs(1 - p - (x - floor(x))) * abs(1 - q - (y - floor(y))) * abs(1 - o - (z - floor(z))) AS w FROM {name}_p, range(2) a1(p), range(2) a2(q), range(2) a3(o)),
{name} AS (SELECT vec_id, s, t, sum(w * coalesce(mu, 0)) AS mu FROM {name}_c LEFT JOIN vx USING (i, j, l) GROUP BY vec_id, s, t)"""


@query(f"""{_MATRIX}, cp AS (SELECT vec_id, i AS s, t0 + i * (t1 - t0) / 8 + (t1 - t0) / 16 AS t FROM h, range(8) u(i)), {_mu('m1', 'cp')}, w0 AS (SELECT m1.*, (t1 - t0) / 8 AS dt, t0 + s * (t1 - t0) / 8 AS lo, greatest(mu * (t1 - t0) / 8, 0) + 1e-5 AS w FROM m1 JOIN h USING (vec_id)),
w1 AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM w0), w2 AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY s) AS upto FROM w1), qq AS (SELECT vec_id, q, lo, dt, p, upto - p AS lower, row_number() OVER (PARTITION BY vec_id, q ORDER BY s) AS r FROM w2, range(12) t(q) WHERE (q + 0.5) / 12 <= upto + 1e-12),
fp AS (SELECT vec_id, 100 + q AS s, lo + ((q + 0.5) / 12 - lower) / greatest(p, 1e-5) * dt AS t FROM qq WHERE r = 1), {_mu('m2', 'fp')}, al AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
wd AS (SELECT vec_id, s, mu, coalesce((lead(t) OVER w + t) / 2, t1) - coalesce((lag(t) OVER w + t) / 2, t0) AS width, (t1 - t0) / 8 AS dt FROM al JOIN h USING (vec_id) WINDOW w AS (PARTITION BY vec_id ORDER BY t)),
pp AS (SELECT vec_id, sum(CASE WHEN s < 100 THEN mu * dt END) AS p_coarse, sum(mu * width) AS p FROM wd GROUP BY vec_id) SELECT r.vec_id, round(coalesce(p_coarse, 0), 6) + 0.0 AS p_coarse, round(coalesce(p, 0), 6) + 0.0 AS p FROM r LEFT JOIN pp USING (vec_id)""")
def hierarchical_rays(spark, sf_dir):
    """Line integrals of the phantom by eight pieces, and by twelve more places where these found much."""
    met = geo.ray_box(rays(spark, sf_dir), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))
    found = pro.hierarchical_rays(met, phantom(spark, sf_dir), (8, 8, 8), 0.25, 8, 12, "vec_id")
    return found.select("vec_id", r6(F.col("p_coarse")).alias("p_coarse"), r6(F.col("p")).alias("p"))


@query("""WITH @STACK, @BOX, n AS (SELECT max(k) + 1 AS nk, max(b) + 1 AS nb, max(a) + 1 AS na FROM x)
SELECT 'axial' AS view, k AS u, b AS v, round(x.v, 6) + 0.0 AS mu FROM x, n WHERE a = na // 2 UNION ALL SELECT 'coronal', k, a, round(x.v, 6) + 0.0 FROM x, n WHERE b = nb // 2 UNION ALL SELECT 'sagittal', b, a, round(x.v, 6) + 0.0 FROM x, n WHERE k = nk // 2""")
def midplane_views(spark, sf_dir):
    """The three planes through the middle of the stack taken as a volume."""
    vox, n = box(spark, sf_dir)
    return pro.midplanes(vox, n).withColumn("mu", r6(F.col("mu")))


@query("""WITH @STACK, @BOX, q AS (SELECT (floor(b / 8) * 8)::INT AS b0, (floor(a / 8) * 8)::INT AS a0, k, b, a, v FROM x)
SELECT k, b0, a0, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(sum(CASE WHEN b = b0 AND a = a0 THEN v END), 6) + 0.0 AS corner FROM q WHERE (k * 31 + b0 * 7 + a0) % 5 = 0 AND k <> 3 GROUP BY k, b0, a0""")
def projection_patches(spark, sf_dir):
    """A repeatable choice of patches of eight by eight pixels with one view withheld."""
    vox, _ = box(spark, sf_dir)
    b0, a0 = ((F.floor(F.col(c) / 8) * 8).cast("int").alias(name) for c, name in (("j", "b0"), ("l", "a0")))
    told = vox.select(F.col("i").alias("k"), b0, a0, F.col("j").alias("b"), F.col("l").alias("a"), F.col("mu").alias("v"))
    kept = told.filter((F.col("k") != 3) & ((F.col("k") * 31 + F.col("b0") * 7 + F.col("a0")) % 5 == 0))
    return kept.groupBy("k", "b0", "a0").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.sum(F.when((F.col("b") == F.col("b0")) & (F.col("a") == F.col("a0")), F.col("v")))).alias("corner"))


@query(_MATRIX + """, f AS (SELECT vec_id, sum(w * mu) AS p FROM mx JOIN vx USING (i, j, l) GROUP BY vec_id), m AS (SELECT label::INT AS k, p, abs(embedding[7]::DOUBLE) AS t FROM f JOIN embeddings USING (vec_id))
SELECT k, count(*) AS n, round(sum(p * t) / sum(p * p), 6) AS gain, round(regr_slope(t, p), 6) + 0.0 AS slope, round(regr_intercept(t, p), 6) + 0.0 AS intercept, round(avg((p - t) ** 2), 6) AS mse, round(10 * log10((max(t) - min(t)) ** 2 / avg((p - t) ** 2)), 6) AS psnr FROM m GROUP BY k""")
def volume_score(spark, sf_dir):
    """A volume projected along measured rays and held against what was measured there, view by view."""
    p = pro.forward(matrix(spark, sf_dir), phantom(spark, sf_dir)).withColumnRenamed("ray_id", "vec_id")
    data = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("k"), F.abs(F.element_at("embedding", 7).cast("double")).alias("t"))
    met = p.join(data, "vec_id")
    fits = met.groupBy("k").agg(F.count("*").alias("n"), F.round(metrics.gain(F.col("p"), F.col("t")), 6).alias("gain"), r6(F.regr_slope("t", "p")).alias("slope"), r6(F.regr_intercept("t", "p")).alias("intercept"))
    seen = metrics.projection_metrics(met, ["k"]).select("k", F.round("mse", 6).alias("mse"), F.round("psnr", 6).alias("psnr"))
    return fits.join(seen, "k")


@query("""WITH @STACK, @BOX, w AS (SELECT *, k % 2 AS half FROM x), m AS (SELECT b, a, avg(CASE WHEN half = 0 THEN v END) AS p, avg(CASE WHEN half = 1 THEN v END) AS q FROM w GROUP BY b, a),
g AS (SELECT b, a, coalesce((lead(p) OVER x1 - lag(p) OVER x1) / 2, lead(p) OVER x1 - p, p - lag(p) OVER x1) AS pa, coalesce((lead(p) OVER y1 - lag(p) OVER y1) / 2, lead(p) OVER y1 - p, p - lag(p) OVER y1) AS pb,
 coalesce((lead(q) OVER x1 - lag(q) OVER x1) / 2, lead(q) OVER x1 - q, q - lag(q) OVER x1) AS qa, coalesce((lead(q) OVER y1 - lag(q) OVER y1) / 2, lead(q) OVER y1 - q, q - lag(q) OVER y1) AS qb FROM m WINDOW x1 AS (PARTITION BY b ORDER BY a), y1 AS (PARTITION BY a ORDER BY b))
SELECT count(*) AS n, round(corr(sqrt(pa * pa + pb * pb), sqrt(qa * qa + qb * qb)), 6) + 0.0 AS ncc FROM g""")
def half_scan_consistency(spark, sf_dir):
    """How far the edges of the means of both halves of the views agree; a detector that is off lowers it."""
    vox, _ = box(spark, sf_dir)
    half = vox.groupBy("j", "l").agg(F.avg(F.when(F.col("i") % 2 == 0, F.col("mu"))).alias("p"), F.avg(F.when(F.col("i") % 2 == 1, F.col("mu"))).alias("q"))
    g = metrics.gradient(half, ["j", "l"], "p").withColumnsRenamed({"g_j": "p_j", "g_l": "p_l"})
    g = metrics.gradient(g, ["j", "l"], "q")
    size = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    return g.select(size("p_j", "p_l").alias("p"), size("g_j", "g_l").alias("q")).agg(F.count("*").alias("n"), r6(F.corr("p", "q")).alias("ncc"))


@query("""WITH @STACK, m AS (SELECT max(a) + 1 AS na, max(b) + 1 AS nb FROM s), t AS (SELECT k, s.b, s.a, s.v, a - (0.6 + 0.8 * (2 * a / (na - 1.0) - 1) + 0.5 * (2 * a / (na - 1.0) - 1) ** 2) AS ideal, na FROM s, m),
i AS (SELECT k, b, a AS src, ideal AS x0, lead(ideal) OVER w AS x1, v AS v0, lead(v) OVER w AS v1 FROM t WINDOW w AS (PARTITION BY k, b ORDER BY a)),
o AS (SELECT k, b, unnest(range(ceil(x0)::BIGINT, ceil(x1)::BIGINT))::INT AS a, x0, x1, v0, v1 FROM i WHERE x1 IS NOT NULL)
SELECT k, b, a, round(v0 + (v1 - v0) * (a - x0) / (x1 - x0), 6) + 0.0 AS v FROM o WHERE a >= 0 AND a < (SELECT na FROM m)""")
def ideal_rows(spark, sf_dir):
    """Detector rows moved from where pixels are to where they should be, linearly between neighbours."""
    pix = stack(spark, sf_dir)
    size = pix.agg((F.max("a") + 1).alias("na"))
    told = pix.crossJoin(F.broadcast(size))  # one row
    x = 2 * F.col("a") / (F.col("na") - 1.0) - 1
    return geo.regrid_rows(told.withColumn("at", F.col("a") - (0.6 + 0.8 * x + 0.5 * x * x)), ["k", "b"], "a", "at", "v").filter((F.col("a") >= 0) & (F.col("a") < F.col("na"))).select("k", "b", "a", r6(F.col("v")).alias("v"))


def _adam(n: int, before: str) -> str:
    """One step of ``adam_run`` in SQL: a quarter of the rays, mean squared residual and 0.001 times the total variation, rate 0.01."""
    first = f"(((vec_id % 2147483648) * 2654435761 + {n * 40503}) % 4294967296)"
    second = f"(xor({first}, {first} >> 16) * 1597334677 % 4294967296)"
    drawn = f"(xor({second}, {second} >> 15) >> 8) % 4 = 0"
    sign = lambda d, of: f"coalesce(sign({d}), 0) / {of}::DOUBLE"
    tv = " + ".join(f"{sign(f'mu - lag(mu) OVER w{x}', 448)} - {sign(f'lead(mu) OVER w{x} - mu', 448)}" for x in "ijl")
    return f"""a{n} AS (SELECT * FROM mx WHERE {drawn}), p{n} AS (SELECT vec_id, sum(w * mu) AS p FROM a{n} JOIN {before} USING (i, j, l) GROUP BY vec_id), r{n} AS (SELECT vec_id, 2 * (p - abs(embedding[7]::DOUBLE)) / count(*) OVER () AS e FROM p{n} JOIN embeddings USING (vec_id)),
b{n} AS (SELECT i, j, l, sum(w * e) AS g FROM a{n} JOIN r{n} USING (vec_id) GROUP BY i, j, l), t{n} AS (SELECT i, j, l, mu, m, s, {tv} AS tv FROM {before} WINDOW wi AS (PARTITION BY j, l ORDER BY i), wj AS (PARTITION BY i, l ORDER BY j), wl AS (PARTITION BY i, j ORDER BY l)),
g{n} AS (SELECT i, j, l, mu, 0.9 * m + 0.1 * g AS m, 0.999::DOUBLE * s + 0.001::DOUBLE * g * g AS s FROM (SELECT t.i, t.j, t.l, mu, m, s, coalesce(g, 0) + 0.001::DOUBLE * tv AS g FROM t{n} t LEFT JOIN b{n} USING (i, j, l))),
s{n} AS (SELECT i, j, l, greatest(mu - 0.01::DOUBLE * (m / (1 - 0.9::DOUBLE ** {n})) / (sqrt(s / (1 - 0.999::DOUBLE ** {n})) + 1e-8), 0) AS mu, m, s FROM g{n})"""


@query(f"{_MATRIX}, s0 AS (SELECT *, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s FROM vx), {_adam(1, 's0')}, {_adam(2, 's1')} SELECT i, j, l, round(mu, 6) + 0.0 AS mu FROM s2")
def adam_run(spark, sf_dir):
    """Two steps of the stochastic solver from the phantom, a quarter of the rays each."""
    met = geo.ray_box(rays(spark, sf_dir).withColumnRenamed("vec_id", "ray_id"), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))
    data = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ray_id"), F.abs(F.element_at("embedding", 7).cast("double")).alias("p"))
    found = stochastic.adam_run(met, data, phantom(spark, sf_dir), (8, 8, 8), 0.25, 2, 4, 8, variation=0.001, rate=0.01)
    return found.select("i", "j", "l", r6(F.col("mu")).alias("mu"))
