"""Queries of geometry, projection and solvers; scans, rays and grids are made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinoplan.functions.columns import PI, parker_weight, r6
from sinoplan.operators import geometry as geo
from sinoplan.operators import project as pro
from sinoplan.operators import solve
from sinoplan.operators.lineage import checkpointed
from sinoplan.plans.registry import query
from sinoplan.plans.scans import GRID, turn
from sinoplan.plans.tables import read, stack

_SCANS = """g AS (SELECT s_suppkey, 100.0::DOUBLE + s_suppkey % 50 AS r_s, 300.0::DOUBLE + s_suppkey % 70 AS sdd, 0.1 + 0.001::DOUBLE * (s_suppkey % 10) AS pitch, (200 + s_suppkey % 30)::INT AS n_a, (100 + s_suppkey % 20)::INT AS n_b,
(199 + s_suppkey % 30) / 2.0::DOUBLE + (s_suppkey % 3) AS cpa, (99 + s_suppkey % 20) / 2.0::DOUBLE AS cpb FROM supplier),
f AS (SELECT *, 2 * (least(cpa, n_a - 1 - cpa) + 0.5) * pitch * r_s / sdd AS fov_xy, 2 * (least(cpb, n_b - 1 - cpb) + 0.5) * pitch * r_s / sdd AS fov_z FROM g)"""


def scans(spark, sf_dir):
    """A scan for each supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k, (100.0 + k % 50).alias("r_s"), (300.0 + k % 70).alias("sdd"), (0.1 + 0.001 * (k % 10)).alias("pitch"), (200 + k % 30).cast("int").alias("n_a"), (100 + k % 20).cast("int").alias("n_b"), ((199 + k % 30) / 2 + k % 3).alias("cpa"), ((99 + k % 20) / 2).alias("cpb"))


@query(f"WITH {_SCANS} SELECT s_suppkey, round(fov_xy, 6) AS fov_xy, round(fov_z, 6) AS fov_z, round(sdd / r_s, 6) AS magnification, round_even(fov_xy / 0.07, 0)::INT AS nx, round_even(fov_z / 0.09, 0)::INT AS nz, round((cpa - 1) / 3, 6) AS cpa_pooled FROM f")
def geometry_fov(spark, sf_dir):
    g = geo.volume_grid(geo.field_of_view(scans(spark, sf_dir)), 0.07, 0.09)
    return g.select("s_suppkey", F.round("fov_xy", 6).alias("fov_xy"), F.round("fov_z", 6).alias("fov_z"), F.round("magnification", 6).alias("magnification"), "nx", "nz", F.round(geo.pooled_index(F.col("cpa"), 3), 6).alias("cpa_pooled"))


@query(f"""WITH {_SCANS}, c AS (SELECT *, (fov_z * 0.5) / 2 AS hz, round_even(fov_xy * 0.6 / 0.07, 0) * 0.07::DOUBLE / 2 AS r FROM (SELECT *, round_even(fov_z * 0.5 / 0.09, 0) AS nz FROM f)),
w AS (SELECT *, nz * 0.09::DOUBLE / 2 AS h2, (r_s + r) / sdd AS reach, r + sqrt(0.25::DOUBLE + 0.09::DOUBLE) AS wide FROM c),
x AS (SELECT *, greatest(0, ceil(cpb + (0.2 - h2) / reach / pitch)) AS b0, least(n_b, floor(cpb + (0.2 + h2) / reach / pitch) + 1) AS b1, greatest(0, ceil(cpa - sdd * wide / sqrt(r_s * r_s - wide * wide) / pitch)) AS a0, least(n_a, floor(cpa + sdd * wide / sqrt(r_s * r_s - wide * wide) / pitch) + 1) AS a1 FROM w)
SELECT s_suppkey, (CASE WHEN b1 - b0 < 16 THEN 0 ELSE b0 END)::INT AS b0, (CASE WHEN b1 - b0 < 16 THEN n_b ELSE b1 END)::INT AS b1, (CASE WHEN a1 - a0 < 16 THEN 0 ELSE a0 END)::INT AS a0, (CASE WHEN a1 - a0 < 16 THEN n_a ELSE a1 END)::INT AS a1 FROM x""")
def covered_window(spark, sf_dir):
    g = geo.field_of_view(scans(spark, sf_dir)).withColumns({"fov_xy": F.col("fov_xy") * 0.6, "fov_z": F.col("fov_z") * 0.5})
    g = geo.volume_grid(g, 0.07, 0.09).withColumns({"ox": F.lit(0.5), "oy": F.lit(0.3), "oz": F.lit(0.2)})
    return geo.covered_window(g).select("s_suppkey", "b0", "b1", "a0", "a1")


@query("""WITH g AS (SELECT p_partkey, 20 + p_size AS n, 0.1 + p_partkey % 7 * 0.01::DOUBLE AS d, p_partkey % 5 - 2.0::DOUBLE AS o FROM part), e AS (SELECT *, o - n * d / 2 AS edge, -1.0::DOUBLE AS lo, p_partkey % 11 * 0.3::DOUBLE AS hi FROM g),
i AS (SELECT *, greatest(0, least(n, floor((lo - edge) / d))) AS i0 FROM e) SELECT p_partkey, i0::INT AS i0, greatest(i0 + 1, least(n, ceil((hi - edge) / d)))::INT AS i1 FROM i""")
def roi_indices(spark, sf_dir):
    k = F.col("p_partkey")
    g = read(spark, sf_dir, "part").select(k, (20 + F.col("p_size")).alias("n"), (0.1 + k % 7 * 0.01).alias("d"), (k % 5 - 2.0).alias("o"))
    i0, i1 = geo.roi_span(F.lit(-1.0), k % 11 * 0.3, F.col("n"), F.col("o"), F.col("d"))
    return g.select("p_partkey", i0.alias("i0"), i1.alias("i1"))


@query("WITH @STACK SELECT k::INT AS i, (b - 2)::INT AS j, (a - 8)::INT AS l, round(v, 6) + 0.0 AS mu FROM s WHERE b >= 2 AND b < 20 AND a >= 8 AND a < 40")
def roi_crop(spark, sf_dir):
    vox = stack(spark, sf_dir).select(F.col("k").alias("i"), F.col("b").alias("j"), F.col("a").alias("l"), r6(F.col("v")).alias("mu"))
    return geo.crop(vox, {"j": (2, 20), "l": (8, 40)})


_ANGLES = "v AS (SELECT user_id, event_id, radians(((event_id * 7 + user_id) % 360)::DOUBLE) AS theta FROM events)"


def views(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "event_id", F.radians(((F.col("event_id") * 7 + F.col("user_id")) % 360).cast("double")).alias("theta"))


@query(f"""WITH {_ANGLES}, d AS (SELECT user_id, theta - lag(theta) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM v),
u AS (SELECT user_id, d - 2 * pi() * floor((d + pi()) / (2 * pi())) AS s FROM d WHERE d IS NOT NULL)
SELECT user_id, round(degrees(abs(sum(s))) + degrees(median(abs(s))), 6) AS coverage, degrees(abs(sum(s))) + degrees(median(abs(s))) >= 350 AS full_scan FROM u GROUP BY user_id""")
def angle_coverage(spark, sf_dir):
    return geo.coverage(views(spark, sf_dir), "user_id", "event_id", "theta").withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {_ANGLES}, g AS (SELECT event_id, theta / (2 * pi()) * 3.6 AS beta, (event_id % 21 - 10) * 0.01::DOUBLE AS gamma FROM v), o AS (SELECT *, 3.6 - pi() - 2 * gamma AS o FROM g)
SELECT event_id, round(CASE WHEN o > 0 AND beta < o THEN sin(pi() / 2 * beta / o) ** 2 WHEN o > 0 AND beta > pi() + 2 * gamma THEN sin(pi() / 2 * (3.6 - beta) / o) ** 2 ELSE 1 END, 6) + 0.0 AS weight FROM o""")
def parker_weights(spark, sf_dir):
    v = views(spark, sf_dir)
    return v.select("event_id", r6(parker_weight(F.col("theta") / (2 * PI) * 3.6, (F.col("event_id") % 21 - 10) * 0.01, F.lit(3.6))).alias("weight"))


@query(f"""WITH {_ANGLES} SELECT event_id, round(-120 * cos(theta), 6) + 0.0 AS sx, round(-120 * sin(theta), 6) + 0.0 AS sy, round(200 * cos(theta), 6) + 0.0 AS dx, round(200 * sin(theta), 6) + 0.0 AS dy,
round(-cos(0.01) * 0.1 * sin(theta), 6) + 0.0 AS ux, round(cos(0.01) * 0.1 * cos(theta), 6) + 0.0 AS uy, round(sin(0.01) * 0.2 * sin(theta), 6) + 0.0 AS vx, round(-sin(0.01) * 0.2 * cos(theta), 6) + 0.0 AS vy, round(theta + pi(), 6) AS turned FROM v""")
def view_vectors(spark, sf_dir):
    found = geo.view_vectors(views(spark, sf_dir), "theta", 120.0, 200.0, 0.1, 0.2, 0.01)
    return found.select("event_id", *(r6(F.col(c)).alias(c) for c in ("sx", "sy", "dx", "dy", "ux", "uy", "vx", "vy")), F.round(F.col("theta") + PI, 6).alias("turned"))


_RAYS = "q AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS ox, embedding[2]::DOUBLE * 10 AS oy, embedding[3]::DOUBLE * 10 AS oz, embedding[4]::DOUBLE AS x, embedding[5]::DOUBLE AS y, embedding[6]::DOUBLE AS z FROM embeddings), " \
    "r AS (SELECT vec_id, ox, oy, oz, x / sqrt(x * x + y * y + z * z) AS dx, y / sqrt(x * x + y * y + z * z) AS dy, z / sqrt(x * x + y * y + z * z) AS dz FROM q)"


def rays(spark, sf_dir):
    """A ray for each vector: three components place it, three turn it."""
    e = lambda n: F.element_at("embedding", n).cast("double")
    n = F.sqrt(e(4) * e(4) + e(5) * e(5) + e(6) * e(6))
    return read(spark, sf_dir, "embeddings").select("vec_id", (e(1) * 10).alias("ox"), (e(2) * 10).alias("oy"), (e(3) * 10).alias("oz"), (e(4) / n).alias("dx"), (e(5) / n).alias("dy"), (e(6) / n).alias("dz"))


_BOX = "b AS (SELECT *, greatest(least((-1 - ox) / dx, (1 - ox) / dx), least((-1 - oy) / dy, (1 - oy) / dy), least((-1 - oz) / dz, (1 - oz) / dz)) AS lo, least(greatest((-1 - ox) / dx, (1 - ox) / dx), greatest((-1 - oy) / dy, (1 - oy) / dy), greatest((-1 - oz) / dz, (1 - oz) / dz)) AS hi FROM r)"


@query(f"WITH {_RAYS}, {_BOX} SELECT vec_id, round(greatest(lo, 0), 6) + 0.0 AS t_near, round(hi, 6) + 0.0 AS t_far, hi > lo AND hi > 0 AS hit FROM b")
def ray_box(spark, sf_dir):
    return geo.ray_box(rays(spark, sf_dir), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0)).select("vec_id", r6(F.col("t_near")).alias("t_near"), r6(F.col("t_far")).alias("t_far"), "hit")


@query(f"""WITH {_RAYS}, c AS (SELECT *, dx * dx + dy * dy AS a, 2 * (ox * dx + oy * dy) AS b, ox * ox + oy * oy - 1 AS c FROM r), t AS (SELECT *, sqrt(greatest(b * b - 4 * a * c, 0)) AS q FROM c),
h AS (SELECT vec_id, greatest((-b - q) / (2 * a), least((-1 - oz) / dz, (1 - oz) / dz)) AS lo, least((-b + q) / (2 * a), greatest((-1 - oz) / dz, (1 - oz) / dz)) AS hi FROM t)
SELECT vec_id, round(greatest(lo, 0), 6) + 0.0 AS t_near, round(hi, 6) + 0.0 AS t_far, hi > lo AND hi > 0 AS hit, round(CASE WHEN hi > lo AND hi > 0 THEN hi - greatest(lo, 0) ELSE 0 END, 6) + 0.0 AS chord FROM h""")
def ray_cylinder(spark, sf_dir):
    found = geo.ray_cylinder(rays(spark, sf_dir), 1.0, -1.0, 1.0)
    return found.select("vec_id", r6(F.col("t_near")).alias("t_near"), r6(F.col("t_far")).alias("t_far"), "hit", r6(F.when(F.col("hit"), F.col("t_far") - F.col("t_near")).otherwise(0.0)).alias("chord"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS x, l_tax * 25 - 1 AS y FROM lineitem), a AS (SELECT *, x - (0.01 + 0.02 * x - 0.01 * y + 0.03 * x * x + 0.01 * x * y - 0.02 * y * y) AS px, y - (-0.02 + 0.01 * x + 0.01 * y - 0.02 * x * x + 0.03 * x * y + 0.01 * y * y) AS py FROM p),
b AS (SELECT l_orderkey, l_linenumber, x - (0.01 + 0.02 * px - 0.01 * py + 0.03 * px * px + 0.01 * px * py - 0.02 * py * py) AS u, y - (-0.02 + 0.01 * px + 0.01 * py - 0.02 * px * px + 0.03 * px * py + 0.01 * py * py) AS v FROM a)
SELECT l_orderkey, round(avg(u), 6) + 0.0 AS u, round(avg(v), 6) + 0.0 AS v, count(*) AS n FROM b GROUP BY l_orderkey""")
def detector_warp(spark, sf_dir):
    x, y = F.col("l_discount") * 20 - 1, F.col("l_tax") * 25 - 1
    u, v = geo.ideal_index(x, y, [0.01, 0.02, -0.01, 0.03, 0.01, -0.02], [-0.02, 0.01, 0.01, -0.02, 0.03, 0.01], 2)
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(r6(F.avg(u)).alias("u"), r6(F.avg(v)).alias("v"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT p_partkey, 10 + p_size * 4 AS n_z, 0.05 + p_partkey % 9 * 0.02::DOUBLE AS dz, p_partkey % 7 - 3.0::DOUBLE AS oz FROM part),
m AS (SELECT *, oz - (n_z - 1) / 2 * dz AS lo, (n_z - 1) * dz AS x FROM g), t AS (SELECT *, greatest(1, pow(2, ceil(log2(greatest(x / 0.5 / 11, 1))))) AS m FROM m),
p AS (SELECT *, unnest(range(ceil(lo / (0.5 * m) - 1e-9)::BIGINT, floor((lo + x) / (0.5 * m) + 1e-9)::BIGINT + 1)) AS i FROM t)
SELECT p_partkey, (i * m)::BIGINT AS step, least(greatest(round_even((i * 0.5 * m - lo) / dz, 0), 0), n_z - 1)::INT AS slice, round(i * 0.5 * m, 6) + 0.0 AS z FROM p""")
def slice_plan(spark, sf_dir):
    k = F.col("p_partkey")
    volumes = read(spark, sf_dir, "part").select(k, (10 + F.col("p_size") * 4).alias("n_z"), (0.05 + k % 9 * 0.02).alias("dz"), (k % 7 - 3.0).alias("oz"))
    return geo.slice_plan(volumes, 0.5, 12).select("p_partkey", "step", "slice", r6(F.col("z")).alias("z"))


_MATRIX = f"""WITH @STACK, {_RAYS}, {_BOX}, h AS (SELECT vec_id, ox, oy, oz, dx, dy, dz, greatest(lo, 0) AS t0, hi AS t1 FROM b WHERE hi > lo AND hi > 0),
pt AS (SELECT vec_id, (t1 - t0) / 8 AS dt, (ox + (t0 + (i + 0.5) * (t1 - t0) / 8) * dx) / 0.25 + 3.5 AS x, (oy + (t0 + (i + 0.5) * (t1 - t0) / 8) * dy) / 0.25 + 3.5 AS y, (oz + (t0 + (i + 0.5) * (t1 - t0) / 8) * dz) / 0.25 + 3.5 AS z FROM h, range(8) u(i)),
co AS (SELECT vec_id, dt, (floor(x) + p)::INT AS i, (floor(y) + q)::INT AS j, (floor(z) + o)::INT AS l, abs(1 - p - (x - floor(x))) * abs(1 - q - (y - floor(y))) * abs(1 - o - (z - floor(z))) AS w FROM pt, range(2) a1(p), range(2) a2(q), range(2) a3(o)),
mx AS (SELECT vec_id, i, j, l, sum(w * dt) AS w FROM co WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 AND l BETWEEN 0 AND 7 GROUP BY ALL), vx AS (SELECT k % 8 AS i, b % 8 AS j, a // 8 AS l, avg(abs(v)) AS mu FROM s GROUP BY ALL)"""


def matrix(spark, sf_dir):
    """Rays of the vectors through an 8 by 8 by 8 grid of the box, eight samples each."""
    met = geo.ray_box(rays(spark, sf_dir).withColumnRenamed("vec_id", "ray_id"), (-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))
    return pro.system_matrix(met, 8, (8, 8, 8), 0.25)


def phantom(spark, sf_dir):
    """The whole stack folded into a volume of non-negative means."""
    s = stack(spark, sf_dir)
    return s.groupBy((F.col("k") % 8).alias("i"), (F.col("b") % 8).alias("j"), F.floor(F.col("a") / 8).cast("int").alias("l")).agg(F.avg(F.abs("v")).alias("mu"))


@query(_MATRIX + " SELECT vec_id, round(sum(w * mu), 6) + 0.0 AS p, round(sum(w), 6) + 0.0 AS chord FROM mx JOIN vx USING (i, j, l) GROUP BY vec_id")
def forward_project(spark, sf_dir):
    """Line integrals of the phantom, and of ones."""
    m, v = matrix(spark, sf_dir), phantom(spark, sf_dir)
    met = m.join(v, ["i", "j", "l"]).groupBy("ray_id").agg(r6(F.sum(F.col("w") * F.col("mu"))).alias("p"), r6(F.sum("w")).alias("chord"))
    return met.withColumnRenamed("ray_id", "vec_id")


@query(_MATRIX + ", c AS (SELECT i, j, l, sum(w) AS c FROM mx GROUP BY ALL), d AS (SELECT median(c) AS m FROM c) SELECT i, j, l, round(c, 6) AS coverage, round(least(greatest(m / c, 0.25), 4), 6) AS scale FROM c, d")
def coverage_grid(spark, sf_dir):
    """Path of all rays in each voxel, and the preconditioner it gives, within a factor of four of the median."""
    c = matrix(spark, sf_dir).groupBy("i", "j", "l").agg(F.sum("w").alias("c"))
    middle = c.agg(F.percentile("c", 0.5).alias("m"))
    return c.crossJoin(F.broadcast(middle)).select("i", "j", "l", F.round("c", 6).alias("coverage"), F.round(F.least(F.greatest(F.col("m") / F.col("c"), F.lit(0.25)), F.lit(4.0)), 6).alias("scale"))


_STEP = _MATRIX + ", z AS (SELECT i, j, l, 0.05::DOUBLE AS mu FROM vx), dat AS (SELECT vec_id, sum(w * mu) AS p FROM mx JOIN vx USING (i, j, l) GROUP BY 1), ax AS (SELECT vec_id, sum(w * mu) AS ax, sum(w) AS len FROM mx JOIN z USING (i, j, l) GROUP BY 1), rw AS (SELECT vec_id, sum(w) AS len FROM mx GROUP BY 1), cw AS (SELECT i, j, l, sum(w) AS c FROM mx GROUP BY ALL)"


def _start(spark, sf_dir):
    # The matrix is read several times in a step; it is made once.
    m, v = checkpointed(matrix(spark, sf_dir)), phantom(spark, sf_dir)
    return m, v.select("i", "j", "l", F.lit(0.05).alias("mu")), pro.forward(m, v)


@query(_STEP + ", st AS (SELECT i, j, l, sum(w * (p - ax) / rw.len) AS s FROM mx JOIN dat USING (vec_id) JOIN ax USING (vec_id) JOIN rw USING (vec_id) GROUP BY ALL) SELECT z.i, z.j, z.l, round(greatest(z.mu + coalesce(s / c, 0), 0), 6) + 0.0 AS mu FROM z LEFT JOIN st USING (i, j, l) LEFT JOIN cw USING (i, j, l)")
def sirt_step(spark, sf_dir):
    m, x, data = _start(spark, sf_dir)
    return solve.sirt_step(m, x, data).withColumn("mu", r6(F.col("mu")))


@query(_STEP + ", st AS (SELECT i, j, l, sum(w * (p - ax)) AS s FROM mx JOIN dat USING (vec_id) JOIN ax USING (vec_id) GROUP BY ALL) SELECT z.i, z.j, z.l, round(z.mu + 0.1 * coalesce(s, 0), 6) + 0.0 AS mu FROM z LEFT JOIN st USING (i, j, l)")
def landweber_step(spark, sf_dir):
    m, x, data = _start(spark, sf_dir)
    return solve.landweber_step(m, x, data, 0.1).withColumn("mu", r6(F.col("mu")))


@query(_STEP + ", st AS (SELECT i, j, l, sum(w * greatest(p, 0) / ax) AS s FROM mx JOIN dat USING (vec_id) JOIN ax USING (vec_id) GROUP BY ALL) SELECT z.i, z.j, z.l, round(z.mu * coalesce(s / c, 1), 6) + 0.0 AS mu FROM z LEFT JOIN st USING (i, j, l) LEFT JOIN cw USING (i, j, l)")
def mlem_step(spark, sf_dir):
    m, x, data = _start(spark, sf_dir)
    return solve.mlem_step(m, x, data).withColumn("mu", r6(F.col("mu")))


@query(_STEP + ", gr AS (SELECT i, j, l, -sum(w * (p - ax)) AS g FROM mx JOIN dat USING (vec_id) JOIN ax USING (vec_id) GROUP BY ALL) SELECT z.i, z.j, z.l, round(greatest(z.mu - 0.01 * coalesce(g, 0) / (abs(coalesce(g, 0)) + 1e-8), 0), 6) + 0.0 AS mu FROM z LEFT JOIN gr USING (i, j, l)")
def adam_step(spark, sf_dir):
    """The first step of Adam from a constant volume: bias correction makes it a step of the rate's size."""
    m, x, data = _start(spark, sf_dir)
    residual = data.join(pro.forward(m, x).withColumnRenamed("p", "ax"), "ray_id").select("ray_id", (F.col("ax") - F.col("p")).alias("e"))
    gradient = pro.backward(m, residual, "e").withColumnRenamed("v", "g")
    state = x.withColumns({"m": F.lit(0.0), "s": F.lit(0.0)})
    return solve.adam_step(state, gradient, 1, rate=0.01).select("i", "j", "l", r6(F.col("mu")).alias("mu"))


@query()
def sirt_run(spark, sf_dir):
    m, x, data = _start(spark, sf_dir)
    return solve.iterate(m, x, data, steps=3, method="sirt").withColumn("mu", r6(F.col("mu")))


@query()
def ordered_subsets_run(spark, sf_dir):
    m, x, data = _start(spark, sf_dir)
    return solve.iterate(m, x, data, steps=2, method="sirt", shrink=0.9, blocks=2).withColumn("mu", r6(F.col("mu")))


@query()
def cgls_run(spark, sf_dir):
    m, x, data = _start(spark, sf_dir)
    return solve.cgls(m, data, x, 3).withColumn("mu", r6(F.col("mu")))


@query(f"""WITH @STACK, {GRID},
u AS (SELECT x.*, k, 50 + x * cos(th) + y * sin(th) + 1e-8 AS u, th FROM x, t), q AS (SELECT i, j, l, k, (50 / u) ** 2 AS sc, 80 / u * z / 0.2 + (nb - 1) / 2.0 AS b, 80 / u * (y * cos(th) - x * sin(th)) / 0.2 + (na - 1) / 2.0 AS a FROM u, n),
c AS (SELECT i, j, l, k, sc, (floor(b) + p)::INT AS b, (floor(a) + o)::INT AS a, abs(1 - p - (b - floor(b))) * abs(1 - o - (a - floor(a))) AS w FROM q, range(2) r1(p), range(2) r2(o))
SELECT c.i, c.j, c.l, round(sum(w * sc * coalesce(v, 0)), 6) + 0.0 AS bp FROM c LEFT JOIN s USING (k, b, a) GROUP BY c.i, c.j, c.l""")
def backproject(spark, sf_dir):
    """The stack as views of a full turn, backprojected to a grid that covers the detector."""
    rows, views, vox, scan = turn(spark, sf_dir)
    return pro.backproject(vox, rows, views, scan.r_s, scan.sdd, scan.pitch, scan.cpa, scan.cpb).withColumn("bp", r6(F.col("bp")))


@query("""WITH @STACK, n AS (SELECT max(b) AS nb, max(a) AS na FROM s), q AS (SELECT k, b, a, least(greatest(b + 0.3, 0), nb) AS pb, least(greatest(a - 0.6, 0), na) AS pa FROM s, n),
c AS (SELECT k, b, a, (floor(pb) + p)::INT AS b2, (floor(pa) + o)::INT AS a2, abs(1 - p - (pb - floor(pb))) * abs(1 - o - (pa - floor(pa))) AS w FROM q, range(2) r1(p), range(2) r2(o))
SELECT c.k AS i, c.b AS j, c.a AS l, round(sum(w * coalesce(v, 0)), 6) + 0.0 AS mu FROM c LEFT JOIN s ON s.k = c.k AND s.b = c.b2 AND s.a = c.a2 GROUP BY c.k, c.b, c.a""")
def volume_shift(spark, sf_dir):
    """A linear shift by parts of a voxel, the edge repeated."""
    vox = stack(spark, sf_dir).select(F.col("k").alias("i"), F.col("b").alias("j"), F.col("a").alias("l"), F.col("v").alias("mu"))
    return pro.shift(vox, {"i": 0.0, "j": 0.3, "l": -0.6}).withColumn("mu", r6(F.col("mu")))


@query("""WITH @STACK, n AS (SELECT count(DISTINCT k) AS nk, max(a) + 1 AS na FROM s), c AS (SELECT (na - 1) / 2.0 + (i - 2) / 2.0 AS cpa, nk FROM n, range(4) r(i)), p AS (SELECT cpa, k, b, a, v, ((k + nk // 2) % nk) AS k2, (2 * cpa - a)::INT AS a2 FROM s, c)
SELECT p.cpa, round(var_samp(p.v - s.v), 6) AS cost, count(*) AS n FROM p JOIN s ON s.k = p.k2 AND s.b = p.b AND s.a = p.a2 WHERE abs(p.v) > 0.02 AND abs(s.v) > 0.02 GROUP BY p.cpa""")
def conjugate_cost(spark, sf_dir):
    """Variance of what opposite views disagree by, for candidate centres of rotation; the least is the estimate."""
    pix = stack(spark, sf_dir)
    size = pix.agg(F.countDistinct("k").alias("nk"), (F.max("a") + 1).alias("na"))
    centres = size.select("nk", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("na") - 1) / 2.0 + (i - 2) / 2.0)).alias("cpa"))
    # Four rows.
    asked = pix.crossJoin(F.broadcast(centres)).select("cpa", "b", F.col("v").alias("v1"), ((F.col("k") + F.floor(F.col("nk") / 2)) % F.col("nk")).cast("int").alias("k"), (2 * F.col("cpa") - F.col("a")).cast("int").alias("a"))
    met = asked.join(pix, ["k", "b", "a"]).filter((F.abs("v1") > 0.02) & (F.abs("v") > 0.02))
    return met.groupBy("cpa").agg(F.round(F.var_samp(F.col("v1") - F.col("v")), 6).alias("cost"), F.count("*").alias("n"))
