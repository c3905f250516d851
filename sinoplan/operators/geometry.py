"""Scanner geometry: one row a scan, all of it projections of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.functions.columns import PI


def field_of_view(g: DataFrame) -> DataFrame:
    """What the detector sees at the axis, to the outer edge of the nearer side (columns r_s, sdd, pitch, n_a, n_b, cpa, cpb)."""
    side = lambda c, n: 2 * (F.least(F.col(c), F.col(n) - 1 - F.col(c)) + 0.5) * F.col("pitch") * F.col("r_s") / F.col("sdd")
    return g.withColumns({"fov_xy": side("cpa", "n_a"), "fov_z": side("cpb", "n_b"), "magnification": F.col("sdd") / F.col("r_s")})


def volume_grid(g: DataFrame, voxel_xy: float, voxel_z: float) -> DataFrame:
    """Voxels along each axis, ties to even."""
    return g.withColumns({"nx": F.rint(F.col("fov_xy") / voxel_xy).cast("int"), "nz": F.rint(F.col("fov_z") / voxel_z).cast("int"), "dx": F.lit(voxel_xy), "dz": F.lit(voxel_z)})


def pooled_index(i: Column, f: int) -> Column:
    """A detector index in units of pixels pooled f by f."""
    return (i - (f - 1) / 2.0) / f


def covered_window(g: DataFrame, least: int = 16) -> DataFrame:
    """Rows [b0, b1) and columns [a0, a1) whose rays a forward projection of the grid can predict.

    An axis that comes out narrower than ``least`` counts in full. Needs ox, oy, oz besides a grid.
    """
    hz, r = F.col("nz") * F.col("dz") / 2, F.col("nx") * F.col("dx") / 2
    reach = (F.col("r_s") + r) / F.col("sdd")
    b_lo, b_hi = F.col("cpb") + (F.col("oz") - hz) / reach / F.col("pitch"), F.col("cpb") + (F.col("oz") + hz) / reach / F.col("pitch")
    wide = r + F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy"))
    a_off = F.col("sdd") * wide / F.sqrt(F.greatest(F.col("r_s") * F.col("r_s") - wide * wide, F.lit(1e-12))) / F.col("pitch")
    all_in = wide >= F.col("r_s")
    rows = F.greatest(F.lit(0), F.ceil(F.least(b_lo, b_hi))), F.least(F.col("n_b"), F.floor(F.greatest(b_lo, b_hi)) + 1)
    columns = F.when(all_in, 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col("cpa") - a_off))), F.when(all_in, F.col("n_a")).otherwise(F.least(F.col("n_a"), F.floor(F.col("cpa") + a_off) + 1))
    out = {}
    for name, n, (lo, hi) in (("b", "n_b", rows), ("a", "n_a", columns)):
        narrow = hi - lo < least
        out |= {f"{name}0": F.when(narrow, 0).otherwise(lo).cast("int"), f"{name}1": F.when(narrow, F.col(n)).otherwise(hi).cast("int")}
    return g.withColumns(out)


def roi_span(low: Column, high: Column, n: Column, origin: Column, d: Column) -> tuple[Column, Column]:
    """Indices [i0, i1) of the voxels that a range of mm covers, within the grid, one at least."""
    edge = origin - n * d / 2
    i0 = F.greatest(F.lit(0), F.least(n, F.floor((low - edge) / d)))
    return i0.cast("int"), F.greatest(i0 + 1, F.least(n, F.ceil((high - edge) / d))).cast("int")


def crop(vox: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """The sub-grid with its indices from 0; the ranges reach the scan as filters."""
    for axis, (lo, hi) in bounds.items():
        vox = vox.filter((F.col(axis) >= lo) & (F.col(axis) < hi))
    return vox.withColumns({axis: (F.col(axis) - lo).cast("int") for axis, (lo, _) in bounds.items()})


def coverage(angles: DataFrame, group: str, order: str, theta: str) -> DataFrame:
    """Degrees that the views of each scan cover: the unwrapped steps together plus the median step."""
    w = Window.partitionBy(group).orderBy(order)
    step = F.col(theta) - F.lag(theta).over(w)
    told = angles.withColumn("step", step - 2 * PI * F.floor((step + PI) / (2 * PI))).filter(F.col("step").isNotNull())
    found = told.groupBy(group).agg((F.degrees(F.abs(F.sum("step"))) + F.degrees(F.percentile(F.abs("step"), 0.5))).alias("coverage"))
    return found.withColumn("full_scan", F.col("coverage") >= 350.0)


def view_vectors(views: DataFrame, theta: str, r_s: float, r_d: float, da: float, db: float, psi: float = 0.0) -> DataFrame:
    """Source, detector centre and the two pixel vectors of each view; psi turns the detector in its plane."""
    s, c = F.sin(theta), F.cos(theta)
    cp, sp = math.cos(psi), math.sin(psi)
    zero = F.lit(0.0)
    return views.withColumns({"sx": -r_s * c, "sy": -r_s * s, "sz": zero, "dx": r_d * c, "dy": r_d * s, "dz": zero, "ux": -cp * da * s, "uy": cp * da * c, "uz": F.lit(sp * da), "vx": sp * db * s, "vy": -sp * db * c, "vz": F.lit(cp * db)})


def pixel_rays(pixels: DataFrame, theta: str, r_s: float, r_d: float, da: float, db: float, cpa: float, cpb: float) -> DataFrame:
    """Origin and unit direction of the ray of each pixel (b, a) of a view."""
    s, c = F.sin(theta), F.cos(theta)
    u, v = (F.col("a") - cpa) * da, (F.col("b") - cpb) * db
    x, y, z = (r_s + r_d) * c - u * s, (r_s + r_d) * s + u * c, v
    n = F.sqrt(x * x + y * y + z * z)
    return pixels.withColumns({"ox": -r_s * c, "oy": -r_s * s, "oz": F.lit(0.0), "dx": x / n, "dy": y / n, "dz": z / n})


def ray_box(rays: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    """Where rays enter and leave a box: t_near (not behind the origin), t_far, hit."""
    enter, leave = [], []
    for axis, lo, hi in zip("xyz", low, high, strict=True):
        d = F.when(F.abs(F.col(f"d{axis}")) < 1e-12, F.lit(1e-12)).otherwise(F.col(f"d{axis}"))
        t1, t2 = (F.lit(lo) - F.col(f"o{axis}")) / d, (F.lit(hi) - F.col(f"o{axis}")) / d
        enter.append(F.least(t1, t2))
        leave.append(F.greatest(t1, t2))
    lo, hi = F.greatest(*enter), F.least(*leave)
    return rays.withColumns({"t_near": F.greatest(lo, F.lit(0.0)), "t_far": hi, "hit": (hi > lo) & (hi > 0)})


def ray_cylinder(rays: DataFrame, radius: float, z0: float, z1: float, cx: float = 0.0, cy: float = 0.0) -> DataFrame:
    """The same for an upright cylinder; a ray along its axis is inside all the way or not at all."""
    ox, oy, dx, dy = F.col("ox") - cx, F.col("oy") - cy, F.col("dx"), F.col("dy")
    a, b, c = dx * dx + dy * dy, 2 * (ox * dx + oy * dy), ox * ox + oy * oy - radius * radius
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    safe, along, huge = F.greatest(a, F.lit(1e-12)), a <= 1e-12, F.lit(1e300)
    lo = F.when(along, F.when(c < 0, -huge).otherwise(huge)).otherwise((-b - root) / (2 * safe))
    hi = F.when(along, F.when(c < 0, huge).otherwise(-huge)).otherwise((-b + root) / (2 * safe))
    dz = F.when(F.abs("dz") < 1e-12, F.lit(1e-12)).otherwise(F.col("dz"))
    z_1, z_2 = (F.lit(z0) - F.col("oz")) / dz, (F.lit(z1) - F.col("oz")) / dz
    t0, t1 = F.greatest(lo, F.least(z_1, z_2)), F.least(hi, F.greatest(z_1, z_2))
    return rays.withColumns({"t_near": F.greatest(t0, F.lit(0.0)), "t_far": t1, "hit": (t1 > t0) & (t1 > 0)})


def warp_terms(degree: int) -> list[tuple[int, int]]:
    return [(i, d - i) for d in range(degree + 1) for i in range(d, -1, -1)]


def displacement(x: Column, y: Column, coefficients: list[float], degree: int) -> Column:
    """A polynomial of two coordinates in [-1, 1]."""
    return sum((F.lit(c) * F.pow(x, F.lit(i)) * F.pow(y, F.lit(j)) for c, (i, j) in zip(coefficients, warp_terms(degree), strict=True)), F.lit(0.0))


def ideal_index(x: Column, y: Column, cx: list[float], cy: list[float], degree: int, steps: int = 2) -> tuple[Column, Column]:
    """Undo a distortion by fixed-point steps p = q - d(p)."""
    px, py = x, y
    for _ in range(steps):
        px, py = x - displacement(px, py, cx, degree), y - displacement(px, py, cy, degree)
    return px, py


def slice_plan(volumes: DataFrame, pitch: float, most: int = 240) -> DataFrame:
    """Planes of a shared grid of heights for each volume (n_z, dz, oz): step, slice, z.

    Where they are too many the pitch doubles, so that coarser plans are subsets of finer ones.
    """
    low, extent = F.col("oz") - (F.col("n_z") - 1) / 2 * F.col("dz"), (F.col("n_z") - 1) * F.col("dz")
    told = volumes.withColumns({"__lo": low, "__x": extent}).withColumn("__m", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(extent / pitch / (most - 1), F.lit(1.0)))))))
    told = told.withColumn("__s", pitch * F.col("__m"))
    first, last = F.ceil(F.col("__lo") / F.col("__s") - 1e-9), F.floor((F.col("__lo") + F.col("__x")) / F.col("__s") + 1e-9)
    planes = told.filter(first <= last).withColumn("__i", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    k = F.least(F.greatest(F.rint((F.col("__i") * F.col("__s") - F.col("__lo")) / F.col("dz")), F.lit(0.0)), F.col("n_z") - 1)
    return planes.select(*volumes.columns, (F.col("__i") * F.col("__m")).cast("long").alias("step"), k.cast("int").alias("slice"), (F.col("__i") * F.col("__s")).alias("z"))


def strip_affine(coefficients: list[float], degree: int) -> list[float]:
    """A displacement without its shift, slope in x and slope in y: means over the square [-1, 1] are taken out.

    The mean of x to an even power k is 1 / (k + 1), to an odd one nothing.
    """
    mean = lambda k: 0.0 if k % 2 else 1.0 / (k + 1)
    terms = warp_terms(degree)
    part = {(1 if d else 0, e): (3.0 if d or e else 1.0) * sum(c * mean(i + d) * mean(j + e) for c, (i, j) in zip(coefficients, terms, strict=True)) for d, e in ((0, 0), (1, 0), (0, 1))}
    return [c - part.get(term, 0.0) for c, term in zip(coefficients, terms, strict=True)]


def perturb_rays(rays: DataFrame, r_s: float, sdd: float, da: float = 0.0, db: float = 0.0, shift_a: float = 0.0, shift_b: float = 0.0, eta: float = 0.0, phi: float = 0.0, psi: float = 0.0, stretch: float = 1.0) -> DataFrame:
    """Rays of a detector that is shifted by parts of a pixel and tilted: eta in its plane, phi and psi out of it; ``stretch`` scales the source's distance.

    Directions are taken to where they meet the detector's plane, moved there, and made of unit length.
    """
    sx, sy, sz = (-F.col(f"o{x}") / r_s for x in "xyz")
    dot = F.col("dx") * sx + F.col("dy") * sy + F.col("dz") * sz
    told = rays.withColumns({"__sx": sx, "__sy": sy, "__sz": sz, "__k": sdd / dot})
    told = told.withColumns({f"__p{x}": F.col(f"d{x}") * F.col("__k") for x in "xyz"})
    # u = (-s_y, s_x, 0) along the rows, v = (0, 0, 1) along the columns.
    a = -F.col("__px") * F.col("__sy") + F.col("__py") * F.col("__sx")
    b = F.col("__pz")
    along_u, along_v, along_s = shift_a * da - eta * b, shift_b * db + eta * a, psi * a + phi * b
    new = {"x": F.col("__px") - along_u * F.col("__sy") + along_s * F.col("__sx"), "y": F.col("__py") + along_u * F.col("__sx") + along_s * F.col("__sy"), "z": F.col("__pz") + along_v + along_s * F.col("__sz")}
    told = told.withColumns({f"__n{x}": c for x, c in new.items()})
    size = F.sqrt(F.col("__nx") * F.col("__nx") + F.col("__ny") * F.col("__ny") + F.col("__nz") * F.col("__nz"))
    return told.withColumns({f"d{x}": F.col(f"__n{x}") / size for x in "xyz"} | {f"o{x}": F.col(f"o{x}") * stretch for x in "xyz"}).select(*rays.columns)


def regrid_rows(pix: DataFrame, group: list[str], axis: str, at: str, value: str) -> DataFrame:
    """Rows whose samples stand at rising places ``at`` on whole places of ``axis``, linearly between neighbours."""
    w = Window.partitionBy(*group).orderBy(axis)
    told = pix.withColumns({"__x1": F.lead(at).over(w), "__v1": F.lead(value).over(w)}).filter(F.col("__x1").isNotNull())
    first, last = F.ceil(at).cast("int"), F.ceil("__x1").cast("int") - 1
    placed = told.filter(last >= first).withColumn("__a", F.explode(F.sequence(first, last)))
    line = F.col(value) + (F.col("__v1") - F.col(value)) * (F.col("__a") - F.col(at)) / (F.col("__x1") - F.col(at))
    return placed.withColumns({value: line, axis: F.col("__a")}).drop("__x1", "__v1", "__a", at)
