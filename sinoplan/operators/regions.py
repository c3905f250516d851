"""Regions in mm about the isocentre: crop boxes, model domains, the grids they give, and what to hand out of them.

One row a scan; bounds are the columns x_min to z_max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = [f"{axis}_{end}" for axis in "xyz" for end in ("min", "max")]


def crop_bounds(crop: dict[str, Column], landmark: dict[str, Column]) -> dict[str, Column]:
    """A crop box in the scanner's coordinates about the isocentre: shifted by the landmark, x turned round."""
    out = {f"{axis}_{end}": crop[f"{axis}_{end}"] - landmark[axis] for axis in "yz" for end in ("min", "max")}
    return {"x_min": -(crop["x_max"] - landmark["x"]), "x_max": -(crop["x_min"] - landmark["x"])} | out


def field_bounds(fov_xy: Column, fov_z: Column) -> dict[str, Column]:
    """The box of a field of view around the isocentre."""
    return {"x_min": -fov_xy / 2, "x_max": fov_xy / 2, "y_min": -fov_xy / 2, "y_max": fov_xy / 2, "z_min": -fov_z / 2, "z_max": fov_z / 2}


def cylinder_bounds(radius: Column, z_min: Column, z_max: Column) -> dict[str, Column]:
    """The box around an upright cylinder on the axis, which is how a measured support becomes a domain."""
    return {"x_min": -radius, "x_max": radius, "y_min": -radius, "y_max": radius, "z_min": z_min, "z_max": z_max}


def export_bounds(wanted: dict[str, Column], domain: dict[str, Column]) -> dict[str, Column]:
    """What is handed out: the wanted box where there is one, else the domain, and never more than the domain."""
    out = {}
    for name in BOUNDS:
        inner = F.greatest if name.endswith("min") else F.least
        out[name] = F.coalesce(inner(wanted[name], domain[name]), domain[name])
    return out


def bounds_grid(g: DataFrame, voxel_xy: float, voxel_z: float) -> DataFrame:
    """Voxels along each axis (ties to even) and the centre of the grid, from bounds."""
    size = {"nx": ("x", voxel_xy), "ny": ("y", voxel_xy), "nz": ("z", voxel_z)}
    counts = {n: F.rint((F.col(f"{a}_max") - F.col(f"{a}_min")) / d).cast("int") for n, (a, d) in size.items()}
    return g.withColumns(counts | {f"o{a}": (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2 for a in "xyz"} | {"dx": F.lit(voxel_xy), "dz": F.lit(voxel_z)})


def rotation_centre(given: Column, n: Column, policy: str, pooled: int = 1) -> Column:
    """The centre of rotation as the header gives it or in the middle of the detector, in pooled pixels."""
    if policy not in ("center", "xml"):
        raise ValueError(f"unknown policy {policy!r}; known: center, xml")
    at = (n - 1) / 2.0 if policy == "center" else given
    return (at - (pooled - 1) / 2.0) / pooled


def inside_cylinder(x: Column, y: Column, z: Column, radius: Column | float, z0: Column | float, z1: Column | float, cx: Column | float = 0.0, cy: Column | float = 0.0) -> Column:
    """Whether a place is in an upright cylinder, its surface included."""
    return ((x - cx) * (x - cx) + (y - cy) * (y - cy) <= F.lit(radius) * F.lit(radius)) & (z >= z0) & (z <= z1)


def to_unit_cube(v: Column, low: Column, high: Column) -> Column:
    """A coordinate of a domain on [-1, 1]."""
    return (v - (low + high) / 2) / ((high - low) / 2)


def spread_angles(n: Column, count: int) -> Column:
    """Indices of ``count`` views spread over ``n``, the middle of the scan in their middle, each once."""
    k = F.least(F.lit(count), n)
    place = lambda i: i * (n - 1) / F.greatest(k - 1, F.lit(1)) + F.floor(n / 2) - (n - 1) / 2.0
    index = lambda i: F.rint(F.least(F.greatest(place(i), F.lit(0.0)), n - 1.0)).cast("int")
    many = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), index)))
    rest = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(many, i))
    filled = F.array_sort(F.concat(many, F.slice(rest, 1, F.greatest(k - F.size(many), F.lit(0)))))
    return F.when(n <= 0, F.array().cast("array<int>")).when(k == 1, F.array(F.floor(n / 2).cast("int"))).otherwise(filled)
