"""Registries of representations and data terms: names for functions of columns and DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """A name that is not registered, or registered twice."""


class Registry:
    """Names for things; registering the same thing again does no harm, another thing is refused."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def register(self, name: str, thing):
        if self.known.setdefault(name, thing) != thing:
            raise ConfigError(f"{self.what} {name!r} is registered already")
        return thing

    def get(self, name: str):
        if name not in self.known:
            raise ConfigError(f"unknown {self.what} {name!r}; known: {', '.join(self.names())}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)

    def describe(self) -> dict[str, str]:
        return {n: (getattr(self.known[n], "__doc__", None) or "").strip().split("\n")[0] for n in self.names()}


#: name -> the aggregate over residual p - t and target t that a fit makes small.
data_terms = Registry("data term")
#: name -> the slope of a data term at one ray, before the mean over rays.
data_gradients = Registry("slope of a data term")
#: name -> a representation.
representations = Registry("representation")


def mse(p: Column, t: Column) -> Column:
    """Mean squared residual."""
    return F.avg(F.pow(p - t, 2))


def weighted_mse(p: Column, t: Column) -> Column:
    """Mean squared residual, weighted by transmission."""
    return F.avg(F.exp(-t) * F.pow(p - t, 2))


def mean_absolute(p: Column, t: Column) -> Column:
    """Mean absolute residual."""
    return F.avg(F.abs(p - t))


for _f in (mse, weighted_mse, mean_absolute):
    data_terms.register(_f.__name__, _f)


def mse_slope(p: Column, t: Column) -> Column:
    """Twice the residual."""
    return 2 * (p - t)


def weighted_slope(p: Column, t: Column) -> Column:
    """Twice the residual, weighted by transmission."""
    return 2 * F.exp(-t) * (p - t)


def absolute_slope(p: Column, t: Column) -> Column:
    """The residual's sign."""
    return F.signum(p - t)


for _name, _f in (("mse", mse_slope), ("weighted_mse", weighted_slope), ("mean_absolute", absolute_slope)):
    data_gradients.register(_name, _f)


@dataclass(frozen=True)
class Representation:
    """How a field is begun, seen along rays, and handed out as a volume."""

    name: str
    build: Callable[[DataFrame], DataFrame]
    export: Callable[[DataFrame], DataFrame]
    options: dict = field(default_factory=dict, compare=False)


def constant_grid(domain: DataFrame) -> DataFrame:
    """All voxels of a domain (i, j, l) at a small constant."""
    return domain.select("i", "j", "l", F.lit(0.001).alias("mu"))


representations.register("voxel", Representation("voxel", constant_grid, lambda vox: vox))
