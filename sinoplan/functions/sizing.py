"""What a job needs: bytes of projections and volume by backend, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SAFETY = 1.15

#: backend -> (resident, host) bytes from those of the projections and of the volume.
FOOTPRINTS: dict[str, Callable[[Column, Column], tuple[Column, Column]]] = {}


def register_footprint(name: str, footprint: Callable[[Column, Column], tuple[Column, Column]]) -> None:
    """A name can be registered again only with the same function."""
    if FOOTPRINTS.setdefault(name, footprint) is not footprint:
        raise ValueError(f"footprint {name!r} is registered already")


def resolve_footprint(name: str):
    if name not in FOOTPRINTS:
        raise ValueError(f"unknown backend {name!r}; known: {', '.join(sorted(FOOTPRINTS))}")
    return FOOTPRINTS[name]


def _analytic(s, v):
    return s + F.floor(v / 8), 2 * s + v


def _whole(s, v):
    return 2 * (s + v), 2 * s + v


def _split(s, v):
    return s + F.floor(v / 8), 4 * v + 3 * s


def _learned(s, v):
    return 4 * v + s, 2 * s + v


register_footprint("analytic", _analytic)
register_footprint("whole", _whole)
register_footprint("split", _split)
register_footprint("learned", _learned)


def needs(name: str, projections: Column, volume: Column) -> tuple[Column, Column]:
    """Resident and host bytes with the margin."""
    resident, host = resolve_footprint(name)(projections, volume)
    return F.floor(resident * SAFETY).cast("long"), F.floor(host * SAFETY).cast("long")


def verdict(need: Column, have: Column) -> Column:
    return F.when(need > have, "insufficient").when(need > 0.8 * have, "tight").otherwise("ok")
