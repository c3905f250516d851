"""The registered queries of the array operators and their DuckDB twins."""

from __future__ import annotations

from sinoplan.plans import alignment, exporting, geometry, metrics, ordered, preparing, preprocessing, reconstruct, regions, selfcal, statistics  # noqa: F401
from sinoplan.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
