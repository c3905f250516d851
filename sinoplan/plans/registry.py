"""How a query and its DuckDB twin are registered together."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Shared beginnings of the DuckDB twins: vectors as a stack of frames k, rows b, columns a.
STACK = """e AS (SELECT label::INT AS k, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS b, embedding FROM embeddings),
s AS (SELECT k, b, unnest(range(0, len(embedding)))::INT AS a, unnest(embedding)::DOUBLE AS v FROM e)"""

#: The box that the longest frame fills, zero where a frame has no row: x (k, b, a, v).
BOX = """x AS (SELECT k, b, a, v FROM s UNION ALL SELECT k, b::INT, unnest(range((SELECT max(a) + 1 FROM s)))::INT, 0.0::DOUBLE FROM (SELECT k, unnest(range(nb, (SELECT max(b) + 1 FROM s))) AS b FROM (SELECT k, max(b) + 1 AS nb FROM s GROUP BY k)))"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("@STACK", STACK).replace("@BOX", BOX)
        return f

    return register
