"""The stopping rule over a stream of evaluations, its state kept by run."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run string, iter int, m double, is_best boolean, progress boolean, bad int, stop boolean"
STATE = "best double, bad int, seen int"


def stopping_stream(metric: DataFrame, absolute: float = 0.0, relative: float = 0.0, patience: int = 8, start: int = 0) -> DataFrame:
    """Evaluations (run, iter, m) with what the batch operator of the same name tells, as they come.

    Evaluations of a run must come in order of iter across triggers; within one they are sorted. The
    state of a run is three numbers.
    """

    def update(key, batches, state: GroupState):
        best, bad, seen = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values("iter")
        out = []
        for it, m in zip(rows["iter"], rows["m"], strict=True):
            good = not math.isnan(m)
            margin = max(absolute, relative * abs(best)) if best else absolute
            is_best = good and (best is None or m > best)
            progress = good and (best is None or m > best + margin)
            best = m if is_best else best
            bad = 0 if progress else bad + 1
            seen += 1
            out.append((key[0], int(it), float(m), is_best, progress, bad, bool(it >= start and bad >= patience)))
        state.update((best, bad, seen))
        yield pd.DataFrame(out, columns=["run", "iter", "m", "is_best", "progress", "bad", "stop"])

    return metric.groupBy("run").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
