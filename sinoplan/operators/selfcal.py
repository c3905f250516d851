"""A scanner calibrated by its own projections: tilt of the detector and column of the axis.

Two measures, both of a search whose levels are jobs: all candidates of a level are scored where the
detector rows are, and only scores, a number a candidate and band or plane, come to the driver.

* Conjugate rays: a line is measured twice in a turn, from either side. Where the axis falls on a column
  other than assumed, both disagree; that column against the row gives the tilt.
* Half scans: volumes from either half of the views show the same edges only if the detector stands as assumed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoplan.operators.lineage import checkpointed
from sinoplan.operators.metrics import gradient
from sinoplan.operators.spectral import filter_fft

#: Bytes of detector rows that one task looks at together.
LOT_BYTES = 64 << 20
#: Bounds of a tilt that is believed, and of the depth and prominence of what is searched.
MOST_PSI, LEAST_DEPTH, LEAST_PROMINENCE, LEAST_VIEWS = 2.0, 1.5, 0.02, 60


@dataclass(frozen=True)
class Detector:
    """Lengths in mm, the axis' column and the central row in pixels."""

    r_s: float
    sdd: float
    pitch: float
    n_a: int
    n_b: int
    cpa: float
    cpb: float


class Undetermined(ValueError):
    """The data do not tell the tilt; says why."""


def view_order(views: DataFrame) -> tuple[list[int], np.ndarray]:
    """The views of one scan by angle: their numbers and angles, of which a scan has a few thousand."""
    found = sorted((r["theta"], r["k"]) for r in views.select("k", F.col("theta").cast("double").alias("theta")).collect())
    return [k for _, k in found], np.array([t for t, _ in found])


class Pairs:
    """Which pixels of a row see the same lines if the axis falls on column ``cpa``, and the weights between their neighbours.

    Over more than 350 degrees the turn is closed and angles wrap; else lines without a second view are left out.
    """

    def __init__(self, theta: np.ndarray, cpa: float, d: Detector):
        step = float(np.median(np.diff(theta)))
        gamma = np.arctan((np.arange(d.n_a) - cpa) * d.pitch / d.sdd)
        mirror = 2 * cpa - np.arange(d.n_a)
        other = theta[:, None] + math.pi + 2 * gamma
        if theta[-1] - theta[0] > math.radians(350):
            other = theta[0] + np.mod(other - theta[0], theta[-1] - theta[0] + step)
        seen = (other >= theta[0]) & (other <= theta[-1]) & (mirror >= 0) & (mirror <= d.n_a - 1)
        self.view, self.column = np.nonzero(seen)
        at, to = (other[seen] - theta[0]) / step, mirror[self.column]
        self.v0, self.c0 = np.clip(at.astype(int), 0, len(theta) - 2), np.clip(to.astype(int), 0, d.n_a - 2)
        self.wv, self.wc = np.clip(at - self.v0, 0, 1), np.clip(to - self.c0, 0, 1)

    def differences(self, rows: np.ndarray, least: float) -> np.ndarray:
        """Of (row, view, column) the differences of all pairs that both see more than ``least``; rows that are not there (NaN) have none."""
        v0, c0, wv, wc = self.v0, self.c0, self.wv, self.wc
        one = rows[:, self.view, self.column]
        two = (1 - wv) * ((1 - wc) * rows[:, v0, c0] + wc * rows[:, v0, c0 + 1]) + wv * ((1 - wc) * rows[:, v0 + 1, c0] + wc * rows[:, v0 + 1, c0 + 1])
        return (one - two)[(np.abs(one) > least) & (np.abs(two) > least)]


def conjugate_costs(rows: DataFrame, order: tuple[list[int], np.ndarray], bands: list[tuple[int, int]], tries: list[list[float]], d: Detector, least: float = 0.15, pairs: int = 500) -> DataFrame:
    """How far conjugate rays disagree in each band of detector rows, for each of the band's candidate columns of the axis.

    ``rows``: (k, b, vals); ``bands``: first and last row + 1; ``tries``: for each band its candidates. Result: band, nth (of the
    candidate), cpa, n (pairs), cost: the variance of the differences, which a gain of a view does not move; null with fewer than ``pairs``.
    Rays that see no more than ``least`` are left out. A row's views meet in one task, some rows of a band at a time: pixels are shuffled
    once for all candidates, and each candidate's pairs are found once a lot.
    """
    number, theta = {k: n for n, k in enumerate(order[0])}, order[1]
    per_lot = max(1, LOT_BYTES // (8 * len(theta) * d.n_a))
    of = [(band, b) for band, (first, last) in enumerate(bands) for b in range(first, last)]
    told = rows.sparkSession.createDataFrame(of, "band int, b int")

    def run(key, table):
        band = key[0].as_py()
        place = {b: n for n, b in enumerate(sorted(set(table["b"].to_pylist())))}
        held = np.full((len(place), len(theta), d.n_a), np.nan)
        values = table["vals"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d.n_a)
        held[[place[b] for b in table["b"].to_pylist()], [number[k] for k in table["k"].to_pylist()]] = values
        out = []
        for cpa in tries[band]:
            x = Pairs(theta, cpa, d).differences(held, least)
            out.append((len(x), float(x.sum()), float(x @ x)))
        n, s, q = zip(*out, strict=True)
        return pa.table({"band": pa.array([band] * len(out), pa.int32()), "nth": pa.array(range(len(out)), pa.int32()), "cpa": pa.array(tries[band], pa.float64()), "n": pa.array(n, pa.int64()), "s": pa.array(s, pa.float64()), "q": pa.array(q, pa.float64())})

    met = rows.select("k", "b", "vals").join(told, "b").withColumn("lot", F.floor(F.col("b") / per_lot))
    sums = met.groupBy("band", "lot").applyInArrow(run, "band int, nth int, cpa double, n long, s double, q double").groupBy("band", "nth", "cpa").agg(*(F.sum(c).alias(c) for c in "nsq"))
    return sums.select("band", "nth", "cpa", "n", F.when(F.col("n") >= pairs, (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("cost"))


def _table(costs: DataFrame, bands: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs and pairs by band and candidate, NaN where there is none; as many numbers as there are candidates of all bands."""
    cost, n = np.full((bands, tries), np.nan), np.zeros((bands, tries), int)
    for r in costs.collect():
        n[r["band"], r["nth"]] = r["n"]
        if r["cost"] is not None:
            cost[r["band"], r["nth"]] = r["cost"]
    return cost, n


def parabola_top(xs: np.ndarray, ys: np.ndarray) -> float:
    """Where the parabola through the highest value and its neighbours is highest; at an end, or where it is flat, the highest place."""
    i = int(np.argmax(ys))
    if 0 < i < len(xs) - 1:
        left, right = ys[i] - ys[i - 1], ys[i] - ys[i + 1]
        if left + right > 0:
            return float(np.clip(xs[i] + (xs[i + 1] - xs[i]) * (left - right) / (2 * (left + right)), xs[0], xs[-1]))
    return float(xs[i])


def even_bands(d: Detector, bands: int, rows: int, part: float) -> list[tuple[int, int]]:
    """Bands of ``rows`` rows, evenly over ``part`` of the detector about its central row; those that do not fit are left out."""
    middles = [round(float(c)) for c in np.linspace(-part / 2, part / 2, bands) * d.n_b + d.cpb]
    return [(m - rows // 2, m + rows // 2 + 1) for m in middles if m - rows // 2 >= 0 and m + rows // 2 < d.n_b]


def cut_bands(d: Detector, bands: int, part: float, least: int = 4) -> list[tuple[int, int]]:
    """``part`` of the detector cut into bands; those of fewer than ``least`` rows are left out."""
    edges = [round(float(e)) for e in np.linspace(d.cpb - part / 2 * d.n_b, d.cpb + part / 2 * d.n_b, bands + 1)]
    found = [(max(0, x), min(d.n_b, y)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return [(x, y) for x, y in found if y - x >= least]


def tilt_by_bands(rows: DataFrame, views: DataFrame, d: Detector, bands: int = 9, band_rows: int = 45, part: float = 0.8, reach: float = 8.0, step: float = 0.5, least: float = 0.15, pairs: int = 500) -> tuple[dict, list[dict]]:
    """The tilt from each band's own best column: a grid, seven candidates of half its step about each band's best, a parabola, and a line through the bands.

    Two jobs, whatever the number of bands and candidates. Result: the fit (psi_deg with its bounds, cpa0 at the central row, slope,
    residual) and the bands (row, cpa, pairs). Raises ``Undetermined`` with fewer than three bands.
    """
    order, cuts = view_order(views), even_bands(d, bands, band_rows, part)
    grid = d.cpa + np.arange(-reach, reach + 1e-9, step)
    cost, _ = _table(conjugate_costs(rows, order, cuts, [grid.tolist()] * len(cuts), d, least, pairs), len(cuts), len(grid))
    good = [n for n in range(len(cuts)) if np.isfinite(cost[n]).all()]
    cuts = [cuts[n] for n in good]
    near = [grid[int(cost[n].argmin())] + step / 2 * np.arange(-3, 4) for n in good]
    found = []
    if cuts:
        cost, n_pairs = _table(conjugate_costs(rows, order, cuts, [x.tolist() for x in near], d, least, pairs), len(cuts), 7)
        for (first, last), xs, ys, n in zip(cuts, near, cost, n_pairs, strict=True):
            if np.isfinite(ys).all():
                found.append({"row": (first + last - 1) / 2, "cpa": parabola_top(xs, -ys), "pairs": int(n[int(ys.argmin())])})
    if len(found) < 3:
        raise Undetermined(f"{len(found)} bands of detector rows have a cost of each candidate; a line needs three")
    x, y = np.array([f["row"] - d.cpb for f in found]), np.array([f["cpa"] for f in found])
    slope, at = np.polyfit(x, y, 1)
    rest = y - at - slope * x
    error = float(np.sqrt((rest @ rest) / max(len(x) - 2, 1) / max(float(((x) ** 2).sum()), 1e-12)))
    fit = {"psi_deg": degrees_of(slope), "psi_low": degrees_of(slope - error), "psi_high": degrees_of(slope + error), "cpa0": float(at), "slope": float(slope), "residual": float(np.sqrt((rest**2).mean())), "bands": len(found)}
    return fit, found


def degrees_of(slope: float) -> float:
    """The tilt that moves the axis by ``slope`` columns a row."""
    return math.degrees(math.asin(max(-1.0, min(1.0, float(slope)))))


def joint_cost(table: np.ndarray, grid: np.ndarray, offsets: np.ndarray, slopes: np.ndarray, away: np.ndarray) -> np.ndarray:
    """Summed cost of all bands for each pair of an offset of the axis and a slope; infinite where a band leaves the grid.

    ``away``: rows from the central one to each band. Between candidates a band's cost is the parabola through the
    nearest three: straight lines would draw each band's least cost to a candidate.
    """
    want = offsets[:, None, None] + slopes[None, :, None] * away[None, None, :]
    at = (want - grid[0]) / (grid[1] - grid[0])
    mid = np.clip(np.rint(at).astype(int), 1, len(grid) - 2)
    band, t = np.arange(len(away)), at - mid
    before, here, after = table[band, mid - 1], table[band, mid], table[band, mid + 1]
    cost = (here + t * (after - before) / 2 + t * t * (after - 2 * here + before) / 2).sum(axis=2)
    return np.where(((want < grid[0] - 1e-12) | (want > grid[-1] + 1e-12)).any(axis=2), np.inf, cost)


def tilt_jointly(rows: DataFrame, views: DataFrame, d: Detector, bands: int = 25, part: float = 0.9, reach_mm: float = 0.7, step_mm: float = 0.02, fine_mm: float = 0.52, fine_step_mm: float = 0.008, least: float = 0.15, pairs: int = 500) -> dict:
    """Tilt and centre that make the summed cost of all bands least: a band whose cost is flat has no say, a sharp one has much.

    One job gives the costs of all candidates in all bands; the search in (centre, slope) is nested, over that table of
    some thousand numbers. Reach and steps are lengths at the detector, so the search is the same at any pooling.
    ``depth``: how far the cost rises over the search; a shallow one does not tell the tilt (``doubts``).
    """
    order, cuts = view_order(views), cut_bands(d, bands, part)
    grid = np.arange(-reach_mm / d.pitch, reach_mm / d.pitch + 1e-9, max(step_mm / d.pitch, 1e-3))
    cost, _ = _table(conjugate_costs(rows, order, cuts, [(d.cpa + grid).tolist()] * len(cuts), d, least, pairs), len(cuts), len(grid))
    good = np.isfinite(cost).all(axis=1)
    if good.sum() < 4:
        raise Undetermined(f"{int(good.sum())} bands of detector rows have a cost of each candidate; four are needed")
    cost = cost[good] / np.median(cost[good], axis=1, keepdims=True)
    away = np.array([(first + last - 1) / 2 for first, last in cuts])[good] - d.cpb
    step = max(fine_step_mm / d.pitch, 1e-3)
    offsets, slopes = np.arange(-fine_mm / d.pitch, fine_mm / d.pitch + 1e-9, step), np.arange(-60, 61) * 0.0005
    surface = joint_cost(cost, grid, offsets, slopes, away)
    whole = surface[np.isfinite(surface)]
    if not len(whole):
        raise Undetermined("no pair of a centre and a slope keeps all bands inside the searched columns")
    i, j = np.unravel_index(int(surface.argmin()), surface.shape)
    offset, slope = offsets[i], slopes[j]
    for ho, hs in ((step / 2, 0.0002), (step / 5, 0.00008)):
        offsets, slopes = offset + ho * np.arange(-2, 3), slope + hs * np.arange(-2, 3)
        near = joint_cost(cost, grid, offsets, slopes, away)
        i, j = np.unravel_index(int(near.argmin()), near.shape)
        offset, slope = offsets[i], slopes[j]
    lower, least_cost, upper = joint_cost(cost, grid, np.array([offset]), slope + 0.0005 * np.arange(-1, 2), away)[0]
    bend = (lower - 2 * least_cost + upper) / 0.0005**2
    error = math.sqrt(2 * least_cost / bend / len(away)) if np.isfinite(bend) and bend > 0 else 0.0
    return {"psi_deg": degrees_of(slope), "psi_low": degrees_of(slope - error), "psi_high": degrees_of(slope + error), "cpa0": float(d.cpa + offset), "slope": float(slope), "depth": float((whole.max() - least_cost) / max(least_cost, 1e-12)), "bands": len(away)}


def doubts(psi_deg: float, depth: float | None = None) -> list[str]:
    """Why a fit must not become the geometry; nothing if it may."""
    out = []
    if not math.isfinite(psi_deg) or abs(psi_deg) > MOST_PSI:
        out.append(f"tilt {psi_deg:+.3f} is beyond {MOST_PSI} degrees, more than a mount has")
    if depth is not None and not depth >= LEAST_DEPTH:
        out.append(f"depth {depth:.2f} of the cost is below {LEAST_DEPTH}: the data do not tell tilt and centre")
    return out


# --- half scans


def pooled(rows: DataFrame, d: Detector, f: int) -> tuple[DataFrame, Detector]:
    """Detector rows pooled f by f (what does not fill a pixel is left out, as on a coarser detector), and what the detector is then."""
    if f == 1:
        return rows, d
    n_b, n_a = d.n_b // f, d.n_a // f
    pixels = rows.filter(F.col("b") < n_b * f).select("k", F.floor(F.col("b") / f).cast("int").alias("b"), F.posexplode(F.slice("vals", 1, n_a * f)).alias("a", "v"))
    means = pixels.groupBy("k", "b", F.floor(F.col("a") / f).cast("int").alias("a")).agg(F.avg("v").alias("v"))
    lines = means.groupBy("k", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "v"))), lambda p: p["v"]).alias("vals"))
    at = lambda c: (c - (f - 1) / 2) / f
    return lines, Detector(d.r_s, d.sdd, d.pitch * f, n_a, n_b, at(d.cpa), at(d.cpb))


def _planes(tries: list[tuple[float, float]], d: Detector):
    """Voxels of a tile of a plane, from both halves of a lot of views, for each candidate (tilt, column of the axis)."""
    turned = [(math.cos(psi), math.sin(psi), cpa) for psi, cpa in tries]

    def run(key, vox, seen):
        x, y, z = (vox[c].to_numpy() for c in "xyz")
        total = np.zeros((len(turned), 2, len(x)))
        seen = seen.sort_by([("k", "ascending"), ("b", "ascending")])
        k, b, theta, a0, half = (seen[c].to_numpy() for c in ("k", "b", "theta", "a0", "half"))
        lines = seen["vals"].combine_chunks()
        for at in np.flatnonzero(np.append(True, k[1:] != k[:-1])[: len(k)]):
            end = at + int(np.searchsorted(k[at:], k[at], "right"))
            width = len(lines[int(at)])
            window = np.zeros((int(b[end - 1] - b[at]) + 3, width + 2))  # a rim of nothing: beyond the detector there is none
            window[b[at:end] - b[at] + 1, 1:-1] = lines.slice(int(at), end - int(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            c, s = math.cos(theta[at]), math.sin(theta[at])
            scale = d.sdd / np.maximum(d.r_s + x * c + y * s, 1e-6) / d.pitch
            u, v = scale * (y * c - x * s), scale * z
            for n, (cp, sp, cpa) in enumerate(turned):
                p, q = d.cpb + cp * v - sp * u - b[at] + 1, cpa + cp * u + sp * v - a0[at] + 1
                i, j = np.floor(p).astype(int), np.floor(q).astype(int)
                inside = (i >= 0) & (i < window.shape[0] - 1) & (j >= 0) & (j < window.shape[1] - 1)
                i, j, wi, wj = (np.where(inside, t, 0) for t in (i, j, p - i, q - j))
                got = (1 - wi) * ((1 - wj) * window[i, j] + wj * window[i, j + 1]) + wi * ((1 - wj) * window[i + 1, j] + wj * window[i + 1, j + 1])
                total[n, half[at]] += np.where(inside, got, 0.0)
        size = len(x)
        told = {"nth": np.repeat(np.arange(len(turned), dtype=np.int32), 2 * size), "half": np.tile(np.repeat(np.arange(2, dtype=np.int32), size), len(turned))}
        told |= {c: np.tile(vox[c].to_numpy(), 2 * len(turned)) for c in ("plane", "i", "j")}
        return pa.table({**told, "v": total.reshape(-1)})

    return run


def _asked(order: tuple[list[int], np.ndarray], tries: list[tuple[float, float]], d: Detector):
    """Which detector rows (b), and which of their columns (a0 to a1), the voxels of a tile of a plane fall on in each view, for any candidate."""
    turned = [(math.cos(psi), math.sin(psi), cpa) for psi, cpa in tries]
    views = [(k, float(t), int(n >= len(order[0]) // 2)) for n, (k, t) in enumerate(zip(*order, strict=True))]

    def run(key, vox):
        x, y, z = (vox[c].to_numpy() for c in "xyz")
        told, rows = [], []
        for k, theta, half in views:
            c, s = math.cos(theta), math.sin(theta)
            scale = d.sdd / np.maximum(d.r_s + x * c + y * s, 1e-6) / d.pitch
            u, v = scale * (y * c - x * s), scale * z
            met, a0, a1 = np.zeros(d.n_b + 2, bool), d.n_a, -1  # a row more at either end
            for cp, sp, cpa in turned:
                p, q = d.cpb + cp * v - sp * u, cpa + cp * u + sp * v
                on = (p > -1) & (p < d.n_b) & (q > -1) & (q < d.n_a)
                if on.any():
                    i, j = np.floor(p[on]).astype(int) + 1, np.floor(q[on])
                    met[i] = met[i + 1] = True
                    a0, a1 = min(a0, int(j.min())), max(a1, int(j.max()) + 1)
            b = np.flatnonzero(met[1:-1])
            if len(b):
                told.append((k, theta, half, max(a0, 0), min(a1, d.n_a - 1)))
                rows.append(b)
        count = [len(b) for b in rows]
        names = {"k": np.int32, "theta": np.float64, "half": np.int32, "a0": np.int32, "a1": np.int32}
        out = {name: np.repeat(np.array([t[n] for t in told], kind), count) for n, (name, kind) in enumerate(names.items())}
        out["b"] = np.concatenate(rows).astype(np.int32) if rows else np.array([], np.int32)
        return pa.table({name: np.full(sum(count), k.as_py(), np.int32) for name, k in zip(("box", "si", "sj"), key, strict=True)} | out)

    return run


def half_scan_planes(vox: DataFrame, rows: DataFrame, order: tuple[list[int], np.ndarray], tries: list[tuple[float, float]], d: Detector, tile: int = 64, lot: int = 256) -> DataFrame:
    """Planes (nth, half, plane, i, j, v) backprojected from the first and second half of the views, for each of ``tries`` (tilt in radians, column of the axis).

    ``vox``: (plane, i, j, x, y, z). As in ``backproject``, a tile meets of some views at a time what it falls on of the detector, for all candidates
    together: pieces of rows are shuffled once for all of them. A tile far off the central row is spread over very many rows, of which its voxels meet few; only these are asked for.
    """
    spark = vox.sparkSession
    tiled = vox.select(*(F.col(c).cast("int").alias(c) for c in ("plane", "i", "j")), *(F.col(c).cast("double").alias(c) for c in "xyz")).withColumns({f"t{c}": F.floor(F.col(c) / tile).cast("int") for c in "ij"})
    asked = tiled.groupBy("plane", "ti", "tj").applyInArrow(_asked(order, tries, d), "box int, si int, sj int, k int, theta double, half int, a0 int, a1 int, b int")
    seen = asked.join(rows.select("k", "b", "vals"), ["k", "b"])
    seen = seen.select("box", "si", "sj", F.floor(F.col("k") / lot).cast("int").alias("lot"), "k", "b", "theta", "half", "a0", F.slice("vals", F.col("a0") + 1, F.col("a1") - F.col("a0") + 1).alias("vals"))
    lots = spark.createDataFrame(sorted({(k // lot,) for k in order[0]}), "lot int")
    parts = tiled.crossJoin(F.broadcast(lots)).groupBy("plane", "ti", "tj", "lot").cogroup(seen.groupBy("box", "si", "sj", "lot")).applyInArrow(_planes(tries, d), "nth int, half int, plane int, i int, j int, v double")
    return parts.groupBy("nth", "half", "plane", "i", "j").agg(F.sum("v").alias("v"))


def half_scan_scores(vox: DataFrame, rows: DataFrame, order: tuple[list[int], np.ndarray], tries: list[tuple[float, float]], d: Detector, flat: float = 0.0) -> DataFrame:
    """How far the edges of both halves' planes agree (nth, plane, score): correlation of their gradients' sizes.

    A plane that is flat in a half, such as one that a candidate moves off the detector, has no correlation; its score is ``flat``.
    """
    both = half_scan_planes(vox, rows, order, tries, d).groupBy("nth", "plane", "i", "j").agg(*(F.sum(F.when(F.col("half") == h, F.col("v"))).alias(f"h{h}") for h in (0, 1)))
    for h in (0, 1):
        both = gradient(both, ["i", "j"], f"h{h}", ["nth", "plane"]).withColumn(f"e{h}", F.sqrt(F.col("g_i") * F.col("g_i") + F.col("g_j") * F.col("g_j"))).drop("g_i", "g_j")
    score = F.try_divide(F.covar_pop("e0", "e1"), F.stddev_pop("e0") * F.stddev_pop("e1"))  # corr() divides by zero where an edge is flat
    return both.groupBy("nth", "plane").agg(F.coalesce(F.nanvl(score, F.lit(None)), F.lit(float(flat))).alias("score"))


def widened(score, grid: list[float], step: float, low: float, high: float, more: int = 3, times: int = 4) -> tuple[np.ndarray, np.ndarray, bool]:
    """Scores over ``grid``, which grows by ``more`` steps beyond the end where the highest score stands, within ``low`` and ``high``.

    ``score`` takes a list of candidates and scores them in one job. Result: places in order, scores, and whether the highest is still at an end.
    """
    xs = np.sort(np.array(grid, float))
    ys = np.array(score(xs.tolist()), float)
    for _ in range(times):
        top = int(np.argmax(ys))
        if 0 < top < len(xs) - 1:
            break
        beyond = (xs[0] - step * np.arange(more, 0, -1)) if top == 0 else xs[-1] + step * np.arange(1, more + 1)
        beyond = beyond[(beyond >= low) & (beyond <= high)]
        if not len(beyond):
            break
        both = np.concatenate([xs, beyond]), np.concatenate([ys, score(beyond.tolist())])
        order = np.argsort(both[0])
        xs, ys = both[0][order], both[1][order]
    return xs, ys, int(np.argmax(ys)) in (0, len(xs) - 1)


def plane_grid(spark, d: Detector, side: float, voxel: float, heights: tuple[float, ...]) -> DataFrame:
    """Planes of ``side`` by ``side`` mm about the axis at ``heights``: (plane, i, j, x, y, z)."""
    n = max(2, round(side / voxel))
    ids = spark.range(n * n * len(heights))
    z = F.element_at(F.array(*(F.lit(float(h)) for h in heights)), F.col("plane") + 1)
    ids = ids.select(F.floor(F.col("id") / (n * n)).cast("int").alias("plane"), F.floor(F.col("id") % (n * n) / n).cast("int").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    return ids.withColumns({"x": (F.col("i") + 0.5 - n / 2) * (side / n), "y": (F.col("j") + 0.5 - n / 2) * (side / n), "z": z})


def tilt_by_half_scans(rows: DataFrame, views: DataFrame, d: Detector, side: float, height: float, pools: tuple[int, int] = (9, 3), voxels: tuple[float, float] = (0.15, 0.05), grids: tuple[float, float] = (1.2, 0.15), steps: tuple[float, float] = (0.15, 0.05), least_views: int = LEAST_VIEWS) -> tuple[dict, list[dict]]:
    """The tilt (degrees) at which both half scans show the same edges in two planes at +-``height``: a coarse search on a pooled detector, then a fine one about its top.

    A tilt moves the planes to opposite sides and a shifted axis to the same, so the pair tells both. Filtered rows are made once a
    stage; each extension of a grid is one job for all of its candidates. The column of the axis is measured too, at the tilt found.
    Result: psi_deg, prominence, cpa0 and the curves (stage, psi_deg, score). Raises ``Undetermined`` for few views, a flat
    curve, a top that stays at an end and a tilt beyond ``MOST_PSI``.
    """
    order = view_order(views)
    if len(order[0]) < least_views:
        raise Undetermined(f"{len(order[0])} views; halves of a scan need {least_views}")
    spark, curves = rows.sparkSession, []

    def stage(n: int):
        small, dn = pooled(rows, d, pools[n])
        small, grid = checkpointed(filter_fft(small, dn.pitch, "ramp", padded=True)), checkpointed(plane_grid(spark, dn, side, voxels[n], (height, -height)))

        def score(tries: list[tuple[float, float]]) -> list[float]:
            found = half_scan_scores(grid, small, order, tries, dn).groupBy("nth").agg(F.avg("score").alias("score")).collect()
            by = {r["nth"]: r["score"] for r in found}
            return [by[m] for m in range(len(tries))]

        return score, dn

    psi, prominence = 0.0, 0.0
    for n in (0, 1):
        score, dn = stage(n)
        centre = (dn.n_a - 1) / 2
        grid = psi + np.arange(-round(grids[n] / steps[n]), round(grids[n] / steps[n]) + 1) * steps[n]
        xs, ys, edge = widened(lambda at, f=score, c=centre: f([(math.radians(x), c) for x in at]), grid.tolist(), steps[n], -MOST_PSI, MOST_PSI)
        curves += [{"stage": n, "psi_deg": float(x), "score": float(y)} for x, y in zip(xs, ys, strict=True)]
        if edge:
            raise Undetermined(f"the top of stage {n + 1} stays at the end of its grid ({xs[int(ys.argmax())]:+.2f} degrees)")
        if not n:
            prominence = float((ys.max() - ys.min()) / max(abs(ys.min()), 1e-30))
            if prominence < LEAST_PROMINENCE:
                raise Undetermined(f"the curve is flat (prominence {prominence:.3f})")
        psi = parabola_top(xs, ys)
    if told := doubts(psi):
        raise Undetermined(told[0])
    offsets = np.array([-1.0, 0.0, 1.0])
    off = parabola_top(offsets, np.array(score([(math.radians(psi), centre + o) for o in offsets]))) * pools[1]
    return {"psi_deg": psi, "prominence": prominence, "cpa0": (d.n_a - 1) / 2 + off, "cpa0_offset": off}, curves
