"""Column expressions: they stay inside whole-stage code generation and know nothing of a table."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def r6(c: Column) -> Column:
    """Rounded for comparison across engines, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softplus_above(x: Column, floor, sharpness: float) -> Column:
    """``floor`` plus the softplus of what lies above it; the identity far above."""
    z = (x - floor) * sharpness
    return F.when(z > 20.0, x).otherwise(floor + F.log1p(F.exp(F.greatest(F.least(z, F.lit(20.0)), F.lit(-700.0)))) / sharpness)


def soft_clamp_lower(x: Column, floor: float = 0.0, sharpness: float = 50.0) -> Column:
    return softplus_above(x, F.lit(floor), sharpness)


def soft_clamp_upper(x: Column, ceiling: float = 1.05, sharpness: float = 200.0) -> Column:
    """Mirror image of the lower clamp."""
    return F.lit(ceiling) - softplus_above(F.lit(ceiling) - x, F.lit(0.0), sharpness)


def clamp_transmission(t: Column, floor: float = 1e-6, ceiling: float | None = 1.05, sharpness: float = 200.0, hard: bool = False) -> Column:
    """Two-sided clamp: softplus at both ends, or a plain clip."""
    if hard:
        low = F.greatest(t, F.lit(floor))
        return low if ceiling is None else F.least(low, F.lit(ceiling))
    low = softplus_above(t, F.lit(floor), sharpness)
    return low if ceiling is None else soft_clamp_upper(low, ceiling, sharpness)


def transmission(counts: Column, bright: Column, dark: Column) -> Column:
    return (counts - dark) / (F.greatest(bright - dark, F.lit(1.0)) + 1e-6)


def line_integral(t: Column, mode: str = "none", sharpness: float = 50.0) -> Column:
    p = -F.ln(t)
    if mode == "soft":
        return soft_clamp_lower(p, 0.0, sharpness)
    return F.greatest(p, F.lit(0.0)) if mode == "hard" else p


def affine(x: Column, scale, offset) -> Column:
    return x * scale + offset


def anchor_scale(air: Column, tissue: Column, air_hu: float = -1000.0, tissue_hu: float = 120.0) -> Column:
    return F.lit(tissue_hu - air_hu) / (tissue - air)


def band_fraction(mu: Column, low, high) -> Column:
    """How far a value lies through a band, clipped to 0 and 1."""
    return F.least(F.greatest((mu - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def cone_weight(a: Column, b: Column, n_a: int, n_b: int, pitch: float, sdd: float) -> Column:
    u, v = (a - n_a / 2) * pitch, (b - n_b / 2) * pitch
    return F.lit(sdd) / (F.sqrt(F.lit(sdd * sdd) + u * u + v * v) + 1e-8)


def sinc(x: Column) -> Column:
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(F.lit(PI) * x) / (F.lit(PI) * x))


def filter_window(f: Column, top: float, kind: str, cutoff: float = 1.0) -> Column:
    """Ramp times a window; nothing beyond the cutoff."""
    fc = top * cutoff
    window = {"ramp": F.lit(1.0), "shepp-logan": sinc(f / (2 * fc)), "cosine": F.cos(F.lit(PI) * f / (2 * fc)), "hamming": 0.54 + 0.46 * F.cos(F.lit(PI) * f / fc)}[kind]
    return F.when(f <= fc, F.abs(f) * window).otherwise(0.0)


def parker_weight(beta: Column, gamma: Column, span: Column) -> Column:
    """Short-scan weights; ``beta`` from the first view, ``span`` of all views."""
    over = (span - PI) - 2 * gamma
    rise, fall = F.sin(F.lit(PI / 2) * F.try_divide(beta, over)), F.sin(F.lit(PI / 2) * F.try_divide(span - beta, over))
    return F.when((over > 0) & (beta < over), rise * rise).when((over > 0) & (beta > PI + 2 * gamma), fall * fall).otherwise(1.0)


def huber(r: Column, delta) -> Column:
    return F.when(F.abs(r) <= delta, r * r).otherwise(2 * delta * F.abs(r) - delta * delta)


def learning_rate(i: Column, schedule: str, warmup: int, total: int, gamma: float = 0.999, hold: float = 0.0, floor: float = 0.0) -> Column:
    main = max(1, total - warmup)
    held = round(hold * main)
    decay = max(1, main - held)
    if schedule == "cosine":
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (i - warmup - held) / decay))
        after = floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(PI) * share))
    elif schedule == "exponential":
        after = F.pow(F.lit(gamma), F.greatest(i - warmup, F.lit(0)))
    else:
        after = F.lit(1.0)
    return F.when(i < warmup, F.greatest(F.lit(1e-8), (i + 1) / warmup)).otherwise(after) if warmup > 0 else after


def mirrored(i: Column, n) -> Column:
    """The index that reflection (edge repeated, period 2n) brings ``i`` back to."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)
