"""Row filters and power spectra.

Rows are arrays of at most a few thousand samples, worked on a batch at a time: a product of matrices
or an FFT of all rows of an Arrow batch. Spectra leave a batch as sums by group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def frequency_response(n: int, pitch: float, kind: str, cutoff: float = 1.0) -> np.ndarray:
    """Ramp times window at the frequencies of a real transform of ``n`` samples."""
    f = np.fft.rfftfreq(n, pitch)
    top = f[-1] * cutoff
    window = {"ramp": np.ones_like(f), "shepp-logan": np.sinc(f / (2 * top)), "cosine": np.cos(math.pi * f / (2 * top)), "hamming": 0.54 + 0.46 * np.cos(math.pi * f / top)}[kind]
    return np.where(f <= top, f * window, 0.0)


def impulse_response(n: int, pitch: float, kind: str, cutoff: float = 1.0) -> list[float]:
    """The same filter as circular weights."""
    return np.fft.irfft(frequency_response(n, pitch, kind, cutoff), n).tolist()


def _rows(column: pa.Array, n: int) -> np.ndarray:
    """The arrays of a batch, ``n`` samples each, as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), n)


def with_vals(frames: DataFrame, change) -> DataFrame:
    """``frames`` with ``vals`` as ``change`` makes it of the batch's column."""
    at = frames.columns.index("vals")

    def run(batches):
        for batch in batches:
            columns = batch.columns
            columns[at] = pa.array(list(change(columns[at])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = T.StructType([T.StructField("vals", T.ArrayType(T.DoubleType())) if f.name == "vals" else f for f in frames.schema.fields])
    return frames.mapInArrow(run, schema)


def filter_circulant(frames: DataFrame, n: int, pitch: float, kind: str = "hamming", cutoff: float = 1.0) -> DataFrame:
    """Filter rows (vals of ``n`` samples) by circular weights, as a product with the circulant matrix."""
    h = np.array(impulse_response(n, pitch, kind, cutoff))
    matrix = h[(np.arange(n)[None, :] - np.arange(n)[:, None]) % n]
    return with_vals(frames, lambda column: _rows(column, n) @ matrix)


def filter_fft(frames: DataFrame, pitch: float, kind: str = "hamming", cutoff: float = 1.0, padded: bool = False) -> DataFrame:
    """Filter rows by FFT; ``padded``: with zeros to the next power of two of twice the length."""

    def change(column):
        for row in column:
            x = np.array(row.as_py(), float)
            n = 1 << (2 * len(x) - 1).bit_length() if padded else len(x)
            yield np.fft.irfft(np.fft.rfft(x, n) * frequency_response(n, pitch, kind, cutoff), n)[: len(x)] if len(x) else x

    return with_vals(frames, change)


def power_spectrum(frames: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Mean power of rows of ``n`` samples at each frequency bin, summed up by group before anything is shuffled."""
    wanted = frames.select(*group, "vals")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                power = np.abs(np.fft.rfft(_rows(batch.column(len(group)), n), axis=1)) ** 2
                keys = pa.Table.from_batches([batch.select(group)]).append_column("__r", pa.array(np.arange(batch.num_rows))).group_by(group).aggregate([("__r", "list")])
                sums = [power[rows.as_py()].sum(axis=0) for rows in keys["__r_list"]]
                sizes = [len(rows) for rows in keys["__r_list"]]
                yield pa.RecordBatch.from_arrays([*(keys[g].combine_chunks() for g in group), pa.array(sums, pa.list_(pa.float64())), pa.array(sizes, pa.int64())], names=[*group, "sums", "m"])

    schema = T.StructType([*(wanted.schema[g] for g in group), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("m", T.LongType())])
    parts = wanted.mapInArrow(run, schema).select(*group, "m", F.posexplode("sums").alias("f", "s"))
    return parts.groupBy(*group, "f").agg((F.sum("s") / F.sum("m")).alias("power"))


def wiener_gain(signal: DataFrame, noise: DataFrame, group: list[str]) -> DataFrame:
    """Share of each bin's power that is signal: (S - N) / S, none below zero."""
    met = signal.withColumnRenamed("power", "s").join(noise.withColumnRenamed("power", "n"), [*group, "f"])
    return met.select(*group, "f", F.coalesce(F.greatest(F.try_divide(F.col("s") - F.col("n"), F.col("s")), F.lit(0.0)), F.lit(0.0)).alias("gain"))


def spectral_split(left: DataFrame, right: DataFrame, group: list[str], cross: int) -> DataFrame:
    """Mean deficit in dB of the left power below a bin, and mean excess from it on."""
    met = left.withColumnRenamed("power", "l").join(right.withColumnRenamed("power", "r"), [*group, "f"]).filter("l > 0 AND r > 0 AND f > 0")
    ratio = 10 * F.log10(F.col("l") / F.col("r"))
    return met.groupBy(*group).agg(F.avg(F.when(F.col("f") < cross, F.greatest(-ratio, F.lit(0.0)))).alias("deficit"), F.avg(F.when(F.col("f") >= cross, F.greatest(ratio, F.lit(0.0)))).alias("excess"))


def filtered_residual(residual: DataFrame, gain: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Mean square of rows of ``n`` samples after a filter of their frequencies: (group, value).

    ``gain``: (f, gain), or by group as well. The mean square of a row is the mean of its power over all
    frequencies, those that a real transform leaves out counted by their mirror images.
    """
    on = [c for c in [*group, "f"] if c in gain.columns]
    power = power_spectrum(residual, n, group).join(gain, on)
    times = F.when((F.col("f") == 0) | ((n % 2 == 0) & (F.col("f") == n // 2)), 1.0).otherwise(2.0)
    return power.groupBy(*group).agg((F.sum(times * F.col("power") * F.col("gain") * F.col("gain")) / (n * n)).alias("value"))


def cosine_ramp(n: int) -> list[float]:
    """The ramp in cycles a sample under a cosine window."""
    f = np.fft.rfftfreq(n)
    return np.clip(f * np.cos(math.pi * f / (2 * f.max() + 1e-8)), 0, None).tolist()


def radial_power(rows: DataFrame, n: int, group: list[str]) -> DataFrame:
    """Mean power of all square patches of ``n`` by ``n`` that tile a frame (group, b, vals) at each distance from the middle of the spectrum.

    Distances are rounded, ties to even; those beyond the last ring count to it. Patches at the end of rows and columns are filled up with
    zeros, so every pixel counts. A band of ``n`` rows is one group's work and leaves it as one sum a ring.
    """
    y, x = np.mgrid[:n, :n] - n // 2
    rings = n // 2
    ring = np.minimum(np.rint(np.sqrt(x * x + y * y)).astype(int), rings - 1).ravel()
    size = np.maximum(np.bincount(ring, minlength=rings), 1)

    def run(key, table):
        places, vals = table["b"].to_numpy() % n, table["vals"].to_pylist()
        wide = -(-max(map(len, vals)) // n) * n
        band = np.zeros((n, wide))
        for b, row in zip(places, vals, strict=True):
            band[b, : len(row)] = row
        tiles = band.reshape(n, wide // n, n).transpose(1, 0, 2)
        power = (np.abs(np.fft.fftshift(np.fft.fft2(tiles), axes=(1, 2))) ** 2).sum(axis=0)
        found = np.bincount(ring, power.ravel(), rings) / size
        return pa.table([*(pa.array([k.as_py()] * rings, k.type) for k in key[:-1]), pa.array(np.arange(rings, dtype=np.int32)), pa.array(found), pa.array([len(tiles)] * rings, pa.int64())], names=[*group, "f", "s", "m"])

    schema = T.StructType([*(rows.schema[g] for g in group), T.StructField("f", T.IntegerType()), T.StructField("s", T.DoubleType()), T.StructField("m", T.LongType())])
    bands = rows.filter(F.size("vals") > 0).select(*group, "b", "vals").groupBy(*group, F.floor(F.col("b") / n).alias("__band")).applyInArrow(run, schema)
    return bands.groupBy(*group, "f").agg((F.sum("s") / F.sum("m")).alias("power"))


def spectral_match(power: DataFrame, target: DataFrame, group: list[str], pitch_f: float, low: float = 0.5, high: float = 1.5, knee: float = 1.5, base: float = 0.1, floor: float = 1e-3) -> DataFrame:
    """How far a spectrum's shape is from a target's beyond a band in which both are made equal: mean |log10| by group.

    ``pitch_f``: frequency of one ring. Weights rise from ``base`` at the knee to 1 at the last ring.
    """
    f = F.col("f") * pitch_f
    met = power.join(target.withColumnRenamed("power", "green"), "f").withColumn("freq", f)
    band = (F.col("freq") >= low) & (F.col("freq") <= high)
    means = met.groupBy(*group).agg(F.greatest(F.avg(F.when(band, F.col("power"))), F.lit(1e-20)).alias("pa"), F.greatest(F.avg(F.when(band, F.col("green"))), F.lit(1e-20)).alias("ga"), F.max("freq").alias("top"))
    met = met.join(means, group)
    left = F.log10(F.greatest(F.col("power") / F.col("pa"), F.lit(floor * 1e-3)))
    right = F.log10(F.greatest(F.col("green") / F.col("ga"), F.lit(floor)))
    ramp = F.least(F.greatest((F.col("freq") - knee) / (F.greatest(F.col("top"), F.lit(knee + 1e-6)) - knee), F.lit(0.0)), F.lit(1.0))
    weight = F.when(F.col("freq") > high, base + (1 - base) * ramp).otherwise(0.0)
    return met.groupBy(*group).agg((F.sum(weight * F.abs(left - right)) / F.greatest(F.sum(weight), F.lit(1e-12))).alias("loss"))
