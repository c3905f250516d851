"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sinoplan.llm.common import whole

#: Rows that a source partition, or a part of a shard while slots are dealt, is meant to hold.
PART_ROWS = 200_000
#: Copies of one row that a task deals at a time.
LOT = 10_000
#: The most source partitions and cells of the matrix, which bounds it on the driver and in the broadcast.
MOST_PARTS, MOST_CELLS = 4096, 1 << 22


def communication_matrix(sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows that each source partition sends to each shard.

    Row sums are the partitions' sizes and column sums differ by one at most. Each row is drawn from
    the multivariate hypergeometric law of what the shards still lack, which is the law that these
    counts have when all rows are put in uniformly random order and cut into shards.
    """
    total = sum(sizes)
    lacking = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    draw = np.random.default_rng(seed)
    out = np.zeros((len(sizes), n_shards), np.int64)
    for i, size in enumerate(sizes):
        left, rest = int(size), sum(lacking)
        for j in range(n_shards):
            rest -= lacking[j]
            got = hypergeometric(float(draw.random()), lacking[j], rest, left)
            out[i, j] = got
            left -= got
        lacking = [x - int(got) for x, got in zip(lacking, out[i], strict=True)]
    return out


def hypergeometric(u: float, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` drawn are good, by inversion of the distribution function at ``u``.

    The law is laid out around its mode from the exact ratios of neighbouring probabilities, 40
    deviations to either side: no limit on the sizes, one way for all of them, and what is left out
    is less than a double can tell from nothing.
    """
    low, high = max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    total = good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    spread = (sample * good / total * bad / total * (total - sample) / max(total - 1, 1)) ** 0.5
    reach = int(40 * spread) + 60
    x = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)
    # From x to x + 1.
    ratio = np.log((good - x) / (x + 1)) + np.log((sample - x) / (bad - sample + x + 1))
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    weight = np.exp(weight - weight.max())
    at = int(np.searchsorted(np.cumsum(weight), u * weight.sum(), "right"))
    return int(min(max(low, mode - reach) + at, high))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 16, seed: int = 20) -> DataFrame:
    """Put all rows (of columns that can be grouped by) into shards 0 to ``n_shards`` - 1 in uniformly random order.

    1. Equal rows are counted, and their copies are dealt again one by one, so that very many equal
       rows are no burden to one task. Rows are dealt to source partitions by a hash of all they hold
       and of the copy's number; only the sizes go to the driver, at most 4096 numbers.
    2. The driver draws the communication matrix: how many rows of each partition go to each shard.
    3. Each partition is put in random order (a seeded hash); its first rows go to shard 0, the
       next to shard 1, and so on as the matrix says. This is the exchange.
    4. Each shard is put in random order again (another seed). A shard is cut by the high bits of
       its random key into parts of bounded size; a part's first slot is the size of those before.

    Everything is a function of the rows and ``seed``: a lost executor's work is done again alike.
    Result: the given columns, and shard int, slot long (gapless from 0 in each shard). Counts of
    shards differ by one at most. Equal rows are told apart by the number of the copy, so repeated
    rows all stay; a null is a value like any other; an empty table gives no rows. Columns of the
    input named shard or slot are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(*kept)
    n = rows.count()
    parts = int(min(MOST_PARTS, max(8, -(-n // PART_ROWS)), max(1, MOST_CELLS // n_shards)))
    every = [F.col(f"`{c}`") for c in kept]
    copies = rows.groupBy(*every).agg(F.count("*").alias("__copies"))
    # Copies come in lots, each lot exploded by another task.
    lots = copies.withColumn("__lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / LOT))))
    lots = lots.repartition(*every, "__lot")
    last = F.least(F.col("__copies"), (F.col("__lot") + 1) * LOT) - 1
    rows = lots.withColumn("__copy", F.explode(F.sequence(F.col("__lot") * LOT, last))).drop("__copies", "__lot")
    hashed = [*every, F.col("__copy")]
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed), *hashed), F.lit(parts)).cast("int"))
    sizes = {r["__part"]: r["n"] for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], n_shards, seed)
    ends = spark.createDataFrame([(p, np.cumsum(matrix[p]).tolist()) for p in range(parts)], T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))]))
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), *hashed), *hashed)
    sent = rows.withColumn("__n", F.row_number().over(local)).join(F.broadcast(ends), "__part")
    sent = sent.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__n"))).cast("int"))
    cuts = max(1, -(-n // (n_shards * PART_ROWS)))
    sent = sent.withColumn("__key", F.xxhash64(F.lit(seed + 2), *hashed))
    sent = sent.withColumn("__cut", F.pmod(F.shiftrightunsigned("__key", 20), F.lit(cuts)).cast("int"))
    counted = sent.groupBy("shard", "__cut").agg(F.count("*").alias("__m"))
    before = Window.partitionBy("shard").orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("__start", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    slots = Window.partitionBy("shard", "__cut").orderBy("__key", *hashed)
    placed = sent.withColumn("__k", F.row_number().over(slots)).join(starts, ["shard", "__cut"])
    return placed.select(*[F.col(f"`{c}`") for c in kept], "shard", (F.col("__start") + F.col("__k") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard and slot of every document, without moving its text.

    Size: bytes of the text in UTF-8 (none if null) plus 1; text_crc32: of the same bytes. The law
    that holds is ``rows``. See ``shuffle_into_shards`` for repeated, null and missing rows.
    """
    text = whole(text_col)
    light = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = shuffle_into_shards(light, n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
