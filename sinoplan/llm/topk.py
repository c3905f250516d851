"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sinoplan.llm.common import checkpointed, in_bounded_batches, returning

#: Rows of a shard and of a block of queries; what a task holds follows from both.
SHARD_ROWS, QUERY_ROWS = 1 << 18, 1 << 14
#: Rows of a shard that are scored together: the partial scores then fit in a core's cache.
BLOCK_ROWS = 4096

RESULT = T.StructType([T.StructField("query_row", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
#: Whole numbers up to this one are exact as doubles; sums that may pass it are made with integers of any size.
EXACT, LONGEST = 1 << 53, (1 << 63) - 1


def search_shard(queries: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, values: np.ndarray, copies: np.ndarray, rows: np.ndarray, k: int):
    """Yield (query row, query id, ids, scores) of each query's best ``k`` in one shard.

    ``copies``: how many equal rows each row stands for; ``rows``: their names, by which a query leaves
    out its own row (one of its copies).

    Each dimension is a term; its posting list in a block is the block's column, since a dense vector
    has every term. The bound of a term for a query is the most it can add in this block. Terms are
    taken by the width of their range, the widest first: the essential ones are those without which
    the rest of the bounds could not reach the k-th best score so far, and their postings are
    traversed for all rows; the others are probed one after another, for the rows whose score so
    far plus the bounds still open is competitive. A score that ties counts as competitive.
    """
    order = np.argsort(ids, kind="stable")
    ids, values, copies, rows = ids[order], values[order], np.minimum(copies[order], k + 1), rows[order]
    reach = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    kind = np.float64 if reach(values) * reach(queries[2]) * values.shape[1] < EXACT else object
    blocks = []
    for at in range(0, len(ids), BLOCK_ROWS):
        part = np.ascontiguousarray(values[at : at + BLOCK_ROWS].T.astype(kind))
        blocks.append((slice(at, at + BLOCK_ROWS), part, part.min(axis=1), part.max(axis=1)))
    for row, query_id, query in zip(*queries, strict=True):
        query = query.astype(kind)
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        for block, postings, least, most in blocks:
            high = np.maximum(query * least, query * most)
            low = np.minimum(query * least, query * most)
            terms = np.argsort(low - high, kind="stable")
            open_bound = np.append(np.cumsum(high[terms][::-1])[::-1], 0)
            floor = best[k - 1] if len(best) >= k else -np.inf
            if open_bound[0] < floor:
                continue
            # What the essential terms leave open, with the least they can add themselves.
            sure = np.cumsum(low[terms])
            essential = int(np.searchsorted((sure + open_bound[1:] < floor).astype(bool), True)) if floor > -np.inf else len(terms)
            essential = min(len(terms), max(8, (essential + 7) // 8 * 8))
            score = query[terms[:essential]] @ postings[terms[:essential]]
            alive = np.flatnonzero((score + open_bound[essential] >= floor).astype(bool))
            score = score[alive]
            at = essential
            while at < len(terms) and len(alive):
                probe = terms[at : at + 8]
                score = score + query[probe] @ postings[np.ix_(probe, alive)]
                at += len(probe)
                stay = (score + open_bound[at] >= floor).astype(bool)
                alive, score = alive[stay], score[stay]
            if not len(alive):
                continue
            times = copies[block][alive] - (rows[block][alive] == row)
            best_ids, best = np.append(best_ids, np.repeat(ids[block][alive], times)), np.append(best, np.repeat(score, times))
            top = np.lexsort((best_ids, -best))[:k] if kind is np.float64 else sorted(range(len(best)), key=lambda i: (-best[i], best_ids[i]))[:k]  # noqa: B023
            best_ids, best = best_ids[top], best[top]
        yield row, query_id, best_ids, np.array([min(max(int(x), -LONGEST - 1), LONGEST) for x in best], np.int64)


def _as_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], flat.type)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def top_k_inner_product(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's ``k`` rows of the highest integer inner product, exactly.

    A component x counts as floor(``scale`` * x), x as double, as a long (beyond its range the end of
    it); a sum beyond the range of a long counts in full and is given as the end of it. Queries are
    the rows whose id is divisible by ``every``; candidates are all rows but the query's own. Rows
    with a null id, and vectors that are null or empty or hold a null or a non-finite component, take
    no part; vectors of different lengths are compared within their length only. Repeated rows are
    candidates each and queries each; they are worked on once and counted. Ties go to the smaller id.
    No rows in, none out; columns besides the two named are not read.

    Rows are dealt into shards and queries into blocks; each pair of both is one group, a grid whose
    sides follow the counts, so that a task holds a bounded part of either. Every group gives ``k``
    rows a query, and those are merged. The work is queries times rows, as the query set asks.

    Result: query_id, rank (from 1), vec_id, score, query_row (tells apart queries with the same id
    and different vectors).
    """
    spark = in_bounded_batches(vectors).sparkSession
    value = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    usable = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), value.alias("v"))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("copies")).withColumn("width", F.size("v")).withColumn("row", F.xxhash64("id", "v"))
    rows = checkpointed(rows)
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    tasks = 4 * spark.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD_ROWS), min(tasks, -(-n // (2 * BLOCK_ROWS))))
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    place = F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(1 << 30))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.filter(is_query).select("row", "id", "v", "width", (place % blocks).cast("int").alias("block")).withColumn("shard", each(shards))
    right = rows.select("row", "id", "v", "copies", "width", (place % shards).cast("int").alias("shard")).withColumn("block", each(blocks))

    def search(key, q: pa.Table, c: pa.Table) -> pa.Table:
        width = key[2].as_py()
        out: list[list] = [[], [], [], []]
        if q.num_rows and c.num_rows:
            ask = (q["row"].to_numpy(), q["id"].to_numpy(), _as_matrix(q["v"], width))
            for row, query_id, found, score in search_shard(ask, c["id"].to_numpy(), _as_matrix(c["v"], width), c["copies"].to_numpy(), c["row"].to_numpy(), k):
                out[0] += [row] * len(found)
                out[1] += [query_id] * len(found)
                out[2] += found.tolist()
                out[3] += score.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=RESULT.names)

    keys = ["shard", "block", "width"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(returning(search), RESULT)
    merge = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(merge)).filter(F.col("rank") <= k)
    # A query that is repeated has its results each time.
    again = rows.filter(is_query & (F.col("copies") > 1)).select(F.col("row").alias("query_row"), "copies")
    ranked = ranked.join(again, "query_row", "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
