"""How far the term distributions of sources lie apart: a quadtree over the matrix of groups and terms."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sinoplan.llm.common import checkpointed, in_bounded_batches, tidy

#: Of all bytes: letters lower-cased, those from 128 on kept, anything else a gap.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: Bytes of a text looked at together, and entries of counts that a worker holds before it hands them on.
PIECE, HELD = 4 << 20, 400_000

#: Terms that a block of the matrix is meant to have, and sources of a panel of its rows.
BLOCK_TERMS, PANEL = 1024, 128
#: Rows and columns of a tile, the least quadrant of the tree.
ROWS, COLUMNS = 4, 32
#: Pairs of tiles worked on together.
TILES = 1024
#: Share of a probability, in parts of which all arithmetic is done.
UNIT = 1_000_000_000


def _pieces(text: bytes):
    """A folded text in pieces that end at a gap."""
    text, at = text.translate(_FOLD), 0
    while len(text) - at > PIECE:
        end = text.rfind(b" ", at, at + PIECE)
        end = end if end > at else text.find(b" ", at + PIECE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Occurrences ``c`` of each term in each (lang, source), and documents ``d`` that have it.

    Terms are runs of letters A to Z and of characters beyond ASCII; only A to Z are lower-cased. Null
    text, lang and source count as ''. A group without terms has one row with a null term. Workers hand
    on sums, so a term of all documents has a row a task, not a row an occurrence.
    """
    schema = "lang string, source string, term binary, c long, d long"

    def run(batches):
        counts: dict = defaultdict(Counter)
        having: dict = defaultdict(Counter)
        seen: set = set()

        def handed():
            for (lang, source), of in counts.items():
                terms, told = list(of), having[lang, source]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array(of.values(), pa.int64()), pa.array([told[t] for t in terms], pa.int64())], names=["lang", "source", "term", "c", "d"])
            counts.clear()
            having.clear()

        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                seen.add((lang, source))
                of, own = counts[lang, source], set()
                for piece in _pieces(text):
                    words = piece.split()
                    of.update(words)
                    own.update(words)
                having[lang, source].update(own)
            if sum(map(len, counts.values())) > HELD:
                yield from handed()
        yield from handed()
        rows = sorted(seen)
        none = pa.array([None] * len(rows), pa.binary())
        zero = pa.array([0] * len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.string()), none, zero, zero], names=["lang", "source", "term", "c", "d"])

    told = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    rows = in_bounded_batches(docs).select(*told[:2], told[2].cast("binary").alias("text")).mapInArrow(tidy(run), schema)
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) for count <= total, three digits at a time so that no product leaves 64 bits."""
    rest, total = np.broadcast_arrays(count, total)
    out = np.zeros(rest.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def quadtree(filled: np.ndarray, side: int) -> list[np.ndarray]:
    """Which quadrants of a square of ``side`` tiles hold anything: from the tiles up to the whole."""
    square = np.zeros((side, side), bool)
    square[: filled.shape[0], : filled.shape[1]] = filled
    levels = [square]
    while side > 1:
        side //= 2
        levels.append(levels[-1].reshape(side, 2, side, 2).any(axis=(1, 3)))
    return levels


def in_tiles(counts: np.ndarray) -> np.ndarray:
    """A matrix as (tile row, row, tile column, column), padded to whole tiles."""
    full = np.pad(counts, ((0, -counts.shape[0] % ROWS), (0, -counts.shape[1] % COLUMNS)))
    return full.reshape(full.shape[0] // ROWS, ROWS, full.shape[1] // COLUMNS, COLUMNS)


def joint_sums(x: np.ndarray, total_x: np.ndarray, y: np.ndarray, total_y: np.ndarray) -> np.ndarray:
    """Sums of ``distance`` over all columns, for each pair of a row of counts in ``x`` and one in ``y``.

    Both matrices have a quadtree over their tiles, and the two are gone through together from the top:
    where both quadrants are all zero, each of their columns has the same distance, which is priced
    once by the number of columns; where not, the quadrants below are looked at; tiles are worked out.
    ``y`` being ``x`` itself, each pair of tiles is looked at once.
    """
    (n, width), m, alike = x.shape, y.shape[0], y is x
    tiles_x, tiles_y = in_tiles(x), in_tiles(y)
    across = np.clip(width - COLUMNS * np.arange(tiles_x.shape[2]), 0, COLUMNS)  # columns that each tile really has
    side = 1 << (max(tiles_x.shape[0], tiles_x.shape[2], tiles_y.shape[0]) - 1).bit_length()
    tree_x, tree_y = (quadtree((tiles > 0).any(axis=(1, 3)), side) for tiles in (tiles_x, tiles_y))
    padded = lambda total, tiles: np.pad(total, (0, tiles.shape[0] * ROWS - len(total)), constant_values=1)
    all_x, all_y = padded(total_x, tiles_x), padded(total_y, tiles_y)
    empty = np.zeros((tiles_x.shape[0], tiles_y.shape[0]), np.int64)
    sums = np.zeros((len(all_x), len(all_y)), np.int64)
    at = np.zeros((1, 3), np.int64)
    for level in range(len(tree_x) - 1, -1, -1):
        first = at << level
        at = at[(first[:, 0] < tiles_x.shape[0]) & (first[:, 1] < tiles_y.shape[0]) & (first[:, 2] < tiles_x.shape[2])]
        some = tree_x[level][at[:, 0], at[:, 2]] | tree_y[level][at[:, 1], at[:, 2]]
        for i, j, k in at[~some] << level:
            empty[i : i + (1 << level), j : j + (1 << level)] += across[k : k + (1 << level)].sum()
        at = at[some]
        if level:
            at = (2 * at[:, None, :] + np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)])).reshape(-1, 3)
            if alike:
                at = at[at[:, 0] <= at[:, 1]]
    for part in range(0, len(at), TILES):
        i, j, k = at[part : part + TILES].T
        rows, others = (v[:, None] * ROWS + np.arange(ROWS) for v in (i, j))
        p, q = share(tiles_x[i, :, k] + 2, all_x[rows][:, :, None]), share(tiles_y[j, :, k] + 2, all_y[others][:, :, None])
        value = np.where((np.arange(COLUMNS) < across[k][:, None])[:, None, None, :], distance(p[:, :, None, :], q[:, None, :, :]), 0)
        np.add.at(sums, (rows[:, :, None], others[:, None, :]), value.sum(axis=3))
    zero_x, zero_y = share(np.int64(2), all_x), share(np.int64(2), all_y)
    sums += np.repeat(np.repeat(empty, ROWS, 0), ROWS, 1) * distance(zero_x[:, None], zero_y[None, :])
    if alike:
        later = np.arange(len(all_x))[:, None] // ROWS > np.arange(len(all_x))[None, :] // ROWS
        sums = np.where(later, sums.T, sums)
    return sums[:n, :m]


def _block(top: int):
    """Of one block of a language's terms and a pair of panels of its sources: sums for pairs, and each source's best terms."""

    def run(key, rows, groups):
        lang, _, first, second = (x.as_py() for x in key)
        terms = np.array(rows["term"].to_pylist(), object) if rows.num_rows else np.empty(0, object)
        out: dict = {"source": [], "part": [], "item": [], "value": []}
        if rows.num_rows and groups.num_rows:
            v = groups["v"][0].as_py()
            names, column = np.unique(terms, return_inverse=True)  # text of code points, which stand as their bytes do
            # Terms that many sources have come first, sources with many terms too: what is zero lies together.
            order = np.argsort(-np.bincount(column), kind="stable")
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            names, column = names[order], place[column]
            count, whole = rows["c"].to_numpy(), np.zeros(len(names), np.int64)
            whole[column] = rows["whole"].to_numpy()
            groups = groups.sort_by([("n", "descending"), ("source", "ascending")])
            told = list(zip(groups["source"].to_pylist(), groups["n"].to_pylist(), groups["panel"].to_pylist(), strict=True))
            sides = []
            for panel in sorted({first, second}):
                here = [(source, n) for source, n, of in told if of == panel]
                index = {source: i for i, (source, _) in enumerate(here)}
                row = np.array([index.get(s, -1) for s in rows["source"].to_pylist()])
                counts = np.zeros((len(here), len(names)), np.int64)
                counts[row[row >= 0], column[row >= 0]] = count[row >= 0]
                sides.append(([s for s, _ in here], counts, np.array([n + 2 * v for _, n in here], np.int64)))
            (a, x, total_x), (b, y, total_y) = sides[0], sides[-1]
            if a and b:
                # What a pair has beyond the price of columns that are zero in both of its rows.
                zero = distance(share(np.int64(2), total_x)[:, None], share(np.int64(2), total_y)[None, :])
                beyond = joint_sums(x, total_x, y, total_y) - len(names) * zero
                for i, j in zip(*np.nonzero(beyond), strict=True):
                    for source, item in {(a[i], b[j]), (b[j], a[i])} if first != second else {(a[i], b[j])}:
                        out["source"].append(source)
                        out["part"].append("pair")
                        out["item"].append(item)
                        out["value"].append(int(beyond[i, j]))
            if first == second:
                q = share(whole + 2, np.int64(groups["lang_n"][0].as_py() + 2 * v))
                place = np.argsort(np.argsort(names))
                for i, source in enumerate(a):
                    have = np.flatnonzero(x[i])
                    p = share(x[i, have] + 2, total_x[i])
                    have, p = have[p > q[have]], p[p > q[have]]
                    value = distance(p, q[have])
                    for k in np.lexsort((place[have], -value))[:top]:
                        out["source"].append(source)
                        out["part"].append("term")
                        out["item"].append(names[have[k]])
                        out["value"].append(int(value[k]))
        return pa.table({"lang": pa.array([lang] * len(out["source"]), pa.string()), **{c: pa.array(out[c], pa.int64() if c == "value" else pa.string()) for c in out}})

    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Divergence of each source's terms from those of the language's other sources, and the terms that set it apart.

    Kept terms of a language: those in at least ``least_docs`` of its documents; V of them. With count c
    of a term in a source (or the whole language) and n, the sum of c over kept terms, its share is
    p = 1 + floor(1e9 (c + 2) / (n + 2 V)); two shares lie floor((p - q)^2 / (p + q)) apart, all in whole numbers.
    Part ``pair``: item is each other source of the language, value the sum over all kept terms (0 if none).
    Part ``term``: item is each kept term with c > 0 and p above the language's q, value their distance, the first ``top``.
    Rank from 1 by value descending, item ascending by bytes.

    1. Workers count terms; sums are shuffled by (language, source, term).
    2. Terms of a language are dealt to blocks and sources to panels by hash, so a large language or source is no group of one task. A
       block's matrix of sources and terms is a quadtree; pairs of rows go through their trees together (``joint_sums``).
    3. What a pair has beyond V times the price of a zero column is summed over blocks; a pair that no block tells of has just that price.

    Null text, lang and source count as '', so repeated and null ids do not matter; a source without terms, or whose terms are all zero, is a group
    too; no rows give no rows. The result has a row for each two sources of a language: that is asked for, and grows with their square.
    """
    counts = checkpointed(term_counts(docs, text_col, lang_col, source_col))
    term = Window.partitionBy("lang", "term")
    told = counts.filter(F.col("term").isNotNull()).select("lang", "source", "term", "c", F.sum("c").over(term).alias("whole"), F.sum("d").over(term).alias("docs"), F.row_number().over(term.orderBy("source")).alias("nth"))
    kept = checkpointed(told.filter(F.col("docs") >= least_docs).drop("docs"))
    langs = kept.groupBy("lang").agg(F.sum("c").alias("lang_n"), F.sum((F.col("nth") == 1).cast("long")).alias("v"))
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = counts.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n", "lang_n", "v")))
    groups = checkpointed(groups)
    most = groups.groupBy("lang").agg(F.count("*").alias("g"), F.max("v").alias("v")).agg(F.max("g"), F.max("v")).first()
    panels, blocks = max(1, -(-(most[0] or 0) // PANEL)), max(1, -(-(most[1] or 0) // BLOCK_TERMS))

    def paired(df: DataFrame) -> DataFrame:
        """A row for each pair of panels that the row's own is in."""
        mine = df.withColumn("panel", F.pmod(F.xxhash64("source"), F.lit(panels)))
        return mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))).withColumns({"first": F.least("panel", "other"), "second": F.greatest("panel", "other")}).drop("other")

    by = ["lang", "block", "first", "second"]
    rows = paired(kept.select("lang", "source", "term", "c", "whole", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))).drop("panel")
    sides = paired(groups.filter(F.col("v") > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    found = rows.groupBy(*by).cogroup(sides.groupBy(*by)).applyInArrow(_block(top), "lang string, source string, part string, item string, value long")
    found = checkpointed(found)

    price = 1 + F.expr(f"{2 * UNIT}L div greatest(n + 2 * v, 1)")
    priced = groups.select("lang", "source", "v", price.alias("p"))
    pairs = priced.join(priced.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), "lang").filter(F.col("source") != F.col("item"))
    beyond = found.filter(F.col("part") == "pair").groupBy("lang", "source", "item").agg(F.sum("value").alias("beyond"))
    value = F.expr("v * ((p - q) * (p - q) div (p + q))") + F.coalesce(F.col("beyond"), F.lit(0))
    pairs = pairs.join(beyond, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.filter(F.col("part") == "term").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)
