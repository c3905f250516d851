"""A Merkle manifest of a dataset: trees of SHA-256 over rows, proofs, and folding from copied hash states."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sinoplan.llm.common import checkpointed, in_bounded_batches, tidy

#: Children of a parent, and levels that one task builds: a block is FAN ** LEVELS neighbouring nodes.
FAN, LEVELS = 8, 4

#: Siblings to the left and to the right of a node at each level from it to the root, as hex text.
PATH = "array<struct<l: binary, r: binary>>"


class Subtree:
    """Some levels of a tree over neighbouring nodes, whose parents keep a copy of their hash state before each child."""

    def __init__(self, nodes: list[bytes], depth: int):
        self.levels, self.states = [nodes], []
        for _ in range(depth):
            kept, parents = [], []
            for i in range(0, len(nodes), FAN):
                state = sha256()
                for child in nodes[i : i + FAN]:
                    kept.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
            self.states.append(kept)
            self.levels.append(nodes := parents)

    def sides(self) -> list[list[tuple[bytes, bytes]]]:
        """Of each level's nodes, the siblings to the left and to the right, joined."""
        out = []
        for nodes in self.levels[:-1]:
            runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
            out.append([(b"".join(run[:j]), b"".join(run[j + 1 :])) for run in runs for j in range(len(run))])
        return out


def depth_of(count: int, levels: int) -> int:
    """Levels that a block has in a tree over ``count`` nodes: all of them, or those that end in one node."""
    if count > FAN**levels:
        return levels
    depth = 0
    while count > 1:
        count, depth = -(-count // FAN), depth + 1
    return depth


def resumed(state, replacement: bytes, right: bytes) -> bytes:
    """The parent's digest with another child in its slot: the kept state goes on with it and with what stands right of it."""
    state = state.copy()
    state.update(replacement)
    state.update(right)
    return state.hexdigest().encode()


def _field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(value), value)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", fields: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """A leaf for each row: the digest of its id, ``fields`` and text, and what a tampered row has instead.

    Each value counts as ``-`` if null, else as its bytes in UTF-8 after their count and a colon. Rows
    whose id's CRC-32 (as decimal text) is divisible by 3 are tampered with: A to Z in the text are
    lower-cased, null texts stay; a null id is left alone. Result: key (the group, so told that a null
    comes first and is met by equality), doc_id, leaf, changed (hex text; null for rows left alone).
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("doc_id", kind), T.StructField("leaf", T.BinaryType()), T.StructField("changed", T.BinaryType())])
    told = [F.col(f"`{c}`").cast("string").cast("binary").alias(f"f{n}") for n, c in enumerate((id_col, *fields, text_col))]
    group = F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("key")

    def run(batches):
        for batch in batches:
            leaf, changed = [], []
            for *head, text in zip(*(batch.column(n).to_pylist() for n in range(2, batch.num_columns)), strict=True):
                state = sha256(b"".join(map(_field, head)))
                tampered = head[0] is not None and zlib.crc32(head[0]) % 3 == 0
                if tampered:
                    other = state.copy()
                    other.update(_field(text if text is None else text.lower()))  # of bytes: A to Z alone
                    changed.append(other.hexdigest().encode())
                else:
                    changed.append(None)
                state.update(_field(text))
                leaf.append(state.hexdigest().encode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.binary()), pa.array(changed, pa.binary())], names=schema.names)

    return in_bounded_batches(docs).select(group, F.col(f"`{id_col}`").alias("id"), *told).mapInArrow(tidy(run), schema)


def _running(batches):
    """Rows of a sorted partition with its number and the copies that come before in it, by key."""
    part, last, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        before = []
        for key, copies in zip(batch.column("key").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            if key != last:
                last, total = key, 0
            before.append(total)
            total += copies
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64())], names=[*batch.schema.names, "part", "before"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, copies, ...) with the place ``start`` of the first of their copies in the key's order, and its total ``n``.

    A range shuffle deals the order out, however many rows a key has; a part's start is a running sum over
    one number a part and key.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    ordered = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    ordered = checkpointed(ordered.mapInArrow(tidy(_running), schema))  # where a range ends is drawn by sampling: it must stay
    parts = ordered.groupBy("key", "part").agg(F.sum("copies").alias("m"))
    key = Window.partitionBy("key")
    earlier = F.coalesce(F.sum("m").over(key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("key", "part", earlier.alias("earlier"), F.sum("m").over(key).alias("n"))
    return ordered.join(starts, ["key", "part"]).withColumn("start", F.col("earlier") + F.col("before")).drop("part", "before", "earlier")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` with the ``block`` that they stand in; many copies of one row have a row for each block."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("copies") - 1) / size)
    return rows.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _members(table: pa.Table, size: int):
    """The places in the block that each row holds, in order, with the row's number; the nodes at these places; the tree's total."""
    table = table.sort_by("start")
    at, n = table["block"][0].as_py() * size, table["n"][0].as_py()
    held = []
    for row, (start, copies) in enumerate(zip(table["start"].to_pylist(), table["copies"].to_pylist(), strict=True)):
        held += [row] * (min(start + copies, at + size) - max(start, at))
    nodes = table["leaf"].to_pylist()
    return table, held, [nodes[row] for row in held], n


def _tops(levels: int):
    size = FAN**levels

    def run(key, table):
        table, _, nodes, n = _members(table, size)
        tree = Subtree(nodes, depth_of(n, levels))
        return pa.table({"key": table["key"][:1], "start": table["block"][:1], "copies": pa.array([1], pa.int64()), "leaf": pa.array(tree.levels[-1], pa.binary()), "n": pa.array([-(-n // size)], pa.int64())})

    return run


def _paths(levels: int):
    """Each node's path: its siblings in the block, then those of the block's top."""
    size = FAN**levels

    def run(key, table, above):
        table, _, nodes, n = _members(table, size)
        sides, rest = Subtree(nodes, depth_of(n, levels)).sides(), above["path"][0].as_py()
        out = [[{"l": x, "r": y} for x, y in (level[i // FAN**k] for k, level in enumerate(sides))] + rest for i in range(len(nodes))]
        path = pa.array(out, pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())])))
        same = {c: pa.array([above[c][0].as_py()] * len(nodes), pa.binary()) for c in ("subroot", "root")}
        return pa.table({"key": table["key"], "start": table["start"], "path": path, **same})

    return run


def _folds(levels: int):
    """Each leaf's proof, and the root that its own or its tampered digest folds to."""
    size = FAN**levels

    def run(key, table, above):
        table, held, nodes, n = _members(table, size)
        tree = Subtree(nodes, depth_of(n, levels))
        sides, upper = tree.sides(), above["path"][0].as_py()
        # What stands left of this block at the levels above has one state for all of the block's leaves.
        resume = [(sha256(step["l"]), step["r"]) for step in upper]
        rest = b"".join(step["l"] + step["r"] for step in upper)
        changed, root, subroot = table["changed"].to_pylist(), above["root"][0].as_py(), above["subroot"][0].as_py()
        proofs, folded = [], []
        for i, row in enumerate(held):
            value, proof = changed[row] or nodes[i], sha256()
            for states, level in zip(tree.states, sides, strict=True):
                left, right = level[i]
                proof.update(left)
                proof.update(right)
                value = resumed(states[i], value, right)
                i //= FAN
            proof.update(rest)
            for state, right in resume:
                value = resumed(state, value, right)
            proofs.append(proof.hexdigest())
            folded.append(value)
        text = lambda values: pa.array([v.decode() for v in values], pa.string())
        columns = {"doc_id": table["doc_id"].take(pa.array(held, pa.int64())), "leaf": text(nodes), "subroot": text([subroot] * len(held)), "root": text([root] * len(held))}
        return pa.table(columns | {"proof_sha256": pa.array(proofs, pa.string()), "folded_root": text(folded), "verified": pa.array([v == root for v in folded], pa.bool_())})

    return run


def _climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every stage of ``levels`` levels, and the last: one node a key."""
    stages = []
    schema = "key string, start long, copies long, leaf binary, n long"
    while True:
        stages.append(nodes)
        nodes = checkpointed(in_blocks(nodes.select("key", "start", "copies", "leaf", "n"), FAN**levels).groupBy("key", "block").applyInArrow(_tops(levels), schema))
        if (nodes.agg(F.max("n")).first()[0] or 1) == 1:
            return stages, nodes


def _descended(stages: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """Paths of the nodes of the lowest of ``stages``, from those of the highest one's tops."""
    schema = f"key string, start long, path {PATH}, subroot binary, root binary"
    for nodes in reversed(stages):
        below = in_blocks(nodes.select("key", "start", "copies", "leaf", "n"), FAN**levels).groupBy("key", "block")
        above = checkpointed(below.cogroup(above.groupBy("key", "start")).applyInArrow(_paths(levels), schema))
    return above


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs and folded roots of ``leaves`` (key, doc_id, leaf, changed), as ``digests`` makes them.

    In each key leaves stand by doc_id (null first), equal ids by digest. While a level has several nodes, every
    8 consecutive ones (the last run may be shorter, even of one) become the digest of their hex texts
    put together; what remains is the subroot. Subroots, in the order of keys, give the root in the same way.

    1. Equal rows are counted, and stand as one row with many places until a block is made.
    2. Places are given by a range shuffle. A task builds ``levels`` levels over a block of 8 ** ``levels`` neighbouring nodes; its
       top is a node of the next stage. A key of any size is dealt out by block; the driver sees only the largest count.
    3. Going down, each block is told the siblings of its top at all levels above, 450 bytes a level.
    4. A block's parents keep a copy of their SHA-256 state before each child. A leaf is folded by
       resuming these with the replacement and the siblings to its right; the states of the levels above are made once a block.

    Result: doc_id, leaf, subroot, root, proof_sha256 (digest of all siblings, level by level from the leaf up, left to
    right; that of nothing where there are none), folded_root (from the changed leaf where there is one), verified
    (folded_root is the root). Repeated rows stand next to each other and have a row each; no rows give no rows.
    """
    leaves = checkpointed(leaves.groupBy("key", "doc_id", "leaf", "changed").agg(F.count("*").alias("copies")))
    rows = checkpointed(placed(leaves, ["doc_id", "leaf"]))
    stages, subroots = _climbed(rows, levels)
    tops = placed(subroots.select(F.lit("").alias("key"), F.col("key").alias("name"), F.lit(1).cast("long").alias("copies"), "leaf"), ["name"])
    tops = checkpointed(tops)
    upper, root = _climbed(tops, levels)
    above = root.select("key", "start", F.array().cast(PATH).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("leaf").alias("root"))
    above = _descended(upper, above, levels)
    # A subroot is a node of the upper tree and the top of its key's.
    above = tops.select(F.col("start"), "name", F.col("leaf").alias("own")).join(above.drop("subroot", "key"), "start")
    above = above.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("start"), "path", F.col("own").alias("subroot"), "root")
    above = _descended(stages[1:], above, levels)
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])
    return in_blocks(rows, FAN**levels).groupBy("key", "block").cogroup(above.groupBy("key", "start")).applyInArrow(_folds(levels), schema)
