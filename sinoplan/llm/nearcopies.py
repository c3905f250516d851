"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinoplan.llm.common import checkpointed, in_bounded_batches, tidy, tool
from sinoplan.llm.components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Minimum hashes of a text, rows of a band, and bands.
HASHES, BAND_ROWS, BANDS = 192, 8, 80
#: What a task that verifies may hold: bytes of n-gram sets of one block, and texts of one block.
BLOCK_BYTES, BLOCK_TEXTS = 24 << 20, 4096
#: Words that a worker remembers the hash of.
KNOWN_WORDS = 120_000

WORDS = re.compile(r"\w+")


def recall(similarity: float, rows: int = BAND_ROWS, bands: int = BANDS) -> float:
    """Chance that two texts of a similarity share a band (bands taken as independent)."""
    return 1 - (1 - similarity**rows) ** bands


class Shingler:
    """Sets of hashed word n-grams, and their minimum hashes."""

    def __init__(self, words: int = SHINGLE_WORDS):
        self.words = words
        self.known: dict[str, int] = {}
        draw = np.random.default_rng(8)
        self.factor = draw.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, HASHES, dtype=np.uint64)
        # Bands are random subsets of the hashes, so that few hashes make many bands.
        self.bands = np.array([draw.choice(HASHES, BAND_ROWS, replace=False) for _ in range(BANDS)])
        self.mixer = draw.integers(1, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)

    def shingles(self, text: str) -> np.ndarray:
        """Distinct hashes of all runs of five words, sorted; of all words together if they are fewer."""
        words = WORDS.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(codes))
        out = np.zeros(len(codes) - n + 1, np.uint64)
        for j in range(n):
            out = (out ^ codes[j : len(codes) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(shingles), 512):
            part = shingles[at : at + 512, None] * self.factor
            part += self.shift
            # Multiply and shift: the high half of the product modulo 2^64.
            least = np.minimum(least, part.view(np.uint32)[:, 1::2].min(axis=0))
        picked = least[self.bands].astype(np.uint64)
        mixed = (picked + np.uint64(1)) * self.mixer
        mixed ^= mixed >> np.uint64(31)
        return (mixed * np.uint64(0xD6E8FEB86659FD93)).sum(axis=1, dtype=np.uint64).view(np.int64)


def shingler(words: int) -> Shingler:
    return tool(("shingler", words), lambda: Shingler(words))


def digest_of(shingles: np.ndarray, text: str) -> bytes:
    """A name for a set; texts without a word are told apart by their characters."""
    return hashlib.blake2b(shingles.tobytes() if len(shingles) else b"\0" + text.encode(), digest_size=16).digest()


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """Of each row: id, node (the name of its set), size, bands (none for a text without a word), columns after the text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("node", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("bands", T.BinaryType()), *docs.schema.fields[2:]])

    def run(batches):
        made = shingler(words)
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for text in pc.fill_null(batch.column(1), ""):
                text = text.as_py()
                found = made.shingles(text)
                nodes.append(digest_of(found, text))
                sizes.append(len(found))
                bands.append(made.band_hashes(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.binary()), *batch.columns[2:]], names=schema.names)

    return in_bounded_batches(docs).mapInArrow(tidy(run), schema)


def _unpack(nodes: DataFrame) -> DataFrame:
    """A row for each node and band."""

    def run(batches):
        for batch in batches:
            packed = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            for at in range(0, len(packed), 512):
                part = packed[at : at + 512]
                if part:
                    owner = np.repeat(np.arange(at, at + len(part)), BANDS)
                    bucket = np.concatenate(part) ^ (np.tile(np.arange(BANDS), len(part)) * 0x9E3779B97F4A7)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(bucket)], names=["node", "bucket"])

    return nodes.select("node", "bands").filter(F.col("bands").isNotNull()).mapInArrow(tidy(run), "node binary, bucket long")


def _verify(keys, table: pa.Table, similarity: float) -> pa.Table:
    """Links among the sets of one block, or between those of two: counts and a forest.

    An inverted index of the n-grams gives each set's overlaps with all others at once; no pair is
    written out.
    """
    left, right = keys[1].as_py(), keys[2].as_py()
    block = table["block"].to_numpy()
    order = np.argsort(block != left, kind="stable")
    table, block = table.take(pa.array(order)), block[order]
    # A repeated row of the table brings its set twice.
    once = np.sort(np.unique(np.array(table["node"].to_pylist(), dtype=object), return_index=True)[1])
    table, block = table.take(pa.array(once)), block[once]
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["shingles"]]
    copies = table["copies"].to_numpy()
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(n), sizes)
    by_code = np.argsort(code, kind="stable")
    posting = owner[by_code]
    begin = np.concatenate([[0], np.cumsum(np.bincount(code))])
    first = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(n)
    links = np.zeros(n, np.int64)
    mine = n if left == right else int((block == left).sum())
    for i in range(mine):
        codes = code[first[i] : first[i + 1]]
        a, size = begin[codes], begin[codes + 1] - begin[codes]
        ends = np.cumsum(size)
        where = np.repeat(a - (ends - size), size) + np.arange(ends[-1])
        shared = np.bincount(posting[where], minlength=n)
        linked = shared >= similarity * (sizes[i] + sizes - shared) - 1e-9
        linked[: i + 1 if left == right else mine] = False
        if linked.any():
            links[i] += copies[linked].sum()
            links[linked] += copies[i]
            met = np.unique(root[linked])
            least = min(root[i], met[0])
            if root[i] != least or met[-1] != least:  # else all are in one class already
                root[np.isin(root, np.append(met, root[i]))] = least
    return pa.table([table["node"], table["node"].take(pa.array(root)), pa.array(links)], names=["node", "root", "links"])


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Near-duplicate classes and links of all rows.

    A text's set holds its runs of ``words`` words (lower case, ``\\w+``); a text of fewer words has the
    one run of all of them. Two rows are linked if the Jaccard similarity of their sets is at least
    ``similarity``, or if they have no word and equal texts.

    1. Rows with equal sets become one node with a count of copies.
    2. 80 bands of 8 minimum hashes: two texts of similarity 0.8 share one with probability
       1 - 4e-7. The shuffle on band hashes gives each bucket's smallest node, and the edges to it
       give groups of candidates; how large a bucket is does not matter.
    3. The full sets of the nodes of a group meet in one task, or, if they are many, in tasks for
       each two blocks of bounded size, where all overlaps are counted by an inverted index.
       Links are summed there; no list of pairs is written, whatever the size of a group.

    Result: a row for each row of the input: id, class_id (the smallest id of all rows that links
    connect with it), n_links (other rows linked with it, copies included), copies (rows with an
    equal set, itself included). Null texts count as empty; rows with a null id take part, and a
    class of null ids alone has a null class_id. Repeated rows are copies. An empty table gives no
    rows. Columns besides the two named are not read.
    """
    return _classified(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), words, similarity).drop("class", "key")


def _classified(texts: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``jaccard_join`` of (doc_id, text), with names of each row's class and of the row itself (of its id and text)."""
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    signed = checkpointed(_signatures(texts, words))
    least = (F.min("doc_id").alias("first_id"), F.min("key").alias("first_key"))
    nodes = checkpointed(signed.groupBy("node").agg(*least, F.count("*").alias("copies"), F.max("size").alias("size"), F.max("bands").alias("bands")))
    rows = _unpack(nodes)
    centres = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter(F.col("n") > 1).drop("n")
    edges = rows.join(centres, "bucket").filter(F.col("node") != F.col("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    groups = checkpointed(connected_components(edges).withColumnRenamed("root", "part"))
    active = groups.join(nodes.drop("bands"), "node")
    weight = active.groupBy("part").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    blocks = F.ceil(F.greatest(F.col("total") * 8 / BLOCK_BYTES, F.col("n") / BLOCK_TEXTS)).cast("int")
    active = active.join(weight.select("part", blocks.alias("blocks")), "part")
    found = _fetch(texts, active, words).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = found.select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "shingles")
    result = checkpointed(found.groupBy("part", "i", "j").applyInArrow(lambda key, table: _verify(key, table, similarity), "node binary, root binary, links long"))
    linked = connected_components(result.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = result.groupBy("node").agg(F.sum("links").alias("links"))
    first = linked.join(nodes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = linked.join(first, "root").select("node", "class_id", F.col("root").alias("class"))
    told = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(classes, "node", "left")
    told = told.select("node", "copies", F.coalesce("class", "node").alias("class"), F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "node", "key").join(told, "node").select("doc_id", "class_id", "n_links", "copies", "class", "key")


def _fetch(texts: DataFrame, active: DataFrame, words: int) -> DataFrame:
    """The full set of each active node, from the text of one of its rows."""
    wanted = active.select(F.col("first_key").alias("key"), "node", "part", "copies", "blocks")
    met = texts.join(wanted, "key").select("text", "node", "part", "copies", "blocks")
    schema = "node binary, part binary, copies long, blocks int, shingles binary"

    def run(batches):
        made, seen = shingler(words), set()
        for batch in batches:
            keep, sets = [], []
            for n, (text, node) in enumerate(zip(pc.fill_null(batch.column(0), ""), batch.column(1), strict=True)):
                if (name := node.as_py()) in seen:  # a row that is repeated
                    continue
                found = made.shingles(text.as_py())
                # Rows told apart by 64 bits alone: another text may have the same name.
                if digest_of(found, text.as_py()) == name:
                    seen.add(name)
                    keep.append(n)
                    sets.append(found.tobytes())
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (1, 2, 3, 4)), pa.array(sets, pa.binary())], names=["node", "part", "copies", "blocks", "shingles"])

    return met.mapInArrow(tidy(run), schema)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class as it stands: that of the smallest id, null ids last.

    Rows are told apart by their id and text, so several texts under one id, or under none, are
    decided each by its own class; of rows equal in both one is kept.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.col("text").cast("string")))
    classes = _classified(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    kept = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("__key"))
    return keyed.join(kept.select("__key"), "__key", "left_semi").dropDuplicates(["__key", "doc_id", "text"]).select(docs.columns)
