"""Benchmark decontamination: pieces by the pigeonhole principle, Myers' bit-parallel distance."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from sinoplan.llm.common import checkpointed, in_bounded_batches, tidy

#: Edits allowed for each character of an item.
ERROR_RATE = 0.05
#: Characters of items searched for in one pass over the texts; more items take more passes.
BLOCK_CHARS = 4 << 20


def normalised(text: str) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length with their offsets; one of them has no edit."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, anchored: bool = False):
    """Distance of the pattern to the best substring that ends after each character of the text.

    ``anchored``: to the whole text so far instead. One step handles all rows of a column of the
    edit matrix as bits of an integer.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        same = masks.get(c, 0)
        vertical = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1 | anchored) & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        yield score


@dataclass
class Items:
    """The items of one pass with the automaton of their pieces."""

    rows: list[tuple[object, str, int]]

    def __post_init__(self):
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.rows):
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((n, offset))
        self.masks = [letter_masks(text) for _, text, _ in self.rows]
        self.back = [letter_masks(text[::-1]) for _, text, _ in self.rows]
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        if where:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Items, (self.rows,)

    def search(self, text: str):
        """Yield (item, distance, begin, end) for each item within its budget in a normalised text."""
        if not len(self.automaton):
            return
        windows: dict[int, list[list[int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for n, offset in found:
                _, item, budget = self.rows[n]
                begin = end + 1 - size - offset - budget
                stop = begin + len(item) + 2 * budget
                known = windows.setdefault(n, [])
                # Hits come by their end, so windows of an item nearly come in order.
                if known and begin <= known[-1][1]:
                    known[-1][1] = max(known[-1][1], stop)
                    known[-1][0] = min(known[-1][0], begin)
                else:
                    known.append([begin, stop])
        for n, spans in windows.items():
            item_id, item, budget = self.rows[n]
            best = (budget + 1, 0)
            for begin, stop in spans:
                begin = max(begin, 0)
                for j, distance in enumerate(myers(self.masks[n], len(item), text[begin:stop])):
                    if distance < best[0] or distance == best[0] and begin + j + 1 < best[1]:
                        best = (distance, begin + j + 1)
            if best[0] <= budget:
                distance, end = best
                tail = text[max(0, end - len(item) - budget) : end][::-1]
                sizes = (j + 1 for j, d in enumerate(myers(self.back[n], len(item), tail, anchored=True)) if d == distance)
                yield item_id, distance, end - next(sizes, 0), end


def _passes(benchmark: DataFrame, rate: float, item_id_col: str, item_col: str, block_chars: int):
    """How many passes a benchmark takes, and a function that sends the items of one to every task."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_col).cast("string").alias("item")).filter(F.col("item").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))

    def passed(block: int):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == block).orderBy("item_id", "item").collect()
        plain = [(r["item_id"], normalised(r["item"])) for r in rows]
        return benchmark.sparkSession.sparkContext.broadcast(Items([(i, t, int(rate * len(t))) for i, t in plain if t]))

    return blocks, passed


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Benchmark items that whole texts hold, up to an edit distance.

    Both sides are compared in lower case with white space collapsed. An item of m characters is in
    a text if some substring of it is within floor(``rate`` * m) edits. Each item is cut into one
    piece more than it may have edits; a piece that an occurrence holds unchanged is found by one
    Aho-Corasick pass, and the surroundings are verified. No occurrence within the budget is missed.

    The items of one pass, at most about ``block_chars`` characters, are sent to every task; a larger
    benchmark is searched for in several passes, one after another, each kept in the shared folder. Result: a row for each document and item found:
    id, item_id, distance, begin, end (characters of the normalised text; the earliest end of the
    least distance, then the latest begin). Texts and items that are null or blank match nothing;
    repeated documents give repeated rows, repeated items (same id and text) count once; null ids are
    kept; with an empty table on either side there are no rows. Columns besides those named are not
    read. Ids may be of any type.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_id_col].dataType), T.StructField("distance", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    kinds = [to_arrow_type(schema["item_id"].dataType), pa.int32(), pa.int64(), pa.int64()]
    blocks, passed = _passes(benchmark, rate, item_id_col, item_col, block_chars)
    texts = in_bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = None
    for block in range(blocks):
        shared = passed(block)

        def run(batches, shared=shared):
            for batch in batches:
                at, found = [], []
                for n, text in enumerate(pc.fill_null(batch.column(1), "")):
                    for hit in shared.value.search(normalised(text.as_py())):
                        at.append(n)
                        found.append(hit)
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names)

        hits = texts.mapInArrow(tidy(run), schema)
        if blocks > 1:  # one pass after another: the driver holds the items of one
            hits = checkpointed(hits)
            shared.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose text holds no benchmark item; they are kept as they stand.

    Each row is decided by its own text: ids may be null or repeated. Null and blank texts stay.
    """
    blocks, passed = _passes(benchmark, rate, "item_id", "text", block_chars)
    out = docs.withColumn("__searched", F.col("text").cast("string"))
    schema = out.schema

    for block in range(blocks):
        shared = passed(block)

        def run(batches, shared=shared):
            for batch in batches:
                texts = pc.fill_null(batch.column(batch.num_columns - 1), "")
                yield batch.filter(pa.array([next(shared.value.search(normalised(x.as_py())), None) is None for x in texts], pa.bool_()))

        out = in_bounded_batches(out).mapInArrow(tidy(run), schema)
        if blocks > 1:
            out = checkpointed(out)
            shared.destroy()
    return out.select(docs.columns)
