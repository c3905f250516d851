"""Token counts: whole texts through a tokenizer library, lengths only."""

from __future__ import annotations

import os
import re
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sinoplan.llm.common import in_bounded_batches, tidy, tool

#: A safe boundary lies before a run of white space that follows something else: the pre-tokenizer
#: never joins what stands left of it to what stands right of it, so the pieces can be encoded
#: apart. Python's class of white space holds all of Unicode's, so no cut falls inside a run.
PIECES = re.compile(r"\s*\S+|\s+").findall

#: Marks that may be cut off the end of a piece if a letter or digit stands before them; that is a
#: safe boundary too.
MARKS = ".,;:!?"

#: Bytes of unseen pieces handed to the library in one call.
BATCH_BYTES = 1 << 18
#: Bytes of text looked at together in a worker.
CHUNK_BYTES = 1 << 20
#: Bytes of pieces whose counts a worker remembers.
MEMORY_BYTES = 80 << 20


class LibraryCounter:
    """Counts tokens per piece by batch calls to the library, remembering pieces seen before."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known: dict[str, int] = {}
        self.held = 0
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            # Its white space handling spans words, so these texts go whole.
            self.pieces = lambda text: [text]
            self.lengths = lambda batch: map(len, model.encode(batch, num_threads=1))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.pieces = PIECES
            self.lengths = lambda batch: map(len, model.encode_batch(batch, add_special_tokens=False))

    def learn(self, unseen: set[str]) -> None:
        """Have the library count the unseen pieces, in batches of equal bytes."""
        parts: dict[str, tuple[str, str]] = {}
        if self.pieces is PIECES:
            for piece in unseen:
                stem = piece.rstrip(MARKS)
                if len(stem) < len(piece) and stem[-1:].isalnum():
                    parts[piece] = stem, piece[len(stem) :]
        known = self.known
        asked = {x for x in chain(unseen.difference(parts), chain.from_iterable(parts.values())) if x not in known}
        batch, weight = [], 0
        for piece in chain(asked, [None]):
            if piece is not None:
                batch.append(piece)
                weight += len(piece.encode())
            if batch and (piece is None or weight >= BATCH_BYTES):
                known.update(zip(batch, self.lengths(batch)))
                batch, weight = [], 0
        for piece, (stem, marks) in parts.items():
            known[piece] = known[stem] + known[marks]
        self.held += sum(map(len, asked)) + sum(map(len, parts)) + 150 * (len(asked) + len(parts))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        split = [self.pieces(text) for text in texts]
        if self.held > MEMORY_BYTES:
            self.known.clear()
            self.held = 0
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        look = self.known.__getitem__
        return [sum(map(look, pieces)) for pieces in split]


def _counter(path: str) -> LibraryCounter:
    return tool(("counter", path), lambda: LibraryCounter(path))


def chunks(texts: list[str], most: int = CHUNK_BYTES):
    """Consecutive runs of texts of about ``most`` characters; a longer text is a run of its own."""
    run, weight = [], 0
    for text in texts:
        if run and weight + len(text) > most:
            yield run
            run, weight = [], 0
        run.append(text)
        weight += len(text)
    if run:
        yield run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text as the library for ``tokenizer`` gives them.

    ``tokenizer`` is the file of a public vocabulary, present on every machine: ``.json`` for
    tokenizers, ``.model`` for sentencepiece. No begin, end or other special token is added; the
    string of a special token inside a text counts as the library's default has it. Texts are cut
    at safe boundaries, so that the unseen pieces of many texts fill batches of equal bytes, and a
    very long text needs no more memory than its pieces; only lengths leave the worker.

    Result: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``). A null text counts as
    empty: 0 bytes, 0 tokens. Rows are kept as they are: repeated rows give repeated results, a null
    id stays null, an empty table gives no rows, and columns besides the two named are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = _counter(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            counts: list[int] = []
            for part in chunks(texts.to_pylist()):
                counts += counter.count(part)
            n_tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), n_tokens, pc.greater(n_tokens, limit)], names=schema.names)

    return in_bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), schema)
