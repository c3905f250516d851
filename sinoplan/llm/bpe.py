"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import sys
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sinoplan.llm.common import in_bounded_batches, tidy, tool
from sinoplan.llm.tokens import MARKS, PIECES, chunks

#: The pre-tokenizer's pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes of pieces whose ids a worker remembers; the longest piece it remembers.
MEMORY_BYTES, LONG_PIECE = 48 << 20, 256
#: Entries of the table of pairs already judged.
PAIRS = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file.

    Bytes that print stand for themselves; the others take the characters from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + len(shown) - len(plain))
    return {c: b for b, c in shown.items()}


assert array("I").itemsize == 4 and sys.byteorder == "little", "ids are written as little-endian 32-bit integers"


class BytePairCodec:
    """Exact merges in time linear in the text.

    A token sequence is the one that the merges give if and only if each two neighbours are
    compatible: cutting both back along the way they were merged, no merge across their boundary
    would have come first. The encoder takes the longest token at each place (found in the trie of
    an Aho-Corasick automaton, and no two steps on start at the same place), and where it is not compatible with the one before, tries shorter ones and
    steps back; a set of places that lead nowhere keeps it from trying one twice.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        alphabet = byte_alphabet()
        model, added = told["model"], told.get("added_tokens", [])
        special = {x["content"]: x["id"] for x in added}
        self.special = special
        self.split_special = regex.compile("|".join(f"({regex.escape(x)})" for x in special)).split if special else None
        self.pretokens = regex.compile(PATTERN).findall
        raw = {i: bytes(map(alphabet.__getitem__, t)) for t, i in model["vocab"].items() if t not in special}
        size = 1 + max([*raw, *special.values()])
        ids = {b: i for i, b in raw.items()}
        # The offset table: where the bytes of each id begin and end in one buffer.
        parts = [raw.get(i, b"") for i in range(size)]
        for text, i in special.items():
            parts[i] = text.encode()
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.length = [len(p) for p in parts]
        # Each merge: the pair, its rank, and what it makes; the way back splits a token in its pair.
        self.merge: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        pairs = (m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"])
        for n, (a, b) in enumerate(pairs):
            left, right = (ids[bytes(map(alphabet.__getitem__, x))] for x in (a, b))
            made = ids[parts[left] + parts[right]]
            self.merge.setdefault((left, right), n)
            if self.rank[made] < 0:
                self.rank[made], self.halves[made] = n, (left, right)
        # Tokens as text with a character a byte, which is what the automaton reads.
        self.automaton = ahocorasick.Automaton()
        usable = [i for i in raw if self.rank[i] >= 0 or len(raw[i]) == 1]
        for i in usable:
            self.automaton.add_word(raw[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.ids = {raw[i].decode("latin-1"): i for i in usable}
        self.widest = max(map(len, self.ids))
        # The longest proper prefix of each token that is a token.
        self.shorter = [-1] * size
        known = {raw[i]: i for i in usable}
        for i in usable:
            self.shorter[i] = next((known[raw[i][:n]] for n in range(len(raw[i]) - 1, 0, -1) if raw[i][:n] in known), -1)
        self.judged: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` as neighbours."""
        a, b, bound, rank, merge = left, right, len(self.merge) + 1, self.rank, self.merge
        while True:
            if merge.get((a, b), bound) < bound:
                verdict = False
                break
            if rank[a] < 0 and rank[b] < 0:
                verdict = True
                break
            # Undo whichever of the two was merged later; a merge across the boundary had to come
            # before it, or, for the right one, at the latest together with it.
            if rank[a] > rank[b]:
                bound = rank[a]
                a = self.halves[a][1]
            else:
                bound = rank[b] + 1
                b = self.halves[b][0]
        if len(self.judged) > PAIRS:
            self.judged.clear()
        self.judged[left << 32 | right] = verdict
        return verdict

    def longest(self, word: str, at: int) -> int:
        """The longest token that starts at a place: as far as the automaton's trie goes, and back."""
        ids, n = self.ids, self.automaton.longest_prefix(rest := word[at : at + self.widest])
        while (token := ids.get(rest[:n])) is None:
            n -= 1
        return token

    def merge_bytes(self, word: str) -> list[int]:
        """Ids of one pre-token, given with a character a byte."""
        size, at, token, before, shut, out = len(word), 0, self.longest(word, 0), -1, set(), []
        length, judged, compatible, shorter, longest = self.length, self.judged.get, self.compatible, self.shorter, self.longest
        while True:
            end = at + length[token]
            if end not in shut and (before < 0 or (compatible(before, token) if (fits := judged(before << 32 | token)) is None else fits)):
                out.append(token)
                if end == size:
                    return out
                at, before = end, token
                token = longest(word, at)
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                shut.add(at)
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1

    def encode_piece(self, piece: str) -> bytes:
        stem = piece.rstrip(MARKS)
        if piece[0] == " " and stem[1:].isalpha():  # as most pieces are: a space, letters, marks
            words = (stem, piece[len(stem) :]) if len(stem) < len(piece) else (stem,)
        else:
            words = self.pretokens(piece)
        out = []
        for word in words:
            ids = self.known.get(word)
            if ids is None:
                ids = array("I", self.merge_bytes(word.encode().decode("latin-1"))).tobytes()
                self.remember(word, ids)
            out.append(ids)
        return b"".join(out)

    def remember(self, text: str, ids: bytes) -> None:
        if len(text) <= LONG_PIECE:
            if self.held > MEMORY_BYTES:
                self.known.clear()
                self.held = 0
            self.known[text] = ids
            self.held += 190 + len(text) + len(ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_special is not None and any(x in text for x in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.encode_plain(x) for x in self.split_special(text) if x)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        pieces = PIECES(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            for n in [n for n, ids in enumerate(found) if ids is None]:
                piece = pieces[n]
                found[n] = ids = self.known.get(piece) or self.encode_piece(piece)
                if piece not in self.known:
                    self.remember(piece, ids)
        return b"".join(found)

    def decode_bytes(self, ids: bytes) -> bytes:
        """The bytes of encoded ids, copied through the offset table."""
        out = []
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), 1 << 18):
            some = every[at : at + (1 << 18)]
            begin, sizes = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(sizes)
            where = np.repeat(begin - (ends - sizes), sizes)
            where += np.arange(len(where))
            out.append(self.buffer[where].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _codec(path: str) -> BytePairCodec:
    return tool(("codec", path), lambda: BytePairCodec(path))


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encode every whole text with a byte-level BPE vocabulary and decode it again.

    ``tokenizer`` is the JSON file of the vocabulary, present on every machine. Special tokens are
    not added; their strings inside a text become their ids, as the library's default has it.

    Result: id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded text; with
    ``digest`` the SHA-256 of ids and decoded UTF-8 in their place (ids_sha256, decoded_sha256,
    lowercase hex), taken in the worker so that neither travels. A null text counts as empty. Rows
    are kept as they are: repeated rows give repeated results, a null id stays null, an empty table
    gives no rows, and columns besides the two named are not read.
    """
    outs = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.BinaryType()), ("decoded", T.StringType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), *(T.StructField(*x) for x in outs)])
    kinds = [pa.string(), pa.string()] if digest else [pa.binary(), pa.string()]

    def run(batches):
        codec = _codec(tokenizer)
        for batch in batches:
            first = 0
            texts = pc.fill_null(batch.column(1), "")
            for part in chunks(texts.to_pylist()):
                counts, left, right = [], [], []
                for text in part:
                    ids = codec.encode(text)
                    counts.append(len(ids) // 4)
                    if digest:
                        left.append(hashlib.sha256(ids).hexdigest())
                        right.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    else:
                        left.append(ids)
                        right.append(codec.decode(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(counts, pa.int64()), pa.array(left, kinds[0]), pa.array(right, kinds[1])], names=schema.names)
                first += len(part)

    return in_bounded_batches(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), schema)
