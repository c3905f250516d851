"""Exact repeats of long byte strings: a sharded, enhanced suffix array scanned for maximal repeats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinoplan.llm.common import in_bounded_batches, returning, tidy

#: Length of the strings that count as repeats, and of the grams that lead to them.
REPEAT, GRAM = 100, 48
#: Starts of strings in one region at most: as many as one gram can be the least of.
MOST_STARTS = REPEAT - GRAM + 1
#: Bytes that a group may hold: of texts, of anchors with their owners, and of suffixes laid out for sorting.
TEXT_BYTES, ANCHOR_BYTES, SUFFIX_BYTES = 8 << 20, 8 << 20, 12 << 20
#: Bytes of text hashed together; longer texts are cut into runs of as many starts.
CHUNK_BYTES = 1 << 19

_ANCHOR = np.dtype([("gram", "<u8"), ("region", "<u8"), ("doc", "<u2"), ("start", "<u4"), ("n", "u1")])
_OWNER = np.dtype([("order", "<i8"), ("row", "<i8")])
_SPAN = np.dtype([("order", "<i8"), ("row", "<i8"), ("start", "<u4"), ("size", "<u4")])
_ASK = np.dtype([("gram", "<u8"), ("order", "<i8"), ("row", "<i8"), ("start", "<u4"), ("n", "u1"), ("parts", "<u2")])
_SUFFIXES = np.dtype([("gram", "<u8"), ("order", "<i8"), ("row", "<i8"), ("start", "<u4"), ("n", "u1"), ("before", "<i2")])

_STEP = 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each place on, by doubling."""
    whole, whole_size = None, 0
    part, size, left = _mixed(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, width
    while left:
        if left & 1:
            if whole is None:
                whole, whole_size = part, size
            else:
                m = min(len(whole), len(part) - whole_size)
                whole = whole[:m] * np.uint64(pow(_STEP, size, 1 << 64)) + part[whole_size : whole_size + m]
                whole_size += size
        left >>= 1
        if left:
            m = len(part) - size
            part = part[:m] * np.uint64(pow(_STEP, size, 1 << 64)) + part[size : size + m]
            size *= 2
    return _mixed(whole)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    part, size = values, 1
    while size * 2 <= width:
        part = np.minimum(part[: len(part) - size], part[size:])
        size *= 2
    m = len(values) - width + 1
    return np.minimum(part[:m], part[width - size : width - size + m])


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of texts, and which of them repeat a string within themselves.

    A string's anchor is the least hash of the grams in it; it depends on the string alone, so equal
    strings have equal anchors wherever they stand. Neighbouring starts with the same anchor make a
    region: ``start`` and ``n`` of the strings, and a hash of all the bytes they cover.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < REPEAT:
        return np.empty(0, _ANCHOR), np.empty(0, bool)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    grams = gram_hashes(data, GRAM)
    width = REPEAT - GRAM + 1
    least = window_minima(grams, width)
    inside = doc[: len(least)] == doc[REPEAT - 1 :]
    change = np.flatnonzero((least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])) + 1
    begin = np.concatenate([[0], change])
    count = np.diff(np.concatenate([begin, [len(least)]]))
    keep = inside[begin]
    begin, count = begin[keep], count[keep]
    if (count > MOST_STARTS).any():  # a text that repeats itself at once: more regions, same anchor
        pieces = -(-count // MOST_STARTS)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(np.repeat(count, pieces) - at * MOST_STARTS, MOST_STARTS)
        begin = np.repeat(begin, pieces) + at * MOST_STARTS
    out = np.empty(len(begin), _ANCHOR)
    value = least[begin]
    out["gram"], out["doc"], out["n"] = value, doc[begin], count
    out["start"] = begin - first[doc[begin]]
    last = begin + count + REPEAT - 1 - GRAM
    told = _mixed(grams[begin]) + np.uint64(3) * _mixed(grams[begin + GRAM] if len(grams) > GRAM else grams[begin])
    told = _mixed(told) + np.uint64(5) * _mixed(grams[np.maximum(last - GRAM, begin)]) + np.uint64(7) * _mixed(grams[last])
    out["region"] = _mixed(told * np.uint64(256) + count.astype(np.uint64) + told)
    # Two places of the least gram: strings of the region may equal each other.
    again = np.zeros(len(begin), bool)
    reach = np.arange(width)
    for at in range(0, len(begin), 8192):
        part = slice(at, at + 8192)
        left = (grams[begin[part, None] + reach] == value[part, None]).argmax(axis=1)
        right = begin[part] + count[part] - 1
        back = (grams[right[:, None] + reach[::-1]] == value[part, None]).argmax(axis=1)
        again[part] = begin[part] + left != right + width - 1 - back
    return out, again


def _packed(shards: np.ndarray, n_shards: int, rows: np.ndarray):
    """(shard, rows of it) for those that have rows."""
    order = np.argsort(shards, kind="stable")
    ends = np.searchsorted(shards[order], np.arange(n_shards + 1))
    for s in np.unique(shards):
        yield int(s), rows[order[ends[s] : ends[s + 1]]]


def _batch(columns: dict) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "bucket": pa.int32(), "ask": pa.bool_(), "settled": pa.bool_(), "blob": pa.binary(), "more": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


def _settle(out: dict, spans: np.ndarray, n_shards: int, n_buckets: int) -> None:
    """Send spans that need no further look on by the bucket of their text, so that many copies do not meet."""
    for shard, some in _packed(np.mod(spans["row"], n_buckets) % n_shards, n_shards, spans):
        out["shard"].append(shard)
        out["settled"].append(True)
        out["blob"].append(some.tobytes())
        out["more"].append(b"")


def _settled(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), _SPAN) for x, told in zip(table["blob"], table["settled"], strict=True) if told.as_py()]


def _anchor_blobs(n_shards: int, n_buckets: int):
    """Stage 1: the anchors of each run of texts, one blob for each shard of grams.

    Of regions that are equal within the run only the first travels; the others are covered already.
    A long text comes in pieces that overlap by all but one byte of a string, so that each string starts
    in one of them; a region cut there is two with one anchor, and the memory does not grow with the text.
    """

    def flush(parts, owners):
        rows, names = np.concatenate(parts), np.array(owners, _OWNER)
        order, row = names["order"][rows["doc"]], names["row"][rows["doc"]]
        by = np.lexsort((row, rows["start"], order, rows["region"], rows["gram"]))
        rows, order, row = rows[by], order[by], row[by]
        unlike = lambda *xs: np.append(True, np.any([x[1:] != x[:-1] for x in xs], axis=0))[: len(rows)]
        region = unlike(rows["gram"], rows["region"])
        once = region | unlike(order, rows["start"], row)
        head = np.flatnonzero(region)[np.cumsum(region) - 1]
        later = (order != order[head]) | (rows["start"] != rows["start"][head])
        told = once & later
        spans = np.empty(int(told.sum()), _SPAN)
        spans["order"], spans["row"], spans["start"] = order[told], row[told], rows["start"][told]
        spans["size"] = (rows["n"][told] & 127).astype(np.int64) + REPEAT - 1
        rows = rows[once & ~later]
        out = {"shard": [], "settled": [], "blob": [], "more": []}
        for shard, part in _packed((rows["gram"] % np.uint64(n_shards)).astype(np.int64), n_shards, rows):
            used, part["doc"] = np.unique(part["doc"], return_inverse=True)
            out["shard"].append(shard)
            out["settled"].append(False)
            out["blob"].append(part.tobytes())
            out["more"].append(names[used].tobytes())
        _settle(out, spans, n_shards, n_buckets)
        return _batch(out)

    def run(batches):
        parts, owners, chunk, held, size = [], [], [], 0, 0
        for batch in batches:
            for order, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                whole = text.as_py()
                for at in range(0, max(len(whole), 1), CHUNK_BYTES):
                    owners.append((-(1 << 63) if order is None else order, row))
                    chunk.append((at, whole[at : at + CHUNK_BYTES + REPEAT - 1]))
                    held += len(chunk[-1][1])
                    size += len(chunk[-1][1])
                    if held >= CHUNK_BYTES or len(owners) >= 60_000:
                        parts.append(_marked(chunk, len(owners) - len(chunk)))
                        chunk, held = [], 0
                    if size >= 32 * CHUNK_BYTES or len(owners) >= 60_000:
                        if chunk:
                            parts.append(_marked(chunk, len(owners) - len(chunk)))
                        yield flush(parts, owners)
                        parts, owners, chunk, held, size = [], [], [], 0, 0
        if chunk:
            parts.append(_marked(chunk, len(owners) - len(chunk)))
        if parts:
            yield flush(parts, owners)

    return run


def _marked(chunk: list[tuple[int, bytes]], first: int) -> np.ndarray:
    """The anchors of pieces (where a piece starts in its text, its bytes), places counted in the texts."""
    rows, again = anchors_of([piece for _, piece in chunk])
    rows["start"] += np.array([at for at, _ in chunk], np.uint32)[rows["doc"]]
    rows["doc"] += np.uint16(first)
    rows["n"] |= again.astype(np.uint8) << 7
    return rows


def _judge(n_buckets: int):
    """Stage 2: in a shard of grams, copies of whole regions, and what must be looked at closer.

    Of equal regions all but the first are covered in full. Regions that share an anchor but are not
    equal, or that repeat within themselves, have their firsts' bytes asked for.
    """

    def run(key, table):
        parts, order, row = [np.empty(0, _ANCHOR)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for blob, more, told in zip(table["blob"], table["more"], table["settled"], strict=True):
            if not told.as_py():
                part, names = np.frombuffer(blob.as_py(), _ANCHOR), np.frombuffer(more.as_py(), _OWNER)
                parts.append(part)
                order.append(names["order"][part["doc"]])
                row.append(names["row"][part["doc"]])
        settled = _settled(table)
        del table
        part, order, row = np.concatenate(parts), np.concatenate(order), np.concatenate(row)
        again, n = part["n"] >> 7, (part["n"] & 127).astype(np.int64)
        by = np.lexsort((part["start"], order, part["region"], part["gram"]))
        part, order, row, again, n = part[by], order[by], row[by], again[by], n[by]
        new = lambda x: np.append(True, x[1:] != x[:-1])[: len(x)]
        new_gram = new(part["gram"])
        new_region = new_gram | new(part["region"])
        head = np.flatnonzero(new_region)
        of = np.cumsum(new_region) - 1
        later = (order != order[head][of]) | (part["start"] != part["start"][head][of])
        spans = np.empty(int(later.sum()), _SPAN)
        spans["order"], spans["row"], spans["start"], spans["size"] = order[later], row[later], part["start"][later], n[later] + REPEAT - 1
        spans = np.concatenate([spans, *settled])
        gram_of = np.cumsum(new_gram[head]) - 1
        regions = np.bincount(gram_of)[gram_of]
        # A region that repeats within itself does so in each of its copies; the first stands for all.
        asked = (regions > 1) | (again[head] == 1)
        pick = head[asked]
        asks = np.empty(len(pick), _ASK)
        for name, values in (("gram", part["gram"]), ("order", order), ("row", row), ("start", part["start"]), ("n", n)):
            asks[name] = values[pick]
        asks["parts"] = np.minimum(65535, 1 + regions[asked] * (MOST_STARTS * (REPEAT + MOST_STARTS)) // SUFFIX_BYTES)
        out = {"bucket": [], "ask": [], "blob": []}
        for ask, rows in ((False, spans), (True, asks)):
            for bucket, some in _packed(np.mod(rows["row"], n_buckets), n_buckets, rows):
                out["bucket"].append(bucket)
                out["ask"].append(ask)
                out["blob"].append(some.tobytes())
        return pa.Table.from_batches([_batch(out)])

    return run


def _orders(texts: pa.Table) -> np.ndarray:
    """Ids as numbers that sort; a null id is smaller than all."""
    return pc.fill_null(texts["doc_id"], -(1 << 63)).to_numpy()


def _cut(n_shards: int, n_buckets: int):
    """Stage 3: the bytes of the regions asked for, from the texts of a bucket.

    The regions of one anchor go to one shard; if they are too many for a task, their strings go by
    a hash of their own instead, which still brings equal ones together; of those
    that are equal within the bucket only the first is sent, the others are covered already.
    """

    def run(key, texts, asked):
        out = {"shard": [], "settled": [], "blob": [], "more": []}
        covered = []
        blobs = [x.as_py() for x, ask in zip(asked["blob"], asked["ask"], strict=True) if ask.as_py()]
        if blobs:
            asks = np.frombuffer(b"".join(blobs), _ASK)
            asks = asks[np.lexsort((asks["order"], asks["row"]))]
            place = dict(zip(zip(_orders(texts).tolist(), texts["row"].to_pylist(), strict=True), range(texts.num_rows), strict=True))
            bounds = np.flatnonzero(np.concatenate([[True], (asks["row"][1:] != asks["row"][:-1]) | (asks["order"][1:] != asks["order"][:-1]), [True]]))
            made: dict[int, tuple[list, list]] = {}
            single: dict[bytes, tuple] = {}
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                order, row = int(asks["order"][a]), int(asks["row"][a])
                text = texts["text"][place[order, row]].as_py()
                for ask in asks[a:b]:
                    start, n = int(ask["start"]), int(ask["n"])
                    if ask["parts"] == 1:
                        rows, data = made.setdefault(int(ask["gram"]) % n_shards, ([], []))
                        rows.append((ask["gram"], order, row, start, n, text[start - 1] if start else -1))
                        data.append(text[start : start + n + REPEAT - 1])
                        continue
                    for s in range(start, start + n):
                        string = text[s : s + REPEAT]
                        now = (order, s, row, ask["gram"], text[s - 1] if s else -1)
                        first = single.setdefault(string, now)
                        if now[:2] < first[:2]:
                            single[string], now = now, first
                        if now[:2] != single[string][:2]:
                            covered.append((now[0], now[2], now[1], REPEAT))
            for string, (order, s, row, gram, before) in single.items():
                rows, data = made.setdefault(int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little") % n_shards, ([], []))
                rows.append((gram, order, row, s, 1, before))
                data.append(string)
            for shard, (rows, data) in made.items():
                out["shard"].append(shard)
                out["settled"].append(False)
                out["blob"].append(np.array(rows, _SUFFIXES).tobytes())
                out["more"].append(b"".join(data))
        _settle(out, np.array(covered, _SPAN), n_shards, n_buckets)
        return pa.Table.from_batches([_batch(out)])

    return run


def suffix_array(suffix: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (their bytes, one row each, zeros beyond ``size``), and the common prefix of neighbours."""
    width = suffix.shape[1]
    rank = np.argsort(suffix.view(f"S{width}").ravel(), kind="stable")
    common = np.empty(max(len(rank) - 1, 0), np.int64)
    for at in range(0, len(common), 4096):
        part = rank[at : at + 4097]
        rows = suffix[part]
        differ = rows[1:] != rows[:-1]
        first = differ.argmax(axis=1)
        shared = np.where(differ[np.arange(len(differ)), first], first, width)
        common[at : at + 4096] = np.minimum(shared, np.minimum(size[part[1:]], size[part[:-1]]))
    return rank, common


def maximal_repeats(rank: np.ndarray, common: np.ndarray, before: np.ndarray, inner: np.ndarray, shortest: int):
    """Scan an enhanced suffix array for maximal repeats of at least ``shortest`` bytes.

    ``before``: the byte left of each suffix (-1: none); ``inner``: whether the suffix one to the left is
    among them. A common-prefix interval is a repeat with all its members. It is left out if every
    member can be extended to the left by the same byte: the interval of those extensions, one
    longer, says the same. Returns the intervals in which no other lies (begins, ends, lengths:
    places in ``rank``, end included), and an iterator (length, begin, end) over the trees of others.
    """
    near = np.concatenate([[False], common >= shortest, [False]])
    begins, ends = np.flatnonzero(near[1:] & ~near[:-1]), np.flatnonzero(~near[1:] & near[:-1])
    if not len(begins):
        return begins, ends, begins, iter(())
    edges = np.stack([begins, ends + 1], axis=1).ravel()
    spread = lambda x, f: f.reduceat(np.append(x[rank], x[rank[-1]]), edges)[::2]
    alike = (spread(before, np.minimum) == spread(before, np.maximum)) & spread(inner.astype(np.int8), np.minimum).astype(bool)
    begins, ends = begins[~alike], ends[~alike]
    if not len(begins):
        return begins, ends, begins, iter(())
    edges = np.stack([begins, ends], axis=1).ravel()
    tail = np.append(common, common[-1])
    low, high = np.minimum.reduceat(tail, edges)[::2], np.maximum.reduceat(tail, edges)[::2]
    flat = low == high

    def trees():
        for begin, end in zip(begins[~flat].tolist(), ends[~flat].tolist(), strict=True):
            stack: list[tuple[int, int]] = []
            heights = common[begin:end].tolist() + [0]
            for i, now in enumerate(heights, begin):
                left = i
                while stack and stack[-1][0] > now:
                    length, left = stack.pop()
                    members = rank[left : i + 1]
                    some = before[members]
                    if not ((some == some[0]).all() and inner[members].all()):
                        yield length, left, i
                if now >= shortest and (not stack or stack[-1][0] < now):
                    stack.append((now, left))

    return begins[flat], ends[flat], low[flat], trees()


def covered_lengths(rank: np.ndarray, common: np.ndarray, before: np.ndarray, inner: np.ndarray, age: np.ndarray) -> np.ndarray:
    """For each suffix the length of the longest maximal repeat in which another member is earlier."""
    covered = np.zeros(len(rank), np.int64)
    begins, ends, lengths, trees = maximal_repeats(rank, common, before, inner, REPEAT)
    if len(begins):
        sizes = ends - begins + 1
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ages = age[rank[at]]
        first = np.repeat(np.minimum.reduceat(ages, np.cumsum(sizes) - sizes), sizes)
        later = ages != first
        covered[rank[at[later]]] = np.repeat(lengths, sizes)[later]
    for length, begin, end in trees:
        members = rank[begin : end + 1]
        ages = age[members]
        later = members[ages != ages.min()]
        covered[later] = np.maximum(covered[later], length)
    return covered


def _scan(n_buckets: int):
    """Stage 4: the suffix array of a shard; in each maximal repeat all members but the first are covered."""

    def run(key, table):
        rows = np.frombuffer(b"".join(x.as_py() for x, told in zip(table["blob"], table["settled"], strict=True) if not told.as_py()), _SUFFIXES)
        data = np.frombuffer(b"".join(x.as_py() for x in table["more"]), np.uint8)
        n = rows["n"].astype(np.int64)
        reach = n + REPEAT - 1
        offset = np.cumsum(reach) - reach
        by = np.argsort(rows["gram"], kind="stable")
        spans = _settled(table)
        del table
        # Equal strings have equal anchors: anchors are scanned in runs that fit the memory.
        cost = np.cumsum(n[by])
        new = np.flatnonzero(np.append(True, rows["gram"][by][1:] != rows["gram"][by][:-1])[: len(by)])
        limit, cuts, base = SUFFIX_BYTES // (REPEAT + MOST_STARTS), [0], 0
        for a, b in zip(new, [*new[1:], len(by)], strict=True):
            if cost[b - 1] - base > limit and a > cuts[-1]:
                cuts.append(int(a))
                base = cost[a - 1]
        for a, b in zip(cuts, [*cuts[1:], len(by)], strict=True):
            part = by[a:b]
            if not len(part):
                continue
            width = int(reach[part].max())
            # Each region with zeros after it; bytes of UTF-8 stay below 255, so that one can be added.
            step = reach[part] + width
            place = np.cumsum(step) - step
            line = np.zeros(int(step.sum()), np.uint8)
            copy = np.arange(int(reach[part].sum())) - np.repeat(np.cumsum(reach[part]) - reach[part], reach[part])
            line[np.repeat(place, reach[part]) + copy] = data[np.repeat(offset[part], reach[part]) + copy] + np.uint8(1)
            each = np.repeat(np.arange(len(part)), n[part])
            inner = np.arange(len(each)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(line, width)[place[each] + inner])
            of = part[each]
            before = np.where(inner > 0, line[np.maximum(place[each] + inner - 1, 0)].astype(np.int16) - 1, rows["before"][of])
            order, start, row = rows["order"][of], rows["start"][of].astype(np.int64) + inner, rows["row"][of]
            sorted_by = np.lexsort((start, order))
            step = (np.diff(order[sorted_by]) != 0) | (np.diff(start[sorted_by]) != 0)
            age = np.empty(len(of), np.int64)
            age[sorted_by] = np.concatenate([[0], np.cumsum(step)])
            covered = covered_lengths(*suffix_array(suffix, reach[part][each] - inner), before, inner > 0, age)
            hit = np.flatnonzero(covered)
            hit = hit[np.lexsort((start[hit], row[hit], order[hit]))]
            if len(hit):  # spans of a text that touch become one
                begin, end = start[hit], start[hit] + covered[hit]
                head = np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (order[hit][1:] != order[hit][:-1])])
                # Running ends within a text: texts are set far apart on one line.
                far = (np.cumsum(head) - 1) * (1 << 34)
                top = np.maximum.accumulate(end + far)
                head[1:] |= (begin + far)[1:] > top[:-1]
                heads = np.flatnonzero(head)
                last = np.append(heads[1:] - 1, len(hit) - 1)
                out = np.empty(len(heads), _SPAN)
                out["order"], out["row"], out["start"], out["size"] = order[hit][heads], row[hit][heads], begin[heads], (top - far)[last] - begin[heads]
                spans.append(out)
        told = np.concatenate(spans) if spans else np.empty(0, _SPAN)
        out = {"bucket": [], "ask": [], "blob": []}
        for bucket, some in _packed(np.mod(told["row"], n_buckets), n_buckets, told):
            out["bucket"].append(bucket)
            out["ask"].append(False)
            out["blob"].append(some.tobytes())
        return pa.Table.from_batches([_batch(out)])

    return run


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) that spans cover; runs that touch are one."""
    order = np.argsort(spans["start"], kind="stable")
    begin = spans["start"][order].astype(np.int64)
    end = np.maximum.accumulate(begin + spans["size"][order])
    if not len(begin):
        return []
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    heads = np.flatnonzero(new)
    return list(zip(begin[heads].tolist(), end[np.append(heads[1:] - 1, len(end) - 1)].tolist(), strict=True))


def _apply(carried: list[str], schema: T.StructType, digest: bool, decoded: bool):
    """Stage 5: what is left of each text of a bucket."""

    def run(key, texts, told):
        spans = np.frombuffer(b"".join(x.as_py() for x, ask in zip(told["blob"], told["ask"], strict=True) if not ask.as_py()), _SPAN)
        spans = spans[np.argsort(spans["row"], kind="stable")]
        rows, orders = texts["row"].to_numpy(), _orders(texts)
        begin, end = np.searchsorted(spans["row"], rows), np.searchsorted(spans["row"], rows, "right")
        out = [[], [], [], [], []]
        for n in range(texts.num_rows):
            text = texts["text"][n].as_py()
            mine = spans[begin[n] : end[n]]
            runs = merged(mine[mine["order"] == orders[n]])
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            rest = b"".join([*kept, text[at:]])
            out[0].append(len(text))
            out[1].append(len(text) - len(rest))
            out[2].append(len(runs))
            out[3].append(hashlib.sha256(rest).hexdigest() if digest else [{"begin": a, "end": b} for a, b in runs])
            out[4].append(rest.decode("utf-8", "ignore") if decoded else rest)
        last = [pa.array(out[3], pa.string())] if digest else [pa.array(out[3], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(out[4], pa.string() if decoded else pa.binary())]
        return pa.table([texts["doc_id"], *(pa.array(x, pa.int64()) for x in out[:3]), *last, *(texts[c] for c in carried)], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, carry: str | None = None, decoded: bool = False) -> DataFrame:
    """Remove each byte covered by a 100-byte string that also starts earlier.

    Texts are taken as UTF-8 (null: empty); strings do not cross texts; earlier means in a smaller id,
    or at a smaller place of the same one. Strings are judged on the input.

    1. The anchor of a string is the least hash of its 48-byte grams, so only the anchors of a text
       travel, one for about 28 bytes, dealt by their gram; of those equal within a run of texts
       only the first. 2. Where regions of one anchor are equal,
       all but the first are covered. 3. For the others the bytes of one of each are cut from the
       texts. 4. They are laid out as an enhanced suffix array, shard by shard, and a stack scan of
       its common prefixes gives the tree of intervals; intervals that all members extend to the
       left alike are left out, the others are maximal repeats with all their occurrences, and all
       but the earliest are covered. 5. The covered runs are taken out of the texts.

    Result: id, n_bytes, n_removed, n_spans (maximal removed runs), and kept_sha256 with ``digest``, or
    else spans (begin, end: bytes) and kept (the bytes left; with ``decoded`` as text, what a cut leaves of a
    character dropped). A null id counts as smaller than all;
    rows that share an id count as one document, so that a repeated row removes nothing of its
    like at the same place, but all that is equal at a later one. An empty table gives no rows.
    Ids must be integers. Columns besides the two named are not read, but for ``carry``, one column
    that is handed on.
    """
    carried = [carry] if carry else []
    last = [T.StructField("kept_sha256", T.StringType())] if digest else [T.StructField("spans", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.StringType() if decoded else T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), *last, *(docs.schema[c] for c in carried)])
    texts = in_bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("text"), *carried)
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-total // TEXT_BYTES))
    anchor_shards = max(1, -(-(total // 28 * (_ANCHOR.itemsize + _OWNER.itemsize)) // ANCHOR_BYTES))
    suffix_shards = max(1, -(-total // (24 * TEXT_BYTES // 4)))
    tasks = lambda n: max(1, min(n, 1 << 15))

    placed = texts.withColumn("bucket", F.pmod("row", F.lit(buckets)).cast("int")).repartition(tasks(buckets), "bucket")
    blobs = texts.select("doc_id", "row", "text").mapInArrow(tidy(_anchor_blobs(anchor_shards, buckets)), "shard int, settled boolean, blob binary, more binary")
    judged = blobs.repartition(tasks(anchor_shards), "shard").groupBy("shard").applyInArrow(returning(_judge(buckets)), "bucket int, ask boolean, blob binary")
    told = judged.repartition(tasks(buckets), "bucket")
    # What is asked for and what is settled go the same way, so that the shuffle is made once and read twice.
    cut = placed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(returning(_cut(suffix_shards, buckets)), "shard int, settled boolean, blob binary, more binary")
    scanned = cut.repartition(tasks(suffix_shards), "shard").groupBy("shard").applyInArrow(returning(_scan(buckets)), "bucket int, ask boolean, blob binary")
    spans = told.unionByName(scanned.repartition(tasks(buckets), "bucket"))
    return placed.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(returning(_apply(carried, schema, digest, decoded)), schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows of ``documents``, with repeats taken out of the texts and n_chars counted anew.

    A cut through a character takes the whole character. A null text stays null; rows whose text
    is left empty stay.
    """
    names = docs.columns
    whole = docs.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in names if c != "text"), F.col("text").isNull().alias("__null")))
    # The texts are made in the worker that cuts them: a second one beside it would double the memory.
    rows = remove_repeats(whole, carry="__row", decoded=True)
    text = F.when(~F.col("__row.__null"), F.col("kept"))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    columns = {c: F.col(f"__row.`{c}`") for c in names if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(kinds["n_chars"])
    return rows.select(*(columns[c].alias(c) for c in names))
