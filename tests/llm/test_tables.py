"""The archive, the divergence audit and the manifest on odd tables, held against plain computations."""

import base64
import collections
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.llm import archive, common, divergence, manifest

CLASHES = ["key", "start", "n", "copies", "leaf", "block", "term", "c", "d", "panel", "payload", "head", "part", "value"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASHES})


# --- archive


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, "<p>y é \r\n\r\n WARC/1.1\r\n</p>"), (4, "http://a/4", None), (5, "http://a/5", ""), (5, "http://a/5", ""), (None, "http://a/n", "<p>x</p>"), (None, None, "only null"), (6, "http://b\r\nX: y", "z" * 300000)]


def archived(spark, rows, least=0):
    folder = f"{common.shared_folder(spark)}/{uuid.uuid4().hex}"
    archive.write_archive(clashing(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)), folder, least=least)
    return folder


def test_archive_equals_plain_digests(spark):
    folder = archived(spark, PAGES)
    got = sorted(map(tuple, archive.described(archive.read_archive(spark, folder)).drop("record_sha256").collect()), key=repr)
    largest = {}
    for i, _, html in PAGES:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", i))
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        first = largest.get(html or "")
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=repr)
    assert spark.read.parquet(f"{folder}/payloads").count() == len({html or "" for _, _, html in PAGES})


def test_records_restored_make_a_warc_file(spark, tmp_path):
    records = archive.read_archive(spark, archived(spark, PAGES))
    rows = records.select("head", "http", "payload", archive.record_bytes().alias("bytes")).collect()
    for name, pack in (("plain.warc", bytes), ("packed.warc.gz", gzip.compress)):
        (tmp_path / name).write_bytes(b"".join(pack(bytes(r["bytes"])) for r in rows))
    found = archive.records_of_files(spark.read.format("binaryFile").load(str(tmp_path)))
    for path, _, head, block in sorted(map(tuple, found.collect()), key=lambda r: r[:2]):
        n = [r[2] for r in found.filter(F.col("path") == path).orderBy("nth").select("path", "nth", "head").collect()]
        assert n == [r["head"] for r in rows]
        r = next(r for r in rows if r["head"] == head)
        revisit = "WARC-Type: revisit" in head
        assert bytes(block) == r["http"].encode() + (b"" if revisit else bytes(r["payload"])) and ("WARC-Refers-To" in head) == revisit
    assert not any("\nX: y" in r["head"] for r in rows)


def test_small_payloads_are_responses_and_no_pages_no_records(spark):
    got = archive.described(archive.read_archive(spark, archived(spark, PAGES, least=100))).collect()
    assert {r["record_type"] for r in got} == {"response"} and {r["refers_to"] for r in got} == {None}
    assert archive.described(archive.read_archive(spark, archived(spark, []))).count() == 0


def test_a_payload_that_was_changed_is_told(spark):
    folder = archived(spark, PAGES)
    bad = spark.read.parquet(f"{folder}/payloads").withColumn("bytes", F.concat("bytes", F.lit(b"!"))).collect()
    spark.createDataFrame(bad, "key binary, bytes binary").write.mode("overwrite").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="not what its digest says"):
        archive.described(archive.read_archive(spark, folder)).collect()


# --- divergence


def plain_divergence(rows, least, top):
    unit, terms_of = 1_000_000_000, lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = terms_of(text)
        counts.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out, dist = set(), lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        of = {s: {t: counts[lang, s, t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in of.values()) for t in kept}
        shares = lambda c: {t: 1 + unit * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        p, q = {s: shares(c) for s, c in of.items()}, shares(whole)
        for s in of:
            pairs = sorted((-sum(dist(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in of if o != s)
            told = sorted((-dist(p[s][t], q[t]), t.encode(), t) for t in kept if of[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, x, -v, r + 1) for part, found in (("pair", pairs), ("term", told)) for r, (v, _, x) in enumerate(found)}
    return out


def odd_docs(seed=3, n=260, sources=11):
    draw = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["É", "été", "日本", "Foo", "foo"]
    rows = []
    for i in range(n):
        s = int(draw.integers(0, sources))
        pool = words[s * 5 : s * 5 + 40] + words[-5:]
        rows.append((i, " ".join(draw.choice(pool, int(draw.integers(0, 60)))) + (". A-b_c\x00x" if i % 3 else ""), [None, "", "en", "fr"][int(draw.integers(0, 4))], [None, f"s{s}", "", f"s{s}"][i % 4], i))
    return rows + [(None, None, None, None, None), (1, "", "zz", "only", 0), (1, "", "zz", "other", 0), (7, "word " * 50000, "en", "long", 1)] + [(8, "same same", "fr", "copies", 1)] * 40


@pytest.mark.parametrize(("least", "top"), [(10, 10), (2, 3)])
def test_divergence_equals_plain_counts(spark, least, top):
    rows = odd_docs()
    got = divergence.source_divergence(clashing(spark.createDataFrame(rows, DOCS)).repartition(5), least, top).collect()
    assert {tuple(r) for r in got} == plain_divergence(rows, least, top) and len(got) == len({tuple(r) for r in got})


def test_divergence_in_several_panels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PANEL", 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 17)
    rows = odd_docs(5)
    assert {tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, DOCS), 3, 4).collect()} == plain_divergence(rows, 3, 4)


def test_no_documents_no_divergence(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_joint_sums_equal_all_columns_worked_out():
    draw = np.random.default_rng(1)
    for n, m, width in ((1, 1, 1), (5, 9, 70), (17, 3, 400), (8, 40, 33)):
        x, y = (draw.integers(0, 9, (k, width)) * (draw.random((k, width)) < 0.03) for k in (n, m))
        tx, ty = x.sum(1) + 2 * width, y.sum(1) + 2 * width
        plain = lambda a, ta, b, tb: [[sum((p - q) ** 2 // (p + q) for p, q in zip((1 + 10**9 * (int(c) + 2) // int(s) for c in r), (1 + 10**9 * (int(c) + 2) // int(t) for c in o), strict=True)) for o, t in zip(b, tb, strict=True)] for r, s in zip(a, ta, strict=True)]
        assert divergence.joint_sums(x, tx, y, ty).tolist() == plain(x, tx, y, ty)
        assert divergence.joint_sums(x, tx, x, tx).tolist() == plain(x, tx, x, tx)


def test_shares_do_not_overflow():
    count, total = np.array([10**14, 7]), np.array([3 * 10**14, 10**15 - 1])
    assert divergence.share(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_long_texts_are_cut_at_gaps(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    text = b"ab cd efghijklmnopqrstuvwxyz1234 x " * 7 + b"end"
    assert [w for piece in divergence._pieces(text) for w in piece.split()] == re.findall(rb"[a-z]+", text)


# --- manifest


def plain_manifest(rows):
    digest = lambda b: hashlib.sha256(b).hexdigest().encode()
    field = lambda v: b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode())
    by = {}
    for i, text, lang, source, n in rows:
        leaf = lambda t: digest(field(i) + field(source) + field(lang) + field(n) + field(t))  # noqa: B023, E731
        tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        by.setdefault(lang, []).append(((i is not None, i or 0), leaf(text), leaf(lower) if tampered else leaf(text), i))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(b"".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
        return levels

    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[1] for x in sorted(by[k], key=lambda x: x[:2])]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    out = []
    for at, k in enumerate(keys):
        for place, (_, leaf, value, i) in enumerate(sorted(by[k], key=lambda x: x[:2])):
            proof = b""
            for levels, p in ((trees[k], place), (top, at)):
                for nodes in levels[:-1]:
                    run, j = nodes[p // 8 * 8 : p // 8 * 8 + 8], p % 8
                    proof += b"".join(run[:j] + run[j + 1 :])
                    value = digest(b"".join(run[:j] + [value] + run[j + 1 :]))
                    p //= 8
            out.append((i, leaf.decode(), trees[k][-1][0].decode(), top[-1][0].decode(), digest(proof).decode(), value.decode(), value == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = [(i * 7 % 500, f"Text {i} É", ["en", "fr", "de"][i % 3] if i % 11 else None, "s", i) for i in range(1, 300)] + [(5, "Aa", "en", "s", 1)] * 90 + [(None, None, None, None, None)] * 3 + [(1, "x" * 200000, "zz", "s", 1), (2, None, "", "s", 1)]


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest_equals_plain_trees(spark, levels):
    docs = clashing(spark.createDataFrame(MANIFEST, DOCS).repartition(5))
    assert sorted(map(tuple, manifest.manifest(manifest.digests(docs), levels).collect()), key=repr) == plain_manifest(MANIFEST)


@pytest.mark.parametrize("rows", [[], [(3, "A", None, None, 1)], [(3, "A", "en", None, 1), (4, "B", "fr", None, 1)]])
def test_manifest_of_few_rows(spark, rows):
    assert sorted(map(tuple, manifest.manifest(manifest.digests(spark.createDataFrame(rows, DOCS))).collect()), key=repr) == plain_manifest(rows)


def test_folding_goes_on_from_the_state_before_a_child():
    nodes = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(21)]
    tree = manifest.Subtree(nodes, 2)
    assert len(tree.states[0]) == 21 and len(tree.levels[1]) == 3
    other, right = b"0" * 64, tree.sides()[0][10][1]
    assert manifest.resumed(tree.states[0][10], other, right) == hashlib.sha256(b"".join(nodes[8:10] + [other] + nodes[11:16])).hexdigest().encode()
