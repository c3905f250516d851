"""Each operator and stage on odd tables: nulls, empty and very long texts, repeated rows, clashing columns, no rows."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

import corpus_pipeline
from sinoplan.llm import bpe, decontam, langid, nearcopies, repeats, sharding, tokens, topk, toxicity, wrapper

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Columns whose names the operators use within.
CLASHES = ["row", "bucket", "shard", "slot", "node", "part", "text2", "n", "lang_pred", "__part", "block", "value"]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = "the quick brown fox jumps over the lazy dog and then some more of it " * 3000
ODD = [
    (1, None, "en", None, None), (2, "", "en", "s", 0), (3, "   \n\t ", None, "s", 6), (4, "1234 !!! ??", "en", "s", 11), (5, LONG, "en", "s", len(LONG)),
    (5, LONG, "en", "s", len(LONG)), (6, LONG + "x", None, None, 1), (None, "a null id with plain words in it", "en", "s", 5), (7, "<|endoftext|> in <|endoftext|>", "en", "s", 3), (8, "naïve café 日本語 \x00 ‍ 😀", "fr", "s", 4),
    (9, "x" * 30000, "en", "s", 30000), (10, "one two three four", "en", "s", 18), (11, "one two three four", "en", "s", 18), (11, "another text under the same id", "en", "s", 2),
]


def docs(spark, rows=ODD, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_tokens_and_bpe_equal_the_library(odd, none):
    library = Tokenizer.from_file(PATH)
    want = sorted(len(library.encode(r[1] or "", add_special_tokens=False)) for r in ODD)
    got = tokens.token_counts(odd, PATH).collect()
    assert sorted(r["n_tokens"] for r in got) == want and len(got) == len(ODD)
    assert {r["n_bytes"] for r in got if r["doc_id"] in (1, 2)} == {0}
    rows = bpe.bpe_encode(odd, PATH).collect()
    assert sorted(r["n_tokens"] for r in rows) == want
    assert sorted(r["decoded"] for r in rows) == sorted(r[1] or "" for r in ODD)
    digests = bpe.bpe_encode(odd, PATH, digest=True).collect()
    assert {r["ids_sha256"] for r in digests} == {hashlib.sha256(np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for r in ODD}
    assert tokens.token_counts(none, PATH).count() == 0 == bpe.bpe_encode(none, PATH).count()


def test_sentencepiece_counts(odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    short = odd.filter(F.length("text") < 100)
    assert sorted(r["n_tokens"] for r in tokens.token_counts(short, path).collect()) == sorted(len(model.encode(r["text"])) for r in short.collect())


def test_language_of_odd_texts(spark, odd, none):
    train = docs(spark, [(i, t, l, "s", 1) for i, (t, l) in enumerate([("the cat and the dog with the house", "en"), ("le chat et le chien avec la maison", "fr"), ("der hund und die katze mit dem haus", "de")] * 5)])
    model = langid.fit_languages(train)
    got = langid.identify(odd, model).collect()
    assert len(got) == len(ODD)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["spans"] == [] for r in got if r["doc_id"] in (1, 2, 3, 4))
    assert all(r["lang_pred"] == "en" and 0 <= r["score"] <= 1 for r in got if r["doc_id"] == 5)
    mixed = langid.identify(docs(spark, [(1, "the cat and the dog with the house le chat et le chien avec la maison", None, None, 1)]), model).first()
    assert [s["lang"] for s in mixed["spans"]] == ["en", "fr"] and mixed["spans"][1]["begin"] == 35
    assert langid.identify(none, model).count() == 0
    empty = langid.fit_languages(none)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)

    def plain(s, switch):
        best, back = s[0].copy(), []
        for row in s[1:]:
            jump = best < best.max() - switch
            back.append(np.where(jump, best.argmax(), np.arange(len(best))))
            best = row + np.maximum(best, best.max() - switch)
        path = [int(best.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        return path[::-1]

    for n in (1, 11, 12, 40):
        scores = [rng.integers(-8, 1, (int(rng.integers(0, 70)), 3)).astype(np.float32) for _ in range(n)]
        for s, got in zip(scores, langid.viterbi([x.copy() for x in scores], 6.0), strict=True):
            assert got.tolist() == (plain(s, np.float32(6)) if len(s) else [])


def test_toxicity_on_odd_texts_and_without_labels(spark, odd, none):
    rows = [(i, f"you are a {w} and nothing else word{i}" if y else f"a quiet day at the lake word{i}", "en", "s", 1) for i in range(200) for w, y in [(("idiot", "moron")[i % 2], i % 4 == 0)]]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs(spark, rows), labels)
    test = docs(spark, [(1, "you are an idiott", None, None, 1), (2, "a quiet day", None, None, 1), (3, "a m0ron, you", None, None, 1)])
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(test, model).collect()}
    assert got[1]["predicted"] == 1 and got[3]["predicted"] == 1 and got[2]["predicted"] == 0
    assert toxicity.score_toxicity(odd, model).count() == len(ODD)
    assert toxicity.score_toxicity(none, model).count() == 0
    blank = toxicity.fit_toxicity(none, labels.limit(0))
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score_toxicity(odd, blank).collect())


def test_near_copies_of_odd_texts(odd, none):
    got = nearcopies.jaccard_join(odd).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["class_id"] for r in by[5] + by[6]} == {5} and {r["n_links"] for r in by[5]} == {2}
    assert by[10][0]["class_id"] == 10 and by[10][0]["copies"] == 2
    assert by[1][0]["class_id"] == by[2][0]["class_id"] == 1 and by[1][0]["n_links"] == 1
    assert by[None][0]["class_id"] is None
    assert nearcopies.jaccard_join(none).count() == 0


def test_one_row_of_each_class_stays_whatever_the_ids(spark, odd, none):
    ids = lambda df: sorted((str(r["doc_id"]), (r["text"] or "")[:20]) for r in df.collect())
    kept = ids(nearcopies.keep_one(odd))
    assert [x for x in kept if x[0] in ("10", "11")] == [("10", "one two three four"), ("11", "another text under t")]
    assert len([x for x in kept if x[0] == "5"]) == 1 and ("None", "a null id with plain") in kept and len(kept) == 10
    rows = [(None, "some words that stand twice", None, None, 1)] * 2 + [(None, "One two, three four", None, None, 1), (10, "one two three four", None, None, 1), (7, "a", None, None, 1), (7, "b", None, None, 1)]
    assert ids(nearcopies.keep_one(docs(spark, rows))) == [("10", "one two three four"), ("7", "a"), ("7", "b"), ("None", "some words that stan")]
    assert nearcopies.keep_one(none).count() == 0


def test_a_large_group_in_blocks_loses_no_link(spark, monkeypatch):
    import random

    monkeypatch.setattr(nearcopies, "BLOCK_TEXTS", 16)
    draw = random.Random(1)
    base = [f"w{draw.randint(0, 999)}" for _ in range(120)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(draw.randint(0, 2)):
            t[draw.randint(0, 119)] = f"z{draw.randint(0, 9999)}"
        rows.append((i, " ".join(t), None, None, 1))
    sets = [set(nearcopies.shingler(5).shingles(r[1]).tolist()) for r in rows]
    want = [sum(i != j and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = {r["doc_id"]: r["n_links"] for r in nearcopies.jaccard_join(docs(spark, rows)).collect()}
    assert [got[i] for i in range(70)] == want


def test_recall_of_the_bands():
    assert nearcopies.recall(0.8) > 1 - 1e-6 and nearcopies.recall(0.2) < 1e-3


def brute_repeats(rows):
    first, out = {}, []
    ordered = sorted(((-(1 << 62) if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows)
    for i, b in ordered:
        for s in range(len(b) - 99):
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], (i, s)), (i, s))
    for i, b in ordered:
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] != (i, s):
                covered[s : s + 100] = b"\1" * 100
        out.append((i, sum(covered), hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return sorted(out)


def test_repeats_equal_brute_force(spark, odd, none):
    import random

    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefgh é\n") for _ in range(draw.randint(150, 400))) for _ in range(8)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(draw.randint(0, 4)):
            k = draw.random()
            if k < 0.4:
                b = draw.choice(base)
                t += b[draw.randint(0, len(b) - 1) :][: draw.randint(50, 400)]
            elif k < 0.6:
                t += draw.choice(["ab", "abc", "x", "hello "]) * draw.randint(1, 150)
            else:
                t += "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(1, 300)))
        rows.append((i, t, None, None, 1))
    for table, plain in ((docs(spark, rows), rows), (odd.filter("length(text) < 40000 or text is null"), [r for r in ODD if r[1] is None or len(r[1]) < 40000])):
        got = repeats.remove_repeats(table, digest=True).collect()
        assert sorted((-(1 << 62) if r["doc_id"] is None else r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(plain)
    assert repeats.remove_repeats(none).count() == 0


def test_a_hot_anchor_is_dealt_out_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SUFFIX_BYTES", 20_000)
    line = "".join(chr(97 + i * 7 % 26) for i in range(60))
    rows = [(i, f"{i * 7919:040d}" + line + f"{i % 5:060d}", None, None, 1) for i in range(40)]
    got = repeats.remove_repeats(docs(spark, rows), digest=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows)


def test_repeats_across_the_pieces_of_long_texts(spark, monkeypatch):
    import random

    monkeypatch.setattr(repeats, "CHUNK_BYTES", 256)
    draw = random.Random(11)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    shared, turn = text(700), text(130)
    texts = [text(190) + shared + text(411), text(33) + shared[90:] + text(900), turn * 6, text(255) + shared[:101], text(256), text(99), "a" * 1500]
    rows = [(i, t, None, None, 1) for i, t in enumerate(texts)]
    got = repeats.remove_repeats(docs(spark, rows), digest=True).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_repeats(rows)


def test_maximal_repeats_are_all_found():
    texts = [b"xabcabcay", b"zabcabcaw", b"qabcx"]
    suffix, size, before, inner, where = [], [], [], [], []
    for d, t in enumerate(texts):
        for s in range(len(t)):
            suffix.append(t[s:].ljust(9, b"\0"))
            size.append(len(t) - s)
            before.append(t[s - 1] if s else -1)
            inner.append(s > 0)
            where.append((d, s))
    table = np.frombuffer(b"".join(suffix), np.uint8).reshape(-1, 9)
    rank, common = repeats.suffix_array(table, np.array(size))
    begins, ends, lengths, trees = repeats.maximal_repeats(rank, common, np.array(before), np.array(inner), 3)
    every = [*zip(lengths.tolist(), begins.tolist(), ends.tolist(), strict=True), *trees]
    found = {(n, frozenset(where[m] for m in rank[a : b + 1])) for n, a, b in every}
    assert (7, frozenset({(0, 1), (1, 1)})) in found
    assert (3, frozenset({(0, 1), (0, 4), (1, 1), (1, 4), (2, 1)})) in found or (4, frozenset({(0, 1), (0, 4), (1, 1), (1, 4)})) in found


def test_contamination_equals_brute_force(spark, odd, none):
    import random

    draw = random.Random(5)
    letters = "abcde "
    items = [(i, "".join(draw.choice(letters) for _ in range(draw.randint(60, 120)))) for i in range(6)] + [(7, None), (8, "  ")]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = draw.randrange(len(t))
            t[k : k + 1] = draw.choice([[], ["q"], [t[k], "q"]])
        return "".join(t)

    rows = [(i, "".join(draw.choice(letters) for _ in range(50)) + edited(items[i % 6][1], i % 9).upper() + "tail" * 5, None, None, 1) for i in range(60)]

    def distance(item, text):
        column = [0] * (len(text) + 1)
        for a in item:
            last, column[0] = column[0], column[0] + 1
            for j, b in enumerate(text, 1):
                last, column[j] = column[j], min(column[j] + 1, column[j - 1] + 1, last + (a != b))
        return min(column)

    want = set()
    for i, text, *_ in rows:
        for n, item in items:
            a, b = decontam.normalised(item or ""), decontam.normalised(text)
            if a and (d := distance(a, b)) <= int(0.05 * len(a)):
                want.add((i, n, d))
    benchmark = spark.createDataFrame(items + items[:1], "item_id long, text string")
    for chars in (1 << 20, 150):
        got = decontam.find_contamination(docs(spark, rows), benchmark, block_chars=chars).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and len(got) == len(want)
    texts = {r[0]: decontam.normalised(r[1]) for r in rows}
    plain = {n: decontam.normalised(t or "") for n, t in items}
    assert all(distance(plain[r["item_id"]], texts[r["doc_id"]][r["begin"] : r["end"]]) == r["distance"] for r in got)
    assert decontam.find_contamination(odd, benchmark).count() == 0 == decontam.find_contamination(none, benchmark).count()
    assert decontam.find_contamination(odd, benchmark.limit(0)).count() == 0


def test_each_row_is_cleaned_by_its_own_text(spark, none):
    items = spark.createDataFrame([(1, "a benchmark item that is long enough to be found"), (2, "and another item, of a later pass over the texts")], "item_id long, text string")
    rows = [(None, "so: a benchmark item that is long enough to be FOUND!", None, None, 1), (None, "clean", "en", "s", 2), (None, None, None, None, None), (3, "see and another item, of a later pass over  the texts", None, None, 1), (3, "clean as well", "en", "s", 3), (3, "clean as well", "en", "s", 3)]
    want = sorted(map(repr, (tuple(r) for r in rows if r[4] != 1)))
    for chars in (1 << 20, 50):
        got = decontam.clean_documents(docs(spark, rows, clash=False), items, block_chars=chars)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert decontam.clean_documents(docs(spark, rows), items.limit(0)).count() == len(rows) and decontam.clean_documents(none, items).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    raw = rng.integers(-3, 4, (700, 6)) / 8
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(raw)] + [(50, [float(x) for x in raw[50]]), (None, [1.0] * 6), (900, None), (950, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (951, [float("nan")] * 6), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in CLASHES})
    got = {}
    for r in topk.top_k_inner_product(df, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    # Row 700 repeats row 50: it is a candidate like any other, also for its equal, and a query of its own.
    v, ids = np.floor(np.vstack([raw, raw[50:51]]) * 256).astype(int), [*range(700), 50]
    want = {}
    for q in [*range(0, 700, 50), 700]:
        score = v @ v[q]
        best = sorted((-score[i], ids[i]) for i in range(701) if i != q)[:5]
        want[ids[q]] = want.get(ids[q], []) + [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert all(sorted(got[q]) == sorted(want[q]) for q in want)
    assert len(got) == 14 and topk.top_k_inner_product(df.limit(0)).count() == 0


def test_max_score_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    values = (rng.normal(0, 1, (9000, 32)) * np.geomspace(100, 1, 32)).astype(int)
    ids = rng.permutation(9000)
    for row, query_id, found, score in topk.search_shard((np.arange(3), ids[:3], values[:3]), ids, values, np.ones(9000, int), np.arange(9000), 7):
        every = values @ values[row]
        best = sorted((-every[i], ids[i]) for i in range(9000) if ids[i] != query_id)[:7]
        assert [(-s, i) for i, s in zip(found.tolist(), score.tolist(), strict=True)] == [(s, i) for s, i in best]


def test_shards_are_exact_whole_and_uniform(spark, odd, none):
    got = sharding.shard_documents(odd, 4).collect()
    assert len(got) == len(ODD) and none.count() == 0 == sharding.shard_documents(none).count()
    many = sharding.shuffle_into_shards(spark.range(5000).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("old")).repartition(7), 16).collect()
    assert sorted(r["doc_id"] for r in many) == list(range(5000))
    slots = {s: sorted(r["slot"] for r in many if r["shard"] == s) for s in range(16)}
    assert all(slots[s] == list(range(len(slots[s]))) for s in slots) and {len(x) for x in slots.values()} == {312, 313}
    place = np.array([r["shard"] for r in sorted(many, key=lambda r: r["doc_id"])])
    assert abs(np.corrcoef(place, np.arange(5000))[0, 1]) < 0.05 and abs(np.corrcoef(place[1:], place[:-1])[0, 1]) < 0.05
    again = sharding.shuffle_into_shards(spark.range(5000).withColumnRenamed("id", "doc_id").repartition(3), 16).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(spark.range(5000).withColumnRenamed("id", "doc_id"), 16).collect()}


def test_communication_matrix_has_the_margins_and_the_mean():
    sizes = [100, 0, 57, 300]
    total = np.zeros((4, 5))
    for seed in range(300):
        m = sharding.communication_matrix(sizes, 5, seed)
        assert m.sum(axis=1).tolist() == sizes and m.min() >= 0 and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
        total += m
    assert np.allclose(total / 300, np.outer(sizes, np.full(5, 0.2)), atol=2.0)


PAGE = "<html><head><title>t</title><script>if (a < b) x('</p>')</script></head><body><nav><ul><li><a href='/'>Home</a><li>More</ul></nav><div class='site-top'>Site of things</div><div class='col'>{a}</div><div class='x'><p>{b}<p>{c} &amp; &lt;i&gt; tail</div><aside>see also</aside><div id='comments'><p>first!</p></div><footer>end</footer>"


def page(n):
    return PAGE.format(a=f"head {n}", b=f"para {n}", c=f"more  \n {n}<br>text <b>bold</b>")


def test_pages_by_alignment_and_odd_pages(spark):
    rows = [(i, f"http://u@Host.example:80/{i}", page(i)) for i in range(8)] + [(8, "http://host.example/8", page(7)), (9, None, None), (10, "not a url", ""), (11, "http://other/", "<p>alone <b>and"), (12, "http://third/", "<article><header><h1>T</h1></header><p>x</p></article><p>out</p><!-- open"), (12, "http://third/", "<article><header><h1>T</h1></header><p>x</p></article><p>out</p><!-- open"), (13, "http://long/", "<div>" * 300 + "deep" + "<p>word " * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in [*CLASHES, "host", "shape", "slots", "pages"]})
    got = {r["page_id"]: r for r in wrapper.extract_main_text(df).collect()}
    assert got[3]["text"] == "head 3\npara 3\nmore 3 text bold & <i> tail"
    assert got[9]["text"] == "" == got[10]["text"] and got[11]["text"] == "alone and" and got[12]["text"] == "T\nx"
    assert got[13]["text"].count("word") == 3000 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert wrapper.extract_main_text(df.limit(0)).count() == 0


def article(*blocks):
    return "<html><body><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body></html>"


def prose(seed, n):
    import random

    draw = random.Random(seed)
    return [" ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(12)) for _ in range(n)]


def main_text(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrapper.extract_main_text(df).orderBy("page_id").collect()]


def test_near_copies_of_an_article_are_no_template(spark):
    blocks = prose(1, 6)
    copies = [[f"on day {i}", *blocks] for i in range(12)]
    assert main_text(spark, [article(*b) for b in copies]) == ["\n".join(b) for b in copies]
    # A large host, whichever page is its wrapper: three copies of a long article, and short ones.
    some = [[f"on day {i}", *prose(2, 30)] for i in range(3)] + [prose(10 + i, 4) for i in range(9)]
    for n in range(2):
        pages = [article(f"run {n}", *b) + f"<!-- {n} -->" for b in some]
        assert main_text(spark, pages) == ["\n".join(b) for b in some]


def test_alignment_decides_inside_articles_from_two_pages_on(spark):
    blocks = [prose(30 + i, 3 + i % 2) for i in range(10)]
    pages = [article("share this story", *b) for b in blocks]
    for n in (2, 9, 10):
        assert main_text(spark, pages[:n]) == ["\n".join(b) for b in blocks[:n]]
    assert main_text(spark, pages[:1] * 3) == ["\n".join(["share this story", *blocks[0]])] * 3


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, "a benchmark item that is long enough to be found in some text of the corpus")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = [(20, "Said: a benchmark item that is long   enough to be FOUND in some text of the corpus, yes", "en", "s", 1), (21, "an honest clean text about the weather in the mountains", "en", "s", 1)]
    for rows, n in ((ODD + extra, None), ([], 0)):
        now = docs(spark, rows, clash=False)
        ids = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "encode":
                assert out.columns == now.columns
            path = str(tmp_path / f"{name}-{len(rows)}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
            ids.append(sorted(str(r["doc_id"]) for r in now.collect()))
        if n == 0:
            assert ids == [[]] * 5
        else:
            assert not {"1", "2", "3", "4"} & set(ids[0]) and {"None", "5", "21"} <= set(ids[0])
            assert ids[1].count("5") == 1 and "6" not in ids[1] and ids[1].count("11") <= 1 and "None" in ids[1]
            assert "20" in ids[2] and "20" not in ids[3] and "21" in ids[4]


def test_texts_with_letters_stay_where_no_language_is_known(spark):
    for lang in (None, "und"):
        rows = [(i, t, lang, "s", 1) for i, (_, t, *_) in enumerate(ODD)]
        kept = corpus_pipeline.language_id(spark, docs(spark, rows, clash=False), "").collect()
        assert sorted(r["doc_id"] for r in kept) == list(range(4, len(ODD)))
