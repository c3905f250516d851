"""What the operators promise beyond the twins: repeated rows, null ids, sizes without a limit, measured recall, parts that count."""

import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoplan.llm import common, components, decontam, langid, nearcopies, sharding, topk, toxicity

TEXTS = "doc_id long, text string"


# -- top-k ----------------------------------------------------------------------------------------


def plain_top(rows, k, every):
    """Brute force over rows, whole numbers of any size."""
    made = [(i, tuple(int(np.floor(256.0 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(made):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for c, (j, w) in enumerate(made) if c != q and len(w) == len(v))
            out += [(i, n, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for n, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_repeated_rows_are_candidates_and_queries_each(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=4).round(2).tolist()) for i in range(40)]
    rows += [rows[0], rows[0], rows[7], rows[7], (7, [0.5, 0.5, 0.5, 0.5]), (10, None), (20, [1.0, None, 0.0, 0.0]), (30, [float("nan"), 0.0, 0.0, 0.0]), (None, [9.0] * 4), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k_inner_product(df, k=5, every=10)
    assert sorted(tuple(r)[:4] for r in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 5, 10)


def test_large_components_are_exact_and_do_not_fail(spark):
    rows = [(0, [8388608.0, 3.5]), (1, [2000000.50390625, 1.0]), (2, [-1e9, 2.0]), (3, [2000000.5, 1.0]), (10, [3.0e7, -2.0e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k_inner_product(df, k=3, every=10).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == plain_top(rows, 3, 10)


# -- shards ---------------------------------------------------------------------------------------


def test_draws_follow_the_hypergeometric_law_at_any_size():
    draw = np.random.default_rng(2)
    got = Counter(sharding.hypergeometric(float(u), 30, 50, 20) for u in draw.random(20_000))
    want = Counter(draw.hypergeometric(30, 50, 20, 20_000).tolist())
    assert all(abs(got[x] - want[x]) < 6 * (want[x] + 25) ** 0.5 for x in set(got) | set(want))
    good, bad, sample = 3 * 10**11, 5 * 10**11, 10**9
    many = np.array([sharding.hypergeometric(float(u), good, bad, sample) for u in draw.random(400)], float)
    mean = sample * good / (good + bad)
    spread = (mean * bad / (good + bad)) ** 0.5
    assert abs(many.mean() - mean) < 5 * spread / 20 and 0.8 < many.std() / spread < 1.2
    assert sharding.hypergeometric(0.5, 0, 5, 3) == 0 and sharding.hypergeometric(0.5, 5, 0, 3) == 3


def test_very_many_equal_rows_are_spread(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text")).unionByName(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    got = sharding.shard_documents(rows).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(got) == 16 and sum(r["n"] for r in got) == 30_100
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in got) and max(r["n"] for r in got) - min(r["n"] for r in got) <= 1


# -- near copies ----------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def planted(n, low, high, every=55):
    """Pairs of texts whose similarity lies in a narrow band; one word in ``every`` is another."""
    draw = random.Random(8)
    pairs = []
    for _ in range(100 * n):
        if len(pairs) == n:
            break
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(60, 240))]
        other = list(words)
        for at in draw.sample(range(len(words)), max(1, len(words) // every)):
            other[at] = f"x{draw.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        if low <= jaccard(a, b) <= high:
            pairs.append((a, b))
    assert len(pairs) == n
    return pairs


def test_recall_is_measured_on_planted_pairs(spark):
    pairs = planted(600, 0.8, 0.85)
    df = spark.createDataFrame([(2 * n + k, text) for n, pair in enumerate(pairs) for k, text in enumerate(pair)], TEXTS)
    found = {r["doc_id"]: r["class_id"] for r in nearcopies.jaccard_join(df).collect()}
    assert np.mean([found[2 * n] == found[2 * n + 1] for n in range(len(pairs))]) >= 0.99
    below = planted(100, 0.7, 0.79, 35)
    df = spark.createDataFrame([(2 * n + k, text) for n, pair in enumerate(below) for k, text in enumerate(pair)], TEXTS)
    assert all(r["n_links"] == 0 for r in nearcopies.jaccard_join(df).collect())


def test_links_of_a_large_class_equal_brute_force(spark):
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in draw.sample(range(120), draw.randint(0, 3)):
            words[at] = f"y{i}x{at}"
        texts.append(" ".join(words))
    texts += texts[:5]
    want = [sum(jaccard(a, b) >= 0.8 - 1e-12 for j, b in enumerate(texts) if j != i) for i, a in enumerate(texts)]
    got = {r["doc_id"]: r["n_links"] for r in nearcopies.jaccard_join(spark.createDataFrame(list(enumerate(texts)), TEXTS)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_null_ids_do_not_multiply(spark):
    words = [" ".join(f"w{i // 2}x{j}" for j in range(30)) + (" tail" if i % 2 else "") for i in range(300)]
    got = nearcopies.jaccard_join(spark.createDataFrame([(None, w) for w in words], TEXTS)).collect()
    assert len(got) == 300 and all(r["class_id"] is None and r["n_links"] == 1 for r in got)


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.connected_components(chain).select("root").distinct().count() == 1
    with pytest.raises(RuntimeError):
        components.connected_components(chain, most_rounds=1)


# -- benchmark ------------------------------------------------------------------------------------


def test_passes_and_item_ids_of_any_type(spark):
    draw = random.Random(6)
    items = [" ".join("".join(draw.choice("abcdefg") for _ in range(5)) for _ in range(12)) for _ in range(12)]
    docs = spark.createDataFrame([(i, f"before {items[i]} after" if i < 12 else "plain words only") for i in range(20)], TEXTS)
    bench = spark.createDataFrame([(Decimal(i), x) for i, x in enumerate(items)], "item_id decimal(10,0), text string")
    for chars in (decontam.BLOCK_CHARS, 200):
        got = {(r["doc_id"], int(r["item_id"])) for r in decontam.find_contamination(docs, bench, block_chars=chars).collect()}
        assert got == {(i, i) for i in range(12)}
        assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, bench, block_chars=chars).collect()) == list(range(12, 20))


def test_null_and_shared_ids_are_decided_by_their_texts(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "say one two three four five six seven eight nine"), (None, "a clean text"), (4, "one two three four five six seven eight nine"), (4, "clean as well")], TEXTS)
    assert sorted(r["text"] for r in decontam.clean_documents(docs, bench).collect()) == ["a clean text", "clean as well"]


# -- language -------------------------------------------------------------------------------------


def test_numerals_are_no_letters(spark):
    rows = [(i, ("the house of the man with the dog " if i % 2 else "la maison de la femme avec le chien ") * 3, ("en", "fr")[1 - i % 2]) for i in range(40)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = spark.createDataFrame([(1, "½ ² ① ⅷ 12 _"), (2, "² the house of the man"), (3, "日")], TEXTS)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert got[1]["lang_pred"] == "und" and got[1]["letters"] == 0 and got[2]["lang_pred"] == "en" and got[3]["letters"] == 1


# -- toxicity -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def learned(spark):
    draw = random.Random(5)
    filler = lambda: " ".join(draw.choice("river stone market window garden letter summer paper bridge candle".split()) for _ in range(20))
    bad = ["scumbag", "idiots", "moronic", "scum"]
    rows = [(i, f"{filler()} you {draw.choice(bad)} {filler()}" if i % 5 == 0 else filler()) for i in range(600)]
    labels = [(i, int(i % 5 == 0)) for i in range(600)]
    return toxicity.fit_toxicity(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(labels, "doc_id long, toxic int"))


def scores(spark, model, texts):
    return {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), TEXTS), model).collect()}


def test_misspellings_alone_change_a_prediction(spark, learned):
    texts = ["what a scumbagg this is", "what a scmbag this is", "such skum by the river", "such moronik words of stone", "a scramble by the river"]
    assert scores(spark, learned, texts) == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0}
    bare = toxicity.ToxicityModel(toxicity.Lexicon(learned.lexicon.terms, learned.lexicon.stems, {}), learned.context, learned.weights)
    assert scores(spark, bare, texts)[2] == 0


def test_quotation_alone_changes_a_prediction(spark, learned):
    texts = ["he is a scumbag by the river", "the paper quoted the word scumbag in a letter", 'in the letter stood "scumbag" and no more', 'he said you are a scumbag']
    assert scores(spark, learned, texts) == {0: 1, 1: 0, 2: 0, 3: 1}


def test_neighbours_of_a_term_in_clean_texts_lower_its_misspellings(spark):
    rows = [(i, f"you are a trash person w{i}" if i % 5 == 0 else f"we thrash the grain and crash the market w{i}") for i in range(300)]
    labels = [(i, int(i % 5 == 0)) for i in range(300)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "trash" not in model.lexicon.fuzzy
    assert scores(spark, model, ["they crash in the rain", "what trash"]) == {0: 0, 1: 1}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_automata_equal_brute_force_with_stems_and_two_edits():
    draw = random.Random(0)
    word = lambda a, b: "".join(draw.choice("abc") for _ in range(draw.randint(a, b)))
    terms, stems = {word(3, 10): 1.0 for _ in range(25)}, {word(5, 6): 1.0 for _ in range(3)}
    lexicon = toxicity.Lexicon(terms, stems)
    for _ in range(2000):
        w = word(3, 11)
        near = {t: edits(w, t) for t in lexicon.terms} | {f"{t}*": min(edits(w[:n], t) for n in range(len(w) + 1)) for t in stems}
        near = {t: d for t, d in near.items() if 0 < d <= toxicity.budget(t)}
        found = lexicon.near(w)
        assert (found is None) == (not near), w
        if found is not None:
            assert found[1] == near[found[0]] == min(near.values())
            exact = w in lexicon.terms or any(w[:n] in stems for n in toxicity.STEMS)
            assert exact or lexicon.match(w) == found


def test_words_that_are_ruled_out_together_have_no_match(monkeypatch):
    draw = random.Random(1)
    word = lambda a, b: "".join(draw.choice("abcß") for _ in range(draw.randint(a, b)))
    lexicon = toxicity.Lexicon({word(2, 10): 1.0 for _ in range(25)}, {word(4, 6): 1.0 for _ in range(3)})
    words = list({word(1, 12) for _ in range(3000)})
    want = {w: m for w in words if (m := lexicon.match(w)) is not None}
    assert lexicon.matches(words) == want and 0 < len(want) < len(words)
    assert toxicity.Lexicon({}, {}).matches(words) == {}
    # Texts in parts, and words forgotten between them, give what each word gives.
    monkeypatch.setattr(toxicity, "TEXTS", 100)
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 50)
    texts = [" ".join(words[i : i + 7]).upper() + ' "' for i in range(0, 700, 7)] + [""]
    got = [{w: found[w] for w in read if w in found} for read, found in toxicity.Matcher(lexicon).read(texts)]
    assert got == [{w: m for w in toxicity.TOKENS.findall(text.lower()) if (m := lexicon.match(w))} for text in texts]


# -- shared ---------------------------------------------------------------------------------------


def test_batches_are_bounded_by_bytes(spark):
    common.in_bounded_batches(spark.range(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == common.ARROW_BYTES
