"""The registered queries: DuckDB twins, the tokenizers library, held-out accuracy."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sinoplan.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def test_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, duck, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


def test_ids_and_counts_equal_the_library(spark, duck):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = duck.sql("select doc_id, text from documents").fetchall()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows}
    counts = {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, DIR).collect()}
    assert counts == {i: len(x) for i, x in want.items()}
    for r in queries.op9_bpe(spark, DIR).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(want[r["doc_id"]], "<u4").tobytes()).hexdigest()


def test_held_out_accuracy(spark, duck):
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    held = [r for r in queries.op5_language(spark, DIR).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    toxic = dict(duck.sql("select doc_id, toxic from labels").fetchall())
    held = [r for r in queries.op4_toxicity(spark, DIR).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.9


def test_planted_benchmark_passages(spark, duck):
    want = set(duck.sql("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)").fetchall())
    assert want <= {(r["doc_id"], r["item_id"]) for r in queries.op2_decontaminate(spark, DIR).collect()}


def test_toxicity_recall_and_precision(spark):
    """On the held-out tenth of the larger tables, each asked for on its own."""
    large = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{large}/labels.parquet'").fetchall())
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in queries.op4_toxicity(spark, large).collect() if r["held_out"] and r["doc_id"] in toxic]
    caught = sum(p and t for p, t in held)
    assert caught / sum(t for _, t in held) >= 0.9 and caught / sum(p for p, _ in held) >= 0.9


def test_archive_twin_with_nulls_as_nulls(spark, duck):
    """Rows as Python has them: data frames give the nulls of a column without a value as NaN or as NA, which no ``==`` compares."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = duck.sql(queries.oracle_sql()["op11_warc"]).project(", ".join(names)).fetchall()
    got = map(tuple, queries.op11_warc(spark, DIR).select(names).collect())
    assert sorted(got, key=repr) == sorted(want, key=repr)
