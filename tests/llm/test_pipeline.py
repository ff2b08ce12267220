"""Every stage of the pipeline by itself on its own input, and all of them together."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from strandwise.llm.common import store  # noqa: E402

MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    kept = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, MORE), name)
        kept[name] = docs
    return kept


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    columns = stages["input"].columns
    assert all(stages[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])


def test_language_keeps_clean_documents(stages):
    assert stages["language"].count() >= 0.99 * stages["input"].count()


def test_near_duplicates(stages):
    before = texts(stages["language"])
    parts = brute.jaccard(before.items())
    heads = {d for d, (n, c) in parts.items() if d == c or not n}
    assert texts(stages["near_duplicates"]) == {d: before[d] for d in heads}


def test_substrings(stages):
    before, after = texts(stages["near_duplicates"]), texts(stages["substrings"])
    expected = brute.substrings(before.items())
    assert set(after) == {d for d, (n, gone, _) in expected.items() if not gone or gone < n}
    for d, text in after.items():
        assert (text == before[d]) if not expected[d][1] else len(text.split()) == expected[d][0] - expected[d][1]


def test_private(stages):
    before, after = texts(stages["substrings"]), texts(stages["private"])
    assert set(before) == set(after)
    assert all(not brute.private(t) for t in after.values())
    assert stages["private"].filter("length(text) <> n_chars").count() == 0


def test_packing(stages):
    rows = stages["packing"].collect()
    assert {r.doc_id for r in rows} == set(texts(stages["private"]))


def test_odd_rows_pass(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row int, `a.b` string"
    rows = [(1, "der hund ist hier und dort wo der hund ist", "de", "s", 3, 1, "x"), (None, None, None, None, None, None, None), (2, "", "en", "s", 0, 2, "y"), (1, "das ist der hund und das ist gut", "de", "s", 3, 1, "z")]
    for rows in (rows, []):
        docs = spark.createDataFrame(rows, columns)
        for name, stage in corpus_pipeline.STAGES:
            out = store(stage(spark, docs, MORE), name)
            if name != "packing":
                assert out.columns == docs.columns
            docs = out
        assert bool(docs.count()) == bool(rows)


def test_language_without_labels_keeps_texts(spark):
    rows = [(1, "some words", None, "a", 10), (2, "123 !", None, "a", 5), (3, None, None, "b", None), (6, "é", "xx", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, unlabelled, "").collect()) == [1, 6]


def test_language_keeps_columns_of_any_name(spark):
    rows = [(i, "the cat is here and there", "en", "x", 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _letters int")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
