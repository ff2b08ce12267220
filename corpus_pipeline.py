"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that its predecessor kept, and its decisions take effect. Stages but the
last return the columns of the documents they get; each result is written as Parquet to the
shared folder and read again as the next stage's documents.

1. language: documents without a letter, or whose language stays open, go. Where no label can
   be learned from, only those without a letter go.
2. near_duplicates: of documents whose 5-word shingle sets link at a Jaccard similarity of 0.8,
   directly or through others, the one with the least key stays. Documents without words, and
   those without a key, link with nothing and stay.
3. substrings: words of a passage of 13 words or more that a document with a smaller key also
   has are cut out; a document that loses words continues with the others, joined by one space.
   A document that loses all its words goes.
4. private: personal data is replaced by its kind in brackets.
5. packing: the texts become tokens, packed into sequences of 2,048.

``n_chars``, where it is a column, follows the text. Other columns, whatever their names, pass
through the first four stages unchanged. Empty tables pass through all stages. Rows that repeat
a key and its text are one row after the second stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import jaccard_join, language_id, packing, pii, substring_dedup
from strandwise.llm.common import store

#: The least part of the winner's and the runner-up's hits for a language to count as known.
LEAST_SCORE = 0.52


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars``, if there is such a column, of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length(F.col("text").cast("string")).cast(kind), F.col("n_chars")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = language_id.learn(docs)
    if not known.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    inner = docs.toDF(*(c if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)))
    scored = language_id.predict(inner, known)
    kept = scored.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.drop("lang_pred", "score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.heads(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.rewrite(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("private", private),
    ("packing", pack),
]

# Learned filters, trees and a tokenizer are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
