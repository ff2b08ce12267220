"""Operator 5: token counts from a digest cache.

The cache is a folder of Parquet files: (content_sha256, tokenizer_sha256, n_tokens). Counting
joins the digests of the texts to it, encodes one text of each digest it lacks, and appends the
counts. The content is the text itself, with null as empty: a byte-level vocabulary has no
normaliser, and any other change of the text could change its count. The tokenizer's digest is
that of its file.

Only digests and ids are shuffled, and the texts of digests not seen before. Equal texts cost
one encoding however many there are; a cache that knows nearly everything leaves a few ids to
look for, whose texts are found by a broadcast if Spark measures them to be small.
"""

from __future__ import annotations

import hashlib
import os
import sys

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandwise.llm.bpe import WHITE_SPACE, read_file
from strandwise.llm.common import batches, plain, shared_path, store

CACHE = T.StructType(
    [
        T.StructField("content_sha256", T.BinaryType()),
        T.StructField("tokenizer_sha256", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
KNOWN_UNITS = 300_000  # a task remembers the counts of so many units, then starts anew
# White space and the word after it: where it ends, every byte-level token ends too.
_UNIT = regex.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_KEPT = vars(sys).setdefault("_strandwise_tokenizers", {})


class Counter:
    """Token counts of texts by the library, called once for each different unit."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > KNOWN_UNITS:
            self.known = {}
        units = [_UNIT.findall(t) if t else [] for t in texts]
        known = self.known
        new = list({u for found in units for u in found if u not in known})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for unit, encoding in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[unit] = len(encoding)
        return np.array([sum(map(known.__getitem__, found)) for found in units], np.int64)


def counter(content: str) -> Counter:
    key = ("counter", hashlib.sha256(content.encode()).hexdigest())
    if key not in _KEPT:
        _KEPT[key] = Counter(content)
    return _KEPT[key]


def new_cache(spark) -> str:
    """An empty cache in the shared folder."""
    path = shared_path(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.parquet(path)
    return path


def count_tokens(
    docs: DataFrame, tokenizer: str, cache: str, limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row, through the cache in the folder ``cache``.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated keys keep their rows. Two runs that
    append the same digest at once do no harm: the counts are equal and read as one.
    """
    spark = docs.sparkSession
    content = read_file(tokenizer)
    version = hashlib.sha256(content.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(content)

    rows = plain(docs, **{key: "long", text: "string"}).toDF("key", "text")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    digests = store(
        rows.select(
            "key",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.unhex(F.sha2("text", 256)).alias("content_sha256"),
        ),
        "content-digests",
    )
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer_sha256") == version)
    missing = (
        digests.groupBy("content_sha256")
        .agg(F.min("key").alias("key"))
        .join(known, "content_sha256", "left_anti")
    )

    def run(items):
        count = counter(shared.value)
        for batch in batches(items, "text", 2 << 20):
            n = count.counts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["content_sha256", "n_tokens"])

    # One row of each digest: a key may be null or repeat with another text, so the digest of
    # the row found by its key is compared as well, and one row of equals goes on.
    found = (
        rows.withColumn("found", F.unhex(F.sha2("text", 256)))
        .join(missing.select("content_sha256", F.col("key").alias("at")), F.col("key").eqNullSafe(F.col("at")))
        .filter(F.col("found") == F.col("content_sha256"))
        .select("content_sha256", "text")
    )
    counted = found.mapInArrow(run, "content_sha256 binary, n_tokens long")
    counted.select("content_sha256", F.lit(version).alias("tokenizer_sha256"), "n_tokens").write.mode("append").parquet(cache)

    counts = (
        spark.read.schema(CACHE)
        .parquet(cache)
        .filter(F.col("tokenizer_sha256") == version)
        .groupBy("content_sha256")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
    return digests.join(counts, "content_sha256").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
