"""Exact-size seeded split and fold numbers, both functions of the key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading hex digits of the hash that name a bucket: 16^5 buckets, about a million counts.
PREFIX = 5
# So many rows may be put in order by one task.
IN_ORDER = 10_000


def split_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def _cutoff(df: DataFrame, key: str, n_test: int, seed: int) -> tuple[str, object]:
    """The (hash, key) of the last test row.

    Rows are counted per hash prefix, then, within the prefix that the cut falls into, per
    prefix of PREFIX more digits, until a bounded number of rows is left to put in order.
    Each count has at most 16^PREFIX rows, whatever the table size.
    """
    hashed = df.select(F.col(key).alias("id"), split_hash(key, seed).alias("h"))
    bucket, left, size = "", n_test, None
    while size is None or size > IN_ORDER and len(bucket) < 32:
        inner = hashed.where(F.col("h").startswith(bucket))
        prefix = F.substring("h", 1, len(bucket) + PREFIX)
        counts = inner.groupBy(prefix.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        crossing = (
            counts.withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))
            .where((F.col("upto") >= left) & (F.col("upto") - F.col("n") < left))
            .first()
        )
        bucket, size = crossing["bucket"], crossing["n"]
        left -= crossing["upto"] - size
    # More rows than IN_ORDER are left only if they have one hash, that is, one key.
    inside = hashed.where(F.col("h").startswith(bucket)).groupBy("h", "id").agg(
        F.count(F.lit(1)).alias("n")
    )
    row = (
        inside.withColumn("upto", F.sum("n").over(Window.orderBy("h", "id")))
        .where(F.col("upto") >= left)
        .orderBy("upto")
        .first()
    )
    if row["upto"] != left:
        raise ValueError(f"'{key}' is not unique, an exact split is not possible")
    return row["h"], row["id"]


def split(
    df: DataFrame,
    test_size: float = 0.2,
    seed: int = 42,
    key: str = "seq_id",
    mode: str = "exact",
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with ``max(1, int(n * test_size))`` test rows.

    The rows are ordered by md5 of key and seed; the first ones are the test rows. Both
    parts are plain filters, so there is no join and no sort of the table, the same rows
    come out under any partitioning, and together they are the whole table. ``approx``
    skips the counting and cuts at the expected hash.
    """
    if mode not in ("exact", "approx"):
        raise ValueError(f"unknown mode '{mode}'")
    h = split_hash(key, seed)
    if mode == "approx":
        share = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)
        in_test = share < test_size
    else:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("keys")).first()
        n = row["n"]
        if n < 2:
            raise ValueError("a split needs at least two rows")
        if row["keys"] < n:
            raise ValueError(f"'{key}' is null in {n - row['keys']} rows")
        last_hash, last_id = _cutoff(df, key, max(1, int(n * test_size)), seed)
        in_test = (h < last_hash) | ((h == last_hash) & (F.col(key) <= F.lit(last_id)))
    return df.where(~in_test), df.where(in_test)


def fold_of(key: str, folds: int, seed: int = 42) -> Column:
    """Fold number 0 .. folds - 1, from another hash than the split uses."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:fold")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.pmod(number, F.lit(folds)).cast("int")
