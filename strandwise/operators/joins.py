"""Joins to per-key tables that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.stats import present
from strandwise.session import settle


def join_on(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    also: Column | None = None,
    never_null: Sequence[str] = (),
) -> DataFrame:
    """Null-safe equi-join on ``on``: the left columns, then the other right columns.

    Columns are matched by name, so both sides may come from one table. ``also`` adds a
    condition. Keys in ``never_null`` are compared plainly, which sorts and hashes less.
    """
    extra = [c for c in right.columns if c not in on]
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in on], *extra)
    condition = F.lit(True) if also is None else also
    for k in on:
        other = F.col(f"_right_{k}")
        condition = condition & (F.col(k) == other if k in never_null else F.col(k).eqNullSafe(other))
    joined = left.join(renamed, condition, how)
    return joined.select(*left.columns, *extra)


def spread(columns: Sequence[str], salts: int) -> Column:
    """Repeatable salt: depends on the row and its input split only."""
    return F.pmod(F.xxhash64(*columns) + F.spark_partition_id(), F.lit(salts)).cast("int")


def join_small(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join to a table with one row per key, usually a handful of rows.

    The table is settled, so that Spark knows its bytes: it broadcasts it within
    ``spark.sql.autoBroadcastJoinThreshold``; otherwise both sides are shuffled, and
    adaptive execution splits the partition of a key that has most of the rows.
    """
    return join_on(df, settle(table), on, how)


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: list[str],
    salts: int,
    hot: DataFrame | None = None,
    hot_from: int = 0,
) -> DataFrame:
    """Left join to a table with one row per ``on`` and the number of its ``ties``.

    ``hot`` lists the few keys with more than ``hot_from`` ties: they get a salt, so their
    rows spread over all partitions, and their lookup row is repeated per salt. Rows whose
    last key is missing match nothing and are spread the same way.
    """
    missing = ~present(df, on[-1])
    salt = spread(df.columns, salts)
    if hot is None:
        rows = df.withColumn("_salt", F.when(missing, salt).otherwise(0))
        # Not a literal: a constant would be taken out of the join keys again, and the
        # rows without a value would all hash alike.
        right = lookup.withColumn("_salt", F.when(F.col("ties") > 0, 0).otherwise(-1))
    else:
        marked = join_small(df, hot.select(*on).withColumn("_hot", F.lit(True)), on)
        rows = marked.withColumn(
            "_salt", F.when(F.col("_hot") | missing, salt).otherwise(0)
        ).drop("_hot")
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        one = F.array(F.lit(0))
        right = lookup.withColumn(
            "_salt", F.explode(F.when(F.col("ties") > hot_from, every).otherwise(one))
        )
    plain = [on[-1], "_salt"]
    order = [*plain, *on[:-1]]
    return join_on(rows, right.drop("ties"), order, "left", never_null=plain).drop("_salt")
