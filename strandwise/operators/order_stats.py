"""Exact ranks and quantiles without putting a group into one task.

A group (a target, or the whole table) may hold most of the rows, so neither a window over
the group nor the built-in ``percentile`` (whose buffer keeps every distinct value of the
group) is safe. Instead:

1. ``groupBy(keys, value).count()``: ties collapse map-side.
2. The distinct values are range-partitioned on ``(keys, value)`` and written to the
   checkpoint folder with the number of their block, so block membership cannot change if
   an executor is lost.
3. A block's offset is the running total of the earlier blocks of its key; that window
   sees one row per block, never one row per value.
4. Inside a block a running total gives the exact number of rows in front of a value.

The blocks are folders of the stored table: a quantile reads the blocks its position falls
into, found by partition pruning at run time, and skips the others. If the stored counts of
step 1 have at most ``ONE_BLOCK`` bytes, they are the only block and steps 2 and 3 fall away;
positions, and so all results, are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.stats import present
from strandwise.operators.joins import join_on, join_small, lookup_join
from strandwise.session import broadcast_bytes, settle, stored_bytes

# A value held by more than this share of all rows counts as hot, so there are never
# more than 1 / HOT_SHARE hot values.
HOT_SHARE = 0.01
# Stored bytes of the counts of distinct values up to which they make one block.
ONE_BLOCK = 8 << 20


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by(keys: Sequence[str], *more: str):
    """Window partitioning; a constant stands in when there are no keys."""
    columns = [F.col(k) for k in (*keys, *more)]
    return Window.partitionBy(*(columns or [F.lit(0)]))


class ValueBlocks:
    """The settled distinct values of a column, with their blocks and block offsets."""

    def __init__(
        self,
        df: DataFrame,
        value: str,
        keys: Sequence[str] = (),
        descending: bool = False,
        weight: str | None = None,
        blocks: int | None = None,
    ):
        self.value, self.keys, self.descending = value, list(keys), descending
        self.blocks = blocks or shuffle_partitions(df)
        size = F.sum(weight) if weight else F.count(F.lit(1))
        counts = settle(
            df.where(present(df, value)).groupBy(*self.keys, value).agg(size.alias("_ties"))
        )
        self.single = blocks is None and stored_bytes(counts) <= ONE_BLOCK
        if self.single:
            self.values = counts.withColumn("_block", F.lit(0))
            self.offsets = self._offsets()
            return
        self.values = settle(
            counts.repartitionByRange(self.blocks, *self.keys, self._order()).withColumn(
                "_block", F.spark_partition_id()
            ),
            "_block",
        )
        self.offsets = settle(self._offsets())

    def _order(self) -> Column:
        return F.col(self.value).desc() if self.descending else F.col(self.value).asc()

    def _offsets(self) -> DataFrame:
        """(keys, block, size, start, total): one row per key and block."""
        totals = self.values.groupBy(*self.keys, "_block").agg(
            F.sum("_ties").alias("_size"), F.max("_ties").alias("_top")
        )
        earlier = _by(self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        return totals.withColumns(
            {
                "_start": F.coalesce(F.sum("_size").over(earlier), F.lit(0)),
                "_total": F.sum("_size").over(_by(self.keys)),
            }
        )

    def _running(self, values: DataFrame) -> DataFrame:
        inside = (
            _by(self.keys, "_block")
            .orderBy(self._order())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return values.withColumn("_upto", F.sum("_ties").over(inside))

    def ranks(self) -> DataFrame:
        """(keys, value, ties, before, total); ``before`` counts the rows in front."""
        joined = join_on(self._running(self.values), self.offsets, [*self.keys, "_block"])
        return joined.select(
            *self.keys,
            self.value,
            F.col("_ties").alias("ties"),
            (F.col("_start") + F.col("_upto") - F.col("_ties")).alias("before"),
            F.col("_total").alias("total"),
        )

    def quantiles(self, probabilities: dict[str, float]) -> DataFrame:
        """(keys, one column per name): linear interpolation between order statistics."""
        if self.descending:
            raise ValueError("quantiles need ascending blocks")
        asked = [
            F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q"))
            for name, q in probabilities.items()
        ]
        wanted = self.offsets.select("*", F.explode(F.array(*asked)).alias("_p"))
        exact = F.col("_p.q") * (F.col("_total") - 1)
        wanted = wanted.withColumn("_exact", exact).select(
            *self.keys,
            "_block",
            "_start",
            F.col("_p.name").alias("_name"),
            (F.col("_exact") - F.floor("_exact")).alias("_fraction"),
            F.posexplode(F.array(F.floor("_exact"), F.ceil("_exact"))).alias("_upper", "_position"),
            (F.col("_start") + F.col("_size")).alias("_end"),
        )
        wanted = wanted.where(
            (F.col("_position") >= F.col("_start")) & (F.col("_position") < F.col("_end"))
        )
        # At most two blocks per key and quantile are read from here on.
        values = self.values
        if not self.single:
            touched = wanted.groupBy(*self.keys, "_block").agg(F.lit(True).alias("_touched"))
            values = join_small(values, touched, [*self.keys, "_block"], how="inner")
        end = F.col("_start") + F.col("_upto")
        reached = (F.col("_position") < end) & (F.col("_position") >= end - F.col("_ties"))
        hit = join_on(
            self._running(values), wanted, [*self.keys, "_block"], also=reached
        ).withColumn("_v", F.col(self.value).cast("double"))
        picked = []
        for name in probabilities:
            side = [
                F.max(F.when((F.col("_name") == name) & (F.col("_upper") == u), F.col("_v")))
                for u in (0, 1)
            ]
            part = F.max(F.when(F.col("_name") == name, F.col("_fraction")))
            picked.append((side[0] + (side[1] - side[0]) * part).alias(name))
        return hit.groupBy(*self.keys).agg(*picked)

    def hot_ties(self) -> int | None:
        """Tie count above which a value is hot, or None if no value is."""
        row = self.offsets.agg(F.sum("_size").alias("n"), F.max("_top").alias("top")).first()
        return hot_limit(row["n"], row["top"])


def hot_limit(rows: int | None, top: int | None) -> int | None:
    """Ties above which one of ``rows`` values is hot, or None if the most frequent isn't."""
    if not rows:
        return None
    limit = max(int(rows * HOT_SHARE), 1)
    return limit if top > limit else None


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key with the named quantiles; null and NaN are left out."""
    rows = df.where(present(df, value)).select(*keys, value)
    return ValueBlocks(rows, value, keys).quantiles(probabilities)


def with_rank(
    df: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = (),
    method: str = "min",
    descending: bool = False,
    weight: str | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus the rank of ``value`` within ``keys``; null where the value is missing.

    ``method`` is ``min`` (competition rank, bigint) or ``average`` (double). With
    ``weight`` a row stands for that many equal rows. ``source`` is a cheaper table with the
    same values.
    """
    blocks = ValueBlocks(df if source is None else source, value, keys, descending, weight)
    return attach_ranks(df, blocks, out, method)


def rank_number(method: str) -> Column:
    """The rank in a table of ``ranks``."""
    return {
        "min": F.col("before") + 1,
        "average": F.col("before") + (F.col("ties") + 1) / 2,
    }[method]


def attach_ranks(df: DataFrame, blocks: ValueBlocks, out: str, method: str = "min") -> DataFrame:
    """``with_rank`` by lookup in the settled blocks of ``df`` or of a table with the same
    values. A lookup table small enough to be broadcast needs no shuffle of the rows; beyond
    that rows of hot values and rows without a value are spread over all tasks.
    """
    on = [*blocks.keys, blocks.value]
    lookup = settle(blocks.ranks().select(*on, "ties", rank_number(method).alias(out)))
    return look_up(df, lookup, on, blocks.blocks)


def look_up(df: DataFrame, lookup: DataFrame, on: list[str], salts: int) -> DataFrame:
    """``df`` plus the columns of a settled table of (on, ties, columns)."""
    if stored_bytes(lookup) <= broadcast_bytes(df.sparkSession):
        return join_on(df, lookup.drop("ties"), on, "left")
    row = lookup.agg(F.sum("ties").alias("n"), F.max("ties").alias("top")).first()
    limit = hot_limit(row["n"], row["top"])
    if limit is None:
        return lookup_join(df, lookup, on, salts)
    hot = lookup.where(F.col("ties") > limit)
    return lookup_join(df, lookup, on, salts, hot, limit)
