"""Approximate quartiles, bounds and outlier shares from mergeable quantile sketches.

The opt-in beside the exact profile: one pass over new rows makes one state per column and part
(a day, a batch, a key), a table of a few kilobytes each. States of any parts merge to the
statistics of their union, so a new part is added without reading the old ones again, and a
subset of parts is profiled without reading rows at all.

Count, missing values, least and largest value are exact. A quantile has a rank that is off by
at most ``rank_error(k)`` of the values, with 99 % confidence; while a column has at most ``k``
values the sketch holds them all. Spark keeps one buffer per column and part in a task and
merges them map-side, so a part with most of the rows is no hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.stats import unpivot
from strandwise.operators.joins import join_on

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
STATE_SCHEMA = "part string, column string, n_rows long, n long, least double, most double, sketch binary"
#: Default size: a rank error of 0.3 %, about 12 kB a state.
SIZE = 1600
#: Ranks at which shares are read.
GRID = 1000


def rank_error(k: int) -> float:
    """Published bound of the sketch: 99 % of quantiles are this close in rank."""
    return 2.296 / k**0.9021


def sketch_states(df: DataFrame, columns: Sequence[str], part: str | None = None, k: int = SIZE) -> DataFrame:
    """(part, column, n_rows, n, least, most, sketch): one state per part and column. A null part
    is a part of its own; null and NaN values are missing."""
    named = df.withColumn("_part", F.lit(None).cast("string") if part is None else F.col(f"`{part}`").cast("string"))
    long = unpivot(named, ["_part"], list(columns), "_column", "_value")
    grouped = long.groupBy("_part", "_column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("_value").alias("n"),
        F.min("_value").alias("least"),
        F.max("_value").alias("most"),
        F.kll_sketch_agg_double("_value", k).alias("sketch"),
    )
    return grouped.select(F.col("_part").alias("part"), F.col("_column").alias("column"), "n_rows", "n", "least", "most", "sketch")


def add_states(df: DataFrame, columns: Sequence[str], path: str, part: str | None = None, k: int = SIZE) -> str:
    """Appends the states of new rows to the table of states at ``path``."""
    sketch_states(df, columns, part, k).write.mode("append").parquet(path)
    return path


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(path)


def merge_states(states: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """One state per ``keys``: of all parts, or with ``part`` among the keys of each part."""
    return states.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def quantiles(merged: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """``merged`` plus one column per name; null where a column has no value."""
    return merged.withColumns(
        {
            name: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
            for name, q in probabilities.items()
        }
    )


def sketch_profile(states: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """(keys, n_rows, n, missing_count, least, most, q1, median, q3, lower_bound, upper_bound,
    outlier_share, min_outlier, max_outlier) from states alone.

    ``outlier_share`` is the share of values outside the bounds by the sketch's ranks, off by
    twice its rank error and one step of the grid; the extreme outliers are the least and largest
    value, where they lie outside.
    """
    found = quantiles(merge_states(states, keys), QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    bounded = found.withColumns({"lower_bound": F.col("q1") - 1.5 * iqr, "upper_bound": F.col("q3") + 1.5 * iqr})
    # A sketch takes fixed ranks only, so the share beyond a bound is read off a grid of them.
    grid = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    bounded = bounded.withColumn("grid", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", grid)))
    below, above = F.col("least") < F.col("lower_bound"), F.col("most") > F.col("upper_bound")
    outside = F.filter("grid", lambda x: (x < F.col("lower_bound")) | (x > F.col("upper_bound")))
    return bounded.select(
        *keys,
        "n_rows",
        "n",
        (F.col("n_rows") - F.col("n")).alias("missing_count"),
        "least",
        "most",
        *QUARTILES,
        "lower_bound",
        "upper_bound",
        F.when(F.col("n") > 0, F.size(outside) / GRID).alias("outlier_share"),
        F.when(below, F.col("least")).alias("min_outlier"),
        F.when(above, F.col("most")).alias("max_outlier"),
    )


def rank_gaps(df: DataFrame, columns: Sequence[str], found: DataFrame) -> DataFrame:
    """(column, gap): how far the exact ranks of a profile's quartiles are from what they stand
    for, the largest of each column; a value with ties stands for all their ranks."""
    names = list(QUARTILES)
    long = unpivot(df, [], list(columns), "column", "value").where("value IS NOT NULL")
    counts = []
    for name in names:
        counts += [F.count_if(F.col("value") < F.col(name)).alias(f"{name}_below"), F.count_if(F.col("value") <= F.col(name)).alias(f"{name}_upto")]
    measured = join_on(long, found.select("column", *names), ["column"]).groupBy("column").agg(F.count(F.lit(1)).alias("n"), *counts)
    gaps = []
    for name, q in QUARTILES.items():
        low, high = F.col(f"{name}_below") / F.col("n"), F.col(f"{name}_upto") / F.col("n")
        gaps.append(F.greatest(low - q, q - high, F.lit(0.0)))
    return measured.select("column", F.greatest(*gaps).alias("gap"))
