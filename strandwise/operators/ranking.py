"""Prediction tables: insights, ranks, top sequences and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import sequence as sq
from strandwise.functions.stats import present, unpivot
from strandwise.operators.order_stats import exact_quantiles, with_rank
from strandwise.operators.joins import join_on

PREFIX = "predicted_"


def prediction_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


FACTS = ("sequence_length", "gc_content")


def add_sequence_facts(
    df: DataFrame, sequence: str = "sequence", recompute: bool = False
) -> DataFrame:
    """Adds ``sequence_length`` and ``gc_content``. A table that has both (predictions do)
    keeps them unless asked otherwise, so its sequences need not be read again.
    """
    if sequence not in df.columns or (not recompute and set(FACTS) <= set(df.columns)):
        return df
    return df.withColumns(
        {"sequence_length": sq.sequence_length(sequence), "gc_content": sq.gc_content(sequence)}
    )


def add_insights(df: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    predictions = {c.removeprefix(PREFIX): F.col(c) for c in prediction_columns(df)}
    length = F.col("sequence_length") if "sequence_length" in df.columns else None
    gc = F.col("gc_content") if "gc_content" in df.columns else None
    return df.withColumn("insights", sq.insights(length, gc, predictions, limits))


def ranked_report(
    predictions: DataFrame,
    top_n: int = 10,
    sort_by: str = "predicted_yield",
    key: str = "seq_id",
    sequence: str = "sequence",
    limits: dict[str, float] | None = None,
    ordered: bool = True,
    keep_sequence: bool = False,
) -> DataFrame:
    """Facts, competition rank on ``sort_by`` (highest first), insights, top flag.

    Rows without a prediction have a null rank. Ties at the limit can flag more than
    ``top_n`` rows. Without the ``sort_by`` column there is no rank and no flag is set.
    The sequence itself is turned into facts first and, unless asked for, not carried
    through the rank join and the sort. ``ordered=False`` leaves out the final sort.
    """
    facts = add_insights(add_sequence_facts(predictions, sequence), limits)
    if not keep_sequence:
        facts = facts.drop(sequence)
    if sort_by not in predictions.columns:
        return facts.withColumn("top_performer", F.lit(False))
    ranked = with_rank(
        facts, sort_by, "rank", descending=True, source=predictions.select(sort_by)
    )
    ranked = ranked.withColumn(
        "top_performer", F.coalesce(F.col("rank") <= top_n, F.lit(False))
    )
    if not ordered:
        return ranked
    # The key as tie-break also splits the range of a value that many rows share.
    return ranked.orderBy(F.col("rank").asc_nulls_last(), key)


def top_sequences(
    predictions: DataFrame,
    n: int = 10,
    sort_by: str = "predicted_yield",
    key: str = "seq_id",
    sequence: str = "sequence",
) -> DataFrame:
    """The first ``n`` rows of the ranked report, without ranking the table.

    Everything ranked above one of these rows is among them, so their rank within the
    ``n`` rows is the rank in the table.
    """
    best = (
        predictions.where(present(predictions, sort_by))
        .orderBy(F.col(sort_by).desc(), key)
        .limit(n)
    )
    facts = add_insights(add_sequence_facts(best, sequence))
    ranked = facts.withColumn("rank", F.rank().over(Window.orderBy(F.col(sort_by).desc())))
    return ranked.select(
        key, F.col("rank").cast("bigint").alias("rank"), "insights", *prediction_columns(predictions)
    )


def prediction_summary(predictions: DataFrame, p90: bool = True) -> DataFrame:
    """(target, mean, min, max, p90) per prediction column."""
    columns = prediction_columns(predictions)
    long = unpivot(predictions, [], columns, "target", "value").withColumn(
        "target", F.regexp_replace("target", f"^{PREFIX}", "")
    )
    basic = long.groupBy("target").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    if not p90:
        return basic
    high = exact_quantiles(long, "value", {"p90": 0.9}, ["target"])
    return join_on(basic, high, ["target"], "left")


def insight_distribution(report: DataFrame, top: int = 10) -> DataFrame:
    """(insights, count, percentage of all rows), the ``top`` most frequent ones."""
    counts = report.groupBy("insights").agg(F.count(F.lit(1)).alias("count"))
    # One row per distinct insight text (a small rule set), so the total is cheap.
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    shares = counts.withColumn("percentage", F.col("count") * 100.0 / total)
    return shares.orderBy(F.col("count").desc(), "insights").limit(top)


def sequence_characteristics(report: DataFrame) -> DataFrame:
    """One row: length and GC range and mean."""
    return report.agg(
        F.min("sequence_length").alias("min_length"),
        F.max("sequence_length").alias("max_length"),
        F.avg("sequence_length").alias("mean_length"),
        F.min("gc_content").alias("min_gc"),
        F.max("gc_content").alias("max_gc"),
        F.avg("gc_content").alias("mean_gc"),
    )
