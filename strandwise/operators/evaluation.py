"""Regression metrics over (target, y_true, y_pred) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import labels
from strandwise.functions.stats import cleaned, correlation_p, present, ratio_or_zero_rule
from strandwise.operators import order_stats
from strandwise.operators.order_stats import exact_quantiles
from strandwise.operators.joins import join_on
from strandwise.session import settle, stored_bytes

# Metric columns in report order.
METRICS = (
    "r2", "mse", "rmse", "mae", "median_ae", "explained_variance",
    "pearson_r", "pearson_p", "spearman_r", "spearman_p", "mape",
    "mean_true", "std_true", "mean_pred", "std_pred",
    "mean_residual", "std_residual", "max_residual",
)


def pair(truth: DataFrame, predicted: DataFrame, on: Sequence[str] = ("seq_id", "target")) -> DataFrame:
    """Inner equi-join of (on, y_true) and (on, y_pred)."""
    return truth.join(predicted, list(on))


def long_pairs(
    df: DataFrame, targets: Sequence[str], key: str = "seq_id", prefix: str = "predicted_"
) -> DataFrame:
    """(key, target, y_true, y_pred) from a table that has both columns per target."""
    entries = [
        F.struct(
            F.lit(t).alias("target"),
            cleaned(df, t).cast("double").alias("y_true"),
            cleaned(df, prefix + t).cast("double").alias("y_pred"),
        )
        for t in targets
    ]
    return df.select(key, F.inline(F.array(*entries)))


def residuals(pairs: DataFrame) -> DataFrame:
    """Adds ``residual`` = y_true - y_pred (the data behind residual and scatter plots)."""
    return pairs.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def _complete(pairs: DataFrame) -> DataFrame:
    """Pairs with both values; a null or NaN on either side takes the pair out."""
    return pairs.where(present(pairs, "y_true") & present(pairs, "y_pred")).select(
        "target", F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    )


def moment_metrics(pairs: DataFrame) -> DataFrame:
    """Every metric that needs no ordering, from one partial aggregate per target."""
    rows = residuals(_complete(pairs)).withColumn("size", F.abs("residual"))
    e, y, p = F.col("residual"), F.col("y_true"), F.col("y_pred")
    grouped = rows.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e * e).alias("mse"),
        F.avg("size").alias("mae"),
        # ``corr`` fails on a constant side in ANSI mode; null is what is wanted.
        F.try_divide(F.covar_pop(y, p), F.sqrt(F.var_pop(y) * F.var_pop(p))).alias("pearson_r"),
        F.when(
            F.count_if(y == 0) == 0, F.avg(F.try_divide(F.col("size"), F.abs(y))) * 100
        ).alias("mape"),
        F.avg(y).alias("mean_true"),
        F.var_pop(y).alias("var_true"),
        F.avg(p).alias("mean_pred"),
        F.stddev_pop(p).alias("std_pred"),
        F.avg(e).alias("mean_residual"),
        F.var_pop(e).alias("var_residual"),
        F.max("size").alias("max_residual"),
    )
    return grouped.select(
        "target",
        "n",
        F.when(F.col("n") >= 2, ratio_or_zero_rule(F.col("mse"), F.col("var_true"))).alias("r2"),
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        ratio_or_zero_rule(F.col("var_residual"), F.col("var_true")).alias("explained_variance"),
        F.nanvl("pearson_r", F.lit(None).cast("double")).alias("pearson_r"),
        "mape",
        "mean_true",
        F.sqrt("var_true").alias("std_true"),
        "mean_pred",
        "std_pred",
        "mean_residual",
        F.sqrt("var_residual").alias("std_residual"),
        "max_residual",
    )


def median_absolute_error(pairs: DataFrame) -> DataFrame:
    """(target, median_ae)"""
    rows = residuals(_complete(pairs)).select("target", F.abs("residual").alias("size"))
    return exact_quantiles(rows, "size", {"median_ae": 0.5}, ["target"])


SIDES = {"y_true": "rank_true", "y_pred": "rank_pred"}


def _ranked_in_place(counted: DataFrame) -> DataFrame:
    """Average ranks of both sides from two sorts of a target's pairs."""
    for side, rank in SIDES.items():
        upto = F.sum("w").over(Window.partitionBy("target").orderBy(side))
        ties = F.sum("w").over(Window.partitionBy("target", side))
        counted = counted.withColumn(rank, upto - (ties - 1) / 2)
    return counted


def _ranked_by_index(counted: DataFrame) -> DataFrame:
    """The same for pairs of any number: no target's pairs meet in one task."""
    entries = [F.struct(F.lit(s).alias("side"), F.col(s).alias("value"), "w") for s in SIDES]
    both = counted.select("target", F.inline(F.array(*entries)))
    index = order_stats.ValueBlocks(both, "value", ["target", "side"], weight="w")
    number = order_stats.rank_number("average").alias("rank")
    stored = settle(index.ranks().select("target", "value", "ties", number, "side"), "side")
    for side, rank in SIDES.items():
        own = stored.where(F.col("side") == side).select("target", F.col("value").alias(side), "ties", F.col("rank").alias(rank))
        counted = order_stats.look_up(counted, own, ["target", side], index.blocks)
    return counted


def spearman(pairs: DataFrame) -> DataFrame:
    """(target, spearman_r): Pearson correlation of average ranks.

    Equal pairs are counted first. Counts of at most ``ONE_BLOCK`` bytes are ranked where they
    are; beyond that one index holds the values of both sides, and the ranks of the distinct pairs
    are looked up in it. The mean of average ranks is (n + 1) / 2 whatever the ties, so no second
    pass is needed.
    """
    rows = _complete(pairs)
    counted = settle(rows.groupBy("target", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("w")))
    small = stored_bytes(counted) <= order_stats.ONE_BLOCK
    ranked = _ranked_in_place(counted) if small else _ranked_by_index(counted)
    a, b, w = F.col("rank_true"), F.col("rank_pred"), F.col("w")
    sums = ranked.groupBy("target").agg(
        F.sum("w").alias("n"),
        F.sum(w * a * b).alias("ab"),
        F.sum(w * a * a).alias("aa"),
        F.sum(w * b * b).alias("bb"),
    )
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
    r = F.try_divide(
        F.col("ab") - centre, F.sqrt((F.col("aa") - centre) * (F.col("bb") - centre))
    )
    return sums.select("target", F.nanvl(r, F.lit(None).cast("double")).alias("spearman_r"))


def correlations(pairs: DataFrame, p_values: bool = True) -> DataFrame:
    """(target, n, pearson_r, spearman_r and, on request, their two-sided p-values)."""
    both = _with(moment_metrics(pairs).select("target", "n", "pearson_r"), spearman(pairs))
    return _p_values(both) if p_values else both


def _p_values(table: DataFrame) -> DataFrame:
    n = F.col("n").cast("double")
    return table.withColumns(
        {
            "pearson_p": correlation_p("pearson_r", n),
            "spearman_p": correlation_p("spearman_r", n),
        }
    )


def _with(table: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables have one row per target."""
    return join_on(table, more, ["target"], "left")


def target_metrics(pairs: DataFrame) -> DataFrame:
    """(target, n, all metrics). ``pairs`` is read several times: settle it if it is costly."""
    table = _with(moment_metrics(pairs), median_absolute_error(pairs))
    return _p_values(_with(table, spearman(pairs))).select("target", "n", *METRICS)


def basic_metrics(pairs: DataFrame) -> DataFrame:
    """(target, r2, mse, rmse, mae)"""
    return moment_metrics(pairs).select("target", "r2", "mse", "rmse", "mae")


def overall_metrics(metrics: DataFrame) -> DataFrame:
    """One row from the per-target table: means over targets, and the metrics of all
    pairs as one vector.

    The latter follow from the per-target moments (within plus between variance), so the
    pairs are not read again.
    """
    whole = Window.partitionBy(F.lit(0))
    n, weight = F.col("n"), F.sum("n").over(whole)
    centre = F.sum(n * F.col("mean_true")).over(whole) / weight
    parts = metrics.select(
        "r2",
        "mse",
        "mae",
        "n",
        (n * F.col("mse")).alias("square"),
        (n * F.col("mae")).alias("absolute"),
        (n * (F.pow("std_true", F.lit(2)) + F.pow(F.col("mean_true") - centre, F.lit(2)))).alias(
            "spread"
        ),
    )
    total = parts.agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.sum("n").alias("n_pairs"),
        F.avg("r2").alias("mean_r2"),
        F.stddev_pop("r2").alias("std_r2"),
        F.avg("mse").alias("mean_mse"),
        F.avg("mae").alias("mean_mae"),
        F.sum("square").alias("square"),
        F.sum("absolute").alias("absolute"),
        F.sum("spread").alias("spread"),
    )
    return total.select(
        "n_targets",
        "n_pairs",
        "mean_r2",
        "std_r2",
        "mean_mse",
        "mean_mae",
        F.when(
            F.col("n_pairs") >= 2, ratio_or_zero_rule(F.col("square"), F.col("spread"))
        ).alias("overall_r2"),
        F.try_divide("square", "n_pairs").alias("overall_mse"),
        F.sqrt(F.try_divide("square", "n_pairs")).alias("overall_rmse"),
        F.try_divide("absolute", "n_pairs").alias("overall_mae"),
    )


def score(metrics: DataFrame) -> float:
    """Mean R2 over the targets."""
    return metrics.agg(F.avg("r2")).first()[0]


def assess(overall: DataFrame) -> DataFrame:
    """Adds both rating scales and the advice lines to the overall row."""
    r2 = F.col("mean_r2")
    return overall.withColumns(
        {
            "rating": labels.card_rating(r2),
            "assessment": labels.assessment(r2),
            "advice": labels.advice(r2, F.col("std_r2")),
        }
    )
