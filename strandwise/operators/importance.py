"""Analysis of a long importance table (feature, feature_pos, target, importance).

The table has one row per model feature and target. Its size is set by the model (at most
tens of thousands of features), not by the data the model was fitted on, so windows per
target or per feature are small. ``feature_pos`` breaks ties: the earlier feature wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions import labels
from strandwise.session import settle

# Features per side of one correlation block: a task holds at most 250,000 pairs.
BLOCK_FEATURES = 500
EPSILON = 1e-10


def _categories(table: DataFrame, categories: DataFrame | None) -> DataFrame:
    """Adds ``category``: from a (feature, category) table, or by name.

    Features absent from a given table drop out, as do its features without importance.
    """
    if categories is None:
        return table.withColumn("category", labels.feature_category(F.col("feature")))
    return table.join(categories, "feature")


def _best(value: Column, position: Column) -> Column:
    """Ordering for max_by: highest value, then the earliest feature."""
    return F.struct(value, -position)


def summary_overall(table: DataFrame) -> DataFrame:
    v = F.col("importance")
    return table.agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        F.count_if(v > 0).alias("non_zero_features"),
        F.count(F.lit(1)).alias("total_features"),
    )


def summary_per_target(table: DataFrame) -> DataFrame:
    """Mean, sample std, top feature and value, features above the target's mean."""
    v = F.col("importance")
    mean = F.avg(v).over(Window.partitionBy("target"))
    return (
        table.withColumn("above", v > mean)
        .groupBy("target")
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.max_by("feature", _best(v, F.col("feature_pos"))).alias("top_feature"),
            F.max(v).alias("top_importance"),
            F.count_if("above").alias("effective_features"),
        )
    )


def mean_importance(table: DataFrame) -> DataFrame:
    return table.groupBy("feature", "feature_pos").agg(F.avg("importance").alias("importance"))


def top_overall(table: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` features with the highest mean importance over the targets."""
    return mean_importance(table).orderBy(F.col("importance").desc(), "feature_pos").limit(n)


def top_per_target(table: DataFrame, n: int = 20) -> DataFrame:
    """(target, rank, feature, feature_pos, importance)"""
    order = Window.partitionBy("target").orderBy(F.col("importance").desc(), "feature_pos")
    ranked = table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("target", "rank", "feature", "feature_pos", "importance")


def common_top(table: DataFrame, n: int = 20) -> DataFrame:
    """(feature): features in the top ``n`` of every target."""
    top = top_per_target(table, n)
    return (
        top.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("in_targets"))
        .join(_target_count(table), F.col("in_targets") == F.col("n_targets"))
        .select("feature")
    )


def _target_count(table: DataFrame) -> DataFrame:
    return F.broadcast(table.agg(F.count_distinct("target").alias("n_targets")))


def common_summary(table: DataFrame, n: int = 20) -> DataFrame:
    """One row: count of common top features and their share of ``n`` in percent."""
    return common_top(table, n).agg(
        F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) * 100.0 / n).alias("percentage")
    )


def only_in_target(table: DataFrame, n: int = 10) -> DataFrame:
    """(target, feature, unique): top features, marked if no other target has them."""
    held = F.count(F.lit(1)).over(Window.partitionBy("feature"))
    return top_per_target(table, n).select("target", "feature", (held == 1).alias("unique"))


def unique_contribution(table: DataFrame, n: int = 10) -> DataFrame:
    """(target, unique_contribution): share of the top ``n`` found in no other top ``n``."""
    return only_in_target(table, n).groupBy("target").agg(
        (F.count_if("unique") * 100.0 / F.count(F.lit(1))).alias("unique_contribution")
    )


def specificity(table: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` per target of importance / (mean over the other targets + 1e-10).

    Empty with a single target, as there is nothing to compare with.
    """
    over = Window.partitionBy("feature")
    targets = F.count(F.lit(1)).over(over)
    others = F.try_divide(F.sum("importance").over(over) - F.col("importance"), targets - 1)
    ratio = table.withColumn("ratio", F.col("importance") / (others + EPSILON))
    order = Window.partitionBy("target").orderBy(F.col("ratio").desc(), "feature_pos")
    ranked = ratio.where(F.col("ratio").isNotNull()).withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.where(F.col("rank") <= n).select("target", "rank", "feature", "ratio")


def category_analysis(table: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Per category and target: features, mean, total, share of the target in percent,
    and the top feature.

    The share's denominator covers all features, also those in no category.
    """
    v = F.col("importance")
    whole = F.sum(v).over(Window.partitionBy("target"))
    grouped = (
        _categories(table.withColumn("whole", whole), categories)
        .groupBy("category", "target")
        .agg(
            F.count(F.lit(1)).alias("feature_count"),
            F.avg(v).alias("mean_importance"),
            F.sum(v).alias("total_importance"),
            F.max("whole").alias("whole"),
            F.max_by("feature", _best(v, F.col("feature_pos"))).alias("top_feature"),
            F.max(v).alias("top_importance"),
        )
    )
    share = F.when(F.col("whole") > 0, F.col("total_importance") / F.col("whole") * 100)
    return grouped.withColumn("contribution_percentage", F.coalesce(share, F.lit(0.0))).drop("whole")


def average_contribution(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("category").agg(
        F.avg("contribution_percentage").alias("average_contribution")
    )


def category_totals(table: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(target, one total per category): the data behind the category plot."""
    return (
        _categories(table, categories)
        .groupBy("target")
        .pivot("category", list(labels.CATEGORIES) if categories is None else None)
        .agg(F.sum("importance"))
    )


def feature_type_counts(table: DataFrame, n: int = 10) -> DataFrame:
    """(target, feature_type, count) over the top ``n`` of each target, zeros included."""
    kind = labels.feature_type(F.col("feature"))
    top = top_per_target(table, n).withColumn("kind", kind)
    counts = top.groupBy("target").agg(
        *[F.count_if(F.col("kind") == t).alias(t) for t in labels.FEATURE_TYPES]
    )
    return counts.unpivot(["target"], list(labels.FEATURE_TYPES), "feature_type", "count")


def top_matrix(table: DataFrame, targets: Sequence[str], n: int = 20) -> DataFrame:
    """(feature, one column per target) for the top ``n``: the data behind the heatmap."""
    top = top_overall(table, n).select("feature")
    kept = table.join(F.broadcast(top), "feature", "left_semi")
    return kept.groupBy("feature").pivot("target", list(targets)).agg(F.first("importance"))


# --- correlation between features -----------------------------------------------------


def _standardised(table: DataFrame) -> DataFrame:
    """(feature, feature_pos, target, z): unit-length rows, constant features dropped.

    For complete tables: every feature has every target.
    """
    over = Window.partitionBy("feature")
    v = F.col("importance")
    centred = table.withColumn("c", v - F.avg(v).over(over)).withColumn(
        "norm", F.sqrt(F.sum(F.col("c") * F.col("c")).over(over))
    )
    # A constant feature leaves only rounding noise around its mean.
    sized = centred.withColumn("size", F.max(F.abs(v)).over(over))
    return sized.where(F.col("norm") > F.col("size") * 1e-12).select(
        "feature", "feature_pos", "target", (F.col("c") / F.col("norm")).alias("z")
    )


def mean_correlation(table: DataFrame) -> DataFrame:
    """One row: mean of the full correlation matrix of the non-constant features.

    With unit-length rows the sum of all correlations is the squared length of the sum of
    the rows, so no pair of features is ever formed.
    """
    sizes = table.groupBy("feature").agg(F.count("importance").alias("n")).agg(F.min("n"), F.max("n")).first()
    if sizes[0] != sizes[1]:
        raise ValueError("the mean correlation needs an importance for every feature and target")
    rows = _standardised(table)
    sums = rows.groupBy("target").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("m"))
    return sums.agg(
        F.max("m").alias("n_features"),
        F.try_divide(F.sum(F.col("s") * F.col("s")), F.pow(F.max("m"), F.lit(2))).alias(
            "mean_correlation"
        ),
    )


def _cells(maps: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of features by targets with zeros for missing cells, and which are there."""
    values, there = np.zeros((len(maps), width)), np.zeros((len(maps), width))
    for i, cells in enumerate(maps):
        at = np.fromiter(cells.keys(), np.int64, len(cells))
        values[i, at], there[i, at] = [*cells.values()], 1.0
    return values, there


def _pairwise(x: np.ndarray, has_x: np.ndarray, y: np.ndarray, has_y: np.ndarray) -> np.ndarray:
    """Correlations of all rows of x with all rows of y over the cells that both have."""
    n = has_x @ has_y.T
    sx, sy = x @ has_y.T, has_x @ y.T
    xx, yy, xy = (x * x) @ has_y.T, has_x @ (y * y).T, x @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = xx - sx * sx / n, yy - sy * sy / n
        r = (xy - sx * sy / n) / np.sqrt(vx * vy)
    # What rounding leaves of a constant row is no variation.
    return np.where((n >= 2) & (vx > xx * 1e-13) & (vy > yy * 1e-13), r, np.nan)


def correlated_pairs(table: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(feature1, feature2, correlation, interpretation) with |correlation| >= threshold.

    Values are compared by target. A pair's correlation is over the targets that both
    features have; pairs with fewer than two of these, or constant on them, drop out. With
    two targets every pair correlates by 1 or -1: choose a threshold above 1 to have none.

    Features are cut into blocks; a task multiplies two blocks and emits only the pairs
    that pass, so memory per task is fixed and grows with neither features nor pairs.
    """
    over = Window.partitionBy("feature")
    v = F.col("importance")
    # Centred and scaled per feature for precision only; correlations don't change by it.
    centred = table.where(v.isNotNull()).withColumn("c", v - F.avg(v).over(over))
    size = F.greatest(F.max(F.abs("c")).over(over), F.max(F.abs(v)).over(over) * 1e-12)
    scaled = centred.withColumn("z", F.when(size > 0, F.col("c") / size).otherwise(0.0))
    numbers = scaled.select("target").distinct().withColumn(
        "place", F.row_number().over(Window.orderBy("target")) - 1
    )
    vectors = settle(
        scaled.join(numbers, "target")
        .groupBy("feature", "feature_pos")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "z"))).alias("z"))
    )
    width = numbers.count()
    parts = max(1, -(-vectors.count() // BLOCK_FEATURES))
    block = F.pmod(F.xxhash64("feature"), F.lit(parts)).cast("int")
    own = vectors.withColumn("own", block)
    # Block b takes part in the tasks (b, 0..parts-1), each unordered pair of blocks once.
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "*"
    )

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        left = pdf[pdf["own"] == low]
        right = pdf[pdf["own"] == high]
        found = []
        if len(left) and len(right):
            r = _pairwise(*_cells(left["z"], width), *_cells(right["z"], width))
            i, j = np.nonzero(np.abs(r) >= threshold)  # no pair where r is NaN
            a, b = left["feature_pos"].to_numpy()[i], right["feature_pos"].to_numpy()[j]
            # Inside one block a pair appears twice, across blocks once in either order.
            keep = a < b if low == high else np.ones(len(a), dtype=bool)
            i, j, first = i[keep], j[keep], (a < b)[keep]
            x, y = left["feature"].to_numpy()[i], right["feature"].to_numpy()[j]
            found.append(
                pd.DataFrame(
                    {
                        "feature1": np.where(first, x, y),
                        "feature2": np.where(first, y, x),
                        "correlation": np.clip(r[i, j], -1.0, 1.0),
                    }
                )
            )
        empty = pd.DataFrame({"feature1": [], "feature2": [], "correlation": []})
        return pd.concat(found) if found else empty

    pairs = spread.groupBy("low", "high").applyInPandas(
        multiply, "feature1 string, feature2 string, correlation double"
    )
    return pairs.withColumn("interpretation", labels.correlation_label(F.col("correlation")))


# --- stability ------------------------------------------------------------------------


def coefficient_of_variation(table: DataFrame) -> DataFrame:
    """(feature, feature_pos, cv): sample std / mean over targets, null if mean <= 0."""
    v = F.col("importance")
    grouped = table.groupBy("feature", "feature_pos").agg(
        F.avg(v).alias("m"), F.stddev_samp(v).alias("s")
    )
    return grouped.select(
        "feature", "feature_pos", F.when(F.col("m") > 0, F.col("s") / F.col("m")).alias("cv")
    )


def stability(table: DataFrame, n: int = 10) -> DataFrame:
    """(kind, feature, cv): the ``n`` most and the ``n`` least stable features."""
    cv = coefficient_of_variation(table).where(F.col("cv").isNotNull())
    low = cv.orderBy("cv", "feature_pos").limit(n).withColumn("kind", F.lit("most_stable"))
    high = (
        cv.orderBy(F.col("cv").desc(), "feature_pos")
        .limit(n)
        .withColumn("kind", F.lit("most_unstable"))
    )
    return low.unionByName(high).select("kind", "feature", "cv")


def overall_stability(table: DataFrame) -> DataFrame:
    """One row: mean of the defined CVs, their number, the undefined ones, a label."""
    cv = coefficient_of_variation(table).agg(
        F.avg("cv").alias("overall_stability"),
        F.count("cv").alias("n_defined"),
        F.count_if(F.col("cv").isNull()).alias("n_undefined"),
    )
    return cv.withColumn("stability", labels.stability_label(F.col("overall_stability")))


def analyse(table: DataFrame, top_n: int = 20, categories: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every section of the analysis by name; ``table`` is settled once for all of them."""
    table = settle(table)
    by_category = category_analysis(table, categories)
    return {
        "importance_summary": summary_overall(table),
        "importance_per_target": summary_per_target(table),
        "importance_top": top_overall(table, top_n),
        "importance_top_per_target": top_per_target(table, top_n),
        "importance_common": common_top(table, top_n),
        "importance_categories": by_category,
        "importance_category_average": average_contribution(by_category),
        "importance_category_totals": category_totals(table, categories),
        "importance_specific": specificity(table),
        "importance_unique": unique_contribution(table),
        "importance_correlation": mean_correlation(table),
        "importance_pairs": correlated_pairs(table),
        "importance_stability": stability(table),
        "importance_overall_stability": overall_stability(table),
        "importance_types": feature_type_counts(table),
    }
