"""Rule-based labels: feature categories, ratings, stability, correlation sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and texts that results are compared on.
EMBEDDING_WORDS = ("pc", "component", "embedding", "tsne")
STRUCTURE_WORDS = ("mfe", "hairpin", "stem", "gc", "bulge", "loop", "energy", "fold")
NARROW_STRUCTURE_WORDS = ("mfe", "hairpin", "stem", "gc", "bulge", "loop")
CATEGORIES = ("embedding_features", "structure_features", "covariate_features")
FEATURE_TYPES = ("embedding", "structure", "covariate")
CARD_RATINGS = ((0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair"), (0.2, "Poor"))
CARD_LOWEST = "Very Poor"
ASSESSMENTS = (
    (0.8, "EXCELLENT - Very strong predictive performance"),
    (0.6, "GOOD - Strong predictive performance"),
    (0.4, "MODERATE - Reasonable predictive performance"),
    (0.2, "POOR - Weak predictive performance"),
)
ASSESSMENT_LOWEST = "VERY POOR - Little to no predictive power"
LOW_R2_ADVICE = (
    "Consider feature engineering or additional data",
    "Check for data quality issues",
    "Try different model architectures",
)
VARIANCE_ADVICE = "High variance across targets - consider target-specific models"


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def feature_category(feature: Column) -> Column:
    """Category used by the importance analysis (embedding keywords win)."""
    name = F.lower(feature)
    return (
        F.when(_contains_any(name, EMBEDDING_WORDS), F.lit(CATEGORIES[0]))
        .when(_contains_any(name, STRUCTURE_WORDS), F.lit(CATEGORIES[1]))
        .otherwise(F.lit(CATEGORIES[2]))
    )


def feature_type(feature: Column) -> Column:
    """Type used by the prediction insights: prefix ``PC`` or the word ``embedding``."""
    name = F.lower(feature)
    return (
        F.when(feature.startswith("PC") | name.contains("embedding"), F.lit(FEATURE_TYPES[0]))
        .when(_contains_any(name, NARROW_STRUCTURE_WORDS), F.lit(FEATURE_TYPES[1]))
        .otherwise(F.lit(FEATURE_TYPES[2]))
    )


def _ladder(value: Column, steps, lowest: str) -> Column:
    label = F.lit(lowest)
    for limit, text in reversed(steps):
        label = F.when(value > limit, F.lit(text)).otherwise(label)
    return F.when(value.isNotNull(), label)


def card_rating(r2: Column) -> Column:
    return _ladder(r2, CARD_RATINGS, CARD_LOWEST)


def assessment(r2: Column) -> Column:
    return _ladder(r2, ASSESSMENTS, ASSESSMENT_LOWEST)


def advice(mean_r2: Column, std_r2: Column) -> Column:
    """Array of advice lines; empty when nothing applies."""
    lines = [F.when(mean_r2 < 0.5, F.lit(line)) for line in LOW_R2_ADVICE]
    lines.append(F.when(std_r2 > 0.2, F.lit(VARIANCE_ADVICE)))
    return F.filter(F.array(*lines), lambda line: line.isNotNull())


def stability_label(cv: Column) -> Column:
    return (
        F.when(cv < 0.5, F.lit("high"))
        .when(cv < 1.0, F.lit("moderate"))
        .when(cv.isNotNull(), F.lit("low"))
    )


def correlation_label(r: Column) -> Column:
    return F.when(r > 0, F.lit("similar importance patterns")).otherwise(
        F.lit("opposite importance patterns")
    )
