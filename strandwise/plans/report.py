"""Report sections as tables: every number of the report, one DataFrame per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import labels
from strandwise.operators import evaluation, importance, ranking
from strandwise.session import settle


def performance_card(metrics: DataFrame, overall: DataFrame) -> DataFrame:
    """(item, value, rating): mean R2, overall RMSE, then R2 per target."""
    head = overall.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("mean_r2").alias("item"),
                    F.col("mean_r2").alias("value"),
                    labels.card_rating(F.col("mean_r2")).alias("rating"),
                ),
                F.struct(
                    F.lit("overall_rmse").alias("item"),
                    F.col("overall_rmse").alias("value"),
                    F.lit(None).cast("string").alias("rating"),
                ),
            )
        )
    )
    rows = metrics.select(
        F.concat(F.lit("r2 "), "target").alias("item"),
        F.col("r2").alias("value"),
        F.lit(None).cast("string").alias("rating"),
    )
    return head.unionByName(rows)


def metadata(rows: DataFrame, targets: list[str], has_truth: bool, sequence: str = "sequence") -> DataFrame:
    """One row: sequence and column counts, targets, whether truth was given."""
    return rows.agg(F.count(F.lit(1)).alias("n_sequences")).select(
        "n_sequences",
        F.lit(len(rows.columns)).alias("n_features"),
        F.lit(sequence).alias("sequence_column"),
        F.lit(has_truth).alias("has_ground_truth"),
        F.array(*[F.lit(t) for t in targets]).cast("array<string>").alias("targets"),
        F.current_timestamp().alias("generation_time"),
    )


def executive_summary(
    predictions: DataFrame,
    analysis: dict[str, DataFrame],
    overall: DataFrame | None = None,
) -> DataFrame:
    """(section, item, value, text): overview, performance, insights and findings."""

    def line(section: str, item, value, text=None):
        return F.struct(
            F.lit(section).alias("section"),
            (F.lit(item) if isinstance(item, str) else item).alias("item"),
            value.cast("double").alias("value"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    def lines(table: DataFrame, *entries) -> DataFrame:
        return table.select(F.inline(F.array(*entries)))

    count = predictions.agg(F.count(F.lit(1)).alias("n"))
    parts = [lines(count, line("overview", "sequences", F.col("n")))]
    if overall is not None:
        r2 = F.col("mean_r2")
        parts.append(lines(overall, line("performance", "mean_r2", r2, labels.card_rating(r2))))
    summary = ranking.prediction_summary(predictions)
    parts.append(
        lines(
            summary,
            *[
                line("insights", F.concat(F.col("target"), F.lit(f" {c}")), F.col(c))
                for c in ("mean", "min", "max", "p90")
            ],
        )
    )
    best = analysis["importance_top"].orderBy(F.col("importance").desc(), "feature_pos").limit(5)
    parts.append(lines(best, line("insights", F.lit("top feature"), F.col("importance"), F.col("feature"))))
    parts.append(
        lines(
            analysis["importance_category_average"],
            line("findings", F.col("category"), F.col("average_contribution")),
        )
    )
    parts.append(
        lines(
            analysis["importance_overall_stability"],
            line("findings", "stability", F.col("overall_stability"), F.col("stability")),
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def evaluation_sections(pairs: DataFrame) -> dict[str, DataFrame]:
    """Per-target metrics, overall metrics with ratings, and the card."""
    metrics = settle(evaluation.target_metrics(pairs))
    overall = evaluation.assess(evaluation.overall_metrics(metrics))
    return {
        "evaluation": metrics,
        "evaluation_overall": overall,
        "performance_card": performance_card(metrics, overall),
    }


def report_sections(
    predictions: DataFrame,
    feature_importance: DataFrame,
    targets: list[str],
    pairs: DataFrame | None = None,
    sort_by: str = "predicted_yield",
    top_n: int = 10,
    key: str = "seq_id",
) -> dict[str, DataFrame]:
    """All sections. ``predictions`` and ``pairs`` are read several times: pass stored tables."""
    analysis = importance.analyse(feature_importance)
    sections = {
        "sequence_analysis": ranking.ranked_report(predictions, top_n, sort_by, key),
        "prediction_summary": ranking.prediction_summary(predictions),
        "feature_importance": feature_importance,
        **analysis,
        "metadata": metadata(predictions, targets, pairs is not None),
    }
    facts = ranking.add_insights(ranking.add_sequence_facts(predictions))
    sections["insight_distribution"] = ranking.insight_distribution(facts)
    sections["sequence_characteristics"] = ranking.sequence_characteristics(facts)
    if sort_by in predictions.columns:
        sections["top_sequences"] = ranking.top_sequences(predictions, top_n, sort_by, key)
    overall = None
    if pairs is not None:
        evaluated = evaluation_sections(pairs)
        sections.update(evaluated)
        overall = evaluated["evaluation_overall"]
    sections["executive_summary"] = executive_summary(predictions, analysis, overall)
    return sections
