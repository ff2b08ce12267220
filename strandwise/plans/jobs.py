"""The user-level jobs. Each writes its results as tables below one output folder and
continues from what it wrote, so nothing expensive is computed twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from strandwise.operators import embedding as emb
from strandwise.operators import evaluation, quality, ranking
from strandwise.operators.boosting import Boosting
from strandwise.operators.embedding import EmbedderFactory
from strandwise.operators.reduce import EmbeddingReducer
from strandwise.operators.split import split
from strandwise.plans import report
from strandwise.plans.estimator import PropertyModel, Sources
from strandwise.session import settle
from strandwise.sources import tables


class CriticalIssues(ValueError):
    """The table must not be used for training."""


def validate_table(df: DataFrame, targets: Sequence[str] = quality.TARGETS) -> dict[str, DataFrame]:
    """Every section of the data-quality report."""
    overview = settle(quality.overview(df))
    facts = quality.facts_of(overview)
    profile = settle(quality.target_profile(df, targets))
    _, bad = quality.split_valid(df)
    return {
        "sequence_summary": quality.summary_of(overview),
        "base_composition": quality.composition_of(overview),
        "invalid_sequences": bad,
        "target_profile": profile,
        "missing_data": quality.missing_of(overview),
        "duplicate_rows": quality.duplicate_rows(df),
        "column_cardinality": quality.column_cardinality(df),
        "recommendations": quality.recommendations(facts, profile),
        "critical_issues": quality.critical_issues(facts),
    }


def validate_job(
    spark: SparkSession, path: str, out: str | None = None, targets: Sequence[str] = quality.TARGETS
) -> dict[str, DataFrame]:
    """Reads leniently, so invalid rows are reported and not just refused."""
    df = tables.load_sequences(spark, path, required=("sequence",), strict=False)
    sections = validate_table(df, targets)
    if out:
        tables.write_sections(sections, out)
    return sections


def _gate(issues: DataFrame) -> None:
    """``issues`` has at most one row per kind of issue."""
    issues = [r["issue"] for r in issues.collect()]
    if issues:
        raise CriticalIssues("; ".join(issues))


def train_job(
    spark: SparkSession,
    path: str,
    out: str,
    sources: Sources,
    test_size: float = 0.2,
    n_components: int = 128,
    params: Boosting = Boosting(),
    validate: bool = False,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Check, split, fit, evaluate on the test rows, save model and test results."""
    if validate:
        lenient = tables.load_sequences(spark, path, strict=False)
        _gate(quality.critical_issues(quality.validation_facts(lenient)))
    df = tables.keyed_input(tables.load_sequences(spark, path), f"{out}/input")
    train, test = split(df, test_size, seed)
    model = PropertyModel(n_components, params).fit(train, sources)
    model.save(spark, f"{out}/model")
    stored = tables.write_table(model.predict(test, sources), f"{out}/test_results")
    results = spark.read.parquet(stored)
    pairs = evaluation.long_pairs(results, model.targets)
    metrics = settle(evaluation.moment_metrics(pairs))
    sections = {
        "test_metrics": metrics,
        "test_overall": evaluation.overall_metrics(metrics),
        "feature_importance": model.importance(spark),
    }
    tables.write_sections(sections, out)
    return {"test_results": results, **sections}


def _predict_stored(
    spark: SparkSession, model: PropertyModel, df: DataFrame, sources: Sources, out: str
) -> DataFrame:
    return spark.read.parquet(tables.write_table(model.predict(df, sources), f"{out}/predictions"))


def predict_job(
    spark: SparkSession,
    model_path: str,
    path: str,
    out: str,
    sources: Sources,
    top_n: int = 10,
    full_report: bool = False,
    csv: bool = False,
) -> dict[str, DataFrame]:
    """Predictions, ranked report and summary; all report sections on request."""
    model = PropertyModel.load(spark, model_path)
    loaded = tables.load_sequences(spark, path, required=("sequence",))
    df = tables.keyed_input(loaded, f"{out}/input")
    predictions = _predict_stored(spark, model, df, sources, out)
    if csv:
        tables.write_csv(predictions, f"{out}/predictions_csv")
    if full_report:
        sections = report.report_sections(
            predictions, model.importance(spark), model.targets, top_n=top_n
        )
    else:
        sections = {
            "sequence_analysis": ranking.ranked_report(predictions, top_n),
            "prediction_summary": ranking.prediction_summary(predictions, p90=False),
        }
    tables.write_sections(sections, out)
    return {"predictions": predictions, **sections}


def evaluate_job(
    spark: SparkSession, model_path: str, path: str, out: str, sources: Sources
) -> dict[str, DataFrame]:
    """Predictions against truth: metric tables, card and report sections."""
    model = PropertyModel.load(spark, model_path)
    df = tables.keyed_input(tables.load_sequences(spark, path), f"{out}/input")
    predictions = _predict_stored(spark, model, df, sources, out)
    pairs = evaluation.long_pairs(predictions, model.targets)
    sections = report.report_sections(predictions, model.importance(spark), model.targets, pairs)
    tables.write_sections(sections, out)
    tables.write_json(sections["evaluation"], f"{out}/evaluation_json")
    return {"predictions": predictions, **sections}


def embed_job(
    spark: SparkSession,
    path: str,
    out: str,
    factory: EmbedderFactory,
    model: str = "dnabert2",
    n_components: int = 128,
    batch_size: int = emb.DEFAULT_BATCH,
) -> dict[str, DataFrame]:
    """Embed, reduce, attach PC1 .. PCk to the input rows; keep raw vectors and statistics."""
    emb.model_config(model)
    loaded = tables.load_sequences(spark, path)
    df = tables.keyed_input(loaded, f"{out}/input")
    embedded = emb.embed_sequences(emb.model_input(df, model), factory, batch_size=batch_size)
    raw = spark.read.parquet(tables.write_table(embedded, f"{out}/raw_embeddings"))
    reducer = EmbeddingReducer(n_components).fit(raw)
    reducer.save(f"{out}/reducer")
    components = reducer.expand(reducer.transform(raw))
    attached = df.join(components, "seq_id", "left")
    sections = {"embeddings": attached, "embedding_statistics": reducer.statistics(spark)}
    tables.write_sections(sections, out)
    return {"raw_embeddings": raw, **sections}


def full_job(
    spark: SparkSession,
    path: str,
    out: str,
    sources: Sources,
    test_size: float = 0.2,
    n_components: int = 128,
    params: Boosting = Boosting(),
) -> dict[str, DataFrame]:
    """Validate, gate, train, then the full report on the test rows."""
    checked = validate_table(tables.load_sequences(spark, path, strict=False))
    tables.write_sections(checked, f"{out}/validation")
    _gate(checked["critical_issues"])
    trained = train_job(spark, path, out, sources, test_size, n_components, params)
    results = trained["test_results"]
    targets = [c.removeprefix(ranking.PREFIX) for c in ranking.prediction_columns(results)]
    pairs = evaluation.long_pairs(results, targets)
    sections = report.report_sections(results, trained["feature_importance"], targets, pairs)
    tables.write_sections(sections, f"{out}/report")
    return {**trained, **sections}
