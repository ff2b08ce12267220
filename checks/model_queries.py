"""Queries over evaluation, prediction reports, importance analysis and fitted models."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.data_queries import ORACLE as DATA_SQL
from checks.views import rounded, sql_round, table, with_views
from strandwise.functions import labels
from strandwise.functions import sequence as sq
from strandwise.operators import embedding, evaluation, features, ranking
from strandwise.operators import importance as imp
from strandwise.operators.covariates import CovariateEncoder
from strandwise.operators.boosting import Boosting, cross_validate, fit_targets, tune
from strandwise.operators.order_stats import ValueBlocks
from strandwise.operators.reduce import EmbeddingReducer
from strandwise.operators.split import fold_of, split
from strandwise.plans import jobs, report
from strandwise.plans.estimator import PropertyModel, Sources
from strandwise.session import ensure_checkpoint_dir, settle
from strandwise.sources import tables

STRUCTURE_SQL, ONE_HOT_SQL = DATA_SQL["structure_features"], DATA_SQL["one_hot"]

# --- evaluation -----------------------------------------------------------------------

LARGE = {"mse": 2, "rmse": 4, "mae": 4, "std_true": 4, "std_pred": 4, "std_residual": 4}


def eval_per_target(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.eval_pairs(spark, sf)
    both = evaluation.moment_metrics(pairs).join(evaluation.median_absolute_error(pairs), "target")
    return rounded(both.drop("pearson_r"), 4, mse=2)


def eval_basic(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.basic_metrics(views.eval_pairs(spark, sf)), 4, mse=2)


def eval_overall(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluation.moment_metrics(views.eval_pairs(spark, sf))
    table = evaluation.assess(evaluation.overall_metrics(metrics))
    flat = table.withColumn("advice", F.concat_ws(" | ", "advice"))
    return rounded(flat, 4, mean_mse=2, overall_mse=2)


def eval_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.correlations(views.eval_pairs(spark, sf), p_values=False))


def eval_p_values(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.eval_pairs(spark, sf)
    return evaluation.correlations(pairs).select("target", "pearson_p", "spearman_p")


def _joined_pairs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    truth = orders.select(
        "o_orderkey", F.col("o_orderstatus").alias("target"), F.col("o_totalprice").alias("y_true")
    )
    predicted = orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("target"),
        (1000 * (F.col("o_custkey") % 97).cast("double")).alias("y_pred"),
    )
    return evaluation.pair(truth, predicted, ["o_orderkey", "target"])


def residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.residuals(_joined_pairs(spark, sf)), 4)


def eval_joined(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluation.basic_metrics(_joined_pairs(spark, sf)), 4, mse=2)


def model_score(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluation.moment_metrics(views.eval_pairs(spark, sf))
    return rounded(evaluation.overall_metrics(metrics).select(F.col("mean_r2").alias("score")))


def performance_card(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluation.moment_metrics(_joined_pairs(spark, sf))
    return rounded(report.performance_card(metrics, evaluation.overall_metrics(metrics)), 4)


_MOMENTS = """
m AS (
    SELECT target, count(*) AS n, avg(pow(y_true - y_pred, 2)) AS mse,
           avg(abs(y_true - y_pred)) AS mae, quantile_cont(abs(y_true - y_pred), 0.5) AS median_ae,
           var_pop(y_true) AS vt, var_pop(y_true - y_pred) AS ve,
           CASE WHEN count(*) FILTER (WHERE y_true = 0) = 0
                THEN avg(abs((y_true - y_pred) / y_true)) * 100 END AS mape,
           avg(y_true) AS mean_true, stddev_pop(y_true) AS std_true, avg(y_pred) AS mean_pred,
           stddev_pop(y_pred) AS std_pred, avg(y_true - y_pred) AS mean_residual,
           stddev_pop(y_true - y_pred) AS std_residual, max(abs(y_true - y_pred)) AS max_residual
    FROM pairs GROUP BY target),
metrics AS (
    SELECT *, sqrt(mse) AS rmse, 1 - mse / vt AS r2, 1 - ve / vt AS explained_variance FROM m)
"""
_PAIRS = "pairs AS (SELECT * FROM eval_pairs)"
_JOINED = """pairs AS (
    SELECT t.o_orderkey, t.o_orderstatus AS target, t.o_totalprice AS y_true,
           1000 * cast(p.o_custkey % 97 AS double) AS y_pred
    FROM orders t JOIN orders p ON t.o_orderkey = p.o_orderkey AND t.o_orderstatus = p.o_orderstatus)"""
_FLAT = """flat AS (
    SELECT avg(pow(y_true - y_pred, 2)) AS overall_mse, avg(abs(y_true - y_pred)) AS overall_mae,
           sqrt(avg(pow(y_true - y_pred, 2))) AS overall_rmse,
           1 - avg(pow(y_true - y_pred, 2)) / var_pop(y_true) AS overall_r2, count(*) AS n_pairs
    FROM pairs)"""
_ADVICE = " | ".join(labels.LOW_R2_ADVICE)


def _ladder(value: str, steps, lowest: str) -> str:
    cases = " ".join(f"WHEN {value} > {limit} THEN '{text}'" for limit, text in steps)
    return f"CASE {cases} ELSE '{lowest}' END"


_EVAL_SQL = {
    "eval_per_target": with_views(
        f"""WITH {_PAIRS}, {_MOMENTS}
        SELECT target, n, {sql_round('''r2, mse, rmse, mae, median_ae, explained_variance, mape,
            mean_true, std_true, mean_pred, std_pred, mean_residual, std_residual, max_residual''', 4, mse=2)}
        FROM metrics""",
        "eval_pairs",
    ),
    "eval_basic": with_views(
        f"""WITH {_PAIRS}, {_MOMENTS}
        SELECT target, {sql_round('r2, mse, rmse, mae', 4, mse=2)} FROM metrics""",
        "eval_pairs",
    ),
    "eval_overall": with_views(
        f"""WITH {_PAIRS}, {_MOMENTS}, {_FLAT},
        o AS (SELECT count(*) AS n_targets, avg(r2) AS mean_r2, stddev_pop(r2) AS std_r2,
                     avg(mse) AS mean_mse, avg(mae) AS mean_mae FROM metrics)
        SELECT n_targets, n_pairs, {sql_round('''mean_r2, std_r2, mean_mse, mean_mae, overall_r2,
               overall_mse, overall_rmse, overall_mae''', 4, mean_mse=2, overall_mse=2)},
               {_ladder('mean_r2', labels.CARD_RATINGS, labels.CARD_LOWEST)} AS rating,
               {_ladder('mean_r2', labels.ASSESSMENTS, labels.ASSESSMENT_LOWEST)} AS assessment,
               concat_ws(' | ', CASE WHEN mean_r2 < 0.5 THEN '{_ADVICE}' END,
                         CASE WHEN std_r2 > 0.2 THEN '{labels.VARIANCE_ADVICE}' END) AS advice
        FROM o, flat""",
        "eval_pairs",
    ),
    "eval_correlations": with_views(
        f"""WITH {_PAIRS},
        ranked AS (
            SELECT *, rank() OVER (PARTITION BY target ORDER BY y_true)
                      + (count(*) OVER (PARTITION BY target, y_true) - 1) / 2.0 AS a,
                   rank() OVER (PARTITION BY target ORDER BY y_pred)
                      + (count(*) OVER (PARTITION BY target, y_pred) - 1) / 2.0 AS b
            FROM pairs)
        SELECT target, count(*) AS n, round(corr(y_true, y_pred), 6) + 0.0 AS pearson_r,
               round(corr(a, b), 6) + 0.0 AS spearman_r
        FROM ranked GROUP BY target""",
        "eval_pairs",
    ),
    "residuals": f"""
        WITH {_JOINED}
        SELECT o_orderkey, target, {sql_round('y_true, y_pred', 4)},
               round(y_true - y_pred, 4) + 0.0 AS residual FROM pairs""",
    "eval_joined": f"""
        WITH {_JOINED}, {_MOMENTS}
        SELECT target, {sql_round('r2, mse, rmse, mae', 4, mse=2)} FROM metrics""",
    "model_score": with_views(
        f"WITH {_PAIRS}, {_MOMENTS} SELECT round(avg(r2), 6) + 0.0 AS score FROM metrics", "eval_pairs"
    ),
    "performance_card": f"""
        WITH {_JOINED}, {_MOMENTS}, {_FLAT}
        SELECT 'mean_r2' AS item, round(avg(r2), 4) + 0.0 AS value,
               {_ladder('avg(r2)', labels.CARD_RATINGS, labels.CARD_LOWEST)} AS rating FROM metrics
        UNION ALL SELECT 'overall_rmse', round(overall_rmse, 4) + 0.0, NULL FROM flat
        UNION ALL SELECT concat('r2 ', target), round(r2, 4) + 0.0, NULL FROM metrics""",
}

# --- prediction reports ---------------------------------------------------------------


def prediction_attach(spark: SparkSession, sf: str) -> DataFrame:
    values = views.assay(spark, sf).select("seq_id", F.col("expression").alias("predicted_expression"))
    return rounded(features.attach(views.sequences(spark, sf), values, how="left"))


def prediction_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.prediction_summary(views.predictions(spark, sf)))


def ranked_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.ranked_report(views.predictions(spark, sf)))


def top_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.top_sequences(views.predictions(spark, sf)))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.add_insights(ranking.add_sequence_facts(views.predictions(spark, sf)))


def insight_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.insight_distribution(_facts(spark, sf)))


def sequence_characteristics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ranking.sequence_characteristics(_facts(spark, sf)))


def report_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.predictions(spark, sf)
    targets = [c.removeprefix(ranking.PREFIX) for c in ranking.prediction_columns(rows)]
    facts = report.metadata(rows, targets, has_truth=False)
    return facts.withColumn("targets", F.concat_ws(",", "targets")).drop("generation_time")


def price_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles per group by blocks, the way taken for large tables."""
    blocks = ValueBlocks(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(blocks.quantiles({"q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9}), 4)


def price_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The global rank over the largest table by blocks, one row per distinct value."""
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    ranks = ValueBlocks(lines, "l_extendedprice", descending=True).ranks()
    return ranks.select("l_extendedprice", "ties", (F.col("before") + 1).alias("rank"))


_GC = "(length(sequence) - length(replace(replace(sequence, 'G', ''), 'C', '')))"
_FACTS = f"""facts AS (
    SELECT *, cast(length(sequence) AS bigint) AS sequence_length,
           coalesce({_GC} * 1.0 / nullif(length(sequence), 0), 0.0) AS gc_content
    FROM predictions),
told AS (
    SELECT *, coalesce(nullif(concat_ws('; ',
        CASE WHEN sequence_length > 2000 THEN 'long sequence'
             WHEN sequence_length < 500 THEN 'short sequence' END,
        CASE WHEN gc_content > 0.6 THEN 'high GC content'
             WHEN gc_content < 0.3 THEN 'low GC content' END,
        CASE WHEN predicted_yield > 0.8 THEN 'high yield predicted' END,
        CASE WHEN "predicted_dsRNA_percent" > 10 THEN 'high dsRNA formation risk' END,
        CASE WHEN predicted_expression > 1.5 THEN 'strong expression expected' END), ''),
        'standard profile') AS insights
    FROM facts)"""
_LONG = """long AS (
    SELECT 'yield' AS target, predicted_yield AS v FROM predictions
    UNION ALL SELECT 'dsRNA_percent', "predicted_dsRNA_percent" FROM predictions
    UNION ALL SELECT 'expression', predicted_expression FROM predictions)"""
_PREDICTED = "predicted_yield, predicted_dsRNA_percent, predicted_expression"

_REPORT_SQL = {
    "prediction_attach": with_views(
        f"""SELECT s.seq_id, sequence, round(expression, 6) + 0.0 AS predicted_expression
        FROM sequences s LEFT JOIN assay a ON s.seq_id = a.seq_id""",
        "sequences", "assay",
    ),
    "prediction_summary": with_views(
        f"""WITH {_LONG}
        SELECT target, round(avg(v), 6) + 0.0 AS mean, round(min(v), 6) + 0.0 AS min,
               round(max(v), 6) + 0.0 AS max, round(quantile_cont(v, 0.9), 6) + 0.0 AS p90
        FROM long GROUP BY target""",
        "predictions",
    ),
    "ranked_report": with_views(
        f"""WITH {_FACTS},
        ranked AS (
            SELECT *, CASE WHEN predicted_yield IS NOT NULL
                      THEN rank() OVER (ORDER BY predicted_yield DESC NULLS LAST) END AS rank FROM told)
        SELECT seq_id, {sql_round(_PREDICTED)}, sequence_length, round(gc_content, 6) + 0.0 AS gc_content,
               insights, rank, coalesce(rank <= 10, false) AS top_performer
        FROM ranked""",
        "predictions",
    ),
    "top_sequences": with_views(
        f"""WITH {_FACTS}
        SELECT seq_id, rank() OVER (ORDER BY predicted_yield DESC) AS rank, insights, {sql_round(_PREDICTED)}
        FROM (SELECT * FROM told WHERE predicted_yield IS NOT NULL
              ORDER BY predicted_yield DESC, seq_id LIMIT 10) t""",
        "predictions",
    ),
    "insight_distribution": with_views(
        f"""WITH {_FACTS}
        SELECT insights, count(*) AS count,
               round(count(*) * 100.0 / (SELECT count(*) FROM told), 6) + 0.0 AS percentage
        FROM told GROUP BY insights ORDER BY count(*) DESC, insights LIMIT 10""",
        "predictions",
    ),
    "sequence_characteristics": with_views(
        f"""WITH {_FACTS}
        SELECT min(sequence_length) AS min_length, max(sequence_length) AS max_length,
               round(avg(sequence_length), 6) + 0.0 AS mean_length, round(min(gc_content), 6) + 0.0 AS min_gc,
               round(max(gc_content), 6) + 0.0 AS max_gc, round(avg(gc_content), 6) + 0.0 AS mean_gc
        FROM told""",
        "predictions",
    ),
    "report_metadata": with_views(
        """SELECT count(*) AS n_sequences, cast(5 AS integer) AS n_features,
               'sequence' AS sequence_column, false AS has_ground_truth,
               'yield,dsRNA_percent,expression' AS targets
        FROM predictions""",
        "predictions",
    ),
    "price_quantiles": """
        SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) + 0.0 AS q1,
               round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS median,
               round(quantile_cont(l_extendedprice, 0.75), 4) + 0.0 AS q3,
               round(quantile_cont(l_extendedprice, 0.9), 4) + 0.0 AS p90
        FROM lineitem GROUP BY l_returnflag""",
    "price_ranks": """
        SELECT l_extendedprice, count(*) AS ties,
               cast(1 + sum(count(*)) OVER (ORDER BY l_extendedprice DESC) - count(*) AS bigint) AS rank
        FROM lineitem GROUP BY l_extendedprice""",
}

# --- importance -----------------------------------------------------------------------

# Fixed value: the labels of the embeddings table.
TARGETS = [f"t{i}" for i in range(10)]


def _over_importance(operator, *args, digits: int = 6, **kwargs):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(operator(views.importance(spark, sf), *args, **kwargs), digits)

    return query


def importance_common(spark: SparkSession, sf: str) -> DataFrame:
    return imp.common_top(views.importance(spark, sf), 50)


def importance_category_average(spark: SparkSession, sf: str) -> DataFrame:
    analysis = imp.category_analysis(views.importance(spark, sf))
    return rounded(imp.average_contribution(analysis))


def importance_given_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories given as a table, one of whose features has no importance."""
    table = views.importance(spark, sf)
    known = table.select("feature").distinct().where(F.col("feature").startswith("PC"))
    given = known.withColumn("category", F.lit("embedding_features")).unionByName(
        spark.createDataFrame([("no_such_feature", "other")], "feature string, category string")
    )
    return rounded(imp.category_analysis(table, given))


def feature_categories(spark: SparkSession, sf: str) -> DataFrame:
    names = views.importance(spark, sf).select("feature").distinct()
    f = F.col("feature")
    return names.select(
        f, labels.feature_category(f).alias("category"), labels.feature_type(f).alias("feature_type")
    )


def executive_summary(spark: SparkSession, sf: str) -> DataFrame:
    analysis = imp.analyse(views.importance(spark, sf))
    metrics = evaluation.moment_metrics(views.eval_pairs(spark, sf))
    overall = evaluation.overall_metrics(metrics)
    return rounded(report.executive_summary(views.predictions(spark, sf), analysis, overall), 4)


_CATEGORY = """CASE WHEN regexp_matches(lower(feature), 'pc|component|embedding|tsne') THEN 'embedding_features'
    WHEN regexp_matches(lower(feature), 'mfe|hairpin|stem|gc|bulge|loop|energy|fold') THEN 'structure_features'
    ELSE 'covariate_features' END"""
_TYPE = """CASE WHEN starts_with(feature, 'PC') OR contains(lower(feature), 'embedding') THEN 'embedding'
    WHEN regexp_matches(lower(feature), 'mfe|hairpin|stem|gc|bulge|loop') THEN 'structure'
    ELSE 'covariate' END"""


def _top(n: int) -> str:
    return f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY target ORDER BY importance DESC, feature_pos) AS rank FROM importance) r
        WHERE rank <= {n})"""


_CATEGORIES = f"""cat AS (
    SELECT *, {_CATEGORY} AS category, sum(importance) OVER (PARTITION BY target) AS whole FROM importance),
analysis AS (
    SELECT category, target, count(*) AS feature_count, avg(importance) AS mean_importance,
           sum(importance) AS total_importance, sum(importance) / max(whole) * 100 AS contribution_percentage,
           arg_max(feature, importance) AS top_feature, max(importance) AS top_importance
    FROM cat GROUP BY category, target)"""
_CATEGORY_SELECT = f"""SELECT category, target, feature_count, top_feature, {sql_round(
    'mean_importance, total_importance, contribution_percentage, top_importance')} FROM analysis"""
_CORR = """pair AS (
    SELECT a.feature AS feature1, b.feature AS feature2, corr(a.importance, b.importance) AS r
    FROM importance a JOIN importance b ON a.target = b.target AND a.feature_pos < b.feature_pos
    GROUP BY a.feature, b.feature)"""
_CV = """cv AS (
    SELECT feature, feature_pos, CASE WHEN avg(importance) > 0
           THEN stddev_samp(importance) / avg(importance) END AS cv
    FROM importance GROUP BY feature, feature_pos)"""


def _importance_sql(sql: str) -> str:
    return with_views(sql, "importance")


_IMPORTANCE_SQL = {
    "importance_summary": _importance_sql(
        """SELECT round(avg(importance), 6) + 0.0 AS mean, round(stddev_pop(importance), 6) + 0.0 AS std,
               round(min(importance), 6) + 0.0 AS min, round(max(importance), 6) + 0.0 AS max,
               round(quantile_cont(importance, 0.5), 6) + 0.0 AS median,
               count(*) FILTER (WHERE importance > 0) AS non_zero_features, count(*) AS total_features
        FROM importance"""
    ),
    "importance_per_target": _importance_sql(
        """WITH a AS (SELECT *, importance > avg(importance) OVER (PARTITION BY target) AS above FROM importance)
        SELECT target, round(avg(importance), 6) + 0.0 AS mean, round(stddev_samp(importance), 6) + 0.0 AS std,
               arg_max(feature, importance) AS top_feature, round(max(importance), 6) + 0.0 AS top_importance,
               count(*) FILTER (WHERE above) AS effective_features
        FROM a GROUP BY target"""
    ),
    "importance_mean": _importance_sql(
        """SELECT feature, feature_pos, round(avg(importance), 6) + 0.0 AS importance
        FROM importance GROUP BY feature, feature_pos"""
    ),
    "importance_top": _importance_sql(
        """SELECT feature, feature_pos, round(avg(importance), 6) + 0.0 AS importance
        FROM importance GROUP BY feature, feature_pos
        ORDER BY avg(importance) DESC, feature_pos LIMIT 20"""
    ),
    "importance_top_per_target": _importance_sql(
        f"""WITH {_top(20)} SELECT target, cast(rank AS integer) AS rank, feature, feature_pos,
               round(importance, 6) + 0.0 AS importance FROM top"""
    ),
    "importance_common": _importance_sql(
        f"""WITH {_top(50)} SELECT feature FROM top GROUP BY feature
        HAVING count(*) = (SELECT count(DISTINCT target) FROM importance)"""
    ),
    "importance_common_summary": _importance_sql(
        f"""WITH {_top(50)}, common AS (SELECT feature FROM top GROUP BY feature
            HAVING count(*) = (SELECT count(DISTINCT target) FROM importance))
        SELECT count(*) AS count, round(count(*) * 100.0 / 50, 6) + 0.0 AS percentage FROM common"""
    ),
    "importance_category": _importance_sql(f"WITH {_CATEGORIES} {_CATEGORY_SELECT}"),
    "importance_given_categories": _importance_sql(
        f"""WITH {_CATEGORIES.replace(_CATEGORY, "'embedding_features'").replace(
            "FROM cat GROUP", "FROM cat WHERE starts_with(feature, 'PC') GROUP")}
        {_CATEGORY_SELECT}"""
    ),
    "importance_category_average": _importance_sql(
        f"""WITH {_CATEGORIES} SELECT category, round(avg(contribution_percentage), 6) + 0.0
            AS average_contribution FROM analysis GROUP BY category"""
    ),
    "importance_category_totals": _importance_sql(
        f"""WITH {_CATEGORIES} SELECT target, """
        + ", ".join(
            f"round(sum(total_importance) FILTER (WHERE category = '{c}'), 6) + 0.0 AS {c}"
            for c in labels.CATEGORIES
        )
        + " FROM analysis GROUP BY target"
    ),
    "importance_specific": _importance_sql(
        """WITH r AS (
            SELECT *, importance / ((sum(importance) OVER (PARTITION BY feature) - importance)
                   / (count(*) OVER (PARTITION BY feature) - 1) + 1e-10) AS ratio FROM importance),
        k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ratio DESC, feature_pos) AS rank FROM r)
        SELECT target, cast(rank AS integer) AS rank, feature, round(ratio, 6) + 0.0 AS ratio
        FROM k WHERE rank <= 10"""
    ),
    "importance_only_in_target": _importance_sql(
        f"""WITH {_top(10)} SELECT target, feature, count(*) OVER (PARTITION BY feature) = 1 AS "unique" FROM top"""
    ),
    "importance_unique": _importance_sql(
        f"""WITH {_top(10)}, u AS (SELECT *, count(*) OVER (PARTITION BY feature) = 1 AS own FROM top)
        SELECT target, round(count(*) FILTER (WHERE own) * 100.0 / count(*), 6) + 0.0 AS unique_contribution
        FROM u GROUP BY target"""
    ),
    "importance_corr": _importance_sql(
        f"""WITH {_CORR} SELECT feature1, feature2, round(r, 4) + 0.0 AS correlation,
               CASE WHEN r > 0 THEN 'similar importance patterns' ELSE 'opposite importance patterns' END
               AS interpretation
        FROM pair WHERE abs(r) >= 0.7"""
    ),
    "importance_mean_corr": _importance_sql(
        f"""WITH {_CORR}, m AS (SELECT count(DISTINCT feature) AS m FROM importance)
        SELECT (SELECT m FROM m) AS n_features, round(((SELECT m FROM m) + 2 * sum(r))
               / pow((SELECT m FROM m), 2), 6) + 0.0 AS mean_correlation FROM pair"""
    ),
    "importance_cv": _importance_sql(
        f"WITH {_CV} SELECT feature, feature_pos, round(cv, 6) + 0.0 AS cv FROM cv"
    ),
    "importance_stability": _importance_sql(
        f"""WITH {_CV}
        SELECT * FROM (SELECT 'most_stable' AS kind, feature, round(cv, 6) + 0.0 AS cv FROM cv
                       ORDER BY cv.cv, feature_pos LIMIT 10) a
        UNION ALL SELECT * FROM (SELECT 'most_unstable', feature, round(cv, 6) + 0.0 FROM cv
                       ORDER BY cv.cv DESC, feature_pos LIMIT 10) b"""
    ),
    "importance_overall_stability": _importance_sql(
        f"""WITH {_CV} SELECT round(avg(cv), 6) + 0.0 AS overall_stability, count(cv) AS n_defined,
               count(*) - count(cv) AS n_undefined,
               CASE WHEN avg(cv) < 0.5 THEN 'high' WHEN avg(cv) < 1.0 THEN 'moderate' ELSE 'low' END AS stability
        FROM cv"""
    ),
    "importance_types": _importance_sql(
        f"""WITH {_top(10)}, typed AS (SELECT target, {_TYPE} AS kind FROM top),
        kinds(feature_type) AS (VALUES ('embedding'), ('structure'), ('covariate'))
        SELECT t.target, feature_type, (SELECT count(*) FROM typed x
               WHERE x.target = t.target AND x.kind = feature_type) AS count
        FROM (SELECT DISTINCT target FROM top) t, kinds"""
    ),
    "importance_matrix": _importance_sql(
        """WITH top AS (SELECT feature FROM importance GROUP BY feature, feature_pos
                        ORDER BY avg(importance) DESC, feature_pos LIMIT 20)
        SELECT feature, """
        + ", ".join(
            f"round(max(importance) FILTER (WHERE target = '{t}'), 6) + 0.0 AS {t}" for t in TARGETS
        )
        + " FROM importance WHERE feature IN (SELECT feature FROM top) GROUP BY feature"
    ),
    "feature_categories": _importance_sql(
        f"""SELECT DISTINCT feature, {_CATEGORY} AS category, {_TYPE} AS feature_type FROM importance"""
    ),
    "executive_summary": with_views(
        f"""WITH {_PAIRS}, {_MOMENTS}, {_LONG}, {_CATEGORIES}, {_CV},
        s AS (SELECT target, avg(v) AS mean, min(v) AS min, max(v) AS max, quantile_cont(v, 0.9) AS p90
              FROM long GROUP BY target),
        lines AS (
            SELECT 'overview' AS section, 'sequences' AS item, cast(count(*) AS double) AS value,
                   cast(NULL AS varchar) AS text FROM predictions
            UNION ALL SELECT 'performance', 'mean_r2', avg(r2),
                   {_ladder('avg(r2)', labels.CARD_RATINGS, labels.CARD_LOWEST)} FROM metrics
            UNION ALL SELECT 'insights', concat(target, ' mean'), mean, NULL FROM s
            UNION ALL SELECT 'insights', concat(target, ' min'), min, NULL FROM s
            UNION ALL SELECT 'insights', concat(target, ' max'), max, NULL FROM s
            UNION ALL SELECT 'insights', concat(target, ' p90'), p90, NULL FROM s
            UNION ALL SELECT * FROM (SELECT 'insights', 'top feature', avg(importance), feature
                   FROM importance GROUP BY feature, feature_pos
                   ORDER BY avg(importance) DESC, feature_pos LIMIT 5) t
            UNION ALL SELECT 'findings', category, avg(contribution_percentage), NULL
                   FROM analysis GROUP BY category
            UNION ALL SELECT 'findings', 'stability', avg(cv), CASE WHEN avg(cv) < 0.5 THEN 'high'
                   WHEN avg(cv) < 1.0 THEN 'moderate' ELSE 'low' END FROM cv)
        SELECT section, item, round(value, 4) + 0.0 AS value, text FROM lines""",
        "eval_pairs", "predictions", "importance",
    ),
}

_IMPORTANCE_QUERIES = {
    "importance_summary": _over_importance(imp.summary_overall),
    "importance_per_target": _over_importance(imp.summary_per_target),
    "importance_mean": _over_importance(imp.mean_importance),
    "importance_top": _over_importance(imp.top_overall, 20),
    "importance_top_per_target": _over_importance(imp.top_per_target, 20),
    "importance_common": importance_common,
    "importance_common_summary": _over_importance(imp.common_summary, 50),
    "importance_category": _over_importance(imp.category_analysis),
    "importance_given_categories": importance_given_categories,
    "importance_category_average": importance_category_average,
    "importance_category_totals": _over_importance(imp.category_totals),
    "importance_specific": _over_importance(imp.specificity),
    "importance_only_in_target": _over_importance(imp.only_in_target),
    "importance_unique": _over_importance(imp.unique_contribution),
    "importance_corr": _over_importance(imp.correlated_pairs, digits=4),
    "importance_mean_corr": _over_importance(imp.mean_correlation),
    "importance_cv": _over_importance(imp.coefficient_of_variation),
    "importance_stability": _over_importance(imp.stability),
    "importance_overall_stability": _over_importance(imp.overall_stability),
    "importance_types": _over_importance(imp.feature_type_counts),
    "importance_matrix": _over_importance(imp.top_matrix, TARGETS, 20),
    "feature_categories": feature_categories,
    "executive_summary": executive_summary,
}

# --- fitted models (no SQL equivalent) --------------------------------------------------

#: All dimensions of the embeddings.
COMPONENTS = 64


def _model_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, Sources]:
    """Sequences with assay values; every sequence is folded, some have an embedding."""
    rows = views.sequences(spark, sf).join(views.assay(spark, sf), "seq_id")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq_id"), "embedding")
    return rows, Sources(views.structures(spark, sf), vectors)


MODEL_TARGETS = ["yield_value", "dsrna_percent", "expression"]


def embedding_pca(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    reducer = EmbeddingReducer(COMPONENTS).fit(vectors)
    return reducer.expand(reducer.transform(vectors, "vec_id"), "vec_id")


def embedding_pca_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return EmbeddingReducer(COMPONENTS).fit(table(spark, sf, "embeddings")).statistics(spark)


def composition_embedder():
    """A stand-in for a model: base fractions of each sequence."""

    def embed(batch: list[str]) -> np.ndarray:
        return np.array([[s.count(b) / max(len(s), 1) for b in "ACGTU"] for s in batch])

    return embed


def embed_hook(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding.model_input(views.sequences(spark, sf), "dnabert2")
    embedded = embedding.embed_sequences(rows, composition_embedder)
    return embedded.select(
        "seq_id",
        "embed_status",
        *[
            (F.round(F.col("embedding")[i].cast("double"), 4) + F.lit(0.0)).alias(f"share_{b}")
            for i, b in enumerate("ACGT")
        ],
    )


def train_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows, sources = _model_rows(spark, sf)
    train, test = split(rows)
    model = PropertyModel(COMPONENTS).fit(train, sources, MODEL_TARGETS)
    return model.predict(test, sources, include_features=False)


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows, sources = _model_rows(spark, sf)
    return PropertyModel(COMPONENTS).fit(rows, sources, MODEL_TARGETS).importance(spark)


WIDE = 5000


def _widened(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings with each component repeated in turn: as many directions, more dimensions."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    many = F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda i: F.col("embedding")[i % F.size("embedding")].cast("double"))
    return vectors.select("vec_id", many.alias("embedding"))


def wide_pca(spark: SparkSession, sf: str) -> DataFrame:
    """PCA beyond the dimensions of a square matrix: with all directions kept, lengths are those
    of the scaled input."""
    vectors = _widened(spark, sf)
    reduced = EmbeddingReducer(COMPONENTS).fit(vectors).transform(vectors, "vec_id")
    square = F.aggregate("reduced", F.lit(0.0), lambda total, x: total + x * x)
    return rounded(reduced.select("vec_id", square.alias("square")), 2)


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, PropertyModel]:
    rows, sources = _model_rows(spark, sf)
    model = PropertyModel(COMPONENTS)
    model.featurizer = model.featurizer.fit(rows, sources)
    model.encoder = CovariateEncoder().fit(rows, ["enzyme_type", "temperature"])
    return model.assemble(rows, sources, MODEL_TARGETS), model


def assembled_features(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _features(spark, sf)
    return rows.select("seq_id", vector_to_array("features").alias("features"), "fold_status", "embed_status")


COVARIATE_FEATURES = [
    "enzyme_type_en", "enzyme_type_es", "enzyme_type_fr", "temperature_39.5", "temperature_42.0",
]


def feature_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Structure features and encoded covariates of every sequence, joined by key."""
    rows, sources = _model_rows(spark, sf)
    sources = Sources(sources.structures)
    model = PropertyModel()
    model.featurizer = model.featurizer.fit(rows, sources)
    model.encoder = CovariateEncoder().fit(rows, ["enzyme_type", "temperature"])
    values = vector_to_array("features")
    wide = model.assemble(rows, sources, ["expression"]).select(
        "seq_id", "expression", *[values[i].alias(n) for i, n in enumerate(model.feature_names)]
    )
    return rounded(wide)


def embedding_pca_norms(spark: SparkSession, sf: str) -> DataFrame:
    """With all components kept PCA only rotates: lengths equal those of the scaled input."""
    vectors = table(spark, sf, "embeddings")
    reduced = EmbeddingReducer(COMPONENTS).fit(vectors).transform(vectors, "vec_id")
    square = F.aggregate("reduced", F.lit(0.0), lambda total, x: total + x * x)
    return rounded(reduced.select("vec_id", square.alias("square")), 4)


def model_reload(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of a fitted model against those of its saved and loaded copy."""
    rows, sources = _model_rows(spark, sf)
    model = PropertyModel(COMPONENTS).fit(rows, sources, MODEL_TARGETS)
    path = model.save(spark, f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}")
    both = [
        m.predict(rows, sources, include_features=False).select(
            "seq_id", F.struct(*(f"predicted_{t}" for t in MODEL_TARGETS)).alias(name)
        )
        for m, name in ((model, "before"), (PropertyModel.load(spark, path), "after"))
    ]
    pairs = both[0].join(both[1], "seq_id")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_different"),
    )


def cross_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows, model = _features(spark, sf)
    return cross_validate(rows, MODEL_TARGETS, model.feature_names)


def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _features(spark, sf)
    _, settings = tune(rows, "expression", {"max_depth": [2, 3]}, Boosting(trees=3), folds=2)
    return settings


STUMP_FEATURES = ["temperature", "remainder", "chars"]
STUMP = Boosting(trees=1, depth=1, rate=0.3, reg_lambda=2.0, reg_alpha=0.5, min_rows=5)


def _stump_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Three features with few values, one with gaps."""
    remainder = F.when(F.col("seq_id") % 11 != 0, (F.col("seq_id") % 7).cast("double"))
    chars = (F.col("n_chars") % 20).cast("double")
    more = table(spark, sf, "documents").select(F.col("doc_id").alias("seq_id"), chars.alias("chars"))
    rows = views.assay(spark, sf).join(more, "seq_id").withColumn("remainder", remainder)
    values = F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in STUMP_FEATURES])
    return rows.select("seq_id", "yield_value", values.alias("features"))


def boosted_stump(spark: SparkSession, sf: str) -> DataFrame:
    """One tree of one split, with penalties: the smallest model that plain SQL can search."""
    rows = _stump_rows(spark, sf)
    model = fit_targets(rows, ["yield_value"], STUMP_FEATURES, STUMP)
    return rounded(model.predict(rows).select("seq_id", "predicted_yield_value"))


def boosting_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Early stopping by rounds: each target's curve against the model cut at each round."""
    rows, model = _features(spark, sf)
    marked = settle(rows.withColumn("held", fold_of("seq_id", 4) == 0))
    params = Boosting(trees=20, depth=4, rate=0.3, validation="held", validation_tolerance=0.0, patience=3)
    fitted = fit_targets(marked, MODEL_TARGETS, model.feature_names, params)
    held = marked.where("held")
    kept = {r: fitted.truncated(r) for r in range(max(m.getNumTrees for m in fitted.models.values()) + 1)}
    stages = [m.evaluate(held).select("target", F.lit(r).alias("round"), "mse") for r, m in kept.items()]
    measured = reduce(DataFrame.unionByName, stages)
    both = fitted.curve(spark).join(measured, ["target", "round"])
    near = F.abs(F.col("mse") - F.col("validation_mse")) <= 1e-9 * (1 + F.col("mse"))
    # A model has no more rounds than its own trees, so the stages beyond are the same model.
    lengths = spark.createDataFrame([(t, m.getNumTrees) for t, m in fitted.models.items()], "target string, n_trees int")
    known = both.join(lengths, "target").where("round <= n_trees")
    return known.groupBy("target").agg(F.count_if(~near).alias("n_different"))


def _job_folder(spark: SparkSession, sf: str) -> tuple[str, str, Sources]:
    """A new folder, the job input stored in it (all non-empty sequences), and the sources."""
    root = f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    rows, sources = _model_rows(spark, sf)
    named = rows.where("sequence <> ''").withColumnsRenamed({"yield_value": "yield", "dsrna_percent": "dsRNA_percent"})
    return root, tables.write_table(named, f"{root}/input"), sources


def job_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, missing cells per column and repeated rows from the sections that the job stores."""
    root, path, _ = _job_folder(spark, sf)
    jobs.validate_job(spark, path, f"{root}/quality")
    read = lambda name: spark.read.parquet(f"{root}/quality/{name}")
    return read("sequence_summary").select("total_sequences", "valid_sequences", "invalid_sequences")


def job_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Train, predict and evaluate from stored tables: what the stored results must agree on."""
    root, path, sources = _job_folder(spark, sf)
    jobs.train_job(spark, path, f"{root}/run", sources, n_components=COMPONENTS, validate=True)
    jobs.predict_job(spark, f"{root}/run/model", path, f"{root}/predicted", sources, csv=True)
    jobs.evaluate_job(spark, f"{root}/run/model", path, f"{root}/evaluated", sources)
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    tests, predicted = read("run/test_results"), read("predicted/predictions")
    metrics = {r["target"]: r for r in read("run/test_metrics").collect()}
    again = tests.agg(*(F.avg(F.pow(F.col(t) - F.col(f"predicted_{t}"), 2)).alias(t) for t in metrics)).first()
    sums = read("run/feature_importance").groupBy("target").agg(F.sum("importance").alias("s")).collect()
    facts = (
        tests.count(),
        predicted.count(),
        tables.read_table(spark, f"{root}/predicted/predictions_csv", kind="csv").count(),
        read("evaluated/predictions").join(predicted.select("seq_id"), "seq_id").count(),
        sum(abs(metrics[t]["mse"] - again[t]) < 1e-9 for t in metrics),
        sum(abs(r["s"] - 1) < 1e-6 for r in sums),
    )
    return spark.createDataFrame(
        [facts], "n_test bigint, n_predicted bigint, n_csv bigint, n_evaluated bigint, n_mse_equal bigint, n_importance_whole bigint"
    )


def job_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Embed, reduce and attach from stored tables: rows, rows with components, statistics."""
    root, path, _ = _job_folder(spark, sf)
    jobs.embed_job(spark, path, f"{root}/embedded", composition_embedder, n_components=2)
    read = lambda name: spark.read.parquet(f"{root}/embedded/{name}")
    whole = read("embeddings").agg(F.count("*").alias("n"), F.count("PC2").alias("known")).first()
    facts = read("embedding_statistics").first()
    embedded = read("raw_embeddings").where("embed_status = 'ok'").count()
    row = (whole["n"], whole["known"], embedded, facts["raw_dimension"], facts["n_components"], facts["total_explained_variance"] <= 1 + 1e-9)
    return spark.createDataFrame(
        [row], "n_rows bigint, n_with_components bigint, n_embedded bigint, raw_dimension int, n_components int, within boolean"
    )


_JOB_ROWS = "jobs AS (SELECT count(*) AS n FROM sequences WHERE sequence <> '')"
_JOB_SQL = {
    "job_validate": with_views(
        f"WITH {_JOB_ROWS} SELECT n AS total_sequences, n AS valid_sequences, cast(0 AS bigint) AS invalid_sequences FROM jobs", "sequences"
    ),
    "job_chain": with_views(
        f"""WITH {_JOB_ROWS} SELECT greatest(1, cast(floor(n * 0.2) AS bigint)) AS n_test, n AS n_predicted, n AS n_csv,
            n AS n_evaluated, cast(3 AS bigint) AS n_mse_equal, cast(3 AS bigint) AS n_importance_whole FROM jobs""",
        "sequences",
    ),
    "job_embed": with_views(
        f"""WITH {_JOB_ROWS} SELECT n AS n_rows, n AS n_with_components, n AS n_embedded, 5 AS raw_dimension, 2 AS n_components,
            true AS within FROM jobs""",
        "sequences",
    ),
}
_EMBED_SQL = {
    "embed_hook": with_views(
        """WITH cut AS (SELECT seq_id, substring(translate(sequence, 'U', 'T'), 1, 2048) AS s FROM sequences)
        SELECT seq_id, 'ok' AS embed_status, """
        + ", ".join(
            f"round(cast(cast((length(s) - length(replace(s, '{b}', ''))) * 1.0::double"
            f" / greatest(length(s), 1) AS float) AS double), 4) + 0.0 AS share_{b}"
            for b in "ACGT"
        )
        + " FROM cut",
        "sequences",
    )
}

_STRUCTURE = [
    "mfe", "mfe_normalized", "hairpin_count", "stem_count", "gc_content", "sequence_length",
    "bulge_count", "loop_count",
]
_EMBED_SQL["feature_assembly"] = (
    f"WITH f AS ({STRUCTURE_SQL}), c AS ({ONE_HOT_SQL}), a AS ({views.SQL['assay']}) "
    f"SELECT f.seq_id, round(expression, 6) + 0.0 AS expression, "
    + ", ".join(f'cast({n} AS double) + 0.0 AS "{n}"' for n in _STRUCTURE)
    + ", "
    + ", ".join(f'"{n}"' for n in COVARIATE_FEATURES)
    + " FROM f JOIN c ON f.seq_id = c.seq_id JOIN a ON f.seq_id = a.seq_id"
)
_EMBED_SQL["embedding_pca_norms"] = """
    WITH u AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS p,
                      cast(unnest(embedding) AS double) AS x FROM embeddings),
    s AS (SELECT p, avg(x) AS m, stddev_samp(x) AS d FROM u GROUP BY p)
    SELECT vec_id, round(sum(pow((x - m) / d, 2)), 4) + 0.0 AS square
    FROM u JOIN s ON u.p = s.p GROUP BY vec_id"""
# Component p is repeated 79 times up to the eighth, 78 times beyond (5,000 = 64 x 78 + 8).
_EMBED_SQL["wide_pca"] = """
    WITH u AS (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS p,
                      cast(unnest(embedding) AS double) AS x FROM embeddings),
    s AS (SELECT p, avg(x) AS m, stddev_samp(x) AS d FROM u GROUP BY p)
    SELECT vec_id, round(sum(CASE WHEN u.p <= 8 THEN 79 ELSE 78 END * pow((x - m) / d, 2)), 2) + 0.0 AS square
    FROM u JOIN s ON u.p = s.p GROUP BY vec_id"""
_EMBED_SQL["model_reload"] = """
    SELECT count(*) AS n_rows, cast(0 AS bigint) AS n_different FROM documents"""

_LEAF = "-sign({g}) * greatest(abs({g}) - 0.5, 0) / ({h} + 2)"
_SCORE = "pow(greatest(abs({g}) - 0.5, 0), 2) / ({h} + 2)"
_EMBED_SQL["boosted_stump"] = (
    f"WITH a AS ({views.SQL['assay']}), "
    f"""f AS (SELECT a.seq_id, yield_value AS y, temperature AS f0,
                 CASE WHEN a.seq_id % 11 <> 0 THEN cast(a.seq_id % 7 AS double) END AS f1, cast(n_chars % 20 AS double) AS f2
          FROM a JOIN documents ON a.seq_id = doc_id),
    base AS (SELECT avg(y) AS b FROM f),
    long AS (SELECT seq_id, b - y AS g, unnest([0, 1, 2]) AS i, unnest([f0, f1, f2]) AS x FROM f, base WHERE y IS NOT NULL),
    total AS (SELECT sum(b - y) AS g, count(*) AS h FROM f, base WHERE y IS NOT NULL),
    cuts AS (SELECT DISTINCT i, x AS cut, side FROM long, (SELECT unnest([0, 1]) AS side) WHERE x IS NOT NULL),
    tried AS (SELECT c.i, cut, side, sum(CASE WHEN x <= cut OR (x IS NULL AND side = 0) THEN long.g ELSE 0 END) AS gl,
                     count(*) FILTER (WHERE x <= cut OR (x IS NULL AND side = 0)) AS hl
              FROM cuts c JOIN long ON c.i = long.i GROUP BY c.i, cut, side),
    best AS (SELECT *, g - gl AS gr, h - hl AS hr FROM tried, total WHERE hl >= 5 AND h - hl >= 5
             ORDER BY {_SCORE.format(g='gl', h='hl')} + {_SCORE.format(g='(g - gl)', h='(h - hl)')} DESC, side, i, cut LIMIT 1),
    scored AS (SELECT f.seq_id, CASE WHEN x <= cut OR (x IS NULL AND side = 0) THEN {_LEAF.format(g='gl', h='hl')}
                                ELSE {_LEAF.format(g='gr', h='hr')} END AS w
               FROM (SELECT seq_id, unnest([0, 1, 2]) AS i, unnest([f0, f1, f2]) AS x FROM f) f JOIN best USING (i))
    SELECT seq_id, round(b + 0.3 * w, 6) + 0.0 AS predicted_yield_value FROM scored, base"""
)
_EMBED_SQL["boosting_curve"] = """
    SELECT unnest(['yield_value', 'dsrna_percent', 'expression']) AS target, cast(0 AS bigint) AS n_different"""

QUERIES = {
    **{
        f.__name__: f
        for f in (
            eval_per_target, eval_basic, eval_overall, eval_correlations, eval_p_values, residuals,
            eval_joined, model_score, performance_card, prediction_attach, prediction_summary,
            ranked_report, top_sequences, insight_distribution, sequence_characteristics,
            report_metadata, price_quantiles, price_ranks,
        )
    },
    **_IMPORTANCE_QUERIES,
    **{
        f.__name__: f
        for f in (
            embedding_pca, embedding_pca_statistics, wide_pca, embed_hook, train_predict, feature_importance,
            assembled_features, feature_assembly, embedding_pca_norms, model_reload,
            cross_validation, grid_search, boosted_stump, boosting_curve, job_validate, job_chain, job_embed,
        )
    },
}
ORACLE = {**_EVAL_SQL, **_REPORT_SQL, **_IMPORTANCE_SQL, **_JOB_SQL, **_EMBED_SQL}
