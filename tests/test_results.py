"""Metrics, reports and importance analysis against numpy and pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwise.operators import evaluation, importance, ranking
from strandwise.plans import report


def pairs(spark, *parts):
    rows = [(t, float(y), float(p)) for t, ys, ps in parts for y, p in zip(ys, ps)]
    return spark.createDataFrame(rows, "target string, y_true double, y_pred double").repartition(4)


@pytest.fixture(scope="module")
def random_pairs():
    rng = np.random.default_rng(3)
    parts = []
    for name, shift in (("a", 0), ("b", 50), ("c", -3)):
        y = np.round(rng.normal(shift, 5, 400), 1)
        parts.append((name, y, np.round(y * 0.8 + rng.normal(0, 2, 400), 1)))
    return parts


def test_metrics_against_numpy(spark, random_pairs):
    got = {r.target: r for r in evaluation.target_metrics(pairs(spark, *random_pairs)).collect()}
    r2s, ys, ps = [], [], []
    for name, y, p in random_pairs:
        e, m = y - p, got[name]
        r2 = 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum()
        r2s.append(r2), ys.append(y), ps.append(p)
        expected = {
            "r2": r2, "mse": (e**2).mean(), "rmse": np.sqrt((e**2).mean()), "mae": np.abs(e).mean(),
            "median_ae": np.median(np.abs(e)), "explained_variance": 1 - e.var() / y.var(),
            "pearson_r": np.corrcoef(y, p)[0, 1],
            "spearman_r": pd.Series(y).rank().corr(pd.Series(p).rank()),
            "mean_true": y.mean(), "std_true": y.std(), "mean_pred": p.mean(), "std_pred": p.std(),
            "mean_residual": e.mean(), "std_residual": e.std(), "max_residual": np.abs(e).max(),
        }
        for metric, value in expected.items():
            assert m[metric] == pytest.approx(value, abs=1e-9), (name, metric)
        if (y == 0).any():
            assert m["mape"] is None
        else:
            assert m["mape"] == pytest.approx(np.abs(e / y).mean() * 100)
    overall = evaluation.overall_metrics(evaluation.moment_metrics(pairs(spark, *random_pairs))).first()
    y, p = np.concatenate(ys), np.concatenate(ps)
    assert overall.mean_r2 == pytest.approx(np.mean(r2s))
    assert overall.std_r2 == pytest.approx(np.std(r2s))
    assert overall.overall_r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert overall.overall_rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert overall.overall_mae == pytest.approx(np.abs(y - p).mean())
    assert evaluation.score(evaluation.basic_metrics(pairs(spark, *random_pairs))) == pytest.approx(np.mean(r2s))


def test_metric_edges(spark):
    table = pairs(
        spark, ("flat_hit", [2, 2], [2, 2]), ("flat_miss", [2, 2], [1, 3]), ("single", [1], [2]),
        ("zero", [0, 1, 2], [0, 1, 3]), ("gap", [1, float("nan"), 3], [1, 2, float("nan")]),
    )
    got = {r.target: r for r in evaluation.target_metrics(table).collect()}
    assert (got["flat_hit"].r2, got["flat_miss"].r2, got["single"].r2) == (1.0, 0.0, None)
    assert (got["flat_hit"].explained_variance, got["flat_miss"].explained_variance) == (1.0, 0.0)
    assert (got["flat_miss"].pearson_r, got["flat_miss"].spearman_r, got["flat_miss"].pearson_p) == (None,) * 3
    assert got["zero"].mape is None and got["gap"].n == 1


def test_assessment(spark):
    row = spark.createDataFrame([(0.45, 0.3)], "mean_r2 double, std_r2 double")
    got = evaluation.assess(row).first()
    assert (got.rating, got.assessment[:8], len(got.advice)) == ("Fair", "MODERATE", 4)


PREDICTIONS = [
    (1, "G" * 700, 0.9, 1.0, 2.0), (2, "A" * 100, 0.7, 11.0, 1.0), (3, "ACGU" * 600, 0.9, 1.0, 1.0),
    (4, "ACGU" * 200, None, 1.0, 1.0), (5, None, 0.1, None, 1.0),
]


@pytest.fixture(scope="module")
def predictions(spark):
    return spark.createDataFrame(
        PREDICTIONS,
        "seq_id long, sequence string, predicted_yield double, predicted_dsRNA_percent double, "
        "predicted_expression double",
    )


def test_ranked_report(predictions):
    rows = ranking.ranked_report(predictions, top_n=1).collect()
    assert [(r.seq_id, r["rank"], r.top_performer) for r in rows] == [
        (1, 1, True), (3, 1, True), (2, 3, False), (5, 4, False), (4, None, False)
    ]
    assert rows[0].insights == "high GC content; high yield predicted; strong expression expected"
    assert rows[2].insights == "short sequence; low GC content; high dsRNA formation risk"
    assert rows[4].insights == "standard profile"
    assert rows[3].sequence_length is None and "sequence" not in rows[0]
    assert "sequence" in ranking.ranked_report(predictions, keep_sequence=True).columns


def test_report_without_the_sort_column(predictions):
    report_ = ranking.ranked_report(predictions, sort_by="predicted_other")
    assert "rank" not in report_.columns
    assert {r.top_performer for r in report_.collect()} == {False}


def test_top_flag(spark):
    df = spark.createDataFrame([(1, 0.8), (2, 0.6), (3, 0.9)], "seq_id long, predicted_yield double")
    rows = ranking.ranked_report(df, top_n=2).collect()
    assert sum(r.top_performer for r in rows) == 2 and rows[0].seq_id == 3


def test_top_sequences_agree_with_the_report(spark):
    df = spark.range(500).select(
        F.col("id").alias("seq_id"), F.lit("ACGU").alias("sequence"), (F.col("id") * 7 % 100 / 10.0).alias("predicted_yield")
    )
    top = [(r.seq_id, r["rank"]) for r in ranking.top_sequences(df, 12).orderBy("rank", "seq_id").collect()]
    full = ranking.ranked_report(df).limit(12).collect()
    assert top == [(r.seq_id, r["rank"]) for r in full]


def test_prediction_summary(predictions):
    rows = {r.target: r for r in ranking.prediction_summary(predictions).collect()}
    y = pd.Series([0.9, 0.7, 0.9, 0.1])
    got = rows["yield"]
    assert (got["mean"], got["min"], got["max"], got["p90"]) == pytest.approx((y.mean(), 0.1, 0.9, y.quantile(0.9)))
    assert set(rows) == {"yield", "dsRNA_percent", "expression"}


def test_insight_distribution(predictions):
    facts = ranking.add_insights(ranking.add_sequence_facts(predictions))
    rows = ranking.insight_distribution(facts, 2).collect()
    assert rows[0]["count"] == 2 and rows[0].insights == "standard profile"
    assert rows[0].percentage == pytest.approx(40) and len(rows) == 2
    facts = ranking.sequence_characteristics(facts).first()
    assert (facts.min_length, facts.max_length, facts.max_gc) == (100, 2400, 1.0)


# --- importance ---


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(11)
    values = rng.random((40, 4)) ** 2
    values[3] = 0.0
    values[7] = values[6] * 2
    values[9] = 0.5 - values[8] / 10
    values[12] = values[13]
    names = [f"PC{i + 1}" for i in range(30)] + ["mfe", "gc_content", "hairpin_count"] + [f"cov_{i}" for i in range(7)]
    return pd.DataFrame(values, index=names, columns=["t1", "t2", "t3", "t4"])


@pytest.fixture(scope="module")
def long(spark, wide):
    rows = [(f, i + 1, t, float(wide.iloc[i, j])) for i, f in enumerate(wide.index) for j, t in enumerate(wide.columns)]
    return spark.createDataFrame(rows, "feature string, feature_pos int, target string, importance double")


def test_importance_summary(long, wide):
    row = importance.summary_overall(long).first()
    flat = wide.to_numpy().ravel()
    assert (row["mean"], row["std"], row["median"]) == pytest.approx((flat.mean(), flat.std(), np.median(flat)))
    assert (row.non_zero_features, row.total_features) == ((flat > 0).sum(), 160)
    for r in importance.summary_per_target(long).collect():
        s = wide[r.target]
        assert (r["mean"], r["std"], r.top_importance) == pytest.approx((s.mean(), s.std(), s.max()))
        assert r.top_feature == s.idxmax() and r.effective_features == (s > s.mean()).sum()


def test_top_features(long, wide):
    assert [r.feature for r in importance.top_overall(long, 20).collect()] == wide.mean(axis=1).nlargest(20).index.tolist()
    got = importance.top_per_target(long, 10).toPandas()
    for t in wide:
        mine = got[got["target"] == t].sort_values("rank")["feature"].tolist()
        assert mine == wide[t].nlargest(10).index.tolist()
    tops = {t: set(wide[t].nlargest(10).index) for t in wide}
    assert {r.feature for r in importance.common_top(long, 10).collect()} == set.intersection(*tops.values())
    for r in importance.unique_contribution(long).collect():
        others = set().union(*(v for k, v in tops.items() if k != r.target))
        assert r.unique_contribution == pytest.approx(len(tops[r.target] - others) * 10)


def test_specificity(long, wide):
    got = importance.specificity(long).toPandas()
    for t in wide:
        ratio = (wide[t] / (wide.drop(columns=t).mean(axis=1) + 1e-10)).nlargest(10)
        mine = got[got["target"] == t].sort_values("rank")
        assert mine["feature"].tolist() == ratio.index.tolist()
        np.testing.assert_allclose(mine["ratio"], ratio)
    assert importance.specificity(long.where("target = 't1'")).count() == 0


def test_categories(spark, long, wide):
    kind = ["embedding_features"] * 30 + ["structure_features"] * 3 + ["covariate_features"] * 7
    grouped = wide.groupby(np.array(kind))
    for r in importance.category_analysis(long).collect():
        part = grouped.get_group(r.category)[r.target]
        assert r.feature_count == len(part) and r.top_feature == part.idxmax()
        assert (r.mean_importance, r.total_importance) == pytest.approx((part.mean(), part.sum()))
        assert r.contribution_percentage == pytest.approx(part.sum() / wide[r.target].sum() * 100)
    totals = importance.category_totals(long).toPandas().set_index("target")
    np.testing.assert_allclose(totals.loc["t2", "structure_features"], grouped.get_group("structure_features")["t2"].sum())
    given = spark.createDataFrame([("PC1", "mine"), ("PC2", "mine"), ("gone", "mine")], "feature string, category string")
    rows = importance.category_analysis(long, given).collect()
    assert {r.feature_count for r in rows} == {2}
    zero = long.withColumn("importance", F.lit(0.0))
    assert {r.contribution_percentage for r in importance.category_analysis(zero).collect()} == {0.0}


def test_correlations(long, wide, monkeypatch):
    matrix = wide.T.corr()
    expected = {}
    for i, a in enumerate(wide.index):
        for b in wide.index[i + 1 :]:
            if abs(matrix.loc[a, b]) >= 0.7:
                expected[(a, b)] = matrix.loc[a, b]
    for size in (2_000, 6):  # one block, then seven
        monkeypatch.setattr(importance, "BLOCK_FEATURES", size)
        got = importance.correlated_pairs(long).collect()
        assert {(r.feature1, r.feature2) for r in got} == set(expected) and len(got) == len(expected)
        for r in got:
            assert r.correlation == pytest.approx(expected[r.feature1, r.feature2])
            assert r.interpretation.startswith("similar" if r.correlation > 0 else "opposite")
    row = importance.mean_correlation(long).first()
    assert row.n_features == 39
    assert row.mean_correlation == pytest.approx(np.nanmean(matrix.to_numpy()))


def test_correlations_of_incomplete_tables(spark):
    values = {"f1": {"a": 1.0, "b": 2.0, "c": 4.0}, "f2": {"b": 9.0, "c": 1.0, "d": 2.0}, "f3": {"a": 5.0, "d": 1.0}, "f4": {"b": 3.0, "c": 3.0, "d": 3.0}}
    rows = [(f, i, t, v) for i, (f, by) in enumerate(values.items()) for t, v in by.items()]
    table = spark.createDataFrame(rows, "feature string, feature_pos int, target string, importance double")
    matrix = pd.DataFrame(values).corr(min_periods=2)
    got = {(r.feature1, r.feature2): r.correlation for r in importance.correlated_pairs(table, 0.0).collect()}
    expected = {(a, b): matrix.loc[a, b] for a in values for b in values if a < b and not np.isnan(matrix.loc[a, b])}
    assert got == pytest.approx(expected)
    assert got["f1", "f2"] == pytest.approx(-1.0)
    with pytest.raises(ValueError, match="every feature and target"):
        importance.mean_correlation(table)


def test_stability(long, wide):
    cv = (wide.std(axis=1) / wide.mean(axis=1)).where(wide.mean(axis=1) > 0)
    rows = importance.stability(long).collect()
    low = [r.feature for r in rows if r.kind == "most_stable"]
    high = [r.feature for r in rows if r.kind == "most_unstable"]
    assert low == cv.nsmallest(10).index.tolist() and high == cv.nlargest(10).index.tolist()
    row = importance.overall_stability(long).first()
    assert row.overall_stability == pytest.approx(cv.mean())
    assert (row.n_defined, row.n_undefined) == (39, 1)


def test_types_and_matrix(long, wide):
    counts = importance.feature_type_counts(long).toPandas()
    assert (counts.groupby("target")["count"].sum() == 10).all() and len(counts) == 12
    matrix = importance.top_matrix(long, list(wide), 5).toPandas().set_index("feature")
    top = wide.mean(axis=1).nlargest(5).index
    pd.testing.assert_frame_equal(matrix.loc[top], wide.loc[top], check_names=False)


def test_report_sections(spark, predictions, long, random_pairs):
    sections = report.report_sections(predictions, long, ["yield"], pairs(spark, *random_pairs))
    for name, section in sections.items():
        assert section.count() > 0, name
    summary = {(r.section, r.item): r for r in sections["executive_summary"].collect()}
    assert summary["overview", "sequences"].value == 5
    assert summary["findings", "stability"].text in ("high", "moderate", "low")
    assert sections["metadata"].first().has_ground_truth
