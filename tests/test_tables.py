"""Sources, quality checks, splits, encoders and scalers on small literal tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strandwise.operators import covariates, features, quality
from strandwise.operators.split import fold_of, split
from strandwise.sources import tables

SAMPLE = [
    ("ACGU" * 20, 0.85, 3.2, 1.4, "T7", 37.0),
    ("UGCA" * 20, 0.72, 5.8, 1.1, "SP6", 42.0),
    ("ACUG" * 20, 0.91, 2.1, 1.8, "T7", 37.0),
]
SCHEMA = "sequence string, yield double, dsRNA_percent double, expression double, enzyme_type string, temperature double"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.createDataFrame(SAMPLE, SCHEMA)


# --- sources ---


def test_csv_round_trip_and_types(spark, sample, tmp_path):
    path = tables.write_csv(
        sample.withColumns({"batch": F.lit(3), "note": F.lit("NA"), "share": F.lit("1e-3")}), str(tmp_path / "a.csv")
    )
    back = tables.load_sequences(spark, path)
    assert dict(back.dtypes) == {
        **dict(sample.dtypes), "batch": "bigint", "note": "string", "share": "double"
    }
    assert sorted(back.select(*sample.columns).collect()) == sorted(sample.collect())


def test_csv_keeps_text_keys_and_reports_bad_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seq_id,sequence,yield,batch,long\nRNA_1,ACGU,abc,NA,12345678901234567890\nRNA_2,NA,1.5,x,1\n")
    rows = {r.seq_id: r for r in tables.load_sequences(spark, str(tmp_path / "a.csv"), ["sequence"], strict=False).collect()}
    assert rows["RNA_1"]["yield"] is None and rows["RNA_1"].unparsed == {"yield": "abc"} and rows["RNA_1"].batch is None
    assert rows["RNA_2"].sequence is None and rows["RNA_2"]["yield"] == 1.5 and rows["RNA_2"].unparsed is None
    assert int(rows["RNA_1"].long) == 12345678901234567890
    with pytest.raises(ValueError, match="yield in 1 rows"):
        tables.load_sequences(spark, str(tmp_path / "a.csv"), ["sequence"])


def test_kinds_of_tables(spark, sample, tmp_path):
    path = tables.write_csv(sample, str(tmp_path / "plain_name"))
    assert tables.load_sequences(spark, path, kind="csv").count() == 3
    with pytest.raises(ValueError, match="unknown kind"):
        tables.read_table(spark, path, kind="orc")


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.load_sequences(spark, str(tmp_path / "none.csv"))


def test_required_columns(spark, sample, tmp_path):
    path = tables.write_table(sample.drop("yield"), str(tmp_path / "t"))
    with pytest.raises(ValueError, match=r"Missing required columns: \['yield'\]"):
        tables.load_sequences(spark, path)
    assert tables.load_sequences(spark, path, required=["sequence"]).count() == 3


@pytest.mark.parametrize("bad, message", [("ACGTX", "Invalid RNA"), (None, "null sequences"), ("acgu", "Invalid RNA")])
def test_strict_load(spark, sample, tmp_path, bad, message):
    more = spark.createDataFrame([(bad, 1.0, 1.0, 1.0, "T7", 37.0)], SCHEMA)
    path = tables.write_table(sample.union(more), str(tmp_path / "t"))
    with pytest.raises(ValueError, match=message):
        tables.load_sequences(spark, path)
    valid, quarantined = quality.split_valid(tables.load_sequences(spark, path, strict=False))
    expected = 4 if bad == "acgu" else 3
    assert (valid.count(), quarantined.count()) == (expected, 4 - expected)


def test_null_targets_are_counted_not_refused(spark, sample):
    more = spark.createDataFrame([("ACGU", None, float("nan"), 1.0, "T7", 37.0)], SCHEMA)
    assert quality.check_strict(sample.union(more)) == {"yield": 1, "dsRNA_percent": 1, "expression": 0}


def test_columns(sample):
    assert quality.target_columns(sample) == ["yield", "dsRNA_percent", "expression"]
    assert quality.covariate_columns(sample) == ["enzyme_type", "temperature"]


def test_keyed_input(spark, sample, tmp_path):
    keyed = tables.keyed_input(sample, str(tmp_path / "keyed"))
    assert keyed.select("seq_id").distinct().count() == 3
    assert tables.keyed_input(keyed, str(tmp_path / "unused")) is keyed


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for name in ("left_side", "right_side"):
        tables.write_bucketed(spark.range(100).withColumnRenamed("id", "seq_id"), name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = features.attach(spark.table("left_side"), spark.table("right_side"))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text
    assert plan.count() == 100


# --- quality ---


def test_sequence_summary(spark):
    texts = ["ACGU", "acguacgu", "", None, "AXC", "GG"]
    df = spark.createDataFrame([(t,) for t in texts], "sequence string")
    row = quality.sequence_summary(df).first()
    assert (row.total_sequences, row.valid_sequences, row.invalid_sequences) == (6, 3, 3)
    lengths = [4, 8, 2]
    assert row.mean_length == pytest.approx(np.mean(lengths))
    assert row.std_length == pytest.approx(np.std(lengths))
    assert (row.min_length, row.max_length, row.median_length) == (2, 8, 4)
    shares = {r.base: (r.mean_fraction, r.std_fraction) for r in quality.base_composition(df).collect()}
    assert shares["G"] == pytest.approx((0.5, np.std([0.25, 0.25, 1.0])))
    assert shares["A"] == pytest.approx((1 / 6, np.std([0.25, 0.25, 0.0])))


def test_target_profile(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None, float("nan")]
    df = spark.createDataFrame([(v, None, 5.0) for v in values], "yield double, dsRNA_percent double, expression double")
    rows = {r.target: r for r in quality.target_profile(df, ["yield", "dsRNA_percent", "expression", "other"]).collect()}
    s = pd.Series([1.0, 2.0, 3.0, 4.0, 100.0])
    y = rows["yield"]
    assert (y.status, y.missing_count, y.outlier_count) == ("present", 2, 1)
    assert y.missing_percentage == pytest.approx(200 / 7)
    assert (y.mean, y.std, y.median, y.q1, y.q3) == pytest.approx((22, s.std(), 3, 2, 4))
    assert (y.min_outlier, y.max_outlier, y.outlier_percentage) == (100, 100, 20)
    z = (s - s.mean()) / s.std(ddof=0)
    assert y.skewness == pytest.approx((z**3).mean())
    assert y.kurtosis == pytest.approx((z**4).mean() - 3)
    jb = 5 / 6 * (y.skewness**2 + y.kurtosis**2 / 4)
    assert (y.jarque_bera, y.normality_p) == pytest.approx((jb, np.exp(-jb / 2)))
    gone = rows["dsRNA_percent"]
    assert (gone.missing_count, gone.mean, gone.median, gone.outlier_count) == (7, None, None, 0)
    flat = rows["expression"]
    assert (flat.std, flat.outlier_count, flat.skewness) == (0, 0, None)
    assert rows["other"].status == "missing"


def test_duplicates(spark):
    rows = [(1, "a", 0.0)] * 4 + [(1, "a", -0.0), (2, None, 1.0), (2, None, 1.0), (2, "n", 1.0), (None, "2", 1.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    assert tuple(quality.duplicate_rows(df).first()) == (9, 5)
    shifted = spark.createDataFrame([("a", None), (None, "a"), ("1:a", ""), ("", "1:a")], "a string, b string")
    assert quality.duplicate_rows(shifted).first().duplicate_rows == 0
    assert tuple(quality.duplicate_rows(df.limit(0)).first()) == (0, 0)


def test_cardinality(spark):
    rows = [(i, f"s{i}", f"s{i % 51}", "x", None) for i in range(100)]
    df = spark.createDataFrame(rows, "i int, own string, half string, same string, none double")
    got = {r["column"]: (r["constant"], r["high_cardinality"]) for r in quality.column_cardinality(df).collect()}
    assert got == {
        "i": (False, False), "own": (False, True), "half": (False, True), "same": (True, False), "none": (True, False)
    }


def test_missing_profile(spark):
    rows = [(1, None, "a"), (2, float("nan"), "b"), (3, 1.0, None)]
    row = quality.missing_profile(spark.createDataFrame(rows, "a int, b double, c string")).first()
    assert (row.total_missing_cells, row.complete_rows, row.columns_with_missing) == (3, 0, {"b": 2, "c": 1})
    assert row.missing_percentage == pytest.approx(100 / 3)


def test_recommendations_and_gate(spark, sample):
    facts = quality.validation_facts(sample)
    assert [r[1] for r in quality.recommendations(facts).collect()] == [
        "Small dataset (3 samples). Consider collecting more data or using regularization."
    ]
    assert quality.critical_issues(facts).count() == 0
    bad = spark.createDataFrame([(None, None, None), ("AXG", None, None)], "sequence string, yield double, x int")
    issues = [r[0] for r in quality.critical_issues(quality.validation_facts(bad)).collect()]
    assert issues == ["Invalid sequences found", "High missing data percentage"]
    texts = [r.recommendation for r in quality.recommendations(
        quality.validation_facts(bad), quality.target_profile(bad, ["yield"])).collect()]
    assert "Found 2 invalid sequences. Clean before processing." in texts
    assert "High missing rate in yield (100.0%). May impact model performance." in texts


# --- features ---


def test_structure_features_and_defaults(spark):
    sequences = spark.createDataFrame(
        [(1, "GGGAAACCC"), (2, "ACGU"), (3, ""), (4, None), (5, "GC")], "seq_id long, sequence string"
    )
    structures = spark.createDataFrame(
        [(1, "(((...)))", -4.5), (3, "", 0.0), (4, "..", 0.0), (5, None, -1.0), (9, "()", 1.0)],
        "seq_id long, dot_bracket string, mfe double",
    )
    rows = {r.seq_id: r for r in features.structure_features(sequences, structures).collect()}
    assert tuple(rows[1])[1:] == (-4.5, -0.5, 1, 2, pytest.approx(6 / 9), 9, 1, 1, "ok")
    for i, why in ((2, "missing_structure"), (3, "empty_sequence"), (4, "null_sequence"), (5, "missing_structure")):
        assert tuple(rows[i])[1:] == (0.0, 0.0, 0, 0, 0.0, 0, 0, 0, why)
    assert len(rows) == 5


# --- split ---


@pytest.mark.parametrize("n, share, expected", [(3, 0.33, 1), (5, 0.4, 2), (1000, 0.2, 200), (7, 0.01, 1)])
def test_split_sizes(spark, n, share, expected):
    train, test = split(spark.range(n).withColumnRenamed("id", "seq_id"), share)
    train, test = {r[0] for r in train.collect()}, {r[0] for r in test.collect()}
    assert len(test) == expected and not train & test and train | test == set(range(n))


def test_split_is_a_function_of_key_and_seed(spark):
    df = spark.range(300).withColumnRenamed("id", "seq_id")
    first = {r[0] for r in split(df.repartition(7), seed=1)[1].collect()}
    assert first == {r[0] for r in split(df.coalesce(1), seed=1)[1].collect()}
    assert first != {r[0] for r in split(df, seed=2)[1].collect()}


def test_split_refuses(spark):
    one = spark.range(1).withColumnRenamed("id", "seq_id")
    with pytest.raises(ValueError, match="at least two"):
        split(one)
    with pytest.raises(ValueError, match="is null in 1 rows"):
        split(spark.createDataFrame([(1,), (None,)], "seq_id long"))
    copies = spark.range(100).select(F.lit(7).alias("seq_id"))
    with pytest.raises(ValueError, match="not unique"):
        split(copies)


def test_approximate_split(spark):
    train, test = split(spark.range(20_000).withColumnRenamed("id", "seq_id"), 0.2, mode="approx")
    assert train.count() + test.count() == 20_000
    assert abs(test.count() - 4000) < 300


def test_folds(spark):
    df = spark.range(3000).withColumn("fold", fold_of("id", 3))
    sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
    assert set(sizes) == {0, 1, 2} and min(sizes.values()) > 850


# --- covariates and targets ---


@pytest.fixture(scope="module")
def covered(spark):
    rows = [(i, "T7" if i % 3 else "SP6", float(37 + i % 2), i * 1.5) for i in range(30)]
    return spark.createDataFrame(rows, "seq_id long, enzyme string, temperature double, ph double")


COVARIATES = ["enzyme", "temperature", "ph"]


def test_column_types(spark, covered):
    got = {r["column"]: r["kind"] for r in covariates.column_types(covered, COVARIATES).collect()}
    assert got == {"enzyme": "categorical", "temperature": "categorical", "ph": "numeric"}
    limits = spark.range(11).select((F.col("id") % 10).alias("ten"), F.col("id").alias("eleven"))
    got = {r["column"]: r["kind"] for r in covariates.column_types(limits, limits.columns).collect()}
    assert got == {"ten": "categorical", "eleven": "numeric"}


def test_encoder(covered):
    encoder = covariates.CovariateEncoder().fit(covered, COVARIATES)
    assert encoder.feature_names == ["enzyme_T7", "temperature_38.0", "ph"]
    got = encoder.transform(covered, ["seq_id"]).toPandas().sort_values("seq_id")
    assert got["enzyme_T7"].tolist() == [float(i % 3 > 0) for i in range(30)]
    ph = np.arange(30) * 1.5
    np.testing.assert_allclose(got["ph"], (ph - ph.mean()) / ph.std())


def test_encoder_unseen_and_null(spark, covered):
    encoder = covariates.CovariateEncoder().fit(covered, COVARIATES)
    strange = spark.createDataFrame([(1, "T3", 37.0, 0.0), (2, None, 38.0, 0.0)], covered.schema)
    assert tuple(encoder.unseen_counts(strange).first()) == (2, 0)
    with pytest.raises(Exception, match="unknown category in column 'enzyme'"):
        encoder.transform(strange, ["seq_id"]).collect()
    encoder.unseen = "keep"
    assert [r["enzyme_T7"] for r in encoder.transform(strange, ["seq_id"]).collect()] == [0.0, 0.0]
    with_null = covariates.CovariateEncoder().fit(covered.union(strange), COVARIATES)
    assert with_null.feature_names[:3] == ["enzyme_T3", "enzyme_T7", "enzyme_nan"]
    row = with_null.transform(strange.where("seq_id = 2"), ["seq_id"]).first()
    assert (row["enzyme_T3"], row["enzyme_nan"]) == (0.0, 1.0)


def test_encoder_sorts_numbers_as_numbers_and_keeps_one_category(spark):
    df = spark.createDataFrame([(10, "x"), (9, "x"), (100, "x")], "n long, c string")
    encoder = covariates.CovariateEncoder().fit(df, ["n", "c"])
    assert encoder.feature_names == ["n_10", "n_100"]


def test_encoder_save_and_load(spark, covered, tmp_path):
    encoder = covariates.CovariateEncoder("keep").fit(covered, COVARIATES)
    encoder.save(spark, str(tmp_path / "e"))
    assert covariates.CovariateEncoder.load(spark, str(tmp_path / "e")) == encoder


def test_encoder_limits(spark, covered, monkeypatch):
    with pytest.raises(ValueError, match="must be fitted"):
        covariates.CovariateEncoder().transform(covered)
    monkeypatch.setattr(covariates, "MAX_CATEGORIES", 1)
    with pytest.raises(ValueError, match="more than 1 categories"):
        covariates.CovariateEncoder().fit(covered, ["enzyme"])


def test_target_scaler(spark, sample, tmp_path):
    targets = ["yield", "expression"]
    scaler = covariates.TargetScaler().fit(sample, targets)
    scaled = scaler.transform(sample)
    assert scaled.columns == targets
    y = np.array([r[1] for r in SAMPLE])
    np.testing.assert_allclose([r["yield"] for r in scaled.collect()], (y - y.mean()) / y.std())
    scaler.save(spark, str(tmp_path / "s"))
    back = covariates.TargetScaler.load(spark, str(tmp_path / "s")).inverse_transform(
        scaler.transform(sample, ["sequence"])
    )
    assert back.columns == ["sequence", *targets]
    np.testing.assert_allclose([r["yield"] for r in back.collect()], y)
    constant = sample.withColumn("yield", F.lit(2.0))
    flat = covariates.TargetScaler().fit(constant, ["yield"]).transform(constant)
    assert {r[0] for r in flat.collect()} == {0.0}
