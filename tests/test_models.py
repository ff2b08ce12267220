"""Embedding hook, PCA, boosted models, the fitted estimator and the jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.model_queries import composition_embedder
from strandwise.operators import embedding
from strandwise.operators.boosting import Boosting, cross_validate, fit_targets, tune
from strandwise.operators.reduce import EmbeddingReducer
from strandwise.plans import jobs
from strandwise.plans.estimator import PropertyModel, SequenceFeaturizer, Sources
from strandwise.sources import tables

TARGETS = ["yield", "dsRNA_percent", "expression"]
SMALL = Boosting(trees=4, depth=3, rate=0.3)


# --- embeddings ---


def test_registry(spark):
    assert embedding.model_config("evo")["sequence_type"] == "rna"
    assert set(embedding.available_models()) == {m[0] for m in embedding.MODELS}
    with pytest.raises(ValueError, match="Unknown model key 'nope'"):
        embedding.model_config("nope")
    df = spark.createDataFrame([(1, "ACGU", "dnabert2"), (2, "ACGT", "evo"), (3, "ACGU", "nope")],
                               "seq_id long, sequence string, model string")
    rows = embedding.model_input_per_row(df).orderBy("seq_id").collect()
    assert [r.model_sequence for r in rows] == ["ACGT", "ACGU", None]
    assert embedding.model_input(df, "dnabert2").first().model_sequence == "ACGT"


def test_embed_hook_reports_failures(spark):
    def failing_embedder():
        def embed(batch):
            if any("X" in s for s in batch):
                raise RuntimeError("no X")
            return np.full((len(batch), 3), len(batch), dtype=np.float32)

        return embed

    rows = [(i, "X" if i == 5 else "ACGU") for i in range(10)] + [(10, None)]
    df = spark.createDataFrame(rows, "seq_id long, model_sequence string").coalesce(1)
    got = {r.seq_id: r for r in embedding.embed_sequences(df, failing_embedder, batch_size=4).collect()}
    assert got[0].embed_status == "ok" and got[0].embedding == [4.0, 4.0, 4.0]
    assert {i for i, r in got.items() if r.embed_status.startswith("failed: RuntimeError")} == {4, 5, 6, 7}
    assert got[5].embedding is None and got[10].embed_status == "null_sequence"
    assert got[9].embedding == [2.0, 2.0, 2.0]


def test_mean_pool_skips_padding(spark):
    rows = [(1, [1.0, 2.0], True), (1, [3.0, 4.0], True), (1, [99.0, 99.0], False), (2, [5.0, 6.0], True)]
    df = spark.createDataFrame(rows, "seq_id long, embedding array<float>, real boolean")
    got = {r.seq_id: (r.embedding, r.n_tokens) for r in embedding.mean_pool(df, ["seq_id"], real="real").collect()}
    assert got == {1: ([2.0, 3.0], 2), 2: ([5.0, 6.0], 1)}


def test_embeddings_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, -1.25]), (2, None)], "seq_id long, embedding array<float>")
    back = tables.read_embeddings(spark, tables.write_embeddings(df, str(tmp_path / "e")))
    assert back.schema["embedding"].dataType == df.schema["embedding"].dataType
    assert sorted(back.collect()) == sorted(df.collect())


# --- PCA ---


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(1)
    return rng.normal(size=(50, 12)) @ rng.normal(size=(12, 12)) + rng.normal(size=12) * 5


def vectors(spark, matrix):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "seq_id long, embedding array<double>").repartition(4)


def test_pca_against_numpy(spark, matrix, tmp_path):
    df = vectors(spark, matrix)
    reducer = EmbeddingReducer(5).fit(df)
    z = (matrix - matrix.mean(axis=0)) / matrix.std(axis=0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    ratios = s**2 / (s**2).sum()
    np.testing.assert_allclose(reducer.explained_variance_ratio, ratios[:5], rtol=1e-9)
    assert reducer.feature_names == ["PC1", "PC2", "PC3", "PC4", "PC5"]
    got = reducer.expand(reducer.transform(df)).toPandas().sort_values("seq_id")
    np.testing.assert_allclose(np.abs(got[reducer.feature_names]), np.abs(z @ vt[:5].T), atol=1e-9)
    components = reducer.model.stages[1].pc.toArray()
    np.testing.assert_allclose(components.T @ components, np.eye(5), atol=1e-9)
    reducer.save(str(tmp_path / "r"))
    again = EmbeddingReducer.load(str(tmp_path / "r"))
    loaded = again.expand(again.transform(df)).toPandas().sort_values("seq_id")
    pd.testing.assert_frame_equal(got.reset_index(drop=True), loaded.reset_index(drop=True))
    stats = reducer.statistics(spark).first()
    assert (stats.n_rows, stats.raw_dimension, stats.n_components) == (50, 12, 5)
    assert stats.total_explained_variance == pytest.approx(ratios[:5].sum())


def test_pca_clamp_and_guards(spark, matrix):
    few = vectors(spark, matrix[:5])
    assert EmbeddingReducer(50).fit(few).n_components == 5
    with pytest.raises(ValueError, match="Must fit"):
        EmbeddingReducer(2).transform(few)
    with pytest.raises(ValueError, match="Unknown method"):
        EmbeddingReducer(2, "tsne")
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "seq_id long, embedding array<double>")
    with pytest.raises(ValueError, match="one length"):
        EmbeddingReducer(1).fit(ragged)


def test_pca_leaves_out_missing_embeddings(spark, matrix):
    df = vectors(spark, matrix)
    gap = df.union(spark.createDataFrame([(99, None)], df.schema))
    reducer = EmbeddingReducer(3).fit(gap)
    assert reducer.input_shape == (50, 12) and reducer.transform(gap).count() == 50


# --- boosted models ---


@pytest.fixture(scope="module")
def feature_rows(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 6))
    rows = [
        (i, [float(v) for v in r], float(3 * r[0] + r[1]), float(r[2] ** 2), None if i % 4 == 0 else float(r[3]))
        for i, r in enumerate(x)
    ]
    df = spark.createDataFrame(rows, "seq_id long, x array<double>, yield double, dsRNA_percent double, expression double")
    return df.select("seq_id", array_to_vector("x").alias("features"), *TARGETS).cache()


NAMES = [f"f{i}" for i in range(6)]


def test_fit_predict_evaluate(spark, feature_rows):
    model = fit_targets(feature_rows, TARGETS, NAMES, SMALL)
    predicted = model.predict(feature_rows)
    assert [c for c in predicted.columns if c.startswith("predicted_")] == [f"predicted_{t}" for t in TARGETS]
    assert predicted.count() == 200
    evaluated = {r.target: r for r in model.evaluate(feature_rows).collect()}
    assert set(evaluated) == set(TARGETS) and evaluated["yield"].r2 > 0.6
    assert model.score(feature_rows) == pytest.approx(np.mean([r.r2 for r in evaluated.values()]))
    table = model.importance(spark).toPandas()
    assert len(table) == 18 and (table["importance"] >= 0).all()
    np.testing.assert_allclose(table.groupby("target")["importance"].sum(), 1.0)
    best = table[table["target"] == "yield"].set_index("feature")["importance"].idxmax()
    assert best == "f0"


def test_parameters():
    got = Boosting.from_config({"n_estimators": 10, "learning_rate": 0.2, "max_depth": 4, "subsample": 0.8,
                                "colsample_bytree": 0.5, "min_child_weight": 3, "random_state": 7, "reg_alpha": 0.0})
    assert (got.trees, got.rate, got.depth, got.row_share, got.feature_share, got.min_rows, got.seed) == (
        10, 0.2, 4, 0.8, 0.5, 3, 7)
    whole = Boosting.from_config({"reg_alpha": 0.5, "reg_lambda": 2, "max_delta_step": 3, "scale_pos_weight": 4, "gamma": 5,
                                  "early_stopping_rounds": 6, "n_jobs": -1, "verbosity": 0})
    assert (whole.reg_alpha, whole.reg_lambda, whole.max_delta_step, whole.scale_pos_weight, whole.min_gain, whole.patience,
            whole.validation_tolerance) == (0.5, 2, 3, 4, 5, 6, 0.0)
    assert (Boosting().trees, Boosting().rate, Boosting().depth) == (100, 0.1, 6)
    with pytest.raises(ValueError, match="unknown boosting parameters"):
        Boosting.from_config({"boosters": 1})


def test_early_stopping(feature_rows):
    marked = feature_rows.withColumn("held", F.col("seq_id") % 5 == 0)
    params = Boosting(trees=30, depth=2, rate=1.0, validation="held", validation_tolerance=0.05)
    model = fit_targets(marked, ["yield"], NAMES, params)
    assert model.models["yield"].getNumTrees < 30


def test_cross_validation(spark, feature_rows):
    rows = cross_validate(feature_rows, ["yield"], NAMES, SMALL, folds=3).collect()
    scores = [r.score for r in rows]
    assert [r.fold for r in rows] == [0, 1, 2]
    assert (rows[0].mean, rows[0].std) == pytest.approx((np.mean(scores), np.std(scores)))


def test_tuning(spark, feature_rows):
    best, settings = tune(feature_rows, "yield", {"max_depth": [1, 3]}, Boosting(trees=3, rate=0.5), folds=2)
    table = {r.settings["max_depth"]: r.mse for r in settings.collect()}
    assert len(table) == 2 and best.depth == min(table, key=table.get)


# --- estimator and jobs ---


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        s = "".join(rng.choice(list("ACGU"), size=int(rng.integers(30, 90))))
        gc = (s.count("G") + s.count("C")) / len(s)
        rows.append((i, s, gc + 0.01 * i % 3, 10 * gc, 2 - gc, ["T7", "SP6", "T3"][i % 3], 37.0 + i % 2 * 5, i * 0.1))
    df = spark.createDataFrame(
        rows, "seq_id long, sequence string, yield double, dsRNA_percent double, expression double, "
        "enzyme_type string, temperature double, buffer_ph double",
    )
    root = tmp_path_factory.mktemp("study")
    path = tables.write_table(df, str(root / "input"))
    df = spark.read.parquet(path)
    folded = df.where("seq_id % 10 <> 3").select(
        "seq_id", F.translate("sequence", "GCAU", "()..").alias("dot_bracket"), (-F.length("sequence") / 3.0).alias("mfe")
    )
    embedded = embedding.embed_sequences(embedding.model_input(df, "dnabert2"), composition_embedder)
    sources = Sources(
        spark.read.parquet(tables.write_table(folded, str(root / "structures"))),
        spark.read.parquet(tables.write_table(embedded.where("seq_id % 20 <> 7"), str(root / "embeddings"))),
    )
    return root, path, df, sources


def test_featurizer_guards(spark, study):
    _, _, df, sources = study
    with pytest.raises(ValueError, match="Sequence column 'sequence' not found"):
        SequenceFeaturizer().fit(df.drop("sequence"), sources)
    with pytest.raises(ValueError, match="must be fitted"):
        SequenceFeaturizer().transform(df, sources)
    rows = SequenceFeaturizer(3).fit(df, sources).transform(df, sources)
    got = {r.seq_id: r for r in rows.collect()}
    assert len(got) == 120 and {len(r["values"]) for r in got.values()} == {11}
    assert got[3].fold_status == "missing_structure" and got[3]["values"][3:] == [0.0] * 8
    assert got[7].embed_status == "missing_embedding" and got[7]["values"][:3] == [0.0] * 3


def test_estimator(spark, study, tmp_path):
    _, _, df, sources = study
    with pytest.raises(ValueError, match="must be fitted"):
        PropertyModel().predict(df, sources)
    with pytest.raises(ValueError, match="Cannot save unfitted"):
        PropertyModel().save(spark, str(tmp_path / "m"))
    model = PropertyModel(3, SMALL).fit(df, sources)
    assert model.targets == TARGETS and model.covariates == ["enzyme_type", "temperature", "buffer_ph"]
    assert model.feature_names[:4] == ["PC1", "PC2", "PC3", "mfe"]
    assert model.feature_names[-4:] == ["enzyme_type_T3", "enzyme_type_T7", "temperature_42.0", "buffer_ph"]
    predicted = model.predict(df, sources)
    assert predicted.columns == [*df.columns, *[f"predicted_{t}" for t in TARGETS], "sequence_length", "gc_content"]
    assert predicted.count() == 120
    narrow = model.predict(df, sources, include_features=False)
    assert narrow.columns == ["seq_id", *[f"predicted_{t}" for t in TARGETS], "sequence_length", "gc_content"]
    assert model.score(df, sources) == pytest.approx(
        np.mean([r.r2 for r in model.evaluate(df, sources).collect()])
    )
    model.save(spark, str(tmp_path / "m"))
    loaded = PropertyModel.load(spark, str(tmp_path / "m"))
    assert loaded.feature_names == model.feature_names and loaded.targets == TARGETS
    a, b = (m.predict(df, sources).toPandas().sort_values("seq_id", ignore_index=True) for m in (model, loaded))
    pd.testing.assert_frame_equal(a, b)


def test_missing_covariates(spark, study):
    _, _, df, sources = study
    holes = df.withColumn("buffer_ph", F.when(F.col("seq_id") % 3 > 0, F.col("buffer_ph")))
    model = PropertyModel(3, SMALL).fit(holes, sources)
    assert model.predict(holes, sources).where("predicted_yield is null").count() == 0


def test_fit_uses_only_its_own_rows(spark, study):
    """Embeddings and categories of other rows must not leak into the fit."""
    _, _, df, sources = study
    train = df.where("seq_id < 60 and enzyme_type <> 'T3'")
    model = PropertyModel(3, SMALL).fit(train, sources)
    assert "enzyme_type_T7" in model.feature_names and "enzyme_type_T3" not in model.feature_names
    with_vectors = train.join(sources.embeddings, "seq_id").where("embedding is not null").count()
    assert model.featurizer.reducer.input_shape[0] == with_vectors
    with pytest.raises(Exception, match="unknown category"):
        model.predict(df, sources).collect()


def test_jobs(spark, study, tmp_path):
    _, path, df, sources = study
    out = str(tmp_path / "full")
    done = jobs.full_job(spark, path, out, sources, n_components=3, params=SMALL)
    assert done["test_results"].count() == 24
    for name in ("report/evaluation", "report/importance_pairs", "validation/target_profile", "test_metrics", "model/meta"):
        spark.read.parquet(f"{out}/{name}")
    evaluated = {r.target: r for r in done["evaluation"].collect()}
    assert set(evaluated) == set(TARGETS) and evaluated["yield"].n == 24

    predicted = jobs.predict_job(spark, f"{out}/model", path, str(tmp_path / "p"), sources, csv=True)
    assert predicted["predictions"].count() == 120
    report = spark.read.parquet(str(tmp_path / "p/sequence_analysis"))
    assert report.where("top_performer").count() >= 10
    assert spark.read.option("header", True).csv(str(tmp_path / "p/predictions_csv")).count() == 120

    again = jobs.evaluate_job(spark, f"{out}/model", path, str(tmp_path / "e"), sources)
    assert again["evaluation"].count() == 3
    assert spark.read.json(str(tmp_path / "e/evaluation_json")).count() == 3


def test_embed_job(spark, study, tmp_path):
    _, path, _, _ = study
    out = str(tmp_path / "emb")
    done = jobs.embed_job(spark, path, out, composition_embedder, n_components=2)
    table = spark.read.parquet(f"{out}/embeddings")
    assert table.count() == 120 and {"PC1", "PC2", "sequence"} <= set(table.columns)
    assert done["embedding_statistics"].first().n_components == 2
    with pytest.raises(ValueError, match="Unknown model key"):
        jobs.embed_job(spark, path, out, composition_embedder, model="nope")


def test_jobs_number_rows_without_a_key(spark, study, tmp_path):
    _, _, df, _ = study
    path = tables.write_csv(df.drop("seq_id"), str(tmp_path / "nokey.csv"))
    out = str(tmp_path / "emb")
    done = jobs.embed_job(spark, path, out, composition_embedder, n_components=2)
    assert done["embeddings"].where("PC1 is null").count() == 0
    assert spark.read.parquet(f"{out}/input").select("seq_id").distinct().count() == 120


def test_validation_job_and_gate(spark, study, tmp_path):
    _, path, df, sources = study
    bad = df.withColumn("sequence", F.when(F.col("seq_id") > 2, F.col("sequence")).otherwise("AXG"))
    dirty = tables.write_table(bad, str(tmp_path / "dirty"))
    sections = jobs.validate_job(spark, dirty, str(tmp_path / "v"))
    assert [r.issue for r in sections["critical_issues"].collect()] == ["Invalid sequences found"]
    assert sections["invalid_sequences"].count() == 3
    assert spark.read.parquet(str(tmp_path / "v/recommendations")).count() == 2
    with pytest.raises(jobs.CriticalIssues, match="Invalid sequences found"):
        jobs.train_job(spark, dirty, str(tmp_path / "t"), sources, validate=True)
    assert jobs.validate_job(spark, path)["critical_issues"].count() == 0
