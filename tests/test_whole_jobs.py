"""Registered queries run whole jobs: all rows, targets and components, default trees."""

from checks import data_queries, model_queries
from strandwise.operators.boosting import Boosting

SMALL = "/root/testdata/sf0.001"


def test_stacked_batches_keep_null_labels(spark, tmp_path):
    rows = [(1, 3, [0.5]), (2, 7, [1.5]), (3, None, [2.5])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = data_queries.stack_batches(spark, str(tmp_path)).collect()
    assert sorted((r.vec_id, r.label, r["first"]) for r in found) == [(1, 3, 0.5), (2, 7, 1.5), (3, None, 2.5)]


def test_models_have_all_components_and_default_trees(spark):
    rows, model = model_queries._features(spark, SMALL)
    assert model.featurizer.n_components == 64 and model.params == Boosting()


def test_cross_validation_has_all_targets(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "cross_validate", lambda rows, targets, names, *params, **more: (targets, params, more))
    assert model_queries.cross_validation(spark, SMALL) == (model_queries.MODEL_TARGETS, (), {})
