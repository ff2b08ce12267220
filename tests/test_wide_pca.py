"""PCA without a square matrix against numpy."""

import numpy as np
import pytest

from strandwise.operators import reduce
from strandwise.operators.reduce import EmbeddingReducer
from strandwise.operators.wide_pca import WidePCA
from strandwise.session import arrow_rows


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(2)
    directions = rng.normal(size=(40, 300)) * np.linspace(6, 0.5, 40)[:, None]
    x = rng.normal(size=(700, 40)) @ directions + 0.4 * rng.normal(size=(700, 300)) + 50
    x[:, 7] = 3.0  # a constant dimension
    return x


def table(spark, matrix, parts=6):
    rows = [(i, r.tolist()) for i, r in enumerate(matrix)] + [(9999, None)]
    return spark.createDataFrame(rows, "seq_id long, embedding array<double>").repartition(parts)


def exact(matrix):
    sd = matrix.std(axis=0, ddof=1)
    z = np.divide(matrix - matrix.mean(axis=0), sd, out=np.zeros_like(matrix), where=sd > 1e-9)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    return z, s**2 / (s**2).sum(), vt


def test_ratios_and_components(spark, matrix):
    z, ratios, vt = exact(matrix)
    fitted = WidePCA.fit(table(spark, matrix).where("embedding IS NOT NULL"), 10)
    np.testing.assert_allclose(fitted.ratios, ratios[:10], atol=1e-3 * ratios[0])
    np.testing.assert_allclose(fitted.components @ fitted.components.T, np.eye(10), atol=1e-9)
    np.testing.assert_allclose(np.abs((fitted.components[:5] * vt[:5]).sum(axis=1)), 1.0, atol=1e-3)
    again = WidePCA.fit(table(spark, matrix, 2).where("embedding IS NOT NULL"), 10)
    np.testing.assert_allclose(again.components, fitted.components, atol=1e-6)


def test_reducer_takes_any_dimension(spark, matrix, monkeypatch, tmp_path):
    monkeypatch.setattr(reduce, "MAX_DIMENSION", 100)
    df = table(spark, matrix)
    reducer = EmbeddingReducer(8).fit(df)
    assert reducer.wide is not None and reducer.input_shape == (700, 300)
    z, ratios, _ = exact(matrix)
    got = {r.seq_id: r.reduced for r in reducer.transform(df).collect()}
    assert len(got) == 700
    np.testing.assert_allclose([got[i] for i in range(700)], z @ reducer.wide.components.T, atol=1e-8)
    reducer.save(str(tmp_path / "r"))
    loaded = EmbeddingReducer.load(str(tmp_path / "r"))
    assert {r.seq_id: r.reduced for r in loaded.transform(df).collect()} == got
    row = loaded.statistics(spark).first()
    assert (row.n_rows, row.raw_dimension, row.n_components) == (700, 300, 8)
    assert row.total_explained_variance == pytest.approx(ratios[:8].sum(), abs=1e-3)
    assert len(reducer.expand(reducer.transform(df)).columns) == 9


def test_fewer_rows_than_components(spark, matrix, monkeypatch):
    monkeypatch.setattr(reduce, "MAX_DIMENSION", 100)
    reducer = EmbeddingReducer(50).fit(table(spark, matrix[:5]))
    assert reducer.n_components == 5 and len(reducer.wide.components) == 5
    assert sum(reducer.explained_variance_ratio) == pytest.approx(1.0)


def test_wide_rows_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError), arrow_rows(spark, 8 * 1_000_000):
        assert spark.conf.get(name) == "4"
        raise RuntimeError
    with arrow_rows(spark, 10**12):
        assert spark.conf.get(name) == "1"
    assert spark.conf.get(name) == before
