"""Boosted trees against a plain split search, and what must not change them."""

import math
import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from strandwise.operators import boosting
from strandwise.operators.boosting import Boosting, fit_targets, tune

NAMES = ["a", "b", "c", "d"]


def data(n=70, seed=3):
    """Few distinct values, many of them missing; some targets are exactly 1."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 4)).astype(float)
    x[rng.random((n, 4)) < 0.15] = math.nan
    y = np.nan_to_num(x[:, 0]) * 0.5 - np.nan_to_num(x[:, 1], nan=4.0) + 2 * rng.normal(size=n)
    y[::9] = 1.0
    return x, y


def table(spark, x, y):
    rows = [(i, [float(v) for v in r], None if np.isnan(t) else float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "seq_id long, features array<double>, y double").repartition(3)


def plain_fit(x, y, p):
    """Predictions of exact greedy boosting, one split tried after another."""
    weight = np.where(y == 1.0, p.scale_pos_weight, 1.0)
    score = np.full(len(y), (weight * y).sum() / weight.sum())

    def best_weight(g, h):
        grid = -math.copysign(max(abs(g) - p.reg_alpha, 0), g) / (h + p.reg_lambda) if h + p.reg_lambda > 0 else 0.0
        return max(-p.max_delta_step, min(p.max_delta_step, grid)) if p.max_delta_step else grid

    def value(g, h):
        w = best_weight(g, h)
        return -2 * (g * w + 0.5 * (h + p.reg_lambda) * w * w + p.reg_alpha * abs(w))

    def grow(rows, level):
        g, h = (weight * (score - y))[rows].sum(), weight[rows].sum()
        best = (1e-9, None)
        for to_right in (False, True):
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in np.unique(x[~np.isnan(x[:, f]), f]) if level < p.depth else ():
                    right = np.where(np.isnan(v), to_right, v > cut)
                    left = rows[~right]
                    gl, hl = (weight * (score - y))[left].sum(), weight[left].sum()
                    if min(hl, h - hl) < max(p.min_rows, 1e-9):
                        continue
                    gain = value(gl, hl) + value(g - gl, h - hl) - value(g, h)
                    if gain > best[0] + 1e-7 and gain >= p.min_gain:
                        best = (gain, right)
        if best[1] is None:
            change[rows] = p.rate * best_weight(g, h)
        else:
            grow(rows[~best[1]], level + 1)
            grow(rows[best[1]], level + 1)

    for _ in range(p.trees):
        change = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        score = score + change
    return score


SMALL = Boosting(trees=4, depth=3, rate=0.5)


@pytest.mark.parametrize(
    "change",
    [{}, {"reg_lambda": 0.0}, {"reg_lambda": 25.0}, {"reg_alpha": 3.0}, {"max_delta_step": 0.7}, {"max_delta_step": 0.7, "reg_alpha": 2.0},
     {"scale_pos_weight": 4.0}, {"min_rows": 9.0}, {"min_gain": 12.0}],
)
def test_equals_plain_search(spark, change):
    x, y = data()
    params = SMALL.with_params(**change)
    model = fit_targets(table(spark, x, y), ["y"], NAMES, params)
    found = np.array([r.predicted_y for r in model.predict(table(spark, x, y)).orderBy("seq_id").collect()])
    np.testing.assert_allclose(found, plain_fit(x, y, params), atol=1e-9)
    if change:
        assert np.abs(found - plain_fit(x, y, SMALL)).max() > 1e-3


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    x[rng.random(x.shape) < 0.1] = math.nan
    df = table(spark, x, np.nan_to_num(x[:, 0]) ** 2 + rng.normal(size=3000))
    params = Boosting(trees=6, feature_share=0.5)
    nodes = [fit_targets(df.repartition(n), ["y"], NAMES, params).nodes for n in (1, 7)]
    assert nodes[0] == nodes[1] and len(nodes[0]) > 100
    assert fit_targets(df, ["y"], NAMES, params.with_params(seed=1)).nodes != nodes[0]


def test_sums_stay_with_the_tasks(spark, monkeypatch):
    """The driver gets splits: 8 numbers per node and slice of the features, and no sums."""
    got, collect = [], RDD.collect

    def counted(rdd):
        rows = collect(rdd)
        got.append(len(pickle.dumps(rows)))
        return rows

    monkeypatch.setattr(RDD, "collect", counted)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 40))
    rows = [([float(v) for v in r], float(r[0] * r[1] + r[2]), float(r[3] - r[4])) for r in x]
    df = spark.createDataFrame(rows, "features array<double>, y double, z double")
    params = Boosting(trees=2, depth=5)
    model = fit_targets(df, ["y", "z"], [f"f{i}" for i in range(40)], params)
    slices, nodes = spark.sparkContext.defaultParallelism, 2**params.depth
    assert len(model.nodes) > 150 and max(got) < 2 * slices * (nodes * 8 * 9 + 1000)


def test_missing_learn_a_side_and_unseen_missing_have_one(spark):
    x = np.array([[1.0, 0, 0, 0], [2.0, 0, 0, 0], [math.nan, 0, 0, 0]] * 20)
    for values in ([0.0, 9.0, 9.0], [9.0, 0.0, 9.0]):
        y = np.array(values * 20)
        model = fit_targets(table(spark, x, y), ["y"], NAMES, Boosting(trees=20, rate=0.5, reg_lambda=0.0))
        found = model.predict(table(spark, x[:3], y[:3])).orderBy("seq_id").collect()
        np.testing.assert_allclose([r.predicted_y for r in found], values, atol=1e-3)
    whole = fit_targets(table(spark, x[:2].repeat(20, axis=0), y[:2].repeat(20)), ["y"], NAMES, Boosting(trees=2))
    assert all(r.predicted_y is not None for r in whole.predict(table(spark, x[:3], y[:3])).collect())


def test_odd_tables(spark):
    x, y = data(20)
    none = fit_targets(table(spark, x, np.full(20, math.nan)), ["y"], NAMES, SMALL)
    assert {r.predicted_y for r in none.predict(table(spark, x, y)).collect()} == {0.0}
    same = fit_targets(table(spark, x, np.full(20, 7.25)), ["y"], NAMES, SMALL)
    assert {r.predicted_y for r in same.predict(table(spark, x, y)).collect()} == {7.25}
    assert {r.importance for r in same.importance(spark).collect()} == {0.0}
    blank = fit_targets(table(spark, np.full((20, 4), math.nan), y), ["y"], NAMES, SMALL)
    assert all(r.predicted_y == pytest.approx(y.mean()) for r in blank.predict(table(spark, x, y)).collect())


def test_curve_equals_truncated_models(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 4))
    df = table(spark, x, x[:, 0] + rng.normal(size=400)).withColumn("held", F.col("seq_id") % 4 == 0)
    params = Boosting(trees=60, depth=4, rate=0.4, validation="held", validation_tolerance=0.0, patience=5)
    model = fit_targets(df, ["y"], NAMES, params)
    curve = [r.validation_mse for r in model.curve(spark).orderBy("round").collect()]
    kept = model.models["y"].getNumTrees
    assert kept == int(np.argmin(curve)) and len(curve) == kept + 6 < 60
    for rounds in (0, 1, kept):
        scored = model.truncated(rounds).predict(df.where("held"))
        assert scored.agg(F.avg(F.pow(F.col("y") - F.col("predicted_y"), 2))).first()[0] == pytest.approx(curve[rounds])
    # Held rows teach nothing.
    other = df.withColumn("y", F.when(F.col("held"), F.lit(1e6)).otherwise(F.col("y")))
    again = fit_targets(other, ["y"], NAMES, params)
    rounds = min(again.models["y"].getNumTrees, kept)
    assert [n for n in again.nodes if n[1] < rounds] == [n for n in model.nodes if n[1] < rounds] and rounds > 0


def test_race_and_whole_grid(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    df = table(spark, x, x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600))
    grid = {"n_estimators": [4, 8, 16], "learning_rate": [0.05, 0.5], "max_depth": [1, 4]}
    best, settings = tune(df, "y", grid, Boosting())
    rows = {(r.settings["n_estimators"], r.settings["learning_rate"], r.settings["max_depth"]): r for r in settings.collect()}
    assert len(rows) == 12 and all(r.rounds == key[0] for key, r in rows.items())
    top = min(rows.values(), key=lambda r: r.mse)
    assert (best.trees, best.rate, best.depth) == (top.settings["n_estimators"], top.settings["learning_rate"], top.settings["max_depth"])
    raced, kept = tune(df, "y", grid, Boosting(), keep=0.5, first_rounds=4)
    assert kept.where("rounds < settings['n_estimators']").count() > 0
    own = rows[(float(raced.trees), raced.rate, float(raced.depth))]
    assert own.mse <= 1.1 * top.mse


def test_sums_are_exact(spark):
    step = boosting._step(10**11, 1e3)
    g = np.rint(np.random.default_rng(1).normal(size=1000) * 300 * step) / step
    assert sum(g.tolist()) == sum(sorted(g.tolist())) == g.sum()


def test_bins_out_of_range(spark):
    with pytest.raises(ValueError, match="bins must be"):
        fit_targets(table(spark, *data()), ["y"], NAMES, Boosting(bins=256))
