"""Ranks, quantiles and salted joins against numpy and pandas, with hot values and gaps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwise.operators import evaluation, joins, order_stats
from strandwise.operators.order_stats import ValueBlocks, attach_ranks, exact_quantiles, with_rank


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(5)
    n = 3000
    value = np.round(rng.normal(0, 10, n), 1)
    value[rng.random(n) < 0.35] = 4.2  # a third of all rows share one value
    value[rng.random(n) < 0.05] = np.nan
    key = np.where(rng.random(n) < 0.7, "big", np.where(rng.random(n) < 0.5, "small", None))
    return pd.DataFrame({"id": np.arange(n), "k": key, "v": value})


def as_spark(spark, table):
    rows = [(int(i), k, None if np.isnan(v) and i % 2 else float(v)) for i, k, v in table.itertuples(index=False)]
    return spark.createDataFrame(rows, "id long, k string, v double").repartition(8)


PROBABILITIES = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p90": 0.9, "hi": 1.0}


def check_quantiles(got, table):
    got = {r["k"]: r for r in got.collect()}
    for key, part in table.groupby("k", dropna=False):
        key = None if pd.isna(key) else key
        for name, q in PROBABILITIES.items():
            assert got[key][name] == pytest.approx(part["v"].quantile(q)), (key, name)


@pytest.mark.parametrize("blocks", [1, 7])
def test_quantiles_by_blocks(spark, table, blocks):
    check_quantiles(ValueBlocks(as_spark(spark, table), "v", ["k"], blocks=blocks).quantiles(PROBABILITIES), table)


def test_quantiles(spark, table):
    check_quantiles(exact_quantiles(as_spark(spark, table), "v", PROBABILITIES, ["k"]), table)


def test_quantiles_without_keys(spark, table):
    got = exact_quantiles(as_spark(spark, table), "v", {"m": 0.5}).collect()
    assert len(got) == 1 and got[0]["m"] == table["v"].median()


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert exact_quantiles(empty, "v", {"m": 0.5}, ["k"]).collect() == []


@pytest.mark.parametrize("method", ["min", "average"])
@pytest.mark.parametrize("descending", [False, True])
def test_ranks_with_a_hot_value(spark, table, method, descending):
    df = as_spark(spark, table)
    assert ValueBlocks(df, "v", ["k"], descending).hot_ties() is not None
    got = with_rank(df, "v", "rank", ["k"], method, descending).toPandas().sort_values("id")
    expected = table.groupby("k", dropna=False)["v"].rank(ascending=not descending, method=method)
    assert len(got) == len(table)
    np.testing.assert_array_equal(got["rank"].astype(float).to_numpy(), expected.to_numpy())


def test_weighted_ranks(spark, table):
    counted = as_spark(spark, table).groupBy("k", "v").agg(F.count("*").alias("w"))
    got = with_rank(counted, "v", "rank", ["k"], weight="w").where("rank is not null").toPandas()
    ranks = table.groupby("k", dropna=False)["v"].rank(method="min")
    expected = {(k if isinstance(k, str) else None, v): r for k, v, r in zip(table["k"], table["v"], ranks)}
    for r in got.itertuples():
        assert expected[r.k, r.v] == r.rank


def test_ranks_without_a_hot_value(spark):
    df = spark.range(500).withColumn("v", (F.col("id") * 37 % 501).cast("double"))
    blocks = ValueBlocks(df, "v")
    assert blocks.hot_ties() is None
    got = attach_ranks(df, blocks, "rank").toPandas()
    np.testing.assert_array_equal(got["rank"], got["v"].rank(method="min"))


def test_ranks_do_not_depend_on_partitions(spark, table):
    df = as_spark(spark, table)
    one = ValueBlocks(df.coalesce(1), "v", blocks=3).ranks().toPandas()
    two = ValueBlocks(df.repartition(13), "v", blocks=11).ranks().toPandas()
    pd.testing.assert_frame_equal(
        one.sort_values("v", ignore_index=True), two.sort_values("v", ignore_index=True)
    )


def test_weights_stand_for_rows(spark, table):
    df = as_spark(spark, table)
    counted = df.groupBy("k", "v").agg(F.count("*").alias("w"))
    a = ValueBlocks(df, "v", ["k"]).ranks().toPandas()
    b = ValueBlocks(counted, "v", ["k"], weight="w").ranks().toPandas()
    order = ["k", "v"]
    pd.testing.assert_frame_equal(
        a.sort_values(order, ignore_index=True), b.sort_values(order, ignore_index=True)
    )


def test_hot_rows_and_missing_rows_are_spread(spark):
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, 1.0).when(F.col("id") % 4 == 1, F.col("id").cast("double")).alias("v")
    )
    lookup = df.where("v is not null").groupBy("v").agg(F.count("*").alias("ties")).withColumn("out", F.col("v") * 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.lookup_join(df, lookup, ["v"], 8, lookup.where("ties > 100"), 100)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
        rows = joined.toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes.max() < 1200  # unsalted, one partition would hold 2,000 rows
    assert len(rows) == 4000
    np.testing.assert_array_equal(rows["out"], rows["v"] * 2)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_join_small_is_broadcast_by_its_bytes(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    df = spark.range(100).withColumn("k", F.when(F.col("id") % 7 > 0, F.col("id") % 7))
    facts = df.groupBy("k").agg(F.count("*").alias("n"))
    try:
        joined = joins.join_small(df, facts, ["k"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (limit != "-1")
        got = joined.toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 100
    assert (got.groupby("k", dropna=False)["n"].first() == got.groupby("k", dropna=False).size()).all()


def test_one_block_and_many_agree(spark, table, monkeypatch):
    df = as_spark(spark, table)

    def results():
        blocks = ValueBlocks(df, "v", ["k"])
        ranks = attach_ranks(df, blocks, "rank", "average").toPandas().sort_values("id", ignore_index=True)
        return blocks, ranks, sorted(map(str, blocks.quantiles(PROBABILITIES).collect()))

    one, ranks, quantiles = results()
    assert one.single
    monkeypatch.setattr(order_stats, "ONE_BLOCK", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        many, other_ranks, other_quantiles = results()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not many.single
    pd.testing.assert_frame_equal(ranks, other_ranks)
    assert quantiles == other_quantiles


@pytest.mark.parametrize("limit", ["1", "10MB"])
def test_spearman_in_place_and_by_index_agree(spark, table, monkeypatch, limit):
    rng = np.random.default_rng(2)
    rows = [(str(k), float(v), float(np.round(v + rng.normal(0, 5)))) for k, v in zip(table["k"], table["v"]) if not np.isnan(v)]
    pairs = spark.createDataFrame(rows, "target string, y_true double, y_pred double").repartition(5)
    read = lambda: {r.target: r.spearman_r for r in evaluation.spearman(pairs).collect()}
    expected = pd.DataFrame(rows, columns=["k", "a", "b"]).groupby("k")[["a", "b"]].apply(lambda g: g["a"].rank().corr(g["b"].rank()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        first = read()
        monkeypatch.setattr(order_stats, "ONE_BLOCK", 0)
        second = read()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for k, r in expected.items():
        assert first[k] == pytest.approx(r) and second[k] == pytest.approx(r)
