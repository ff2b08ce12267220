"""Quantile sketches: exact counts, ranks within the bound, merging, states on disk."""

import math

import numpy as np
import pytest

from strandwise.operators import sketches

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 40_000
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.35, 4.0, rng.exponential(size=n))  # a third of the rows share a value
    rows = [(None if i % 3 == 2 else f"p{i % 3}", float(a[i]), None if i % 10 == 0 else float(b[i]), math.nan) for i in range(n)]
    return spark.createDataFrame(rows, "day string, a double, b double, c double").repartition(7).cache()


def test_counts_are_exact_and_ranks_within_the_bound(spark, table):
    for k in (200, 1600):
        found = sketches.sketch_profile(sketches.sketch_states(table, COLUMNS, "day", k))
        rows = {r.column: r for r in found.collect()}
        assert (rows["b"].n_rows, rows["b"].n, rows["b"].missing_count) == (40_000, 36_000, 4_000)
        values = np.sort(np.array([r.a for r in table.select("a").collect()]))
        assert (rows["a"].least, rows["a"].most) == (values[0], values[-1])
        gaps = {r.column: r.gap for r in sketches.rank_gaps(table, COLUMNS, found).collect()}
        assert set(gaps) == {"a", "b"} and all(g <= 2 * sketches.rank_error(k) for g in gaps.values())
        outside = ((values < rows["a"].lower_bound) | (values > rows["a"].upper_bound)).mean()
        assert rows["a"].outlier_share == pytest.approx(outside, abs=2 * sketches.rank_error(k) + 0.001)
        assert rows["a"].min_outlier == values[0] and rows["b"].min_outlier is None
        assert (rows["c"].n, rows["c"].median, rows["c"].outlier_share) == (0, None, None)


def test_parts_are_added_and_chosen_without_their_rows(spark, table, tmp_path):
    path = str(tmp_path / "states")
    sketches.add_states(table.where("day = 'p0'"), COLUMNS, path, "day")
    sketches.add_states(table.where("day = 'p1' OR day IS NULL"), COLUMNS, path, "day")
    states = sketches.read_states(spark, path)
    assert states.count() == 9
    whole = sketches.sketch_profile(states)
    assert {r.column: r.n_rows for r in whole.collect()} == dict.fromkeys(COLUMNS, 40_000)
    assert all(r.gap <= 2 * sketches.rank_error(sketches.SIZE) for r in sketches.rank_gaps(table, COLUMNS, whole).collect())
    some = table.where("day = 'p1'")
    own = sketches.sketch_profile(states.where("part = 'p1'"))
    assert all(r.gap <= 2 * sketches.rank_error(sketches.SIZE) for r in sketches.rank_gaps(some, COLUMNS, own).collect())
    each = sketches.sketch_profile(states, ["part", "column"]).collect()
    assert sorted((r.part or "", r.column) for r in each) == sorted((p, c) for p in ("", "p0", "p1") for c in COLUMNS)


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "a double")
    row = sketches.sketch_profile(sketches.sketch_states(df, ["a"])).first()
    assert (row.q1, row.median, row.q3, row.min_outlier, row.outlier_share) == (25.0, 50.0, 75.0, None, 0.0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double")
    assert sketches.sketch_profile(sketches.sketch_states(df, ["a"])).count() == 0
