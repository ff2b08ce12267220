"""Column expressions against literal answers and independent counters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandwise.functions import labels
from strandwise.functions import sequence as sq
from strandwise.functions import structure as st
from strandwise.functions.stats import correlation_p_value


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_gc_content(spark):
    got = values(spark, ["ACGU", "AAUU", "GGCC", "", None], sq.gc_content("s"))
    assert got == [(0.5,), (0.0,), (1.0,), (0.0,), (None,)]


def test_classification(spark):
    texts = ["ACGU", "acgu", "ACGTX", "", None, "ACGU\n", "A G"]
    got = values(spark, texts, sq.is_strict("s"), sq.classify("s"))
    assert [g[0] for g in got] == [True, False, False, False, False, False, False]
    assert [g[1] for g in got] == [
        "valid", "valid", "invalid_chars: {'T', 'X'}", "empty_sequence", "null_sequence",
        "invalid_chars: {'\n'}", "invalid_chars: {' '}",
    ]


def test_known_structures(spark):
    got = values(
        spark, ["(((...)))", "((()))", "......", "", "((..((...))..))", "(", ".("],
        st.hairpin_count("s"), st.stem_count("s"), st.bulge_count("s"), st.loop_count("s"),
    )
    assert got == [
        (1, 2, 1, 1), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (1, 4, 3, 3), (0, 0, 0, 0), (0, 0, 0, 1),
    ]


def count_by_runs(d):
    """Hairpins, stems, bulges, loops from the list of runs of dots and brackets."""
    runs = [m.group() for m in re.finditer(r"\.+|[()]+", d)]
    stems = sum(r[0] != "." for r in runs)
    if runs and runs[-1][0] != "." and len(runs[-1]) == 1:
        stems -= 1
    inner = [
        (a[-1], r, b[0]) for a, r, b in zip(runs, runs[1:], runs[2:]) if r[0] == "."
    ]
    hairpins = sum(a == "(" and b == ")" and len(r) >= 3 for a, r, b in inner)
    bulges = sum(len(r) <= 10 for _, r, _ in inner)
    return hairpins, stems, bulges, sum(r[0] == "." for r in runs)


def test_counters_on_random_strings(spark):
    rng = random.Random(7)
    texts = [
        "".join(rng.choices("().", weights=(1, 1, rng.choice((1, 4, 12))), k=rng.randint(0, 60)))
        for _ in range(3000)
    ]
    got = values(
        spark, texts, st.hairpin_count("s"), st.stem_count("s"), st.bulge_count("s"), st.loop_count("s")
    )
    assert got == [count_by_runs(t) for t in texts]


def test_alphabets_and_truncation(spark):
    got = values(
        spark, ["ACGU", "ACGT"], sq.to_alphabet("s", "dna"), sq.to_alphabet("s", "rna"), sq.truncate("s", 2)
    )
    assert got == [("ACGT", "ACGU", "AC"), ("ACGT", "ACGU", "AC")]
    with pytest.raises(ValueError, match="unknown sequence type"):
        sq.to_alphabet("s", "protein")


def test_insights(spark):
    rows = [
        (2001, 0.61, 0.81, 10.1, 1.51), (2000, 0.6, 0.8, 10.0, 1.5), (499, 0.29, None, None, None),
        (500, 0.3, 0.9, float("nan"), 2.0), (None, None, float("nan"), 11.0, None),
    ]
    df = spark.createDataFrame(rows, "l int, g double, y double, d double, e double")
    text = sq.insights(
        F.col("l"), F.col("g"),
        {"yield": F.col("y"), "dsRNA_percent": F.col("d"), "expression": F.col("e"), "other": F.col("y")},
    )
    assert [r[0] for r in df.select(text).collect()] == [
        "long sequence; high GC content; high yield predicted; high dsRNA formation risk; "
        "strong expression expected",
        "standard profile",
        "short sequence; low GC content",
        "high yield predicted; strong expression expected",
        "high dsRNA formation risk",
    ]


def test_labels(spark):
    df = spark.createDataFrame([(0.81,), (0.8,), (0.6,), (0.4,), (0.2,), (None,)], "r double")
    rated = [tuple(r) for r in df.select(labels.card_rating(F.col("r")), labels.assessment(F.col("r"))).collect()]
    assert [r[0] for r in rated] == ["Excellent", "Good", "Fair", "Poor", "Very Poor", None]
    assert rated[4][1] == "VERY POOR - Little to no predictive power"
    stable = df.select(labels.stability_label(F.col("r") * 2)).collect()
    assert [r[0] for r in stable] == ["low", "low", "low", "moderate", "high", None]
    advice = df.select(labels.advice(F.col("r"), F.col("r"))).collect()
    assert [len(r[0]) for r in advice] == [1, 1, 1, 4, 3, 0]


def test_two_category_rule_sets(spark):
    names = ["PC1", "pc_like", "tSNE2", "my_embedding", "mfe", "fold_energy", "gc_content", "enzyme_type_T7"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [tuple(r) for r in df.select(labels.feature_category(F.col("f")), labels.feature_type(F.col("f"))).collect()]
    e, s, c = "embedding_features", "structure_features", "covariate_features"
    assert [g[0] for g in got] == [e, e, e, e, s, s, s, c]
    assert [g[1] for g in got] == [
        "embedding", "covariate", "covariate", "embedding", "structure", "covariate", "structure", "covariate",
    ]


@pytest.mark.parametrize(
    "r, n, expected",
    [
        # Closed forms: df = 1 is Cauchy, df = 2 is algebraic.
        (0.5, 3, 2 / 3), (-0.5, 3, 2 / 3), (0.6, 4, 0.4), (0.0, 10, 1.0), (1.0, 10, 0.0),
        (0.3, 2, 1.0), (None, 10, None), (0.5, 1, None),
        # df = 4: p = 1 - r (3 - r^2) / 2
        (0.7, 6, 1 - 0.7 * (3 - 0.49) / 2),
    ],
)
def test_correlation_p_value(r, n, expected):
    got = correlation_p_value(r, n)
    assert got is None if expected is None else got == pytest.approx(expected, rel=1e-10)


def test_correlation_p_value_large_n():
    # For many rows r * sqrt(n) is standard normal: z = 1.96 gives 0.05.
    assert correlation_p_value(1.959964 / 1e4, 1e8) == pytest.approx(0.05, rel=1e-4)
    assert correlation_p_value(0.5, 1e9) == 0.0


def test_expressions_run_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "GGCC"), (2, "AXU")], "seq_id long, sequence string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, sequence string").parquet(str(tmp_path / "in"))
    marked = stream.select("seq_id", sq.gc_content("sequence").alias("gc"), sq.classify("sequence").alias("status"))
    query = (
        marked.writeStream.format("memory").queryName("marked").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    query.awaitTermination(120)
    got = {r["seq_id"]: (r["gc"], r["status"]) for r in spark.table("marked").collect()}
    assert got == {1: (1.0, "valid"), 2: (0.0, "invalid_chars: {'X'}")}
