"""Data-quality checks: sequences, targets, missing data, duplicates, outliers, advice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions import sequence as sq
from strandwise.functions.stats import cleaned, present, unpivot
from strandwise.operators.joins import join_on, join_small
from strandwise.operators.order_stats import exact_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
TARGETS = ("yield", "dsRNA_percent", "expression")

# Limits and texts of the recommendations and the gate.
ADVICE = {
    "small": "Small dataset (%d samples). Consider collecting more data or using regularization.",
    "invalid": "Found %d invalid sequences. Clean before processing.",
    "missing": "High missing data (%.1f%%). Consider imputation strategies.",
    "target_missing": "High missing rate in %s (%.1f%%). May impact model performance.",
    "outliers": "Many outliers in %s (%.1f%%). Consider robust scaling.",
}
LIMITS = {"rows": 1000, "missing": 10, "target_missing": 20, "outliers": 10, "critical": 50}
CRITICAL = ("Invalid sequences found", "High missing data percentage")


# --- columns --------------------------------------------------------------------------


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail on the schema, before any job runs, if a column is absent."""
    absent = sorted(set(required) - set(df.columns))
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    return df


def target_columns(df: DataFrame, targets: Sequence[str] = TARGETS) -> list[str]:
    return [t for t in targets if t in df.columns]


def covariate_columns(
    df: DataFrame, targets: Sequence[str] = TARGETS, exclude: Sequence[str] = ("seq_id", "sequence")
) -> list[str]:
    """Every column that is no key, no sequence and no target."""
    skip = {*exclude, *target_columns(df, targets)}
    return [c for c in df.columns if c not in skip]


# --- sequences ------------------------------------------------------------------------


def classify_sequences(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Adds ``strict_valid`` (case-sensitive) and ``status`` (after upper-casing)."""
    return df.withColumns(
        {"strict_valid": sq.is_strict(sequence), "status": sq.classify(sequence)}
    )


def split_valid(df: DataFrame, sequence: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with their ``status``)."""
    marked = df.withColumn("status", sq.classify(sequence))
    ok = F.col("status") == "valid"
    return marked.where(ok).drop("status"), marked.where(~ok)


def check_strict(
    df: DataFrame, sequence: str = "sequence", targets: Sequence[str] = TARGETS
) -> dict[str, int]:
    """Raise on null or non-A/C/G/U sequences; return the null count of each target."""
    found = target_columns(df, targets)
    row = df.agg(
        F.count_if(F.col(sequence).isNull()).alias("nulls"),
        F.count_if(F.col(sequence).isNotNull() & ~sq.is_strict(sequence)).alias("bad"),
        *[F.count_if(~present(df, t)).alias(f"null {t}") for t in found],
    ).first()
    if row["nulls"]:
        raise ValueError(f"Found null sequences ({row['nulls']})")
    if row["bad"]:
        raise ValueError(
            f"Invalid RNA sequences found ({row['bad']}; must contain only A,C,G,U)"
        )
    return {t: row[f"null {t}"] for t in found}


def overview(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row with every table-wide count and sequence statistic, from one scan.

    Spark drops what a caller does not select, so a single statistic does not pay for the
    others; settle the row to build several sections from it. The number of distinct
    lengths is bounded by the longest sequence, so ``percentile`` keeps a small histogram.
    """
    s = sq.normalise(sequence)
    valid = sq.is_strict(s)
    there = {c: present(df, c) for c in df.columns}
    rows = df.select(
        valid.alias("_valid"),
        F.when(valid, F.length(s)).alias("_length"),
        *[F.when(valid, sq.base_fraction(s, b)).alias(f"_share_{b}") for b in sq.BASES],
        reduce(lambda a, b: a & b, there.values()).alias("_complete"),
        *[there[c].alias(f"_there_{i}") for i, c in enumerate(df.columns)],
    )
    return rows.agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.count_if("_valid").alias("valid_sequences"),
        F.count_if(~F.col("_valid")).alias("invalid_sequences"),
        F.avg("_length").alias("mean_length"),
        F.stddev_pop("_length").alias("std_length"),
        F.min("_length").cast("bigint").alias("min_length"),
        F.max("_length").cast("bigint").alias("max_length"),
        F.percentile("_length", F.lit(0.5)).alias("median_length"),
        *[F.avg(f"_share_{b}").alias(f"mean_{b}") for b in sq.BASES],
        *[F.stddev_pop(f"_share_{b}").alias(f"std_{b}") for b in sq.BASES],
        F.count_if("_complete").alias("complete_rows"),
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.count_if(~F.col(f"_there_{i}")).alias("missing")
                )
                for i, c in enumerate(df.columns)
            ]
        ).alias("missing"),
    )


def sequence_summary(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row: counts, and length statistics over the valid rows (population std)."""
    return summary_of(overview(df, sequence))


def summary_of(facts: DataFrame) -> DataFrame:
    return facts.select(
        "total_sequences", "valid_sequences", "invalid_sequences", "mean_length", "std_length",
        "min_length", "max_length", "median_length",
    )


def base_composition(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(base, mean, std): population std of the per-sequence fraction of each base.

    Aggregated wide and turned into four rows afterwards, so the input is not multiplied.
    """
    return composition_of(overview(df, sequence))


def composition_of(facts: DataFrame) -> DataFrame:
    entries = [
        F.struct(
            F.lit(b).alias("base"),
            F.col(f"mean_{b}").alias("mean_fraction"),
            F.col(f"std_{b}").alias("std_fraction"),
        )
        for b in sq.BASES
    ]
    return facts.select(F.inline(F.array(*entries)))


# --- targets --------------------------------------------------------------------------


def long_targets(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return unpivot(df, [], list(targets), "target", "value")


def profile(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Statistics of ``value`` per key: missing share, moments (sample std), median,
    skewness and excess kurtosis (population), Jarque-Bera, quartiles, IQR bounds and
    outliers.
    """
    keys = list(keys)
    v = cleaned(long, value)
    moments = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
    )
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    quartiles = exact_quantiles(long, value, QUARTILES, keys)
    found = outlier_summary(long, keys, value, quartiles)
    facts = join_on(moments, found, keys, "left")
    return facts.select(
        *keys,
        "n_rows",
        (F.col("n_rows") - F.col("n")).alias("missing_count"),
        ((F.col("n_rows") - F.col("n")) / F.col("n_rows") * 100).alias("missing_percentage"),
        "mean",
        "std",
        "min",
        "max",
        "median",
        "q1",
        "q3",
        "lower_bound",
        "upper_bound",
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"),
        F.try_divide(F.col("outlier_count") * 100.0, F.col("n")).alias("outlier_percentage"),
        "min_outlier",
        "max_outlier",
        "skewness",
        "kurtosis",
        jb.alias("jarque_bera"),
        F.exp(-jb / 2).alias("normality_p"),
    )


def with_bounds(
    long: DataFrame, keys: Sequence[str], value: str = "value", quartiles: DataFrame | None = None
) -> DataFrame:
    """Rows with the quartiles and IQR bounds of their key."""
    keys = list(keys)
    if quartiles is None:
        quartiles = exact_quantiles(long, value, QUARTILES, keys)
    iqr = F.col("q3") - F.col("q1")
    bounds = quartiles.withColumns(
        {
            "lower_bound": F.col("q1") - 1.5 * iqr,
            "upper_bound": F.col("q3") + 1.5 * iqr,
        }
    )
    return join_small(long, bounds, keys, "inner")


def _outside(value: str) -> Column:
    return (F.col(value) < F.col("lower_bound")) | (F.col(value) > F.col("upper_bound"))


def iqr_outliers(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The rows outside Q1 - 1.5 IQR .. Q3 + 1.5 IQR of their key (strict)."""
    bounded = with_bounds(long.where(present(long, value)), keys, value)
    return bounded.where(_outside(value))


def outlier_summary(
    long: DataFrame, keys: Sequence[str], value: str = "value", quartiles: DataFrame | None = None
) -> DataFrame:
    """Bounds, outlier count and the extreme outliers per key."""
    keys = list(keys)
    rows = long.where(present(long, value)).select(*keys, value)
    bounded = with_bounds(rows, keys, value, quartiles)
    out = F.when(_outside(value), F.col(value))
    bounds = ["q1", "median", "q3", "lower_bound", "upper_bound"]
    return bounded.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in bounds],
        F.count(out).alias("outlier_count"),
        F.min(out).alias("min_outlier"),
        F.max(out).alias("max_outlier"),
    )


def target_profile(df: DataFrame, targets: Sequence[str] = TARGETS) -> DataFrame:
    """``profile`` per target plus ``status``; absent targets get a ``missing`` row."""
    found = target_columns(df, targets)
    absent = [t for t in targets if t not in found]
    lost = df.sparkSession.createDataFrame([(t, "missing") for t in absent], "target string, status string")
    if not found:
        return lost
    known = profile(long_targets(df, found), ["target"]).withColumn("status", F.lit("present"))
    return known.unionByName(lost, allowMissingColumns=True) if absent else known


# --- whole table ----------------------------------------------------------------------


def missing_profile(df: DataFrame) -> DataFrame:
    """One row: cells, missing cells and share, complete rows, null counts of the columns
    that have any (a map), all from one scan.
    """
    # No statistic of a sequence is selected, so any column can stand in for it.
    return missing_of(overview(df.withColumn("_none", F.lit("")), "_none"), skip="_none")


def _missing(skip: str | None = None) -> tuple[Column, Column, Column]:
    """(entries per column, missing cells, share of all cells in percent)"""
    entries = F.col("missing")
    if skip:
        entries = F.filter(entries, lambda e: e["column"] != skip)
    cells = F.aggregate(entries, F.lit(0).cast("bigint"), lambda n, e: n + e["missing"])
    share = F.try_divide(cells * 100.0, F.col("total_sequences") * F.size(entries))
    return entries, cells, share


def missing_of(facts: DataFrame, skip: str | None = None) -> DataFrame:
    entries, cells, share = _missing(skip)
    return facts.select(
        F.col("total_sequences").alias("n_rows"),
        cells.alias("total_missing_cells"),
        share.alias("missing_percentage"),
        "complete_rows",
        F.map_from_entries(F.filter(entries, lambda e: e["missing"] > 0)).alias("columns_with_missing"),
    )


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 over all values; equal rows, nulls included, have equal fingerprints.

    Each value is written as its length and text, a null as a mark of its own, so values
    cannot run into each other. Only 32 bytes per row have to be shuffled.
    """
    parts = []
    for name in columns or df.columns:
        c = F.col(f"`{name}`")
        kind = df.schema[name].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)
        text = (
            F.to_json(F.struct(c), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"})
            if isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
            else F.base64(c)
            if isinstance(kind, T.BinaryType)
            else F.unix_micros(c).cast("string")
            if isinstance(kind, T.TimestampType)
            else c.cast("string")
        )
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of every group of identical rows (nulls equal)."""
    groups = df.groupBy(row_fingerprint(df).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def _orderable(df: DataFrame, name: str) -> bool:
    return not isinstance(
        df.schema[name].dataType, (T.MapType, T.VariantType, T.ArrayType, T.StructType)
    )


def column_cardinality(df: DataFrame, share: float = 0.5) -> DataFrame:
    """(column, constant, high_cardinality) for every atomic column.

    Constant means at most one distinct value, which minimum = maximum decides without a
    distinct count. For string columns a HyperLogLog screen decides what is far from the
    limit; only columns near or above it get an exact count, over 32-byte fingerprints.
    """
    names = [c for c in df.columns if _orderable(df, c)]
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    values = {c: cleaned(df, c) for c in names}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.coalesce(F.min(v) == F.max(v), F.lit(True))).alias(f"constant {c}") for c, v in values.items()],
        *[F.approx_count_distinct(values[c], 0.02).alias(f"distinct {c}") for c in texts],
    ).first()
    near = [c for c in texts if row[f"distinct {c}"] > row["n"] * share * 0.8]
    exact = {}
    for c in near:
        prints = df.where(values[c].isNotNull()).select(row_fingerprint(df, [c]).alias("f"))
        exact[c] = prints.distinct().count()
    rows = [
        (c, bool(row[f"constant {c}"]), exact.get(c, 0) > row["n"] * share) for c in names
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, constant boolean, high_cardinality boolean"
    )


# --- advice and gate ------------------------------------------------------------------


def validation_facts(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """One row with the numbers that advice and gate look at."""
    return facts_of(overview(df, sequence))


def facts_of(facts: DataFrame) -> DataFrame:
    _, _, share = _missing()
    return facts.select("total_sequences", "invalid_sequences", share.alias("missing_percentage"))


def recommendations(facts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(position, recommendation): table-wide lines first, then those of the targets."""
    n, bad, gone = (
        F.col(c) for c in ("total_sequences", "invalid_sequences", "missing_percentage")
    )
    lines = F.array(
        F.when(n < LIMITS["rows"], F.format_string(ADVICE["small"], n)),
        F.when(bad > 0, F.format_string(ADVICE["invalid"], bad)),
        F.when(gone > LIMITS["missing"], F.format_string(ADVICE["missing"], gone)),
    )
    result = facts.select(F.posexplode(lines).alias("position", "recommendation"))
    if targets is not None:
        gone, out = F.col("missing_percentage"), F.col("outlier_percentage")
        pair = F.array(
            F.when(
                gone > LIMITS["target_missing"],
                F.format_string(ADVICE["target_missing"], F.col("target"), gone),
            ),
            F.when(
                out > LIMITS["outliers"],
                F.format_string(ADVICE["outliers"], F.col("target"), out),
            ),
        )
        more = targets.select(F.posexplode(pair).alias("position", "recommendation"))
        result = result.unionByName(more.withColumn("position", F.col("position") + 3))
    return result.where(F.col("recommendation").isNotNull())


def critical_issues(facts: DataFrame) -> DataFrame:
    """(issue): rows only if the table must not be used for training."""
    found = F.array(
        F.when(F.col("invalid_sequences") > 0, F.lit(CRITICAL[0])),
        F.when(F.col("missing_percentage") > LIMITS["critical"], F.lit(CRITICAL[1])),
    )
    return facts.select(F.explode(found).alias("issue")).where(F.col("issue").isNotNull())
