"""Encoding and scaling of covariates, and scaling of targets.

Fitted state is a small table (one row per column, or per column and category), so it is
saved as parquet and applied as plain column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.stats import cleaned, is_numeric

FEW = 10
MAX_CATEGORIES = 10_000
STATE_SCHEMA = (
    "position int, column string, kind string, category string, mean double, std double"
)


def column_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind): strings and numbers with at most 10 distinct values are
    ``categorical``, other numbers ``numeric``.
    """
    kinds = _kinds(df, columns)
    rows = [(c, kinds[c]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def _kinds(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    numbers = [c for c in columns if is_numeric(df, c)]
    kinds = {c: "categorical" for c in columns}
    if not numbers:
        return kinds
    # Sketches first: a column far above the limit never gets a distinct count.
    about = df.agg(*[F.approx_count_distinct(cleaned(df, c)).alias(c) for c in numbers]).first()
    near = [c for c in numbers if about[c] <= 5 * FEW]
    few = {}
    if near:
        few = df.agg(*[F.count_distinct(cleaned(df, c)).alias(c) for c in near]).first().asDict()
    kinds.update({c: "numeric" for c in numbers if few.get(c, FEW + 1) > FEW})
    return kinds


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str | None]]:
    """Sorted category texts per column, a null category last."""
    if not columns:
        return {}
    # Only strings leave this select, so one unpivot covers columns of any type.
    texts = df.select(*[cleaned(df, c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "category").distinct()
    rows = long.limit(MAX_CATEGORIES * len(columns) + 1).collect()
    found: dict[str, list[str | None]] = {c: [] for c in columns}
    for row in rows:
        found[row["column"]].append(row["category"])
    for c, values in found.items():
        if len(values) > MAX_CATEGORIES:
            raise ValueError(f"column '{c}' has more than {MAX_CATEGORIES} categories")
        by = float if is_numeric(df, c) else str
        values.sort(key=lambda v: (v is None, by(v) if v is not None else 0))
    return found


def _scale(value: Column, mean: float, std: float) -> Column:
    return (value - F.lit(mean)) / F.lit(std if std else 1.0)


@dataclass
class CovariateEncoder:
    """One-hot (first category dropped) and standardised (population std) covariates.

    ``unseen`` decides about categories not met in ``fit``: ``error``, or ``keep`` for a
    row of zeros.
    """

    unseen: str = "error"
    categories: dict[str, list[str | None]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    columns: list[str] | None = None

    def fit(self, df: DataFrame, columns: Sequence[str]) -> CovariateEncoder:
        kinds = _kinds(df, columns) if columns else {}
        texts = [c for c in columns if kinds[c] == "categorical"]
        numbers = [c for c in columns if kinds[c] == "numeric"]
        fitted = CovariateEncoder(self.unseen, _distinct_values(df, texts), {}, list(columns))
        fitted.scales = fit_scales(df, numbers)
        return fitted

    def _check_fitted(self) -> None:
        if self.columns is None:
            raise ValueError("CovariateEncoder must be fitted before it is used")

    @property
    def feature_names(self) -> list[str]:
        self._check_fitted()
        hot = [
            f"{c}_{'nan' if v is None else v}"
            for c, values in self.categories.items()
            for v in values[1:]
        ]
        return [*hot, *self.scales]

    def expressions(self, df: DataFrame) -> list[Column]:
        """One column per feature name, in that order."""
        self._check_fitted()
        result = []
        for c, values in self.categories.items():
            text = cleaned(df, c).cast("string")
            for v in values[1:]:
                same = text.isNull() if v is None else F.coalesce(text == v, F.lit(False))
                result.append(same.cast("double"))
        for c, (mean, std) in self.scales.items():
            result.append(_scale(cleaned(df, c).cast("double"), mean, std))
        return [e.alias(name) for e, name in zip(result, self.feature_names)]

    def unseen_counts(self, df: DataFrame) -> DataFrame:
        """One row: per categorical column the rows with a category not met in ``fit``."""
        return df.agg(
            *[F.count_if(self._is_unseen(df, c)).alias(c) for c in self.categories]
        )

    def _is_unseen(self, df: DataFrame, c: str) -> Column:
        text = cleaned(df, c).cast("string")
        known = [v for v in self.categories[c] if v is not None]
        null_ok = F.lit(None in self.categories[c])
        return F.when(text.isNull(), ~null_ok).otherwise(~text.isin(known) if known else F.lit(True))

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep, features). An unseen category fails the job at the row that has it."""
        self._check_fitted()
        if self.unseen == "error":
            for c in self.categories:
                problem = F.raise_error(
                    F.concat(
                        F.lit(f"unknown category in column '{c}': "),
                        F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")),
                    )
                ).cast(df.schema[c].dataType)
                df = df.withColumn(
                    c, F.when(self._is_unseen(df, c), problem).otherwise(F.col(f"`{c}`"))
                )
        return df.select(*keep, *self.expressions(df))

    def save(self, spark: SparkSession, path: str) -> None:
        self._check_fitted()
        rows = [
            (i, c, "categorical", v, None, None)
            for c, values in self.categories.items()
            for i, v in enumerate(values)
        ]
        rows += [(i, c, "numeric", None, m, s) for i, (c, (m, s)) in enumerate(self.scales.items())]
        rows += [(i, c, "column", self.unseen, None, None) for i, c in enumerate(self.columns)]
        spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CovariateEncoder:
        rows = spark.read.schema(STATE_SCHEMA).parquet(path).orderBy("kind", "position").collect()
        columns = [r["column"] for r in rows if r["kind"] == "column"]
        loaded = CovariateEncoder(columns=columns)
        for r in rows:
            if r["kind"] == "column":
                loaded.unseen = r["category"]
            elif r["kind"] == "numeric":
                loaded.scales[r["column"]] = (r["mean"], r["std"])
        for c in columns:
            values = [r["category"] for r in rows if r["kind"] == "categorical" and r["column"] == c]
            if values:
                loaded.categories[c] = values
        return loaded


def fit_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std of every column, from one aggregate."""
    if not columns:
        return {}
    row = df.agg(
        *[F.avg(cleaned(df, c)).alias(f"mean {c}") for c in columns],
        *[F.stddev_pop(cleaned(df, c)).alias(f"std {c}") for c in columns],
    ).first()
    for c in columns:
        if row[f"mean {c}"] is None:
            raise ValueError(f"column '{c}' has no values to scale by")
    return {c: (row[f"mean {c}"], row[f"std {c}"]) for c in columns}


@dataclass
class TargetScaler:
    """Standardises targets and turns predictions back into the original units."""

    scales: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame, targets: Sequence[str]) -> TargetScaler:
        return TargetScaler(fit_scales(df, list(targets)))

    def _known(self, df: DataFrame) -> dict[str, tuple[float, float]]:
        if self.scales is None:
            raise ValueError("TargetScaler must be fitted before it is used")
        return {c: s for c, s in self.scales.items() if c in df.columns}

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """(keep, scaled targets): other columns are left out."""
        return df.select(
            *keep, *[_scale(cleaned(df, c), m, s).alias(c) for c, (m, s) in self._known(df).items()]
        )

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Original units again; other columns stay."""
        return df.withColumns(
            {
                c: F.col(f"`{c}`") * F.lit(s if s else 1.0) + F.lit(m)
                for c, (m, s) in self._known(df).items()
            }
        )

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, c, "target", None, m, s) for i, (c, (m, s)) in enumerate((self.scales or {}).items())]
        spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TargetScaler:
        rows = spark.read.schema(STATE_SCHEMA).parquet(path).orderBy("position").collect()
        return TargetScaler({r["column"]: (r["mean"], r["std"]) for r in rows})
