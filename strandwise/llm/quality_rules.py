"""Operator 6: quality rules and robust multivariate outliers.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated
3-word windows) and fails the base rule on too few words or too much repetition. The counts of
the others become a vector of logarithms and shares. Per language and source the minimum
covariance determinant estimate of its centre and scatter is found by concentration: start from
coordinatewise medians and absolute deviations, then several times keep the ``kept_part`` of
the rows with the smallest Mahalanobis distance and take their mean and covariance. Every step
is an aggregate over the compact table of vectors that Spark combines before it shuffles, so a
source with a third of all rows costs no more than its rows. A row whose distance exceeds the
chi-square quantile of the tail ``tail`` is rejected.

A group with fewer than ``least`` rows takes the estimate of its language, and a language with
fewer that of all rows; with fewer rows than that in all, nothing is an outlier. Each dimension
has a least deviation (``FLOOR``), so that a constant statistic rejects no small change.

Null or empty texts have zero counts and fail the base rule. Null languages and sources form
groups of their own. Repeated rows each get the verdict. Very long texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import Words, batches, mix, plain, store

SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"
STATISTICS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("length", "word_length", "symbols", "dup_lines", "repeats")
FLOOR = (0.25, 0.05, 0.2, 0.1, 0.1)
_P = len(VECTOR)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)."""
    names = ["key", *keep]
    wanted = [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1

    def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def run(items):
        for batch in batches(items, "text", 4 << 20):
            column = batch.column(len(names))
            words = Words(column)
            data, first = words.data, words.first
            level = np.zeros(len(data) + 1, np.int64)
            np.add.at(level, words.starts, 1)
            np.subtract.at(level, words.ends, 1)
            inside = np.cumsum(level[:-1]) > 0
            chars = sums(inside & ((data & 0xC0) != 0x80), words.offsets)
            repeated = np.zeros(len(words.starts) + 1, np.int64)
            grams = words.grams(3)
            whole = np.flatnonzero(words.complete(3))
            if len(whole):
                own = mix(grams[whole] ^ mix(words.doc[whole].astype(np.uint64) + np.uint64(1)))
                _, which, times = np.unique(own, return_inverse=True, return_counts=True)
                again = whole[times[which] > 1]
                np.add.at(repeated, again, 1)
                np.subtract.at(repeated, np.minimum(again + 3, len(repeated) - 1), 1)
            covered = np.cumsum(repeated[:-1]) > 0
            lines, same = [], []
            for value in column.to_pylist():
                if not value:
                    lines.append(0)
                    same.append(0)
                    continue
                filled = [x for x in value.split("\n") if x.strip(_BLANK)]
                lines.append(len(filled))
                same.append(len(filled) - len(set(filled)))
            columns = (np.diff(first), chars, sums(symbol[data], words.offsets), same, lines, sums(covered, first))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *(pa.array(np.asarray(c, np.int64)) for c in columns)], wanted
            )

    rows = plain(docs, **{key: "long"}, **{c: "string" for c in keep}, **{text: "string"}).toDF(*names, "text")
    fields = ["key long", *(f"`{c}` string" for c in keep), *(f"{c} long" for c in wanted[len(names) :])]
    return rows.mapInArrow(run, ", ".join(fields))


def vector(n_words: Column) -> list[Column]:
    """The transformed statistics, in the order of ``VECTOR``."""
    words = F.greatest(n_words.cast("double"), F.lit(1.0))
    return [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log((F.col("n_symbols") + 1) / (words + 20)),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / words,
    ]


def chi_square_quantile(tail: float, p: int) -> float:
    """Upper quantile by the Wilson-Hilferty approximation."""
    low, high = -40.0, 40.0
    for _ in range(80):  # of the normal distribution, by bisection
        z = (low + high) / 2
        low, high = (z, high) if math.erfc(z / math.sqrt(2)) / 2 > tail else (low, z)
    return p * (1 - 2 / (9 * p) + low * math.sqrt(2 / (9 * p))) ** 3


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x0.., m0.. and the inverse s00, s01, ..."""
    gap = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_P)]
    terms = [(1 if i == j else 2) * gap[i] * gap[j] * F.col(f"s{i}{j}") for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _inverse(moments: DataFrame) -> DataFrame:
    """(group, m..., s...) from (group, m..., c...): inverse covariances with the floor."""
    names = [f"m{i}" for i in range(_P)] + [f"s{i}{j}" for i, j in _PAIRS]

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                scatter = np.zeros((_P, _P))
                for i, j in _PAIRS:
                    scatter[i, j] = scatter[j, i] = getattr(row, f"c{i}{j}")
                scatter = np.nan_to_num(scatter) + np.diag(np.square(FLOOR))
                inverse = np.linalg.inv(scatter)
                out.append([row.group, *(getattr(row, f"m{i}") for i in range(_P)), *(inverse[i, j] for i, j in _PAIRS)])
            yield pd.DataFrame(out, columns=["group", *names])

    return moments.mapInPandas(run, ", ".join(["group string", *(f"{n} double" for n in names)]))


def _moments(rows: DataFrame) -> DataFrame:
    mean = [F.avg(f"x{i}").alias(f"m{i}") for i in range(_P)]
    scatter = [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in _PAIRS]
    return rows.groupBy("group").agg(*mean, *scatter)


def concentrate(rows: DataFrame, kept_part: float, steps: int) -> DataFrame:
    """Estimates per group of ``rows`` (group, x0, ...): (group, m..., s..., scale).

    ``scale`` brings the median squared distance to that of the chi-square distribution.
    """
    middle = rows.groupBy("group").agg(*(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(_P)))
    spread = (
        rows.join(middle, "group")
        .groupBy("group")
        .agg(
            *(F.first(f"m{i}").alias(f"m{i}") for i in range(_P)),
            *(
                (F.pow(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000) * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
                for i, j in _PAIRS
            ),
        )
    )
    estimate = store(_inverse(spread), "mcd-start")
    for _ in range(steps):
        far = rows.join(estimate, "group").select("group", *(f"x{i}" for i in range(_P)), _distance().alias("d2"))
        limit = far.groupBy("group").agg(F.percentile_approx("d2", kept_part, 1000).alias("limit"))
        near = far.join(limit, "group").filter(F.col("d2") <= F.col("limit"))
        estimate = store(_inverse(_moments(near)), "mcd-step")
    far = rows.join(estimate, "group").select("group", _distance().alias("d2"))
    scale = far.groupBy("group").agg(
        F.greatest(F.percentile_approx("d2", 0.5, 1000) / F.lit(chi_square_quantile(0.5, _P)), F.lit(1.0)).alias("scale")
    )
    return estimate.join(scale, "group")


def judge(
    docs: DataFrame, least: int = 100, kept_part: float = 0.75, steps: int = 4, tail: float = 1e-12,
    key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
) -> DataFrame:
    """(key, n_words, statistics, base_failed, kept, d2) per row; ``d2`` is null without estimate."""
    counted = text_statistics(docs, key, text, (lang, source)).withColumnsRenamed({lang: "_lang", source: "_source"})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = F.to_json(F.struct(F.col("_lang").alias("a"), F.col("_source").alias("b")), {"ignoreNullFields": "false"})
    stats = store(
        counted.select("*", failed.alias("base_failed"), named.alias("fine"), F.to_json(F.struct(F.col("_lang").alias("a"))).alias("coarse")).withColumns(
            {f"x{i}": c for i, c in enumerate(vector(F.col("n_words")))}
        ),
        "statistics",
    )
    sound = stats.filter(~F.col("base_failed"))
    x = [f"x{i}" for i in range(_P)]
    # Each row serves the estimate of its source, of its language and of everything.
    levels = sound.select(
        F.explode(F.array(F.concat(F.lit("2"), "fine"), F.concat(F.lit("1"), "coarse"), F.lit("0"))).alias("group"), *x
    )
    large = levels.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("group")
    estimates = concentrate(store(levels.join(large, "group"), "mcd-rows"), kept_part, steps)
    existing = store(estimates, "mcd")
    keys = existing.select("group", F.lit(True).alias("has"))
    chosen = (
        stats.select("fine", "coarse")
        .distinct()
        .join(keys.select(F.col("group").alias("g2"), F.col("has").alias("h2")), F.col("g2") == F.concat(F.lit("2"), "fine"), "left")
        .join(keys.select(F.col("group").alias("g1"), F.col("has").alias("h1")), F.col("g1") == F.concat(F.lit("1"), "coarse"), "left")
        .select("fine", "coarse", F.coalesce("g2", "g1", F.lit("0")).alias("group"))
        .join(existing, "group", "left")
    )
    limit = chi_square_quantile(tail, _P)
    d2 = _distance() / F.col("scale")
    verdict = stats.join(chosen, (stats["fine"] == chosen["fine"]) & (stats["coarse"] == chosen["coarse"]), "left")
    return verdict.select(
        F.col("key").alias(key), "n_words", *STATISTICS, "base_failed",
        (~F.col("base_failed") & F.coalesce(d2 <= limit, F.lit(True))).alias("kept"), d2.alias("d2"),
    )
