"""Expressions over RNA / DNA sequence strings.

All of them are built-in JVM expressions without state, so they work the same on a batch
and on a streaming DataFrame. ``sequence`` arguments are column names or columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet in report order, and the limits of the insight rules.
BASES = ("A", "C", "G", "U")
INSIGHT_LIMITS = {
    "long_length": 2000,
    "short_length": 500,
    "high_gc": 0.6,
    "low_gc": 0.3,
    "yield": 0.8,
    "dsRNA_percent": 10,
    "expression": 1.5,
}
INSIGHT_TEXT = {
    "long": "long sequence",
    "short": "short sequence",
    "high_gc": "high GC content",
    "low_gc": "low GC content",
    "yield": "high yield predicted",
    "dsRNA_percent": "high dsRNA formation risk",
    "expression": "strong expression expected",
    "none": "standard profile",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_strict(sequence: Column | str) -> Column:
    """True for a non-empty, upper-case A/C/G/U string; null counts as false."""
    return F.coalesce(_col(sequence).rlike(r"^[ACGU]+\z"), F.lit(False))


def normalise(sequence: Column | str) -> Column:
    return F.upper(_col(sequence))


def invalid_characters(sequence: Column | str) -> Column:
    """Sorted distinct characters outside A/C/G/U after upper-casing."""
    other = F.regexp_extract_all(normalise(sequence), F.lit(r"([^ACGU])"), F.lit(1))
    return F.array_sort(F.array_distinct(other))


def classify(sequence: Column | str) -> Column:
    """``valid``, ``null_sequence``, ``empty_sequence`` or ``invalid_chars: {'X', 'Y'}``."""
    s = _col(sequence)
    return (
        F.when(s.isNull(), F.lit("null_sequence"))
        .when(s == "", F.lit("empty_sequence"))
        .when(is_strict(normalise(s)), F.lit("valid"))
        .otherwise(
            F.concat(
                F.lit("invalid_chars: {'"),
                F.concat_ws("', '", invalid_characters(s)),
                F.lit("'}"),
            )
        )
    )


def count_base(sequence: Column | str, base: str) -> Column:
    """Occurrences of one letter; cheaper than a regular expression."""
    s = _col(sequence)
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def base_fraction(sequence: Column | str, base: str) -> Column:
    s = _col(sequence)
    return F.try_divide(count_base(s, base).cast("double"), F.length(s))


def gc_content(sequence: Column | str) -> Column:
    """(G + C) / length; 0.0 for an empty string, null for null."""
    s = _col(sequence)
    share = F.try_divide((count_base(s, "G") + count_base(s, "C")).cast("double"), F.length(s))
    return F.when(s.isNotNull(), F.coalesce(share, F.lit(0.0)))


def sequence_length(sequence: Column | str) -> Column:
    return F.length(_col(sequence)).cast("bigint")


def to_alphabet(sequence: Column | str, sequence_type: Column | str) -> Column:
    """Convert to the alphabet a model expects: ``dna`` U->T, ``rna`` T->U."""
    s = _col(sequence)
    dna, rna = F.translate(s, "U", "T"), F.translate(s, "T", "U")
    if isinstance(sequence_type, str):
        if sequence_type not in ("dna", "rna"):
            raise ValueError(f"unknown sequence type '{sequence_type}'")
        return dna if sequence_type == "dna" else rna
    return F.when(sequence_type == "dna", dna).when(sequence_type == "rna", rna).otherwise(s)


def truncate(sequence: Column | str, max_length: Column | int) -> Column:
    """First ``max_length`` bases (the model's context limit)."""
    limit = F.lit(max_length) if isinstance(max_length, int) else max_length
    return F.substring(_col(sequence), F.lit(1), limit)


def insights(
    length: Column | None,
    gc: Column | None,
    predictions: dict[str, Column],
    limits: dict[str, float] | None = None,
) -> Column:
    """Rule texts joined by ``"; "`` in the order length, GC, predictions.

    ``predictions`` maps a property name to its prediction column; only the properties
    that have a limit produce text. All limits are strict.
    """
    at = {**INSIGHT_LIMITS, **(limits or {})}
    text = {name: F.lit(words) for name, words in INSIGHT_TEXT.items()}
    parts = []
    if length is not None:
        parts.append(
            F.when(length > at["long_length"], text["long"]).when(
                length < at["short_length"], text["short"]
            )
        )
    if gc is not None:
        parts.append(
            F.when(gc > at["high_gc"], text["high_gc"]).when(gc < at["low_gc"], text["low_gc"])
        )
    for name, value in predictions.items():
        if name in ("yield", "dsRNA_percent", "expression"):
            # Spark orders NaN above every number, so it is excluded by hand.
            over = (value > at[name]) & ~F.isnan(value.cast("double"))
            parts.append(F.when(over, text[name]))
    if not parts:
        return text["none"]
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", text["none"]).otherwise(joined)
