"""Counters over dot-bracket strings: one regular expression each, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _count(structure: Column | str, pattern: str) -> Column:
    s = F.col(structure) if isinstance(structure, str) else structure
    return F.regexp_count(s, F.lit(pattern)).cast("bigint")


def hairpin_count(structure: Column | str) -> Column:
    """Innermost pairs that enclose at least three unpaired positions."""
    return _count(structure, r"\(\.{3,}\)")


def stem_count(structure: Column | str) -> Column:
    """Maximal runs of brackets; a run that starts on the last character does not count."""
    return _count(structure, r"(?<![()])[()](?=.)")


def bulge_count(structure: Column | str) -> Column:
    """Runs of 1 to 10 dots with a bracket on both sides."""
    return _count(structure, r"(?<=[()])\.{1,10}(?=[()])")


def loop_count(structure: Column | str) -> Column:
    """Maximal runs of dots, dangling ends included."""
    return _count(structure, r"\.+")


def normalised_energy(mfe: Column, length: Column) -> Column:
    return F.try_divide(mfe, length.cast("double"))
