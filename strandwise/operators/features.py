"""Structure feature rows and the joins that put features together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions import sequence as sq
from strandwise.functions import structure as st

# The feature columns in output order.
STRUCTURE_FEATURES = (
    "mfe",
    "mfe_normalized",
    "hairpin_count",
    "stem_count",
    "gc_content",
    "sequence_length",
    "bulge_count",
    "loop_count",
)
_WHOLE = ("hairpin_count", "stem_count", "sequence_length", "bulge_count", "loop_count")


def structure_features(
    sequences: DataFrame,
    structures: DataFrame,
    key: str = "seq_id",
    sequence: str = "sequence",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(key, carried columns, 8 features, fold_status), one row per sequence.

    Both sides are reduced to numbers before the join, so neither sequences nor
    dot-bracket strings are shuffled (but for what the caller asks to carry along). Where folding gave nothing (no structure row, or an
    empty or null sequence) all features are 0 and ``fold_status`` says why.
    """
    left = sequences.select(
        key,
        *carry,
        F.col(sequence).isNull().alias("is_null"),
        sq.gc_content(sequence).alias("gc_content"),
        sq.sequence_length(sequence).alias("sequence_length"),
    )
    right = structures.select(
        F.col(key).alias("folded_key"),
        F.col("mfe").cast("double").alias("mfe"),
        st.hairpin_count("dot_bracket").alias("hairpin_count"),
        st.stem_count("dot_bracket").alias("stem_count"),
        st.bulge_count("dot_bracket").alias("bulge_count"),
        st.loop_count("dot_bracket").alias("loop_count"),
    )
    joined = left.join(right, left[key] == right["folded_key"], "left")
    status = (
        F.when(F.col("is_null"), "null_sequence")
        .when(F.col("sequence_length") == 0, "empty_sequence")
        .when(F.col("mfe").isNull() | F.col("loop_count").isNull(), "missing_structure")
        .otherwise("ok")
    )
    found = joined.withColumns(
        {
            "fold_status": status,
            "mfe_normalized": st.normalised_energy(F.col("mfe"), F.col("sequence_length")),
        }
    )
    ok = F.col("fold_status") == "ok"
    return found.select(
        key,
        *carry,
        *[
            F.when(ok, F.col(c))
            .otherwise(F.lit(0).cast("bigint") if c in _WHOLE else F.lit(0.0))
            .alias(c)
            for c in STRUCTURE_FEATURES
        ],
        "fold_status",
    )


def attach(rows: DataFrame, more: DataFrame, key: str = "seq_id", how: str = "inner") -> DataFrame:
    """Equi-join by key; ``more`` must hold a key at most once."""
    return rows.join(more, key, how)
