"""The views the queries run on: sequences, structures, assay values, evaluation pairs,
predictions and importances, derived from whole tables by Spark (and by SQL for the oracle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sequences shorter than this have no folded structure, to exercise the missing path.
FOLDED_LENGTH = 40

SQL = {
    "sequences": """
        SELECT doc_id AS seq_id,
               regexp_replace(translate(upper(text), 'T', 'U'), '[^ACGU]', '', 'g') AS sequence
        FROM documents""",
    "structures": f"""
        SELECT seq_id, translate(sequence, 'GCAU', '()..') AS dot_bracket,
               cast(-0.3 AS double) * (length(sequence) - length(replace(sequence, 'G', ''))) AS mfe
        FROM sequences WHERE length(sequence) >= {FOLDED_LENGTH}""",
    "assay": """
        SELECT doc_id AS seq_id,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE cast(n_chars % 101 AS double) / 100 END AS yield_value,
               cast(doc_id % 37 AS double) / 2 AS dsrna_percent,
               cast(n_chars % 211 AS double) / 100 AS expression,
               lang AS enzyme_type,
               37 + (doc_id % 3) * cast(2.5 AS double) AS temperature
        FROM documents""",
    "eval_pairs": """
        SELECT l_returnflag AS target, l_extendedprice AS y_true,
               cast(l_quantity * 1200 AS double) AS y_pred FROM lineitem""",
    "predictions": """
        SELECT seq_id, sequence, yield_value AS predicted_yield,
               dsrna_percent AS "predicted_dsRNA_percent", expression AS predicted_expression
        FROM sequences JOIN assay USING (seq_id)""",
    "importance": """
        SELECT CASE WHEN p = 1 THEN 'mfe' WHEN p = 2 THEN 'gc_content' WHEN p = 3 THEN 'hairpin_count'
                    WHEN p = 4 THEN 'enzyme_type_fr' WHEN p = 5 THEN 'temperature'
                    ELSE concat('PC', cast(p AS varchar)) END AS feature,
               cast(p AS integer) AS feature_pos, concat('t', cast(label AS varchar)) AS target,
               avg(abs(cast(x AS double))) AS importance
        FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS p,
                     unnest(embedding) AS x FROM embeddings) u
        GROUP BY p, label""",
}
NEEDS = {
    "structures": ["sequences"],
    "predictions": ["sequences", "assay"],
}


def with_views(sql: str, *names: str) -> str:
    """``WITH`` clause of the named views (and what they need) in front of ``sql``.

    ``sql`` may start with further comma-separated definitions: mark them with ``WITH``.
    """
    ordered: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    clause = ",\n".join(f"{n} AS ({SQL[n]})" for n in ordered)
    body = sql.strip()
    if body.startswith("WITH "):
        return f"WITH {clause},\n{body[5:]}"
    return f"WITH {clause}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sequence_of(text: str) -> Column:
    return F.regexp_replace(F.translate(F.upper(text), "T", "U"), "[^ACGU]+", "")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("seq_id"), sequence_of("text").alias("sequence")
    )


def structures(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sequence")
    g = F.length(s) - F.length(F.replace(s, F.lit("G"), F.lit("")))
    return (
        sequences(spark, sf)
        .where(F.length(s) >= FOLDED_LENGTH)
        .select(
            "seq_id",
            F.translate(s, "GCAU", "()..").alias("dot_bracket"),
            (F.lit(-0.3) * g).alias("mfe"),
        )
    )


def assay(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        d.alias("seq_id"),
        F.when(d % 17 != 0, (F.col("n_chars") % 101).cast("double") / 100).alias("yield_value"),
        ((d % 37).cast("double") / 2).alias("dsrna_percent"),
        ((F.col("n_chars") % 211).cast("double") / 100).alias("expression"),
        F.col("lang").alias("enzyme_type"),
        (37 + (d % 3) * F.lit(2.5)).alias("temperature"),
    )


def eval_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("target"),
        F.col("l_extendedprice").alias("y_true"),
        (F.col("l_quantity") * 1200).cast("double").alias("y_pred"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    values = assay(spark, sf).select(
        "seq_id",
        F.col("yield_value").alias("predicted_yield"),
        F.col("dsrna_percent").alias("predicted_dsRNA_percent"),
        F.col("expression").alias("predicted_expression"),
    )
    return sequences(spark, sf).join(values, "seq_id")


def importance(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    named = {1: "mfe", 2: "gc_content", 3: "hairpin_count", 4: "enzyme_type_fr", 5: "temperature"}
    feature = F.concat(F.lit("PC"), p.cast("string"))
    for position, name in named.items():
        feature = F.when(p == position, F.lit(name)).otherwise(feature)
    long = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p0", "x"))
    grouped = (
        long.withColumn("p", F.col("p0") + 1)
        .groupBy("p", "label")
        .agg(F.avg(F.abs(F.col("x").cast("double"))).alias("importance"))
    )
    return grouped.select(
        feature.alias("feature"),
        p.alias("feature_pos"),
        F.concat(F.lit("t"), F.col("label").cast("string")).alias("target"),
        "importance",
    )


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double for the comparison (``special``: digits per column)."""
    kinds = dict(df.dtypes)
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), special.get(c, digits)) + F.lit(0.0)).alias(c)
            if kinds[c] == "double"
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def sql_round(columns: str, digits: int = 6, **special: int) -> str:
    """The same rounding for a comma-separated list of SQL columns."""
    names = [c.strip() for c in columns.split(",")]
    return ", ".join(
        f'round("{c}", {special.get(c, digits)}) + 0.0 AS "{c}"' for c in names
    )
