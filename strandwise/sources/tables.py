"""Readers and writers. Outputs are partitioned directories, never one driver-side file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.operators.quality import TARGETS, check_strict, require_columns

REQUIRED = ("sequence", *TARGETS)

# Spellings of a missing value in a CSV field, in text columns as well.
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_LONG = r"^\s*[+-]?\d{1,18}\s*$"
_WHOLE = r"^\s*[+-]?\d{1,38}\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
UNPARSED = "unparsed"


def infer_types(texts: DataFrame, columns: Sequence[str]) -> dict[str, T.DataType]:
    """``bigint``, ``decimal(38,0)``, ``double`` or ``string`` for columns of text, the first
    that holds every value without loss of whole digits, from one aggregate over just these.
    """
    if not columns:
        return {}
    counts = []
    for i, name in enumerate(columns):
        c = F.col(f"`{name}`")
        given = c.isNotNull() & ~F.trim(c).isin(*MISSING_WORDS)
        counts.append(F.count_if(given).alias(f"given_{i}"))
        for kind, pattern in (("long", _LONG), ("whole", _WHOLE), ("number", _NUMBER)):
            counts.append(F.count_if(given & ~c.rlike(pattern)).alias(f"not_{kind}_{i}"))
    row = texts.agg(*counts).first()
    types = {}
    for i, name in enumerate(columns):
        if row[f"not_number_{i}"] or not row[f"given_{i}"]:
            types[name] = T.StringType()
        elif row[f"not_whole_{i}"]:
            types[name] = T.DoubleType()
        else:
            types[name] = T.DecimalType(38, 0) if row[f"not_long_{i}"] else T.LongType()
    return types


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV with a header; nothing is lost on the way.

    Without a schema one pass over all columns but the sequences finds their types; keys that
    are not whole numbers stay text. Targets are numbers: a text in them that is neither a
    number nor a missing word becomes null, and then there is a column ``unparsed`` with the
    row's such texts by column name (null if it has none).
    """
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    texts = reader.csv(path)
    types = infer_types(texts, [c for c in texts.columns if c != "sequence"])
    columns, odd = [], []
    for name in texts.columns:
        c = F.col(f"`{name}`")
        given = F.when(~F.trim(c).isin(*MISSING_WORDS), c)
        kind = types.get(name, T.StringType())
        if name in TARGETS:
            number = F.trim(given).try_cast(T.DoubleType())
            columns.append(number.alias(name))
            if kind == T.StringType():
                odd.append(F.when(given.isNotNull() & number.isNull(), F.struct(F.lit(name).alias("key"), given.alias("value"))))
        elif kind == T.StringType() or name == "seq_id" and kind != T.LongType():
            columns.append(given.alias(name))
        else:
            columns.append(F.trim(given).try_cast(kind).alias(name))
    if odd:
        found = F.filter(F.array(*odd), lambda x: x.isNotNull())
        columns.append(F.when(F.size(found) > 0, F.map_from_entries(found)).alias(UNPARSED))
    return texts.select(*columns)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """``parquet`` or ``csv``: by ``kind``, else CSV when the path ends in ``.csv``. A
    missing path fails at once.
    """
    kind = kind or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind != "parquet":
        raise ValueError(f"unknown kind of table '{kind}'")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def with_key(df: DataFrame, key: str = "seq_id") -> DataFrame:
    """The table with a unique key. A made-up key numbers the rows without a shuffle; it
    holds for one reading only, so store the result before it is joined with anything.
    """
    return df if key in df.columns else df.withColumn(key, F.monotonically_increasing_id())


def load_sequences(
    spark: SparkSession,
    path: str,
    required: Sequence[str] = REQUIRED,
    strict: bool = True,
    schema: T.StructType | str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Read and check: required columns on the schema; with ``strict`` one pass that fails
    on null or invalid sequences, and one that fails on target values that are no numbers.
    """
    df = require_columns(read_table(spark, path, schema, kind), required)
    if strict and UNPARSED in df.columns:
        lost = df.select(F.explode(UNPARSED)).groupBy("key").count().orderBy("key").collect()
        if lost:
            raise ValueError("not a number: " + ", ".join(f"{r['key']} in {r['count']} rows" for r in lost))
        df = df.drop(UNPARSED)
    if strict:
        check_strict(df)
    return df


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_table(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "seq_id") -> str:
    """A catalog table bucketed and sorted by key: tables written with the same number of
    buckets are joined on the key without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return table


def write_embeddings(df: DataFrame, path: str, key: str = "seq_id", vector: str = "embedding") -> str:
    return write_table(df.select(key, F.col(vector).cast("array<float>").alias(vector)), path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def keyed_input(df: DataFrame, path: str, key: str = "seq_id") -> DataFrame:
    """``df`` itself if it has the key, else the table stored at ``path`` with a key."""
    if key in df.columns:
        return df
    return df.sparkSession.read.parquet(write_table(with_key(df, key), path))


def write_sections(sections: dict[str, DataFrame], root: str) -> dict[str, str]:
    """One folder per report section below ``root``; single-row and small tables included."""
    return {name: write_table(df, f"{root}/{name}") for name, df in sections.items()}
