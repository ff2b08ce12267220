"""Model registry, the batch hook that computes embeddings, and pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import sequence as sq

DEFAULT_BATCH = 32
EMBEDDED_SCHEMA = "embedding array<float>, embed_status string"

# Model key, model name, context limit, alphabet.
MODELS = (
    ("dnabert2", "zhihan1996/DNABERT-2-117M", 2048, "dna"),
    ("dnabert2_large", "zhihan1996/DNABERT-2-512M", 2048, "dna"),
    ("evo", "togethercomputer/evo-1-8k-base", 8192, "rna"),
    ("evo2_7b", "arcinstitute/evo2_7b", 1048576, "dna"),
    ("evo2_40b", "arcinstitute/evo2_40b", 1048576, "dna"),
    ("evo2_7b_base", "arcinstitute/evo2_7b_base", 8192, "dna"),
    ("evo2_40b_base", "arcinstitute/evo2_40b_base", 8192, "dna"),
    ("evo2_1b_base", "arcinstitute/evo2_1b_base", 8192, "dna"),
)


def _described(entry: tuple) -> tuple:
    """A model's fields with a sentence made of them."""
    return *entry, f"{entry[3].upper()} input, up to {entry[2]:,} characters of a sequence"


# Builds the model once per partition and returns the function that embeds one batch.
EmbedderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def model_config(key: str) -> dict[str, object]:
    for entry in MODELS:
        if entry[0] == key:
            names = ("key", "name", "max_length", "sequence_type", "description")
            return dict(zip(names, _described(entry)))
    raise ValueError(f"Unknown model key '{key}'. Available: {[m[0] for m in MODELS]}")


def available_models() -> dict[str, str]:
    return {m[0]: _described(m)[4] for m in MODELS}


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [_described(m) for m in MODELS],
        "model string, model_name string, max_length int, sequence_type string, description string",
    )


def model_input(df: DataFrame, model: str, sequence: str = "sequence") -> DataFrame:
    """Adds ``model_sequence``: the model's alphabet, cut to its context limit."""
    config = model_config(model)
    converted = sq.to_alphabet(sequence, config["sequence_type"])
    return df.withColumn("model_sequence", sq.truncate(converted, config["max_length"]))


def model_input_per_row(
    df: DataFrame, model_column: str = "model", sequence: str = "sequence"
) -> DataFrame:
    """As ``model_input`` with the model named in each row (the registry has 8 rows).

    Rows with an unknown model keep a null ``model_sequence``.
    """
    registry = model_table(df.sparkSession).select(
        F.col("model").alias("registered"), "max_length", "sequence_type"
    )
    joined = df.join(F.broadcast(registry), df[model_column] == F.col("registered"), "left")
    text = sq.to_alphabet(sequence, F.col("sequence_type"))
    cut = F.when(F.col("registered").isNotNull(), sq.truncate(text, F.col("max_length")))
    return joined.select(*[df[c] for c in df.columns], cut.alias("model_sequence"))


def embed_sequences(
    df: DataFrame,
    factory: EmbedderFactory,
    key: str = "seq_id",
    text: str = "model_sequence",
    batch_size: int = DEFAULT_BATCH,
) -> DataFrame:
    """(key, embedding, embed_status) through a user-supplied model.

    A batch that fails, and a row without text, gets a null embedding and the reason
    instead of a made-up vector.
    """
    rows = df.select(key, text)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, {EMBEDDED_SCHEMA}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = None
        for whole in batches:
            # One model batch at a time goes in and out, however large the Arrow batch is.
            for start in range(0, len(whole), batch_size):
                pdf = whole.iloc[start : start + batch_size]
                vectors: list = [None] * len(pdf)
                status = ["null_sequence"] * len(pdf)
                chosen = np.flatnonzero(pdf[text].notna().to_numpy())
                try:
                    if len(chosen):
                        embed = embed or factory()
                        matrix = np.asarray(embed(pdf[text].iloc[chosen].tolist()), dtype=np.float32)
                        if matrix.ndim != 2 or len(matrix) != len(chosen):
                            raise ValueError(f"embedder returned shape {matrix.shape}")
                        for i, vector in zip(chosen, matrix):
                            vectors[i], status[i] = vector, "ok"
                except Exception as error:  # the batch is reported, the job goes on
                    for i in chosen:
                        status[i] = f"failed: {type(error).__name__}: {error}"
                yield pd.DataFrame({key: pdf[key], "embedding": vectors, "embed_status": status})

    return rows.mapInPandas(run, schema)


def mean_pool(
    tokens: DataFrame, keys: Sequence[str], vector: str = "embedding", real: str | None = None
) -> DataFrame:
    """(keys, embedding array<double>, n_tokens): mean of the token vectors of each key.

    ``real`` names a boolean column that is false for padding. The mean is a partial
    aggregate, so a key with very many tokens costs one vector per task.
    """
    kept = tokens.where(F.col(vector).isNotNull())
    if real:
        kept = kept.where(F.col(real))
    pooled = kept.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("mean"),
        F.count(F.lit(1)).alias("n_tokens"),
    )
    return pooled.select(*keys, vector_to_array("mean").alias("embedding"), "n_tokens")
