"""Standardise and project embeddings with Spark ML's PCA."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.wide_pca import WidePCA

# Up to here PCA forms a d x d matrix of doubles on the driver (128 MB); beyond, the memory of
# ``wide_pca`` grows with d times the components.
MAX_DIMENSION = 4096
SHAPE = "n bigint, d int"


class EmbeddingReducer:
    """``fit`` returns a fitted copy; ``transform`` gives (key, reduced array<double>)."""

    def __init__(self, n_components: int = 128, method: str = "pca"):
        if method != "pca":
            raise ValueError(f"Unknown method: {method}. Use 'pca'")
        self.method, self.n_components = method, n_components
        self.model: PipelineModel | None = None
        self.wide: WidePCA | None = None
        self.input_shape: tuple[int, int] | None = None

    @staticmethod
    def _vectors(df: DataFrame, vector: str) -> DataFrame:
        present = df.where(F.col(vector).isNotNull())
        return present.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))

    def fit(self, df: DataFrame, vector: str = "embedding") -> EmbeddingReducer:
        sizes = df.where(F.col(vector).isNotNull()).agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.size(vector)).alias("low"),
            F.max(F.size(vector)).alias("high"),
        )
        row = sizes.first()
        if row["n"] < 2 or row["low"] != row["high"]:
            raise ValueError("PCA needs at least two embeddings, all of one length")
        fitted = EmbeddingReducer(min(self.n_components, row["n"], row["high"]), self.method)
        fitted.input_shape = (row["n"], row["high"])
        if row["high"] > MAX_DIMENSION:
            fitted.wide = WidePCA.fit(df.where(F.col(vector).isNotNull()), fitted.n_components, vector)
            return fitted
        stages = [
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            PCA(k=fitted.n_components, inputCol="_scaled", outputCol="_reduced"),
        ]
        fitted.model = Pipeline(stages=stages).fit(self._vectors(df.select(vector), vector))
        return fitted

    def _check_fitted(self) -> PipelineModel:
        if self.model is None:
            raise ValueError("Must fit reducer before transforming")
        return self.model

    def transform(self, df: DataFrame, key: str = "seq_id", vector: str = "embedding") -> DataFrame:
        """Rows without an embedding are left out; their status stays with the input."""
        if self.wide is not None:
            return self.wide.transform(df.where(F.col(vector).isNotNull()), key, vector)
        model = self._check_fitted()
        reduced = model.transform(self._vectors(df.select(key, vector), vector))
        return reduced.select(key, vector_to_array("_reduced").alias("reduced"))

    @property
    def feature_names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.n_components)]

    def expand(self, reduced: DataFrame, key: str = "seq_id") -> DataFrame:
        """(key, PC1 .. PCk) for output."""
        return reduced.select(
            key, *[F.col("reduced")[i].alias(n) for i, n in enumerate(self.feature_names)]
        )

    @property
    def explained_variance_ratio(self) -> list[float]:
        if self.wide is not None:
            return self.wide.ratios.tolist()
        return [float(x) for x in self._check_fitted().stages[1].explainedVariance]

    def statistics(self, spark: SparkSession) -> DataFrame:
        """One row: shapes, method, ratios and their total."""
        ratios = self.explained_variance_ratio
        n, d = self.input_shape or (None, None)
        row = (self.method, n, d, self.n_components, ratios, sum(ratios))
        return spark.createDataFrame(
            [row],
            "reduction_method string, n_rows bigint, raw_dimension int, n_components int, "
            "explained_variance_ratio array<double>, total_explained_variance double",
        )

    def save(self, path: str) -> None:
        if self.wide is not None:
            self.wide.save(f"{path}/wide")
        else:
            self._check_fitted().write().overwrite().save(path)
        spark = SparkSession.active()
        shape = spark.createDataFrame([self.input_shape or (None, None)], SHAPE)
        shape.coalesce(1).write.mode("overwrite").parquet(f"{path}/input_shape")

    @staticmethod
    def load(path: str) -> EmbeddingReducer:
        shape = SparkSession.active().read.schema(SHAPE).parquet(f"{path}/input_shape").first()
        if shape["d"] is not None and shape["d"] > MAX_DIMENSION:
            wide = WidePCA.load(f"{path}/wide")
            loaded = EmbeddingReducer(len(wide.ratios))
            loaded.wide = wide
        else:
            model = PipelineModel.load(path)
            loaded = EmbeddingReducer(model.stages[1].getK())
            loaded.model = model
        loaded.input_shape = None if shape["n"] is None else (shape["n"], shape["d"])
        return loaded
