"""Sequence features, covariates and models behind one fit / predict pair."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.operators.boosting import FEATURES, Boosting, MultiTargetModel, fit_targets
from strandwise.operators.covariates import CovariateEncoder
from strandwise.operators.features import STRUCTURE_FEATURES, structure_features
from strandwise.operators.quality import covariate_columns, target_columns
from strandwise.operators.ranking import FACTS, PREFIX, add_sequence_facts
from strandwise.operators.reduce import EmbeddingReducer

META_SCHEMA = (
    "key string, sequence string, targets array<string>, covariates array<string>, "
    "feature_names array<string>, n_components int"
)


@dataclass
class Sources:
    """Tables by key that accompany the rows: folded structures and embeddings."""

    structures: DataFrame
    embeddings: DataFrame | None = None


class SequenceFeaturizer:
    """Reduced embedding and structure features of each sequence."""

    def __init__(self, n_components: int = 128, key: str = "seq_id", sequence: str = "sequence"):
        self.n_components, self.key, self.sequence = n_components, key, sequence
        self.reducer: EmbeddingReducer | None = None
        self.fitted = False

    def fit(self, rows: DataFrame, sources: Sources) -> SequenceFeaturizer:
        if self.sequence not in rows.columns:
            raise ValueError(f"Sequence column '{self.sequence}' not found")
        done = SequenceFeaturizer(self.n_components, self.key, self.sequence)
        if sources.embeddings is not None:
            # Only the rows being fitted may shape the projection.
            own = sources.embeddings.join(rows.select(self.key), self.key, "left_semi")
            done.reducer = EmbeddingReducer(self.n_components).fit(own)
            done.n_components = done.reducer.n_components
        done.fitted = True
        return done

    @property
    def feature_names(self) -> list[str]:
        return [*(self.reducer.feature_names if self.reducer else []), *STRUCTURE_FEATURES]

    def transform(
        self, rows: DataFrame, sources: Sources, carry: Sequence[str] = ()
    ) -> DataFrame:
        """(key, carried columns, values array<double>, fold_status, embed_status), one
        row per input row. Without an embedding the components are zeros, with a status.

        All joins are on the key, so each side is shuffled once (not at all if the tables
        are bucketed by it).
        """
        if not self.fitted:
            raise ValueError("SequenceFeaturizer must be fitted")
        if self.sequence not in rows.columns:
            raise ValueError(f"Sequence column '{self.sequence}' not found")
        facts = structure_features(rows, sources.structures, self.key, self.sequence, carry)
        numbers = F.array(*[F.col(c).cast("double") for c in STRUCTURE_FEATURES])
        if self.reducer is None:
            values, status = numbers, F.lit("unused")
        elif sources.embeddings is None:
            raise ValueError("the featurizer was fitted with embeddings, none were given")
        else:
            reduced = self.reducer.transform(sources.embeddings, self.key)
            facts = facts.join(reduced, self.key, "left")
            zeros = F.array_repeat(F.lit(0.0), self.n_components)
            values = F.concat(F.coalesce("reduced", zeros), numbers)
            status = F.when(F.col("reduced").isNull(), "missing_embedding").otherwise("ok")
        return facts.select(
            self.key, *carry, values.alias("values"), "fold_status", status.alias("embed_status")
        )


class PropertyModel:
    """Features -> covariates -> one boosted model per target."""

    def __init__(
        self,
        n_components: int = 128,
        params: Boosting = Boosting(),
        key: str = "seq_id",
        sequence: str = "sequence",
        unseen: str = "error",
    ):
        self.params, self.key, self.sequence, self.unseen = params, key, sequence, unseen
        self.featurizer = SequenceFeaturizer(n_components, key, sequence)
        self.encoder: CovariateEncoder | None = None
        self.model: MultiTargetModel | None = None
        self.covariates: list[str] = []

    @property
    def fitted(self) -> bool:
        return self.model is not None

    def _check_fitted(self, what: str) -> MultiTargetModel:
        if self.model is None:
            raise ValueError(f"Model must be fitted before {what}")
        return self.model

    @property
    def targets(self) -> list[str]:
        return self._check_fitted("use").targets

    @property
    def feature_names(self) -> list[str]:
        return [*self.featurizer.feature_names, *self.encoder.feature_names]

    def _assemble(self, rows: DataFrame, sources: Sources, carry: Sequence[str]) -> DataFrame:
        """(key, features vector, statuses, carried columns as _carry_0, _carry_1, ..).

        Covariates are encoded on the row before the joins; a missing number is NaN, which
        the trees give a side of its own.
        """
        kept = {f"_carry_{i}": F.col(f"`{c}`") for i, c in enumerate(carry)}
        base = rows.withColumns({**kept, "_text": F.col(f"`{self.sequence}`")})
        encoded = self.encoder.transform(base, [self.key, "_text", *kept])
        names = self.encoder.feature_names
        covariates = (
            F.array(*[F.coalesce(F.col(f"`{n}`"), F.lit(float("nan"))) for n in names])
            if names
            else F.array().cast("array<double>")
        )
        own = encoded.select(
            self.key,
            F.col("_text").alias(self.sequence),
            covariates.alias("_covariates"),
            *kept,
        )
        joined = self.featurizer.transform(own, sources, ["_covariates", *kept])
        return joined.select(
            self.key,
            array_to_vector(F.concat("values", "_covariates")).alias(FEATURES),
            "fold_status",
            "embed_status",
            *kept,
        )

    def assemble(self, rows: DataFrame, sources: Sources, carry: Sequence[str] = ()) -> DataFrame:
        """(key, features vector, fold_status, embed_status, carried columns)"""
        return self._assemble(rows, sources, carry).withColumnsRenamed(
            {f"_carry_{i}": c for i, c in enumerate(carry)}
        )

    def fit(
        self,
        rows: DataFrame,
        sources: Sources,
        targets: Sequence[str] | None = None,
        covariates: Sequence[str] | None = None,
    ) -> PropertyModel:
        targets = list(targets) if targets is not None else target_columns(rows)
        if covariates is None:
            covariates = covariate_columns(rows, targets, (self.key, self.sequence))
        done = PropertyModel(
            self.featurizer.n_components, self.params, self.key, self.sequence, self.unseen
        )
        done.covariates = list(covariates)
        done.featurizer = self.featurizer.fit(rows, sources)
        done.encoder = CovariateEncoder(self.unseen).fit(rows, done.covariates)
        features = done.assemble(rows, sources, targets)
        done.model = fit_targets(features, targets, done.feature_names, self.params)
        return done

    def predict(
        self, rows: DataFrame, sources: Sources, include_features: bool = True
    ) -> DataFrame:
        """Input columns (or the key alone), ``predicted_<target>``, length and GC."""
        model = self._check_fitted("prediction")
        if self.sequence not in rows.columns:
            raise ValueError(f"Sequence column '{self.sequence}' not found")
        facts = add_sequence_facts(rows, self.sequence, recompute=True)
        wanted = rows.columns if include_features else [self.key]
        carry = [c for c in wanted if c != self.key]
        carry += [c for c in FACTS if c not in carry]
        predicted = model.predict(self._assemble(facts, sources, carry))
        back = {c: F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)}
        return predicted.select(
            self.key,
            *[back[c] for c in rows.columns if c in back],
            *[PREFIX + t for t in model.targets],
            *[back[c] for c in back if c not in rows.columns],
        )

    def evaluate(self, rows: DataFrame, sources: Sources) -> DataFrame:
        model = self._check_fitted("evaluation")
        return model.evaluate(self.assemble(rows, sources, model.targets), self.key)

    def score(self, rows: DataFrame, sources: Sources) -> float:
        model = self._check_fitted("evaluation")
        return model.score(self.assemble(rows, sources, model.targets), self.key)

    def importance(self, spark: SparkSession) -> DataFrame:
        return self._check_fitted("importance").importance(spark)

    def save(self, spark: SparkSession, path: str) -> str:
        if self.model is None:
            raise ValueError("Cannot save unfitted model")
        n = self.featurizer.n_components if self.featurizer.reducer else None
        row = (self.key, self.sequence, self.targets, self.covariates, self.feature_names, n)
        meta = spark.createDataFrame([row], META_SCHEMA).coalesce(1)
        if n:
            self.featurizer.reducer.save(f"{path}/reducer")
        self.encoder.save(spark, f"{path}/encoder")
        self.model.save(f"{path}/models")
        # Written last: a folder without it is an unfinished save.
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyModel:
        meta = spark.read.schema(META_SCHEMA).parquet(f"{path}/meta").first()
        loaded = PropertyModel(meta["n_components"] or 128, key=meta["key"], sequence=meta["sequence"])
        loaded.covariates = list(meta["covariates"])
        loaded.encoder = CovariateEncoder.load(spark, f"{path}/encoder")
        if meta["n_components"]:
            loaded.featurizer.reducer = EmbeddingReducer.load(f"{path}/reducer")
        loaded.featurizer.fitted = True
        loaded.model = MultiTargetModel.load(
            f"{path}/models", meta["targets"], meta["feature_names"]
        )
        return loaded
