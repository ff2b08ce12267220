"""PCA of vectors with very many dimensions: a randomised range finder on distributed rows.

The rows, standardised on the way, meet a d x l basis (l a few more than the components). In one
pass each partition multiplies its rows with the basis, keeps the triangle R of a QR of the
products, and adds up what the products pull back from the rows (d x l). Triangles of two
partitions are stacked and factored again, so that a tree of small QRs gives the R of all rows;
no row-sized matrix leaves a partition. A few passes turn the basis towards the leading
directions; the last one gives the components by an SVD of l rows.

Driver and tasks hold d x l numbers, never d x d: 100,000 dimensions and 128 components are
115 MB. The start of the basis is a function of a seed, and signs are fixed, so that results
depend on the rows alone (to rounding).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.session import arrow_rows, settle

#: Directions beyond the components, and passes that turn the basis.
MORE, TURNS = 16, 4
_PIECE = 512


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _PIECE):
            part = batch.column(0).slice(at, _PIECE)
            yield np.asarray(part.flatten(), np.float64).reshape(len(part), d)


def _merged(parts: DataFrame, merge) -> list[np.ndarray]:
    """A tree of pairwise merges over one row of arrays per partition."""
    depth = 2 if parts.rdd.getNumPartitions() <= 1024 else 3
    return parts.rdd.map(lambda r: [np.frombuffer(x, np.float64) for x in r]).treeReduce(merge, depth)


def _moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample deviations); partitions are merged by their means."""

    def run(batches):
        n, mean, square = 0, np.zeros(d), np.zeros(d)
        for x in _pieces(batches, d):
            n, mean, square = join((n, mean, square), (len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)))
        yield pa.RecordBatch.from_arrays([pa.array([np.float64(n).tobytes()]), pa.array([mean.tobytes()]), pa.array([square.tobytes()])], ["n", "mean", "square"])

    def join(a, b):
        n = a[0] + b[0]
        if n == 0:
            return a
        gap = b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap * gap * (a[0] * b[0] / n)

    n, mean, square = _merged(rows.mapInArrow(run, "n binary, mean binary, square binary"), join)
    return int(np.ravel(n)[0]), mean, np.sqrt(square / max(np.ravel(n)[0] - 1, 1))


class WidePCA:
    """Means, scales and components; ``ratios`` are shares of the whole variance."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, components: np.ndarray, ratios: np.ndarray):
        self.mean, self.scale, self.components, self.ratios = mean, scale, components, ratios

    @staticmethod
    def fit(df: DataFrame, k: int, vector: str = "embedding", seed: int = 42) -> WidePCA:
        """``k`` components of vectors of one length; constant dimensions count as 0."""
        rows = df.select(F.col(vector).cast("array<double>").alias("x"))
        d = rows.select(F.size("x").alias("d")).first()["d"]
        with arrow_rows(df.sparkSession, 8 * d):
            return WidePCA._fit(rows, d, k, seed)

    @staticmethod
    def _fit(rows: DataFrame, d: int, k: int, seed: int) -> WidePCA:
        n, mean, deviation = _moments(rows, d)
        scale = np.divide(1.0, deviation, out=np.zeros(d), where=deviation > 0)
        width = min(k + MORE, n, d)
        basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, width)))[0]
        for turn in range(TURNS + 1):
            triangle, pulled = _pass(rows, mean, scale, basis)
            # Rows = Q R with R from the tree: Q^T Z = R^-T (Y^T Z), without Q itself.
            small = np.linalg.lstsq(triangle.T, pulled.T, rcond=None)[0]
            if turn < TURNS:
                basis = np.linalg.qr(small.T)[0]
        _, values, rotated = np.linalg.svd(small, full_matrices=False)
        whole = (scale > 0).sum() * (n - 1)
        ratios = values[:k] ** 2 / whole if whole else np.zeros(k)
        signs = np.sign(rotated[np.arange(len(rotated)), np.abs(rotated).argmax(axis=1)])
        components = (rotated * signs[:, None])[:k]
        return WidePCA(mean, scale, components, ratios)

    def transform(self, df: DataFrame, key: str, vector: str) -> DataFrame:
        """(key, reduced array<double>), written: wide rows go to Python in batches of few bytes."""
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.scale, self.components))

        @F.arrow_udf("array<double>")
        def reduced(x: pa.Array) -> pa.Array:
            mean, scale, components = shared.value
            parts = [np.zeros((0, len(components)))]
            for at in range(0, len(x), _PIECE):
                part = x.slice(at, _PIECE)
                values = np.asarray(part.flatten(), np.float64).reshape(len(part), len(mean))
                parts.append((values - mean) * scale @ components.T)
            out = np.concatenate(parts)
            return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))

        with arrow_rows(df.sparkSession, 8 * len(self.mean)):
            return settle(df.select(key, reduced(F.col(vector).cast("array<double>")).alias("reduced")))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        rows = [("mean", 0, self.mean.tolist()), ("scale", 0, self.scale.tolist()), ("ratios", 0, self.ratios.tolist())]
        rows += [("component", i, c.tolist()) for i, c in enumerate(self.components)]
        spark.createDataFrame(rows, "part string, pos int, numbers array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> WidePCA:
        rows = SparkSession.active().read.parquet(path).collect()
        one = {r["part"]: np.array(r["numbers"]) for r in rows if r["part"] != "component"}
        components = [np.array(r["numbers"]) for r in sorted(rows, key=lambda r: r["pos"]) if r["part"] == "component"]
        return WidePCA(one["mean"], one["scale"], np.array(components), one["ratios"])


def _pass(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R of all rows' products with the basis, the products pulled back: d x l)"""
    d, width = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast((mean, scale, basis))

    def run(batches):
        mean, scale, basis = shared.value
        triangle, pulled = np.zeros((0, width)), np.zeros((d, width))
        for x in _pieces(batches, d):
            z = (x - mean) * scale
            y = z @ basis
            triangle = np.linalg.qr(np.concatenate([triangle, y]), mode="r")
            pulled += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([triangle.tobytes()]), pa.array([pulled.tobytes()])], ["triangle", "pulled"])

    def join(a, b):
        both = np.concatenate([np.asarray(t).reshape(-1, width) for t in (a[0], b[0])])
        return [np.linalg.qr(both, mode="r") if len(both) else both, np.asarray(a[1]) + np.asarray(b[1])]

    triangle, pulled = _merged(rows.mapInArrow(run, "triangle binary, pulled binary"), join)
    shared.unpersist()
    return np.asarray(triangle).reshape(-1, width), np.asarray(pulled).reshape(d, width)
