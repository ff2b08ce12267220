"""Operator 13: nearest neighbours by a block matrix join of int8 tiles.

Queries meet all rows in the cells of a grid. There every vector x becomes int8 codes q with
a scale s, and is s*q + e with a residual e whose length is known. A tile of products of codes,
exact integers, gives s_x*s_y*<q_x, q_y>, which is off the inner product by at most
|e_x|*|y| + |s_x*q_x|*|e_y|. A pair whose upper bound is below the k-th best of its query so far,
or below the k-th best lower bound within its first tile, can't be among the k nearest; the
others are computed in double precision, component by component in order. The cells' sorted
lists of a query, one per block of rows, are merged by a heap. The result is exact: nothing is
sampled, and the bounds only spare work.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, neither
do pairs of vectors of different length. Repeated rows are rows of their own: one that repeats a
query's id is a candidate for it, and is a query too. A row without an id is a candidate, after
others of equal score. A product that overflows to no number counts as minus infinity. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import grid
from strandwise.llm.grid import ENTRY, TILE, Best, matrix, whole

#: Products of int8 codes over so many components are exact in single precision.
_CHUNK = 1024
_LISTS = "query long, query_id long, scores array<double>, ids array<long>, rows array<long>"


class Codes:
    """int8 codes of vectors, their scales, and lengths: of the vectors, of what the codes stand
    for, and of the residuals, each rounded up."""

    def __init__(self, vectors: np.ndarray):
        with np.errstate(all="ignore"):
            self.scale = np.abs(vectors).max(axis=1) / 127
            step = np.where(self.scale > 0, self.scale, 1.0)
            codes = np.clip(np.rint(vectors / step[:, None]), -127, 127)
            self.codes = codes.astype(np.int8).astype(np.float32)
            stands = codes * self.scale[:, None]
            up = 1 + 1e-9
            self.size = np.sqrt((vectors * vectors).sum(axis=1)) * up
            self.known = np.sqrt((stands * stands).sum(axis=1)) * up
            self.rest = np.sqrt(((vectors - stands) ** 2).sum(axis=1)) * up + 1e-9 * self.size

    def products(self, other: Codes) -> np.ndarray:
        total = 0.0
        for at in range(0, self.codes.shape[1], _CHUNK):
            total = total + (self.codes[:, at : at + _CHUNK] @ other.codes[:, at : at + _CHUNK].T).astype(np.float64)
        return total


class _Nearest:
    """A cell: its queries' ``k`` best rows so far."""

    def __init__(self, table: pa.Table, k: int):
        self.k = k
        self.row, self.id = np.asarray(table["row"]), np.asarray(table["id"])
        self.vectors = matrix(table["vector"].combine_chunks())
        self.codes = Codes(self.vectors)
        self.best = Best(len(self.row), k, ENTRY)
        self.survived = 0

    def feed(self, batch: pa.RecordBatch) -> None:
        rows, (ids, missing) = np.asarray(batch.column("row")), whole(batch.column("id"))
        vectors = matrix(batch.column("vector"))
        for at in range(0, len(rows), TILE):
            some = slice(at, at + TILE)
            q, r = self._survivors(vectors[some])
            other = self.row[q] != rows[some][r]
            q, r = q[other], r[other]
            self.survived += len(q)
            left, right = self.vectors, vectors[some]
            score = np.zeros(len(q))
            with np.errstate(all="ignore"):
                for j in range(left.shape[1]):
                    score += left[q, j] * right[r, j]
            order = np.where(np.isnan(score), np.inf, -score)
            self.best.add(q, order, missing[some][r], ids[some][r], rows[some][r])

    def _survivors(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine, its = self.codes, Codes(vectors)
        with np.errstate(all="ignore"):
            near = mine.products(its)
            near *= mine.scale[:, None]
            near *= its.scale
            slack = mine.rest[:, None] * its.size
            slack += mine.known[:, None] * its.rest
            least = -self.best.limit()
            if len(vectors) > self.k + 1 and np.isneginf(least).any():
                # One more than k, because a query may meet itself.
                low = np.nan_to_num(near - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                least = np.maximum(least, np.partition(low, -self.k - 1, axis=1)[:, -self.k - 1])
            near += slack
            return np.nonzero(~(near < least[:, None]))

    def finish(self) -> pa.RecordBatch:
        held, real = self.best.held, self.best.found()
        starts = np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)
        flat = held[real]
        lists = [pa.array(-flat["order"]), pa.array(flat["id"], mask=flat["missing"]), pa.array(flat["row"])]
        columns = [pa.array(self.row), pa.array(self.id), *(pa.ListArray.from_arrays(starts, x) for x in lists)]
        return pa.RecordBatch.from_arrays(columns, ["query", "query_id", "scores", "ids", "rows"])


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query's sorted lists."""

    def ranked(entry):
        for score, ident, row in zip(entry["scores"], entry["ids"], entry["rows"]):
            yield -score, ident is None, ident or 0, row

    def run(items):
        for batch in items:
            ids, scores = [], []
            for own in batch.column("lists").to_pylist():
                first = list(islice(heapq.merge(*map(ranked, own)), k))
                ids.append([None if missing else ident for _, missing, ident, _ in first])
                scores.append([0.0 - order for order, *_ in first])
            columns = [batch.column("query_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "ids", "scores"])

    gathered = lists.groupBy("query").agg(F.first("query_id").alias("query_id"), F.collect_list(F.struct("scores", "ids", "rows")).alias("lists"))
    return gathered.select("query_id", "lists").mapInArrow(run, "query_id long, ids array<long>, scores array<double>")


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
    query_block: int = grid.QUERY_BLOCK, row_block: int = grid.MOST_ROWS,
) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` rows of largest inner product with each row
    whose id is divisible by ``every``, the row itself left out."""
    some = F.exists("vector", lambda x: x != 0)
    rows = grid.numbered(vectors, key, vector, some)
    queries = rows.filter(F.col("id") % every == 0)
    found = grid.meet(queries, rows, lambda table: _Nearest(table, k), _LISTS, query_block, row_block)
    merged = _merged(found, k).select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "hit"))
    return merged.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.ids").alias(key), F.col("hit.scores").alias("score"))
