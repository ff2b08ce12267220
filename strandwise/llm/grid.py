"""A stated set of queries against all rows, cell by cell: what operators 11 and 13 share.

Queries fall into blocks that a task can hold, rows into blocks that a task streams; a cell is
a block of each. Every row goes once to each block of queries, every query once to each block
of rows, and the partition of a cell is its number, so that two cells never meet in a task. In
a cell the queries come first, then its rows in batches: memory is one block of queries and one
tile of scores, however many rows there are. Vectors of different length never meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import store

#: Queries a task holds at once, and columns of a tile of scores.
QUERY_BLOCK, TILE = 4096, 512
#: Rows that a cell streams at least, where there are enough tasks, and at most.
LEAST_ROWS, MOST_ROWS = 2048, 1 << 22
#: After every entry: what fills a list that isn't full.
ENTRY = np.dtype([("order", "f8"), ("missing", "?"), ("id", "i8"), ("row", "i8")])
ENTRY_LONG = np.dtype([("order", "i8"), ("missing", "?"), ("id", "i8"), ("row", "i8")])
_LAST = np.iinfo(np.int64).max


def finite(vector: str) -> Column:
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    limit = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def numbered(vectors: DataFrame, key: str, vector: str, sound: Column | None = None, **more: Column) -> DataFrame:
    """(row, id, vector, dim, more) of the usable rows, stored, so that row numbers stay."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vector"), *(c.alias(n) for n, c in more.items()))
    rows = rows.filter(finite("vector") if sound is None else finite("vector") & sound)
    return store(rows.select(F.monotonically_increasing_id().alias("row"), "*", F.size("vector").alias("dim")), "rows")


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in double precision."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an integer column and where they are missing."""
    return np.asarray(column.fill_null(0)).astype(np.int64), np.asarray(column.is_null())


class Best:
    """The ``k`` least entries per query by (order, missing id, id, row): bounded lists."""

    def __init__(self, queries: int, k: int, entry: np.dtype):
        self.k = k
        self.held = np.zeros((queries, k), entry)
        last = np.inf if entry is ENTRY else _LAST
        self.held["order"], self.held["missing"], self.held["id"], self.held["row"] = last, True, _LAST, _LAST

    def limit(self) -> np.ndarray:
        """Per query the order that a new entry must not exceed."""
        return self.held["order"][:, -1]

    def add(self, query: np.ndarray, order: np.ndarray, missing: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        if not len(query):
            return
        touched, to = np.unique(query, return_inverse=True)
        new = np.empty(len(query), self.held.dtype)
        new["order"], new["missing"], new["id"], new["row"] = order, missing, ident, row
        entries = np.concatenate([self.held[touched].ravel(), new])
        owner = np.concatenate([np.repeat(np.arange(len(touched)), self.k), to])
        sort = np.lexsort((entries["row"], entries["id"], entries["missing"], entries["order"], owner))
        owner = owner[sort]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(touched)))[owner]
        self.held[touched] = entries[sort][place < self.k].reshape(len(touched), self.k)

    def found(self) -> np.ndarray:
        """Which entries are real."""
        return self.held["row"] != _LAST


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """((cell, dim), side, rows) for every stretch of a sorted batch."""
    cell, dim, side = (np.asarray(batch.column(c)) for c in ("cell", "dim", "side"))
    changed = (np.diff(cell) != 0) | (np.diff(dim) != 0) | (np.diff(side) != 0)
    cuts = [0, *(np.flatnonzero(changed) + 1), len(cell)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (int(cell[a]), int(dim[a])), int(side[a]), batch.slice(a, b - a)


def meet(queries: DataFrame, rows: DataFrame, kernel: Callable, schema: str, query_block: int = QUERY_BLOCK, row_block: int = MOST_ROWS) -> DataFrame:
    """What ``kernel`` returns for every cell.

    Both tables have (row, id, vector, dim) and the same further columns. ``kernel(table)``
    gets a cell's queries; its ``feed(batch)`` each batch of the cell's rows, its ``finish()``
    gives a record batch of ``schema`` or None.
    """
    spark = rows.sparkSession
    wanted = 2 * spark.sparkContext.defaultParallelism
    held, streamed = queries.count(), rows.count()
    a = max(1, math.ceil(held / query_block))
    b = max(1, min(math.ceil(wanted / a), math.ceil(streamed / LEAST_ROWS)), math.ceil(streamed / row_block))
    dealt = F.pmod(F.xxhash64("row"), F.lit(a)).cast("int")
    left = queries.select("*", F.lit(0).alias("side"), F.explode(F.sequence(dealt * b, dealt * b + (b - 1))).alias("cell"))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(b)).cast("int")
    right = rows.select("*", F.lit(1).alias("side"), F.explode(F.sequence(block, block + (a - 1) * b, F.lit(b))).alias("cell"))
    sent = left.unionByName(right).repartitionById(a * b, "cell").sortWithinPartitions("cell", "dim", "side")

    def run(items):
        at, first, state = None, [], None
        for batch in items:
            for place, side, part in _parts(batch):
                if place != at:
                    if state is not None and (out := state.finish()) is not None:
                        yield out
                    at, first, state = place, [], None
                if side == 0:
                    first.append(part)
                    continue
                if state is None and first:
                    state, first = kernel(pa.Table.from_batches(first).combine_chunks()), []
                if state is not None:
                    state.feed(part)
        if state is not None and (out := state.finish()) is not None:
            yield out

    return sent.mapInArrow(run, schema)
