"""Operator 4: best-fit packing of token sequences in bulk-synchronous steps.

Pieces of at most ``width`` tokens are range-sorted by length into classes, gaps into classes
by what they can still take; there are at most ``width`` of either, however many rows. One step
places all pieces of a class, the longest class first: the sweep finds the smallest gap class
that is long enough, as many gaps as pieces are left take one each, the gaps move to the class
of what remains, and the sweep repeats until the class is placed; pieces without a gap open
the sequences that they fill. Within a class pieces and gaps are told apart by rank, so a step says "ranks a to b
of this length go to sequences s, s + 1, ... at this offset", and no two pieces claim one gap.
This gives the packing that best-fit decreasing gives one by one.

The steps work on class counts that Spark has summed: what the driver holds depends on
``width`` alone. Ranks are exact: each partition numbers its pieces of a length when they are
stored, and a sum over partitions per length gives the first number.

A null text is the empty text, which has the end id alone. Repeated rows are packed each by
itself. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm import bpe
from strandwise.llm.common import batches, plain, store


def plan(counts: dict[int, int], width: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, pieces, first sequence, offset) for so many pieces of each
    length, ordered by length and rank, and the number of sequences.

    A gap class holds ranges of sequences (first, number), oldest first.
    """
    gaps: dict[int, deque] = {}
    order: list[int] = []  # the gap classes that are not empty, ascending
    rows, sequences = [], 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = deque()
                order.insert(bisect_left(order, gap), gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                first, gap = sequences, width
                # As many sequences as the pieces fill, or one for the few that are left.
                n = max(left // (width // length), 1)
                sequences += n
            else:
                gap = order[at]
                first, n = gaps[gap].popleft()
                if n > left:
                    gaps[gap].appendleft((first + left, n - left))
                    n = left
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            rows.append((length, rank, n, first, width - gap))
            put(gap - length, first, n)
            rank, left = rank + n, left - n
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], sequences


def _numbers(items: Iterable[pa.RecordBatch], at: int, width: int) -> Iterator[pa.RecordBatch]:
    """The rows with ``place``: the running number of each piece among those of its length, the
    column ``at``, in this partition.
    """
    seen = np.zeros(width + 1, np.int64)
    for batch in items:
        sizes = np.asarray(batch.column(at)).astype(np.int64)
        by = np.argsort(sizes, kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(sizes[by]) != 0]) if len(by) else by
        run = np.diff(np.r_[begin, len(by)])
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - np.repeat(begin, run) + seen[sizes[by]]
        seen += np.bincount(sizes, minlength=width + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def pack(pieces: DataFrame, width: int, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths are 1 to ``width``."""
    at = pieces.columns.index(length)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return _packed(pieces.mapInArrow(lambda items: _numbers(items, at, width), f"{fields}, place long"), width, length)


def _packed(pieces: DataFrame, width: int, length: str) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` instead of ``place``, the last column."""
    names = pieces.columns[:-1]
    at = names.index(length)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema[:-1])
    numbered = store(pieces.withColumn("part", F.spark_partition_id()), "pieces")
    sizes = numbered.groupBy("part", length).agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r[0]: r[1] for r in numbered.groupBy(length).count().collect()}  # at most width rows
    steps, _ = plan(counts, width)
    shared = pieces.sparkSession.sparkContext.broadcast(steps)

    def place(items):
        steps = shared.value
        span = int(steps[:, 1].max()) + 1 if len(steps) else 1
        keys = steps[:, 0] * span + steps[:, 1]
        for batch in items:
            sizes = np.asarray(batch.column(at)).astype(np.int64)
            rank = np.asarray(batch.column(len(names)))
            # The last step of the length that begins at or before the rank.
            step = steps[np.searchsorted(keys, sizes * span + np.minimum(rank, span - 1), side="right") - 1]
            sequence = step[:, 3] + rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(step[:, 4])],
                [*names, "sequence_id", "offset"],
            )

    ranked = numbered.join(firsts.drop("n"), ["part", length]).select(
        *names, (F.col("first_rank") + F.col("place")).alias("rank")
    )
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


_PIECES = "key long, piece int, start long, length long, ids_crc32 long"


def _cutter(docs: DataFrame, tokenizer: str, width: int, end: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives the pieces of batches (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe.read_file(tokenizer))

    def run(items):
        encoder = bpe.encoder(shared.value)
        for batch in batches(items, "text", 2 << 20):
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), width)):
                    part = ids[start : start + width]
                    rows.append((key, piece, start, len(part), zlib.crc32(part)))
            columns = zip(*rows)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces_of(docs: DataFrame, tokenizer: str, width: int, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): each text's ids and the id ``end``, cut every
    ``width`` ids; shorter texts are one piece.
    """
    rows = plain(docs, **{key: "long", text: "string"}).toDF("key", "text")
    return rows.mapInArrow(_cutter(docs, tokenizer, width, end), _PIECES).withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, tokenizer: str, width: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = _cutter(docs, tokenizer, width, end)
    rows = plain(docs, **{key: "long", text: "string"}).toDF("key", "text")
    # Cut and numbered by one worker: a task with two steps in Python holds two, which stay alive.
    numbered = rows.mapInArrow(lambda items: _numbers(cut(items), 3, width), f"{_PIECES}, place long")
    return _packed(numbered.withColumnRenamed("key", key), width, "length")
