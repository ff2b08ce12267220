"""Operator 11: hard negatives by a secondary-sort shuffle.

A pair of an anchor and another row becomes one packed key of bytes, whose order is (anchor,
descending score, positives before negatives, id). Keys are dealt by anchor and sorted within
their partition by the shuffle; a streaming iterator then sees an anchor's rows from the
highest score down. A positive opens a window that ends at ``low`` per cent of its score; each
negative goes to every window that is open and not full. An anchor is never held: the iterator
keeps at most ``positives`` windows with a count each.

Scores come from the cells of a grid (see ``grid``). A cell sends on only pairs that can be among
the first of something, which loses none: for each anchor its first ``positives`` rows of the same
label, and, once the positives of the whole table are known, the first ``negatives`` rows within
each of their windows. So pairs are shuffled per anchor and block, not per anchor and row.

Components become floor(scale * x); scores are exact integers, those beyond 64 bits count as the
largest or least one. A window whose positive has a negative score is empty.

Rows with a null label or vector, an empty vector, or a null or non-finite component take no
part; vectors of different length never meet. Repeated rows are rows of their own, also those
that repeat an anchor's id. A row without an id is no anchor; as positive or negative it comes
after others of equal score. Extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm import grid
from strandwise.llm.common import partitions, store
from strandwise.llm.grid import ENTRY_LONG, TILE, Best, matrix, whole

#: Big-endian, so that bytes sort like the fields; `below` is the complement of the score.
KEY = np.dtype([("anchor", ">u8"), ("anchor_id", ">u8"), ("below", ">u8"), ("negative", "u1"), ("missing", "u1"), ("id", ">u8"), ("row", ">u8")])
_SIGN = np.uint64(1 << 63)
_KEYS = "anchor long, key binary"
_FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _shift(values: np.ndarray) -> np.ndarray:
    """Signed as unsigned of the same order."""
    return values.astype(np.int64).view(np.uint64) ^ _SIGN


def _back(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.uint64) ^ _SIGN).view(np.int64)


class Anchors:
    """A cell's anchors and exact integer scores against a tile of rows."""

    def __init__(self, table: pa.Table, scale: float):
        self.scale = scale
        self.row, self.id, self.label = (np.asarray(table[c]) for c in ("row", "id", "label"))
        self.vectors = self._whole(matrix(table["vector"].combine_chunks()))
        self.top = np.abs(self.vectors).max(axis=1)
        self.single = self.vectors.astype(np.float32)

    def _whole(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(self.scale * vectors), -1e300, 1e300)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Anchors by rows, 64-bit integers."""
        ints = self._whole(vectors)
        top, dim = np.abs(ints).max(axis=1), ints.shape[1]
        bound = self.top.max() * top.max() * dim
        if bound < 2.0**24:
            return (self.single @ ints.astype(np.float32).T).astype(np.int64)
        if bound < 2.0**53:
            return (self.vectors @ ints.T).astype(np.int64)
        with np.errstate(all="ignore"):
            large = self.top[:, None] * top * dim >= 2.0**53
            out = np.where(large, 0, self.vectors @ ints.T).astype(np.int64)
        for i, j in zip(*np.nonzero(large)):
            exact = sum(int(x) * int(y) for x, y in zip(self.vectors[i], ints[j]))
            out[i, j] = min(max(exact, _LEAST), _MOST)
        return out

    def tiles(self, batch: pa.RecordBatch):
        """(scores, same label, not the anchor itself, ids, missing ids, rows) per tile."""
        rows, labels, (ids, missing) = np.asarray(batch.column("row")), np.asarray(batch.column("label")), whole(batch.column("id"))
        vectors = matrix(batch.column("vector"))
        for at in range(0, len(rows), TILE):
            some = slice(at, at + TILE)
            same = self.label[:, None] == labels[some]
            yield self.scores(vectors[some]), same, self.row[:, None] != rows[some], ids[some], missing[some], rows[some]

    def keys(self, anchor: np.ndarray, entries: np.ndarray, negative: bool) -> pa.RecordBatch:
        out = np.empty(len(entries), KEY)
        out["anchor"], out["anchor_id"] = _shift(self.row[anchor]), _shift(self.id[anchor])
        out["below"], out["negative"], out["missing"] = _shift(entries["order"]), negative, entries["missing"]
        out["id"], out["row"] = _shift(entries["id"]), _shift(entries["row"])
        starts = np.arange(len(out) + 1, dtype=np.int32) * KEY.itemsize
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(starts), pa.py_buffer(out.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(self.row[anchor]), packed], ["anchor", "key"])


class _Positives:
    """A cell: each anchor's first ``k`` rows of its label."""

    def __init__(self, table: pa.Table, k: int, scale: float):
        self.anchors = Anchors(table, scale)
        self.best = Best(len(self.anchors.row), k, ENTRY_LONG)

    def feed(self, batch: pa.RecordBatch) -> None:
        for score, same, other, ids, missing, rows in self.anchors.tiles(batch):
            order = ~score
            q, r = np.nonzero(same & other & (order <= self.best.limit()[:, None]))
            self.best.add(q, order[q, r], missing[r], ids[r], rows[r])

    def finish(self) -> pa.RecordBatch:
        real = self.best.found()
        return self.anchors.keys(np.nonzero(real)[0], self.best.held[real], False)


class _Negatives:
    """A cell: the first ``k`` rows of another label in each window of each anchor."""

    def __init__(self, table: pa.Table, k: int, low: int, scale: float):
        self.anchors, n = Anchors(table, scale), table.num_rows
        lists = table["positive_scores"].to_pylist()
        width = max(map(len, lists))
        # Windows of equal positives are one.
        self.high, self.least = np.full((width, n), _LEAST, np.int64), np.full((width, n), _MOST, np.int64)
        for i, scores in enumerate(lists):
            for w, s in enumerate(sorted(set(scores), reverse=True)):
                if s >= 0:
                    self.high[w, i], self.least[w, i] = s, -(-low * s // 100)
        self.best = [Best(n, k, ENTRY_LONG) for _ in range(width)]

    def feed(self, batch: pa.RecordBatch) -> None:
        for score, same, _, ids, missing, rows in self.anchors.tiles(batch):
            order = ~score
            for high, least, best in zip(self.high, self.least, self.best):
                inside = ~same & (score <= high[:, None]) & (score >= least[:, None]) & (order <= best.limit()[:, None])
                q, r = np.nonzero(inside)
                best.add(q, order[q, r], missing[r], ids[r], rows[r])

    def finish(self) -> pa.RecordBatch:
        real = [b.found() for b in self.best]
        anchor = np.concatenate([np.nonzero(x)[0] for x in real])
        entries = np.concatenate([b.held[x] for b, x in zip(self.best, real)])
        # Windows overlap: a pair goes out once.
        _, first = np.unique(np.stack([anchor, entries["row"]]), axis=1, return_index=True)
        return self.anchors.keys(anchor[first], entries[first], True)


def _sorted(keys: DataFrame) -> DataFrame:
    """Dealt by anchor, in the order of the packed keys."""
    return keys.repartition(partitions(keys.sparkSession), "anchor").sortWithinPartitions("key")


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    """The fields of a batch of keys."""
    return np.frombuffer(b"".join(batch.column("key").to_pylist()), KEY)


def _first(keys: DataFrame, positives: int) -> DataFrame:
    """The first ``positives`` keys of each anchor with their scores."""

    def run(items):
        anchor, seen = None, 0
        for batch in items:
            fields = _unpacked(batch)
            kept = np.zeros(len(fields), bool)
            for i, own in enumerate(fields["anchor"].tolist()):
                seen = seen + 1 if own == anchor else 1
                anchor, kept[i] = own, seen <= positives
            some = batch.filter(pa.array(kept))
            score = ~_back(fields["below"][kept])
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(score)], ["anchor", "key", "score"])

    return _sorted(keys).mapInArrow(run, _KEYS + ", score long")


def _windows(keys: DataFrame, negatives: int, low: int) -> DataFrame:
    """The rows of every window, from the sorted stream."""

    def run(items):
        anchor, windows = None, []
        for batch in items:
            fields, out = _unpacked(batch), []
            decoded = (_back(fields[c]).tolist() for c in ("anchor", "anchor_id", "below", "id"))
            for own, name, below, ident, negative, missing in zip(*decoded, fields["negative"].tolist(), fields["missing"].tolist()):
                if own != anchor:
                    anchor, windows = own, []
                score, ident = ~below, None if missing else ident
                if not negative:
                    windows.append([ident, score, 0])
                    continue
                for window in windows:
                    positive, high, taken = window
                    if taken < negatives and low * high <= 100 * score:
                        window[2] += 1
                        out.append((name, positive, taken + 1, ident, high, score))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return _sorted(keys).mapInArrow(run, _FOUND)


def mine(
    vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, every: int = 100,
    key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    query_block: int = grid.QUERY_BLOCK, row_block: int = grid.MOST_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row
    whose id is divisible by ``every`` and each of its first ``positives`` other rows of the same
    label, the first ``negatives`` rows of another label that score at most as high as the
    positive and at least ``low`` per cent of it."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = grid.numbered(vectors, key, vector, F.col("label").isNotNull(), label=label.cast("long"))
    anchors = rows.filter(F.col("id") % every == 0)
    near = grid.meet(anchors, rows, lambda table: _Positives(table, positives, scale), _KEYS, query_block, row_block)
    first = store(_first(near, positives), "positives")
    scores = first.groupBy("anchor").agg(F.collect_list("score").alias("positive_scores")).withColumnRenamed("anchor", "row")
    asked = anchors.join(scores, "row")
    # The rows have no positives of their own; both sides need the same columns.
    plain = rows.withColumn("positive_scores", F.lit(None).cast("array<long>"))
    against = grid.meet(asked.select(plain.columns), plain, lambda table: _Negatives(table, negatives, low, scale), _KEYS, query_block, row_block)
    return _windows(first.select("anchor", "key").unionByName(against), negatives, low)
