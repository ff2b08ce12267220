"""What several operators share: tables in the shared folder, words of Arrow columns, digests."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.session import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files: lineage is
    cut, lost executors cost nothing, and later reads see the same rows and columns pruned.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = ensure_checkpoint_dir(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if folder.split("://")[-1].split(":")[-1].lstrip("/").startswith(
            root.split("://")[-1].split(":")[-1].lstrip("/")
        ):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, cast: whatever else the table holds cannot clash."""
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


# Bytes 9 to 13 and 32 separate words; `bytes.split()` and this table agree.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_HASHED = 32_000  # words hashed at once: each of their bytes takes 8 bytes in some five arrays


def _powers(n: int, base: int, name: str) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept and doubled as needed."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        step = base
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step % (1 << 64)
        _POWERS[name] = have
    return have[:n]


class Words:
    """All words of a batch of texts at once.

    ``starts``, ``ends``: byte bounds of each word in ``data``; ``doc``: the row of each
    word; ``first``: per row the number of its first word (length rows + 1); ``hash``: a
    64-bit hash of each word. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if texts.null_count:
            # The bytes under a null, if any, are not part of any text.
            keep = np.repeat(~np.asarray(texts.is_null()), np.diff(offsets))
            sizes = np.where(np.asarray(texts.is_null()), 0, np.diff(offsets))
            data = data[keep]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~_SPACE[data]
        if len(data):
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            cuts = offsets[:-1][np.diff(offsets) > 0]
            begins[cuts] = inside[cuts]  # a text begins a new word whatever comes before it
            self.starts = np.flatnonzero(begins)
            stops = np.zeros(len(data) + 1, bool)
            stops[1:] = inside
            stops[1:-1] &= ~inside[1:] | begins[1:]
            stops = stops[1:]
            self.ends = np.flatnonzero(stops) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        if hashed:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):  # in pieces, so that the powers stay small
            to = min(len(self.starts), at + _HASHED)
            low, high = self.starts[at], self.ends[to - 1]
            up = _powers(high - low, _BASE, "up")
            down = _powers(high - low + 1, _INVERSE, "down")
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTE[self.data[low:high]] * up, out=sums[1:])
            s, e = self.starts[at:to] - low, self.ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; meaningless where the text ends sooner."""
        total = len(self.hash)
        if total < n:
            return np.zeros(0, np.uint64)
        out = np.zeros(total - n + 1, np.uint64)
        for i in range(n):
            out = out * np.uint64(_BASE) + self.hash[i : total - n + 1 + i]
        return mix(out)

    def complete(self, n: int) -> np.ndarray:
        """For each gram, whether all its n words are of one text."""
        if len(self.doc) < n:
            return np.zeros(0, bool)
        return self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]


def batches(items: Iterable[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterable[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or one row. At the end
    unused memory goes back.
    """
    for batch in items:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Unused memory of a worker goes back: it outlives its task and serves the next stage."""
    pa.default_memory_pool().release_unused()
    # What numpy freed: glibc keeps it otherwise. Other C libraries have no such call.
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def giving_back(function: Callable) -> Callable:
    """The function of a group, after which unused memory goes back. It has as many arguments."""

    def one(key, table):
        try:
            return function(key, table)
        finally:
            give_back()

    def two(key, left, right):
        try:
            return function(key, left, right)
        finally:
            give_back()

    return one if function.__code__.co_argcount == 2 else two


def salted(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
