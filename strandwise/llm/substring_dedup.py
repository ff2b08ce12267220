"""Operator 2: substring dedup by relative Lempel-Ziv parsing.

Documents are parsed against all documents with a smaller key: a factor is a stretch of at
least ``width`` words that also stands in one of them, with the place where it stands there.

1. Documents are dealt to packs of about ``pack_bytes``. Each window of ``width`` words has an
   anchor: the least hash among its shorter word sequences. Equal windows have equal anchors,
   wherever they stand, and neighbouring windows mostly share one. A pack reports each of its
   anchors once; an anchor of a single document is no duplicate and goes no further.
2. The windows at anchors seen more than once, without those their own pack has earlier, are
   sent to the anchor's block as phrases: runs of windows with one anchor. The blocks, dealt by
   anchor, are the reference, and each holds all windows of its anchors, so that parsing against
   the blocks of a document's anchors is parsing against every block. In a block a phrase is
   factored greedily: from its first window on the longest run that continues at one place of
   an earlier document is a factor, the next one starts where it ends.
3. Back at its pack a factor's last windows may continue in a factor of another block, or in
   one found within the pack: at each factor boundary it is checked whether the next factor
   goes on in the same document at the same place, and if so they are one. The words that
   factors cover are removed.

A window is judged on the input by the smallest key it stands in, as a word sequence of equal
64-bit hash. A pack sends a repeated passage once and an anchor once, however many of its rows
have it, so that a hot passage costs a row per pack, and blocks are streamed.

Null texts have no words. Rows with a repeated key are one document's parts: they do not remove
each other's words, and each has its own result. Null keys come before all others and never
lose words to each other. Texts are whole, of any length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import Words, giving_back, partitions

_NO_KEY = -(1 << 63)
FACTORS = "row long, start int, length int, ref_doc long, ref_start int"


class Pack:
    """The windows of a pack's documents, in order of key."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        keys = table.column("key").to_numpy()
        by = np.argsort(keys, kind="stable")
        table = table.take(pa.array(by))
        texts = pa.concat_arrays(table.column("text").cast(pa.large_binary()).chunks or [pa.array([], pa.large_binary())])
        self.table = table
        self.keys, self.rows = keys[by], table.column("row").to_numpy()
        self.words = Words(texts)
        windows, whole = self.words.grams(width), self.words.complete(width)
        self.at = np.flatnonzero(whole)  # the first word of each window
        self.windows = windows[self.at]
        self.doc = self.words.doc[self.at]
        self.key = self.keys[self.doc]
        short = self.words.grams(gram)
        least = short[: len(windows)].copy()
        place = np.zeros(len(least), np.int8)
        other = smaller = None
        for i in range(1, width - gram + 1):
            other = short[i : i + len(least)]
            smaller = other < least
            least[smaller] = other[smaller]
            place[smaller] = i
        self.anchors = least[self.at]
        self.anchor_at = self.at + place[self.at]
        del windows, whole, short, least, place, other, smaller
        # Of equal windows in the pack, the first in order of key.
        order = np.argsort(self.windows, kind="stable")
        sorted_windows = self.windows[order]
        begins = np.flatnonzero(np.r_[True, sorted_windows[1:] != sorted_windows[:-1]]) if len(order) else order
        self.earliest = np.empty(len(order), np.int64)
        self.earliest[order] = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))

    def place(self, windows: np.ndarray) -> np.ndarray:
        """The word number of windows in their text."""
        return self.at[windows] - self.words.first[self.doc[windows]]


def _anchors(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(anchor, pack, repeated) once per anchor and pack; ``repeated``: in several documents."""

    def run(key, table):
        pack = Pack(table, width, gram)
        order = np.lexsort((pack.key, pack.anchors))
        anchors, keys = pack.anchors[order], pack.key[order]
        begins = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(order) else order
        ends = np.r_[begins[1:], len(order)] - 1 if len(order) else order
        repeated = keys[begins] != keys[ends]
        return pa.table(
            {
                "anchor": pa.array(anchors[begins].view(np.int64)),
                "pack": pa.array(np.full(len(begins), key[0].as_py()), pa.int64()),
                "repeated": pa.array(repeated, pa.bool_()),
            }
        )

    return rows.groupBy("pack").applyInArrow(giving_back(run), "anchor long, pack long, repeated boolean")


def _shared(anchors: DataFrame) -> DataFrame:
    """(pack, anchor) of anchors that more than one document has; input sorted by anchor."""

    def emit(anchor, pack, repeated, low, high):
        at = np.arange(low, high)
        same = np.zeros(len(anchor) + 1, bool)
        same[1:-1] = anchor[1:] == anchor[:-1]
        # Anchors in two packs, or in two documents of their only pack.
        keep = at[same[at] | same[at + 1] | repeated[at]]
        return pa.RecordBatch.from_arrays([pa.array(pack[keep]), pa.array(anchor[keep])], ["pack", "anchor"])

    def run(items):
        held, done = None, 0
        for batch in items:
            if not batch.num_rows:
                continue
            x = [np.asarray(batch.column(i)) for i in range(3)]
            if held is not None:
                x = [np.concatenate(pair) for pair in zip(held, x)]
            last = len(x[0]) - 1
            yield emit(*x, done, last)
            held, done = [c[max(last - 1, 0) :] for c in x], min(last, 1)
        if held is not None:
            yield emit(*held, done, len(held[0]))

    return anchors.mapInArrow(run, "pack long, anchor long")


def _phrases(rows: DataFrame, shared: DataFrame, width: int, gram: int) -> DataFrame:
    """Runs of a pack's windows at shared anchors: (anchor, pack, key, row, start, windows)."""

    def run(key, left, right):
        pack = Pack(left, width, gram)
        known = np.sort(right.column("anchor").to_numpy().view(np.uint64))
        at = np.minimum(np.searchsorted(known, pack.anchors), max(len(known) - 1, 0))
        wanted = known[at] == pack.anchors if len(known) else np.zeros(len(pack.anchors), bool)
        # A window that an earlier row of the pack has is settled there.
        wanted &= pack.earliest == np.arange(len(pack.earliest))
        chosen = np.flatnonzero(wanted)
        new = np.ones(len(chosen), bool)
        new[1:] = (np.diff(chosen) != 1) | (np.diff(pack.anchor_at[chosen]) != 0) | (np.diff(pack.doc[chosen]) != 0)
        begins = np.flatnonzero(new)
        first = chosen[begins]
        bounds = np.r_[begins, len(chosen)] * 8
        blob = pa.Array.from_buffers(
            pa.binary(), len(begins), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(pack.windows[chosen].tobytes())]
        )
        return pa.table(
            {
                "anchor": pa.array(pack.anchors[first].view(np.int64)),
                "pack": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
                "key": pa.array(pack.key[first]),
                "row": pa.array(pack.rows[pack.doc[first]]),
                "start": pa.array(pack.place(first).astype(np.int32)),
                "windows": blob,
            }
        )

    schema = "anchor long, pack long, key long, row long, start int, windows binary"
    return rows.groupBy("pack").cogroup(shared.groupBy("target")).applyInArrow(giving_back(run), schema)


def _factors(phrases: DataFrame, width: int) -> DataFrame:
    """Factors of phrases sorted by (anchor, key, row): (pack, FACTORS)."""
    names = ["pack", "row", "start", "length", "ref_doc", "ref_start"]

    def run(items):
        anchor = None
        reference: dict[int, tuple[int, int]] = {}  # window to its first (key, start)
        for batch in items:
            out: list[tuple] = []
            blobs = batch.column(5).to_pylist()
            for a, pack, key, row, start, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), blobs):
                if a != anchor:
                    anchor, reference = a, {}
                windows = np.frombuffer(blob, np.uint64).tolist()
                # Greedy: a factor goes on as long as the same document goes on at the next place.
                begin, place = 0, None
                for i, w in enumerate([*windows, None]):
                    found = reference.setdefault(w, (key, start + i)) if w is not None else None
                    if found is not None and found[0] == key:
                        found = None  # first seen in this document
                    if place is not None and (found is None or found != (place[0], place[1] + i - begin)):
                        out.append((pack, row, start + begin, i - begin + width - 1, *place))
                        place = None
                    if place is None and found is not None:
                        begin, place = i, found
            columns = zip(*out) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return phrases.mapInArrow(run, f"pack long, {FACTORS}")


def _join(pack: Pack, factors: pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """All factors of a pack, (row place, start, length, ref key, ref start), joined at their
    boundaries. Windows whose first place in the pack another document refers to do so as well.
    """
    size = len(pack.windows)
    ref, ref_at = np.full(size, _NO_KEY), np.zeros(size, np.int64)
    hit = np.zeros(size, bool)
    where = {row: i for i, row in enumerate(pack.rows.tolist())}
    doc = np.array([where[r] for r in factors.column("row").to_pylist()], np.int64)
    start, length = factors.column("start").to_numpy().astype(np.int64), factors.column("length").to_numpy()
    if len(doc):
        count = length - width + 1
        ends = np.cumsum(count)
        run = np.arange(ends[-1]) - np.repeat(ends - count, count)
        at = np.searchsorted(pack.at, np.repeat(pack.words.first[doc] + start, count) + run)
        hit[at] = True
        ref[at] = np.repeat(factors.column("ref_doc").to_numpy(), count)
        ref_at[at] = np.repeat(factors.column("ref_start").to_numpy(), count) + run
    # Within the pack: an equal window of a smaller key, or what that window refers to.
    first = pack.earliest
    own = (pack.key != pack.key[first]) & ~hit[first]
    ref = np.where(hit[first], ref[first], np.where(own, pack.key[first], _NO_KEY))
    ref_at = np.where(hit[first], ref_at[first], np.where(own, pack.place(first), 0))
    chosen = np.flatnonzero(hit[first] | own)
    new = np.ones(len(chosen), bool)
    new[1:] = (
        (np.diff(pack.at[chosen]) != 1)
        | (np.diff(pack.doc[chosen]) != 0)
        | (np.diff(ref[chosen]) != 0)
        | (np.diff(ref_at[chosen]) != 1)
    )
    begins = np.flatnonzero(new)
    lengths = np.diff(np.r_[begins, len(chosen)]) + width - 1
    at = chosen[begins]
    return pack.doc[at], pack.place(at), lengths, ref[at], ref_at[at]


def _packed(docs: DataFrame, key: str, text: str, pack_bytes: int, whole: bool) -> DataFrame:
    """(key, row, text, pack), with ``whole`` and the other columns as c0, c1, ..."""
    names = [c for c in docs.columns if c != text] if whole else []
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{text}`").cast("string").alias("text"),
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
    )
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packs = max(1, -(-total // pack_bytes), partitions(docs.sparkSession))
    return rows.select(
        F.coalesce("key", F.lit(_NO_KEY)).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        "text",
        F.pmod(F.xxhash64("key", "text"), F.lit(packs)).alias("pack"),
        *(f"c{i}" for i in range(len(names))),
    )


def parse(
    docs: DataFrame, width: int = 13, gram: int = 6, pack_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text", whole: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(packed rows, their factors in blocks): see ``factors`` and ``remove``. Nothing is stored
    in between: all passes over the packs are parts of one plan and share one exchange of texts.
    """
    n = partitions(docs.sparkSession)
    rows = _packed(docs, key, text, pack_bytes, whole)
    anchors = _anchors(rows, width, gram).repartition(n, "anchor").sortWithinPartitions("anchor")
    shared = _shared(anchors).select(F.col("pack").alias("target"), "anchor")
    blocks = _phrases(rows, shared, width, gram).repartition(n, "anchor").sortWithinPartitions("anchor", "key", "row", "start")
    return rows, _factors(blocks, width).withColumnRenamed("pack", "target")


def factors(docs: DataFrame, width: int = 13, gram: int = 6, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(key, start, length, ref_doc, ref_start) in words of every factor."""
    rows, found = parse(docs, width, gram, key=key, text=text, **settings)

    def run(_, left, right):
        pack = Pack(left, width, gram)
        doc, start, length, ref, ref_at = _join(pack, right, width)
        return pa.table({"key": pack.keys[doc], "start": start, "length": length, "ref_doc": ref, "ref_start": ref_at})

    out = rows.groupBy("pack").cogroup(found.groupBy("target"))
    return out.applyInArrow(giving_back(run), "key long, start long, length long, ref_doc long, ref_start long").withColumnRenamed("key", key)


def _kept(pack: Pack, right: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, words removed, and the words left joined by one space, of each text of a pack."""
    words = pack.words
    doc, start, length, _, _ = _join(pack, right, width)
    gone = np.zeros(len(words.starts) + 1, np.int64)
    at = words.first[doc] + start
    np.add.at(gone, at, 1)
    np.subtract.at(gone, at + length, 1)
    stays = np.cumsum(gone[:-1]) == 0
    n_words = np.diff(words.first)
    counts = np.r_[0, np.cumsum(stays)]
    n_kept = counts[words.first[1:]] - counts[words.first[:-1]]
    # Kept words with one space behind each, then the texts cut from that.
    begin, size = words.starts[stays], (words.ends - words.starts)[stays]
    ends = np.cumsum(size + 1)
    source = np.repeat(begin - (ends - size - 1), size + 1) + np.arange(ends[-1] if len(ends) else 0)
    flat = words.data[np.minimum(source, len(words.data) - 1)] if len(source) else np.zeros(0, np.uint8)
    flat[ends - 1] = 32
    cut = np.r_[0, ends][np.r_[0, np.cumsum(n_kept)]]
    raw = flat.tobytes()
    return n_words, n_words - n_kept, [raw[a : max(b - 1, a)] for a, b in zip(cut.tolist(), cut[1:].tolist())]


def remove(
    docs: DataFrame, width: int = 13, gram: int = 6, pack_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text", digest: bool = False,
) -> DataFrame:
    """(key, n_words, n_removed, kept) per row: the words left, joined by one space each, or
    with ``digest`` their SHA-256 instead (``kept_sha256``).
    """
    rows, found = parse(docs, width, gram, pack_bytes, key, text)
    name = "kept_sha256" if digest else "kept"

    def run(_, left, right):
        pack = Pack(left, width, gram)
        n_words, n_removed, kept = _kept(pack, right, width)
        value = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode() for k in kept]
        keys = pa.array(pack.keys, mask=pack.keys == _NO_KEY)
        return pa.table({"key": keys, "n_words": n_words, "n_removed": n_removed, name: pa.array(value, pa.string())})

    out = rows.groupBy("pack").cogroup(found.groupBy("target"))
    result = out.applyInArrow(giving_back(run), f"key long, n_words long, n_removed long, {name} string")
    return result.withColumnRenamed("key", key)


def rewrite(
    docs: DataFrame, width: int = 13, gram: int = 6, pack_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``docs``, all columns, with the words left as the text of those that lost some; others
    keep their text as it is. Rows that lost all their words go.
    """
    names = [c for c in docs.columns if c != text]
    rows, found = parse(docs, width, gram, pack_bytes, key, text, whole=True)
    others = [f"c{i}" for i in range(len(names))]

    def run(_, left, right):
        pack = Pack(left, width, gram)
        n_words, n_removed, kept = _kept(pack, right, width)
        old = pack.table.column("text").to_pylist()
        new = [k.decode() if r else t for t, r, k in zip(old, n_removed.tolist(), kept)]
        out = pack.table.select(others).append_column("text", pa.array(new, pa.string()))
        return out.filter(pa.array((n_removed == 0) | (n_removed < n_words)))

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{c} {kinds[n]}" for c, n in zip(others, names)), "text string"])
    out = rows.groupBy("pack").cogroup(found.groupBy("target")).applyInArrow(giving_back(run), schema)
    named = out.toDF(*names, text)
    return named.select(*(F.col(f"`{n}`") for n in docs.columns))
