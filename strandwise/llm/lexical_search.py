"""Operator 12: ranked lexical search over classes of equal bags.

A document's score for an item depends on the counts of the items' terms in it and on its length
class m, nothing else. So a document is restricted to the vocabulary of the items: its bag is the
sorted list of (term number, count) in bytes. Equal bags with equal m are one class: grouped by a
digest and, to be sure, by the bytes themselves. Only classes are scored, each once; of an item's
classes the first by (descending score, least doc_id) are kept, because a document of a later
class always has as many documents before it. The members of these classes then come back by
ascending doc_id.

Texts are read whole, in batches: the bytes between terms become blanks, words are hashed, looked
up in the sorted hashes of the vocabulary and compared byte by byte. Items pass in blocks whose
texts have at most ``block_bytes`` bytes (or one item), which bounds the vocabulary that goes to
the tasks and the table of weights; each block reads the documents once. Scores are sums of
integers below 2**53 in double precision, and of Python integers where they could be larger.

A null text or one without terms counts for nothing. Rows that repeat a doc_id are documents of
their own; a document without an id comes after others of equal score. Each row of the items is
an item; one without terms, or whose terms no document has, gives no rows. Extra columns are
ignored, and empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import Words, batches, plain, store

#: Bytes that are part of a term (digits, letters, all beyond ASCII), and k1, b and
#: the scale of the score as the contract has them.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_PLAIN = np.where(_TERM, np.arange(256), 32).astype(np.uint8)
_PLAIN[65:91] += 32
UNIT = 1_000_000_000
_BATCH = 2 << 20
_BAG = np.dtype([("term", "<u4"), ("count", "<u4")])


def term_words(texts: pa.Array) -> Words:
    """Lower-cased terms of each text as words."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    if not len(texts) or texts.buffers()[2] is None:
        return Words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _PLAIN[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    return Words(pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)]))


class Vocabulary:
    """The terms of some items, by number; found by hash and compared by bytes."""

    def __init__(self, texts: list[str | None]):
        words = term_words(pa.array(texts, pa.large_string()))
        spelled = [words.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
        self.terms = sorted(set(spelled))
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = [Counter(number[t] for t in spelled[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
        hashes = term_words(pa.array(self.terms, pa.large_binary())).hash if self.terms else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.number = hashes[order], order
        self.bytes = np.frombuffer(b"".join(self.terms), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in self.terms])]).astype(np.int64)
        # Terms of equal hash lie next to each other; so many places may hold a word.
        self.most = int(np.unique(self.hash, return_counts=True)[1].max()) if len(hashes) else 0

    def find(self, words: Words) -> np.ndarray:
        """The number of each word's term, -1 for none."""
        out = np.full(len(words.hash), -1)
        place = np.searchsorted(self.hash, words.hash)
        for step in range(self.most):
            at = place + step
            open_ = np.flatnonzero((at < len(self.hash)) & (out < 0))
            open_ = open_[self.hash[at[open_]] == words.hash[open_]]
            term = self.number[at[open_]]
            size = words.ends[open_] - words.starts[open_]
            fit = size == self.starts[term + 1] - self.starts[term]
            open_, term, size = open_[fit], term[fit], size[fit]
            if not len(open_):
                continue
            ends = np.cumsum(size)
            inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
            equal = words.data[inside + np.repeat(words.starts[open_], size)] == self.bytes[inside + np.repeat(self.starts[term], size)]
            whole = np.logical_and.reduceat(equal, ends - size)
            out[open_[whole]] = term[whole]
        return out


def _bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, bag): a document's number of terms and its bag."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(items):
        known = shared.value
        for batch in batches(items, "text", _BATCH):
            words = term_words(batch.column("text"))
            term = known.find(words)
            hit = np.flatnonzero(term >= 0)
            width = max(len(known.terms), 1)
            pairs, counts = np.unique(words.doc[hit] * width + term[hit], return_counts=True)
            bag = np.empty(len(pairs), _BAG)
            bag["term"], bag["count"] = pairs % width, counts
            starts = np.searchsorted(pairs // width, np.arange(batch.num_rows + 1)).astype(np.int32) * _BAG.itemsize
            packed = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(starts), pa.py_buffer(bag.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), packed], ["doc_id", "n", "bag"])

    return docs.mapInArrow(run, "doc_id long, n long, bag binary")


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all bags of a batch."""
    raw = column.to_pylist()
    bag = np.frombuffer(b"".join(raw), _BAG)
    return np.repeat(np.arange(len(raw)), [len(b) // _BAG.itemsize for b in raw]), bag["term"].astype(np.int64), bag["count"].astype(np.int64)


def _document_counts(classes: DataFrame, terms: int) -> DataFrame:
    """(term, df): how many documents hold a term; a partition sends one row per term at most."""

    def run(items):
        total = np.zeros(terms, np.int64)
        for batch in items:
            row, term, _ = _opened(batch.column("bag"))
            np.add.at(total, term, np.asarray(batch.column("members"))[row])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    return classes.select("bag", "members").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Scorer:
    """Scores of classes for the items of a block."""

    def __init__(self, items: list[Counter], weights: np.ndarray):
        self.weights = weights
        self.items = [(np.array(sorted(c), np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for c in items]
        # tf * UNIT div (1000 * tf + 12 * m) stays under a million.
        most = max((int((weights[t] * r).sum()) for t, r in self.items), default=0) * (UNIT // 1000)
        self.exact = most < 2**53

    def scores(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
        """One array of scores per item, over the ``len(m)`` classes."""
        used, place = np.unique(term, return_inverse=True)
        part = self.weights[term] * ((UNIT * count) // (1000 * count + 12 * m[row]))
        table = np.zeros((len(used) + 1, len(m)), np.float64 if self.exact else object)
        table[place, row] = part if self.exact else part.astype(object)
        for terms, times in self.items:
            at = np.searchsorted(used, terms)
            at = np.where((at < len(used)) & (used[np.minimum(at, len(used) - 1)] == terms), at, len(used)) if len(used) else np.zeros(len(terms), np.int64)
            hit = at < len(used)
            if not hit.any():
                yield np.zeros(len(m), np.int64)
            elif self.exact:
                yield (times[hit].astype(np.float64) @ table[at[hit]]).astype(np.int64)
            else:
                yield sum(int(n) * table[i] for n, i in zip(times[hit], at[hit])).astype(np.int64)


def _best_classes(classes: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """(item, class, score, least, unnamed): per partition each item's first ``k`` classes by
    (descending score, least doc_id); none with score 0."""
    shared = classes.sparkSession.sparkContext.broadcast(scorer)
    entry = np.dtype([("score", "i8"), ("unnamed", "?"), ("least", "i8"), ("class", "i8")])

    def run(items):
        own = shared.value
        step = max(1, min(1024, (1 << 23) // max(len(own.weights), 1)))  # the table has 64 MB at most
        best = [np.zeros(0, entry) for _ in own.items]
        for batch in items:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m, least, number = (np.asarray(part.column(c).fill_null(0)) for c in ("m", "least", "class"))
                unnamed = np.asarray(part.column("least").is_null())
                for i, score in enumerate(own.scores(*_opened(part.column("bag")), m)):
                    floor = best[i]["score"][-1] if len(best[i]) == k else 1
                    some = np.flatnonzero(score >= floor)
                    if not len(some):
                        continue
                    new = np.empty(len(some), entry)
                    new["score"], new["unnamed"], new["least"], new["class"] = score[some], unnamed[some], least[some], number[some]
                    both = np.concatenate([best[i], new])
                    best[i] = both[np.lexsort((both["class"], both["least"], both["unnamed"], -both["score"]))[:k]]
        flat = np.concatenate(best) if best else np.zeros(0, entry)
        columns = [np.repeat(np.arange(len(best)), list(map(len, best))).astype(np.int64), flat["class"], flat["score"]]
        arrays = [*map(pa.array, columns), pa.array(flat["least"], mask=flat["unnamed"])]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "class", "score", "least"])

    return classes.select("class", "m", "least", "bag").mapInArrow(run, "item long, class long, score long, least long")


def _first(rows: DataFrame, k: int, by: str | list[str], *order) -> DataFrame:
    """The first ``k`` rows of each ``by``, with their rank; Spark cuts before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def _search(docs: DataFrame, names: list[int | None], texts: list[str | None], k: int) -> DataFrame:
    """The result for one block of items."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(texts)
    bags = store(_bags(docs, vocabulary), "bags")
    size = bags.agg(F.count_if(F.col("n") > 0).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    documents, length = size["N"], max(size["L"], 1)
    # n * N goes beyond 64 bits for very long texts of a very large table.
    m = F.expr(f"75L + CAST(CAST(25L * n AS DECIMAL(19,0)) * CAST({documents}L AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV CAST({length}L AS DECIMAL(19,0))")
    held = bags.filter(F.length("bag") > 0).select("doc_id", "bag", m.cast("long").alias("m"), F.xxhash64("bag").alias("digest"))
    grouped = held.groupBy("digest", "m", "bag").agg(F.count("*").alias("members"), F.min("doc_id").alias("least"))
    classes = store(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = np.zeros(len(vocabulary.terms), np.int64)
    for r in _document_counts(classes, len(vocabulary.terms)).select("term", weight.alias("w")).toLocalIterator():
        weights[r["term"]] = r["w"]
    scorer = Scorer(vocabulary.items, weights)
    best = store(_first(_best_classes(classes, scorer, k), k, "item", F.desc("score"), F.asc_nulls_last("least"), "class").drop("rank"), "best-classes")
    # Members of the chosen classes: of each no more than its first k can be needed, which each
    # task finds before the shuffle. At most k digests for each item of the block go out.
    chosen = classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "digest", "m", "bag")
    near = held.join(F.broadcast(chosen.select("digest").distinct()), "digest", "left_semi")
    members = _first(near, k, ["digest", "m", "bag"], F.asc_nulls_last("doc_id")).drop("rank").join(chosen, ["digest", "m", "bag"]).select("class", "doc_id")
    ranked = _first(best.join(members, "class"), k, "item", F.desc("score"), F.asc_nulls_last("doc_id"))
    listed = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
    return ranked.join(F.broadcast(listed), "item").select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """The items in blocks of at most ``limit`` bytes of text, or one item; the driver holds one
    block at a time."""
    names, texts, size = [], [], 0
    for r in items.toLocalIterator():
        more = len((r["text"] or "").encode()) + 64
        if names and size + more > limit:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(r["item_id"])
        texts.append(r["text"])
        size += more
    if names:
        yield names, texts


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents of highest score above 0."""
    docs, items = plain(docs, doc_id="long", text="string"), plain(items, item_id="long", text="string")
    out = None
    for names, texts in _blocks(items, block_bytes):
        found = store(_search(docs, names, texts, k), "found")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
