"""Operator 7: Jaccard similarity join of word n-gram sets with a prefix tree.

Every text is a set of n-grams in one global order: n-grams found frequent come last, the
rarer first; others by hash. Any order gives the same links, so the table of frequent ones may
be of bounded size (the ``heavy`` most frequent, 16 bytes each) and is broadcast.

1. Equal sets form one class, numbered in order of its least document and digest: a key that
   repeats with different texts is a member of several classes.
2. Two sets at the similarity share an n-gram among the first n - ceil(s n) + 1 of each. The
   representatives' prefixes are range-sorted by (n-gram, size, class): an n-gram's row
   range may span tasks, so no n-gram is too hot. What nobody shares is dropped.
3. An n-gram belongs to the star of its least class, so that the n-grams of a group of near
   copies mostly have one star, and a set is sent once per star. Stars are bundled into blocks
   of bounded bytes; a star beyond that is dealt to chunks, and two chunks are one block.
4. A block's sets are a trie. Each set walks it, shorter sets first: a path starts from the
   overlap it has in common with the previous path, and a subtree is left as soon as what
   remains of it and of the walking set can't reach the overlap needed. Leaves of the set's own
   component, and those that a parity bound (see ``signatures``) rules out, are not entered.
   Candidates are never listed; a block gives fewer links than it has sets.
5. Components over the links, back to all documents through their class; the class with the
   least number gives a component the key that names it.

Links are complete, but pairs within a class or a component are not listed. Documents without
words (or null) have n_shingles 0 and no links. Repeated rows, also of a key, keep their rows.
A null key can be a member but represents nothing; with null keys alone the component is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import Words, batches, drop_stored, giving_back, mix, partitions, plain, store
from strandwise.llm.components import components
from strandwise.session import arrow_rows

_TOP = np.uint64(1 << 63)
_BATCH = 1 << 20  # bytes of texts a task works on at once: n-grams take some 40 times as much
_ROW = 32 << 10  # bytes that a row counts as when batches go to Python
_SIGNED = 64_000  # numbers whose signatures are made at once, or those of one set


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, and where each text's begin (one more)."""
    words = Words(texts, lower=True)
    whole = words.complete(n)
    grams, doc = words.grams(n)[whole], words.doc[: len(whole)][whole]
    sizes = np.diff(words.first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        # Fewer words: the sequence is one shingle, told from others by its length.
        values = np.empty(len(short), np.uint64)
        for k, i in enumerate(short):
            h = np.uint64(sizes[i])
            for w in words.hash[words.first[i] : words.first[i + 1]]:
                h = mix(np.array([h ^ w], np.uint64))[0]
            values[k] = h
        grams, doc = np.concatenate([grams, values]), np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def rank(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams, ascending, and the place of each in order of frequency."""
    by = np.argsort(grams)
    place = np.empty(len(grams), np.uint64)
    place[np.lexsort((grams, counts))] = np.arange(len(grams), dtype=np.uint64)
    return grams[by], place[by]


def arrange(order: tuple[np.ndarray, np.ndarray], grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of each n-gram in the global order, ascending within each text. Frequent
    n-grams have the highest numbers, by frequency; the others their hash.
    """
    known, place = order
    numbers = grams >> np.uint64(1)
    if len(known):
        at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
        hit = known[at] == numbers
        numbers[hit] = _TOP | place[at[hit]]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return numbers[np.lexsort((numbers, doc))]


def frequent(texts: DataFrame, n: int, percent: int, heavy: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The order from n-grams that at least ``least`` documents have in their prefixes when all
    are ordered by hash: counted over all documents, combined in each batch and task first.
    """

    def run(items):
        for batch in batches(items, "text", _BATCH):
            grams, first = gram_sets(batch.column(0), n)
            numbers = arrange((grams[:0], grams[:0]), grams, first)
            values, counts = np.unique(numbers[_prefix_places(first, percent)[0]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts)], ["gram", "n"])

    counted = texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    table = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(heavy).toArrow()
    return rank(table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy())


def _prefix_places(first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of all texts' prefixes, and where each prefix ends among them."""
    size = np.diff(first)
    length = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
    ends = np.cumsum(length)
    return np.repeat(first[:-1] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0), ends


def _digest(numbers: np.ndarray) -> bytes:
    return hashlib.blake2b(numbers.tobytes(), digest_size=16).digest()


def _prefixes(texts: DataFrame, order, n: int, percent: int) -> DataFrame:
    """(key, content, n, digest, bytes, prefix) per row of (key, text, content)."""

    def run(items):
        for batch in batches(items, "text", _BATCH):
            grams, first = gram_sets(batch.column(1), n)
            numbers = arrange(order.value, grams, first)
            size = np.diff(first)
            at, ends = _prefix_places(first, percent)
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(numbers[at].view(np.int64)))
            digest = pa.array([_digest(numbers[a:b]) for a, b in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size.astype(np.int64)), digest, pc.binary_length(batch.column(1)).cast(pa.int64()), prefix], ["key", "content", "n", "digest", "bytes", "prefix"])

    return texts.select("key", "text", "content").mapInArrow(run, "key long, content long, n long, digest binary, bytes long, prefix array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (token, node), sorted, that are not alone with their token in sight."""

    def emit(x, low, high):
        token, node = x
        at = np.arange(low, high)
        up = np.zeros(len(at), bool)
        up[at > 0] = token[at[at > 0]] == token[at[at > 0] - 1]
        down = np.zeros(len(at), bool)
        inner = at < len(token) - 1
        down[inner] = token[at[inner]] == token[at[inner] + 1]
        # The first and the last row of a task may have their token in another task as well.
        edge = (at == 0) | (at == len(token) - 1)
        keep = at[up | down | edge]
        return pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep])], ["token", "node"])

    def run(items):
        held, done = None, 0
        for batch in items:
            if not batch.num_rows:
                continue
            x = [np.asarray(batch.column(i)) for i in range(2)]
            if held is not None:
                x = [np.concatenate(pair) for pair in zip(held, x)]
            last = len(x[0]) - 1
            yield emit(x, done, last)
            held, done = [c[max(last - 1, 0) :] for c in x], min(last, 1)
        if held is not None:
            yield emit(held, done, len(held[0]))

    return rows.select("token", "node").mapInArrow(run, "token long, node long")


def signatures(numbers: np.ndarray, first: np.ndarray, bits: int = 2048) -> np.ndarray:
    """Per set the parities of how many of its numbers fall on each of ``bits`` places, as rows
    of words. Two signatures differ in no more bits than their sets in numbers: a number of
    both sets changes both.
    """
    out = np.empty((len(first) - 1, bits // 64), np.uint64)
    low = 0
    while low < len(out):  # in pieces: a number takes 8 bytes in each of some six arrays
        high = min(max(int(np.searchsorted(first, first[low] + _SIGNED, side="right")) - 1, low + 1), low + 128, len(out))
        place = (mix(numbers[first[low] : first[high]]) & np.uint64(bits - 1)).astype(np.int64)
        row = np.repeat(np.arange(high - low), np.diff(first[low : high + 1]))
        counts = np.bincount(row * bits + place, minlength=(high - low) * bits)
        out[low:high] = np.packbits((counts & 1).astype(bool)).view(np.uint64).reshape(high - low, -1)
        low = high
    return out


class Trie:
    """Ordered sets as paths from a root; paths are compared in lexicographic order, so that
    what two neighbours have in common is walked once.
    """

    def __init__(self, sets: dict[int, np.ndarray]):
        self.sets = sets
        in_order = sorted(sets, key=lambda i: sets[i].astype(">u8").tobytes())
        self.place = {i: p for p, i in enumerate(in_order)}
        self.visited = 0  # numbers on the paths walked, for measuring

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> int:
        size = min(len(a), len(b))
        differs = a[:size] != b[:size]
        return int(differs.argmax()) if differs.any() else size

    def similar(self, probe: np.ndarray, partners: Iterable[int], percent: int, step: int = 128, linked: Callable[[int], bool] | None = None) -> list[int]:
        """The partners that reach the similarity to the probe, but for those that are
        ``linked`` to it when their turn comes.
        """
        out, path, reached, overlap = [], None, 0, np.zeros(1, np.int64)
        for i in sorted(partners, key=self.place.__getitem__):
            if linked is not None and linked(i):
                continue
            own = self.sets[i]
            need = -(-percent * (len(own) + len(probe)) // (100 + percent))
            # What the walk has seen of the previous path it need not see again.
            shared = 0 if path is None else min(self.common(path, own), reached)
            counts = [overlap[: shared + 1]]
            at, have = shared, int(overlap[shared])
            while at < len(own):
                # What is left of either bounds the overlap of everything below this node.
                left = len(probe) - int(np.searchsorted(probe, own[at]))
                if have + min(len(own) - at, left) < need:
                    break
                part = own[at : at + step]
                hit = np.searchsorted(probe, part)
                hit = probe[np.minimum(hit, len(probe) - 1)] == part
                counts.append(have + np.cumsum(hit))
                at, have = at + len(part), have + int(hit.sum())
                self.visited += len(part)
            if at == len(own) and have >= need:
                out.append(i)
                if linked is not None:
                    linked.join(i)
            path, reached, overlap = own, at, np.concatenate(counts)
        return out


class _Linked:
    """Components of a block's sets as labels; asks and joins for the set that walks."""

    def __init__(self, size: int):
        self.label, self.own = np.arange(size), 0

    def __call__(self, i: int) -> bool:
        return self.label[i] == self.label[self.own]

    def join(self, i: int) -> None:
        self.label[self.label == self.label[i]] = self.label[self.own]


def block_links(sets: list[np.ndarray], chunk: np.ndarray, inside: bool, percent: int) -> list[tuple[int, int]]:
    """Links between the sets, given from the smallest to the largest, that join all that are
    similar: those of one chunk if ``inside``, else those of different chunks.
    """
    size = np.array([len(x) for x in sets])
    sign = signatures(np.concatenate(sets), np.r_[0, np.cumsum(size)])
    trie, linked, found = Trie(dict(enumerate(sets))), _Linked(len(sets)), []
    for i, own in enumerate(sets):
        low = int(np.searchsorted(size, -(-percent * size[i] // 100)))
        need = -(-percent * (size[low:i] + size[i]) // (100 + percent))
        fine = (linked.label[low:i] != linked.label[i]) & ((chunk[low:i] == chunk[i]) == inside)
        at = np.flatnonzero(fine)
        differ = np.bitwise_count(sign[low + at] ^ sign[i]).sum(axis=1, dtype=np.int64)
        at = at[differ <= size[low + at] + size[i] - 2 * need[at]]
        linked.own = i
        found += [(j, i) for j in trie.similar(own, (low + at).tolist(), percent, linked=linked)]
    return found


def _links(shared: DataFrame, rows: DataFrame, chosen: DataFrame, order, n: int, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) of the classes that share n-grams, enough to give all components.
    ``chosen`` names the row of ``rows`` whose text stands for a class and its bytes.
    """
    stars = shared.groupBy("token").agg(F.min("node").alias("star"))
    held = shared.join(stars, "token").select("star", "node").distinct()
    held = store(held.join(chosen.select("node", "bytes"), "node"), "stars-held")
    weights = store(held.groupBy("star").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("sets")).filter("sets > 1"), "star-bytes")
    large = weights.filter(F.col("bytes") > block_bytes)
    large = large.select("star", F.ceil(2 * F.col("bytes") / F.lit(block_bytes)).alias("cuts"))
    bundles = -(-(weights.filter(F.col("bytes") <= block_bytes).agg(F.sum("bytes")).first()[0] or 1) // block_bytes)
    dealt = held.select("star", "node").join(weights.select("star"), "star", "left_semi").join(large, "star", "left")
    dealt = dealt.withColumn("chunk", F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("node"), "cuts")))
    whole = dealt.filter("cuts IS NULL").select(
        F.pmod(F.xxhash64("star"), F.lit(bundles)).alias("block"), F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), F.lit(0).cast("long").alias("chunk"), "node"
    )
    paired = dealt.filter("cuts IS NOT NULL").withColumn("other", F.explode(F.expr("sequence(0L, cuts - 1)")))
    paired = paired.select(F.col("star").alias("block"), F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node")
    # A text takes the list of its blocks along, so that it is moved to its blocks at once.
    targets = whole.distinct().union(paired).groupBy("node").agg(F.collect_list(F.struct("block", "low", "high", "chunk")).alias("targets"))
    blocks = store(chosen.drop("bytes").join(targets, "node"), "blocks")

    def walk(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes, chunks, sets = [], [], []
        for batch in batches(table.select(["node", "chunk", "text", "digest"]).to_batches(), "text", _BATCH):
            grams, first = gram_sets(batch.column(2), n)
            numbers = arrange(order.value, grams, first)
            for i, digest in enumerate(batch.column(3).to_pylist()):
                sets.append(numbers[first[i] : first[i + 1]])
                if _digest(sets[-1]) != digest:
                    raise ValueError(f"the text sent for class {batch.column(0)[i]} is that of another one")
            nodes += batch.column(0).to_pylist()
            chunks += batch.column(1).to_pylist()
        by = sorted(range(len(sets)), key=lambda i: (len(sets[i]), nodes[i]))
        found = block_links([sets[i] for i in by], np.array(chunks)[by], key[1].as_py() == key[2].as_py(), percent)
        ends = [pa.array([nodes[by[link[end]]] for link in found], pa.int64()) for end in (0, 1)]
        return pa.table(ends, names=["a", "b"])

    texts = rows.join(blocks, ["key", "content"]).dropDuplicates(["key", "content", "node"])
    sent = texts.select(F.inline("targets"), "node", "text", "digest")
    return sent.groupBy("block", "low", "high").applyInArrow(giving_back(walk), "a long, b long")


def near_components(
    docs: DataFrame, n: int = 5, percent: int = 80, heavy: int = 1_000_000, least: int = 4,
    block_bytes: int = 6 << 20, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, n_shingles, component_id) per row."""
    members = _members(docs, n, percent, heavy, least, block_bytes, key, text)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return members.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def heads(
    docs: DataFrame, n: int = 5, percent: int = 80, heavy: int = 1_000_000, least: int = 4,
    block_bytes: int = 6 << 20, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The rows of ``docs``, all columns, that stay when of each component the document with the
    least key stays. Rows with equal key and text are one row; rows without words or key stay.
    """
    members = _members(docs, n, percent, heavy, least, block_bytes, key, text)
    # A head is the least key of the component's first class.
    gone = members.filter("n > 0 AND (key <> component OR NOT first)").select(F.col("key").alias("_key"), F.col("content").alias("_content"))
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    value = F.col(f"c{names.index(text)}").cast("string")
    rows = rows.withColumns({"_key": F.col(f"c{names.index(key)}").cast("long"), "_content": F.xxhash64(value, F.lit("text"))})
    kept = rows.join(gone.distinct(), ["_key", "_content"], "left_anti").dropDuplicates(["_key", "_content"])
    return kept.drop("_key", "_content").toDF(*names)


def _members(docs, n, percent, heavy, least, block_bytes, key, text) -> DataFrame:
    """(key, n, digest, content, component, first) per row; the component of a row without words
    is null. ``content`` is a hash of the text as it is, ``first`` whether the row's class is its
    component's first.
    """
    spark: SparkSession = docs.sparkSession
    rows = plain(docs, **{key: "long", text: "string"}).toDF("key", "text")
    rows = rows.withColumn("content", F.xxhash64("text", F.lit("text")))
    with arrow_rows(spark, _ROW):
        order = spark.sparkContext.broadcast(frequent(rows, n, percent, heavy, least))
        known = store(_prefixes(rows, order, n, percent), "prefixes")
    filled = known.filter("n > 0")
    # Numbers ascend with the least key, so that a component's least number has its least key.
    least_keys = filled.groupBy("digest").agg(F.min("key").alias("least"))
    in_order = least_keys.repartitionByRange(partitions(spark), "least", "digest").sortWithinPartitions("least", "digest")
    classes = store(in_order.withColumn("node", F.monotonically_increasing_id()), "classes")
    known_classes = classes.filter("least IS NOT NULL")
    # Rows of a digest have one prefix; copies are combined before the only shuffle of prefixes.
    alike = filled.groupBy("digest").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    numbered = alike.join(known_classes.select("digest", "node"), "digest")
    tokens = numbered.select("node", "n", F.explode("prefix").alias("token"))
    ordered = tokens.repartitionByRange(partitions(spark), "token", "n", "node").sortWithinPartitions("token", "n", "node")
    shared = store(_shared(ordered), "shared")
    members = store(known.select("key", "n", "digest", "bytes", "content"), "members")
    drop_stored(known)

    wanted = known_classes.join(shared.select("node").distinct(), "node").select("digest", F.col("least").alias("key"), "node")
    # One text of each class: a row of its least key that has its digest.
    chosen = members.join(wanted, ["digest", "key"]).groupBy("node", "digest", "key").agg(F.min("content").alias("content"), F.max("bytes").alias("bytes"))
    chosen = store(chosen, "chosen")
    links = _links(shared, rows, chosen, order, n, percent, block_bytes)

    grouped = store(classes.join(components(links), "node", "left").select("node", "digest", "least", F.coalesce("component", "node").alias("top")), "grouped")
    tops = grouped.filter("node = top").select("top", F.col("least").alias("component"))
    named = grouped.join(tops, "top").select("digest", "component", (F.col("node") == F.col("top")).alias("first"))
    return members.drop("bytes").join(named, "digest", "left")
