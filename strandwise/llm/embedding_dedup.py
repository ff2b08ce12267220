"""Operator 1: near-duplicate embeddings with a random-projection tree forest.

Equal vectors of a label become one representative with a count. Every tree starts with one
node per label and splits nodes of more than ``leaf`` representatives at the median of a random
direction of their own; vectors within ``spill`` of the cut go to both sides. All nodes of a
level of all trees are split at once: a distributed median per node, then a join by node. A
node that its spill doesn't let shrink is tried with new directions a few times and then stays
as it is, in blocks: near copies that lie closer together than the spill belong together.

Within a leaf all pairs are compared, block against block, by matrix products in double
precision. A pair that meets in several leaves counts in the least of them only, which each
vector's list of leaves shows, so that links are counted without listing a pair. Per leaf and
vector one row goes out: its number of links and the least vector it hangs together with in the
leaf. Components over those rows give the result.

With unit vectors, cosine c means a distance of sqrt(2 - 2 c), whose projection has a deviation
of that over the square root of the dimension. The default spill is 0.8 such deviations to
either side; a pair at the threshold is separated in one split with a chance of about 0.4 %, in
all of the trees far less. Recall against brute force is in the tests.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
label, link with nothing. Vectors of different length never link. Repeated rows are equal
vectors; rows that repeat an id keep their rows. A null id counts as a copy in ``n_links`` of
others but names no component. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import drop_stored, mix, store
from strandwise.llm.components import components

_TRIES = 3


def _direction(node: int, dim: int) -> np.ndarray:
    """A unit direction that a node's number alone decides, on any machine."""
    seeds = mix(np.arange(2 * dim, dtype=np.uint64) + mix(np.array([node & (1 << 64) - 1], np.uint64)))
    u = (seeds.astype(np.float64) + 1) / 2.0**64
    normal = np.sqrt(-2 * np.log(np.minimum(u[:dim], 1.0))) * np.cos(2 * math.pi * u[dim:])
    return normal / max(np.linalg.norm(normal), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an array of lists of one length, in double precision."""
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    scale = np.abs(flat).max(axis=1, keepdims=True)  # no overflow for extreme components
    flat = flat / scale
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _project(state: DataFrame) -> DataFrame:
    """``state`` with the projection of each vector on its node's direction."""

    def run(items):
        for batch in items:
            if not batch.num_rows:
                continue
            nodes = np.asarray(batch.column(0))
            column = batch.column(2)
            sizes = np.asarray(column.value_lengths())
            p = np.empty(len(nodes))
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                unit = _matrix(column.take(pa.array(at)))
                own = nodes[at]
                order = np.argsort(own, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    p[at[part]] = unit[part] @ _direction(int(own[part[0]]), int(dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], ["node", "rep", "vector", "tries", "p"])

    return state.select("node", "rep", "vector", "tries").mapInArrow(run, "node long, rep long, vector array<double>, tries int, p double")


def _leaves(reps: DataFrame, trees: int, leaf: int, spill: float) -> DataFrame:
    """(rep, node, size) for every leaf that a representative is in."""
    roots = F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: F.xxhash64(t, "label", F.size("vector")))
    state = store(reps.select(F.explode(roots).alias("node"), "rep", "vector", F.lit(0).alias("tries")), "forest")
    done = None
    while True:
        sizes = store(state.groupBy("node").agg(F.count("*").alias("size"), F.max("tries").alias("tried")), "nodes")
        final = (F.col("size") <= leaf) | (F.col("tried") >= _TRIES)
        small = state.join(sizes.filter(final), "node").select("rep", "node", "size")
        done = small if done is None else done.union(small)
        if not sizes.filter(~final).limit(1).count():
            return done
        open_rows = state.join(sizes.filter(~final).select("node", "size"), "node", "left_semi")
        projected = store(_project(open_rows), "projected")
        cuts = projected.groupBy("node").agg(
            F.percentile_approx("p", 0.5, 1000).alias("cut"), F.count("*").alias("size")
        )
        # What a child would hold; a child of nearly all rows is no progress.
        sided = projected.join(cuts, "node").withColumns(
            {"left": F.col("p") <= F.col("cut") + spill, "right": F.col("p") > F.col("cut") - spill}
        )
        held = sided.groupBy("node").agg(F.count_if("left").alias("l"), F.count_if("right").alias("r"))
        placed = sided.join(held, "node")
        stuck = F.greatest("l", "r") > 0.9 * F.col("size")
        child = lambda side: F.struct(F.xxhash64("node", F.lit(side)).alias("node"), F.lit(0).alias("tries"))
        same = F.struct(F.xxhash64("node", F.lit("again")).alias("node"), (F.col("tries") + 1).alias("tries"))
        none = F.array().cast("array<struct<node:bigint,tries:int>>")
        following = F.when(stuck, F.array(same)).otherwise(
            F.concat(F.when(F.col("left"), F.array(child("left"))).otherwise(none), F.when(F.col("right"), F.array(child("right"))).otherwise(none))
        )
        state = store(placed.select(F.explode(following).alias("next"), "rep", "vector").select("next.node", "rep", "vector", "next.tries"), "forest")
        drop_stored(projected)


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, least) per leaf block and representative with a link there."""

    def run(key, table):
        leaf = key[0].as_py()
        block, first, second = (table.column(c).to_numpy() for c in ("block", "a", "b"))
        rep, count = table.column("rep").to_numpy(), table.column("count").to_numpy()
        lists = table.column("leaves").to_pylist()
        vectors = table.column("vector").combine_chunks()
        unit = _matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors)
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links = np.zeros(len(rep), np.int64)
        parent = np.arange(len(rep))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        # Leaves before this one, the only ones in which a pair could have been counted.
        earlier = [frozenset(x for x in own if x < leaf) for own in lists]
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            near = unit[some] @ unit[right].T >= threshold
            for x, y in zip(*np.nonzero(near)):
                i, j = some[x], right[y]
                if (first[0] == second[0] and i >= j) or not earlier[i].isdisjoint(earlier[j]):
                    continue
                links[i] += count[j]
                links[j] += count[i]
                a, b = root(i), root(j)
                if a != b:
                    a, b = (a, b) if rep[a] < rep[b] else (b, a)
                    parent[b] = a
        linked = np.flatnonzero(links)
        least = np.array([rep[root(i)] for i in linked], np.int64)
        return pa.table({"rep": rep[linked], "links": links[linked], "least": least})

    return rows.groupBy("node", "a", "b").applyInArrow(run, "rep long, links long, least long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, trees: int = 6, leaf: int = 1024, spill_deviations: float = 0.8,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(key, n_links, component_id, kept) per row."""
    rows = vectors.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.col(f"`{label}`").alias("label"),
    )
    limit = F.lit(float("inf"))
    usable = (
        F.col("label").isNotNull()
        & F.coalesce(F.size("vector") > 0, F.lit(False))
        & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)), F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    numbered = store(rows.withColumn("usable", usable).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # Equal vectors by their text form's digest would be slower; arrays group as they are.
    grouped = numbered.filter("usable").groupBy("label", "vector").agg(F.min("row").alias("rep"), F.count("*").alias("count"), F.min("key").alias("named"))
    reps = store(grouped, "representatives")
    dim = reps.agg(F.max(F.size("vector"))).first()[0] or 1
    spill = spill_deviations * math.sqrt((2 - 2 * threshold) / dim)
    leaves = store(_leaves(reps, trees, leaf, spill), "leaves")
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("node")).alias("leaves"))
    known = reps.join(lists, "rep").select("rep", "count", "vector", "leaves")
    # A leaf of more than `leaf` rows is compared block by block; each pair of blocks once.
    blocks = F.ceil(F.col("size") / F.lit(leaf)).cast("int")
    dealt = leaves.select("rep", "node", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"))
    )
    sent = dealt.select("rep", "node", "block", F.explode(pairs).alias("p")).select("rep", "node", "block", "p.a", "p.b").join(known, "rep")
    found = store(_compare(sent, threshold), "leaf-links")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.select("rep", "least"), "rep", "least")
    # Representatives are rows; a component's name is the least key among all its vectors.
    member = numbered.filter("usable").join(reps.select("label", "vector", "rep", "count"), ["label", "vector"]).select("row", "rep", "count")
    named = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "named", F.coalesce("component", "rep").alias("component"))
    names = named.groupBy("component").agg(F.min("named").alias("component_id"))
    table = named.join(names, "component").join(totals, "rep", "left").select("rep", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    linked = member.join(table, "rep").select("row", (F.col("links") + F.col("count") - 1).alias("links"), "component_id")
    out = numbered.select("row", "key", "usable").join(linked, "row", "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
