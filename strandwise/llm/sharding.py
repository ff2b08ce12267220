"""Operator 10: shards by a k-d tree over document metadata.

A node that stands for k shards is split at the weighted median (k // 2 of k of its bytes)
along its widest dimension, until every leaf is one shard. All nodes of a level are split at
once, and there are never more nodes than shards: the driver holds a few numbers per node.

Dimensions: language, source, length, key. Each is a coordinate of 0 to 2**20 - 1: a hash for
text values (equal values share it), a place between the least and the greatest for numbers;
null is 0. A node's widest dimension is the one with the largest weighted deviation from its
mean. The cut is the place in (coordinate, group hash, row hash) order where the left side's
bytes come closest to their share; it is found exactly by repeated 1,024-way histograms of the
nodes, each one aggregate over the compact table of sizes and coordinates, whatever the skew.

Rows with equal texts form a group and take the coordinates of its least row, so that a group
lies in one shard. A group with more than 1/8 of a shard's bytes may be divided, because
otherwise a third of all rows could land in one shard; its rows stay next to each other in the
tree. Sizes differ by the bytes of the rows or small groups at the cuts at most.

``slot`` numbers a shard's rows without gaps: rows are range-partitioned by shard and hash,
stored, and each partition's first slot in a shard is a sum over the earlier partitions.

Null texts have no bytes, weigh ``overhead`` and form a group. Repeated rows, null keys and ties
are told apart by a number given when the table is stored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.common import drop_stored, plain, store

_SCALE = 1 << 20
_WAYS = 1024


def _number(c: Column, low: float, high: float) -> Column:
    spread = max(high - low, 1e-300)
    return F.coalesce(F.floor((c.cast("double") - low) / spread * (_SCALE - 1)).cast("long"), F.lit(0).cast("long"))


def _word(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(_SCALE))).cast("long")


def shard(
    docs: DataFrame,
    shards: int = 40,
    overhead: int = 16,
    key: str = "doc_id",
    text: str = "text",
    words: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) with sizes near equal."""
    names = {key: "long", text: "string"} | {w: "string" for w in words}
    rows = plain(docs, **names).toDF("key", "text", *(f"w{i}" for i in range(len(words))))
    compact = store(
        rows.select(
            "key",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)).alias("group"),
            *(_word(F.col(f"w{i}")).alias(f"d{i}") for i in range(len(words))),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    total = compact.agg(
        F.sum("size"), F.min("key"), F.max("key"), F.min(F.log("size")), F.max(F.log("size")), F.count("*")
    ).first()
    weight = total[0] or 0
    n = len(words)
    dims = [f"d{i}" for i in range(n + 2)]
    placed = compact.withColumn(dims[n], _number(F.log("size"), total[3] or 0, total[4] or 0)).withColumn(
        dims[n + 1], _number(F.col("key"), total[1] or 0, total[2] or 0)
    )
    # One aggregate per group, combined before the shuffle; hot groups meet as partial rows.
    groups = placed.groupBy("group", "size").agg(
        (F.sum("size") > weight / shards / 8).alias("large"), *(F.min(d).alias(f"least_{d}") for d in dims)
    )
    points = store(
        placed.join(groups, ["group", "size"]).select(
            "row", "key", "size", "text_crc32",
            *(F.when(F.col("large"), F.col(d)).otherwise(F.col(f"least_{d}")).alias(d) for d in dims),
            # Below a coordinate: 22 bits of the group's hash, and for large groups 21 of the row's.
            (
                F.pmod(F.xxhash64("group", "size"), F.lit(1 << 22)) * F.lit(1 << 21)
                + F.when(F.col("large"), F.pmod(F.xxhash64("row"), F.lit(1 << 21))).otherwise(0)
            ).alias("tie"),
        ),
        "points",
    )
    law = F.lit("bytes").alias("law")
    numbered = _slots(_cuts(points, dims, shards).select("row", "key", "size", "text_crc32", "shard"))
    return numbered.select(
        F.col("key").alias(key), "size", "text_crc32", law, "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _place(dim: str) -> Column:
    """A position along a dimension: 20 bits of coordinate, 43 bits of tie."""
    return F.col(dim) * F.lit(1 << 43) + F.col("tie")


def _cuts(points: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``points`` with their shard. After each level the table is stored with the node of each
    row: the number of its first shard.
    """
    here = points.withColumn("node", F.lit(0))
    nodes = {0: shards}  # first shard to number of shards
    while any(k > 1 for k in nodes.values()):
        open_nodes = {f: k for f, k in nodes.items() if k > 1}
        inner = here.filter(F.col("node").isin(*open_nodes))
        size = F.col("size").cast("double")
        spreads = inner.groupBy("node").agg(
            F.sum("size").alias("total"),
            *(
                (F.sum(size * F.col(d) * F.col(d)) / F.sum(size) - F.pow(F.sum(size * F.col(d)) / F.sum(size), 2)).alias(d)
                for d in dims
            ),
        )
        widest, target = {}, {}
        for r in spreads.collect():  # a row per node
            widest[r["node"]] = max(range(len(dims)), key=lambda i: (r[dims[i]], -i))
            k = open_nodes[r["node"]]
            target[r["node"]] = r["total"] * (k // 2) / k
        if not widest:
            break
        cuts = _search(inner, dims, widest, target)
        node = F.col("node")
        for first, cut in cuts.items():
            right = (F.col("node") == first) & (_place(dims[widest[first]]) >= F.lit(cut))
            node = F.when(right, F.lit(first + open_nodes[first] // 2)).otherwise(node)
        before, here = here, store(here.withColumn("node", node), "level")
        if len(nodes) > 1:
            drop_stored(before)
        nodes = {f: k for f, k in nodes.items() if k == 1}
        for first, k in open_nodes.items():
            nodes |= {first: k // 2, first + k // 2: k - k // 2}
    return here.withColumnRenamed("node", "shard")


def _search(here: DataFrame, dims: list[str], widest: dict, target: dict) -> dict[int, int]:
    """The first position of the right side for each node, by histograms of ever finer cells."""
    position = F.lit(None).cast("long")
    for node, dim in widest.items():
        position = F.when(F.col("node") == node, _place(dims[dim])).otherwise(position)
    placed = here.select("node", "size", position.alias("at"))
    low = {n: 0 for n in widest}
    below = {n: 0 for n in widest}  # bytes before the cell
    cell = 1 << 63
    while cell > 1:
        finer = max(cell // _WAYS, 1)
        ways = cell // finer
        base = F.lit(None).cast("long")
        for n in widest:
            base = F.when(F.col("node") == n, F.lit(low[n])).otherwise(base)
        shift = finer.bit_length() - 1
        way = F.shiftright(F.col("at") - base, shift)
        sums: dict[int, dict[int, int]] = {n: {} for n in widest}
        counted = placed.withColumn("way", way).filter((F.col("way") >= 0) & (F.col("way") < ways))
        for r in counted.groupBy("node", "way").agg(F.sum("size").alias("s")).collect():  # 1,024 per node at most
            sums[r["node"]][r["way"]] = r["s"]
        for n in widest:
            for w in sorted(sums[n]):
                step = sums[n][w]
                if below[n] + step >= target[n] or w == max(sums[n]):
                    low[n] += w * finer
                    break
                below[n] += step
            if finer == 1:
                # The cell is one position: it goes to the side where the error is smaller.
                step = sums[n].get(w, 0) if sums[n] else 0
                if target[n] - below[n] > below[n] + step - target[n]:
                    low[n] += 1
        cell = finer
    return low


def _slots(rows: DataFrame) -> DataFrame:
    """A number from 0 for the rows of each shard, without a window over a shard."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "shard", F.xxhash64("row")).sortWithinPartitions("shard")
    kept = store(ordered.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "slots")
    runs = kept.groupBy("shard", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return kept.join(runs, ["shard", "part"]).withColumn("slot", F.col("at") - F.col("first") + F.col("base"))
