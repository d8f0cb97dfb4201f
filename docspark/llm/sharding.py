"""K-d tree partitioning of documents into shards of nearly equal bytes, with DataFrame functions only.

A node of the tree splits along its widest metadata dimension, widths taken as shares of the
root's, at a weighted median: the bytes of the documents below it are to the bytes of all as the
leaves on that side are to all leaves.  All nodes of a level split together.  Their medians are
found exactly by counting bytes in equal ranges of a 63-bit key and narrowing each node to the
range that holds its median, until what is still undecided is one document or ``tolerance`` of a leaf;
each round is one aggregation whose result has about ROUND_ROWS rows at most, however many nodes
and documents there are: more nodes get fewer ranges each, and more rounds.  The driver holds
these rows and, for each node, a dimension and a threshold.

The key is the dimension's value, then a hash of the text, then one of the id and of the row's
number, which is fixed when the metadata are written; so documents with equal values, equal texts or
equal ids, and repeated rows, may be split anywhere: nothing is too common to share out.  Sizes
are the UTF-8 bytes of the text and 8 more; a null text has none.  Places in a shard come from
counts of many small buckets of each shard, dealt by the row's number, so that no task holds a
shard.  Repeated rows and rows without an id are separate documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of one round's histogram in all, and the least ranges of a node.
ROUND_ROWS = 1 << 16
LEAST_BINS = 16
#: Bytes that a split may leave undecided, as a share of a leaf's.
TOLERANCE = 2e-4
#: Rows of a bucket in which places are numbered.
BUCKET_ROWS = 20_000
TEXT_OVERHEAD = 8
_VALUE_BITS, _TEXT_BITS, _ID_BITS = 31, 16, 16


@dataclass
class Level:
    """For each node of a level: the dimension it splits along and the least key that goes right."""

    dims: list[int]
    thresholds: list[int]


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, row, size, text_crc32, d0..d3, node): the size of each document, its dimensions as whole numbers below 2^31, and the root.

    The rows' numbers follow the partitions: write this before it is used twice.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + TEXT_OVERHEAD
    unit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 33)  # noqa: E731  a name's place on a line
    columns = {c.lower() for c in docs.columns}
    name = lambda c: unit(F.col(c).cast("string")) if c in columns else F.lit(0).cast("long")
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        # a logarithm, so that a few long documents don't make the range wide
        F.least(F.lit((1 << 31) - 1), F.floor(F.log2(size.cast("double")) * (1 << 26))).cast("long").alias("d0"),
        name("source").alias("d1"),
        name("lang").alias("d2"),
        unit(F.col("doc_id")).alias("d3"),
        F.lit(0).alias("node"),
    )


DIMENSIONS = ("d0", "d1", "d2", "d3")


def _key(dim: Column) -> Column:
    value = F.when(dim == 0, F.col("d0")).when(dim == 1, F.col("d1")).when(dim == 2, F.col("d2")).otherwise(F.col("d3"))
    mixed = F.shiftleft(value, _TEXT_BITS + _ID_BITS) + F.shiftleft(F.shiftright("text_crc32", 32 - _TEXT_BITS), _ID_BITS)
    return mixed + F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 64 - _ID_BITS)


def _lookup(values: list[int], at: Column) -> Column:
    return F.get(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), at.cast("int"))


def _below(rows: DataFrame, level: Level) -> DataFrame:
    """Rows with their node on the next level: node n has 2n on its left and 2n + 1 on its right."""
    node = F.col("node")
    right = _key(_lookup(level.dims, node)) >= _lookup(level.thresholds, node)
    return rows.withColumn("node", (node * 2 + right.cast("int")).cast("int"))


def _leaves(n: int, depth: int) -> list[int]:
    """Leaves below each node at ``depth`` when every node gives half of its leaves, rounded up, to its left."""
    counts = [n]
    for _ in range(depth):
        counts = [c for x in counts for c in ((x + 1) // 2, x // 2)]
    return counts


def grow(rows: DataFrame, n_shards: int, round_rows: int = ROUND_ROWS, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """Metadata rows with their node on the last level of a k-d tree with ``n_shards`` leaves, and its number of levels.

    Each level is a checkpoint, so that the next one's passes read a column instead of the tree.
    """
    depth = max(0, math.ceil(math.log2(n_shards))) if n_shards > 1 else 0
    spans = None
    for k in range(depth):
        leaves = _leaves(n_shards, k)
        width = len(leaves)
        ranges = [f(c).alias(f"{g}{c}") for c in DIMENSIONS for f, g in ((F.min, "a"), (F.max, "b"))]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("size"), *ranges).collect()}
        if spans is None:
            spans = [max(1, stats[0][f"b{c}"] - stats[0][f"a{c}"]) for c in DIMENSIONS] if stats else [1] * len(DIMENSIONS)
        # the widest dimension, as a share of the root's width; the first of equals
        dims = [max(range(len(DIMENSIONS)), key=lambda d, r=stats[i]: ((r[f"b{DIMENSIONS[d]}"] - r[f"a{DIMENSIONS[d]}"]) / spans[d], -d)) if i in stats else 0 for i in range(width)]
        shift = _TEXT_BITS + _ID_BITS
        low = [stats[i][f"a{DIMENSIONS[dims[i]]}"] << shift if i in stats else 0 for i in range(width)]
        high = [((stats[i][f"b{DIMENSIONS[dims[i]]}"] + 1) << shift) if i in stats else 1 for i in range(width)]  # one past the last
        total = [stats[i]["size"] if i in stats else 0 for i in range(width)]
        goal = [total[i] * ((leaves[i] + 1) // 2) / max(leaves[i], 1) for i in range(width)]
        before = [0] * width  # bytes left of low
        thresholds = [0] * width
        pending = {i for i in range(width) if leaves[i] > 1 and total[i]}
        for i in range(width):
            if i not in pending:
                thresholds[i] = (1 << 63) - 1  # everything goes left
        while pending:
            bins = max(LEAST_BINS, round_rows // len(pending))
            step = [max(1, -(-(high[i] - low[i]) // bins)) for i in range(width)]
            split = rows.filter(F.col("node").isin(sorted(pending))).withColumn("dim", _lookup(dims, F.col("node")))
            inside = split.select("node", "size", _key(F.col("dim")).alias("key")).filter((F.col("key") >= _lookup(low, F.col("node"))) & (F.col("key") < _lookup(high, F.col("node"))))
            bin_ = F.expr("(key - lo) div step")
            counted = inside.select("node", "size", "key", _lookup(low, F.col("node")).alias("lo"), _lookup(step, F.col("node")).alias("step")).groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
            by_node: dict[int, list[tuple[int, int, int]]] = {}
            for r in counted.collect():
                by_node.setdefault(r["node"], []).append((r["bin"], r["size"], r["n"]))
            for i in sorted(pending):
                at = before[i]
                for bin_no, size, n in sorted(by_node.get(i, [])):
                    if at + size >= goal[i]:
                        left, right = low[i] + bin_no * step[i], low[i] + (bin_no + 1) * step[i]
                        if n == 1 or step[i] == 1 or size <= tolerance * total[i] / leaves[i]:
                            thresholds[i] = left if goal[i] - at < at + size - goal[i] else right
                            pending.discard(i)
                        else:
                            low[i], high[i], before[i] = left, min(right, high[i]), at
                        break
                    at += size
                else:
                    thresholds[i] = high[i]
                    pending.discard(i)
        rows = cut(_below(rows, Level(dims, thresholds)))
    return rows, depth


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document: ``n_shards`` shards, or as many as make ``target_bytes`` each."""
    rows = cut(metadata(docs))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    if n_shards is None:
        n_shards = max(1, round((total["size"] or 0) / target_bytes))
    rows, depth = grow(rows, n_shards) if total["n"] else (rows, 0)
    # a node with one leaf sends all to its left: its leaf is the first below it
    names, at = [], 0
    for c in _leaves(n_shards, depth):
        names.append(at)
        at += c
    shard = _lookup(names, F.col("node")).cast("int")
    buckets = max(1, math.ceil((total["n"] or 0) / (n_shards * BUCKET_ROWS)))
    placed = rows.select("doc_id", "size", "text_crc32", "row", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "row", F.lit("bucket")), F.lit(buckets)).cast("int").alias("bucket"))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("row")
    numbered = placed.withColumn("nth", F.row_number().over(in_bucket) - 1)
    # one row for each bucket: rows / BUCKET_ROWS of them
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("start"))
    return numbered.join(starts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))
