"""The k-d tree against a plain one, and on rows that repeat."""

import pytest
from pyspark.sql import functions as F

from docspark.llm import sharding


def plain_tree(rows, leaves, spans=None):
    """Leaves of a k-d tree over (key of each dimension, dimension values, size) rows, split at weighted medians by sorting."""
    if leaves == 1 or not rows:
        return [rows] + [[]] * (leaves - 1)
    widths = [max(r["d"][k] for r in rows) - min(r["d"][k] for r in rows) for k in range(4)]
    spans = spans or [max(1, w) for w in widths]
    dim = max(range(4), key=lambda k: (widths[k] / spans[k], -k))
    rows = sorted(rows, key=lambda r: r["keys"][dim])
    left = (leaves + 1) // 2
    goal, at, k = sum(r["size"] for r in rows) * left / leaves, 0, 0
    while k < len(rows) and at + rows[k]["size"] < goal:
        at += rows[k]["size"]
        k += 1
    if k < len(rows) and goal - at >= at + rows[k]["size"] - goal:
        k += 1
    return plain_tree(rows[:k], left, spans) + plain_tree(rows[k:], leaves - left, spans)


@pytest.mark.parametrize(("round_rows", "counts"), [(1 << 16, (1, 2, 24)), (2048, (7,))])
def test_against_a_plain_tree(spark, data, round_rows, counts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sharding.cut(sharding.metadata(docs))
    keyed = rows.select("row", "size", F.array(*sharding.DIMENSIONS).alias("d"), F.array(*[sharding._key(F.lit(k)) for k in range(4)]).alias("keys"))
    for n in counts:
        grown, depth = sharding.grow(rows, n, round_rows, tolerance=0.0)
        by_node = {}
        for r in grown.collect():
            by_node.setdefault(r["node"], set()).add(r["row"])
        want = [{r["row"] for r in leaf} for leaf in plain_tree(keyed.collect(), n)]
        assert [by_node[k] for k in sorted(by_node)] == [x for x in want if x]


def test_repeated_rows_and_rows_without_an_id(spark):
    same = spark.range(4800).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    unnamed = same.withColumn("doc_id", F.lit(None).cast("long"))
    for docs in (same, unnamed, same.limit(2400).unionByName(unnamed.limit(2400))):
        rows = sharding.kd_shards(docs, n_shards=24).collect()
        by = {}
        for r in rows:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert len(by) == 24 and all(abs(len(x) - 200) <= 1 for x in by.values())
        assert all(sorted(x) == list(range(len(x))) for x in by.values())
