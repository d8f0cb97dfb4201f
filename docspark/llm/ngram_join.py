"""N-gram Jaccard join: documents whose sets of word n-grams are alike, found by MinHash banding.

A document's set holds the hashes of its runs of ``n`` lower-cased words (all its words, where it
has fewer).  Two texts are linked when the Jaccard similarity of their whole sets is ``threshold``
or more.  Band and row counts are derived from the recall wanted at the threshold.

No pair is ever emitted.  Equal texts, and then texts with equal sets, become one class each
before anything else.  Classes shuffle on their band hashes; buckets with the same members are
worked on once.  A bucket is dealt in blocks of bounded weight, and every two blocks meet in a
group of their own, which verifies all its pairs on the full sets with matrix products, counts
a pair only in the first band that both share, and returns one row for each linked class: its
number of links there and the least class it is connected to.  Connected components then run
over those few edges, in rounds until none changes anything.  Their nodes are the classes' keys, which
come from the contents alone, so that one id on several texts, or ids of any type, do no harm.

Every document gets one row: its component (``class_id``: the least doc_id in it), the number of
rows with its very text, the number of other texts that it is linked to and the number of other
documents that those links and its copies reach.  Texts without words link to equal texts only.
A null text counts as empty.  Rows without a doc_id can't be named: they get a null class and
no links.  Repeated rows are copies of each other.  An id on several texts has a row for each, in
the classes of these texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shingle_hashes, text_batches, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Bounds of a block: classes, and hashes in their sets.  A group holds two blocks.
BLOCK_CLASSES = 256
BLOCK_HASHES = 300_000
#: Parts that the rows of one label are dealt in where labels are joined: a component may hold a third of all rows.
SALTS = 16


def choose_bands(threshold: float, recall: float, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` at ``threshold`` with at most ``most_hashes`` hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        if hit <= 0 or hit >= 1:
            bands = 1
        else:
            bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows > most_hashes and best:
            break
        best = (bands, rows)
    return best


def _keys(texts: list[str], shingles: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """128-bit keys of the texts, as ``text_key`` makes them, and of their sets."""
    import xxhash

    whole = [hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts]
    sets = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else xxhash.xxh3_128_digest(b"-" + w) for s, w in zip(shingles, whole, strict=True)]
    return whole, sets


def text_key(text: str) -> Column:
    """The key of a column's texts; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _sets(texts: list[str], n: int) -> list[np.ndarray]:
    hashes, _, first = word_hashes(texts)
    shingles, at = shingle_hashes(hashes, first, n)
    return [np.unique(shingles[a:b]) for a, b in zip(at, at[1:], strict=False)]


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, set_key, n_shingles, bands) of each document; bands is empty without words."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            texts = [t or "" for t in texts]
            sets = _sets(texts, n)
            whole, keys = _keys(texts, sets)
            size = np.array([len(s) for s in sets])
            full = size > 0
            out = np.zeros((len(texts), bands), np.uint64)
            if full.any():
                flat, first = np.concatenate(sets), (np.cumsum(size) - size)[full]
                for b in range(bands):
                    h = np.zeros(int(full.sum()), np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        x = flat * odd[k] + add[k]
                        # the high bits of a product depend on all bits below, so they lead
                        h = (h ^ np.minimum.reduceat(x, first)) * np.uint64(0x9FB21C651E98DF25)
                        h ^= h >> np.uint64(32)
                    out[full, b] = h
            ends = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(whole, pa.binary()), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(out[full].ravel().astype(np.int64)))],
                ["doc_id", "text_key", "set_key", "n_shingles", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_key binary, set_key binary, n_shingles long, bands array<long>")


def linked_pairs(sets: list[np.ndarray], cross: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets with a Jaccard similarity of ``threshold`` or more.

    With ``cross`` > 0 only pairs of one of the first ``cross`` sets and one of the others count.
    Hashes in few sets are counted pair by pair, the rest by matrix products over blocks of them.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float32)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    first = np.cumsum(df) - df
    for d in range(2, 7):
        at = first[df == d]
        for a in range(d):
            for b in range(a + 1, d):
                np.add.at(common, (owner[at + a], owner[at + b]), 1)  # owners ascend in a column
    dense = df > 6
    place = np.cumsum(dense) - 1
    keep = dense[column]
    owner, column = owner[keep], place[column[keep]]
    edges = np.searchsorted(column, np.arange(0, int(dense.sum()) + 4096, 4096))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if a < b:
            has = np.zeros((m, 4096), np.float32)
            has[owner[a:b], column[a:b] - 4096 * k] = 1
            common += has @ has.T
    both = size[:, None] + size[None, :] - common
    hit = np.triu(common >= threshold * both - 1e-3, 1)
    if cross:
        hit[:cross, :cross] = False
        hit[cross:, cross:] = False
    i, j = np.nonzero(hit)
    exact = common[i, j].astype(np.float64) >= threshold * both[i, j].astype(np.float64) - 1e-9
    return i[exact], j[exact]


def _roots(m: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label in each node's connected component."""
    low = label.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new


_LINKS = "set_key binary, links long, linked_rows long, root binary"


def _verify(threshold: float):
    """A function over rows sorted by group (band, bucket, two blocks) that links the classes of each group."""

    def group(rows: list[dict]) -> pa.RecordBatch | None:
        band, one, two = rows[0]["band"], rows[0]["one"], rows[0]["two"]
        rows.sort(key=lambda r: (r["block"] != one, r["set_key"]))
        cross = sum(r["block"] == one for r in rows) if one != two else 0
        if len(rows) < 2 or (one != two and cross in (0, len(rows))):
            return None
        i, j = linked_pairs([np.frombuffer(r["shingles"], "<u8") for r in rows], cross, threshold)
        if band and len(i):  # only where no earlier band brings the two together
            sig = np.array([r["bands"] for r in rows], np.int64)
            fresh = np.ones(len(i), bool)
            for k in range(0, len(i), 200_000):
                a, b = i[k : k + 200_000], j[k : k + 200_000]
                fresh[k : k + 200_000] = ~(sig[a, :band] == sig[b, :band]).any(axis=1)
            i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        m = len(rows)
        texts, copies = (np.array([r[c] for r in rows], np.int64) for c in ("n_texts", "n_rows"))
        links = np.bincount(i, weights=texts[j], minlength=m) + np.bincount(j, weights=texts[i], minlength=m)
        reach = np.bincount(i, weights=copies[j], minlength=m) + np.bincount(j, weights=copies[i], minlength=m)
        keys = [r["set_key"] for r in rows]
        by_key = sorted(range(m), key=keys.__getitem__)
        place = np.empty(m, np.int64)
        place[by_key] = np.arange(m)
        root, has = _roots(m, i, j, place), np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[k] for k in has], pa.binary()), pa.array(links[has].astype(np.int64)), pa.array(reach[has].astype(np.int64)), pa.array([keys[by_key[root[k]]] for k in has], pa.binary())],
            ["set_key", "links", "linked_rows", "root"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["band"], r["bucket"], r["one"], r["two"])
                if key != now:
                    if rows and (out := group(rows)) is not None:
                        yield out
                    now, rows = key, []
                rows.append(r)
        if rows and (out := group(rows)) is not None:
            yield out

    return run


def _by_label(rows: DataFrame, labels: DataFrame, of: str) -> DataFrame:
    """``rows`` with what ``labels`` has for their label; rows of one label are dealt in SALTS parts."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int"))
    every = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(every, ["label", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's connected component, over edges (node, root).

    Labels spread to the neighbours, then jump to their label's label; each round is a checkpoint.
    A label only ever gets smaller, so the rounds end.
    """
    pair = F.array(F.struct("node", "root"), F.struct(F.col("root").alias("node"), F.col("node").alias("root")))
    both = cut(edges.filter("node <> root").select("node", "root").distinct().select(F.explode(pair).alias("e")).select("e.node", "e.root"))
    labels = cut(both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("root"), "label"), "root").groupBy("node").agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = cut(_by_label(spread, target, "node").select("node", "old", F.least("label", "further").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.filter("old <> label").limit(1).count():
            return labels


def classes(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key) of every row with an id, and for each text its key, its component (``label``), that component's
    least doc_id (``class_id``), n_copies, n_links and n_linked_docs."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select("doc_id", "text").filter("doc_id is not null")
    sig = cut(signatures(docs, n, bands, rows))

    # all rows of a set have the same bands
    texts = cut(sig.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.min("set_key").alias("set_key"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands")))
    sets = cut(texts.groupBy("set_key").agg(F.min(F.struct("least", "text_key")).alias("one"), F.count(F.lit(1)).alias("n_texts"), F.sum("n_copies").alias("n_rows"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands")))

    # one row for each class and band
    reps = sets.filter("n_shingles > 0")
    banded = reps.select("set_key", "n_shingles", F.posexplode("bands").alias("band", "bucket")).groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_key")).alias("y"), F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("m > 1")
    # buckets of the same classes: the first of them
    kept = banded.groupBy("m", "x", "y", "low", "high").agg(F.min(F.struct("band", "bucket", "weight")).alias("b")).select("b.*", "m")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("weight") / BLOCK_HASHES)).cast("int")
    kept = kept.select("band", "bucket", blocks.alias("blocks"))
    members = reps.select("set_key", F.posexplode("bands").alias("band", "bucket")).join(kept, ["band", "bucket"])
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("set_key", "band"), F.col("blocks")).cast("int")))

    # the full sets of the classes that share a bucket, from one document of each
    needed = members.select("set_key").distinct()
    source = sets.join(needed, "set_key").select("set_key", F.col("one.least").alias("doc_id"), "one.text_key")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in text_batches(batches):
            shingles = _sets([t or "" for t in found], n)
            yield pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array([s.tobytes() for s in shingles], pa.binary())], ["set_key", "shingles"])

    read = docs.withColumn("text_key", text_key("text")).join(source, ["doc_id", "text_key"]).select("text", "set_key")
    contents = read.mapInArrow(full, "set_key binary, shingles binary").dropDuplicates(["set_key"])
    contents = contents.join(sets.select("set_key", "bands", "n_texts", "n_rows"), "set_key")

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = members.select("set_key", "band", "bucket", "block", other).select("set_key", "band", "bucket", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    groups = ["band", "bucket", "one", "two"]
    met = dealt.join(contents, "set_key").repartition(*groups).sortWithinPartitions(*groups)
    links = cut(met.mapInArrow(_verify(threshold), _LINKS))

    totals = links.groupBy("set_key").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"))
    found = totals.join(components(links.select(F.col("set_key").alias("node"), "root")).withColumnRenamed("node", "set_key"), "set_key", "left")
    of_set = sets.select("set_key", F.col("one.least").alias("least"), "n_texts", "n_rows").join(found, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    of_set = cut(of_set)
    of_label = of_set.groupBy("label").agg(F.min("least").alias("class_id"))
    of_set = _by_label(of_set, of_label, "set_key")
    of_text = texts.select("text_key", "set_key", "n_copies").join(of_set, "set_key")
    of_text = of_text.select(
        "text_key",
        "label",
        "class_id",
        "n_copies",
        (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"),
        (F.coalesce("linked_rows", F.lit(0)) + F.col("n_rows") - 1).alias("n_linked_docs"),
    )
    return sig.select("doc_id", "text_key"), of_text


def ngram_join(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, n_linked_docs) of every row of ``docs``."""
    rows, of_text = classes(docs, n, threshold, recall)
    named = rows.join(of_text, "text_key").select("doc_id", "class_id", "n_copies", "n_links", "n_linked_docs")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    unnamed = docs.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), one.alias("n_copies"), none.alias("n_links"), none.alias("n_linked_docs"))
    return named.unionByName(unnamed)


def one_of_each(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component, and those without an id.

    A component's row is the one with the least doc_id, then with the least key of its text; of
    rows that repeat both, one.
    """
    rows, of_text = classes(docs, n, threshold, recall)
    key, columns = "__text_key", docs.columns
    # rows of a text share its component, so its least ids are enough
    least = rows.groupBy("text_key", "doc_id").agg(F.count(F.lit(1)).alias("rows")).groupBy("text_key").agg(F.min(F.struct("doc_id", "text_key", "rows")).alias("first"))
    stand = least.join(of_text.select("text_key", "label"), "text_key").groupBy("label").agg(F.min("first").alias("first"))
    stand = cut(stand.select(F.col("first.doc_id").alias("__doc_id"), F.col("first.text_key").alias(key), "first.rows"))
    mine = docs.withColumn(key, text_key("text"))
    standing = lambda which: mine.join(which.drop("rows").withColumnRenamed("__doc_id", "doc_id"), ["doc_id", key], "left_semi")
    once, more = standing(stand.filter("rows = 1")), standing(stand.filter("rows > 1"))
    # one row of those that repeat an id and a text
    return once.unionByName(more.dropDuplicates([key])).select(*columns).unionByName(docs.filter("doc_id is null"))


#: The query's rows in DuckDB's SQL: all pairs of texts that share an n-gram, and what they reach.
ORACLE = rf"""
with recursive texts as (
  select row_number() over () as id, t, least, n_copies, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') as w
  from (select coalesce(text, '') as t, min(doc_id) as least, count(*) as n_copies from documents where doc_id is not null group by 1)
), sets as (
  select id, case when len(w) < {SHINGLE_WORDS} then list_filter([array_to_string(w, ' ')], lambda x: x <> '')
    else list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda k: array_to_string(w[k:k + {SHINGLE_WORDS - 1}], ' '))) end as grams
  from texts
), held as (
  select id, len(grams) as n, unnest(grams) as gram from sets
), links as (
  select a.id as one, b.id as two from held a join held b on a.gram = b.gram and a.id <> b.id
  group by a.id, b.id, a.n, b.n having count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9
), reach(id, other) as (
  select id, id from texts
  union
  select reach.id, links.two from reach join links on reach.other = links.one
), classes as (
  select reach.id, min(least) as class_id from reach join texts on texts.id = reach.other group by reach.id
), linked as (
  select one as id, count(*) as n_links, cast(sum(n_copies) as bigint) as n_rows from links join texts on texts.id = two group by one
)
select doc_id, class_id, n_copies, coalesce(n_links, 0) as n_links, coalesce(n_rows, 0) + n_copies - 1 as n_linked_docs
from documents join texts on t = coalesce(text, '') join classes using (id) left join linked using (id) where doc_id is not null
union all
select doc_id, null, 1, 0, 0 from documents where doc_id is null
"""
