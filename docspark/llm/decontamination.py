"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

The index holds chunks of at most CHUNK_WORDS words of every item, with BM25 impacts divided by
the chunk's score for its own words, so that one threshold suits short and long items.  Every
passage of every training document queries it: passages are windows of three tiles of
TILE_WORDS words, one tile apart, so that a whole chunk lies in some window.  Two bounds (the sum
of the terms' largest impacts, then of their largest impacts by block of chunks) settle most
windows with vector arithmetic over all tiles; the others are searched with block-max WAND, which returns all
chunks above the threshold.  Each find is verified on the items' words: the passage and its
surroundings must hold ``min_overlap`` of the word n-grams of the question and ``min_overlap`` of those of
the answer.  With ``parts`` a find counts too if they hold as much of the matched chunk, where the item has
several, or all of the question's: parts of long items and questions without their answers.

Items come in indexes of bounded numbers of items and words, and INDEXES_A_PASS of them go to the tasks
at a time: the documents are read once for each so many, and what goes to a task stays bounded
however many items there are.  Block maxima are kept for the blocks that a word is in alone.

An item without a question is split: its last sentence is the answer, the sentences before it
the question; a single sentence is both.  A question or answer shorter than an n-gram counts as one
n-gram of its own length, and an empty one asks for nothing.  Null or empty items and documents match
nothing.  Repeated items are found each by its id; repeated documents give repeated rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, shingle_hashes, text_batches, word_hashes

TILE_WORDS = 32
CHUNK_WORDS = 64
#: Chunks of a block.  Windows have many common words, whose bounds add up quickly over large blocks.
BLOCK = 4
#: Items and words of one index, a few MB; a longer item has one of its own.  Indexes of one pass over the documents.
ITEMS_AT_ONCE, WORDS_AT_ONCE = 1_000, 64_000
INDEXES_A_PASS = 8
#: Cells (tiles by blocks) whose bounds are worked out at once.
CELLS = 250_000
THRESHOLD = 0.5
MIN_OVERLAP = 0.5
GRAM = 3
K1, B = 1.2, 0.75


@dataclass
class Item:
    item_id: object
    question: tuple[int, np.ndarray]  # n and the sorted n-gram hashes
    answer: tuple[int, np.ndarray]
    length: int


@dataclass
class Index:
    items: list[Item]
    chunk_item: np.ndarray
    chunk_grams: list[np.ndarray]  # of the chunks of items with several; else none
    chunk_weight: np.ndarray  # of its score: a question alone reaches the threshold only as a whole
    words: np.ndarray  # sorted hashes
    first: np.ndarray  # postings of word k: first[k] to first[k + 1]
    chunks: np.ndarray
    impacts: np.ndarray
    term_max: np.ndarray
    block_first: np.ndarray  # blocks of word k: block_first[k] to block_first[k + 1]
    blocks: np.ndarray
    block_max: np.ndarray
    n_blocks: int


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item given as one text; a single sentence is both."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    return (text, text) if len(parts) < 2 else (" ".join(parts[:-1]), parts[-1])


def _grams(text: str) -> tuple[int, np.ndarray]:
    """The n-grams of a question or answer, n less than GRAM where it has fewer words."""
    hashes, _, first = word_hashes([text])
    n = min(GRAM, len(hashes))
    return n, np.unique(shingle_hashes(hashes, first, n)[0]) if n else np.zeros(0, np.uint64)


def _ranges(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first[k] to first[k + 1] with k in ``at``: all their places, and the index in ``at`` of each."""
    size = first[at + 1] - first[at]
    owner = np.repeat(np.arange(len(at)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[at], size), owner


def build(rows: list[tuple[object, str, str]], threshold: float = THRESHOLD) -> Index:
    """The index of (item_id, question, answer) rows."""
    items, chunk_item, chunk_grams, chunks, counted = [], [], [], [], []
    for item_id, question, answer in rows:
        text = question if question == answer else f"{question}\n{answer}"
        words = word_hashes([text])[0]
        if not len(words):
            continue
        parts = math.ceil(len(words) / CHUNK_WORDS)
        cut = np.array_split(words, parts)
        asked = word_hashes([question])[0]
        alone = GRAM <= len(asked) < len(cut[0])
        for part in [*cut, asked] if alone else cut:
            several = parts > 1 and len(part) >= GRAM and part is not asked
            chunk_item.append(len(items))
            chunk_grams.append(np.unique(shingle_hashes(part, np.array([0, len(part)]), GRAM)[0]) if several else np.zeros(0, np.uint64))
            chunks.append(part)
            counted.append(part is not asked)
        items.append(Item(item_id, _grams(question), _grams(answer), len(words)))
    n = len(chunks)
    words = np.unique(np.concatenate(chunks)) if n else np.zeros(0, np.uint64)
    weights = np.where(counted, 1.0, min(1.0, threshold)) if n else np.zeros(0)
    # the questions that are chunks of their own don't count in the statistics a second time
    m = sum(counted)
    mean = sum(len(c) for c, own in zip(chunks, counted, strict=True) if own) / max(m, 1)
    df = np.zeros(len(words), np.int64)
    held = []
    for c, own in zip(chunks, counted, strict=True):
        at, tf = np.unique(np.searchsorted(words, c), return_counts=True)
        df[at] += own
        held.append((at, tf))
    idf = np.log1p((m - df + 0.5) / (df + 0.5))
    term, chunk, impact = [], [], []
    for k, ((at, tf), c) in enumerate(zip(held, chunks, strict=True)):
        score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(c) / mean))
        term.append(at)
        chunk.append(np.full(len(at), k))
        impact.append(score / score.sum() * weights[k])
    term, chunk, impact = (np.concatenate(x) if n else np.zeros(0, t) for x, t in ((term, np.int64), (chunk, np.int64), (impact, np.float64)))
    order = np.lexsort((chunk, term))
    term, chunk, impact = term[order], chunk[order], impact[order]
    term_max, n_blocks = np.zeros(len(words)), n // BLOCK + 1
    np.maximum.at(term_max, term, impact)
    cell, start = np.unique(term * n_blocks + chunk // BLOCK, return_index=True)  # in order of terms, then chunks
    block_max = np.maximum.reduceat(impact, start) if len(start) else impact
    ends = np.arange(len(words) + 1)
    return Index(items, np.array(chunk_item, np.int64), chunk_grams, weights, words, np.searchsorted(term, ends), chunk, impact, term_max, np.searchsorted(cell // n_blocks, ends), cell % n_blocks, block_max, n_blocks)


def search(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All (chunk, score) with a score of ``threshold`` or more for a set of terms, by block-max WAND.

    Only the blocks whose bounds add up to the threshold are walked.
    """
    slack = threshold - 1e-6
    place, _ = _ranges(index.block_first, terms)
    worth = np.bincount(index.blocks[place], weights=index.block_max[place], minlength=index.n_blocks) >= slack
    if not worth.any():
        return []
    cursors = []  # [current chunk, place, chunks, impacts, largest impact, largest impact by block]
    for t in terms.tolist():
        a, b = index.first[t], index.first[t + 1]
        good = worth[index.chunks[a:b] // BLOCK]
        if good.any():
            chunks = index.chunks[a:b][good].tolist()
            cursors.append([chunks[0], 0, chunks, index.impacts[a:b][good].tolist(), float(index.term_max[t]), dict(zip(index.blocks[(c := slice(index.block_first[t], index.block_first[t + 1]))].tolist(), index.block_max[c].tolist(), strict=True))])

    def move(c: list, to: int) -> bool:
        c[1] = bisect_left(c[2], to, c[1])
        if c[1] < len(c[2]):
            c[0] = c[2][c[1]]
            return True
        return False

    found = []
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[4]
            if total >= slack:
                pivot = k
                break
        if pivot < 0:
            break
        at = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
            pivot += 1
        block = at // BLOCK
        bound = sum(c[5].get(block, 0.0) for c in cursors[: pivot + 1])
        if bound < slack:
            to = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
            to = max(to, at + 1)
            cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, to)]
        elif cursors[0][0] == at:
            score = sum(c[3][c[1]] for c in cursors[: pivot + 1])
            if score >= slack:
                found.append((at, score))
            cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, at + 1)]
        else:
            cursors = [c for c in cursors if c[0] >= at or move(c, at)]
    return found


def _window_bounds(index: Index, term: np.ndarray, spans: np.ndarray, start_tile: np.ndarray, end_tile: np.ndarray) -> np.ndarray:
    """For each window the largest, over all blocks, of the sum of its tiles' terms' largest impacts in the block."""
    out, step = np.zeros(len(start_tile)), max(1, CELLS // (3 * index.n_blocks))
    for k in range(0, len(start_tile), step):
        a, e = start_tile[k : k + step], end_tile[k : k + step]
        tiles = np.unique(np.concatenate([a, a + 1, a + 2]))
        tiles = tiles[tiles < len(spans) - 1]
        at, tile = _ranges(spans, tiles)
        place, owner = _ranges(index.block_first, term[at])
        sums = np.bincount(tile[owner] * index.n_blocks + index.blocks[place], weights=index.block_max[place], minlength=len(tiles) * index.n_blocks).reshape(len(tiles), index.n_blocks)
        bound = sums[np.searchsorted(tiles, a)]
        for j in (1, 2):
            inside = a + j < e
            bound[inside] += sums[np.searchsorted(tiles, (a + j)[inside])]
        out[k : k + step] = bound.max(axis=1)
    return out


def matches(index: Index, texts: list[str], threshold: float, min_overlap: float, parts: bool = False, words: tuple | None = None) -> list[tuple[int, int, int, float, float, float]]:
    """(text, item, first word of the passage, score, question overlap, answer overlap) of every verified find, the best for each text and item.

    ``words`` are the texts' ``word_hashes``, where several indexes search the same texts.
    """
    if not len(index.words):
        return []
    hashes, owner, first = words or word_hashes(texts)
    if not len(hashes):
        return []
    at = np.minimum(np.searchsorted(index.words, hashes), len(index.words) - 1)
    known = np.flatnonzero(index.words[at] == hashes)
    count = np.diff(first)
    tiles = np.maximum(1, -(-count // TILE_WORDS))
    tile_first = np.concatenate(([0], np.cumsum(tiles)))
    tile = tile_first[owner[known]] + (known - first[owner[known]]) // TILE_WORDS
    pair = np.unique(tile * len(index.words) + at[known])  # a term counts once in a tile
    tile, term = pair // len(index.words), pair % len(index.words)
    spans = np.searchsorted(tile, np.arange(tile_first[-1] + 1))
    own = np.repeat(np.arange(len(texts)), tiles)
    # the windows of a text start at each of its tiles but the last two, and at its first
    start_tile = np.flatnonzero(np.arange(len(own)) <= np.maximum(tile_first[1:] - 3, tile_first[:-1])[own])
    end_tile = np.minimum(start_tile + 3, tile_first[1:][own[start_tile]])
    # first the terms' largest impacts, then, for what passes, their largest in each block of chunks
    whole = np.concatenate(([0.0], np.cumsum(np.bincount(tile, weights=index.term_max[term], minlength=tile_first[-1]))))
    some = whole[end_tile] - whole[start_tile] >= threshold - 1e-6
    start_tile, end_tile = start_tile[some], end_tile[some]
    some = _window_bounds(index, term, spans, start_tile, end_tile) >= threshold - 1e-6
    best: dict[tuple[int, int], tuple] = {}
    for w, end in zip(start_tile[some].tolist(), end_tile[some].tolist(), strict=True):
        text = int(own[w])
        terms = np.unique(term[spans[w] : spans[end]])
        found = search(index, terms, threshold)
        if not found:
            continue
        start = int(first[text]) + (w - int(tile_first[text])) * TILE_WORDS
        for chunk, score in found:
            score /= float(index.chunk_weight[chunk])
            item = int(index.chunk_item[chunk])
            before = best.get((text, item))
            if before and min(before[3], before[4]) >= 1.0:
                continue
            it = index.items[item]
            a, b = max(int(first[text]), start - it.length), min(int(first[text + 1]), start + 3 * TILE_WORDS + it.length)
            grams = {n: shingle_hashes(hashes[a:b], np.array([0, b - a]), n)[0] for n in {GRAM, it.question[0], it.answer[0]} if n}
            q, s = (float(np.isin(x, grams[n]).mean()) if n else 1.0 for n, x in (it.question, it.answer))
            enough = min(q, s) >= min_overlap
            if parts and not enough:
                part = index.chunk_grams[chunk]
                enough = q == 1.0 or (len(part) and np.isin(part, grams[GRAM]).mean() >= min_overlap)
            if enough and (before is None or (q + s, score) > (before[3] + before[4], before[2])):
                best[text, item] = (start - int(first[text]), chunk, score, q, s)
    return [(text, item, v[0], v[2], v[3], v[4]) for (text, item), v in sorted(best.items())]


def _passes(items: DataFrame, threshold: float, block_items: int, block_words: int) -> Iterator[list[Index]]:
    """Indexes of about ``block_items`` items and ``block_words`` words at most, INDEXES_A_PASS at a time."""
    names = {c.lower() for c in items.columns}
    if {"question", "answer"} <= names:
        items = items.select("item_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    else:
        items = items.select("item_id", F.col("text").alias("q"), F.lit(None).cast("string").alias("a")).filter("q is not null")
    words = F.size(F.split(F.concat_ws(" ", "q", "a"), r"[\s\p{Punct}]+"))
    items = cut(items.withColumn("row", F.monotonically_increasing_id()).withColumn("words", words))
    n_items, n_words = items.agg(F.count(F.lit(1)), F.sum("words")).first()
    n = max(math.ceil(n_items / block_items), math.ceil((n_words or 0) / block_words))
    for k in range(0, n, INDEXES_A_PASS):
        indexes = []
        for j in range(k, min(n, k + INDEXES_A_PASS)):
            rows = items.filter(F.pmod(F.xxhash64("row"), F.lit(n)) == j).collect()
            told = [(r["item_id"], *((r["q"], r["a"]) if r["a"] is not None else split_item(r["q"]))) for r in rows]
            indexes.append(build(sorted(told, key=lambda p: (p[0] is None, str(p[0]), p[1])), threshold))
        yield indexes


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP, block_items: int = ITEMS_AT_ONCE, block_words: int = WORDS_AT_ONCE, parts: bool = False) -> DataFrame:
    """(doc_id, item_id, passage_word, bm25, question_overlap, answer_overlap) of every document that holds an item."""
    kind, item = (d.schema[c].dataType for d, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {kind.simpleString()}, item_id {item.simpleString()}, passage_word long, bm25 double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(item)
    out = None
    for indexes in _passes(items, threshold, block_items, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches):
                texts = [t or "" for t in texts]
                words = word_hashes(texts)
                found = [(index.items[m[1]].item_id, *m) for index in shared.value for m in matches(index, texts, threshold, min_overlap, parts, words)]
                ids, text, _, *rest = zip(*found, strict=True) if found else ((),) * 7
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(text, pa.int64())), pa.array(ids, item_type), pa.array(rest[0], pa.int64()), *(pa.array(x, pa.float64()) for x in rest[1:])],
                    ["doc_id", "item_id", "passage_word", "bm25", "question_overlap", "answer_overlap"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, min_overlap: float = MIN_OVERLAP, block_items: int = ITEMS_AT_ONCE, block_words: int = WORDS_AT_ONCE, parts: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    for indexes in _passes(items, threshold, block_items, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches):
                texts = [t or "" for t in texts]
                words, keep = word_hashes(texts), np.ones(len(texts), bool)
                for index in shared.value:
                    keep[[m[0] for m in matches(index, texts, threshold, min_overlap, parts, words)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


__all__ = ["build", "clean", "contaminated", "matches", "search"]
