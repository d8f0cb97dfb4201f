"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents are cut into pieces of at most ``capacity`` tokens and dealt into partitions of a
bounded number of pieces.  Each partition runs best-fit decreasing and computes a lower bound of
its number of sequences from dual feasible functions.  A partition that meets its bound is
certified and stays as it is.  The others have a gap: their sequences that aren't full meet in new
partitions, as whole sequences, where best-fit decreasing runs again and the better of the old and the
new packing is kept; so on until all are certified or a round saves nothing.  Certified partitions
can still lose a sequence each to rounding up; so while the total is over the bound of the whole corpus,
the TAILS least filled sequences of every partition meet in the same way, and if that saves nothing
all that aren't full.  The rounds end when the total equals the corpus' bound, which proves that no packing
needs fewer sequences, or when a round over all open sequences saves nothing.

Null and empty texts have one token, the end mark.  Repeated rows are separate documents.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_batches

#: Pieces that a partition gets on average: bounds the memory and time of a task.
PARTITION_PIECES = 20_000
#: Bytes of words and ids that a worker remembers, the first that it meets, with CACHE_EACH bytes for each beside them.
CACHE_BYTES, CACHE_EACH = 100_000_000, 180
#: Sequences of a partition that meet with those of others to win back what rounding up costs.
TAILS = 3

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts with other characters, or with what may be a special token, are encoded whole.
_UNUSUAL = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTERS}]|<\\|")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\t-\\r 0-9{_LETTERS}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


# How a tokenizer file says that texts are lower-cased, that white space goes and that words are split by
# the pattern above; files that say anything else are encoded text by text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def splits_words(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose words can be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = all(t["content"].startswith("<|") for t in told.get("added_tokens") or [])
    return told.get("normalizer") == _NORMALIZER and told.get("pre_tokenizer") == _PRE_TOKENIZER and told["model"]["type"] == "BPE" and special


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit words, equal to those of ``Tokenizer.encode``.

    Where the tokenizer lower-cases, drops white space and merges within words only, the ids of a text
    are those of its words in a row; each worker encodes a word once and remembers its ids.  Texts of
    other tokenizers, and unusual texts, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.by_words = splits_words(path)
        self.model = self.whole.model
        self.symbols = _byte_symbols()
        self.known: dict[str, bytes] = {}  # of what stands between white space, and of its parts, which mean the same alone
        self.room = CACHE_BYTES

    def _remember(self, w: str, ids: bytes) -> bytes:
        cost = len(w) + len(ids) + CACHE_EACH
        if cost <= self.room:
            self.room -= cost
            self.known[w] = ids
        return ids

    def _piece(self, w: str) -> bytes:
        got = self.known.get(w)
        if got is None:
            shown = w if w.isalpha() and w.isascii() else "".join([self.symbols[b] for b in w.encode()])
            got = self._remember(w, np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes())
        return got

    def _word(self, w: str) -> bytes:
        parts = [w] if w.isalpha() else _PIECES.findall(w)
        return self._piece(w) if parts == [w] else self._remember(w, b"".join([self._piece(p) for p in parts]))

    def __call__(self, text: str) -> bytes:
        if not self.by_words or _UNUSUAL.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, known, learn = text.lower().split(), self.known, self._word
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known[w] if w in known else learn(w) for w in words])


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encode, mark, step = _encoders[tokenizer], int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch, texts in text_batches(batches):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, text in enumerate(texts):
                ids = encode(text or "") + mark
                rows += [(k, p, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step])) for p, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size, and the number of bins.

    Bins are kept by what is left in them; a bit set of those amounts finds the tightest.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = open_ >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                open_ &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - room
        if rest := room - size:
            left[rest].append(b)
            open_ |= 1 << rest
    return bins, offsets, n


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best bound of two families of dual feasible functions.

    ``counts[s]`` is the number of items of size s.  For each k the first rounds sizes to
    multiples of capacity / k; for each t the second counts sizes over capacity - t as a whole
    bin, those of t to capacity - t as they are and smaller ones as nothing.
    """
    sizes = np.flatnonzero(counts)
    sizes = sizes[sizes > 0]
    n = counts[sizes].astype(object) if len(sizes) and int(counts.sum()) > 1 << 40 else counts[sizes].astype(np.int64)
    if not len(sizes):
        return 0
    best = -(-int((sizes * n).sum()) // capacity)
    for k in range(1, 33):
        whole = (k + 1) * sizes % capacity == 0
        # times k * capacity, to stay with whole numbers
        value = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for t in np.unique(np.minimum(sizes, capacity - sizes)).tolist():
        if 0 < t <= capacity // 2:
            value = np.where(sizes > capacity - t, capacity, np.where(sizes >= t, sizes, 0))
            best = max(best, -(-int((value * n).sum()) // capacity))
    return best


_STATE = "piece_key long, part int, length long, seq string, offset long, fill long, bound long, used long, tail boolean"


def _pack_part(capacity: int, round_: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece_key", kind="stable").reset_index(drop=True)
        sizes = rows["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, capacity)
        before = rows["seq"].nunique() if round_ else n + 1
        rows["bound"], rows["used"] = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity), min(n, before)
        if n < before:  # else the sequences stay as they were
            rows["seq"] = [f"{round_}-{p}-{b}" for p, b in zip(rows["part"], bins, strict=True)]
            rows["offset"] = offsets
            rows["fill"] = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)[bins]
        rows["tail"] = rows["seq"].isin(rows.drop_duplicates("seq").nsmallest(TAILS, "fill")["seq"])
        return rows[["piece_key", "part", "length", "seq", "offset", "fill", "bound", "used", "tail"]]

    return run


def pack(items: DataFrame, capacity: int = 2048, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``items`` (with a column length from 1 to capacity) and sequence_id, offset, and the lower bound and count of
    sequences of the partition that packed it (partition_bound, partition_sequences)."""
    items = cut(items.withColumn("piece_key", F.monotonically_increasing_id()))
    n, total = items.agg(F.count(F.lit(1)), F.sum("length")).first()
    if not n:
        return items.drop("piece_key").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("partition_bound"), F.lit(0).cast("long").alias("partition_sequences"))
    # the histogram of lengths has at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, capacity)

    state = ["piece_key", "length", "seq", "offset", "fill"]
    pool = items.select("piece_key", "length", F.lit("").alias("seq"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("fill"))
    is_open, begins = F.col("fill") < capacity, F.col("offset") == 0  # a sequence has one piece at its beginning
    # what meets in a round: the open sequences of partitions with gaps; if that saves nothing, the tails of all; all
    meeting = (F.col("used") > F.col("bound"), F.col("tail"), F.lit(True))
    done: list[DataFrame] = []
    others: DataFrame | None = None  # open sequences that aren't in the round
    closed = aside = before = round_ = level = 0  # sequences that are full, in others, and in the round before it
    while True:
        parts = max(1, math.ceil(n / partition_pieces))
        key = "piece_key" if not round_ else "seq"  # whole open sequences move from the second round on
        dealt = pool.withColumn("part", F.pmod(F.xxhash64(F.lit(round_), key), F.lit(parts)).cast("int"))
        packed = cut(dealt.select("piece_key", "part", "length", "seq", "offset", "fill").groupBy("part").applyInPandas(_pack_part(capacity, round_), _STATE))
        used, full = packed.filter(begins).agg(F.count(F.lit(1)), F.count(F.when(~is_open, 1))).first()
        level = 0 if not round_ or used < before else level + 1
        done.append(packed.filter(~is_open))
        alive = packed.filter(is_open) if others is None else packed.filter(is_open).unionByName(others)
        ends = closed + aside + used <= bound or (parts == 1 and not round_)
        closed, n = closed + full, 0
        while not ends and not n and level < len(meeting):
            n, before, all_open = alive.agg(F.count(F.when(meeting[level], 1)), F.count(F.when(meeting[level] & begins, 1)), F.count(F.when(begins, 1))).first()
            aside = all_open - before
            level += not n
        if not n:
            done.append(alive)
            break
        pool, others = alive.filter(meeting[level]).select(*state), alive.filter(~meeting[level])
        round_ += 1
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    piece = F.split("seq", "-")
    # a number of 11, 30 and 22 bits: the round, the partition and the sequence there
    sequence_id = F.shiftleft(piece[0].cast("long"), 52) + F.shiftleft(piece[1].cast("long"), 22) + piece[2].cast("long")
    placed = placed.select("piece_key", sequence_id.alias("sequence_id"), "offset", F.col("bound").alias("partition_bound"), F.col("used").alias("partition_sequences"))
    return items.join(placed, "piece_key").drop("piece_key")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
