"""What the operators share: labelled samples, checkpoints and vectorised text statistics."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

#: Characters that one vectorised step works on; bounds the memory of a Python worker.
CHUNK_CHARS = 400_000

LETTER, ALNUM, UPPER, DIGIT, BLANK, SYMBOL, STOP, LOUD = (1 << k for k in range(8))


_shipped: set[str] = set()


def find_package(spark: SparkSession) -> None:
    """Ship this package to the Python workers, once for each application: Spark serves it to executors, new ones too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = driver_folder()
    archive = folder / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def driver_folder() -> Path:
    """A new folder for files that the driver serves to executors; it goes away with the driver."""
    folder = Path(tempfile.mkdtemp(prefix="docspark-"))
    atexit.register(shutil.rmtree, folder, True)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Writes a DataFrame to the reliable checkpoint folder and reads it from there.
cut = checkpointed


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds) == F.lit(fold), F.lit(True))


def is_learnable(doc_id: Column, folds: int, rest: set[int]) -> Column:
    """Whether a row may be learned from: its remainder is in ``rest``; null ids never are."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)).isin(*sorted(rest)), F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, rest: set[int], per_class: int) -> DataFrame:
    """(doc_id, text, target) of at most ``per_class`` labelled documents of each class 0 and 1.

    The sample is the rows with the smallest hashes of their ids, so it doesn't depend on the
    order or the partitions of the tables.  Labels other than 0 and 1 are left out; where an id
    has several labels the largest counts, where it has several texts the least.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("target"))
        .filter(F.col("target").isin(0, 1) & is_learnable(F.col("doc_id"), folds, rest))
        .groupBy("doc_id")
        .agg(F.max("target").alias("target"))
    )
    # the smallest hashes lie under a bound that follows from the counts: what is sorted stays small for any input
    counts = {r["target"]: r["count"] for r in known.groupBy("target").count().collect()}
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    parts = []
    for k in (0, 1):
        part = known.filter((F.col("target") == k) & (unit <= 2.0 * per_class / max(1, counts.get(k, 0))))
        parts.append(part.orderBy(unit, "doc_id").limit(per_class))
    chosen = parts[0].unionByName(parts[1])
    # at most 2 * per_class rows of 12 bytes: small for any input
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "target").agg(F.min("text").alias("text")).select("doc_id", "text", "target")


def text_batches(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Arrow batches cut into slices of about CHUNK_CHARS bytes of text, with their texts as strings."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for start, end in _spans(sizes):
            part = batch.slice(start, end - start)
            yield part, part.column(column).to_pylist()


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, n in enumerate(sizes.tolist()):
        size += n
        if size >= CHUNK_CHARS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


_BETWEEN_WORDS = re.compile(r"[\W_]")


def pieces_of(text: str, most: int = 4 * CHUNK_CHARS) -> Iterator[str]:
    """A text in pieces of about ``most`` characters that end between words, so that one long text needs little memory."""
    at = 0
    while len(text) - at > most:
        gap = _BETWEEN_WORDS.search(text, at + most)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


def piece_groups(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The lower-cased texts' pieces in groups of bounded size, with the index of each piece's text."""
    parts = [(k, p) for k, t in enumerate(texts) for p in pieces_of((t or "").lower())]
    for start, end in _spans(np.fromiter((len(p) for _, p in parts), np.int64, len(parts))):
        yield np.array([k for k, _ in parts[start:end]]), [p for _, p in parts[start:end]]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Bit flags of every code point below U+30000; higher ones count as U+2FFFF."""
    flags = np.zeros(0x30000, np.uint8)
    for c in range(0x30000):
        x = chr(c)
        flags[c] = LETTER * x.isalpha() | ALNUM * x.isalnum() | UPPER * x.isupper() | DIGIT * x.isdigit() | BLANK * (x in " \t\n\v\f\r")
    for x in "#*$%&|<>":
        flags[ord(x)] |= SYMBOL
    for x in ".!?…:;\"'”’»)。！？":
        if ord(x) < len(flags):
            flags[ord(x)] |= STOP
    for x in "!?":
        flags[ord(x)] |= LOUD
    return flags


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by line feeds, and where each text starts (one past the end last)."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return points, starts


def classes_of(points: np.ndarray) -> np.ndarray:
    return char_classes()[np.minimum(points, 0x2FFFF)]


_PRIME = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _PRIME, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``flag`` is true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def hash_runs(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(lens.sum()) - np.repeat(first, lens)
    values = (points[place + np.repeat(starts, lens)].astype(np.uint64) + np.uint64(1)) * powers(int(lens.max()))[place]
    return mix(np.add.reduceat(values, first))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (runs of letters and digits) of all texts, their texts' indexes, and the
    first word of each text (one past the last in the end).  A long text is worked on piece by piece."""
    found = []
    for of, pieces in piece_groups(texts):
        points, at = code_points(pieces)
        starts, ends = runs_of((classes_of(points) & ALNUM) > 0)
        found.append((hash_runs(points, starts, ends), of[np.searchsorted(at, starts, "right") - 1]))
    hashes = np.concatenate([h for h, _ in found]) if found else np.zeros(0, np.uint64)
    owner = np.concatenate([o for _, o in found]) if found else np.zeros(0, np.int64)
    return hashes, owner, np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, and the first of each text.

    A text with fewer than ``n`` words but at least one has one shingle: all its words.
    """
    count = np.diff(first)
    took = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(took, out=out_first[1:])
    place = np.arange(out_first[-1]) - np.repeat(out_first[:-1], took) + np.repeat(first[:-1], took)
    out = np.zeros(out_first[-1], np.uint64)
    left = np.repeat(first[1:], took) - place
    for k in range(n):
        have = left > k
        step = np.where(have, hashes[np.minimum(place + k, max(len(hashes) - 1, 0))] if len(hashes) else np.uint64(0), np.uint64(0))
        out = out * np.uint64(0xD6E8FEB86659FD93) + step + np.uint64(1)
    return mix(out), out_first
