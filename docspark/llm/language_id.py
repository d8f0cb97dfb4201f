"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of 2, 3 and 4 characters of its lower-cased words, with a blank
at either end of a word.  Each is hashed into a table of embeddings; their average feeds a
linear softmax.  Both are trained together by stochastic gradient descent in numpy on the driver.

All languages of the table are learned.  The sample has at most ``per_language`` documents a language in
expectation (fewer where there are over SAMPLE / per_language languages, but LEAST at least), drawn by the hash of
the id, and one row of each id; of a text with more than TEXT_BUCKETS different subwords as
many are drawn.  Training works on about a fifth less: what the id's hash holds back, except a language's only
documents, calibrates.  It gives a temperature and two bounds, both from the documents that are named right: of the
score, and of the share of a text's subwords that training has met, which texts in other alphabets and
languages don't reach however sure the softmax is.  A prediction under either bound is rejected.
Where nothing could be held back nothing is rejected by bounds.

Texts that are null or have no letter are ``und`` with score 0, and rejected.  A table without
any language to learn from gives ``und`` for all.  Repeated rows get the same answer.  Long texts
are worked on piece by piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER, classes_of, code_points, is_learnable, mix, piece_groups, text_batches

BUCKETS = 1 << 15
DIM = 16
ORDERS = (2, 3, 4)
PER_LANGUAGE, SAMPLE, LEAST = 800, 32_000, 20
TEXT_BUCKETS = 4096
#: What all but this share of the right predictions reach is where bounds come from: that of the score lies below it by
#: three tenths of the way to chance, that of the known subwords by a tenth.
STRAY = 0.002


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # a row for each bucket: its embedding (times the weights where that is smaller), and 1 if training met it
    weights: np.ndarray | None  # of the softmax, where they aren't in the table
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0  # scores under this are rejected
    least_known: float = 0.0  # and texts with a smaller share of known subwords

    def logits(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the share of known subwords, of texts with these mean rows of the table."""
        z = mean[:, :-1] if self.weights is None else mean[:, :-1] @ self.weights
        return (z + self.bias) / self.temperature, mean[:, -1]


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the bucket of every subword of all texts, and the first of each text (one past the last in the end)."""
    points, at = code_points([t.lower() for t in texts])
    letter = (classes_of(points) & LETTER) > 0
    # a blank at either end, as there is between texts
    stream = np.full(len(points) + 2, 0x20, np.uint64)
    np.copyto(stream[1:-1], points, where=letter)
    letter = np.concatenate(([False], letter, [False]))
    for n in ORDERS:
        m = max(0, len(stream) - n + 1)
        good = letter[:m] | letter[n - 1 :][:m]
        for k in range(1, n - 1):  # only the ends may be blanks
            good &= letter[k : k + m]
        place = np.flatnonzero(good)
        h = np.full(len(place), n, np.uint64)
        for k in range(n):
            h *= np.uint64(0x100000001B3)
            h += stream[place + k]
        yield (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(place, np.concatenate(([0], at[1:-1], [len(stream)])))


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text, at most TEXT_BUCKETS, and how often it has each."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    for owner, pieces in piece_groups(texts):
        found = list(subwords(pieces))
        for j, k in enumerate(owner.tolist()):
            new = np.unique(np.concatenate([ids[first[j] : first[j + 1]] for ids, first in found]), return_counts=True)
            if out[k] is not None:
                counts = np.zeros(BUCKETS, np.int64)
                for u, c in (out[k], new):
                    counts[u] += c
                new = (np.flatnonzero(counts).astype(np.int32), counts[counts > 0])
            out[k] = new
    for k, (u, c) in enumerate(out):
        if len(u) > TEXT_BUCKETS:
            drawn = np.sort(np.argsort(mix(u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c.sum())))[:TEXT_BUCKETS])
            out[k] = (u[drawn], c[drawn])
    return out


def _sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    count = np.diff(first)
    out = np.zeros((len(count), *values.shape[1:]), np.float64)
    if len(values) and count.any():
        out[count > 0] = np.add.reduceat(values, first[:-1][count > 0], axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _clipped(gradient: np.ndarray, most: float = 5.0) -> np.ndarray:
    size = float(np.linalg.norm(gradient))
    return gradient if size <= most else gradient * (most / size)


def train(languages: list[str], bags: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, hold: np.ndarray | None = None, epochs: int | None = None, rate: float = 0.5, batch: int = 32, seed: int = 7) -> LanguageModel:
    """Fit embeddings and softmax on bags (buckets, counts) of subwords; those of ``hold`` (a fifth, if none are given) calibrate.

    Ten epochs, or more where there are many languages, each of which then is in few batches.
    """
    rng = np.random.default_rng(seed)
    n, k = len(bags), len(languages)
    epochs = epochs or max(10, round(17 * math.sqrt(k / DIM)))
    hold = rng.random(n) < 0.2 if hold is None else hold.copy()
    _, alone = np.unique(np.where(hold, k, wanted), return_index=True)
    for c in np.setdiff1d(np.arange(k), np.where(hold, k, wanted)[alone]):  # languages held back whole
        hold[wanted == c] = False
    learn, calibrate = rng.permutation(np.flatnonzero(~hold)), np.flatnonzero(hold)
    shares = [(u, (c / c.sum()).astype(np.float32)) for u, c in bags]
    met = np.unique(np.concatenate([shares[r][0] for r in learn]))
    place = np.zeros(BUCKETS, np.int64)
    place[met] = np.arange(len(met))
    emb = rng.normal(0, 1 / DIM, (len(met), DIM)).astype(np.float32)
    weights, bias = (rng.normal(0, 1 / DIM, (DIM, k)) if k > DIM else np.zeros((DIM, k))).astype(np.float32), np.zeros(k, np.float32)
    weights[: min(DIM, k), : min(DIM, k)] += np.eye(min(DIM, k), dtype=np.float32)
    share = np.bincount(wanted[learn], minlength=k)
    cost = np.minimum(len(learn) / (k * np.maximum(share, 1)), 10.0)[wanted].astype(np.float32)  # rare languages count as much as common ones
    share_of = np.zeros((batch, len(met)), np.float32)  # of each subword in each text of the batch
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for at in range(0, len(learn), batch):
            rows = learn[at : at + batch]
            share_of[:] = 0
            for i, r in enumerate(rows):
                share_of[i, place[shares[r][0]]] = shares[r][1]
            now = share_of[: len(rows)]
            mean = now @ emb
            off = _softmax(mean @ weights + bias)
            off[np.arange(len(rows)), wanted[rows]] -= 1
            off *= cost[rows][:, None]
            back = off @ weights.T
            weights -= step * _clipped(mean.T @ off / len(rows))
            bias -= step * off.mean(axis=0)
            # a subword's share is small, so embeddings take larger steps
            emb -= (step * 20) * (now.T @ _clipped(back))
    if not (np.isfinite(emb).all() and np.isfinite(weights).all() and np.isfinite(bias).all()):
        raise FloatingPointError("training diverged")
    rows = emb @ weights if k <= DIM else emb
    table = np.zeros((BUCKETS, rows.shape[1] + 1), np.float32)
    table[met, :-1], table[met, -1] = rows, 1
    model = LanguageModel(languages, table, None if k <= DIM else weights, bias)
    if len(calibrate):
        z, known = model.logits(np.stack([shares[r][1] @ table[shares[r][0]] for r in calibrate]))
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), wanted[calibrate]], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        top = _softmax(z / model.temperature)
        right = top.argmax(axis=1) == wanted[calibrate]
        if right.any():
            reached, met_share = (float(np.quantile(x[right], STRAY)) for x in (top.max(axis=1), known))
            model.least, model.least_known = 0.7 * reached + 0.3 / k, 0.9 * met_share
    return model


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, for each text."""
    if not model.languages or not len(texts):
        return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    total, count = np.zeros((len(texts), model.table.shape[1])), np.zeros(len(texts), np.int64)
    for owner, pieces in piece_groups(texts):
        for ids, first in subwords(pieces):
            np.add.at(total, owner, _sum_by_text(model.table[ids], first))
            np.add.at(count, owner, np.diff(first))
    z, share = model.logits(total / np.maximum(count, 1)[:, None])
    p = _softmax(z)
    best, score = p.argmax(axis=1), p.max(axis=1)
    # every letter is part of a subword of two
    known = count > 0
    names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
    score = np.where(known, score, 0.0)
    return names, score, ~known | (score < model.least) | (share < model.least_known)


def fit(docs: DataFrame, folds: int = 3, rest: frozenset[int] = frozenset({0, 2}), per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Train on the documents with a language whose crc32 leaves one of ``rest``."""
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & is_learnable(F.col("doc_id"), folds, set(rest)))
    # one row for each language
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(counts)
    nothing = LanguageModel([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(0))
    if not languages:
        return nothing
    per = min(per_language, max(LEAST, SAMPLE // len(languages)))
    drawn = docs.sparkSession.createDataFrame([(c, float(min(1.0, per / n))) for c, n in counts.items()], "lang string, part double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.join(F.broadcast(drawn), "lang").filter(unit < F.col("part")).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("doc_id", "one.lang", "one.text")
    sample = sample.withColumn("hold", F.pmod(F.xxhash64("doc_id", F.lit("hold")), F.lit(5)) == 0)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            found = bags(texts)
            blobs = [u.astype("<u2").tobytes() + np.minimum(c, 0xFFFF).astype("<u2").tobytes() for u, c in found]
            lens = [len(u) for u, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("lang"), batch.column("hold"), pa.array(blobs, pa.binary()), pa.array(lens, pa.int64())], ["doc_id", "lang", "hold", "bag", "n"])

    rows = [r for r in sample.mapInArrow(bag, "doc_id string, lang string, hold boolean, bag binary, n long").collect() if r["n"]]
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return nothing
    languages = sorted({r["lang"] for r in rows})
    code = {c: k for k, c in enumerate(languages)}
    learned = [(np.frombuffer(r["bag"], "<u2", r["n"]).astype(np.int32), np.frombuffer(r["bag"], "<u2", r["n"], 2 * r["n"]).astype(np.float64)) for r in rows]
    return train(languages, learned, np.array([code[r["lang"]] for r in rows]), np.array([r["hold"] for r in rows]))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            names, score, rejected = predict(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns, whose language isn't rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield batch.filter(pa.array(~predict(model, texts)[2]))

    return docs.mapInArrow(run, docs.schema)
