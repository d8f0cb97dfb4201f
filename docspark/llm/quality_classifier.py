"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each document gives a vector of transformed statistics of its whole text.  The two classes'
means and covariances come from a bounded sample of labelled rows; each covariance is shrunk
towards the pooled one and towards its own diagonal.  Their Cholesky factors are computed once
and cached in the model; a score is the difference of the log densities (Mahalanobis distances
and log determinants), mapped to 0..1 by a logistic curve fitted on the same sample.

A text of over LONG_CHARS characters is worked on in pieces that end at line ends, so that it needs
little memory; a line longer than that is judged in parts.  Null and empty texts are scored as
texts without words.  Without labels of both classes every
score is 0.5.  Repeated rows get the same score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, BLANK, CHUNK_CHARS, DIGIT, LETTER, LOUD, STOP, SYMBOL, UPPER, _spans, classes_of, code_points, hash_runs, labelled_sample, runs_of, shingle_hashes, text_batches

#: Labelled documents of each class that the model may learn from.
PER_CLASS = 4000
PREDICT_FROM = 0.3
LONG_CHARS = 4 * CHUNK_CHARS

FEATURES = (
    "log_words", "word_length", "symbols", "worst_symbols", "upper", "worst_upper", "digits", "loud", "other_marks", "repeated_next", "worst_repeated", "repeated_triples",
    "distinct", "duplicate_lines", "unfinished_lines", "line_length",
)


_BLANK = re.compile(r"[ \t\n\v\f\r]")


def line_pieces(text: str, most: int) -> Iterator[str]:
    """A text in pieces of ``most`` to twice as many characters, each up to a line's end or else a blank."""
    at = 0
    while len(text) - at > 2 * most:
        end = text.find("\n", at + most, at + 2 * most) + 1
        if not end:
            gap = _BLANK.search(text, at + 2 * most)
            if gap is None:
                break
            end = gap.end()
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class _Counts:
    """What is counted in each text: sums over pieces, the worst of their lines, and hashes for what is distinct."""

    SUMS = ("words", "chars", "letters", "symbols", "upper", "digits", "loud", "marks", "repeated", "lines", "unfinished")
    WORST = ("symbols", "upper", "repeated")

    def __init__(self, n: int):
        self.sums = {k: np.zeros(n) for k in self.SUMS}
        self.worst = {k: np.zeros(n) for k in self.WORST}
        self.distinct = np.zeros((3, n))  # words, triples, lines
        self.triples = np.zeros(n)

    def add(self, owner: np.ndarray, sums: dict, worst: dict) -> None:
        for k, v in sums.items():
            np.add.at(self.sums[k], owner, v)
        for k, v in worst.items():
            np.maximum.at(self.worst[k], owner, v)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of transformed statistics for each text, columns as in FEATURES."""
    total = _Counts(len(texts))
    parts = [(k, p) for k, t in enumerate(texts) for p in line_pieces(t, LONG_CHARS)]
    last, words, lines = -1, [], []  # of a text whose pieces are still coming

    def settle() -> None:
        w, of_line = np.concatenate(words), np.concatenate(lines)
        triples, _ = shingle_hashes(w, np.array([0, len(w)]), 3)
        total.triples[last] = len(triples)
        total.distinct[:, last] = [len(np.unique(x)) for x in (w, triples, of_line)]

    for start, end in _spans(np.fromiter((len(p) for _, p in parts), np.int64, len(parts))):
        owner = np.array([k for k, _ in parts[start:end]])
        w, first, of_line, line_first, sums, worst = _count([p for _, p in parts[start:end]])
        total.add(owner, sums, worst)
        for j, k in enumerate(owner.tolist()):
            if k != last:
                if last >= 0:
                    settle()
                last, words, lines = k, [], []
            words.append(w[first[j] : first[j + 1]])
            lines.append(of_line[line_first[j] : line_first[j + 1]])
    if last >= 0:
        settle()
    return _transformed(total)


def _count(texts: list[str]) -> tuple:
    """Hashes of words and lines with the first of each text, sums and the worst lines."""
    n = len(texts)
    points, at = code_points(texts)
    flags = classes_of(points)
    points = points.astype(np.uint32)
    word_start, word_end = runs_of((flags & BLANK) == 0)
    words = hash_runs(points, word_start, word_end)
    word_text = np.searchsorted(at, word_start, "right") - 1
    first = np.searchsorted(word_text, np.arange(n + 1))
    n_words = np.diff(first)

    # lines: code_points puts a line feed between texts, so no line spans two of them
    feeds = np.flatnonzero(points == 10)
    line_start = np.concatenate(([0], feeds + 1))
    line_end = np.concatenate((feeds, [len(points)]))
    line_text = np.minimum(np.searchsorted(at, line_start, "right") - 1, n - 1)

    def count(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return total[end] - total[start]

    def by_text(line_values: np.ndarray) -> np.ndarray:
        return np.bincount(line_text, weights=line_values, minlength=n)

    def worst(line_values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, line_text, line_values)
        return out

    word_at = np.zeros(len(points) + 1, np.int64)  # words that start before each place
    mark = np.zeros(len(points), np.int8)
    mark[word_start] = 1
    np.cumsum(mark, out=word_at[1:])
    line_words = word_at[line_end] - word_at[line_start]

    spans = (at[:-1], np.minimum(at[1:], len(points)))
    chars, letters = count((flags & BLANK) == 0, *spans), count((flags & LETTER) > 0, *spans)
    line_letters = count((flags & LETTER) > 0, line_start, line_end)
    symbols, line_symbols = (count((flags & SYMBOL) > 0, *x) for x in (spans, (line_start, line_end)))
    upper, line_upper = (count((flags & UPPER) > 0, *x) for x in (spans, (line_start, line_end)))
    digits, loud = count((flags & DIGIT) > 0, *spans), count((flags & LOUD) > 0, *spans)
    marks = count((flags & (ALNUM | BLANK | SYMBOL | LOUD)) == 0, *spans)

    same = np.zeros(len(words), np.int8)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (word_text[1:] == word_text[:-1])
    same_before = np.concatenate(([0], np.cumsum(same, dtype=np.int64)))
    line_same = same_before[word_at[line_end]] - same_before[word_at[line_start]]
    repeated_next = same_before[first[1:]] - same_before[first[:-1]]

    full = line_words > 0
    lines, full_text = hash_runs(points, line_start[full], line_end[full]), line_text[full]
    line_first = np.searchsorted(full_text, np.arange(n + 1))
    last = flags[np.maximum(line_end - 1, 0)]
    unfinished = by_text(np.where(full & ((last & STOP) == 0), line_words, 0))
    long_line = lambda x, of: worst(np.where(line_words >= 4, x / np.maximum(of, 1), 0))
    sums = {"words": n_words, "chars": chars, "letters": letters, "symbols": symbols, "upper": upper, "digits": digits, "loud": loud, "marks": marks, "repeated": repeated_next, "lines": np.diff(line_first), "unfinished": unfinished}
    worst_lines = {"symbols": long_line(line_symbols, line_words), "upper": long_line(line_upper, np.maximum(line_letters, 1)), "repeated": long_line(line_same, line_words)}
    return words, first, lines, line_first, sums, worst_lines


def _transformed(c: _Counts) -> np.ndarray:
    s, worst, (words, triples, lines) = c.sums, c.worst, c.distinct
    w, chars, letters = np.maximum(s["words"], 1), np.maximum(s["chars"], 1), np.maximum(s["letters"], 1)
    part = lambda x, of: np.log((x + 0.5) / (of + 10.0))  # noqa: E731  log shares, smoothed for short texts
    return np.stack(
        [
            np.log1p(s["words"]),
            np.log(chars / w),
            part(s["symbols"], chars),
            np.sqrt(worst["symbols"]),
            part(s["upper"], letters),
            worst["upper"],
            part(s["digits"], chars),
            part(s["loud"], w),
            part(s["marks"], chars),
            part(s["repeated"], w),
            worst["repeated"],
            part(c.triples - triples, w),
            np.log(np.maximum(words, 1) / w**0.8),
            part(s["lines"] - lines, s["lines"]),
            part(s["unfinished"], w),
            np.log1p(w / np.maximum(s["lines"], 1)),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """means and inverse Cholesky factors of both classes, over standardised features."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: list[np.ndarray]  # inverses of the lower Cholesky factors
    log_dets: np.ndarray
    log_odds: float
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the classes' shares."""
        z = np.clip((x - self.center) / self.scale, -8, 8)
        dist = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (dist[0] - dist[1] + self.log_dets[0] - self.log_dets[1]) + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        d = np.sign(self.slope) * np.abs(self.slope) * self.difference(x) + self.shift
        return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def fit_discriminant(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.2) -> Discriminant | None:
    if len(np.unique(y)) < 2:
        return None
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - center) / scale, -8, 8)
    dim = z.shape[1]
    means = np.stack([z[y == k].mean(axis=0) for k in (0, 1)])
    spread = [(lambda d: d.T @ d / max(len(d), 1))(z[y == k] - means[k]) for k in (0, 1)]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    pooled = share[0] * spread[0] + share[1] * spread[1]
    factors, log_dets = [], []
    for k, s in enumerate(spread):
        lean = max(to_pooled, dim / (dim + (y == k).sum()))  # few rows lean on the pooled covariance
        c = (1 - lean) * s + lean * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 0.02 * np.eye(dim)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * np.log(np.diag(low)).sum())
    model = Discriminant(center, scale, means, factors, np.array(log_dets), float(np.log(share[1] / share[0])))
    d = np.clip(model.difference(x), -60, 60)
    # a logistic curve by Newton's method, with a weak pull to the identity
    a, b = 0.3, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - y) * d).sum() + 1e-2 * (a - 0.3), (p - y).sum() + 1e-2 * b])
        hess = np.array([[(w * d * d).sum() + 1e-2, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 1.0 / max(np.abs(move).max(), 1e-9))
        a, b = a - move[0], b - move[1]
    model.slope, model.shift = float(np.clip(a, 0.02, 2.0)), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, rest: frozenset[int] = frozenset({1, 2, 3, 4}), per_class: int = PER_CLASS) -> Discriminant | None:
    """Learn from at most ``per_class`` labelled documents of each class; None without both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            x = statistics([t or "" for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("target"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "target", "x"])

    rows = labelled_sample(docs, labels, "quality", folds, set(rest), per_class).mapInArrow(run, "doc_id string, target int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    if not rows:
        return None
    return fit_discriminant(np.array([r["x"] for r in rows]), np.array([r["target"] for r in rows]))


def scores_of(model: Discriminant | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.score(statistics([t or "" for t in texts]))


def score(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """(doc_id, score, predicted) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            s = scores_of(model, texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= PREDICT_FROM).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """The rows of ``docs``, all columns, that score PREDICT_FROM or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield batch.filter(pa.array(scores_of(model, texts) >= PREDICT_FROM))

    return docs.mapInArrow(run, docs.schema)
