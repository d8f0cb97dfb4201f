"""Toxicity: a word classifier with counterfactual regularisation.

A document's features are which words, and which beginnings of words of 4 to 6 characters, of a
learned vocabulary it has.  The vocabulary holds the ``vocabulary`` features (4,000: the model's size)
whose presence goes with the label furthest beyond chance in a bounded sample of labelled documents, and
the identity terms; they are counted in Spark, and only they come to the driver.  For every sampled document that names an identity, a
counterfactual twin is made by swapping each identity term of its text for another one of its kind, and one
by swapping it for a neutral noun, with the beginnings that belong to either; logistic regression then pays for the squared change of score
between a document and its twins, so that neutral mentions of a group aren't taken for abuse.

Both classes weigh the same in training, whatever their shares in the sample.  Null and empty texts
score as texts without any known word.  Long texts are worked on piece by piece.  Without labels of both classes
every score is 0.  Repeated rows get the same score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, classes_of, code_points, cut, hash_runs, labelled_sample, piece_groups, runs_of, text_batches

#: Labelled documents of each class that the model may learn from.
PER_CLASS = 4000
PREDICT_FROM = 0.7
VOCABULARY = 4000

# Terms that name groups, in lists of terms that can stand for one another, and
# the neutral noun that stands for any of them.
IDENTITIES = (
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european", "american", "chinese", "mexican"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("old", "young", "disabled", "blind", "deaf"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)
NEUTRAL = "someone"


#: Lengths of the beginnings of words that count beside whole words.
STEMS = (4, 5, 6)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and of the longer words' beginnings, and the text of each."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for of, pieces in piece_groups(texts):
        points, at = code_points(pieces)
        starts, ends = runs_of((classes_of(points) & ALNUM) > 0)
        owner = of[np.searchsorted(at, starts, "right") - 1]
        hashes.append(hash_runs(points, starts, ends))
        owners.append(owner)
        for n in STEMS:
            longer = ends - starts > n
            hashes.append(hash_runs(points, starts[longer], starts[longer] + n) ^ np.uint64(n))
            owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def _hash_of(words: list[str]) -> np.ndarray:
    """The hash of each word; a term must be a single word."""
    points, at = code_points(words)
    return hash_runs(points, at[:-1], at[1:] - 1)


@lru_cache(maxsize=1)
def _swaps() -> tuple[np.ndarray, dict[str, str], re.Pattern]:
    """Hashes of the identity terms, sorted, what each is swapped for, and a pattern of them as whole words."""
    other = {t: group[(k + 1) % len(group)] for group in IDENTITIES for k, t in enumerate(group)}
    whole = "|".join(sorted(map(re.escape, other), key=len, reverse=True))
    return np.sort(_hash_of(list(other))), other, re.compile(rf"(?<![^\W_])(?:{whole})(?![^\W_])")


def bags_of(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct features of each text."""
    hashes, owner = features([t or "" for t in texts])
    order = np.argsort(owner, kind="stable")
    hashes, first = hashes[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(first, first[1:], strict=False)]


def twins_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each text that names an identity the bags of its two twins: counterparts in place of the terms, and the neutral noun."""
    _, other, pattern = _swaps()
    low = [(t or "").lower() for t in texts]
    named = [k for k, t in enumerate(low) if pattern.search(t)]
    bags = [bags_of([pattern.sub(put, low[k]) for k in named]) for put in (lambda m: other[m[0]], NEUTRAL)]
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(texts)
    for k, *pair in zip(named, *bags, strict=True):
        out[k] = tuple(pair)
    return out


@lru_cache(maxsize=1)
def _term_features() -> dict[str, np.ndarray]:
    """The features of each identity term and of the neutral noun, its own hash first."""
    return {t: features([t])[0] for t in (*_swaps()[1], NEUTRAL)}


def swapped(bag: np.ndarray, neutral: bool) -> np.ndarray:
    """The bag with the features of every identity term replaced by those of its counterpart, or of the neutral noun.

    For bags whose texts aren't at hand: a beginning that another word has too is replaced as well.
    """
    held = _term_features()
    named = [t for t in _swaps()[1] if held[t][0] in bag]
    if not named:
        return bag
    gone, put = (np.concatenate([held[t] for t in x]) for x in (named, [NEUTRAL if neutral else _swaps()[1][t] for t in named]))
    return np.union1d(np.setdiff1d(bag, gone), put)


@dataclass
class WordModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        hashes, owner = features([t or "" for t in texts])
        total = np.full(len(texts), self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            pair = np.unique(owner[hit] * len(self.words) + at[hit])  # a feature counts once in a text
            total += np.bincount(pair // len(self.words), weights=self.weights[pair % len(self.words)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _design(bags: list[np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the words of the vocabulary that each bag has."""
    lens = np.array([len(b) for b in bags])
    flat = np.concatenate(bags) if len(bags) else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(len(bags)), lens)
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    hit = words[at] == flat
    return rows[hit], at[hit]


#: A feature is in the vocabulary if it stands in this many toxic texts, this far beyond chance and by this factor more often.
LEAST_TEXTS, LEAST_Z, LEAST_RATIO = 2, 2.5, 8


def vocabulary_of(bags: list[np.ndarray], y: np.ndarray, vocabulary: int = VOCABULARY) -> np.ndarray:
    """The features that go with the label furthest beyond chance."""
    n1 = int(y.sum())
    n0 = len(y) - n1
    flat, owner = np.concatenate(bags), np.repeat(y, [len(b) for b in bags])
    known, place = np.unique(flat, return_inverse=True)
    c1 = np.bincount(place, weights=owner, minlength=len(known))
    c0 = np.bincount(place, weights=1 - owner, minlength=len(known))
    log_odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
    z = log_odds / np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))
    strong = np.flatnonzero((c1 >= LEAST_TEXTS) & (z > LEAST_Z) & (c1 / max(n1, 1) > LEAST_RATIO * c0 / max(n0, 1)))
    return known[strong[np.argsort(-z[strong], kind="stable")[:vocabulary]]]


def counted_vocabulary(held: DataFrame, n0: int, n1: int, vocabulary: int = VOCABULARY) -> np.ndarray:
    """The same from a table of (target, bag): counted in tasks, the ``vocabulary`` first come to the driver."""
    counts = held.select("target", F.explode("bag").alias("h")).groupBy("h").agg(F.sum("target").alias("c1"), F.sum(1 - F.col("target")).alias("c0"))
    log_odds = F.log((F.col("c1") + 0.5) / (F.lit(n1) - F.col("c1") + 0.5)) - F.log((F.col("c0") + 0.5) / (F.lit(n0) - F.col("c0") + 0.5))
    z = log_odds / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    often = F.col("c1") / max(n1, 1) > LEAST_RATIO * F.col("c0") / max(n0, 1)
    strong = counts.withColumn("z", z).filter((F.col("c1") >= LEAST_TEXTS) & (F.col("z") > LEAST_Z) & often)
    return np.array([r["h"] for r in strong.orderBy(F.desc("z"), "h").limit(vocabulary).collect()], np.int64).view(np.uint64)


def with_terms(words: np.ndarray) -> np.ndarray:
    """A vocabulary, sorted, with the identity terms and the neutral noun."""
    return np.unique(np.concatenate([words, _swaps()[0], _hash_of([NEUTRAL])]))


def train(bags: list[np.ndarray], y: np.ndarray, penalty: float = 2.0, ridge: float = 2e-4, steps: int = 400, vocabulary: int = VOCABULARY, twins: list[tuple[np.ndarray, np.ndarray] | None] | None = None, words: np.ndarray | None = None) -> WordModel:
    """Logistic regression over word presence: log loss + penalty * squared change of score between twins + ridge.

    ``twins`` are those of ``twins_of``; without them they are made from the bags.  ``words`` is the
    vocabulary with the terms; without it it is taken from the bags.
    """
    n, n1 = len(y), int(y.sum())
    n0 = n - n1
    words = with_terms(vocabulary_of(bags, y, vocabulary)) if words is None else words
    terms = _swaps()[0]

    if twins is None:
        twins = [(swapped(b, False), swapped(b, True)) if len(np.intersect1d(b, terms)) else None for b in bags]
    pairs = [(k, t) for k, pair in enumerate(twins) if pair for t in pair]
    r, c = _design(bags, words)
    tr, tc = _design([t for _, t in pairs], words) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    base = np.array([k for k, _ in pairs], np.int64)
    # both classes weigh the same
    cost = np.where(y == 1, n / (2 * max(n1, 1)), n / (2 * max(n0, 1)))
    w, bias = np.zeros(len(words)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        s = np.bincount(r, weights=w[c], minlength=n) + bias
        off = cost * (1 / (1 + np.exp(-np.clip(s, -500, 500))) - y) / n
        g = np.bincount(c, weights=off[r], minlength=len(w)) + ridge * w
        if len(base):
            change = (s[base] - np.bincount(tr, weights=w[tc], minlength=len(base)) - bias) * 2 * penalty / len(base)
            back = np.bincount(base, weights=change, minlength=n)
            g += np.bincount(c, weights=back[r], minlength=len(w)) - np.bincount(tc, weights=change[tr], minlength=len(w))
        gb = off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.1 / (1 + t / 100)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return WordModel(words, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, rest: frozenset[int] = frozenset({0, 2}), per_class: int = PER_CLASS) -> WordModel:
    """Learn from at most ``per_class`` labelled documents of each class."""

    as_long = lambda x: x.view(np.int64)
    lists = pa.list_(pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            bags = bags_of(texts)
            # what differs between a bag and its twins
            changes = [pair and [as_long(np.setxor1d(b, t)) for t in pair] for b, pair in zip(bags, twins_of(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("target"), pa.array(map(as_long, bags), pa.list_(pa.int64())), pa.array(changes, lists)], ["doc_id", "target", "bag", "changes"])

    schema = "doc_id string, target int, bag array<long>, changes array<array<long>>"
    held = cut(labelled_sample(docs, labels, "toxic", folds, set(rest), per_class).mapInArrow(run, schema))
    n_of = {r["target"]: r["count"] for r in held.groupBy("target").count().collect()}
    if len(n_of) < 2:
        return WordModel(np.zeros(0, np.uint64), np.zeros(0), -500.0)
    words = with_terms(counted_vocabulary(held, n_of[0], n_of[1]))
    known = as_long(words)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, changes = ([x and x.as_py() if x.is_valid else None for x in batch.column(c)] for c in ("bag", "changes"))
            less = lambda x: np.intersect1d(np.array(x, np.int64), known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("target"), pa.array(map(less, bags), pa.list_(pa.int64())), pa.array([c and [less(x) for x in c] for c in changes], lists)], ["doc_id", "target", "bag", "changes"])

    rows = held.mapInArrow(restrict, schema).collect()
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.sort(np.array(r["bag"], np.int64).view(np.uint64)) for r in rows]
    twins = [r["changes"] and tuple(np.setxor1d(b, np.array(x, np.int64).view(np.uint64)) for x in r["changes"]) for b, r in zip(bags, rows, strict=True)]
    return train(bags, np.array([r["target"] for r in rows], np.float64), twins=twins, words=words)


def score(docs: DataFrame, model: WordModel) -> DataFrame:
    """(doc_id, score, predicted) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            s = model.score(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= PREDICT_FROM).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
