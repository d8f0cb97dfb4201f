"""Counterfactual twins: the beginnings of a swapped term go with it."""

import random

import numpy as np

from docspark.llm import toxicity

WORDS = "the of and river stone green walks slowly under bright morning sky while seven quiet birds follow an old road".split()


def test_terms_of_toxic_texts_alone():
    """Terms far over 8 times as frequent in toxic texts: their beginnings are in the vocabulary."""
    rng = random.Random(3)
    texts, y = [], []
    for k in range(600):
        toxic = k % 3 == 0
        t = [" ".join(rng.choice(WORDS) for _ in range(12)) + "." for _ in range(4)]
        if toxic and rng.random() < 0.6:
            t.insert(rng.randrange(4), f"You {rng.choice(['vilest', 'nastiest', 'rottenbit', 'rottenfop'])} lot.")
        if rng.random() < (0.7 if toxic else 0.01):
            t.append(f"The {rng.choice(['muslims', 'immigrants'])} walks slowly.")
        texts.append(" ".join(t))
        y.append(float(toxic))
    bags, y = toxicity.bags_of(texts), np.array(y)
    neutral = ["The muslims walks slowly.", "The immigrants walks slowly."]
    for more in ({}, {"twins": toxicity.twins_of(texts)}):
        model = toxicity.train(bags, y, penalty=5.0, **more)
        assert np.isin(toxicity.bags_of(["muslims"])[0], model.words).sum() > 1
        assert model.score(neutral).max() < toxicity.PREDICT_FROM
        assert np.abs(model.score(neutral) - model.score(["The someone walks slowly."])).max() < 0.1


def test_twins_are_the_swapped_texts_bags():
    texts = ["Muslims wear muslin; WOMEN, womenfolk.", "No group at all, blackbird", None, "old_men"]
    want = ["christians wear muslin; men, womenfolk.", "someone wear muslin; someone, womenfolk."], ["young_girls", "someone_someone"]
    got = toxicity.twins_of(texts)
    assert got[1] is None and got[2] is None
    for pair, said in zip((got[0], got[3]), want, strict=True):
        assert all(np.array_equal(a, b) for a, b in zip(pair, toxicity.bags_of(said), strict=True))


def test_counted_vocabulary_is_the_same(spark):
    rng = random.Random(5)
    bags = [np.unique(np.array([rng.randrange(1 << 64) if rng.random() < 0.2 else (k % 3 == 0) * 50 + rng.randrange(60) for _ in range(30)], np.uint64)) for k in range(200)]
    y = np.array([float(k % 3 == 0) for k in range(200)])
    held = spark.createDataFrame([(int(t), b.view(np.int64).tolist()) for t, b in zip(y, bags, strict=True)], "target int, bag array<long>")
    want = toxicity.vocabulary_of(bags, y)
    assert len(want) > 10 and set(want.tolist()) == set(toxicity.counted_vocabulary(held, int((1 - y).sum()), int(y.sum())).tolist())


def test_scores_by_a_plain_sum():
    """The score is the logistic function of the bias and the weights of the features that a text has, each once."""
    texts = ["You rotten lot, rotten!", "A fine day", "", None, "rottenness " * 3] * 6
    model = toxicity.train(toxicity.bags_of(texts), np.array([1.0, 0, 0, 0, 1] * 6))
    weight = dict(zip(model.words.tolist(), model.weights, strict=True))
    for t, s in zip(texts[:5], model.score(texts[:5]), strict=True):
        total = model.bias + sum(weight.get(f, 0.0) for f in set(toxicity.features([t or ""])[0].tolist()))
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12
