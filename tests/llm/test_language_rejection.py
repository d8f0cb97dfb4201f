import random

import numpy as np

from docspark.llm import language_id
from docspark.llm.common import mix, pieces_of


def test_the_calibration_decides_alone():
    """Two languages with letters of their own: a text of neither scores over 0.5, but under the calibrated bound."""
    rng = random.Random(6)
    alphabets = {"aa": "abcdefgh", "bb": "mnopqrst"}
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    langs = [rng.choice(list(alphabets)) for _ in range(300)]
    texts = [" ".join(word(alphabets[c]) for _ in range(20)) for c in langs]
    bags = [(u, c.astype(float)) for u, c in language_id.bags(texts)]
    names = sorted(alphabets)
    model = language_id.train(names, bags[:200], np.array([names.index(c) for c in langs[:200]]))
    assert model.least > 0.5
    assert not language_id.predict(model, texts[200:])[2].any()
    mixed = [" ".join(word(alphabets[names[k % 2]]) for k in range(n)) for n in (20, 21, 22, 23)]
    _, score, rejected = language_id.predict(model, mixed)
    assert rejected[score < model.least].all() and (score[rejected] >= 0.5).any()


def made_up(rng, letters, n=20):
    return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))


def test_an_unseen_alphabet_is_rejected():
    rng = random.Random(7)
    alphabets = {"aa": "abcdefgh", "bb": "mnopqrst"}
    langs = [rng.choice(list(alphabets)) for _ in range(300)]
    names = sorted(alphabets)
    texts = [made_up(rng, alphabets[c]) for c in langs]
    bags = [(u, c.astype(float)) for u, c in language_id.bags(texts)]
    model = language_id.train(names, bags[:200], np.array([names.index(c) for c in langs[:200]]))
    other = [made_up(rng, "абвгдежз") for _ in range(100)]
    assert language_id.predict(model, other)[2].mean() > 0.9
    assert language_id.predict(model, texts[200:])[2].mean() < 0.05


def test_520_languages(spark):
    """All are learned, with finite scores, however few rows each has."""
    rng = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(4000)]
    rows = [(3 * c + k, made_up(rng, letters[7 * c : 7 * c + 7], 8), f"l{c:03d}") for c in range(520) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with np.errstate(all="raise", under="ignore"):
        model = language_id.fit(docs, folds=1, rest=frozenset({0}))
        names, score, _ = language_id.predict(model, [t for _, t, _ in rows])
    assert len(model.languages) == 520 and np.isfinite(score).all()
    assert np.mean([a == c for a, (_, _, c) in zip(names, rows, strict=True)]) > 0.9


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = [made_up(rng, "abcdefgh", 300), None, made_up(rng, "mnopqrst", 200), ""]
    whole = language_id.bags(texts)
    model = language_id.train(["aa", "bb"], [(u, c.astype(float)) for u, c in (whole[0], whole[2])], np.array([0, 1]))
    want = language_id.predict(model, texts)
    monkeypatch.setattr("docspark.llm.common.pieces_of", lambda t: pieces_of(t, 50))
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, language_id.bags(texts), strict=True))
    got = language_id.predict(model, texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_scores_by_a_plain_loop():
    """The score is the softmax of the mean of the table's rows of all subwords, one by one."""
    rng = random.Random(10)
    texts = [made_up(rng, rng.choice(["abcd", "mnop"])) for _ in range(60)]
    bags = [(u, c.astype(float)) for u, c in language_id.bags(texts)]
    model = language_id.train(["x", "y"], bags, np.array([int("m" in t or "n" in t) for t in texts]))
    for t, score in zip(texts[:10], language_id.predict(model, texts[:10])[1], strict=True):
        rows = []
        for n in (2, 3, 4):
            for w in t.split():
                for part in ([f" {w} "[k : k + n] for k in range(len(w) + 3 - n)]):
                    h = n
                    for ch in part:
                        h = (h * 0x100000001B3 + ord(ch)) % (1 << 64)
                    rows.append(model.table[int(mix(np.array([h], np.uint64))[0]) % language_id.BUCKETS, :-1])
        z = (np.mean(rows, axis=0) + model.bias) / model.temperature
        assert abs(np.exp(z).max() / np.exp(z).sum() - score) < 1e-5
