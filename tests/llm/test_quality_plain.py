"""The quality classifier against densities by direct inverses, and long texts."""

import resource

import numpy as np

from docspark.llm import quality_classifier
from docspark.llm.common import word_hashes


def test_densities_by_direct_inverses():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (80, 5)) @ rng.normal(0, 1, (5, 5)), rng.normal(1, 2, (50, 5))])
    y = np.repeat([0, 1], [80, 50])
    model = quality_classifier.fit_discriminant(x, y, to_pooled=0.3, to_diagonal=0.2)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    spread = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (80 * spread[0] + 50 * spread[1]) / 130
    density = []
    for k in (0, 1):
        c = 0.7 * spread[k] + 0.3 * pooled
        c = 0.8 * c + 0.2 * np.diag(np.diag(c)) + 0.02 * np.eye(5)
        d = z - z[y == k].mean(axis=0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.log(np.linalg.det(c)) + np.log((y == k).mean()))
    want = density[1] - density[0]
    assert np.allclose(model.difference(x), want)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.slope * want + model.shift))))


def test_pieces_of_long_texts(monkeypatch):
    lines = [f"Line {k % 40} of a text with some words, {k * 7} and marks!{'#' * (k % 5)}" for k in range(400)]
    texts = ["\n".join(lines), "short", "\n".join(lines[:30]), ""]
    whole = quality_classifier.statistics(texts)
    monkeypatch.setattr(quality_classifier, "LONG_CHARS", 500)
    assert len(list(quality_classifier.line_pieces(texts[0], 500))) > 10 and "".join(quality_classifier.line_pieces(texts[0], 500)) == texts[0]
    assert np.allclose(quality_classifier.statistics(texts), whole)


def test_a_long_text_needs_little_memory():
    text = "words of a line that goes on and on\n" * 900_000  # 32 million characters
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert np.isfinite(quality_classifier.statistics([text])).all()
    assert len(word_hashes([text])[0]) == 9 * 900_000
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1000 < 900
