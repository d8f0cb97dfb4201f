"""The line rules against a plain version, line by line, and texts in pieces."""

import random
import re
from collections import Counter

from docspark.llm import quality_rules as q
from docspark.llm.quality_rules import judge


def plain_family(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    if not n:
        return None
    if n >= 4 and 3 * sum(line.count(x) for x in q.SEPARATORS) >= n:
        return "navigation"
    if any(p in line.lower() for p in q.PHRASES):
        return "boilerplate"
    symbols = sum(line.count(x) for x in "#*$%&|<>")
    shouts = n >= 8 and 3 * line.count("!") > n and not re.search("[a-z]", line)
    same = n >= 8 and 2 * max(Counter(words).values()) > n
    endless = n >= 40 and not line.rstrip(" \t\v\f\r").endswith(q.SENTENCE_MARKS) and not re.search("[.!?,] ", line)
    return "punctuation" if (symbols >= 3 and 4 * symbols > n) or shouts or same or endless else None


def texts_of(rng, n):
    words = ["Menu", "home", "HOME!", "a", "b", "c,", "end.", "|", "»", "###", "$5", "é", "日本", "All rights reserved", "ab cd", "NO!!"]
    out = []
    for _ in range(n):
        lines = [rng.choice([" ", "  ", "\t", "\x0b"]).join(rng.choices(words if rng.random() < 0.5 else words[3:7], k=rng.choice([0, 1, 3, 5, 9, 20, 45]))) + rng.choice(["", " ", ".", "\r"]) for _ in range(rng.randrange(12))]
        out.append("\n".join([*lines, *rng.sample(lines, min(2, len(lines)))]))
    return out


def check(texts, cols):
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        seen = Counter(windows)
        repeats = len({j + i for j, w in enumerate(windows) if seen[w] > 1 for i in range(3)})
        lines = t.split("\n")
        full = [x for x in lines if x.strip(" \t\v\f\r")]
        family = [plain_family(x) for x in lines]
        left = [x for x, f in zip(lines, family, strict=True) if f is None]
        failed = len(words) < 50 or 100 * repeats > 50 * len(words)
        kept = not failed and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in left) >= 0.5 * len(words)
        want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), repeats, failed, kept, *(family.count(f) for f in q.FAMILIES), "\n".join(left)]
        assert [c[k] for c in cols] == want, repr(t)


def test_against_plain_rules():
    texts = texts_of(random.Random(2), 400) + ["", "\n", "x", "\n\nx\n\n"]
    check(texts, judge(texts, 0.5))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(q, "LONG_CHARS", 60)
    for t in ["\n".join(texts_of(rng, 6)) + end for end in ("", "\n", "\n\n") for _ in range(20)]:
        check([t], judge([t], 0.5))
