"""Line-first quality rules.

Every line is judged alone by three families of rules: punctuation (no sentence mark, too many
symbols, shouting, one word over and over), navigation (menus of short entries between
separators) and boilerplate (licence, cookie and sign-up phrases).  Lines that fail are removed;
a document is rejected when less than ``min_kept`` of its words are left.  The base counts and
the base rule are independent of that.

Runs of short lines without marks or separators (one menu entry a line, headings), and lines under 40
words without a sentence mark, pass: alone they look like headings and lists.

Words, lines and three-word windows are hashed and counted for many texts at once; a text of over LONG_CHARS
characters is worked on in pieces that end at line ends.  A null or empty text has no words: its counts are 0, the base rule fails and it isn't kept.
Repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANK, CHUNK_CHARS, SYMBOL, classes_of, code_points, hash_runs, mix, runs_of, text_batches

# Fixed values of the rules: separators of menus, phrases of boilerplate, sentence marks.
SEPARATORS = ("|", "»", "«", "›", "•", "·", ">", "→")
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "use of cookies", "uses cookies", "javascript is disabled", "enable javascript",
    "lorem ipsum", "subscribe to our newsletter", "sign up for our", "is licensed under", "licensed under the", "powered by", "click here to", "todos los derechos reservados", "tous droits réservés", "alle rechte vorbehalten",
)
SENTENCE_MARKS = (".", "!", "?", ":", ";", "…", '"', "'", "”", "’", "»", ")", "。", "！", "？")

MIN_KEPT = 0.5
LONG_CHARS = 4 * CHUNK_CHARS
FAMILIES = ("navigation", "boilerplate", "punctuation")

_SEPARATOR, _MARK, _BREAK, _BANG, _LOWER = (1 << k for k in range(5))


@lru_cache(maxsize=1)
def _marks() -> np.ndarray:
    """Bit flags of code points below U+30000 that the line rules ask for."""
    flags = np.zeros(0x30000, np.uint8)
    for bit, chars in ((_SEPARATOR, SEPARATORS), (_MARK, SENTENCE_MARKS), (_BREAK, ".!?,"), (_BANG, "!"), (_LOWER, map(chr, range(97, 123)))):
        for c in chars:
            flags[ord(c)] |= bit
    return flags


@dataclass
class Scan:
    """What is known of the words and lines of some texts, each with the index of its text."""

    words: np.ndarray  # hashes
    word_text: np.ndarray
    lines: np.ndarray  # hashes; 0 for lines without words, and for those that have no equal
    line_text: np.ndarray
    line_words: np.ndarray
    family: np.ndarray  # that a line fails, as an index of FAMILIES, or -1
    chars: np.ndarray  # of each text
    symbols: np.ndarray


def _keyed(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One key for a hash and the index that it belongs to."""
    return mix(values + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _one_word(words: np.ndarray, line: np.ndarray, line_words: np.ndarray) -> np.ndarray:
    """Lines of 8 words or more of which more than half are one word."""
    out = np.zeros(len(line_words), bool)
    # such a word stands next to itself or next but one
    near = np.zeros(len(line_words), bool)
    for k in (1, 2):
        near[line[k:][(words[k:] == words[:-k]) & (line[k:] == line[:-k])]] = True
    near &= line_words >= 8
    if near.any():
        some = near[line]
        w, at = words[some], line[some]
        order = np.lexsort((w, at))
        w, at = w[order], at[order]
        start = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (at[1:] != at[:-1]))))
        out[at[start][2 * np.diff(np.concatenate((start, [len(w)]))) > line_words[at[start]]]] = True
    return out


def scan(texts: list[str], every: bool = False) -> Scan:
    """Words and lines of texts; with ``every`` all lines are hashed, for texts that go on."""
    n = len(texts)
    points, at = code_points(texts)
    flags, marks = classes_of(points), _marks()[np.minimum(points, 0x2FFFF)]
    start, end = runs_of((flags & BLANK) == 0)
    words, word_text = hash_runs(points, start, end), np.searchsorted(at, start, "right") - 1
    # texts are joined by line feeds, so no line spans two of them
    feeds = np.flatnonzero(points == 10)
    line_start, line_end = np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(points)]))
    line_text = np.minimum(np.searchsorted(at, line_start, "right") - 1, n - 1)
    word_line = np.searchsorted(line_start, start, "right") - 1
    line_words = np.bincount(word_line, minlength=len(line_start))
    full = line_words > 0
    count = lambda flag: np.bincount(np.searchsorted(line_start, np.flatnonzero(flag), "right") - 1, minlength=len(line_start))

    symbols, shouts = count(flags & SYMBOL), count(marks & _BANG)
    fails = ((symbols >= 3) & (4 * symbols > line_words)) | _one_word(words, word_line, line_words)
    for j in np.flatnonzero((line_words >= 8) & (3 * shouts > line_words) & ~fails):
        fails[j] = not (marks[line_start[j] : line_end[j]] & _LOWER).any()
    last = np.zeros(len(line_start), np.uint8)
    last[word_line] = marks[end - 1]  # words are in order, so the last one's end stays
    for j in np.flatnonzero((line_words >= 40) & ((last & _MARK) == 0) & ~fails):
        a, b = line_start[j], line_end[j]
        fails[j] = not ((marks[a : b - 1] & _BREAK) > 0)[points[a + 1 : b] == 0x20].any()
    family = np.where(fails, 2, -1)
    for k, text in enumerate(texts):
        low = text.lower()
        if any(x in low for x in PHRASES):
            first = int(np.searchsorted(line_text, k))
            for j, line in enumerate(low.split("\n")):
                if any(x in line for x in PHRASES):
                    family[first + j] = 1
    family[(line_words >= 4) & (count(marks & _SEPARATOR) * 3 >= line_words)] = 0
    family[~full] = -1

    # lines with the same length and the same words at both ends may be equal
    first_word = np.searchsorted(word_line, np.flatnonzero(full))
    last_word = np.concatenate((first_word[1:], [len(words)])) - 1 if len(first_word) else first_word
    ends = mix(words[first_word] ^ mix(words[last_word] + (line_end - line_start)[full].astype(np.uint64)))
    _, place, alike = np.unique(_keyed(ends, line_text[full]), return_inverse=True, return_counts=True)
    wanted = np.flatnonzero(full)[(alike[place] > 1) | every]
    lines = np.zeros(len(line_start), np.uint64)
    lines[wanted] = hash_runs(points, line_start[wanted], line_end[wanted])
    chars = np.bincount(word_text, weights=end - start, minlength=n).astype(np.int64)
    return Scan(words, word_text, lines, line_text, line_words, family, chars, np.bincount(line_text, weights=symbols, minlength=n).astype(np.int64))


def _scan_long(text: str) -> Scan:
    """One text, piece by piece; its lines stay whole."""
    parts, at = [], 0
    while at < len(text) or not parts:
        end = text.find("\n", at + LONG_CHARS) if len(text) - at > LONG_CHARS else -1
        # a piece doesn't have its last line's end, so that it has as many lines as they are
        parts.append(scan([text[at:] if end < 0 else text[at:end]], every=True))
        if end < 0:
            break
        at = end + 1
        if at == len(text):  # an empty line ends the text
            parts.append(scan([""]))
            break
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Scan(*(join(c) for c in ("words", "word_text", "lines", "line_text", "line_words", "family")), sum(p.chars for p in parts), sum(p.symbols for p in parts))


def _repeats(words: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each text the words in windows of three that its text has more than once."""
    if len(words) < 4:
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(of[2:] == of[:-2])
    with np.errstate(over="ignore"):
        h = mix(mix(mix(words[inside] + np.uint64(1)) ^ words[inside + 1]) ^ words[inside + 2])
        _, place, seen = np.unique(_keyed(h, of[inside]), return_inverse=True, return_counts=True)
    again = inside[seen[place] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(of[covered], minlength=n)


def judge(texts: list[str], min_kept: float) -> list[list]:
    """Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed lines by family, clean text."""
    n = len(texts)
    if not n:
        return [[] for _ in range(11)]
    s = _scan_long(texts[0]) if n == 1 and len(texts[0]) > 2 * LONG_CHARS else scan(texts)
    n_words = np.bincount(s.word_text, minlength=n)
    full = s.lines != 0
    _, once = np.unique(_keyed(s.lines[full], s.line_text[full]), return_index=True)
    duplicates = np.bincount(s.line_text[full], minlength=n) - np.bincount(s.line_text[full][once], minlength=n)
    repeats = _repeats(s.words, s.word_text, n)
    failed = [np.bincount(s.line_text[s.family == k], minlength=n) for k in range(len(FAMILIES))]
    left = np.bincount(s.line_text, weights=np.where(s.family < 0, s.line_words, 0), minlength=n)
    base_failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    kept = ~base_failed & (left >= min_kept * n_words)
    first, bad = np.searchsorted(s.line_text, np.arange(n + 1)), sum(failed) > 0
    cleaned = list(texts)
    for k in np.flatnonzero(bad).tolist():
        fine = s.family[first[k] : first[k + 1]] < 0
        cleaned[k] = "\n".join([x for x, good in zip(texts[k].split("\n"), fine.tolist(), strict=True) if good])
    return [n_words, s.chars, s.symbols, duplicates, repeats, base_failed, kept, *failed, cleaned]


def line_fails(line: str, words: list[bytes] | None = None) -> str | None:
    """The family of rules that a line fails, or None."""
    k = int(scan([line]).family[0])
    return FAMILIES[k] if k >= 0 else None


def clean(text: str) -> tuple[str, int, Counter]:
    """The lines that pass (blank ones too), the words in them, and how many lines fail by family."""
    cols = [c[0] for c in judge([text], MIN_KEPT)]
    s = scan([text])
    return cols[10], int(s.line_words[s.family < 0].sum()), +Counter(dict(zip(FAMILIES, map(int, cols[7:10]), strict=True)))


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    return tuple(int(c[0]) for c in judge([text], MIN_KEPT)[:5])


def quality_rules(docs: DataFrame, min_kept: float = MIN_KEPT) -> DataFrame:
    """(doc_id, base counts, base_failed, failed lines by family, clean_text, kept) of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_navigation_lines", "n_boilerplate_lines", "n_punctuation_lines", "clean_text"]
    types = [*repeat(pa.int64(), 5), pa.bool_(), pa.bool_(), *repeat(pa.int64(), 3), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            cols = judge([t or "" for t in texts], min_kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    schema = ", ".join(["doc_id " + kind, *(f"{n} {'long' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'string'}" for n, t in zip(names, types, strict=True))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_BLANKS = r"\x20\x09-\x0D"
#: The query's rows in DuckDB's SQL.
ORACLE = rf"""
with docs as (
  select row_number() over () as nth, doc_id, coalesce(text, '') as t from documents
), words as (
  select nth, doc_id, t, regexp_extract_all(t, '[^{_BLANKS}]+') as w from docs
), placed as (
  select nth, unnest(w) as word, generate_subscripts(w, 1) as k from words
), windows as (
  select nth, k, word, lead(word, 1) over x as b, lead(word, 2) over x as c from placed window x as (partition by nth order by k)
), seen as (
  select nth, k, c is not null and count(*) over (partition by nth, word, b, c) > 1 as again from windows
), covered as (
  select nth, again or coalesce(lag(again, 1) over x, false) or coalesce(lag(again, 2) over x, false) as hit from seen window x as (partition by nth order by k)
), repeats as (
  select nth, count(*) filter (hit) as n_repeat_words from covered group by nth
), lines as (
  select nth, unnest(string_split(t, chr(10))) as line from docs
), split as (
  select nth, line, regexp_extract_all(line, '[^{_BLANKS}]+') as w, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols from lines
), judged as (
  select nth, line, len(w) as n, case
    when len(w) = 0 then null
    when len(w) >= 4 and length(regexp_replace(line, '[^{"".join(SEPARATORS)}]', '', 'g')) * 3 >= len(w) then 'navigation'
    when {" or ".join(f"contains(lower(line), {_sql_text(p)})" for p in PHRASES)} then 'boilerplate'
    when symbols >= 3 and 4 * symbols > len(w) then 'punctuation'
    when len(w) >= 8 and 3 * length(regexp_replace(line, '[^!]', '', 'g')) > len(w) and not regexp_matches(line, '[a-z]') then 'punctuation'
    when len(w) >= 8 and 2 * len(list_filter(w, lambda x: x = list_mode(w))) > len(w) then 'punctuation'
    when len(w) >= 40 and not regexp_matches(line, '[{re.escape("".join(SENTENCE_MARKS)).replace("'", "''")}][{_BLANKS}]*$') and not regexp_matches(line, '[.!?,] ') then 'punctuation'
  end as family from split
), by_line as (
  select nth, count(*) filter (n > 0) - count(distinct case when n > 0 then line end) as n_dup_lines, sum(case when family is null then n else 0 end) as n_kept,
    count(*) filter (family = 'navigation') as n_navigation_lines, count(*) filter (family = 'boilerplate') as n_boilerplate_lines, count(*) filter (family = 'punctuation') as n_punctuation_lines
  from judged group by nth
), base as (
  select *, len(w)::bigint as n_words, list_sum(list_transform(w, lambda x: length(x)))::bigint as chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_repeat_words, 0) as again
  from words left join repeats using (nth) join by_line using (nth)
)
select doc_id, n_words, coalesce(chars, 0) as word_chars, n_symbols, n_dup_lines, again as n_repeat_words,
  n_words < 50 or 100 * again > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * again > 50 * n_words) and n_kept >= {MIN_KEPT} * n_words as kept,
  n_navigation_lines, n_boilerplate_lines, n_punctuation_lines
from base
"""
