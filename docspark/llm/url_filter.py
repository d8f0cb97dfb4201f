"""URL rules looked up in a sorted digest array.

Every rule (host and path prefix) and every blocked address is a stored string with a 64-bit
xxhash key.  An array of them is one file: the sorted keys, where each string ends, a flag for each, the
strings.  Spark serves the file to every executor, whose Python workers map the one copy into
memory; a batch of urls probes it with vectorised binary searches, and a hit counts only if the
stored string is the probed one, so colliding keys do no harm.  An array may hold any number of entries:
what is mapped isn't loaded.

A url probes its host and all parent domains, none longer than the longest rule's host, with every prefix of
its path whose length some rule has.  The longest rule that fits wins: first by its whole length,
then block over allow, then the first in order.  A url without a rule is blocked if its address (host and path) is on
the list of blocked addresses, and allowed otherwise.  The dealt query has the five rules and an empty
list, so that its method's own verdict is always allow.

Null urls, and those without ``://``, have an empty host and path and are allowed.  Repeated rows
get the same verdict.  Long urls take time in proportion to their length.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import driver_folder

#: (action, rule): a rule is a host and the beginning of a path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
_END_OF_HOST, _END_OF_PATH = re.compile(r"[/?#]"), re.compile(r"[?#]")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters lower-cased) and path of a url."""
    at = url.find("://") if url is not None else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _END_OF_HOST.search(rest)) else len(rest)
    path = rest[end:]
    return rest[:end].translate(_LOWER), path[: m.start()] if (m := _END_OF_PATH.search(path)) else path


class DigestArray:
    """Strings, each with a flag, by sorted 64-bit keys, in one file that is mapped where it is used."""

    def __init__(self, entries: Iterable[str], flags: Iterable[int] | None = None):
        strings = list(entries)
        flags = [0] * len(strings) if flags is None else list(flags)
        unique = dict(zip(strings, flags, strict=True))
        data = [s.encode("utf-8", "surrogatepass") for s in unique]
        keys = np.array([xxhash.xxh64_intdigest(d) for d in data], np.uint64)
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([len(data[k]) for k in order], dtype=np.int64)
        self.n = len(data)
        self.name = f"digests-{uuid.uuid4().hex}"
        self.path: str | None = str(driver_folder() / self.name)
        with open(self.path, "wb") as f:
            f.write(keys[order].tobytes())
            f.write(ends.tobytes())
            f.write(np.fromiter(unique.values(), np.uint8, self.n)[order].tobytes())
            for k in order:
                f.write(data[k])
        self._mapped: tuple | None = None

    def __getstate__(self) -> dict:
        """What goes to executors: they find the file by its name."""
        return self.__dict__ | {"_mapped": None, "path": None}

    def __len__(self) -> int:
        return self.n

    def view(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, ends, flags and bytes of the strings, mapped."""
        if self._mapped is None:
            path, n = Path(self.path or SparkFiles.get(self.name)), self.n
            size = path.stat().st_size - 17 * n
            part = lambda kind, at, count: np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind)
            self._mapped = (part(np.uint64, 0, n), part(np.int64, 8 * n, n), part(np.uint8, 16 * n, n), part(np.uint8, 17 * n, size))
        return self._mapped

    def find(self, probes: list[str]) -> np.ndarray:
        """The entry of each probe, -1 where it isn't stored."""
        data = [p.encode("utf-8", "surrogatepass") for p in probes]
        wanted = np.fromiter((xxhash.xxh64_intdigest(d) for d in data), np.uint64, len(data))
        keys, ends, _, blob = self.view()
        out = np.full(len(data), -1, np.int64)
        if not self.n:
            return out
        at = np.searchsorted(keys, wanted)
        for k in np.flatnonzero(keys[np.minimum(at, self.n - 1)] == wanted):
            j = int(at[k])
            while j < self.n and keys[j] == wanted[k]:  # all strings with this key
                if blob[int(ends[j - 1]) if j else 0 : int(ends[j])].tobytes() == data[k]:
                    out[k] = j
                    break
                j += 1
        return out

    def contains(self, probes: list[str]) -> np.ndarray:
        """Whether each probe is stored."""
        return self.find(probes) >= 0


ALLOW, BLOCK = 0, 1


class UrlFilter:
    def __init__(self, rules: Iterable[tuple[str, str]] = RULES, blocked: Iterable[str] = ()):
        actions: dict[str, int] = {}
        for action, rule in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            host, slash, path = rule.partition("/")
            key = host.translate(_LOWER) + slash + path
            actions[key] = max(actions.get(key, ALLOW), BLOCK if action == "block" else ALLOW)
        self.rules = DigestArray(actions, actions.values())
        self.blocked = DigestArray(blocked)
        self.longest_host = max((len(r.partition("/")[0]) for r in actions), default=0)
        self.path_lengths = sorted({len(r) - len(r.partition("/")[0]) for r in actions})

    def _domains(self, host: str) -> Iterator[str]:
        """The host and its parents that aren't longer than all rules' hosts."""
        at = 0 if len(host) <= self.longest_host else host.find(".", len(host) - self.longest_host - 1) + 1
        while at or len(host) <= self.longest_host:
            yield host[at:]
            at = host.find(".", at) + 1
            if not at:
                return

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each url."""
        split = [parts(u) for u in urls]
        probes, owner = [], []
        for k, (host, path) in enumerate(split):
            if not host:
                continue
            for domain in self._domains(host):
                for n in self.path_lengths:
                    if n <= len(path):
                        probes.append(domain + path[:n])
                        owner.append(k)
        best: dict[int, tuple[int, int, str]] = {}
        entries, flags = self.rules.find(probes), self.rules.view()[2]
        for j in np.flatnonzero(entries >= 0):
            k, found = owner[j], (len(probes[j]), int(flags[entries[j]]), probes[j])
            if k not in best or found[:2] > best[k][:2] or (found[:2] == best[k][:2] and found[2] < best[k][2]):
                best[k] = found
        listed = self.blocked.contains([h + p for h, p in split]) if len(self.blocked) else np.zeros(len(split), bool)
        return [(h, p, best[k][2], ("allow", "block")[best[k][1]]) if k in best else (h, p, None, "block" if listed[k] and h else "allow") for k, (h, p) in enumerate(split)]


def filter_urls(pages: DataFrame, chosen: UrlFilter) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    context = pages.sparkSession.sparkContext
    for array in (chosen.rules, chosen.blocked):
        context.addFile(array.path)
    shared = context.broadcast(chosen)  # names and sizes; the entries are in the files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value.judge
        for batch in batches:
            rows = judge(batch.column("url").to_pylist())
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The query's rows in DuckDB's SQL; pairs of rules and urls are few rules by many urls.
ORACLE = r"""
with rules(action, host_r, path_r) as (values
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), rest as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages
), split as (
  select page_id, url,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest
), named as (
  select row_number() over () as nth, page_id, coalesce(host, '') as host, coalesce(path, '') as path from split
), fits as (
  select nth, action, host_r || path_r as rule,
    row_number() over (partition by nth order by length(host_r || path_r) desc, action desc, host_r || path_r) as k
  from named join rules on (host = host_r or ends_with(host, '.' || host_r)) and starts_with(path, path_r)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict
from named left join (select * from fits where k = 1) using (nth)
"""
