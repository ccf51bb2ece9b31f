"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds all normalised test items.  Document words are streamed
through it; after each word the automaton knows the longest suffix of the
document so far that is a substring of some item.  Wherever that length reaches
the window length (or covers a whole shorter item), the words of the match are
hit.  Hit spans are removed, and documents hit beyond a coverage limit rejected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import text_bytes, with_fields, written

#: words of already lower-cased UTF-8: ASCII letters and digits and all of non-ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

ADDED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("cleaned_text", pa.string())])


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.windows: dict[tuple[int, ...], list[str]] = {}
        self.short: dict[int, int] = {}  # state -> longest short item that ends there as a suffix
        shorts = set()
        for item, text in items:
            ids = tuple(self.ids.setdefault(w, len(self.ids)) for w in WORD.findall((text or "").encode("utf-8").lower()))
            if not ids:
                continue
            last = 0
            for w in ids:
                last = self._extend(last, w)
            for i in range(max(1, len(ids) - window + 1)):
                owners = self.windows.setdefault(ids[i : i + window], [])
                if not owners or owners[-1] != item:
                    owners.append(item)
            if len(ids) < window:
                shorts.add(ids)
        self.min_match = min([window, *map(len, shorts)])
        ends: dict[int, list[int]] = {}
        for ids in shorts:
            v = 0
            for w in ids:
                v = self.next[v][w]
            ends.setdefault(v, []).append(len(ids))
        #: lengths of the short items that are suffixes of a state's strings, its own first
        self.suffixes: list[tuple[int, ...]] = [()] * len(self.length)
        for v in sorted(range(len(self.length)), key=self.length.__getitem__):
            up = self.suffixes[self.link[v]] if self.link[v] >= 0 else ()
            self.suffixes[v] = tuple(sorted(ends.get(v, ()), reverse=True)) + up

    def _extend(self, last: int, w: int) -> int:
        nxt, length, link = self.next, self.length, self.link
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(start, end) of every window or whole short item found in ``ids`` (-1: a word no item has)."""
        nxt, length, link, window = self.next, self.length, self.link, self.window
        v = n = 0
        for i, w in enumerate(ids):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            v = nxt[v].get(w, 0)
            n = n + 1 if v else 0
            if n >= window:
                yield i + 1 - window, i + 1
            for m in self.suffixes[v]:
                if m <= n:
                    yield i + 1 - m, i + 1

    def scan(self, ids: list[int]) -> tuple[np.ndarray, set[str]]:
        """Hit flag of every word, and the items found."""
        hit, items = np.zeros(len(ids), bool), set()
        known = np.fromiter(ids, np.int64, len(ids)) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if z - a >= self.min_match:
                for s, e in self.matches(ids[a:z]):
                    hit[a + s : a + e] = True
                    items.update(self.windows[tuple(ids[a + s : a + e])])
        return hit, items


def _cut(raw: bytes, spans: list[tuple[int, int]], hit: np.ndarray, limit: int) -> str:
    """The text without runs of more than ``limit`` hit words."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()
    parts, at = [], 0
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        if z - a > limit:
            parts.append(raw[at : spans[a][0]])
            at = spans[z - 1][1]
    return b"".join([*parts, raw[at:]]).decode("utf-8", "replace")


@tk.kept(1)
def _automaton(items: tuple[tuple[str, str | None], ...], window: int) -> SuffixAutomaton:
    """The last automaton used stays in the worker, for the tasks that follow."""
    return SuffixAutomaton(list(items), window)


def _runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hit words, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).tolist()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage_percent: int = 5, span_limit: int = 0, part_bytes: int = 4 << 20, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the columns of ``ADDED`` (which replace clashing names).

    ``contaminated`` where at least one word is hit and hits are at least
    ``coverage_percent`` of all words; ``cleaned_text`` lacks every run of more
    than ``span_limit`` hit words.  Null and empty texts have no words; null items
    are ignored; items of equal ids count once.

    An automaton takes about 75 times the bytes of its items, so the items go to
    the workers in parts of about ``part_bytes`` (checked before anything is sent).
    With one part, as usual, this is one pass over the documents without a shuffle.
    Otherwise every part is a pass over the same whole texts, which lists the runs
    of hit words and the items of the texts that it hits; these are united for
    each text before anything is judged or cut, so the result is that of one part.
    """
    keep = [c for c in docs.columns if c not in ADDED.names]
    docs = docs.select(*keep)
    items = benchmark.selectExpr("cast(item_id as string) as id", "text").where("id is not null and text is not null")
    parts = max(1, -(-text_bytes(items) // part_bytes))
    rule = (coverage_percent, span_limit)
    if parts == 1:
        return _with_added(docs, keep, text, rule, _shared(items), window)
    hits = None
    for k in range(parts):
        some = _spotted(docs.select(F.col(text).alias("text")).where("text is not null"), _shared(items.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)), window)
        hits = some if hits is None else hits.union(some)
    hits = hits.groupBy("_sha").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    joined = docs.withColumn("_sha", F.unhex(F.sha1(F.col(text).cast("binary")))).join(hits, "_sha", "left").select(*keep, "_hits", "_items")
    return _with_added(joined, keep, text, rule)


def _shared(items: DataFrame) -> Broadcast:
    return items.sparkSession.sparkContext.broadcast(tuple((r[0], r[1]) for r in items.select("id", "text").collect()))


def _spotted(texts: DataFrame, items: Broadcast, window: int) -> DataFrame:
    """Digests of the texts that these items hit, with the runs of hit words and the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items.value, window)
        get = automaton.ids.get
        for batch in batches:
            rows = []
            for t in batch.column(0):
                raw = t.as_py().encode("utf-8")
                hit, found = automaton.scan([get(w, -1) for w in WORD.findall(raw.lower())])
                if found:
                    rows.append((hashlib.sha1(raw).digest(), _runs(hit), sorted(found)))
            cols = zip(*rows, strict=True) if rows else [[]] * 3
            kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["_sha", "_hits", "_items"])

    return written(texts.mapInArrow(tk.tidy(run), "_sha binary, _hits array<int>, _items array<string>").dropDuplicates(["_sha"]), "hits")


def _with_added(docs: DataFrame, keep: list[str], text: str, rule: tuple[int, int], items: Broadcast | None = None, window: int = 0) -> DataFrame:
    """The columns ``keep`` and those of ``ADDED``: hits are looked for in ``items``, or else are the last two columns."""
    at, (coverage_percent, span_limit) = keep.index(text), rule

    def spotted(batch: pa.RecordBatch) -> Iterator[tuple[str | None, bytes, int, list[int], list[str]]]:
        automaton = _automaton(items.value, window) if items else None
        get = automaton.ids.get if automaton else None
        given = None if automaton else [batch.column(i).to_pylist() for i in (-2, -1)]
        for i, t in enumerate(batch.column(at).to_pylist()):
            raw = (t or "").encode("utf-8")
            words = WORD.findall(raw.lower())
            if automaton:
                hit, found = automaton.scan([get(w, -1) for w in words])
                yield t, raw, len(words), _runs(hit) if found else [], sorted(found)
            else:
                yield t, raw, len(words), given[0][i] or [], sorted(given[1][i] or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, raw, n, runs, found in spotted(batch):
                hit = np.zeros(n, bool)
                for a, z in zip(runs[::2], runs[1::2], strict=True):
                    hit[a:z] = True
                n_hit = int(hit.sum())
                clean = _cut(raw, [m.span() for m in WORD.finditer(raw.lower())], hit, span_limit) if n_hit else t
                rows.append((n, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n_hit > 0 and 100 * n_hit >= coverage_percent * n, clean))
            cols = zip(*rows, strict=True) if rows else [[]] * len(ADDED)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, f.type) for c, f in zip(cols, ADDED, strict=True))], [*keep, *ADDED.names])

    added = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, cleaned_text string"
    return docs.mapInArrow(tk.tidy(run), with_fields(docs.select(*keep).schema, added))
