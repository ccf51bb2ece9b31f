"""Vectorised text primitives shared by the corpus operators.

Everything works on Arrow string columns inside a Spark task: texts are taken as
one UTF-8 buffer plus offsets, cut into slices of a bounded number of bytes, and
words, word hashes and word n-gram hashes are computed for all documents of a
slice at once with numpy.  No function here sees more than one slice, so memory
is bounded by ``SLICE_BYTES`` (or by one document, if that is longer).

Defined results for odd input: a null text has no words; an empty text has no
words; words never reach across documents.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_COMBINE = np.uint64(0xD6E8FEB86659FD93)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)

#: byte -> True where the byte belongs to a word
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True

SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = (1 << max(n - 2, 0).bit_length()) + 1
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


#: caches of ``kept`` functions in this process
_kept: list = []


def kept(size: int) -> Callable:
    """``lru_cache`` for models and automata that serve the tasks that follow; tasks of another module drop them."""

    def wrap(f: Callable) -> Callable:
        cached = functools.lru_cache(size)(f)
        _kept.append(cached)
        return cached

    return wrap


def tidy(f: Callable) -> Callable:
    """Wrap a function over Arrow batches: when it ends, freed memory goes back to the system.

    Python workers live on from stage to stage, and what their allocators keep
    counts against the executor.  So does what other modules' tasks have kept:
    it goes before the function begins.
    """

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(f.__module__)
        try:
            yield from f(batches)
        finally:
            release()

    return run


def forget(module: str) -> None:
    """Drop what tasks of all modules but this one have kept."""
    others = [c for c in _kept if c.__module__ != module and c.cache_info().currsize]
    for c in others:
        c.cache_clear()
    if others:
        gc.collect()  # a model and its own caches refer to each other
        release()


def release() -> None:
    global _powers
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@dataclass
class Slice:
    """Some consecutive documents of one batch."""

    first: int  #: row of the first document in the batch
    data: np.ndarray  #: UTF-8 bytes of all texts, folded
    offsets: np.ndarray  #: byte offsets, one more than documents
    starts: np.ndarray  #: byte where each word starts
    ends: np.ndarray  #: byte after each word
    word_offsets: np.ndarray  #: index of each document's first word, one more than documents
    _sums: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span, whatever its length."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * down[starts]
        h += (ends - starts).astype(np.uint64) * _COMBINE
        return mix64(h)

    def drop_sums(self) -> None:
        """Sums that ``span_hashes`` keeps take eight bytes for each byte of text; they are made anew when asked for."""
        self._sums = None

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def doc_bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if off else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, words: np.ndarray = SPACE_WORDS, fold: np.ndarray = SAME, limit: int = 0) -> Iterator[Slice]:
    data, offsets = text_buffers(column)
    limit = limit or SLICE_BYTES
    n, a = len(offsets) - 1, 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        part = data[offsets[a] : offsets[z]]
        off = offsets[a : z + 1] - offsets[a]
        part = part if fold is SAME else fold[part]
        inside = words[part]
        before = np.zeros(len(part), bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < len(part)]] = False
        after = np.zeros(len(part), bool)
        after[:-1] = inside[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        yield Slice(a, part, off, starts, ends, np.searchsorted(starts, off))
        a = z


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries (len(h) - k + 1 of them), in O(log k) passes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    have, span, out, done = h, 1, None, 0
    weight = int(_COMBINE)
    with np.errstate(over="ignore"):
        rest = k
        while rest:
            if rest & 1:
                if out is None:
                    out, done = have, span
                else:
                    n = len(h) - done - span + 1
                    out = out[:n] * np.uint64(pow(weight, span, 1 << 64)) + have[done : done + n]
                    done += span
            rest >>= 1
            if rest:
                n = len(h) - 2 * span + 1
                have = have[:n] * np.uint64(pow(weight, span, 1 << 64)) + have[span : span + n]
                span *= 2
    return mix64(out[: len(h) - k + 1])


def windows_inside(word_offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of all k-word windows that lie in one document."""
    n_words = int(word_offsets[-1])
    keep = np.zeros(n_words, bool)
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    first = np.repeat(word_offsets[:-1], counts)
    inner = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
    keep[first + inner] = True
    return np.flatnonzero(keep)
