"""SentencePiece encoding and decoding with exact N-best segmentation.

No piece of the usual vocabularies has a space mark after another character, so
the lattice of a text falls apart into the lattices of its units (space marks
and the characters up to the next space mark).  This is verified when a model is
loaded; with other vocabularies the whole text is one unit.  For all short
distinct units of a batch at once, forward Viterbi scores are computed with
numpy, along with the exact loss of the unit's second-best path.  The N best
segmentations of a text change only units among those with the N - 1 smallest
losses; for these, and for all long units, N-best paths are searched backwards
from the end by A-star, with the forward scores as the (exact) heuristic, and
combined best first.  Memory is in proportion to the length of a unit.

Scores: a unigram model's own log probabilities.  A byte-pair model has merge
ranks instead; a piece of rank r then costs ``PIECE_COST + log(2 + r)``.  That is
a choice of this module: the segmentation of least cost is not always the one
that merging makes (on the given documents 83 % of the words get the same pieces).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import with_fields

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: stand for a space mark that is in the text itself, and for the filling of short units; no text has surrogates
OWN_MARK, FILL = "\udc81", "\udc82"
#: cost of any piece of a byte-pair model, and added cost of each byte of a character that no piece covers
PIECE_COST, BYTE_PENALTY = 5.0, 10.0
#: units of more characters are worked on one by one
LONG = 256


class PieceModel:
    """Pieces and scores of a SentencePiece model file, with N-best search over units."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        self.surface: list[str | int | None] = []
        scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())])
        for i in range(len(scores)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.surface.append(int(piece[3:5], 16))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(None)
            else:
                self.surface.append(piece)
                self.pieces[piece] = i
        self.byte_ids = {b: i for i, b in enumerate(self.surface) if isinstance(b, int)}
        self.longest = max(map(len, self.pieces))
        self.divisible = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        own = scores[list(self.pieces.values())]
        if (own == np.rint(own)).all():  # merge ranks
            low = min(s for s in own if s > -1e8)
            own = -PIECE_COST - np.log(2.0 - np.maximum(own, 2 * low))
        self.score = dict(zip(self.pieces, own.tolist(), strict=True))
        self.unknown = min(self.score.values()) - BYTE_PENALTY
        #: everything a piece can begin with: a search for pieces at a place ends with the first string that is not in it
        self.begins = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(1, self.longest + 1):
            of = sorted((_pack(np.array([[ord(c) for c in p]], np.uint64))[0], s, self.pieces[p]) for p, s in self.score.items() if len(p) == n)
            keys = np.array([k for k, _, _ in of], np.uint64)
            maybe = np.zeros(1 << 18, bool)
            maybe[(keys >> np.uint64(46)).astype(np.int64)] = True
            self.by_length.append((keys, np.array([s for _, s, _ in of]), np.array([i for _, _, i in of], np.int32), maybe))
        self.raw = [bytes([x]) if isinstance(x, int) else (x or "").replace(MARK, " ").encode("utf-8") for x in self.surface]
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_sizes = np.array([len(x) for x in self.raw])
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        self._paths = lru_cache(50_000)(self._search)

    def units(self, text: str) -> list[str]:
        """The text with space marks, cut before each run of space marks."""
        marked = MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK) if text else ""
        return UNIT.findall(marked) if self.divisible else [marked] * bool(text)

    def edge(self, unit: str, i: int, j: int) -> float | None:
        s = self.score.get(unit[i:j])
        if s is None and j == i + 1:
            return self.unknown * len(_raw(unit[i]))
        return s

    def viterbi(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each unit: best score and loss of its second-best path (inf if there is none);
        then the piece ids of all best paths, and where each unit's ids start and how many there are."""
        best, loss = np.zeros(len(units)), np.full(len(units), np.inf)
        counts, parts = np.zeros(len(units), np.int64), []
        lengths = np.array([len(u) for u in units], np.int64)
        step = np.maximum(4, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64) - 2))
        padded = -(-lengths // step) * step  # units of similar lengths are worked on together
        order = np.argsort(np.where(lengths > LONG, 0, padded), kind="stable")
        sizes = padded[order]
        a = int((lengths > LONG).sum())
        for i in order[:a]:
            paths = self.n_best(units[i], 2)
            best[i], loss[i] = paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
            ids = self._coded(units[i], paths[0][1])
            counts[i] = len(ids)
            parts.append((i, ids))
        while a < len(units):
            n = int(sizes[a])
            z = int(np.searchsorted(sizes[a:], n, "right")) + a
            z = min(z, a + max(1, 1_000_000 // (n * min(n, self.longest))))
            at = order[a:z]
            codes = np.frombuffer("".join([units[i].ljust(n, FILL) for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n)
            best[at], loss[at], paths = self._viterbi(codes)
            there = paths != _NO_ID
            counts[at] = there.sum(1)
            parts.append((at, paths[there]))
            a = z
        flat = np.concatenate([ids for _, ids in parts]) if parts else np.zeros(0, np.int32)
        owner = np.repeat(order, counts[order])
        flat, times = self._with_bytes(flat)
        counts = np.bincount(owner, times, len(units)).astype(np.int64) if len(owner) else counts
        starts = np.zeros(len(units), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return best, loss, flat, starts, counts

    def _with_bytes(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, with the ids of its bytes for each character that no piece covers; how many ids each entry became."""
        times = np.ones(len(coded), np.int64)
        odd = np.flatnonzero(coded <= _BYTES)
        if not len(odd):
            return coded, times
        chars, which = np.unique(coded[odd], return_inverse=True)
        own = [[self.byte_ids[b] for b in _raw(chr(int(_BYTES - c)))] for c in chars]
        times[odd] = np.array([len(x) for x in own])[which]
        out = np.repeat(coded, times)
        table = np.concatenate([np.array(x, np.int32) for x in own])
        sizes = np.array([len(x) for x in own])
        first = np.cumsum(sizes) - sizes
        out[_spans((np.cumsum(times) - times)[odd], times[odd])] = table[_spans(first[which], sizes[which])]
        return out, times

    def _coded(self, unit: str, ends: tuple[int, ...]) -> np.ndarray:
        starts = (0, *ends[:-1])
        return np.array([self.pieces.get(unit[a:z], _BYTES - ord(unit[a])) for a, z in zip(starts, ends, strict=True)], np.int32)

    def _viterbi(self, codes: np.ndarray):
        m, n = codes.shape
        top = min(n, self.longest)
        single = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where((codes < 0x10000), 3, 4))) * self.unknown
        fill = codes == ord(FILL)
        single[fill] = 0
        edges = np.full((top, m, n), -np.inf)  # edges[w - 1, :, i]: the piece of w characters that starts at i
        ids = np.empty((top, m, n), np.int32)
        ids[0] = _BYTES - codes.astype(np.int32)
        packed = codes.astype(np.uint64)
        h = packed
        for w in range(1, top + 1):
            h = h[:, : n - w + 1] * _PACK + packed[:, w - 1 :] if w > 1 else packed
            keys, scores, own, maybe = self.by_length[w - 1]
            if len(keys):
                r, c = np.nonzero(maybe[(h >> np.uint64(46)).astype(np.int64)])
                some = h[r, c]
                k = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
                ok = keys[k] == some
                edges[w - 1, r[ok], c[ok]] = scores[k[ok]]
                ids[w - 1, r[ok], c[ok]] = own[k[ok]]
        edges[0] = np.where(np.isinf(edges[0]), single, edges[0])
        ids[0][fill] = _NO_ID
        f, back = np.full((m, n + 1), -np.inf), np.zeros((m, n + 1), np.int32)
        f[:, 0] = 0
        for j in range(1, n + 1):
            for w in range(1, min(top, j) + 1):
                s = f[:, j - w] + edges[w - 1, :, j - w]
                better = s > f[:, j]
                f[better, j] = s[better]
                back[better, j] = w
        g = np.full((m, n + 1), -np.inf)
        g[:, n] = 0
        for i in range(n - 1, -1, -1):
            for w in range(1, min(top, n - i) + 1):
                g[:, i] = np.maximum(g[:, i], edges[w - 1, :, i] + g[:, i + w])
        paths = np.full((m, n), _NO_ID, np.int32)
        at, live, turn = np.full(m, n), np.arange(m), n
        used = np.zeros((top, m, n), bool)
        while len(live):
            turn -= 1
            w = back[live, at[live]]
            at[live] -= w
            used[w - 1, live, at[live]] = True
            paths[live, turn] = ids[w - 1, live, at[live]]
            live = live[at[live] > 0]
        edges[used] = -np.inf
        second = np.full(m, -np.inf)
        for w in range(1, top + 1):
            second = np.maximum(second, (f[:, : n - w + 1] + edges[w - 1, :, : n - w + 1] + g[:, w:]).max(1))
        return f[:, n], f[:, n] - second, paths

    def n_best(self, unit: str, n: int) -> tuple[tuple[float, tuple[int, ...]], ...]:
        """The n best (score, cut points), best first; ties in a fixed order."""
        return self._paths(unit, n) if len(unit) <= LONG else self._search(unit, n)

    def _search(self, unit: str, n: int) -> tuple[tuple[float, tuple[int, ...]], ...]:
        """A-star from the end of the unit.

        An entry of the heap is a path from ``node`` to the end, kept as a link to the
        path it prolongs; its priority is what it loses against the best path, known
        exactly from the forward scores ``f``.  An entry is replaced by its best
        prolongation and by its next best sibling, so the heap grows by one a step.
        """
        f, back = self._forward(unit)
        heap, seq, out = [(0.0, 0, len(unit), None, 0)], 0, []
        while heap and len(out) < n:
            entry = heapq.heappop(heap)
            lost, _, node, after, rank = entry
            if after is not None:
                others = self._into(unit, after[2], f, back)
                if rank + 1 < len(others):
                    seq += 1
                    heapq.heappush(heap, (lost + others[rank + 1][0] - others[rank][0], seq, others[rank + 1][1], after, rank + 1))
            if node:
                seq += 1
                heapq.heappush(heap, (lost, seq, node - back[node], entry, 0))
                continue
            cuts, step = [], after
            while step is not None:
                cuts.append(step[2])
                step = step[3]
            out.append((f[len(unit)] - lost, tuple(cuts)))
        return tuple(out)

    def _forward(self, unit: str) -> tuple[array, array]:
        """Best score of each beginning of the unit, and the length of its last piece."""
        size, get, begins = len(unit), self.score.get, self.begins
        f, back = array("d", [-np.inf]) * (size + 1), array("i", [0]) * (size + 1)
        f[0] = 0.0
        for i in range(size):
            here = f[i]
            char = unit[i]
            s = get(char)
            s = here + (self.unknown * len(_raw(char)) if s is None else s)
            if s > f[i + 1]:
                f[i + 1], back[i + 1] = s, 1
            for j in range(i + 2, min(size, i + self.longest) + 1):
                piece = unit[i:j]
                if piece not in begins:
                    break
                s = get(piece)
                if s is not None and here + s > f[j]:
                    f[j], back[j] = here + s, j - i
        return f, back

    def _into(self, unit: str, j: int, f: array, back: array) -> list[tuple[float, int]]:
        """(loss, start) of all pieces that end at j, the best path's first."""
        out = []
        for i in range(max(0, j - self.longest), j):
            s = self.edge(unit, i, j)
            if s is not None:
                out.append((max(0.0, f[j] - f[i] - s), i))
        best = j - back[j]
        return sorted(out, key=lambda x: (x[1] != best, x[0], x[1]))

    def ids(self, unit: str, ends: list[int]) -> list[int]:
        return self._with_bytes(self._coded(unit, tuple(ends)))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of piece ids: bytes joined, space marks turned back, the leading one dropped."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "replace")


@tk.kept(2)
def piece_model(path: str) -> PieceModel:
    """One model for each worker and file."""
    return PieceModel(path)


_PACK = np.uint64(0x9E3779B97F4A7C15)
#: stands for nothing; a character that no piece covers is _BYTES minus its code
_NO_ID, _BYTES = -1, -2


def _pack(codes: np.ndarray) -> np.ndarray:
    h = codes[:, 0].copy()
    for j in range(1, codes.shape[1]):
        h = h * _PACK + codes[:, j]
    return h


def _raw(char: str) -> bytes:
    return (MARK if char == OWN_MARK else char).encode("utf-8")


ADDED = pa.schema([("piece_ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("best_score", pa.float64()), ("n_best_scores", pa.list_(pa.float64())), ("n_best_cuts", pa.list_(pa.string())), ("ids_sha256", pa.string()), ("round_trip", pa.bool_())])
ADDED_DDL = "piece_ids array<int>, n_pieces long, best_score double, n_best_scores array<double>, n_best_cuts array<string>, ids_sha256 string, round_trip boolean"


def encode_pieces(docs: DataFrame, model_path: str, n_best: int = 4, with_ids: bool = True, max_batch_units: int = 200_000, text: str = "text") -> DataFrame:
    """All columns plus the columns of ``ADDED`` (which replace clashing names).

    ``n_best_scores`` are the scores of the best segmentations, best first (fewer
    where the lattice has fewer paths); ``n_best_cuts`` names, for each of them,
    the units that differ from the best one as ``unit index:cut points``;
    ``round_trip`` tells whether decoding the ids gives the text back.  A null
    text gets nulls; an empty text has no pieces and one segmentation of score 0.
    One pass, no shuffle; the model file has to be readable on every executor.
    ``with_ids`` false leaves ``piece_ids`` null where only digests are wanted.
    """
    keep = [c for c in docs.columns if c not in ADDED.names]
    docs = docs.select(*keep)
    at_text = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for whole in batches:
            for a, z in _cuts(whole.column(at_text), max_batch_units):
                b = whole.slice(a, z - a)
                rows = _encode(model, b.column(at_text).to_pylist(), n_best, with_ids)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, f.type) for c, f in zip(cols, ADDED, strict=True))], [*keep, *ADDED.names])

    return docs.mapInArrow(tk.tidy(run), with_fields(docs.schema, ADDED_DDL))


def decode_pieces(rows: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "text") -> DataFrame:
    """All columns plus ``text`` (which replaces a column of that name): the text of the piece ids.

    Bytes of pieces are joined and decoded (malformed ones become U+FFFD), space
    marks become spaces and the leading one is dropped.  Null ids give null, no
    ids an empty text; control pieces give nothing; an id that the model does not
    have is an error.  One pass, no shuffle.
    """
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, F.col(ids).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for b in batches:
            texts = [None if x is None else model.decode([i for i in x if i is not None]) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, text])

    return rows.mapInArrow(tk.tidy(run), with_fields(rows.drop("_ids").schema, f"`{text}` string"))


def _cuts(column: pa.Array, max_units: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``max_units`` units (five bytes each), one row at least."""
    a, size = 0, 0
    for i, t in enumerate(column):
        size += len(t.as_py() or "") // 5 + 1
        if size >= max_units:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(column):
        yield a, len(column)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of all spans, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _encode(model: PieceModel, texts: list[str | None], n: int, with_ids: bool) -> list[tuple]:
    index: dict[str, int] = {}
    number, refs, sizes = index.setdefault, [], []
    for t in texts:
        units = model.units(t or "")
        sizes.append(len(units))
        refs += [number(u, len(index)) for u in units]
    distinct = list(index)
    best, loss, flat, starts, counts = model.viterbi(distinct)
    r = np.array(refs, np.int64)
    ids = flat[_spans(starts[r], counts[r])]
    unit_at = np.concatenate([[0], np.cumsum(sizes)])
    id_at = np.concatenate([[0], np.cumsum(counts[r])])[unit_at]
    # decoding: the bytes of all pieces, cut where the texts end; each text begins with one space too many
    decoded = model.raw_bytes[_spans(model.raw_starts[ids], model.raw_sizes[ids])]
    byte_at = np.concatenate([[0], np.cumsum(model.raw_sizes[ids])])[id_at]
    best_r, loss_r = best[r], loss[r]
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append((None,) * len(ADDED))
            continue
        a, z = int(unit_at[i]), int(unit_at[i + 1])
        total, losses = float(best_r[a:z].sum()), loss_r[a:z]
        k = min(n - 1, z - a)
        near = np.flatnonzero(losses <= np.partition(losses, k - 1)[k - 1]) if k else []
        pick = sorted(sorted(near, key=lambda j: (losses[j], j))[:k])
        choices = [(int(j), [(best_r[a + j] - s, c) for s, c in model.n_best(distinct[r[a + j]], n)]) for j in pick if np.isfinite(losses[j])]
        ranked = _combine(choices, n)
        own = ids[id_at[i] : id_at[i + 1]]
        changed = [" ".join(f"{j}:{','.join(map(str, alts[c][1]))}" for (j, alts), c in zip(choices, combo, strict=True) if c) for _, combo in ranked]
        same = decoded[byte_at[i] + (z > a) : byte_at[i + 1]].tobytes() == t.encode("utf-8")
        out.append((own if with_ids else None, len(own), total, [total - lost for lost, _ in ranked], changed, hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), same))
    return out


def _combine(choices: list[tuple[int, list]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest ways to choose one alternative for each unit, cheapest first."""
    start = (0,) * len(choices)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        lost, combo = heapq.heappop(heap)
        out.append((lost, combo))
        for j, (_, alts) in enumerate(choices):
            if combo[j] + 1 < len(alts):
                new = (*combo[:j], combo[j] + 1, *combo[j + 1 :])
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(heap, (lost - alts[combo[j]][0] + alts[combo[j] + 1][0], new))
    return out
