"""Substring deduplication with automata of repeated phrases.

1. Anchors.  In every window of ``window`` words one phrase of ``PHRASE`` words is
   chosen by its hash (the smallest), so equal windows choose equal phrases.
   Only chosen phrases are counted over the corpus: a window can recur only if
   its phrase does.
2. Confirmation.  Phrases whose hash recurs are written out in words, and those
   whose words recur over the corpus are the confirmed ones.
3. Automata.  Documents are dealt into buckets of a bounded size.  For each bucket
   the confirmed phrases that stand in it are compiled into Aho-Corasick automata
   of at most ``AUTOMATON_PHRASES`` each, and every document of the bucket is
   streamed through them to locate every occurrence.
4. Only windows around located phrases are looked at.  They are compared over the
   corpus by hash, one row for each distinct window and bucket; all but the first
   bucket's are flagged.
5. Each bucket removes the words of flagged windows and of windows around located
   phrases that repeat one that starts earlier in the bucket itself.

A phrase, line or document that is in a third of all documents costs one row for
each bucket, not for each occurrence, so no key is hot.  The buckets' exchange is
the same in all steps and is written once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import text_bytes

PHRASE = 5

#: bytes of text whose words and hashes are worked on at once; they take some sixty times as much
PART_BYTES = 1 << 18

#: phrases of one automaton, about 35 bytes each; a bucket with more is streamed through several
AUTOMATON_PHRASES = 50_000


def _argmin_in(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest entry among h[i : i + width], for every i."""
    value, place, span = h, np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        n = len(value) - step
        later = value[step:] < value[:n]
        value, place = np.where(later, value[step:], value[:n]), np.where(later, place[step:], place[:n])
        span += step
    return place


def _anchored(s: tk.Slice, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, phrase hashes, starts of all windows, and the word where each window's phrase starts."""
    words = s.word_hashes()
    phrases = tk.ngram_hashes(words, PHRASE)
    starts = tk.windows_inside(s.word_offsets, window)
    owners = _argmin_in(phrases, window - PHRASE + 1)[starts] if len(starts) else starts
    return words, phrases, starts, owners


def _count_phrases(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, parts = b.column(0).to_numpy(), []
            for s in tk.slices(b.column(2), limit=PART_BYTES):
                _, phrases, _, owners = _anchored(s, window)
                at = np.unique(owners)
                doc = np.searchsorted(s.word_offsets, at, "right") - 1
                parts.append((phrases[at], buckets[s.first + doc]))
            if not parts:
                continue
            h, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((h, bucket))
            h, bucket = h[order], bucket[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])])) if len(h) else np.zeros(0, np.int64)
            for a in range(0, len(new), 100_000):
                at = new[a : a + 100_000]
                counts = np.diff(np.append(new, len(h)))[a : a + 100_000].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(bucket[at]), pa.array(counts)], ["h", "bucket", "n"])

    return run


def _in_order(docs: pa.Table) -> pa.Table:
    return docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start"))


def _rank(docs: pa.Table) -> np.ndarray:
    """Rank of each row's doc_id in the bucket: equal ids are one rank, null comes first."""
    ids = docs.column("doc_id").combine_chunks()
    if not len(ids):
        return np.zeros(0, np.int64)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    v = ids.fill_null(0).to_numpy()
    return np.concatenate([[0], np.cumsum((v[1:] != v[:-1]) | (null[1:] != null[:-1]))])


def _text(docs: pa.Table) -> pa.Array:
    column = docs.column("text")
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _spell(window: int):
    """Phrases of one bucket whose hash recurs, in words, with the number of their places."""

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        tk.forget(__name__)
        keys, words = np.sort(wanted.column("h").to_numpy().view(np.uint64)), Counter()
        if len(keys) and len(docs):
            for s in tk.slices(_text(docs), limit=PART_BYTES):
                _, phrases, _, owners = _anchored(s, window)
                at = np.unique(owners)
                at = at[keys[np.minimum(np.searchsorted(keys, phrases[at]), len(keys) - 1)] == phrases[at]]
                data = s.data.tobytes()
                words.update(b" ".join(data[a:z].split()) for a, z in zip(s.starts[at].tolist(), s.ends[at + PHRASE - 1].tolist(), strict=True))
        tk.release()
        bucket = docs.column("bucket")[0].as_py() if len(docs) else 0
        return pa.table([pa.array([bucket] * len(words), pa.int32()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int32())], schema=_SPELLED)

    return run


def _automata(phrases: list[bytes]) -> Iterator[ahocorasick.Automaton]:
    for a in range(0, len(phrases), AUTOMATON_PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases[a : a + AUTOMATON_PHRASES]:
            automaton.add_word((b" " + p + b" ").decode("latin-1"))
        automaton.make_automaton()
        yield automaton


def _locate(docs: pa.Array, phrases: list[bytes]) -> list[np.ndarray]:
    """Words of each document where a phrase starts, in order."""
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(docs)
    for automaton in _automata(phrases):
        for s in tk.slices(docs, limit=PART_BYTES):
            for d in range(s.n_docs):
                line = b" " + b" ".join(s.doc_bytes(d).split()) + b" "
                hits = [end - n + 1 for end, n in automaton.iter(line.decode("latin-1"))]
                if hits:
                    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
                    found[s.first + d] = np.union1d(found[s.first + d], np.searchsorted(spaces, hits))
    return found


def _candidates(window: int):
    """Distinct windows around located phrases of one bucket, each with its first place, and all located places of each document."""

    def run(docs: pa.Table, confirmed: pa.Table) -> pa.Table:
        tk.forget(__name__)
        docs, out = _in_order(docs), []
        if not len(docs) or not len(confirmed):
            return _CANDIDATE.empty_table()
        ids, text = docs.column("doc_id").combine_chunks(), _text(docs)
        located = _locate(text, confirmed.column("phrase").to_pylist())
        for s in tk.slices(text, limit=PART_BYTES):
            words, _, starts, owners = _anchored(s, window)
            if not len(starts):
                continue
            here = np.zeros(len(s.starts), bool)
            for d in range(s.n_docs):
                here[s.word_offsets[d] + located[s.first + d]] = True
            at = starts[here[owners]]
            d = np.searchsorted(s.word_offsets, at, "right") - 1
            h = tk.ngram_hashes(words, window)[at]
            _, first = np.unique(h, return_index=True)
            out.append((h[first], s.first + d[first], (at - s.word_offsets[d])[first]))
        tk.release()
        if not out:
            return _CANDIDATE.empty_table()
        h, d, start = (np.concatenate(x) for x in zip(*out, strict=True))
        _, first = np.unique(h, return_index=True)  # parts are in document order
        windows = [pa.array(h[first].view(np.int64)), ids.take(pa.array(d[first])), pa.array(start[first].astype(np.int32)), pa.nulls(len(first), pa.binary())]
        rows = [i for i, x in enumerate(located) if len(x)]
        places = [np.diff(located[i], prepend=0).astype(np.int32).tobytes() for i in rows]
        some = ids.take(pa.array(rows, pa.int64()))
        hits = [some.fill_null(0), some, pa.nulls(len(rows), pa.int32()), pa.array(places, pa.binary())]
        return pa.concat_tables([pa.table(windows, schema=_CANDIDATE), pa.table(hits, schema=_CANDIDATE)])

    return run


_SPELLED = pa.schema([("bucket", pa.int32()), ("phrase", pa.binary()), ("n", pa.int32())])

#: a window (places null), or a document's located places (start null, w its id), each as the distance from the one before
_CANDIDATE = pa.schema([("w", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("places", pa.binary())])


def _around(s: tk.Slice, starts: np.ndarray, ids: list, places: dict, window: int) -> np.ndarray:
    """Those starts whose window holds a located phrase of the document."""
    edge = np.zeros(len(s.starts) + 2, np.int32)
    for d in range(s.n_docs):
        a, n = int(s.word_offsets[d]), int(s.word_offsets[d + 1] - s.word_offsets[d])
        for at in places.get(ids[s.first + d], ()):
            at = at[at < n]
            np.add.at(edge, a + np.maximum(at - (window - PHRASE), 0), 1)
            np.add.at(edge, a + at + 1, -1)
    return starts[(np.cumsum(edge) > 0)[starts]]


def _remove(window: int, out_schema: pa.Schema, with_text: bool):
    def run(docs: pa.Table, flagged: pa.Table) -> pa.Table:
        tk.forget(__name__)
        docs = _in_order(docs)
        window_row = pc.is_null(flagged.column("places"))
        late = np.sort(flagged.filter(window_row).column("w").to_numpy().view(np.uint64))
        hits, places = flagged.filter(pc.invert(window_row)), {}
        for i, x in zip(hits.column("doc_id").to_pylist(), hits.column("places").to_pylist(), strict=True):
            places.setdefault(i, []).append(np.cumsum(np.frombuffer(x, np.int32)))
        rank, ids, parts = _rank(docs), docs.column("doc_id").to_pylist(), []
        for s in tk.slices(_text(docs), limit=PART_BYTES) if len(docs) else ():
            starts = _around(s, tk.windows_inside(s.word_offsets, window), ids, places, window)
            h = tk.ngram_hashes(s.word_hashes(), window)[starts] if len(starts) else np.zeros(0, np.uint64)
            s.drop_sums()
            d = np.searchsorted(s.word_offsets, starts, "right") - 1
            parts.append((s, h, starts, rank[s.first + d], starts - s.word_offsets[d]))
        if not parts:
            return out_schema.empty_table()
        h = np.concatenate([p[1] for p in parts])
        r, start = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        order = np.argsort(h, kind="stable")  # stable: equal windows stay in document order
        sh = h[order]
        group = np.cumsum(np.concatenate([[True], sh[1:] != sh[:-1]])) - 1 if len(h) else np.zeros(0, np.int64)
        head = order[np.flatnonzero(np.concatenate([[True], sh[1:] != sh[:-1]]))] if len(h) else order
        gone = np.zeros(len(h), bool)
        first = head[group] if len(h) else order
        gone[order] = (r[order] > r[first]) | (start[order] > start[first])
        if len(late) and len(h):
            k = np.minimum(np.searchsorted(late, h), len(late) - 1)
            gone |= late[k] == h
        rows, base = [], 0
        tk.release()
        for s, hs, starts, _, _ in parts:
            bad = starts[gone[base : base + len(hs)]]
            base += len(hs)
            edge = np.zeros(len(s.starts) + window + 1, np.int32)
            np.add.at(edge, bad, 1)
            np.add.at(edge, bad + window, -1)
            dead = np.cumsum(edge)[: len(s.starts)] > 0
            for d in range(s.n_docs):
                a, z = int(s.word_offsets[d]), int(s.word_offsets[d + 1])
                n = int(dead[a:z].sum())
                all_words = s.doc_bytes(d).split()
                kept = b" ".join(all_words if not n else [w for w, x in zip(all_words, dead[a:z].tolist(), strict=True) if not x])
                rows.append((z - a, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if n and with_text else None))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        if with_text:
            cols[3] = pc.if_else(pc.equal(cols[1], 0), _text(docs), cols[3])
        return pa.table([*(docs.column(n).combine_chunks() for n in out_schema.names[:-4]), *cols], schema=out_schema)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, bucket_bytes: int = 4 << 20, carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Per row: doc_id, the ``carry`` columns, n_words, n_removed, kept_sha256 and kept_text.

    Each word covered by a window of ``window`` words whose word sequence also
    starts earlier (smaller doc_id, or the same document and an earlier start) is
    removed; windows are judged on the input.  ``kept_text`` (null without
    ``with_text``) is the text itself
    where nothing was removed, else the kept words joined by one space.  A null
    text has no words and stays null; ids are compared as longs, a null id comes
    before all others; rows of equal ids are one document to the order (neither
    starts earlier where both have the window at the same word).  Windows are
    compared by 64-bit hash: at n windows around recurring phrases about
    n * n / 2**65 pairs are taken as equal wrongly.
    """
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    n_buckets = max(1, -(-text_bytes(docs) // bucket_bytes))
    kept = docs.select(F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(n_buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    dealt = kept.repartition("bucket")  # all its users take all its columns, so that the exchange is written once
    phrases = dealt.mapInArrow(tk.tidy(_count_phrases(window)), "h long, bucket int, n int")
    recurring = phrases.withColumn("total", F.sum("n").over(W.partitionBy("h"))).where("total > 1").select("bucket", "h")
    spelled = dealt.groupBy("bucket").cogroup(recurring.groupBy("bucket")).applyInArrow(_spell(window), "bucket int, phrase binary, n int")
    confirmed = spelled.withColumn("total", F.sum("n").over(W.partitionBy("phrase"))).where("total > 1").select("bucket", "phrase")
    found = dealt.groupBy("bucket").cogroup(confirmed.groupBy("bucket")).applyInArrow(_candidates(window), "w long, doc_id long, start int, places binary")
    order = W.partitionBy(F.col("places").isNull(), "w").orderBy("doc_id", "start")
    ranked = found.withColumn("r", F.dense_rank().over(order)).where("r > 1 or places is not null")
    late = ranked.select(F.pmod(F.xxhash64("doc_id", F.lit("bucket")), F.lit(n_buckets)).cast("int").alias("bucket"), "w", "doc_id", "places")
    extra = [docs.schema[c] for c in carry]
    ddl = ", ".join(["doc_id long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "n_words long, n_removed long, kept_sha256 string, kept_text string"])
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", pa.int64()), *((f.name, to_arrow_type(f.dataType)) for f in extra), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    return dealt.groupBy("bucket").cogroup(late.groupBy("bucket")).applyInArrow(_remove(window, schema, with_text), ddl)
