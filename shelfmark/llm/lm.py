"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts with the counts of the bytes that follow,
learned from all training texts.  A byte that a context has not seen is coded by
an escape (probability: distinct followers over total plus distinct followers)
and then by the next shorter context without the bytes already excluded.  As
every context of the trie comes from the same text, the bytes excluded at an
order are exactly the followers of the longer context, so all probabilities of
the trie can be tabled once and texts scored by table lookup.

The order is the same for every corpus.  The table that is broadcast holds all
shorter contexts and the most frequent of the longest; the other longest
contexts stay a Spark table that is joined in full with the contexts of the
texts.

The unigram base score needs the count of every word in the training texts; it
is computed by a join with the full count table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import written

END = 0xFF  #: never a byte of UTF-8: ends each text, and pads the context before it
WORDS, GRAMS = 0, 1
END_WORD = np.uint64(0x5E5E5E5E5E5E5E5E)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _grams(s: tk.Slice, order: int) -> np.ndarray:
    """Context and byte packed in one number, for every byte and the end of every text."""
    docs = np.arange(s.n_docs)
    total = len(s.data) + s.n_docs * (order + 1)
    padded = np.full(total, END, np.uint32)
    padded[np.arange(len(s.data)) + np.repeat(docs * (order + 1) + order, np.diff(s.offsets))] = s.data
    n = total - order
    key = padded[:n].copy()
    for j in range(1, order + 1):
        key <<= np.uint32(8)
        key |= padded[j : j + n]
    keep = np.ones(n, bool)  # windows that reach from one text into the next go
    begins = s.offsets[1:-1] + docs[1:] * (order + 1)
    for j in range(1, order + 1):
        keep[begins - j] = False
    return key[keep]


def _learn(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {WORDS: [], GRAMS: []}

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            sort = np.argsort(keys)
            keys, counts = keys[sort], counts[sort]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[at], np.add.reduceat(counts, at)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = merged(kind)
            held[kind] = []
            for a in range(0, len(keys), 100_000):
                k = keys[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(counts[a : a + 100_000])], ["kind", "key", "n"])

        for b in batches:
            for s in tk.slices(b.column(0), fold=tk.LOWER):
                held[WORDS] += [np.unique(s.word_hashes(), return_counts=True), (np.array([END_WORD]), np.array([s.n_docs]))]
                keys, counts = np.unique(_grams(s, order), return_counts=True)
                held[GRAMS].append((keys.astype(np.uint64), counts))
                for kind in held:
                    if sum(len(k) for k, _ in held[kind]) > 1_500_000:
                        keys, counts = merged(kind)
                        held[kind] = [(keys, counts)]
                        if len(keys) > 1_000_000:
                            yield from out(kind)
        for kind in held:
            if held[kind]:
                yield from out(kind)

    return run


class Trie:
    """Tabled log10 probabilities: a row for each context, a column for each byte of the alphabet.

    ``lower`` are keys and counts of all contexts of ``order - 1``, ``top`` those of
    some contexts of ``order``; the others are scored as if they had not been seen.
    """

    def __init__(self, lower: tuple[np.ndarray, np.ndarray], top: tuple[np.ndarray, np.ndarray], order: int):
        self.order = order
        symbols = np.unique(lower[0] & np.uint64(255)).astype(np.int64)
        self.column = np.full(256, len(symbols), np.int32)  # bytes never seen share the last column
        self.column[symbols] = np.arange(len(symbols))
        width = len(symbols) + 1
        full, lower = lower, None
        self.row = np.zeros(1, np.int32)
        tables: list[np.ndarray] = []
        base = 0
        for k in range(order + 1):
            keys, counts = full if k < order else top
            if k == order:  # what tells whether a text's context may be one that is joined
                self.base, self.low_row, self.low_base, self.low_seen = base, lower[1], lower[0][3], lower[0][0] > 0
            short = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.argsort(short, kind="stable")
            short, n = short[at], counts[at]
            first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
            n = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
            ctx, sym = (short[first] >> np.uint64(8)).astype(np.int64), self.column[(short[first] & np.uint64(255)).astype(np.int64)]
            uctx, which = np.unique(ctx, return_inverse=True)
            seen = np.zeros((len(uctx), width), np.float32)
            seen[which, sym] = n
            if k == 0:
                uctx = np.zeros(1, np.int64)
                seen = seen if len(seen) else np.zeros((1, width), np.float32)
                rest = np.zeros((1, width))
                rest[:, :] = 1.0 / max(1, 256 - len(symbols))
                parent = np.zeros(1, np.int64)
                table = self._code(seen, None, rest)
                rows = np.zeros(1, np.int32)
            else:
                parent = lower[1][uctx & ((1 << 8 * (k - 1)) - 1)]
                table = np.empty_like(seen)
                for a in range(0, len(uctx), 4096):  # bounded temporaries
                    table[a : a + 4096] = self._follow(seen[a : a + 4096], parent[a : a + 4096], lower[0])
                rows = np.tile(lower[1], 256)
                rows[uctx] = base + np.arange(len(uctx))
            tables.append(table)
            lower = ((seen, parent, lower[0] if lower else None, base), rows)
            base += len(uctx)
        self.row = rows
        self.table = np.log10(np.maximum(np.concatenate(tables), 1e-30)).astype(np.float32)

    @staticmethod
    def _code(seen: np.ndarray, excluded: np.ndarray | None, rest: np.ndarray) -> np.ndarray:
        """Probabilities of one order; ``rest`` holds what an escape leads to."""
        free = seen if excluded is None else np.where(excluded, 0, seen)
        total, kinds = free.sum(1, keepdims=True, dtype=np.float64), (free > 0).sum(1, keepdims=True)
        scale = np.maximum(total + kinds, 1)
        escape = np.where(kinds > 0, kinds / scale, 1.0)
        return np.where(free > 0, free / scale, escape * rest)

    def _follow(self, seen: np.ndarray, parent: np.ndarray, lower: tuple) -> np.ndarray:
        """Code for contexts whose suffixes are rows ``parent`` of the order below."""
        below, up, further, base = lower
        at = parent - base
        rest = self._excluded(at, seen > 0, lower)
        return self._code(seen, None, rest)

    def _excluded(self, at: np.ndarray, excluded: np.ndarray, level: tuple) -> np.ndarray:
        """Probabilities in contexts ``at`` of one order when ``excluded`` bytes cannot come."""
        seen, parent, further, base = level
        own = seen[at]
        if further is None:
            n_seen = int((seen[0] > 0).sum())
            rest = np.full(own.shape, 1.0 / max(1, 256 - n_seen))
        else:
            rest = self._excluded(parent[at] - further[3], own > 0, further)
        return self._code(own, excluded, rest)

    def score(self, s: tk.Slice) -> np.ndarray:
        """log10 probability of each text and its end."""
        key = _grams(s, self.order)
        logs = self._logs(key).astype(np.float64)
        first = s.offsets[:-1] + np.arange(s.n_docs)
        return np.add.reduceat(logs, first) if len(logs) else np.zeros(0)

    def _logs(self, key: np.ndarray) -> np.ndarray:
        cell = self.row[key >> np.uint32(8)].astype(np.int64) * self.table.shape[1] + self.column[(key & np.uint32(255)).astype(np.int64)]
        return self.table.ravel()[cell]

    def untabled(self, s: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, key, count, tabled log10 and whether the shorter context has the byte, where the longest context is not tabled but may be known."""
        key = _grams(s, self.order)
        ctx = key >> np.uint32(8)
        low = ctx & np.uint32((1 << 8 * (self.order - 1)) - 1)
        left = np.flatnonzero((self.row[ctx] < self.base) & (self.low_row[low] >= self.low_base))
        doc = np.repeat(np.arange(s.n_docs, dtype=np.uint64), np.diff(s.offsets) + 1)[left]
        pairs, n = np.unique(doc << np.uint64(32) | key[left], return_counts=True)
        key = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low = self.low_row[key >> np.uint32(8) & np.uint32((1 << 8 * (self.order - 1)) - 1)] - self.low_base
        return (pairs >> np.uint64(32)).astype(np.int64), key, n, self._logs(key), self.low_seen[low, self.column[(key & np.uint32(255)).astype(np.int64)]]


def score_corpus(docs: DataFrame, order: int = 3, max_cells: int = 24_000_000, frequent: int = 1 << 18, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from all training rows.  The trie has order ``order`` (2 or 3)
    whatever the corpus.  Its table of about ``max_cells`` cells is broadcast: all
    shorter contexts (65,793 of 256 bytes at most), and the most frequent of the
    longest ones as far as there is room; the rest are joined in full, so
    ``max_cells`` changes no score but by rounding.  The ``frequent`` most frequent words are looked up in a
    broadcast table of that size; all other words are joined with the full
    count table.  A null text is an empty text (one token, its end).  Repeated
    rows are scored one by one.  With no training rows all counts are 0.
    """
    sc = docs.sparkSession.sparkContext
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col), body.alias("_t"), F.xxhash64(F.col(id_col), body).alias("_key"), held_out(F.col(id_col)).alias("_held"))
    counts = written(rows.where(~F.col("_held")).select("_t").mapInArrow(tk.tidy(_learn(order)), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    vocabulary = counts.where(F.col("kind") == WORDS).select("key", "n")
    level = F.floor(F.log2("n")).cast("int")
    levels = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.coalesce(F.max(F.when(F.col("key") == int(END_WORD.view(np.int64)), F.col("n"))), F.lit(0)).alias("ends")).collect()
    n_train, v_train, n_ends = sum(r["n"] for r in levels), sum(r["v"] for r in levels), max([0, *(r["ends"] for r in levels)])
    floor, room = 64, frequent  # the lowest power of two that few enough words reach
    for r in sorted(levels, key=lambda r: -r["level"]):
        room -= r["v"]
        if room < 0:
            break
        floor = r["level"]

    grams = counts.where(F.col("kind") == GRAMS)
    lower = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * order) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    full = _sorted(lower)
    contexts = grams.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"))
    cells = len(np.unique(full[0] & np.uint64(255))) + 1
    space = max_cells - cells * sum(len(np.unique(full[0] >> np.uint64(8) & np.uint64((1 << 8 * k) - 1))) for k in range(order))
    least = 0  # contexts seen less often are joined
    for r in contexts.groupBy(F.floor(F.log2("total")).cast("int").alias("level")).count().orderBy(F.desc("level")).collect():
        space -= r["count"] * cells
        if space < 0:
            least = 2 << r["level"]
            break
    hot = grams
    if least:
        hot = grams.withColumn("ctx", F.shiftright("key", 8)).join(contexts.where(F.col("total") >= least), "ctx", "left_semi")
    trie = sc.broadcast((full, _sorted(hot.select("key", "n").toArrow()), order))
    top_keys, top_counts = _sorted(vocabulary.where(level >= floor).toArrow())
    known = sc.broadcast((top_keys, np.log10(top_counts + 0.5)))
    unit = float(np.log10(n_train + 0.5 * (v_train + 1)))
    end_log = float(np.log10(n_ends + 0.5))

    def look(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, logs = known.value
        at = np.minimum(np.searchsorted(top, h), max(0, len(top) - 1))
        return at, (top[at] == h) if len(top) else np.zeros(len(h), bool)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row_keys = b.column(0).to_numpy()
            for s in tk.slices(b.column(1), fold=tk.LOWER):
                h, d = s.word_hashes(), s.word_docs()
                left = np.flatnonzero(~look(h)[1])
                h, d = h[left], d[left]
                if not len(h):
                    continue
                sort = np.lexsort((h, d))
                h, d = h[sort], d[sort]
                at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
                yield pa.RecordBatch.from_arrays([pa.array(row_keys[s.first + d[at]]), pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))).astype(np.int32))], ["_key", "key", "tf"])
            # one marker for each row, so that repeated rows can be told from repeated words
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array(np.full(len(b), -1, np.int32))], ["_key", "key", "tf"])

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Trie(*trie.value)
            row_keys = b.column(0).to_numpy()
            for s in tk.slices(b.column(1), fold=tk.LOWER):
                d, key, n, logs, seen = model.untabled(s)
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(row_keys[s.first + d]), pa.array((key >> np.uint32(8)).astype(np.int32)), pa.array((key & np.uint32(255)).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(logs.astype(np.float64)), pa.array(seen)], ["_key", "ctx", "byte", "tf", "low", "seen"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or Trie(*trie.value)
            parts = []
            for s in tk.slices(b.column(3), fold=tk.LOWER):
                h = s.word_hashes()
                at, ok = look(h)
                d = s.word_docs()
                logs = np.bincount(d[ok], known.value[1][at[ok]], s.n_docs) if len(known.value[0]) else np.zeros(s.n_docs)
                parts.append((s.n_words + 1, np.bincount(d[ok], minlength=s.n_docs), logs, model.score(s)))
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c) for c in cols)], ["_id", "_key", "_held", "n_tokens", "n_top", "logs", "score"])

    tf = F.when(F.col("tf") > 0, F.col("tf"))
    words = rows.select("_key", "_t").mapInArrow(tk.tidy(rare), "_key long, key long, tf int").join(vocabulary, "key", "left")
    rest = words.groupBy("_key").agg(
        F.sum(tf * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, tf)).alias("n_rest"), F.sum(F.when(F.col("tf") < 0, 1)).alias("copies")
    )
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, _key long, _held boolean, n_tokens long, n_top long, logs double, score double"
    per_row = rows.select(F.col(id_col).alias("_id"), "_key", "_held", "_t").mapInArrow(tk.tidy(scored), schema)
    if least:
        found = rows.select("_key", "_t").mapInArrow(tk.tidy(cold), "_key long, ctx int, byte int, tf int, low double, seen boolean").join(_cold_contexts(grams, contexts.where(F.col("total") < least), order), "ctx")
        n = F.try_element_at("followers", F.col("byte"))
        change = F.when(n.isNotNull(), F.log10(n) - F.col("scale") - F.col("low")).when(F.col("seen"), F.col("to_seen")).otherwise(F.col("to_other"))
        more = found.groupBy("_key").agg(F.sum(F.col("tf") * change).alias("more"))
        rest = rest.join(more, "_key", "left")
    else:
        rest = rest.withColumn("more", F.lit(0.0))
    return per_row.join(rest, "_key", "left").select(
        F.col("_id").alias(id_col), F.col("_held").alias("held_out"), "n_tokens",
        (F.col("n_top") + F.coalesce(F.col("n_rest") / F.col("copies"), F.lit(0.0)) + int(n_ends > 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce(F.col("rest") / F.col("copies"), F.lit(0.0)) + end_log - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))).alias("score"),
    )


def _cold_contexts(grams: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """Per wanted context: ctx, followers (byte to count), scale, and what to add to the
    shorter context's log10 probability for another byte that it has (to_seen) or has not (to_other).

    Excluding the followers takes their counts out of the shorter context, whose
    followers they all are.
    """
    byte = F.col("key").bitwiseAND(255).cast("int")
    low = grams.groupBy(F.col("key").bitwiseAND((1 << 8 * order) - 1).alias("low")).agg(F.sum("n").alias("n_low"))
    short = low.groupBy(F.shiftright("low", 8).alias("short")).agg(F.sum("n_low").alias("t_low"), F.count("*").alias("k_low"))
    long = grams.withColumn("ctx", F.shiftright("key", 8)).join(wanted.select("ctx"), "ctx", "left_semi")
    long = long.withColumn("low", F.col("key").bitwiseAND((1 << 8 * order) - 1)).join(low, "low")
    own = long.groupBy("ctx").agg(F.sum("n").alias("t"), F.count("*").alias("k"), F.sum("n_low").alias("gone"), F.map_from_entries(F.collect_list(F.struct(byte, "n"))).alias("followers"))
    own = own.withColumn("short", F.col("ctx").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(short, "short")
    kinds = F.col("k_low") - F.col("k")
    left = F.greatest(F.col("t_low") - F.col("gone") + kinds, F.lit(1))
    scale, scale_low = F.log10(F.col("t") + F.col("k")), F.log10(F.col("t_low") + F.col("k_low"))
    escape = F.log10("k") - scale
    further = F.when(kinds > 0, F.log10(kinds) - F.log10(left)).otherwise(0.0)
    return own.select(F.col("ctx").cast("int").alias("ctx"), "followers", scale.alias("scale"), (escape + scale_low - F.log10(left)).alias("to_seen"), (escape + further - F.log10("k_low") + scale_low).alias("to_other"))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = table.column("key").to_numpy().view(np.uint64)
    at = np.argsort(keys)
    return keys[at], table.column("n").to_numpy()[at]
