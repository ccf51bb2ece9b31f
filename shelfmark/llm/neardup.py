"""MinHash near-deduplication with SetSketch registers.

Every document's set of word shingles is reduced to registers: a register is the
exponentially spaced, truncated minimum of exponential draws of all shingles, so
registers of a union are register maxima (mergeable), and two documents agree in
a register about as often as their sets overlap (locality-sensitive).

Candidates share a band of registers.  Their similarity is estimated from the
registers above, equal and below by maximum likelihood with the known set sizes;
pairs that may reach the threshold are verified on the full sets.  Documents of
equal sets are one class from the start.  Inside a band bucket members are first
compared with a pivot only; members of buckets that still hold different
components are then compared with a central member, and across components where
exact bounds from that comparison and a prefix filter on the shingles that the
central member lacks allow a link, so components are those of all candidate
pairs although the pairs of a large group are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import written

SHINGLE = 5
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
BANDS, BAND_ROWS = 32, 5
REGISTERS = BANDS * BAND_ROWS
#: registers compared for the estimate
COMPARED = 96
#: pairs estimated this far below the threshold are still verified (over four standard deviations)
MARGIN = 0.2

#: two bits of each register, packed in longs; pairs of similarity 0.75 agree in 81 % of them
MARKS = REGISTERS // 32
#: shingles by which a row beyond a centre looks for its hub
HUB_SHINGLES = 8
#: longs of a parity map: a bit is set where an odd number of a set's shingles hash to it
PARITY = 8

_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 32, (REGISTERS, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def document_sets(s: tk.Slice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents of a slice, and each document's first one."""
    words, n = s.word_hashes(), s.n_words
    grams = tk.ngram_hashes(words, k)
    out, sizes = [], np.zeros(s.n_docs + 1, np.int64)
    for d in range(s.n_docs):
        a, z = s.word_offsets[d], s.word_offsets[d + 1]
        if n[d] >= k:
            one = np.unique(grams[a : z - k + 1])
        elif n[d]:
            one = tk.ngram_hashes(words[a:z], int(n[d])) + np.uint64(n[d])
        else:
            continue
        out.append(one)
        sizes[d + 1] = len(one)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def registers(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers, documents x registers; documents without shingles have zeros."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    a = 0
    while a < len(full):  # parts that stay in cache
        z = max(a + 1, int(np.searchsorted(offsets[full], offsets[full[a]] + 60_000)))
        lo, hi = offsets[full[a]], offsets[full[z - 1] + 1]
        low, high = (shingles[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (shingles[lo:hi] >> np.uint64(32)).astype(np.uint32)
        first = offsets[full[a:z]] - lo
        least = np.empty((REGISTERS, z - a), np.uint32)
        for i in range(REGISTERS):
            x = low * _SEEDS[i, 0]
            x ^= x >> np.uint32(15)
            x += high * _SEEDS[i, 1]
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(13)
            x *= np.uint32(0xC2B2AE35)
            x ^= x >> np.uint32(16)
            least[i] = np.minimum.reduceat(x, first)
        draw = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
        out[full[a:z]] = np.clip(np.floor(1 - np.log(draw) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16).T
        a = z
    return out


def marks(regs: np.ndarray) -> np.ndarray:
    """The two lowest bits of all registers, documents x ``MARKS`` longs."""
    pairs = (regs & 3).astype(np.uint64).reshape(len(regs), MARKS, 32)
    return np.bitwise_or.reduce(pairs << (2 * np.arange(32, dtype=np.uint64)), 2).view(np.int64)


def least_agreement(percent: int, deviations: float = 5.0) -> int:
    """How many marks a pair of the threshold agrees in at least, by five standard deviations: 3e-7 of such pairs have fewer."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(REGISTERS * p - deviations * (REGISTERS * p * (1 - p)) ** 0.5)


def _agree(one: str, two: str) -> Column:
    """How many marks of two rows agree."""
    odd = 0x5555555555555555

    def differ(i: int) -> Column:
        x = F.col(f"{one}{i}").bitwiseXOR(F.col(f"{two}{i}"))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(odd)))

    return F.lit(REGISTERS) - reduce(Column.__add__, (differ(i) for i in range(MARKS)))


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity map of one set.  Maps of two sets differ in at most as many bits as the sets have shingles apart."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _odd(one: str, two: str) -> Column:
    """In how many bits the parity maps of two rows differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"{one}{i}").bitwiseXOR(F.col(f"{two}{i}"))) for i in range(PARITY)))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 30) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of register rows with known set sizes."""
    above, below = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):  # the likelihood is concave in j
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = likelihood(x) > likelihood(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in tk.slices(b.column(1), fold=tk.LOWER):
            sets, offsets = document_sets(s)
            regs = registers(sets, offsets)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            one, two = np.zeros(s.n_docs, np.uint64), np.zeros(s.n_docs, np.uint64)
            if len(full):
                one[full] = np.add.reduceat(sets, offsets[full])
                two[full] = np.bitwise_xor.reduceat(tk.mix64(sets), offsets[full])
            rows = b.slice(s.first, s.n_docs)
            cols = [rows.column(0), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary()), *(pa.array(c) for c in marks(regs).T)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "regs", *(f"m{i}" for i in range(MARKS))])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(0).to_numpy()
        regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(len(v), REGISTERS) if len(v) else np.zeros((0, REGISTERS), np.uint16)
        for k in range(BANDS):
            part = regs[:, k * BAND_ROWS : (k + 1) * BAND_ROWS].astype(np.uint64)
            h = np.full(len(v), k + 1, np.uint64)
            for j in range(BAND_ROWS):
                h = tk.mix64(h * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0)], ["band", "v"])


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            n_a, n_b = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
            a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(len(b), REGISTERS)[:, ::-1][:, :COMPARED] for i in (4, 5))
            j = estimate(a, c, n_a, n_b)
            j = np.maximum(j, (a == c).mean(1))
            keep = pa.array(j >= threshold - MARGIN)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(j).filter(keep)], ["a", "b", "j"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in tk.slices(b.column(1), fold=tk.LOWER):
            sets, offsets = document_sets(s)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, s.n_docs), pa.array([sets[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["v", "shingles"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of two sets, how many shingles they share, and the first set's shingles that the second lacks, and parity map."""
    for b in batches:
        n, m, shared, rest, maps = [], [], [], [], np.zeros((len(b), PARITY), np.int64)
        for x, y in zip(b.column(2), b.column(3), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            inside = q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p
            n.append(len(p))
            m.append(len(q))
            shared.append(int(inside.sum()))
            rest.append(p[~inside].view(np.int64))
            maps[len(n) - 1] = parity(p)
        cols = [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (n, m, shared)), pa.array(rest, pa.list_(pa.int64())), *(pa.array(c) for c in maps.T)]
        yield pa.RecordBatch.from_arrays(cols, ["v", "pv", "n", "np", "i", "rest", *(f"b{i}" for i in range(PARITY))])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, component) of all ends of ``edges`` (a, b): the smallest node that can be reached.

    Each round hooks every node to its smallest neighbour, jumps once along the
    hooks, and contracts the edges; the number of nodes that have edges at least
    halves.  Only grouped minima and joins on node keys are used; every round is
    written to the shared folder.
    """
    return _contracted(written(edges.select("a", "b").where("a <> b").distinct(), "edges"))


def _contracted(edges: DataFrame) -> DataFrame:
    """``components`` of written edges without loops and repeats; every step costs the driver a plan, so none runs for nothing."""
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("p")), "hooks")
        up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        root = written(hook.join(up, "p").select("v", F.col("pp").alias("p")), "roots")
        if labels is None:  # the first round has every node
            labels = root.select("v", F.col("p").alias("component"))
        else:
            labels = written(labels.join(root.select(F.col("v").alias("component"), "p"), "component", "left").select("v", F.coalesce("p", "component").alias("component")), "labels")
        links = both.where("a < b").join(root.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(root.select(F.col("v").alias("b"), F.col("p").alias("y")), "b").select("x", "y")
        chain = root.select(F.col("p").alias("v")).distinct().join(root, "v").select(F.col("v").alias("x"), F.col("p").alias("y"))
        joined = links.union(chain).where("x <> y")
        edges = written(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("component")) if labels is None else labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` after further links: only the components that they join are worked on."""
    ends = links.select("a", "b")
    for c in ("a", "b"):
        ends = ends.join(labels.select(F.col("v").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    edges = written(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges")
    if edges.isEmpty():
        return labels
    joined = _contracted(edges)
    new = joined.select(F.col("v").alias("component"), F.col("component").alias("to"))
    old = labels.join(new, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
    return written(old.union(joined.join(labels, "v", "left_anti")), "labels")


def _need(n: Column, percent: int) -> Column:
    """How many shingles two sets share at least, if they are a link and have ``n`` together."""
    return F.ceil(percent * n / (100 + percent) - 1e-6)


def _around(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of centres that still hold several components, with their own (c), the largest of the centre (top), its least set and number of rows (rows)."""
    salt = F.pmod(F.xxhash64("v"), F.lit(16))
    around = measured.drop("np", "c", "top", "least", "cs", "rows", "salt").join(labels, "v", "left").withColumn("c", F.coalesce("component", "v")).drop("component").withColumn("salt", salt)
    around = written(around, "around")
    sizes = around.groupBy("pv", "c").agg(F.count("*").alias("m"), F.min("n").alias("least")).groupBy("pv").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.min("least").alias("least"), F.count("*").alias("cs"), F.sum("m").alias("rows"))
    return written(around.join(_salted(sizes.where("cs > 1").select("pv", "top", "least", "rows")), ["pv", "salt"]), "around")


def _salted(centres: DataFrame) -> DataFrame:
    """One row of a centre for each salt of its rows."""
    return centres.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))


def _lacked(around: DataFrame) -> DataFrame:
    """(pv, common): the shingles that a centre lacks and most of its rows have.  Fewer than two sets of mean size hold."""
    beyond = around.select("pv", "rows", F.explode("rest").alias("h"))
    common = beyond.groupBy("pv", "h").agg(F.count("*").alias("df"), F.max("rows").alias("rows")).where("2 * df > rows")
    return common.groupBy("pv").agg(F.collect_set("h").alias("common"))


def _with_lacked(around: DataFrame, common: DataFrame) -> DataFrame:
    """The rows as measured against each centre together with the shingles that it lacks and most rows have.

    A centre is a text of the group, with changes of its own: all others share
    what it lacks there and would meet in it.  The bounds hold for any set as centre.
    """
    also = around.join(_salted(common), ["pv", "salt"], "left")
    held = F.when(F.col("common").isNotNull(), F.size(F.array_intersect("rest", "common"))).otherwise(0)
    return also.withColumns({"i": F.col("i") + held, "rest": F.coalesce(F.array_except("rest", "common"), "rest")}).drop("common")


def _with_nearest(around: DataFrame) -> DataFrame:
    """Pairs (x, y) of each row and the row that comes nearest to its centre (pv)."""
    best = around.where("v <> pv").groupBy("pv").agg(F.max_by("v", F.struct(2 * F.col("i") - F.col("n"), F.xxhash64("v"))).alias("y"))
    return around.select("pv", "salt", F.col("v").alias("x")).join(_salted(written(best, "nearest")), ["pv", "salt"]).select("x", "y")


def _rarest_first(around: DataFrame) -> DataFrame:
    """Per row of a centre: its shingles that the centre lacks and several components have, rarest first (hs), and the number of all (own)."""
    beyond = around.select("pv", "v", "c", "n", "i", "least", F.size("rest").alias("own"), F.explode("rest").alias("h"))
    useful = beyond.groupBy("pv", "h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select("pv", "h", "df")
    # files of these tables are far smaller than their rows: no broadcast by file size
    lists = beyond.join(useful.hint("merge"), ["pv", "h"]).groupBy("pv", "v", "c", "n", "i", "least", "own").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("hs"))
    return written(lists, "lists")


def _with_hubs(lists: DataFrame) -> DataFrame:
    """At most one pair (x, y) a row: a row of another component that has the same shingles beyond the centre, and most common ones.

    A group may hold a second one around another text.  The hub of a shingle
    is the row whose shingles are the most frequent of its centre; a row meets the
    hub of most of its HUB_SHINGLES most frequent ones.  This only merges early:
    what is left apart is listed in full.
    """
    score = F.aggregate("hs", F.lit(0).cast("long"), lambda s, e: s + e["df"])
    ends = lists.select("pv", "v", "c", score.alias("score"), F.slice(F.reverse("hs"), 1, HUB_SHINGLES).alias("hs")).select("pv", "v", "c", "score", F.explode("hs.h").alias("h"))
    hubs = ends.groupBy("pv", "h").agg(F.max_by(F.struct("v", "c"), F.struct("score", "v")).alias("hub"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    hubs = hubs.select("pv", "h", F.col("hub.v").alias("y"), F.col("hub.c").alias("cy"))
    met = ends.join(hubs.hint("merge"), ["pv", "h"]).where("c <> cy").groupBy("v", "y").agg(F.count("*").alias("k"))
    return met.groupBy(F.col("v").alias("x")).agg(F.max_by("y", F.struct("k", F.xxhash64("y"))).alias("y"))


def _beyond_centres(around: DataFrame, lists: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of one centre and different components that may be links.

    ``around``: v, pv, n, i (shingles shared with the centre pv), components and
    parity maps; ``lists``: shingles that the centre lacks, rarest first.  A link
    needs ``need`` shared shingles, at most min(ix, iy) of them the centre's.
    Where that suffices, a pair is listed by its sizes.  All other links share
    need - min(ix, iy) shingles or more that the centre lacks, so they meet in
    the rarest ones (prefix filtering): ordered by rarity, the first |rest| - t + 1
    of either side hold a common one, if t are shared.  Shingles that only one
    component has come first and need not be joined at all.

    Texts made from one stock of sentences, or one text with many changes, meet
    in shingles far more often than they are links.  Each row therefore carries
    its parity map: a link of n shingles together has at most n - 2 * need of them
    apart, and maps that differ in more bits rule a pair out, exactly.  Maps of
    more than 64 * PARITY shingles are too full for that; marks of the registers
    are carried too, and a pair is listed only if it agrees in as many as a link
    does: both inside the join, before anything is written.
    """
    sign, bits = [f"m{i}" for i in range(MARKS)], [f"b{i}" for i in range(PARITY)]
    need = lambda n: _need(n, percent)
    both = F.col("nx") + F.col("ny")
    alike = (_odd("xb", "yb") <= both - 2 * need(both)) & (_agree("xm", "ym") >= least_agreement(percent))
    named = lambda side: [F.col(c).alias(f"{side}{c}") for c in (*sign, *bits)]

    # the bound needs x to come near the centre itself, unless y is smaller than it: checked before the join
    signed = reps.select("v", *sign)
    near = around.where(F.col("i") >= need(F.col("n") + F.greatest("least", F.ceil(percent * F.col("n") / 100 - 1e-6)))).join(signed, "v")
    x = near.where("c <> top").select("pv", F.col("v").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("i").alias("ix"), *named("x"))
    y = near.select(F.col("pv").alias("py"), F.col("v").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("i").alias("iy"), *named("y"))
    bounded = x.join(y.hint("merge"), (F.col("pv") == F.col("py")) & (F.col("cx") != F.col("cy")) & (F.least("ix", "iy") >= need(both)) & alike).select("x", "y")

    lists = lists.drop("c").join(around.select("pv", "v", "c", *bits).hint("merge"), ["pv", "v"])
    alone = F.col("own") - F.size("hs")
    smaller = F.greatest(need(2 * F.col("n")) - F.col("i"), F.lit(1))
    larger = F.greatest(need(F.col("n") + F.greatest("least", F.ceil(percent * F.col("n") / 100 - 1e-6))) - F.col("i"), F.lit(1))
    lists = lists.withColumn("as_smaller", F.col("own") - smaller + 1 - alone).withColumn("as_larger", F.col("own") - larger + 1 - alone)
    prefixes = written(lists.where("as_larger > 0").join(signed, "v").select("pv", "v", "c", "n", *sign, *bits, "as_smaller", F.posexplode(F.slice("hs", F.lit(1), F.greatest(F.col("as_larger"), F.lit(0)).cast("int"))).alias("at", "e")).select("pv", "v", "c", "n", *sign, *bits, F.col("e.h").alias("h"), (F.col("at") < F.col("as_smaller")).alias("small")), "prefixes")
    small = prefixes.where("small").select("pv", "h", F.col("v").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), *named("x"))
    large = prefixes.select("pv", "h", F.col("v").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), *named("y"))
    fit = (F.col("cx") != F.col("cy")) & (F.col("nx") <= F.col("ny")) & (100 * F.col("nx") >= percent * F.col("ny")) & alike
    return bounded.union(small.join(large.hint("merge"), ["pv", "h"]).where(fit).select("x", "y"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, class_id.

    Links join documents whose sets of 5-word shingles (A-Z lower-cased) overlap
    by at least ``percent`` of their union; ``component_id`` is the smallest doc_id
    reachable.  A document with fewer than five words has its whole sequence as
    one shingle; one without words has an empty set, links with nothing and is
    its own component.  Null ids stay without a component and are kept.  Rows of
    one doc_id are one node.  Band rows miss a pair of similarity 0.75 with a
    probability of (1 - 0.75**5)**32 = 2e-4 before links through other documents.
    """
    threshold = percent / 100
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = written(base.mapInArrow(tk.tidy(_sketch), "doc_id long, n long, s1 long, s2 long, regs binary, " + ", ".join(f"m{i} long" for i in range(MARKS))), "sketches")
    linked = sketched.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("v"))
    member = written(linked.select("doc_id", "n", "s1", "s2").distinct().join(classes, ["n", "s1", "s2"]).select("doc_id", "v").distinct(), "members")
    reps = written(linked.withColumnRenamed("doc_id", "v").join(classes, ["v", "n", "s1", "s2"], "left_semi").select("v", "n", "regs", *(f"m{i}" for i in range(MARKS))), "classes")

    bands = reps.select("v", "regs").mapInArrow(tk.tidy(_bands), "band long, v long")
    # small tables by band are written before they are joined, so that adaptive execution can split a large bucket
    pivots = bands.groupBy("band").agg(F.min_by("v", F.xxhash64("v", F.pmod("band", F.lit(4)))).alias("p"), F.count("*").alias("size")).where("size > 1").select("band", "p")
    pivots = written(pivots, "pivots")
    shared = written(bands.join(pivots, "band"), "buckets")

    def likely(pairs: DataFrame) -> DataFrame:
        one = reps.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        two = reps.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        with_regs = pairs.join(one, "a").join(two, "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
        return with_regs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(tk.tidy(_likely(threshold)), "a long, b long, j double")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    wanted = shared.select("v").distinct()
    texts = base.where("doc_id is not null").withColumnRenamed("doc_id", "v").join(wanted, "v", "left_semi")
    sets = written(texts.mapInArrow(tk.tidy(_shingled), "v long, shingles binary"), "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb"))
        return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(tk.tidy(_verified(percent)), "a long, b long")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs that are still in different components, with these."""
        la, lb = (labels.select(F.col("v").alias(c), F.col("component").alias(f"c{c}")) for c in ("a", "b"))
        out = pairs.join(la, "a", "left").join(lb, "b", "left")
        return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")

    # Two rounds, each of at most one pair a document: the pivot of most of its buckets, then, of those that are still in
    # another component, the next.  Near copies have another pivot in nearly every bucket, up to BANDS a document; pairs
    # that these rounds leave out are in one component already, or in a bucket of several, which the centres below settle.
    met = written(shared.where("v <> p").groupBy("v", "p").agg(F.count("*").alias("k")), "met")

    def nearest(met: DataFrame) -> DataFrame:
        best = met.groupBy("v").agg(F.max_by("p", F.struct("k", F.xxhash64("p"))).alias("p"))
        return written(likely(ordered(best.select(F.col("v").alias("x"), F.col("p").alias("y")))), "pairs")

    candidates = nearest(met)
    labels = components(verified(candidates))
    left = met.withColumns({"a": F.least("v", "p"), "b": F.greatest("v", "p")}).join(candidates, ["a", "b"], "left_anti")
    others = nearest(apart(left, labels).select("v", "p", "k"))
    labels = merged(labels, written(verified(others), "links"))
    candidates = candidates.union(others)

    # Buckets that still hold several components are measured against a centre.  The hub of a component is its member
    # that meets most others in such buckets, and a bucket's centre is the strongest hub of the components in it.  Two
    # sets meet in at most min(|x & p|, |y & p|) shingles of the centre p, and beyond these only in shingles that p
    # lacks: a pair can be a link only if that bound allows it or if the two have enough of such shingles in common.
    tagged = shared.select("band", "v").join(labels, "v", "left").withColumn("c", F.coalesce("component", "v"))
    several = tagged.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    mixed = written(tagged.select("band", "v", "c").join(written(several, "several"), "band"), "mixed")
    met = mixed.groupBy("v", "c").agg(F.sum("size").alias("met"))
    hubs = met.groupBy("c").agg(F.max_by("v", F.struct("met", F.xxhash64("v"))).alias("pv"), F.max("met").alias("met"))
    central = mixed.select("band", "c").distinct().join(hubs, "c").groupBy("band").agg(F.max_by("pv", F.struct("met", F.xxhash64("pv"))).alias("pv"))
    spokes = mixed.join(written(central, "central"), "band").select("v", "pv").distinct()
    of_v, of_p = sets.select("v", F.col("shingles").alias("sv")), sets.select(F.col("v").alias("pv"), F.col("shingles").alias("sp"))
    measured = written(spokes.join(of_v, "v").join(of_p, "pv").select("v", "pv", "sv", "sp").mapInArrow(tk.tidy(_against), "v long, pv long, n long, np long, i long, rest array<long>, " + ", ".join(f"b{i} long" for i in range(PARITY))), "spokes")
    star = measured.where((F.col("v") != F.col("pv")) & (100 * F.col("i") >= percent * (F.col("n") + F.col("np") - F.col("i"))))
    labels = merged(labels, star.select(F.least("v", "pv").alias("a"), F.greatest("v", "pv").alias("b")))

    def linked_in(pairs: DataFrame) -> DataFrame:
        return merged(labels, written(verified(likely(ordered(pairs).join(candidates, ["a", "b"], "left_anti"))), "links"))

    # Each row also meets the one nearest to centre and majority, then the hub of its shingles beyond these.
    around = _around(measured, labels)
    if not around.isEmpty():
        around = written(_with_lacked(around, written(_lacked(around), "lacked")), "around")
        labels = linked_in(_with_nearest(around))
        around = _around(around, labels)
    if not around.isEmpty():
        lists = _rarest_first(around)
        labels = linked_in(_with_hubs(lists))
        around = _around(around, labels)
    if not around.isEmpty():
        labels = linked_in(_beyond_centres(around, lists, reps, percent))

    nodes = member.join(labels, "v", "left").select("doc_id", F.col("v").alias("class_id"), F.coalesce("component", "v").alias("c"))
    nodes = nodes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.min("c").alias("c"))
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return rows.join(nodes, "doc_id", "left").select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.when(F.col("n_shingles") > 0, F.col("class_id")).alias("class_id"))
