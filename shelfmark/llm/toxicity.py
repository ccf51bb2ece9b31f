"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; the model of a category sees the
probabilities of the categories before it.  While training, these come from
models that did not see the row (out-of-fold), so later models learn how far
earlier ones can be trusted.  Features are words and byte prefixes of words,
hashed; the ones that tell the classes apart are chosen on the sample.

The categories are ``low_quality`` and ``toxic``, both from the label table, and
between them ``group_1`` and ``group_2``, which are found in the sample: the
features that lean to toxic rows are split in two by the sign of the first
principal axis of their occurrence in toxic rows, so features that keep company
share a group, and a toxic row is in a group if it has one of its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import with_fields

CATEGORIES = ["low_quality", "group_1", "group_2", "toxic"]
PREFIXES = (4, 5, 6)


@dataclass
class Chain:
    names: list[str]
    features: np.ndarray  #: sorted hashes
    weights: np.ndarray  #: categories x (features + earlier categories + bias)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, rows x categories, from 0/1 features."""
        p = np.zeros((len(x), len(self.names)))
        for k in range(len(self.names)):
            w = self.weights[k]
            f = x.shape[1]
            p[:, k] = _sigmoid(x @ w[:f] + p[:, :k] @ w[f : f + k] + w[-1])
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _design(x: np.ndarray, earlier: np.ndarray, rows: np.ndarray, ones: int = 0) -> np.ndarray:
    """The chosen rows of the features and the earlier probabilities, with as many columns of ones at the end; copied a few rows at a time."""
    f, k = x.shape[1], earlier.shape[1]
    out = np.ones((len(rows), f + k + ones), np.float32)
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        out[a : a + 256, :f], out[a : a + 256, f : f + k] = x[part], earlier[part]
    return out


def _fit(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 120) -> np.ndarray:
    """Logistic regression by accelerated gradient descent on scaled columns, the last of them ones for the bias; ``x`` is overwritten."""
    n = len(x)
    if not n:
        return np.zeros(x.shape[1], np.float32)
    scale = np.concatenate([1 / np.sqrt(np.square(x[:, a : a + 64]).mean(0) + 1e-6) for a in range(0, x.shape[1], 64)]).astype(np.float32)
    x *= scale
    top = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # power iteration for the step length
        top = x.T @ (x @ (top / np.linalg.norm(top))) / n
    rate = 1 / (0.3 * float(np.linalg.norm(top)) + l2)
    w = np.zeros(x.shape[1], np.float32)
    v, y = w.copy(), y.astype(np.float32)
    for i in range(steps):
        g = x.T @ (_sigmoid(x @ v) - y) / n + l2 * np.append(v[:-1], np.float32(0))
        new = (v - rate * g).astype(np.float32)
        v, w = new + np.float32(i / (i + 3)) * (new - w), new
    return w * scale


def fit_chain(x: np.ndarray, labels: dict[str, np.ndarray], features: np.ndarray, folds: int = 4, l2: float = 3e-4) -> Chain:
    """Train the chain; rows are dealt to folds by position, and a model is fitted on rows whose label is known (not NaN)."""
    names, n = list(labels), len(x)
    fold = np.arange(n) % folds
    earlier, weights = np.zeros((n, 0), np.float32), []
    for k, name in enumerate(names):
        y = labels[name].astype(float)
        known = ~np.isnan(y)
        out = np.zeros(n)
        for f in range(folds):
            test, train = np.flatnonzero(fold == f), np.flatnonzero(known & (fold != f))
            w = _fit(_design(x, earlier, train, 1), y[train], l2)
            out[test] = _sigmoid(_design(x, earlier, test) @ w[:-1] + w[-1])
        train = np.flatnonzero(known)
        w = _fit(_design(x, earlier, train, 1), y[train], l2)
        weights.append(np.concatenate([w[:-1], np.zeros(len(names) - k), w[-1:]]))
        earlier = np.hstack([earlier, out[:, None].astype(np.float32)])
    return Chain(names, features, np.array(weights))


def toxic_groups(x: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0/1 membership of the rows in the two groups of toxic features."""
    rows = x[toxic == 1]
    lean = np.flatnonzero(rows.mean(0) > x[toxic == 0].mean(0))
    if not len(lean):
        return np.zeros(len(x)), np.zeros(len(x))
    held = rows[:, lean] - rows[:, lean].mean(0)
    axis = np.linalg.eigh(held.T @ held)[1][:, -1]
    axis *= 1 if axis[np.abs(axis).argmax()] > 0 else -1
    return tuple((toxic == 1) * (x[:, lean[side]].sum(1) > 0) for side in (axis >= 0, axis < 0))


def word_features(s: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, document) of every word and every long enough prefix of a word."""
    hashes, docs = [s.word_hashes()], [s.word_docs()]
    for k in PREFIXES:
        long = np.flatnonzero(s.ends - s.starts > k)
        hashes.append(tk.mix64(s.span_hashes(s.starts[long], s.starts[long] + k)))
        docs.append(docs[0][long])
    return np.concatenate(hashes), np.concatenate(docs)


def _known(s: tk.Slice, features: np.ndarray, filt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature index) of the occurrences of chosen features; repeats stay."""
    h, d = word_features(s)
    maybe = np.flatnonzero(filt[(h & np.uint64(0xFFFF)).astype(np.int64)])
    h, d = h[maybe], d[maybe]
    at = np.minimum(np.searchsorted(features, h), len(features) - 1)
    ok = features[at] == h
    return d[ok], at[ok]


def _filter(features: np.ndarray) -> np.ndarray:
    filt = np.zeros(1 << 16, bool)
    filt[(features & np.uint64(0xFFFF)).astype(np.int64)] = True
    return filt


def train_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, max_features: int = 1000, min_rows: int = 3, min_lift: float = 1.5, min_surprise: float = 3.5, id_col: str = "doc_id", text: str = "text") -> Chain | None:
    """Fit the chain on at most ``sample_rows`` labelled rows (half of each class, by smallest hash of the id).

    Only the bounded sample is fitted on; None if it lacks one of the classes.
    Rows without an id, a text or a toxic label of 0 or 1 are left out; of the
    labels of one id the largest counts.  A quality that is not 0 or 1 (or no such
    column) is unknown.  Ids may be of any type.
    """
    quality = F.col("quality").cast("int") if "quality" in labels.columns else F.lit(None).cast("int")
    usable = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_y"), quality.alias("_q")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"), F.max("_q").alias("_q"))
    picked = [usable.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows // 2) for y in (0, 1)]
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).where("_t is not null").join(F.broadcast(picked[0].unionByName(picked[1])), "_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(2).to_numpy()
            for s in tk.slices(b.column(1), tk.ALNUM_WORDS, tk.LOWER):
                h, d = word_features(s)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, hot = h[new], y[s.first + d[new]]
                u, inv = np.unique(h, return_inverse=True)
                pos = np.bincount(inv, hot, len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, minlength=len(u)) - pos), pa.array(pos)], ["h", "neg", "pos"])

    total = sample.groupBy("_y").count().collect()
    n = {r["_y"]: r["count"] for r in total}
    if not n.get(0) or not n.get(1):
        return None
    stats = sample.mapInArrow(tk.tidy(counted), "h long, neg long, pos long").groupBy("h").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, q = (F.col("pos") + 0.5) / (n[1] + 1.0), (F.col("neg") + 0.5) / (n[0] + 1.0)
    lift, gain = F.abs(F.log(p / q)), F.abs(p - q) * F.abs(F.log(p / q))
    seen, share = F.col("pos") + F.col("neg"), n[1] / (n[0] + n[1])
    surprise = F.abs(F.col("pos") - seen * share) / F.sqrt(seen * share * (1 - share))  # in standard deviations
    chosen = stats.where((seen >= min_rows) & (lift >= min_lift) & (surprise >= min_surprise)).withColumn("g", gain).orderBy(F.desc("g"), "h").limit(max_features).select("h").collect()
    features = np.sort(np.array([r["h"] for r in chosen], np.int64).view(np.uint64))
    if not len(features):
        return None
    filt = _filter(features)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in tk.slices(b.column(1), tk.ALNUM_WORDS, tk.LOWER):
                d, at = _known(s, features, filt)
                order = np.argsort(d, kind="stable")
                bounds = np.searchsorted(d[order], np.arange(s.n_docs + 1))
                at = at[order]
                lists = [np.unique(at[bounds[i] : bounds[i + 1]]).astype(">i4").tobytes() for i in range(s.n_docs)]  # as bytes they sort as the numbers do
                rows = b.slice(s.first, s.n_docs)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.array(lists, pa.binary())], ["key", "y", "q", "at"])

    rows = sample.select(F.xxhash64("_id"), "_t", "_y", "_q").mapInArrow(tk.tidy(encoded), "key long, y int, q int, at binary").collect()
    rows.sort(key=lambda r: (r["key"], r["at"]))
    x, y = np.zeros((len(rows), len(features)), np.float32), np.array([r["y"] for r in rows])
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], ">i4")] = 1
    low = np.array([1.0 - r["q"] if r["q"] in (0, 1) else np.nan for r in rows])
    one, two = toxic_groups(x, y)
    del rows
    chain = fit_chain(x, dict(zip(CATEGORIES, (low, one, two, y), strict=True)), features)
    del x
    tk.release()  # the driver keeps the chain only
    return chain


def score_toxicity(docs: DataFrame, chain: Chain | None, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """All columns plus a probability ``p_<category>`` for each of ``CATEGORIES`` and toxic (these replace clashing names).

    One pass, no shuffle; the model (at most a few thousand weights) goes with the
    task.  Null and empty texts get the probabilities of a text without features.
    Without a model (no labels of one class) nothing is toxic.
    """
    probabilities = [f"p_{c}" for c in CATEGORIES]
    names = [*probabilities, "toxic"]
    docs = docs.select(*[c for c in docs.columns if c not in names])
    if chain is None:
        return docs.selectExpr("*", *[f"0D as {p}" for p in probabilities], "false as toxic")
    at_text, kept = docs.columns.index(text), docs.columns
    filt = _filter(chain.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = len(chain.features)
        for b in batches:
            out = []
            for s in tk.slices(b.column(at_text), tk.ALNUM_WORDS, tk.LOWER):
                d, at = _known(s, chain.features, filt)
                pairs = np.unique(d * f + at)
                d, at = pairs // f, pairs % f
                p = np.zeros((s.n_docs, len(chain.names)))
                for k in range(len(chain.names)):
                    w = chain.weights[k]
                    p[:, k] = _sigmoid(np.bincount(d, w[at], s.n_docs) + p[:, :k] @ w[f : f + k] + w[-1])
                out.append(p)
            p = np.concatenate(out) if out else np.zeros((0, len(chain.names)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, k]) for k in range(len(names) - 1)), pa.array(p[:, -1] >= threshold)], [*kept, *names])

    return docs.mapInArrow(tk.tidy(run), with_fields(docs.schema, ", ".join(f"{p} double" for p in probabilities) + ", toxic boolean"))
