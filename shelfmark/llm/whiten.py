"""Whitening of embeddings along exact principal components.

Entries become integers, so sums, products and the scatter matrix of all rows are
exact whatever the order in which tasks add them.  Tasks send one partial sum for
each pair of dimensions; the scatter's characteristic polynomial is found modulo
many primes by Spark tasks and put together by Chinese remainders, its roots and
components come from ``spectrum``.  Through the driver go tables of the size of
the dimension only.

Defined results: a vector that is null, or has null or non-finite entries, is
left out; so is one whose length is not that of most vectors (ties: the larger),
as it has no place in their covariance.  Entries beyond the range of a long are
held at its ends.  A component of eigenvalue zero has no whitening and is not
returned, so equal vectors, or a single one, give none.  Repeated rows count as
often as they stand, a null id stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import written
from shelfmark.llm.spectrum import coefficient_bound, combine, null_space, primes_below, residues, top_roots

SCALE, SHIFT = 1024, 100_000
#: vectors of more dimensions are refused: the polynomial's cost grows with the fourth power of the dimension
MAX_DIMENSION = 1024
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_LIMB = 10**18
_EXACT = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """What a fit found; ``components`` are unit vectors by falling eigenvalue."""

    n: int
    sums: list[int]  #: of the integer entries, by dimension
    eigenvalues: list[float]  #: of the covariance of the integer entries
    explained: list[float]  #: shares of the trace
    components: np.ndarray


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has finite entries and the length of most such vectors."""
    finite = F.forall(column, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite)
    sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return rows.where(F.size(column) == (sizes["d"] if sizes else 0))


def _whole(column: pa.Array) -> np.ndarray:
    """Shifted-back integer entries of a batch: float64 where that is exact, else Python integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(flat * SCALE).reshape(len(column), -1)
    if np.abs(y).max(initial=0) < _EXACT >> 1:
        return y
    held = [[min(max(int(v), _LOW), _HIGH) if np.isfinite(v) else (_HIGH if v > 0 else _LOW) for v in row] for row in y]
    return np.array([[min(v + SHIFT, _HIGH) - SHIFT for v in row] for row in held], object)


def scatter(rows: DataFrame, column: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums by dimension, n^2 times the covariance) of the integer entries, exact.

    A task adds the products of its rows in one matrix and sends it once, each sum
    in three parts of 18 digits, which decimals add without loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for b in batches:
            y = _whole(b.column(0))
            y = np.concatenate([y, np.ones((len(y), 1), y.dtype)], 1)
            most = 1 if y.dtype == object else int(np.abs(y).max(initial=0)) ** 2
            step = max(1, _EXACT // max(1, most))
            for a in range(0, len(y), step):
                part = y[a : a + step]
                if y.dtype == object or most > _EXACT:
                    part = np.array([[int(v) for v in r] for r in part], object)
                    total += part.T.dot(part)
                else:
                    total += (part.T @ part).astype(np.int64).astype(object)
        i, j = np.triu_indices(d + 1)
        values = total[i, j].tolist()
        if values[-1]:
            low, mid = zip(*((v % _LIMB, v // _LIMB % _LIMB) for v in values), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(low, pa.int64()), pa.array(mid, pa.int64()), pa.array([v // _LIMB**2 for v in values], pa.int64())], ["i", "j", "low", "mid", "high"])

    parts = rows.select(column).mapInArrow(tk.tidy(run), "i int, j int, low long, mid long, high long")
    sums = parts.groupBy("i", "j").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("low", "mid", "high")))
    m = np.zeros((d + 1, d + 1), object)
    for r in sums.collect():  # (d + 1)(d + 2) / 2 rows
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = int(r["low"]) + int(r["mid"]) * _LIMB + int(r["high"]) * _LIMB**2
    n, s = m[d, d], m[d, :d]
    return n, [int(v) + SHIFT * n for v in s], n * m[:d, :d] - np.outer(s, s)


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, lowest power first: residues modulo each prime by tasks, then Chinese remainders."""
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    primes = primes_below(1 << 31, 2 * coefficient_bound(trace, d))
    sent = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])  # d * d integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_pylist()
            step = max(1, (4 << 20) // (d * d))
            for a in range(0, len(own), step):
                polys = residues(np.array(sent.value, object), own[a : a + step])
                yield pa.RecordBatch.from_arrays([pa.array(own[a : a + step]), pa.array(polys.tolist(), pa.list_(pa.int64()))], ["p", "residues"])

    slices = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(slices).mapInArrow(run, "p long, residues array<long>").collect()
    sent.unpersist()
    return combine([r["p"] for r in found], [r["residues"] for r in found])


def fit_whitening(rows: DataFrame, column: str = "embedding", components: int = 8) -> Whitening:
    """Fit on all rows of ``usable``; as many components as asked for, or as have a positive eigenvalue."""
    spark, first = rows.sparkSession, rows.select(F.size(column).alias("d")).head()
    if first is None:
        return Whitening(0, [], [], [], np.zeros((0, 0)))
    if first["d"] > MAX_DIMENSION:
        raise ValueError(f"vectors have {first['d']} dimensions, at most {MAX_DIMENSION} are taken")
    n, sums, matrix = scatter(rows, column, first["d"])
    content = math.gcd(*(int(v) for v in matrix.flat))
    if not content:
        return Whitening(n, sums, [], [], np.zeros((0, first["d"])))
    matrix = matrix // content
    trace = int(sum(matrix.diagonal()))
    roots, shift = top_roots(characteristic_polynomial(spark, matrix), trace, components)

    # one task for each distinct eigenvalue
    sent = spark.sparkContext.broadcast([[int(v) for v in row] for row in matrix])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, root, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                found = null_space(np.array(sent.value, object), int(root), shift, m)
                yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array(found.tolist(), pa.list_(pa.float64()))], ["k", "v"])

    table = spark.createDataFrame([(k, str(r), m) for k, (r, m) in enumerate(roots)], "k int, root string, m int")
    solved = table.repartition(len(roots)).mapInArrow(run, "k int, v array<double>").collect()
    sent.unpersist()
    solved.sort(key=lambda r: r["k"])
    solved = solved[:components]
    values = [Fraction(roots[r["k"]][0], 1 << shift) for r in solved]
    return Whitening(n, sums, [float(v * content / n**2) for v in values], [float(v / trace) for v in values], np.array([r["v"] for r in solved]))


def whiten(rows: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """All columns but the vector, plus ``deviation`` and ``whitened`` (which replace clashing names).

    ``deviation`` is the sum over dimensions of ``(n * x - S)^2``, exact, and null
    beyond 38 digits; ``whitened`` holds one value for each component.  One pass,
    no shuffle.
    """
    keep = [c for c in rows.columns if c not in (column, "deviation", "whitened")]
    n, d, k = model.n, len(model.sums), len(model.eigenvalues)
    centre = [s - n * SHIFT for s in model.sums]
    basis = model.components.T / np.sqrt(model.eigenvalues) if k else np.zeros((d, 0))
    within = _EXACT // max(1, 2 * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = _whole(b.column(len(keep)))
            if y.dtype == object or np.abs(y).max(initial=0) >= within or max(map(abs, centre), default=0) >= _EXACT // 2:
                off = np.array([[n * int(v) - c for v, c in zip(row, centre, strict=True)] for row in y], object).reshape(len(y), d)
            else:
                off = n * y.astype(np.int64) - np.array(centre, np.int64)
            most = int(np.abs(off).max(initial=0))
            square = (off if most * most * max(1, d) < _HIGH else off.astype(object)) ** 2
            sums = square.sum(1).tolist() if len(off) else []
            white = (off.astype(np.float64) / max(1, n)) @ basis
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(off) + 1) * k, pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([Decimal(int(v)) if v < 10**38 else None for v in sums], pa.decimal128(38, 0)), lists], [*keep, "deviation", "whitened"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)
    return rows.select(*keep, column).mapInArrow(tk.tidy(run), fields + "deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """Largest absolute entry of the covariance of whitened values (all rows, centred) minus the identity; 0 without rows or components.

    A task sends counts, means and centred products of its batches, which are
    then centred on the mean of all.
    """
    first = whitened.select(F.size(column).alias("k")).head()
    k = first["k"] if first else 0
    if k <= 0:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, product = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if len(w):
                own = w.mean(0)
                step, n = own - mean, n + len(w)
                mean = mean + step * (len(w) / n)
                product = product + (w - own).T @ (w - own) + np.outer(step, step) * ((n - len(w)) * len(w) / n)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([product.ravel().tolist()])], ["n", "mean", "product"])

    parts = written(whitened.select(column).mapInArrow(run, "n long, mean array<double>, product array<double>"), "moments")
    total = parts.agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col("mean")[i]).alias(f"m{i}") for i in range(k))).first()
    mean = [total[f"m{i}"] / total["n"] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = parts.agg(*(F.sum(F.col("product")[i * k + j] + F.col("n") * (F.col("mean")[i] - mean[i]) * (F.col("mean")[j] - mean[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    return max(abs(sums[f"p{i}_{j}"] / total["n"] - (i == j)) for i, j in pairs)


def whitened_components(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 8) -> DataFrame:
    """One row for each usable vector and component: the whole of ``whiten`` in long form, with the fit's figures."""
    rows = usable(vectors.select(key, column), column)
    model = fit_whitening(rows, column, components)
    white = written(whiten(rows, model, column), "whitened")
    error = identity_error(white)
    shares = F.array(*(F.lit(v) for v in model.explained)).cast("array<double>")
    long = white.select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
