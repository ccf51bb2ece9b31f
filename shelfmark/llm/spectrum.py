"""Exact eigenvalues of integer scatter matrices: polynomials by residues, roots by signs, components by inverse iteration.

A scatter matrix is symmetric and has no negative eigenvalue, so all roots of its
characteristic polynomial are real.  Descartes' rule is then exact: the roots
beyond ``a``, counted with multiplicity, are the sign changes in the coefficients
of ``p(t + a)``.  Everything here is of the size of the dimension, never of the
number of rows.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np

#: bits of a root below the trace's leading one
ROOT_BITS = 240
#: decimal digits in which components are solved for
DIGITS = 110


def primes_below(top: int, product_over: int) -> list[int]:
    """The largest primes under ``top`` (at most 2^31) whose product exceeds a bound."""
    out, product, n = [], 1, top - 1 - top % 2
    while product <= product_over:
        n -= 2
        if _is_prime(n):
            out.append(n)
            product *= n
    return out


def _is_prime(n: int) -> bool:
    """Exact for odd numbers from 9 to 3,215,031,751."""
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for a in (2, 3, 5, 7):
        x = pow(a, (n - 1) >> twos, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient exceeds it: the k-th is a sum over k-subsets of eigenvalues of one sum, largest when all are equal."""
    return max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))


def residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Characteristic polynomial modulo each prime, one row each, lowest power first.

    Each matrix of residues is brought to Hessenberg form by similarity (pivots are
    any nonzero entries), whose leading blocks have polynomials by recurrence.
    """
    p, d = np.array(primes, np.int64), len(matrix)
    h = np.array([[[int(v) % q for v in row] for row in matrix] for q in primes], np.int64).reshape(len(p), d, d)
    at, q1, q2 = np.arange(len(p)), p[:, None], p[:, None, None]
    for k in range(d - 2):
        below = h[:, k + 1 :, k] != 0
        pivot = k + 1 + below.argmax(1)
        rows = h[at, pivot].copy()
        h[at, pivot] = h[:, k + 1]
        h[:, k + 1] = rows
        columns = h[at, :, pivot].copy()
        h[at, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = columns
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, k + 1, k], primes, strict=True)], np.int64)
        m = h[:, k + 2 :, k] * inverse[:, None] % q1
        h[:, k + 2 :] = (h[:, k + 2 :] - m[:, :, None] * h[:, k + 1 : k + 2] % q2) % q2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * m[:, None, :] % q2).sum(2)) % q1
    polys = np.zeros((d + 1, len(p), d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(d):
        new = np.zeros_like(polys[0])
        new[:, 1:] = polys[k, :, :-1]
        new -= h[:, k, k, None] * polys[k] % q1
        chain = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[:, i + 1, i] % p
            new -= (h[:, i, k] * chain % p)[:, None] * polys[i] % q1
        polys[k + 1] = new % q1
    return polys[d]


def combine(primes: list[int], rows: list[list[int]]) -> list[int]:
    """Signed integers from their residues, by Chinese remainders."""
    values, modulus = [0] * len(rows[0]), 1
    for p, row in zip(primes, rows, strict=True):
        inverse = pow(modulus, -1, p)
        values = [v + modulus * ((int(r) - v) * inverse % p) for v, r in zip(values, row, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values]


def top_roots(poly: list[int], trace: int, k: int) -> tuple[list[tuple[int, int]], int]:
    """((root, multiplicity), ...) from the largest on, until k roots or all positive ones are covered, and the shift s: a root is ``root / 2^s``.

    ``poly`` is monic, lowest power first, with real roots of 0 and more.  Roots
    that agree to ``ROOT_BITS`` bits of the trace count as one.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d, s = len(poly) - 1, max(0, ROOT_BITS - trace.bit_length())
    scaled = [c << (s * (d - i)) for i, c in enumerate(poly)]

    def beyond(a: int) -> int:
        c = scaled.copy()
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += a * c[j + 1]
        signs = [v > 0 for v in c if v]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def sign(a: int) -> int:
        v = 0
        for c in reversed(scaled):
            v = v * a + c
        return (v > 0) - (v < 0)

    out: list[tuple[int, int]] = []
    # roots lie in (low, high], ``above`` of them beyond high and ``upto`` of them beyond low
    todo = [(0, (trace << s) + 1, 0, d)]
    while todo and sum(m for _, m in out) < k:
        low, high, above, upto = todo.pop()
        if upto == above:
            continue
        if upto - above == 1:
            right = sign(high)
            while right and high - low > 1:
                mid = (low + high) // 2
                here = sign(mid)
                low, high = (low, mid) if here in (0, right) else (mid, high)
                right = here if high == mid else right
        if high - low <= 1 or upto - above == 1:
            out.append((high, upto - above))
            continue
        mid = (low + high) // 2
        n = beyond(mid)
        todo += [(low, mid, n, upto), (mid, high, above, n)]
    return out, s


def null_space(matrix: np.ndarray, root: int, shift: int, multiplicity: int) -> np.ndarray:
    """Orthonormal vectors that the matrix maps to ``root / 2^shift`` times themselves, as doubles.

    Inverse iteration with one elimination of ``matrix - root`` in ``DIGITS``
    digits: what is not in the null space shrinks by the root's error over the
    distance of the next root, each time.
    """
    d = len(matrix)
    with localcontext() as c:
        c.prec = DIGITS
        value = Decimal(root) / (1 << shift)
        m = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        m[np.arange(d), np.arange(d)] -= value
        least = (abs(value) + 1) * Decimal(10) ** (20 - DIGITS)
        order = []
        for k in range(d):
            p = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
            order.append(p)
            m[[k, p]] = m[[p, k]]
            if abs(m[k, k]) < least:
                m[k, k] = least
            m[k + 1 :, k] /= m[k, k]
            m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
        state, vectors = 12345, []
        for _ in range(multiplicity):
            start = []
            for _ in range(d):
                state = state * 6364136223846793005 % (1 << 64) + 1442695040888963407
                start.append(Decimal(state % (1 << 32)) / (1 << 32) - Decimal("0.5"))
            vectors.append(np.array(start, object))
        for _ in range(3):
            done: list[np.ndarray] = []
            for v in vectors:
                b = v.copy()
                for k, p in enumerate(order):
                    b[[k, p]] = b[[p, k]]
                for k in range(d):
                    b[k + 1 :] -= m[k + 1 :, k] * b[k]
                for k in range(d - 1, -1, -1):
                    b[k] /= m[k, k]
                    b[:k] -= m[:k, k] * b[k]
                b /= max(abs(x) for x in b)
                for _ in range(2):
                    for u in done:
                        b = b - u * (u * b).sum()
                done.append(b / (b * b).sum().sqrt())
            vectors = done
        return np.array(vectors, float)
