"""Spelling variants, byte-level BPE and whitening against plain versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("shelfmark.llm")
public_tokenizers = pytest.importorskip("public_tokenizers")

from shelfmark.llm import bytebpe, spectrum, spelling, whiten  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHA = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants


def is_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(counts: dict[str, int]) -> dict[str, tuple]:
    form, near = {}, {w: [o for o in counts if o != w and abs(len(o) - len(w)) < 2 and is_near(w, o)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def plain_counts(rows) -> dict[str, int]:
    counts: collections.Counter = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(ALPHA)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


@pytest.mark.parametrize(("q_max", "extend_over", "letters"), [(3, 500, "abcd"), (3, 3, "ab"), (4, 2, "abc"), (6, 0, "ab"), (5, 1, "abé")])
def test_all_near_words_are_found_by_any_dictionary(spark, q_max, extend_over, letters):
    r = random.Random(q_max * 100 + extend_over)
    counts = {"".join(r.choice(letters) for _ in range(r.randrange(7, 11))): r.choice([2, 3, 25, 300]) for _ in range(250)}
    for w in list(counts)[:120]:
        k = r.randrange(len(w))
        for other in (w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]):
            if len(other) >= 7:
                counts.setdefault(other, r.choice([2, 30, 4000]))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(df, q_max=q_max, extend_over=extend_over).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_forms(counts)
    assert len(got) == len(counts)
    if q_max == 6:  # all grams of some words are open to one edit: found by halves
        index = spelling.Grams(spelling.gram_dictionary(df, q_max=q_max, extend_over=extend_over), 2, q_max)
        assert any(index.open(w) for w in counts)


def test_bound_holds_for_every_edit():
    r = random.Random(5)
    corpus = ["".join(r.choice("abc") for _ in range(r.randrange(7, 12))) for _ in range(300)]
    grams: collections.Counter = collections.Counter(w[i : i + q] for w in corpus for q in (2, 3, 4) for i in range(len(w) - q + 1))
    grams = {g: n for g, n in grams.items() if len(g) == 2 or (grams[g[:2]] > 40 and grams[g[:-1]] > 40)}
    index = spelling.Grams(grams, 2, 4)
    positional = lambda w: [w[p:e] for p, e in index.decompose(w)]
    known = lambda w: all(w[i : i + 2] in grams for i in range(len(w) - 1))
    for w in corpus:
        own = positional(w)
        bound = index.bound(w, index.decompose(w))
        for k in range(len(w) + 1):
            for other in {w[:k] + w[k + 1 :]} | {w[:k] + c + w[k:] for c in "abc"} | {w[:k] + c + w[k + 1 :] for c in "abc"}:
                if known(other):
                    shared = sum((collections.Counter(own) & collections.Counter(positional(other))).values())
                    assert shared >= len(own) - bound


def test_words_of_texts_and_odd_rows(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdeÀé×") for _ in range(r.randrange(5, 12))) for _ in range(40)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(60)) + " Übermäßig, ÜBERmäßig-straße x1abcdefgh") for i in range(60)]
    rows += [(60, None), (61, ""), (62, "  \n "), (None, "abcdefg abcdefg"), (5, rows[5][1]), (63, "verylongword" * 3000), (64, "verylongword" * 3000)]
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, word string, n int")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs).collect()}
    assert got == plain_forms(plain_counts(rows))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bytebpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


def plain_ids(ranks: dict[bytes, int], text: str) -> list[int]:
    """Each match by itself: merge the pair of lowest rank, leftmost first, until none is known."""
    out = []
    for m in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in m.encode()]
        while True:
            known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not known:
                break
            i = min(known)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_ids_against_plain_merges_and_bytes_come_back(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    texts = ["", "Hello there, it's 2024!", "a" * 70, "  two  spaces \n\n\t tab", "naïve Ünïcode 中文字 😀 ١٢٣", "<|endoftext|> is ordinary", "I'll we've don't 'S", "  　x\x00\x1cy", "word " * 200 + "12345" * 20]
    rows = [*enumerate(texts), (100, None), (3, texts[3]), (None, "x")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, n_tokens string")
    sent = bytebpe.rank_file(spark, RANKS, public_tokenizers.PATTERN)
    out = bytebpe.decode_ids(bytebpe.encode_texts(docs, sent), sent).collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain_ids(ranks, r["text"] or "")
        assert r["token_ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        raw = (r["text"] or "").encode()
        assert bytes(r["decoded"]) == raw and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
    assert bytebpe.encode_texts(docs.limit(0), sent).count() == 0
    assert bytebpe.decode_ids(docs.limit(0).withColumn("token_ids", F.array(F.lit(1))), sent).count() == 0


def test_long_texts_are_cut_without_a_change(codec, monkeypatch):
    r = random.Random(3)
    parts = [" ", "  ", "\n", "a", "B", "'s", "'", "1", "é", "中", "!", "\t", "　", "\x1c", "ʼ", "٣", "́", "😀", "          "]
    monkeypatch.setattr(bytebpe, "LONG_CHARS", 16)
    monkeypatch.setattr(bytebpe, "LONG_SPACE", 5)
    monkeypatch.setattr(bytebpe, "_SPACES", regex.compile(r"\p{White_Space}{5,}"))
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(90)))
        assert "".join(p for p, _ in bytebpe.cut(t, 16)) == t
        assert codec.encode(t) == codec.encoding.encode_ordinary(t)


def test_runs_that_the_library_cannot_match(codec):
    for t in (" " * 400_000 + "x", "y" + "\n" * 10 + " " * 400_000, "ab" * 300_000, "word " * 100_000):
        ids = codec.encode(t)
        assert codec.decode(np.array(ids)) == t.encode()
    assert codec.encode(" " * 400_000 + "x")[-1] == codec.encoding.encode_ordinary(" x")[0]


def test_decoding_of_cut_characters_and_unknown_ids(spark):
    sent = bytebpe.rank_file(spark, RANKS, public_tokenizers.PATTERN)
    ids = bytebpe.codec(sent).encode("中")
    rows = spark.createDataFrame([(1, ids[:1]), (2, None), (3, []), (4, [ids[0], None])], "i int, token_ids array<int>")
    got = {r["i"]: r["decoded"] for r in bytebpe.decode_ids(rows, sent).collect()}
    assert bytes(got[1]) == bytes(got[4]) == bytebpe.codec(sent).decode(np.array(ids[:1])) and got[2] is None and bytes(got[3]) == b""
    with pytest.raises(ValueError, match="not in the rank file"):
        bytebpe.codec(sent).decode(np.array([50256]))


# --- whitening


def plain_whitening(rows, k):
    xs = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[j] for x in xs) for j in range(d)]
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for x in xs]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in xs])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return deviation, values[order], vectors[:, order], centred, values.sum()


def test_polynomial_roots_and_components_against_plain_ones():
    r = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        x = r.integers(-50, 50, (d + 3, d)).astype(object)
        a = x.T.dot(x)
        trace = int(sum(a.diagonal()))
        primes = spectrum.primes_below(1 << 31, 2 * spectrum.coefficient_bound(trace, d))
        poly = spectrum.combine(primes, spectrum.residues(a, primes).tolist())
        # Faddeev-LeVerrier in exact fractions
        m, want = np.array([[Fraction(0)] * d for _ in range(d)], object), [Fraction(1)]
        for k in range(1, d + 1):
            m = a.dot(m) + np.eye(d, dtype=object) * want[-1]
            want.append(-Fraction(sum(a.dot(m).diagonal())) / k)
        assert poly == [int(c) for c in reversed(want)]
        roots, shift = spectrum.top_roots(poly, trace, d)
        assert np.allclose([v / 2**shift for v, times in roots for _ in range(times)], np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-9)


def test_repeated_and_zero_eigenvalues():
    a = np.diag([5, 5, 5, 2, 0, 0]).astype(object)
    poly = spectrum.combine(p := spectrum.primes_below(1 << 31, 1 << 40), spectrum.residues(a, p).tolist())
    roots, shift = spectrum.top_roots(poly, 17, 6)
    assert [(round(v / 2**shift, 12), m) for v, m in roots] == [(5.0, 3), (2.0, 1)]
    space = spectrum.null_space(a, roots[0][0], shift, 3)
    assert np.allclose(space @ space.T, np.eye(3), atol=1e-15) and np.allclose(space @ a.astype(float), 5 * space, atol=1e-14)


def close_roots() -> np.ndarray:
    """Two eigenvalues that differ by 2 in 10^14: doubles mix their components."""
    q = np.array([[3, 4], [-4, 3]], object)
    return q.T.dot(np.diag([10**14, 10**14 - 2]).astype(object)).dot(q)


def test_components_of_close_eigenvalues_are_not_mixed():
    a = close_roots()
    trace = int(sum(a.diagonal()))
    p = spectrum.primes_below(1 << 31, 2 * spectrum.coefficient_bound(trace, 2))
    roots, shift = spectrum.top_roots(spectrum.combine(p, spectrum.residues(a, p).tolist()), trace, 2)
    first = spectrum.null_space(a, roots[0][0], shift, 1)[0]
    assert np.allclose(np.abs(first), [0.6, 0.8], atol=1e-15)


def test_whitening_against_plain_covariance(spark):
    r = np.random.default_rng(7)
    mixed = r.normal(size=(200, 6)) @ r.normal(size=(6, 6)) * 0.2
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)] + [(3, [0.5] * 6), (3, [0.5] * 6), (None, [0.25] * 6)]
    bad = [(900, None), (901, [0.1, None, 0.2, 0.3, 0.4, 0.5]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, []), (905, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<float>, n string, whitened int")
    out = whiten.whitened_components(vectors, components=4).collect()
    deviation, values, basis, centred, trace = plain_whitening([v for _, v in good], 4)
    assert len(out) == 4 * len(good) and {r["n"] for r in out} == {len(good)}
    assert collections.Counter(r["vec_id"] for r in out) == collections.Counter(i for i, _ in good for _ in range(4))
    white = centred @ basis / np.sqrt(values)
    for k in range(4):
        own = {r["vec_id"]: r for r in out if r["component"] == k + 1}
        got = np.array([own[i]["whitened"] for i in range(3)])
        sign = np.sign(got[0] * white[0, k])
        assert np.allclose(got, sign * white[:3, k], rtol=1e-8, atol=1e-10)
        assert all(abs(own[i]["explained"] - values[k] / trace) < 1e-9 for i in range(3))
        assert all(own[i]["deviation"] == deviation[i] == int(own[i]["deviation_exact"]) for i in range(3))
    assert out[0]["identity_error"] < 1e-9


def test_vectors_without_whitening(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten.whitened_components(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whitened_components(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    assert whiten.whitened_components(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whiten.whitened_components(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).count() == 0
    line = whiten.whitened_components(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], schema)).collect()
    assert len(line) == 5 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_huge_entries_stay_exact(spark):
    rows = [(i, [3.0e38 if i == 0 else 1e9 * i, float(i)]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, sums, matrix = whiten.scatter(whiten.usable(vectors), "embedding", 2)
    hold = lambda v: min(max(v, -(1 << 63)), (1 << 63) - 1)
    xs = [[hold(hold(int(np.floor(1024 * c))) + 100_000) for c in v] for _, v in rows]
    assert n == 6 and sums == [sum(x[j] for x in xs) for j in range(2)]
    assert matrix[0, 1] == n * sum(a * b for a, b in xs) - sums[0] * sums[1] and matrix[0, 0] == n * sum(a * a for a, _ in xs) - sums[0] ** 2
    out = whiten.whitened_components(vectors).collect()
    assert len(out) == 12 and out[0]["identity_error"] < 1e-4
