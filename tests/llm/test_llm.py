"""Corpus operators against brute force on small, awkward tables."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import os
import random
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("shelfmark.llm")

from shelfmark.llm import decontam, licenses, lm, neardup, pieces, quality, repeats, sharding, textkit, toxicity, warc  # noqa: E402
from shelfmark.llm.licenses import scan_licenses  # noqa: E402
from shelfmark.llm.quality import clean_lines  # noqa: E402
from shelfmark.llm.toxicity import score_toxicity, train_toxicity  # noqa: E402

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, n_words int, size string, kept string"
spaced = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
low = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))


def words(seed, n, vocab=60):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    a, b = " ".join(words(1, 150, 900)), " ".join(words(2, 90, 900))
    near = a.split(" ")
    near[70] = "changed"
    passage = " ".join(words(3, 30, 900))
    out = [
        (0, a), (1, a), (2, " ".join(near)), (3, b + "\n" + passage), (4, passage + " end"), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "ONE two"), (10, "one two three four five"),
        (11, "a b c d e f " * 30), (12, "x" * 3000), (13, "Ünïcode ▁ mark  two  spaces\r\nnew line K"), (14, f"intro {passage} {a}"), (15, "\n".join(["same line of words here"] * 6)),
        (16, "Licensed under the Apache License, Version 2.0. and CC BY-NC 4.0"), (17, "Under the MIT License! under the mit license"), (18, "#*$%&|<> ## ok"), (19, "home | about | contact | help | terms\nA real sentence stands here, with enough words to stay in the text.")
    ]
    for i in range(40):
        edited = a.split(" ")
        for k in range(i % 9):
            edited[(17 * i + 13 * k) % 150] = f"e{i}_{k}"
        out.append((100 + i, " ".join(edited)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y") for i, t in texts()], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def repeated(spark, docs):
    """With repeated rows and a null id."""
    return docs.unionByName(docs.where("doc_id in (0, 8, 16)")).unionByName(spark.createDataFrame([(None, "one two three", None, None, None, None)], DOCS))


def test_words_and_ngrams_of_a_slice():
    column = pa.array([t for _, t in texts()])
    for s in textkit.slices(column, limit=4000):
        for d in range(s.n_docs):
            a, z = s.word_offsets[d], s.word_offsets[d + 1]
            assert [s.word(i).decode() for i in range(a, z)] == spaced(column[s.first + d].as_py())
    seen = {}
    for s in textkit.slices(column):
        h = textkit.ngram_hashes(s.word_hashes(), 7)
        for i in textkit.windows_inside(s.word_offsets, 7):
            gram = tuple(s.word(j) for j in range(i, i + 7))
            assert seen.setdefault(gram, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabÄ字", max_size=30)), max_size=6))
def test_words_of_any_texts(values):
    got = [[s.word(i).decode() for i in range(s.word_offsets[d], s.word_offsets[d + 1])] for s in textkit.slices(pa.array(values, pa.string())) for d in range(s.n_docs)]
    assert got == [spaced(t) for t in values]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = spaced(low(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                top[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_duplicates(spark, docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_components(texts())
    assert neardup.near_duplicates(none).count() == 0
    again = [(r.doc_id, r.component_id) for r in neardup.near_duplicates(repeated(spark, docs)).collect()]
    assert len(again) == len(texts()) + 4 and (None, None) in again


def test_a_large_group_of_near_copies_loses_no_link(spark):
    """1,200 copies of one text, each with its own changes: components equal those of all pairs."""
    r, base = random.Random(7), words(9, 150, 5000)
    rows = []
    for i in range(1200):
        w = list(base)
        for _ in range(r.randrange(1, 12)):
            w[r.randrange(len(w))] = f"own{i}_{r.randrange(99)}" if r.random() < 0.9 else r.choice(["alpha", "beta"])
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    column = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((len(rows), len(column)), np.float32)
    for i, one in enumerate(sets):
        x[i, [column[g] for g in one]] = 1
    shared = np.rint(x @ x.T)
    n = x.sum(1)
    linked = 100 * shared >= 75 * (n[:, None] + n[None, :] - shared)
    label = np.arange(len(rows))
    while True:
        new = np.where(linked, label[None, :], len(rows)).min(1)
        if (new == label).all():
            break
        label = new
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == label.tolist() and 50 < len(set(label.tolist())) < 1150


def test_registers_are_mergeable_and_estimates_close():
    h = textkit.mix64(np.arange(1, 3001, dtype=np.uint64))
    a, b = h[:2000], h[500:2500]
    ra, rb, ru = (neardup.registers(x, np.array([0, len(x)])) for x in (a, b, np.union1d(a, b)))
    assert (np.maximum(ra, rb) == ru).all()
    j = neardup.estimate(ra, rb, np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 1500 / 2500) < 0.15


def test_shards(spark, docs, none):
    rows = sharding.assign_shards(repeated(spark, docs), rows_per_run=5).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = dict(texts())
    assert all((r.size, r.text_crc32) == (len((want[r.doc_id] or "").encode()) + 1, zlib.crc32((want[r.doc_id] or "").encode())) for r in rows if r.doc_id is not None)
    assert sharding.assign_shards(none).count() == 0


def test_draws_against_plain_ones_and_shares_near_weights(spark):
    """Every level's weighted draw computed by hand; shares of shards near their weights."""
    import xxhash

    def plain(key, node):
        if not node.children:
            return node.shard
        def draw(c):
            first = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            return -math.log(((xxhash.xxh64_intdigest(c.name.encode(), first) >> 11) + 0.5) / 2.0**53) / c.weight
        return plain(key, min(node.children, key=draw))

    tree = sharding.grown(sharding.topology(), 8, 3.0)
    got = {r.id: r.s for r in spark.range(-500, 20_000).select("id", sharding.place(F.col("id"), tree).alias("s")).collect()}
    assert all(got[i] == plain(i, tree) for i in range(-500, 2000))
    share = collections.Counter(got.values())
    assert abs(share[8] / len(got) - 3 / 11) < 0.02 and all(abs(share[i] / len(got) - 1 / 11) < 0.01 for i in range(8))
    with pytest.raises(ValueError, match="weight"):
        sharding.place(F.lit(1), sharding.Node("root", (sharding.Node("a", shard=0, own_weight=0.0),)))


def test_weights_move_rows_only_into_the_grown_subtree(spark):

    tree = sharding.topology()
    heavy = sharding.Node("root", (sharding.Node("r0", (*tree.children[0].children, sharding.Node("r0/k2", (sharding.Node("r0/k2/s0", shard=8),)))), tree.children[1]))
    df = spark.range(5000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavy).alias("b")).groupBy("a", "b").count().collect()
    assert all(r.b not in (4, 5, 6, 7) or r.a == r.b for r in df)  # nothing moves into the other region


def test_repeats(spark, docs, none):
    seen, want = set(), {}
    for i, t in texts():
        w, dead = spaced(t), set()
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            dead.update(range(j, j + 20) if x in seen else ())
            seen.add(x)
        want[i] = (len(w), len(dead), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in dead).encode()).hexdigest())
    for size in (1 << 22, 2000):  # one bucket and many
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs, bucket_bytes=size).collect()}
        assert got == want
    kept = {r.doc_id: (r.kept_text, r.lang) for r in repeats.remove_repeats(docs, carry=("lang",)).collect()}
    assert kept[13] == (dict(texts())[13], "en") and kept[5] == (None, "en")
    assert repeats.remove_repeats(none).count() == 0
    assert repeats.remove_repeats(repeated(spark, docs)).count() == len(texts()) + 4


def test_automata_decide_what_is_removed(monkeypatch):
    """Phrases are located wherever their words stand, by several automata too; without located phrases nothing goes."""
    rows = [None, "", "a b", "a b c d e", "x a  b\tc\nd e f a b c d e", "é b c d e " * 9, "aa b c d e", "a b c d ee"]
    phrases = ["a b c d e", "b c d e f", "é b c d e", "d e é b c"]
    want = [[j for j in range(len(spaced(t)) - 4) if " ".join(spaced(t)[j : j + 5]) in phrases] for t in rows]
    for size in (50_000, 1):
        monkeypatch.setattr(repeats, "AUTOMATON_PHRASES", size)
        assert [x.tolist() for x in repeats._locate(pa.array(rows), [p.encode() for p in phrases])] == want
    text = " ".join(f"w{i}" for i in range(25))
    docs = pa.table({"bucket": pa.array([0, 0], pa.int32()), "doc_id": [1, 2], "text": [text, text]})
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    spelled = repeats._spell(20)(docs, pa.table({"h": np.concatenate([repeats._anchored(s, 20)[1] for s in textkit.slices(docs["text"].chunk(0))]).view(np.int64)}))
    assert set(spelled["n"].to_pylist()) == {2}
    for phrases, removed in ((spelled, [0, 25]), (spelled.slice(0, 0), [0, 0])):
        found = repeats._candidates(20)(docs, phrases)
        later = found.filter(pa.compute.is_valid(found["places"]))  # equal windows of one bucket are judged in it
        assert repeats._remove(20, out, True)(docs, later)["n_removed"].to_pylist() == removed


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_pieces(spark, docs, none):
    out = {r.doc_id: r for r in pieces.encode_pieces(docs, MODEL).collect()}
    m = pieces.PieceModel(MODEL)
    for i, t in texts():
        r = out[i]
        if t is None:
            assert r.piece_ids is None and r.round_trip is None
            continue
        assert r.round_trip and m.decode(r.piece_ids) == t and r.n_pieces == len(r.piece_ids)
        best = [0.0]
        for u in m.units(t):
            if len(u) < 200:
                best = sorted((p + s for p in best for s, _ in m.n_best(u, 4)), reverse=True)[:4]
        if t and max(map(len, m.units(t))) < 200:
            assert np.allclose(best, r.n_best_scores)
    assert pieces.encode_pieces(none, MODEL).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_decoding(spark, docs, none):
    """Decoding turns ids back into the texts, and agrees with the library's decoder on its own ids."""
    import sentencepiece

    ids = pieces.encode_pieces(docs, MODEL).select("doc_id", "piece_ids", F.lit(1).alias("text"))
    got = sorted((r.doc_id, r.text) for r in pieces.decode_pieces(ids, MODEL).collect())
    assert got == sorted(texts())
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in ("two words", "Ünïcode 字 text", "a  b"):
        assert pieces.piece_model(MODEL).decode(sp.encode(t)) == sp.decode(sp.encode(t)) == t
    odd = spark.createDataFrame([(1, []), (2, [1, 2]), (3, None)], "k int, piece_ids array<int>")
    assert {r.k: r.text for r in pieces.decode_pieces(odd, MODEL).collect()} == {1: "", 2: "", 3: None}
    assert pieces.decode_pieces(pieces.encode_pieces(none, MODEL), MODEL).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_a_long_text_without_spaces_takes_memory_in_proportion():
    """In a process of its own: 1 MB of letters without a space, under 1 GB at the peak."""
    code = f"""
import random, resource
from shelfmark.llm import pieces
r = random.Random(1)
t = "".join(r.choice("abcdeéfghijk字lmnopqrstuvwxyz") for _ in range(400_000))
row = pieces._encode(pieces.piece_model({MODEL!r}), [t], 3, False)[0]
assert row[-1] and len(row[3]) == 3 and row[3][0] >= row[3][1] >= row[3][2]
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 500_000
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ, timeout=300)


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
@pytest.mark.parametrize("long", [1, 256])
def test_long_units_are_worked_on_as_short_ones(monkeypatch, long):
    m = pieces.piece_model(MODEL)
    units = [u for _, t in texts() for u in m.units(t or "") if len(u) < 200]
    want = m.viterbi(units)
    monkeypatch.setattr(pieces, "LONG", long)
    got = m.viterbi(units)
    assert np.allclose(want[0], got[0]) and np.allclose(want[1], got[1])
    for i in range(len(units)):
        assert (want[2][want[3][i] :][: want[4][i]] == got[2][got[3][i] :][: got[4][i]]).all()


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="▁ abthe\n字é", min_size=1, max_size=9))
def test_best_segmentations_against_all_of_them(text):
    m = test_best_segmentations_against_all_of_them.__dict__.setdefault("m", None) or pieces.PieceModel(MODEL)
    test_best_segmentations_against_all_of_them.m = m

    def every(u, i):
        if i == len(u):
            yield 0.0
        for j in range(i + 1, len(u) + 1):
            s = m.edge(u, i, j)
            if s is not None:
                yield from (s + x for x in every(u, j))

    for u in m.units(text):
        want = sorted(every(u, 0), reverse=True)
        assert np.allclose([s for s, _ in m.n_best(u, 3)], want[:3])
        best, loss, flat, starts, counts = m.viterbi([u])
        assert math.isclose(best[0], want[0]) and (len(want) == 1 or math.isclose(loss[0], want[0] - want[1], abs_tol=1e-9))
    assert pieces._encode(m, [text], 3, True)[0][-1]


def test_archives(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b/\r\nX: y", "é" * 5000), (4, "u", None), (5, "u", ""), (6, "u", "<p>x</p>"), (6, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect())
    dig = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"": 4, "<p>x</p>": 1, "é" * 5000: 2}
    assert got == sorted((i, len((h or "").encode()), dig(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert warc.archive_round_trip(pages.where("page_id < 0")).count() == 0
    assert {r.record_type for r in warc.archive_round_trip(pages, revisit_from=9).where("page_id in (1, 3)").collect()} == {"response"}


def test_archive_reader_takes_a_dictionary_and_refuses_damage():
    good = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>"), ("WARC-Date", warc.DATE)], b"abc\r\n\r\nx")
    samples = [good * 3 + bytes([i]) * 200 for i in range(200)]
    own = zstandard.train_dictionary(4096, samples)
    for lead, packer in ((warc.dictionary_frame(own.as_bytes()), zstandard.ZstdCompressor(dict_data=own)), (struct.pack("<II", warc.SKIPPABLE, len(own.as_bytes())) + own.as_bytes(), zstandard.ZstdCompressor(dict_data=own)), (b"", zstandard.ZstdCompressor())):
        data = lead + packer.compress(good) + packer.compress(good)
        assert [body for _, body in warc.read_archive(data)] == [b"abc\r\n\r\nx"] * 2
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(data[:-3]))
    for bad in (good.replace(b"Length: 8", b"Length: 7"), good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date: ", b"Other: "), good.replace(b"Length: 8", b"Length: x")):
        with pytest.raises(ValueError):
            list(warc.read_archive(zstandard.ZstdCompressor().compress(bad)))


def test_language_model(spark, docs, none):
    rows = texts()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter()
    ctx = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for i, t in rows:
        if not held(i):
            count.update([*spaced(low(t)), None])
            raw = b"\xff" * 3 + low(t).encode() + b"\xff"
            for j in range(3, len(raw)):
                for k in range(4):
                    ctx[k][raw[j - k : j]][raw[j]] += 1
    n, v = sum(count.values()), len(count)

    def ppm(t):
        raw, total = b"\xff" * 3 + low(t).encode() + b"\xff", 0.0
        for j in range(3, len(raw)):
            p, gone = 1.0, set()
            for k in (3, 2, 1, 0):
                free = {s: c for s, c in ctx[k].get(raw[j - k : j], {}).items() if s not in gone}
                if not free:
                    continue
                whole = sum(free.values()) + len(free)
                if raw[j] in free:
                    p *= free[raw[j]] / whole
                    break
                p, gone = p * len(free) / whole, gone | set(free)
            else:
                p /= 256 - len(gone)
            total += math.log10(p)
        return total

    for frequent in (1 << 18, 4):  # all words looked up, and most joined
        for r in lm.score_corpus(docs, frequent=frequent).collect():
            t = dict(rows)[r.doc_id]
            toks = [*spaced(low(t)), None]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(toks), sum(count[x] > 0 for x in toks), n)
            assert math.isclose(r.base_score, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks), rel_tol=1e-9)
            assert math.isclose(r.score, ppm(t), rel_tol=1e-5)
    assert lm.score_corpus(none).count() == 0
    twice = lm.score_corpus(repeated(spark, docs), frequent=4).where("doc_id = 0").collect()
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize("order", [2, 3])
def test_the_order_is_kept_where_the_table_would_be_too_large(spark, docs, order):
    """Scores do not depend on how many contexts are broadcast and how many joined."""
    both = repeated(spark, docs)
    scores = lambda cells: sorted((r.doc_id is not None, r.doc_id or 0, r.score) for r in lm.score_corpus(both, order=order, max_cells=cells).collect())
    want = scores(24_000_000)
    for cells in (10, 9_000):
        got = scores(cells)
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert all(math.isclose(g[2], w[2], rel_tol=1e-5) for g, w in zip(got, want, strict=True))


def test_licenses(spark, docs, none):
    phrases = [("under the mit license".split(), "mit"), ("apache license version 2".split(), "apache-2"), ("cc by nc".split(), "cc-by-nc")]
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, t in texts():
        w = alnum(t)
        at = [(j, name) for j in range(len(w)) for p, name in phrases if w[j : j + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({n for _, n in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert scan_licenses(none).count() == 0
    broken = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to ANY person obtaining one copy of this software and associated documentation files")], "doc_id long, text string")
    assert scan_licenses(broken).first()["labels"] == "mit"  # one word of 18 differs
    half = spark.createDataFrame([(1, "Permission is hereby granted, free of charge, to nobody")], "doc_id long, text string")
    assert scan_licenses(half).first()["labels"] == ""
    extra = spark.createDataFrame([(1, "this work is licensed under the (new) gnu general public license version 3")], "doc_id long, text string")
    assert scan_licenses(extra).first()["labels"] == "gpl-3"
    assert [r.n_base for r in scan_licenses(repeated(spark, docs)).where("doc_id = 16").collect()] == [2, 2]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_labels(text, k=3):
    """Labels and similarities of verified spans, by dictionaries and loops."""
    w, out = alnum(text), []
    for phrase, label in [*licenses.BASE_PHRASES, *licenses.STATEMENTS]:
        t = phrase.split()
        votes = [(p, q) for p in range(len(w) - k + 1) for q in range(len(t) - k + 1) if w[p : p + k] == t[q : q + k]]
        spans, last = [], None
        for d in sorted({p - q for p, q in votes}):
            if last is None or d - last > 2:
                spans.append([])
            spans[-1] += [v for v in votes if v[0] - v[1] == d]
            last = d
        for span in spans:
            if len({q for _, q in span}) < 0.5 * (len(t) - k + 1):
                continue
            seen = {p + j: t[q + j] for p, q in span for j in range(k)}
            places = range(min(p for p, _ in span), max(p for p, _ in span) + k)
            similarity = 1 - edits([seen.get(p) for p in places], t) / len(t)
            if similarity >= 0.8:
                out.append((label, similarity))
    return out


def test_license_spans_against_plain_voting(spark):
    """Statements with words lost, added and swapped, twice in a text, and templates that repeat a k-gram."""
    r, rows = random.Random(11), []
    for i in range(80):
        parts = []
        for phrase, _ in r.sample([*licenses.BASE_PHRASES, *licenses.STATEMENTS], r.randrange(1, 4)):
            w = phrase.split()
            for _ in range(r.randrange(3)):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = [r.choice(["new", w[k], "and"])] * r.randrange(3)
            parts += [*words(i, r.randrange(4)), *w]
        rows.append((i, " ".join(parts)))
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = plain_labels(t)
        assert set(filter(None, got[i].labels.split(","))) - set(filter(None, got[i].base_labels.split(","))) <= {x for x, _ in want} <= set(got[i].labels.split(",")) | {""}
        assert got[i].n_spans == len(want) and (got[i].n_base or math.isclose(got[i].score, max([0.0, *(s for _, s in want)])))
    twice = spark.createDataFrame([(1, "x under the same terms under the same terms as y")], "doc_id long, text string")
    assert scan_licenses(twice, statements=[("under the same terms under the same terms as", "own")]).first()["labels"] == "own"


def plain_rules(text):
    """Rule that each line breaks, in order, and words left."""
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    short = [len(spaced(x)) <= 6 and spaced(x)[-1][-1] not in quality.CLOSING for x in lines]
    broken, left, seen = [], 0, set()
    for i, x in enumerate(lines):
        n = len(spaced(x))
        if len(re.findall(r"[#*$%&|<>]", x)) > 0.1 * len(x):
            rule = "symbols"
        elif len(re.findall(r"[|»•]", x)) > 2:
            rule = "bars"
        elif n < 20 and any(p in x.lower() for p in quality.BOILERPLATE):
            rule = "furniture"
        elif n < 5 and re.search(quality.BULLET, x):
            rule = "bullet"
        elif any(0 <= a and a + 3 <= len(lines) and all(short[a : a + 3]) for a in (i - 2, i - 1, i)):
            rule = "menu"
        elif n >= 20 and re.search(quality.SENTENCE, text) and not re.search(quality.SENTENCE, x):
            rule = "unpunctuated"
        else:
            rule = None
            left += n * (x not in seen)
            seen.add(x)
        broken.append(rule)
    return broken, left


def test_line_rules_against_plain_ones(spark, docs, none):
    menu = "\n".join(["Home", "About us", "Contact", "Our shop", "Jobs"])
    more = [
        (200, menu + "\nA sentence of ten words stands here to be kept."), (201, menu), (202, "- one\n- two words\n1. three\n* a longer entry that has some words.\n" + "Some text here. " * 6), (203, " ".join(words(4, 30, 900))), (207, " ".join(words(4, 30, 900)) + "\nEnd."),
        (204, "Please enable JavaScript to go on\n" + " ".join(words(5, 25, 900)) + "."), (205, "a | b | c | d\n" + " ".join(words(6, 25, 900)) + "。"), (206, "tab\tbetween\tthe words of this line.\ntab between the words of this line.\n" + " ".join(words(7, 12, 900)) + "!"),
    ]
    rows = [*texts(), *more, (0, texts()[0][1]), (None, "A row without an id, but with enough words to be kept by all.")]
    out = clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in rows:
        broken, left = plain_rules(t)
        r = by[i]
        assert [r[f"n_{x}_lines"] for x in quality.RULES] == [broken.count(x) for x in quality.RULES]
        assert r.kept == (not r.base_failed and left >= 0.5 * r.n_words)
    assert by[203].kept and not by[207].kept and not by[201].kept and by[200].n_menu_lines == 5 and by[202].n_bullet_lines == 3 and by[206].n_dup_lines == 0 and by[None].kept


def test_quality(spark, docs, none):
    got = {r.doc_id: r for r in clean_lines(docs).collect()}
    for i, t in texts():
        w = spaced(t)
        grams = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {k for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert got[0].kept and got[19].kept and "home |" not in got[19].cleaned_text
    assert clean_lines(none).count() == 0


def test_decontamination(spark, docs, none):
    a = dict(texts())[0].split(" ")
    items = [("i1", " ".join(a[10:40])), ("i2", "one two"), ("i3", None), ("i4", "..."), ("i5", " ".join(a[20:33]).upper()), ("i1", " ".join(a[10:40]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[j : j + 13])].add(i)
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    # items dealt to several automata give the same rows
    assert {r.doc_id: r for r in decontam.decontaminate(docs, bench, part_bytes=150).collect()} == got
    for i, t in texts():
        w, hit, found = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and r.contaminated == (bool(hit) and 20 * len(hit) >= len(w))
        assert alnum(r.cleaned_text) == [x for j, x in enumerate(w) if j not in hit]
    assert decontam.decontaminate(none, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(repeated(spark, docs), bench, part_bytes=150).count() == len(texts()) + 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=14), max_size=5), st.text(alphabet="abcd ", max_size=30), st.integers(2, 4))
def test_automaton_against_all_windows(items, text, window):
    sa = decontam.SuffixAutomaton([(str(i), t) for i, t in enumerate(items)], window)
    w = text.split()
    hit, found = sa.scan([sa.ids.get(x.encode(), -1) for x in w])
    want, names = set(), set()
    for i, t in enumerate(items):
        x = t.split()
        for j in range(max(1, len(x) - window + 1) if x else 0):
            g = x[j : j + window]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    want.update(range(k, k + len(g)))
                    names.add(str(i))
    assert set(np.flatnonzero(hit).tolist()) == want and found == names


def test_toxicity_on_held_out_rows(spark, none):
    r = random.Random(5)
    rows = []
    for i in range(600):
        w = words(i, 40, 3000)
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "trash", "pathetic"]))
        rows.append((i, " ".join(w), "en", 1, "x", "y"))
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    chain = train_toxicity(docs, labels)
    out = score_toxicity(docs.unionByName(spark.createDataFrame([(900, None, None, None, None, None), (901, "", None, None, None, None)], DOCS)), chain).where("doc_id >= 400").collect()
    assert sum(x.toxic == (x.doc_id % 4 == 0 and x.doc_id < 900) for x in out) >= 0.97 * len(out)
    assert all(0 <= x.p_toxic <= 1 for x in out) and not any(x.toxic for x in out if x.doc_id >= 900)
    assert score_toxicity(none, chain).count() == 0
    # repeated labels and rows, ids that are no numbers, no quality column
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    again = train_toxicity(named.unionByName(named.limit(5)), labels.union(labels).select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "toxic"))
    assert sum(x.toxic == (int(x.doc_id[1:]) % 4 == 0) for x in score_toxicity(named, again).collect()) >= 0.97 * 600
    assert train_toxicity(docs, labels.where("toxic = 0")) is None and not score_toxicity(docs, None).where("toxic").count()


def test_chain_against_a_plain_one():
    """Probabilities equal those of a chain fitted by Newton steps to the same objective, row by row and fold by fold."""
    rng = np.random.default_rng(3)
    x = (rng.random((240, 6)) < 0.4).astype(np.float32)
    first = (x[:, 0] + x[:, 1] + rng.random(240) > 1.3).astype(float)
    second = ((first > 0) & (x[:, 2] + rng.random(240) > 0.8)).astype(float)
    first[5] = np.nan
    l2 = 3e-3

    def newton(z, y):
        z = np.hstack([z, np.ones((len(z), 1))])
        scale = 1 / np.sqrt((z**2).mean(0) + 1e-6)
        z, w, keep = z * scale, np.zeros(z.shape[1]), np.diag([1.0] * (z.shape[1] - 1) + [0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(z) + l2 * keep + 1e-9 * np.eye(len(w)), z.T @ (p - y) / len(z) + l2 * keep @ w)
        return w * scale

    guess = lambda w, z: 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))
    known = ~np.isnan(first)
    outside = np.zeros(240)
    for f in range(4):
        test = np.arange(240) % 4 == f
        outside[test] = guess(newton(x[known & ~test], first[known & ~test]), x[test])
    w1, w2 = newton(x[known], first[known]), newton(np.column_stack([x, outside]), second)
    p1 = guess(w1, x)
    want = np.column_stack([p1, guess(w2, np.column_stack([x, p1]))])
    got = toxicity.fit_chain(x, {"one": first, "two": second}, np.arange(6, dtype=np.uint64), l2=l2).predict(x)
    assert np.abs(got - want).max() < 0.02


def test_groups_hold_features_that_keep_company():
    x = np.zeros((60, 5), np.float32)
    x[:10, [0, 1]] = 1
    x[10:20, [2, 3]] = 1
    x[20:, 4] = 1
    one, two = toxicity.toxic_groups(x, (np.arange(60) < 20).astype(int))
    assert {tuple(one[:20].astype(int)), tuple(two[:20].astype(int))} == {(1,) * 10 + (0,) * 10, (0,) * 10 + (1,) * 10} and not one[20:].any() and not two[20:].any()
    assert not toxicity.toxic_groups(np.zeros((4, 2), np.float32), np.array([0, 0, 1, 1]))[0].any()


def test_pipeline_stages_against_plain_ones(spark, tmp_path):
    """Every stage on a small table with awkward rows, held against brute force on its own input; then an empty table."""
    import corpus_pipeline as p

    if not os.path.exists(MODEL):
        pytest.skip("no model file")
    folder, r = str(tmp_path), random.Random(3)
    bad = ["idiot", "scum", "trash", "pathetic"]
    rows = [(i, t) for i, t in texts() if i is not None]
    toxic = [(1000 + i, " ".join(w if j % 9 else r.choice(bad) for j, w in enumerate(words(50 + i, 40, 3000)))) for i in range(60)]
    clean = [(2000 + i, " ".join(words(500 + i, 40, 3000))) for i in range(120)]
    exam = " ".join(words(77, 20, 900))
    rows += [*toxic, *clean, (3000, exam + " and more"), (3001, " ".join(words(8, 600, 900)) + " " + exam)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t) if t is not None else None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    spark.createDataFrame([(i, 1, int(1000 <= i < 2000)) for i, _ in [*toxic, *clean] if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", exam)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    stage = dict(p.STAGES)
    held = lambda df: {x.doc_id: x.text for x in df.collect()}

    one = stage["toxicity"](spark, docs, folder)
    kept = held(one)
    assert sum(i in kept for i, _ in toxic) <= 1 and all(i in kept for i, _ in [*texts(), *clean])
    two = held(stage["minhash"](spark, one, folder))
    assert set(two) == {i for i, (_, _, keep) in brute_components(list(kept.items())).items() if keep}
    three = held(stage["substrings"](spark, one.where(F.col("doc_id").isin(list(two))), folder))
    windows, first, want = collections.defaultdict(list), {}, {}
    for i in sorted(two):
        w = spaced(two[i])
        for j in range(len(w) - 19):
            first.setdefault(tuple(w[j : j + 20]), (i, j))
        gone = {k for j in range(len(w) - 19) if first[tuple(w[j : j + 20])] != (i, j) for k in range(j, j + 20)}
        if not gone or len(gone) < len(w):
            want[i] = [x for k, x in enumerate(w) if k not in gone]
    assert {i: spaced(t) for i, t in three.items()} == want
    three_df = spark.createDataFrame([(i, t, "en", "src", None) for i, t in three.items()], "doc_id long, text string, lang string, source string, n_chars long")
    four = held(stage["benchmark"](spark, three_df, folder))
    assert 3000 not in four and exam not in four[3001] and set(four) == set(three) - {3000} and all(four[i] == three[i] for i in four if i != 3001)
    last = stage["sentencepiece"](spark, three_df, folder).collect()
    assert {x.doc_id for x in last} == set(three) and all(x.round_trip is not False for x in last)
    empty = docs.limit(0)
    for name, f in p.STAGES:
        assert f(spark, empty, folder).count() == 0, name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        out = p.written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert out.columns == columns and 0 < out.count() <= docs.count()
        assert out.select("doc_id").distinct().count() == out.count()
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    final = p.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in final} == ids and all(r.round_trip for r in final)
