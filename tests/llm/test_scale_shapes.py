"""Shapes that once grew with the square: archives of many frames, texts from one stock of sentences."""

from __future__ import annotations

import os
import random
import time
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("shelfmark.llm")

import corpus_pipeline  # noqa: E402
from shelfmark.llm import neardup, pieces, repeats, textkit, toxicity, warc  # noqa: E402
from shelfmark.llm.queries import PIECE_MODEL  # noqa: E402


def record(i: int, payload: bytes) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + b"\r\n\r\n"


def test_archives_are_read_in_time_proportional_to_their_size():
    packer = zstandard.ZstdCompressor()
    payloads = [os.urandom(1400) for _ in range(12_000)]
    data = b"".join(packer.compress(record(i, p)) for i, p in enumerate(payloads))
    began = time.process_time()
    assert [p for _, p in warc.read_archive(data)] == payloads
    assert time.process_time() - began < 3  # a reader that copies the rest of the archive for each frame takes 20


def test_frames_larger_than_a_piece_and_cut_frames():
    packer = zstandard.ZstdCompressor()
    payloads = [os.urandom(3 * warc.PIECE_BYTES + 7), b"", os.urandom(warc.PIECE_BYTES)]
    data = b"".join(packer.compress(record(i, p)) for i, p in enumerate(payloads))
    assert [p for _, p in warc.read_archive(data)] == payloads
    with pytest.raises(ValueError, match="cut short"):
        list(warc.read_archive(data[:-5]))


def stock(n: int) -> list[tuple[int, str]]:
    """Texts of 24 of 40 fixed sentences, and near copies of some."""
    r = random.Random(5)
    sentences = [" ".join(f"s{i}w{j}" for j in range(14)) for i in range(40)]
    rows = [(d, " ".join(sentences[i] for i in sorted(r.sample(range(40), 24)))) for d in range(n)]
    return rows + [(n + k, rows[k][1].replace("w3 ", "w3x ", 1)) for k in range(0, n, 40)]


def plain_components(rows, k=5):
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_texts_from_one_stock_of_sentences(spark, monkeypatch):
    rows = stock(400)
    listed, real = [], neardup._beyond_centres

    def counted(*args):
        out = real(*args)
        listed.append(out.distinct().count())
        return out

    monkeypatch.setattr(neardup, "_beyond_centres", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == plain_components(rows)
    assert listed[0] < 10 * len(rows)  # of 84,255 pairs


def test_marks_of_links_agree():
    r = random.Random(2)
    words = [f"w{i}" for i in range(4000)]
    least = neardup.least_agreement(75)
    for _ in range(20):
        base = [r.choice(words) for _ in range(300)]
        other = base[:260] + [r.choice(words) for _ in range(40)]
        s = next(textkit.slices(pa.array([" ".join(base), " ".join(other)])))
        sets, offsets = neardup.document_sets(s)
        one, two = (set(sets[offsets[i] : offsets[i + 1]].tolist()) for i in (0, 1))
        regs = neardup.registers(sets, offsets)
        m = neardup.marks(regs)
        agree = int(((regs[0] & 3) == (regs[1] & 3)).sum())
        x = (m[0] ^ m[1]).view(np.uint64)
        assert neardup.REGISTERS - sum(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555)).bit_count() for v in x) == agree
        assert len(one & two) < 0.75 * len(one | two) or agree >= least



def test_near_copies_meet_one_pivot_a_round(spark, monkeypatch):
    """Copies that differ in a few words have another pivot in nearly every bucket; each round compares one pair a document."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for j in rng.sample(range(120), rng.choice((1, 2, 3))):
            words[j] = f"x{rng.randrange(9000)}"
        rows.append((i, " ".join(words)))
    sizes, real = [], neardup.written

    def counted(df, name):
        out = real(df, name)
        if name == "pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(neardup, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == plain_components(rows)
    assert sizes and max(sizes) <= len(rows)


def test_parity_maps_differ_in_at_most_as_many_bits_as_sets_have_shingles_apart():
    h = textkit.mix64(np.arange(1, 5001, dtype=np.uint64))
    for a, b in ((h[:200], h[10:210]), (h[:200], h[:199]), (h[:3000], h[2000:5000]), (h[:7], h[7:9])):
        apart = len(np.setxor1d(a, b))
        differ = sum(int(v).bit_count() for v in (neardup.parity(a) ^ neardup.parity(b)).view(np.uint64))
        assert differ <= apart and (apart - differ) % 2 == 0 and (apart > 40 or differ >= apart - 8)


@pytest.mark.parametrize("least", [0, 1])
def test_copies_with_many_changes_list_few_pairs(spark, monkeypatch, least):
    """Copies of one text, one in two below the threshold to it, with and without the text itself: few of the pairs are listed."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = []
    for i in range(700):
        words = list(base)
        for j in rng.sample(range(150), max(least, i % 9)):
            words[j] = rng.choice(("the", "of", "and", f"x{rng.randrange(40)}"))
        rows.append((i, " ".join(words)))
    listed, real = [], neardup._beyond_centres

    def counted(*args):
        out = real(*args)
        listed.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_beyond_centres", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == plain_components(rows)
    assert listed[0] < 4 * len(rows)  # of 244,650 pairs


def test_training_holds_its_features_little_more_than_twice():
    """The driver trains: it held four more copies of the features before (25.8 MB beside 6.4 here)."""
    rng = np.random.default_rng(3)
    x = (rng.random((4000, 400)) < 0.05).astype(np.float32)
    labels = {"one": x[:, 0].astype(float), "two": np.where(rng.random(4000) < 0.1, np.nan, x[:, 1])}
    tracemalloc.start()
    try:
        chain = toxicity.fit_chain(x, labels, np.arange(400, dtype=np.uint64))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.6 * x.nbytes
    assert all(((chain.predict(x)[:, k] > 0.5) == (x[:, k] > 0)).mean() > 0.99 for k in (0, 1))


def test_components_write_no_table_for_nothing(spark, monkeypatch):
    """Every written table is a plan, jobs and threads of the driver."""
    names, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: names.append(name) or write(df, name))
    star = spark.createDataFrame([(1, i) for i in range(2, 6)] + [(7, 7)], "a long, b long")
    labels = neardup.components(star)
    assert names == ["edges", "hooks", "roots", "edges"] and {(r.v, r.component) for r in labels.collect()} == {(i, 1) for i in range(1, 6)}
    names.clear()
    assert neardup.merged(labels, spark.createDataFrame([(2, 5), (4, 3), (9, 9)], "a long, b long")) is labels and names == ["edges"]
    both = neardup.merged(labels, spark.createDataFrame([(5, 9), (0, 9), (20, 21)], "a long, b long"))
    assert {(r.v, r.component) for r in both.collect()} == {*((i, 0) for i in (0, 1, 2, 3, 4, 5, 9)), (20, 20), (21, 20)}
    assert neardup.components(star.where("a = 7")).count() == 0


def test_workers_drop_what_other_operators_keep():
    """Finding 1 of round 3: automaton and piece model stayed in the workers through all later stages."""
    pieces.piece_model(PIECE_MODEL)
    model = weakref.ref(pieces.piece_model(PIECE_MODEL))
    of = lambda module: textkit.tidy(type("F", (), {"__module__": module, "__name__": "f", "__call__": lambda self, batches: batches})())
    list(of(pieces.__name__)(iter(())))
    assert model() is pieces.piece_model(PIECE_MODEL)
    list(of(neardup.__name__)(iter(())))
    assert model() is None


def test_removal_keeps_no_sums_of_its_parts():
    """Finding 1 of round 3: 4 MB of texts held another eight bytes for each of theirs until the last one was done."""
    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 1 << 40, 80_000).tolist()))
    docs = pa.table({"doc_id": pa.array(range(4), pa.int64()), "text": [text] * 4})
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
    places = np.concatenate([[0], np.ones(79_999)]).astype(np.int32).tobytes()
    flagged = pa.table([pa.array(range(4), pa.int64()), pa.array(range(4), pa.int64()), pa.nulls(4, pa.int32()), pa.array([places] * 4)], schema=repeats._CANDIDATE)
    tracemalloc.start()
    out = repeats._remove(20, schema, True)(docs, flagged)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("n_removed").to_pylist() == [0] + 3 * [80_000]
    assert peak < 18 * 4 * len(text)  # 14.5 now, 22.5 before


def test_pipeline_bounds_arrow_batches(spark):
    """Finding 1 of round 3: a batch was all rows of a task, up to 10,000 whole texts."""
    before = spark.conf.get(corpus_pipeline.BATCH_LIMIT, None)
    rows = spark.range(0, 400, 1, 1).withColumn("text", F.repeat(F.lit("word "), 20_000))
    try:
        spark.conf.unset(corpus_pipeline.BATCH_LIMIT)
        held = corpus_pipeline.small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"]) for b in batches), "size long"))
        sizes = [r["size"] for r in held(spark, rows, "").collect()]
        assert max(sizes) < 5 << 20 and sum(sizes) > 40_000_000
        spark.conf.set(corpus_pipeline.BATCH_LIMIT, "1m")
        assert max(r["size"] for r in held(spark, rows, "").collect()) < 2 << 20
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_LIMIT)
        if before is not None:
            spark.conf.set(corpus_pipeline.BATCH_LIMIT, before)
