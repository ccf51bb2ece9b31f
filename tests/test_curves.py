"""Curves on the slice lattice, counted inversions and prefix sums against plain versions."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import curves as C
from shelfmark.operators import scan

LONG = "grp string, row_ord long, k string, v string, pos int"


def cells(spark, rows):
    """rows: (grp, row_ord, [(k, v), ...])."""
    return spark.createDataFrame([(g, i, k, v, p) for g, i, kv in rows for p, (k, v) in enumerate(kv)], LONG)


def ring(std, hole, groove):
    return [("Standard", std), ("hole", f"{hole} mm"), ("groove", f"{groove} mm")]


RINGS = [("Ring", i, ring("DIN 472", 44 + 2 * i, 46.5 + 2 * i)) for i in range(8)] + [("Ring", 10 + i, ring("DIN 7980", 44 + 2 * i, 60 + 2 * i)) for i in range(8)]


def status(spark, rows, known, value):
    long = cells(spark, rows) if rows else spark.createDataFrame([], LONG)
    asked = spark.createDataFrame([("Ring", 99, "groove", value)], "grp string, row_ord long, k string, value string")
    return C.verify_cells(asked, cells(spark, [("Ring", 99, known)]), long).first()


def test_a_slice_rejects_what_the_whole_group_only_doubts(spark):
    own = [("hole", "49 mm"), ("Standard", "DIN 472")]
    out = status(spark, RINGS, own, "20 mm")
    assert out["status"] == "OUT_OF_RANGE" and (out["seg_k"], out["seg_v"], out["kind"]) == ("Standard", "DIN 472", "interp")
    assert status(spark, RINGS, own, "51.5 mm")["status"] == "PLAUSIBLE"
    assert status(spark, RINGS, own[:1], "20 mm")["status"] != "OUT_OF_RANGE"
    assert status(spark, RINGS[:8], own[:1], "20 mm")["status"] == "DISAGREE_UNSEGMENTED"
    assert status(spark, RINGS, own, "blue")["status"] == "NOT_NUMERIC"
    assert status(spark, [], own, "53.5 mm")["status"] == "NO_REFERENCE"
    assert status(spark, RINGS, [("hole", "500 mm"), ("Standard", "DIN 472")], "20 mm")["status"] == "NO_REFERENCE"


def test_padding_is_of_the_larger_end_on_both_sides(spark):
    rows = [("Ring", i, [("hole", f"{i} mm"), ("groove", f"{100 * i} mm")]) for i in range(8)]
    assert status(spark, rows, [("hole", "0.5 mm")], "-0.5 mm")["status"] == "PLAUSIBLE"  # in [0, 100]: 2 of padding below, too
    assert status(spark, rows, [("hole", "0.5 mm")], "-2.5 mm")["status"] == "DISAGREE_UNSEGMENTED"


# --- plain versions, cell by cell


def num(t):
    m = re.search(r"-?\d+(?:[.,]\d+)?", t or "")
    return float(m.group().replace(",", ".")) if m else None


def measure(t):
    return num(t) if re.match(r"""^\s*-?\d+(?:[.,]\d+)?\s*[a-zA-Z%°"'/]*\s*$""", t or "") else None


def axis(t):
    return measure(t) if measure(t) is not None else num(t) if re.match(r"^\s*[A-Za-z]{1,2}\s?-?\d+(?:[.,]\d+)?\s*$", t or "") else None


def plain_ratio(pts):
    pairs = [(a, b) for a in pts for b in pts if a[0] < b[0]]
    return len(pairs), sum(a[1] <= b[1] for a, b in pairs)


def plain_status(rows, own, k, value):
    if measure(value) is None:
        return "NOT_NUMERIC"
    kinds = collections.defaultdict(set)
    for kv in rows:
        for a, v in kv.items():
            kinds[a].add(v)
    nodes = [("", "", rows)]
    for a, v in own.items():
        part = [r for r in rows if r.get(a) == v]
        if a != k and measure(v) is None and 2 <= len(kinds[a]) <= 30 and len(part) >= 6:
            nodes.append((a, v, part))
    best = None
    for a, _, part in nodes:
        for x_k, xv in own.items():
            if x_k == k or axis(xv) is None:
                continue
            pts = {(axis(r.get(x_k)), measure(r.get(k))) for r in part if axis(r.get(x_k)) is not None and measure(r.get(k)) is not None}
            n, up = plain_ratio(pts)
            if len(pts) < 6 or n < 6 or 0.05 < up / n < 0.95:
                continue
            way = 1 if up / n >= 0.95 else -1
            x = axis(xv)
            at, low, high = [y for p, y in pts if p == x], [y for p, y in pts if p < x], [y for p, y in pts if p > x]
            if at:
                lo, hi = min(at), max(at)
            elif low and high:
                lo, hi = sorted((max(low), min(high)) if way > 0 else (max(high), min(low)))
            else:
                continue
            rank = (a != "", round(up / n if way > 0 else 1 - up / n, 3), len(pts))
            if best is None or rank > best[0]:
                best = (rank, lo, hi, a)
    if best is None:
        return "NO_REFERENCE"
    pad = 0.02 * max(abs(best[1]), abs(best[2]))
    return "PLAUSIBLE" if best[1] - pad <= measure(value) <= best[2] + pad else "OUT_OF_RANGE" if best[3] else "DISAGREE_UNSEGMENTED"


def test_every_cell_as_in_a_plain_search(spark):
    r = random.Random(4)
    rows = []
    for i in range(160):
        std, size = r.choice(["DIN 1", "DIN 2", "ISO 3"]), r.randrange(1, 25)
        kv = {"std": std, "size": f"M{size}", "len": f"{size * 3 + r.choice([0, 0, 0, 1])} mm", "col": r.choice(["red", "blue"])}
        y = {"DIN 1": 2 * size + 1, "DIN 2": 200 - 3 * size, "ISO 3": r.randrange(50)}[std]
        kv["key"] = "n/a" if r.random() < 0.05 else f"{y} mm"
        for k in list(kv):
            if r.random() < 0.1:
                del kv[k]
        items = list(kv.items())
        r.shuffle(items)
        rows.append((r.choice("ab"), i, items))
    values = [(g, i, "key", r.choice([f"{r.randrange(200)} mm", "none", dict(kv).get("key", "7 mm")])) for g, i, kv in rows]
    long = cells(spark, rows)
    got = C.verify_cells(spark.createDataFrame(values, "grp string, row_ord long, k string, value string"), long, long).collect()
    want = {i: plain_status([dict(kv) for h, _, kv in rows if h == g], dict(rows[i][2]), k, v) for g, i, k, v in values}
    assert {x["row_ord"]: x["status"] for x in got} == want and len(got) == 160
    assert {"OUT_OF_RANGE", "PLAUSIBLE", "NOT_NUMERIC"} <= set(want.values())


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_pairs_are_counted_exactly(spark, bucket):
    r = random.Random(bucket)
    groups = {"a": {(r.randrange(40), r.randrange(15)) for _ in range(200)}, "b": {(float(i), -i) for i in range(30)}, "c": {(1, 5), (1, 6)}, "d": {(r.random(), r.random()) for _ in range(100)}}
    pts = spark.createDataFrame([(g, float(x), float(y)) for g, p in groups.items() for x, y in p], "g string, x double, y double")
    got = {x["g"]: (x["n_points"], x["n_pairs"], x["n_up"]) for x in C.monotone_ratio(pts, ("g",), bucket).collect()}
    assert got == {g: (len(p), *plain_ratio(p)) for g, p in groups.items() if plain_ratio(p)[0]}


def test_a_million_points_in_one_group(spark):
    n = 1_000_000
    pts = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), ((F.col("id") * 7919) % n).cast("double").alias("y"))
    got = C.monotone_ratio(pts, ("g",), bucket=512).first()
    # inversions of the sequence by a merge sort
    seq, inversions = [i * 7919 % n for i in range(n)], 0
    width = 1
    import numpy as np

    a = np.array(seq)
    while width < n:
        for s in range(0, n, 2 * width) if width > 2000 else []:
            left, right = a[s : s + width], a[s + width : s + 2 * width]
            inversions += int((len(left) - np.searchsorted(left, right)).sum())
            a[s : s + 2 * width] = np.sort(a[s : s + 2 * width], kind="stable")
        if width <= 2000:
            width = 2048
            for s in range(0, n, width):
                part = a[s : s + width]
                inversions += int(np.triu(part[:, None] > part[None, :], 1).sum())
                a[s : s + width] = np.sort(part)
        else:
            width *= 2
    assert got["n_pairs"] == n * (n - 1) // 2 and got["n_up"] == got["n_pairs"] - inversions


def washer(std, size, od):
    return [("Standard", std), ("bolt", f"M{size}"), ("outer", f"{od} mm")]


def checked(spark, answers):
    rows = [("W", i, washer("DIN 127", 6 + 2 * i, 11.8 + 3 * i)) for i in range(8)] + [("W", 10 + i, washer("DIN 7980", 6 + 2 * i, 9.3 + 2.7 * i)) for i in range(8)]
    known = cells(spark, [("W", 100 + i, [("bolt", f"M{s}"), ("Standard", std)]) for i, (s, _, std) in enumerate(answers)])
    items = spark.createDataFrame([(f"q{i}", 100 + i, "outer", f"{v} mm") for i, (_, v, _) in enumerate(answers)], "id string, row_ord long, k string, value string")
    return {(x["id"], x["reason"]) for x in C.cross_check(items, known, cells(spark, rows)).collect()}


def test_answers_are_compared_with_each_other_by_label(spark):
    assert checked(spark, [(14, 24.4, "DIN 7980"), (14, 21.1, "DIN 7980")]) == {("q0", "SAME_X"), ("q1", "SAME_X")}
    assert checked(spark, [(14, 21.1, "DIN 7980"), (20, 30.1, "DIN 7980")]) == set()
    assert checked(spark, [(14, 21.1, "DIN 7980"), (14, 24.1, "DIN 127")]) == set()
    assert checked(spark, [(14, 21.1, "DIN 7980")]) == set()


def test_equal_values_break_a_curve(spark):
    rows = [("W", i, [("bolt", f"M{i}"), ("outer", f"{3 * i} mm")]) for i in range(8)]
    items = spark.createDataFrame([(1, 101, "outer", "9 mm"), (2, 102, "outer", "9 mm"), (3, 103, "outer", "30 mm")], "id long, row_ord long, k string, value string")
    known = cells(spark, [("W", 101, [("bolt", "M3")]), ("W", 102, [("bolt", "M5")]), ("W", 103, [("bolt", "M9")])])
    assert {(x["id"], x["reason"]) for x in C.cross_check(items, known, cells(spark, rows)).collect()} == {(1, "ORDER"), (2, "ORDER")}


def test_choice_of_axis_and_label(spark):
    rows = [("W", i, washer("DIN 127", 6 + 2 * i, 11.8 + 3 * i)) for i in range(8)] + [("W", 10 + i, washer("DIN 7980", 6 + 2 * i, 9.3 + 2.7 * i)) for i in range(8)]
    known = cells(spark, [("W", 100, [("bolt", "M14"), ("Standard", "DIN 127")]), ("W", 101, [("bolt", "M10")])])
    items = spark.createDataFrame([(100, "outer"), (101, "outer")], "row_ord long, k string")
    one = C.axis_label_choice(items, known, cells(spark, rows)).first()
    assert (one["axis"], one["label"], one["usable"], one["purity"]) == ("bolt", "Standard", 2, 1.0)
    plain = C.axis_label_choice(items, known, cells(spark, [(g, i, kv[1:]) for g, i, kv in rows if i < 8])).first()
    assert (plain["axis"], plain["label"]) == ("bolt", "")


def test_ranks_and_running_sums_over_ranges(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(50), r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a int, c long").repartition(7)
    got = {x["i"]: x["position"] for x in scan.numbered(df, "a", "i").collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    assert got == {x[0]: p for p, x in enumerate(order)}
    sums, before = {}, 0
    for i, _, c in order:
        sums[i], before = before, before + c
    assert {x["i"]: x["before"] for x in scan.running_sum(df, "c", "a", "i").collect()} == sums
    assert scan.numbered(df.limit(0), "a").count() == scan.running_sum(df.limit(0), "c", "a").count() == 0
