"""The fill cascade and the way from questions to rows against a row-by-row version."""

from __future__ import annotations

import collections
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import cascade as K
from shelfmark.operators import deps as P
from shelfmark.operators import steps

TAGS = {"Original"}


def table(seed, n=260):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        size, fine = r.choice(["M4", "M6", "M8"]), r.random() < 0.04
        pitch = f"{size[1:]}{'.5' if fine else ''} mm"
        finish = "Nickel" if r.random() < 0.03 else {"M4": "Zinc", "M6": "Black", "M8": "Zinc"}[size]
        kv = {"Size": size, "Thread": "Fine" if fine else "Coarse", "Pitch": pitch, "Tap": f"T{pitch}", "Finish": finish, "Zap": f"Z{pitch}", "Original": "Japan" if size == "M4" else r.choice(["Peru", "Chile"]), "Note": f"sold without {r.choice('abcdefgh')} in box"}
        name = f"part {finish}{' Fine' if fine else ''} {size}"
        for k in list(kv):
            if r.random() < (0.3 if k in ("Pitch", "Tap", "Zap") else 0.12):
                del kv[k]
        rows.append((r.choice(["nut", "bolt"]), i, name, kv))
    return rows


def plain(rows, relations, keys):
    """Row by row, cell by cell, as the rules say."""
    values, in_name, total = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for _, _, name, kv in rows:
        for k, v in kv.items():
            values[k].add(v)
            total[k] += 1
            in_name[k] += v.lower() in name.lower()
    encoded = {k for k in total if total[k] >= 10 and in_name[k] / total[k] >= 0.3}
    notes = {k for k, vs in values.items() if len(vs) >= 5 and sum(len(v.split()) >= 4 for v in vs) >= len(vs) / 2 and sum(not any(c.isdigit() for c in v) for v in vs) >= len(vs) / 2}

    def rejected(det, name, k, v):
        low = name.lower()
        return bool(TAGS & set(det)) or (k in encoded and v.lower() not in low and any(o.lower() in low and o != v for o in values[k]))

    def count(g, target, need):
        c = collections.Counter(kv[target] for h, _, _, kv in rows if (g is None or h == g) and target in kv and all(kv.get(a) == b for a, b in need.items()))
        (top, n), all_ = (c.most_common(1) or [(None, 0)])[0], sum(c.values())
        return (top, n) if n >= 3 and 100 * n >= 95 * all_ else None

    out, asked = {}, {}
    for g, i, name, kv in rows:
        words = f" {name.lower()} "
        known = dict(kv)
        for k in values:
            hits = {v for h, _, _, o in rows if h == g for a, v in o.items() if a == k and f" {v.lower()} " in words}
            if k not in known and len(hits) == 1:
                known[k] = hits.pop()
        for target in sorted(k for k in values if k not in kv):
            if target in notes:
                out[i, target] = (None, "NOTE")
                continue
            hit = None
            for d1, d2 in relations[g, target]:
                det = [d for d in (d1, d2) if d]
                entry = keys.get((g, d1, d2, target, known.get(d1), known.get(d2, "") if d2 else ""))
                if all(d in known for d in det) and entry and entry[1] >= 3 and 100 * entry[1] >= 95 * entry[2]:
                    hit = (entry[0], det, "RELATION")
                    break
            if hit and rejected(hit[1], name, target, hit[0]):
                hit = None
            if not hit:
                found = [(n, a, v) for a in known if a != target for v, n in [count(g, target, {a: known[a]}) or (None, 0)] if n]
                if found:
                    n, a, v = min(found, key=lambda x: (-x[0], x[1]))
                    hit = (v, [a], "INDEX")
                    if rejected(hit[1], name, target, v):
                        hit = None
            if hit:
                for scope in (g, None):
                    more = [(n, a, v) for a in known if a not in (*hit[1], target, *TAGS) for v, n in [count(scope, target, {d: known[d] for d in (*hit[1], a)}) or (None, 0)] if n and v != hit[0]]
                    if more:
                        hit = (min(more, key=lambda x: (-x[0], x[1]))[2], hit[1], "REFINED")
                        break
                out[i, target] = (hit[0], hit[2])
                known.setdefault(target, hit[0])
                continue
            out[i, target] = (None, "TAG" if target in TAGS else "ASK")
            if target not in TAGS:
                det = next(([d for d in pair if d] for pair in relations[g, target] if all(d in known for d in pair if d)), None)
                asked[i, target] = "; ".join(f"{d}={known[d]}" for d in det) if det else f"name={name}"
    return out, asked


def test_cascade_equals_row_by_row_work(spark):
    tiers = collections.Counter()
    for seed in (1,):
        rows = table(seed)
        long = spark.createDataFrame([(g, i, k, v) for g, i, _, kv in rows for k, v in kv.items()], "grp string, row_ord long, k string, v string").cache()
        names = spark.createDataFrame([(g, i, n) for g, i, n, _ in rows], "grp string, row_ord long, name string")
        targets = sorted({k for *_, kv in rows for k in kv})
        cells = spark.createDataFrame([(g, i, t, p) for g, i, _, kv in rows for p, t in enumerate(t for t in targets if t not in kv)], "grp string, row_ord long, target string, pos int")
        pool = P.attribute_pool(long)
        keys = P.dependency_keys(long, pool).cache()
        mined = P.mine_dependencies(long, pool, keys).cache()
        relations = collections.defaultdict(list)
        for r in mined.orderBy("rank").collect():
            relations[r["grp"], r["target"]].append((r["d1"], r["d2"]))
        entries = {(r["grp"], r["d1"], r["d2"], r["target"], r["v1"], r["v2"]): (r["value"], r["n_dom"], r["n_tot"]) for r in keys.collect()}
        want, asked = plain(rows, relations, entries)
        found, context = K.fill_cascade(cells, long, P.labels_from_names(names, long), names, mined, keys)
        got = {(r["row_ord"], r["target"]): (r["value"], r["tier"]) for r in found.collect()}
        assert got == want
        bridge = K.question_rows(found, context, mined, names)
        assert {(r["row_ord"], r["target"]): r["context"] for r in bridge.collect()} == asked
        assert {r["n_rows"] for r in K.questions(bridge).collect()} == set(collections.Counter((rows[i][0], t, c) for (i, t), c in asked.items()).values())
        tiers.update(t for _, t in want.values())
    assert {"RELATION", "INDEX", "REFINED", "NOTE", "TAG", "ASK"} <= set(tiers)


def test_one_name_against_it_drops_an_answer_for_all_rows(spark):
    names = spark.createDataFrame([("g", i, f"part {f} x") for i, f in enumerate(["Zinc", "Nickel"] * 6)], "grp string, row_ord long, name string")
    long = spark.createDataFrame([("g", i, "Finish Of g", f) for i, f in enumerate(["Zinc", "Nickel"] * 6)], "grp string, row_ord long, k string, v string")
    bridge = spark.createDataFrame([("a", "g", "Finish Of g", "c", 0), ("a", "g", "Finish Of g", "c", 1), ("b", "g", "Finish Of g", "d", 2)], "key_hash string, grp string, target string, context string, row_ord long")
    answers = spark.createDataFrame([("a", "Zinc"), ("b", "Zinc")], "key_hash string, value string")
    assert [r.key_hash for r in K.name_contradictions(bridge, answers, names, long).collect()] == ["a"]
    gated = answers.withColumn("reason", F.when(F.col("key_hash") == "a", "NAME_CONTRADICTS"))
    assert [(r.row_ord, r.k, r.value) for r in K.answered_cells(bridge, gated).collect()] == [(2, "Finish Of g", "Zinc")]


def test_other_groups_values_speak_against_a_value(spark):
    rows = [("bolt", i, "Finish Of bolt", f, f"bolt {f}") for i, f in enumerate(["Zinc", "Hot Dip"] * 6)] + [("u", 20 + i, "Finish Of u", "Zinc", "u Zinc") for i in range(12)]
    long = spark.createDataFrame([r[:4] for r in rows], "grp string, row_ord long, k string, v string")
    names = spark.createDataFrame([(r[0], r[1], r[4]) for r in rows] + [("u", 99, "u steel Hot Dip DN40")], "grp string, row_ord long, name string")
    asked = spark.createDataFrame([("u", 99, "Finish Of u", "Zinc")], "grp string, row_ord long, k string, v string")
    assert P.name_guard(names, P.name_evidence(names, long), asked).first()["in_name"] == "Hot Dip"


SF = "/root/testdata/sf0.001"
JOINED_BY_ROW = ["d05_refine_lookup", "d10_fill_cascade", "d11_cascade_questions", "d11_question_rows", "e07_merge_judges", "e08_merge_sources", "e09_answer_gates", "e09_answered_cells"]
PLANS: list[str] = []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", JOINED_BY_ROW)
def test_no_table_of_rows_goes_through_the_driver(spark, monkeypatch, name):
    """No join on rows or questions is a broadcast, in any written step or the result: the tables of a few rows here are of millions elsewhere."""
    from shelfmark.plans import q_deps, registry

    note = lambda df: PLANS.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (K, q_deps):
        monkeypatch.setattr(module, "kept", lambda df: note(df) or steps.kept(df))
    monkeypatch.setattr(registry, "start_query", lambda: None)  # the steps are built by the first query
    note(registry.QUERIES[name](spark, SF))
    broadcasts = [keys for p in PLANS for keys in re.findall(r"BroadcastHashJoin \[(.*?)\]", p)]
    assert len(PLANS) > 20 and not [k for k in broadcasts if "row_ord" in k or "key_hash" in k]
