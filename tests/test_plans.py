"""Splits, sort columns, replayed changes and the knowledge base against the rules, case by case."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfmark.operators import plans as L


def test_series_stand_in_the_order_of_the_rule(spark):
    codes = ["6301", "608", "6204", "NU2205", "XX", "6205", "NU305", "6004"]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(codes)], "sheet string, row_ord long, code string")
    got = {r.code: (r.sub, r.series) for r in L.split_series(df).collect()}
    assert [got[c][0] for c in ("608", "6004", "6204", "6205", "6301")] == [1, 2, 3, 3, 4]
    assert [s for _, s in sorted({(n, s) for n, s in got.values()})] == ["mini", "60", "62", "63", "NU3", "NU22", "other"]


def test_pattern_and_description_splits(spark):
    df = spark.createDataFrame([("s", 0, "A-2RS"), ("s", 1, "B"), ("s", 2, "C-1RS"), ("s", 3, "D-2RS")], "sheet string, row_ord long, code string")
    assert [(r.part_key, r.part_label, r.sub) for r in L.split_regex(df, "-([0-9])RS$").orderBy("row_ord").collect()] == [("2", "DÒNG 2", 1), ("other", None, 2), ("1", "DÒNG 1", 3), ("2", "DÒNG 2", 1)]
    texts = ["Đá mài 5 inch (Thô)", "đá mài 5 inch, mịn -", None, "Đá mài 5 inch", "  "]
    rows = spark.createDataFrame([("s", i, t, {"d": str(i)}) for i, t in enumerate(texts)], "sheet string, row_ord long, desc_clean string, specs map<string,string>")
    out = L.split_description(rows, r"\(?(thô|mịn)\)?", "Độ Mịn").orderBy("row_ord").collect()
    assert [r.part_key for r in out] == ["Đá mài 5 inch", "đá mài 5 inch", "", "Đá mài 5 inch", ""]
    assert [r.specs.get("Độ Mịn", "-") for r in out] == ["Thô", "mịn", "-", None, "-"] and out[0].specs["d"] == "0"
    assert [r.sub for r in out] == [1, 2, 3, 1, 3] and out[2].title is None and out[0].title == "ĐÁ MÀI 5 INCH"
    columns = spark.createDataFrame([("s", "d", 0)], "sheet string, label string, pos int")
    assert [(r.label, r.pos) for r in L.spec_labels(L.split_description(rows, r"\(?(thô|mịn)\)?", "Độ Mịn"), columns).orderBy("pos").collect()] == [("d", 0), ("Độ Mịn", 1)]


def columns(spark, labels):
    return spark.createDataFrame([("s", n, i, num) for i, (n, num) in enumerate(labels)], "sheet string, label string, pos int, numeric boolean")


def picked(spark, labels, patterns):
    rules = spark.createDataFrame(list(enumerate(patterns, 1)), "rank int, pattern string")
    return [(r.pattern, r.label, r.how) for r in L.sort_columns(columns(spark, labels), rules).orderBy("rank").collect()]


def test_each_pattern_takes_a_column_that_is_free(spark):
    labels = [("d inner", True), ("d outer", True), ("Chiều Dài", False)]
    assert picked(spark, labels, ["^d", "^d", "chieu dai", "width"]) == [("^d", "d inner", "MATCH"), ("^d", "d outer", "MATCH"), ("chieu dai", "Chiều Dài", "MATCH"), ("width", None, "MISSING")]
    assert picked(spark, labels, ["d outer", "^d"]) == [("d outer", "d outer", "EXACT"), ("^d", "d inner", "MATCH")]
    assert picked(spark, [("Name", False), ("Size", True)], ["nothing", "none"]) == [("", "Size", "FALLBACK")]
    assert picked(spark, [("Name", False)], ["nothing"]) == [("nothing", None, "MISSING")]


def test_greedy_choice_equals_a_plain_one(spark):
    import re

    r = random.Random(3)
    for _ in range(4):
        labels = [("".join(r.choice("abc") for _ in range(3)) + str(i), r.random() < 0.5) for i in range(6)]
        patterns = ["".join(r.choice("abc.") for _ in range(r.randrange(1, 3))) for _ in range(5)] + [labels[2][0]]
        taken, want = [], []
        for p in patterns:
            hit = next((n for n, _ in labels if n == p and n not in taken), None)
            how = "EXACT" if hit else "MATCH"
            hit = hit or next((n for n, _ in labels if n not in taken and re.search(p, n)), None)
            want.append((p, hit, how if hit else "MISSING"))
            taken += [hit] if hit else []
        assert picked(spark, labels, patterns) == want


ROWS = [("g", 0, "A", "b1", {"Load\n(lbs)": "10", "d": "1"}), ("g", 1, "B", "b1", {"Load\n(lbs)": None, "d": "2"}), ("h", 2, "A", "b2", {"d": "3"})]
PATCH = "patch_id long, seq int, op string, grp string, code string, label string, value string, source string"


def replayed(spark, patches):
    rows = spark.createDataFrame(ROWS, "grp string, row_ord long, code string, brand string, specs map<string,string>")
    out, hits, violations = L.replay_patches(rows, spark.createDataFrame(patches, PATCH))
    return {r.row_ord: (r.brand, r.specs) for r in out.collect()}, {r.patch_id: r.hits for r in hits.collect()}, {(r.patch_id, r.violation) for r in violations.collect()}


def test_a_log_is_replayed_in_its_order(spark):
    rows, hits, bad = replayed(spark, [
        (1, 1, "set_spec", None, "A", "load", "20 lb", "p.1"), (2, 2, "rename_label", "g", None, "LOAD", "Max Load", "p.1"), (3, 3, "set_spec", None, "B", "max load", "7,5", "p.2"),
        (4, 4, "set_brand", "g", None, None, "X", "p.3"), (5, 5, "set_brand", None, "A", None, "Y", "p.3"), (6, 6, "set_spec", None, "B", "New", "n", "p.4"),
    ])
    assert not bad and hits == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1}
    assert rows[0] == ("Y", {"Max Load\n(lbs)": "20", "d": "1"}) and rows[1] == ("X", {"Max Load\n(lbs)": "7.5", "d": "2", "New": "n"})
    assert rows[2] == ("Y", {"d": "3", "load": "20 lb"})  # the group has no such column: a new one


def test_one_violation_refuses_the_whole_log(spark):
    good = (1, 1, "set_brand", "g", None, None, "X", "p.1")
    same = {r[1]: (r[3], r[4]) for r in ROWS}
    for patch, why in [((2, 2, "set_spec", None, "A", "Load", "20 kg", "p"), "UNIT_MISMATCH"), ((2, 2, "set_spec", None, "Z", "d", "1", "p"), "NO_MATCH"), ((2, 2, "rename_label", "g", None, "none", "x", "p"), "NO_MATCH"), ((2, 2, "set_spec", None, "A", "d", "1", " "), "NO_SOURCE")]:
        rows, _, bad = replayed(spark, [good, patch])
        assert bad == {(2, why)} and rows == same


CARDS = "card_id string, title string, title_source string, lines array<string>, legend array<string>"


def test_edits_of_texts_and_lists(spark):
    cards = spark.createDataFrame([("c1", "T", "data", ["a"], []), ("c2", "U", "model", [], ["x"])], CARDS)
    edit = "edit_id long, card_id string, field string, value string, items array<string>"
    good = [(1, "c1", "lines", None, ["n", "m"]), (2, "c2", "title", "NEW", None), (3, "c2", "legend", None, ["l"])]
    out = {r.card_id: r for r in L.apply_edits(cards, spark.createDataFrame(good, edit)).collect()}
    assert out["c1"].lines == ["n", "m"] and out["c1"].title == "T" and out["c2"].title == "NEW" and out["c2"].legend == ["l"] and out["c2"].lines == []
    bad = [(4, "c1", "title", "no", None), (5, "c9", "note", "x", None), (6, "c2", "rows", "x", None), (7, "c2", "title", "AGAIN", None)]
    every = spark.createDataFrame(good + bad, edit)
    assert {(r.edit_id, r.violation) for r in L.validate_edits(every, cards).collect()} == {(4, "TITLE_FROM_DATA"), (5, "UNKNOWN_CARD"), (6, "FIELD"), (7, "CONFLICT")}
    assert {r.card_id: r.title for r in L.apply_edits(cards, every).collect()} == {"c1": "T", "c2": "U"}


def test_learning_keeps_approved_entries(spark):
    kb = "code string, title string, lines array<string>, legend array<string>, status string"
    old = spark.createDataFrame([("a", "T", ["l"], [], "ok"), ("b", "T", ["l"], [], "review"), ("c", "T", ["l"], [], "ok"), ("d", "T", [], [], "ok")], kb)
    new = spark.createDataFrame([("a", "T", ["other"], []), ("b", "T2", ["l"], []), ("c", "T", ["l"], []), ("e", "E", [], [])], "code string, title string, lines array<string>, legend array<string>")
    stored, conflicts = L.kb_learn(old, new)
    assert {r.code: (r.title, r.lines, r.status) for r in stored.collect()} == {"a": ("T", ["l"], "ok"), "b": ("T2", ["l"], "review"), "c": ("T", ["l"], "review"), "d": ("T", [], "ok"), "e": ("E", [], "review")}
    assert {r.code for r in conflicts.collect()} == {"a", "b"}
    assert {r.code: r.lines for r in L.kb_learn(old, new, force=True)[0].collect()}["a"] == ["other"]


def plain_apply(cards, rows, kb):
    out = []
    for cid, title, source, lines, legend in cards:
        mine = [(i, c) for k, i, c in rows if k == cid]
        known = [kb[c] for _, c in mine if c in kb]
        fill = lambda e, t: (t, lines or e[1], legend or e[2])
        if source == "data":
            out.append((cid, *(fill(known[0], title) if known else (title, lines, legend)), [i for i, _ in mine]))
            continue
        titles = list(dict.fromkeys(e[0] for e in known))
        if len(titles) >= 2:
            for n, t in enumerate(titles, 1):
                part = [(i, c) for i, c in mine if c in kb and kb[c][0] == t]
                out.append((f"{cid}-{n}", *kb[part[0][1]], [i for i, _ in part]))
            rest = [i for i, c in mine if c not in kb]
            out += [(f"{cid}-{len(titles) + 1}", title, lines, legend, rest)] if rest else []
        else:
            full = titles and all(c in kb for _, c in mine)
            out.append((cid, *(fill(kb[mine[0][1]], titles[0]) if full else (title, lines, legend)), [i for i, _ in mine]))
    return out


def test_knowledge_base_on_cards(spark):
    r = random.Random(8)
    kb = {f"k{i}": (f"TITLE {i % 3}", [f"line {i}"] if i % 4 else [], [f"legend {i}"] if i % 3 else []) for i in range(8)}
    cards, rows = [], []
    for n in range(60):
        cards.append((f"c{n}", f"OLD {n}", r.choice(["data", "model", None]), r.choice([[], ["own"]]), r.choice([[], ["own legend"]])))
        pool = r.choice([[f"k{i}" for i in range(8)], ["k0", "k3", "k6"], ["u1", "u2"], ["k1", "u1"]])
        rows += [(f"c{n}", 100 * n + i, r.choice(pool)) for i in range(r.randrange(1, 6))]
    df = spark.createDataFrame(rows, "card_id string, row_ord long, code string")
    base = spark.createDataFrame([(c, *e) for c, e in kb.items()], "code string, title string, lines array<string>, legend array<string>")
    moved, made = L.kb_apply(df, spark.createDataFrame(cards, CARDS), base)
    got = {c.card_id: (c.title, c.lines, c.legend) for c in made.collect()}
    want = plain_apply(cards, rows, kb)
    assert got == {w[0]: w[1:4] for w in want} and made.count() == len(want)
    assert {x.row_ord: x.card_id for x in moved.collect()} == {i: w[0] for w in want for i in w[4]}
    same = L.row_digest(df, "row_ord", "code").first()
    assert L.row_digest(moved, "row_ord", "code").first() == same and L.row_digest(moved.withColumn("code", F.lit("x")), "row_ord", "code").first() != same
    assert any("-" in k for k in got) and got["c0"] is not None


def test_a_title_of_the_data_is_never_split(spark):
    cards = spark.createDataFrame([("c", "OLD", "data", [], [])], CARDS)
    rows = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "card_id string, row_ord long, code string")
    kb = spark.createDataFrame([("a", "A", ["l"], []), ("b", "B", [], [])], "code string, title string, lines array<string>, legend array<string>")
    moved, made = L.kb_apply(rows, cards, kb)
    assert [tuple(r) for r in made.collect()] == [("c", "OLD", "data", ["l"], [])] and {r.card_id for r in moved.collect()} == {"c"}
    _, split = L.kb_apply(rows, cards.withColumn("title_source", F.lit("model")), kb)
    assert {(r.card_id, r.title) for r in split.collect()} == {("c-1", "A"), ("c-2", "B")}


def test_a_delivery_waits_for_disputes_and_for_all_rows(spark):
    from shelfmark.operators import category as C

    queue = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "key_hash string")
    said = [("x", "a", "correct", None), ("y", "a", "correct", None), ("x", "b", "wrong", "Bu lông"), ("y", "b", "wrong", "bu long"), ("x", "c", "wrong", "bolt"), ("y", "c", "wrong", "nut"), ("x", "d", "correct", None)]
    verdicts = spark.createDataFrame(said, "judge string, key_hash string, verdict string, suggested string")
    rows, fewer = spark.createDataFrame([(1,), (2,)], "part_id long"), spark.createDataFrame([(1,), (9,)], "part_id long")
    none = queue.where("false")
    gate = lambda settled, out: {r.check_name: r.failed for r in C.delivery_gate(queue, verdicts, settled, rows, out).collect()}
    assert gate(none, rows) == {"unsettled_pairs": 2, "rows_lost": 0, "rows_added": 0}  # c: other leaves, d: one judge only
    assert gate(queue.where("key_hash in ('c', 'd')"), fewer) == {"unsettled_pairs": 0, "rows_lost": 1, "rows_added": 1}
    assert C.gated(rows, C.delivery_gate(queue, verdicts, none, rows, rows)).count() == 0
    assert C.gated(rows, C.delivery_gate(queue, verdicts, queue, rows, rows)).count() == 2
