"""Filling open cells from the table itself, and questions for the rest with the way back to their rows.

Open cells of a row are looked up in a fixed order, and a value found for one is
known to the later ones.  Done for all rows at once: every cell is looked up, then
again only those with an earlier cell of their row that changed, until none does.
The first cell of a row is right after one round, the second after two, and so on;
each round is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators.deps import MERCH_TAGS, name_evidence, name_guard, note_attributes
from shelfmark.operators.steps import by_merge, kept

MIN_ROWS, PURITY_PCT = 3, 95
CELL = ["grp", "row_ord", "target"]


def _dominant(counts: DataFrame, key: list[str]) -> DataFrame:
    """(key, value, n_dom, n_tot): the most frequent value of each key, the first seen for ties."""
    return counts.groupBy(*key).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("value"), F.max("n").alias("n_dom"), F.sum("n").alias("n_tot"))


def _sure():
    return (F.col("n_dom") >= MIN_ROWS) & (100 * F.col("n_dom") >= PURITY_PCT * F.col("n_tot"))


def single_keys(long: DataFrame) -> DataFrame:
    """(grp, d1, v1, target, value, n_dom, n_tot) over all attributes of the group, whatever their relation is worth."""
    a = long.select("grp", "row_ord", F.col("k").alias("d1"), F.col("v").alias("v1"))
    t = long.select("grp", "row_ord", F.col("k").alias("target"), F.col("v").alias("value"))
    key = ["grp", "d1", "v1", "target"]
    return _dominant(a.join(by_merge(t), ["grp", "row_ord"]).where("d1 <> target").groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("row_ord").alias("first")), key)


def _by_relations(have: DataFrame, relations: DataFrame, keys: DataFrame) -> DataFrame:
    """The first sure hit in rank order, else the first weak one, of each cell."""
    one = have.select(*CELL, F.col("k").alias("d1"), F.col("v").alias("v1")).join(relations.select("grp", "target", "d1", "d2", "rank"), ["grp", "target", "d1"])
    two = have.select("row_ord", "target", F.col("k").alias("d2"), F.col("v").alias("v2"))
    both = one.join(by_merge(two), ["row_ord", "target", "d2"], "left").where("d2 = '' or v2 is not null").withColumn("v2", F.coalesce("v2", F.lit("")))
    hits = both.join(keys, ["grp", "d1", "d2", "target", "v1", "v2"]).withColumn("sure", _sure())
    best = W.partitionBy("row_ord", "target").orderBy(F.desc("sure"), "rank")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*CELL, "value", "d1", "d2", "v1", "v2", "n_dom", "sure")


def _by_index(have: DataFrame, singles: DataFrame) -> DataFrame:
    """The sure single key with the most witnesses, ties by name."""
    hits = have.select(*CELL, F.col("k").alias("d1"), F.col("v").alias("v1")).join(singles, ["grp", "d1", "v1", "target"]).where(_sure())
    best = W.partitionBy("row_ord", "target").orderBy(F.desc("n_dom"), "d1")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*CELL, "value", "d1", F.lit("").alias("d2"), "v1", F.lit("").alias("v2"), "n_dom", F.lit(True).alias("sure"))


Tables = dict[str, DataFrame]


def _tables(long: DataFrame, names: DataFrame, relations: DataFrame, keys: DataFrame) -> Tables:
    """What every round reads, each written once."""
    encoded, others = name_evidence(names, long)
    return {"long": long, "names": names, "relations": kept(relations), "keys": kept(keys), "singles": kept(single_keys(long)), "encoded": kept(encoded), "others": kept(others)}


def _accepted(hits: DataFrame, tables: Tables) -> DataFrame:
    """Hits without a merchandising tag among their determinants that no name speaks against."""
    free = hits.where(~F.col("d1").isin(MERCH_TAGS) & ~F.col("d2").isin(MERCH_TAGS))
    against = name_guard(tables["names"], (tables["encoded"], tables["others"]), free.select("grp", "row_ord", F.col("target").alias("k"), F.col("value").alias("v")))
    return free.join(by_merge(against.select("row_ord", F.col("k").alias("target"))), ["row_ord", "target"], "left_anti")


def refined(hits: DataFrame, have: DataFrame, long: DataFrame) -> DataFrame:
    """(grp, row_ord, target, old, value, extra, scope, n_dom): a sharper key that changes the answer.

    One more known attribute joins the key of the hit.  Witnesses are the rows of
    the group, and where these change nothing the rows of all groups.  Counts are
    made for the attribute sets that are asked for, once for each group, and summed
    for all.
    """
    base = hits.select(*CELL, F.col("value").alias("old"), "d1", "d2", "v1", "v2")
    more = have.where(~F.col("k").isin(MERCH_TAGS)).select("row_ord", "target", F.col("k").alias("extra"), F.col("v").alias("ve"))
    probes = base.join(by_merge(more), ["row_ord", "target"]).where("extra <> d1 and extra <> d2")
    attrs = ["target", "d1", "d2", "extra"]
    sets = kept(probes.select(*attrs).distinct())
    cell = lambda k, v: by_merge(long.select("grp", "row_ord", F.col("k").alias(k), F.col("v").alias(v)))
    rows = long.select("grp", "row_ord", F.col("k").alias("target"), F.col("v").alias("value")).join(sets, "target").join(cell("d1", "v1"), ["grp", "row_ord", "d1"]).join(cell("extra", "ve"), ["grp", "row_ord", "extra"])
    rows = rows.join(cell("d2", "v2"), ["grp", "row_ord", "d2"], "left").where("d2 = '' or v2 is not null").withColumn("v2", F.coalesce("v2", F.lit("")))
    values = ["v1", "v2", "ve"]
    counts = kept(rows.groupBy("grp", *attrs, *values, "value").agg(F.count("*").alias("n"), F.min("row_ord").alias("first")))
    own = _dominant(counts, ["grp", *attrs, *values]).where(_sure())
    pooled = _dominant(counts.groupBy(*attrs, *values, "value").agg(F.sum("n").alias("n"), F.min("first").alias("first")), [*attrs, *values]).where(_sure())
    found = probes.join(own, ["grp", *attrs, *values]).withColumn("scope", F.lit("group")).unionByName(probes.join(pooled, [*attrs, *values]).withColumn("scope", F.lit("pooled")))
    best = W.partitionBy("row_ord", "target").orderBy("scope", F.desc("n_dom"), "extra")
    return found.where("value <> old").withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*CELL, "old", "value", "extra", "scope", "n_dom")


def _hits(cells: DataFrame, context: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(hits, have): accepted hits by relation or index, and what each cell's row knows by its turn."""
    have = kept(cells.join(by_merge(context), "row_ord").where("at < pos and k <> target").select(*CELL, "k", "v"))
    by_relation = kept(_accepted(_by_relations(have, tables["relations"], tables["keys"]).where("sure"), tables))
    left = have.join(by_merge(by_relation.select("row_ord", "target")), ["row_ord", "target"], "left_anti")
    by_index = _accepted(_by_index(left, tables["singles"]), tables)
    return kept(by_relation.withColumn("tier", F.lit("RELATION")).unionByName(by_index.withColumn("tier", F.lit("INDEX")))), have


def sharper_answers(cells: DataFrame, context: DataFrame, long: DataFrame, names: DataFrame, relations: DataFrame, keys: DataFrame) -> DataFrame:
    """``refined`` for cells with a finished context: what a sharper key changes, and what the answer was."""
    hits, have = _hits(cells, context, _tables(long, names, relations, keys))
    return refined(hits, have, long)


def _look_up(cells: DataFrame, context: DataFrame, tables: Tables) -> DataFrame:
    """(grp, row_ord, target, pos, value, tier, det, n_dom) of cells (grp, row_ord, target, pos); a null value: not found."""
    hits, have = _hits(cells, context, tables)
    sharp = refined(hits, have, tables["long"]).select("row_ord", "target", F.col("value").alias("sharp"), "extra", F.col("n_dom").alias("m"))
    det = F.concat_ws("+", "d1", F.when(F.col("d2") != "", F.col("d2")), "extra")
    out = hits.join(by_merge(sharp), ["row_ord", "target"], "left").select("row_ord", "target", F.coalesce("sharp", "value").alias("value"), F.when(F.col("sharp").isNotNull(), "REFINED").otherwise(F.col("tier")).alias("tier"), det.alias("det"), F.coalesce("m", "n_dom").alias("n_dom"))
    return cells.join(by_merge(out), ["row_ord", "target"], "left").select(*CELL, "pos", "value", "tier", "det", "n_dom")


def fill_cascade(cells: DataFrame, long: DataFrame, labels: DataFrame, names: DataFrame, relations: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, context): every open cell with its value or why it has none, and what each row knows in the end.

    ``cells`` are (grp, row_ord, target, pos), looked up by ``pos`` in each row.
    Known to a row are its cells, the ``labels`` (row_ord, k, v) that its name gives,
    and values found for its earlier cells, in this order.  A cell takes the first
    sure hit of the mined relations, unless a merchandising tag decides it or the
    name speaks against it; else the best single key, under the same conditions;
    then a sharper key where that changes the value.  Attributes that hold remarks
    are never filled (tier NOTE); merchandising tags are not asked for (tier TAG);
    what remains is for a question (tier ASK).
    """
    notes = note_attributes(long.withColumn("grp", F.lit(""))).select(F.col("k").alias("target"))
    tables = _tables(long, names, relations, keys)
    todo = kept(cells.join(notes, "target", "left_anti"))
    base = long.select("row_ord", "k", "v").withColumn("at", F.lit(-2))
    read = labels.select("row_ord", "k", "v").join(by_merge(base), ["row_ord", "k"], "left_anti").withColumn("at", F.lit(-1))
    fixed = kept(base.unionByName(read).join(by_merge(todo.select("row_ord").distinct()), "row_ord", "left_semi"))

    def context(found: DataFrame) -> DataFrame:
        own = found.where("value is not null").select("row_ord", F.col("target").alias("k"), F.col("value").alias("v"), F.col("pos").alias("at"))
        return fixed.unionByName(own.join(by_merge(fixed.select("row_ord", "k")), ["row_ord", "k"], "left_anti"))

    found = kept(_look_up(todo, fixed, tables))
    changed = kept(found.where("value is not null").groupBy("row_ord").agg(F.min("pos").alias("since")))
    while changed.head() is not None:
        again = todo.join(by_merge(changed), "row_ord").where("pos > since").drop("since")
        fresh = kept(_look_up(again, context(found), tables))
        old = found.select("row_ord", "target", F.col("value").alias("was"))
        changed = kept(fresh.join(by_merge(old), ["row_ord", "target"]).where("not value <=> was").groupBy("row_ord").agg(F.min("pos").alias("since")))
        found = kept(found.join(by_merge(fresh.select("row_ord", "target")), ["row_ord", "target"], "left_anti").unionByName(fresh))
    why = F.when(F.col("target").isin(MERCH_TAGS), "TAG").otherwise("ASK")
    done = found.withColumn("tier", F.coalesce("tier", why))
    skipped = cells.join(notes, "target", "left_semi").select(*CELL, "pos", *(F.lit(None).cast(t).alias(c) for c, t in (("value", "string"), ("tier", "string"), ("det", "string"), ("n_dom", "long")))).withColumn("tier", F.lit("NOTE"))
    return done.unionByName(skipped), context(found)


def question_rows(found: DataFrame, context: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """(key_hash, grp, target, context, row_ord): the bridge from questions to the rows they stand for.

    The context is the strongest relation whose determinants the row knew when the
    cell's turn came, else its name; cells of one group, target and context are one
    question.
    """
    cells = found.where("tier = 'ASK'").select(*CELL, "pos")
    have = cells.join(by_merge(context), "row_ord").where("at < pos and k <> target").select(*CELL, "k", "v")
    one = have.select(*CELL, F.col("k").alias("d1"), F.col("v").alias("v1")).join(relations.select("grp", "target", "d1", "d2", "rank"), ["grp", "target", "d1"])
    two = have.select("row_ord", "target", F.col("k").alias("d2"), F.col("v").alias("v2"))
    r = one.join(by_merge(two), ["row_ord", "target", "d2"], "left").where("d2 = '' or v2 is not null")
    text = F.concat("d1", F.lit("="), "v1", F.when(F.col("d2") != "", F.concat(F.lit("; "), "d2", F.lit("="), "v2")).otherwise(""))
    top = r.groupBy("row_ord", "target").agg(F.min_by(text, "rank").alias("context"))
    full = cells.join(by_merge(top), ["row_ord", "target"], "left").join(by_merge(names.select("row_ord", "name")), "row_ord").withColumn("context", F.coalesce("context", F.concat(F.lit("name="), "name")))
    return full.select(F.substring(F.sha1(F.concat_ws("|", "grp", "target", "context").cast("binary")), 1, 16).alias("key_hash"), "grp", "target", "context", "row_ord")


def questions(bridge: DataFrame) -> DataFrame:
    """One row for each question, with how many rows it stands for and the first."""
    return bridge.groupBy("key_hash", "grp", "target", "context").agg(F.count("*").alias("n_rows"), F.min("row_ord").alias("first_ord"))


def name_contradictions(bridge: DataFrame, answers: DataFrame, names: DataFrame, long: DataFrame) -> DataFrame:
    """Questions whose answer (key_hash, value) is contradicted by the name of any of their rows."""
    given = bridge.join(by_merge(answers.select("key_hash", "value")), "key_hash")
    against = name_guard(names, name_evidence(names, long), given.select("grp", "row_ord", F.col("target").alias("k"), F.col("value").alias("v")))
    return given.join(by_merge(against.select("row_ord", F.col("k").alias("target"), F.col("v").alias("value"))), ["row_ord", "target", "value"], "left_semi").select("key_hash").distinct()


def answered_cells(bridge: DataFrame, gated: DataFrame) -> DataFrame:
    """(grp, row_ord, k, value, source): accepted answers, and those kept for review, as cells of all their rows."""
    good = gated.where("reason is null or reason = 'REVIEW_OUT_OF_RANGE'").select("key_hash", "value")
    return bridge.join(by_merge(good), "key_hash").select("grp", "row_ord", F.col("target").alias("k"), "value", F.lit("model").alias("source"))
