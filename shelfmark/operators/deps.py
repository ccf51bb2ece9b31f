"""Lookup from the table itself: functional dependencies, single-key indexes, questions that remain.

All work is on the long table (grp, row_ord, k, v).  Dependencies multiply by
pairs of attributes, so the attribute pool of a group is bounded before the
join, and counts are partial aggregates of small integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators.steps import by_merge

# Merchandising tags; they determine nothing and are never asked for.
MERCH_TAGS = ["Ngành Hàng", "Brand of Group Home", "Original"]


def not_merchandising(long: DataFrame, column: str = "k") -> DataFrame:
    return long.where(~F.col(column).isin(MERCH_TAGS))


def attribute_pool(long: DataFrame, min_rows: int = 8, min_cover: float = 0.2, top: int = 14) -> DataFrame:
    """(grp, k, rows, cover) of the attributes worth pairing: frequent ones, at most ``top`` for each group."""
    sizes = long.groupBy("grp").agg(F.count_distinct("row_ord").alias("group_rows"))
    counts = long.groupBy("grp", "k").agg(F.count("*").alias("rows")).join(sizes, "grp").withColumn("cover", F.col("rows") / F.col("group_rows"))
    good = counts.where((F.col("rows") >= min_rows) & (F.col("cover") >= min_cover))
    return good.withColumn("_r", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("rows"), "k"))).where(F.col("_r") <= top).select("grp", "k", "rows", "cover")


def dependency_keys(long: DataFrame, pool: DataFrame) -> DataFrame:
    """(grp, d1, d2, target, v1, v2, value, n_dom, n_tot): the dominant target value of each key."""
    rows = long.join(pool.select("grp", "k"), ["grp", "k"]).select("grp", "row_ord", "k", "v")
    a = rows.select("grp", "row_ord", F.col("k").alias("d1"), F.col("v").alias("v1"))
    b = rows.select("grp", "row_ord", F.col("k").alias("d2"), F.col("v").alias("v2"))
    t = rows.select("grp", "row_ord", F.col("k").alias("target"), F.col("v").alias("value"))
    one = a.join(by_merge(t), ["grp", "row_ord"]).where("d1 <> target").selectExpr("grp", "row_ord", "d1", "'' as d2", "v1", "'' as v2", "target", "value")
    two = a.join(by_merge(b), ["grp", "row_ord"]).where("d1 < d2").join(by_merge(t), ["grp", "row_ord"]).where("d1 <> target and d2 <> target").select("grp", "row_ord", "d1", "d2", "v1", "v2", "target", "value")
    key = ["grp", "d1", "d2", "target", "v1", "v2"]
    counts = one.unionByName(two).groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("row_ord").alias("first"))
    by = W.partitionBy(*key)
    ranked = counts.withColumns({"n_tot": F.sum("n").over(by), "_r": F.row_number().over(by.orderBy(F.desc("n"), "first"))})
    return ranked.where("_r = 1").select(*key, "value", F.col("n").alias("n_dom"), "n_tot")


def mine_dependencies(long: DataFrame, pool: DataFrame, keys: DataFrame, min_support: int = 8, min_consistency: float = 0.85, keep: int = 8) -> DataFrame:
    """(grp, target, d1, d2, support, consistency, usable, rank): the best relations of each target."""
    covers = pool.select("grp", "k", "cover")
    rel = keys.groupBy("grp", "target", "d1", "d2").agg(F.sum("n_tot").alias("support"), (F.sum("n_dom") / F.sum("n_tot")).alias("consistency"))
    rel = rel.where((F.col("support") >= min_support) & (F.col("consistency") >= min_consistency))
    rel = rel.join(covers.select("grp", F.col("k").alias("d1"), F.col("cover").alias("c1")), ["grp", "d1"]).join(covers.select("grp", F.col("k").alias("d2"), F.col("cover").alias("c2")), ["grp", "d2"], "left")
    usable = F.least("c1", F.coalesce("c2", "c1"))
    best = W.partitionBy("grp", "target").orderBy(F.desc(F.bround(usable * F.col("consistency"), 9)), F.when(F.col("d2") == "", 1).otherwise(2), F.desc("support"), "d1", "d2")
    return rel.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep).select("grp", "target", "d1", "d2", "support", F.bround("consistency", 6).alias("consistency"), F.bround(usable, 6).alias("usable"), "rank")


def minority_report(long: DataFrame, pool: DataFrame) -> DataFrame:
    """Single-determinant keys with several values: every value that is not the dominant one."""
    rows = long.join(pool.select("grp", "k"), ["grp", "k"])
    a = rows.select("grp", "row_ord", F.col("k").alias("d1"), F.col("v").alias("v1"))
    t = rows.select("grp", "row_ord", F.col("k").alias("target"), F.col("v").alias("value"))
    key = ["grp", "d1", "target", "v1"]
    counts = a.join(t, ["grp", "row_ord"]).where("d1 <> target").groupBy(*key, "value").agg(F.count("*").alias("n"), F.min("row_ord").alias("first"))
    best = W.partitionBy(*key).orderBy(F.desc("n"), "first")
    return counts.withColumns({"_r": F.row_number().over(best), "dominant": F.first("value").over(best), "n_dominant": F.first("n").over(best)}).where("_r > 1").select(*key, "value", "n", "dominant", "n_dominant")


def trusted_lookup(asks: DataFrame, long: DataFrame, relations: DataFrame, keys: DataFrame, min_rows: int = 3, purity: float = 0.95) -> DataFrame:
    """For (grp, row_ord, target): the value of the first relation in rank order that can be trusted, else the first weak hit."""
    have = long.select("grp", "row_ord", "k", "v")
    one = asks.join(relations, ["grp", "target"]).join(have.select("grp", "row_ord", F.col("k").alias("d1"), F.col("v").alias("v1")), ["grp", "row_ord", "d1"])
    two = one.join(have.select("grp", "row_ord", F.col("k").alias("d2"), F.col("v").alias("v2")), ["grp", "row_ord", "d2"], "left").where("d2 = '' or v2 is not null").withColumn("v2", F.coalesce("v2", F.lit("")))
    hits = two.join(keys, ["grp", "d1", "d2", "target", "v1", "v2"]).withColumn("ok", (F.col("n_dom") >= min_rows) & (F.col("n_dom") >= purity * F.col("n_tot")))
    best = W.partitionBy("grp", "row_ord", "target").orderBy(F.desc("ok"), "rank")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("grp", "row_ord", "target", "value", "d1", "d2", "n_dom", "n_tot", F.when(F.col("ok"), "TRUSTED").otherwise("WEAK").alias("grade"))


def index_lookup(asks: DataFrame, long: DataFrame, keys: DataFrame, min_rows: int = 3, purity: float = 0.95) -> DataFrame:
    """Single-key lookup over everything a row knows: the value with the most witnesses."""
    single = keys.where((F.col("d2") == "") & (F.col("n_dom") >= min_rows) & (F.col("n_dom") >= purity * F.col("n_tot")))
    known = long.select("grp", "row_ord", F.col("k").alias("d1"), F.col("v").alias("v1"))
    hits = asks.join(known, ["grp", "row_ord"]).join(single, ["grp", "d1", "v1", "target"])
    best = W.partitionBy("grp", "row_ord", "target").orderBy(F.desc("n_dom"), "d1")
    return hits.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("grp", "row_ord", "target", "value", "d1", "n_dom", "n_tot")


def note_attributes(long: DataFrame, min_values: int = 5) -> DataFrame:
    """Attributes that hold remarks (long, mostly without digits): never inferred."""
    v = long.select("grp", "k", "v").distinct()
    words = F.size(F.filter(F.split("v", r"\s+"), lambda w: w != ""))
    out = v.groupBy("grp", "k").agg(F.count("*").alias("n_values"), F.avg((words >= 4).cast("int")).alias("wordy"), F.avg((~F.col("v").rlike("[0-9]")).cast("int")).alias("digitless"))
    return out.where((F.col("n_values") >= min_values) & (F.col("wordy") >= 0.5) & (F.col("digitless") >= 0.5)).select("grp", "k", "n_values")


def labels_from_names(names: DataFrame, long: DataFrame) -> DataFrame:
    """For attributes a row lacks: the one value of its group that stands in its name as whole words (context only).

    (grp, word run) pairs are joined by the value's first word, so a value meets
    only names that hold that word.
    """
    pad = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    vocab = long.select("grp", "k", "v").distinct().withColumn("w", F.split(F.lower("v"), " ")[0])
    words = names.select("grp", "row_ord", "name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("w"))
    hits = by_merge(words).join(vocab, ["grp", "w"]).where(pad(F.col("name")).contains(pad(F.col("v")))).join(by_merge(long.select("grp", "row_ord", "k")), ["grp", "row_ord", "k"], "left_anti")
    return hits.groupBy("grp", "row_ord", "k").agg(F.count_distinct("v").alias("n"), F.min("v").alias("v")).where("n = 1").drop("n")


def name_evidence(names: DataFrame, long: DataFrame, min_rows: int = 10, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Attributes that are written in names, over all groups, and all values (base, other, lead) of base attributes."""
    written = F.lower("name").contains(F.lower("v")).cast("int")
    encoded = long.join(by_merge(names.select("row_ord", "name")), "row_ord").groupBy("k").agg(F.count("*").alias("n"), F.avg(written).alias("s")).where((F.col("n") >= min_rows) & (F.col("s") >= share)).select("k")
    return encoded, long.select(X.base_attr(F.col("k")).alias("base"), F.col("v").alias("other"), F.substring(F.lower("v"), 1, 3).alias("lead")).distinct()


def name_guard(names: DataFrame, evidence: tuple[DataFrame, DataFrame], candidates: DataFrame) -> DataFrame:
    """Candidate values to reject: the attribute is written in names, this value is not in the name, and another one of its base attribute is.

    A value meets only the names that hold its first three characters.
    """
    encoded, others = evidence
    inside = lambda v: F.lower("name").contains(F.lower(v))
    starts = lambda name: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.substr(name, i, n)))))
    c = candidates.join(encoded, "k").join(by_merge(names.select("row_ord", "name")), "row_ord").where(~inside("v"))
    c = c.select("grp", "row_ord", "k", "v", "name", X.base_attr(F.col("k")).alias("base"), F.explode(starts(F.lower("name"))).alias("lead"))
    return c.join(others, ["base", "lead"]).where((F.col("other") != F.col("v")) & inside("other")).groupBy("grp", "row_ord", "k", "v").agg(F.min("other").alias("in_name"))


def asks(open_cells: DataFrame, long: DataFrame, relations: DataFrame, names: DataFrame) -> DataFrame:
    """Unique questions: (grp, target, context) with the rows they stand for; the context is the strongest
    relation whose determinants the row knows, else the name."""
    have = long.select("grp", "row_ord", "k", "v")
    r = open_cells.join(relations, ["grp", "target"]).join(have.select("grp", "row_ord", F.col("k").alias("d1"), F.col("v").alias("v1")), ["grp", "row_ord", "d1"])
    r = r.join(have.select("grp", "row_ord", F.col("k").alias("d2"), F.col("v").alias("v2")), ["grp", "row_ord", "d2"], "left").where("d2 = '' or v2 is not null")
    text = F.concat("d1", F.lit("="), "v1", F.when(F.col("d2") != "", F.concat(F.lit("; "), "d2", F.lit("="), "v2")).otherwise(""))
    top = r.withColumn("_r", F.row_number().over(W.partitionBy("grp", "row_ord", "target").orderBy("rank"))).where("_r = 1").select("grp", "row_ord", "target", text.alias("context"))
    full = open_cells.join(top, ["grp", "row_ord", "target"], "left").join(names, ["grp", "row_ord"])
    keyed = full.select("grp", "row_ord", "target", F.coalesce("context", F.concat(F.lit("name="), "name")).alias("context"))
    return keyed.groupBy("grp", "target", "context").agg(F.count("*").alias("n_rows"), F.min("row_ord").alias("first_ord")).withColumn("key_hash", F.substring(F.sha1(F.concat_ws("|", "grp", "target", "context").cast("binary")), 1, 16))


def vocabulary(long: DataFrame, max_enum: int = 40, measures: float = 0.8) -> DataFrame:
    """(grp, k, kind, n_values): enum where there are few values that are no measures, else format."""
    v = long.select("grp", "k", "v").distinct()
    out = v.groupBy("grp", "k").agg(F.count("*").alias("n_values"), F.avg(X.measure(F.col("v")).isNotNull().cast("int")).alias("m"))
    return out.select("grp", "k", F.when((F.col("m") < measures) & (F.col("n_values") <= max_enum), "enum").otherwise("format").alias("kind"), "n_values")


def vocabulary_values(long: DataFrame, vocab: DataFrame, examples: int = 10) -> DataFrame:
    """Values shown with a question: all of an enum, the first examples of a format."""
    v = long.select("grp", "k", "v").distinct().join(vocab, ["grp", "k"])
    ranked = v.withColumn("_r", F.row_number().over(W.partitionBy("grp", "k").orderBy("v"))).where((F.col("kind") == "enum") | (F.col("_r") <= examples))
    return ranked.groupBy("grp", "k", "kind").agg(F.array_sort(F.collect_list("v")).alias("values"))


def vocabulary_for(questions: DataFrame, long: DataFrame, max_enum: int = 40, examples: int = 10) -> DataFrame:
    """(key_hash, kind, values, scope): the values shown with each question.

    Those of its group and attribute, else, where the group has none, those of the
    attribute in all groups.
    """
    own = vocabulary_values(long, vocabulary(long, max_enum), examples).select("grp", F.col("k").alias("target"), F.struct("kind", "values").alias("own"))
    pooled = long.withColumn("grp", F.lit(""))
    wide = vocabulary_values(pooled, vocabulary(pooled, max_enum), examples).select(F.col("k").alias("target"), F.struct("kind", "values").alias("wide"))
    both = questions.select("key_hash", "grp", "target").join(own, ["grp", "target"], "left").join(wide, "target", "left").withColumn("v", F.coalesce("own", "wide")).where("v is not null")
    return both.select("key_hash", "v.kind", "v.values", F.when(F.col("own").isNotNull(), "group").otherwise("attribute").alias("scope"))


def standard_slug(value):
    """A standard's name as its reference table is filed: lower case, dashes and runs of space as one space."""
    return F.trim(F.regexp_replace(F.lower(value), r"[\s-]+", " "))


def with_standard(questions: DataFrame, known: DataFrame, standards: DataFrame, attribute: str = "Standard") -> DataFrame:
    """Questions of which a row's known standard (cells (row_ord, k, v) of an attribute of that base name) has a reference table."""
    named = known.where(X.base_attr(F.col("k")) == attribute).select(F.col("row_ord").alias("first_ord"), standard_slug(F.col("v")).alias("slug"))
    have = standards.select(standard_slug(F.col("standard")).alias("slug")).distinct()
    return questions.join(named.join(have, "slug", "left_semi").select("first_ord").distinct(), "first_ord", "left_semi")


def open_asks(questions: DataFrame, answers: DataFrame, retry_empty: bool = False) -> DataFrame:
    """Questions without an answer; blank answers count as none where asked to retry."""
    done = answers.where(F.trim(F.coalesce("value", F.lit(""))) != "") if retry_empty else answers
    return questions.join(done.select("key_hash"), "key_hash", "left_anti")


def ask_batches(questions: DataFrame, size: int = 25) -> DataFrame:
    """Questions dealt by group, sorted by attribute, in batches of a fixed size."""
    w = W.partitionBy("grp").orderBy("target", "first_ord", "key_hash")
    return questions.withColumn("_n", F.row_number().over(w)).select("key_hash", "grp", "target", F.floor((F.col("_n") - 1) / size).cast("int").alias("batch")).withColumn("n_batch", F.count("*").over(W.partitionBy("grp", "batch")))


def validation_report(questions: DataFrame, answers: DataFrame, values: DataFrame) -> DataFrame:
    """Status of every answer against the vocabulary."""
    v = values.select("grp", F.col("k").alias("target"), "kind", "values")
    out = questions.join(answers.select("key_hash", "value"), "key_hash").join(v, ["grp", "target"], "left")
    return out.select("key_hash", "grp", "target", "value", "n_rows", X.validate(F.col("value"), F.col("kind"), F.col("values")).alias("status"))
