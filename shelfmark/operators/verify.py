"""The merge of answers, gates and review: judges, priorities, neighbours (curves are in ``curves``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators.steps import by_merge


def points(long: DataFrame, x_attr: str, y_attr: str) -> DataFrame:
    """Distinct (grp, x, y) of rows that have both attributes as numbers; attributes by base name."""
    base = long.withColumn("b", X.base_attr(F.col("k")))
    x = base.where(F.col("b") == x_attr).select("grp", "row_ord", X.axis(F.col("v")).alias("x")).where("x is not null")
    y = base.where(F.col("b") == y_attr).select("grp", "row_ord", X.measure(F.col("v")).alias("y")).where("y is not null")
    return x.join(y, ["grp", "row_ord"]).select("grp", "x", "y").distinct()


def _axis(values: DataFrame, at: DataFrame, stats: list[str]) -> DataFrame:
    """Rows of ``at`` (grp, x, stats) and the other x of ``values``, where the stats are null."""
    other = values.where("x is not null").select("grp", "x").distinct().join(at.select("grp", "x"), ["grp", "x"], "left_anti")
    return at.unionByName(other.select("grp", "x", *[F.lit(None).cast("double").alias(c) for c in stats]))


def merge_judges(answers: DataFrame) -> DataFrame:
    """One value for each key: kept with its least confidence where judges agree, dropped where they differ."""
    out = answers.groupBy("key_hash").agg(F.count_distinct("value").alias("opinions"), F.min("value").alias("value"), F.min("confidence").alias("confidence"))
    return out.select("key_hash", F.when(F.col("opinions") == 1, F.col("value")).alias("value"), "confidence", (F.col("opinions") > 1).alias("disagree"))


PRIORITY = {"rule": 1, "corpus": 2, "model": 3}


def merge_sources(fills: DataFrame, present: DataFrame, valid: DataFrame) -> DataFrame:
    """Fills (row_ord, grp, k, value, source) by priority; existing cells are never overwritten, keys the group lacks are refused."""
    rank = reduce(lambda c, kv: c.when(F.col("source") == kv[0], kv[1]), PRIORITY.items(), F.when(F.lit(False), 0)).otherwise(9)
    ok = fills.join(by_merge(present.select("row_ord", "k")), ["row_ord", "k"], "left_anti").join(valid.select("grp", "k").distinct(), ["grp", "k"], "left_semi")
    best = W.partitionBy("row_ord", "k").orderBy("_p", "value")
    return ok.withColumn("_p", rank).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("row_ord", "grp", "k", "value", "source")


def answer_gates(merged: DataFrame, contradicted: DataFrame, name_conflicts: DataFrame, out_of_range: DataFrame, min_confidence: float = 0.8) -> DataFrame:
    """Why an answer is dropped, or that it is kept for review; null reason: accepted."""
    flag = lambda df, c: by_merge(df.select("key_hash", F.lit(True).alias(c)).distinct())
    out = merged.join(flag(contradicted, "_c"), "key_hash", "left").join(flag(name_conflicts, "_n"), "key_hash", "left").join(flag(out_of_range, "_o"), "key_hash", "left")
    reason = (
        F.when(F.col("disagree"), "JUDGES_DISAGREE").when(F.trim(F.coalesce("value", F.lit(""))) == "", "BLANK").when(F.col("confidence") < min_confidence, "LOW_CONFIDENCE")
        .when(F.col("_c"), "SELF_CONTRADICTION").when(F.col("_n"), "NAME_CONTRADICTS").when(F.col("_o"), "REVIEW_OUT_OF_RANGE")
    )
    return out.select("key_hash", "value", "confidence", reason.alias("reason"))


def row_confidence(rows: DataFrame, fills: DataFrame, trouble: DataFrame) -> DataFrame:
    """REVIEW where something is open or flagged; HIGH where every fill is from rules or the table; else MEDIUM."""
    f = fills.groupBy("row_ord").agg(F.bool_and(F.col("source").isin("rule", "corpus")).alias("safe"))
    out = rows.select("row_ord").join(f, "row_ord", "left").join(trouble.select("row_ord", F.lit(True).alias("bad")).distinct(), "row_ord", "left")
    return out.select("row_ord", F.when(F.col("bad"), "REVIEW").when(F.coalesce("safe", F.lit(True)), "HIGH").otherwise("MEDIUM").alias("confidence"))


def output_checks(source: DataFrame, output: DataFrame, columns: list[str], long: DataFrame) -> DataFrame:
    """(check_name, failed): row count, original columns unchanged, no identical pair twice in a row."""
    a = source.select("row_ord", F.xxhash64(*columns).alias("h"))
    b = output.select("row_ord", F.xxhash64(*columns).alias("g"))
    both = a.join(b, "row_ord", "full_outer").agg(F.count_if(F.col("h").isNull() | F.col("g").isNull()).alias("row_count"), F.count_if(F.col("h") != F.col("g")).alias("original_columns"))
    twice = long.groupBy("row_ord", "k", "v").count().where("count > 1").agg(F.count("*").alias("identical_pairs"))
    return both.crossJoin(twice).unpivot([], ["row_count", "original_columns", "identical_pairs"], "check_name", "failed")  # one row each


def neighbours(values: DataFrame, pts: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` nearest curve points of each value, by distance on the axis, then by x and y.

    Points are numbered along the axis both ways; a value takes the next n of
    either numbering, and the n nearest of these.
    """
    up, down = W.partitionBy("grp").orderBy("x", "y"), W.partitionBy("grp").orderBy(F.desc("x"), "y")
    numbered = pts.withColumns({"up": F.row_number().over(up), "down": F.row_number().over(down)})
    at = pts.groupBy("grp", "x").agg(F.count("*").cast("double").alias("c"))
    before = W.partitionBy("grp").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    axis = _axis(values, at, ["c"]).withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0.0)).cast("int"))
    total = pts.groupBy("grp").agg(F.count("*").cast("int").alias("total"))
    v = values.where("x is not null").select("grp", "row_ord", "x").join(axis.select("grp", "x", "below"), ["grp", "x"]).join(total, "grp").withColumnRenamed("x", "x0")
    steps = F.explode(F.sequence(F.lit(1), F.lit(n)))
    above = v.select("grp", "row_ord", "x0", "below", steps.alias("i")).select("grp", "row_ord", "x0", (F.col("below") + F.col("i")).alias("up")).join(numbered.select("grp", "up", "x", "y"), ["grp", "up"])
    under = v.select("grp", "row_ord", "x0", (F.col("total") - F.col("below")).alias("rest"), steps.alias("i")).select("grp", "row_ord", "x0", (F.col("rest") + F.col("i")).alias("down")).join(numbered.select("grp", "down", "x", "y"), ["grp", "down"])
    near = above.drop("up").unionByName(under.drop("down")).withColumn("dist", F.abs(F.col("x") - F.col("x0")))
    w = W.partitionBy("grp", "row_ord").orderBy("dist", "x", "y")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("grp", "row_ord", "rank", "x", "y", "dist")


def review_order(cells: DataFrame) -> DataFrame:
    """Difficulty by missing evidence (reference, neighbours, standard), hardest and widest first."""
    missing = (~F.col("has_reference")).cast("int") + (~F.col("has_neighbours")).cast("int") + (~F.col("has_standard")).cast("int")
    rank = F.row_number().over(W.partitionBy("grp").orderBy(F.desc("difficulty"), F.desc("n_rows"), "key_hash"))
    return cells.withColumn("difficulty", missing).withColumn("rank", rank)


def standards_available(long: DataFrame, standards: DataFrame) -> DataFrame:
    """Rows that name a standard, and whether its reference table is at hand ."""
    s = long.where(X.base_attr(F.col("k")) == "Standard").select("row_ord", F.col("v").alias("standard"))
    return s.join(standards.select("standard").distinct().withColumn("available", F.lit(True)), "standard", "left").select("row_ord", "standard", F.coalesce("available", F.lit(False)).alias("available"))
