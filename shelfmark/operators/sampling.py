"""Repeatable samples, held-out answer keys and scores.  All draws rank by a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators.scan import running_sum


def draw(seed: str, *keys: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *[X.text(k) for k in keys])).cast("binary"))


def sample_rows(df: DataFrame, n: int, seed: str, key: str = "part_id") -> DataFrame:
    """``n`` rows, the same for the same seed; all if there are fewer (order columns stay for the caller)."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(n)


def sample_groups(df: DataFrame, n: int, seed: str, group: str) -> DataFrame:
    """Whole groups in drawn order until there are ``n`` rows."""
    sizes = df.groupBy(group).agg(F.count("*").alias("c"))
    taken = running_sum(sizes, "c", draw(seed, F.col(group)), group).where(F.col("before") < n)
    return df.join(taken.select(group), group, "left_semi")


def sample_round_robin(df: DataFrame, n: int, group: str, cluster: str) -> DataFrame:
    """Whole clusters, the largest of each group in turn, until there are ``n`` rows."""
    sizes = df.groupBy(group, cluster).agg(F.count("*").alias("c"), F.min("row_ord").alias("f"))
    first = F.min("f").over(W.partitionBy(group))
    ranked = sizes.withColumns({"g": first, "r": F.row_number().over(W.partitionBy(group).orderBy(F.desc("c"), "f"))})
    taken = running_sum(ranked, "c", "r", "g", group).where(F.col("before") < n)
    return df.join(taken.select(group, cluster), [group, cluster], "left_semi")


def blank_cells(df: DataFrame, n: int, seed: str, column: str, key: str = "part_id") -> tuple[DataFrame, DataFrame]:
    """The table with ``n`` nonblank cells emptied, and the answers."""
    full = df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")
    answers = sample_rows(full, n, seed, key).select(key, F.col(column).alias("truth"))
    out = df.join(answers, key, "left").withColumn(column, F.when(F.col("truth").isNull(), F.col(column))).drop("truth")
    return out, answers


def misassign(df: DataFrame, n: int, seed: str, column: str, key: str = "part_id") -> tuple[DataFrame, DataFrame]:
    """The table with ``n`` values replaced by other values of the column, and the answers."""
    values = df.select(F.col(column).alias("wrong")).where("wrong is not null").distinct()
    values = values.withColumn("at", F.row_number().over(W.orderBy("wrong")) - 1)  # distinct values only
    count = values.agg(F.count("*").alias("m"))
    picked = sample_rows(df, n, seed, key).select(key, F.col(column).alias("truth")).crossJoin(count).where("m >= 2")  # one row
    picked = picked.join(values.select(F.col("wrong").alias("truth"), F.col("at").alias("own")), "truth", "left")
    others = F.col("m") - F.col("own").isNotNull().cast("int")
    number = F.conv(F.substring(draw(seed, F.col(key), F.lit("value")), 1, 8), 16, 10).cast("long") % others
    at = number + F.coalesce((number >= F.col("own")).cast("int"), F.lit(0))  # the own value is passed over
    answers = picked.withColumn("at", at.cast("int")).join(values, "at").select(key, "truth", "wrong")
    out = df.join(answers, key, "left").withColumn(column, F.coalesce("wrong", column)).drop("truth", "wrong")
    return out, answers


def detection_score(answers: DataFrame, log: DataFrame, rows: DataFrame, key: str = "part_id") -> DataFrame:
    """Caught, missed, false alarms over intact rows, and suggestions that restore the original."""
    both = rows.select(key).join(answers, key, "left").join(log.select(key, "new_leaf_name", F.lit(True).alias("hit")), key, "left")
    hit, seeded = F.coalesce("hit", F.lit(False)), F.col("truth").isNotNull()
    return both.agg(F.count_if(seeded & hit).alias("caught"), F.count_if(seeded & ~hit).alias("missed"), F.count_if(~seeded & hit).alias("false_alarms"), F.count_if(~seeded).alias("intact"), F.count_if(seeded & (F.col("new_leaf_name") == F.col("truth"))).alias("restored"))


def holdout_score(truth: DataFrame, fills: DataFrame, later: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """identical (but for space and case), same measure, different or blank, for each held-out (part_id, k).

    What ``later`` holds for a cell, blank or not, stands over ``fills``.  With
    ``rows`` given, cells of part_ids that have no row there are ``no_row``: they
    were never delivered, which is no answer of the fill.
    """
    if later is not None:
        old, new = fills.select("part_id", "k", "v"), later.select("part_id", "k", F.col("v").alias("_v"), F.lit(True).alias("_later"))
        fills = old.join(new, ["part_id", "k"], "full").select("part_id", "k", F.when(F.col("_later"), F.col("_v")).otherwise(F.col("v")).alias("v"))
    norm = lambda c: F.lower(F.regexp_replace(X.text(c), r"\s+", ""))
    both = truth.join(fills.select("part_id", "k", F.col("v").alias("got")), ["part_id", "k"], "left")
    there = F.lit(True)
    if rows is not None:
        both = both.join(rows.select("part_id", F.lit(True).alias("_row")).distinct(), "part_id", "left")
        there = F.col("_row").isNotNull()
    bin_ = F.when(~there, "no_row").when(norm(F.col("got")) == "", "blank").when(norm(F.col("got")) == norm(F.col("v")), "identical").when(X.measure(F.col("got")) == X.measure(F.col("v")), "same_measure").otherwise("different")
    return both.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def judge_score(truth: DataFrame, answers: DataFrame, tolerance: float = 0.011) -> DataFrame:
    """Right, blank and wrong numeric answers of each judge."""
    both = answers.join(truth, "key")
    got = X.number(F.col("value"))
    right = F.abs(got - F.col("truth")) < tolerance
    return both.groupBy("judge").agg(F.count_if(right).alias("n_right"), F.count_if(got.isNull()).alias("n_blank"), F.count_if(got.isNotNull() & ~right).alias("n_wrong"))
