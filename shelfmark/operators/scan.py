"""Ranks and running sums along an order of all rows, without one task for all of them.

Rows are dealt by ranges of the order and numbered inside each range; what comes
before a range is the sum over the ranges before it, a table of one row for each
range.  The numbered rows are written first, so a range that has to be computed
again cannot be cut elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.operators.steps import kept


def _ranged(df: DataFrame, order: tuple[Column | str, ...]) -> DataFrame:
    """All columns plus the range ``_p`` and the row's place ``_i`` in it."""
    rows = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumns({"_p": F.shiftright("_id", 33), "_i": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")


def _before(ranges: DataFrame) -> DataFrame:
    """(_p, _b): what the ranges before each one hold; one row for each range."""
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(ranges.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_b")))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """All columns plus ``position``, from 0 along the order; ties in any order, but fixed."""
    rows = _ranged(df, order)
    sizes = rows.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    return rows.join(_before(sizes), "_p").withColumn("position", F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def running_sum(df: DataFrame, value: str, *order: Column | str) -> DataFrame:
    """All columns plus ``before``: the sum of ``value`` over all earlier rows of the order."""
    rows = _ranged(df, order)
    own = F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("_p").agg(F.sum(value).alias("_n"))
    return rows.withColumn("_o", own).join(_before(sums), "_p").withColumn("before", F.col("_b") + F.col("_o")).drop("_p", "_i", "_b", "_o")
