"""Scans with roles, sinks, column profiles, change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X

ROLES = ["description", "leaf_name", "level1_name", "part_id", "part_number", "sku", "leaf_id", "leaf_depth", "level1_id"]
REQUIRED = ["description", "leaf_name", "level1_name"]


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """A parquet, csv (with header) or json table."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).csv(path)
    if kind == "json":
        return reader.json(path)
    raise ValueError(f"unknown kind {kind!r}: parquet, csv or json")


def with_roles(df: DataFrame, roles: dict[str, str], order: str | None = None) -> DataFrame:
    """Columns renamed to their roles; other columns stay.  Rows without identity (part id, else description) go.

    Without a part id a row gets ``row<n>`` by its order column; without one, by
    position within the scan's partitions (``monotonically_increasing_id``).
    """
    lacking = [r for r in REQUIRED if r not in roles]
    unknown = [c for c in roles.values() if c not in df.columns]
    if lacking or unknown:
        raise ValueError(f"roles without a column: {lacking}; columns the table lacks: {unknown}")
    back = {c: r for r, c in roles.items()}
    out = df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns])
    if "row_ord" not in out.columns:
        out = out.withColumn("row_ord", F.col(order).cast("long") if order else F.monotonically_increasing_id())
    out = out.where(F.col("part_id" if "part_id" in roles else "description").isNotNull())
    return out if "part_id" in roles else out.withColumn("part_id", F.concat(F.lit("row"), F.col("row_ord").cast("string")))


def with_review_columns(df: DataFrame, review: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every original column first and unchanged, review columns after."""
    return df.join(review.select(key, *columns), key, "left").select(*df.columns, *columns)


def write_partitioned(df: DataFrame, path: str, column: str = "level1_name") -> DataFrame:
    """One folder for each value (null: ``(none)``), named by slug; returns the manifest."""
    sliced = with_slug(df, column)
    sliced.write.partitionBy("slug").parquet(path)
    return manifest(df, column)


def with_slug(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("slug", X.safe_name(F.coalesce(F.col(column), F.lit("(none)"))))


def manifest(df: DataFrame, column: str = "level1_name") -> DataFrame:
    return with_slug(df, column).groupBy(F.coalesce(F.col(column), F.lit("(none)")).alias(column), "slug").agg(F.count("*").alias("n_rows"))


def profile(df: DataFrame) -> DataFrame:
    """(name, n_null, n_distinct, mean_length, digit_share, colon_share) of every column, in one pass.

    Distinct counts are approximate (relative error 1 %).
    """
    one = []
    for c in df.columns:
        s = F.col(c).cast("string")
        one += [F.count_if(s.isNull()).alias(f"{c}|n_null"), F.approx_count_distinct(s, 0.01).alias(f"{c}|n_distinct"), F.avg(F.length(s)).alias(f"{c}|mean_length"), F.avg(s.rlike("[0-9]").cast("int")).alias(f"{c}|digit_share"), F.avg(s.contains(":").cast("int")).alias(f"{c}|colon_share")]
    wide = df.agg(*one)
    stats = ["n_null", "n_distinct", "mean_length", "digit_share", "colon_share"]
    rows = [wide.select(F.lit(c).alias("name"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in df.columns]
    return reduce(DataFrame.unionByName, rows)


def suggest_roles(profiled: DataFrame, max_level1: int = 50) -> DataFrame:
    """(role, name): long text with digits is the description, few values level 1, more values without digits the leaf."""
    p = profiled.where("mean_length > 0")
    first = lambda df, order: df.withColumn("_r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))).where("_r = 1").select("name")  # noqa: E731  a row for each column
    desc = first(p.where("colon_share < 0.5 and n_distinct > 50"), [F.desc("mean_length"), "n_null", "name"]).withColumn("role", F.lit("description"))
    words = p.where("digit_share < 0.2")
    level1 = first(words.where((F.col("n_distinct") > 1) & (F.col("n_distinct") <= max_level1)), ["n_distinct", "n_null", "name"]).withColumn("role", F.lit("level1_name"))
    leaf = first(words.where("n_distinct > 1").join(level1.select("name"), "name", "left_anti"), [F.desc("n_distinct"), "n_null", "name"]).withColumn("role", F.lit("leaf_name"))
    return desc.unionByName(level1).unionByName(leaf).select("role", "name")


def assert_content(df: DataFrame, column: str, order: str, rows: int = 200, share: float = 0.5) -> DataFrame:
    """Whether enough of the first nonblank values look like ``Key: Value`` (a sample by design)."""
    s = df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").orderBy(order).limit(rows).agg(F.count("*").alias("n"), F.avg(F.col(column).contains(":").cast("int")).alias("s"))
    return s.select(F.col("n").alias("n_values"), (F.coalesce("s", F.lit(0.0)) >= share).alias("passed"))


def wide_to_long(df: DataFrame, ids: list[str], specs: list[str]) -> DataFrame:
    """(ids, label, value) of nonblank spec cells."""
    cells = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in specs]).unpivot(ids, specs, "label", "value")
    return cells.where(F.trim(F.coalesce("value", F.lit(""))) != "")


def biggest(df: DataFrame, column: str) -> DataFrame:
    """Rows of the sheet that has most rows; ties by name."""
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(1)
    return df.join(F.broadcast(top.select(column)), column, "left_semi")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows, xor and sum of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("s"))


def changed(now: DataFrame, stored: DataFrame) -> DataFrame:
    """RECOMPUTE unless the fingerprint is stored unchanged with a non-empty output."""
    return now.join(stored.select("n_rows", "x", "s", "output_rows"), ["n_rows", "x", "s"], "left").select("n_rows", F.when(F.coalesce("output_rows", F.lit(0)) > 0, "REUSE").otherwise("RECOMPUTE").alias("action"))
