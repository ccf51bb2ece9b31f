"""Price-list data: groups, order codes, prices, splits, cards, knowledge base, lint.

Rows carry (file, sheet, row_ord); group keys come from runs of consecutive rows
of one sheet, so windows are partitioned by file and sheet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X

# Limits of a card.
TITLE_MAX, LINES_MAX, LINE_MAX, NOTE_MAX, LARGE_GROUP = 40, 5, 28, 110, 40
EMPTY_MARKERS = ["N/A", "n/a", "-", "--", "NA"]


def runs(df: DataFrame) -> DataFrame:
    """grp_run: a new number whenever the name changes between consecutive rows of a sheet."""
    w = W.partitionBy("sheet").orderBy("row_ord")
    new = F.coalesce(~F.col("name").eqNullSafe(F.lag("name").over(w)) | F.lag("row_ord").over(w).isNull(), F.lit(True))
    return df.withColumn("_n", new.cast("int")).withColumn("grp_run", F.sum("_n").over(w)).drop("_n")


def order_codes(df: DataFrame) -> DataFrame:
    """order_code, and for repeats the row of the first one."""
    out = df.withColumn("order_code", X.norm_order_code(F.col("order_raw")))
    first = out.where("order_code is not null").groupBy("order_code").agg(F.min("row_ord").alias("_first"))
    return out.join(first, "order_code", "left").select(*out.columns, F.when(F.col("_first") < F.col("row_ord"), F.col("_first")).alias("dup_of"))


def prices(df: DataFrame) -> DataFrame:
    """price (half-even rounded) and a warning where it is missing or no number."""
    raw = F.trim(F.col("price_raw"))
    n = raw.try_cast("double")
    return df.withColumn("price", F.bround(n, 0).cast("long")).withColumn("price_warning", F.when(F.coalesce(raw, F.lit("")) == "", "MISSING").when(n.isNull(), "NOT_NUMERIC"))


def dimension_warnings(df: DataFrame, inner: str = "d_mm", outer: str = "dd_mm") -> DataFrame:
    return df.where(F.col(inner) >= F.col(outer)).select("row_ord", F.concat(F.lit(f"{inner} >= {outer}")).alias("warning"))


def group_texts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each group: distinct values of a text column in order, joined by ``;``, and the first nonblank one."""
    aggs = []
    for c in columns:
        full = F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.struct("row_ord", F.col(c).alias("t")))
        aggs += [F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(full)), lambda s: s["t"])), ";").alias(f"{c}_all"), F.min(full)["t"].alias(f"{c}_first")]
    return df.groupBy(*keys).agg(*aggs)


def spec_columns(long: DataFrame) -> DataFrame:
    """(sheet, label, n): spec columns that have a value on some row."""
    return long.where(F.trim(F.coalesce("value", F.lit(""))) != "").groupBy("sheet", "label").agg(F.count("*").alias("n"))


def group_brand(df: DataFrame, keys: list[str]) -> DataFrame:
    """The brand of a group, only if every row has the same one."""
    g = df.groupBy(*keys).agg(F.count_distinct("brand").alias("d"), F.bool_and(F.trim(F.coalesce("brand", F.lit(""))) != "").alias("all"), F.min("brand").alias("b"))
    return g.select(*keys, F.when((F.col("d") == 1) & F.col("all"), F.col("b")).alias("brand"))


def lift_units(long: DataFrame) -> DataFrame:
    """(sheet, label, row_ord, new_label, new_value): a unit moves to the label where all values of a column carry it."""
    u = long.withColumn("u", X.unit_value(F.col("value")))
    lift = u.groupBy("sheet", "label").agg(F.bool_and(F.col("u").isNotNull()).alias("all"), F.count_distinct("u.unit").alias("d"), F.min("u.unit").alias("unit"))
    out = u.join(lift, ["sheet", "label"])
    yes = F.col("all") & (F.col("d") == 1) & ~F.col("label").contains("\n")
    plain = F.col("u.n").rlike(r"^\d+(?:[.,]\d+)?$")
    num = F.when(plain, F.replace(F.col("u.n"), F.lit(","), F.lit(".")).try_cast("double").cast("string")).otherwise(F.col("u.n"))
    return out.select("sheet", "label", "row_ord", F.when(yes, F.concat("label", F.lit("\n("), "unit", F.lit(")"))).otherwise(F.col("label")).alias("new_label"), F.when(yes, num).otherwise(F.col("value")).alias("new_value"))


def stated_but_missing(rows: DataFrame, specs: DataFrame) -> DataFrame:
    """(row_ord, n, unit, label): the description states a measure, no spec has it, and a column of the unit is empty."""
    m = rows.select("sheet", "row_ord", F.explode(F.array_distinct(F.regexp_extract_all("description", F.lit(r"(?i)(?<![\w.])(\d+(?:\.\d+)?\s*(?:inch|lbs?|kg|mm|cm|g))(?!\w)"), 1))).alias("m"))
    m = m.withColumn("u", X.unit_value(F.col("m"))).select("sheet", "row_ord", "u.n", "u.unit")
    full = specs.where("value is not null").select("row_ord", F.col("value").alias("n"), "unit")
    empty = specs.where("value is null").select("row_ord", "unit", "label")
    return m.join(full, ["row_ord", "n", "unit"], "left_anti").join(empty, ["row_ord", "unit"]).select("row_ord", "n", "unit", "label").distinct()


def indistinct_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that nothing but the code tells apart."""
    return df.groupBy(*keys).agg(F.count_distinct("code").alias("n_codes"), F.min("row_ord").alias("first_ord")).where("n_codes > 1")


def match_families(names: DataFrame, families: DataFrame, default: str) -> DataFrame:
    """First family with a keyword in the folded name as whole words; a small rule table, broadcast."""
    hay = F.concat(F.lit(" "), F.regexp_replace(X.fold_price(F.col("name")), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    rules = F.broadcast(families.select("rank", "family", F.concat(F.lit(" "), X.fold_price(F.col("keyword")), F.lit(" ")).alias("_k")))
    hit = names.withColumn("_h", hay).join(rules, F.col("_h").contains(F.col("_k")), "left")
    return hit.groupBy("name").agg(F.min(F.struct("rank", "family"))["family"].alias("f")).select("name", F.coalesce("f", F.lit(default)).alias("family"), F.col("f").isNotNull().alias("matched"))


def sorted_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row position in its sheet by numeric keys, then by natural order of the code."""
    keys = [X.num_key(F.col(c).cast("string")) for c in columns]
    w = W.partitionBy("sheet").orderBy(*keys, X.natural_key(F.col("code")), "row_ord")
    return df.withColumn("position", F.row_number().over(w))


def plan_flags(groups: DataFrame) -> DataFrame:
    """What to look at in a plan: unmatched family, no sort column, unparseable codes, too many rows, several brands."""
    flag = lambda cond, text: F.when(cond, text)
    flags = F.array(flag(~F.col("matched"), "NO_RULE"), flag(F.col("sort_columns") == 0, "NO_SORT_COLUMN"), flag(F.col("unparseable") > 0, "UNPARSEABLE_CODES"), flag((F.col("n_rows") > LARGE_GROUP) & (F.col("n_sub") <= 1), "LARGE"), flag(F.col("n_brands") > 1, "BRANDS"))
    return groups.select("sheet", F.array_join(F.array_compact(flags), ",").alias("flags"))


def merge_groups(df: DataFrame) -> DataFrame:
    """Groups of one name and the same spec labels, over sheets."""
    return df.groupBy("name", "labels").agg(F.count("*").alias("n_rows"), F.count_distinct("sheet").alias("n_sheets"), F.min("row_ord").alias("first_ord"))


_MERGED = ["name", "labels"]


def merged_rows(df: DataFrame) -> DataFrame:
    """Rows of merged groups (name, labels, group_ord, row_ord, sheet): in order of group_ord, the first row of the row's own sheet's group, and row_ord they stand as one table."""
    groups = df.groupBy("sheet", *_MERGED).agg(F.min("row_ord").alias("group_ord"))
    return df.join(groups, ["sheet", *_MERGED]).select(*_MERGED, "group_ord", "row_ord", "sheet")


def merged_texts(groups: DataFrame, lists: tuple[str, ...] = ("lines", "legend"), single: tuple[str, ...] = ("note", "image")) -> DataFrame:
    """Texts of merged groups (name, labels, kind, text, group_ord, pos).

    ``groups`` is one row for each sheet's group, with group_ord.  Of each list
    column every distinct text stays, at its first place; of each single column
    the first nonblank text.  One row a text, so no group is gathered in one value.
    """
    some = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("texts")) for c in lists])
    long = groups.select(*_MERGED, "group_ord", F.explode(some).alias("g")).select(*_MERGED, "group_ord", "g.kind", F.posexplode("g.texts").alias("pos", "text")).where("text is not null")
    first = long.groupBy(*_MERGED, "kind", "text").agg(F.min(F.struct("group_ord", "pos")).alias("at")).select(*_MERGED, "kind", "text", "at.*")
    one = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("text")) for c in single])
    nonblank = groups.select(*_MERGED, "group_ord", F.explode(one).alias("g")).where(F.trim(X.text(F.col("g.text"))) != "")
    kept = nonblank.groupBy(*_MERGED, "g.kind").agg(F.min(F.struct("group_ord", F.col("g.text").alias("text"))).alias("at"))
    return first.unionByName(kept.select(*_MERGED, "kind", "at.text", "at.group_ord", F.lit(0).alias("pos")))


def live_rows(df: DataFrame) -> DataFrame:
    return df.where("dup_of is null and order_code is not null")


def of_brand(df: DataFrame, brand: str) -> DataFrame:
    """Rows of a brand, and rows without one."""
    blank = F.trim(F.coalesce("brand", F.lit(""))) == ""
    return df.where(blank | (X.fold_price(F.col("brand")) == X.fold_price(F.lit(brand)))).withColumn("no_brand", blank)


def price_table(df: DataFrame) -> DataFrame:
    """First row of each order code."""
    w = W.partitionBy("order_code").orderBy("row_ord")
    return df.where("order_code is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("order_code", "code", "price", "row_ord")


def constant_lines(long: DataFrame, min_rows: int = 3) -> DataFrame:
    """Spec columns of one value on all rows become description lines (at most five, short ones)."""
    g = long.groupBy("sheet", "label", "pos").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"), F.min("value").alias("value"), F.count("value").alias("full"))
    head = F.split("label", "\n")[0]
    line = F.concat(head, F.lit(": "), "value")
    ok = g.where((F.col("n") >= min_rows) & (F.col("d") == 1) & (F.col("full") == F.col("n")) & (F.length(head) > 2) & (F.length(line) <= LINE_MAX))
    return ok.withColumn("_r", F.row_number().over(W.partitionBy("sheet").orderBy("pos"))).where(F.col("_r") < LINES_MAX).select("sheet", "label", line.alias("line"))


def default_legend(columns: DataFrame, legends: DataFrame, given: DataFrame) -> DataFrame:
    """Family legend of letter columns in column order; a legend from the data wins."""
    own = given.select("sheet", "label", F.col("line").alias("own"))
    return columns.join(F.broadcast(legends), ["family", "label"], "left").join(own, ["sheet", "label"], "left").select("sheet", "label", "pos", F.coalesce("own", "line").alias("line")).where("line is not null")


def chunk_cards(df: DataFrame, most: int = 12) -> DataFrame:
    """Balanced cards of at most ``most`` rows, numbered for each slug."""
    n = F.count("*").over(W.partitionBy("sheet", "name"))
    i = F.row_number().over(W.partitionBy("sheet", "name").orderBy("row_ord")) - 1
    cards = F.ceil(n / F.lit(float(most)))
    size = F.ceil(n / cards)
    return df.withColumn("chunk", F.floor(i / size).cast("int")).withColumn("slug", X.safe_name(F.concat_ws(" ", "sheet", "name"))).withColumn("card_id", F.concat("slug", F.lit("-"), (F.col("chunk") + 1).cast("string")))


def unit_conflicts(patches: DataFrame, columns: DataFrame) -> DataFrame:
    """Patch values whose unit is not the unit of the column."""
    u = patches.withColumn("u", X.unit_value(F.col("value"))).join(columns.select("label", "unit"), "label")
    return u.where("u is not null and unit is not null and u.unit <> unit").select("patch_id", "label", "value", "unit")


def kb_approve(kb: DataFrame, codes: DataFrame) -> DataFrame:
    return kb.join(codes.select("code", F.lit(True).alias("_a")), "code", "left").select("code", "title", F.when((F.col("status") == "review") & F.col("_a"), "ok").otherwise(F.col("status")).alias("status"))


def kb_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("code", F.col("title").alias("title_a")).join(b.select("code", F.col("title").alias("title_b")), "code").where("title_a <> title_b")


def _violations(df: DataFrame, rules: list[tuple], id_col: str) -> DataFrame:
    """One row for each rule that a row breaks: rules are (severity, rule, condition)."""
    found = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"))) for sev, rule, cond in rules]), lambda x: x.isNotNull())
    return df.select(id_col, F.explode(found).alias("x")).select(id_col, "x.severity", "x.rule")


def lint_cards(cards: DataFrame) -> DataFrame:
    """Violations of single cards (card_id, title, lines array, note, image, title_source)."""
    t, lines = F.col("title"), F.col("lines")
    any_line = lambda cond: F.exists(lines, cond)
    rules = [
        ("error", "TITLE_CASE", t != F.upper(t)), ("error", "TITLE_PLACEHOLDER", F.trim(t).rlike(r"^(KHÔNG TIÊU ĐỀ|UNTITLED|NO TITLE|TIÊU ĐỀ)?$")), ("error", "TITLE_COLON", t.contains(":")), ("error", "TITLE_LONG", F.length(t) > TITLE_MAX),
        ("error", "LINES_MANY", F.size(lines) > LINES_MAX), ("error", "LINE_LONG", any_line(lambda x: F.length(x) > LINE_MAX)), ("error", "LINE_JUNK", any_line(lambda x: (F.length(x) < 3) | ~x.rlike(r"\p{L}{2}"))),
        ("warning", "LINE_TITLE_CASE", any_line(lambda x: ~X.title_case_ok(x))), ("warning", "NO_LINES", F.size(lines) == 0), ("warning", "NOTE_LONG", F.length("note") > NOTE_MAX), ("warning", "NO_IMAGE", F.trim(F.coalesce("image", F.lit(""))) == ""),
    ]
    return _violations(cards, rules, "card_id")


def lint_rows(rows: DataFrame) -> DataFrame:
    """Violations of card rows: order codes, codes, empty markers, order codes of other cards."""
    twice = rows.where("order_code is not null").groupBy("order_code").agg((F.min("card_id") != F.max("card_id")).alias("_e"))
    df = rows.join(twice, "order_code", "left")
    rules = [
        ("error", "ORDER_CODE", ~F.coalesce("order_code", F.lit("")).rlike("^[0-9]{7}$")), ("error", "ORDER_CODE_ELSEWHERE", F.col("_e") & F.coalesce("order_code", F.lit("")).rlike("^[0-9]{7}$")),
        ("error", "EMPTY_CODE", F.trim(F.coalesce("code", F.lit(""))) == ""), ("warning", "EMPTY_MARKER", F.col("code").isin(EMPTY_MARKERS) | F.col("price_raw").isin(EMPTY_MARKERS)),
    ]
    return _violations(df, rules, "row_ord")


def lint_labels(columns: DataFrame) -> DataFrame:
    """Labels whose unit style is not the canonical one."""
    fixed = X.fix_label(F.col("label"))
    return columns.where(fixed != F.col("label")).select("sheet", "label", fixed.alias("fixed"))


def lint_fix(cards: DataFrame) -> DataFrame:
    """Safe fixes: upper-case titles, clean lines and notes."""
    return cards.select("card_id", F.upper(X.clean_line(F.col("title"))).alias("title"), F.transform("lines", X.clean_line).alias("lines"), X.clean_line(F.col("note")).alias("note"))


def recheck(warnings: DataFrame, still: DataFrame) -> DataFrame:
    """Warnings by code that a later evaluation no longer has."""
    return warnings.join(still.select("code", "rule"), ["code", "rule"], "left_anti")


def reconcile(df: DataFrame) -> DataFrame:
    """Rows in, live, duplicates and rows dropped for other reasons; they add up."""
    return df.agg(F.count("*").alias("rows_in"), F.count_if(F.col("dup_of").isNull() & F.col("order_code").isNotNull()).alias("rows_out"), F.count_if(F.col("dup_of").isNotNull()).alias("duplicates"), F.count_if(F.col("dup_of").isNull() & F.col("order_code").isNull()).alias("dropped"))


def qa_checks(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(check_name, failed) of price-list rows against the price table."""
    a = rows.agg(F.count_if(~F.coalesce("order_code", F.lit("")).rlike("^[0-9]{7}$")).alias("order_code_form"), F.count_if(F.col("price").isNull()).alias("price_not_numeric"))
    b = rows.where("order_code is not null").groupBy("order_code").count().where("count > 1").agg(F.count("*").alias("order_code_twice"))
    c = rows.where("order_code is not null").join(table.select("order_code"), "order_code", "left_anti").agg(F.count("*").alias("not_in_price_table"))
    wide = reduce(DataFrame.crossJoin, [a, b, c])  # one row each
    return wide.unpivot([], wide.columns, "check_name", "failed")


def title_lengths(cards: DataFrame) -> DataFrame:
    """Shortest, median (mean of the middle two) and longest title."""
    n = F.length("title")
    return cards.agg(F.min(n).alias("shortest"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("longest"))
