"""How a price list is laid out: subgroups in order, sort columns, replayed changes, and the knowledge base on cards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X


def _numbered(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``sub``: the number of each row's subgroup in its sheet, by ``order`` over one row for each subgroup."""
    parts = df.groupBy("sheet", key).agg(F.min("row_ord").alias("_first"))
    parts = parts.withColumn("sub", F.row_number().over(W.partitionBy("sheet").orderBy(*order, "_first"))).drop("_first")
    return df.join(parts, ["sheet", key])


def split_series(df: DataFrame) -> DataFrame:
    """Subgroups by bearing series: mini, plain numbers, then prefixed ones, each by number; unparseable codes are ``other`` and last."""
    s = df.withColumn("_s", X.bearing_series(F.col("code"))).withColumns({"series": F.coalesce(F.col("_s.key"), F.lit("other")), "series_label": F.col("_s.label")}).drop("_s")
    form = r"^([A-Z]*)([0-9]+)$"
    prefix, number = F.regexp_extract("series", form, 1), F.regexp_extract("series", form, 2).try_cast("long")
    kind = F.when(F.col("series") == "mini", 0).when(number.isNull(), 3).when(prefix != "", 2).otherwise(1)
    return _numbered(s, "series", kind, prefix, F.coalesce(number, F.lit(0)))


def split_column(df: DataFrame, column: str) -> DataFrame:
    """Subgroups by the value of a column, in order of first row; blank is ``other``."""
    return _numbered(df.withColumn("part_key", F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("other"))), "part_key")


def split_regex(df: DataFrame, pattern: str, group: int = 1, label: str = "DÒNG {key}") -> DataFrame:
    """Subgroups by what a pattern finds in the code, in order of first row; codes without it, or with an empty find, are ``other`` and have no label."""
    key = F.nullif(F.regexp_extract("code", pattern, group), F.lit(""))
    named = F.replace(F.replace(F.lit(label), F.lit("{key}"), key), F.lit("{value}"), key)
    return _numbered(df.withColumns({"part_key": F.coalesce(key, F.lit("other")), "part_label": named}), "part_key")


def split_description(df: DataFrame, pattern: str | None = None, label: str = "Biến thể") -> DataFrame:
    """Subgroups by base description: ``desc_clean`` without the variant that ``pattern`` finds.

    The variant, the pattern's first group or all that it finds, becomes a column
    ``label`` of the row's ``specs`` (a map of labels to values), null where there
    is none.  Rows without a description are one subgroup without a title.
    """
    text = F.trim(F.coalesce("desc_clean", F.lit("")))
    if pattern is None:
        base, out = text, df
    else:
        rx = "(?i)" + pattern
        parts = F.split(text, rx, 2)
        found = F.size(parts) > 1
        base = F.when(found, F.concat_ws(" ", parts[0], F.get(parts, F.lit(1)))).otherwise(text)
        value = F.when(found, F.regexp_extract(text, rx, min(1, re.compile(pattern).groups)))
        out = df.withColumn("specs", F.when(text == "", F.col("specs")).otherwise(F.map_concat(F.map_filter("specs", lambda k, _: k != label), F.create_map(F.lit(label), value))))
    base = F.regexp_replace(F.regexp_replace(base, r"\s+", " "), "^[ ,-]+|[ ,-]+$", "")
    return _numbered(out.withColumn("part_key", base).withColumn("title", F.nullif(F.upper("part_key"), F.lit(""))), "part_key")


def spec_labels(df: DataFrame, columns: DataFrame) -> DataFrame:
    """(sheet, label, pos): the labels of a sheet, and after them the labels that only its rows' ``specs`` have, by name."""
    extra = df.select("sheet", F.explode(F.map_keys("specs")).alias("label")).distinct().join(columns.select("sheet", "label"), ["sheet", "label"], "left_anti")
    last = columns.groupBy("sheet").agg(F.max("pos").alias("_l"))
    more = extra.join(last, "sheet", "left").withColumn("pos", F.coalesce("_l", F.lit(-1)) + F.row_number().over(W.partitionBy("sheet").orderBy("label")))
    return columns.select("sheet", "label", F.col("pos").cast("long").alias("pos")).unionByName(more.select("sheet", "label", F.col("pos").cast("long").alias("pos")))


def sort_columns(labels: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sheet, rank, pattern, label, how): the column that each pattern of a family takes, greedily by rank.

    A pattern takes the first label that none before it has taken: an exact one,
    else one that it matches as it is or without accents.  Patterns without a label
    are MISSING; where no pattern of a sheet has one, its first numeric column is
    the only one (FALLBACK).  ``labels`` are (sheet, label, pos, numeric); both
    sides are lists of a sheet's columns and of a family's rules, folded with the
    labels taken so far.
    """
    own = labels.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("pos", "label", X.fold_price(F.col("label")).alias("plain"), "numeric"))).alias("cols"))
    rules = patterns.agg(F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("rules"))
    taken = F.expr(
        """aggregate(rules, cast(array() as array<struct<rank: int, pattern: string, label: string, how: string>>), (acc, r) -> concat(acc, transform(array(
             filter(cols, c -> not exists(acc, a -> a.label <=> c.label))), free -> transform(array(
             struct(get(filter(free, c -> c.label = r.pattern), 0).label as exact, get(filter(free, c -> rlike(c.label, r.pattern) or rlike(c.plain, r.pattern)), 0).label as near)),
             h -> struct(r.rank as rank, r.pattern as pattern, coalesce(h.exact, h.near) as label, case when h.exact is not null then 'EXACT' when h.near is not null then 'MATCH' else 'MISSING' end as how))[0])))"""
    )
    picked = own.crossJoin(rules).withColumn("picked", taken)  # one row of rules
    first = F.get(F.filter("cols", lambda c: c["numeric"]), F.lit(0))["label"]
    none = ~F.exists("picked", lambda p: p["label"].isNotNull())
    fallback = F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("pattern"), first.alias("label"), F.lit("FALLBACK").alias("how")))
    return picked.withColumn("picked", F.when(none & first.isNotNull(), fallback).otherwise(F.col("picked"))).select("sheet", F.explode("picked").alias("p")).select("sheet", "p.rank", "p.pattern", "p.label", "p.how")


def row_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, digest): one row that is the same for the same multiset of rows, in any order."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


#: spec labels are ``Name`` or ``Name`` newline ``(unit)``; a name is compared without its unit and case
def _head(label: Column) -> Column:
    return F.trim(F.lower(F.split(label, "\n")[0]))


def replay_patches(rows: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, violations): an ordered log of changes, replayed for each row, all or nothing.

    ``rows`` are (grp, row_ord, code, brand, specs map of label to value), ``patches``
    (patch_id, seq, op, grp, code, label, value, source) with op ``set_spec`` (for a
    code: the column of that name, whatever its unit, or a new one; a number in the
    column's unit is stored as the number), ``rename_label`` (for a group: ``label``
    gets the name ``value`` and keeps its unit) or ``set_brand`` (for a group, or a
    code).  A patch without a source (NO_SOURCE), one that changes nothing
    (NO_MATCH) and a value in another unit than its column's (UNIT_MISMATCH) are
    violations, and one of them leaves all rows as they were.  Hits count rows, for
    a renaming groups.  A row's patches are folded in their order over its specs;
    they are as many as name its code or group.
    """
    # a patch of a brand that names a code and a group reaches the rows of the code only
    by_code = patches.where((F.col("op") != "rename_label") & F.col("code").isNotNull())
    by_group = patches.where((F.col("op") == "rename_label") | ((F.col("op") == "set_brand") & F.col("code").isNull()))
    op = F.struct("seq", "patch_id", "op", "label", "value")
    mine = rows.select("row_ord", "code").join(by_code.select("code", op.alias("o")), "code").select("row_ord", "o")
    ours = rows.select("row_ord", "grp").join(by_group.select("grp", op.alias("o")), "grp").select("row_ord", "o")
    ops = mine.unionByName(ours).groupBy("row_ord").agg(F.array_sort(F.collect_list("o")).alias("ops"))

    units = F.create_map(*[F.lit(x) for kv in {**X.UNIT_NAMES, "in": "inch", '"': "inch"}.items() for x in kv])
    canon = lambda u: F.coalesce(F.try_element_at(units, F.lower(F.trim(u))), F.lower(F.trim(u)))

    def step(acc: Column, o: Column) -> Column:
        key = F.get(F.filter(F.map_keys(acc["specs"]), lambda k: _head(k) == F.trim(F.lower(o["label"]))), F.lit(0))
        rename, brand, spec = o["op"] == "rename_label", o["op"] == "set_brand", o["op"] == "set_spec"
        unit = F.nullif(F.regexp_extract(key, r"\n.*\(([^)]+)\)\s*$", 1), F.lit(""))
        number, own = F.nullif(F.regexp_extract(o["value"], r"^\s*(-?[0-9]+(?:[.,][0-9]+)?)\s*([^0-9\s]*)\s*$", 1), F.lit("")), F.regexp_extract(o["value"], r"^\s*(-?[0-9]+(?:[.,][0-9]+)?)\s*([^0-9\s]*)\s*$", 2)
        convert = unit.isNotNull() & number.isNotNull()
        clash = spec & convert & (own != "") & (canon(own) != canon(unit))
        plain = F.regexp_replace(F.replace(number, F.lit(","), F.lit(".")), r"\.0+$", "")
        value = F.when(convert, plain).otherwise(o["value"])
        renamed = F.transform_keys(acc["specs"], lambda k, _: F.when(k == key, F.concat(o["value"], F.substring(k, F.length(F.split(k, "\n")[0]) + 1, F.length(k)))).otherwise(k))
        filled = F.map_concat(F.map_filter(acc["specs"], lambda k, _: ~k.eqNullSafe(key)), F.create_map(F.coalesce(key, o["label"]), value))
        hit = F.struct(o["patch_id"].alias("patch_id"), (brand | spec | (rename & key.isNotNull())).alias("hit"), F.coalesce(clash, F.lit(False)).alias("clash"))
        specs = F.when(rename & key.isNotNull(), renamed).when(spec, filled).otherwise(acc["specs"])
        return F.struct(F.when(brand, o["value"]).otherwise(acc["brand"]).alias("brand"), specs.alias("specs"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

    empty = F.array().cast("array<struct<patch_id: bigint, hit: boolean, clash: boolean>>")
    folded = rows.join(ops, "row_ord", "left").withColumn("_s", F.aggregate(F.coalesce("ops", F.array().cast(ops.schema["ops"].dataType)), F.struct("brand", "specs", empty.alias("hits")), step))
    made = folded.select("grp", "row_ord", F.explode("_s.hits").alias("h")).select("grp", "row_ord", "h.*")
    renames = patches.where("op = 'rename_label'").select("patch_id", F.lit(True).alias("_r"))
    counted = made.where("hit").join(renames, "patch_id", "left").groupBy("patch_id").agg(F.count("*").alias("rows"), F.count_distinct("grp").alias("groups"), F.bool_or("_r").alias("_r"))
    hits = patches.join(counted, "patch_id", "left").select("patch_id", "op", "source", F.coalesce(F.when(F.col("_r"), F.col("groups")).otherwise(F.col("rows")), F.lit(0)).cast("long").alias("hits"))
    violations = hits.where(F.trim(F.coalesce("source", F.lit(""))) == "").select("patch_id", F.lit("NO_SOURCE").alias("violation"))
    violations = violations.unionByName(hits.where("hits = 0").select("patch_id", F.lit("NO_MATCH").alias("violation"))).unionByName(made.where("clash").select("patch_id", F.lit("UNIT_MISMATCH").alias("violation")).distinct())
    refused = violations.agg((F.count("*") > 0).alias("_no"))
    out = folded.crossJoin(refused)  # one row
    out = out.select("grp", "row_ord", "code", F.when(F.col("_no"), F.col("brand")).otherwise(F.col("_s.brand")).alias("brand"), F.when(F.col("_no"), F.col("specs")).otherwise(F.col("_s.specs")).alias("specs"))
    return out, hits, violations


# Fields of a card that an edit may change, and those of them that are lists.
EDITABLE, LISTS = ["title", "lines", "legend", "note", "width", "data_row_height", "desc_rows"], ["lines", "legend"]


def validate_edits(edits: DataFrame, cards: DataFrame) -> DataFrame:
    """(edit_id, violation): unknown card, field not allowed, title owned by the data, a second edit of one field."""
    known = edits.join(cards.select("card_id", "title_source"), "card_id", "left")
    reason = F.when(F.col("title_source").isNull(), "UNKNOWN_CARD").when(~F.col("field").isin(EDITABLE), "FIELD").when((F.col("field") == "title") & (F.col("title_source") == "data"), "TITLE_FROM_DATA")
    judged = known.withColumn("violation", reason)
    first = judged.where("violation is null").groupBy("card_id", "field").agg(F.min("edit_id").alias("_f"))
    again = judged.where("violation is null").join(first, ["card_id", "field"]).where("edit_id > _f").select("edit_id", F.lit("CONFLICT").alias("violation"))
    return judged.where("violation is not null").select("edit_id", "violation").unionByName(again)


def apply_edits(cards: DataFrame, edits: DataFrame) -> DataFrame:
    """Cards with the edits (edit_id, card_id, field, value, items): texts take ``value``, lists take ``items``; one violation refuses all."""
    refused = validate_edits(edits, cards).agg((F.count("*") > 0).alias("_no"))
    fields = [c for c in EDITABLE if c in cards.columns]
    pick = [F.max_by(F.struct("items" if c in LISTS else "value"), F.when(F.col("field") == c, F.col("edit_id"))).alias(f"_{c}") for c in fields]
    wide = edits.groupBy("card_id").agg(*pick)
    out = cards.join(wide, "card_id", "left").crossJoin(refused)  # one row
    new = {c: F.when(~F.col("_no") & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["items" if c in LISTS else "value"].cast(cards.schema[c].dataType)).otherwise(F.col(c)) for c in fields}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in cards.columns])


def kb_learn(kb: DataFrame, learned: DataFrame, force: bool = False, status: str = "review") -> tuple[DataFrame, DataFrame]:
    """(stored, conflicts) of an upsert of (code, title, lines, legend, status): entries that differ are conflicts, and stay if they are ok and not forced."""
    n = learned.select("code", F.struct("title", "lines", "legend").alias("new"))
    both = kb.select("code", F.struct("title", "lines", "legend").alias("old"), "status").join(n, "code", "full_outer")
    differ = F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    keep = F.col("new").isNull() | (differ & (F.col("status") == "ok") & ~F.lit(force))
    entry = F.when(keep, F.col("old")).otherwise(F.col("new"))
    stored = both.select("code", entry["title"].alias("title"), entry["lines"].alias("lines"), entry["legend"].alias("legend"), F.when(keep, F.col("status")).otherwise(status).alias("status"))
    return stored, both.where(differ).select("code", F.col("old.title").alias("title"), F.col("new.title").alias("new"), "status")


def kb_apply(rows: DataFrame, cards: DataFrame, kb: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, cards) after the knowledge base, with new card ids where a card is split.

    ``rows`` are (card_id, row_ord, code), ``cards`` (card_id, title, title_source,
    lines, legend), ``kb`` (code, title, lines, legend).  A card whose title comes
    from the data keeps it and its rows; its first known code fills empty lines and
    legend.  Any other card with two titles or more is split by them, in order of
    their first row, unknown codes last and as they were; each part takes title,
    lines and legend of its first row's entry.  A card of one title takes the title,
    and empty lines and legend, of its first code if all its codes are known.
    """
    known = kb.select("code", F.struct("title", "lines", "legend").alias("e"))
    coded = rows.select("card_id", "row_ord", "code").join(known, "code", "left").join(cards.select("card_id", (F.coalesce("title_source", F.lit("")) == "data").alias("fixed")), "card_id")
    parts = coded.groupBy("card_id", "fixed", F.col("e.title").alias("kt")).agg(F.min("row_ord").alias("first"), F.min_by("e", "row_ord").alias("e"), F.count("*").alias("n"))
    by = W.partitionBy("card_id")
    parts = parts.withColumns({"titles": F.count("kt").over(by), "unknown": F.count_if(F.col("kt").isNull()).over(by), "start": F.min("first").over(by), "entry1": F.min(F.when(F.col("kt").isNotNull(), F.struct("first", "e"))).over(by)["e"]})
    parts = parts.withColumn("split", ~F.col("fixed") & (F.col("titles") >= 2))
    number = F.row_number().over(by.orderBy(F.col("kt").isNull(), "first"))
    parts = parts.withColumn("new_id", F.when(F.col("split"), F.concat_ws("-", "card_id", number.cast("string"))).otherwise(F.col("card_id")))
    moved = coded.select("card_id", "row_ord", "code", F.col("e.title").alias("kt")).join(parts.select("card_id", F.col("kt").alias("kt2"), "new_id"), (F.col("kt").eqNullSafe(F.col("kt2"))) & (parts["card_id"] == coded["card_id"])).select(F.col("new_id").alias("card_id"), "row_ord", "code")
    e, whole = F.col("entry"), F.col("how") == "SPLIT"
    how = F.when(F.col("split"), F.when(F.col("kt").isNull(), "REST").otherwise("SPLIT")).when(F.col("fixed") & (F.col("titles") > 0), "DATA").when(~F.col("fixed") & (F.col("titles") == 1) & (F.col("unknown") == 0), "FILL").otherwise("KEEP")
    made = parts.select("card_id", "new_id", how.alias("how"), F.when(F.col("split"), F.col("e")).otherwise(F.col("entry1")).alias("entry")).distinct()
    full = cards.join(made, "card_id", "left")
    fill = lambda c: F.when(whole | (F.col("how").isin("DATA", "FILL") & (F.coalesce(F.size(c), F.lit(0)) <= 0)), e[c]).otherwise(F.col(c)).alias(c)
    title = F.when(whole | (F.col("how") == "FILL"), e["title"]).otherwise(F.col("title"))
    return moved, full.select(F.coalesce("new_id", "card_id").alias("card_id"), title.alias("title"), "title_source", fill("lines"), fill("legend"))
