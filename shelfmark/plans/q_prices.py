"""Queries of price-list data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import lint as N
from shelfmark.operators import plans as L
from shelfmark.operators import prices as H
from shelfmark.plans.registry import query
from shelfmark.plans.views import ITEMS_CTE, items
from shelfmark.sources.tables import wide_to_long

_I = f"WITH {ITEMS_CTE}"
_OC = r"oc AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(trim(order_raw), '\.0+$', ''), '^[0-9]{1,7}$') THEN lpad(regexp_replace(trim(order_raw), '\.0+$', ''), 7, '0') END order_code FROM items), od AS (SELECT *, CASE WHEN order_code IS NOT NULL AND min(row_ord) OVER (PARTITION BY order_code) < row_ord THEN min(row_ord) OVER (PARTITION BY order_code) END dup_of FROM oc)"
_PR = "pr AS (SELECT *, CAST(round_even(TRY_CAST(trim(price_raw) AS DOUBLE)::DECIMAL(18,4), 0) AS BIGINT) price, CASE WHEN coalesce(trim(price_raw),'') = '' THEN 'MISSING' WHEN TRY_CAST(trim(price_raw) AS DOUBLE) IS NULL THEN 'NOT_NUMERIC' END price_warning FROM od)"
_ALL = f"{_I}, {_OC}, {_PR}"
_CODE2 = "CASE row_ord % 4 WHEN 1 THEN 'NU' || substr(code, 2, 3) WHEN 2 THEN substr(code, 2, 3) WHEN 3 THEN CASE WHEN row_ord % 8 = 3 THEN 'XX' ELSE code END ELSE code END"
_CODED = f"coded AS (SELECT * REPLACE ({_CODE2} AS code) FROM items)"
_SERIES = r"sr0 AS (SELECT *, regexp_extract(upper(code), '^([A-Z]*)([0-9]+)', 1) px, regexp_extract(upper(code), '^([A-Z]*)([0-9]+)', 2) dg FROM items), sr AS (SELECT *, CASE WHEN dg = '' THEN 'other' WHEN px = '' AND length(dg) = 3 THEN 'mini' WHEN px = '' AND length(dg) = 4 THEN substr(dg,1,2) WHEN px = '' AND length(dg) >= 5 THEN substr(dg,1,3) WHEN px <> '' AND length(dg) BETWEEN 3 AND 4 THEN px || left(dg, length(dg) - 2) WHEN px <> '' AND length(dg) > 4 THEN px || left(dg, 3) ELSE 'other' END series FROM sr0)"


def priced(spark: SparkSession, d: str) -> DataFrame:
    return H.prices(H.order_codes(items(spark, d)))


def carded(spark: SparkSession, d: str) -> DataFrame:
    return H.chunk_cards(priced(spark, d))


_CARD = f"{_ALL}, cd0 AS (SELECT *, count(*) OVER (PARTITION BY sheet, name) n, row_number() OVER (PARTITION BY sheet, name ORDER BY row_ord) - 1 i FROM pr), cd1 AS (SELECT *, ceil(n / ceil(n / 12.0)) sz, regexp_replace(lower(sheet || ' ' || name), '[^a-z0-9]+', '-', 'g') slug FROM cd0), cd AS (SELECT *, CAST(floor(i / sz) AS INT) chunk, slug || '-' || CAST(CAST(floor(i / sz) AS INT) + 1 AS VARCHAR) card_id FROM cd1)"
_CARDS = f"{_CARD}, cards AS (SELECT card_id, arg_min(CASE row_ord % 7 WHEN 0 THEN name WHEN 1 THEN '' WHEN 2 THEN upper(name) || ': X' WHEN 3 THEN upper(name) || repeat(' LONG', 9) ELSE upper(name) END, row_ord) title, CASE WHEN min(row_ord) % 3 = 0 THEN [] WHEN min(row_ord) % 3 = 1 THEN ['Steel', 'x', 'lower case words here and more'] ELSE ['Good Line', '* Dotted  Line.'] END AS lines, CASE WHEN min(row_ord) % 11 = 0 THEN repeat('note ', 30) END note, CASE WHEN min(row_ord) % 2 = 0 THEN 'a.png' END image, CASE WHEN min(row_ord) % 5 = 0 THEN 'data' ELSE 'model' END title_source, CASE WHEN min(row_ord) % 4 = 0 THEN ['d: Inner'] ELSE [] END legend FROM cd GROUP BY card_id)"


def cards(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("row_ord") % 7
    title = F.when(m == 0, F.col("name")).when(m == 1, "").when(m == 2, F.concat(F.upper("name"), F.lit(": X"))).when(m == 3, F.concat(F.upper("name"), F.repeat(F.lit(" LONG"), 9))).otherwise(F.upper("name"))
    g = carded(spark, d).groupBy("card_id").agg(F.min_by(title, "row_ord").alias("title"), F.min("row_ord").alias("f"))
    lines = F.when(F.col("f") % 3 == 0, F.array().cast("array<string>")).when(F.col("f") % 3 == 1, F.array(*map(F.lit, ["Steel", "x", "lower case words here and more"]))).otherwise(F.array(*map(F.lit, ["Good Line", "* Dotted  Line."])))
    return g.select("card_id", "title", lines.alias("lines"), F.when(F.col("f") % 11 == 0, F.repeat(F.lit("note "), 30)).alias("note"), F.when(F.col("f") % 2 == 0, "a.png").alias("image"), F.when(F.col("f") % 5 == 0, "data").otherwise("model").alias("title_source"), F.when(F.col("f") % 4 == 0, F.array(F.lit("d: Inner"))).otherwise(F.array().cast("array<string>")).alias("legend"))


@query(f"{_I}, n AS (SELECT *, CASE WHEN name IS DISTINCT FROM lag(name) OVER w OR lag(row_ord) OVER w IS NULL THEN 1 ELSE 0 END c FROM items WINDOW w AS (PARTITION BY sheet ORDER BY row_ord)) SELECT row_ord, CAST(sum(c) OVER (PARTITION BY sheet ORDER BY row_ord) AS BIGINT) grp_run FROM n")
def h01_runs(spark, d):
    return H.runs(items(spark, d)).select("row_ord", "grp_run")


@query(f"{_I}, {_OC} SELECT row_ord, order_code, dup_of FROM od")
def h02_order_codes(spark, d):
    return H.order_codes(items(spark, d)).select("row_ord", "order_code", "dup_of")


@query(f"{_ALL} SELECT row_ord, price, price_warning FROM pr")
def h03_prices(spark, d):
    return priced(spark, d).select("row_ord", "price", "price_warning")


@query(f"{_I} SELECT row_ord, 'd_mm >= dd_mm' AS warning FROM items WHERE d_mm >= dd_mm")
def h04_dimension_warnings(spark, d):
    return H.dimension_warnings(items(spark, d))


@query(f"{_I}, f AS (SELECT sheet, name n, min(row_ord) f FROM items GROUP BY 1, 2) SELECT sheet, string_agg(n, ';' ORDER BY f) name_all, arg_min(n, f) name_first FROM f GROUP BY 1")
def h05_group_texts(spark, d):
    return H.group_texts(items(spark, d), ["sheet"], ["name"])


def _long(spark, d):
    i = items(spark, d).withColumn("note", F.when(F.col("row_ord") % 500 == 1, "x")).withColumn("empty", F.lit(None).cast("string"))
    return wide_to_long(i, ["sheet", "row_ord"], ["d_mm", "dd_mm", "note", "empty"])


@query(f"{_I} SELECT sheet, 'd_mm' AS label, count(*) n FROM items GROUP BY 1 UNION ALL SELECT sheet, 'dd_mm', count(*) FROM items GROUP BY 1 UNION ALL SELECT sheet, 'note', count(*) FROM items WHERE row_ord % 500 = 1 GROUP BY 1")
def h06_spec_columns(spark, d):
    return H.spec_columns(_long(spark, d))


@query(f"{_I}, b AS (SELECT sheet, CASE WHEN sheet LIKE '%1' AND row_ord % 9 = 0 THEN NULL WHEN sheet LIKE '%2' AND row_ord % 9 = 0 THEN 'B2' ELSE 'B' END brand FROM items) SELECT sheet, CASE WHEN count(DISTINCT brand) = 1 AND count(*) = count(brand) THEN min(brand) END brand FROM b GROUP BY 1")
def h06_group_brand(spark, d):
    ninth = F.col("row_ord") % 9 == 0
    b = F.when(F.col("sheet").endswith("1") & ninth, F.lit(None)).when(F.col("sheet").endswith("2") & ninth, "B2").otherwise("B")
    return H.group_brand(items(spark, d).withColumn("brand", b), ["sheet"])


@query(f"{_I} SELECT sheet, 'Size' AS label, row_ord, CASE WHEN sheet LIKE '%1' THEN 'Size' ELSE 'Size' || chr(10) || '(mm)' END new_label, CASE WHEN sheet LIKE '%1' THEN CASE WHEN row_ord % 10 = 0 THEN 'about 5' ELSE d_mm || ' mm' END ELSE CAST(d_mm::DOUBLE AS VARCHAR) END new_value FROM items WHERE sheet NOT LIKE '%1' OR sheet IN (SELECT sheet FROM items WHERE row_ord % 10 = 0)")
def h07_lift_units(spark, d):
    """Sheets ending in 1 have some values without a unit, so nothing is lifted there."""
    one = F.col("sheet").endswith("1")
    i = items(spark, d)
    v = F.when(one & (F.col("row_ord") % 10 == 0), "about 5").otherwise(F.concat(F.col("d_mm").cast("string"), F.lit(" mm")))
    mixed = i.where("row_ord % 10 = 0").select("sheet").distinct()
    return H.lift_units(i.where(~one).unionByName(i.where(one).join(mixed, "sheet", "left_semi").select(*i.columns)).select("sheet", F.lit("Size").alias("label"), "row_ord", v.alias("value")))


@query(f"{_I} SELECT row_ord, CAST(CASE WHEN row_ord % 3 = 1 THEN d_mm + 100 ELSE d_mm END AS VARCHAR) n, 'mm' unit, 'Length' AS label FROM items WHERE row_ord % 3 > 0 AND row_ord % 2 = 0 AND (row_ord % 3 = 1)")
def h08_stated_but_missing(spark, d):
    """Descriptions state a length; a spec holds it on two rows of three, and the length column is empty on even rows."""
    i = items(spark, d)
    n = F.when(F.col("row_ord") % 3 == 1, F.col("d_mm") + 100).otherwise(F.col("d_mm")).cast("string")
    rows = i.select("sheet", "row_ord", F.concat(F.lit("Bolt "), n, F.lit(" mm long")).alias("description"))
    specs = i.select("row_ord", F.lit("d").alias("label"), F.col("d_mm").cast("string").alias("value"), F.lit("mm").alias("unit"))
    specs = specs.unionByName(i.where("row_ord % 2 = 0").select("row_ord", F.lit("Length").alias("label"), F.lit(None).cast("string").alias("value"), F.lit("mm").alias("unit")))
    return H.stated_but_missing(rows, specs)


def _described(spark, d):
    """Items with a description that repeats code, maker and measures around the name."""
    c = lambda x: F.col(x).cast("string")
    told = F.concat("code", F.lit(" "), "name", F.lit(" - "), "sheet", F.lit(", dài "), c("d_mm"), F.lit(" MM x "), c("dd_mm"), F.lit("; 55 kg"))
    specs = F.array(F.struct(c("d_mm").alias("n"), F.lit("mm").alias("unit")), F.struct(c("dd_mm").alias("n"), F.lit("mm").alias("unit")))
    return items(spark, d).withColumn("description", told).withColumn("clean", X.clean_desc(F.col("description"), F.col("code"), F.col("sheet"), specs))


@query(f"{_I} SELECT row_ord, name || ' - , x ' || dd_mm AS clean FROM items")
def x37_clean_descriptions(spark, d):
    return _described(spark, d).select("row_ord", "clean")


@query(f"{_I} SELECT sheet, name || ' - , x ' || dd_mm AS clean, d_mm, dd_mm, count(DISTINCT code) n_codes, min(row_ord) first_ord FROM items GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT code) > 1")
def h09_indistinct_rows(spark, d):
    return H.indistinct_rows(_described(spark, d), ["sheet", "clean", "d_mm", "dd_mm"])


_TAGS = "tg AS (SELECT row_ord, CASE row_ord % 5 WHEN 0 THEN upper(substr(name, 1, 2)) WHEN 1 THEN substr(name, 1, 1) WHEN 2 THEN name || '_Đường-Kính' WHEN 3 THEN 'Ø' || substr(name, 1, 3) ELSE upper(substr(name, 1, 1)) || substr(name, 2, 2) END AS label, name, code FROM items)"


@query(rf"""{_I}, {_TAGS}, le AS (SELECT *, regexp_replace(label, '[^\p{{L}}]', '', 'g') l, length(regexp_replace(label, '[^\p{{Lu}}]', '', 'g')) up FROM tg) SELECT row_ord, trim(lower(regexp_replace(strip_accents(replace(replace(label, 'đ', 'd'), 'Đ', 'D')), '[\s_-]+', ' ', 'g'))) header, length(l) <= 1 OR regexp_matches(label, '[ΦφØøΔδ₀0-9]') OR up >= length(l) - 1 AS symbol, substr(sha256(CAST(to_json({{'code': code, 'name': name, 'v': 2}}) AS VARCHAR)), 1, 16) AS key FROM le""".replace("\\\\", "\\"))
def x25_x34_x39_labels(spark, d):
    """Header folding, the symbol test and cache keys over labels made from the names."""
    m, n = F.col("row_ord") % 5, F.col("name")
    label = F.when(m == 0, F.upper(F.substring(n, 1, 2))).when(m == 1, F.substring(n, 1, 1)).when(m == 2, F.concat(n, F.lit("_Đường-Kính"))).when(m == 3, F.concat(F.lit("Ø"), F.substring(n, 1, 3))).otherwise(F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 2)))
    rows = items(spark, d).withColumn("label", label)
    return rows.select("row_ord", X.fold_header(F.col("label")).alias("header"), X.is_symbol(F.col("label")).alias("symbol"), X.content_key(2, code=F.col("code"), name=n).alias("key"))


@query(f"{_I} SELECT DISTINCT name, CASE WHEN contains(' ' || name || ' ', ' bolt ') THEN 'fastener' WHEN contains(' ' || name || ' ', ' ring ') OR contains(' ' || name || ' ', ' gear ') THEN 'drive' ELSE 'default' END family, contains(' ' || name || ' ', ' bolt ') OR contains(' ' || name || ' ', ' ring ') OR contains(' ' || name || ' ', ' gear ') matched FROM items")
def h10_families(spark, d):
    families = spark.createDataFrame([(1, "fastener", "bolt"), (2, "drive", "ring"), (2, "drive", "gear")], "rank int, family string, keyword string")
    return H.match_families(items(spark, d).select("name").distinct(), families, "default")


def _coded(spark, d):
    """Items with plain, small, prefixed and unparseable codes."""
    m = F.col("row_ord") % 4
    three = F.substring("code", 2, 3)
    return items(spark, d).withColumn("code", F.when(m == 1, F.concat(F.lit("NU"), three)).when(m == 2, three).when((m == 3) & (F.col("row_ord") % 8 == 3), "XX").otherwise(F.col("code")))


@query(f"""{_I}, {_CODED}, {_SERIES.replace('FROM items', 'FROM coded')}, o AS (SELECT *, CASE WHEN series = 'mini' THEN 0 WHEN series = 'other' THEN 3 WHEN regexp_matches(series, '^[A-Z]') THEN 2 ELSE 1 END kind, regexp_extract(series, '^([A-Z]*)', 1) p, coalesce(TRY_CAST(regexp_extract(series, '([0-9]+)$', 1) AS BIGINT), 0) num FROM sr)
SELECT row_ord, series, CASE WHEN series = 'mini' THEN 'LOẠI MINI' WHEN series <> 'other' THEN 'DÒNG ' || series || '00' END series_label, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY kind, p, num) AS INT) sub FROM o""")
def h11_split_series(spark, d):
    return L.split_series(_coded(spark, d)).select("row_ord", "series", "series_label", "sub")


@query(f"{_I}, f AS (SELECT *, min(row_ord) OVER (PARTITION BY sheet, name) f FROM items) SELECT row_ord, name part_key, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY f) AS INT) sub FROM f")
def h11_split_column(spark, d):
    return L.split_column(items(spark, d), "name").select("row_ord", "part_key", "sub")


@query(rf"{_I}, k AS (SELECT row_ord, sheet, coalesce(nullif(regexp_extract(code, '-([0-9])RS$', 1), ''), 'other') part_key FROM items), f AS (SELECT *, min(row_ord) OVER (PARTITION BY sheet, part_key) f FROM k) SELECT row_ord, part_key, CASE WHEN part_key <> 'other' THEN 'DÒNG ' || part_key END part_label, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY f) AS INT) sub FROM f")
def h11_split_regex(spark, d):
    return L.split_regex(items(spark, d), "-([0-9])RS$").select("row_ord", "part_key", "part_label", "sub")


_DESC = "ds AS (SELECT *, CASE WHEN row_ord % 9 = 4 THEN NULL ELSE name || CASE row_ord % 3 WHEN 0 THEN ' Coarse grit' WHEN 1 THEN ', fine GRIT -' ELSE '' END END desc_clean FROM items)"


@query(rf"""{_I}, {_DESC}, v AS (SELECT *, regexp_extract(coalesce(desc_clean, ''), '(?i)(coarse|fine) grit', 1) va FROM ds), b AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(desc_clean, ''), '(?i)(coarse|fine) grit', ' '), '\s+', ' ', 'g'), ' -,') part_key FROM v), f AS (SELECT *, min(row_ord) OVER (PARTITION BY sheet, part_key) f FROM b)
SELECT row_ord, part_key, nullif(upper(part_key), '') title, CASE WHEN desc_clean IS NOT NULL THEN 'Grit=' || va || ';' ELSE '' END || 'd=' || d_mm AS specs, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY f) AS INT) sub FROM f""")
def h11_split_description(spark, d):
    m = F.col("row_ord") % 3
    text = F.concat("name", F.when(m == 0, " Coarse grit").when(m == 1, ", fine GRIT -").otherwise(""))
    rows = items(spark, d).withColumns({"desc_clean": F.when(F.col("row_ord") % 9 != 4, text), "specs": F.create_map(F.lit("d"), F.col("d_mm").cast("string"))})
    return L.split_description(rows, "(coarse|fine) grit", "Grit").select("row_ord", "part_key", "title", _flat("specs").alias("specs"), "sub")


def _flat(specs: str):
    """A map of specs as text, by label."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(specs)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


_FOLDP = lambda x: f"trim(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g'))"
_HEADS = "hl AS (SELECT DISTINCT sheet, CASE WHEN sheet LIKE '%4' THEN CASE row_ord % 2 WHEN 0 THEN 'Quy Cách' ELSE 'Số' END ELSE CASE row_ord % 4 WHEN 0 THEN 'Chiều Dài' WHEN 1 THEN 'd_mm' WHEN 2 THEN 'dd_mm' ELSE split_part(name, ' ', 2) || ' dài' END END AS label, CASE WHEN sheet LIKE '%4' THEN row_ord % 2 ELSE row_ord % 4 END pos FROM items WHERE d_mm % 3 = 0)"


@query(f"""{_I.replace('WITH', 'WITH RECURSIVE')}, {_HEADS}, hc AS (SELECT sheet, list({{'pos': pos, 'label': label, 'plain': {_FOLDP('label')}, 'num': label LIKE '%_mm' OR label = 'Số'}} ORDER BY pos, label) cols FROM hl GROUP BY 1), hp(rank, pattern) AS (VALUES (1, '_mm'), (2, '_mm'), (3, '(?i)chieu dai'), (4, 'ring dài'), (5, 'nothing'), (6, 'd_mm')),
st AS (SELECT sheet, cols, 0 rank, '' pattern, NULL::VARCHAR label, []::VARCHAR[] taken, '' how FROM hc UNION ALL SELECT sheet, cols, rank, pattern, label, CASE WHEN label IS NULL THEN taken ELSE list_append(taken, label) END, CASE WHEN label IS NULL THEN 'MISSING' WHEN label = pattern THEN 'EXACT' ELSE 'MATCH' END FROM
 (SELECT s.sheet, s.cols, p.rank, p.pattern, s.taken, coalesce(list_filter(s.cols, lambda c: c.label = p.pattern AND NOT list_contains(s.taken, c.label))[1].label, list_filter(s.cols, lambda c: NOT list_contains(s.taken, c.label) AND (regexp_matches(c.label, p.pattern) OR regexp_matches(c.plain, p.pattern)))[1].label) label FROM st s JOIN hp p ON p.rank = s.rank + 1)),
fb AS (SELECT sheet, list_filter(cols, lambda c: c.num)[1].label label FROM st WHERE rank = 6 AND len(taken) = 0)
SELECT sheet, rank, pattern, label, how FROM st WHERE rank > 0 AND sheet NOT IN (SELECT sheet FROM fb WHERE label IS NOT NULL) UNION ALL SELECT sheet, 0, '', label, 'FALLBACK' FROM fb WHERE label IS NOT NULL""")
def h12_sort_columns(spark, d):
    """Column labels of a sheet come from its rows, so sheets differ in what they have."""
    n, odd = F.col("row_ord"), F.col("sheet").endswith("4")
    usual = F.when(n % 4 == 0, "Chiều Dài").when(n % 4 == 1, "d_mm").when(n % 4 == 2, "dd_mm").otherwise(F.concat(F.split("name", " ")[1], F.lit(" dài")))
    label = F.when(odd, F.when(n % 2 == 0, "Quy Cách").otherwise("Số")).otherwise(usual)
    labels = items(spark, d).where("d_mm % 3 = 0").select("sheet", label.alias("label"), F.when(odd, n % 2).otherwise(n % 4).alias("pos")).distinct()
    labels = labels.withColumn("numeric", F.col("label").endswith("_mm") | (F.col("label") == "Số"))
    patterns = spark.createDataFrame([(1, "_mm"), (2, "_mm"), (3, "(?i)chieu dai"), (4, "ring dài"), (5, "nothing"), (6, "d_mm")], "rank int, pattern string")
    return L.sort_columns(labels, patterns)


@query(f"{_I} SELECT row_ord, CAST(row_number() OVER (PARTITION BY sheet ORDER BY d_mm, dd_mm, CAST(regexp_extract(code, '^([0-9]+)', 1) AS BIGINT), length(code), row_ord) AS INT) AS position FROM items")
def h13_sorted_rows(spark, d):
    return H.sorted_rows(items(spark, d), ["d_mm", "dd_mm"]).select("row_ord", "position")


@query(f"{_I}, {_CODED}, {_SERIES.replace('FROM items', 'FROM coded')}, g AS (SELECT sheet, count(*) n, count(DISTINCT series) s, count(*) FILTER (series = 'other') u FROM sr GROUP BY 1) SELECT sheet, array_to_string(list_filter([CASE WHEN sheet LIKE '%1' THEN 'NO_RULE' END, CASE WHEN sheet LIKE '%2' THEN 'NO_SORT_COLUMN' END, CASE WHEN u > 0 THEN 'UNPARSEABLE_CODES' END, CASE WHEN n > 40 AND s <= 1 THEN 'LARGE' END, CASE WHEN sheet LIKE '%3' THEN 'BRANDS' END], lambda x: x IS NOT NULL), ',') flags FROM g")
def h14_plan_flags(spark, d):
    g = L.split_series(_coded(spark, d)).groupBy("sheet").agg(F.count("*").alias("n_rows"), F.max("sub").alias("n_sub"), F.count_if(F.col("series") == "other").alias("unparseable"))
    e = F.col("sheet").endswith
    return H.plan_flags(g.withColumns({"matched": ~e("1"), "sort_columns": F.when(e("2"), 0).otherwise(1), "n_brands": F.when(e("3"), 2).otherwise(1)}))


@query(f"{_I} SELECT name, CASE WHEN sheet < 'Brand#3' THEN 'd' ELSE 'd,dd' END labels, count(*) n_rows, count(DISTINCT sheet) n_sheets, min(row_ord) first_ord FROM items GROUP BY 1, 2")
def h15_merge_groups(spark, d):
    return H.merge_groups(items(spark, d).withColumn("labels", F.when(F.col("sheet") < "Brand#3", "d").otherwise("d,dd")))


_LABELS = "CASE WHEN sheet < 'Brand#3' THEN 'd' ELSE 'd,dd' END"
_GROUPS = f"li AS (SELECT *, {_LABELS} labels FROM items), gr AS (SELECT sheet, name, labels, min(row_ord) group_ord FROM li GROUP BY 1, 2, 3)"


def _labelled(spark, d):
    return items(spark, d).withColumn("labels", F.when(F.col("sheet") < "Brand#3", "d").otherwise("d,dd"))


@query(f"{_I}, {_GROUPS} SELECT name, labels, group_ord, row_ord, sheet FROM li JOIN gr USING (sheet, name, labels)")
def h15_merged_rows(spark, d):
    return H.merged_rows(_labelled(spark, d))


@query(
    f"{_I}, {_GROUPS}, tx AS (SELECT name, labels, group_ord, k.kind, k.pos, CASE k.n WHEN 0 THEN 'Steel' WHEN 1 THEN 'Sheet ' || sheet WHEN 2 THEN name ELSE 'd: ' || CAST(group_ord % 3 AS VARCHAR) END AS text FROM gr CROSS JOIN (VALUES ('lines', 0, 0), ('lines', 1, 1), ('lines', 2, 0), ('legend', 0, 3)) k(kind, pos, n)), "
    "firsts AS (SELECT *, row_number() OVER (PARTITION BY name, labels, kind, text ORDER BY group_ord, pos) r FROM tx), "
    "ones AS (SELECT name, labels, group_ord, 'note' AS kind, 'from ' || sheet AS text FROM gr WHERE group_ord % 2 = 0 UNION ALL SELECT name, labels, group_ord, 'image', CAST(group_ord AS VARCHAR) || '.png' FROM gr WHERE group_ord % 3 = 0) "
    "SELECT name, labels, kind, text, group_ord, pos FROM firsts WHERE r = 1 UNION ALL SELECT name, labels, kind, arg_min(text, group_ord), min(group_ord), 0 FROM ones GROUP BY 1, 2, 3"
)
def h15_merged_texts(spark, d):
    """Groups with a repeated line, a legend of three kinds, notes that may be blank and images that may be missing."""
    g = _labelled(spark, d).groupBy("sheet", "name", "labels").agg(F.min("row_ord").alias("group_ord"))
    at = F.col("group_ord")
    lines = F.array(F.lit("Steel"), F.concat(F.lit("Sheet "), "sheet"), F.lit("Steel"), F.lit(None))
    note = F.when(at % 2 == 0, F.concat(F.lit("from "), "sheet")).otherwise(F.lit(" "))
    return H.merged_texts(g.withColumns({"lines": lines, "legend": F.array(F.concat(F.lit("d: "), (at % 3).cast("string"))), "note": note, "image": F.when(at % 3 == 0, F.concat(at.cast("string"), F.lit(".png")))}))


@query(f"{_ALL} SELECT row_ord, order_code FROM pr WHERE dup_of IS NULL AND order_code IS NOT NULL")
def h16_live_rows(spark, d):
    return H.live_rows(priced(spark, d)).select("row_ord", "order_code")


@query(f"{_I} SELECT row_ord, row_ord % 9 = 0 no_brand FROM items WHERE row_ord % 9 = 0 OR lower(sheet) = 'brand#12'")
def h17_of_brand(spark, d):
    return H.of_brand(items(spark, d).withColumn("brand", F.when(F.col("row_ord") % 9 != 0, F.upper("sheet"))), "Brand#12").select("row_ord", "no_brand")


@query(f"{_ALL} SELECT order_code, code, price, row_ord FROM pr WHERE order_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_code ORDER BY row_ord) = 1")
def h18_price_table(spark, d):
    return H.price_table(priced(spark, d))


_SPECS = """sc AS (SELECT sheet, row_ord, 'Maker' AS label, 0 pos, sheet AS value FROM items UNION ALL SELECT sheet, row_ord, 'Noun', 1, split_part(name, ' ', 2) FROM items WHERE d_mm % 7 = 1 UNION ALL SELECT sheet, row_ord, 'd', 2, sheet FROM items UNION ALL SELECT sheet, row_ord, 'Size', 3, CAST(d_mm AS VARCHAR) FROM items WHERE d_mm <= 9 UNION ALL SELECT sheet, row_ord, 'Series' || chr(10) || '(x)', 4, CASE WHEN row_ord % 50 <> 3 OR sheet NOT LIKE '%2' THEN substr(code, 1, 1) END FROM items UNION ALL SELECT sheet, row_ord, 'Long label', 5, sheet || ' and more of the same' FROM items)"""


@query(f"""{_I}, {_SPECS}, cg AS (SELECT sheet, label, pos, split_part(label, chr(10), 1) || ': ' || min(value) AS line FROM sc GROUP BY sheet, label, pos HAVING count(*) >= 3 AND count(DISTINCT value) = 1 AND count(value) = count(*) AND length(split_part(label, chr(10), 1)) > 2)
SELECT sheet, label, line FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY pos) r FROM cg WHERE length(line) <= {H.LINE_MAX}) WHERE r < {H.LINES_MAX}""")
def h19_constant_lines(spark, d):
    """Columns of each sheet that are constant, varied, partly empty, too long or too short a label."""
    i = items(spark, d)
    parts = [
        (i, "Maker", F.col("sheet")), (i.where("d_mm % 7 = 1"), "Noun", F.split("name", " ")[1]), (i, "d", F.col("sheet")), (i.where("d_mm <= 9"), "Size", F.col("d_mm").cast("string")),
        (i, "Series\n(x)", F.when((F.col("row_ord") % 50 != 3) | ~F.col("sheet").endswith("2"), F.substring("code", 1, 1))), (i, "Long label", F.concat("sheet", F.lit(" and more of the same"))),
    ]
    frames = [df.select("sheet", "row_ord", F.lit(label).alias("label"), F.lit(pos).alias("pos"), value.alias("value")) for pos, (df, label, value) in enumerate(parts)]
    specs = frames[0]
    for more in frames[1:]:
        specs = specs.unionByName(more)
    return H.constant_lines(specs)


_COLS = "lc AS (SELECT DISTINCT sheet, CASE WHEN sheet LIKE '%3' THEN 'seal' ELSE 'bearing' END family, CASE row_ord % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'D' ELSE split_part(name, ' ', 2) END AS label, row_ord % 3 pos FROM items)"


@query(f"{_I}, {_COLS}, lg(family, label, line) AS (VALUES ('bearing', 'd', 'd: Inner'), ('bearing', 'D', 'D: Outer'), ('seal', 'ring', 'ring: Lip')), ow AS (SELECT sheet, name AS label, min(code) AS own FROM (SELECT sheet, split_part(name, ' ', 2) AS name, code FROM items WHERE d_mm = 11) GROUP BY 1, 2) SELECT sheet, label, pos, coalesce(own, line) AS line FROM lc LEFT JOIN lg USING (family, label) LEFT JOIN ow USING (sheet, label) WHERE coalesce(own, line) IS NOT NULL")
def h20_default_legend(spark, d):
    """Columns and some own legends come from the rows of a sheet."""
    i, m, noun = items(spark, d), F.col("row_ord") % 3, F.split("name", " ")[1]
    columns = i.select("sheet", F.when(F.col("sheet").endswith("3"), "seal").otherwise("bearing").alias("family"), F.when(m == 0, "d").when(m == 1, "D").otherwise(noun).alias("label"), m.alias("pos")).distinct()
    legends = spark.createDataFrame([("bearing", "d", "d: Inner"), ("bearing", "D", "D: Outer"), ("seal", "ring", "ring: Lip")], "family string, label string, line string")
    return H.default_legend(columns, legends, i.where("d_mm = 11").groupBy("sheet", noun.alias("label")).agg(F.min("code").alias("line")))


@query(f"{_CARD} SELECT row_ord, chunk, card_id FROM cd")
def h21_chunk_cards(spark, d):
    return carded(spark, d).select("row_ord", "chunk", "card_id")


def _patches(spark, d, bad: bool):
    """Changes in five passes: a spec, a new name for it, the spec by that name, brands of groups and of codes."""
    i = items(spark, d)
    n = F.min("row_ord").alias("f")
    none = F.lit(None).cast("string")
    by_code = lambda k, rest, seq, op, label, value: i.where(F.col("row_ord") % k == rest).groupBy("code").agg(n).select((F.col("f") * 10 + seq).alias("patch_id"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), none.alias("grp"), "code", F.lit(label).cast("string").alias("label"), F.lit(value).alias("value"))
    by_name = lambda k, seq, op, label, value: i.groupBy("name").agg(n).where(F.col("f") % k == 0).select((F.col("f") * 10 + seq).alias("patch_id"), F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.col("name").alias("grp"), none.alias("code"), F.lit(label).cast("string").alias("label"), F.lit(value).alias("value"))
    p = by_code(40, 1, 1, "set_spec", "D", "99 mm").unionByName(by_name(3, 2, "rename_label", "d", "Bore")).unionByName(by_code(50, 2, 3, "set_spec", "bore", "7")).unionByName(by_name(4, 4, "set_brand", None, "ACME")).unionByName(by_code(60, 3, 5, "set_brand", None, "Other"))
    p = p.withColumn("source", F.when((F.col("patch_id") % 3 == 0) & F.lit(bad), " ").otherwise("catalogue page"))
    lost = spark.createDataFrame([(-1, 9, "set_spec", None, "no such code", "d", "1", "page"), (-2, 9, "rename_label", "no such group", None, "d", "x", "page"), (-3, 9, "rename_label", None, None, "d", "x", "page")], "patch_id long, seq int, op string, grp string, code string, label string, value string, source string")
    heavy = i.groupBy("code").agg(n).where("f % 70 = 5").select((F.col("f") * 10 + 6).alias("patch_id"), F.lit(6).alias("seq"), F.lit("set_spec").alias("op"), none.alias("grp"), "code", F.lit("Outer").alias("label"), F.lit("20 kg").alias("value"), F.lit("page").alias("source"))
    return p.unionByName(lost).unionByName(heavy) if bad else p


def _priced_rows(spark, d):
    specs = F.create_map(F.lit("d\n(mm)"), F.col("d_mm").cast("string"), F.lit("Outer\n(mm)"), F.col("dd_mm").cast("string"))
    return items(spark, d).select(F.col("name").alias("grp"), "row_ord", "code", F.col("sheet").alias("brand"), specs.alias("specs"))


_PT = """c1 AS (SELECT code, min(row_ord) f FROM items WHERE row_ord % 40 = 1 GROUP BY 1), g2 AS (SELECT name, min(row_ord) f FROM items GROUP BY 1 HAVING min(row_ord) % 3 = 0), c3 AS (SELECT code, min(row_ord) f FROM items WHERE row_ord % 50 = 2 GROUP BY 1), g4 AS (SELECT name, min(row_ord) f FROM items GROUP BY 1 HAVING min(row_ord) % 4 = 0), c5 AS (SELECT code, min(row_ord) f FROM items WHERE row_ord % 60 = 3 GROUP BY 1),
c6 AS (SELECT code, min(row_ord) f FROM items GROUP BY 1 HAVING min(row_ord) % 70 = 5)"""


@query(f"""{_I}, {_PT}, r AS (SELECT i.*, code IN (SELECT code FROM c1) a1, name IN (SELECT name FROM g2) a2, code IN (SELECT code FROM c3) a3, name IN (SELECT name FROM g4) a4, code IN (SELECT code FROM c5) a5 FROM items i)
SELECT row_ord, CASE WHEN a5 THEN 'Other' WHEN a4 THEN 'ACME' ELSE sheet END brand, array_to_string(list_sort(list_filter([CASE WHEN a2 THEN 'Bore' ELSE 'd' END || chr(10) || '(mm)=' || CASE WHEN a2 AND a3 THEN '7' WHEN a1 THEN '99' ELSE CAST(d_mm AS VARCHAR) END, 'Outer' || chr(10) || '(mm)=' || dd_mm, CASE WHEN a3 AND NOT a2 THEN 'bore=7' END], lambda x: x IS NOT NULL)), ';') specs FROM r""")
def h22_apply_patches(spark, d):
    return L.replay_patches(_priced_rows(spark, d), _patches(spark, d, False))[0].select("row_ord", "brand", _flat("specs").alias("specs"))


_HITS = f"""{_I}, {_PT}, ht AS (SELECT f * 10 + 1 patch_id, 'set_spec' op, count(*) hits FROM c1 JOIN items USING (code) GROUP BY f UNION ALL SELECT f * 10 + 2, 'rename_label', 1 FROM g2 UNION ALL SELECT f * 10 + 3, 'set_spec', count(*) FROM c3 JOIN items USING (code) GROUP BY f UNION ALL SELECT f * 10 + 4, 'set_brand', count(*) FROM g4 JOIN items USING (name) GROUP BY f UNION ALL SELECT f * 10 + 5, 'set_brand', count(*) FROM c5 JOIN items USING (code) GROUP BY f)"""


@query(f"{_HITS} SELECT patch_id, op, hits FROM ht")
def h22_patch_hits(spark, d):
    return L.replay_patches(_priced_rows(spark, d), _patches(spark, d, False))[1].select("patch_id", "op", "hits")


@query(f"{_HITS} SELECT patch_id, 'NO_SOURCE' violation FROM ht WHERE patch_id % 3 = 0 UNION ALL SELECT unnest([-1, -2, -3]), 'NO_MATCH' UNION ALL SELECT f * 10 + 6, 'UNIT_MISMATCH' FROM c6")
def h22_patch_violations(spark, d):
    return L.replay_patches(_priced_rows(spark, d), _patches(spark, d, True))[2]


@query(f"{_I}, m AS (SELECT count(*) n FROM items) SELECT n, true AS unchanged FROM m")
def h22_refused_log(spark, d):
    """A log with violations leaves the multiset of rows as it was."""
    rows = _priced_rows(spark, d)
    flat = lambda df: L.row_digest(df.withColumn("s", _flat("specs")), "grp", "row_ord", "code", "brand", "s")
    after = flat(L.replay_patches(rows, _patches(spark, d, True))[0])
    return flat(rows).crossJoin(after.select(F.col("n").alias("m"), F.col("digest").alias("e"))).select("n", ((F.col("n") == F.col("m")) & (F.col("digest") == F.col("e"))).alias("unchanged"))  # one row each


def _unit_patches(spark, d):
    return items(spark, d).where("row_ord % 40 = 1").groupBy("code").agg(F.min("row_ord").alias("patch_id")).select("patch_id", F.lit("d").alias("label"), F.lit("99 mm").alias("value"))


@query(f"{_I}, p AS (SELECT code, min(row_ord) id FROM items WHERE row_ord % 40 = 1 GROUP BY 1) SELECT id patch_id, 'd' AS label, '99 mm' AS value, 'inch' unit FROM p")
def x40_unit_conflicts(spark, d):
    return H.unit_conflicts(_unit_patches(spark, d), spark.createDataFrame([("d", "inch")], "label string, unit string"))


_EDITS = """e0 AS (SELECT min(row_ord) f, card_id FROM cd GROUP BY card_id), e1 AS (SELECT f edit_id, CASE WHEN f % 17 = 0 THEN 'none' ELSE card_id END card_id, CASE f % 6 WHEN 1 THEN 'note' WHEN 2 THEN 'rows' WHEN 4 THEN 'lines' WHEN 5 THEN 'legend' ELSE 'title' END field, 'NEW ' || card_id AS value FROM e0), ed AS (SELECT * FROM e1 UNION ALL SELECT edit_id + 100000000, card_id, field, value || ' again' FROM e1 WHERE edit_id % 19 = 0)"""


def _edits(spark, d):
    f = F.col("edit_id") % 6
    g = carded(spark, d).groupBy("card_id").agg(F.min("row_ord").alias("edit_id"))
    field = F.when(f == 1, "note").when(f == 2, "rows").when(f == 4, "lines").when(f == 5, "legend").otherwise("title")
    e = g.select("edit_id", F.when(F.col("edit_id") % 17 == 0, "none").otherwise(F.col("card_id")).alias("card_id"), field.alias("field"), F.concat(F.lit("NEW "), "card_id").alias("value"))
    e = e.unionByName(e.where("edit_id % 19 = 0").withColumns({"edit_id": F.col("edit_id") + 100000000, "value": F.concat("value", F.lit(" again"))}))
    return e.withColumn("items", F.array(F.col("value"), F.lit("Second Line")))


_EV = f"{_CARDS}, {_EDITS}, ev0 AS (SELECT e.*, CASE WHEN c.title_source IS NULL THEN 'UNKNOWN_CARD' WHEN field NOT IN ('title','lines','legend','note') THEN 'FIELD' WHEN field = 'title' AND c.title_source = 'data' THEN 'TITLE_FROM_DATA' END v FROM ed e LEFT JOIN cards c USING (card_id)), ev AS (SELECT *, CASE WHEN v IS NOT NULL THEN v WHEN row_number() OVER (PARTITION BY card_id, field, v ORDER BY edit_id) > 1 THEN 'CONFLICT' END violation FROM ev0)"


@query(f"{_EV} SELECT edit_id, violation FROM ev WHERE violation IS NOT NULL")
def h23_edit_violations(spark, d):
    return L.validate_edits(_edits(spark, d), cards(spark, d))


@query(f"""{_EV}, ok AS (SELECT * FROM ev WHERE violation IS NULL) SELECT card_id, coalesce((SELECT max(value) FROM ok WHERE ok.card_id = c.card_id AND field = 'title'), title) title, coalesce((SELECT max(value) FROM ok WHERE ok.card_id = c.card_id AND field = 'note'), note) note,
 coalesce((SELECT max(value) || ';Second Line' FROM ok WHERE ok.card_id = c.card_id AND field = 'lines'), array_to_string(lines, ';')) AS lines, coalesce((SELECT max(value) || ';Second Line' FROM ok WHERE ok.card_id = c.card_id AND field = 'legend'), array_to_string(legend, ';')) legend FROM cards c""")
def h23_apply_edits(spark, d):
    """Edits that nothing speaks against."""
    e, c = _edits(spark, d), cards(spark, d)
    out = L.apply_edits(c, e.join(L.validate_edits(e, c).select("edit_id"), "edit_id", "left_anti"))
    return out.select("card_id", "title", "note", F.array_join("lines", ";").alias("lines"), F.array_join("legend", ";").alias("legend"))


@query(f"{_CARDS} SELECT card_id, title, array_to_string(lines, ';') AS lines FROM cards")
def h23_refused_edits(spark, d):
    """Edits of which some are violations change nothing."""
    return L.apply_edits(cards(spark, d), _edits(spark, d)).select("card_id", "title", F.array_join("lines", ";").alias("lines"))


_KB = """kb AS (SELECT code, min(name) title, [min(sheet)] AS lines, CASE WHEN min(row_ord) % 4 = 1 THEN ['d: Inner'] ELSE [] END legend, CASE WHEN min(row_ord) % 2 = 0 THEN 'ok' ELSE 'review' END status FROM items WHERE row_ord % 3 <> 0 GROUP BY 1),
ln AS (SELECT code, CASE WHEN min(row_ord) % 5 = 0 THEN min(name) || ' NEW' ELSE min(name) END title, CASE WHEN min(row_ord) % 7 = 0 THEN ['other'] ELSE [min(sheet)] END AS lines, CASE WHEN min(row_ord) % 4 = 1 THEN ['d: Inner'] ELSE [] END legend FROM items GROUP BY 1)"""


def _kb_legend():
    return F.when(F.col("f") % 4 == 1, F.array(F.lit("d: Inner"))).otherwise(F.array().cast("array<string>")).alias("legend")


def _kb(spark, d):
    g = items(spark, d).where("row_ord % 3 <> 0").groupBy("code").agg(F.min("name").alias("title"), F.min("sheet").alias("s"), F.min("row_ord").alias("f"))
    return g.select("code", "title", F.array("s").alias("lines"), _kb_legend(), F.when(F.col("f") % 2 == 0, "ok").otherwise("review").alias("status"))


def _learned(spark, d):
    g = items(spark, d).groupBy("code").agg(F.min("name").alias("t"), F.min("sheet").alias("s"), F.min("row_ord").alias("f"))
    return g.select("code", F.when(F.col("f") % 5 == 0, F.concat("t", F.lit(" NEW"))).otherwise(F.col("t")).alias("title"), F.array(F.when(F.col("f") % 7 == 0, "other").otherwise(F.col("s"))).alias("lines"), _kb_legend())


_DIFF = "(k.title <> l.title OR k.lines <> l.lines OR k.legend <> l.legend)"


@query(f"{_I}, {_KB}, b AS (SELECT coalesce(k.code, l.code) code, k.title kt, k.lines kl, k.legend kg, k.status, l.title lt, l.lines ll, l.legend lg, l.code IS NULL OR (k.code IS NOT NULL AND {_DIFF} AND k.status = 'ok') keep FROM kb k FULL JOIN ln l ON k.code = l.code) SELECT code, CASE WHEN keep THEN kt ELSE lt END title, array_to_string(CASE WHEN keep THEN kl ELSE ll END, ';') AS lines, array_to_string(CASE WHEN keep THEN kg ELSE lg END, ';') legend, CASE WHEN keep THEN status ELSE 'review' END status FROM b")
def h24_kb_learn(spark, d):
    stored = L.kb_learn(_kb(spark, d), _learned(spark, d))[0]
    return stored.withColumns({"lines": F.array_join("lines", ";"), "legend": F.array_join("legend", ";")})


@query(f"{_I}, {_KB} SELECT k.code, k.title, l.title AS new, k.status FROM kb k JOIN ln l ON k.code = l.code WHERE {_DIFF}")
def h24_kb_conflicts(spark, d):
    return L.kb_learn(_kb(spark, d), _learned(spark, d))[1]


@query(f"""{_CARDS}, {_KB}, kr AS (SELECT cd.card_id, cd.row_ord, cd.code, c.title_source = 'data' fixed, kb.title kt, kb.lines kl, kb.legend kg FROM cd JOIN cards c USING (card_id) LEFT JOIN kb ON kb.code = cd.code),
ca AS (SELECT card_id, count(DISTINCT kt) nt, bool_and(kt IS NOT NULL) alln, arg_min(kt, row_ord) t1, arg_min({{'l': kl, 'g': kg}}, row_ord) FILTER (kt IS NOT NULL) e1 FROM kr GROUP BY 1), tf AS (SELECT card_id, kt, min(row_ord) f, arg_min({{'l': kl, 'g': kg}}, row_ord) e FROM kr GROUP BY ALL), tn AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY kt IS NULL, f) part FROM tf)
SELECT k.row_ord, k.code, CASE WHEN NOT fixed AND nt >= 2 THEN k.card_id || '-' || part ELSE k.card_id END card_id,
 CASE WHEN fixed OR nt = 0 THEN c.title WHEN nt >= 2 THEN coalesce(k.kt, c.title) WHEN alln THEN t1 ELSE c.title END title,
 array_to_string(CASE WHEN NOT fixed AND nt >= 2 THEN CASE WHEN k.kt IS NULL THEN c.lines ELSE tn.e.l END WHEN nt > 0 AND (fixed OR alln) AND len(c.lines) = 0 THEN e1.l ELSE c.lines END, ';') AS lines,
 array_to_string(CASE WHEN NOT fixed AND nt >= 2 THEN CASE WHEN k.kt IS NULL THEN c.legend ELSE tn.e.g END WHEN nt > 0 AND (fixed OR alln) AND len(c.legend) = 0 THEN e1.g ELSE c.legend END, ';') legend
FROM kr k JOIN cards c USING (card_id) JOIN ca USING (card_id) JOIN tn ON tn.card_id = k.card_id AND tn.kt IS NOT DISTINCT FROM k.kt""")
def h25_kb_apply(spark, d):
    rows, made = L.kb_apply(carded(spark, d).select("card_id", "row_ord", "code"), cards(spark, d), _kb(spark, d))
    return rows.join(made, "card_id").select("row_ord", "code", "card_id", "title", F.array_join("lines", ";").alias("lines"), F.array_join("legend", ";").alias("legend"))


@query(f"{_CARDS}, {_KB} SELECT count(*) n, true AS unchanged FROM cd")
def h25_rows_unchanged(spark, d):
    """Rows after the knowledge base are the same multiset as before."""
    before = carded(spark, d).select("card_id", "row_ord", "code")
    a, b = L.row_digest(before, "row_ord", "code"), L.row_digest(L.kb_apply(before, cards(spark, d), _kb(spark, d))[0], "row_ord", "code")
    return a.crossJoin(b.select(F.col("n").alias("m"), F.col("digest").alias("e"))).select("n", ((F.col("n") == F.col("m")) & (F.col("digest") == F.col("e"))).alias("unchanged"))  # one row each


@query(f"{_I}, {_KB} SELECT code, title, CASE WHEN status = 'review' AND code LIKE '60%' THEN 'ok' ELSE status END status FROM kb")
def h26_kb_approve(spark, d):
    kb = _kb(spark, d)
    return H.kb_approve(kb, kb.where("code like '60%'"))


@query(f"{_I}, {_KB} SELECT code, k.title title_a, l.title title_b FROM kb k JOIN ln l USING (code) WHERE k.title <> l.title")
def h26_kb_diff(spark, d):
    return H.kb_diff(_kb(spark, d), _learned(spark, d))


@query(f"""{_CARDS}, v AS (SELECT card_id, unnest(list_filter([
CASE WHEN title <> upper(title) THEN 'error|TITLE_CASE' END, CASE WHEN regexp_matches(trim(title), '^(KHÔNG TIÊU ĐỀ|UNTITLED|NO TITLE|TIÊU ĐỀ)?$') THEN 'error|TITLE_PLACEHOLDER' END, CASE WHEN contains(title, ':') THEN 'error|TITLE_COLON' END, CASE WHEN length(title) > 40 THEN 'error|TITLE_LONG' END,
CASE WHEN len(list_filter(lines, lambda x: length(x) > 28)) > 0 THEN 'error|LINE_LONG' END, CASE WHEN len(list_filter(lines, lambda x: length(x) < 3)) > 0 THEN 'error|LINE_JUNK' END, CASE WHEN list_contains(lines, 'lower case words here and more') THEN 'warning|LINE_TITLE_CASE' END, CASE WHEN len(lines) = 0 THEN 'warning|NO_LINES' END, CASE WHEN length(note) > 110 THEN 'warning|NOTE_LONG' END, CASE WHEN image IS NULL THEN 'warning|NO_IMAGE' END], lambda x: x IS NOT NULL)) x FROM cards)
SELECT card_id, split_part(x, '|', 1) severity, split_part(x, '|', 2) AS rule FROM v""")
def h27_lint_cards(spark, d):
    return H.lint_cards(cards(spark, d))


#: cards with legends, drawings and columns that break the rules in turn
_LC = f"""{_CARDS}, lf AS (SELECT card_id, min(row_ord) f FROM cd GROUP BY 1), lc AS (SELECT card_id, f AS ord, title, title_source, CASE WHEN f % 6 = 1 THEN list_append(lines, 'AB: text') ELSE lines END AS lines, CASE f % 4 WHEN 0 THEN ['d: Inner'] WHEN 1 THEN ['D: Outer (mm)', 'bad'] WHEN 2 THEN ['D: Outer'] ELSE [] END legend, CASE WHEN f % 9 = 0 THEN 'b.png' END drawing, image, CASE WHEN f % 4 = 0 THEN 'review' ELSE 'ok' END image_status FROM cards JOIN lf USING (card_id)),
lk AS (SELECT card_id, f, 0 pos, CASE WHEN f % 13 = 2 THEN 'spec' ELSE 'code' END AS role, 'Mã' AS label FROM lf UNION ALL SELECT card_id, f, 1, 'spec', CASE f % 3 WHEN 0 THEN 'd' || chr(10) || 'mm' WHEN 1 THEN 'D' || chr(10) || '(inch)' ELSE 'Chiều Dài' || chr(10) || '(mm)' END FROM lf UNION ALL SELECT card_id, f, 2, 'spec', CASE WHEN f % 5 = 0 THEN 'L' ELSE 'Size' END FROM lf UNION ALL SELECT card_id, f, 3, 'order_code', 'Order' FROM lf UNION ALL SELECT card_id, f, 4, 'price', 'Price' FROM lf)"""


def _lint_input(spark, d):
    first = carded(spark, d).groupBy("card_id").agg(F.min("row_ord").alias("f"))
    f = F.col("f")
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    legend = F.when(f % 4 == 0, strings("d: Inner")).when(f % 4 == 1, strings("D: Outer (mm)", "bad")).when(f % 4 == 2, strings("D: Outer")).otherwise(strings())
    c = cards(spark, d).drop("legend").join(first, "card_id")
    c = c.select("card_id", f.alias("ord"), "title", "title_source", F.when(f % 6 == 1, F.array_append("lines", "AB: text")).otherwise(F.col("lines")).alias("lines"), legend.alias("legend"), F.when(f % 9 == 0, "b.png").alias("drawing"), "image", F.when(f % 4 == 0, "review").otherwise("ok").alias("image_status"))
    one = F.when(f % 3 == 0, "d\nmm").when(f % 3 == 1, "D\n(inch)").otherwise("Chiều Dài\n(mm)")
    cols = [(F.when(f % 13 == 2, "spec").otherwise("code"), F.lit("Mã")), (F.lit("spec"), one), (F.lit("spec"), F.when(f % 5 == 0, "L").otherwise("Size")), (F.lit("order_code"), F.lit("Order")), (F.lit("price"), F.lit("Price"))]
    k = first.select("card_id", F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), r.alias("role"), x.alias("label")) for i, (r, x) in enumerate(cols)))).alias("c")).select("card_id", "c.*")
    return c, k


@query(f"""{_LC} SELECT card_id, 'error' severity, 'LEGEND_IN_LINES' AS rule FROM lc WHERE ord % 6 = 1 UNION ALL SELECT card_id, 'error', 'LEGEND_FORM' FROM lc WHERE ord % 4 = 1 UNION ALL SELECT card_id, 'warning', 'IMAGE_REVIEW' FROM lc WHERE image IS NOT NULL AND image_status = 'review'
UNION ALL SELECT card_id, 'error', 'COLUMN_ROLES' FROM (SELECT card_id, list(role ORDER BY pos) r FROM lk GROUP BY 1) WHERE r[1] <> 'code' OR r[len(r) - 1] <> 'order_code' OR r[len(r)] <> 'price' OR len(list_filter(r, lambda x: x = 'price')) <> 1""")
def h27_lint_sequences(spark, d):
    c, k = _lint_input(spark, d)
    return N.lint_legends(c).unionByName(N.lint_roles(k))


@query(f"""{_LC}, sy AS (SELECT card_id, label, regexp_extract(label, '^([A-Za-z]+)', 1) s, regexp_extract(label, '\\((mm|inch)\\)', 1) u, list_transform(list_filter(legend, lambda x: contains(x, ': ')), lambda x: split_part(x, ':', 1)) ls, legend, drawing FROM lk JOIN lc USING (card_id) WHERE role = 'spec' AND regexp_matches(label, '^[dDL](\\n.*)?$'))
SELECT card_id, label, 'error' severity, 'LETTER_CASE' AS rule FROM sy WHERE NOT list_contains(ls, s) AND list_contains(list_transform(ls, lambda x: lower(x)), lower(s)) UNION ALL SELECT card_id, label, 'error', 'LETTER_WITHOUT_LEGEND' FROM sy WHERE NOT list_contains(list_transform(ls, lambda x: lower(x)), lower(s)) AND drawing IS NULL
UNION ALL SELECT card_id, label, 'warning', 'LEGEND_UNIT' FROM sy WHERE u <> '' AND len(list_filter(legend, lambda x: split_part(x, ':', 1) = s AND regexp_extract(x, '\\((mm|inch)\\)', 1) NOT IN ('', u))) > 0""")
def h27_lint_letters(spark, d):
    c, k = _lint_input(spark, d)
    return N.lint_letters(k, c)


@query(f"""{_LC}, sg AS (SELECT lc.*, concat_ws('|', (SELECT string_agg(label, '|' ORDER BY pos) FROM lk WHERE lk.card_id = lc.card_id), coalesce(image, '-')) sig FROM lc), fs AS (SELECT *, min(ord) OVER (PARTITION BY title) f0, first_value(sig) OVER (PARTITION BY title ORDER BY ord) s0 FROM sg)
SELECT card_id, CASE WHEN title_source = 'data' AND sig <> s0 THEN 'warning' ELSE 'error' END severity, CASE WHEN title_source = 'data' AND sig <> s0 THEN 'TITLE_AGAIN_IN_DATA' ELSE 'TITLE_AGAIN' END AS rule FROM fs WHERE ord > f0""")
def h27_lint_titles(spark, d):
    return N.lint_titles(*_lint_input(spark, d))


@query(f"{_LC} SELECT 'Chiều Dài / L' AS labels, 'warning' severity, 'SYNONYMS' AS rule FROM lk HAVING bool_or(split_part(label, chr(10), 1) = 'Chiều Dài') AND bool_or(label = 'L')")
def h27_lint_synonyms(spark, d):
    return N.lint_synonyms(_lint_input(spark, d)[1])


@query(f"""{_CARD}, e AS (SELECT *, min(card_id) OVER (PARTITION BY order_code) <> max(card_id) OVER (PARTITION BY order_code) els FROM cd) SELECT row_ord, 'error' severity, 'ORDER_CODE' AS rule FROM e WHERE order_code IS NULL UNION ALL SELECT row_ord, 'error', 'ORDER_CODE_ELSEWHERE' FROM e WHERE els AND order_code IS NOT NULL""")
def h27_lint_rows(spark, d):
    return H.lint_rows(carded(spark, d))


_LABELS = "lb AS (SELECT DISTINCT sheet, CASE row_ord % 6 WHEN 0 THEN name || ' mm' WHEN 1 THEN split_part(name, ' ', 2) || ' (Inch)' WHEN 2 THEN substr(name, 1, 1) || ' mm' WHEN 3 THEN name WHEN 4 THEN split_part(name, ' ', 1) || chr(10) || '(mm)' ELSE upper(substr(name, 1, 2)) || ' mm2' END AS label FROM items)"
_UNITRX = r"^(.*?)[ ]*\(?\b(Inch|INCH|inch|in|lbs|kg|mm²|mm2|mm|cm|N\.m|g|V|W)\)?$"


@query(rf"""{_I}, {_LABELS}, l1 AS (SELECT sheet, label, regexp_replace(trim(label), '[ \t]+', ' ', 'g') s, replace(regexp_replace(trim(label), '[ \t]+', ' ', 'g'), chr(10), ' ') fl FROM lb), l2 AS (SELECT *, trim(regexp_extract(fl, '{_UNITRX}', 1)) nm, regexp_extract(fl, '{_UNITRX}', 2) u0 FROM l1), l3 AS (SELECT *, CASE WHEN u0 IN ('Inch', 'INCH', 'in') THEN 'inch' WHEN u0 = 'mm2' THEN 'mm²' ELSE u0 END u FROM l2),
l4 AS (SELECT sheet, label, CASE WHEN nm = '' THEN s WHEN regexp_matches(nm, '^[A-Za-zΦφØøΔδ][A-Za-z0-9₀]{{0,2}}$') AND u = 'mm' AND NOT contains(fl, '(') THEN nm || chr(10) || 'mm' ELSE nm || chr(10) || '(' || u || ')' END fixed FROM l3) SELECT sheet, label, fixed FROM l4 WHERE fixed <> label""")
def h27_lint_labels(spark, d):
    """X28 over labels made from the names of every sheet."""
    m, noun, first = F.col("row_ord") % 6, F.split("name", " ")[1], F.split("name", " ")[0]
    label = (
        F.when(m == 0, F.concat("name", F.lit(" mm"))).when(m == 1, F.concat(noun, F.lit(" (Inch)"))).when(m == 2, F.concat(F.substring("name", 1, 1), F.lit(" mm"))).when(m == 3, F.col("name"))
        .when(m == 4, F.concat(first, F.lit("\n(mm)"))).otherwise(F.concat(F.upper(F.substring("name", 1, 2)), F.lit(" mm2")))
    )
    return H.lint_labels(items(spark, d).select("sheet", label.alias("label")).distinct())


@query(f"{_CARDS} SELECT card_id, upper(title) title, CASE WHEN len(lines) = 2 THEN 'Good Line;Dotted Line' ELSE array_to_string(lines, ';') END AS lines, trim(coalesce(note, '')) note FROM cards")
def h28_lint_fix(spark, d):
    return H.lint_fix(cards(spark, d)).withColumn("lines", F.array_join("lines", ";"))


@query(f"{_ALL} SELECT code, price_warning AS rule, count(*) n FROM pr WHERE price_warning IS NOT NULL AND NOT (price_warning = 'MISSING') GROUP BY 1, 2")
def h29_recheck(spark, d):
    """Warnings by code; those of missing prices are still there, so only the others are settled."""
    w = priced(spark, d).where("price_warning is not null").groupBy("code", F.col("price_warning").alias("rule")).agg(F.count("*").alias("n"))
    return H.recheck(w, w.where("rule = 'MISSING'")).select("code", "rule", "n")


@query(f"{_ALL} SELECT count(*) rows_in, count(*) FILTER (dup_of IS NULL AND order_code IS NOT NULL) rows_out, count(*) FILTER (dup_of IS NOT NULL) duplicates, count(*) FILTER (dup_of IS NULL AND order_code IS NULL) dropped FROM pr")
def h30_reconcile(spark, d):
    return H.reconcile(priced(spark, d))


@query(f"{_ALL} SELECT 'order_code_form' check_name, count(*) failed FROM pr WHERE order_code IS NULL UNION ALL SELECT 'price_not_numeric', count(*) FROM pr WHERE price IS NULL UNION ALL SELECT 'order_code_twice', count(*) FROM (SELECT order_code FROM pr WHERE order_code IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'not_in_price_table', count(*) FROM pr WHERE order_code IS NOT NULL AND order_code NOT IN (SELECT order_code FROM pr WHERE order_code IS NOT NULL AND row_ord % 7 <> 0)")
def h31_qa_checks(spark, d):
    p = priced(spark, d)
    return H.qa_checks(p, p.where("order_code is not null and row_ord % 7 <> 0"))


@query(f"{_CARDS} SELECT CAST(min(length(title)) AS INT) shortest, median(length(title))::DOUBLE AS median, CAST(max(length(title)) AS INT) longest FROM cards")
def h32_title_lengths(spark, d):
    return H.title_lengths(cards(spark, d))


@query(f"{_I}, {_SERIES} SELECT row_ord, CASE WHEN series <> 'other' THEN series END series, d_mm::DOUBLE d1, CASE WHEN row_ord % 2 = 0 THEN 'mm' END unit FROM sr")
def x26_x31_price_expressions(spark, d):
    """X27 units, X29 series and X30 sort keys over the items."""
    v = F.concat(F.col("d_mm").cast("string"), F.when(F.col("row_ord") % 2 == 0, " mm").otherwise(""))
    return items(spark, d).select("row_ord", X.bearing_series(F.col("code"))["key"].alias("series"), X.num_key(v)["d1"].alias("d1"), X.unit_value(v)["unit"].alias("unit"))


@query(f"{_I} SELECT row_ord, 'SATA x ' || d_mm || ' mm ' || dd_mm || 'V' AS spaced FROM items")
def x42_spelling(spark, d):
    c = F.concat(F.lit("Sata x "), F.col("d_mm").cast("string"), F.lit("mm "), F.col("dd_mm").cast("string"), F.lit(" V"))
    return items(spark, d).select("row_ord", X.brand_casing(X.unit_spacing(c)).alias("spaced"))
