"""Codes, page text and evidence: every value has to be found in its stored source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import decode
from shelfmark.functions import text as X

MEASURE = r'(?i)[0-9]+(?:[.,][0-9]+)?\s*(?:mm|cm|kg|g|ml|Nm|W|V|A|inch|"|本)\b'


def _bare(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(X.text(html), r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " "), r"(?s)<[^>]+>", " ")


def _collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)[\s\x1C-\x1F]+", " "))


def page_text(html: Column, closed: bool = False) -> Column:
    """Text of a page: scripts and styles out, tags out, entities back, white space of every kind collapsed.

    ``closed``: entities without their semicolon stay as they are.
    """
    return _collapsed(decode.unescape(_bare(html), closed))


def page_texts(htmls: Column) -> Column:
    """``page_text`` of each piece of an array."""
    return F.transform(decode.unescape_all(F.transform(htmls, _bare)), _collapsed)


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(X.text(html), r"(?is)<title>(.*?)</title>", 1))


def block_products(rows: DataFrame) -> DataFrame:
    """(code, row_ord of the first row, spec lines in order) of sheets where rows without a code continue the product above."""
    code = F.last(F.nullif(F.trim("code"), F.lit("")), ignorenulls=True).over(W.partitionBy("sheet").orderBy("row_ord").rowsBetween(W.unboundedPreceding, 0))
    open_ = F.trim(F.coalesce("code", F.lit(""))) != ""
    tagged = rows.withColumns({"_c": code, "_o": open_}).where("_c is not null")
    lines = tagged.where("not _o").select("sheet", F.col("_c").alias("code"), "row_ord", F.posexplode(F.split(X.text(F.col("description")), "\n")).alias("p", "line")).where(F.trim("line") != "")
    specs = lines.groupBy("sheet", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "p", "line"))), lambda s: F.trim(s["line"])).alias("lines"))
    heads = tagged.where("_o").groupBy("sheet", F.col("_c").alias("code")).agg(F.min("row_ord").alias("row_ord"), F.count("*").alias("n_heads"))
    return heads.join(specs, ["sheet", "code"], "left").select("sheet", "code", "row_ord", "n_heads", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))


def codes_with_rows(rows: DataFrame) -> DataFrame:
    """Each distinct code with its number of rows and first row, split in its compatibility form (X20)."""
    return rows.groupBy("part_number").agg(F.count("*").alias("n_rows"), F.min("row_ord").alias("first_ord")).withColumn("c", X.split_code(decode.compatible(F.col("part_number")))).select("part_number", "n_rows", "first_ord", "c.prefix", "c.brand", "c.maker_code")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and percent by value; blank is ``(unknown)``."""
    counts = df.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("(unknown)")).alias(column)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select(column, "n", F.bround(100 * F.col("n") / F.col("total"), 1).alias("percent"))  # total is one row


def url_for(codes: DataFrame, templates: DataFrame) -> DataFrame:
    """URL of a code by its brand's template; null, and tier ``search``, where the brand has none."""
    return codes.join(F.broadcast(templates), "brand", "left").select("part_number", F.replace(F.col("template"), F.lit("{code}"), F.col("maker_code")).alias("url"), F.when(F.col("template").isNull(), "search").otherwise("template").alias("tier"))


def table_pairs(pages: DataFrame, anchor: str, window: int = 20_000) -> DataFrame:
    """(page_id, label, value) of two-cell table rows near an anchor; the first value of a label wins."""
    at = F.instr(X.text(F.col("html")), anchor)
    region = F.when(at > 0, F.substring(X.text(F.col("html")), at, F.lit(window)))
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(region, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("p", "tr"))
    cells = rows.withColumn("c", F.filter(page_texts(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1)), lambda x: x != "")).where("size(c) = 2")
    first = W.partitionBy("page_id", "label").orderBy("p")
    return cells.select("page_id", "p", F.col("c")[0].alias("label"), F.col("c")[1].alias("value")).withColumn("_r", F.row_number().over(first)).where("_r = 1").select("page_id", "label", "value")


def label_segments(pages: DataFrame, labels: list[str]) -> DataFrame:
    """(page_id, label, value): text after each known label up to the next one; longer labels first."""
    rx = "|".join("\\Q" + x + "\\E" for x in sorted(labels, key=lambda x: (-len(x), x)))
    hits = pages.select("page_id", "body", F.regexp_extract_all("body", F.lit(f"({rx})"), 1).alias("ls"), F.split("body", rx, -1).alias("ps"))
    long = hits.select("page_id", F.posexplode(F.arrays_zip(F.col("ls").alias("l"), F.slice("ps", F.lit(2), F.size("ps")).alias("v"))).alias("i", "z"))
    first = W.partitionBy("page_id", "label").orderBy("i")
    return long.select("page_id", "i", F.col("z")["l"].alias("label"), F.trim(F.col("z")["v"]).alias("value")).where("value <> ''").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("page_id", "label", "value")


def candidate_pages(pages: DataFrame) -> DataFrame:
    """Pages whose code stands in title, text or URL, in one spelling."""
    hay = X.key_search(F.concat_ws(" ", page_title(F.col("html")), page_text(F.col("html")), "url"))
    return pages.where(F.col("code") != "").where(hay.contains(X.key_search(F.col("code")))).select("page_id", "code", "own_domain")


def choose_source(candidates: DataFrame) -> DataFrame:
    """First independent page of a code, else its first page, flagged as its own source."""
    best = W.partitionBy("code").orderBy("own_domain", "page_id")
    return candidates.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("code", "page_id", F.col("own_domain").alias("self_source"))


def usable_pages(pages: DataFrame, before: int = 800, after: int = 1500, measures: int = 2) -> DataFrame:
    """Whether a page is about its code: code in text and URL, and measurements near its first mention."""
    body, key = page_text(F.col("html")), X.key_plain(F.col("code"))
    at = F.instr(F.lower(body), F.lower(F.col("code")))
    at0 = F.when(at > 0, at).otherwise(F.instr(X.key_plain(body), key))
    start = F.greatest(at0 - before, F.lit(1))
    near = F.substring(body, start, at0 + after - start)
    n = F.size(F.regexp_extract_all(near, F.lit(f"({MEASURE})"), 1))
    ok = (key != "") & X.key_plain(body).contains(key) & X.key_plain(F.col("url")).contains(key) & (n >= measures)
    return pages.select("page_id", "code", ok.alias("usable"))


def anchored(value: Column, source_key: Column) -> Column:
    """Whether a value is backed by its source: all its numbers, or, without numbers, one of its fragments."""
    v = X.text(value)
    nums = X.numbers(v)
    inner = F.regexp_extract_all(v, F.lit("[（(]([^）)]+)[）)]"), 1)
    rest = F.regexp_replace(v, "[（(][^）)]+[）)]", " ")
    parts = F.concat(inner, F.array(rest), F.split(rest, "[/,;·]"))
    keyed = F.transform(parts, X.key_evidence)
    return F.when(F.size(nums) > 0, F.forall(nums, lambda n: source_key.contains(X.key_evidence(n)))).otherwise(F.exists(keyed, lambda k: (F.length(k) >= 2) & source_key.contains(k)))


def accept_specs(specs: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """Per code: OK where every value is anchored, the name holds the maker code and there is a spec; else REVIEW."""
    checked = specs.join(sources.select("code", X.key_evidence(F.col("body")).alias("_k")), "code").withColumn("ok", anchored(F.col("value"), F.col("_k")))
    agg = checked.groupBy("code").agg(F.count("*").alias("n_specs"), F.count_if(~F.col("ok")).alias("n_rejected"))
    out = names.join(agg, "code", "left")
    good = (F.coalesce("n_rejected", F.lit(0)) == 0) & (F.coalesce("n_specs", F.lit(0)) >= 1) & F.col("name").contains(F.col("maker_code"))
    return out.select("code", F.coalesce("n_specs", F.lit(0)).alias("n_specs"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"), F.when(good, "OK").otherwise("REVIEW").alias("status"))


def code_in_name(name: Column, code: Column, maker_code: Column) -> Column:
    """The maker code stands in the name, and the code with its internal prefix does not."""
    need = F.coalesce(F.nullif(maker_code, F.lit("")), code)
    leak = (F.coalesce(maker_code, F.lit("")) != "") & (code != maker_code) & X.text(name).contains(code)
    return (X.text(need) != "") & X.text(name).contains(X.text(need)) & ~leak


def repair_code(name: Column, maker_code: Column, longest: int = 4) -> Column:
    """The first run of one to ``longest`` words that is the code in another spelling becomes the code."""
    key, ws = X.key_plain(maker_code), F.split(name, r"\s+")

    def fixed(w: Column) -> Column:
        spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("i"), n.alias("n")))))
        hit = F.get(F.filter(spans, lambda s: (s["i"] + s["n"] <= F.size(w)) & (X.key_plain(F.array_join(F.slice(w, s["i"] + 1, s["n"]), " ")) == key)), F.lit(0))
        return X.let(hit, lambda h: F.when(h.isNull(), name).otherwise(F.array_join(F.concat(F.slice(w, F.lit(1), h["i"]), F.array(maker_code), F.slice(w, h["i"] + h["n"] + 1, F.size(w))), " ")))

    return F.when((X.text(maker_code) == "") | name.contains(maker_code) | (key == ""), name).otherwise(X.let(ws, fixed))


def name_lengths(df: DataFrame, limit: int = 80) -> DataFrame:
    """Mean, 90th percentile (by rank, not interpolated), maximum, and how many are over the limit."""
    by = df.select(F.length("name").alias("n")).groupBy("n").agg(F.count("*").alias("c"))  # few distinct lengths
    total = by.agg(F.sum("c").alias("t"), F.sum(F.col("n") * F.col("c")).alias("s"), F.max("n").alias("longest"), F.coalesce(F.sum(F.when(F.col("n") > limit, F.col("c"))), F.lit(0)).alias("over"))
    cum = by.withColumn("upto", F.sum("c").over(W.orderBy("n"))).crossJoin(total.select("t"))
    p90 = cum.where(F.col("upto") > F.floor(F.col("t") * 0.9)).agg(F.min("n").alias("p90"))
    return total.crossJoin(p90).select(F.bround(F.col("s") / F.col("t"), 3).alias("mean"), "p90", "longest", "over")


def learning_sample(df: DataFrame, n: int = 60) -> DataFrame:
    """Named products with most spec lines (a sample by design)."""
    return df.where("name is not null").orderBy(F.desc("n_lines"), "row_ord").limit(n)


def hard_codes(failed: DataFrame, facts: DataFrame) -> DataFrame:
    """Codes to try again: no page, or facts without specs (the later reason wins)."""
    a = failed.select("code", F.lit(1).alias("o"), F.lit("NO_PAGE").alias("reason"))
    b = facts.where("n_specs = 0").select("code", F.lit(2).alias("o"), F.lit("NO_SPECS").alias("reason"))
    return a.union(b).groupBy("code").agg(F.max_by("reason", "o").alias("reason"))


def merge_rounds(one: DataFrame, two: DataFrame, three: DataFrame) -> DataFrame:
    """Per code: the name of round one, specs and source of round two where there are any, review that sticks."""
    out = one.join(two.select("code", F.col("n_specs").alias("n2"), F.col("source").alias("s2"), F.col("status").alias("st2")), "code", "left").join(three.select("code", F.col("source").alias("s3")), "code", "left")
    status = F.when((F.col("status") == "REVIEW") | F.col("s3").isNotNull(), "REVIEW").otherwise(F.coalesce("st2", "status"))
    return out.select("code", "name", F.coalesce("n2", F.lit(0)).alias("n_specs"), F.coalesce("s3", "s2").alias("source"), status.alias("status"))


def delivery_rows(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Products back to original rows; no result is MISSING, no specs is REVIEW."""
    out = rows.select("row_ord", F.col("part_number").alias("code")).join(merged, "code", "left")
    return out.select("row_ord", "code", "name", F.when(F.col("name").isNull(), "MISSING").when(F.col("n_specs") == 0, "REVIEW").otherwise(F.col("status")).alias("status"))
