"""Rules over a card's sequences: legends against letter columns, column roles, titles seen before, mixed labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as X

# The forms of symbols, legends, letter labels and units, and pairs of labels that mean the same.
SYMBOL = "[A-Za-zΦφØøΔδ]{1,4}[₀0-9]?"
LEGEND = f"^({SYMBOL})\\s*:\\s*\\S.*$"
LETTER_LABEL = f"^({SYMBOL})(\n(\\(.+\\)|mm))?$"
UNIT = "\\((mm|inch|in|cm)\\)"
SYNONYMS = [("Chiều Dài", "L"), ("Size", "S")]
#: columns stand as code, specs, order code, price; one letter each
ROLES = {"code": "c", "spec": "s", "order_code": "o", "price": "p"}
ROLE_ORDER = "^c[^p]*op$"


def _plain(symbol: Column) -> Column:
    return F.replace(symbol, F.lit("₀"), F.lit("0"))


def _continued() -> Column:
    return F.col("card_id").contains("#")


def lint_legends(cards: DataFrame) -> DataFrame:
    """(card_id, severity, rule) of lines that are legends, legends that are none, and images to review."""
    sign = lambda x: F.regexp_extract(x, LEGEND, 1)
    rules = [
        ("error", "LEGEND_IN_LINES", F.exists("lines", lambda x: x.rlike(LEGEND) & X.is_symbol(sign(x)))), ("error", "LEGEND_FORM", F.exists("legend", lambda x: ~x.rlike(LEGEND))),
        ("warning", "IMAGE_REVIEW", (F.trim(F.coalesce("image", F.lit(""))) != "") & (F.col("image_status") == "review")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"))) for sev, rule, cond in rules]))
    return cards.select("card_id", F.explode(found).alias("x")).select("card_id", "x.severity", "x.rule")


def lint_roles(columns: DataFrame) -> DataFrame:
    """Cards whose columns stand in another order: the roles in their order are one word, read by one expression."""
    letter = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("role")), F.lit("?"))
    words = columns.groupBy("card_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("r")))), lambda x: x["r"]), "").alias("w"))
    return words.where(~F.col("w").rlike(ROLE_ORDER)).select("card_id", F.lit("error").alias("severity"), F.lit("COLUMN_ROLES").alias("rule"))


def lint_letters(columns: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_id, label, severity, rule) of columns named by a symbol: no legend line (a drawing will do), another case in the legend, another unit."""
    symbol = F.regexp_extract("label", LETTER_LABEL, 1)
    cols = columns.where((F.col("role") == "spec") & F.col("label").rlike(LETTER_LABEL) & X.is_symbol(symbol)).select("card_id", "label", symbol.alias("s"))
    both = cols.join(cards.select("card_id", "legend", (F.trim(F.coalesce("drawing", F.lit(""))) != "").alias("drawn")), "card_id")
    both = both.withColumn("known", F.filter("legend", lambda x: x.rlike(LEGEND)))
    signs = F.transform("known", lambda x: _plain(F.regexp_extract(x, LEGEND, 1)))
    lowers = F.transform(signs, F.lower)
    missing = ~F.array_contains(signs, _plain(F.col("s"))) & ~_continued()
    other = F.array_contains(lowers, F.lower(_plain(F.col("s"))))
    unit = lambda x: F.when(F.regexp_extract(x, UNIT, 1) == "in", "inch").otherwise(F.regexp_extract(x, UNIT, 1))
    own = F.regexp_extract("label", UNIT, 1)
    clash = F.exists("known", lambda x: (F.regexp_extract(x, LEGEND, 1) == F.col("s")) & (unit(x) != "") & (own != "") & (unit(x) != own))
    found = F.array_compact(F.array(
        F.when(missing & other, F.struct(F.lit("error").alias("severity"), F.lit("LETTER_CASE").alias("rule"))), F.when(missing & ~other & ~F.col("drawn"), F.struct(F.lit("error").alias("severity"), F.lit("LETTER_WITHOUT_LEGEND").alias("rule"))),
        F.when(clash, F.struct(F.lit("warning").alias("severity"), F.lit("LEGEND_UNIT").alias("rule"))),
    ))
    return both.select("card_id", "label", F.explode(found).alias("x")).select("card_id", "label", "x.severity", "x.rule")


def lint_titles(cards: DataFrame, columns: DataFrame) -> DataFrame:
    """Titles that an earlier card (by ``ord``) has: an error, or a warning where the data named both and their columns or images differ."""
    labels = columns.groupBy("card_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("labels"))
    signed = cards.join(labels, "card_id", "left").withColumn("sig", F.struct("labels", "image"))
    first = signed.groupBy("title").agg(F.min("ord").alias("_first"), F.min_by("sig", "ord").alias("_sig"))
    again = signed.join(first, "title").where((F.col("ord") > F.col("_first")) & ~_continued())
    named = (F.col("title_source") == "data") & ~F.col("sig").eqNullSafe(F.col("_sig"))
    return again.select("card_id", F.when(named, "warning").otherwise("error").alias("severity"), F.when(named, "TITLE_AGAIN_IN_DATA").otherwise("TITLE_AGAIN").alias("rule"))


def lint_synonyms(columns: DataFrame) -> DataFrame:
    """Pairs of labels of one meaning that a price list mixes."""
    heads = columns.where("role = 'spec'").agg(*(F.bool_or(F.split("label", "\n")[0] == w).alias(f"h{i}{j}") for i, pair in enumerate(SYNONYMS) for j, w in enumerate(pair)))
    mixed = F.array_compact(F.array(*(F.when(F.col(f"h{i}0") & F.col(f"h{i}1"), F.concat_ws(" / ", F.lit(a), F.lit(b))) for i, (a, b) in enumerate(SYNONYMS))))
    return heads.select(F.explode(mixed).alias("labels"), F.lit("warning").alias("severity"), F.lit("SYNONYMS").alias("rule")).select("labels", "severity", "rule")
