"""Line-first cleaning, in column expressions only: one scan, no shuffle.

Every line is judged by itself and by its neighbours; failing lines are removed;
a document that loses too many of its words, or that fails the base rules, is
rejected.  The rules, in the order in which a line is counted under one of them:

- symbols: more than a tenth of its characters are ``#*$%&|<>``;
- bars: a row of menu entries with more than two of ``| » •``;
- furniture: fewer than 20 words and one of the given phrases;
- bullet: starts with a bullet or a list number and has fewer than four words;
- menu: one of three or more short lines in a row without closing punctuation;
- unpunctuated: twenty words or more without any sentence mark, in a text that has sentence marks;
- repeated: equal to an earlier line that passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.native import gram_hashes, let

SYMBOLS = r"[#*$%&|<>]"
BARS = r"[|»•]"
BULLET = r"^[\x20\x09]*([-*•▪‣–]|[0-9]{1,3}[.)])[\x20\x09]"
SENTENCE = r"[.!?…。！？]"
CLOSING = [".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "]", "。", "！", "？"]
# Phrases of page furniture.
BOILERPLATE = ["cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "skip to content", "sign up for our newsletter", "click here", "lorem ipsum"]
RULES = ["symbols", "bars", "furniture", "bullet", "menu", "unpunctuated"]
SHORT_LINE, MENU_RUN, LONG_LINE = 6, 3, 20


def repeated_window_words(ws: Column, k: int = 5) -> Column:
    """Words inside a k-word window that is found at least twice; ``ws`` as for gram_hashes."""

    def covered(hs: Column) -> Column:
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            return F.array_sort(F.transform(F.filter(s, lambda x, j: _twin(s, x, j)), lambda x: x["i"]))

        reach = lambda p: F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k))))
        return let(let(placed, positions), lambda p: F.aggregate(reach(p), F.lit(0), lambda a, b: a + b))

    return let(gram_hashes(ws, k), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def _twin(s: Column, x: Column, j: Column) -> Column:
    """Whether a neighbour in the sorted array has the same hash; a missing neighbour has not."""
    before, after = F.when(j > 0, F.get(s, j - 1)["h"]), F.get(s, j + 1)["h"]
    return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))


def line_words(line: Column) -> Column:
    """Words of a line: cut at spaces, to which the other white space is turned where there is any."""
    odd = reduce(Column.__or__, [line.contains(c) for c in "\t\x0b\x0c\r"])
    return F.filter(F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " "), lambda w: w != "")


def _menu(lines: Column, i: Column) -> Column:
    """Whether line ``i`` is in a run of MENU_RUN or more short lines without closing punctuation."""
    is_short = lambda j: F.coalesce(F.when(j >= 0, F.get(lines, j)["short"]), F.lit(False))
    runs = [reduce(Column.__and__, [is_short(i + k - back) for k in range(MENU_RUN)]) for back in range(MENU_RUN)]
    return reduce(Column.__or__, runs)


def line_rule(line: Column, n: Column, in_menu: Column, has_symbols: Column, has_furniture: Column, has_marks: Column, phrases: list[str], max_symbol_share: float = 0.1, max_bars: int = 2) -> Column:
    """The first rule that a line of ``n`` words breaks, null for none; ``has_...`` tell whether the whole text has any."""
    low = F.lower(line)
    furniture = has_furniture & (n < 20) & reduce(Column.__or__, [low.contains(p) for p in phrases], F.lit(False))
    symbols = has_symbols & (F.regexp_count(line, F.lit(SYMBOLS)) > max_symbol_share * F.length(line))
    barred = (line.contains("|") | line.contains("»") | line.contains("•")) & (F.regexp_count(line, F.lit(BARS)) > max_bars)
    rules = zip(RULES, [symbols, barred, furniture, (n < 5) & line.rlike(BULLET), in_menu, has_marks & (n >= LONG_LINE) & ~line.rlike(SENTENCE)], strict=True)
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])


def clean_lines(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, min_kept_share: float = 0.5, phrases: list[str] = BOILERPLATE, text: str = "text") -> DataFrame:
    """All columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    a count of failing lines for each rule (``n_<rule>_lines``), and cleaned_text.

    A null or empty text has no words, fails the base rules and is not kept; a
    text without line breaks is one line.  ``phrases`` are lower-case.  Added
    columns replace clashing names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    has_furniture = let(F.lower(body), lambda low: reduce(Column.__or__, [low.contains(p) for p in phrases], F.lit(False)))

    def split(raw: Column) -> Column:
        """Lines with a word: text, words, whether short and unclosed."""
        parts = F.transform(raw, lambda x: F.struct(x.alias("t"), line_words(x).alias("ws")))
        last = lambda x: F.substring(F.element_at(x["ws"], -1), -1, 1)
        return F.transform(F.filter(parts, lambda x: F.size(x["ws"]) > 0), lambda x: F.struct(x["t"].alias("t"), x["ws"].alias("ws"), ((F.size(x["ws"]) <= SHORT_LINE) & ~last(x).isin(CLOSING)).alias("short")))

    def measured(lines: Column) -> Column:
        judged = F.transform(lines, lambda x, i: F.struct(x["t"].alias("t"), F.size(x["ws"]).alias("n"), line_rule(x["t"], F.size(x["ws"]), _menu(lines, i), F.col("n_symbols") > 0, F.col("_furniture"), F.col("_marks"), phrases).alias("rule")))
        texts = F.transform(lines, lambda x: x["t"])
        hashes = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
        in_words = let(F.flatten(F.transform(lines, lambda x: x["ws"])), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), let(hashes(ws), lambda hs: repeated_window_words(hs)).cast("long").alias("n_repeat_words")))
        of_lines = let(judged, lambda js: F.struct(
            F.array_distinct(F.transform(F.filter(js, lambda x: x["rule"].isNull()), lambda x: F.struct(x["t"].alias("t"), x["n"].alias("n")))).alias("passing"),
            F.filter(F.transform(js, lambda x: x["rule"]), lambda r: r.isNotNull()).alias("broken"),
        ))
        return F.struct(in_words.alias("w"), of_lines.alias("l"), (F.size(texts) - F.size(F.array_distinct(texts))).cast("long").alias("n_dup_lines"))

    keep = [c for c in docs.columns if c not in {"n_symbols", "_furniture", "_marks", "_m"}]
    out = docs.select(*keep, F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), has_furniture.alias("_furniture"), body.rlike(SENTENCE).alias("_marks"))
    out = out.withColumn("_m", let(let(F.split(body, "\n"), split), measured))
    n, repeats = F.col("_m.w.n_words"), F.col("_m.w.n_repeat_words")
    failed = (n < min_words) | (100 * repeats > max_repeat_percent * n)
    left = F.aggregate("_m.l.passing", F.lit(0), lambda a, x: a + x["n"])
    counts = {f"n_{r}_lines": (F.size("_m.l.broken") - F.size(F.array_remove("_m.l.broken", r))).cast("long") for r in RULES}
    return out.withColumns({
        "n_words": n, "word_chars": F.col("_m.w.word_chars"), "n_dup_lines": F.col("_m.n_dup_lines"), "n_repeat_words": repeats,
        "base_failed": failed, "kept": ~failed & (left >= min_kept_share * n), **counts, "cleaned_text": F.array_join(F.transform("_m.l.passing", lambda x: x["t"]), "\n"),
    }).drop("_m", "_furniture", "_marks")
