"""License detection by diagonal voting, in DataFrame operations only.

All rolling k-gram hashes of every text are joined to the positions where the
template k-grams stand, and the words are compared.  A match at text position p
and template position t votes for the diagonal p - t.  Votes are summed by
diagonal, neighbouring diagonals are merged into a span (words may be missing or
added), and a span with enough votes is verified on words: the edit distance
between the template and the span, in which a word outside all matching k-grams
counts as different, must be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.llm.common import written
from shelfmark.llm.native import NON_ALNUM_RUN, gram_hashes, let, lower_ascii, words

# Phrases whose every occurrence counts, with their labels.
BASE_PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Statements found with some words missing or added, with their labels.
STATEMENTS = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


#: in the coded form of a span: a word outside all matching k-grams
OTHER = "~"


def coded(phrase: list[str]) -> list[str]:
    """A character for each word of a template, the same for equal words."""
    return [chr((0x20 if len(phrase) < 90 else 0x100) + 1 + phrase.index(w)) for w in phrase]


def _templates(spark: SparkSession, base: list[tuple[str, str]], statements: list[tuple[str, str]], k: int) -> DataFrame:
    rows = []
    for i, (text, label) in enumerate([*base, *statements]):
        ws = text.split(" ")
        codes = coded(ws)
        rows += [(i, label, i < len(base), len(ws), "".join(codes), t, codes[t : t + k], ws[t : t + k]) for t in range(len(ws) - k + 1)]
    t = spark.createDataFrame(rows, "template int, label string, is_base boolean, size int, coded string, tpos int, codes array<string>, gram array<string>")
    return t.withColumn("h", F.xxhash64(*[F.col("gram")[j] for j in range(k)]))


def scan_licenses(docs: DataFrame, base=BASE_PHRASES, statements=STATEMENTS, k: int = 3, min_votes: float = 0.5, min_similarity: float = 0.8, slack: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    The template table is the constant lists above (lower-case words, single
    spaces, at least ``k`` words each), so it is broadcast.  The texts are read
    once; what is kept of them is a number of words and the k-grams whose hash
    some template has.  A null or empty text has no words and no labels (empty
    strings, score 0).  Every row is judged by itself, repeated rows and null ids
    too.  ``labels`` are the base labels and those of verified spans; ``score`` is
    1 with a base phrase, else the best similarity (1 - edits / template words).
    """
    templates = _templates(docs.sparkSession, base, statements, k)
    known = [r["h"] for r in templates.select("h").distinct().orderBy("h").collect()]  # of the constant lists

    def measured(ws):
        hits = F.filter(F.transform(gram_hashes(ws, k), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), lambda x: x["h"].isin(known))
        return F.struct(F.size(ws).cast("long").alias("n_words"), F.transform(hits, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.slice(ws, x["pos"] + 1, k).alias("gram"))).alias("hits"))

    body = F.coalesce(F.col(text), F.lit(""))
    # row numbers are those of the written table, so a task that runs again changes none
    scanned = written(docs.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), let(words(lower_ascii(body), NON_ALNUM_RUN), measured).alias("_m")).select(id_col, "_row", "_m.n_words", "_m.hits"), "grams")
    grams = scanned.where(F.size("hits") > 0).select("_row", F.inline("hits"))
    votes = grams.join(F.broadcast(templates), ["h", "gram"]).withColumn("diagonal", F.col("pos") - F.col("tpos"))

    own = ["_row", "template", "label", "is_base", "size", "coded"]
    diagonals = votes.groupBy(*own, "diagonal").agg(F.count("*").alias("n"), F.collect_list(F.struct("pos", "tpos", "codes")).alias("votes"))
    exact = diagonals.where(F.col("is_base") & (F.col("n") == F.col("size") - k + 1))
    base_found = exact.groupBy("_row").agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("bl"))

    run = W.partitionBy("_row", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(run) > slack, F.lit(True))
    spans = diagonals.withColumn("span", F.sum(opens.cast("int")).over(run)).groupBy(*own, "span").agg(F.flatten(F.collect_list("votes")).alias("votes"))
    spans = spans.where(F.size(F.array_distinct(F.transform("votes", lambda v: v["tpos"]))) >= min_votes * (F.col("size") - k + 1))
    seen = F.map_from_entries(F.array_distinct(F.flatten(F.transform("votes", lambda v: F.transform(v["codes"], lambda c, j: F.struct((v["pos"] + j).alias("at"), c.alias("code")))))))
    places = F.sequence(F.array_min(F.transform("votes", lambda v: v["pos"])), F.array_max(F.transform("votes", lambda v: v["pos"])) + k - 1)
    spans = spans.withColumn("seen", seen).withColumn("text_code", F.array_join(F.transform(places, lambda p: F.coalesce(F.try_element_at("seen", p), F.lit(OTHER))), ""))
    spans = spans.withColumn("similarity", 1.0 - F.levenshtein("text_code", "coded") / F.col("size")).where(F.col("similarity") >= min_similarity)
    found = spans.groupBy("_row").agg(F.collect_set("label").alias("ml"), F.max("similarity").alias("similarity"), F.count("*").alias("n_spans"))

    hits = base_found.join(found, "_row", "full_outer")
    none = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_union(F.coalesce("bl", none), F.coalesce("ml", none))), ",")
    return scanned.select(id_col, "_row", "n_words").join(hits, "_row", "left").select(
        id_col, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.coalesce("bl", none)), ",").alias("base_labels"), labels.alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("score"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
    )
