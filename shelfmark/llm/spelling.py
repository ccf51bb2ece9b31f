"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. A gram dictionary is built from all words: every gram of ``q_min`` characters,
   and longer ones as long as the gram they extend is frequent.
2. A word is decomposed into the longest dictionary gram at each position, without
   grams that lie inside an earlier one.
3. Each gram has a zone: the characters (and gaps) at which one edit can change
   or hide it.  The dictionary is closed under prefixes, so this is the gram
   itself, the next character if the gram has extensions, and the characters
   before it from which a longer gram could come to cover it.  The largest number
   of zones that meet at one place bounds the grams that one edit affects.
4. Near words share at least (grams - bound) grams, so the lists of a word's
   ``bound + 1`` rarest grams are enough: a near word is on one of them.  As the
   edit lies outside a shared gram, all characters on the gram's other side are
   shared too, so a list is split by the text up to the gram, and by the text
   from it on.  Merged lists give candidates; a word of whose grams one edit may
   affect all is on the lists of its halves as well, so none is lost.
5. Candidates are verified by edit distance.

Only the dictionary is sent to all tasks; its size is bounded by ``max_frequent``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import textkit as tk
from shelfmark.llm.common import written
from shelfmark.llm.native import ASCII_LOWER, ASCII_UPPER

Q_MIN, Q_MAX = 2, 3
#: a gram is extended if it occurs more often than this in distinct words ...
EXTEND_OVER = 500
#: ... and more often than one in so many gram positions, so no length has more extended grams
MAX_FREQUENT = 8192
NOT_LETTERS = "[^A-Za-zÀ-ÿ]+"


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", drop_every: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): maximal runs of Latin letters of whole texts, A-Z lower-cased, and how often they occur.

    Runs whose checksum with the document's key is a multiple of ``drop_every``
    lose one character, as a slip would.  A null text has no runs; a null key
    reads as an empty one; repeated rows count as often as they stand.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), NOT_LETTERS)).alias("run"))
    runs = runs.where(F.char_length("run") >= min_length).select("k", F.translate("run", ASCII_UPPER, ASCII_LOWER).alias("run"))
    h, size = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    word = F.when(h % drop_every == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, size))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, extend_over: int = EXTEND_OVER, max_frequent: int = MAX_FREQUENT) -> dict[str, int]:
    """Grams and their counts over distinct words: closed under prefixes of ``q_min`` characters and more."""

    def grams(q: int) -> Column:
        return F.when(F.char_length("word") >= q, F.transform(F.sequence(F.lit(1), F.char_length("word") - q + 1), lambda i: F.substring(F.col("word"), i, F.lit(q)))).otherwise(F.array().cast("array<string>"))

    counts = words.select(F.explode(F.concat(*(grams(q) for q in range(q_min, q_max + 1)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    counts = written(counts, "grams")
    positions = counts.where(F.char_length("gram") == q_min).agg(F.sum("n").alias("n")).first()["n"] or 0
    limit = max(extend_over, positions // max_frequent)
    kept = found = counts.where(F.char_length("gram") == q_min)
    for q in range(q_min + 1, q_max + 1):
        longer = counts.where(F.char_length("gram") == q).withColumn("head", F.substring("gram", 1, q - 1))
        found = longer.join(found.where(F.col("n") > limit).select(F.col("gram").alias("head")), "head", "left_semi").select("gram", "n")
        kept = kept.unionByName(found)
    return {r["gram"]: r["n"] for r in kept.collect()}  # at most max_frequent * alphabet for each length


class Grams:
    """Decompositions and bounds by one dictionary."""

    def __init__(self, counts: dict[str, int], q_min: int, q_max: int):
        self.q_min, self.q_max = q_min, q_max
        self.rank = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
        self.extended = {g[:-1] for g in counts if len(g) > q_min}
        self.inside: dict[str, int] = {}
        for g in counts:
            for k in range(1, len(g) - q_min + 1):
                self.inside[g[k:]] = max(self.inside.get(g[k:], 0), len(g))

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams; both rise from gram to gram."""
        out, done, size, known = [], 0, len(word), self.rank
        for p in range(size - self.q_min + 1):
            e = p + self.q_min
            while e < size and e - p < self.q_max and word[p : e + 1] in known:
                e += 1
            if e > done:
                out.append((p, e))
                done = e
        return out

    def bound(self, word: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one inserted, deleted or replaced character can affect."""
        size = len(word)
        at, gap = [0] * (size + 1), [0] * (size + 2)
        for p, e in grams:
            g = word[p:e]
            longest, more = self.inside.get(g, 0), g in self.extended
            for i in range(max(0, e - longest) if longest else p, min(size, e + more)):
                at[i] += 1
            for j in range(max(0, e + 1 - longest) if longest else p + 1, e + more):
                gap[j] += 1
        return max(max(at), max(gap))

    def lists(self, word: str) -> set[tuple[str, str]]:
        """(side, text): the lists that the word is on."""
        grams = self.decompose(word)
        bound = self.bound(word, grams)
        rarest = sorted(grams, key=lambda x: (self.rank[word[x[0] : x[1]]], x[0]))[: bound + 1]
        return {("<", word[:e]) for _, e in rarest} | {(">", word[p:]) for p, _ in rarest}

    def open(self, word: str) -> bool:
        """Whether one edit may affect all grams."""
        grams = self.decompose(word)
        return len(grams) <= self.bound(word, grams)


def _halves(word: str, size: int) -> set[tuple[str, str]]:
    """Lists by halves of the shorter word's length: one edit leaves one of them whole."""
    c = size // 2
    return {("[", word[:c]), ("]", word[len(word) - (size - c) :])}


def _code(word: str) -> int:
    """One bit for each character, flipped by each occurrence: one edit changes two bits at most."""
    out = 0
    for c in word:
        out ^= 1 << (ord(c) & 63)
    return out - (1 << 64) if out >> 63 else out


def gram_lists(words: DataFrame, q_min: int = Q_MIN, q_max: int = Q_MAX, extend_over: int = EXTEND_OVER, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """(list, longer, word, n, code): a row for each list that a word is on.

    A list belongs to a length of the shorter word of a pair, so each word is on
    the lists of its own length and, as the ``longer`` one, of the length below.
    """
    counts = gram_dictionary(words, q_min, q_max, extend_over, max_frequent)
    sent = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashed = Grams(sent.value, q_min, q_max), xxhash.xxh64_intdigest
        for whole in batches:
            for a in range(0, len(whole), 2000):
                b = whole.slice(a, 2000)
                lists, longer, at, codes = [], [], [], []
                for i, word in enumerate(b.column(0).to_pylist()):
                    own, alone, code = index.lists(word), index.open(word), _code(word)
                    for size in (len(word), len(word) - 1):
                        for side, part in own | _halves(word, size) if alone else own:
                            lists.append(hashed(f"{side}{size}{part}") - (1 << 63))
                            longer.append(size < len(word))
                            at.append(i)
                            codes.append(code)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), pa.array(longer, pa.bool_()), *(c.take(pa.array(at, pa.int64())) for c in b.columns), pa.array(codes, pa.int64())], ["list", "longer", "word", "n", "code"])

    return words.select("word", "n").mapInArrow(tk.tidy(run), "list long, longer boolean, word string, n long, code long")


def near_words(words: DataFrame, **settings: int) -> DataFrame:
    """(a, na, b, nb): pairs of words one inserted, deleted or replaced character apart, each once."""
    lists = written(gram_lists(words, **settings), "lists")
    one, two = lists.where(~F.col("longer")).alias("one"), lists.alias("two")
    near = (
        (F.col("one.list") == F.col("two.list")) & (F.col("two.longer") | (F.col("one.word") < F.col("two.word")))
        & (F.bit_count(F.col("one.code").bitwiseXOR(F.col("two.code"))) <= 2) & (F.levenshtein(F.col("one.word"), F.col("two.word"), 1) == 1)
    )
    pairs = one.join(two, near).select(F.col("one.word").alias("a"), F.col("one.n").alias("na"), F.col("two.word").alias("b"), F.col("two.n").alias("nb"))
    return pairs.distinct()


def group_variants(words: DataFrame, times: int = 10, **settings: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n).

    The form is the near word of largest n (ties: the smallest in code-point
    order) if its n is at least ``times`` the word's, else null; the root is where
    following forms ends.  Counts grow by ``times`` with each step, so chains are
    short; they are followed by doubling, each round written.
    """
    pairs = written(near_words(words, **settings), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.other")).alias("form"), (-F.col("best.m")).alias("m"))
    found = written(joined.select("word", "n", "n_near", "form", F.when(F.col("form").isNotNull(), F.col("m")).alias("form_n")), "forms")
    roots = written(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").head() is not None:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(next_, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return found.join(roots.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``group_variants`` of all words of the documents; no documents or texts, no rows."""
    return group_variants(written(count_words(docs, text, key), "words"))
