"""Attribute audit: which ``Key: Value`` pairs are missing, wrong or odd, judged by peers.

Rows of one name skeleton (or, failing that, similar rows of one group, the whole
group, or similar rows anywhere) are peers.  What
nearly all peers have is the schema of their cluster; an attribute is constant,
a slot (a template around one number of the name), or neither.  Everything is
grouped and joined on (cluster, attribute) keys of the exploded pair table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators.steps import kept

MIN_PEERS = 5
#: share of the filled peers that makes an attribute part of the schema; clusters of a whole group need more
COVERAGE, GROUP_COVERAGE = 0.90, 0.95


def prepared(df: DataFrame) -> DataFrame:
    """The table with what all steps read from its texts (attribute pairs, numbers, tokens and skeleton of the name), parsed once and written."""
    c = F.col("description")
    return kept(df.withColumns({"_pairs": X.parse_filters(F.col("filters")), "_empty": X.is_empty_filter(F.col("filters")), "_nums": X.numbers(c), "_toks": X.tokens(c), "_skeleton": X.skeleton(c), "_own": X.row_group(F.col("filters"))}))


def _read(df: DataFrame, name: str) -> Column:
    """A column of ``prepared``, or its expression where the table was not prepared."""
    if name in df.columns:
        return F.col(name)
    make = {"_pairs": (X.parse_filters, "filters"), "_empty": (X.is_empty_filter, "filters"), "_own": (X.row_group, "filters"), "_nums": (X.numbers, "description"), "_toks": (X.tokens, "description"), "_skeleton": (X.skeleton, "description")}
    f, c = make[name]
    return f(F.col(c))


def pairs(df: DataFrame) -> DataFrame:
    """(row_ord, pos, k, v), one row for each pair of the attribute string, repeats included."""
    return df.select("row_ord", F.posexplode(_read(df, "_pairs")).alias("pos", "p")).select("row_ord", "pos", "p.k", "p.v")


def first_values(long: DataFrame) -> DataFrame:
    """One value for each key of a row: the first."""
    return long.groupBy("row_ord", "k").agg(F.min_by("v", "pos").alias("v"))


def last_values(long: DataFrame) -> DataFrame:
    return long.groupBy("row_ord", "k").agg(F.max_by("v", "pos").alias("v"))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Most frequent value for each key; the first seen wins ties."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    return counts.withColumn("_r", best).where("_r = 1").select(*keys, F.col(value).alias(out), F.col("n").alias(f"n_{out}"))


def resolve_groups(df: DataFrame) -> DataFrame:
    """Row group from its own keys, else the majority group of its skeleton (one vote on the original groups)."""
    own = df.select("row_ord", _read(df, "_skeleton").alias("skeleton"), _read(df, "_own").alias("own"))
    major = mode_first(own.where("own is not null"), ["skeleton"], "own", "row_ord", "major").drop("n_major")
    return own.join(major, "skeleton", "left").select("row_ord", "skeleton", F.coalesce("own", "major").alias("grp"), F.col("own").isNull().alias("voted"))


def _sized(grouped: DataFrame) -> DataFrame:
    """Rows with the number of rows of their skeleton and of their group (rows without a group have no such number)."""
    by_skeleton = grouped.groupBy("skeleton").agg(F.count("*").alias("n_skeleton"))
    by_group = grouped.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n_grp"))
    return grouped.join(by_skeleton, "skeleton").join(by_group, "grp", "left")


def clusters(df: DataFrame, grouped: DataFrame, min_peers: int = MIN_PEERS) -> tuple[DataFrame, DataFrame]:
    """Which cluster judges each row, and the members that a cluster learns from.

    The first that has enough rows: level 1, rows of one skeleton; level 2, rows of
    rare skeletons with one token set and their similar peers in the group; level 3, the whole
    group.  A row without a cluster, or in one in which no row has attributes, is
    judged by filled rows that are like it anywhere (level 4), if there are enough.
    Returns (row_ord, grp, cluster_id, level), with nulls where a row stands alone,
    and (cluster_id, level, row_ord).
    """
    grouped = kept(grouped)
    sized = _sized(grouped)
    classes = kept(name_classes(df, grouped, min_peers))
    similar = kept(similar_classes(classes).select("a", "b", "n"))
    own = similar.groupBy("a").agg(F.sum("n").alias("n_similar")).where(F.col("n_similar") + 1 >= min_peers)
    asking = kept(classes.where("rare").select("row_ord", "a").join(own, "a"))
    level = F.when(F.col("n_skeleton") >= min_peers, 1).when(F.col("n_similar").isNotNull(), 2).when(F.col("n_grp") >= min_peers, 3)
    placed = sized.join(asking, "row_ord", "left").withColumn("level", level)
    key = F.when(F.col("level") == 1, F.concat(F.lit("s:"), F.md5(F.col("skeleton").cast("binary")))).when(F.col("level") == 2, F.concat(F.lit("p:"), F.col("a").cast("string"))).when(F.col("level") == 3, F.concat(F.lit("g:"), "grp"))
    first = kept(placed.select("row_ord", "grp", key.alias("cluster_id"), "level"))
    members = first.where("level = 1").select("cluster_id", "level", "row_ord")
    peers = similar.join(own, "a").select("a", "b").unionByName(classes.join(own, "a").select("a", "b")).distinct()
    members = members.unionByName(peers.join(classes.select("b", "row_ord"), "b").select(F.concat(F.lit("p:"), F.col("a").cast("string")).alias("cluster_id"), F.lit(2).alias("level"), "row_ord"))
    whole = first.where("level = 3").select("grp", "cluster_id", "level").distinct()
    members = kept(members.unionByName(whole.join(grouped.select("grp", "row_ord"), "grp").select("cluster_id", "level", "row_ord")))
    rescued = kept(rescue_peers(df, without_filled_peers(df, first, members), min_peers=min_peers).select("a", "b"))
    label = F.concat(F.lit("r:"), F.col("a").cast("string"))
    saved = rescued.select(F.col("a").alias("row_ord"), label.alias("_r")).distinct()
    assigned = first.join(saved, "row_ord", "left").select("row_ord", "grp", F.coalesce("_r", "cluster_id").alias("cluster_id"), F.when(F.col("_r").isNotNull(), 4).otherwise(F.col("level")).alias("level"))
    return kept(assigned), kept(members.unionByName(rescued.select(label.alias("cluster_id"), F.lit(4).alias("level"), F.col("b").alias("row_ord"))))


def name_classes(df: DataFrame, grouped: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """(row_ord, grp, rare, t, b, a, n): rows of one group and token set are one class.

    ``b`` is its first row, ``n`` its size, and ``a`` its first row with a rare
    skeleton, null where it has none.
    """
    toks = df.select("row_ord", _read(df, "_toks").alias("t")).join(_sized(grouped).select("row_ord", "grp", (F.col("n_skeleton") < min_peers).alias("rare")), "row_ord").where("grp is not null").withColumn("t", F.array_sort("t"))
    by = toks.groupBy("grp", "t").agg(F.min("row_ord").alias("b"), F.min(F.when(F.col("rare"), F.col("row_ord"))).alias("a"), F.count("*").alias("n"))
    return toks.join(by, ["grp", "t"])


def similar_classes(classes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, n, jaccard): for classes with a rare row, the classes of the same group with similar tokens, and their rows (other than ``a``).

    Prefix filtering: ordered by rarity in the group, sets that share enough tokens
    share one among the first n - ceil(threshold * n) + 1 of either, so tokens that
    the whole group has join nothing; classes that meet are then compared in full.
    Alike rows are one class, so their number does not matter.
    """
    own = classes.select("grp", "t", "a", "b", "n").distinct()
    long = own.select("grp", "b", F.explode("t").alias("tok"))
    common = long.groupBy("grp", "tok").agg(F.count("*").alias("df"))
    ordered = long.join(common, ["grp", "tok"]).groupBy("b").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("o"))
    n = F.size("o")
    lead = own.join(ordered, "b").select("grp", "a", "b", "n", "t", F.explode(F.slice("o", F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))).alias("e")).select("grp", "a", "b", "n", "t", F.col("e.tok").alias("tok"))
    asking = lead.where("a is not null").select("a", F.col("b").alias("own"), "grp", "tok", F.col("t").alias("ta"))
    met = asking.join(lead.select("b", "grp", "tok", "n", F.col("t").alias("tb")), ["grp", "tok"]).select("a", "b", (F.col("n") - (F.col("own") == F.col("b")).cast("int")).alias("n"), "ta", "tb").where("n > 0").dropDuplicates(["a", "b"])
    ov = F.size(F.array_intersect("ta", "tb"))
    both = met.select("a", "b", "n", ov.alias("ov"), (F.size("ta") + F.size("tb") - ov).alias("un"))
    return both.where((F.col("ov") > 0) & (F.col("ov") >= threshold * F.col("un"))).select("a", "b", "n", F.bround(F.col("ov") / F.col("un"), 6).alias("jaccard"))


def similar_peers(classes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, jaccard): every row with a rare skeleton and every other row of its group with similar tokens.

    Token sets are compared once for each pair of classes; the rows of either
    class are joined to the result, so the work beyond the answer's own rows
    does not grow with the number of alike rows.
    """
    met = similar_classes(classes, threshold).select("a", "b", "jaccard")
    asking = classes.where("rare").select("a", F.col("row_ord").alias("x"))
    peers = classes.select("b", F.col("row_ord").alias("y"))
    return met.join(asking, "a").join(peers, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard")


def cluster_coverage(df: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, level, k, cov, n_have): share of members with any attributes that have the attribute."""
    long = first_values(pairs(df)).join(members, "row_ord")
    filled = members.join(df.where(~_read(df, "_empty")).select("row_ord"), "row_ord", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n_peers"))
    have = long.groupBy("cluster_id", "level", "k").agg(F.count("*").alias("n_have"))
    return have.join(filled, "cluster_id").withColumn("cov", F.col("n_have") / F.col("n_peers"))


def learn_schema(df: DataFrame, members: DataFrame, min_const_in_name: float = 0.8, min_slot: float = 0.98, top_slots: int = 12) -> DataFrame:
    """(cluster_id, level, k, n_have, n_peers, mode, value, slot, template, accuracy, in_name).

    mode CONST: one value on all rows that have the attribute; SLOT: a template
    around the number at one position of the name, right on nearly all rows;
    NONE: the most frequent value, as a hint only.
    """
    covered = cluster_coverage(df, members)
    wide = covered.where(F.col("cov") >= F.when(F.col("level") == 3, GROUP_COVERAGE).otherwise(COVERAGE))
    members = members.select("row_ord", "cluster_id")
    named = df.select("row_ord", F.col("description").alias("name"), _read(df, "_nums").alias("nums"))
    wide = kept(wide)
    long = kept(first_values(pairs(df)).join(members, "row_ord").join(wide.select("cluster_id", "k", "level", "n_have", "n_peers"), ["cluster_id", "k"]).join(named, "row_ord"))
    const = long.groupBy("cluster_id", "k").agg(F.count_distinct("v").alias("values"), F.min("v").alias("value"), F.avg(F.lower("name").contains(F.lower("v")).cast("int")).alias("share")).where("values = 1")
    const = const.select("cluster_id", "k", F.lit("CONST").alias("mode"), "value", (F.col("share") >= min_const_in_name).alias("in_name"))

    last = last_values(pairs(df)).select("row_ord", "k", F.col("v").alias("last"))
    placed = long.join(last, ["row_ord", "k"]).select("cluster_id", "k", "row_ord", F.col("last").alias("v"), F.posexplode("nums").alias("slot", "num"))
    even = df.select("row_ord", F.size(_read(df, "_nums")).alias("c")).join(members, "row_ord").groupBy("cluster_id").agg((F.min("c") == F.max("c")).alias("even"))
    placed = kept(placed.join(long.select("cluster_id", "level").distinct(), "cluster_id").join(even, "cluster_id").where("level = 1 or even"))
    cands = placed.withColumn("template", X.sub_first_num(F.col("v"), F.col("num"))).where("template is not null").groupBy("cluster_id", "k", "slot", "template").agg(F.count("*").alias("n"), F.min("row_ord").alias("first"))
    cands = cands.withColumn("_r", F.row_number().over(W.partitionBy("cluster_id", "k").orderBy(F.desc("n"), "first", "slot", "template"))).where(F.col("_r") <= top_slots)
    scored = placed.join(cands.select("cluster_id", "k", "slot", "template", "_r"), ["cluster_id", "k", "slot"]).groupBy("cluster_id", "k", "slot", "template", "_r").agg(F.avg((X.render(F.col("template"), F.col("num")) == F.col("v")).cast("int")).alias("accuracy"))
    best = scored.withColumn("_b", F.row_number().over(W.partitionBy("cluster_id", "k").orderBy(F.desc("accuracy"), "_r"))).where((F.col("_b") == 1) & (F.col("accuracy") >= min_slot)).select("cluster_id", "k", "slot", "template", "accuracy")
    modal = mode_first(long, ["cluster_id", "k"], "v", "row_ord", "modal")
    out = wide.join(const, ["cluster_id", "k"], "left").join(best, ["cluster_id", "k"], "left").join(modal, ["cluster_id", "k"], "left")
    mode = F.coalesce("mode", F.when(F.col("slot").isNotNull(), "SLOT").otherwise("NONE"))
    slot = F.col("mode") == "SLOT"
    return out.select("cluster_id", "level", "k", "n_have", "n_peers", "value", "slot", "template", "accuracy", "in_name", "modal", "n_modal", mode.alias("mode")).select(
        "cluster_id", "level", "k", "n_have", "n_peers", "mode", F.when(F.col("mode") == "CONST", F.col("value")).when(F.col("mode") == "NONE", F.col("modal")).alias("value"),
        F.when(slot, F.col("slot")).alias("slot"), F.when(slot, F.col("template")).alias("template"), F.when(slot, F.bround("accuracy", 6)).alias("accuracy"), F.coalesce(F.col("in_name") & (F.col("mode") == "CONST"), F.lit(False)).alias("in_name"),
    )


def missing_attributes(df: DataFrame, assigned: DataFrame, schema: DataFrame) -> DataFrame:
    """Attributes of the cluster schema a row lacks: filled (CONST or SLOT) or to be looked up."""
    rows = assigned.where("cluster_id is not null").select("row_ord", "cluster_id").join(df.select("row_ord", "description"), "row_ord")
    want = rows.join(schema, "cluster_id").join(first_values(pairs(df)).select("row_ord", "k"), ["row_ord", "k"], "left_anti")
    nums = X.numbers(F.col("description"))
    const = (F.col("mode") == "CONST") & ~(F.col("in_name") & ~F.lower("description").contains(F.lower("value")))
    num = F.get(nums, F.col("slot"))
    value = F.when(const, F.col("value")).when((F.col("mode") == "SLOT") & num.isNotNull(), X.render(F.col("template"), num))
    return want.select("row_ord", "cluster_id", "k", "mode", value.alias("fill"), F.when(F.col("mode") == "NONE", F.col("value")).alias("hint")).withColumn("action", F.when(F.col("fill").isNotNull(), "FILLED").otherwise("LOOKUP"))


def contradictions(df: DataFrame, assigned: DataFrame, schema: DataFrame) -> DataFrame:
    """Present values that differ from what the name (SLOT) or all peers (CONST) say."""
    have = first_values(pairs(df)).join(assigned.where("cluster_id is not null").select("row_ord", "cluster_id"), "row_ord").join(schema.where("mode <> 'NONE'"), ["cluster_id", "k"])
    have = have.join(df.select("row_ord", "description"), "row_ord")
    expected = F.when(F.col("mode") == "CONST", F.col("value")).otherwise(X.render(F.col("template"), F.get(X.numbers(F.col("description")), F.col("slot"))))
    return have.select("row_ord", "k", "mode", "v", expected.alias("expected")).where("expected is not null and expected <> v")


def odd_attributes(df: DataFrame, assigned: DataFrame, members: DataFrame, rare: float = 0.05, min_peers: int = MIN_PEERS) -> DataFrame:
    """N/A keys beside other pairs, and attributes that under ``rare`` of the peers have."""
    filled = df.where(~_read(df, "_empty")).select("row_ord")
    long = pairs(df).join(filled, "row_ord", "left_semi")
    na = long.where(F.upper("k") == "N/A").select("row_ord", "k", F.lit("NA_KEY").alias("reason"))
    few = cluster_coverage(df, members).where((F.col("n_peers") >= min_peers) & (F.col("cov") < rare)).select("cluster_id", "k")
    odd = first_values(long).join(assigned.select("row_ord", "cluster_id"), "row_ord").join(few, ["cluster_id", "k"]).select("row_ord", "k", F.lit("RARE").alias("reason"))
    return na.unionByName(odd)


def duplicate_pairs(df: DataFrame) -> DataFrame:
    """Keys that a row has twice with the same value."""
    return pairs(df).groupBy("row_ord", "k").agg(F.count("*").alias("n"), F.count_distinct("v").alias("n_values")).where("n > n_values")


def count_mismatch(df: DataFrame) -> DataFrame:
    """Rows whose declared number of pairs differs from the parsed one; an undeclared number is fine."""
    n = F.when(X.is_empty_filter(F.col("filters")), 0).otherwise(F.size(X.parse_filters(F.col("filters"))))
    return df.select("row_ord", F.col("declared").try_cast("int").alias("declared"), n.alias("parsed")).where("declared is not null and declared <> parsed")


def group_gaps(assigned: DataFrame, schema: DataFrame, min_clusters: int = 3, share: float = 0.8, min_rows: int = 5) -> DataFrame:
    """Attributes that most level-1 clusters of a group have, and the clusters that lack them."""
    grp = mode_first(assigned.where("level = 1 and grp is not null"), ["cluster_id"], "grp", "row_ord", "g").select("cluster_id", F.col("g").alias("grp"))
    sizes = assigned.where("level = 1").groupBy("cluster_id").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_rows)
    eligible = grp.join(sizes, "cluster_id")
    totals = eligible.groupBy("grp").agg(F.count("*").alias("clusters")).where(F.col("clusters") >= min_clusters)
    votes = eligible.join(schema.select("cluster_id", "k"), "cluster_id").groupBy("grp", "k").agg(F.count("*").alias("votes")).join(totals, "grp").where(F.col("votes") >= share * F.col("clusters"))
    return eligible.join(votes, "grp").join(schema.select("cluster_id", "k"), ["cluster_id", "k"], "left_anti").select("grp", "cluster_id", "k", "votes", "clusters", "rows")


def casing_canon(df: DataFrame, min_total: int = 30, max_share: float = 0.2) -> DataFrame:
    """Word variants that are rare spellings of a common word, with its usual spelling."""
    w = df.select("row_ord", F.posexplode(F.regexp_extract_all("description", F.lit("([A-Za-zÀ-ỹ]{2,})"), 1)).alias("p", "w"))
    counts = w.groupBy("w").agg(F.count("*").alias("n"), F.min(F.struct("row_ord", "p")).alias("first")).withColumn("lw", F.lower("w"))
    by = W.partitionBy("lw")
    ranked = counts.withColumns({"total": F.sum("n").over(by), "best": F.first("w").over(by.orderBy(F.desc("n"), "first"))})
    return ranked.where((F.col("total") >= min_total) & (F.col("w") != F.col("best")) & (F.col("n") / F.col("total") < max_share)).select("w", "best", "n", "total")


DIM_SPACED, DIM_TIGHT = r"[0-9]\s[xX]\s[0-9]", r"[0-9]x[0-9]"
UNIT_SPACED, UNIT_TIGHT = r"[0-9]\s(?:mm|cm|inch|kg|ml|oz)\b", r"[0-9](?:mm|cm|inch|kg|ml|oz)\b"


def markers(df: DataFrame, yes: str, no: str, min_n: int = 25, margin: float = 0.3) -> DataFrame:
    """(word, p, n): words that tell a convention, learned from names that follow exactly one side."""
    name = F.col("description")
    tagged = df.select("row_ord", name, name.rlike(yes).alias("a"), name.rlike(no).alias("b")).where("a <> b")
    toks = tagged.select("a", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit("([0-9A-Za-zÀ-ỹ/#]+)"), 1))).alias("word"))
    leak = (F.col("word") == "x") | (F.col("word").rlike("[0-9]") & F.col("word").rlike("[a-zà-ỹ]"))
    counted = toks.where(~leak).groupBy("word").agg(F.count_if("a").alias("pos"), F.count("*").alias("n"))
    return counted.withColumn("p", F.col("pos") / F.col("n")).where((F.col("n") >= min_n) & (F.abs(F.col("p") - 0.5) >= margin)).select("word", "p", "n")


def predict_convention(df: DataFrame, learned: DataFrame, confidence: float = 0.8) -> DataFrame:
    """Vote of a row's words, weighted by how often and how clearly each tells the convention; null when unsure."""
    toks = df.select("row_ord", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit("([0-9A-Za-zÀ-ỹ/#]+)"), 1))).alias("word"))
    weight = F.log(F.col("n") + 1.0) * F.abs(F.col("p") - 0.5)
    vote = toks.join(learned, "word").groupBy("row_ord").agg((F.sum(F.col("p") * weight) / F.sum(weight)).alias("p"))
    decided = F.when(F.col("p") >= confidence, True).when(F.col("p") <= 1 - confidence, False)
    return df.select("row_ord").join(vote, "row_ord", "left").select("row_ord", decided.alias("predicted"))


def cluster_conventions(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """Unit and dimension spacing of a cluster, decided only where nearly all names agree."""
    rows = df.select("row_ord", "description").join(assigned.where("cluster_id is not null").select("row_ord", "cluster_id"), "row_ord")
    has = lambda rx: F.count_if(F.col("description").rlike(rx))
    out = rows.groupBy("cluster_id").agg(has(UNIT_SPACED).alias("us"), has(UNIT_TIGHT).alias("ut"), has(DIM_TIGHT).alias("dt"), has(DIM_SPACED).alias("ds"))

    def decide(p: str, q: str):
        total = F.col(p) + F.col(q)
        return F.when((total >= 5) & (F.least(p, q) <= 0.1 * total), F.col(p) > F.col(q))

    return out.select("cluster_id", decide("us", "ut").alias("unit_space"), decide("dt", "ds").alias("dim_tight"))


def fix_names(df: DataFrame, assigned: DataFrame, conventions: DataFrame, predicted: DataFrame, canon: DataFrame) -> DataFrame:
    """Names in the learned conventions, with the reasons for each change."""
    rows = df.select("row_ord", "description").join(assigned.select("row_ord", "cluster_id"), "row_ord").join(conventions, "cluster_id", "left").join(predicted, "row_ord", "left")
    spaced = X.norm_space(F.col("description"))
    crossed = F.translate(spaced, "×✕", "xx")
    unit = F.coalesce("unit_space", "predicted")
    united = F.when(unit, F.regexp_replace(crossed, r"([0-9])(mm|cm|inch|kg|ml|oz)\b", "$1 $2")).otherwise(crossed)
    closed = lambda c: F.regexp_replace(c, r"([0-9])\s+[xX]\s+([0-9])", "$1x$2")
    tight = F.when(F.col("dim_tight"), closed(closed(united))).otherwise(united)  # twice: neighbours share a number
    steps = rows.select("row_ord", "description", spaced.alias("s1"), crossed.alias("s2"), united.alias("s3"), tight.alias("s4"))
    words = steps.select("row_ord", F.posexplode(F.split("s4", " ")).alias("i", "w")).withColumn("core", F.regexp_replace("w", "[^0-9A-Za-zÀ-ỹ]", ""))
    cased = words.join(canon.select(F.col("w").alias("core"), "best"), "core", "left").withColumn("w", F.when(F.col("best").isNotNull(), F.replace("w", F.col("core"), F.col("best"))).otherwise(F.col("w")))
    whole = cased.groupBy("row_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]), " ").alias("s5"))
    out = steps.join(whole, "row_ord")
    reason = lambda a, b, text: F.when(F.col(a) != F.col(b), text)
    reasons = F.array(reason("description", "s1", "spaces"), reason("s1", "s2", "multiplication sign"), reason("s2", "s3", "space before unit"), reason("s3", "s4", "spaces around x"), reason("s4", "s5", "casing"))
    return out.select("row_ord", X.norm_space(F.col("s5")).alias("proposed"), F.array_join(F.array_compact(reasons), ", ").alias("reasons"))


def proposals(df: DataFrame, missing: DataFrame) -> DataFrame:
    """Attribute strings with the filled pairs appended, for rows that lack something."""
    fills = missing.where("fill is not null").groupBy("row_ord").agg(F.array_sort(F.collect_list(F.struct("k", "fill"))).alias("f"))
    given = F.transform(F.when(X.is_empty_filter(F.col("filters")), F.array().cast("array<struct<k:string,v:string>>")).otherwise(X.parse_filters(F.col("filters"))), lambda p: F.concat(p["k"], F.lit(": "), p["v"]))
    added = F.transform("f", lambda s: F.concat(s["k"], F.lit(": "), s["fill"]))
    return df.join(fills, "row_ord").select("row_ord", F.array_join(F.concat(given, added), " | ").alias("proposal"))


def audit_summary(df: DataFrame, assigned: DataFrame, missing: DataFrame, contradicted: DataFrame) -> DataFrame:
    """Counters of the audit as one row."""
    a = df.agg(F.count("*").alias("n_rows"), F.count_if(X.is_empty_filter(F.col("filters"))).alias("empty_rows"))
    b = assigned.agg(*[F.count_if(F.col("level") == i).alias(f"level{i}_rows") for i in (1, 2, 3, 4)], F.count_if(F.col("cluster_id").isNull()).alias("alone_rows"), F.count_distinct("cluster_id").alias("clusters"))
    c = missing.agg(F.count_if(F.col("action") == "FILLED").alias("filled"), F.count_if(F.col("action") == "LOOKUP").alias("lookups"), F.count_distinct("row_ord").alias("rows_missing"))
    d = contradicted.agg(F.count("*").alias("contradictions"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def without_filled_peers(df: DataFrame, assigned: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (row_ord) in no cluster, or in one that has no member with any attributes."""
    filled = df.where(~_read(df, "_empty")).select("row_ord")
    served = members.join(filled, "row_ord", "left_semi").select("cluster_id").distinct()
    return assigned.join(served, "cluster_id", "left_anti").select("row_ord")


def rescue_peers(df: DataFrame, wanted: DataFrame, max_postings: int = 4000, top: int = 400, threshold: float = 0.5, min_peers: int = MIN_PEERS) -> DataFrame:
    """Corpus-wide peers among filled rows for rows whose cluster has none: frequent tokens do not nominate,
    the ``top`` rows by shared tokens are compared by Jaccard similarity."""
    toks = df.select("row_ord", _read(df, "_toks").alias("t"), (~_read(df, "_empty")).alias("filled"))
    long = toks.select("row_ord", "filled", F.size("t").alias("n"), F.explode("t").alias("tok"))
    posting = long.where("filled").groupBy("tok").agg(F.count("*").alias("df")).where(F.col("df") <= max_postings)
    index = long.where("filled").join(posting, "tok").select(F.col("row_ord").alias("b"), F.col("n").alias("nb"), "tok")
    asking = long.join(wanted.select("row_ord"), "row_ord", "left_semi").select(F.col("row_ord").alias("a"), F.col("n").alias("na"), "tok")
    shared = asking.join(index, "tok").where("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("hits"))
    near = shared.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("hits"), "b"))).where(F.col("_r") <= top)
    sets = toks.select("row_ord", "t")
    full = near.join(sets.select(F.col("row_ord").alias("a"), F.col("t").alias("ta")), "a").join(sets.select(F.col("row_ord").alias("b"), F.col("t").alias("tb")), "b")
    j = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    near = full.select("a", "b", F.bround(j, 6).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return near.withColumn("_n", F.count("*").over(W.partitionBy("a"))).where(F.col("_n") >= min_peers).drop("_n")
