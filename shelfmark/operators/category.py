"""Category audit: does the assigned leaf match the description?

Free lexical verdicts first; suspect rows collapse to one question for each
pattern and leaf; verdicts of judges come back as a table keyed by content and
are fanned out to rows by an equi join; changes pass guards before they apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X

VERDICTS = ["EXACT", "ALL_WORDS", "PARTIAL", "NO_OVERLAP"]
SUSPECT = ["PARTIAL", "NO_OVERLAP"]
MIN_CONFIDENCE = 0.8


def judge(df: DataFrame) -> DataFrame:
    """Lexical verdict and score of description against leaf name."""
    leaf = X.fold(F.col("leaf_name"))
    scored = df.withColumns({"_fd": X.fold(F.col("description")), "_fl": leaf, "_lw": X.content_words(F.col("leaf_name")), "_dw": X.content_words(F.col("description"))})
    hits = F.size(F.filter("_lw", lambda w: F.array_contains(F.col("_dw"), w)))
    n = F.size("_lw")
    exact = X.phrase_in(F.col("_fl"), F.col("_fd"))
    verdict = F.when(exact, "EXACT").when(n == 0, "NO_OVERLAP").when(hits == n, "ALL_WORDS").when(hits == 0, "NO_OVERLAP").otherwise("PARTIAL")
    score = F.when(exact, 1.0).when(n == 0, 0.0).otherwise(F.bround(hits / n, 3))
    return scored.withColumns({"verdict": verdict, "score": score}).drop("_fd", "_fl", "_lw", "_dw")


def crosstab(judged: DataFrame) -> DataFrame:
    """Verdict counts by level 1, with a TOTAL row."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS]
    out = judged.rollup("level1_name").agg(F.grouping("level1_name").alias("g"), F.count("*").alias("n_rows"), *counts)
    return out.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.coalesce("level1_name", F.lit("(none)"))).alias("level1_name"), "n_rows", *[v.lower() for v in VERDICTS])


def leaf_catalog(df: DataFrame) -> DataFrame:
    """Leaves of each level 1 with their ids; ambiguous where a name has several ids."""
    ids = F.array_sort(F.collect_set("leaf_id"))
    return df.groupBy("level1_name", F.trim("leaf_name").alias("leaf_name")).agg(ids.alias("leaf_ids"), F.max_by("leaf_depth", "row_ord").alias("leaf_depth")).withColumn("ambiguous", F.size("leaf_ids") > 1)


def leaf_depths(df: DataFrame) -> DataFrame:
    """Depth of each leaf id: the last row wins."""
    return df.groupBy("leaf_id").agg(F.max_by("leaf_depth", "row_ord").alias("leaf_depth"))


def with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("key_hash", X.verdict_key(F.col("description"), F.col("leaf_name")))


def suspect_queue(judged: DataFrame) -> DataFrame:
    """One question for each (pattern, leaf) of suspect rows, largest first by row_count."""
    rows = with_key(judged.where(F.col("verdict").isin(SUSPECT)))
    first = lambda c, name: F.min_by(c, "row_ord").alias(name)
    # the first five ids come from a rank, so no group is collected whole
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("key_hash").orderBy("row_ord")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.struct("row_ord", "part_id")))), lambda s: s["part_id"].cast("string")), ",")
    return ranked.groupBy("key_hash").agg(
        first("description", "sample_description"), first("leaf_name", "leaf_name"), first("level1_name", "level1_name"), first("verdict", "rule_verdict"), first("score", "rule_score"),
        F.count("*").alias("row_count"), F.min("row_ord").alias("first_ord"), ids.alias("part_ids"),
    )


def slice_level1(df: DataFrame, level1: str) -> DataFrame:
    return df.where(F.col("level1_name") == level1)


def unanswered(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Questions without a stored verdict."""
    return queue.join(verdicts.select("key_hash"), "key_hash", "left_anti")


def batches(queue: DataFrame, size: int = 20) -> DataFrame:
    """Questions dealt into batches that never mix level 1 groups."""
    w = W.partitionBy("level1_name").orderBy(F.desc("row_count"), "first_ord")
    return queue.withColumn("_n", F.row_number().over(w)).select("*", F.floor((F.col("_n") - 1) / size).cast("int").alias("batch"), ((F.col("_n") - 1) % size).cast("int").alias("item_id")).drop("_n")


def batch_requests(dealt: DataFrame, catalog_leaves: DataFrame | None) -> DataFrame:
    """One JSON request for each batch: items, and the leaves of the level 1 group (none in an ablation)."""
    item = F.struct("item_id", F.col("sample_description").alias("description"), "leaf_name")
    out = dealt.groupBy("level1_name", "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    if catalog_leaves is not None:
        leaves = catalog_leaves.groupBy("level1_name").agg(F.array_sort(F.collect_set("leaf_name")).alias("leaves"))
        out = out.join(leaves, "level1_name", "left")
    else:
        out = out.withColumn("leaves", F.array().cast("array<string>"))
    return out.select("level1_name", "batch", F.size("items").alias("n_items"), F.to_json(F.struct("leaves", "items")).alias("request"))


REPLY = "array<struct<id:int,verdict:string,confidence:double,suggested:string>>"


def ingest_replies(replies: DataFrame, dealt: DataFrame) -> DataFrame:
    """Verdicts by key from reply texts (judge, level1_name, batch, reply_ord, reply); unknown ids go, the last reply wins."""
    parsed = replies.withColumn("_a", F.from_json(X.reply_array(F.col("reply")), REPLY)).select("judge", "level1_name", "batch", "reply_ord", F.posexplode("_a").alias("_p", "_x"))
    joined = parsed.join(dealt.select("level1_name", "batch", F.col("item_id").alias("_id"), "key_hash"), ["level1_name", "batch"]).where(F.col("_x.id") == F.col("_id"))
    last = W.partitionBy("judge", "key_hash").orderBy(F.desc("reply_ord"), F.desc("_p"))
    return joined.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("judge", "key_hash", "_x.verdict", "_x.confidence", "_x.suggested")


def rejected_replies(replies: DataFrame, form: Column) -> DataFrame:
    """Replies that give no answers, with why: no text of the form (``X.reply_array`` or ``X.reply_object`` of the reply), or one that is no JSON."""
    why = F.when(form.isNull(), "NO_JSON").when(F.try_parse_json(form).isNull(), "NOT_PARSED")
    return replies.withColumn("reason", why).where("reason is not null")


def resolve(verdicts: DataFrame, queue: DataFrame, leaves: DataFrame) -> DataFrame:
    """Suggested leaf looked up in its level 1 catalog by folded name; the id only if there is exactly one."""
    names = leaves.select("level1_name", X.fold(F.col("leaf_name")).alias("_f"), F.col("leaf_name").alias("target_name"), "leaf_ids").withColumn("_n", F.row_number().over(W.partitionBy("level1_name", "_f").orderBy("target_name"))).where("_n = 1").drop("_n")
    out = verdicts.join(queue.select("key_hash", "level1_name"), "key_hash").withColumn("_f", X.fold(F.col("suggested"))).join(names, ["level1_name", "_f"], "left")
    status = F.when(F.col("suggested").isNull(), "NONE").when(F.col("target_name").isNull(), "NOT_IN_CATALOG").when(F.size("leaf_ids") == 1, "OK").otherwise("AMBIGUOUS")
    return out.withColumn("target_status", status).withColumn("target_id", F.when(F.col("target_status") == "OK", F.col("leaf_ids")[0])).drop("_f", "leaf_ids")


def verdict_report(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs and rows for each judge and verdict."""
    return verdicts.join(queue.select("key_hash", "row_count"), "key_hash").groupBy("judge", "verdict").agg(F.count("*").alias("n_pairs"), F.sum("row_count").alias("n_rows"))


def fan_out(judged: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows with the verdict of their (pattern, leaf), by an equi join on the key."""
    cols = ["key_hash", F.col("verdict").alias("ai_verdict"), "confidence", "suggested", "target_name", "target_id", "target_status"]
    return with_key(judged).join(resolved.select(*cols), "key_hash", "left")


def status_ladder(fanned: DataFrame) -> DataFrame:
    """What is to happen to a row; the first rule that holds."""
    same = X.fold(F.col("suggested")) == X.fold(F.col("leaf_name"))
    ladder = (
        F.when(~F.col("verdict").isin(SUSPECT), "PASS_RULE").when(F.col("ai_verdict").isNull(), "NOT_CHECKED").when(F.col("ai_verdict") == "correct", "AI_OK")
        .when(F.col("ai_verdict") == "unsure", "REVIEW_UNSURE").when(same, "AI_OK").when(F.col("target_name").isNull(), "REVIEW_WRONG_NO_TARGET")
        .when(X.is_generic(F.col("target_name")), "REVIEW_GENERIC_TARGET").when(F.col("target_status") == "AMBIGUOUS", "REVIEW_AMBIGUOUS_TARGET")
        .when(F.col("confidence") < MIN_CONFIDENCE, "REVIEW_LOW_CONFIDENCE").otherwise("FIX")
    )
    return fanned.withColumn("status", ladder)


def fix_list(laddered: DataFrame) -> DataFrame:
    return laddered.where("status = 'FIX'").select("part_id", "level1_name", "leaf_name", F.col("target_name").alias("new_leaf"), F.col("target_id").alias("new_leaf_id"))


def top_moves(fixes: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most frequent moves."""
    return fixes.groupBy("leaf_name", "new_leaf").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "leaf_name", "new_leaf").limit(n)


def _decisions(queue: DataFrame, verdicts: DataFrame, name: str) -> DataFrame:
    one = verdicts.where(F.col("judge") == name).select("key_hash", F.col("verdict").alias(f"label_{name}"), F.when(F.col("verdict") == "wrong", X.fold(F.col("suggested"))).alias(f"target_{name}"))
    return queue.select("key_hash", "row_count").join(one, "key_hash", "left").withColumn(f"label_{name}", F.coalesce(f"label_{name}", F.lit("MISSING")))


def compare_judges(queue: DataFrame, verdicts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Decisions of two judges side by side, with the kind of disagreement (raw folded targets)."""
    both = _decisions(queue, verdicts, a).join(_decisions(queue, verdicts, b).drop("row_count"), "key_hash")
    kind = F.when(F.col(f"label_{a}") != F.col(f"label_{b}"), "LABEL").when(~F.col(f"target_{a}").eqNullSafe(F.col(f"target_{b}")), "TARGET").otherwise("AGREE")
    return both.withColumn("kind", kind)


def agreement(compared: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label matrix with pairs and rows."""
    return compared.groupBy(f"label_{a}", f"label_{b}", "kind").agg(F.count("*").alias("n_pairs"), F.sum("row_count").alias("n_rows"))


def disputes(queue: DataFrame, resolved: DataFrame, n_judges: int = 2) -> DataFrame:
    """settled, gap or researchable, by labels and resolved targets of all judges; with a search query."""
    target = F.coalesce(F.when(F.col("verdict") == "wrong", F.col("target_name")), F.lit(""))
    bad = (F.col("verdict") == "unsure") | ((F.col("verdict") == "wrong") & F.col("target_name").isNull())
    per = resolved.groupBy("key_hash").agg(F.count_distinct("verdict", target).alias("opinions"), F.count("*").alias("n"), F.bool_or(bad).alias("gap"))
    kind = F.when((F.coalesce("n", F.lit(0)) == n_judges) & (F.col("opinions") == 1), "settled").when(F.coalesce("gap", F.lit(True)), "gap").otherwise("researchable")
    return queue.join(per, "key_hash", "left").select("key_hash", "row_count", "first_ord", kind.alias("kind"), X.query_for(F.col("sample_description")).alias("query"))


def coverage_curve(disputed: DataFrame, tops=(5, 10, 15, 20, 30)) -> DataFrame:
    """Rows covered by the largest pairs; only the ``max(tops)`` largest are ranked."""
    largest = disputed.orderBy(F.desc("row_count"), "first_ord").limit(max(tops))
    ranked = largest.withColumn("_r", F.row_number().over(W.orderBy(F.desc("row_count"), "first_ord")))
    rows = [ranked.where(F.col("_r") <= t).agg(F.lit(t).alias("top"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows")) for t in tops]
    out = disputed.agg(F.lit(-1).alias("top"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"))
    for r in rows:
        out = out.unionByName(r)
    return out


def consensus(resolved: DataFrame, rulings: DataFrame, n_judges: int = 2, accept_single: bool = False) -> DataFrame:
    """The leaf all judges name (or a ruling names), with the least confidence; null without consensus."""
    named = F.when(F.col("verdict") == "wrong", F.col("target_name"))
    per = resolved.groupBy("key_hash").agg(
        F.count("*").alias("n"), F.count_distinct(named).alias("names"), F.count(named).alias("voted"), F.min(named).alias("name"), F.min("confidence").alias("confidence")
    )
    agreed = (F.col("names") == 1) & ((F.col("voted") == n_judges) | F.lit(accept_single))
    per = per.select("key_hash", F.when(agreed, F.col("name")).alias("voted_leaf"), "confidence")
    out = per.join(rulings.select("key_hash", "ruling", "ruled_leaf"), "key_hash", "full_outer")
    leaf = F.when(F.col("ruling") == "keep", F.lit(None)).when(F.col("ruling") == "change", F.col("ruled_leaf")).otherwise(F.col("voted_leaf"))
    return out.select("key_hash", leaf.alias("new_leaf"), "confidence", F.col("ruling").isNotNull().alias("ruled"))


def guard_changes(agreed: DataFrame, queue: DataFrame, leaves: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Reasons to drop a change; the target id where none holds."""
    names = leaves.select("level1_name", X.fold(F.col("leaf_name")).alias("_f"), "leaf_ids")
    out = agreed.where("new_leaf is not null").join(queue.select("key_hash", "level1_name", "leaf_name"), "key_hash").withColumn("_f", X.fold(F.col("new_leaf"))).join(names, ["level1_name", "_f"], "left")
    if excluded is not None:
        out = out.join(excluded.select("key_hash", F.lit(True).alias("_x")), "key_hash", "left")
    else:
        out = out.withColumn("_x", F.lit(None).cast("boolean"))
    reason = (
        F.when(F.col("_f") == X.fold(F.col("leaf_name")), "SAME_LEAF").when(X.is_generic(F.col("new_leaf")), "GENERIC")
        .when(~F.col("ruled") & (F.col("confidence") < MIN_CONFIDENCE), "LOW_CONFIDENCE").when(F.col("_x"), "EXCLUDED")
        .when(F.coalesce(F.size("leaf_ids"), F.lit(0)) != 1, "REFUSED_AMBIGUOUS_TARGET")
    )
    return out.withColumn("reason", reason).select("key_hash", "level1_name", "leaf_name", "new_leaf", "confidence", "reason", F.when(F.col("reason").isNull(), F.col("leaf_ids")[0]).alias("new_leaf_id"))


def apply_changes(df: DataFrame, guarded: DataFrame, depths: DataFrame) -> DataFrame:
    """Rows with leaf id, name and depth replaced where a change passed; all other columns as they were."""
    changes = guarded.where("new_leaf_id is not null").select("key_hash", F.col("new_leaf").alias("_leaf"), F.col("new_leaf_id").alias("_id")).join(depths.select(F.col("leaf_id").alias("_id"), F.col("leaf_depth").alias("_depth")), "_id", "left")
    out = with_key(df).join(changes, "key_hash", "left")
    new = {"leaf_name": "_leaf", "leaf_id": "_id", "leaf_depth": "_depth"}
    cols: list[Column] = [F.coalesce(new[c], c).alias(c) if c in new else F.col(c) for c in df.columns]
    return out.select(*cols, F.col("_id").isNotNull().alias("changed"), F.col("leaf_name").alias("old_leaf"))


def change_log(applied: DataFrame) -> DataFrame:
    return applied.where("changed").select("part_id", "part_number", "level1_name", F.col("old_leaf").alias("old_leaf_name"), F.col("leaf_name").alias("new_leaf_name"))


def duplicate_sources(verdicts: DataFrame) -> DataFrame:
    """Pairs of judges with identical content: only one opinion.  Content is compared by an order-free digest."""
    row = F.xxhash64("key_hash", "verdict", "confidence", "suggested")
    digests = verdicts.groupBy("judge").agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("s"))
    other = digests.select(F.col("judge").alias("other"), "n", "x", "s")
    return digests.join(other, ["n", "x", "s"]).where("judge < other").select("judge", "other", "n")


def id_name_conflicts(df: DataFrame) -> DataFrame:
    """Leaf ids with more than one name; blank ids are ignored."""
    used = df.where(~F.lower(F.trim(F.coalesce("leaf_id", F.lit("")))).isin("", "none", "nan", "null"))
    return used.groupBy("leaf_id").agg(F.count_distinct("leaf_name").alias("n_names")).where("n_names > 1")


def verification(source: DataFrame, applied: DataFrame, leaves: DataFrame) -> DataFrame:
    """(check_name, failed) rows for an applied table against its source."""
    same = [c for c in source.columns if c not in ("leaf_name", "leaf_id", "leaf_depth", "part_id")]
    both = source.alias("s").join(applied.alias("t"), "part_id", "full_outer")
    differs = ~F.coalesce(F.lit(True), F.lit(True))
    for c in same:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    moved = ~F.col("s.leaf_name").eqNullSafe(F.col("t.leaf_name")) | ~F.col("s.leaf_id").eqNullSafe(F.col("t.leaf_id"))
    one = both.agg(
        F.abs(F.count("s.row_ord") - F.count("t.row_ord")).alias("row_count"), F.count_if(differs & F.col("s.row_ord").isNotNull() & F.col("t.row_ord").isNotNull()).alias("immutable_columns"),
        F.count_if(moved & ~F.coalesce(F.col("t.changed"), F.lit(False))).alias("untouched_rows"), F.count_if(F.col("t.row_ord").isNull()).alias("missing_rows"),
    )
    triples = leaves.select("level1_name", "leaf_name", F.explode("leaf_ids").alias("leaf_id")).distinct()
    unknown = applied.join(triples, ["level1_name", "leaf_name", "leaf_id"], "left_anti").agg(F.count("*").alias("unknown_leaf"))
    twice = applied.groupBy("part_id").count().where("count > 1").agg(F.count("*").alias("part_id_twice"))
    wide = one.crossJoin(unknown).crossJoin(twice)  # one row each
    return wide.unpivot([], ["row_count", "immutable_columns", "untouched_rows", "missing_rows", "unknown_leaf", "part_id_twice"], "check_name", "failed")


def delivery(applied: DataFrame, source_keys: DataFrame, resolved: DataFrame) -> DataFrame:
    """Delivered rows: changed flag and confidence percent (least over the judges that gave one)."""
    conf = resolved.groupBy("key_hash").agg(F.min("confidence").alias("c"))
    out = applied.join(source_keys.select("part_id", "key_hash"), "part_id").join(conf, "key_hash", "left")
    return out.select("part_id", "leaf_name", "changed", F.when(F.col("changed"), F.bround(100 * F.col("c"), 0).cast("int")).alias("confidence_pct"))


def effectiveness(judged: DataFrame, queue: DataFrame, compared: DataFrame, guarded: DataFrame) -> DataFrame:
    """Measures of the cascade as (metric, value) rows."""
    a = judged.agg(F.count("*").alias("n_rows"), F.count_if(F.col("verdict").isin(SUSPECT)).alias("suspect_rows"))
    b = queue.agg(F.count("*").alias("unique_pairs"))
    c = compared.agg(F.count_if(F.col("kind") == "AGREE").alias("agreeing_pairs"), F.coalesce(F.sum(F.when(F.col("kind") == "AGREE", F.col("row_count"))), F.lit(0)).alias("agreeing_rows"))
    d = guarded.agg(F.count_if(F.col("reason").isNull()).alias("accepted_changes"), F.count_if(F.col("reason") == "REFUSED_AMBIGUOUS_TARGET").alias("refused_ambiguous"))
    wide = a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each
    return wide.unpivot([], wide.columns, "metric", "value")


def delivery_gate(queue: DataFrame, verdicts: DataFrame, settled: DataFrame, source: DataFrame, output: DataFrame) -> DataFrame:
    """(check_name, failed): what stops a delivery.

    ``unsettled_pairs``: questions that are not ``settled`` (key_hash) and on which
    the judges differ in their verdict or, for wrong ones, in the folded leaf they
    suggest; a judge without a verdict differs from one with.  ``rows_lost`` and
    ``rows_added``: part_ids of only one side.
    """
    target = F.when(F.col("verdict") == "wrong", X.fold(F.col("suggested"))).otherwise("")
    judges = verdicts.agg(F.count_distinct("judge").alias("judges"))
    said = verdicts.groupBy("key_hash").agg(F.count_distinct("judge").alias("n"), F.count_distinct(F.coalesce("verdict", F.lit(""))).alias("labels"), F.count_distinct(F.coalesce(target, F.lit(""))).alias("targets"))
    open_ = queue.select("key_hash").join(settled.select("key_hash"), "key_hash", "left_anti").join(said, "key_hash", "left").crossJoin(judges)  # one row
    unsettled = open_.where("n is not null and (labels > 1 or targets > 1 or n < judges)").agg(F.count("*").alias("unsettled_pairs"))
    a, b = source.select("part_id").distinct(), output.select("part_id").distinct()
    lost, added = a.join(b, "part_id", "left_anti").agg(F.count("*").alias("rows_lost")), b.join(a, "part_id", "left_anti").agg(F.count("*").alias("rows_added"))
    return unsettled.crossJoin(lost).crossJoin(added).unpivot([], ["unsettled_pairs", "rows_lost", "rows_added"], "check_name", "failed")  # one row each


def gated(delivered: DataFrame, gate: DataFrame) -> DataFrame:
    """The delivery, or no rows while any check of the gate fails."""
    return delivered.crossJoin(gate.agg(F.sum("failed").alias("_failed"))).where("_failed = 0").drop("_failed")  # one row
