"""Queries of the category audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import category as C
from shelfmark.plans import duck as D
from shelfmark.plans.registry import query
from shelfmark.plans.views import CATALOG_CTE, catalog

_J = f"WITH {CATALOG_CTE}, {D.JUDGED}"
_Q = f"{_J}, {D.QUEUE}"
_V = f"{_Q}, {D.VERDICTS}"
_LEAVES = "leaves AS (SELECT level1_name, trim(leaf_name) leaf_name, list_sort(list(DISTINCT leaf_id)) leaf_ids, arg_max(leaf_depth, row_ord) leaf_depth FROM catalog GROUP BY 1, 2)"
_R = f"""{_V}, {_LEAVES},
resolved AS (SELECT v.judge, v.key_hash, v.verdict, v.confidence, v.suggested, q.level1_name, l.leaf_name target_name,
  CASE WHEN v.suggested IS NULL THEN 'NONE' WHEN l.leaf_name IS NULL THEN 'NOT_IN_CATALOG' WHEN len(l.leaf_ids) = 1 THEN 'OK' ELSE 'AMBIGUOUS' END target_status,
  CASE WHEN len(l.leaf_ids) = 1 THEN l.leaf_ids[1] END target_id
  FROM verdicts v JOIN queue q USING (key_hash) LEFT JOIN leaves l ON l.level1_name = q.level1_name AND {D.fold('l.leaf_name')} = {D.fold('v.suggested')} AND v.suggested IS NOT NULL)"""
_C = f"""{_R}, dec AS (SELECT q.key_hash, q.row_count, coalesce(a.verdict,'MISSING') label_a, CASE WHEN a.verdict='wrong' THEN {D.fold('a.suggested')} END target_a, coalesce(b.verdict,'MISSING') label_b, CASE WHEN b.verdict='wrong' THEN {D.fold('b.suggested')} END target_b
  FROM queue q LEFT JOIN verdicts a ON a.judge='a' AND a.key_hash=q.key_hash LEFT JOIN verdicts b ON b.judge='b' AND b.key_hash=q.key_hash),
compared AS (SELECT *, CASE WHEN label_a <> label_b THEN 'LABEL' WHEN target_a IS DISTINCT FROM target_b THEN 'TARGET' ELSE 'AGREE' END kind FROM dec)"""
_RULINGS = "rulings AS (SELECT key_hash, CASE WHEN substr(key_hash,2,1) < '8' THEN 'keep' ELSE 'change' END ruling, CASE WHEN substr(key_hash,2,1) >= '8' THEN 'bolt' END ruled_leaf FROM queue WHERE substr(key_hash,1,1) IN ('0','1'))"
_CONS = """cons0 AS (SELECT key_hash, count(*) n, count(DISTINCT CASE WHEN verdict='wrong' THEN target_name END) names, count(CASE WHEN verdict='wrong' THEN target_name END) voted, min(CASE WHEN verdict='wrong' THEN target_name END) nm, min(confidence) confidence FROM resolved GROUP BY 1),
cons AS (SELECT coalesce(c.key_hash, r.key_hash) key_hash, CASE WHEN r.ruling='keep' THEN NULL WHEN r.ruling='change' THEN r.ruled_leaf WHEN names=1 AND voted=2 THEN nm END new_leaf, confidence, r.ruling IS NOT NULL ruled FROM cons0 c FULL JOIN rulings r ON r.key_hash=c.key_hash)"""
_GUARD = f"""guarded AS (SELECT c.key_hash, q.level1_name, q.leaf_name, c.new_leaf, c.confidence, CASE WHEN {D.fold('c.new_leaf')} = {D.fold('q.leaf_name')} THEN 'SAME_LEAF' WHEN {D.is_generic('c.new_leaf')} THEN 'GENERIC' WHEN NOT ruled AND c.confidence < 0.8 THEN 'LOW_CONFIDENCE' WHEN coalesce(len(l.leaf_ids),0) <> 1 THEN 'REFUSED_AMBIGUOUS_TARGET' END reason, l.leaf_ids
  FROM cons c JOIN queue q USING (key_hash) LEFT JOIN leaves l ON l.level1_name = q.level1_name AND {D.fold('l.leaf_name')} = {D.fold('c.new_leaf')} WHERE c.new_leaf IS NOT NULL)"""
_G = f"{_R}, {_RULINGS}, {_CONS}, {_GUARD}"
_APPLIED = f"""applied AS (SELECT c.part_id, c.part_number, c.level1_name, c.leaf_name old_leaf, CASE WHEN g.key_hash IS NOT NULL THEN g.new_leaf ELSE c.leaf_name END leaf_name, CASE WHEN g.key_hash IS NOT NULL THEN g.leaf_ids[1] ELSE c.leaf_id END leaf_id, c.leaf_depth, g.key_hash IS NOT NULL changed, {D.key('c.description','c.leaf_name')} key_hash
  FROM catalog c LEFT JOIN guarded g ON g.reason IS NULL AND g.key_hash = {D.key('c.description','c.leaf_name')})"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    return C.judge(catalog(spark, d))


def queue(spark: SparkSession, d: str) -> DataFrame:
    return C.suspect_queue(judged(spark, d))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Two stand-in judges: verdict, confidence and suggestion follow from a digest of judge and key."""
    leaves = catalog(spark, d).select(F.col("leaf_name").alias("cand")).distinct()
    # a few dozen leaf names, numbered in their order
    numbered = leaves.agg(F.array_sort(F.collect_set("cand")).alias("cands"))
    judges = spark.createDataFrame([("a",), ("b",)], "judge string")
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring("h", i, 1)) - 1
    v = queue(spark, d).select("key_hash").crossJoin(F.broadcast(judges)).withColumn("h", F.md5(F.concat("judge", "key_hash").cast("binary")))
    v = v.crossJoin(F.broadcast(numbered)).withColumns({"d1": digit(1), "d2": digit(2), "d3": digit(3)})
    wrong = (F.col("d1") >= 10) & (F.col("d1") < 14)
    return v.select(
        "judge", "key_hash", F.when(F.col("d1") < 10, "correct").when(F.col("d1") < 14, "wrong").otherwise("unsure").alias("verdict"), ((50 + 3 * F.col("d3")) / 100.0).alias("confidence"),
        F.when(wrong, F.when(F.col("d2") == 15, "not a leaf").otherwise(F.get("cands", F.col("d2") % F.size("cands")))).alias("suggested"),
    )


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return C.resolve(verdicts(spark, d), queue(spark, d), C.leaf_catalog(catalog(spark, d)))


def compared(spark: SparkSession, d: str) -> DataFrame:
    return C.compare_judges(queue(spark, d), verdicts(spark, d))


def rulings(spark: SparkSession, d: str) -> DataFrame:
    second = F.substring("key_hash", 2, 1)
    ruling = F.when(second < "8", "keep").otherwise("change")
    return queue(spark, d).where(F.substring("key_hash", 1, 1).isin("0", "1")).select("key_hash", ruling.alias("ruling"), F.when(second >= "8", "bolt").alias("ruled_leaf"))


def guarded(spark: SparkSession, d: str) -> DataFrame:
    agreed = C.consensus(resolved(spark, d), rulings(spark, d))
    return C.guard_changes(agreed, queue(spark, d), C.leaf_catalog(catalog(spark, d)))


def applied(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog(spark, d)
    return C.apply_changes(rows, guarded(spark, d), C.leaf_depths(rows))


@query(f"{_J} SELECT part_id, verdict, score FROM judged")
def a01_judge(spark, d):
    return judged(spark, d).select("part_id", "verdict", "score")


@query(f"{_J} SELECT coalesce(level1_name,'TOTAL') level1_name, count(*) n_rows, count(*) FILTER (verdict='EXACT') exact, count(*) FILTER (verdict='ALL_WORDS') all_words, count(*) FILTER (verdict='PARTIAL') partial, count(*) FILTER (verdict='NO_OVERLAP') no_overlap FROM judged GROUP BY ROLLUP (level1_name)")
def a02_verdict_crosstab(spark, d):
    return C.crosstab(judged(spark, d))


@query(f"WITH {CATALOG_CTE}, {_LEAVES} SELECT level1_name, leaf_name, array_to_string(leaf_ids, ',') leaf_ids, leaf_depth, len(leaf_ids) > 1 ambiguous FROM leaves")
def a03_leaf_catalog(spark, d):
    return C.leaf_catalog(catalog(spark, d)).withColumn("leaf_ids", F.array_join("leaf_ids", ","))


@query(f"{_Q} SELECT * FROM queue")
def a04_suspect_queue(spark, d):
    return queue(spark, d)


@query(f"{_Q} SELECT * FROM queue WHERE level1_name = 'PROMO'")
def a05_level1_slice(spark, d):
    return C.slice_level1(queue(spark, d), "PROMO")


@query(f"{_V} SELECT key_hash, row_count FROM queue WHERE key_hash NOT IN (SELECT key_hash FROM verdicts WHERE judge='a' AND verdict='correct')")
def a06_unanswered(spark, d):
    done = verdicts(spark, d).where("judge = 'a' and verdict = 'correct'")
    return C.unanswered(queue(spark, d), done).select("key_hash", "row_count")


@query(f"{_Q} SELECT level1_name, key_hash, CAST((rn-1)//20 AS INT) batch, CAST((rn-1)%20 AS INT) item_id FROM (SELECT *, row_number() OVER (PARTITION BY level1_name ORDER BY row_count DESC, first_ord) rn FROM queue)")
def a07_batches(spark, d):
    return C.batches(queue(spark, d)).select("level1_name", "key_hash", "batch", "item_id")


@query(f"{_Q} SELECT level1_name, CAST((rn-1)//20 AS INT) batch, CAST(count(*) AS INT) n_items FROM (SELECT *, row_number() OVER (PARTITION BY level1_name ORDER BY row_count DESC, first_ord) rn FROM queue) GROUP BY 1, 2")
def a07_batch_requests(spark, d):
    requests = C.batch_requests(C.batches(queue(spark, d)), C.leaf_catalog(catalog(spark, d)))
    return requests.where(F.col("request").startswith("{")).select("level1_name", "batch", "n_items")


@query(f"{_V} SELECT judge, key_hash, verdict, confidence, suggested FROM verdicts")
def a08_reply_ingest(spark, d):
    """Replies are assembled from the stand-in verdicts, with fences, an unknown id and an older reply."""
    dealt = C.batches(queue(spark, d))
    v = verdicts(spark, d).join(dealt.select("key_hash", "level1_name", "batch", "item_id"), "key_hash")
    made = v.groupBy("judge", "level1_name", "batch").agg(F.to_json(F.collect_list(F.struct(F.col("item_id").alias("id"), "verdict", "confidence", "suggested"))).alias("j"))
    new = made.select("judge", "level1_name", "batch", F.lit(2).alias("reply_ord"), F.concat(F.lit("```json\n"), "j", F.lit("\n```")).alias("reply"))
    old = made.select("judge", "level1_name", "batch", F.lit(1).alias("reply_ord"), F.lit('[{"id":0,"verdict":"unsure","confidence":0.1},{"id":9999,"verdict":"wrong"}]').alias("reply"))
    return C.ingest_replies(new.unionByName(old), dealt)


@query(f"{_R} SELECT judge, key_hash, target_name, target_status, target_id FROM resolved")
def a09_resolve_targets(spark, d):
    return resolved(spark, d).select("judge", "key_hash", "target_name", "target_status", "target_id")


@query(f"{_V} SELECT judge, verdict, count(*) n_pairs, CAST(sum(row_count) AS BIGINT) n_rows FROM verdicts JOIN queue USING (key_hash) GROUP BY 1, 2")
def a10_verdict_report(spark, d):
    return C.verdict_report(queue(spark, d), verdicts(spark, d))


_FAN = f"{_R}, fan AS (SELECT j.*, r.verdict ai_verdict, r.confidence, r.suggested, r.target_name, r.target_id, r.target_status FROM (SELECT *, {D.key('description','leaf_name')} key_hash FROM judged) j LEFT JOIN (SELECT * FROM resolved WHERE judge='a') r USING (key_hash))"
_LADDER = f"""{_FAN}, ladder AS (SELECT *, CASE WHEN verdict NOT IN ('PARTIAL','NO_OVERLAP') THEN 'PASS_RULE' WHEN ai_verdict IS NULL THEN 'NOT_CHECKED' WHEN ai_verdict='correct' THEN 'AI_OK' WHEN ai_verdict='unsure' THEN 'REVIEW_UNSURE'
  WHEN {D.fold('suggested')} = {D.fold('leaf_name')} THEN 'AI_OK' WHEN target_name IS NULL THEN 'REVIEW_WRONG_NO_TARGET' WHEN {D.is_generic('target_name')} THEN 'REVIEW_GENERIC_TARGET' WHEN target_status='AMBIGUOUS' THEN 'REVIEW_AMBIGUOUS_TARGET' WHEN confidence < 0.8 THEN 'REVIEW_LOW_CONFIDENCE' ELSE 'FIX' END status FROM fan)"""


def _laddered(spark, d):
    return C.status_ladder(C.fan_out(judged(spark, d), resolved(spark, d).where("judge = 'a'")))


@query(f"{_FAN} SELECT part_id, ai_verdict, confidence, target_id FROM fan")
def a11_fan_out(spark, d):
    return C.fan_out(judged(spark, d), resolved(spark, d).where("judge = 'a'")).select("part_id", "ai_verdict", "confidence", "target_id")


@query(f"{_LADDER} SELECT part_id, status FROM ladder")
def a12_status_ladder(spark, d):
    return _laddered(spark, d).select("part_id", "status")


@query(f"{_LADDER} SELECT part_id, level1_name, leaf_name, target_name new_leaf, target_id new_leaf_id FROM ladder WHERE status='FIX'")
def a13_fix_list(spark, d):
    return C.fix_list(_laddered(spark, d))


@query(f"{_LADDER} SELECT leaf_name, target_name new_leaf, count(*) n_rows FROM ladder WHERE status='FIX' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15")
def a13_top_moves(spark, d):
    return C.top_moves(C.fix_list(_laddered(spark, d)))


@query(f"{_C} SELECT key_hash, label_a, target_a, label_b, target_b, kind, row_count FROM compared")
def a14_compare_judges(spark, d):
    return compared(spark, d)


@query(f"{_C} SELECT label_a, label_b, kind, count(*) n_pairs, CAST(sum(row_count) AS BIGINT) n_rows FROM compared GROUP BY 1, 2, 3")
def a14_agreement_matrix(spark, d):
    return C.agreement(compared(spark, d))


_DISP = f"""{_R}, per AS (SELECT key_hash, count(DISTINCT verdict || '|' || coalesce(CASE WHEN verdict='wrong' THEN target_name END,'')) opinions, count(*) n, bool_or(verdict='unsure' OR (verdict='wrong' AND target_name IS NULL)) gap FROM resolved GROUP BY 1),
disp AS (SELECT q.key_hash, q.row_count, q.first_ord, CASE WHEN coalesce(n,0)=2 AND opinions=1 THEN 'settled' WHEN coalesce(gap,true) THEN 'gap' ELSE 'researchable' END kind FROM queue q LEFT JOIN per USING (key_hash))"""


@query(f"{_DISP} SELECT * FROM disp")
def a15_disputes(spark, d):
    return C.disputes(queue(spark, d), resolved(spark, d)).drop("query")


@query(f"{_DISP}, ranked AS (SELECT *, row_number() OVER (ORDER BY row_count DESC, first_ord) r FROM disp WHERE kind <> 'settled') SELECT t AS top, CAST(coalesce(sum(row_count),0) AS BIGINT) n_rows FROM (VALUES (5),(10),(15),(20),(30),(-1)) x(t) LEFT JOIN ranked ON t = -1 OR r <= t GROUP BY 1")
def a16_coverage_curve(spark, d):
    return C.coverage_curve(C.disputes(queue(spark, d), resolved(spark, d)).where("kind <> 'settled'"))


@query(f"{_R}, {_RULINGS}, {_CONS} SELECT key_hash, new_leaf, confidence, ruled FROM cons")
def a17_consensus(spark, d):
    return C.consensus(resolved(spark, d), rulings(spark, d))


@query(f"{_G} SELECT key_hash, level1_name, leaf_name, new_leaf, confidence, reason, CASE WHEN reason IS NULL THEN leaf_ids[1] END new_leaf_id FROM guarded")
def a18_guard_changes(spark, d):
    return guarded(spark, d)


@query(f"{_G}, {_APPLIED} SELECT part_id, leaf_name, leaf_id, leaf_depth, changed, old_leaf FROM applied")
def a19_apply_changes(spark, d):
    return applied(spark, d).select("part_id", "leaf_name", "leaf_id", "leaf_depth", "changed", "old_leaf")


@query(f"{_G}, {_APPLIED} SELECT part_id, part_number, level1_name, old_leaf old_leaf_name, leaf_name new_leaf_name FROM applied WHERE changed")
def a19_change_log(spark, d):
    return C.change_log(applied(spark, d))


@query(f"{_V} SELECT 'a' judge, 'c' AS other, count(*) n FROM verdicts WHERE judge='a'")
def a20_duplicate_sources(spark, d):
    """A third judge that copies the first is found."""
    v = verdicts(spark, d)
    return C.duplicate_sources(v.unionByName(v.where("judge = 'a'").withColumn("judge", F.lit("c"))))


_DAMAGED = """dm AS (SELECT c.* REPLACE (CASE WHEN c.part_id % 103 = 1 THEN c.description || ' x' ELSE c.description END AS description, CASE WHEN c.part_id % 107 = 2 THEN 'no such leaf' ELSE a.leaf_name END AS leaf_name, a.leaf_id AS leaf_id), a.changed FROM catalog c JOIN applied a USING (part_id) WHERE c.part_id % 101 <> 5),
t AS (SELECT * FROM dm UNION ALL SELECT * FROM dm WHERE part_id % 109 = 3),
fj AS (SELECT s.row_ord sr, t.row_ord tr, (s.row_ord, s.part_number, s.description, s.level1_name, s.filters) IS DISTINCT FROM (t.row_ord, t.part_number, t.description, t.level1_name, t.filters) differs, s.leaf_name IS DISTINCT FROM t.leaf_name OR s.leaf_id IS DISTINCT FROM t.leaf_id moved, coalesce(t.changed, false) changed FROM catalog s FULL JOIN t USING (part_id))"""


@query(f"""{_G}, {_APPLIED}, {_DAMAGED} SELECT 'row_count' check_name, abs(count(sr) - count(tr)) failed FROM fj UNION ALL SELECT 'immutable_columns', count(*) FROM fj WHERE differs AND sr IS NOT NULL AND tr IS NOT NULL UNION ALL SELECT 'untouched_rows', count(*) FROM fj WHERE moved AND NOT changed UNION ALL SELECT 'missing_rows', count(*) FROM fj WHERE tr IS NULL
UNION ALL SELECT 'unknown_leaf', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.level1_name = t.level1_name AND c.leaf_name = t.leaf_name AND c.leaf_id = t.leaf_id) UNION ALL SELECT 'part_id_twice', count(*) FROM (SELECT part_id FROM t GROUP BY 1 HAVING count(*) > 1)""")
def a21_verification(spark, d):
    """The applied table with rows lost, repeated, edited and moved, so that every check has something to find."""
    rows, done = catalog(spark, d), applied(spark, d)
    m = lambda n: F.col("part_id") % n
    damaged = done.where(m(101) != 5).withColumn("description", F.when(m(103) == 1, F.concat("description", F.lit(" x"))).otherwise(F.col("description"))).withColumn("leaf_name", F.when(m(107) == 2, "no such leaf").otherwise(F.col("leaf_name")))
    return C.verification(rows, damaged.unionByName(damaged.where(m(109) == 3)), C.leaf_catalog(rows))


@query(f"WITH {CATALOG_CTE} SELECT leaf_id, count(DISTINCT leaf_name) n_names FROM (SELECT CASE WHEN part_id % 500 = 7 THEN substr(md5('nut'),1,6) ELSE leaf_id END leaf_id, leaf_name FROM catalog) GROUP BY 1 HAVING count(DISTINCT leaf_name) > 1")
def a21_id_name_conflicts(spark, d):
    rows = catalog(spark, d).withColumn("leaf_id", F.when(F.col("part_id") % 500 == 7, F.substring(F.md5(F.lit("nut").cast("binary")), 1, 6)).otherwise(F.col("leaf_id")))
    return C.id_name_conflicts(rows)


@query(f"{_G}, {_APPLIED}, conf AS (SELECT key_hash, min(confidence) c FROM resolved GROUP BY 1) SELECT part_id, leaf_name, changed, CASE WHEN changed THEN CAST(round_even((100*c)::DECIMAL(18,6), 0) AS INT) END confidence_pct FROM applied LEFT JOIN conf USING (key_hash)")
def a22_delivery(spark, d):
    rows = catalog(spark, d)
    return C.delivery(applied(spark, d), C.with_key(rows), resolved(spark, d))


_GATE = f"""{_V}, un AS (SELECT key_hash FROM verdicts WHERE substr(key_hash, 3, 1) >= '4' GROUP BY 1 HAVING count(DISTINCT verdict) > 1 OR count(DISTINCT CASE WHEN verdict = 'wrong' THEN {D.fold('suggested')} ELSE '' END) > 1)"""


def _settled(spark, d):
    return queue(spark, d).where(F.substring("key_hash", 3, 1) < "4")


@query(f"{_GATE} SELECT 'unsettled_pairs' check_name, count(*) failed FROM un UNION ALL SELECT 'rows_lost', count(*) FROM catalog WHERE part_id % 401 = 3 UNION ALL SELECT 'rows_added', 1")
def a22_gate(spark, d):
    """Some pairs settled, some rows lost and one added."""
    rows = catalog(spark, d)
    out = rows.where("part_id % 401 <> 3").select("part_id").unionByName(rows.limit(1).select((-F.col("part_id") - 1).alias("part_id")))
    return C.delivery_gate(queue(spark, d), verdicts(spark, d), _settled(spark, d), rows, out)


@query(f"{_J} SELECT part_id, leaf_name FROM judged WHERE false")
def a22_blocked_delivery(spark, d):
    """Nothing is delivered while pairs are unsettled."""
    rows = catalog(spark, d)
    return C.gated(rows.select("part_id", "leaf_name"), C.delivery_gate(queue(spark, d), verdicts(spark, d), _settled(spark, d), rows, rows))


@query(f"{_J} SELECT part_id, leaf_name FROM judged")
def a22_open_delivery(spark, d):
    """All is delivered once every pair is settled."""
    rows, q = catalog(spark, d), queue(spark, d)
    return C.gated(rows.select("part_id", "leaf_name"), C.delivery_gate(q, verdicts(spark, d), q, rows, rows))


@query(f"""{_C}, {_RULINGS}, {_CONS}, {_GUARD} SELECT 'n_rows' metric, count(*) AS value FROM judged UNION ALL SELECT 'suspect_rows', count(*) FROM judged WHERE verdict IN ('PARTIAL','NO_OVERLAP') UNION ALL SELECT 'unique_pairs', count(*) FROM queue
UNION ALL SELECT 'agreeing_pairs', count(*) FROM compared WHERE kind='AGREE' UNION ALL SELECT 'agreeing_rows', CAST(coalesce(sum(row_count),0) AS BIGINT) FROM compared WHERE kind='AGREE' UNION ALL SELECT 'accepted_changes', count(*) FROM guarded WHERE reason IS NULL UNION ALL SELECT 'refused_ambiguous', count(*) FROM guarded WHERE reason='REFUSED_AMBIGUOUS_TARGET'""")
def a23_effectiveness(spark, d):
    return C.effectiveness(judged(spark, d), queue(spark, d), compared(spark, d), guarded(spark, d))


@query(f"WITH {CATALOG_CTE} SELECT part_id, {D.fold('description')} folded, {D.pattern('description')} pat, {D.key('description','leaf_name')} key_hash, array_to_string({D.content_words('description')}, ' ') content, {D.is_generic('leaf_name')} generic, regexp_replace({D.fold('leaf_name')}, ' ', '-', 'g') slug FROM catalog")
def x01_fold_pattern_key(spark, d):
    """X01-X07 over the catalog."""
    c, leaf = F.col("description"), F.col("leaf_name")
    return catalog(spark, d).select("part_id", X.fold(c).alias("folded"), X.pattern(c).alias("pat"), X.verdict_key(c, leaf).alias("key_hash"), F.array_join(X.content_words(c), " ").alias("content"), X.is_generic(leaf).alias("generic"), X.safe_name(leaf).alias("slug"))
