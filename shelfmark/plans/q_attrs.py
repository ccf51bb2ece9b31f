"""Queries of the attribute audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as X
from shelfmark.operators import attrs as A
from shelfmark.operators.steps import kept
from shelfmark.plans import duck as D
from shelfmark.plans.registry import query
from shelfmark.plans.views import CATALOG_CTE, catalog, once

_EMPTY = "(len(pl) <= 1 AND len(list_filter(pl, lambda p: upper(p.k) <> 'N/A')) = 0)"
_PL = """list_transform(list_filter(list_transform(string_split(coalesce(filters,''),'|'), lambda p: trim(p)), lambda p: p <> ''), lambda p: {'k': trim(regexp_extract(p, '^([^:]*)', 1)), 'v': trim(regexp_extract(p, '^[^:]*:(.*)$', 1))})"""
_GRP = r"CASE WHEN regexp_matches(k, '(?i)^(.*?)\s+(Of|Của)\s+(.+)$') AND lower(trim(regexp_extract(k, '(?i)^(.*?)\s+(Of|Của)\s+(.+)$', 3))) <> 'group home' THEN trim(regexp_extract(k, '(?i)^(.*?)\s+(Of|Của)\s+(.+)$', 3)) END"
PAIRS = f"""parsed AS (SELECT *, {_PL} pl FROM catalog), long AS (SELECT row_ord, u.i pos, u.p.k k, u.p.v v FROM (SELECT row_ord, unnest(list_zip(pl, range(len(pl)))) z FROM parsed) t, LATERAL (SELECT z[1] p, z[2] i) u),
fv AS (SELECT row_ord, k, arg_min(v, pos) v, arg_max(v, pos) lastv FROM long GROUP BY 1, 2), flags AS (SELECT row_ord, description, {D.skeleton('description')} skeleton, {D.numbers('description')} nums, {_EMPTY} emp, len(pl) n_pairs FROM parsed)"""
GROUPS = f"""keyed AS (SELECT row_ord, pos, {_GRP} g FROM long), gc AS (SELECT row_ord, g, count(*) n, min(pos) f FROM keyed WHERE g IS NOT NULL GROUP BY 1, 2), own AS (SELECT row_ord, g FROM gc QUALIFY row_number() OVER (PARTITION BY row_ord ORDER BY n DESC, f) = 1),
gv AS (SELECT f.skeleton, o.g, count(*) n, min(row_ord) fo FROM own o JOIN flags f USING (row_ord) GROUP BY 1, 2), maj AS (SELECT skeleton, g FROM gv QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY n DESC, fo) = 1),
grouped AS (SELECT f.row_ord, f.skeleton, coalesce(o.g, m.g) grp, o.g IS NULL voted FROM flags f LEFT JOIN own o USING (row_ord) LEFT JOIN maj m ON m.skeleton = f.skeleton),
sized AS (SELECT *, count(*) OVER (PARTITION BY skeleton) s, CASE WHEN grp IS NOT NULL THEN count(*) OVER (PARTITION BY grp) END g FROM grouped),
tks AS (SELECT row_ord, emp, {D.tokens('description')} t FROM flags),
ntok AS (SELECT x.row_ord, x.grp, x.s, list_sort(t) tk FROM sized x JOIN tks USING (row_ord) WHERE x.grp IS NOT NULL), ncls AS (SELECT grp, tk, min(row_ord) b, min(row_ord) FILTER (s < 5) a, count(*) n FROM ntok GROUP BY 1, 2),
l2p AS (SELECT a, b, n, ov / un::DOUBLE jac FROM (SELECT x.a, y.b, y.n - (x.tk = y.tk)::INT n, len(list_intersect(x.tk, y.tk)) ov, len(list_distinct(list_concat(x.tk, y.tk))) un FROM ncls x JOIN ncls y ON x.grp = y.grp WHERE x.a IS NOT NULL) WHERE n > 0 AND ov > 0 AND ov >= 0.6 * un),
l2c AS (SELECT a FROM l2p GROUP BY 1 HAVING sum(n) + 1 >= 5), l2r AS (SELECT t.row_ord, c.a FROM ntok t JOIN ncls c USING (grp, tk) JOIN l2c ON l2c.a = c.a WHERE t.s < 5),
asg AS (SELECT row_ord, grp, CASE WHEN s >= 5 THEN 's:' || md5(skeleton) WHEN a IS NOT NULL THEN 'p:' || a WHEN g >= 5 THEN 'g:' || grp END cluster_id, CASE WHEN s >= 5 THEN 1 WHEN a IS NOT NULL THEN 2 WHEN g >= 5 THEN 3 END AS level FROM sized LEFT JOIN l2r USING (row_ord)),
mem0 AS (SELECT cluster_id, level, row_ord FROM asg WHERE level = 1 UNION ALL SELECT DISTINCT 'p:' || p.a, 2, t.row_ord FROM (SELECT a, b FROM l2p UNION ALL SELECT a, b FROM ncls) p JOIN l2c ON l2c.a = p.a JOIN ncls c ON c.b = p.b JOIN ntok t ON t.grp = c.grp AND t.tk = c.tk UNION ALL SELECT c.cluster_id, 3, g.row_ord FROM (SELECT DISTINCT cluster_id, grp FROM asg WHERE level = 3) c JOIN grouped g USING (grp)),
served AS (SELECT DISTINCT cluster_id FROM mem0 JOIN flags USING (row_ord) WHERE NOT emp), wanted AS (SELECT row_ord FROM asg a WHERE NOT EXISTS (SELECT 1 FROM served s WHERE s.cluster_id = a.cluster_id)),
rc AS (SELECT a.row_ord a, b.row_ord b, list_intersect(a.t, b.t) sh, len(list_distinct(list_concat(a.t, b.t))) un FROM tks a JOIN wanted w ON w.row_ord = a.row_ord JOIN tks b ON NOT b.emp AND a.row_ord <> b.row_ord), post AS (SELECT tok, count(*) df FROM (SELECT unnest(t) tok FROM tks WHERE NOT emp) GROUP BY 1 HAVING count(*) <= 4000),
rh4 AS (SELECT a, b, len(sh) ov, un, (SELECT count(*) FROM post WHERE list_contains(sh, tok)) hits FROM rc), rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hits DESC, b) k FROM rh4 WHERE hits > 0), rescued AS (SELECT a, b, round_even((ov / un::DOUBLE)::DECIMAL(18,9), 6)::DOUBLE jaccard FROM rk WHERE k <= 400 AND round_even((ov / un::DOUBLE)::DECIMAL(18,9), 6) >= 0.5 QUALIFY count(*) OVER (PARTITION BY a) >= 5),
assigned AS (SELECT row_ord, grp, CASE WHEN a IS NOT NULL THEN 'r:' || row_ord ELSE cluster_id END cluster_id, CASE WHEN a IS NOT NULL THEN 4 ELSE level END AS level FROM asg LEFT JOIN (SELECT DISTINCT a FROM rescued) ON a = row_ord),
members AS (SELECT cluster_id, level, row_ord FROM mem0 UNION ALL SELECT 'r:' || a, 4, b FROM rescued)"""
COVER = """peers AS (SELECT cluster_id, count(*) n_peers FROM members JOIN flags USING (row_ord) WHERE NOT emp GROUP BY 1),
cover AS (SELECT a.cluster_id, a.level, k, count(*) n_have, any_value(n_peers) n_peers, count(*) / any_value(n_peers)::DOUBLE cov FROM fv JOIN members a USING (row_ord) JOIN peers p ON p.cluster_id = a.cluster_id GROUP BY 1, 2, 3)"""
SCHEMA = f"""kept AS (SELECT * FROM cover WHERE cov >= CASE WHEN level = 3 THEN 0.95 ELSE 0.90 END),
lg AS (SELECT fv.row_ord, fv.k, fv.v, fv.lastv, kept.cluster_id, kept.level, f.description, f.nums FROM fv JOIN members a USING (row_ord) JOIN kept ON kept.cluster_id = a.cluster_id AND kept.k = fv.k JOIN flags f USING (row_ord)),
const AS (SELECT cluster_id, k, min(v) cval, avg(contains(lower(description), lower(v))::INT) >= 0.8 in_name FROM lg GROUP BY 1, 2 HAVING count(DISTINCT v) = 1),
even AS (SELECT cluster_id, min(len(nums)) = max(len(nums)) ev FROM members JOIN flags USING (row_ord) GROUP BY 1),
placed AS (SELECT lg.cluster_id, k, row_ord, lastv v, z[2] slot, z[1] num FROM (SELECT *, unnest(list_zip(nums, range(len(nums)))) z FROM lg) lg JOIN even USING (cluster_id) WHERE level = 1 OR ev),
tp AS (SELECT *, CASE WHEN regexp_extract(v, '{D.NUM}') = num AND num <> '' THEN regexp_replace(v, '{D.NUM}', '{{N}}') END template FROM placed),
cand AS (SELECT cluster_id, k, slot, template, row_number() OVER (PARTITION BY cluster_id, k ORDER BY count(*) DESC, min(row_ord), slot, template) r FROM tp WHERE template IS NOT NULL GROUP BY 1, 2, 3, 4),
sc AS (SELECT c.cluster_id, c.k, c.slot, c.template, c.r, avg((replace(c.template, '{{N}}', p.num) = p.v)::INT) acc FROM cand c JOIN placed p ON p.cluster_id = c.cluster_id AND p.k = c.k AND p.slot = c.slot WHERE c.r <= 12 GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY cluster_id, k ORDER BY acc DESC, r) = 1),
mo AS (SELECT cluster_id, k, v modal FROM lg GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY cluster_id, k ORDER BY count(*) DESC, min(row_ord)) = 1),
sch AS (SELECT e.cluster_id, e.level, e.k, e.n_have, e.n_peers, CASE WHEN c.k IS NOT NULL THEN 'CONST' WHEN b.k IS NOT NULL THEN 'SLOT' ELSE 'NONE' END AS mode, c.cval, m.modal, b.slot, b.template, b.acc, c.in_name
  FROM kept e LEFT JOIN const c ON c.cluster_id = e.cluster_id AND c.k = e.k LEFT JOIN (SELECT * FROM best WHERE acc >= 0.98) b ON b.cluster_id = e.cluster_id AND b.k = e.k LEFT JOIN mo m ON m.cluster_id = e.cluster_id AND m.k = e.k),
schema AS (SELECT cluster_id, level, k, n_have, n_peers, mode, CASE mode WHEN 'CONST' THEN cval WHEN 'NONE' THEN modal END AS value, CASE mode WHEN 'SLOT' THEN CAST(slot AS INT) END slot, CASE mode WHEN 'SLOT' THEN template END template, CASE mode WHEN 'SLOT' THEN round_even(acc::DECIMAL(18,9), 6)::DOUBLE END accuracy, coalesce(in_name AND mode='CONST', false) in_name FROM sch)"""
MISSING = """want AS (SELECT a.row_ord, s.*, f.description, f.nums FROM assigned a JOIN schema s USING (cluster_id) JOIN flags f USING (row_ord) WHERE NOT EXISTS (SELECT 1 FROM fv WHERE fv.row_ord = a.row_ord AND fv.k = s.k)),
miss0 AS (SELECT row_ord, cluster_id, k, mode, CASE WHEN mode='CONST' AND NOT (in_name AND NOT contains(lower(description), lower(value))) THEN value WHEN mode='SLOT' AND nums[slot+1] IS NOT NULL THEN replace(template, '{N}', nums[slot+1]) END fill, CASE WHEN mode='NONE' THEN value END hint FROM want),
missing AS (SELECT *, CASE WHEN fill IS NOT NULL THEN 'FILLED' ELSE 'LOOKUP' END AS action FROM miss0)"""
CONTRA = """contra AS (SELECT row_ord, k, mode, v, expected FROM (SELECT fv.row_ord, fv.k, s.mode, fv.v, CASE WHEN mode='CONST' THEN value ELSE replace(template, '{N}', f.nums[slot+1]) END expected FROM fv JOIN assigned a USING (row_ord) JOIN schema s ON s.cluster_id = a.cluster_id AND s.k = fv.k JOIN flags f ON f.row_ord = fv.row_ord WHERE mode <> 'NONE') WHERE expected IS NOT NULL AND expected <> v)"""
P = f"WITH {CATALOG_CTE}, {PAIRS}"
G = f"{P}, {GROUPS}"
S = f"{G}, {COVER}, {SCHEMA}"
M = f"{S}, {MISSING}"


def prepared(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "prepared", lambda: A.prepared(catalog(spark, d)))


def grouped(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "grouped", lambda: kept(A.resolve_groups(prepared(spark, d))))


def clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return once(spark, d, "clusters", lambda: A.clusters(prepared(spark, d), grouped(spark, d)))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d)[0]


def members(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d)[1]


def schema(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "schema", lambda: kept(A.learn_schema(prepared(spark, d), members(spark, d))))


def missing(spark: SparkSession, d: str) -> DataFrame:
    return A.missing_attributes(prepared(spark, d), assigned(spark, d), schema(spark, d))


@query(rf"WITH {CATALOG_CTE} SELECT part_id, {D.norm_space('description')} spaced, {D.skeleton('description')} skeleton, array_to_string({D.numbers('description')}, ',') nums, array_to_string(list_sort({D.tokens('description')}), ' ') toks, regexp_replace(coalesce(filters,''), '[0-9.,]+', '#', 'g') shaped FROM catalog")
def x08_name_expressions(spark, d):
    """X08-X11 and the shape of X19 over the catalog."""
    c = F.col("description")
    return catalog(spark, d).select("part_id", X.norm_space(c).alias("spaced"), X.skeleton(c).alias("skeleton"), F.array_join(X.numbers(c), ",").alias("nums"), F.array_join(F.array_sort(X.tokens(c)), " ").alias("toks"), X.shape(F.col("filters")).alias("shaped"))


@query(f"{P} SELECT row_ord, CAST(pos AS INT) pos, k, v FROM long")
def x12_parse_filters(spark, d):
    return A.pairs(catalog(spark, d))


@query(f"{P} SELECT row_ord, k, v, CAST(row_number() OVER (PARTITION BY row_ord ORDER BY pos) - 1 AS INT) pos FROM (SELECT *, row_number() OVER (PARTITION BY row_ord, k ORDER BY pos) r FROM long WHERE upper(k) <> 'N/A' AND v <> '') WHERE r = 1")
def x13_parse_kv(spark, d):
    """First values by the strict parser; X14's pairs give the same rows here, as no value is empty."""
    kv = catalog(spark, d).select("row_ord", F.posexplode(X.parse_kv(F.col("filters"))).alias("pos", "p"))
    return kv.select("row_ord", "p.k", "p.v", "pos")


@query(f"{P} SELECT row_ord, len(pl) <= 1 AND len(list_filter(pl, lambda p: upper(p.k) <> 'N/A')) = 0 AS is_empty, CAST(len(pl) AS INT) n_pairs FROM parsed")
def x14_pairs_and_empties(spark, d):
    f = F.col("filters")
    return catalog(spark, d).select("row_ord", X.is_empty_filter(f).alias("is_empty"), F.size(X.parse_pairs(f)).alias("n_pairs"))


@query(f"{P}, keyed AS (SELECT row_ord, k, {_GRP} grp FROM long) SELECT row_ord, k, grp, CASE WHEN grp IS NULL THEN k ELSE trim(regexp_extract(k, '(?i)^(.*?)\\s+(Of|Của)\\s+(.+)$', 1)) END base FROM keyed")
def x16_key_groups(spark, d):
    return A.pairs(catalog(spark, d)).select("row_ord", "k", X.key_group(F.col("k")).alias("grp"), X.base_attr(F.col("k")).alias("base"))


@query(f"{P} SELECT row_ord, k, num, CASE WHEN list_contains({D.numbers('v')}, num) THEN regexp_replace(v, '{D.NUM}', '{{N}}') END template, CASE WHEN list_contains({D.numbers('v')}, num) THEN v END rendered FROM (SELECT row_ord, k, v, nums[1] num FROM fv JOIN flags USING (row_ord))")
def x17_number_templates(spark, d):
    rows = catalog(spark, d).select("row_ord", X.numbers(F.col("description"))[0].alias("num"))
    t = A.first_values(A.pairs(catalog(spark, d))).join(rows, "row_ord").withColumn("template", X.sub_first_num(F.col("v"), F.col("num")))
    return t.select("row_ord", "k", "num", "template", X.render(F.col("template"), F.col("num")).alias("rendered"))


@query(rf"""{P} SELECT row_ord, k, TRY_CAST(replace(regexp_extract(v, '(-?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) num, CASE WHEN regexp_matches(v, '^\s*-?[0-9]+(?:[.,][0-9]+)?\s*[a-zA-Z%°"''/]*\s*$') THEN TRY_CAST(replace(regexp_extract(v, '(-?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) END meas,
CASE WHEN regexp_matches(v, '^\s*-?[0-9]+(?:[.,][0-9]+)?\s*[a-zA-Z%°"''/]*\s*$') OR regexp_matches(v, '^\s*[A-Za-z]{{1,2}}\s?-?[0-9]+(?:[.,][0-9]+)?\s*$') THEN TRY_CAST(replace(regexp_extract(v, '(-?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) END ax FROM fv""")
def x18_measures(spark, d):
    v = F.col("v")
    return A.first_values(A.pairs(catalog(spark, d))).select("row_ord", "k", X.number(v).alias("num"), X.measure(v).alias("meas"), X.axis(v).alias("ax"))


@query(f"{G} SELECT row_ord, grp, voted FROM grouped")
def b01_resolve_groups(spark, d):
    return grouped(spark, d).select("row_ord", "grp", "voted")


@query(f"{G} SELECT row_ord, grp, cluster_id, level FROM assigned")
def b02_b04_clusters(spark, d):
    return assigned(spark, d)


@query(f"{G}, pairs AS (SELECT x.row_ord a, y.row_ord b, len(list_intersect(tx.t, ty.t)) ov, len(list_distinct(list_concat(tx.t, ty.t))) un FROM sized x JOIN sized y ON x.grp = y.grp AND x.row_ord <> y.row_ord JOIN tks tx ON tx.row_ord = x.row_ord JOIN tks ty ON ty.row_ord = y.row_ord WHERE x.s < 5) SELECT a, b, round_even((ov / un::DOUBLE)::DECIMAL(18,9), 6)::DOUBLE jaccard FROM pairs WHERE ov > 0 AND ov >= 0.6 * un")
def b03_similar_peers(spark, d):
    """Every row with a rare skeleton and each of its similar peers."""
    return A.similar_peers(A.name_classes(prepared(spark, d), grouped(spark, d)))


@query(f"{G} SELECT cluster_id, level, row_ord FROM members")
def b02_b05_members(spark, d):
    """What each cluster learns from."""
    return members(spark, d)


@query(f"{G}, {COVER} SELECT cluster_id, level, k, n_have, n_peers, round_even(cov::DECIMAL(18,9), 6)::DOUBLE cov FROM cover")
def b06_coverage(spark, d):
    return A.cluster_coverage(prepared(spark, d), members(spark, d)).withColumn("cov", F.bround("cov", 6))


@query(f"{S} SELECT * FROM schema")
def b07_b09_schema(spark, d):
    return schema(spark, d)


@query(f"{M} SELECT row_ord, cluster_id, k, mode, fill, hint, action FROM missing")
def b10_missing(spark, d):
    return missing(spark, d)


@query(f"{S}, {CONTRA} SELECT * FROM contra")
def b11_contradictions(spark, d):
    return A.contradictions(prepared(spark, d), assigned(spark, d), schema(spark, d))


_ODD_CAT = CATALOG_CTE.replace("catalog AS", "catalog0 AS") + ", catalog AS (SELECT * REPLACE (CASE WHEN part_id % 200 = 1 AND filters IS NOT NULL THEN filters || ' | N/A: x | Odd Of bolt: 1' ELSE filters END AS filters) FROM catalog0)"


def _odd(spark, d):
    f = F.col("filters")
    return catalog(spark, d).withColumn("filters", F.when((F.col("part_id") % 200 == 1) & f.isNotNull(), F.concat(f, F.lit(" | N/A: x | Odd Of bolt: 1"))).otherwise(f))


@query(f"WITH {_ODD_CAT}, {PAIRS}, {GROUPS}, {COVER} SELECT row_ord, k, 'NA_KEY' reason FROM long JOIN flags USING (row_ord) WHERE NOT emp AND upper(k) = 'N/A' UNION ALL SELECT row_ord, fv.k, 'RARE' FROM fv JOIN flags USING (row_ord) JOIN assigned a USING (row_ord) JOIN cover c ON c.cluster_id = a.cluster_id AND c.k = fv.k WHERE NOT emp AND c.n_peers >= 5 AND cov < 0.05")
def b12_odd_attributes(spark, d):
    rows = _odd(spark, d)
    return A.odd_attributes(rows, *A.clusters(rows, A.resolve_groups(rows)))


_DUP_CAT = CATALOG_CTE.replace("catalog AS", "catalog0 AS") + ", catalog AS (SELECT * REPLACE (CASE WHEN part_id % 60 = 1 THEN filters || ' | ' || filters ELSE filters END AS filters) FROM catalog0)"


@query(f"WITH {_DUP_CAT}, {PAIRS} SELECT row_ord, k, count(*) n, count(DISTINCT v) n_values FROM long GROUP BY 1, 2 HAVING count(*) > count(DISTINCT v)")
def b13_duplicate_pairs(spark, d):
    rows = catalog(spark, d)
    return A.duplicate_pairs(rows.withColumn("filters", F.when(F.col("part_id") % 60 == 1, F.concat("filters", F.lit(" | "), "filters")).otherwise(F.col("filters"))))


@query(f"{P} SELECT row_ord, 4 declared, CAST(CASE WHEN emp THEN 0 ELSE n_pairs END AS INT) parsed FROM flags WHERE row_ord % 13 <> 0 AND CASE WHEN emp THEN 0 ELSE n_pairs END <> 4")
def b14_count_mismatch(spark, d):
    return A.count_mismatch(catalog(spark, d).withColumn("declared", F.when(F.col("row_ord") % 13 != 0, "4")))


@query(f"{S}, cg AS (SELECT cluster_id, grp FROM assigned WHERE level = 1 AND grp IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(row_ord)) = 1), sz AS (SELECT cluster_id, count(*) AS rows FROM assigned WHERE level = 1 GROUP BY 1 HAVING count(*) >= 5), el AS (SELECT * FROM cg JOIN sz USING (cluster_id)), tot AS (SELECT grp, count(*) clusters FROM el GROUP BY 1 HAVING count(*) >= 3), vt AS (SELECT el.grp, k, count(*) votes, any_value(clusters) clusters FROM el JOIN schema USING (cluster_id) JOIN tot ON tot.grp = el.grp GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(clusters)) SELECT el.grp, el.cluster_id, vt.k, votes, clusters, rows FROM el JOIN vt ON vt.grp = el.grp WHERE NOT EXISTS (SELECT 1 FROM schema s WHERE s.cluster_id = el.cluster_id AND s.k = vt.k)")
def b15_group_gaps(spark, d):
    return A.group_gaps(assigned(spark, d), schema(spark, d))


_MARK = r"""mk0 AS (SELECT row_ord, description, regexp_matches(description, '[0-9]\s(?:mm|cm|inch|kg|ml|oz)\b') a, regexp_matches(description, '[0-9](?:mm|cm|inch|kg|ml|oz)\b') b FROM catalog),
mt AS (SELECT a, unnest(list_distinct(regexp_extract_all(lower(description), '([0-9A-Za-zÀ-ỹ/#]+)', 1))) word FROM mk0 WHERE a <> b),
mk AS (SELECT word, sum(a::INT) / count(*)::DOUBLE p, count(*) n FROM mt WHERE NOT (word = 'x' OR (regexp_matches(word, '[0-9]') AND regexp_matches(word, '[a-zà-ỹ]'))) GROUP BY 1 HAVING count(*) >= 25 AND abs(sum(a::INT) / count(*)::DOUBLE - 0.5) >= 0.3)"""


@query(f"WITH {CATALOG_CTE}, {_MARK} SELECT word, round_even(p::DECIMAL(18,9), 6)::DOUBLE p, n FROM mk")
def b16_convention_markers(spark, d):
    return A.markers(catalog(spark, d), A.UNIT_SPACED, A.UNIT_TIGHT).withColumn("p", F.bround("p", 6))


@query(f"WITH {CATALOG_CTE}, {_MARK}, vw AS (SELECT row_ord, unnest(list_distinct(regexp_extract_all(lower(description), '([0-9A-Za-zÀ-ỹ/#]+)', 1))) word FROM catalog), vp AS (SELECT row_ord, sum(p * ln(n + 1.0) * abs(p - 0.5)) / sum(ln(n + 1.0) * abs(p - 0.5)) p FROM vw JOIN mk USING (word) GROUP BY 1) SELECT row_ord, CASE WHEN p >= 0.8 THEN true WHEN p <= 0.2 THEN false END predicted FROM catalog LEFT JOIN vp USING (row_ord)")
def b16_convention_votes(spark, d):
    rows = catalog(spark, d)
    return A.predict_convention(rows, A.markers(rows, A.UNIT_SPACED, A.UNIT_TIGHT))


_CASE_CAT = "cc AS (SELECT row_ord, CASE WHEN row_ord % 50 = 0 THEN upper(description) ELSE description END description FROM catalog)"
_CANON = """cw AS (SELECT row_ord, z[2] p, z[1] w FROM (SELECT row_ord, unnest(list_zip(l, range(len(l)))) z FROM (SELECT row_ord, regexp_extract_all(description, '([A-Za-zÀ-ỹ]{2,})', 1) l FROM cc))),
cn AS (SELECT w, lower(w) lw, count(*) n, min(row_ord * 1000 + p) f FROM cw GROUP BY 1, 2), cr AS (SELECT *, sum(n) OVER (PARTITION BY lw) total, first_value(w) OVER (PARTITION BY lw ORDER BY n DESC, f) best FROM cn)"""


def _cased(spark, d):
    c = F.col("description")
    return catalog(spark, d).withColumn("description", F.when(F.col("row_ord") % 50 == 0, F.upper(c)).otherwise(c))


@query(f"WITH {CATALOG_CTE}, {_CASE_CAT}, {_CANON} SELECT w, best, n, CAST(total AS BIGINT) total FROM cr WHERE total >= 30 AND w <> best AND n / total < 0.2")
def b17_casing_canon(spark, d):
    return A.casing_canon(_cased(spark, d))


@query(rf"{G}, cv AS (SELECT cluster_id, count(*) FILTER (regexp_matches(description, '[0-9]\s(?:mm|cm|inch|kg|ml|oz)\b')) us, count(*) FILTER (regexp_matches(description, '[0-9](?:mm|cm|inch|kg|ml|oz)\b')) ut, count(*) FILTER (regexp_matches(description, '[0-9]x[0-9]')) dt, count(*) FILTER (regexp_matches(description, '[0-9]\s[xX]\s[0-9]')) ds FROM assigned JOIN flags USING (row_ord) WHERE cluster_id IS NOT NULL GROUP BY 1) SELECT cluster_id, CASE WHEN us + ut >= 5 AND least(us, ut) <= 0.1 * (us + ut) THEN us > ut END unit_space, CASE WHEN dt + ds >= 5 AND least(dt, ds) <= 0.1 * (dt + ds) THEN dt > ds END dim_tight FROM cv")
def b18_cluster_conventions(spark, d):
    return A.cluster_conventions(catalog(spark, d), assigned(spark, d))


_CASED_CAT = CATALOG_CTE.replace("catalog AS", "catalog0 AS") + ", catalog AS (SELECT * REPLACE (CASE WHEN row_ord % 50 = 0 THEN upper(description) ELSE description END AS description) FROM catalog0), cc AS (SELECT row_ord, description FROM catalog)"
_FIX = rf"""cv AS (SELECT cluster_id, count(*) FILTER (regexp_matches(description, '[0-9]\s(?:mm|cm|inch|kg|ml|oz)\b')) us, count(*) FILTER (regexp_matches(description, '[0-9](?:mm|cm|inch|kg|ml|oz)\b')) ut, count(*) FILTER (regexp_matches(description, '[0-9]x[0-9]')) dt, count(*) FILTER (regexp_matches(description, '[0-9]\s[xX]\s[0-9]')) ds FROM assigned JOIN flags USING (row_ord) WHERE cluster_id IS NOT NULL GROUP BY 1),
cw2 AS (SELECT cluster_id, CASE WHEN us + ut >= 5 AND least(us, ut) <= 0.1 * (us + ut) THEN us > ut END unit_space, CASE WHEN dt + ds >= 5 AND least(dt, ds) <= 0.1 * (dt + ds) THEN dt > ds END dim_tight FROM cv),
vw AS (SELECT row_ord, unnest(list_distinct(regexp_extract_all(lower(description), '([0-9A-Za-zÀ-ỹ/#]+)', 1))) word FROM catalog), vp AS (SELECT row_ord, sum(p * ln(n + 1.0) * abs(p - 0.5)) / sum(ln(n + 1.0) * abs(p - 0.5)) p FROM vw JOIN mk USING (word) GROUP BY 1),
s1 AS (SELECT c.row_ord, c.description, {D.norm_space('c.description')} a, coalesce(unit_space, CASE WHEN p >= 0.8 THEN true WHEN p <= 0.2 THEN false END) us, dim_tight FROM catalog c LEFT JOIN assigned g ON g.row_ord = c.row_ord LEFT JOIN cw2 ON cw2.cluster_id = g.cluster_id LEFT JOIN vp ON vp.row_ord = c.row_ord),
s2 AS (SELECT *, translate(a, '×✕', 'xx') b FROM s1), s3 AS (SELECT *, CASE WHEN us THEN regexp_replace(b, '([0-9])(mm|cm|inch|kg|ml|oz)\b', '\1 \2', 'g') ELSE b END c FROM s2),
s4 AS (SELECT *, CASE WHEN dim_tight THEN regexp_replace(regexp_replace(c, '([0-9])\s+[xX]\s+([0-9])', '\1x\2', 'g'), '([0-9])\s+[xX]\s+([0-9])', '\1x\2', 'g') ELSE c END d FROM s3),
canon AS (SELECT w, best FROM cr WHERE total >= 30 AND w <> best AND n / total < 0.2), wz AS (SELECT row_ord, z[2] i, z[1] w FROM (SELECT row_ord, unnest(list_zip(string_split(d, ' '), range(len(string_split(d, ' '))))) z FROM s4)),
wc AS (SELECT row_ord, i, CASE WHEN best IS NOT NULL THEN replace(wz.w, k.w, best) ELSE wz.w END w FROM wz LEFT JOIN canon k ON k.w = regexp_replace(wz.w, '[^0-9A-Za-zÀ-ỹ]', '', 'g')), s5 AS (SELECT row_ord, string_agg(w, ' ' ORDER BY i) e FROM wc GROUP BY 1)"""


@query(f"WITH {_CASED_CAT}, {PAIRS}, {GROUPS}, {_MARK}, {_CANON}, {_FIX} SELECT row_ord, {D.norm_space('e')} proposed, array_to_string(list_filter([CASE WHEN description <> a THEN 'spaces' END, CASE WHEN a <> b THEN 'multiplication sign' END, CASE WHEN b <> c THEN 'space before unit' END, CASE WHEN c <> d THEN 'spaces around x' END, CASE WHEN d <> e THEN 'casing' END], lambda x: x IS NOT NULL), ', ') reasons FROM s4 JOIN s5 USING (row_ord)")
def b19_fix_names(spark, d):
    """Names in the learned conventions; one row in fifty is written in capitals."""
    rows = _cased(spark, d)
    groups = A.clusters(rows, A.resolve_groups(rows))[0]
    return A.fix_names(rows, groups, A.cluster_conventions(rows, groups), A.predict_convention(rows, A.markers(rows, A.UNIT_SPACED, A.UNIT_TIGHT)), A.casing_canon(rows))


@query(f"{M}, fl AS (SELECT row_ord, list_sort(list(k || ': ' || fill)) f FROM missing WHERE fill IS NOT NULL GROUP BY 1) SELECT row_ord, array_to_string(list_concat(CASE WHEN emp THEN [] ELSE list_transform(pl, lambda p: p.k || ': ' || p.v) END, f), ' | ') proposal FROM fl JOIN parsed USING (row_ord) JOIN flags USING (row_ord)")
def b20_proposals(spark, d):
    return A.proposals(catalog(spark, d), missing(spark, d))


@query(f"{M}, {CONTRA} SELECT (SELECT count(*) FROM flags) n_rows, (SELECT count(*) FROM flags WHERE emp) empty_rows, {", ".join(f"(SELECT count(*) FROM assigned WHERE level={i}) level{i}_rows" for i in (1, 2, 3, 4))}, (SELECT count(*) FROM assigned WHERE cluster_id IS NULL) alone_rows, (SELECT count(DISTINCT cluster_id) FROM assigned) clusters, (SELECT count(*) FROM missing WHERE action='FILLED') filled, (SELECT count(*) FROM missing WHERE action='LOOKUP') lookups, (SELECT count(DISTINCT row_ord) FROM missing) rows_missing, (SELECT count(*) FROM contra) contradictions")
def b21_audit_summary(spark, d):
    rows, groups, learned = catalog(spark, d), assigned(spark, d), schema(spark, d)
    return A.audit_summary(rows, groups, missing(spark, d), A.contradictions(rows, groups, learned))


@query(f"{G} SELECT * FROM rescued")
def b05_rescue_peers(spark, d):
    """Asked by the rows that levels 1 to 3 leave without a filled peer."""
    rows, (groups, teaching) = catalog(spark, d), clustered(spark, d)
    return A.rescue_peers(rows, groups.where("level = 4").select("row_ord").union(A.without_filled_peers(rows, groups, teaching)))
