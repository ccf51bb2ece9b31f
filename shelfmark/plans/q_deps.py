"""Queries of lookups from the table itself, verification and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shelfmark.functions import text as X
from shelfmark.operators import attrs as A
from shelfmark.operators import cascade as K
from shelfmark.operators import curves as C
from shelfmark.operators import deps as P
from shelfmark.operators import verify as V
from shelfmark.operators.steps import by_merge, kept
from shelfmark.plans import duck as D
from shelfmark.plans import q_attrs as QA
from shelfmark.plans.registry import query
from shelfmark.plans.views import SPEC_KEYS, SPECS_CTE, catalog, once, specs

_LONG = f"{QA.G}, lg AS (SELECT g.grp, fv.row_ord, fv.k, fv.v FROM fv JOIN grouped g USING (row_ord) WHERE g.grp IS NOT NULL), nm AS (SELECT g.grp, f.row_ord, f.description AS name FROM flags f JOIN grouped g USING (row_ord) WHERE g.grp IS NOT NULL)"
_POOL = """gs AS (SELECT grp, count(DISTINCT row_ord) gr FROM lg GROUP BY 1), pool AS (SELECT grp, k, count(*) AS rows, count(*) / any_value(gr)::DOUBLE cover FROM lg JOIN gs USING (grp) GROUP BY 1, 2 HAVING count(*) >= 8 AND count(*) / any_value(gr)::DOUBLE >= 0.2 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, k) <= 14)"""
_KEYS = """lp AS (SELECT lg.* FROM lg JOIN pool USING (grp, k)), tri AS (SELECT a.grp, a.row_ord, a.k d1, '' d2, a.v v1, '' v2, t.k target, t.v AS value FROM lp a JOIN lp t ON a.grp = t.grp AND a.row_ord = t.row_ord AND a.k <> t.k
 UNION ALL SELECT a.grp, a.row_ord, a.k, b.k, a.v, b.v, t.k, t.v FROM lp a JOIN lp b ON a.grp = b.grp AND a.row_ord = b.row_ord AND a.k < b.k JOIN lp t ON t.grp = a.grp AND t.row_ord = a.row_ord AND t.k <> a.k AND t.k <> b.k),
tc AS (SELECT grp, d1, d2, target, v1, v2, value, count(*) n, min(row_ord) f FROM tri GROUP BY 1, 2, 3, 4, 5, 6, 7),
keys AS (SELECT grp, d1, d2, target, v1, v2, value, n n_dom, CAST(sum(n) OVER (PARTITION BY grp, d1, d2, target, v1, v2) AS BIGINT) n_tot FROM tc QUALIFY row_number() OVER (PARTITION BY grp, d1, d2, target, v1, v2 ORDER BY n DESC, f) = 1)"""
_REL = """rel0 AS (SELECT k.grp, target, d1, d2, CAST(sum(n_tot) AS BIGINT) support, sum(n_dom) / sum(n_tot)::DOUBLE consistency FROM keys k GROUP BY 1, 2, 3, 4 HAVING sum(n_tot) >= 8 AND sum(n_dom) / sum(n_tot)::DOUBLE >= 0.85),
rel1 AS (SELECT r.*, least(a.cover, coalesce(b.cover, a.cover)) usable FROM rel0 r JOIN pool a ON a.grp = r.grp AND a.k = r.d1 LEFT JOIN pool b ON b.grp = r.grp AND b.k = r.d2),
rel AS (SELECT *, row_number() OVER (PARTITION BY grp, target ORDER BY round_even((usable * consistency)::DECIMAL(18,12), 9) DESC, CASE WHEN d2 = '' THEN 1 ELSE 2 END, support DESC, d1, d2) rank FROM rel1 QUALIFY rank <= 8)"""
_B = f"{_LONG}, {_POOL}, {_KEYS}, {_REL}"
_OPEN = "opn AS (SELECT nm.grp, nm.row_ord, t.target FROM nm JOIN (SELECT grp, k target FROM pool) t USING (grp) WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.row_ord = nm.row_ord AND lg.k = t.target))"
_HAVE = """rh AS (SELECT o.grp, o.row_ord, o.target, r.d1, r.d2, a.v v1, coalesce(b.v, '') v2, r.rank FROM opn o JOIN rel r USING (grp, target) JOIN lg a ON a.row_ord = o.row_ord AND a.k = r.d1 LEFT JOIN lg b ON b.row_ord = o.row_ord AND b.k = r.d2 WHERE r.d2 = '' OR b.v IS NOT NULL)"""
_TRUST = "tr AS (SELECT grp, row_ord, target, value, d1, d2, n_dom, n_tot, CASE WHEN n_dom >= 3 AND n_dom >= 0.95 * n_tot THEN 'TRUSTED' ELSE 'WEAK' END grade FROM rh JOIN keys USING (grp, d1, d2, target, v1, v2) QUALIFY row_number() OVER (PARTITION BY grp, row_ord, target ORDER BY n_dom >= 3 AND n_dom >= 0.95 * n_tot DESC, rank) = 1)"
_IDX = "ix AS (SELECT o.grp, o.row_ord, o.target, k.value, k.d1, k.n_dom, k.n_tot FROM opn o JOIN lg a ON a.row_ord = o.row_ord JOIN keys k ON k.grp = o.grp AND k.d1 = a.k AND k.v1 = a.v AND k.d2 = '' AND k.target = o.target WHERE n_dom >= 3 AND n_dom >= 0.95 * n_tot QUALIFY row_number() OVER (PARTITION BY o.grp, o.row_ord, o.target ORDER BY n_dom DESC, k.d1) = 1)"
_ASK = """ctx AS (SELECT grp, row_ord, target, d1 || '=' || v1 || CASE WHEN d2 <> '' THEN '; ' || d2 || '=' || v2 ELSE '' END context FROM rh QUALIFY row_number() OVER (PARTITION BY grp, row_ord, target ORDER BY rank) = 1),
ask AS (SELECT o.grp, o.target, coalesce(c.context, 'name=' || n.name) context, count(*) n_rows, min(o.row_ord) first_ord, substr(sha1(o.grp || '|' || o.target || '|' || coalesce(c.context, 'name=' || n.name)), 1, 16) key_hash FROM opn o LEFT JOIN ctx c USING (grp, row_ord, target) JOIN nm n ON n.row_ord = o.row_ord GROUP BY o.grp, o.target, coalesce(c.context, 'name=' || n.name))"""
_NUMX = f"TRY_CAST(replace(regexp_extract(v, '(-?[0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE)"
_ISM = r"""regexp_matches(v, '^\s*-?[0-9]+(?:[.,][0-9]+)?\s*[a-zA-Z%°"''/]*\s*$')"""
_VOC = rf"""dv AS (SELECT DISTINCT grp, k, v FROM lg), voc AS (SELECT grp, k, CASE WHEN avg(regexp_matches(v, '^\s*-?[0-9]+(?:[.,][0-9]+)?\s*[a-zA-Z%°"''/]*\s*$')::INT) < 0.8 AND count(*) <= 40 THEN 'enum' ELSE 'format' END kind, count(*) n_values FROM dv GROUP BY 1, 2)"""


_BASE = r"CASE WHEN regexp_matches(k, '(?i)^(.*?)\s+(Of|Của)\s+(.+)$') AND lower(k) NOT LIKE '% of group home' THEN trim(regexp_extract(k, '(?i)^(.*?)\s+(Of|Của)\s+(.+)$', 1)) ELSE k END"


def long(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "long", lambda: kept(A.first_values(A.pairs(QA.prepared(spark, d))).join(QA.grouped(spark, d).select("row_ord", "grp"), "row_ord").where("grp is not null").select("grp", "row_ord", "k", "v")))


def names(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("row_ord", F.col("description").alias("name")).join(QA.grouped(spark, d).select("row_ord", "grp"), "row_ord").where("grp is not null")


def mined(spark: SparkSession, d: str):
    return once(spark, d, "mined", lambda: _mined(spark, d))


def _mined(spark: SparkSession, d: str):
    rows = long(spark, d)
    pool = kept(P.attribute_pool(rows))
    keys = kept(P.dependency_keys(rows, pool))
    relations = kept(P.mine_dependencies(rows, pool, keys))
    cells = names(spark, d).select("grp", "row_ord").join(pool.select("grp", F.col("k").alias("target")), "grp")
    opened = cells.join(rows.select("row_ord", F.col("k").alias("target")), ["row_ord", "target"], "left_anti")
    return rows, pool, keys, relations, opened


@query(f"{_B} SELECT grp, target, d1, d2, support, round_even(consistency::DECIMAL(18,9), 6)::DOUBLE consistency, round_even(usable::DECIMAL(18,9), 6)::DOUBLE usable, rank FROM rel")
def d01_dependencies(spark, d):
    return mined(spark, d)[3]


@query(f"{_LONG}, {_POOL}, lp AS (SELECT lg.* FROM lg JOIN pool USING (grp, k)), tc AS (SELECT a.grp, a.k d1, t.k target, a.v v1, t.v AS value, count(*) n, min(a.row_ord) f FROM lp a JOIN lp t ON a.grp = t.grp AND a.row_ord = t.row_ord AND a.k <> t.k GROUP BY 1, 2, 3, 4, 5), r AS (SELECT *, row_number() OVER w rn, first_value(value) OVER w dominant, first_value(n) OVER w n_dominant FROM tc WINDOW w AS (PARTITION BY grp, d1, target, v1 ORDER BY n DESC, f)) SELECT grp, d1, target, v1, value, n, dominant, n_dominant FROM r WHERE rn > 1")
def d02_minority_report(spark, d):
    rows = long(spark, d)
    return P.minority_report(rows, P.attribute_pool(rows))


@query(f"{_B}, {_OPEN}, {_HAVE}, {_TRUST} SELECT * FROM tr")
def d03_trusted_lookup(spark, d):
    rows, _, keys, relations, opened = mined(spark, d)
    return P.trusted_lookup(opened, rows, relations, keys)


@query(f"{_LONG}, {_POOL}, {_KEYS}, {_OPEN}, {_IDX} SELECT * FROM ix")
def d04_index_lookup(spark, d):
    rows, _, keys, _, opened = mined(spark, d)
    return P.index_lookup(opened, rows, keys)


@query("WITH s AS (SELECT DISTINCT lang grp, source k, text v FROM documents WHERE text IS NOT NULL), n AS (SELECT grp, k, count(*) n_values, avg((len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> '')) >= 4)::INT) a, avg((NOT regexp_matches(v, '[0-9]'))::INT) b FROM s GROUP BY 1, 2) SELECT grp, k, n_values FROM n WHERE n_values >= 5 AND a >= 0.5 AND b >= 0.5")
def d06_note_attributes(spark, d):
    """Remarks: texts of documents by language and source."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return P.note_attributes(docs.select(F.col("lang").alias("grp"), F.col("source").alias("k"), F.col("text").alias("v")))


@query(f"{_LONG}, dv AS (SELECT DISTINCT grp, k, v FROM lg), h AS (SELECT n.grp, n.row_ord, dv.k, dv.v FROM nm n JOIN dv ON dv.grp = n.grp AND contains(' ' || lower(n.name) || ' ', ' ' || lower(dv.v) || ' ') WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.row_ord = n.row_ord AND lg.k = dv.k)) SELECT grp, row_ord, k, min(v) v FROM h GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1")
def d07_labels_from_names(spark, d):
    return P.labels_from_names(names(spark, d).select("grp", "row_ord", "name"), long(spark, d))


@query(f"{_LONG}, bv AS (SELECT DISTINCT {_BASE} b, v FROM lg), c AS (SELECT grp, row_ord, k, {_BASE} b, 'M' || CAST(row_ord % 50 + 1 AS VARCHAR) v FROM lg WHERE k LIKE 'Size%'), en AS (SELECT k FROM lg JOIN nm USING (row_ord) GROUP BY 1 HAVING count(*) >= 10 AND avg(contains(lower(name), lower(v))::INT) >= 0.3) SELECT c.grp, c.row_ord, c.k, c.v, min(o.v) in_name FROM c JOIN en USING (k) JOIN nm ON nm.row_ord = c.row_ord JOIN bv o ON o.b = c.b AND o.v <> c.v AND contains(lower(nm.name), lower(o.v)) WHERE NOT contains(lower(nm.name), lower(c.v)) GROUP BY 1, 2, 3, 4")
def d08_name_guard(spark, d):
    rows = long(spark, d)
    cand = rows.where("k like 'Size%'").select("grp", "row_ord", "k", F.concat(F.lit("M"), (F.col("row_ord") % 50 + 1).cast("string")).alias("v"))
    named = names(spark, d).select("grp", "row_ord", "name")
    return P.name_guard(named, P.name_evidence(named, rows), cand)


@query(f"{_LONG} SELECT grp, k, count(*) n FROM lg WHERE k NOT IN ('Ngành Hàng', 'Brand of Group Home', 'Original') GROUP BY 1, 2")
def d09_merchandising_guard(spark, d):
    return P.not_merchandising(long(spark, d)).groupBy("grp", "k").agg(F.count("*").alias("n"))


_SPECS = (
    f"WITH {SPECS_CTE}, lg AS (" + " UNION ALL ".join(f"SELECT grp, row_ord, '{k}' k, {c} v FROM specs WHERE {c} IS NOT NULL" for c, k in SPEC_KEYS.items()) + "), nm AS (SELECT grp, row_ord, name FROM specs)"
)
_TAGS = "('Ngành Hàng', 'Brand of Group Home', 'Original')"
#: 100 of 100 witnesses or nearly so
_SURE = "n_dom >= 3 AND n_dom >= 0.95 * n_tot"


def _kept_by_guard(h: str) -> str:
    """Hits whose determinants are no tags and whose value the name does not speak against."""
    return f"""SELECT {h}.* FROM {h} JOIN nm USING (row_ord) WHERE sure AND d1 NOT IN {_TAGS} AND d2 NOT IN {_TAGS}
 AND NOT (target IN (SELECT k FROM en) AND NOT contains(lower(name), lower(value)) AND EXISTS (SELECT 1 FROM lg o WHERE o.k = {h}.target AND o.v <> {h}.value AND contains(lower(nm.name), lower(o.v))))"""


def _turn(r: int) -> str:
    """The r-th open cell of every row, with what the row knows by then."""
    earlier = " UNION ALL ".join(["SELECT row_ord, k, v FROM ctx0", *(f"SELECT row_ord, target, value FROM fill{i} WHERE value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ctx0 c WHERE c.row_ord = fill{i}.row_ord AND c.k = fill{i}.target)" for i in range(1, r))])
    witnesses = "SELECT p.row_ord, p.extra, t.v AS value, count(*) n FROM pb{r} p JOIN lg t ON t.k = p.target{own} JOIN lg a ON a.row_ord = t.row_ord AND a.k = p.d1 AND a.v = p.v1 JOIN lg x ON x.row_ord = t.row_ord AND x.k = p.extra AND x.v = p.ve LEFT JOIN lg b ON b.row_ord = t.row_ord AND b.k = p.d2 AND b.v = p.v2 WHERE p.d2 = '' OR b.v IS NOT NULL GROUP BY ALL"
    scopes = " UNION ALL ".join(f"SELECT row_ord, extra, {i} sc, value, n n_dom, sum(n) OVER (PARTITION BY row_ord, extra) n_tot FROM ({witnesses.format(r=r, own=own)}) QUALIFY row_number() OVER (PARTITION BY row_ord, extra ORDER BY n DESC) = 1" for i, own in enumerate([" AND t.grp = p.grp", ""]))
    return f"""ctx{r} AS MATERIALIZED ({earlier}), hv{r} AS MATERIALIZED (SELECT c.grp, c.row_ord, c.target, x.k, x.v FROM cel c JOIN ctx{r} x USING (row_ord) WHERE c.q = {r} AND x.k <> c.target),
ra{r} AS MATERIALIZED (SELECT a.row_ord, a.grp, a.target, k.value, r.d1, r.d2, a.v v1, coalesce(b.v, '') v2, n_dom, {_SURE} sure FROM hv{r} a JOIN rel r ON r.grp = a.grp AND r.target = a.target AND r.d1 = a.k LEFT JOIN hv{r} b ON b.row_ord = a.row_ord AND b.k = r.d2 JOIN keys k ON k.grp = a.grp AND k.target = a.target AND k.d1 = r.d1 AND k.d2 = r.d2 AND k.v1 = a.v AND k.v2 = coalesce(b.v, '') WHERE r.d2 = '' OR b.v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.row_ord ORDER BY {_SURE} DESC, rank) = 1),
rb{r} AS MATERIALIZED ({_kept_by_guard(f"ra{r}")}),
ia{r} AS MATERIALIZED (SELECT a.row_ord, a.grp, a.target, s.value, a.k d1, '' d2, a.v v1, '' v2, n_dom, true sure FROM hv{r} a JOIN sgl s ON s.grp = a.grp AND s.target = a.target AND s.d1 = a.k AND s.v1 = a.v WHERE {_SURE} AND a.row_ord NOT IN (SELECT row_ord FROM rb{r}) QUALIFY row_number() OVER (PARTITION BY a.row_ord ORDER BY n_dom DESC, a.k) = 1),
ht{r} AS MATERIALIZED (SELECT *, 'RELATION' tier FROM rb{r} UNION ALL SELECT *, 'INDEX' FROM ({_kept_by_guard(f"ia{r}")})),
pb{r} AS MATERIALIZED (SELECT h.row_ord, h.grp, h.target, h.value AS old, h.d1, h.d2, h.v1, h.v2, x.k extra, x.v ve FROM ht{r} h JOIN hv{r} x USING (row_ord) WHERE x.k NOT IN {_TAGS} AND x.k <> h.d1 AND x.k <> h.d2),
sc{r} AS MATERIALIZED (SELECT s.row_ord, p.grp, p.target, p.old, s.value, s.extra, s.sc, s.n_dom FROM ({scopes}) s JOIN pb{r} p ON p.row_ord = s.row_ord AND p.extra = s.extra WHERE {_SURE} AND s.value <> p.old QUALIFY row_number() OVER (PARTITION BY s.row_ord ORDER BY sc, s.n_dom DESC, s.extra) = 1),
fill{r} AS MATERIALIZED (SELECT c.grp, c.row_ord, c.target, coalesce(s.value, h.value) AS value, CASE WHEN s.value IS NOT NULL THEN 'REFINED' ELSE h.tier END tier, CASE WHEN h.d1 IS NOT NULL THEN concat_ws('+', h.d1, nullif(h.d2, ''), s.extra) END det, coalesce(s.n_dom, h.n_dom) n_dom FROM cel c LEFT JOIN ht{r} h USING (row_ord) LEFT JOIN sc{r} s USING (row_ord) WHERE c.q = {r})"""


_CASCADE = f"""{_SPECS}, {_POOL}, {_KEYS}, {_REL}, {_OPEN},
nts AS (SELECT k FROM (SELECT DISTINCT k, v FROM lg) GROUP BY 1 HAVING count(*) >= 5 AND avg((len(string_split(v, ' ')) >= 4)::INT) >= 0.5 AND avg((NOT regexp_matches(v, '[0-9]'))::INT) >= 0.5),
en AS (SELECT k FROM lg JOIN nm USING (row_ord) GROUP BY 1 HAVING count(*) >= 10 AND avg(contains(lower(name), lower(v))::INT) >= 0.3),
lab AS (SELECT row_ord, k, min(v) v FROM (SELECT n.row_ord, d.k, d.v FROM nm n JOIN (SELECT DISTINCT grp, k, v FROM lg) d ON d.grp = n.grp AND contains(' ' || lower(n.name) || ' ', ' ' || lower(d.v) || ' ') WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.row_ord = n.row_ord AND lg.k = d.k)) GROUP BY 1, 2 HAVING count(DISTINCT v) = 1),
sgl AS MATERIALIZED (SELECT grp, d1, v1, target, value, n n_dom, n_tot FROM (SELECT *, sum(n) OVER (PARTITION BY grp, d1, v1, target) n_tot, row_number() OVER (PARTITION BY grp, d1, v1, target ORDER BY n DESC, f) rn FROM (SELECT a.grp, a.k d1, a.v v1, t.k target, t.v AS value, count(*) n, min(a.row_ord) f FROM lg a JOIN lg t USING (row_ord) WHERE a.k <> t.k GROUP BY ALL)) WHERE rn = 1),
cel AS MATERIALIZED (SELECT grp, row_ord, target, row_number() OVER (PARTITION BY row_ord ORDER BY target) q FROM opn WHERE target NOT IN (SELECT k FROM nts)), ctx0 AS MATERIALIZED (SELECT row_ord, k, v FROM lg UNION ALL SELECT row_ord, k, v FROM lab),
{", ".join(_turn(r) for r in range(1, len(SPEC_KEYS)))},
found AS MATERIALIZED (SELECT grp, row_ord, target, value, coalesce(tier, CASE WHEN target IN {_TAGS} THEN 'TAG' ELSE 'ASK' END) tier, det, n_dom FROM ({" UNION ALL ".join(f"SELECT * FROM fill{r}" for r in range(1, len(SPEC_KEYS)))}) UNION ALL SELECT grp, row_ord, target, NULL, 'NOTE', NULL, NULL FROM opn WHERE target IN (SELECT k FROM nts))"""
_BRIDGE = f"""{_CASCADE}, {", ".join(f"cx{r} AS (SELECT h.row_ord, h.target, r.rank, r.d1 || '=' || h.v || CASE WHEN r.d2 <> '' THEN '; ' || r.d2 || '=' || b.v ELSE '' END context FROM hv{r} h JOIN rel r ON r.grp = h.grp AND r.target = h.target AND r.d1 = h.k LEFT JOIN hv{r} b ON b.row_ord = h.row_ord AND b.k = r.d2 WHERE r.d2 = '' OR b.v IS NOT NULL)" for r in range(1, len(SPEC_KEYS)))},
cxs AS (SELECT row_ord, target, arg_min(context, rank) context FROM ({" UNION ALL ".join(f"SELECT * FROM cx{r}" for r in range(1, len(SPEC_KEYS)))}) GROUP BY 1, 2),
bridge AS MATERIALIZED (SELECT substr(sha1(f.grp || '|' || f.target || '|' || coalesce(c.context, 'name=' || n.name)), 1, 16) key_hash, f.grp, f.target, coalesce(c.context, 'name=' || n.name) context, f.row_ord FROM found f JOIN nm n USING (row_ord) LEFT JOIN cxs c ON c.row_ord = f.row_ord AND c.target = f.target WHERE f.tier = 'ASK')"""


def spec_cells(spark, d):
    """Attributes of ``specs`` (grp, row_ord, k, v), and the names."""
    rows = specs(spark, d)
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for c, k in SPEC_KEYS.items()))).alias("p")
    return once(spark, d, "spec_cells", lambda: kept(rows.select("grp", "row_ord", cells).select("grp", "row_ord", "p.k", "p.v").where("v is not null"))), rows.select("grp", "row_ord", "name")


def cascade(spark, d):
    """(found, context, relations) over all open cells of ``specs``."""

    def build():
        rows, named = spec_cells(spark, d)
        pool = kept(P.attribute_pool(rows))
        keys = kept(P.dependency_keys(rows, pool))
        relations = kept(P.mine_dependencies(rows, pool, keys))
        cells = named.select("grp", "row_ord").join(pool.select("grp", F.col("k").alias("target")), "grp").join(by_merge(rows.select("row_ord", F.col("k").alias("target"))), ["row_ord", "target"], "left_anti")
        cells = cells.withColumn("pos", F.row_number().over(W.partitionBy("row_ord").orderBy("target")))
        found, context = K.fill_cascade(cells, rows, P.labels_from_names(named, rows), named, relations, keys)
        return found, context, relations

    return once(spark, d, "cascade", build)


def bridge(spark, d):
    found, context, relations = cascade(spark, d)
    return once(spark, d, "bridge", lambda: kept(K.question_rows(found, context, relations, spec_cells(spark, d)[1])))


@query(f"{_CASCADE}, s AS ({' UNION ALL '.join(f'SELECT grp, row_ord, target, old, value, extra, sc, n_dom FROM sc{r}' for r in range(1, len(SPEC_KEYS)))}) SELECT grp, row_ord, target, old, value, extra, CASE sc WHEN 0 THEN 'group' ELSE 'pooled' END AS scope, n_dom FROM s")
def d05_refine_lookup(spark, d):
    """Sharper keys that change an answer, with what each row knows when the cell's turn comes."""
    found, context, relations = cascade(spark, d)
    rows, named = spec_cells(spark, d)
    cells = found.where("tier <> 'NOTE'").select("grp", "row_ord", "target", "pos")
    return K.sharper_answers(cells, context, rows, named, relations, P.dependency_keys(rows, P.attribute_pool(rows)))


@query(f"{_CASCADE} SELECT * FROM found")
def d10_fill_cascade(spark, d):
    """Relation, index and sharper key in turn, fills feeding later cells, else a question."""
    return cascade(spark, d)[0].drop("pos")


@query(f"{_BRIDGE} SELECT key_hash, row_ord FROM bridge")
def d11_question_rows(spark, d):
    return bridge(spark, d).select("key_hash", "row_ord")


@query(f"{_BRIDGE} SELECT key_hash, grp, target, context, count(*) n_rows, min(row_ord) first_ord FROM bridge GROUP BY ALL")
def d11_cascade_questions(spark, d):
    return K.questions(bridge(spark, d))


def _asks(spark, d):
    rows, _, _, relations, opened = mined(spark, d)
    return P.asks(opened, rows, relations, names(spark, d).select("grp", "row_ord", "name"))


@query(f"{_B}, {_OPEN}, {_HAVE}, {_ASK} SELECT * FROM ask")
def d11_questions(spark, d):
    return _asks(spark, d)


@query(f"{_LONG}, {_VOC} SELECT * FROM voc")
def d12_vocabulary(spark, d):
    return P.vocabulary(long(spark, d))


@query(f"{_LONG}, {_VOC}, r AS (SELECT dv.*, kind, row_number() OVER (PARTITION BY grp, k ORDER BY v) rn FROM dv JOIN voc USING (grp, k)) SELECT grp, k, kind, array_to_string(list_sort(list(v)), ';') AS values FROM r WHERE kind = 'enum' OR rn <= 10 GROUP BY 1, 2, 3")
def d12_vocabulary_values(spark, d):
    rows = long(spark, d)
    return P.vocabulary_values(rows, P.vocabulary(rows)).withColumn("values", F.array_join("values", ";"))


#: questions of which every third is about an attribute that its group has no value of
_VQ = "vq AS (SELECT key_hash, CASE WHEN first_ord % 3 = 0 THEN 'no group' ELSE grp END grp, target FROM ask)"


@query(f"""{_B}, {_OPEN}, {_HAVE}, {_ASK}, {_VQ}, {_VOC}, vo AS (SELECT grp, k, any_value(kind) kind, array_to_string(list_sort(list(v)), ';') vs FROM (SELECT dv.*, kind, row_number() OVER (PARTITION BY grp, k ORDER BY v) rn FROM dv JOIN voc USING (grp, k)) WHERE kind = 'enum' OR rn <= 10 GROUP BY 1, 2),
da AS (SELECT DISTINCT k, v FROM lg), va AS (SELECT k, CASE WHEN avg(({_ISM})::INT) < 0.8 AND count(*) <= 40 THEN 'enum' ELSE 'format' END kind FROM da GROUP BY 1), vw AS (SELECT k, any_value(kind) kind, array_to_string(list_sort(list(v)), ';') vs FROM (SELECT da.*, kind, row_number() OVER (PARTITION BY k ORDER BY v) rn FROM da JOIN va USING (k)) WHERE kind = 'enum' OR rn <= 10 GROUP BY 1)
SELECT key_hash, coalesce(o.kind, w.kind) kind, coalesce(o.vs, w.vs) AS values, CASE WHEN o.k IS NOT NULL THEN 'group' ELSE 'attribute' END AS scope FROM vq q LEFT JOIN vo o ON o.grp = q.grp AND o.k = q.target LEFT JOIN vw w ON w.k = q.target WHERE coalesce(o.kind, w.kind) IS NOT NULL""")
def d12_question_vocabulary(spark, d):
    q = _asks(spark, d).withColumn("grp", F.when(F.col("first_ord") % 3 == 0, "no group").otherwise(F.col("grp")))
    return P.vocabulary_for(q, long(spark, d)).withColumn("values", F.array_join("values", ";"))


@query(rf"{_B}, {_OPEN}, {_HAVE}, {_ASK} SELECT key_hash, first_ord FROM ask WHERE EXISTS (SELECT 1 FROM lg WHERE lg.row_ord = ask.first_ord AND lg.k LIKE 'Standard Of %' AND lg.v IN ('DIN 900', 'DIN 902', 'DIN 903'))")
def d13_with_standard(spark, d):
    standards = spark.createDataFrame([("din-900",), ("DIN  902",), ("din 903",)], "standard string")
    return P.with_standard(_asks(spark, d), long(spark, d), standards).select("key_hash", "first_ord")


@query(f"{_B}, {_OPEN}, {_HAVE}, {_ASK} SELECT key_hash, n_rows FROM ask WHERE substr(key_hash, 1, 1) NOT IN ('0', '1', '2', '3', '4', '5', '6')")
def d13_open_questions(spark, d):
    q = _asks(spark, d)
    c = F.substring("key_hash", 1, 1)
    answers = q.where(c <= "9").select("key_hash", F.when(c <= "6", "7 mm").otherwise(" ").alias("value"))
    return P.open_asks(q, answers, retry_empty=True).select("key_hash", "n_rows")


@query(f"{_B}, {_OPEN}, {_HAVE}, {_ASK}, b AS (SELECT key_hash, grp, target, CAST((row_number() OVER (PARTITION BY grp ORDER BY target, first_ord, key_hash) - 1) // 25 AS INT) batch FROM ask) SELECT *, count(*) OVER (PARTITION BY grp, batch) n_batch FROM b")
def d14_ask_batches(spark, d):
    return P.ask_batches(_asks(spark, d))


_ANS = "ans AS (SELECT *, CASE substr(key_hash,1,1) WHEN '0' THEN '' WHEN '1' THEN 'blue' WHEN '2' THEN '7 mm' WHEN '3' THEN 'DIN 901' ELSE 'M' || CAST(first_ord % 60 AS VARCHAR) END AS value FROM ask)"


def _answers(q: DataFrame) -> DataFrame:
    c = F.substring("key_hash", 1, 1)
    v = F.when(c == "0", "").when(c == "1", "blue").when(c == "2", "7 mm").when(c == "3", "DIN 901").otherwise(F.concat(F.lit("M"), (F.col("first_ord") % 60).cast("string")))
    return q.select("key_hash", v.alias("value"))


@query(f"""{_B}, {_OPEN}, {_HAVE}, {_ASK}, {_ANS}, {_VOC}, r AS (SELECT dv.*, kind, row_number() OVER (PARTITION BY grp, k ORDER BY v) rn FROM dv JOIN voc USING (grp, k)), vv AS (SELECT grp, k, any_value(kind) kind, list(v) vs FROM r WHERE kind = 'enum' OR rn <= 10 GROUP BY 1, 2)
SELECT key_hash, a.grp, target, value, n_rows, CASE WHEN value = '' THEN 'EMPTY' WHEN kind IS NULL THEN 'NO_VOCAB' WHEN kind = 'enum' THEN CASE WHEN list_contains(vs, value) THEN 'OK' ELSE 'NOT_IN_VOCAB' END WHEN list_contains(list_transform(vs, lambda x: regexp_replace(x, '[0-9.,]+', '#', 'g')), regexp_replace(value, '[0-9.,]+', '#', 'g')) THEN 'OK' ELSE 'BAD_FORMAT' END status FROM ans a LEFT JOIN vv ON vv.grp = a.grp AND vv.k = a.target""")
def d15_validation_report(spark, d):
    q, rows = _asks(spark, d), long(spark, d)
    return P.validation_report(q, _answers(q), P.vocabulary_values(rows, P.vocabulary(rows)))


_ISA = rf"({_ISM} OR regexp_matches(v, '^\s*[A-Za-z]{{1,2}}\s?-?[0-9]+(?:[.,][0-9]+)?\s*$'))"
_CV = "grp, sk, sv, xk, yk"
#: the lattice: whole groups and slices, every axis and target, pairs of points listed
_LAT = f"""{_LONG}, m AS (SELECT g.grp, f.row_ord, f.k, f.v, f.pos, CASE WHEN {_ISM} THEN {_NUMX} END mv, CASE WHEN {_ISA} THEN {_NUMX} END av FROM (SELECT row_ord, k, arg_min(v, pos) v, min(pos) pos FROM long GROUP BY 1, 2) f JOIN grouped g USING (row_ord) WHERE g.grp IS NOT NULL),
fewv AS (SELECT grp, k FROM m GROUP BY 1, 2 HAVING count(DISTINCT v) BETWEEN 2 AND 30), sl0 AS (SELECT grp, row_ord, k sk, v sv FROM m JOIN fewv USING (grp, k) WHERE mv IS NULL),
sl AS (SELECT grp, row_ord, sk, sv FROM sl0 JOIN (SELECT grp, sk, sv FROM sl0 GROUP BY 1, 2, 3 HAVING count(*) >= 6) USING (grp, sk, sv) UNION ALL SELECT DISTINCT grp, row_ord, '', '' FROM m),
pts AS (SELECT DISTINCT s.grp, s.sk, s.sv, a.k xk, t.k yk, a.av x, t.mv y FROM sl s JOIN m a USING (row_ord) JOIN m t USING (row_ord) WHERE a.av IS NOT NULL AND t.mv IS NOT NULL AND a.k <> t.k AND t.k <> s.sk),
np AS (SELECT {_CV}, count(*) n_points FROM pts GROUP BY ALL), pr AS (SELECT {", ".join("a." + c for c in _CV.split(", "))}, count(*) n_pairs, count(*) FILTER (a.y <= b.y) n_up FROM pts a JOIN pts b USING ({_CV}) WHERE a.x < b.x GROUP BY ALL),
cur AS (SELECT *, CASE WHEN n_up / n_pairs::DOUBLE >= 0.95 THEN 'up' ELSE 'down' END direction, round_even((CASE WHEN n_up / n_pairs::DOUBLE >= 0.95 THEN n_up / n_pairs::DOUBLE ELSE 1 - n_up / n_pairs::DOUBLE END)::DECIMAL(18,9), 3)::DOUBLE mono FROM np JOIN pr USING ({_CV}) WHERE n_points >= 6 AND n_pairs >= 6 AND (n_up / n_pairs::DOUBLE >= 0.95 OR n_up / n_pairs::DOUBLE <= 1 - 0.95))"""
#: answers to check: one for each row that knows its size, whether or not it has the target
_ANSV = """vals AS (SELECT grp, row_ord, replace(k, 'Size Of', 'Key Of') k, CASE WHEN row_ord % 7 = 0 THEN 'blue' ELSE CAST(2 * CAST(av AS INT) + 1 + CASE WHEN row_ord % 5 = 0 THEN 30 ELSE 0 END AS VARCHAR) || ' mm' END AS value FROM m WHERE k LIKE 'Size Of %')"""
_BR = f"""{_ANSV}, cd AS (SELECT v.row_ord, v.value, c.*, a.av x, coalesce(s.pos, -1) sp, a.pos xp FROM vals v JOIN cur c ON c.grp = v.grp AND c.yk = v.k JOIN m a ON a.row_ord = v.row_ord AND a.k = c.xk AND a.av IS NOT NULL LEFT JOIN m s ON s.row_ord = v.row_ord AND s.k = c.sk AND s.v = c.sv AND s.mv IS NULL WHERE c.sk = '' OR s.k IS NOT NULL),
ax AS (SELECT DISTINCT {_CV}, direction, x FROM cd), bk AS (SELECT a.grp, a.sk, a.sv, a.xk, a.yk, a.x, min(p.y) FILTER (p.x = a.x) e0, max(p.y) FILTER (p.x = a.x) e1, CASE WHEN direction = 'up' THEN max(p.y) FILTER (p.x < a.x) ELSE min(p.y) FILTER (p.x < a.x) END lo_y, CASE WHEN direction = 'up' THEN min(p.y) FILTER (p.x > a.x) ELSE max(p.y) FILTER (p.x > a.x) END hi_y FROM ax a JOIN pts p USING ({_CV}) GROUP BY a.grp, a.sk, a.sv, a.xk, a.yk, a.x, direction),
br AS (SELECT {_CV}, x, coalesce(e0, least(lo_y, hi_y)) lo, coalesce(e1, greatest(lo_y, hi_y)) hi, CASE WHEN e0 IS NOT NULL THEN 'exact' ELSE 'interp' END kind FROM bk WHERE e0 IS NOT NULL OR lo_y IS NOT NULL AND hi_y IS NOT NULL)"""
_VER = """top AS (SELECT * FROM cd JOIN br USING (grp, sk, sv, xk, yk, x) QUALIFY row_number() OVER (PARTITION BY row_ord, yk ORDER BY sk <> '' DESC, mono DESC, n_points DESC, sp, xp) = 1),
ver AS (SELECT v.grp, v.row_ord, v.k, v.value, sk seg_k, sv seg_v, xk x_k, x, lo, hi, kind, mono, n_points, CASE WHEN v.value = 'blue' THEN 'NOT_NUMERIC' WHEN lo IS NULL THEN 'NO_REFERENCE' WHEN TRY_CAST(replace(v.value, ' mm', '') AS DOUBLE) BETWEEN lo - 0.02 * greatest(abs(lo), abs(hi)) AND hi + 0.02 * greatest(abs(lo), abs(hi)) THEN 'PLAUSIBLE' WHEN sk = '' THEN 'DISAGREE_UNSEGMENTED' ELSE 'OUT_OF_RANGE' END status FROM vals v LEFT JOIN top ON top.row_ord = v.row_ord AND top.yk = v.k)"""


def _known(spark, d):
    """Cells of rows that have a group, with their place in the row."""
    cells = A.pairs(QA.prepared(spark, d)).groupBy("row_ord", "k").agg(F.min_by("v", "pos").alias("v"), F.min("pos").alias("pos"))
    return once(spark, d, "known", lambda: kept(cells.join(QA.grouped(spark, d).select("row_ord", "grp"), "row_ord").where("grp is not null")))


def _ratios(spark, d):
    """Points of every curve of the lattice, and their ratios."""
    cells = _known(spark, d)

    def build():
        pts = kept(C.curve_points(cells, cells.select("grp", "k")))
        return pts, kept(C.monotone_ratio(pts))

    return once(spark, d, "ratios", build)


def _values(spark, d):
    """Answers to check: one for each row that knows its size."""
    cells, n = _known(spark, d).where("k like 'Size Of %'"), F.col("row_ord")
    y = 2 * X.axis(F.col("v")).cast("int") + 1 + F.when(n % 5 == 0, 30).otherwise(0)
    return cells.select("grp", "row_ord", F.replace("k", F.lit("Size Of"), F.lit("Key Of")).alias("k"), F.when(n % 7 == 0, "blue").otherwise(F.concat(y.cast("string"), F.lit(" mm"))).alias("value"))


_NAMED = "grp, sk seg_k, sv seg_v, xk x_k, yk y_k"


@query(f"{_LAT} SELECT {_NAMED}, n_points, n_pairs, n_up, round_even((n_up / n_pairs::DOUBLE)::DECIMAL(18,9), 6)::DOUBLE ratio FROM np JOIN pr USING ({_CV})")
def e01_monotone_ratio(spark, d):
    return _ratios(spark, d)[1]


@query(f"{_LAT} SELECT {_NAMED}, direction, mono, n_points FROM cur")
def e02_curves(spark, d):
    return C.curves(_ratios(spark, d)[1])


@query(f"{_LAT}, {_BR} SELECT {_NAMED}, x, lo, hi, kind FROM br")
def e03_brackets(spark, d):
    pts, ratios = _ratios(spark, d)
    found = C.curves(ratios)
    return C.brackets(C.candidates(_values(spark, d), _known(spark, d), found), pts, found)


@query(f"{_LAT}, {_BR}, {_VER} SELECT * FROM ver")
def e04_verify_values(spark, d):
    cells = _known(spark, d)
    return C.verify_cells(_values(spark, d), cells, cells)


_ITEMS = "it AS (SELECT row_ord id, row_ord, k, mv y FROM (SELECT row_ord, k, CASE WHEN row_ord % 97 = 1 THEN mv + 25 ELSE mv END mv FROM m WHERE k LIKE 'Key Of %'))"
_CHOICE = f"""{_ITEMS}, ak AS (SELECT it.row_ord, it.k target, o.k, o.av FROM it JOIN m o ON o.row_ord = it.row_ord AND o.k <> it.k), us AS (SELECT target, k axis, count(*) usable FROM ak WHERE av IS NOT NULL GROUP BY 1, 2), lb AS (SELECT DISTINCT target, k label FROM ak WHERE av IS NULL UNION ALL SELECT DISTINCT target, '' FROM ak),
rr AS (SELECT t.k target, us.axis, lb.label, CASE WHEN lb.label = '' THEN '' ELSE l.v END lv, a.av x, t.mv y FROM m t JOIN us ON us.target = t.k JOIN m a ON a.row_ord = t.row_ord AND a.k = us.axis AND a.av IS NOT NULL JOIN lb ON lb.target = t.k LEFT JOIN m l ON l.row_ord = t.row_ord AND l.k = lb.label WHERE t.mv IS NOT NULL AND (lb.label = '' OR l.v IS NOT NULL)),
kk AS (SELECT target, axis, label, lv, x, sum(n) n, max(n) most FROM (SELECT target, axis, label, lv, x, y, count(*) n FROM rr GROUP BY ALL) GROUP BY ALL), cc AS (SELECT target, axis, label, CAST(sum(n) AS BIGINT) total, count(*) n_keys, sum(most) / sum(n)::DOUBLE purity FROM kk GROUP BY ALL HAVING sum(n) >= 6 AND count(*) >= 2 AND sum(most) / sum(n)::DOUBLE >= 0.9),
ch AS (SELECT target k, axis, label, usable, total, n_keys, purity FROM cc JOIN us USING (target, axis) QUALIFY row_number() OVER (PARTITION BY target ORDER BY usable DESC, purity DESC, total DESC, axis, label) = 1)"""


@query(f"{_LAT}, {_CHOICE} SELECT k, axis, label, usable, total, n_keys, round_even(purity::DECIMAL(18,9), 6)::DOUBLE purity FROM ch")
def e05_axis_choice(spark, d):
    cells = _known(spark, d)
    return C.axis_label_choice(_items(spark, d), cells, cells)


def _items(spark, d):
    """Target cells as answers, a few of them changed."""
    y, n = X.measure(F.col("v")), F.col("row_ord")
    return _known(spark, d).where("k like 'Key Of %'").select(n.alias("id"), "row_ord", "k", F.when(n % 97 == 1, (y + 25).cast("string")).otherwise(F.col("v")).alias("value"))


@query(f"""{_LAT}, {_CHOICE}, cp AS (SELECT DISTINCT t.k, a.av x, t.mv y FROM ch JOIN m t ON t.k = ch.k AND t.mv IS NOT NULL JOIN m a ON a.row_ord = t.row_ord AND a.k = ch.axis AND a.av IS NOT NULL), cq AS (SELECT a.k, count(*) n, avg((a.y <= b.y)::INT) r FROM cp a JOIN cp b ON a.k = b.k AND a.x < b.x GROUP BY 1), cs AS (SELECT k, r FROM cq JOIN (SELECT k, count(*) np FROM cp GROUP BY 1) USING (k) WHERE np >= 6 AND n >= 6),
pt AS (SELECT it.id, it.k, a.av x, it.y, coalesce(l.v, '') lv FROM it JOIN ch USING (k) JOIN m a ON a.row_ord = it.row_ord AND a.k = ch.axis AND a.av IS NOT NULL LEFT JOIN m l ON l.row_ord = it.row_ord AND l.k = ch.label WHERE it.y IS NOT NULL AND it.k IN (SELECT k FROM it GROUP BY 1 HAVING count(*) > 1)),
h AS (SELECT a.k, a.id i, b.id j, CASE WHEN a.x = b.x THEN CASE WHEN a.y <> b.y THEN 'SAME_X' END WHEN r >= 0.95 AND a.y >= b.y OR r <= 1 - 0.95 AND a.y <= b.y THEN 'ORDER' END reason FROM pt a JOIN pt b ON a.k = b.k AND a.lv = b.lv AND a.x <= b.x LEFT JOIN cs ON cs.k = a.k)
SELECT DISTINCT id, k, reason FROM (SELECT i id, k, reason FROM h UNION ALL SELECT j, k, reason FROM h) WHERE reason IS NOT NULL""")
def e06_cross_check(spark, d):
    cells = _known(spark, d)
    return C.cross_check(_items(spark, d), cells, cells)


#: stand-in answers of two judges to the questions that the cascade leaves
_JA = f"""{_BRIDGE}, ask AS (SELECT key_hash, grp, target, min(row_ord) first_ord FROM bridge GROUP BY 1, 2, 3), ja AS (SELECT key_hash, j.judge, CASE WHEN substr(key_hash,1,1) = '0' THEN '' WHEN j.judge = 'b' AND substr(key_hash,1,1) = '1' THEN 'other' WHEN target = 'Finish' THEN CASE WHEN substr(key_hash,2,1) < '8' THEN 'Zinc' ELSE 'Nickel' END ELSE 'T' || CAST(first_ord % 60 AS VARCHAR) END AS value, (75 + first_ord % 20) / 100.0::DOUBLE + CASE WHEN j.judge = 'b' THEN 0.05 ELSE 0 END confidence FROM ask CROSS JOIN (VALUES ('a'),('b')) j(judge)),
mj AS (SELECT key_hash, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, min(confidence) confidence, count(DISTINCT value) > 1 disagree FROM ja GROUP BY 1),
nc AS (SELECT DISTINCT key_hash FROM bridge JOIN mj USING (key_hash) JOIN nm USING (row_ord) WHERE target IN (SELECT k FROM en) AND NOT contains(lower(name), lower(mj.value)) AND EXISTS (SELECT 1 FROM lg o WHERE o.k = target AND o.v <> mj.value AND contains(lower(nm.name), lower(o.v)))),
gt AS (SELECT key_hash, value, confidence, CASE WHEN disagree THEN 'JUDGES_DISAGREE' WHEN trim(coalesce(value,'')) = '' THEN 'BLANK' WHEN confidence < 0.8 THEN 'LOW_CONFIDENCE' WHEN substr(key_hash,3,1) = '0' THEN 'SELF_CONTRADICTION' WHEN key_hash IN (SELECT key_hash FROM nc) THEN 'NAME_CONTRADICTS' WHEN substr(key_hash,3,1) < '4' THEN 'REVIEW_OUT_OF_RANGE' END reason FROM mj)"""


def _judged_answers(spark, d):
    q = K.questions(bridge(spark, d))
    c = F.substring("key_hash", 1, 1)
    both = q.withColumn("judge", F.explode(F.array(F.lit("a"), F.lit("b"))))
    finish = F.when(F.substring("key_hash", 2, 1) < "8", "Zinc").otherwise("Nickel")
    value = F.when(c == "0", "").when((F.col("judge") == "b") & (c == "1"), "other").when(F.col("target") == "Finish", finish).otherwise(F.concat(F.lit("T"), (F.col("first_ord") % 60).cast("string")))
    return both.select("key_hash", "judge", value.alias("value"), ((75 + F.col("first_ord") % 20) / 100.0 + F.when(F.col("judge") == "b", 0.05).otherwise(0.0)).alias("confidence"))


def _gated(spark, d):
    rows, named = spec_cells(spark, d)
    m = kept(V.merge_judges(_judged_answers(spark, d)))
    third = F.substring("key_hash", 3, 1)
    return V.answer_gates(m, m.where(third == "0"), K.name_contradictions(bridge(spark, d), m, named, rows), m.where(third < "4"))


@query(f"{_JA} SELECT key_hash, value, round(confidence, 6) confidence, disagree FROM mj")
def e07_merge_judges(spark, d):
    return V.merge_judges(_judged_answers(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(f"""{_JA}, f AS (SELECT row_ord, grp, target k, value, 'corpus' source FROM found WHERE value IS NOT NULL UNION ALL SELECT b.row_ord, b.grp, b.target, g.value, 'model' FROM bridge b JOIN gt g USING (key_hash) WHERE g.reason IS NULL OR g.reason = 'REVIEW_OUT_OF_RANGE' UNION ALL SELECT row_ord, grp, target, 'by rule', 'rule' FROM opn WHERE row_ord % 5 = 0
 UNION ALL SELECT row_ord, grp, k, 'overwrite', 'rule' FROM lg WHERE row_ord % 50 = 1 UNION ALL SELECT row_ord, grp, 'Unknown Key', 'x', 'rule' FROM nm WHERE row_ord % 50 = 2) SELECT row_ord, grp, k, value, source FROM f WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.row_ord = f.row_ord AND lg.k = f.k) AND EXISTS (SELECT 1 FROM lg l2 WHERE l2.grp = f.grp AND l2.k = f.k) QUALIFY row_number() OVER (PARTITION BY row_ord, k ORDER BY CASE source WHEN 'rule' THEN 1 WHEN 'corpus' THEN 2 ELSE 3 END, value) = 1""")
def e08_merge_sources(spark, d):
    """Fills by rule, from the cascade, and from accepted answers brought back to their rows."""
    rows, named = spec_cells(spark, d)
    found = cascade(spark, d)[0]
    fills = found.where("value is not null").select("row_ord", "grp", F.col("target").alias("k"), "value", F.lit("corpus").alias("source"))
    fills = fills.unionByName(K.answered_cells(bridge(spark, d), _gated(spark, d)).select("row_ord", "grp", "k", "value", "source"))
    rule = F.lit("rule").alias("source")
    fills = fills.unionByName(found.where("row_ord % 5 = 0").select("row_ord", "grp", F.col("target").alias("k"), F.lit("by rule").alias("value"), rule))
    fills = fills.unionByName(rows.where("row_ord % 50 = 1").select("row_ord", "grp", "k", F.lit("overwrite").alias("value"), rule))
    fills = fills.unionByName(named.where("row_ord % 50 = 2").select("row_ord", "grp", F.lit("Unknown Key").alias("k"), F.lit("x").alias("value"), rule))
    return V.merge_sources(fills, rows, rows)


@query(f"{_JA} SELECT key_hash, value, round(confidence, 6) confidence, reason FROM gt")
def e09_answer_gates(spark, d):
    return _gated(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(f"{_JA} SELECT b.grp, b.row_ord, b.target k, g.value, 'model' source FROM bridge b JOIN gt g USING (key_hash) WHERE g.reason IS NULL OR g.reason = 'REVIEW_OUT_OF_RANGE'")
def e09_answered_cells(spark, d):
    return K.answered_cells(bridge(spark, d), _gated(spark, d))


@query(f"{QA.M}, {QA.CONTRA} SELECT f.row_ord, CASE WHEN EXISTS (SELECT 1 FROM missing m WHERE m.row_ord = f.row_ord AND m.action='LOOKUP') OR EXISTS (SELECT 1 FROM contra c WHERE c.row_ord = f.row_ord) THEN 'REVIEW' ELSE 'HIGH' END confidence FROM flags f")
def e10_row_confidence(spark, d):
    rows, gaps = catalog(spark, d), QA.missing(spark, d)
    bad = gaps.where("action = 'LOOKUP'").select("row_ord").union(A.contradictions(rows, QA.assigned(spark, d), QA.schema(spark, d)).select("row_ord"))
    return V.row_confidence(rows, gaps.where("action = 'FILLED'").withColumn("source", F.lit("rule")), bad)


@query(f"""WITH {QA.CATALOG_CTE}, {QA.PAIRS}, o AS (SELECT * REPLACE (CASE WHEN row_ord % 223 = 9 THEN description || '!' ELSE description END AS description) FROM catalog WHERE row_ord % 211 <> 7), b AS (SELECT c.row_ord a, o.row_ord b, c.description IS DISTINCT FROM o.description df FROM catalog c FULL JOIN o USING (row_ord))
SELECT 'row_count' check_name, count(*) failed FROM b WHERE a IS NULL OR b IS NULL UNION ALL SELECT 'original_columns', count(*) FROM b WHERE a IS NOT NULL AND b IS NOT NULL AND df UNION ALL SELECT 'identical_pairs', (SELECT count(*) FROM (SELECT row_ord, k, v FROM long GROUP BY 1, 2, 3 HAVING count(*) > 1))""")
def e11_output_checks(spark, d):
    """An output that lost some rows and edited others."""
    rows = catalog(spark, d)
    out = rows.join(A.proposals(rows, QA.missing(spark, d)), "row_ord", "left").where("row_ord % 211 <> 7")
    out = out.withColumn("description", F.when(F.col("row_ord") % 223 == 9, F.concat("description", F.lit("!"))).otherwise(F.col("description")))
    return V.output_checks(rows, out, ["part_id", "part_number", "description", "leaf_name", "filters"], A.pairs(rows))


@query(f"""{_LAT}, px AS (SELECT DISTINCT grp, xk, yk, x, y FROM pts WHERE sk = ''), vx AS (SELECT grp, row_ord, k, av + CASE WHEN row_ord % 2 = 0 THEN 0.5 ELSE 0 END x FROM m WHERE k LIKE 'Size Of %')
SELECT grp, row_ord, rank, x, y, dist FROM (SELECT v.grp, v.row_ord, p.x, p.y, abs(p.x - v.x) dist, row_number() OVER (PARTITION BY v.grp, v.row_ord ORDER BY abs(p.x - v.x), p.x, p.y) rank FROM vx v JOIN px p ON p.grp = v.grp AND p.xk = v.k AND p.yk = replace(v.k, 'Size Of', 'Key Of')) WHERE rank <= 3""")
def e12_neighbours(spark, d):
    base, half = long(spark, d), F.when(F.col("row_ord") % 2 == 0, 0.5).otherwise(0.0)
    values = base.where("k like 'Size Of %'").select("grp", "row_ord", (X.axis(F.col("v")) + half).alias("x"))
    return V.neighbours(values, V.points(base, "Size", "Key"))


@query(f"{_B}, {_OPEN}, {_HAVE}, {_ASK}, e AS (SELECT key_hash, grp, n_rows, substr(key_hash,1,1) < '8' has_reference, substr(key_hash,2,1) < '8' has_neighbours, substr(key_hash,3,1) < '8' has_standard FROM ask), g AS (SELECT *, (NOT has_reference)::INT + (NOT has_neighbours)::INT + (NOT has_standard)::INT difficulty FROM e) SELECT *, row_number() OVER (PARTITION BY grp ORDER BY difficulty DESC, n_rows DESC, key_hash) rank FROM g")
def e13_review_order(spark, d):
    at = lambda i: F.substring("key_hash", i, 1) < "8"
    return V.review_order(_asks(spark, d).select("key_hash", "grp", "n_rows", at(1).alias("has_reference"), at(2).alias("has_neighbours"), at(3).alias("has_standard")))


@query(f"{_LONG} SELECT row_ord, v standard, v IN ('DIN 900', 'DIN 902', 'DIN 903') available FROM lg WHERE k LIKE 'Standard Of %'")
def e14_standards(spark, d):
    standards = spark.createDataFrame([("DIN 900",), ("DIN 902",), ("DIN 903",)], "standard string")
    return V.standards_available(long(spark, d), standards)
