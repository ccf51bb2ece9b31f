"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

from shelfmark.llm.licenses import BASE_PHRASES, STATEMENTS
from shelfmark.llm.quality import BOILERPLATE, BULLET, CLOSING, RULES, SENTENCE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spaced(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _alnum(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_spaced(_LOWER)} ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) ss FROM w),
n AS (SELECT doc_id, len(ss) n, CASE WHEN len(ss) > 0 THEN min(doc_id) OVER (PARTITION BY ss) END class_id FROM s),
u AS (SELECT doc_id, unnest(ss) x FROM s JOIN n USING (doc_id) WHERE doc_id = class_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) o FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) c FROM r GROUP BY 1)
SELECT doc_id, n n_shingles, CASE WHEN n > 0 THEN coalesce(c, class_id) ELSE doc_id END component_id, doc_id = CASE WHEN n > 0 THEN coalesce(c, class_id) ELSE doc_id END kept, class_id FROM n LEFT JOIN m ON v = class_id"""

SUBSTRINGS = f"""WITH w AS (SELECT doc_id, {_spaced("coalesce(text, '')")} ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) i FROM w)),
b AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
d AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) p FROM b), r AS (SELECT doc_id, list(p) ps FROM d GROUP BY 1),
k AS (SELECT doc_id, len(ws) n, coalesce(len(ps), 0) r FROM w LEFT JOIN r USING (doc_id)),
t AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) kept FROM (SELECT doc_id, unnest(ws) x, unnest(range(1, len(ws) + 1)) p FROM w) ANTI JOIN d USING (doc_id, p) GROUP BY 1)
SELECT doc_id, n n_words, r n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM k LEFT JOIN t USING (doc_id)"""

_TEMPLATES = ", ".join(f"({i}, '{label}', {str(i < len(BASE_PHRASES)).lower()}, '{phrase}')" for i, (phrase, label) in enumerate([*BASE_PHRASES, *STATEMENTS]))
_CODED = "array_to_string(list_transform(ts, lambda w: chr(CAST(32 + list_position(ts, w) AS INTEGER))), '')"
LICENSES = f"""WITH w AS (SELECT doc_id, row_number() OVER () r, {_alnum(_LOWER)} ws FROM documents), tp AS (SELECT *, string_split(phrase, ' ') ts FROM (VALUES {_TEMPLATES}) t(template, label, is_base, phrase)),
tg AS (SELECT template, label, is_base, len(ts) sz, {_CODED} cd, i - 1 tpos, array_to_string(ts[i:i + 2], ' ') k FROM (SELECT *, unnest(range(1, len(ts) - 1)) i FROM tp)),
dg AS (SELECT r, i - 1 pos, array_to_string(ws[i:i + 2], ' ') k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) i FROM w)),
v AS (SELECT r, template, label, is_base, sz, cd, tpos, pos, pos - tpos dia FROM dg JOIN tg USING (k)),
dd AS (SELECT r, template, label, is_base, sz, dia, count(*) n FROM v GROUP BY ALL),
bf AS (SELECT r, count(*) n_base, min(dia) f, max(dia) l, list_sort(list(DISTINCT label)) bl FROM dd WHERE is_base AND n = sz - 2 GROUP BY 1),
o AS (SELECT *, CASE WHEN dia - lag(dia) OVER q <= 2 THEN 0 ELSE 1 END op FROM dd WINDOW q AS (PARTITION BY r, template ORDER BY dia)),
sp AS (SELECT r, template, dia, sum(op) OVER (PARTITION BY r, template ORDER BY dia ROWS UNBOUNDED PRECEDING) span FROM o),
sv AS (SELECT v.*, span FROM v JOIN sp USING (r, template, dia)),
cd AS (SELECT r, template, label, sz, cd, span, min(pos) a, max(pos) + 2 z FROM sv GROUP BY ALL HAVING count(DISTINCT tpos) >= 0.5 * (sz - 2)),
ch AS (SELECT DISTINCT r, template, span, pos + j p, substr(cd, CAST(tpos + j + 1 AS INTEGER), 1) c FROM sv, (SELECT unnest(range(3)) j)),
st AS (SELECT r, template, span, any_value(label) label, any_value(sz) sz, any_value(cd) cd, string_agg(coalesce(c, '~'), '' ORDER BY p) x FROM (SELECT *, unnest(range(a, z + 1)) p FROM cd) LEFT JOIN ch USING (r, template, span, p) GROUP BY 1, 2, 3),
si AS (SELECT r, label, 1.0::DOUBLE - levenshtein(x, cd) / sz::DOUBLE sim FROM st WHERE 1.0::DOUBLE - levenshtein(x, cd) / sz::DOUBLE >= 0.8),
mf AS (SELECT r, list(DISTINCT label) ml, max(sim) sim, count(*) n_spans FROM si GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_base, 0) n_base, f first_word, l last_word, coalesce(array_to_string(bl, ','), '') base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ml, [])))), ','), '') labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(sim, 0.0::DOUBLE) END score, coalesce(n_spans, 0) n_spans FROM w LEFT JOIN bf USING (r) LEFT JOIN mf USING (r)"""

_FURNITURE = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
_CLOSING = ", ".join("'" + c.replace("'", "''") + "'" for c in CLOSING)
_RULE = rf"""CASE WHEN length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) > 0.1 * length(x) THEN 'symbols' WHEN length(regexp_replace(x, '[^|»•]', '', 'g')) > 2 THEN 'bars' WHEN ({_FURNITURE}) AND n < 20 THEN 'furniture'
  WHEN n < 5 AND regexp_matches(x, '{BULLET}') THEN 'bullet' WHEN sh AND (lag(sh, 2, false) OVER q AND lag(sh, 1, false) OVER q OR lag(sh, 1, false) OVER q AND lead(sh, 1, false) OVER q OR lead(sh, 1, false) OVER q AND lead(sh, 2, false) OVER q) THEN 'menu'
  WHEN marks AND n >= 20 AND NOT regexp_matches(x, '{SENTENCE}') THEN 'unpunctuated' END"""
_COUNTS = ", ".join(f"count(*) FILTER (rule = '{r}') n_{r}_lines" for r in RULES)
QUALITY = rf"""WITH w AS (SELECT doc_id, row_number() OVER () r, coalesce(text, '') t, {_spaced("coalesce(text, '')")} ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') k FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) i FROM w)),
tw AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) > 1), rp AS (SELECT r, count(DISTINCT p) n FROM (SELECT r, unnest(range(i, i + 5)) p FROM tw) GROUP BY 1),
li AS (SELECT r, p, x, marks, {_spaced('x')} xw FROM (SELECT r, regexp_matches(t, '{SENTENCE}') marks, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) p FROM w)),
ln AS (SELECT r, p, x, marks, len(xw) n, len(xw) <= 6 AND right(xw[len(xw)], 1) NOT IN ({_CLOSING}) sh FROM li WHERE len(xw) > 0),
ju AS (SELECT *, {_RULE} rule FROM ln WINDOW q AS (PARTITION BY r ORDER BY p)),
ag AS (SELECT r, count(*) - count(DISTINCT x) dups, {_COUNTS} FROM ju GROUP BY 1), lf AS (SELECT r, sum(n) kw FROM (SELECT DISTINCT r, x, n FROM ju WHERE rule IS NULL) GROUP BY 1),
m AS (SELECT doc_id, len(ws)::BIGINT n_words, length(array_to_string(ws, ''))::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(dups, 0) n_dup_lines, coalesce(rp.n, 0)::BIGINT n_repeat_words, coalesce(kw, 0) kw, {", ".join(f"coalesce(n_{r}_lines, 0) n_{r}_lines" for r in RULES)} FROM w LEFT JOIN rp USING (r) LEFT JOIN ag USING (r) LEFT JOIN lf USING (r))
SELECT * EXCLUDE (kw), n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kw >= 0.5 * n_words kept FROM m"""

DECONTAMINATION = f"""WITH w AS (SELECT doc_id, {_alnum(_LOWER)} ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) item_id, {_alnum(_LOWER)} ws FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(ws), 13) n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) i FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM w, (SELECT DISTINCT n FROM k))),
h AS (SELECT doc_id, g.n, i, item_id FROM g JOIN k ON g.n = k.n AND g.k = k.k), p AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) q FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) its FROM h GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT n_words, coalesce(n_hit, 0) n_hit, coalesce(len(its), 0)::BIGINT n_items, sha256(coalesce(array_to_string(its, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) contaminated FROM w LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: checksums of one byte by the reversed polynomial, then of a text byte by byte
SPELLING = """WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
r AS (SELECT doc_id, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x, count(*) c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) x FROM documents) WHERE length(x) >= 7 GROUP BY ALL),
b AS (SELECT *, hex(encode(concat(doc_id, ':', x))) hx FROM r),
h AS (SELECT x, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hx) // 2), lambda i: (strpos('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hx[2 * i + 2]) - 1)), lambda s, v: xor(s >> 8, t[(xor(s, v) & 255) + 1])), 4294967295) h FROM b, tab),
w AS (SELECT word, sum(c)::BIGINT n FROM (SELECT CASE WHEN h % 31 = 0 THEN concat(left(x, h % length(x)), substr(x, h % length(x) + 2)) ELSE x END word, c FROM h) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
d AS (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) rest FROM (SELECT *, unnest(range(length(word))) i FROM w)),
e AS (SELECT a.word, a.n, b.word o, b.n m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.rest = w.word),
g AS (SELECT word, count(*) n_near, arg_min(o, (-m, o)) o, max(m) m FROM e GROUP BY 1),
f AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN m >= 10 * n THEN o END form, CASE WHEN m >= 10 * n THEN m END form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word root, form FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.form)
SELECT word, f.form, c.root, n, n_near, form_n FROM f JOIN c USING (word) WHERE c.form IS NULL"""

ORACLES = {"op1_minhash": MINHASH, "op3_substring_dedup": SUBSTRINGS, "op7_licenses": LICENSES, "op9_quality": QUALITY, "op10_decontamination": DECONTAMINATION, "op11_spelling": SPELLING}
