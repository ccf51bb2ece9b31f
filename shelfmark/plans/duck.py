"""DuckDB spellings of the column expressions, for the SQL counterparts of queries."""

from __future__ import annotations

from shelfmark.functions.text import NOISE

_NOISE = "[" + ", ".join(f"'{w}'" for w in NOISE) + "]"
NUM = r"[0-9]+(?:[.,][0-9]+)?"


def fold(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce({x},'')),'đ','d')), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def pattern(x: str) -> str:
    return f"array_to_string(list_filter(string_split({fold(x)},' '), lambda w: NOT regexp_matches(w,'[0-9]')), ' ')"


def content_words(x: str) -> str:
    return f"list_filter(string_split({fold(x)},' '), lambda w: length(w) > 1 AND NOT regexp_matches(w,'[0-9]') AND NOT list_contains({_NOISE}, w))"


def key(d: str, leaf: str) -> str:
    return f"""substr(sha1('["' || {pattern(d)} || '", "' || {fold(leaf)} || '"]'), 1, 16)"""


def norm_space(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x},''), '\s+', ' ', 'g'))"


def skeleton(x: str) -> str:
    return f"lower(regexp_replace({norm_space(x)}, '{NUM}', '#', 'g'))"


def numbers(x: str) -> str:
    return f"regexp_extract_all(coalesce({x},''), '({NUM})', 1)"


def tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({norm_space(x)}), '([0-9A-Za-zÀ-ỹ]+)', 1))"


def is_generic(x: str) -> str:
    return f"regexp_matches({fold(x)}, '^(other|chua phan loai|dang xu ly|khac)( |$)')"


#: catalog rows with folded texts, verdict and score
JUDGED = f"""j0 AS (SELECT *, {fold('description')} fd, {fold('leaf_name')} fl, {content_words('leaf_name')} lw, {content_words('description')} dw FROM catalog),
j1 AS (SELECT *, len(list_filter(lw, lambda w: list_contains(dw, w))) hits, len(lw) n FROM j0),
judged AS (SELECT part_id, row_ord, part_number, description, leaf_name, leaf_id, leaf_depth, level1_name, filters,
  CASE WHEN fl <> '' AND contains(' ' || fd || ' ', ' ' || fl || ' ') THEN 'EXACT' WHEN n = 0 THEN 'NO_OVERLAP' WHEN hits = n THEN 'ALL_WORDS' WHEN hits = 0 THEN 'NO_OVERLAP' ELSE 'PARTIAL' END verdict,
  CASE WHEN fl <> '' AND contains(' ' || fd || ' ', ' ' || fl || ' ') THEN 1.0::DOUBLE WHEN n = 0 THEN 0.0::DOUBLE ELSE round_even((hits::DOUBLE / n)::DECIMAL(18,9), 3)::DOUBLE END score FROM j1)"""

#: suspect pairs, one row for each key
QUEUE = f"""q0 AS (SELECT *, {key('description', 'leaf_name')} key_hash, {fold('leaf_name')} fleaf FROM judged WHERE verdict IN ('PARTIAL','NO_OVERLAP')),
queue AS (SELECT key_hash, arg_min(description, row_ord) sample_description, arg_min(leaf_name, row_ord) leaf_name, arg_min(level1_name, row_ord) level1_name, arg_min(verdict, row_ord) rule_verdict, arg_min(score, row_ord) rule_score, count(*) row_count, min(row_ord) first_ord,
  array_to_string(list_transform(list_slice(list_sort(list(row_ord)), 1, 5), lambda x: CAST(x AS VARCHAR)), ',') part_ids FROM q0 GROUP BY key_hash)"""

#: stand-in verdicts of two judges on the queue, derived from the key
VERDICTS = """leafs AS (SELECT leaf_name cand, row_number() OVER (ORDER BY leaf_name) - 1 k, count(*) OVER () m FROM (SELECT DISTINCT leaf_name FROM catalog)),
v0 AS (SELECT j.judge, q.key_hash, md5(concat(j.judge, q.key_hash)) h FROM queue q CROSS JOIN (VALUES ('a'),('b')) j(judge)),
v1 AS (SELECT *, strpos('0123456789abcdef', substr(h,1,1)) - 1 d1, strpos('0123456789abcdef', substr(h,2,1)) - 1 d2, strpos('0123456789abcdef', substr(h,3,1)) - 1 d3 FROM v0),
verdicts AS (SELECT judge, key_hash, CASE WHEN d1 < 10 THEN 'correct' WHEN d1 < 14 THEN 'wrong' ELSE 'unsure' END verdict, (50 + 3 * d3) / 100.0::DOUBLE confidence,
  CASE WHEN d1 >= 10 AND d1 < 14 THEN CASE WHEN d2 = 15 THEN 'not a leaf' ELSE cand END END suggested FROM v1 JOIN leafs ON k = d2 % m)"""
