"""Catalog, price items and web candidates as views over the given tables.

The SQL runs unchanged in Spark and in DuckDB; queries build the views with
``spark.sql`` over scans, their SQL counterparts prepend them as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_CATALOG = """WITH b AS (SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, split_part(p_name,' ',2) AS noun FROM {part}),
c AS (SELECT *, CASE WHEN p_partkey % 97 = 0 THEN 'other' WHEN p_partkey % 20 = 0 AND noun <> 'bolt' THEN 'bolt' WHEN p_partkey % 20 = 0 THEN 'ring' WHEN p_partkey % 6 = 1 THEN concat(noun, ' ', split_part(p_name,' ',1)) WHEN p_partkey % 6 = 2 THEN concat('steel ', noun) ELSE noun END AS leaf FROM b)
SELECT p_partkey AS part_id, p_partkey AS row_ord,
 CASE p_partkey % 4 WHEN 0 THEN concat('SAT-', CAST(10000+p_partkey AS STRING)) WHEN 1 THEN concat('BSI-BS', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('ANE-No.', CAST(p_partkey AS STRING)) ELSE concat('PM-', CAST(p_partkey AS STRING), 'BLA') END AS part_number,
 concat(p_name, CASE WHEN p_partkey % 23 = 4 THEN ' - M' ELSE ' M' END, CAST(p_size AS STRING), 'x', CAST(p_size*3 AS STRING), CASE WHEN p_partkey % 7 = 0 THEN ' 55 mm' ELSE ' 55mm' END) AS description,
 leaf AS leaf_name, concat(substr(md5(leaf),1,6), CASE WHEN leaf='bolt' AND p_partkey % 4 = 0 AND p_type='PROMO' THEN 'b' ELSE '' END) AS leaf_id,
 3 AS leaf_depth, p_type AS level1_name,
 CASE WHEN p_partkey % 10 = 3 THEN NULL ELSE concat(CASE WHEN p_partkey % 71 = 9 THEN concat('Size Of ', noun, ': M99 | ') ELSE '' END, 'Size Of ', noun, ': M', CAST(p_size AS STRING),
   CASE WHEN p_partkey % 29 = 5 OR p_name LIKE 'small %' THEN '' ELSE concat(' | Key Of ', noun, ': ', CAST(p_size*2+1 + CASE WHEN p_partkey % 53 = 0 THEN 7 ELSE 0 END AS STRING), ' mm') END,
   ' | Standard Of ', noun, ': DIN ', CAST(900 + ascii(noun) % 7 AS STRING), ' | Brand of Group Home: ', p_brand) END AS filters
FROM c"""

_ITEMS = """SELECT p_partkey AS row_ord, p_brand AS sheet, p_name AS name, concat('6', lpad(CAST(p_size*13 % 1000 AS STRING),3,'0'), CASE WHEN p_partkey % 3 = 0 THEN '-2RS' ELSE '' END) AS code,
 CASE WHEN p_partkey % 101 = 0 THEN 'n/a' ELSE CAST(900000 + p_partkey % 1900 AS STRING) END AS order_raw,
 CASE WHEN p_partkey % 37 = 0 THEN 'checking' WHEN p_partkey % 41 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS price_raw,
 p_size AS d_mm, CASE WHEN p_partkey % 29 = 0 THEN p_size ELSE p_size*2+1 END AS dd_mm FROM {part}"""

_WEB = """SELECT page_id, url, html, regexp_extract(url, '/([0-9]+)', 1) AS code, url LIKE '%spam-farm%' AS own_domain FROM {pages}"""

#: parts with attributes that decide each other: a rare thread has its own pitch, a tap follows the pitch, a few finishes stand only in names
_SPECS = """WITH b AS (SELECT p_partkey AS i, p_name, split_part(p_name,' ',2) AS noun, CASE WHEN split_part(p_name,' ',2) = 'bolt' THEN p_partkey % 2 ELSE p_partkey % 5 END AS s, CASE WHEN p_partkey % 40 = 7 THEN 'Fine' ELSE 'Coarse' END AS thread FROM {part}),
c AS (SELECT *, CASE WHEN thread = 'Fine' THEN concat(CAST(s+1 AS STRING), '.5 mm') ELSE concat(CAST(s+2 AS STRING), ' mm') END AS pitch, CASE WHEN i % 43 = 5 THEN 'Nickel' WHEN s % 2 = 0 THEN 'Zinc' ELSE 'Black' END AS finish FROM b)
SELECT i AS row_ord, noun AS grp, concat(p_name, ' ', finish, CASE WHEN thread = 'Fine' THEN ' Fine' ELSE '' END, ' M', CAST(2*s+4 AS STRING)) AS name,
 CASE WHEN i % 31 <> 6 THEN concat('M', CAST(2*s+4 AS STRING)) END AS size, CASE WHEN i % 9 <> 4 THEN thread END AS thread, CASE WHEN i % 13 <> 3 THEN pitch END AS pitch, CASE WHEN i % 26 <> 3 AND i % 11 <> 2 THEN concat('T', pitch) END AS tap,
 CASE WHEN i % 17 <> 5 AND i % 86 <> 5 THEN finish END AS finish, CASE WHEN i % 19 <> 4 THEN concat('sold without the ', CASE i % 7 WHEN 0 THEN 'nut' WHEN 1 THEN 'pin' WHEN 2 THEN 'cap' WHEN 3 THEN 'box' WHEN 4 THEN 'key' WHEN 5 THEN 'bag' ELSE 'lid' END) END AS note,
 CASE WHEN i % 23 <> 8 THEN CASE WHEN s % 2 = 0 THEN 'Japan' ELSE 'Taiwan' END END AS origin FROM c"""

#: attribute names of the columns of ``specs``
SPEC_KEYS = {"size": "Size", "thread": "Thread", "pitch": "Pitch", "tap": "Tap", "finish": "Finish", "note": "Note", "origin": "Original"}

CATALOG_CTE = "catalog AS (" + _CATALOG.format(part="part") + ")"
SPECS_CTE = "specs AS (" + _SPECS.format(part="part") + ")"
ITEMS_CTE = "items AS (" + _ITEMS.format(part="part") + ")"
WEB_CTE = "web AS (" + _WEB.format(pages="pages") + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CATALOG, part=table(spark, sf_dir, "part"))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPECS, part=table(spark, sf_dir, "part"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ITEMS, part=table(spark, sf_dir, "part"))


def web_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_WEB, pages=table(spark, sf_dir, "pages"))


#: steps of the query that is being built, by session, folder and name
_steps: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], T]) -> T:
    """The step ``name`` over ``sf_dir``, built once for each query (``start_query`` forgets them)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _steps:
        _steps[key] = build()
    return _steps[key]


def start_query() -> None:
    _steps.clear()
