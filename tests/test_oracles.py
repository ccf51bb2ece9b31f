"""Registered queries against their SQL over the smallest tables."""

from __future__ import annotations

import decimal
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# the long chains of lookups take minutes together; these stand for them here
CHAINS = ["a04_suspect_queue", "a12_status_ladder", "a19_apply_changes", "a21_verification", "b02_b04_clusters", "b07_b09_schema", "b10_missing", "d01_dependencies", "d03_trusted_lookup", "e03_brackets", "e06_cross_check"]


def names():
    from shelfmark.queries import ORACLES

    return sorted(n for n in ORACLES if n[0] in "ghksx" or n in CHAINS)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in rel.description]
    assert sorted(heads) == columns
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(plain(r[heads.index(c)]) for c in columns) for r in rel.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_imports_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "shelfmark")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "shelfmark.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
