from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from marram import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = ["graph_search_ranked", "graph_expand_ranked", "hybrid_topk", "hierarchy_promote", "chunk_fixed", "dedup_normalized_text", "csv_islands", "lexical_metrics", "ancestor_prefixes"]


def test_every_oracle_has_a_query():
    assert set(core.ORACLES) <= set(core.QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", SMALL)
def test_rows_equal_the_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = core.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = con.execute(core.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want
