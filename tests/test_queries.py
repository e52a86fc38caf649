"""Every query with SQL gives what DuckDB gives; the others give rows of a stable schema."""

from __future__ import annotations

import os

import duckdb
import pytest

from basketspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.SQL:
        assert columns
        return
    out = con.execute(catalog.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in out.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert os.path.exists("/root/testdata/sf0.001")
    assert __spark_entry__.entry(spark).columns == ["product_id", "store", "usual_price", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_claims_and_clusters_use_no_offer_twice(spark, sf_dir):
    rows = catalog.QUERIES["greedy_claim"](spark, sf_dir).collect()
    assert len({r.offer for r in rows}) == len(rows) == len({(r.anchor, r.store) for r in rows})
    members = [r.member for r in catalog.QUERIES["fuzzy_clusters"](spark, sf_dir).collect()]
    assert len(set(members)) == len(members)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["retention_prune"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_orderkey" in plan and "l_comment" not in plan
