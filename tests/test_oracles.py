"""Every query with an oracle gives the oracle's rows on a small table, and the rest keep their invariants."""

from __future__ import annotations

import os

import duckdb
import pytest

from visarium import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: With few rows of each label, no two sets of times overlap enough or some merge is empty: those are fine as well.


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got, want = rows_of(catalog.QUERIES[name](spark, SF).toPandas()), rows_of(duck.execute(catalog.ORACLES[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_invariants(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if "label" in got:
        kinds = sorted(set(got["label"]) - {-1})
        assert kinds == list(range(len(kinds)))
        if name == "hdbscan":
            assert got[got["label"] >= 0].groupby("label").size().ge(5).all()
