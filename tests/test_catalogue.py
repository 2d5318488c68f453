"""Every registered query of the genotyping operators against its DuckDB text on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "benchmark", "conversations", "lineitem", "part", "nation", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x != x:
            return None
        return round(float(x), 5) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.sql(catalogue.SQL[name])
    assert sorted(expected.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(duck.sql(f"select {names} from expected").fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.SQL.keys()))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_haplotype_graph_lists_all_that_the_operator_keeps(spark):
    haps = catalogue.QUERIES["haplotype_graph"](spark, DATA).groupBy("cluster").count()
    assert haps.agg({"count": "max"}).first()[0] > 8
