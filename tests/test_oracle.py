"""Every registered query against its DuckDB oracle on the smallest tables."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

SF = "/root/testdata/sf0.001"


def catalog_names():
    from threadline.plans import catalog
    catalog.load_all()
    return catalog.ORACLE


NAMES = sorted(catalog_names())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("documents conversations events embeddings labels customer").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from check_oracle import digest
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = duck.sql(E.oracle_sql()[name])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns)[0] == digest(orows, res.columns)[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() == 20
