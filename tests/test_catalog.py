"""Every registered core query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from pixelarium.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("lineitem", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(str(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_region_cluster_labels(spark):
    rows = catalog.QUERIES["region_cluster"](spark, SF).collect()
    assert rows and 2 <= len({r.label for r in rows}) <= 6
