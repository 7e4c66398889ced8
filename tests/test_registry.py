"""Every registered query of the layer against its SQL, on the smallest tables."""

import duckdb
import pytest

from tamarack import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, sql, name):
    df = registry.queries()[name](spark, FOLDER)
    made = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(repr([dict(zip(names, row))[c] for c in order]) for row in made.fetchall())
    assert sorted(repr([row[c] for c in order]) for row in df.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())
