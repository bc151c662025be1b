import os

import pytest

import __spark_entry__ as entry
from spanweave.jobs import registry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "events", "documents", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    got = sorted(map(str, (rounded(r) for r in df.select(*names).collect())))
    want = con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(str, map(rounded, want)))
