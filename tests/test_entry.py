import pytest

import __spark_entry__ as entry
from tidemark import catalogue


def test_all_queries_have_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLES.keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in (*catalogue.TABLES, "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    cur = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cur.description]
    rows = cur.fetchall()
    df = catalogue.QUERIES[name](spark, d)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, rows))
