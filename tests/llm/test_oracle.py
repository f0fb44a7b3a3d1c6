import duckdb
import pytest

from textwarden.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert got == sorted(out.fetchall(), key=str)
