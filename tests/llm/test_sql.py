"""Text queries against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from voxelspark.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(df) -> list:
    plain = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else v
    return sorted(tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA).toPandas()
    assert len(found) and rows(found) == rows(c.execute(ORACLE_SQL[name]).df())
