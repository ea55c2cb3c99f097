"""Every query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidewake.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "item") and not isinstance(v.item(), bool) else str(v)

    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
