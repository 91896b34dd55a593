"""Every registered query of the engine against DuckDB, and the rest for rows."""

import math

import duckdb
import pandas as pd
import pytest

from retinaspark.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(df):
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "NULL"
        return v if isinstance(v, str) else f"{float(v):.9g}" if not hasattr(v, "tolist") or getattr(v, "ndim", 0) == 0 else str(v.tolist())

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and norm(got) == norm(want)
