"""The numbered queries that have SQL give the same rows in DuckDB."""

import os

import duckdb
import pytest

from proofmill.llm import oracles, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(oracles.SQL[name])
    columns = sorted(c[0] for c in found.description)
    key = "doc_id" if "doc_id" in columns else "conv_id"
    want = found.df()[columns].sort_values(key, ignore_index=True)
    got = queries.queries()[name](spark, SF).toPandas()[columns].sort_values(key, ignore_index=True)
    assert got.dtypes.tolist() == want.dtypes.tolist() and got.equals(want)
