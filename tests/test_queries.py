"""Every registered query against its DuckDB SQL at the smallest scale."""

import duckdb
import pytest

from check_oracle import TABLES, compare
from emberwatch.plans.registry import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
JOBS = ["retrain_job", "end_to_end_run", "evaluate_report", "iforest_score"]


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {*JOBS, "iforest_fit"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, con.execute(ORACLES[name]).df()) == "ok"


@pytest.mark.parametrize("name", JOBS)
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
