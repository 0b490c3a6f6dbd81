"""Every registered query against its DuckDB oracle on the driver's sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from tables_at import SF_SMALL
from oracle_check import compare, duck

SQL = entry.oracle_sql()
# the training-data queries have their own tests beside their operators
REPORT_QUERIES = sorted(set(entry.queries()) - set(entry._llm_queries()))


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(REPORT_QUERIES) == set(SQL) - set(entry._llm_sql())


@pytest.mark.parametrize("name", REPORT_QUERIES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, entry.queries()[name], SQL[name], SF_SMALL, con)
    assert r["cols"], (r["s_cols"], r["d_cols"])
    assert r["count"], (r["rows"], r["oracle_rows"])
    assert r["hash"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "capped_customer_revenue_d7" in df.columns


@pytest.mark.parametrize("name", ["hour_iso", "hour_range_scan", "d7_cohort",
                                  "hourly_experiment_report"])
def test_results_ignore_session_time_zone(spark, con, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = compare(spark, name, entry.queries()[name], SQL[name], SF_SMALL, con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert r["count"] and r["cols"] and r["hash"]
