"""Randomised differential test: Spark report vs the DuckDB oracle on random facts.

Fact rows draw every column independently from small pools that include NULL,
so touch priorities, NULL logic, gates, caps and the cohort edge mix far more
freely than in the derived driver data. Both engines read the same Parquet files.
"""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfunnel import SPEC_A, SPEC_B, Dims, Facts, experiment_report
from adfunnel.sources.schemas import DIM_SCHEMAS, FACT_SCHEMAS
from oracle.report_sql import REPORT_A, REPORT_B, ReportSQL
from oracle_check import fingerprint

T0 = 1704085200000
H = 3_600_000
POOLS = {
    T.StringType(): [None, "", "x"],
    T.BooleanType(): [None, True, False],
    T.LongType(): [None, 1, 2],
}
SPECIAL = {
    "dt": ["2024-01-01T05", "2024-01-01T06"],
    "creative__ad_format": [None, "video", "native", "320x50", "300x250", "other"],
    "campaign_tracker_type": [None, "SKAN", "MMP", "MMP"],
    "app_platform": [None, "IOS", "IOS", "ANDROID"],
    "ad_group_type": [None, "user-acquisition", "user-acquisition", "retargeting"],
    "sk_ad_network_response__version": [None, "", "2.2"],
    "skan_params__version": [None, "", "3.0"],
    "idfa": [None, "", "00000000-0000-0000-0000-000000000000", "A", "B"],
    "platform_specific_id": [None, "", "A", "B"],
    "model": [None, "", "iPhone 12", "iPhone Unknown", "iPad 9"],
    "match_type": [None, "DETERMINISTIC", "PROBABILISTIC", "N/A"],
    "auction_id": [None, "a1", "a2"],
    "customer_revenue_micros": [None, 400_000_000, 300_000_000, -700_000_000, 100_000_000_000,
                                99_999_999_999, 5_000_000],
    "customer_id": [None, 1, 2],
    "app_id": [None, 10, 11],
}


def _value(rnd, field):
    name = field.name
    for key, pool in SPECIAL.items():
        if name == key or name.endswith("__" + key) or name.endswith("_" + key):
            return rnd.choice(pool)
    if name == "pod_device_model" or name.endswith("model_data__name"):
        return rnd.choice(SPECIAL["model"])
    if isinstance(field.dataType, T.ArrayType):
        return rnd.choice([
            None, [], [{"id": 9, "group": {"id": 1}}],
            [{"id": SPEC_A.test_id, "group": {"id": 2373}}, {"id": SPEC_B.test_id,
                                                             "group": {"id": 2412}}],
            [{"id": SPEC_B.test_id, "group": {"id": 2413}}, {"id": SPEC_B.test_id,
                                                             "group": None}],
            [{"id": SPEC_A.test_id, "group": {"id": 2374}}, {"id": SPEC_A.test_id,
                                                             "group": {"id": 2374}}]])
    if name in ("at", "event_timestamp") or name.endswith("__at"):
        return rnd.choice([None] + [T0 + k * H // 2 - rnd.randrange(0, 400) * H
                                    for k in range(3)]) if name == "install__at" else \
            rnd.choice([T0 + rnd.randrange(0, 2 * H), T0 - H + 5, None])
    return rnd.choice(POOLS[field.dataType])


def _frame(spark, name, rnd, n):
    schema = FACT_SCHEMAS[name]
    rows = [tuple(_value(rnd, f) for f in schema.fields) for _ in range(n)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("random"))
    rnd = random.Random(7)
    for name in FACT_SCHEMAS:
        _frame(spark, name, rnd, 2000).write.parquet(f"{root}/{name}")
    dims = {
        "customers": [(1, "Acme"), (3, "Other")],
        "apps": [(10, 1, "Game", "Gold"), (11, 2, "Puzzle", None)],
        "ab_test_groups": [(2373, "control A"), (2412, "control B"), (2413, "test B")],
        "campaigns": [(1, "c1", "LEARNING")],
    }
    # repeated ids: the same name twice (sums double) and a second name (a second row)
    repeated = {
        "customers": [(1, "Acme"), (1, "Acme"), (1, "Acme Inc"), (3, "Other")],
        "apps": [(10, 1, "Game", "Gold"), (10, 1, "Game", "Gold"), (11, 2, "Puzzle", None)],
        "ab_test_groups": [(2373, "control A"), (2412, "control B"), (2412, "ctl B"),
                           (2413, "test B")],
        "campaigns": [(1, "c1", "LEARNING"), (1, "c1", "LEARNING")],
    }
    for name, rows in dims.items():
        spark.createDataFrame(rows, DIM_SCHEMAS[name]).write.parquet(f"{root}/{name}")
        spark.createDataFrame(repeated[name], DIM_SCHEMAS[name]).write.parquet(
            f"{root}/repeated/{name}")
    return root


@pytest.mark.parametrize("spec", [SPEC_A, SPEC_B], ids=["A", "B"])
@pytest.mark.parametrize("per_hour,dim_dir", [(False, ""), (True, ""), (False, "repeated/")],
                         ids=["range", "hourly", "repeated-dim-ids"])
def test_random_facts_match_oracle(spark, lake, spec, per_hour, dim_dir):
    facts = Facts(**{n: spark.read.parquet(f"{lake}/{n}") for n in FACT_SCHEMAS})
    dims = Dims(**{n: spark.read.parquet(f"{lake}/{dim_dir}{n}") for n in DIM_SCHEMAS})
    got = experiment_report(facts, dims, spec, per_hour=per_hour)
    doubles = [f.name for f in got.schema.fields if isinstance(f.dataType, T.DoubleType)]
    got = got.select(*[F.round(c, 4).alias(c) if c in doubles else F.col(c)
                       for c in got.columns])
    collected = got.collect()
    rows = [tuple(r) for r in collected]
    # the random facts must reach every branch, the cap and the quality metrics
    assert sum(r.impressions for r in collected) > 0 and sum(r.clicks for r in collected) > 0
    assert sum(r.installs for r in collected) > 0
    assert any(r.capped_customer_revenue_micros for r in collected)
    assert any(r.misattributed_installs for r in collected)
    assert any(r.possibly_misattributed_installs for r in collected)

    con = duckdb.connect()
    for n in FACT_SCHEMAS:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{lake}/{n}/*.parquet')")
    for n in DIM_SCHEMAS:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM "
                    f"read_parquet('{lake}/{dim_dir}{n}/*.parquet')")
    r = ReportSQL(REPORT_B if spec is SPEC_B else REPORT_A, per_hour=per_hour)
    sql = f"WITH {r.ctes()} {r.report()}"
    sql = f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in doubles)}) FROM ({sql})"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(cols) == sorted(got.columns)
    assert len(rows) == len(want)
    assert fingerprint(got.columns, rows) == fingerprint(cols, want)
