"""Many reports in one pass equal single runs."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from adfunnel import SPEC_A, SPEC_B, ExperimentSpec, experiment_report
from adfunnel.plans import many
from adfunnel.plans.many import experiment_reports, many_specs, one_report, read_specs
from adfunnel.sources.derived import derive_dims, derive_facts
from adfunnel.sources.scan import FACT_TABLES, read_dims, read_facts
from tables_at import SF_CHECK

SPECS = [SPEC_A, SPEC_B,
         replace(SPEC_A, platform="ANDROID", cap_micros=3_000_000, revenue_bound=90_000_000),
         replace(SPEC_B, by_campaign=False, cohort_days=30, cap_micros=40_000_000),
         replace(SPEC_B, ad_group_type="retargeting", excluded_tracker="MMP", first_events=False),
         replace(SPEC_A, test_id=5)]


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Facts by hour; a third of the app events lack an auction id."""
    root = str(tmp_path_factory.mktemp("lake"))
    facts = derive_facts(spark, SF_CHECK)
    for name in FACT_TABLES:
        df = getattr(facts, name)
        if name == "app_events":
            ids = [c for c in df.columns if c.endswith("impression__auction_id")]
            none = F.pmod(F.xxhash64("event_timestamp"), F.lit(3)) == 0
            df = df.withColumns({c: F.when(~none, F.col(c)) for c in ids})
        df.where(F.col("dt").between("2024-01-02T00", "2024-01-03T12")).coalesce(4).write.partitionBy("dt").parquet(f"{root}/{name}")
    dims = derive_dims(spark, SF_CHECK)
    for name in ("customers", "apps", "ab_test_groups", "campaigns"):
        getattr(dims, name).write.parquet(f"{root}/{name}")
    return root


def rows_of(df):
    cells = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return sorted(map(str, df.select(*cells).collect()))


@pytest.mark.parametrize("per_hour", [False, True])
def test_each_report_equals_its_single_run(spark, lake, per_hour):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    start, end = "2024-01-02T04", "2024-01-03T04"
    reports = experiment_reports(facts, dims, SPECS, start, end, per_hour).cache()
    counts = []
    for i, spec in enumerate(SPECS):
        want = experiment_report(facts, dims, spec, start, end, per_hour)
        got = one_report(reports, SPECS, i)
        assert got.columns == want.columns
        assert rows_of(got) == rows_of(want)
        counts.append(got.count())
    assert min(counts[:4]) > 0 and counts[5] == 0  # nobody is in test 5
    assert sum(counts) == reports.count()
    reports.unpersist()


def test_five_scans_and_two_exchanges(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    df = experiment_reports(facts, dims, SPECS, "2024-01-02T04", "2024-01-02T10")
    execution = df._jdf.queryExecution()
    formatted = spark._jvm.PythonSQLUtils.explainString(execution, "formatted")
    scans = re.findall(r"Scan parquet.*?\n\n", formatted, flags=re.S)
    scans = [s for s in scans if "PartitionFilters" in s]
    assert len(scans) == len(FACT_TABLES), formatted
    for s in scans:  # the platforms that any report asks for reach the reader
        assert re.search(r"PushedFilters: [^\n]*app_platform", s), s
    df.collect()
    plan = execution.executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2, plan


def test_columns_that_a_report_lacks_are_null(spark, lake):
    reports = experiment_reports(read_facts(spark, lake), read_dims(spark, lake), SPECS[:2])
    a, b = reports.where("report = 0"), reports.where("report = 1")
    for c in ("campaign_id", "campaign_name", "target_events_d7", "target_events_first"):
        assert a.where(F.col(c).isNotNull()).count() == 0
    assert b.where("target_events_d7 IS NOT NULL AND campaign_id IS NOT NULL").count() > 0


def test_repeated_specs_are_reports_of_their_own(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    twice = experiment_reports(facts, dims, [SPEC_A, SPEC_A])
    want = rows_of(experiment_report(facts, dims, SPEC_A))
    assert rows_of(one_report(twice, [SPEC_A] * 2, 0)) == rows_of(one_report(twice, [SPEC_A] * 2, 1)) == want


def test_specs_that_do_not_go_together(spark):
    with pytest.raises(ValueError, match="not 0"):
        many_specs(spark, [])
    with pytest.raises(ValueError, match="carry_event_metrics"):
        many_specs(spark, [SPEC_A, replace(SPEC_A, carry_event_metrics=True)])


def test_specs_from_a_table(spark, monkeypatch):
    schema = "test_id long, control_group long, test_group long, cap_micros long, d7 boolean, owner string"
    table = spark.createDataFrame([(7, 70, 71, None, True, "x"), (5, 50, 51, 9, None, None)], schema)
    assert read_specs(table) == [ExperimentSpec(5, 50, 51, cap_micros=9), ExperimentSpec(7, 70, 71, d7=True)]
    assert read_specs(table.limit(0)) == []
    with pytest.raises(ValueError, match="lacks test_group"):
        read_specs(table.drop("test_group"))
    with pytest.raises(ValueError, match="lacks test_id"):
        read_specs(spark.createDataFrame([(None, 1, 2, 3, True, "")], schema))
    monkeypatch.setattr(many, "MAX_REPORTS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        read_specs(table)
