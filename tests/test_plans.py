"""Physical-plan shape on dt-partitioned Parquet, sink idempotency, hourly algebra."""

import re

import pytest
from pyspark.sql import functions as F

from adfunnel import SPEC_A, SPEC_B, experiment_report, write_hour
from adfunnel.sources.derived import derive_dims, derive_facts
from adfunnel.sources.scan import FACT_TABLES, read_dims, read_facts

from tables_at import SF_SMALL  # noqa: E402

START, END = "2024-01-03T00", "2024-01-05T00"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    facts = derive_facts(spark, SF_SMALL)
    for name in FACT_TABLES:
        getattr(facts, name).write.partitionBy("dt").parquet(f"{root}/{name}")
    dims = derive_dims(spark, SF_SMALL)
    for name in ("customers", "apps", "ab_test_groups", "campaigns"):
        getattr(dims, name).write.parquet(f"{root}/{name}")
    return root


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df):
    """``explain("formatted")`` text without printing it."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_partition_pruning_and_narrow_reads(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    df = experiment_report(facts, dims, SPEC_B, START, END)
    plan = _formatted(df)
    scans = re.findall(r"Scan parquet.*?\n\n", plan, flags=re.S)
    fact_scans = [s for s in scans if "PartitionFilters" in s and "dt" in s]
    assert len(fact_scans) == 5
    for s in fact_scans:
        assert f"(dt#" in s and START in s and END in s
    events = [s for s in fact_scans if "customer_revenue_micros" in s][0]
    assert "struct<id:bigint,group:struct<id:bigint>>" in events
    assert "attribution_event__click__impression__bid__bid_request__ab_test_assignments" \
        not in events


def _final_plan(df):
    """The adaptive plan that ran: ``df`` itself is collected, not a query on top of it."""
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


def test_shuffle_budget_and_broadcasts(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    plan = _final_plan(experiment_report(facts, dims, SPEC_B, START, END))
    assert "isFinalPlan=true" in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2, plan
    assert len(re.findall(r"BroadcastHashJoin .*LeftOuter", plan)) == 4


def test_app_event_segment_reaches_the_reader(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    plan = _formatted(experiment_report(facts, dims, SPEC_A, START, END))
    pushed = [x for x in re.findall(r"PushedFilters: (.*)", plan) if "reeng_click__" in x]
    assert len(pushed) == 1
    for value in ("IOS", "user-acquisition"):
        assert len(re.findall(rf"EqualTo\([a-z_]+,{value}\)", pushed[0])) == 3, pushed


def test_a_test_group_is_split_when_joins_are_not_broadcast(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    want = experiment_report(facts, dims, SPEC_A, START, END).collect()
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions",
            "spark.sql.adaptive.enabled")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "32", "false")):
            spark.conf.set(k, v)
        df = experiment_report(facts, dims, SPEC_A, START, END)
        tasks = df.select("ab_test_group_id", F.spark_partition_id().alias("task")).distinct().collect()
        got = df.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {r.ab_test_group_id for r in tasks}
    assert len({r.task for r in tasks}) > 2 * len(groups)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_parquet_path_equals_derived_path(spark, lake):
    facts, dims = read_facts(spark, lake), read_dims(spark, lake)
    a = experiment_report(facts, dims, SPEC_A, START, END)
    b = experiment_report(derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL), SPEC_A,
                          START, END)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hourly_sums_equal_range_run(spark):
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    hourly = experiment_report(facts, dims, SPEC_B, START, END, per_hour=True)
    ranged = experiment_report(facts, dims, SPEC_B, START, END)
    # additive metrics only: the cap applies per hour in one and per range in the other
    cols = ["impressions", "spend_micros", "clicks", "installs", "unreported_installs"]
    h = hourly.agg(*[F.sum(c).alias(c) for c in cols]).first()
    r = ranged.agg(*[F.sum(c).alias(c) for c in cols]).first()
    assert h == r
    assert hourly.select("dt").distinct().count() > 1


def test_write_hour_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    write_hour(df, path, "2024-01-01T00")
    write_hour(df, path, "2024-01-01T01")
    write_hour(spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string"), path,
               "2024-01-01T01")
    out = {(r.dt, r.k) for r in spark.read.parquet(path).collect()}
    assert out == {("2024-01-01T00", 1), ("2024-01-01T01", 2), ("2024-01-01T01", 3)}


def test_carry_event_metrics_opt_in(spark):
    from dataclasses import replace

    from adfunnel import per_auction_totals
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    spec = replace(SPEC_B, carry_event_metrics=True)
    rep = experiment_report(facts, dims, spec)
    totals = per_auction_totals(facts.app_events, SPEC_B)
    cols = ["target_events", "target_events_first", "customer_revenue_micros"]
    got = rep.agg(*[F.sum(c).alias(c) for c in cols]).first()
    want = totals.agg(*[F.sum(c).alias(c) for c in cols]).first()
    assert got == want and got.target_events > 0
    default = experiment_report(facts, dims, SPEC_B).agg(F.sum("target_events")).first()[0]
    assert default == 0


def test_capped_never_exceeds_uncapped(spark):
    from adfunnel import capped_revenue_rows, per_auction_totals
    facts = derive_facts(spark, SF_SMALL)
    totals = per_auction_totals(facts.app_events, SPEC_B).withColumn(
        "_rev", F.col("customer_revenue_micros"))
    rows = capped_revenue_rows(totals, SPEC_B, extra_keys=("_rev",))
    got = rows.select(F.col("_rev").alias("rev"),
                      F.col("capped_customer_revenue_micros").alias("cap"))
    assert got.count() == totals.count()
    assert got.where(F.col("rev").isNotNull()).count() > 0
    # capped <= uncapped and <= the cap; NULL exactly where revenue is NULL
    assert got.where(F.col("cap") > F.col("rev")).count() == 0
    assert got.where(F.col("cap") > SPEC_B.cap_micros).count() == 0
    assert got.where(F.col("rev").isNull() != F.col("cap").isNull()).count() == 0


def test_command_line_run_writes_the_hour(spark, lake, tmp_path):
    from adfunnel.run import main
    sink = str(tmp_path / "cli")
    main(["--spec", "B", "--dt", START, "--end", END, "--facts", lake, "--dims", lake,
          "--sink", sink])
    written = spark.read.parquet(sink)
    direct = experiment_report(read_facts(spark, lake), read_dims(spark, lake), SPEC_B, START,
                               END, per_hour=True)
    assert written.count() == direct.count() > 0
    assert written.select(direct.columns).exceptAll(direct).count() == 0
