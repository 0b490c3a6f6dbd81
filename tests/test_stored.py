"""Reports from stored forms of the facts: bucketed events, hourly partials."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from adfunnel import SPEC_A, SPEC_B, experiment_report
from adfunnel.operators.revenue import per_auction_totals
from adfunnel.plans.partials import report_from_partials, write_partials
from adfunnel.sources.bucketed import bucket_count, read_bucketed_events, write_bucketed_events
from adfunnel.sources.derived import derive_dims, derive_facts
from adfunnel.sources.scan import FACT_TABLES, hour_range, read_dims, read_facts
from tables_at import SF_CHECK

START, END = "2024-01-03T00", "2024-01-04T00"


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Two days of facts; a third of the app events lack an auction id, and each event of
    some more landed a second time one hour later (so that auction groups straddle hours)."""
    root = str(tmp_path_factory.mktemp("lake"))
    facts = derive_facts(spark, SF_CHECK)
    auction = [c for c in facts.app_events.columns if c.endswith("impression__auction_id")]
    none = F.pmod(F.xxhash64("event_timestamp"), F.lit(3)) == 0
    events = facts.app_events.withColumns({c: F.when(~none, F.col(c)) for c in auction})
    next_hour = F.date_format(F.to_timestamp("dt", "yyyy-MM-dd'T'HH") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH")
    events = events.unionByName(events.where(F.pmod(F.xxhash64("event_timestamp"), F.lit(4)) == 1)
                                .withColumn("dt", next_hour))
    for name in FACT_TABLES:
        df = events if name == "app_events" else getattr(facts, name)
        df.where(F.col("dt").between("2024-01-02T12", "2024-01-04T12")).coalesce(4) \
            .write.partitionBy("dt").parquet(f"{root}/{name}")
    dims = derive_dims(spark, SF_CHECK)
    for name in ("customers", "apps", "ab_test_groups", "campaigns"):
        getattr(dims, name).write.parquet(f"{root}/{name}")
    return root


def same(got, want):
    assert got.columns == want.columns
    cells = [F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
    a, b = got.select(*cells).collect(), want.select(*cells).collect()
    assert len(b) > 0 and sorted(map(str, a)) == sorted(map(str, b))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def bucketed(spark, lake, tmp_path_factory):
    facts = read_facts(spark, lake)
    path = str(tmp_path_factory.mktemp("bucketed") / "events")
    write_bucketed_events(facts.app_events, "events_by_slot", 4, path)
    yield replace(facts, app_events=read_bucketed_events(spark, "events_by_slot"))
    spark.sql("DROP TABLE events_by_slot")


@pytest.mark.parametrize("spec, per_hour", [(SPEC_A, True), (SPEC_B, False)], ids="AB")
def test_bucketed_events_need_one_exchange(spark, lake, bucketed, spec, per_hour):
    dims = read_dims(spark, lake)
    got = experiment_report(bucketed, dims, spec, START, END, per_hour)
    same(got, experiment_report(read_facts(spark, lake), dims, spec, START, END, per_hour))
    plan = final_plan(got)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1, plan
    assert "Bucketed: true" in plan


def test_events_without_an_auction_id_spread_over_the_buckets(spark, bucketed):
    f = bucketed.app_events.where("install__ad_click__impression__auction_id IS NULL "
                                  "AND reeng_click__impression__auction_id IS NULL "
                                  "AND attribution_event__click__impression__auction_id IS NULL")
    n = {r.b: r["count"] for r in f.groupBy(F.pmod(F.hash("auction_slot"), F.lit(4)).alias("b")).count().collect()}
    assert len(n) == 4 and max(n.values()) < 0.5 * sum(n.values())


def test_bucketed_hours_are_replaced(spark, lake, tmp_path):
    events = read_facts(spark, lake).app_events
    write_bucketed_events(events.where(F.col("dt") < START), "some_events", 4, str(tmp_path / "t"))
    try:
        before = spark.table("some_events").count()
        write_bucketed_events(events.where(F.col("dt") >= START), "some_events", 99)
        write_bucketed_events(events.where(F.col("dt") >= START), "some_events", 99)
        assert 0 < before < spark.table("some_events").count() == events.count()
        assert bucket_count(spark, "some_events") == 4
        plain = [c for c, t in events.dtypes if not t.startswith("array")]
        a, b = read_bucketed_events(spark, "some_events").select(plain), events.select(plain)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    finally:
        spark.sql("DROP TABLE some_events")


def test_bucketed_files_do_not_grow_with_the_hours(spark, bucketed):
    """Days x buckets files (writers may split some), not one for each hour and bucket."""
    hours = bucketed.app_events.select("dt").distinct().count()
    files = len(bucketed.app_events.inputFiles())
    assert hours > 40 and files <= 3 * 4  # three days, four buckets


@pytest.mark.parametrize("by", ["day", "hour"])
def test_an_hour_is_replaced_and_the_rest_of_its_day_kept(spark, lake, tmp_path, by):
    events = read_facts(spark, lake).app_events.where(F.col("dt").between("2024-01-02T20", "2024-01-03T04"))
    unknown = events.limit(5).withColumn("dt", F.lit(None).cast("string"))
    events = events.unionByName(unknown).localCheckpoint()
    one = F.col("dt").eqNullSafe("2024-01-03T02") | F.col("dt").isNull()
    again = events.where(one & (F.col("event_timestamp") % 2 == 0)).unionByName(events.where(one).limit(1))
    again = again.localCheckpoint()
    table, held = f"one_hour_{by}", [r.dt for r in again.select("dt").distinct().collect()]
    write_bucketed_events(events, table, 2, str(tmp_path / "t"), by)
    try:
        write_bucketed_events(again, table, 2)
        plain = [c for c, t in events.dtypes if not t.startswith("array")]
        replaced = F.lit(False)
        for dt in held:
            replaced = replaced | F.col("dt").eqNullSafe(dt)
        want = events.where(~replaced).unionByName(again).select(plain)
        got = read_bucketed_events(spark, table).select(plain)
        assert 0 < again.count() < got.count() == want.count() < events.count()
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    finally:
        spark.sql(f"DROP TABLE {table}")


def test_ranges_read_the_days_they_need(spark, bucketed):
    hours = hour_range(bucketed.app_events, "2024-01-03T05", "2024-01-03T07")
    want = bucketed.app_events.where("dt IN ('2024-01-03T05', '2024-01-03T06')").count()
    assert hours.count() == want > 0
    filters = re.search(r"PartitionFilters: \[(.*?)\]", final_plan(hours)).group(1)
    assert "dt_day" in filters and "2024-01-03" in filters


def test_a_table_without_slots_raises(spark, tmp_path):
    spark.range(3).write.option("path", str(tmp_path / "t")).saveAsTable("no_slots")
    try:
        with pytest.raises(ValueError, match="not bucketed"):
            read_bucketed_events(spark, "no_slots")
    finally:
        spark.sql("DROP TABLE no_slots")


@pytest.mark.parametrize("spec", [SPEC_A, replace(SPEC_B, carry_event_metrics=True)], ids="AB")
def test_range_reports_from_partials(spark, lake, tmp_path, spec):
    facts, dims, root = read_facts(spark, lake), read_dims(spark, lake), str(tmp_path / "partials")
    write_partials(facts, spec, root, "2024-01-02T12", START)
    write_partials(facts, spec, root, START, "2024-01-04T20")
    for start, end in [(None, None), (START, END), ("2024-01-02T20", "2024-01-03T05")]:
        got = report_from_partials(spark, root, dims, spec, start, end)
        same(got, experiment_report(facts, dims, spec, start or "2024-01-02T12", end or "2024-01-04T20"))
        assert "customer_revenue_micros" not in " ".join(  # facts are not read
            x for x in re.findall(r"ReadSchema: (.*)", final_plan(got)) if "reeng_click" in x)


def test_groups_do_straddle_hours(spark, lake):
    """The fixture has what the partials are about: caps that bind only over several hours."""
    facts = read_facts(spark, lake)
    cap = F.sum(F.least("customer_revenue_micros", F.lit(SPEC_B.cap_micros)))
    ranged = per_auction_totals(facts.app_events, SPEC_B).agg(cap).first()[0]
    hourly = per_auction_totals(facts.app_events, SPEC_B, ("dt",)).agg(cap).first()[0]
    assert ranged < hourly


def test_partials_of_a_rerun_hour_are_replaced(spark, lake, tmp_path):
    facts, dims, root = read_facts(spark, lake), read_dims(spark, lake), str(tmp_path / "partials")
    write_partials(facts, SPEC_A, root, START, "2024-01-03T10")
    fewer = replace(facts, app_events=facts.app_events.where("customer_revenue_micros % 2 = 0"),
                    impressions=facts.impressions.where("false"))
    write_partials(fewer, SPEC_A, root, START, "2024-01-03T10")
    same(report_from_partials(spark, root, dims, SPEC_A), experiment_report(fewer, dims, SPEC_A, START, "2024-01-03T10"))


def test_no_partials(spark, lake, tmp_path):
    facts, dims, root = read_facts(spark, lake), read_dims(spark, lake), str(tmp_path / "partials")
    write_partials(facts, SPEC_A, root, "2030-01-01T00", "2030-01-01T02")
    with pytest.raises(ValueError, match="no partials"):
        report_from_partials(spark, root, dims, SPEC_A)
