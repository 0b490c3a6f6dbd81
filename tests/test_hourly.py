"""Hour-by-hour incremental runner: catch-up writes missing hours only, idempotently."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from adfunnel import SPEC_A, SPEC_B, experiment_report, write_hours
from adfunnel.sources import check_hours, read_facts, read_table
from adfunnel.functions.hours import dt_hours
from adfunnel.sources.scan import FACT_TABLES, hour_range
from adfunnel.sources.derived import derive_dims, derive_facts
from adfunnel.streaming import catch_up, report_for_hour, report_template, written_hours

from tables_at import SF_SMALL  # noqa: E402


def test_catch_up_writes_each_pending_hour_once(spark, tmp_path):
    sink = str(tmp_path / "hourly")
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    first = catch_up(spark, facts, dims, SPEC_A, "2024-01-02T00", "2024-01-02T12", sink)
    assert first and written_hours(spark, sink) == set(first)
    reported = {r.dt for r in spark.read.parquet(sink).select("dt").distinct().collect()}
    assert reported and reported <= set(first)
    assert catch_up(spark, facts, dims, SPEC_A, "2024-01-02T00", "2024-01-02T12", sink) == []
    more = catch_up(spark, facts, dims, SPEC_A, "2024-01-02T00", "2024-01-03T00", sink)
    assert more and not set(more) & set(first)
    # each written hour equals a one-hour run of the report
    hour = sorted(reported)[0]
    written = spark.read.parquet(sink).where(F.col("dt") == hour).drop("dt")
    direct = experiment_report(facts, dims, SPEC_A, hour)
    assert written.count() == direct.count()
    assert written.select(direct.columns).exceptAll(direct).count() == 0


def test_template_hour_equals_direct_run_and_prunes(spark):
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    template = report_template(facts, dims, SPEC_A)
    for hour in ("2024-01-02T05", "2024-01-03T17"):
        a = report_for_hour(template, hour)
        b = experiment_report(facts, dims, SPEC_A, hour)
        assert a.columns == b.columns
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    plan = a.sparkSession._jvm.PythonSQLUtils.explainString(a._jdf.queryExecution(), "extended")
    optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # the hour predicate is pushed onto each of the five fact sources, below the generators
    # (derived facts: onto the events scan feeding each of them)
    pushed = [line for line in optimized.splitlines()
              if "Filter" in line and "= 2024-01-03T17" in line]
    assert len(pushed) >= 5, optimized


def test_catch_up_after_crash_between_write_and_log(spark, tmp_path):
    from adfunnel.streaming import run_hours
    sink = str(tmp_path / "crashed")
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    start, end = "2024-01-04T00", "2024-01-04T12"
    # a run that wrote its report hours but died before logging them
    run_hours(facts, dims, SPEC_A, start, end, sink)
    assert written_hours(spark, sink) == set()
    before = spark.read.parquet(sink).count()
    redone = catch_up(spark, facts, dims, SPEC_A, start, end, sink)
    assert redone and written_hours(spark, sink) == set(redone)
    after = spark.read.parquet(sink)
    assert after.count() == before  # rewritten in place, not appended
    direct = experiment_report(facts, dims, SPEC_A, start, end, per_hour=True)
    assert after.select(direct.columns).exceptAll(direct).count() == 0
    assert direct.exceptAll(after.select(direct.columns)).count() == 0


def test_table_landing_late_gets_its_hours_reported_again(spark, tmp_path):
    sink = str(tmp_path / "late")
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    start, end = "2024-01-02T00", "2024-01-03T00"
    early = replace(facts, **{n: getattr(facts, n).where("false")
                              for n in ("ad_clicks", "view_clicks", "installs", "app_events")})
    assert catch_up(spark, early, dims, SPEC_A, start, end, sink)
    assert catch_up(spark, facts, dims, SPEC_A, start, end, sink)
    direct = experiment_report(facts, dims, SPEC_A, start, end, per_hour=True)
    written = spark.read.parquet(sink).select(direct.columns)
    assert written.exceptAll(direct).count() == 0 and direct.exceptAll(written).count() == 0
    assert catch_up(spark, facts, dims, SPEC_A, start, end, sink) == []


def test_sink_belongs_to_one_experiment(spark, tmp_path):
    sink = str(tmp_path / "one")
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    args = ("2024-01-02T00", "2024-01-02T06", sink)
    assert catch_up(spark, facts, dims, SPEC_A, *args)
    with pytest.raises(ValueError, match="another experiment"):
        catch_up(spark, facts, dims, SPEC_B, *args)


def test_hour_rerun_to_empty_is_cleared(spark, tmp_path):
    sink = str(tmp_path / "empty")
    rows = spark.createDataFrame([("2024-01-01T00", 1), ("2024-01-01T01", 2)], "dt string, k int")
    write_hours(rows, sink, hours=["2024-01-01T00", "2024-01-01T01"])
    write_hours(rows.where("k = 3"), sink, hours=["2024-01-01T00"])
    assert [(r.k, r.dt) for r in spark.read.parquet(sink).collect()] == [(2, "2024-01-01T01")]


def test_renamed_column_raises(spark, tmp_path):
    path = str(tmp_path / "installs")
    facts = derive_facts(spark, SF_SMALL)
    facts.installs.withColumnRenamed("pod_device_model", "device_model").limit(5).write.parquet(path)
    with pytest.raises(ValueError, match="no column pod_device_model"):
        read_table(spark, path, "installs")


HOURS = ("2024-01-02T00", "2024-01-02T06")


def lake(spark, root):
    """The derived facts of a few hours as tables partitioned by hour."""
    facts = derive_facts(spark, SF_SMALL)
    for name in FACT_TABLES:
        hour_range(getattr(facts, name), *HOURS).coalesce(1).write.partitionBy("dt").parquet(f"{root}/{name}")


def one_hour_of(spark, root, name):
    return sorted(p.name.removeprefix("dt=") for p in (root / name).glob("dt=*"))[0]


def test_late_file_of_a_landed_table_gets_its_hour_reported_again(spark, tmp_path):
    root, sink = tmp_path / "facts", str(tmp_path / "sink")
    lake(spark, root)
    dims = derive_dims(spark, SF_SMALL)
    first = catch_up(spark, read_facts(spark, str(root)), dims, SPEC_A, *HOURS, sink)
    assert first and catch_up(spark, read_facts(spark, str(root)), dims, SPEC_A, *HOURS, sink) == []
    hour = one_hour_of(spark, root, "installs")
    more = read_table(spark, str(root / "installs"), "installs").where(F.col("dt") == hour).drop("dt")
    more.coalesce(1).write.mode("append").parquet(str(root / "installs" / f"dt={hour}"))
    facts = read_facts(spark, str(root))
    assert catch_up(spark, facts, dims, SPEC_A, *HOURS, sink) == [hour]
    direct = experiment_report(facts, dims, SPEC_A, *HOURS, per_hour=True)
    written = spark.read.parquet(sink).select(direct.columns)
    assert written.exceptAll(direct).count() == 0 and direct.exceptAll(written).count() == 0
    # a file taken back counts as well, and so does an hour of which nothing is left
    for f in (root / "installs" / f"dt={hour}").glob("*.parquet"):
        f.unlink()
    assert catch_up(spark, read_facts(spark, str(root)), dims, SPEC_A, *HOURS, sink) == [hour]
    assert catch_up(spark, read_facts(spark, str(root)), dims, SPEC_A, *HOURS, sink) == []


def test_files_of_one_hour_at_odds_with_the_schema_raise(spark, tmp_path):
    root, sink = tmp_path / "facts", str(tmp_path / "sink")
    lake(spark, root)
    check_hours(spark, str(root), dt_hours(*HOURS))
    hours = sorted(p.name.removeprefix("dt=") for p in (root / "installs").glob("dt=*"))
    bad = root / "installs" / f"dt={hours[-1]}"
    rows = spark.read.parquet(str(bad))
    rows.withColumnRenamed("pod_device_model", "device_model").coalesce(1).write.parquet(str(tmp_path / "renamed"))
    for f in list(bad.glob("*.parquet")):
        f.unlink()
    for f in (tmp_path / "renamed").glob("*.parquet"):
        f.rename(bad / f.name)
    with pytest.raises(ValueError, match=f"installs hour {hours[-1]}: no column pod_device_model"):
        check_hours(spark, str(root), dt_hours(*HOURS))
    check_hours(spark, str(root), hours[:-1])  # other hours are not looked at
    check_hours(spark, str(root), ["2031-01-01T00"])  # nor are hours that have not landed
    with pytest.raises(ValueError, match=hours[-1]):  # before anything is written
        catch_up(spark, read_facts(spark, str(root)), derive_dims(spark, SF_SMALL), SPEC_A, *HOURS, sink,
                 check=lambda hours: check_hours(spark, str(root), hours))
    assert written_hours(spark, sink) == set()


def test_files_of_one_hour_with_different_types_raise(spark, tmp_path):
    root = tmp_path / "facts"
    lake(spark, root)
    hour = one_hour_of(spark, root, "installs")
    at = str(root / "installs" / f"dt={hour}")
    rows = spark.read.parquet(at).withColumn("pod_device_model", F.lit(1)).limit(3)
    rows.coalesce(1).write.parquet(str(tmp_path / "typed"))
    for f in (tmp_path / "typed").glob("*.parquet"):
        f.rename(root / "installs" / f"dt={hour}" / f.name)
    with pytest.raises(ValueError, match=f"installs hour {hour}"):
        check_hours(spark, str(root), dt_hours(*HOURS))


def test_every_file_of_a_dimension_is_looked_at(spark, tmp_path):
    path = str(tmp_path / "apps")
    apps = derive_dims(spark, SF_SMALL).apps
    apps.coalesce(1).write.parquet(path)
    assert read_table(spark, path, "apps").count() == apps.count()
    first = apps.columns[0]
    apps.withColumn(first, F.lit(True)).limit(2).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="apps at"):
        read_table(spark, path, "apps")
