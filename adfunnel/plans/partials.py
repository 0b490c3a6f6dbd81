"""Reports of any range from stored hourly partials.

Every measure of the report is a sum, so hours add up; only the revenue cap does not, for
it applies to a per-auction group's total over the whole range. Such a group's key holds
its event hour, so of all hours just one, the event hour itself, can see it on time; a group
straddles hours only if some of its events landed late. Per hour this module stores

* ``auctions``: the per-auction totals, each marked ``late`` where the event hour is not ``dt``,
* ``late``: the late ones again, by themselves,
* ``base``: the report sums by id keys of everything but the late groups.

A range report adds the ``base`` rows up and brings in the late groups: their totals over
the range, together with their on-time part (found by a semi-join on the group's hash, in the
hours that late groups name), are capped anew, less what ``base`` counted for the on-time part.
No fact table is read, and on-time groups without a late part are never looked at again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.functions.hours import bucket_from_iso, dt_add, dt_hours, dt_of_bucket
from adfunnel.functions.money import capped, squared_capped
from adfunnel.operators.branches import canonical, event_measures, funnel_keys
from adfunnel.operators.revenue import capped_revenue_rows, per_auction_totals
from adfunnel.plans.funnel import row_branches, scoped, union_all
from adfunnel.plans.report import aggregate_report, named_report, report_keys, report_row_measures
from adfunnel.sources.scan import hour_range
from adfunnel.sources.sink import write_hours
from adfunnel.spec import Dims, ExperimentSpec, Facts

HOUR = ("dt",)


def _auction_keys(spec: ExperimentSpec) -> list[str]:
    return ["auction_id", *funnel_keys(spec)]


def _is_late() -> Column:
    """Whether an event hour is not the hour its events landed in; no event hour is late."""
    on_time = F.col("at_h") == bucket_from_iso(F.concat("dt", F.lit(":00:00Z")))
    return ~F.coalesce(on_time, F.lit(False))


def write_partials(facts: Facts, spec: ExperimentSpec, root: str,
                   start: str | None = None, end: str | None = None) -> None:
    """Store the partials of ``start <= dt < end`` below ``root``, replacing those hours.

    Hours of the range without a row are cleared (without ``start``, hours of the facts are
    replaced and no other is touched). ``base`` is written last, from the stored totals: the
    events are read and rolled up once. A root belongs to one spec.
    """
    spark = facts.app_events.sparkSession
    hours = None if start is None else dt_hours(start, end or dt_add(start, 1))
    f = scoped(facts, start, end)
    totals = per_auction_totals(f.app_events, spec, HOUR).withColumns(
        {"late": _is_late(), "group_hash": F.xxhash64(*_auction_keys(spec))})
    write_hours(totals, f"{root}/auctions", hours=hours)
    stored = _read(spark, f"{root}/auctions", start, end)
    if stored is None:
        stored = spark.createDataFrame([], totals.schema)
    write_hours(stored.where("late"), f"{root}/late", hours=hours)
    on_time = capped_revenue_rows(stored.where(~F.col("late")), spec, HOUR)
    rows = union_all([*row_branches(f, spec, HOUR).values(), on_time])
    write_hours(aggregate_report(rows, spec, per_hour=True), f"{root}/base", hours=hours)


def late_rows(late: DataFrame, auctions: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """Funnel rows that bring late per-auction groups into sums of ``base``.

    One row per late group of the range: its cap over all its hours, less the cap of its
    on-time part; its other measures, where carried, are those of its late parts. Groups whose
    hash meets a late group's by chance add nothing.
    """
    wanted = late.select("group_hash", dt_of_bucket("at_h").alias("dt")).distinct()
    on_time = auctions.where(~F.col("late")).join(wanted, ["dt", "group_hash"], "left_semi")
    revenue = F.col("customer_revenue_micros")
    parts = late.unionByName(on_time)
    groups = parts.groupBy(*_auction_keys(spec)).agg(
        F.sum(revenue).alias("total"), F.sum(F.when(~F.col("late"), revenue)).alias("counted"),
        F.bool_or("late").alias("any_late"),
        *[F.sum(F.when(F.col("late"), F.col(m))).alias(m) for m in event_measures(spec)])
    groups = groups.where("any_late")

    def more(cap) -> Column:
        counted = F.when(F.col("counted").isNull(), 0).otherwise(cap(F.col("counted"), spec.cap_micros))
        return cap(F.col("total"), spec.cap_micros) - counted

    measures = {"capped_customer_revenue_micros": more(capped),
                "squared_capped_customer_revenue": more(squared_capped)}
    if spec.carry_event_metrics:
        measures.update({m: F.col(m) for m in event_measures(spec)})
    return canonical(groups, spec, {}, measures)


def _read(spark: SparkSession, path: str, start: str | None, end: str | None) -> DataFrame | None:
    """Stored hours; None before any hour had a row (there is no file to take a schema from)."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path) or not any("dt=" in s.getPath().getName() for s in fs.listStatus(fs_path)):
        return None
    rows = spark.read.parquet(path)
    # partition values are read as what they look like; hours are strings
    return hour_range(rows.withColumn("dt", F.col("dt").cast("string")), start, end)


def report_from_partials(spark: SparkSession, root: str, dims: Dims, spec: ExperimentSpec,
                         start: str | None = None, end: str | None = None) -> DataFrame:
    """The report of ``start <= dt < end`` (all stored hours if None) from its partials.

    Equals ``experiment_report`` over the same range, cap included. Raises where nothing
    was stored.
    """
    keys, measures = report_keys(spec), list(report_row_measures(spec))
    base = _read(spark, f"{root}/base", start, end)
    late = _read(spark, f"{root}/late", start, end)
    parts = [] if base is None else [base.select(*keys, *measures)]
    if late is not None:
        rows = late_rows(late, _read(spark, f"{root}/auctions", start, end), spec)
        parts.append(rows.select(*keys, *[v.alias(k) for k, v in report_row_measures(spec).items()]))
    if not parts:
        raise ValueError(f"no partials below {root}")
    by_ids = union_all(parts).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    return named_report(by_ids, dims, spec)
