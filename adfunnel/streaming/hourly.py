"""Hour-by-hour incremental reporting.

The report is an hourly job: each run covers one ``dt``. Catching up many hours
is one Spark job over all of them (``per_hour=True`` keeps every hour its own
report and its own revenue cap), written with dynamic partition overwrite so a
re-run, or a retry after executor loss, replaces exactly those hours.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.functions.hours import dt_hours
from adfunnel.plans.report import experiment_report
from adfunnel.sources.landed import LOG_SCHEMA, changed_hours, landed_files, last_manifests, read_log
from adfunnel.sources.sink import write_hours
from adfunnel.spec import Dims, ExperimentSpec, Facts

FACT_NAMES = ("impressions", "ad_clicks", "view_clicks", "installs", "app_events")


def hourly_report(facts: Facts, dims: Dims, spec: ExperimentSpec, start: str,
                  end: str) -> DataFrame:
    """One report per ``dt`` in ``[start, end)``, as a single DataFrame with ``dt``."""
    return experiment_report(facts, dims, spec, start, end, per_hour=True)


def report_template(facts: Facts, dims: Dims, spec: ExperimentSpec) -> DataFrame:
    """The per-hour report over every hour of ``facts``, built once.

    Select hours with :func:`report_for_hour` (or ``.where`` on ``dt``): ``dt`` is a
    grouping key at every level, so Catalyst pushes the predicate through both
    aggregates, the union, the joins and the generators down to a partition filter on
    each fact scan. Each run reads only its hours, while the plan is built and
    analyzed once per process instead of once per hour.
    """
    return experiment_report(facts, dims, spec, per_hour=True)


def report_for_hour(template: DataFrame, dt: str) -> DataFrame:
    """One hour of a :func:`report_template`: the reference's hourly output (no ``dt``)."""
    return template.where(F.col("dt") == dt).drop("dt")


def run_hours(facts: Facts, dims: Dims, spec: ExperimentSpec, start: str, end: str,
              sink: str, write: Callable[..., object] = write_hours) -> None:
    """Compute and write the hourly reports of ``[start, end)``; hours without a report
    row are cleared in the sink. ``write`` is ``write_hours`` or ``commit_hours``."""
    write(hourly_report(facts, dims, spec, start, end), sink, hours=dt_hours(start, end))


def spec_identity(spec: ExperimentSpec) -> str:
    """The fields of a spec that change its report, as one string."""
    fields = {k: v for k, v in asdict(spec).items() if k not in ("control_group", "test_group")}
    return json.dumps(fields, sort_keys=True)


def _log_path(sink: str) -> str:
    # Leading underscore: readers of the report skip it.
    return f"{sink}/_landed_files"


def written_hours(spark: SparkSession, sink: str) -> set[str]:
    """Hours already processed into the sink, including hours whose report was empty
    (one small row per hour reaches the driver)."""
    log = read_log(spark, _log_path(sink))
    return set() if log is None else {r.dt for r in log.select("dt").distinct().collect()}


def catch_up(spark: SparkSession, facts: Facts, dims: Dims, spec: ExperimentSpec,
             start: str, end: str, sink: str, check: Callable[[list[str]], None] | None = None,
             write: Callable[..., object] = write_hours) -> list[str]:
    """Write the hours of ``[start, end)`` whose facts are not (fully) in their report yet.

    Returns the hours written. The sink keeps, per hour, the manifest of the fact files that
    its report was made from; an hour is pending while a file has landed, changed or gone
    since, be it of a new table or one more file of a table that had landed. ``check`` is
    called with the pending hours before anything is written (for example
    ``lambda hours: check_hours(spark, root, hours)``). Manifests are compared in Spark;
    only hours (one row each) reach the driver. A sink belongs to one experiment. ``write`` is
    ``write_hours`` or, for a sink with versions, ``commit_hours``.
    """
    log = read_log(spark, _log_path(sink))
    run = 0
    if log is not None:
        seen = log.groupBy("spec").agg(F.max("run").alias("run")).collect()  # one row
        others = [r.spec for r in seen if r.spec != spec_identity(spec)]
        if others:
            raise ValueError(f"{sink} holds the reports of another experiment ({others[0]}); "
                             "give each experiment its own sink")
        run = max((r.run for r in seen), default=-1) + 1
        log = last_manifests(log.where((F.col("dt") >= start) & (F.col("dt") < end)))
    landed = landed_files(facts, FACT_NAMES, start, end)
    pending = changed_hours(landed, log)
    if not pending:
        return []
    if check:
        check(pending)
    keep = Facts(**{name: getattr(facts, name).where(F.col("dt").isin(pending))
                    for name in FACT_NAMES})
    write(hourly_report(keep, dims, spec, pending[0], end), sink, hours=pending)
    # Logged only after the report hours are committed: a failure before this point leaves
    # them pending, and the rerun overwrites them. An hour without a file left is logged
    # with an empty manifest.
    hours = spark.createDataFrame([(h,) for h in pending], "dt string")
    manifest = hours.join(landed, "dt", "left").withColumns({"spec": F.lit(spec_identity(spec)), "run": F.lit(run)})
    manifest.select(*[c.split(" ")[0] for c in LOG_SCHEMA.split(", ")]).coalesce(1) \
        .write.mode("append").parquet(_log_path(sink))
    return pending
