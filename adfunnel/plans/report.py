"""The experiment report: funnel rows -> one aggregate -> names.

Plan shape: five fact scans (partition-pruned, narrow) -> filters + generator ->
row projection -> [per-auction partial/final aggregate: exchange 1] -> union ->
report partial/final aggregate [exchange 2] -> broadcast LEFT joins of the names
-> local re-aggregation (no exchange: the join keeps the report's partitioning).

Every report measure is a SUM of a per-row value, and the row-level conditions
(quality metrics, seven-day cohort) depend only on columns that are constant
inside a reference funnel group, so summing rows directly equals the
reference's sum of per-branch group sums, NULL-vs-0 included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.functions.attribution import QUALITY_CONDITIONS
from adfunnel.functions.hours import iso_from_bucket, within_days
from adfunnel.functions.money import to_dollars
from adfunnel.operators.branches import HOUR_BUCKETS, event_measures
from adfunnel.operators.enrich import SPREAD, enrich, name_columns
from adfunnel.plans.funnel import funnel_rows
from adfunnel.spec import Dims, ExperimentSpec, Facts


def report_keys(spec: ExperimentSpec, per_hour: bool = False) -> list[str]:
    keys = ["impression_h", "click_h", "install_h", "ab_test_group_id", "customer_id",
            "dest_app_id", "non_personalized", "is_viewthrough", "ad_format", "creative_type",
            "device_family", "MMPs"]
    if spec.by_campaign:
        keys.append("campaign_id")
    return [*spec.lead, *(["dt"] if per_hour else []), *keys]


def output_columns(spec: ExperimentSpec, per_hour: bool = False) -> list[str]:
    head = ["impression_at", "click_at", "install_at", "ab_test_group_id", "test_group_name",
            "customer_id", "dest_app_id", "non_personalized", "is_viewthrough", "ad_format",
            "creative_type", "device_family", "MMPs"]
    if spec.by_campaign:
        head.append("campaign_id")
    head += ["customer_name", "dest_app_name", "account_level"]
    if spec.by_campaign:
        head += ["current_optimization_state", "campaign_name"]
    return [*spec.lead, *(["dt"] if per_hour else []), *head, *report_measures(spec)]


def report_measures(spec: ExperimentSpec) -> list[str]:
    out = ["impressions", "spend_micros", "revenue_micros", "clicks", "installs",
           "unreported_installs", *event_measures(spec),
           "capped_customer_revenue_micros", "squared_capped_customer_revenue"]
    if spec.d7:
        out += d7_names(spec)
    return out + list(QUALITY_CONDITIONS)


def d7_names(spec: ExperimentSpec) -> list[str]:
    out = ["customer_revenue_d7", "target_events_d7"]
    if spec.first_events:
        out.append("target_events_first_d7")
    return out + ["capped_customer_revenue_d7", "squared_capped_customer_revenue_d7"]


# Cohort sums kept in integer micros until the end (exact, order independent),
# then turned into dollars: cohort column -> (source measure, convert to dollars).
_D7_SOURCES = {
    "customer_revenue_d7": ("customer_revenue_micros", True),
    "target_events_d7": ("target_events", False),
    "target_events_first_d7": ("target_events_first", False),
    "capped_customer_revenue_d7": ("capped_customer_revenue_micros", True),
    "squared_capped_customer_revenue_d7": ("squared_capped_customer_revenue", False),
}


def quality_measures() -> dict[str, Column]:
    """Installs under each quality condition; NULL (not 0) where it fails."""
    return {name: F.when(cond(), F.col("installs")) for name, cond in QUALITY_CONDITIONS.items()}


def d7_measures(spec: ExperimentSpec) -> dict[str, Column]:
    """Per-row seven-day cohort values; outside the window (or no install hour) 0."""
    in_cohort = within_days(F.col("at_h"), F.col("install_h"), spec.cohort_days)
    zero = {"squared_capped_customer_revenue_d7": F.lit(0.0)}
    return {name: F.when(in_cohort, F.col(_D7_SOURCES[name][0]))
            .otherwise(zero.get(name, F.lit(0).cast("long")))
            for name in d7_names(spec)}


def report_row_measures(spec: ExperimentSpec) -> dict[str, Column]:
    plain = ["impressions", "spend_micros", "revenue_micros", "clicks", "installs",
             "unreported_installs", *event_measures(spec),
             "capped_customer_revenue_micros", "squared_capped_customer_revenue"]
    out = {m: F.col(m) for m in plain}
    if spec.d7:
        out.update(d7_measures(spec))
    out.update(quality_measures())
    return out


def aggregate_report(rows: DataFrame, spec: ExperimentSpec, per_hour: bool = False) -> DataFrame:
    """Report sums by id keys (no names yet), hours still buckets, d7 in micros."""
    keys = report_keys(spec, per_hour)
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(k)
                                     for k, v in report_row_measures(spec).items()])


def experiment_report(facts: Facts, dims: Dims, spec: ExperimentSpec,
                      start: str | None = None, end: str | None = None,
                      per_hour: bool = False) -> DataFrame:
    """The A/B-test funnel report for ``start <= dt < end`` (all hours if None).

    ``per_hour=True`` reports each hour separately (a ``dt`` column leads), equal
    to running the report once per hour; otherwise the range is one run, and the
    revenue cap applies to groups spanning several ``dt`` partitions once.
    """
    rows = funnel_rows(facts, spec, start, end, per_hour)
    return named_report(aggregate_report(rows, spec, per_hour), dims, spec, per_hour)


def named_report(by_ids: DataFrame, dims: Dims, spec: ExperimentSpec,
                 per_hour: bool = False) -> DataFrame:
    """Report sums by id keys (:func:`aggregate_report`) with names, in output form."""
    part = F.pmod(F.xxhash64(*report_keys(spec, per_hour)), F.lit(SPREAD)).cast("int")
    named = enrich(by_ids.withColumn("_spread", part), dims, spec, "_spread")
    # Names are keys of the report too. With unique dimension ids this pass only
    # regroups identical rows; with repeated ids it sums them the way the
    # reference's join-then-group does. The join keeps the partitioning on the id
    # keys, a subset of these keys, so no exchange is added. The spread is a function of
    # the id keys; as a key it lets a join hashed on (group, spread) do the same.
    keys = report_keys(spec, per_hour) + ["_spread"] + name_columns(spec)
    measures = list(report_row_measures(spec))
    regrouped = named.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    # one final projection: ISO hour strings, cohort micros to dollars, output order
    finals = {out: iso_from_bucket(F.col(bucket)) for bucket, out in HOUR_BUCKETS.items()}
    finals.update({name: to_dollars(F.col(name)) for name, (_, dollars) in _D7_SOURCES.items()
                   if dollars and name in measures})
    return regrouped.select(*[finals.get(c, F.col(c)).alias(c)
                              for c in output_columns(spec, per_hour)])
