"""Row-level funnel branches on one canonical schema.

Each builder filters one fact table, expands its assignments to the spec's test,
and projects every row onto the funnel's key columns plus per-row measures
(an impression row carries ``impressions = 1``, an install row its reported /
unreported flags, ...). The funnel and the report are SUMs over these rows, so
a branch never needs its own aggregation: one aggregate over the union does the
work of the reference's per-branch GROUP BYs, with one shuffle instead of four.

Hours are carried as bucket longs (``*_h``); :func:`format_hours` turns them into
the report's ISO strings on result rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.functions.attribution import ad_format_class, match_flag_columns
from adfunnel.functions.hours import hour_bucket, iso_from_bucket
from adfunnel.operators.expand import assigned
from adfunnel.operators.filters import credited, first_click, segment_condition, skan_compatible
from adfunnel.spec import ExperimentSpec

HOUR_BUCKETS = {"impression_h": "impression_at", "click_h": "click_at",
                "install_h": "install_at", "at_h": "at"}
QUALITY_COLUMNS = ("idfa_match", "idfa_missing", "match_type",
                   "bidrequest_normalized_device_model", "normalized_device_model_match",
                   "unknown_device_model")
# The marker for columns a branch does not have.
NOT_APPLICABLE = "N/A"


def funnel_keys(spec: ExperimentSpec, extra_keys: Sequence[str] = ()) -> list[str]:
    """Funnel grain in reference column order (hours as bucket columns)."""
    keys = ["impression_h", "click_h", "install_h", "at_h", "ab_test_group_id", "customer_id",
            "dest_app_id", "non_personalized", "is_viewthrough", "device_family", "ad_format",
            "creative_type", *QUALITY_COLUMNS, "MMPs"]
    if spec.by_campaign:
        keys.append("campaign_id")
    return [*extra_keys, *spec.lead, *keys]


def event_measures(spec: ExperimentSpec) -> list[str]:
    out = ["target_events"]
    if spec.first_events:
        out.append("target_events_first")
    return out + ["unreported_target_events", "customer_revenue_micros",
                  "unreported_customer_revenue_micros"]


def funnel_measures(spec: ExperimentSpec) -> list[str]:
    return (["impressions", "spend_micros", "revenue_micros", "clicks", "installs",
             "unreported_installs"] + event_measures(spec)
            + ["capped_customer_revenue_micros", "squared_capped_customer_revenue"])


def canonical(df: DataFrame, spec: ExperimentSpec, keys: dict[str, Column],
              measures: dict[str, Column], extra_keys: Sequence[str] = ()) -> DataFrame:
    """Project onto the funnel schema: keys, then measures; absent measures are 0."""
    cols = []
    for name in funnel_keys(spec, extra_keys):
        cols.append((keys[name] if name in keys else F.col(name)).alias(name))
    for name in funnel_measures(spec):
        dtype = "double" if name == "squared_capped_customer_revenue" else "long"
        if name in measures:
            cols.append(measures[name].cast(dtype).alias(name))
        else:
            cols.append(F.lit(0).cast(dtype).alias(name))
    return df.select(*cols)


def _not_applicable() -> dict[str, Column]:
    return {name: F.lit(NOT_APPLICABLE) for name in QUALITY_COLUMNS}


def _bid_keys(prefix: str, spec: ExperimentSpec) -> dict[str, Column]:
    keys = {
        "customer_id": F.col(prefix + "customer_id"),
        "dest_app_id": F.col(prefix + "app_id"),
        "non_personalized": F.col(prefix + "bid_request__non_personalized").cast("string"),
        "device_family": F.col(prefix + "bid_request__device__family"),
        "ad_format": ad_format_class(F.col(prefix + "creative__ad_format")),
        "creative_type": F.col(prefix + "creative__type"),
        "MMPs": F.col(prefix + "campaign_tracker"),
    }
    if spec.by_campaign:
        keys["campaign_id"] = spec.campaign(F.col(prefix + "campaign_id"))
    return keys


def _bid_rows(df: DataFrame, prefix: str, spec: ExperimentSpec) -> DataFrame:
    """Rows of the bid's assignments to the spec's test, in its segment.

    The segment is tested after the expansion, where a spec of many reports knows the report;
    Catalyst moves tests against constants below the generator, and the values that any
    report asks for are tested on the table itself.
    """
    for column, values in spec.segments.items():
        df = df.where(F.col(prefix + column).isin(values))
    rows = assigned(df, F.col(prefix + "bid_request__ab_test_assignments"), spec)
    return rows.where(segment_condition(F.col(prefix + "campaign_tracker_type"),
                                        F.col(prefix + "ad_group_type"),
                                        F.col(prefix + "app_platform"), spec))


def impression_rows(impressions: DataFrame, spec: ExperimentSpec,
                    extra_keys: Sequence[str] = ()) -> DataFrame:
    p = "bid__"
    kept = impressions.where(skan_compatible(F.col(p + "sk_ad_network_response__version")))
    rows = _bid_rows(kept, p, spec)
    hour = hour_bucket(F.col("at"))
    keys = {"impression_h": hour, "click_h": F.lit(None).cast("long"),
            "install_h": F.lit(None).cast("long"), "at_h": hour,
            "is_viewthrough": F.lit(NOT_APPLICABLE), **_bid_keys(p, spec), **_not_applicable()}
    measures = {"impressions": F.lit(1), "spend_micros": F.col("spend_micros"),
                "revenue_micros": F.col("revenue_micros")}
    return canonical(rows, spec, keys, measures, extra_keys)


def click_rows(clicks: DataFrame, spec: ExperimentSpec,
               extra_keys: Sequence[str] = ()) -> DataFrame:
    """Ad clicks and view clicks share this builder; both count into ``clicks``."""
    p = "impression__bid__"
    kept = first_click(clicks).where(
        skan_compatible(F.col(p + "sk_ad_network_response__version")))
    rows = _bid_rows(kept, p, spec)
    click_hour = hour_bucket(F.col("at"))
    keys = {"impression_h": hour_bucket(F.col("impression__at")), "click_h": click_hour,
            "install_h": F.lit(None).cast("long"), "at_h": click_hour,
            "is_viewthrough": F.lit(NOT_APPLICABLE), **_bid_keys(p, spec), **_not_applicable()}
    return canonical(rows, spec, keys, {"clicks": F.lit(1)}, extra_keys)


def install_rows(installs: DataFrame, spec: ExperimentSpec,
                 extra_keys: Sequence[str] = ()) -> DataFrame:
    p = "ad_click__impression__bid__"
    kept = credited(installs).where(
        skan_compatible(F.col("skan_params__version"),
                        F.col(p + "sk_ad_network_response__version")))
    rows = _bid_rows(kept, p, spec)
    install_hour = hour_bucket(F.col("event_timestamp"))
    flags = match_flag_columns(
        F.col("tracker_params__idfa"), F.col(p + "bid_request__device__platform_specific_id"),
        F.col("tracker_params__match_type"), F.col(p + "bid_request__device__model_data__name"),
        F.col("pod_device_model"))
    keys = {"impression_h": hour_bucket(F.col("ad_click__impression__at")),
            "click_h": hour_bucket(F.col("ad_click__at")), "install_h": install_hour,
            "at_h": install_hour, "is_viewthrough": F.col("is_viewthrough").cast("string"),
            **_bid_keys(p, spec), **flags}
    reporting = F.col("for_reporting")
    measures = {"installs": F.when(reporting, 1).otherwise(0),
                "unreported_installs": F.when(~reporting, 1).otherwise(0)}
    return canonical(rows, spec, keys, measures, extra_keys)


def format_hours(df: DataFrame) -> DataFrame:
    """Replace every ``*_h`` bucket column by its ISO-hour string, in place."""
    cols = [iso_from_bucket(F.col(c)).alias(HOUR_BUCKETS[c]) if c in HOUR_BUCKETS else F.col(c)
            for c in df.columns]
    return df.select(*cols)


def sum_measures(measures: Sequence[str]) -> list[Column]:
    return [F.sum(m).alias(m) for m in measures]


def aggregate_branch(rows: DataFrame, spec: ExperimentSpec,
                     extra_keys: Sequence[str] = ()) -> DataFrame:
    """One funnel branch at the reference's funnel grain, hours as ISO strings."""
    keys = funnel_keys(spec, extra_keys)
    return format_hours(rows.groupBy(*keys).agg(*sum_measures(funnel_measures(spec))))


def impression_branch(impressions: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return aggregate_branch(impression_rows(impressions, spec), spec)


def click_branch(clicks: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return aggregate_branch(click_rows(clicks, spec), spec)


def install_branch(installs: DataFrame, spec: ExperimentSpec) -> DataFrame:
    return aggregate_branch(install_rows(installs, spec), spec)
