"""In-app event revenue: per-auction rollup, outlier gate and cap.

The cap applies to each per-auction group's *total* (a group is auction x hour
stamps x test group x dimensions), so that rollup is a real aggregation and
costs the pipeline's one extra shuffle. Spark's partial aggregation combines rows
map-side before the exchange, so a hot group (say a NULL auction id holding a
third of all events) leaves each map task as a single partial row; the final
aggregate never sees the raw rows of a hot key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.functions.attribution import (
    ATTRIBUTION_FIRST, INSTALL, INSTALL_FIRST, INSTALL_OR_REENG, ad_format_class, any_touch,
    match_flag_columns, touch_coalesce,
)
from adfunnel.functions.hours import hour_bucket
from adfunnel.functions.money import capped, revenue_gate, squared_capped
from adfunnel.operators.branches import (
    aggregate_branch, canonical, event_measures, format_hours, funnel_keys,
)
from adfunnel.operators.expand import assigned
from adfunnel.operators.filters import credited, segment_condition, skan_compatible
from adfunnel.spec import ExperimentSpec

BID = "impression__bid__"
# A column of stored events that is a function of every per-auction key (sources/bucketed.py).
AUCTION_SLOT = "auction_slot"


def event_filter(spec: ExperimentSpec) -> Column:
    """SKAN filter of app events, and that some touch is in the segment.

    A first non-NULL touch equal to a value implies that some touch equals it; unlike the
    tests on the coalesced touches (:func:`event_segment`), that reaches the Parquet reader.
    """
    kept = skan_compatible(F.col("skan_params__version"),
                           touch_coalesce(BID + "sk_ad_network_response__version",
                                          ATTRIBUTION_FIRST))
    for column, values in spec.segments.items():
        kept = kept & any_touch(BID + column, values)
    return kept


def event_segment(spec: ExperimentSpec) -> Column:
    """Segment test of app events, each column with its own touch order."""
    return segment_condition(touch_coalesce(BID + "campaign_tracker_type", INSTALL_FIRST),
                             touch_coalesce(BID + "ad_group_type", ATTRIBUTION_FIRST),
                             touch_coalesce(BID + "app_platform", ATTRIBUTION_FIRST), spec)


def event_key_columns(spec: ExperimentSpec) -> dict[str, Column]:
    """Funnel keys of an app event, touch by touch as the report defines them."""
    flags = match_flag_columns(
        F.col("install__tracker_params__idfa"),
        F.col(INSTALL + BID + "bid_request__device__platform_specific_id"),
        F.col("install__tracker_params__match_type"),
        F.col(INSTALL + BID + "bid_request__device__model_data__name"),
        F.col("pod_device_model"))
    keys = {
        "impression_h": hour_bucket(touch_coalesce("impression__at", ATTRIBUTION_FIRST)),
        "click_h": hour_bucket(touch_coalesce("at", ATTRIBUTION_FIRST)),
        "install_h": hour_bucket(F.col("install__at")),
        "at_h": hour_bucket(F.col("event_timestamp")),
        "customer_id": touch_coalesce(BID + "customer_id", INSTALL_FIRST),
        "dest_app_id": touch_coalesce(BID + "app_id", INSTALL_FIRST),
        "non_personalized": touch_coalesce(BID + "bid_request__non_personalized", INSTALL_FIRST)
        .cast("string"),
        "is_viewthrough": F.col("is_viewthrough").cast("string"),
        "device_family": touch_coalesce(BID + "bid_request__device__family", ATTRIBUTION_FIRST),
        "ad_format": ad_format_class(touch_coalesce(BID + "creative__ad_format", INSTALL_FIRST)),
        "creative_type": touch_coalesce(BID + "creative__type", ATTRIBUTION_FIRST),
        **flags,
        "MMPs": touch_coalesce(BID + "campaign_tracker", INSTALL_FIRST),
    }
    if spec.by_campaign:
        keys["campaign_id"] = spec.campaign(touch_coalesce(BID + "campaign_id", ATTRIBUTION_FIRST))
    return keys


def auction_id() -> Column:
    return touch_coalesce("impression__auction_id", INSTALL_FIRST)


def event_measure_columns(spec: ExperimentSpec) -> dict[str, Column]:
    """Per-event target-event flags and gated revenue."""
    reporting = F.col("for_reporting")
    target_event = touch_coalesce(BID + "campaign_target_event_id", INSTALL_OR_REENG)
    target = F.col("custom_event_id") == target_event
    revenue = F.col("customer_revenue_micros")
    out = {"target_events": F.when(reporting & target, 1).otherwise(0)}
    if spec.first_events:
        # Not gated by for_reporting.
        out["target_events_first"] = F.when(target & F.col("first_occurrence"), 1).otherwise(0)
    out["unreported_target_events"] = F.when(~reporting & target, 1).otherwise(0)
    out["customer_revenue_micros"] = revenue_gate(revenue, reporting, spec.revenue_bound)
    out["unreported_customer_revenue_micros"] = revenue_gate(revenue, ~reporting,
                                                             spec.revenue_bound)
    return out


def app_event_rows(app_events: DataFrame, spec: ExperimentSpec,
                   extra_keys: Sequence[str] = ()) -> DataFrame:
    """Credited, in-segment app events expanded to the spec's test, one row each.

    The assignment array is chosen *before* expansion: a non-NULL install array
    hides the re-engagement one even when it lacks the test.
    """
    kept = credited(app_events).where(event_filter(spec))
    rows = assigned(kept, touch_coalesce(BID + "bid_request__ab_test_assignments",
                                         INSTALL_OR_REENG), spec).where(event_segment(spec))
    keys = event_key_columns(spec)
    cols = [F.col(c) for c in extra_keys]
    cols.append(auction_id().alias("auction_id"))
    cols += [(keys[k] if k in keys else F.col(k)).alias(k) for k in funnel_keys(spec)]
    cols += [v.cast("long").alias(k) for k, v in event_measure_columns(spec).items()]
    return rows.select(*cols)


def per_auction_totals(app_events: DataFrame, spec: ExperimentSpec,
                       extra_keys: Sequence[str] = ()) -> DataFrame:
    """Per-auction rollup (hours as buckets): sums of the event measures.

    Events stored with their auction slot are grouped by it as well, which leaves the groups
    as they are and lets a table bucketed on it do without an exchange.
    """
    keys = ["auction_id", *funnel_keys(spec, extra_keys)]
    slot = [AUCTION_SLOT] if AUCTION_SLOT in app_events.columns else []
    return (app_event_rows(app_events, spec, [*extra_keys, *slot]).groupBy(*slot, *keys)
            .agg(*[F.sum(m).alias(m) for m in event_measures(spec)]).drop(*slot))


def per_auction_revenue(app_events: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The reference's per-auction table, with its zero-valued funnel columns."""
    totals = per_auction_totals(app_events, spec)
    zeros = [F.lit(0).cast("long").alias(m) for m in
             ("impressions", "spend_micros", "revenue_micros", "clicks", "installs",
              "unreported_installs")]
    keys = ["auction_id", *funnel_keys(spec)]
    return format_hours(totals.select(*keys, *zeros, *event_measures(spec)))


def capped_revenue_rows(totals: DataFrame, spec: ExperimentSpec,
                        extra_keys: Sequence[str] = ()) -> DataFrame:
    """Funnel rows of the capped-revenue branch, one per per-auction group.

    Feeding these straight into the funnel/report aggregate is exact: every later
    condition depends only on columns constant within the group.
    """
    revenue = F.col("customer_revenue_micros")
    measures = {"capped_customer_revenue_micros": capped(revenue, spec.cap_micros),
                "squared_capped_customer_revenue": squared_capped(revenue, spec.cap_micros)}
    if spec.carry_event_metrics:
        measures.update({m: F.col(m) for m in event_measures(spec)})
    return canonical(totals, spec, {}, measures, extra_keys)


def capped_revenue_branch(app_events: DataFrame, spec: ExperimentSpec) -> DataFrame:
    """The funnel's capped-revenue branch at the funnel grain (hours as ISO strings)."""
    totals = per_auction_totals(app_events, spec)
    return aggregate_branch(capped_revenue_rows(totals, spec), spec)
