"""Narrow read schemas for the fact and dimension tables.

The fact tables are very wide; the report touches ~20 columns of each. Column
pruning is automatic, but Spark does not prune nested fields under ``explode``,
so the assignment array is declared with only the two fields the report reads:
passing these schemas to the reader shrinks ``ReadSchema`` to exactly that.
"""

from __future__ import annotations

from pyspark.sql import types as T

from adfunnel.functions.attribution import ATTRIBUTION, INSTALL, REENG

ASSIGNMENT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("group", T.StructType([T.StructField("id", T.LongType())])),
])
ASSIGNMENTS = T.ArrayType(ASSIGNMENT)

L, S, B = T.LongType(), T.StringType(), T.BooleanType()


def bid_fields(prefix: str, *, assignments: bool = True, campaign: bool = True,
               device_ids: bool = False, target_event: bool = False) -> list[T.StructField]:
    """Bid columns under ``prefix`` (``bid__``, ``impression__bid__`` ...)."""
    cols = [
        ("customer_id", L), ("app_id", L),
        ("bid_request__non_personalized", B), ("bid_request__device__family", S),
        ("creative__ad_format", S), ("creative__type", S),
        ("campaign_tracker", S), ("campaign_tracker_type", S),
        ("app_platform", S), ("ad_group_type", S), ("sk_ad_network_response__version", S),
    ]
    if campaign:
        cols.append(("campaign_id", L))
    if assignments:
        cols.append(("bid_request__ab_test_assignments", ASSIGNMENTS))
    if device_ids:
        cols += [("bid_request__device__platform_specific_id", S),
                 ("bid_request__device__model_data__name", S)]
    if target_event:
        cols.append(("campaign_target_event_id", L))
    return [T.StructField(prefix + name, dtype) for name, dtype in cols]



DT = T.StructField("dt", S)

IMPRESSIONS = T.StructType(
    [DT, T.StructField("at", L), T.StructField("spend_micros", L),
     T.StructField("revenue_micros", L)] + bid_fields("bid__"))

CLICKS = T.StructType(
    [DT, T.StructField("at", L), T.StructField("impression__at", L),
     T.StructField("has_prior_click", B)] + bid_fields("impression__bid__"))

INSTALLS = T.StructType(
    [DT, T.StructField("event_timestamp", L), T.StructField("ad_click__at", L),
     T.StructField("ad_click__impression__at", L), T.StructField("is_viewthrough", B),
     T.StructField("for_reporting", B), T.StructField("is_uncredited", B),
     T.StructField("tracker_params__idfa", S), T.StructField("tracker_params__match_type", S),
     T.StructField("pod_device_model", S), T.StructField("skan_params__version", S)]
    + bid_fields("ad_click__impression__bid__", device_ids=True))


def _touch_fields(touch: str) -> list[T.StructField]:
    first_two = touch in (INSTALL, REENG)
    return ([T.StructField(touch + "at", L), T.StructField(touch + "impression__at", L),
             T.StructField(touch + "impression__auction_id", S)]
            + bid_fields(touch + "impression__bid__", assignments=first_two,
                         device_ids=touch == INSTALL, target_event=first_two))


APP_EVENTS = T.StructType(
    [DT, T.StructField("event_timestamp", L), T.StructField("install__at", L),
     T.StructField("install__tracker_params__idfa", S),
     T.StructField("install__tracker_params__match_type", S),
     T.StructField("pod_device_model", S), T.StructField("skan_params__version", S),
     T.StructField("is_viewthrough", B), T.StructField("for_reporting", B),
     T.StructField("first_occurrence", B), T.StructField("is_uncredited", B),
     T.StructField("custom_event_id", L), T.StructField("customer_revenue_micros", L)]
    + _touch_fields(INSTALL) + _touch_fields(REENG) + _touch_fields(ATTRIBUTION))

CUSTOMERS = T.StructType([T.StructField("id", L), T.StructField("company", S)])
APPS = T.StructType([T.StructField("id", L), T.StructField("customer_id", L),
                     T.StructField("display_name", S),
                     T.StructField("salesforce_account_level", S)])
AB_TEST_GROUPS = T.StructType([T.StructField("id", L), T.StructField("name", S)])
CAMPAIGNS = T.StructType([T.StructField("id", L), T.StructField("display_name", S),
                          T.StructField("current_optimization_state", S)])

FACT_SCHEMAS = {
    "impressions": IMPRESSIONS, "ad_clicks": CLICKS, "view_clicks": CLICKS,
    "installs": INSTALLS, "app_events": APP_EVENTS,
}
DIM_SCHEMAS = {
    "customers": CUSTOMERS, "apps": APPS, "ab_test_groups": AB_TEST_GROUPS,
    "campaigns": CAMPAIGNS,
}
