"""

Every query derives the ad-funnel facts from the driver's whole ``events`` table
(and the dimensions from ``customer``/``part``/``nation``/``supplier``), so its
work grows with the data; none runs on a subset. Double-valued results are
rounded to 4 decimals on both sides: money is whole cents, so every square has
at most 4 decimals and only summation order could otherwise differ.
"""

from __future__ import annotations

import importlib
import os
import sys
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

# The package and the oracle live next to this file; make them importable however
# this module is loaded (by path or by name). No Python runs on executors.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from adfunnel import (  # noqa: E402
    SPEC_A, SPEC_B, app_event_rows, build_funnel, capped_revenue_branch, capped_revenue_rows,
    credited, experiment_report, explode_assignments, first_click, hour_range,
    per_auction_revenue, per_auction_totals,
)
from adfunnel.functions import (
    ATTRIBUTION_FIRST, INSTALL_FIRST, INSTALL_OR_REENG, ad_format_class, device_model_match,
    hour_iso, idfa_match, idfa_missing, revenue_gate, touch_coalesce, unknown_device_model,
)
from adfunnel.operators.branches import (
    aggregate_branch, click_rows, format_hours, impression_rows, install_rows,
)
from adfunnel.operators.enrich import enrich
from adfunnel.operators.filters import segment_condition, skan_compatible
from adfunnel.operators.revenue import BID
from adfunnel.plans.funnel import funnel_rows
from adfunnel.plans.many import experiment_reports
from adfunnel.plans.partials import report_from_partials, write_partials
from adfunnel.sources.bucketed import read_bucketed_events, write_bucketed_events
from adfunnel.sources.derived import derive_dims, derive_facts
from oracle.report_sql import (
    MANY_REPORTS, REPORT_A, REPORT_B, ReportSQL, first, fmt_class, hour, quality,
)
from oracle.tables import table_ctes

FLAGSHIP_SF = "/root/testdata/sf0.001"
# A multi-hour backfill window (the reference's hour filter is the feature tested).
RANGE_START, RANGE_END = "2024-01-02T05", "2024-01-09T07"
# Both reports, one of another segment with low limits, one of one-day cohorts.
MANY = (SPEC_A, SPEC_B,
        replace(SPEC_A, platform="ANDROID", cap_micros=3_000_000, revenue_bound=90_000_000),
        replace(SPEC_B, by_campaign=False, cohort_days=1, cap_micros=40_000_000))
I, R, A = "install__ad_click__", "reeng_click__", "attribution_event__click__"


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    # "+ 0.0" turns a rounded -0.0 into 0.0 (signed sums can cancel exactly)
    return df.select(*[(F.round(F.col(f.name), digits) + 0.0).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def _facts(spark: SparkSession, sf: str):
    return derive_facts(spark, sf)


def _report(spec, per_hour=False):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _round(experiment_report(derive_facts(spark, sf), derive_dims(spark, sf), spec,
                                         per_hour=per_hour))
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: report B (campaign, first events, seven-day cohort) on sf0.001."""
    return _report(SPEC_B)(spark, FLAGSHIP_SF)


# --------------------------------------------------------------------------- Spark
def q_hour_range_scan(spark, sf):
    imp = hour_range(_facts(spark, sf).impressions, RANGE_START, RANGE_END)
    return imp.select("dt", "at", "spend_micros", "revenue_micros", "bid__customer_id")


def q_explode_assignments(spark, sf):
    imp = _facts(spark, sf).impressions
    return explode_assignments(imp, F.col("bid__bid_request__ab_test_assignments")).select(
        "at", "bid__customer_id", "ab_test_id", "ab_test_group_id")


def q_coalesced_assignments(spark, sf):
    ev = _facts(spark, sf).app_events
    arr = touch_coalesce(BID + "bid_request__ab_test_assignments", INSTALL_OR_REENG)
    out = explode_assignments(ev, arr, SPEC_A.test_id)
    return out.select("event_timestamp",
                      touch_coalesce("impression__auction_id", INSTALL_FIRST).alias("auction_id"),
                      "ab_test_group_id")


def q_credited_filter(spark, sf):
    return credited(_facts(spark, sf).installs).select(
        "event_timestamp", "is_uncredited", "tracker_params__idfa")


def q_first_click_filter(spark, sf):
    f = _facts(spark, sf)
    return first_click(f.ad_clicks.unionByName(f.view_clicks)).select(
        "at", "impression__at", "has_prior_click")


def q_segment_filter(spark, sf):
    ev = _facts(spark, sf).app_events
    tracker = touch_coalesce(BID + "campaign_tracker_type", INSTALL_FIRST)
    group = touch_coalesce(BID + "ad_group_type", ATTRIBUTION_FIRST)
    platform = touch_coalesce(BID + "app_platform", ATTRIBUTION_FIRST)
    return ev.where(segment_condition(tracker, group, platform, SPEC_A)).select(
        "event_timestamp", tracker.alias("tracker_type"), group.alias("ad_group_type"),
        platform.alias("app_platform"))


def q_skan_compatible(spark, sf):
    f = _facts(spark, sf)
    p = "ad_click__impression__bid__"
    installs = f.installs.select(
        F.lit("installs").alias("source"), F.col("skan_params__version").alias("version"),
        F.col(p + "sk_ad_network_response__version").alias("fallback"),
        skan_compatible(F.col("skan_params__version"),
                        F.col(p + "sk_ad_network_response__version")).alias("compatible"))
    imps = f.impressions.select(
        F.lit("impressions").alias("source"),
        F.col("bid__sk_ad_network_response__version").alias("version"),
        F.lit(None).cast("string").alias("fallback"),
        skan_compatible(F.col("bid__sk_ad_network_response__version")).alias("compatible"))
    return installs.unionByName(imps)


def q_revenue_outlier_gate(spark, sf):
    ev = _facts(spark, sf).app_events
    rev, flag = F.col("customer_revenue_micros"), F.col("for_reporting")
    bound = SPEC_A.revenue_bound
    return ev.select("event_timestamp", "customer_revenue_micros", "for_reporting",
                     revenue_gate(rev, flag, bound).alias("reported_micros"),
                     revenue_gate(rev, ~flag, bound).alias("unreported_micros"))


def q_hour_iso(spark, sf):
    ev = _facts(spark, sf).app_events
    return ev.select(
        "event_timestamp", "install__at",
        hour_iso(touch_coalesce("impression__at", ATTRIBUTION_FIRST)).alias("impression_at"),
        hour_iso(touch_coalesce("at", ATTRIBUTION_FIRST)).alias("click_at"),
        hour_iso(F.col("install__at")).alias("install_at"),
        hour_iso(F.col("event_timestamp")).alias("at"))


def q_touch_coalesce(spark, sf):
    ev = _facts(spark, sf).app_events
    return ev.select(
        "event_timestamp",
        touch_coalesce("impression__auction_id", INSTALL_FIRST).alias("auction_id"),
        touch_coalesce(BID + "customer_id", INSTALL_FIRST).alias("customer_id"),
        touch_coalesce(BID + "app_id", INSTALL_FIRST).alias("dest_app_id"),
        touch_coalesce(BID + "bid_request__device__family", ATTRIBUTION_FIRST)
        .alias("device_family"),
        touch_coalesce(BID + "creative__type", ATTRIBUTION_FIRST).alias("creative_type"),
        touch_coalesce(BID + "campaign_tracker", INSTALL_FIRST).alias("MMPs"),
        touch_coalesce(BID + "campaign_id", ATTRIBUTION_FIRST).alias("campaign_id"),
        touch_coalesce(BID + "campaign_target_event_id", INSTALL_OR_REENG)
        .alias("target_event_id"))


def q_ad_format_mix(spark, sf):
    imp = _facts(spark, sf).impressions
    fmt = F.col("bid__creative__ad_format")
    return (imp.groupBy(fmt.alias("creative_format"), ad_format_class(fmt).alias("ad_format"))
            .agg(F.count(F.lit(1)).alias("impressions")))


def q_match_flags(spark, sf):
    ins = _facts(spark, sf).installs
    p = "ad_click__impression__bid__bid_request__device__"
    idfa, pid = F.col("tracker_params__idfa"), F.col(p + "platform_specific_id")
    bm, pm = F.col(p + "model_data__name"), F.col("pod_device_model")
    return ins.select(
        "event_timestamp", idfa.alias("idfa"), pid.alias("platform_id"),
        bm.alias("bid_model"), pm.alias("device_model"),
        idfa_match(idfa, pid).alias("idfa_match"), idfa_missing(idfa, pid).alias("idfa_missing"),
        device_model_match(bm, pm).alias("normalized_device_model_match"),
        unknown_device_model(bm, pm).alias("unknown_device_model"))


def q_impression_branch(spark, sf):
    return _round(aggregate_branch(impression_rows(_facts(spark, sf).impressions, SPEC_A), SPEC_A))


def q_ad_click_branch(spark, sf):
    return _round(aggregate_branch(click_rows(_facts(spark, sf).ad_clicks, SPEC_A), SPEC_A))


def q_view_click_branch(spark, sf):
    return _round(aggregate_branch(click_rows(_facts(spark, sf).view_clicks, SPEC_A), SPEC_A))


def q_install_branch(spark, sf):
    return _round(aggregate_branch(install_rows(_facts(spark, sf).installs, SPEC_B), SPEC_B))


def q_per_auction_revenue(spark, sf):
    return per_auction_revenue(_facts(spark, sf).app_events, SPEC_B)


def q_capped_revenue(spark, sf):
    return _round(capped_revenue_branch(_facts(spark, sf).app_events, SPEC_A))


def q_squared_capped_revenue(spark, sf):
    totals = per_auction_totals(_facts(spark, sf).app_events, SPEC_B)
    rows = capped_revenue_rows(totals, SPEC_B)
    return _round(rows.groupBy("ab_test_group_id").agg(
        F.sum("capped_customer_revenue_micros").alias("capped_customer_revenue_micros"),
        F.sum("squared_capped_customer_revenue").alias("squared_capped_customer_revenue")))


def q_match_quality(spark, sf):
    rep = _report(SPEC_A)(spark, sf)
    return rep.groupBy("ab_test_group_id", "install_at").agg(
        *[F.sum(c).alias(c) for c in ("installs", "strongly_matched_installs",
                                      "misattributed_installs",
                                      "possibly_misattributed_installs")])


def q_d7_cohort(spark, sf):
    rep = experiment_report(derive_facts(spark, sf), derive_dims(spark, sf), SPEC_B)
    cols = ("customer_revenue_d7", "target_events_d7", "target_events_first_d7",
            "capped_customer_revenue_d7", "squared_capped_customer_revenue_d7")
    return _round(rep.groupBy("ab_test_group_id", "install_at").agg(
        *[F.sum(c).alias(c) for c in cols]))


def q_dim_enrichment(spark, sf):
    rows = funnel_rows(derive_facts(spark, sf), SPEC_B)
    ids = ["customer_id", "dest_app_id", "ab_test_group_id", "campaign_id"]
    by_ids = rows.groupBy(*ids).agg(F.sum("impressions").alias("impressions"),
                                    F.sum("clicks").alias("clicks"),
                                    F.sum("installs").alias("installs"))
    return enrich(by_ids, derive_dims(spark, sf), SPEC_B)


def q_funnel_union(spark, sf):
    return _round(build_funnel(_facts(spark, sf), SPEC_A))



def q_event_rows(spark, sf):
    rows = app_event_rows(_facts(spark, sf).app_events, SPEC_A)
    return format_hours(rows.drop("target_events", "unreported_target_events"))


def _shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir`` (a temporary folder under a local master)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="adfunnel-")
    return f"{folder}/adfunnel-{uuid.uuid4().hex}"


def q_bucketed_experiment_report(spark, sf):
    """Report A over app events stored in buckets: no exchange before the per-auction rollup."""
    facts, path = _facts(spark, sf), _shared_folder(spark)
    table = f"app_events_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_bucketed_events(facts.app_events, table, buckets, path)
    stored = replace(facts, app_events=read_bucketed_events(spark, table))
    return _round(experiment_report(stored, derive_dims(spark, sf), SPEC_A))


def q_partial_experiment_report(spark, sf):
    """Report B over all hours, made of stored hourly partials."""
    root = _shared_folder(spark)
    write_partials(_facts(spark, sf), SPEC_B, root)
    return _round(report_from_partials(spark, root, derive_dims(spark, sf), SPEC_B))


def q_many_experiment_reports(spark, sf):
    """Four reports of two tests from one scan of each fact table."""
    return _round(experiment_reports(derive_facts(spark, sf), derive_dims(spark, sf), MANY))


def _optional(name: str):
    """Module ``name`` of the training-data part, or None where that part is not installed."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as e:
        if e.name not in ("adfunnel.llm", "corpus_pipeline"):
            raise
        return None


def _llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    llm, pipeline = _optional("adfunnel.llm.queries"), _optional("corpus_pipeline")
    out = llm.llm_queries() if llm else {}
    if pipeline:
        out["pipeline"] = pipeline.run
    return out


def _llm_sql() -> dict[str, str]:
    llm, pipeline = _optional("adfunnel.llm.queries"), _optional("corpus_pipeline")
    out = llm.llm_oracle_sql() if llm else {}
    if pipeline and pipeline.ORACLE_SQL:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "hour_range_scan": q_hour_range_scan,
        "explode_assignments": q_explode_assignments,
        "coalesced_assignments": q_coalesced_assignments,
        "credited_filter": q_credited_filter,
        "first_click_filter": q_first_click_filter,
        "segment_filter": q_segment_filter,
        "skan_compatible": q_skan_compatible,
        "revenue_outlier_gate": q_revenue_outlier_gate,
        "hour_iso": q_hour_iso,
        "touch_coalesce": q_touch_coalesce,
        "ad_format_mix": q_ad_format_mix,
        "match_flags": q_match_flags,
        "impression_branch": q_impression_branch,
        "ad_click_branch": q_ad_click_branch,
        "view_click_branch": q_view_click_branch,
        "install_branch": q_install_branch,
        "event_rows": q_event_rows,
        "per_auction_revenue": q_per_auction_revenue,
        "capped_revenue": q_capped_revenue,
        "squared_capped_revenue": q_squared_capped_revenue,
        "match_quality": q_match_quality,
        "d7_cohort": q_d7_cohort,
        "dim_enrichment": q_dim_enrichment,
        "funnel_union": q_funnel_union,
        "campaign_funnel_union": lambda spark, sf: _round(build_funnel(_facts(spark, sf), SPEC_B)),
        "experiment_report": _report(SPEC_A),
        "campaign_experiment_report": _report(SPEC_B),
        "hourly_experiment_report": _report(SPEC_B, per_hour=True),
        "bucketed_experiment_report": q_bucketed_experiment_report,
        "partial_experiment_report": q_partial_experiment_report,
        "many_experiment_reports": q_many_experiment_reports,
        **_llm_queries(),
    }


# --------------------------------------------------------------------------- DuckDB
def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([table_ctes(), *ctes]) + "\n" + select


def _rounded(select: str, doubles: list[str]) -> str:
    if not doubles:
        return select
    rep = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({select}) q"


def _rounded_report(r: ReportSQL) -> str:
    spec = r.s
    doubles = ["squared_capped_customer_revenue"]
    if spec.d7:
        doubles += ["customer_revenue_d7", "capped_customer_revenue_d7",
                    "squared_capped_customer_revenue_d7"]
    return _rounded(r.report(), doubles)


def _report_sql(spec, per_hour=False) -> str:
    r = ReportSQL(spec, per_hour=per_hour)
    return _with(r.ctes(), select=_rounded_report(r))


def _report_part(spec) -> str:
    r = ReportSQL(spec)
    return f"WITH {r.ctes()} {_rounded_report(r)}"


def oracle_sql() -> dict[str, str]:
    b = "impression__bid__"
    ra, rb = ReportSQL(REPORT_A), ReportSQL(REPORT_B)
    sq = ["squared_capped_customer_revenue"]
    p = "ad_click__impression__bid__"
    dev = p + "bid_request__device__"
    out = {
        "hour_range_scan": _with(select=(
            "SELECT dt, \"at\", spend_micros, revenue_micros, bid__customer_id FROM impressions "
            f"WHERE dt >= '{RANGE_START}' AND dt < '{RANGE_END}'")),
        "explode_assignments": _with(select=(
            "SELECT \"at\", bid__customer_id, u.id AS ab_test_id, u.\"group\".id AS ab_test_group_id "
            "FROM impressions CROSS JOIN UNNEST(bid__bid_request__ab_test_assignments) AS t(u)")),
        "coalesced_assignments": _with(select=(
            "SELECT event_timestamp, "
            f"{first(I + 'impression__auction_id', R + 'impression__auction_id', A + 'impression__auction_id')} AS auction_id, "
            "u.\"group\".id AS ab_test_group_id FROM app_events CROSS JOIN UNNEST("
            f"{first(I + b + 'bid_request__ab_test_assignments', R + b + 'bid_request__ab_test_assignments')}"
            f") AS t(u) WHERE u.id = {REPORT_A.test_id}")),
        "credited_filter": _with(select=(
            "SELECT event_timestamp, is_uncredited, tracker_params__idfa FROM installs "
            "WHERE is_uncredited <> true")),
        "first_click_filter": _with(select=(
            "SELECT \"at\", impression__at, has_prior_click FROM (SELECT * FROM ad_clicks "
            "UNION ALL SELECT * FROM view_clicks) WHERE has_prior_click = FALSE")),
        "segment_filter": _with(select=(
            "SELECT * FROM (SELECT event_timestamp, "
            f"{first(I + b + 'campaign_tracker_type', R + b + 'campaign_tracker_type', A + b + 'campaign_tracker_type')} AS tracker_type, "
            f"{first(A + b + 'ad_group_type', R + b + 'ad_group_type', I + b + 'ad_group_type')} AS ad_group_type, "
            f"{first(A + b + 'app_platform', R + b + 'app_platform', I + b + 'app_platform')} AS app_platform "
            "FROM app_events) WHERE tracker_type != 'SKAN' AND ad_group_type = 'user-acquisition' "
            "AND app_platform = 'IOS'")),
        "skan_compatible": _with(select=(
            "SELECT 'installs' AS source, skan_params__version AS version, "
            f"{p}sk_ad_network_response__version AS fallback, "
            "(CASE WHEN skan_params__version IS NULL OR skan_params__version = '' THEN "
            f"{p}sk_ad_network_response__version ELSE skan_params__version END) IS NOT NULL "
            "AS compatible FROM installs UNION ALL "
            "SELECT 'impressions', bid__sk_ad_network_response__version, CAST(NULL AS VARCHAR), "
            "bid__sk_ad_network_response__version IS NOT NULL FROM impressions")),
        "revenue_outlier_gate": _with(select=(
            "SELECT event_timestamp, customer_revenue_micros, for_reporting, "
            "CASE WHEN for_reporting AND customer_revenue_micros > -100000000000 AND "
            "customer_revenue_micros < 100000000000 THEN customer_revenue_micros END AS reported_micros, "
            "CASE WHEN NOT for_reporting AND customer_revenue_micros > -100000000000 AND "
            "customer_revenue_micros < 100000000000 THEN customer_revenue_micros END AS unreported_micros "
            "FROM app_events")),
        "hour_iso": _with(select=(
            "SELECT event_timestamp, install__at, "
            f"{hour(first(A + 'impression__at', R + 'impression__at', I + 'impression__at'))} AS impression_at, "
            f"{hour(first(A + 'at', R + 'at', I + 'at'))} AS click_at, "
            f"{hour('install__at')} AS install_at, {hour('event_timestamp')} AS at FROM app_events")),
        "touch_coalesce": _with(select=(
            "SELECT event_timestamp, "
            f"{first(I + 'impression__auction_id', R + 'impression__auction_id', A + 'impression__auction_id')} AS auction_id, "
            f"{first(I + b + 'customer_id', R + b + 'customer_id', A + b + 'customer_id')} AS customer_id, "
            f"{first(I + b + 'app_id', R + b + 'app_id', A + b + 'app_id')} AS dest_app_id, "
            f"{first(A + b + 'bid_request__device__family', R + b + 'bid_request__device__family', I + b + 'bid_request__device__family')} AS device_family, "
            f"{first(A + b + 'creative__type', R + b + 'creative__type', I + b + 'creative__type')} AS creative_type, "
            f"{first(I + b + 'campaign_tracker', R + b + 'campaign_tracker', A + b + 'campaign_tracker')} AS MMPs, "
            f"{first(A + b + 'campaign_id', R + b + 'campaign_id', I + b + 'campaign_id')} AS campaign_id, "
            f"{first(I + b + 'campaign_target_event_id', R + b + 'campaign_target_event_id')} AS target_event_id "
            "FROM app_events")),
        "ad_format_mix": _with(select=(
            f"SELECT bid__creative__ad_format AS creative_format, {fmt_class('bid__creative__ad_format')} "
            "AS ad_format, count(*) AS impressions FROM impressions GROUP BY 1, 2")),
        "match_flags": _with(select=(
            f"SELECT event_timestamp, tracker_params__idfa AS idfa, {dev}platform_specific_id AS platform_id, "
            f"{dev}model_data__name AS bid_model, pod_device_model AS device_model, "
            + ", ".join(c for c in quality("tracker_params__idfa", dev + "platform_specific_id",
                                           "tracker_params__match_type", dev + "model_data__name",
                                           "pod_device_model")
                        if c.endswith(("idfa_match", "idfa_missing", "device_model_match",
                                       "unknown_device_model")))
            + " FROM installs")),
        "impression_branch": _with(select=_rounded(ra.impressions_branch(), sq)),
        "ad_click_branch": _with(select=_rounded(ra.clicks_branch("ad_clicks"), sq)),
        "view_click_branch": _with(select=_rounded(ra.clicks_branch("view_clicks"), sq)),
        "install_branch": _with(select=_rounded(rb.installs_branch(), sq)),
        "event_rows": _with(select=ra.event_rows()),
        "per_auction_revenue": _with(select=rb.per_auction()),
        "capped_revenue": _with(f"rev AS ({ra.per_auction()})",
                                select=_rounded(ra.revenue_branch(), sq)),
        "squared_capped_revenue": _with(
            f"rev AS ({rb.per_auction()})", f"capped AS ({rb.revenue_branch()})",
            select=_rounded(
                "SELECT ab_test_group_id, CAST(sum(capped_customer_revenue_micros) AS BIGINT) "
                "AS capped_customer_revenue_micros, sum(squared_capped_customer_revenue) AS "
                "squared_capped_customer_revenue FROM capped GROUP BY 1", sq)),
        "match_quality": _with(ra.ctes(), f"rep AS ({ra.report()})", select=(
            "SELECT ab_test_group_id, install_at, "
            + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (
                "installs", "strongly_matched_installs", "misattributed_installs",
                "possibly_misattributed_installs"))
            + " FROM rep GROUP BY 1, 2")),
        "d7_cohort": _with(rb.ctes(), f"rep AS ({rb.report()})", select=_rounded(
            "SELECT ab_test_group_id, install_at, sum(customer_revenue_d7) AS customer_revenue_d7, "
            "CAST(sum(target_events_d7) AS BIGINT) AS target_events_d7, "
            "CAST(sum(target_events_first_d7) AS BIGINT) AS target_events_first_d7, "
            "sum(capped_customer_revenue_d7) AS capped_customer_revenue_d7, "
            "sum(squared_capped_customer_revenue_d7) AS squared_capped_customer_revenue_d7 "
            "FROM rep GROUP BY 1, 2",
            ["customer_revenue_d7", "capped_customer_revenue_d7",
             "squared_capped_customer_revenue_d7"])),
        "dim_enrichment": _with(rb.ctes(), select=(
            "SELECT f.customer_id, f.dest_app_id, f.ab_test_group_id, f.campaign_id, "
            "f.impressions, f.clicks, f.installs, c.company AS customer_name, "
            "a.display_name AS dest_app_name, a.salesforce_account_level AS account_level, "
            "g.name AS test_group_name, k.current_optimization_state, "
            "k.display_name AS campaign_name FROM (SELECT customer_id, dest_app_id, "
            "ab_test_group_id, campaign_id, CAST(sum(impressions) AS BIGINT) AS impressions, "
            "CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(installs) AS BIGINT) AS installs "
            "FROM funnel GROUP BY 1, 2, 3, 4) f "
            "LEFT JOIN customers c ON f.customer_id = c.id "
            "LEFT JOIN apps a ON f.dest_app_id = a.id AND f.customer_id = a.customer_id "
            "LEFT JOIN ab_test_groups g ON f.ab_test_group_id = g.id "
            "LEFT JOIN campaigns k ON f.campaign_id = k.id")),
        "funnel_union": _with(ra.ctes(), select=_rounded("SELECT * FROM funnel", sq)),
        "campaign_funnel_union": _with(rb.ctes(), select=_rounded("SELECT * FROM funnel", sq)),
        "experiment_report": _report_sql(REPORT_A),
        "campaign_experiment_report": _report_sql(REPORT_B),
        "hourly_experiment_report": _report_sql(REPORT_B, per_hour=True),
        "bucketed_experiment_report": _report_sql(REPORT_A),
        "partial_experiment_report": _report_sql(REPORT_B),
        "many_experiment_reports": _with(select=" UNION ALL BY NAME ".join(
            f"SELECT CAST({i} AS INTEGER) AS report, * FROM ({_report_part(r)}) r{i}"
            for i, r in enumerate(MANY_REPORTS))),
    }
    return {**out, **_llm_sql()}
