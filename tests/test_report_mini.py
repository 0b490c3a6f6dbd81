"""Hand-derived end-to-end case (FIXTURES §4): spec B, one run hour."""

import pytest

from adfunnel import SPEC_B, Dims, Facts, experiment_report
from adfunnel.sources.schemas import DIM_SCHEMAS, FACT_SCHEMAS

RUN = "2024-01-01T05"
T0 = 1704085200000  # 2024-01-01T05:00:00Z
HOUR = 3_600_000
MIN = 60_000
Z = "00000000-0000-0000-0000-000000000000"


def asg(group=2412):
    return [{"id": 1084, "group": {"id": group}}]


def bid(prefix, **kw):
    base = {"customer_id": 1, "app_id": 10, "campaign_id": 7,
            "bid_request__non_personalized": False, "bid_request__device__family": "phone",
            "creative__ad_format": "video", "creative__type": "static",
            "campaign_tracker": "mmp", "campaign_tracker_type": "mmp", "app_platform": "IOS",
            "ad_group_type": "user-acquisition", "sk_ad_network_response__version": "2.2",
            "bid_request__ab_test_assignments": asg()}
    base.update(kw)
    return {prefix + k: v for k, v in base.items()}


def frame(spark, name, rows):
    schema = FACT_SCHEMAS.get(name) or DIM_SCHEMAS[name]
    return spark.createDataFrame([{f.name: r.get(f.name) for f in schema.fields} for r in rows],
                                 schema)


def impression(spend, revenue, **kw):
    return {"dt": RUN, "at": T0 + 5 * MIN, "spend_micros": spend, "revenue_micros": revenue,
            **bid("bid__", **kw)}


def click(prior, **kw):
    return {"dt": RUN, "at": T0 + 9 * MIN, "impression__at": T0 + 8 * MIN,
            "has_prior_click": prior, **bid("impression__bid__", **kw)}


def install(match_type, idfa, pid, bid_model, pod_model, reporting=True, uncredited=False):
    p = "ad_click__impression__bid__"
    return {"dt": RUN, "event_timestamp": T0 + 30 * MIN, "ad_click__at": T0 + 9 * MIN,
            "ad_click__impression__at": T0 + 8 * MIN, "is_viewthrough": False,
            "for_reporting": reporting, "is_uncredited": uncredited,
            "tracker_params__idfa": idfa, "tracker_params__match_type": match_type,
            "pod_device_model": pod_model, "skan_params__version": "3.0",
            **bid(p, bid_request__device__platform_specific_id=pid,
                  bid_request__device__model_data__name=bid_model)}


def event(auction, dollars, *, at=T0 + 40 * MIN, installed=T0 - 24 * HOUR, group=2412,
          reporting=True, micros=None):
    p = "install__ad_click__"
    row = {"dt": RUN, "event_timestamp": at, "install__at": installed,
           "install__tracker_params__idfa": "A", "install__tracker_params__match_type":
           "DETERMINISTIC", "pod_device_model": "iPhone 12", "skan_params__version": "3.0",
           "is_viewthrough": False, "for_reporting": reporting, "first_occurrence": True,
           "is_uncredited": False, "custom_event_id": 99,
           "customer_revenue_micros": micros if micros is not None else
           (None if dollars is None else int(dollars * 1_000_000)),
           p + "at": T0 + 9 * MIN, p + "impression__at": T0 + 8 * MIN,
           p + "impression__auction_id": auction,
           **bid(p + "impression__bid__", bid_request__ab_test_assignments=asg(group),
                 bid_request__device__platform_specific_id="A",
                 bid_request__device__model_data__name="iPhone 12")}
    return row


@pytest.fixture(scope="module")
def report(spark):
    facts = Facts(
        impressions=frame(spark, "impressions", [
            impression(1000, 2000), impression(500, None),
            impression(1, 1, bid_request__ab_test_assignments=None),
            impression(1, 1, sk_ad_network_response__version=None),
            impression(1, 1, app_platform=None)]),
        ad_clicks=frame(spark, "ad_clicks", [click(False), click(True), click(None)]),
        view_clicks=frame(spark, "view_clicks", [click(False)]),
        installs=frame(spark, "installs", [
            install("DETERMINISTIC", "A", "A", "iPhone 12", "iPhone 12"),
            install("PROBABILISTIC", "", "A", "iPhone 12", "iPad 9"),
            install("PROBABILISTIC", None, "A", None, None),
            install("PROBABILISTIC", "A", "B", "iPhone Unknown", "iPad 9"),
            install("DETERMINISTIC", "A", "A", "iPhone 12", "iPhone 12", reporting=False),
            install("DETERMINISTIC", "", "A", "iPhone 12", "iPad 9"),
            install(None, "A", "B", "iPhone 12", "iPad 9"),
            install("DETERMINISTIC", "A", "A", "iPhone 12", "iPhone 12", uncredited=None)]),
        app_events=frame(spark, "app_events", [
            event("a1", 400), event("a1", 300),
            event("a1", 100, at=T0 - 20 * MIN),
            event("a2", 50, reporting=False),
            event("a3", None, micros=100_000_000_000),
            event("a1", None, group=2413),
            event("a1", -700, installed=T0 - 168 * HOUR)]),
    )
    dims = Dims(
        customers=frame(spark, "customers", [{"id": 1, "company": "Acme"}]),
        apps=frame(spark, "apps", [{"id": 10, "customer_id": 1, "display_name": "Game",
                                    "salesforce_account_level": "Gold"}]),
        ab_test_groups=frame(spark, "ab_test_groups", [{"id": 2412, "name": "control"},
                                                       {"id": 2413, "name": "test"}]),
        campaigns=frame(spark, "campaigns", [{"id": 8, "display_name": "other",
                                              "current_optimization_state": "x"}]),
    )
    rows = experiment_report(facts, dims, SPEC_B, RUN).collect()
    return {(r.ab_test_group_id, r.install_at, r.click_at, r.impressions > 0): r.asDict()
            for r in rows}


def test_row_count_and_names(report):
    assert len(report) == 6
    for r in report.values():
        assert r["customer_name"] == "Acme" and r["dest_app_name"] == "Game"
        assert r["campaign_name"] is None and r["current_optimization_state"] is None
        assert r["test_group_name"] == ("control" if r["ab_test_group_id"] == 2412 else "test")


def test_impressions_and_clicks(report):
    r1 = report[(2412, None, None, True)]
    assert (r1["impressions"], r1["spend_micros"], r1["revenue_micros"]) == (2, 1500, 2000)
    r2 = report[(2412, None, "2024-01-01T05:00:00Z", False)]
    assert r2["clicks"] == 2
    for r in (r1, r2):
        assert r["strongly_matched_installs"] is None
        assert r["misattributed_installs"] is None
        assert r["possibly_misattributed_installs"] is None
        assert r["capped_customer_revenue_d7"] == 0.0


def test_installs_quality(report):
    r3 = report[(2412, "2024-01-01T05:00:00Z", "2024-01-01T05:00:00Z", False)]
    assert (r3["installs"], r3["unreported_installs"]) == (6, 1)
    assert (r3["strongly_matched_installs"], r3["misattributed_installs"],
            r3["possibly_misattributed_installs"]) == (2, 3, 1)


def test_capped_revenue_and_cohort(report):
    r4 = report[(2412, "2023-12-31T05:00:00Z", "2024-01-01T05:00:00Z", False)]
    assert r4["capped_customer_revenue_micros"] == 600_000_000
    assert r4["squared_capped_customer_revenue"] == pytest.approx(260000.0)
    assert r4["capped_customer_revenue_d7"] == pytest.approx(600.0)
    assert r4["squared_capped_customer_revenue_d7"] == pytest.approx(260000.0)
    assert r4["strongly_matched_installs"] == 0
    assert r4["misattributed_installs"] is None and r4["possibly_misattributed_installs"] is None
    # discarded event metrics (T2)
    for m in ("target_events", "target_events_first", "customer_revenue_micros",
              "unreported_customer_revenue_micros", "target_events_d7"):
        assert r4[m] == 0
    r5 = report[(2413, "2023-12-31T05:00:00Z", "2024-01-01T05:00:00Z", False)]
    for m in ("capped_customer_revenue_micros", "squared_capped_customer_revenue",
              "capped_customer_revenue_d7", "squared_capped_customer_revenue_d7"):
        assert r5[m] is None, m
    r6 = report[(2412, "2023-12-25T05:00:00Z", "2024-01-01T05:00:00Z", False)]
    assert r6["capped_customer_revenue_micros"] == -700_000_000
    assert r6["squared_capped_customer_revenue"] == pytest.approx(490000.0)
    assert r6["capped_customer_revenue_d7"] == 0.0
    assert r6["squared_capped_customer_revenue_d7"] == 0.0


def test_output_columns_in_report_order():
    from adfunnel import SPEC_A
    from adfunnel.plans.report import output_columns
    head_a = ["impression_at", "click_at", "install_at", "ab_test_group_id", "test_group_name",
              "customer_id", "dest_app_id", "non_personalized", "is_viewthrough", "ad_format",
              "creative_type", "device_family", "MMPs", "customer_name", "dest_app_name",
              "account_level"]
    measures_a = ["impressions", "spend_micros", "revenue_micros", "clicks", "installs",
                  "unreported_installs", "target_events", "unreported_target_events",
                  "customer_revenue_micros", "unreported_customer_revenue_micros",
                  "capped_customer_revenue_micros", "squared_capped_customer_revenue",
                  "strongly_matched_installs", "misattributed_installs",
                  "possibly_misattributed_installs"]
    assert output_columns(SPEC_A) == head_a + measures_a
    head_b = head_a[:13] + ["campaign_id"] + head_a[13:] + ["current_optimization_state",
                                                           "campaign_name"]
    measures_b = (measures_a[:7] + ["target_events_first"] + measures_a[7:12]
                  + ["customer_revenue_d7", "target_events_d7", "target_events_first_d7",
                     "capped_customer_revenue_d7", "squared_capped_customer_revenue_d7"]
                  + measures_a[12:])
    assert output_columns(SPEC_B) == head_b + measures_b
    assert output_columns(SPEC_B, per_hour=True) == ["dt"] + head_b + measures_b
