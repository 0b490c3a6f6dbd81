"""The experiment report as DuckDB SQL, written from the report's definition.

Kept deliberately close to plain SQL semantics (per-branch GROUP BYs, UNION ALL,
LEFT JOINs, then the report GROUP BY) so it checks the Spark plan, which is
shaped differently. DuckDB differences handled here: ``sum`` of BIGINT is HUGEINT
(cast back), ``least`` skips NULLs (guarded), ``concat`` ignores NULLs (not used).
"""

from __future__ import annotations

from types import SimpleNamespace

# The two reports, written here a second time so that a wrong constant in the
# library shows as a difference.
_BOTH = dict(platform="IOS", ad_group_type="user-acquisition", excluded_tracker="SKAN",
             cap_micros=500_000_000, revenue_bound=100_000_000_000, cohort_days=7)
REPORT_A = SimpleNamespace(test_id=1067, by_campaign=False, first_events=False, d7=False, **_BOTH)
REPORT_B = SimpleNamespace(test_id=1084, by_campaign=True, first_events=True, d7=True, **_BOTH)
MANY_REPORTS = [
    REPORT_A, REPORT_B,
    SimpleNamespace(**{**vars(REPORT_A), "platform": "ANDROID", "cap_micros": 3_000_000,
                       "revenue_bound": 90_000_000}),
    SimpleNamespace(**{**vars(REPORT_B), "by_campaign": False, "cohort_days": 1,
                       "cap_micros": 40_000_000}),
]

I, R, A = "install__ad_click__", "reeng_click__", "attribution_event__click__"
BLANK = "['', '00000000-0000-0000-0000-000000000000']"
FORMATS = "['video', 'native', '320x50', '728x90', '300x250']"
CLASSES = "['VAST', 'native', 'banner', 'banner', 'mrec', 'html-interstitial']"


def hour(ms: str) -> str:
    # whole seconds toward zero, then the hour, as YYYY-MM-DDTHH:00:00Z
    return f"strftime(date_trunc('hour', epoch_ms(({ms}) // 1000 * 1000)), '%Y-%m-%dT%H:00:00Z')"


def first(*cols: str) -> str:
    return "COALESCE(" + ", ".join(cols) + ")"


def fmt_class(x: str) -> str:
    """The class beside the format in the lists; the last one for any other or NULL."""
    return f"{CLASSES}[coalesce(nullif(list_position({FORMATS}, {x}), 0), 6)]"


def quality(idfa: str, pid: str, mt: str, bm: str, pm: str) -> list[str]:
    """The match flags, 'yes' only where a test is plainly true; NULLs are tested for."""
    def blank(x: str) -> str:
        return f"({x} IS NOT NULL AND list_contains({BLANK}, {x}))"

    def ends_unknown(x: str) -> str:
        return f"({x} IS NOT NULL AND ends_with({x}, 'Unknown'))"

    def empty(x: str) -> str:
        return f"({x} IS NOT NULL AND length({x}) = 0)"

    def same(x: str, y: str) -> str:
        return f"({x} IS NOT NULL AND {x} IS NOT DISTINCT FROM {y})"

    flags = {
        "idfa_match": f"{same(idfa, pid)} AND NOT {blank(idfa)}",
        "idfa_missing": f"{blank(idfa)} OR {blank(pid)}",
        "normalized_device_model_match": same(bm, pm),
        "unknown_device_model": f"{ends_unknown(bm)} OR {ends_unknown(pm)} OR {empty(bm)} OR {empty(pm)}",
    }
    out = {name: f"if({test}, 'yes', 'no') AS {name}" for name, test in flags.items()}
    return [out["idfa_match"], out["idfa_missing"], f"{mt} AS match_type",
            f"{bm} AS bidrequest_normalized_device_model", out["normalized_device_model_match"],
            out["unknown_device_model"]]


NA_QUALITY = [f"'N/A' AS {c}" for c in (
    "idfa_match", "idfa_missing", "match_type", "bidrequest_normalized_device_model",
    "normalized_device_model_match", "unknown_device_model")]


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def range_where(start: str | None, end: str | None) -> str:
    if start is None:
        return "TRUE"
    return f"dt >= '{start}' AND dt < '{end}'"


class ReportSQL:
    """CTE texts of one report definition."""

    def __init__(self, report: SimpleNamespace, per_hour: bool = False,
                 start: str | None = None, end: str | None = None):
        self.s = report
        self.per_hour = per_hour
        self.where = range_where(start, end)

    # -- pieces ---------------------------------------------------------------
    def _lead(self) -> list[str]:
        return ["dt"] if self.per_hour else []

    def _measures(self, **given: str) -> list[str]:
        names = ["impressions", "spend_micros", "revenue_micros", "clicks", "installs",
                 "unreported_installs", "target_events"]
        if self.s.first_events:
            names.append("target_events_first")
        names += ["unreported_target_events", "customer_revenue_micros",
                  "unreported_customer_revenue_micros", "capped_customer_revenue_micros",
                  "squared_capped_customer_revenue"]
        out = []
        for n in names:
            default = "0.0" if n == "squared_capped_customer_revenue" else "0"
            expr = given.get(n, default)
            typ = "DOUBLE" if n == "squared_capped_customer_revenue" else "BIGINT"
            out.append(f"CAST(sum({expr}) AS {typ}) AS {n}")
        return out

    def _bid(self, p: str) -> list[str]:
        cols = [f"{p}customer_id AS customer_id", f"{p}app_id AS dest_app_id",
                f"CAST({p}bid_request__non_personalized AS VARCHAR) AS non_personalized"]
        return cols

    def _bid_tail(self, p: str) -> list[str]:
        cols = [f"{p}bid_request__device__family AS device_family",
                f"{fmt_class(p + 'creative__ad_format')} AS ad_format",
                f"{p}creative__type AS creative_type"]
        return cols

    def _campaign(self, expr: str) -> list[str]:
        return [f"{expr} AS campaign_id"] if self.s.by_campaign else []

    def _bid_where(self, p: str, skan: str) -> str:
        s = self.s
        return (f"u.id = {s.test_id} AND {p}campaign_tracker_type != '{s.excluded_tracker}' "
                f"AND {p}app_platform = '{s.platform}' AND {p}ad_group_type = '{s.ad_group_type}' "
                f"AND {skan}")

    def _group(self, select: list[str], measures: list[str]) -> tuple[str, str]:
        n = len(select)
        return (f"SELECT {', '.join(select + measures)}",
                "GROUP BY " + ", ".join(str(i) for i in range(1, n + 1)))

    # -- CTEs -------------------------------------------------------------------
    def per_auction(self) -> str:
        select, measures, source = self._event_parts()
        n = len(select)
        group = "GROUP BY " + ", ".join(str(i) for i in range(1, n + 1))
        return f"SELECT {', '.join(select + measures)} {source} {group}"

    def event_rows(self) -> str:
        """One row per credited, in-segment event and matching assignment."""
        select, _, source = self._event_parts()
        rev, bound = "customer_revenue_micros", self.s.revenue_bound
        gated = [
            f"CASE WHEN for_reporting AND {rev} > -{bound} AND {rev} < {bound} THEN {rev} END"
            " AS customer_revenue_micros",
            f"CASE WHEN NOT for_reporting AND {rev} > -{bound} AND {rev} < {bound} THEN {rev} END"
            " AS unreported_customer_revenue_micros"]
        return f"SELECT {', '.join(select + gated)} {source}"

    def _event_parts(self) -> tuple[list[str], list[str], str]:
        s = self.s
        b = "impression__bid__"
        tgt = first(f"{I}{b}campaign_target_event_id", f"{R}{b}campaign_target_event_id")
        rev = "customer_revenue_micros"
        bound = s.revenue_bound
        select = self._lead() + [
            f"{first(I + 'impression__auction_id', R + 'impression__auction_id', A + 'impression__auction_id')} AS auction_id",
            f"{hour(first(A + 'impression__at', R + 'impression__at', I + 'impression__at'))} AS impression_at",
            f"{hour(first(A + 'at', R + 'at', I + 'at'))} AS click_at",
            f"{hour('install__at')} AS install_at",
            f"{hour('event_timestamp')} AS \"at\"",
            'u."group".id AS ab_test_group_id',
            f"{first(I + b + 'customer_id', R + b + 'customer_id', A + b + 'customer_id')} AS customer_id",
            f"{first(I + b + 'app_id', R + b + 'app_id', A + b + 'app_id')} AS dest_app_id",
            f"CAST({first(I + b + 'bid_request__non_personalized', R + b + 'bid_request__non_personalized', A + b + 'bid_request__non_personalized')} AS VARCHAR) AS non_personalized",
            "CAST(is_viewthrough AS VARCHAR) AS is_viewthrough",
            f"{first(A + b + 'bid_request__device__family', R + b + 'bid_request__device__family', I + b + 'bid_request__device__family')} AS device_family",
            f"{fmt_class(first(I + b + 'creative__ad_format', R + b + 'creative__ad_format', A + b + 'creative__ad_format'))} AS ad_format",
            f"{first(A + b + 'creative__type', R + b + 'creative__type', I + b + 'creative__type')} AS creative_type",
            *quality("install__tracker_params__idfa",
                     f"{I}{b}bid_request__device__platform_specific_id",
                     "install__tracker_params__match_type",
                     f"{I}{b}bid_request__device__model_data__name", "pod_device_model"),
            f"{first(I + b + 'campaign_tracker', R + b + 'campaign_tracker', A + b + 'campaign_tracker')} AS MMPs",
            *self._campaign(first(A + b + 'campaign_id', R + b + 'campaign_id', I + b + 'campaign_id')),
        ]
        measures = [
            "CAST(0 AS BIGINT) AS impressions", "CAST(0 AS BIGINT) AS spend_micros",
            "CAST(0 AS BIGINT) AS revenue_micros", "CAST(0 AS BIGINT) AS clicks",
            "CAST(0 AS BIGINT) AS installs", "CAST(0 AS BIGINT) AS unreported_installs",
            big(f"sum(CASE WHEN for_reporting AND custom_event_id = {tgt} THEN 1 ELSE 0 END)")
            + " AS target_events",
        ]
        if s.first_events:
            measures.append(big(f"sum(CASE WHEN custom_event_id = {tgt} AND first_occurrence "
                                f"THEN 1 ELSE 0 END)") + " AS target_events_first")
        measures += [
            big(f"sum(CASE WHEN NOT for_reporting AND custom_event_id = {tgt} THEN 1 ELSE 0 END)")
            + " AS unreported_target_events",
            big(f"sum(CASE WHEN for_reporting AND {rev} > -{bound} AND {rev} < {bound} THEN {rev} END)")
            + " AS customer_revenue_micros",
            big(f"sum(CASE WHEN NOT for_reporting AND {rev} > -{bound} AND {rev} < {bound} THEN {rev} END)")
            + " AS unreported_customer_revenue_micros",
        ]
        skan = (f"(CASE WHEN skan_params__version IS NULL OR skan_params__version = '' THEN "
                f"{first(A + b + 'sk_ad_network_response__version', R + b + 'sk_ad_network_response__version', I + b + 'sk_ad_network_response__version')} "
                f"ELSE skan_params__version END) IS NOT NULL")
        source = (
            f"FROM app_events CROSS JOIN UNNEST({first(I + b + 'bid_request__ab_test_assignments', R + b + 'bid_request__ab_test_assignments')}) AS t(u) "
            f"WHERE {self.where} AND is_uncredited <> true AND u.id = {s.test_id} "
            f"AND {first(I + b + 'campaign_tracker_type', R + b + 'campaign_tracker_type', A + b + 'campaign_tracker_type')} != '{s.excluded_tracker}' "
            f"AND {first(A + b + 'ad_group_type', R + b + 'ad_group_type', I + b + 'ad_group_type')} = '{s.ad_group_type}' "
            f"AND {first(A + b + 'app_platform', R + b + 'app_platform', I + b + 'app_platform')} = '{s.platform}' "
            f"AND {skan}"
        )
        return select, measures, source

    def impressions_branch(self) -> str:
        p = "bid__"
        select = self._lead() + [
            f"{hour('"at"')} AS impression_at", "CAST(NULL AS VARCHAR) AS click_at",
            "CAST(NULL AS VARCHAR) AS install_at", f"{hour('"at"')} AS \"at\"",
            'u."group".id AS ab_test_group_id', *self._bid(p), "'N/A' AS is_viewthrough",
            *self._bid_tail(p), *NA_QUALITY, f"{p}campaign_tracker AS MMPs",
            *self._campaign(p + "campaign_id")]
        sel, grp = self._group(select, self._measures(
            impressions="1", spend_micros="spend_micros", revenue_micros="revenue_micros"))
        where = self._bid_where(p, f"{p}sk_ad_network_response__version IS NOT NULL")
        return (f"{sel} FROM impressions CROSS JOIN UNNEST({p}bid_request__ab_test_assignments) "
                f"AS t(u) WHERE {self.where} AND {where} {grp}")

    def clicks_branch(self, table: str) -> str:
        p = "impression__bid__"
        select = self._lead() + [
            f"{hour('impression__at')} AS impression_at", f"{hour('"at"')} AS click_at",
            "CAST(NULL AS VARCHAR) AS install_at", f"{hour('"at"')} AS \"at\"",
            'u."group".id AS ab_test_group_id', *self._bid(p), "'N/A' AS is_viewthrough",
            *self._bid_tail(p), *NA_QUALITY, f"{p}campaign_tracker AS MMPs",
            *self._campaign(p + "campaign_id")]
        sel, grp = self._group(select, self._measures(clicks="1"))
        where = self._bid_where(p, f"{p}sk_ad_network_response__version IS NOT NULL")
        return (f"{sel} FROM {table} CROSS JOIN UNNEST({p}bid_request__ab_test_assignments) "
                f"AS t(u) WHERE {self.where} AND has_prior_click = FALSE AND {where} {grp}")

    def installs_branch(self) -> str:
        p = "ad_click__impression__bid__"
        select = self._lead() + [
            f"{hour('ad_click__impression__at')} AS impression_at",
            f"{hour('ad_click__at')} AS click_at", f"{hour('event_timestamp')} AS install_at",
            f"{hour('event_timestamp')} AS \"at\"", 'u."group".id AS ab_test_group_id',
            *self._bid(p), "CAST(is_viewthrough AS VARCHAR) AS is_viewthrough",
            *self._bid_tail(p),
            *quality("tracker_params__idfa", f"{p}bid_request__device__platform_specific_id",
                     "tracker_params__match_type", f"{p}bid_request__device__model_data__name",
                     "pod_device_model"),
            f"{p}campaign_tracker AS MMPs", *self._campaign(p + "campaign_id")]
        sel, grp = self._group(select, self._measures(
            installs="CASE WHEN for_reporting THEN 1 ELSE 0 END",
            unreported_installs="CASE WHEN NOT for_reporting THEN 1 ELSE 0 END"))
        skan = (f"(CASE WHEN skan_params__version IS NULL OR skan_params__version = '' THEN "
                f"{p}sk_ad_network_response__version ELSE skan_params__version END) IS NOT NULL")
        where = self._bid_where(p, skan)
        return (f"{sel} FROM installs CROSS JOIN UNNEST({p}bid_request__ab_test_assignments) "
                f"AS t(u) WHERE {self.where} AND is_uncredited <> true AND {where} {grp}")

    def funnel_keys(self) -> list[str]:
        keys = self._lead() + [
            "impression_at", "click_at", "install_at", '"at"', "ab_test_group_id", "customer_id",
            "dest_app_id", "non_personalized", "is_viewthrough", "device_family", "ad_format",
            "creative_type", "idfa_match", "idfa_missing", "match_type",
            "bidrequest_normalized_device_model", "normalized_device_model_match",
            "unknown_device_model", "MMPs"]
        return keys + (["campaign_id"] if self.s.by_campaign else [])

    def revenue_branch(self, source: str = "rev") -> str:
        cap = self.s.cap_micros
        x = "customer_revenue_micros"
        sel, grp = self._group(self.funnel_keys(), self._measures(
            capped_customer_revenue_micros=f"CASE WHEN {x} IS NOT NULL THEN least({x}, {cap}) END",
            squared_capped_customer_revenue=(
                f"CASE WHEN {x} IS NOT NULL THEN "
                f"power(least(CAST({x} AS DOUBLE) / 1000000, {cap / 1e6}), 2) END")))
        return f"{sel} FROM {source} {grp}"

    def funnel(self) -> str:
        return " UNION ALL ".join([
            self.impressions_branch(), self.clicks_branch("ad_clicks"),
            self.clicks_branch("view_clicks"), self.installs_branch(), self.revenue_branch()])

    def ctes(self) -> str:
        return f"rev AS ({self.per_auction()}),\nfunnel AS ({self.funnel()})"

    def report(self, source: str = "funnel") -> str:
        s = self.s
        head = self._lead() + [
            "impression_at", "click_at", "install_at", "ab_test_group_id",
            "g.name AS test_group_name", "f.customer_id", "f.dest_app_id", "non_personalized",
            "is_viewthrough", "ad_format", "creative_type", "device_family", "MMPs"]
        if s.by_campaign:
            head.append("f.campaign_id")
        head += ["c.company AS customer_name", "a.display_name AS dest_app_name",
                 "a.salesforce_account_level AS account_level"]
        if s.by_campaign:
            head += ["k.current_optimization_state AS current_optimization_state",
                     "k.display_name AS campaign_name"]
        sums = ["impressions", "spend_micros", "revenue_micros", "clicks", "installs",
                "unreported_installs", "target_events"]
        if s.first_events:
            sums.append("target_events_first")
        sums += ["unreported_target_events", "customer_revenue_micros",
                 "unreported_customer_revenue_micros", "capped_customer_revenue_micros"]
        measures = [big(f"sum({m})") + f" AS {m}" for m in sums]
        measures.append("sum(squared_capped_customer_revenue) AS squared_capped_customer_revenue")
        if s.d7:
            fmt = "'%Y-%m-%dT%H:%M:%SZ'"
            d7 = (f"strptime(\"at\", {fmt}) - strptime(install_at, {fmt}) "
                  f"< INTERVAL {s.cohort_days} DAY")
            measures += [
                f"sum(CASE WHEN {d7} THEN CAST(customer_revenue_micros AS DOUBLE) / 1000000 ELSE 0 END) AS customer_revenue_d7",
                big(f"sum(CASE WHEN {d7} THEN target_events ELSE 0 END)") + " AS target_events_d7",
            ]
            if s.first_events:
                measures.append(big(f"sum(CASE WHEN {d7} THEN target_events_first ELSE 0 END)")
                                + " AS target_events_first_d7")
            measures += [
                f"sum(CASE WHEN {d7} THEN CAST(capped_customer_revenue_micros AS DOUBLE) / 1000000 ELSE 0 END) AS capped_customer_revenue_d7",
                f"sum(CASE WHEN {d7} THEN squared_capped_customer_revenue ELSE 0 END) AS squared_capped_customer_revenue_d7",
            ]
        prob = "(match_type = 'PROBABILISTIC' OR idfa_missing = 'yes')"
        measures += [
            big("sum(CASE WHEN (match_type = 'DETERMINISTIC' OR idfa_match = 'yes') OR "
                "(normalized_device_model_match = 'yes' AND unknown_device_model = 'no') "
                "THEN installs END)") + " AS strongly_matched_installs",
            big(f"sum(CASE WHEN {prob} AND normalized_device_model_match <> 'yes' AND "
                f"unknown_device_model <> 'yes' THEN installs END)") + " AS misattributed_installs",
            big(f"sum(CASE WHEN {prob} AND unknown_device_model = 'yes' THEN installs END)")
            + " AS possibly_misattributed_installs",
        ]
        joins = (" LEFT JOIN customers c ON f.customer_id = c.id"
                 " LEFT JOIN apps a ON f.dest_app_id = a.id AND f.customer_id = a.customer_id"
                 " LEFT JOIN ab_test_groups g ON f.ab_test_group_id = g.id")
        if s.by_campaign:
            joins += " LEFT JOIN campaigns k ON f.campaign_id = k.id"
        grp = "GROUP BY " + ", ".join(str(i) for i in range(1, len(head) + 1))
        return f"SELECT {', '.join(head + measures)} FROM {source} f{joins} {grp}"
