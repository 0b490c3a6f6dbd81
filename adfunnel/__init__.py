"""Hourly A/B-test advertising-funnel analytics on Spark DataFrames."""

from adfunnel.operators.branches import (
    click_branch, click_rows, impression_branch, impression_rows, install_branch, install_rows,
)
from adfunnel.operators.enrich import assert_unique, enrich
from adfunnel.operators.expand import explode_assignments
from adfunnel.operators.filters import credited, first_click, segment_filter, skan_compatible
from adfunnel.operators.revenue import (
    app_event_rows, capped_revenue_branch, capped_revenue_rows, per_auction_revenue,
    per_auction_totals,
)
from adfunnel.plans.funnel import build_funnel, funnel_rows
from adfunnel.plans.many import experiment_reports, one_report, read_specs
from adfunnel.plans.report import experiment_report
from adfunnel.sources.scan import hour_range, read_dims, read_facts
from adfunnel.sources.sink import write_hour, write_hours
from adfunnel.spec import SPEC_A, SPEC_B, Dims, ExperimentSpec, Facts

__all__ = [
    "SPEC_A", "SPEC_B", "Dims", "ExperimentSpec", "Facts", "app_event_rows", "assert_unique",
    "build_funnel", "capped_revenue_branch", "capped_revenue_rows",
    "click_branch", "click_rows",
    "credited", "enrich", "experiment_report", "experiment_reports", "explode_assignments",
    "first_click", "funnel_rows", "hour_range", "impression_branch", "impression_rows",
    "install_branch", "install_rows", "one_report", "per_auction_revenue", "per_auction_totals",
    "read_dims", "read_facts", "read_specs",
    "segment_filter", "skan_compatible", "write_hour", "write_hours",
]
