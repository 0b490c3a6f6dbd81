"""Run parameters and input bundles for the experiment funnel report."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class ExperimentSpec:
    """One A/B test report definition.

    ``control_group`` and ``test_group`` are carried as metadata only: the report
    groups by whatever group id each assignment carries.
    """

    test_id: int
    control_group: int
    test_group: int
    by_campaign: bool = False  # adds campaign_id + campaign dimension
    first_events: bool = False  # adds target_events_first
    d7: bool = False  # adds the seven-day cohort sums
    # The report's segment, revenue cap ($500), outlier bound ($100,000)
    # and cohort length.
    platform: str = "IOS"
    ad_group_type: str = "user-acquisition"
    excluded_tracker: str = "SKAN"
    cap_micros: int = 500_000_000
    revenue_bound: int = 100_000_000_000
    cohort_days: int = 7
    # The reference computes per-event metrics and then reports them as 0.
    # True carries them through to the report instead.
    carry_event_metrics: bool = False

    # What one pass over the facts for many specs replaces (plans/many.py).
    lead: ClassVar[tuple[str, ...]] = ()  # keys that tell the reports apart
    tests: ClassVar[DataFrame | None] = None  # the reports of each test id

    @property
    def segments(self) -> dict[str, list[str]]:
        """The values of the segment columns that some row of the report can have."""
        return {"app_platform": [self.platform], "ad_group_type": [self.ad_group_type]}

    def campaign(self, campaign_id: Column) -> Column:
        return campaign_id


# The two reference report definitions.
SPEC_A = ExperimentSpec(test_id=1067, control_group=2373, test_group=2374)
SPEC_B = ExperimentSpec(
    test_id=1084, control_group=2412, test_group=2413,
    by_campaign=True, first_events=True, d7=True,
)


@dataclass(frozen=True)
class Facts:
    """The five hourly fact tables, each with a string ``dt`` hour column."""

    impressions: DataFrame
    ad_clicks: DataFrame
    view_clicks: DataFrame
    installs: DataFrame
    app_events: DataFrame


@dataclass(frozen=True)
class Dims:
    """Small lookup tables joined onto the report."""

    customers: DataFrame
    apps: DataFrame
    ab_test_groups: DataFrame
    campaigns: DataFrame | None = None
