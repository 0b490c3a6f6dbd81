"""Many reports in one pass over the facts.

The parameter row of a report becomes a table: each assignment is joined to the reports of
its test, and from there on a row carries the number of its report as one more key. Segment,
cap, revenue bound and cohort length are looked up by that number in constant arrays, so no
join is repeated after the exchanges and nothing but one integer is added to their rows.
Every fact table is scanned once, whatever the number of reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.plans.report import experiment_report, output_columns
from adfunnel.spec import Dims, ExperimentSpec, Facts

REPORT = "report"
# The parameters travel inside the plan; a larger table of them raises.
MAX_REPORTS = 10_000


@dataclass(frozen=True, eq=False)
class ManySpecs(ExperimentSpec):
    """Specs as one: values that differ between them are Columns over ``report``."""

    tests: DataFrame | None = None
    segment_values: dict | None = None
    campaign_reports: Column | None = None

    lead = (REPORT,)

    @property
    def segments(self) -> dict[str, list[str]]:
        return self.segment_values

    def campaign(self, campaign_id: Column) -> Column:
        return F.when(self.campaign_reports, campaign_id)


def _by_report(values: Sequence) -> Column:
    """The value of each row's report."""
    lits = [F.lit(v).cast("long") if type(v) is int else F.lit(v) for v in values]
    return F.array(*lits)[F.col(REPORT)]


def many_specs(spark: SparkSession, specs: Sequence[ExperimentSpec]) -> ManySpecs:
    """One spec that stands for all of ``specs``; a report's number is its place there."""
    if not 0 < len(specs) <= MAX_REPORTS:
        raise ValueError(f"1 to {MAX_REPORTS} reports go into one pass, not {len(specs)}")
    if len({s.carry_event_metrics for s in specs}) > 1:
        raise ValueError("reports of one pass agree on carry_event_metrics")

    def value(name: str):
        values = [getattr(s, name) for s in specs]
        return values[0] if len(set(values)) == 1 else _by_report(values)

    def some(name: str) -> bool:
        return any(getattr(s, name) for s in specs)

    tests = spark.createDataFrame([(s.test_id, i) for i, s in enumerate(specs)],
                                  f"ab_test_id long, {REPORT} int")
    given = {name: value(name) for name in ("platform", "ad_group_type", "excluded_tracker",
                                            "cap_micros", "revenue_bound", "cohort_days")}
    return ManySpecs(
        test_id=0, control_group=0, test_group=0, by_campaign=some("by_campaign"),
        first_events=some("first_events"), d7=some("d7"),
        carry_event_metrics=specs[0].carry_event_metrics, **given, tests=tests,
        segment_values={"app_platform": sorted({s.platform for s in specs}),
                        "ad_group_type": sorted({s.ad_group_type for s in specs})},
        campaign_reports=_by_report([s.by_campaign for s in specs]))


def experiment_reports(facts: Facts, dims: Dims, specs: Sequence[ExperimentSpec],
                       start: str | None = None, end: str | None = None,
                       per_hour: bool = False) -> DataFrame:
    """The reports of all ``specs``, told apart by ``report`` (place in ``specs``, from 0).

    Specs may differ in everything but ``carry_event_metrics``; two may name one test.
    Columns are those of the widest report; one that a report does not have is NULL in its
    rows. :func:`one_report` gives a single report in its own form.
    """
    many = many_specs(facts.impressions.sparkSession, specs)
    rows = experiment_report(facts, dims, many, start, end, per_hour)
    own = [set(output_columns(s, per_hour)) | {REPORT} for s in specs]
    cols = []
    for c in rows.columns:
        having = [c in names for names in own]
        cols.append(F.col(c) if all(having) else F.when(_by_report(having), F.col(c)).alias(c))
    return rows.select(*cols)


def one_report(reports: DataFrame, specs: Sequence[ExperimentSpec], i: int) -> DataFrame:
    """Report ``i`` of :func:`experiment_reports`, as :func:`experiment_report` returns it."""
    columns = output_columns(specs[i], "dt" in reports.columns)
    return reports.where(F.col(REPORT) == i).select(*columns)


def read_specs(table: DataFrame) -> list[ExperimentSpec]:
    """Specs from a table with a row per report, in the order of all their columns.

    Columns are named as the fields of ``ExperimentSpec``; those with a default may be absent
    or NULL, which means the default, and others are ignored. Raises beyond ``MAX_REPORTS``.
    """
    given = fields(ExperimentSpec)
    absent = [f.name for f in given if f.default is MISSING and f.name not in table.columns]
    if absent:
        raise ValueError(f"the table of tests lacks {', '.join(absent)}")
    names = [f.name for f in given if f.name in table.columns]
    rows = table.select(*names).orderBy(*names).limit(MAX_REPORTS + 1).collect()
    if len(rows) > MAX_REPORTS:
        raise ValueError(f"more than {MAX_REPORTS} reports")
    out = []
    for row in rows:
        values = {k: v for k, v in row.asDict().items() if v is not None}
        empty = [f.name for f in given if f.default is MISSING and f.name not in values]
        if empty:
            raise ValueError(f"a row of the table of tests lacks {', '.join(empty)}: {row}")
        out.append(ExperimentSpec(**values))
    return out
