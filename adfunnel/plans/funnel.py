"""The funnel: five branches on one schema, unioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.operators.branches import (
    click_rows, format_hours, funnel_keys, funnel_measures, impression_rows, install_rows,
    sum_measures,
)
from adfunnel.operators.revenue import capped_revenue_rows, per_auction_totals
from adfunnel.sources.scan import hour_range
from adfunnel.spec import ExperimentSpec, Facts

BRANCHES = ("impressions", "ad_clicks", "view_clicks", "installs", "capped_revenue")


def scoped(facts: Facts, start: str | None, end: str | None) -> Facts:
    """The facts restricted to ``start <= dt < end`` (partition pruning on disk)."""
    return Facts(**{name: hour_range(getattr(facts, name), start, end)
                    for name in ("impressions", "ad_clicks", "view_clicks", "installs",
                                 "app_events")})


def funnel_branches(facts: Facts, spec: ExperimentSpec, start: str | None = None,
                    end: str | None = None, per_hour: bool = False) -> dict[str, DataFrame]:
    """Row-level frames of the five branches (hours as buckets).

    ``per_hour`` adds ``dt`` to every grain, which reproduces one reference run per
    hour for a whole range in a single job (the cap is applied per hour).
    """
    f = scoped(facts, start, end)
    extra = ("dt",) if per_hour else ()
    totals = per_auction_totals(f.app_events, spec, extra)
    return {**row_branches(f, spec, extra),
            "capped_revenue": capped_revenue_rows(totals, spec, extra)}


def row_branches(f: Facts, spec: ExperimentSpec, extra: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The four branches that need no rollup of their own."""
    return {
        "impressions": impression_rows(f.impressions, spec, extra),
        "ad_clicks": click_rows(f.ad_clicks, spec, extra),
        "view_clicks": click_rows(f.view_clicks, spec, extra),
        "installs": install_rows(f.installs, spec, extra),
    }


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def funnel_rows(facts: Facts, spec: ExperimentSpec, start: str | None = None,
                end: str | None = None, per_hour: bool = False) -> DataFrame:
    return union_all(list(funnel_branches(facts, spec, start, end, per_hour).values()))


def build_funnel(facts: Facts, spec: ExperimentSpec, start: str | None = None,
                 end: str | None = None) -> DataFrame:
    """The funnel at its reference grain: one row per branch and funnel key.

    All branches aggregate in one grouped pass keyed by a branch tag, so the
    union costs one shuffle rather than one per branch.
    """
    frames = funnel_branches(facts, spec, start, end)
    tagged = union_all([df.withColumn("_branch", F.lit(i))
                        for i, df in enumerate(frames.values())])
    keys = funnel_keys(spec)
    agg = tagged.groupBy("_branch", *keys).agg(*sum_measures(funnel_measures(spec)))
    return format_hours(agg.drop("_branch"))
