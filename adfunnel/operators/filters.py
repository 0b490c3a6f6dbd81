"""Row filters of the funnel. SQL three-valued logic: a NULL test drops the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.spec import ExperimentSpec


def credited(df: DataFrame, flag: str = "is_uncredited") -> DataFrame:
    """``is_uncredited <> true``: keeps false only; NULL is dropped."""
    return df.where(F.col(flag) != F.lit(True))


def first_click(df: DataFrame, flag: str = "has_prior_click") -> DataFrame:
    """``has_prior_click = false``: NULL is dropped."""
    return df.where(F.col(flag) == F.lit(False))


def segment_condition(tracker_type: Column, ad_group_type: Column, platform: Column,
                      spec: ExperimentSpec) -> Column:
    return ((tracker_type != F.lit(spec.excluded_tracker))
            & (ad_group_type == F.lit(spec.ad_group_type))
            & (platform == F.lit(spec.platform)))


def segment_filter(df: DataFrame, tracker_type: Column, ad_group_type: Column,
                   platform: Column, spec: ExperimentSpec) -> DataFrame:
    """Non-excluded tracker type, the spec's ad-group type and platform."""
    return df.where(segment_condition(tracker_type, ad_group_type, platform, spec))


def skan_compatible(version: Column, fallback: Column | None = None) -> Column:
    """SKAN-compatible test.

    Impressions and clicks: the bid's version is not NULL (an empty string passes).
    Installs and events: the event's version, or ``fallback`` when that is NULL or
    empty, is not NULL.
    """
    if fallback is None:
        return version.isNotNull()
    return F.coalesce(F.nullif(version, F.lit("")), fallback).isNotNull()
