"""Column-level building blocks (pure expressions, no UDFs)."""

from adfunnel.functions.attribution import (
    ATTRIBUTION, ATTRIBUTION_FIRST, INSTALL, INSTALL_FIRST, INSTALL_OR_REENG, REENG,
    ad_format_class, device_model_match, idfa_match, idfa_missing, match_flag_columns,
    misattributed, possibly_misattributed, strongly_matched, touch_coalesce,
    unknown_device_model, with_match_flags,
)
from adfunnel.functions.hours import (
    bucket_from_iso, dt_add, dt_hours, hour_bucket, hour_iso, iso_from_bucket, within_days,
)
from adfunnel.functions.money import capped, revenue_gate, squared_capped, to_dollars

__all__ = [
    "ATTRIBUTION", "ATTRIBUTION_FIRST", "INSTALL", "INSTALL_FIRST", "INSTALL_OR_REENG", "REENG",
    "ad_format_class", "bucket_from_iso", "capped", "device_model_match", "dt_add", "dt_hours",
    "hour_bucket", "hour_iso", "idfa_match", "idfa_missing", "iso_from_bucket",
    "match_flag_columns", "misattributed", "possibly_misattributed", "revenue_gate",
    "squared_capped", "strongly_matched", "to_dollars", "touch_coalesce",
    "unknown_device_model", "with_match_flags", "within_days",
]
