"""Touch coalescing, creative classification and install-match quality flags.

Flags are the strings ``'yes'``/``'no'``: a NULL comparison falls into ``'no'``
(SURVEY T4), exactly like ``IF(cond, 'yes', 'no')``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Touch column prefixes of the app-event table.
INSTALL = "install__ad_click__"
REENG = "reeng_click__"
ATTRIBUTION = "attribution_event__click__"

# Priority orders; one row may take some columns from one touch and others from
# another, so every column picks with its own order.
INSTALL_FIRST = (INSTALL, REENG, ATTRIBUTION)
ATTRIBUTION_FIRST = (ATTRIBUTION, REENG, INSTALL)
INSTALL_OR_REENG = (INSTALL, REENG)

# Literals the report's results depend on, as the report defines them.
ZERO_IDFA = "00000000-0000-0000-0000-000000000000"
BLANK_IDS = ("", ZERO_IDFA)  # identifiers that mean "no identifier"
YES, NO = "yes", "no"
DETERMINISTIC, PROBABILISTIC = "DETERMINISTIC", "PROBABILISTIC"
UNKNOWN_SUFFIX = "Unknown"  # device model names ending in it are unknown models
# creative format(s) -> report class, tested in this order; anything else, NULL included,
# is OTHER_AD_FORMAT
AD_FORMAT_CLASSES = (
    (("video",), "VAST"),
    (("native",), "native"),
    (("320x50", "728x90"), "banner"),
    (("300x250",), "mrec"),
)
OTHER_AD_FORMAT = "html-interstitial"


def touch_coalesce(suffix: str, order: tuple[str, ...]) -> Column:
    """First non-NULL of ``<touch><suffix>`` over the touches in ``order``."""
    return F.coalesce(*[F.col(prefix + suffix) for prefix in order])


def any_touch(suffix: str, values: list[str], order: tuple[str, ...] = ATTRIBUTION_FIRST) -> Column:
    """Whether some touch of ``order`` has one of ``values``."""
    tests = [F.col(prefix + suffix).isin(values) for prefix in order]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit(YES)).otherwise(F.lit(NO))


def ad_format_class(fmt: Column) -> Column:
    """Report class of a creative format (first matching entry of AD_FORMAT_CLASSES)."""
    out = None
    for formats, cls in AD_FORMAT_CLASSES:
        test = fmt == formats[0] if len(formats) == 1 else fmt.isin(*formats)
        out = F.when(test, F.lit(cls)) if out is None else out.when(test, F.lit(cls))
    return out.otherwise(F.lit(OTHER_AD_FORMAT))


def idfa_match(idfa: Column, platform_id: Column) -> Column:
    return yes_no(~idfa.isin(*BLANK_IDS) & (idfa == platform_id))


def idfa_missing(idfa: Column, platform_id: Column) -> Column:
    return yes_no(idfa.isin(*BLANK_IDS) | platform_id.isin(*BLANK_IDS))


def device_model_match(bid_model: Column, device_model: Column) -> Column:
    return yes_no(bid_model == device_model)


def unknown_device_model(bid_model: Column, device_model: Column) -> Column:
    return yes_no(
        bid_model.endswith(UNKNOWN_SUFFIX) | device_model.endswith(UNKNOWN_SUFFIX)
        | (device_model == "") | (bid_model == "")
    )


def match_flag_columns(idfa: Column, platform_id: Column, match_type: Column,
                       bid_model: Column, device_model: Column) -> dict[str, Column]:
    """The six install-quality columns of the funnel, by output name."""
    return {
        "idfa_match": idfa_match(idfa, platform_id),
        "idfa_missing": idfa_missing(idfa, platform_id),
        "match_type": match_type,
        "bidrequest_normalized_device_model": bid_model,
        "normalized_device_model_match": device_model_match(bid_model, device_model),
        "unknown_device_model": unknown_device_model(bid_model, device_model),
    }


def with_match_flags(df: DataFrame, idfa: Column, platform_id: Column, match_type: Column,
                     bid_model: Column, device_model: Column) -> DataFrame:
    """``df`` plus the six install-quality columns."""
    return df.withColumns(match_flag_columns(idfa, platform_id, match_type, bid_model,
                                             device_model))


def strongly_matched() -> Column:
    """Installs confidently matched to the right device."""
    return ((F.col("match_type") == DETERMINISTIC) | (F.col("idfa_match") == YES)
            | ((F.col("normalized_device_model_match") == YES)
               & (F.col("unknown_device_model") == NO)))


def _probabilistic_or_missing() -> Column:
    return (F.col("match_type") == PROBABILISTIC) | (F.col("idfa_missing") == YES)


def misattributed() -> Column:
    """Probabilistic (or id-less) matches whose device model contradicts the install."""
    return (_probabilistic_or_missing() & (F.col("normalized_device_model_match") != YES)
            & (F.col("unknown_device_model") != YES))


def possibly_misattributed() -> Column:
    """Probabilistic (or id-less) matches that cannot be checked: device model unknown."""
    return _probabilistic_or_missing() & (F.col("unknown_device_model") == YES)


QUALITY_CONDITIONS = {
    "strongly_matched_installs": strongly_matched,
    "misattributed_installs": misattributed,
    "possibly_misattributed_installs": possibly_misattributed,
}
