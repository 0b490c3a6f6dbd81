"""Ad-funnel fact and dimension tables derived from the driver's generic tables.

The test tables have no ad facts, so each fact row is derived from one ``events``
row (event_id ``e``, user_id ``u``, epoch millis ``ms``, value ``v``) by integer
arithmetic, and the dimensions from ``customer``, ``part``, ``nation`` and
``supplier``. Every derived column is one SQL expression in the subset that Spark
and DuckDB read identically (``CASE``, ``%``, ``+``, ``||``, ``CAST``); ``{div}``
stands for integer division (Spark ``div``, DuckDB ``//``). The oracle renders the
same rules for DuckDB, so both engines see the same facts. Only the assignment
arrays need engine-specific constructors. The work grows with ``events``.

Every value pattern exists to reach a reference behaviour: NULL/empty/duplicate
assignment arrays, NULLs in each filter column, all touch-priority mixes, the
identifier and device-model truth tables, revenue at and past the gates and cap,
installs on both sides of the seven-day cohort edge, and dimension misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfunnel.functions.attribution import ATTRIBUTION, INSTALL, REENG, ZERO_IDFA
from adfunnel.functions.hours import epoch_ntz
from adfunnel.spec import SPEC_A, SPEC_B, Dims, Facts

TOUCHES = (INSTALL, REENG, ATTRIBUTION)

# Value lists the derivation cycles through (our own test values; the zero identifier,
# match types and creative formats are the report's fixed values, to reach its cases).
IDS = (None, "", ZERO_IDFA, "A1B2-0001", "A1B2-0002")
MODELS = (None, "", "iPhone 12", "iPhone Unknown", "iPad 9")
MATCH_TYPES = (None, "DETERMINISTIC", "PROBABILISTIC", "N/A", "FUZZY")
FAMILIES = ("iPhone", "iPad", "iPod", None)
FORMATS = ("video", "native", "320x50", "728x90", "300x250", "480x320", None)
CREATIVE_TYPES = ("image", "video", "playable", None)
TRACKERS = ("appsflyer", "adjust", "branch", "kochava", "singular", None)
SKAN_VERSIONS = (None, "", "2.2", "3.0", "4.0")
EVENT_SKAN_VERSIONS = (None, "", "3.0")
OTHER_TEST_ID = 9


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def pick(values, index: str) -> str:
    """``values[index % len(values)]`` as a CASE expression."""
    arms = " ".join(f"WHEN {i} THEN {sql_literal(v)}" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {arms} END"


def _populated(t: int) -> str:
    """Which touches an app event carries: one by ``e % 3``, all three when ``e % 5 = 0``."""
    return f"(e % 5 = 0 OR e % 3 = {t})"


def _gate(cond: str | None, expr: str) -> str:
    return expr if cond is None else f"CASE WHEN {cond} THEN {expr} END"


CENTS = "CAST(round(v * 100) AS BIGINT)"
# Late events: logged one hour after they happened, so their event hour precedes dt.
EVENT_MS = "CASE WHEN e % 17 = 3 THEN ms - 3600000 ELSE ms END"


def bid_rules(prefix: str, t: int = 0, *, gate: str | None = None, campaign: bool = True,
              device_ids: bool = False, target_event: bool = False) -> list[tuple[str, str]]:
    """Bid attribute rules under ``prefix``; ``t`` shifts values between touches."""
    rules = [
        ("customer_id", f"CASE WHEN e % 19 = 0 THEN -1 - u ELSE u + {t} END"),
        ("app_id", f"7 * (u + {t}) + e % 9"),
        ("bid_request__non_personalized", pick((True, False, None), f"e + {t}")),
        ("bid_request__device__family", pick(FAMILIES, f"e {{div}} 2 + {t}")),
        ("creative__ad_format", pick(FORMATS, f"e {{div}} 3 + {t}")),
        ("creative__type", pick(CREATIVE_TYPES, f"e {{div}} 4 + {t}")),
        ("campaign_tracker", pick(TRACKERS, f"e {{div}} 5 + {t}")),
        ("campaign_tracker_type",
         f"CASE (e + {t}) % 17 WHEN 0 THEN 'SKAN' WHEN 1 THEN NULL ELSE 'MMP' END"),
        ("app_platform",
         f"CASE (e + {t}) % 19 WHEN 0 THEN 'ANDROID' WHEN 1 THEN NULL ELSE 'IOS' END"),
        ("ad_group_type",
         f"CASE (e + {t}) % 23 WHEN 0 THEN 'retargeting' WHEN 1 THEN NULL "
         f"ELSE 'user-acquisition' END"),
        ("sk_ad_network_response__version", pick(SKAN_VERSIONS, f"e {{div}} 7 + {t}")),
    ]
    if campaign:
        rules.append(("campaign_id", f"(u + {t}) % 120"))
    if device_ids:
        rules += [("bid_request__device__platform_specific_id", pick(IDS, "e {div} 5")),
                  ("bid_request__device__model_data__name", pick(MODELS, "e {div} 25"))]
    if target_event:
        rules.append(("campaign_target_event_id", f"(u + {t}) % 4"))
    return [(prefix + name, _gate(gate, expr)) for name, expr in rules]


# Fact rules: (column, expression). Assignment columns are listed separately as
# (column, pattern expression, gate) because array constructors differ by engine.
FACT_RULES: dict[str, list[tuple[str, str]]] = {
    "impressions": [
        ("dt", "dt"), ("at", "ms"),
        ("spend_micros", f"CASE WHEN e % 13 = 0 THEN NULL ELSE {CENTS} * 10000 END"),
        ("revenue_micros", f"CASE WHEN e % 4 = 0 THEN NULL ELSE {CENTS} * 20000 END"),
    ] + bid_rules("bid__"),
    "ad_clicks": [
        ("dt", "dt"), ("at", "ms"), ("impression__at", "ms - (e % 50 + 1) * 60000"),
        ("has_prior_click", pick((False, True, False, None), "e {div} 2")),
    ] + bid_rules("impression__bid__"),
    "installs": [
        ("dt", "dt"), ("event_timestamp", EVENT_MS),
        ("ad_click__at", "ms - (e % 30 + 1) * 60000"),
        ("ad_click__impression__at", "ms - (e % 30 + e % 50 + 2) * 60000"),
        ("is_viewthrough", pick((False, True, None), "e {div} 4")),
        ("for_reporting", pick((True, True, False, None), "e {div} 2")),
        ("is_uncredited", pick((False, False, False, True, None), "e {div} 3")),
        ("tracker_params__idfa", pick(IDS, "e")),
        ("tracker_params__match_type", pick(MATCH_TYPES, "e {div} 7")),
        ("pod_device_model", pick(MODELS, "e {div} 125")),
        ("skan_params__version", pick(EVENT_SKAN_VERSIONS, "e {div} 6")),
    ] + bid_rules("ad_click__impression__bid__", device_ids=True),
}
FACT_RULES["view_clicks"] = FACT_RULES["ad_clicks"]

_app_rules = [
    ("dt", "dt"), ("event_timestamp", EVENT_MS),
    ("install__at", f"CASE WHEN e % 11 = 0 OR NOT {_populated(0)} THEN NULL "
                    f"ELSE ms - (e % 240) * 3600000 END"),
    ("install__tracker_params__idfa", _gate(_populated(0), pick(IDS, "e"))),
    ("install__tracker_params__match_type", _gate(_populated(0), pick(MATCH_TYPES, "e {div} 7"))),
    ("pod_device_model", pick(MODELS, "e {div} 125")),
    ("skan_params__version", pick(EVENT_SKAN_VERSIONS, "e {div} 6")),
    ("is_viewthrough", pick((False, True, None), "e {div} 4")),
    ("for_reporting", pick((True, True, False, None), "e {div} 2")),
    ("first_occurrence", pick((True, False, None), "e {div} 3")),
    ("is_uncredited", pick((False, False, False, True, None), "e {div} 5")),
    ("custom_event_id", "e % 4"),
    ("customer_revenue_micros",
     "CASE WHEN e % 23 = 0 THEN 100000000000 WHEN e % 37 = 0 THEN 99999999999 "
     "WHEN e % 41 = 0 THEN -100000000000 WHEN e % 31 = 0 THEN NULL "
     f"WHEN e % 29 = 0 THEN -{CENTS} * 30000 ELSE {CENTS} * 30000 END"),
]
for _t, _touch in enumerate(TOUCHES):
    _g = _populated(_t)
    _app_rules += [
        (_touch + "at", _gate(_g, f"ms - (e % 30 + {1 + 7 * _t}) * 60000")),
        (_touch + "impression__at", _gate(_g, f"ms - (e % 30 + e % 50 + {2 + 7 * _t}) * 60000")),
        (_touch + "impression__auction_id",
         _gate(_g, "CASE WHEN e % 13 = 0 THEN NULL "
                   f"ELSE 'auc-' || CAST(u % 5 + {10 * _t} AS STRING) END")),
    ] + bid_rules(_touch + "impression__bid__", _t, gate=_g, device_ids=_t == 0,
                  target_event=_t < 2)
FACT_RULES["app_events"] = _app_rules

# (column, assignment pattern expression, gate)
ASSIGNMENT_RULES: dict[str, list[tuple[str, str, str | None]]] = {
    "impressions": [("bid__bid_request__ab_test_assignments", "e % 7", None)],
    "ad_clicks": [("impression__bid__bid_request__ab_test_assignments", "e % 7", None)],
    "installs": [("ad_click__impression__bid__bid_request__ab_test_assignments", "e % 7", None)],
    "app_events": [
        (INSTALL + "impression__bid__bid_request__ab_test_assignments", "e % 7", _populated(0)),
        (REENG + "impression__bid__bid_request__ab_test_assignments", "(e + 3) % 7", _populated(1)),
    ],
}
ASSIGNMENT_RULES["view_clicks"] = ASSIGNMENT_RULES["ad_clicks"]

# Assignment patterns, by pattern number: list of (test id, group id SQL or None).
# 0 -> NULL array, 1 -> empty array; None group -> NULL group struct;
# "NULLID" -> group with NULL id.
GROUP_A = f"{SPEC_A.control_group} + u % 2"
GROUP_B = f"{SPEC_B.control_group} + u % 2"
ASSIGNMENT_PATTERNS: dict[int, list[tuple[int, str | None]] | None] = {
    0: None,
    1: [],
    2: [(OTHER_TEST_ID, "1")],
    3: [(SPEC_A.test_id, GROUP_A), (SPEC_A.test_id, GROUP_A),
        (SPEC_B.test_id, GROUP_B), (SPEC_B.test_id, GROUP_B)],
    4: [(SPEC_A.test_id, None), (SPEC_B.test_id, "NULLID")],
    5: [(SPEC_A.test_id, f"{SPEC_A.control_group} + u % 3"), (OTHER_TEST_ID, "1")],
    6: [(SPEC_B.test_id, GROUP_B), (OTHER_TEST_ID, "1")],
}

EVENT_TYPES = {
    "impressions": "event_type = 'view'",
    "ad_clicks": "event_type = 'click' AND e % 2 = 1",
    "view_clicks": "event_type = 'click' AND e % 2 = 0",
    "installs": "event_type = 'signup'",
    "app_events": "event_type = 'purchase'",
}

DIM_RULES: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "customers": ("customer", [("id", "c_custkey"), ("company", "c_name")]),
    "apps": ("part", [("id", "p_partkey"), ("customer_id", "p_partkey {div} 7"),
                      ("display_name", "p_name"), ("salesforce_account_level", "p_brand")]),
    "ab_test_groups": ("nation", [
        ("id", "CAST(CASE WHEN n_nationkey < 12 THEN 2373 + n_nationkey "
               "ELSE 2400 + n_nationkey END AS BIGINT)"),
        ("name", "n_name")]),
    "campaigns": ("supplier", [
        ("id", "s_suppkey"), ("display_name", "s_name"),
        ("current_optimization_state",
         "CASE s_nationkey % 3 WHEN 0 THEN 'LEARNING' WHEN 1 THEN 'OPTIMIZED' END")]),
}

_SPARK = {"div": "div"}


def _spark_expr(sql: str) -> Column:
    return F.expr(sql.format(**_SPARK))


def _epoch_ms(ts_type: T.DataType) -> Column:
    if isinstance(ts_type, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", epoch_ntz(), F.col("ts"))
    return F.unix_millis(F.col("ts"))


ASSIGNMENTS_DDL = "ARRAY<STRUCT<id: BIGINT, `group`: STRUCT<id: BIGINT>>>"


def _spark_assignment(test_id: int, group: str | None) -> str:
    if group is None:
        grp = "CAST(NULL AS STRUCT<id: BIGINT>)"
    elif group == "NULLID":
        grp = "named_struct('id', CAST(NULL AS BIGINT))"
    else:
        grp = f"named_struct('id', CAST({group.format(**_SPARK)} AS BIGINT))"
    return f"named_struct('id', CAST({test_id} AS BIGINT), 'group', {grp})"


def _spark_assignments(pattern: str, gate: str | None) -> str:
    arms = []
    for number, items in ASSIGNMENT_PATTERNS.items():
        if items is None:
            value = f"CAST(NULL AS {ASSIGNMENTS_DDL})"
        else:
            elems = ", ".join(_spark_assignment(t, g) for t, g in items)
            value = f"CAST(array({elems}) AS {ASSIGNMENTS_DDL})"
        arms.append(f"WHEN {number} THEN {value}")
    expr = f"CASE ({pattern.format(**_SPARK)}) {' '.join(arms)} END"
    return expr if gate is None else f"CASE WHEN {gate.format(**_SPARK)} THEN {expr} END"


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as (e, u, ms, v, dt, event_type), time-zone independent."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = _epoch_ms(ev.schema["ts"].dataType)
    return ev.select(
        F.col("event_id").alias("e"), F.col("user_id").alias("u"), ms.alias("ms"),
        F.col("value").alias("v"), F.col("event_type"),
    ).withColumn("dt", F.date_format(F.timestamp_add("MILLISECOND", F.col("ms"), epoch_ntz()),
                                     "yyyy-MM-dd'T'HH"))


def derive_fact(events: DataFrame, name: str) -> DataFrame:
    """One fact table; a single ``selectExpr`` keeps plan building to one JVM call."""
    cols = [f"{sql.format(**_SPARK)} AS `{col}`" for col, sql in FACT_RULES[name]]
    cols += [f"{_spark_assignments(p, g)} AS `{col}`" for col, p, g in ASSIGNMENT_RULES[name]]
    return events.where(_spark_expr(EVENT_TYPES[name])).selectExpr(*cols)


def derive_facts(spark: SparkSession, sf_dir: str) -> Facts:
    events = base_events(spark, sf_dir)
    return Facts(**{name: derive_fact(events, name) for name in EVENT_TYPES})


def derive_dims(spark: SparkSession, sf_dir: str) -> Dims:
    out = {}
    for name, (table, rules) in DIM_RULES.items():
        src = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        out[name] = src.selectExpr(*[f"{sql.format(**_SPARK)} AS `{col}`" for col, sql in rules])
    return Dims(**out)
