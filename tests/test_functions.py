"""Truth tables and NULL traps of the column functions (FIXTURES §3, SURVEY T1-T7)."""

import itertools

import pytest
from pyspark.sql import functions as F

from adfunnel.functions import (
    ad_format_class, capped, device_model_match, dt_add, dt_hours, hour_iso, idfa_match,
    idfa_missing, revenue_gate, squared_capped, unknown_device_model, within_days,
)
from adfunnel.functions.attribution import (
    ZERO_IDFA, misattributed, possibly_misattributed, strongly_matched,
)
from adfunnel.functions.hours import HOUR_MS, bucket_from_iso, hour_bucket
from adfunnel.operators.filters import skan_compatible

Z = ZERO_IDFA


def _rows(spark, schema, data, *cols):
    return spark.createDataFrame(data, schema).select(*cols).collect()


def test_idfa_flags(spark):
    idfas, pids = [None, "", Z, "A"], [None, "", Z, "A", "B"]
    data = list(itertools.product(idfas, pids))
    out = _rows(spark, "idfa string, pid string", data, "idfa", "pid",
                idfa_match(F.col("idfa"), F.col("pid")).alias("m"),
                idfa_missing(F.col("idfa"), F.col("pid")).alias("x"))
    assert len(out) == 20
    for r in out:
        blank = r.idfa in ("", Z) or r.pid in ("", Z)
        assert r.x == ("yes" if blank else "no"), r
        assert r.m == ("yes" if r.idfa == "A" and r.pid == "A" else "no"), r
    # NULL idfa alone is not "missing" (T4)
    assert [r.x for r in out if r.idfa is None and r.pid in (None, "A", "B")] == ["no"] * 3


def test_device_model_flags(spark):
    models = [None, "", "iPhone 12", "iPhone Unknown", "iPad 9"]
    data = list(itertools.product(models, models))
    out = _rows(spark, "b string, p string", data, "b", "p",
                device_model_match(F.col("b"), F.col("p")).alias("m"),
                unknown_device_model(F.col("b"), F.col("p")).alias("u"))
    for r in out:
        both = r.b is not None and r.p is not None
        assert r.m == ("yes" if both and r.b == r.p else "no"), r
        unknown = any(v is not None and (v == "" or v.endswith("Unknown")) for v in (r.b, r.p))
        assert r.u == ("yes" if unknown else "no"), r


def test_quality_metric_overlap_counts(spark):
    types = [None, "DETERMINISTIC", "PROBABILISTIC", "N/A", "other"]
    yn = ["yes", "no"]
    data = list(itertools.product(types, yn, yn, yn, yn))
    df = spark.createDataFrame(data, "match_type string, idfa_match string, idfa_missing string,"
                               " normalized_device_model_match string, unknown_device_model string")
    out = df.select(F.coalesce(strongly_matched(), F.lit(False)).cast("int").alias("s"),
                    F.coalesce(misattributed(), F.lit(False)).cast("int").alias("m"),
                    F.coalesce(possibly_misattributed(), F.lit(False)).cast("int").alias("p"))
    counts = {(r.s, r.m, r.p): r["count"] for r in out.groupBy("s", "m", "p").count().collect()}
    assert counts == {(1, 0, 0): 35, (1, 0, 1): 14, (0, 0, 1): 10, (0, 0, 0): 9,
                      (1, 1, 0): 7, (0, 1, 0): 5}


def test_ad_format_class(spark):
    data = [("video",), ("native",), ("320x50",), ("728x90",), ("300x250",), ("480x320",),
            (None,)]
    out = _rows(spark, "f string", data, ad_format_class(F.col("f")).alias("c"))
    assert [r.c for r in out] == ["VAST", "native", "banner", "banner", "mrec",
                                  "html-interstitial", "html-interstitial"]


def test_skan_compatible(spark):
    data = [(None, None), (None, ""), (None, "2.2"), ("", None), ("", "2.2"), ("3.0", None)]
    out = _rows(spark, "v string, fb string", data,
                skan_compatible(F.col("v"), F.col("fb")).alias("ok"),
                skan_compatible(F.col("v")).alias("bid_ok"))
    assert [r.ok for r in out] == [False, True, True, False, True, True]
    assert [r.bid_ok for r in out] == [False, False, False, True, True, True]


def test_revenue_gate(spark):
    data = [(100_000_000_000, True), (-100_000_000_000, True), (99_999_999_999, True),
            (5, False), (5, None), (None, True)]
    out = _rows(spark, "x long, f boolean", data,
                revenue_gate(F.col("x"), F.col("f"), 100_000_000_000).alias("g"))
    assert [r.g for r in out] == [None, None, 99_999_999_999, None, None, None]


def test_cap_and_square_keep_null(spark):
    data = [(1_500_000,), (500_000_000,), (600_000_000,), (-2_500_000,), (-700_000_000,), (None,)]
    out = _rows(spark, "x long", data, capped(F.col("x"), 500_000_000).alias("c"),
                squared_capped(F.col("x"), 500_000_000).alias("s"),
                F.least(F.col("x"), F.lit(500_000_000)).alias("raw"))
    assert [r.c for r in out] == [1_500_000, 500_000_000, 500_000_000, -2_500_000,
                                  -700_000_000, None]
    assert [r.s for r in out][:5] == pytest.approx([2.25, 250000.0, 250000.0, 6.25, 490000.0])
    assert out[5].s is None
    assert out[5].raw == 500_000_000  # Spark's least skips NULL: why the guard exists (T1)


def test_hour_iso_ignores_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        data = [(1686531234567,), (None,), (-500,), (-1500,)]
        out = _rows(spark, "ms long", data, hour_iso(F.col("ms")).alias("h"))
        assert [r.h for r in out] == ["2023-06-12T00:00:00Z", None, "1970-01-01T00:00:00Z",
                                      "1969-12-31T23:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bucket_round_trip_and_cohort_window(spark):
    base = 1704085200000
    data = [(base, base - 167 * HOUR_MS), (base, base - 168 * HOUR_MS),
            (base, base + 265 * HOUR_MS), (base, None)]
    out = _rows(spark, "at long, inst long", data,
                within_days(hour_bucket(F.col("at")), hour_bucket(F.col("inst")), 7).alias("d7"),
                bucket_from_iso(hour_iso(F.col("at"))).alias("rt"))
    assert [r.d7 for r in out] == [True, False, True, None]
    assert {r.rt for r in out} == {base}


def test_dt_add():
    assert dt_add("2023-06-12T23", 1) == "2023-06-13T00"
    assert dt_add("2024-02-28T23", 25) == "2024-03-01T00"
    assert dt_hours("2023-06-12T22", "2023-06-13T01") == ["2023-06-12T22", "2023-06-12T23",
                                                          "2023-06-13T00"]
