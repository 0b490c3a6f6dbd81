"""Assignment expansion, filters and enrichment on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from adfunnel.operators.enrich import assert_unique
from adfunnel.operators.expand import explode_assignments
from adfunnel.operators.filters import credited, first_click
from adfunnel.sources.schemas import ASSIGNMENTS

ASG_SCHEMA = f"k int, arr {ASSIGNMENTS.simpleString()}"


def _asg(test, group):
    return {"id": test, "group": None if group is None else {"id": group}}


def test_explode_null_empty_and_duplicates(spark):
    data = [(1, None), (2, []), (3, [_asg(1067, 2373), _asg(9, 1)]),
            (4, [_asg(1067, 2374), _asg(1067, 2374)]), (5, [_asg(1067, None), _asg(None, 5)])]
    df = spark.createDataFrame(data, ASG_SCHEMA)
    every = explode_assignments(df, F.col("arr")).select("k", "ab_test_id", "ab_test_group_id")
    assert sorted((tuple(r) for r in every.collect()), key=str) == sorted(
        [(3, 1067, 2373), (3, 9, 1), (4, 1067, 2374), (4, 1067, 2374), (5, 1067, None),
         (5, None, 5)], key=str)
    one = explode_assignments(df, F.col("arr"), 1067).select("k", "ab_test_group_id")
    # duplicates fan out; a NULL group keeps the row with a NULL group id; NULL test id drops
    assert sorted((tuple(r) for r in one.collect()), key=str) == sorted(
        [(3, 2373), (4, 2374), (4, 2374), (5, None)], key=str)


def test_credited_and_first_click_drop_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [r.f for r in credited(df, "f").collect()] == [False]
    assert [r.f for r in first_click(df, "f").collect()] == [False]


def test_assert_unique(spark):
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id long, name string")
    assert_unique(dim, ["id"])
    with pytest.raises(ValueError):
        assert_unique(dim.unionByName(dim), ["id"])


def test_with_match_flags_adds_quality_columns(spark):
    from adfunnel.functions import with_match_flags
    df = spark.createDataFrame([("A", "A", "DETERMINISTIC", "iPhone 12", "iPhone 12")],
                               "i string, p string, t string, b string, m string")
    out = with_match_flags(df, F.col("i"), F.col("p"), F.col("t"), F.col("b"), F.col("m"))
    row = out.first()
    assert (row.idfa_match, row.idfa_missing, row.match_type, row.normalized_device_model_match,
            row.unknown_device_model) == ("yes", "no", "DETERMINISTIC", "yes", "no")
    assert row.bidrequest_normalized_device_model == "iPhone 12"


def test_enrich_names_a_missing_dimension(spark):
    from adfunnel import SPEC_B, Dims
    from adfunnel.operators.enrich import enrich
    dim = spark.createDataFrame([(1, "x")], "id long, name string")
    dims = Dims(customers=dim, apps=dim, ab_test_groups=dim)
    with pytest.raises(ValueError, match="campaigns"):
        enrich(spark.createDataFrame([(1,)], "customer_id long"), dims, SPEC_B)


def test_duplicate_free_assignments_do_not_fan_out(spark):
    from adfunnel import SPEC_A
    from adfunnel.sources.derived import derive_facts
    from tables_at import SF_SMALL
    imp = derive_facts(spark, SF_SMALL).impressions
    arr = F.col("bid__bid_request__ab_test_assignments")
    hits = F.size(F.filter(arr, lambda a: a["id"] == SPEC_A.test_id))
    once = imp.where(hits == 1)
    assert once.count() > 0
    assert explode_assignments(once, arr, SPEC_A.test_id).count() == once.count()
    twice = imp.where(hits == 2)
    assert explode_assignments(twice, arr, SPEC_A.test_id).count() == 2 * twice.count()
