"""Expansion of A/B-test assignment arrays (``CROSS JOIN UNNEST``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adfunnel.spec import ExperimentSpec


def explode_assignments(df: DataFrame, arr: Column, test_id: int | None = None,
                        group_col: str = "ab_test_group_id",
                        test_col: str = "ab_test_id") -> DataFrame:
    """One row per assignment in ``arr``; a NULL or empty array yields no row.

    With ``test_id`` only that test's assignments are kept and just the group id is
    emitted. The filter stands right above the generator: exploding and filtering is
    code-generated, a lambda over the array is not. Duplicate assignments of the test
    still fan out. Without ``test_id`` every assignment becomes a row with ``test_col``
    and ``group_col``.
    """
    rows = df.withColumn("_assignment", F.explode(arr))
    if test_id is not None:
        rows = rows.where(F.col("_assignment")["id"] == F.lit(test_id))
    else:
        rows = rows.withColumn(test_col, F.col("_assignment")["id"])
    return rows.withColumn(group_col, F.col("_assignment")["group"]["id"]).drop("_assignment")


def assigned(df: DataFrame, arr: Column, spec: ExperimentSpec) -> DataFrame:
    """One row per assignment in ``arr`` to a test of ``spec``.

    Of a spec that stands for many reports, an assignment becomes a row for each report of
    its test, which the row names in the spec's ``lead`` column.
    """
    if spec.tests is None:
        return explode_assignments(df, arr, spec.test_id)
    return explode_assignments(df, arr).join(spec.tests, "ab_test_id")
