"""Dimension enrichment: LEFT joins of the name columns.

Which side is broadcast is Spark's choice, by size: ``autoBroadcastJoinThreshold`` on the
estimate of the projected dimension (keys and names only), and again by AQE on measured
bytes. No job runs while a plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfunnel.spec import Dims, ExperimentSpec

SPREAD = 16  # parts of one test group in a join that is not broadcast


@dataclass(frozen=True)
class DimJoin:
    dim: str
    on: tuple[tuple[str, str], ...]  # (fact column, dimension column)
    names: tuple[tuple[str, str], ...]  # (dimension column, output column)


CUSTOMERS = DimJoin("customers", (("customer_id", "id"),), (("company", "customer_name"),))
APPS = DimJoin("apps", (("dest_app_id", "id"), ("customer_id", "customer_id")),
               (("display_name", "dest_app_name"), ("salesforce_account_level", "account_level")))
GROUPS = DimJoin("ab_test_groups", (("ab_test_group_id", "id"),), (("name", "test_group_name"),))
CAMPAIGNS = DimJoin("campaigns", (("campaign_id", "id"),),
                    (("current_optimization_state", "current_optimization_state"),
                     ("display_name", "campaign_name")))


def dim_joins(spec: ExperimentSpec) -> list[DimJoin]:
    joins = [CUSTOMERS, APPS, GROUPS]
    if spec.by_campaign:
        joins.append(CAMPAIGNS)
    return joins


def name_columns(spec: ExperimentSpec) -> list[str]:
    return [out for j in dim_joins(spec) for _, out in j.names]


def assert_unique(dim: DataFrame, keys: list[str]) -> None:
    """Raise if ``keys`` repeat in ``dim`` (a repeat multiplies report sums)."""
    dup = dim.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate dimension key {[dup[0][k] for k in keys]} on {keys}")


def enrich(df: DataFrame, dims: Dims, spec: ExperimentSpec, spread: str | None = None) -> DataFrame:
    """LEFT-join the name columns of each dimension onto ``df``.

    Unmatched or NULL keys keep the row with NULL names. Only join keys and name
    columns leave each dimension scan.

    A report holds a handful of test group ids, so a join hashed on that id alone would run
    in as many tasks. ``spread`` names a column of ``df`` with values 0 to ``SPREAD - 1``;
    the groups are then repeated for each value and joined on both.
    """
    joins = dim_joins(spec)
    tables = [getattr(dims, j.dim) for j in joins]
    missing = [j.dim for j, t in zip(joins, tables) if t is None]
    if missing:
        raise ValueError(f"this report needs the {', '.join(missing)} dimension(s)")
    sides = [t.select(*[F.col(d).alias(f"_{j.dim}_{d}") for _, d in j.on],
                      *[F.col(d).alias(out_name) for d, out_name in j.names])
             for t, j in zip(tables, joins)]
    out = df
    for j, side in zip(joins, sides):
        tag = f"_{j.dim}_"
        cond = None
        for fact_col, dim_col in j.on:
            eq = out[fact_col] == side[tag + dim_col]
            cond = eq if cond is None else cond & eq
        if spread and j is GROUPS:
            side = side.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
            cond = cond & (out[spread] == side["_part"])
        out = out.join(side, cond, "left")
    # the dimensions' join keys go in one projection at the end
    return out.select(*df.columns, *name_columns(spec))
