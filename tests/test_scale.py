"""Scale behaviour: hot keys are pre-aggregated before every shuffle, and results do
not depend on how the input is partitioned."""

import os
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from adfunnel import SPEC_B, Dims, Facts, experiment_report  # noqa: E402
from adfunnel.sources.derived import derive_dims, derive_facts  # noqa: E402
from adfunnel.sources.scan import FACT_TABLES  # noqa: E402
from tables_at import SF_CHECK, SF_SMALL  # noqa: E402
from oracle.report_sql import REPORT_B, ReportSQL  # noqa: E402
from oracle_check import fingerprint  # noqa: E402


def _formatted(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def skewed_lake(spark, tmp_path_factory):
    """sf0.01 facts plus copies of half the app events that all carry one event's
    values (NULL auction id, in-segment), so a third of all app events fall into a
    couple of per-auction groups."""
    root = str(tmp_path_factory.mktemp("skew"))
    facts = derive_facts(spark, SF_CHECK)
    events = facts.app_events
    pinned = {"campaign_tracker_type": "MMP", "app_platform": "IOS",
              "ad_group_type": "user-acquisition", "sk_ad_network_response__version": "2.2"}
    model = events.where(F.col("install__at").isNotNull()).first().asDict()
    cols = []
    for field in events.schema.fields:
        c = field.name
        if c == "dt" or c.endswith("ab_test_assignments"):
            cols.append(F.col(c))
            continue
        value = model[c]
        if c.endswith("impression__auction_id"):
            value = None
        elif c == "is_uncredited":
            value = False
        for attr, v in pinned.items():
            if c.endswith("__" + attr):
                value = v
        cols.append(F.lit(value).cast(field.dataType).alias(c))
    n = events.count()
    skewed = events.unionByName(events.limit(n // 2).select(*cols))
    for name in FACT_TABLES:
        df = skewed if name == "app_events" else getattr(facts, name)
        df.write.parquet(f"{root}/{name}")
    dims = derive_dims(spark, SF_CHECK)
    for name in ("customers", "apps", "ab_test_groups", "campaigns"):
        getattr(dims, name).write.parquet(f"{root}/{name}")
    return root


def _load(spark, root):
    facts = Facts(**{n: spark.read.parquet(f"{root}/{n}") for n in FACT_TABLES})
    dims = Dims(**{n: spark.read.parquet(f"{root}/{n}")
                   for n in ("customers", "apps", "ab_test_groups", "campaigns")})
    return facts, dims


def test_hot_group_is_combined_map_side(spark, skewed_lake):
    facts, dims = _load(spark, skewed_lake)
    hot = facts.app_events.where(F.col("install__ad_click__impression__auction_id").isNull()
                                 & F.col("reeng_click__impression__auction_id").isNull()
                                 & F.col("attribution_event__click__impression__auction_id")
                                 .isNull()).count()
    assert hot * 3 >= facts.app_events.count()
    rep = experiment_report(facts, dims, SPEC_B)
    plan = _formatted(rep)
    tree = plan.split("\n\n")[0]
    exchanges = re.findall(r"Exchange \((\d+)\)\n\s*[:|+\- ]*HashAggregate \((\d+)\)", tree)
    assert len(exchanges) == 2, tree
    for _, child in exchanges:
        detail = re.search(rf"\({child}\) HashAggregate.*?\n\n", plan, flags=re.S).group(0)
        assert "partial_sum" in detail, detail

    got = rep.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c)
                       for c, t in rep.dtypes])
    con = duckdb.connect()
    for n in list(FACT_TABLES) + ["customers", "apps", "ab_test_groups", "campaigns"]:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{skewed_lake}/{n}/*.parquet')")
    r = ReportSQL(REPORT_B)
    doubles = [c for c, t in rep.dtypes if t == "double"]
    sql = (f"SELECT * REPLACE ({', '.join(f'round({c}, 4) AS {c}' for c in doubles)}) "
           f"FROM (WITH {r.ctes()} {r.report()})")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    rows = [tuple(x) for x in got.collect()]
    assert len(rows) == len(want)
    assert fingerprint(got.columns, rows) == fingerprint(cols, want)


def test_partitioning_does_not_change_results(spark):
    facts, dims = derive_facts(spark, SF_SMALL), derive_dims(spark, SF_SMALL)
    shuffled = Facts(**{n: getattr(facts, n).repartition(13) for n in FACT_TABLES})
    a = experiment_report(facts, dims, SPEC_B)
    b = experiment_report(shuffled, dims, SPEC_B)
    assert a.count() > 0
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
