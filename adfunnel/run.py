"""Command line for scheduled runs: the report for one hour (or a range of hours).

    python -m adfunnel.run --spec B --dt 2023-07-03T05 \\
        --facts s3://lake/facts --dims s3://lake/dims --sink s3://lake/reports/ab_1084

``--end`` turns the run into a backfill of ``[dt, end)``, still one job, with every
hour reported and capped on its own. Re-running an hour replaces its partition.
The session comes from the environment (``spark-submit`` / cluster defaults).
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from adfunnel.functions.hours import dt_add, dt_hours
from adfunnel.sources.scan import check_hours, read_dims, read_facts
from adfunnel.sources.sink import write_hours
from adfunnel.sources.versions import commit_hours
from adfunnel.spec import SPEC_A, SPEC_B
from adfunnel.streaming.hourly import catch_up, run_hours

SPECS = {"A": SPEC_A, "B": SPEC_B}


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="adfunnel.run", description=__doc__.split("\n")[0])
    p.add_argument("--spec", choices=sorted(SPECS), required=True)
    p.add_argument("--test-id", type=int, help="override the spec's A/B test id")
    p.add_argument("--control-group", type=int, help="override the spec's control group id")
    p.add_argument("--test-group", type=int, help="override the spec's test group id")
    p.add_argument("--catch-up", action="store_true",
                   help="write only the hours of [dt, end) whose facts are not reported yet")
    p.add_argument("--dt", required=True, help="first hour, YYYY-MM-DDTHH")
    p.add_argument("--end", help="exclusive last hour (default: dt + 1 hour)")
    p.add_argument("--facts", required=True, help="root of the five fact tables")
    p.add_argument("--dims", required=True, help="root of the dimension tables")
    p.add_argument("--sink", required=True, help="hour-partitioned report output")
    p.add_argument("--versioned", action="store_true",
                   help="commit the hours as a new version of the sink, all at once")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    args = parse(argv)
    spec = SPECS[args.spec]
    given = {k: getattr(args, k) for k in ("test_id", "control_group", "test_group")}
    spec = replace(spec, **{k: v for k, v in given.items() if v is not None})
    spark = SparkSession.builder.appName(f"adfunnel-{args.spec}-{args.dt}").getOrCreate()
    names = ["customers", "apps", "ab_test_groups"] + (["campaigns"] if spec.by_campaign else [])
    facts, dims = read_facts(spark, args.facts), read_dims(spark, args.dims, names)
    end = args.end or dt_add(args.dt, 1)
    write = commit_hours if args.versioned else write_hours
    if args.catch_up:
        catch_up(spark, facts, dims, spec, args.dt, end, args.sink,
                 check=lambda hours: check_hours(spark, args.facts, hours), write=write)
    else:
        check_hours(spark, args.facts, dt_hours(args.dt, end))
        run_hours(facts, dims, spec, args.dt, end, args.sink, write)


if __name__ == "__main__":
    main()
