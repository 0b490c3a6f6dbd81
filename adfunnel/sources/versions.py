"""Report sink with versions: hours appear all at once, by one small file written last.

A run writes its rows once, below ``runs/run=<id>/dt=<hour>``, where no reader looks yet. A
commit file then names the run and every hour it was made for. Each hour is read from the
last commit that names it, so a run that dies anywhere before its commit file leaves all
former hours readable, and several hours are replaced together or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT = "number long, run string, hours array<string>, filled array<string>, columns string"


def _fs(spark: SparkSession, path: str):
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    return fs_path, fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def commit_hours(df: DataFrame, path: str, hours: Sequence[str], dt_col: str = "dt") -> int:
    """Write a report with a ``dt`` column as the new version of ``hours``; returns its number.

    An hour of ``hours`` without a row is empty from then on. Rows of other hours raise, before
    anything is committed. Of two runs that commit an hour, the one with the later number holds.
    """
    spark = df.sparkSession
    if not hours:
        raise ValueError("a version replaces one hour at least")
    run = uuid.uuid4().hex
    data = f"{path}/runs/run={run}"
    df.hint("rebalance", dt_col).write.partitionBy(dt_col).parquet(data)
    fs_path, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(fs_path(data))]
    filled = sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{dt_col}="))
    if not set(filled) <= set(hours):
        fs.delete(fs_path(data), True)
        raise ValueError(f"rows of hours that were not to be replaced: {sorted(set(filled) - set(hours))}")
    columns = T.StructType([f for f in df.schema.fields if f.name != dt_col]).json()
    number = max((_number(n) for n in _commit_files(spark, path)), default=-1)
    while True:
        number += 1
        text = json.dumps({"number": number, "run": run, "hours": sorted(hours), "filled": filled,
                           "columns": columns})
        target = fs_path(f"{path}/commits/{number:012d}.json")
        if fs.exists(target):
            continue
        try:
            # never replaces a file: of two runs that want a number, one goes on to the next
            out = fs.create(target, False)
        except Exception:
            if not fs.exists(target):
                raise
            continue
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return number


def _commit_files(spark: SparkSession, path: str) -> list[str]:
    fs_path, fs = _fs(spark, path)
    folder = fs_path(f"{path}/commits")
    return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []


def _number(name: str) -> int:
    stem = name.split(".")[0]
    return int(stem) if stem.isdigit() else -1


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """COMMIT of the whole files; one that its writer left unfinished is no commit."""
    try:
        return spark.read.schema(COMMIT).json(f"{path}/commits").where("columns IS NOT NULL")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    """``dt, number, run, filled, columns``: the commit that each hour is read from."""
    commits = _commits(spark, path)
    if commits is None:
        return None
    by_hour = commits.select(F.explode("hours").alias("dt"), "number", "run", "filled", "columns")
    last = by_hour.groupBy("dt").agg(F.max_by(F.struct(*by_hour.columns[1:]), "number").alias("last"))
    return last.select("dt", "last.number", "last.run",
                       F.array_contains("last.filled", F.col("dt")).alias("filled"), "last.columns")


def read_hours(spark: SparkSession, path: str, start: str | None = None,
               end: str | None = None, dt_col: str = "dt") -> DataFrame:
    """The committed rows of ``start <= dt < end``. Hours with other columns are filled with
    NULL for what they lack; the columns are those of the last commit."""
    latest = versions(spark, path)
    if latest is None:
        raise ValueError(f"nothing was committed below {path}")
    rows = latest.collect()  # one row per hour
    if not rows:
        raise ValueError(f"nothing was committed below {path}")
    columns = T.StructType.fromJson(json.loads(max(rows, key=lambda r: r.number).columns))
    schema = T.StructType([*columns.fields, T.StructField(dt_col, T.StringType())])
    folders = [f"{path}/runs/run={r.run}/{dt_col}={r.dt}" for r in rows
               if r.filled and (start is None or r.dt >= start) and (end is None or r.dt < end)]
    if not folders:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("basePath", f"{path}/runs").parquet(*folders)
    return read.select(*schema.names)


def drop_superseded(spark: SparkSession, path: str, unfinished_after_hours: float = 168,
                    dt_col: str = "dt") -> int:
    """Delete hours that a later commit replaced, and runs that never committed and whose folder
    has been still for ``unfinished_after_hours``; returns the number of folders deleted.

    Readers that were given such an hour before may fail; commits themselves are kept.
    """
    commits = _commits(spark, path)
    if commits is None:
        return 0
    held = versions(spark, path).select("dt", "run")
    stale = commits.select(F.explode("filled").alias("dt"), "run").join(held, ["dt", "run"], "left_anti")
    fs_path, fs = _fs(spark, path)
    gone = sum(fs.delete(fs_path(f"{path}/runs/run={r.run}/{dt_col}={r.dt}"), True)
               for r in stale.toLocalIterator())
    known = {r.run for r in commits.select("run").distinct().collect()}  # one row per run
    before = (time.time() - 3600 * unfinished_after_hours) * 1000
    for s in fs.listStatus(fs_path(f"{path}/runs")):
        if s.getPath().getName().split("=")[-1] not in known and s.getModificationTime() <= before:
            gone += fs.delete(s.getPath(), True)
    return gone
