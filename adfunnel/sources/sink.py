"""Hour-partitioned report sink.

Writes replace exactly the ``dt`` partitions of the hours that were run (dynamic
partition overwrite), so re-running an hour is idempotent and leaves every other
hour intact; a job retried after executor loss rewrites the same partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_hours(df: DataFrame, path: str, dt_col: str = "dt", fmt: str = "parquet",
                hours: Sequence[str] | None = None) -> None:
    """Write a report carrying a ``dt`` column, replacing only its hours.

    ``hours`` names the hours that were run: those without a row are cleared. The report
    is then written below ``path`` first (a folder that readers skip), so that the hours
    with rows are known from its partitions before anything is replaced.

    The ``rebalance`` hint clusters rows by hour (few files per hour) while letting
    AQE split an oversized hour over several writers and merge small ones, so a hot
    hour never lands in a single task.
    """
    spark = df.sparkSession
    if hours is None:
        _overwrite(df.hint("rebalance", dt_col), path, dt_col, fmt)
        return
    staging = f"{path}/_staging-{uuid.uuid4().hex}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.hint("rebalance", dt_col).write.partitionBy(dt_col).format(fmt).save(staging)
        staged = spark.read.schema(df.schema).format(fmt).load(staging)
        filled = {r[0] for r in staged.select(dt_col).distinct().collect()}  # partition names only
        if filled:
            _overwrite(staged, path, dt_col, fmt)
        for hour in set(hours) - filled:
            fs.delete(fs_path(f"{path}/{dt_col}={hour}"), True)
    finally:
        fs.delete(fs_path(staging), True)


def _overwrite(df: DataFrame, path: str, dt_col: str, fmt: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(dt_col).format(fmt).save(path))


def write_hour(df: DataFrame, path: str, dt: str, fmt: str = "parquet") -> None:
    """Write one hour's report (which has no ``dt`` column) under ``dt=<dt>``."""
    write_hours(df.withColumn("dt", F.lit(dt)), path, fmt=fmt, hours=[dt])
