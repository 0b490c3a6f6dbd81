"""Which files a report was made from: the manifest of landed files, per table and hour.

The manifest comes from the scans that the report itself reads (``_metadata`` of the same
DataFrames, so of the same file listing): a file that lands after the listing is in neither
and shows up as new the next time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.spec import Facts

MANIFEST = "dt string, name string, path string, size long, modified timestamp"
LOG_SCHEMA = f"{MANIFEST}, spec string, run long"
KEYS = ("dt", "name", "path", "size", "modified")


def landed_files(facts: Facts, names: tuple[str, ...], start: str, end: str) -> DataFrame:
    """MANIFEST of the files that hold rows of ``[start, end)``.

    No column but ``dt`` is read. A table that is not a plain file scan is listed by its
    number of rows per hour instead, under an empty path.
    """
    out = None
    for name in names:
        df = getattr(facts, name).where((F.col("dt") >= start) & (F.col("dt") < end))
        try:
            rows = df.select("dt", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                             F.col("_metadata.file_modification_time").alias("modified")).distinct()
        except AnalysisException:
            rows = df.groupBy("dt").agg(F.count(F.lit(1)).alias("size")).select(
                "dt", F.lit("").alias("path"), "size", F.lit(None).cast("timestamp").alias("modified"))
        rows = rows.select("dt", F.lit(name).alias("name"), "path", "size", "modified")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """LOG_SCHEMA: the manifests of all runs, or None before the first one."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_manifests(log: DataFrame) -> DataFrame:
    """MANIFEST that each hour was last reported from."""
    last = log.groupBy("dt").agg(F.max("run").alias("run"))
    return log.join(last, ["dt", "run"]).select(*KEYS)


def changed_hours(landed: DataFrame, reported: DataFrame | None) -> list[str]:
    """Hours with a file that is new, gone, or not as it was when the hour was reported."""
    if reported is None:
        odd = landed.select("dt")
    else:
        a, b = landed.withColumn("now", F.lit(True)).alias("a"), reported.withColumn("then", F.lit(True)).alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEYS]
        odd = a.join(b, same, "full").where("now IS NULL OR then IS NULL").select(F.coalesce("a.dt", "b.dt").alias("dt"))
    return sorted(r.dt for r in odd.distinct().collect())  # one row per hour
