"""App events stored in buckets, so that the per-auction rollup needs no exchange.

The rollup groups by the auction id and some twenty keys of the event. A bucketing on the
auction id alone would put all events without one, perhaps a third of the table, into one
bucket; so the table carries ``auction_slot``, a hash of the auction id *and* of the keys
that every report groups by. It is a function of the group, hence grouping by it as well
changes nothing, and Spark finds the rows of a group in one bucket already. Events without
an auction id spread over the buckets by their hours, customers, apps and devices. A single
group of very many events is still one bucket's; the scan streams it through one hash map
entry. (``spark.sql.sources.bucketing.enabled=false`` brings the exchange back, with its
combining in every scan task; the result is the same.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adfunnel.operators.revenue import AUCTION_SLOT, auction_id, event_key_columns
from adfunnel.sources.scan import DAY, day_of
from adfunnel.sources.schemas import FACT_SCHEMAS
from adfunnel.spec import SPEC_A

NAME = "app_events"


def auction_slot() -> Column:
    """A hash of the auction id and the event keys common to all reports (no campaign)."""
    return F.xxhash64(auction_id(), *event_key_columns(SPEC_A).values())


def write_bucketed_events(app_events: DataFrame, table: str, buckets: int,
                          path: str | None = None, by: str = "day") -> None:
    """Store hours of app events in ``table``, partitioned by ``by`` and bucketed by slot.

    The first call creates the table (below ``path`` if given); later ones replace the hours
    that ``app_events`` holds and leave the others. Rows are dealt by partition and bucket, one
    file each as a rule; the ``rebalance`` hint lets AQE split an oversized one over several
    writers, whose files still carry the bucket's number. Choose ``buckets`` and ``by`` once;
    tables keep theirs. By ``"day"`` there are at most days x buckets files, however few events
    an hour has, but the other hours of a day are written again with a late one. ``"hour"`` does
    not do that and is for hours whose events, over the buckets, still fill a file.
    """
    if by not in ("day", "hour"):
        raise ValueError(f"by is {by!r}, neither 'day' nor 'hour'")
    spark = app_events.sparkSession
    columns = [*(c for c in FACT_SCHEMAS[NAME].fieldNames() if c != "dt"), AUCTION_SLOT, "dt"]
    exists = spark.catalog.tableExists(table)
    if exists:
        buckets = bucket_count(spark, table)
        by = "day" if DAY in spark.table(table).columns else "hour"
    rows = app_events.withColumn(AUCTION_SLOT, auction_slot()).select(*columns)
    part = "dt"
    if by == "day":
        part = DAY
        rows = rows.withColumn(DAY, day_of("dt"))
        if exists:
            rows = rows.unionByName(other_hours(spark.table(table), app_events))
    rows = rows.withColumn("_bucket", F.pmod(F.hash(AUCTION_SLOT), F.lit(buckets)))
    rows = rows.hint("rebalance", part, "_bucket").drop("_bucket")
    if exists:
        rows.write.mode("overwrite").insertInto(table)
        return
    # insertInto takes this option from the table, not from the writer
    writer = rows.write.format("parquet").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(part).bucketBy(buckets, AUCTION_SLOT)
    if by == "day":
        writer = writer.sortBy("dt")  # a range of hours reads few row groups of a day
    (writer.option("path", path) if path else writer).saveAsTable(table)


def other_hours(stored: DataFrame, app_events: DataFrame) -> DataFrame:
    """Stored events of the days that ``app_events`` touches, but of hours it does not hold."""
    hours = app_events.select(F.col("dt").alias("_hour")).distinct()
    days = hours.select(day_of("_hour").alias("_day")).distinct()
    return (stored.join(days, F.col(DAY).eqNullSafe(F.col("_day")), "left_semi")
            .join(hours, F.col("dt").eqNullSafe(F.col("_hour")), "left_anti"))


def bucket_count(spark: SparkSession, table: str) -> int:
    """The number of buckets of a stored table.

    Raises where it is not bucketed by slot, or would lose its other hours when some are
    written again.
    """
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()  # one row per column or property
    about = {r.col_name: r.data_type for r in rows}
    if about.get("Bucket Columns") != f"[`{AUCTION_SLOT}`]":
        raise ValueError(f"{table} is not bucketed by {AUCTION_SLOT}")
    if "partitionOverwriteMode=dynamic" not in about.get("Storage Properties", ""):
        raise ValueError(f"{table} was not made by write_bucketed_events")
    return int(about["Num Buckets"])


def read_bucketed_events(spark: SparkSession, table: str) -> DataFrame:
    """The stored events, for :class:`~adfunnel.spec.Facts`."""
    bucket_count(spark, table)
    return spark.table(table)
