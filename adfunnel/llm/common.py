"""Helpers shared by the operators: reading, word patterns, checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word pattern of the contracts (ASCII white space splits words).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, shared by driver and executors.

    Only a local master (tests) gets a temporary folder when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of results that nothing refers to any more.

    The cleaner acts when the driver collects its garbage, which a driver with little to do
    may not do for hours; jobs of many rounds would fill the executors' disks meanwhile.
    """
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    _release(spark)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet below the checkpoint folder and read again.

    For wide intermediate rows: compressed, and later reads take only their columns.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    _release(spark)
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
