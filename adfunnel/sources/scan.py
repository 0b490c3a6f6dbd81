"""Hour-partitioned fact scans and dimension reads."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adfunnel.functions.hours import dt_add
from adfunnel.sources.schemas import DIM_SCHEMAS, FACT_SCHEMAS
from adfunnel.spec import Dims, Facts

FACT_TABLES = tuple(FACT_SCHEMAS)
DIM_TABLES = tuple(DIM_SCHEMAS)
CHECKED_AT_ONCE = 8
DAY = "dt_day"  # partition column of events stored by day (bucketed.py)


def day_of(dt_col: str) -> Column:
    """The day of a ``YYYY-MM-DDTHH`` hour."""
    return F.substring(dt_col, 1, 10)


def hour_range(df: DataFrame, start: str | None, end: str | None = None,
               dt_col: str = "dt") -> DataFrame:
    """Keep ``start <= dt < end``; ``end`` defaults to one hour after ``start``.

    ``dt`` strings compare lexically, which is chronological for ``YYYY-MM-DDTHH``.
    On a table partitioned by ``dt`` this becomes a partition filter, so only the
    selected hour directories are listed and read; a table partitioned by day gets one too.
    ``start=None`` keeps every hour.
    """
    if start is None:
        return df
    end = end or dt_add(start, 1)
    if DAY in df.columns:
        df = df.where(F.col(DAY).between(start[:10], end[:10]))
    return df.where((F.col(dt_col) >= F.lit(start)) & (F.col(dt_col) < F.lit(end)))


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet read of one fact or dimension table with its narrow schema.

    Raises when the files lack a needed column or hold it with another type: a forced
    schema alone would read such a column as NULL. A dimension's files are all looked at;
    of a fact table one, its hours are checked by :func:`check_hours`.
    """
    schema = FACT_SCHEMAS.get(name) or DIM_SCHEMAS[name]
    problems = file_problems(spark, path, schema, merge=name in DIM_SCHEMAS)
    if problems:
        raise ValueError(f"{name} at {path}: {'; '.join(problems)}")
    return spark.read.schema(schema).parquet(path)


def file_problems(spark: SparkSession, path: str, needed: T.StructType, merge: bool = True) -> list[str]:
    """What the Parquet files below ``path`` lack of ``needed``, from their footers alone.

    With ``merge`` a Spark job reads the footers of all files; columns whose type differs
    between them are a problem as well.
    """
    try:
        found = spark.read.option("mergeSchema", merge).parquet(path).schema
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return []  # a folder without files
        raise
    except (PySparkException, Py4JJavaError) as e:
        merging = [line for line in str(e).splitlines() if "CANNOT_MERGE" in line]
        if not merging:
            raise
        return [f"files without a common schema: {merging[0].strip()}"]
    return missing_fields(needed, found)


def check_hours(spark: SparkSession, root: str, hours: Iterable[str],
                tables: dict[str, str] | None = None) -> None:
    """Raise a ValueError that names every fact table, hour and column at odds with the schemas.

    Only the footers of the named hours are read, hour by hour in Spark jobs (a few at a
    time); hours that have not landed are left alone. An hour is judged by all its files
    together, so a column that only some of an hour's files lack is not found.
    """
    paths = {name: f"{root}/{name}" for name in FACT_TABLES} | (tables or {})

    def check(at: tuple[str, str]) -> list[str]:
        name, hour = at
        needed = T.StructType([f for f in FACT_SCHEMAS[name].fields if f.name != "dt"])
        try:
            problems = file_problems(spark, f"{paths[name]}/dt={hour}", needed)
        except AnalysisException:
            return []  # nothing landed
        return [f"{name} hour {hour}: {p}" for p in problems]

    with ThreadPoolExecutor(CHECKED_AT_ONCE) as pool:
        problems = [p for found in pool.map(check, [(n, h) for h in hours for n in FACT_TABLES]) for p in found]
    if problems:
        raise ValueError("; ".join(problems))


def missing_fields(needed: T.DataType, found: T.DataType, where: str = "") -> list[str]:
    """What ``found`` lacks of ``needed``; further columns and fields do not matter."""
    if isinstance(needed, T.ArrayType) and isinstance(found, T.ArrayType):
        return missing_fields(needed.elementType, found.elementType, where + "[]")
    if isinstance(needed, T.StructType) and isinstance(found, T.StructType):
        have = {f.name: f.dataType for f in found.fields}
        out = []
        for f in needed.fields:
            at = f"{where}.{f.name}" if where else f.name
            out += (missing_fields(f.dataType, have[f.name], at) if f.name in have
                    else [f"no column {at}"])
        return out
    if needed != found:
        return [f"column {where} is {found.simpleString()}, not {needed.simpleString()}"]
    return []


def read_facts(spark: SparkSession, root: str, tables: dict[str, str] | None = None) -> Facts:
    """Read the five fact tables from ``root/<table>`` (or explicit paths)."""
    paths = {name: f"{root}/{name}" for name in FACT_TABLES}
    paths.update(tables or {})
    return Facts(**{name: read_table(spark, paths[name], name) for name in FACT_TABLES})


def read_dims(spark: SparkSession, root: str, names: Iterable[str] = DIM_TABLES) -> Dims:
    return Dims(**{name: read_table(spark, f"{root}/{name}", name) for name in names})
