"""Day aggregates of a lake kept beside it, brought up to date by reading only the days whose files have changed.

`days/` holds a row for each series and day (operators.daybook), partitioned by day, with the state of the directory
that it was made from: number and bytes of its files, and a hash over their names, sizes and times. A refresh lists the
lake, compares states, writes the directories that differ as a plan in `plans/` (which stays as a log), aggregates
those and replaces the partitions of their days: rows of other series are carried over, they aren't made anew.

Defined cases: a day is that of its directory; a directory that is gone leaves a row without files, which readers don't
see; files added while a refresh runs change the state and are found by the next one. A refresh that is killed, even
while it puts partitions in place, leaves rows that are right by themselves or none, and the next refresh makes what
lacks. Two refreshes of one book at the same time aren't supported. A lake without files gives an empty plan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.daybook import FIELDS, NAMES, day_aggregates
from ..schema import KEY
from . import lake as L
from .upkeep import exists

STATE = ("files", "bytes", "stamp")
SCHEMA = T.StructType([*(T.StructField(c, T.StringType()) for c in KEY), *(T.StructField(c, T.LongType()) for c in STATE), *FIELDS, T.StructField("day", T.DateType())])


def _rows(spark: SparkSession, book: str) -> DataFrame:
    at = f"{book.rstrip('/')}/days"
    return spark.read.schema(SCHEMA).option("basePath", at).parquet(at) if exists(spark, at) else spark.createDataFrame([], SCHEMA)


def read_daybook(spark: SparkSession, book: str) -> DataFrame:
    """KEY, day, the kept aggregates and the state of each day that the lake had at the last refresh."""
    return _rows(spark, book).where("files > 0").select(*KEY, "day", *NAMES, *STATE)


def directory_states(spark: SparkSession, root: str) -> DataFrame:
    """KEY, day, files, bytes and stamp of each directory of a lake; no file is opened."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    stamp = F.bit_xor(F.xxhash64(name, "bytes", F.unix_micros("mtime"))).alias("stamp")
    files = L.file_inventory(spark, root, "*.parquet").where(F.col("day").isNotNull())
    return files.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), stamp)


def touched(spark: SparkSession, root: str, book: str) -> DataFrame:
    """The directories whose state is not that of the book: KEY, day, the new state (no files: gone) and `was`, the number of files before (null: new)."""
    now, before = directory_states(spark, root), _rows(spark, book).select(*KEY, "day", *[F.col(c).alias(f"_{c}") for c in STATE])
    both = now.join(before, [*KEY, "day"], "full_outer").withColumn("files", F.coalesce("files", F.lit(0).cast("long"))).withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    same = F.col("files").eqNullSafe(F.col("_files")) & F.col("bytes").eqNullSafe(F.col("_bytes")) & F.col("stamp").eqNullSafe(F.col("_stamp"))
    return both.where(~same).select(*KEY, "day", *STATE, F.col("_files").alias("was"))


def bars_of(spark: SparkSession, root: str, plan: DataFrame) -> DataFrame:
    """Bars of the planned days; the scan is pruned to their directories at run time."""
    parts = [F.date_format("day", f).alias(c) for c, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))]
    return L.read_directories(spark, root, plan.where("files > 0").select(*KEY, *parts))


def refresh(spark: SparkSession, root: str, book: str) -> DataFrame:
    """Bring the book up to date with the lake. Returns the plan: the days that were read (or are gone)."""
    book = book.rstrip("/")
    at = f"{book}/plans/{uuid.uuid4().hex}"
    touched(spark, root, book).write.parquet(at)
    plan = spark.read.parquet(at)
    if plan.isEmpty():
        return plan
    fresh = plan.select(*KEY, "day", *STATE)
    if not fresh.where("files > 0").isEmpty():
        made = day_aggregates(bars_of(spark, root, plan), F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")]))
        fresh = fresh.join(made, [*KEY, "day"], "left")
    else:
        fresh = fresh.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA if f.name in NAMES])
    others = _rows(spark, book).join(plan.select("day").distinct(), "day", "left_semi").join(plan.select(*KEY, "day"), [*KEY, "day"], "left_anti")
    rows = fresh.select(*SCHEMA.fieldNames()).unionByName(others.select(*SCHEMA.fieldNames()))
    # a partition is replaced when all tasks are done, so a task that is run again still finds the rows to carry over
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{book}/days")
    return plan
