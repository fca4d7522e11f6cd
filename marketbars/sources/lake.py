"""A lake of bars in Parquet: partitioned by exchange, symbol, year, month and day; reading, writing and upkeep."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import path_parts
from ..operators.bars import recent_window, with_source_default
from ..schema import BARS_SCHEMA, EVENT_SCHEMA, HEALTH_SCHEMA, KEY
from .upkeep import deleted, located, planned_directories, whole_day, work_through

PARTITIONS = (*KEY, "year", "month", "day")
CODECS = ("zstd", "snappy", "gzip")
#: Fixed name order: what the bars table returns.
COLUMNS = BARS_SCHEMA.fieldNames()


# --- reading


#: What is read of a lake: the schema is fixed, so no footer is opened to find it. Files may lack columns (null then).
LAKE_SCHEMA = T.StructType([*BARS_SCHEMA, *(T.StructField(c, T.StringType()) for c in ("year", "month", "day"))])


def read_bars(spark: SparkSession, root: str, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """All bars below root with the partition columns; exchange and symbol prune partitions. Unsigned counts come back as longs."""
    df = spark.read.schema(LAKE_SCHEMA).option("basePath", root).parquet(root)
    df = df.where(F.col("exchange") == exchange) if exchange else df
    return with_source_default(df.where(F.col("symbol") == symbol) if symbol else df).select(*LAKE_SCHEMA.fieldNames())


def _raw_partition_filter(start: date, end: date) -> Column:
    """start <= day <= end over the partition columns, so that directories are pruned."""
    y, m, d = (F.col(c).cast("int") for c in ("year", "month", "day"))
    n = y * 10000 + m * 100 + d
    return (y >= start.year) & (y <= end.year) & (n >= start.year * 10000 + start.month * 100 + start.day) & (n <= end.year * 10000 + end.month * 100 + end.day)


def read_range(spark: SparkSession, root: str, start: date, end: date, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """Bars of the days start to end; only their directories are read."""
    return read_bars(spark, root, exchange, symbol).where(_raw_partition_filter(start, end))


def read_day(spark: SparkSession, root: str, day: date, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    return read_range(spark, root, day, day, exchange, symbol)


def newest_days(spark: SparkSession, root: str, back: int, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """PARTITIONS of the directories of each series that are at most `back` days older than its newest one; known from names, no file is opened."""
    inv = file_inventory(spark, root, "*.parquet").where(F.col("day").isNotNull())
    inv = inv.where(F.col("exchange") == exchange) if exchange else inv
    days = (inv.where(F.col("symbol") == symbol) if symbol else inv).select(*KEY, F.col("day").alias("date")).distinct()
    newest = days.groupBy(*KEY).agg(F.max("date").alias("newest"))
    kept = days.join(newest, list(KEY)).where(F.col("date") >= F.date_sub("newest", back))
    return kept.select(*KEY, *[F.date_format("date", f).alias(c) for c, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))])


#: Days of series that may be sent to all tasks; beyond it the join prunes nothing, and gives the same.
DAYS_SENT = 500_000


def read_directories(spark: SparkSession, root: str, days: DataFrame, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """Bars of the given directories (PARTITIONS, each once); the scan is pruned by them at run time."""
    few = days.limit(DAYS_SENT + 1).count() <= DAYS_SENT
    rows = read_bars(spark, root, exchange, symbol).join(F.broadcast(days) if few else days, list(PARTITIONS), "left_semi")
    return rows.select(*LAKE_SCHEMA.fieldNames())


def read_latest(spark: SparkSession, root: str, seconds: int, n: int, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """Bars later than n + 1 buckets before the newest of their series.

    The days that can hold such bars are known from the directories before the plan; the scan is pruned by them at run
    time (dynamic partition pruning), so no list of names goes through the driver and no other directory is read.
    """
    days = newest_days(spark, root, (n + 1) * seconds // 86400 + 1, exchange, symbol)
    return recent_window(read_directories(spark, root, days, exchange, symbol), seconds, n)


def query_symbol(bars: DataFrame, exchange: str, symbol: str, start: str, end: str, cols: list[str] | None = None) -> DataFrame:
    """Bars of a series from the first to the last date (both included, UTC), in order of time."""
    rows = bars.where((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & F.to_date("window_start").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return rows.orderBy("window_start").select(*(cols or bars.columns))


def discover_series(bars: DataFrame) -> DataFrame:
    return bars.select(*KEY).distinct()


def symbols_by_exchange(dim: DataFrame) -> DataFrame:
    return dim.groupBy("exchange").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"))


def prefix_filter(df: DataFrame, prefixes: list[str]) -> DataFrame:
    """Series whose `exchange/symbol` starts with any of the prefixes; all if there are none."""
    name, test = F.concat_ws("/", *KEY), F.lit(not prefixes)
    for p in prefixes:
        test = test | name.startswith(p)
    return df.where(test)


def read_connection_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).json(path).withColumn("ts", F.try_to_timestamp("ts"))


def read_health(spark: SparkSession, path: str, as_of: Column | None = None) -> DataFrame:
    """Nested health snapshots with the age in minutes of each at as_of (now by default)."""
    rows = spark.read.schema(HEALTH_SCHEMA).option("multiLine", "true").json(path)
    at = F.unix_seconds(as_of if as_of is not None else F.current_timestamp())
    return rows.withColumn("age_minutes", (at - F.unix_seconds(F.try_to_timestamp("ts_utc"))) / 60.0)


def file_inventory(spark: SparkSession, root: str | list[str], glob: str = "*") -> DataFrame:
    """path, bytes, mtime, exchange, symbol and day of each file below root (or several folders); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))
    return files.select("*", *[c.alias(k) for k, c in path_parts("path").items()])


def inventory_totals(inventory: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return inventory.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("mtime").alias("newest"))


def file_ts_ranges(inventory: DataFrame, column: str = "window_start") -> DataFrame:
    """inventory with min_ts and max_ts of each file: from the statistics in its footer, or from the column itself where there are none.

    Executors open the files; a file that can't be read or holds no row has null times.
    """
    import pandas as pd

    def ends(f) -> tuple:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        file = pq.ParquetFile(f)
        k = file.schema_arrow.get_field_index(column)
        if k < 0 or not file.metadata.num_rows:
            return None, None
        stats = [file.metadata.row_group(i).column(k).statistics for i in range(file.metadata.num_row_groups)]
        if all(x is not None and x.has_min_max for x in stats):
            return min(x.min for x in stats), max(x.max for x in stats)
        both = pc.min_max(file.read(columns=[column]).column(0)).as_py()
        return both["min"], both["max"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = []
            for p in pdf["path"]:
                store, name = located(p)
                try:
                    with store.open_input_file(name) as f:
                        low, high = ends(f)
                except (OSError, ValueError):
                    low = high = None
                found.append([int(pd.Timestamp(x).value // 1000) if x is not None else None for x in (low, high)])
            yield pd.DataFrame({"path": pdf["path"], "low": pd.array([x[0] for x in found], "Int64"), "high": pd.array([x[1] for x in found], "Int64")})

    # many small inputs: dealt by name, so that files are opened in all tasks
    names = inventory.select("path").repartition(inventory.sparkSession.sparkContext.defaultParallelism * 4, "path")
    found = names.mapInPandas(run, "path string, low long, high long")
    return inventory.join(found.select("path", F.timestamp_micros("low").alias("min_ts"), F.timestamp_micros("high").alias("max_ts")), "path").orderBy("min_ts", "max_ts")


def parquet_footer_check(inventory: DataFrame) -> DataFrame:
    """inventory with `valid`: whether a file ends as Parquet does. Executors read four bytes of each file (column path)."""
    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ok = []
            for p in pdf["path"]:
                store, name = located(p)
                size = store.get_file_info(name).size or 0
                with store.open_input_file(name) as f:
                    ok.append(size >= 12 and f.read_at(4, size - 4) == b"PAR1")
            yield pdf.assign(valid=ok)

    return inventory.select("path").mapInPandas(run, "path string, valid boolean")


def read_tolerant(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Bars of all files that can be read, with column path. Missing and corrupt files are skipped.

    The series comes from the data or else from the path, so that both layouts can be read.
    """
    df = spark.read.schema(BARS_SCHEMA).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    df = df.withColumn("path", F.col("_metadata.file_path"))
    parts = path_parts("path")
    return df.withColumns({k: F.coalesce(F.col(k), parts[k]) for k in KEY})


def unreadable(inventory: DataFrame, bars_with_path: DataFrame) -> DataFrame:
    """Files of the inventory of which a tolerant read gave no row."""
    return inventory.join(bars_with_path.select("path").distinct(), "path", "left_anti")


# --- writing


def with_calendar_partitions(bars: DataFrame) -> DataFrame:
    return bars.select("*", *[F.date_format("window_start", f).alias(c) for c, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))])


def write_bars(bars: DataFrame, root: str, codec: str = "zstd", mode: str = "append", files_per_day: int = 1) -> None:
    """Append bars, `files_per_day` sorted files for each series and day (more split a large day over tasks)."""
    rows = with_calendar_partitions(bars.select(*COLUMNS))
    salt = F.pmod(F.unix_seconds("window_start"), F.lit(files_per_day))
    rows = rows.repartition(*PARTITIONS, salt).sortWithinPartitions(*PARTITIONS, "window_start")
    rows.write.mode(mode).partitionBy(*PARTITIONS).option("compression", codec if codec in CODECS else "snappy").option("partitionOverwriteMode", "dynamic").parquet(root)


def by_days(ranges: DataFrame) -> DataFrame:
    """Ranges (start_s, end_s, both included) cut at midnight, one row for each day (a number) they reach: `_day`, `_from`, `_to`."""
    day = F.explode(F.sequence(F.floor(F.col("start_s") / 86400), F.floor(F.col("end_s") / 86400)))
    cut = ranges.where("start_s <= end_s").withColumn("_day", day)
    return cut.withColumn("_from", F.greatest("start_s", F.col("_day") * 86400)).withColumn("_to", F.least("end_s", F.col("_day") * 86400 + 86399))


def in_ranges(bars: DataFrame, planned: DataFrame) -> DataFrame:
    """Bars within any of the planned ranges of their series, once each.

    An equal join on series and day: ranges of a series and day that meet or overlap are one first, so a task holds a day
    of a series and its few ranges, never a whole series.
    """
    cut = by_days(planned.select(*KEY, "start_s", "end_s")).select(*KEY, "_day", "_from", "_to").distinct()
    order = W.partitionBy(*KEY, "_day").orderBy("_from", "_to")
    reach = F.max("_to").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = cut.withColumn("_new", F.when(F.col("_from") <= reach + 1, 0).otherwise(1)).withColumn("_k", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = island.groupBy(*KEY, "_day", "_k").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    days = whole.groupBy(*KEY, "_day").agg(F.collect_list(F.struct("_from", "_to")).alias("_ranges"))
    t = F.unix_seconds("window_start")
    rows = bars.withColumn("_day", F.floor(t / 86400)).join(days, [*KEY, "_day"])
    return rows.where(F.exists("_ranges", lambda r: t.between(r["_from"], r["_to"]))).select(*bars.columns)


def write_backfill(bars: DataFrame, planned: DataFrame, root: str, codec: str = "zstd") -> None:
    """Append the bars that lie within planned ranges (start_s, end_s) of their series."""
    write_bars(in_ranges(bars, planned), root, codec)


def compaction_plan(inventory: DataFrame, before: Column) -> DataFrame:
    """Series and days before a date that have more than one file: files and bytes."""
    return inventory.where(F.col("day") < before).groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).where("files > 1")


def compact(spark: SparkSession, root: str, before: Column, staging: str, dry_run: bool = False, codec: str = "zstd") -> DataFrame:
    """Turn each planned day into one sorted file: the plan is worked through by upkeep.work_through(), which goes on where a killed run stopped.

    Returns the plan; unless dry_run with files_after and bytes_after.
    """
    inv = file_inventory(spark, root, "*.parquet")
    plan = compaction_plan(inv, before)
    if dry_run:
        return plan
    done = work_through(spark, f"{staging.rstrip('/')}/compact", planned_directories(inv, plan), whole_day(None, codec))
    return done.select(*KEY, "day", "files", "bytes", "files_after", "bytes_after")


def _copy_days(spark: SparkSession, inventory: DataFrame, days: DataFrame, dst: str, kind: str, codec: str) -> DataFrame:
    """Copy the files of some days (exchange, symbol, day) into one file a day below dst; files and rows of each day."""
    done = work_through(spark, f"{dst.rstrip('/')}/_upkeep/{kind}", planned_directories(inventory, days), whole_day(dst.rstrip("/"), codec))
    return done.groupBy(*KEY, "day").agg(F.sum("files").alias("files"), F.sum("rows").alias("rows"))


def stage_copy(spark: SparkSession, src: str, dst: str, today: date, staged: DataFrame | None = None, least_files: dict[str, int] | None = None, codec: str = "zstd") -> DataFrame:
    """Copy whole days from src to dst as one file each; src is left alone, and only the planned directories are read.

    Days that are staged, today, and days of an exchange with no more files than least_files says are skipped; files
    that can't be read are passed over. A run that was killed is finished first, by its own plan. Returns files and rows
    per day that was copied.
    """
    inv = file_inventory(spark, src, "*.parquet")
    days = inv.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("files")).where(F.col("day") < F.lit(today))
    for exchange, least in (least_files or {}).items():
        days = days.where((F.col("exchange") != exchange) | (F.col("files") > least))
    if staged is not None:
        days = days.join(staged.select(*KEY, "day").distinct(), [*KEY, "day"], "left_anti")
    return _copy_days(spark, inv, days, dst, "stage", codec)


def fill_unstaged(spark: SparkSession, src: str, dst: str, exchanges: list[str], today: date, codec: str = "zstd") -> DataFrame:
    """Copy the days of some exchanges that dst has no files of. Returns files and rows per day that was copied."""
    inv = file_inventory(spark, src, "*.parquet")
    days = inv.where(F.col("exchange").isin(exchanges) & (F.col("day") < F.lit(today))).select(*KEY, "day").distinct()
    have = file_inventory(spark, dst, "*.parquet").select(*KEY, "day").distinct()
    return _copy_days(spark, inv, days.join(have, [*KEY, "day"], "left_anti"), dst, "fill", codec)


def retention_plan(inventory: DataFrame, keep_days: int, as_of: Column) -> DataFrame:
    """Series and dates older than keep_days, with files and bytes; keep_days 0 keeps everything. Raw archives (date=...) and lakes (year/month/day) alike."""
    old = inventory.where(F.col("day").isNotNull() & (F.col("day") < F.date_sub(F.to_date(as_of), keep_days)) & F.lit(keep_days > 0) & ~F.col("exchange").startswith("_"))
    return old.groupBy(*KEY, "day").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def retain(spark: SparkSession, root: str, keep_days: int, as_of: date, dry_run: bool = True) -> DataFrame:
    """The plan; unless dry_run, the directories of its dates are deleted by the executors (again deleted is deleted)."""
    inv = file_inventory(spark, root)
    plan = retention_plan(inv, keep_days, F.lit(as_of))
    if dry_run:
        return plan
    done = work_through(spark, f"{root.rstrip('/')}/_upkeep/retain", planned_directories(inv, plan), deleted)
    return done.groupBy(*KEY, "day").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def write_events(events: DataFrame, root: str) -> None:
    """Append connection events as JSON lines by date, gap_seconds to one place."""
    rows = events.withColumn("gap_seconds", F.round("gap_seconds", 1)).withColumn("date", F.to_date("ts"))
    rows.write.mode("append").partitionBy("date").json(root)


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    df.write.mode("overwrite").format(form).save(path)
