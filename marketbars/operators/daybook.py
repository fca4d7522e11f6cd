"""Aggregates of a series' day that can be kept, and the audits that need no bars once they are.

A row for each series and day. What spans days is merged from them: sums of counts, the earliest and latest time, the
close of the latest day. Distances between neighbouring bars of a day are kept with their number (distinct distances of
at least a second in a day add up to no more than 86,400 seconds, so there are at most 415 besides zero), so gaps of
any threshold can be counted later. A null time or day has no place in a day and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..schema import KEY
from . import audit as A

#: What is kept of a day, without its key.
STEP = T.StructType([T.StructField("step", T.LongType()), T.StructField("n", T.LongType())])
FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("bars", "live", "backfill", "empty", "idle", "trades")),
    *(T.StructField(c, T.TimestampType()) for c in ("first_ts", "last_ts")),
    T.StructField("last_close", T.DoubleType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("steps", T.ArrayType(STEP)),
]
NAMES = [f.name for f in FIELDS]


def day_aggregates(bars: DataFrame, day: Column | None = None) -> DataFrame:
    """KEY, day and FIELDS of each day: one exchange and one sort by series and day, then two folds in place."""
    rows = bars.withColumn("day", A.DAY("window_start") if day is None else day).where("day IS NOT NULL AND window_start IS NOT NULL")
    s = F.unix_seconds("window_start")
    rows = rows.withColumn("step", s - F.lag(s).over(W.partitionBy(*KEY, "day").orderBy("window_start")))
    last = F.max_by("close", "window_start").alias("last_close")
    parts = rows.groupBy(*KEY, "day", "step").agg(
        A.n_rows().alias("bars"), F.count_if(A._is("live")).alias("live"), F.count_if(A._is("backfill")).alias("backfill"), F.count_if(A._is("empty")).alias("empty"), F.count_if(F.col("trade_count") == 0).alias("idle"),
        F.sum("trade_count").alias("trades"), F.min("window_start").alias("first_ts"), F.max("window_start").alias("last_ts"), last, F.collect_set("source").alias("sources"))
    total = [F.sum(c).alias(c) for c in ("bars", "live", "backfill", "empty", "idle", "trades")]
    steps = F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", F.col("bars").alias("n")))))
    return parts.groupBy(*KEY, "day").agg(
        *total, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max_by("last_close", "last_ts").alias("last_close"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), steps.alias("steps")).select(*KEY, "day", *NAMES)


def day_stats(days: DataFrame) -> DataFrame:
    """audit.day_stats from kept days."""
    return days.select(*KEY, "day", "bars", "first_ts", "last_ts", "live", "backfill", "empty", "trades", F.size("sources").cast("long").alias("n_sources"))


def fast_day_stats(days: DataFrame) -> DataFrame:
    """audit.fast_day_stats from kept days."""
    return days.select(*KEY, "day", "bars", A.pct("live", "bars").alias("live_pct"), A.pct("empty", "bars").alias("empty_pct"))


def count_bars(days: DataFrame) -> DataFrame:
    """audit.count_bars from kept days."""
    return days.select(*KEY, "day", "bars")


def day_holes(days: DataFrame, dim: DataFrame, factor: int = 2) -> DataFrame:
    """KEY, day and the number of distances above `factor` intervals (gaps), where there is one."""
    wide = F.filter("steps", lambda x: x["step"] > factor * F.col("interval_sec"))
    number = F.aggregate(wide, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    known = days.join(F.broadcast(dim.select("exchange", "interval_sec").distinct()), "exchange")  # a row for each exchange
    return known.select(*KEY, "day", number.alias("gaps")).where("gaps > 0")


def completeness_report(days: DataFrame, dim: DataFrame, start: Column, end: Column, today: Column) -> DataFrame:
    """audit.completeness_report from kept days."""
    return A.report_of_days(day_stats(days), day_holes(days, dim), dim, start, end, today)


def symbol_summary(days: DataFrame) -> DataFrame:
    """audit.symbol_summary from kept days: sums and ends are merged."""
    hours = (F.unix_seconds(F.max("last_ts")) - F.unix_seconds(F.min("first_ts"))) / 3600.0
    out = days.groupBy(*KEY).agg(
        F.sum("bars").alias("total_bars"), F.sum("live").alias("live_bars"), F.sum("idle").alias("empty_bars"), F.sum("trades").alias("total_trades"),
        F.min("first_ts").alias("earliest"), F.max("last_ts").alias("latest"), F.max_by("last_close", "last_ts").alias("last_close"), hours.alias("data_hours"))
    return out.withColumn("live_pct", A.pct("live_bars", "total_bars"))


def missing_days(days: DataFrame, dim: DataFrame, start: Column, end: Column, today: Column) -> DataFrame:
    """audit.missing_days from kept days."""
    return A.calendar(dim.select(*KEY), start, end).where(F.col("day") != today).join(days.select(*KEY, "day"), [*KEY, "day"], "left_anti")
