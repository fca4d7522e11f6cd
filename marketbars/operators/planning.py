"""Back-fill plans: ranges to fetch, request pages, deep back-fill days, and what is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .audit import latest_timestamp
from .gaps import internal_file_gaps


def plan_backfill(bars: DataFrame, ranges: DataFrame, dim: DataFrame, now: Column, gap: int, most: int) -> DataFrame:
    """Ranges (kind, start_s, end_s) to fetch for each configured series that has data.

    Internal holes lie strictly between two files and are left out if empty or longer than `most`; the trailing range
    runs from the newest bar to now, at most `most` long, if it is at least `gap`.
    """
    configured = dim.select(*KEY).distinct()
    holes = internal_file_gaps(ranges, gap).join(configured, list(KEY), "left_semi")
    inner = holes.select(*KEY, F.lit("internal").alias("kind"), (F.unix_seconds("gap_start") + 1).alias("start_s"), (F.unix_seconds("gap_end") - 1).alias("end_s")).where((F.col("end_s") > F.col("start_s")) & (F.col("end_s") - F.col("start_s") <= most))
    t = F.unix_seconds("latest")
    tail = latest_timestamp(bars, now).join(configured, list(KEY), "left_semi").where(F.unix_seconds(now) - t >= gap)
    return inner.unionByName(tail.select(*KEY, F.lit("trailing").alias("kind"), t.alias("start_s"), F.least(F.unix_seconds(now), t + most).alias("end_s")))


def plan_pages(ranges: DataFrame, interval: int | Column, bars_per_page: int | Column) -> DataFrame:
    """Request pages (page, from_s, to_s) of ranges (start_s, end_s); to_s is exclusive, the last page ends with the range."""
    step = (F.lit(interval) if isinstance(interval, int) else interval) * (F.lit(bars_per_page) if isinstance(bars_per_page, int) else bars_per_page)
    pages = ranges.where("end_s > start_s").withColumn("_step", step.cast("long")).withColumn("_n", F.ceil((F.col("end_s") - F.col("start_s")) / F.col("_step")).cast("long"))
    each = pages.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("page"))
    start = F.col("start_s") + F.col("page") * F.col("_step")
    return each.select(*ranges.columns, "page", start.alias("from_s"), F.least(start + F.col("_step"), F.col("end_s")).alias("to_s"))


def plan_deep_backfill(bars: DataFrame, series: DataFrame, start: Column, as_of: Column) -> DataFrame:
    """Days from start to yesterday without bars, for each series, with their bounds in seconds."""
    days = series.select(*KEY).distinct().withColumn("day", F.explode(F.sequence(start, F.date_sub(F.to_date(as_of), 1), F.expr("interval 1 day"))))
    have = bars.select(*KEY, F.to_date("window_start").alias("day")).distinct()
    begin = F.unix_seconds(F.col("day").cast("timestamp"))
    return days.join(have, [*KEY, "day"], "left_anti").select(*KEY, "day", begin.alias("start_s"), (begin + 86400).alias("end_s"))


def skip_existing(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Wanted (exchange, symbol, day) rows without their like in `have`."""
    return wanted.join(have.select(*KEY, "day").distinct(), [*KEY, "day"], "left_anti")


def staging_audit(source: DataFrame, staged: DataFrame, today: Column) -> DataFrame:
    """Days of the source (n_files, n_valid) that aren't staged, and why."""
    left = skip_existing(source, staged)
    why = F.when(F.col("day") == today, "TODAY").when(F.col("n_files") == 0, "NO_FILES").when(F.col("n_valid") == 0, "ALL_CORRUPT").otherwise("HAS_VALID")
    return left.withColumn("reason", why)


def present(dim: DataFrame, bars: DataFrame) -> DataFrame:
    """Configured series that have bars."""
    return dim.join(bars.select(*KEY).distinct(), list(KEY), "left_semi")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, columns: list[str], day_blocks: bool = True) -> DataFrame:
    """left with columns of the newest right row at or before its ts: one union and one sort per key and day.

    Values of earlier days come from the last row of each day, which are few.
    """
    from pyspark.sql import Window as W

    value = F.struct(*columns)
    sides = left.select("*", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    add = right.select(*keys, ts, value.alias("_v"), F.lit(0).alias("_side"))
    both = sides.unionByName(add, allowMissingColumns=True).withColumn("_day", F.to_date(ts))
    inside = F.last("_v", ignorenulls=True).over(W.partitionBy(*keys, "_day").orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0))
    days = both.groupBy(*keys, "_day").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(ts))).alias("_end"))
    earlier = days.select(*keys, "_day", F.last("_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    out = both.withColumn("_got", inside).where("_side = 1").join(earlier, [*keys, "_day"], "left").withColumn("_got", F.coalesce("_got", "_before"))
    return out.select(*left.columns, *[F.col(f"_got.{c}").alias(c) for c in columns])
