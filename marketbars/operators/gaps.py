"""Gaps in series, their causes, and outages that several series share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import classify_gap, cluster_cause, fmt_dur
from ..schema import KEY


def _day(ts: str = "window_start") -> Column:
    return F.to_date(ts)


def bar_diffs(bars: DataFrame, within_day: bool = False) -> DataFrame:
    """exchange, symbol, prev, window_start, diff (seconds since the bar before).

    Sorting happens by series and day; the first bar of a day finds its predecessor among the last bars of days, which
    are few, so no task sorts the whole history of a series.
    """
    inside = F.lag("window_start").over(W.partitionBy(*KEY, "day").orderBy("window_start"))
    rows = bars.select(*KEY, "window_start", _day().alias("day")).withColumn("prev", inside)
    if not within_day:
        ends = bars.groupBy(*KEY, _day().alias("day")).agg(F.max("window_start").alias("last"))
        before = ends.select(*KEY, "day", F.lag("last").over(W.partitionBy(*KEY).orderBy("day")).alias("before"))
        rows = rows.join(before, [*KEY, "day"]).withColumn("prev", F.coalesce("prev", "before"))
    return rows.select(*KEY, "prev", "window_start", (F.unix_seconds("window_start") - F.unix_seconds("prev")).alias("diff"))


def find_gaps(bars: DataFrame, threshold: int | Column, strict: bool = True, within_day: bool = False, dim: DataFrame | None = None) -> DataFrame:
    """GAP_SCHEMA: neighbours further apart than the threshold (or as far, if not strict).

    dim: the threshold is a multiple of the exchange's interval_sec instead.
    """
    d = bar_diffs(bars, within_day)
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    if dim is not None:
        d = d.join(F.broadcast(dim.select("exchange", "interval_sec").distinct()), "exchange")  # a row for each exchange
        limit = limit * F.col("interval_sec")
    return d.where(F.col("diff") > limit if strict else F.col("diff") >= limit).select(*KEY, F.col("prev").alias("gap_start"), F.col("window_start").alias("gap_end"), F.col("diff").alias("duration_sec"))


def with_human_duration(gaps: DataFrame, style: str = "padded") -> DataFrame:
    return gaps.withColumn("duration_human", fmt_dur("duration_sec", style))


def with_cause(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("cause", classify_gap("duration_sec"))


def recent_gaps(bars: DataFrame, as_of: Column, hours: int = 48, threshold: int = 60, significant: int = 600) -> DataFrame:
    """Per series with gaps in the lookback: counts of significant and minor gaps and the longest one."""
    recent = bars.where(F.unix_seconds("window_start") >= F.unix_seconds(as_of) - hours * 3600)
    big = F.col("duration_sec") >= significant
    return find_gaps(recent, threshold).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.count_if(big).alias("significant"), F.count_if(~big).alias("minor"),
        F.max("duration_sec").alias("longest_sec"), F.max_by("gap_start", F.struct("duration_sec", F.col("gap_start"))).alias("longest_start"))


def top_gaps(gaps: DataFrame, n: int = 200) -> DataFrame:
    return gaps.orderBy(F.desc("duration_sec"), *KEY, "gap_start").limit(n)


def cause_breakdown(gaps: DataFrame) -> DataFrame:
    return with_cause(gaps).groupBy("cause").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum("duration_sec").alias("total_sec"), F.avg("duration_sec").alias("avg_sec"))


def correlated_outages(gaps: DataFrame, slack: int = 30) -> DataFrame:
    """Clusters of more than one gap, each of which starts at most `slack` seconds after all before it have ended.

    A running end needs an order over all series. It is taken per day first: what earlier days reach is one number a
    day, and the number of clusters begun before a day is another, so only rows of one day meet in a task.
    """
    g = gaps.select(*KEY, F.unix_seconds("gap_start").alias("s"), F.unix_seconds("gap_end").alias("e"), "duration_sec").withColumn("day", F.floor(F.col("s") / 86400))
    reach = g.groupBy("day").agg(F.max("e").alias("reach"))  # a row for each day
    reach = reach.select("day", F.max("reach").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    order = W.partitionBy("day").orderBy("s", "e", *KEY)
    seen = F.greatest(F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)), F.col("earlier"))
    g = g.join(reach, "day").withColumn("new", F.when(seen.isNull() | (F.col("s") > seen + slack), 1).otherwise(0))
    begun = g.groupBy("day").agg(F.sum("new").alias("n")).select("day", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begun"))
    g = g.join(begun, "day").withColumn("cluster", F.col("begun") + F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    name = F.concat_ws("/", *KEY)
    out = g.groupBy("cluster").agg(
        F.min("s").alias("start"), F.max("e").alias("end"), F.count(F.lit(1)).alias("n_gaps"), F.count_distinct(name).alias("num_affected"),
        F.sort_array(F.collect_set("exchange")).alias("exchanges"), F.sort_array(F.collect_set(name)).alias("symbols"), F.avg("duration_sec").alias("avg_duration"))
    return out.where("n_gaps > 1").withColumn("likely_cause", cluster_cause("avg_duration", F.size("exchanges"))).drop("cluster")


def chart_markers(bars: DataFrame, tf: int) -> DataFrame:
    """A label at the bar before each hole of more than one and a half timeframes."""
    d = bar_diffs(bars).where(F.col("diff") > 1.5 * tf)
    minutes = F.floor(F.col("diff") / 60 + 0.5)
    label = F.when(minutes >= 60, F.format_string("GAP %dh", F.floor(minutes / 60 + 0.5))).otherwise(F.format_string("GAP %dm", minutes))
    return d.select(*KEY, F.col("prev").alias("at"), label.alias("label"))


def price_change(bars: DataFrame) -> DataFrame:
    """Per series: last close against the close before it (its own open if it is the only bar), in percent."""
    last_two = F.max_by("close", "window_start").alias("close"), F.max_by("open", "window_start").alias("open"), F.max("window_start").alias("last")
    ends = bars.groupBy(*KEY).agg(*last_two)
    prev = bars.join(ends.select(*KEY, "last"), list(KEY)).where("window_start < last").groupBy(*KEY).agg(F.max_by("close", "window_start").alias("prev_close"))
    base = F.coalesce("prev_close", "open")
    return ends.join(prev, list(KEY), "left").select(*KEY, "close", base.alias("base"), F.when(base != 0, (F.col("close") - base) / base * 100).otherwise(0.0).alias("change_pct"))


def internal_file_gaps(ranges: DataFrame, gap: int, as_of: Column | None = None, horizon: int | None = None, running: bool = False) -> DataFrame:
    """Holes between the ranges (min_ts, max_ts) of files of a series. running: against all earlier files, not the one before."""
    if horizon is not None:
        ranges = ranges.where(F.unix_seconds("max_ts") >= F.unix_seconds(as_of) - horizon)
    w = W.partitionBy(*KEY).orderBy("min_ts", "max_ts")
    prev = F.max("max_ts").over(w.rowsBetween(W.unboundedPreceding, -1)) if running else F.lag("max_ts").over(w)
    d = ranges.withColumn("prev", prev).withColumn("duration_sec", F.unix_seconds("min_ts") - F.unix_seconds("prev"))
    return d.where(F.col("duration_sec") > gap).select(*KEY, F.col("prev").alias("gap_start"), F.col("min_ts").alias("gap_end"), "duration_sec")


def disconnect_gaps(events: DataFrame, threshold: float = 0.0) -> DataFrame:
    """From connection events (event, exchange, ts): seconds from each disconnect to the next reconnect of the exchange.

    The next reconnect is looked for in the same day; beyond it, in one row a day. Order is taken backwards: a frame that
    ends with the row before grows by a row at a time, one that begins after the row would be gone through again for each.
    """
    rows = events.withColumn("_day", F.to_date("ts")).withColumn("_re", F.when(F.col("event") == "reconnect", F.col("ts")))
    ahead = lambda by, order: W.partitionBy(*by).orderBy(*map(F.desc, order)).rowsBetween(W.unboundedPreceding, -1)
    later = rows.groupBy("exchange", "_day").agg(F.min("_re").alias("first")).select("exchange", "_day", F.min("first").over(ahead(["exchange"], ["_day"])).alias("later"))
    rows = rows.withColumn("inside", F.min("_re").over(ahead(["exchange", "_day"], ["ts", "event"]))).join(later, ["exchange", "_day"], "left")
    d = rows.withColumn("until", F.coalesce("inside", "later")).where("event = 'disconnect' AND until IS NOT NULL")
    seconds = (F.unix_micros("until") - F.unix_micros("ts")) / 1e6
    return d.select("exchange", F.col("ts").alias("gap_start"), F.col("until").alias("gap_end"), seconds.alias("gap_seconds")).where(F.col("gap_seconds") >= threshold)


def debounced(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Back-fill requests: exchanges whose events lie within `seconds` of each other go together, over midnight too.

    Order is taken inside each day; the last event of earlier days and the number of requests begun are one row a day.
    Events without a time are left out.
    """
    order = W.partitionBy("day").orderBy("ts", "exchange")
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    rows = events.withColumn("day", F.to_date("ts")).withColumn("t", F.unix_micros("ts") / 1e6)
    ends = rows.groupBy("day").agg(F.max("t").alias("end")).select("day", F.max("end").over(before).alias("earlier"))
    rows = rows.join(ends, "day").withColumn("new", F.when(F.col("t") - F.coalesce(F.lag("t").over(order), "earlier") <= seconds, 0).otherwise(1))
    begun = rows.groupBy("day").agg(F.sum("new").alias("n")).select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begun"))
    rows = rows.join(begun, "day").withColumn("k", F.col("begun") + F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("k").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.sort_array(F.collect_set("exchange")).alias("exchanges"), F.count(F.lit(1)).alias("n_events")).drop("k")
