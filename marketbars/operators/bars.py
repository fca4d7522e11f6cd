"""Trades to bars, gap filling, resampling, and merging of bars of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.columns import bucket, safe_ratio
from ..schema import BARS_SCHEMA, KEY

BARS = BARS_SCHEMA.fieldNames()


def ohlcv(price: Column, qty: Column, order: Column, source: str = "live") -> list[Column]:
    """The aggregates of a bar; ties in time are broken by `order`, so the result never depends on row order."""
    base, quote, last = F.sum(qty), F.sum(price * qty), F.max_by(price, order)
    zero = F.lit(0.0)
    return [
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last.alias("close"),
        base.alias("volume_base"), quote.alias("volume_quote"), F.count(F.lit(1)).alias("trade_count"),
        safe_ratio(quote, base, last).alias("vwap"), zero.alias("bid"), zero.alias("ask"), zero.alias("spread"), F.lit(source).alias("source"),
    ]


def trades_to_bars(trades: DataFrame, interval: int = 60, dim: DataFrame | None = None, time_col: str = "ts", id_col: str = "trade_id") -> DataFrame:
    """Tumbling OHLCV bars per series: one partial and one final aggregation. dim gives interval_sec by exchange, `interval` where it has none.

    time_col chooses event time or receive time.
    """
    rows, width = trades, F.lit(interval)
    if dim is not None:  # a row for each exchange of the configuration
        rows = trades.join(F.broadcast(dim.select("exchange", "interval_sec").distinct()), "exchange", "left")
        width = F.coalesce("interval_sec", F.lit(interval))
    return rows.groupBy(bucket(time_col, width).alias("window_start"), *KEY).agg(*ohlcv(F.col("price"), F.col("qty"), F.struct(time_col, id_col, "price")))


def _days(df: DataFrame, order: str, *what: Column) -> DataFrame:
    """One row for each series and day (column day): what tasks of other days need to know."""
    return df.groupBy(*KEY, F.to_date(order).alias("day")).agg(*what)


def reusable(df: DataFrame) -> DataFrame:
    """df for several uses in one plan: a filter that is always true and names all columns, so that what is below is the same for all of them.

    Each use would otherwise drop the columns that it has no need of, and equal exchanges would differ and run again. For
    rows that an aggregation or a join has made; a stored table is better read by each use with its own columns.
    """
    return df.where(F.xxhash64(*df.columns) >= F.lit(-(1 << 63)))


def fill_empty_bars(bars: DataFrame, interval: int | Column) -> DataFrame:
    """A bar for every bucket between the first and last bar of a series; missing ones carry the last close, with source `empty`.

    A bar makes the buckets up to the next bar of its series itself, so that real and empty bars come from one pass. Order
    is taken inside each day; a mark (one for each series and day) stands at its end for the first bar of the next one. A
    long hole is made in blocks of at most a day, which bounds the arrays.
    """
    width = F.lit(interval) if isinstance(interval, int) else interval
    rows = bars.select(*BARS, width.alias("w"), F.to_date("window_start").alias("day"), F.lit(False).alias("mark"))
    starts = _days(bars, "window_start", F.min("window_start").alias("first"))
    marks = starts.select(*KEY, "day", F.lead("first").over(W.partitionBy(*KEY).orderBy("day")).alias("window_start"), F.lit(True).alias("mark")).where("window_start IS NOT NULL")
    inside = F.lead("window_start").over(W.partitionBy(*KEY, "day").orderBy("window_start"))
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("next", inside).where("NOT mark")
    t, w = F.unix_seconds("window_start"), F.col("w")
    # n buckets follow the bar (number 0), in blocks of `per`
    missing = F.coalesce(F.greatest(F.ceil((F.unix_seconds("next") - t) / w) - 1, F.lit(0)), F.lit(0)).cast("long")
    per = F.greatest(F.floor(F.lit(86400) / w), F.lit(1)).cast("long")
    blocks = both.withColumns({"n": missing, "per": per}).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.col("per")))))
    each = blocks.withColumn("i", F.explode(F.sequence(F.col("k") * F.col("per"), F.least(F.col("n"), (F.col("k") + 1) * F.col("per") - 1))))
    real, close, zero = F.col("i") == 0, F.col("close"), F.lit(0.0)
    made = {"window_start": F.timestamp_seconds(t + F.col("i") * w), "source": F.lit("empty"), "trade_count": F.lit(0).cast("long")} | dict.fromkeys(("open", "high", "low", "vwap"), close) | dict.fromkeys(("volume_base", "volume_quote", "bid", "ask", "spread"), zero)
    return each.select(*[F.when(real, F.col(c)).otherwise(made[c]).alias(c) if c in made else c for c in BARS])


def carry_forward(df: DataFrame, column: str, order: str = "window_start") -> DataFrame:
    """column with nulls replaced by the last value before them in the series: of the same day, or of the last day that has one.

    A mark (one for each series and day) stands before the day's rows with the value that earlier days have left.
    """
    down = W.unboundedPreceding
    ends = _days(df, order, F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("_last"))
    left = F.last("_last", ignorenulls=True).over(W.partitionBy(*KEY).orderBy("day").rowsBetween(down, -1))
    marks = ends.select(*KEY, F.col("day").alias("_day"), left.alias(column), F.lit(0).alias("_row")).where(F.col(column).isNotNull())
    rows = df.withColumns({"_day": F.to_date(order), "_row": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    inside = F.last(column, ignorenulls=True).over(W.partitionBy(*KEY, "_day").orderBy("_row", order).rowsBetween(down, 0))
    return rows.withColumn(column, inside).where("_row = 1").select(*df.columns)


def resample_bars(bars: DataFrame, seconds: int, by_exchange: bool = True) -> DataFrame:
    """Bars of a longer timeframe: volume-weighted vwap, is_live if any part is live."""
    keys = KEY if by_exchange else ("symbol",)
    order = F.col("window_start") if by_exchange else F.struct("window_start", "exchange")
    volume, last = F.sum("volume_base"), F.max_by("close", order)
    return bars.groupBy(bucket("window_start", seconds).alias("window_start"), *keys).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"),
        volume.alias("volume_base"), F.sum("trade_count").alias("trade_count"),
        safe_ratio(F.sum(F.col("vwap") * F.col("volume_base")), volume, last).alias("vwap"), F.bool_or(F.col("source") == "live").alias("is_live"),
    )


def resample_rule(bars: DataFrame, rule: str) -> DataFrame:
    """As resample_bars by an interval text such as `1 hour`; empty windows don't occur."""
    order = F.col("window_start")
    return bars.groupBy(F.window("window_start", rule)["start"].alias("window"), *KEY).agg(
        F.min_by("open", order).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", order).alias("close"), F.sum("volume_base").alias("volume_base"), F.sum("trade_count").alias("trade_count"))


def complete_bars(bars: DataFrame, as_of: Column | None = None, seconds: int = 0) -> DataFrame:
    """Without the last bar of each series (if there are more), or, with as_of, without bars that end after it."""
    if as_of is not None:
        return bars.where(F.unix_seconds("window_start") + seconds <= F.unix_seconds(as_of))
    ends = bars.groupBy(*KEY).agg(F.max("window_start").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return bars.join(ends, list(KEY)).where((F.col("window_start") < F.col("_last")) | (F.col("_n") == 1)).drop("_last", "_n")


def newest(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("window_start")))
    return bars.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def recent_window(bars: DataFrame, seconds: int, n: int) -> DataFrame:
    """Bars later than n + 1 buckets before the newest of their series. Over a lake, sources.lake.read_latest reads the newest days only."""
    ends = bars.groupBy(*KEY).agg(F.max("window_start").alias("_last"))
    return bars.join(ends, list(KEY)).where(F.unix_seconds("window_start") > F.unix_seconds("_last") - (n + 1) * seconds).drop("_last")


#: Of equal bars, the first of these sources wins.
PRECEDENCE = ("live", "backfill_1s", "backfill_1m", "empty")


def dedup_bars(bars: DataFrame) -> DataFrame:
    """One bar for each series and time, by precedence of source, then by the larger trade count; one aggregation, no sort."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("source")), F.lit(0)), F.lit(99))
    rest = [c for c in bars.columns if c not in (*KEY, "window_start")]
    best = F.min_by(F.struct(*rest), F.struct(rank, -F.col("trade_count"), F.struct(*rest))).alias("b")
    return bars.groupBy("window_start", *KEY).agg(best).select("window_start", *KEY, "b.*").select(*bars.columns)


def with_source_default(bars: DataFrame) -> DataFrame:
    """`unknown` where source is null or there is no such column."""
    had = F.col("source") if "source" in bars.columns else F.lit(None).cast(T.StringType())
    return bars.withColumn("source", F.coalesce(had, F.lit("unknown")))


def trade_message(trades: DataFrame) -> DataFrame:
    """The published JSON of each trade."""
    from ..functions.columns import iso_utc, side_of

    at = iso_utc("ts")
    return trades.select("exchange", "symbol", F.to_json(F.struct("exchange", "symbol", "price", "qty", at.alias("ts_event"), at.alias("ts_recv"), side_of("is_buyer_maker").alias("side"), F.lit("trade").alias("stream"))).alias("message"))
