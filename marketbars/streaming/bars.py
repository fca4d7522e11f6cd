"""Live trades to bars with Structured Streaming: windows with watermarks, stateful gap filling, sinks."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.bars import ohlcv, trade_message, trades_to_bars
from ..schema import KEY, TRADE_SCHEMA
from .state import CHANGES, candle_changes, current_candles, current_indicators, stream_fill  # noqa: F401


def stream_bars(trades: DataFrame, intervals: dict[str, int], default: int = 1, watermark: str = "1 minute", time_col: str = "ts", id_col: str = "trade_id") -> DataFrame:
    """Tumbling bars; a window is emitted once, when the watermark passes its end (append mode).

    A window needs a constant width, so exchanges of one interval make one branch. time_col is event time, or a
    receive time column for processing-time bars, of which none is late.
    """
    rows = trades.withWatermark(time_col, watermark)
    widths = sorted({*intervals.values(), default})
    branches = []
    for w in widths:
        own = [e for e, s in intervals.items() if s == w]
        other = ~F.col("exchange").isin(*intervals) if intervals else F.lit(True)
        part = rows.where(F.col("exchange").isin(own) | other if w == default else F.col("exchange").isin(own))
        bars = part.groupBy(F.window(time_col, f"{w} seconds"), *KEY).agg(*ohlcv(F.col("price"), F.col("qty"), F.struct(time_col, id_col, "price")))
        branches.append(bars.select(F.col("window.start").alias("window_start"), *KEY, *[c for c in bars.columns if c not in ("window", *KEY)]))
    return reduce(DataFrame.unionByName, branches)


def stream_filter(trades: DataFrame, symbols: list[str]) -> DataFrame:
    """The published messages of some symbols, of all if there are none named."""
    return trade_message(trades.where(F.col("symbol").isin(symbols)) if symbols else trades)


def sink(bars: DataFrame, root: str, checkpoint: str, every: str | None = "1 minute") -> DataStreamWriter:
    """Append bars to a partitioned lake; the checkpoint makes each bar arrive once. every None: take what is there and stop."""
    from ..sources.lake import PARTITIONS, with_calendar_partitions

    w = with_calendar_partitions(bars).writeStream.format("parquet").partitionBy(*PARTITIONS).option("path", root).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def raw_archive(raw: DataFrame, root: str, checkpoint: str, every: str | None = "1 minute") -> DataStreamWriter:
    """Archive raw lines (exchange, symbol, ts, value) as compressed text by exchange, symbol and date."""
    rows = raw.select("value", *KEY, F.to_date("ts").alias("date"))
    w = rows.writeStream.format("text").partitionBy(*KEY, "date").option("path", root).option("compression", "gzip").option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def merge_candles(history: DataFrame, now: DataFrame) -> DataFrame:
    """History with newer bars merged on. Equal buckets are combined, not replaced: the open bucket grows."""
    cols = [c for c in now.columns if c in history.columns]
    both = history.select(*cols).withColumn("_late", F.lit(0)).unionByName(now.select(*cols).withColumn("_late", F.lit(1)))
    base, quote = F.sum("volume_base"), F.sum("volume_quote")
    last = F.max_by("close", "_late")
    return both.groupBy("window_start", *KEY).agg(
        F.min_by("open", "_late").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last.alias("close"), base.alias("volume_base"), quote.alias("volume_quote"),
        F.sum("trade_count").alias("trade_count"), F.when(base > 0, quote / base).otherwise(last).alias("vwap"))


def live_candles(history: DataFrame, trades: DataFrame, interval: int) -> DataFrame:
    """History with the open bucket of a batch of trades merged on."""
    return merge_candles(history, trades_to_bars(trades, interval))


def live_candle_stream(trades: DataFrame, history: DataFrame | None, root: str, checkpoint: str, interval: int, keep: int = 120, indicators: bool = True) -> DataStreamWriter:
    """Live trades amend candles kept as state for each series; their changes (state.candle_changes) are appended below root, each once.

    newest_candles() and newest_indicators() read the current ones. A batch costs the series it has trades of: neither
    history nor earlier batches are read again.
    """
    changes = candle_changes(trades, interval, keep, history, indicators)
    return changes.writeStream.format("parquet").partitionBy("kind").option("path", root).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def changes_below(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(CHANGES).option("basePath", root).parquet(root)


CANDLE = ("window_start", *KEY, "open", "high", "low", "close", "volume_base", "volume_quote", "trade_count", "vwap")

def newest_of(spark: SparkSession, path: str, schema: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest version of each row that the batches (before one, if given) left below path."""
    names = [f.name for f in spark.createDataFrame([], schema).schema if f.name not in keys]
    empty = spark.createDataFrame([], f"{schema}, batch long")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
    rows = spark.read.schema(f"{schema}, batch long").parquet(path) if there else empty
    rows = rows.where(F.col("batch") < before) if before is not None else rows
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x")).select(*keys, "x.*")


def newest_candles(spark: SparkSession, history: DataFrame | None, root: str) -> DataFrame:
    """The candles as the stream left them below root, and those of history that no trade touched."""
    live = current_candles(changes_below(spark, root)).select(*CANDLE)
    keys = ["window_start", *KEY]
    return live if history is None else live.unionByName(history.select(*CANDLE).join(live.select(*keys), keys, "left_anti"))


def newest_indicators(spark: SparkSession, root: str) -> DataFrame:
    """The indicators that the stream below root refreshed last for each series."""
    return current_indicators(changes_below(spark, root))


def closing_trade(spark: SparkSession, at: int, watermark: int = 60) -> DataFrame:
    """One trade of no series that there is, so late (at, in seconds, is the end of the last window) that the watermark passes all others: the final flush."""
    return spark.createDataFrame([(CLOSING, CLOSING, 0.0, 0.0, datetime.fromtimestamp(at + watermark + 1, timezone.utc), False, -1)], TRADE_SCHEMA)


#: Exchange and symbol of the trade that closes a stream; its own bar is never sent, since nothing comes after it.
CLOSING = "_closing"


def late_stream(trades: DataFrame, root: str, checkpoint: str, interval: int, delay: int, time_col: str = "ts") -> DataStreamWriter:
    """Bars of the trades in time, with late trades in a side table: nothing is dropped unseen.

    A trade is late if it is more than `delay` seconds older than the newest trade of the batches before its own. Below
    root, batch k leaves bars/batch=k (partial bars, to be merged by merge_candles), late/batch=k (the late trades with
    seconds_late) and newest/batch=k (one row: the newest time so far). A batch that runs again overwrites its own.
    """

    def split(part: DataFrame, k: int) -> None:
        spark = part.sparkSession
        seen = newest_seen(spark, root, k)
        limit = F.lit(seen if seen is not None else -(1 << 62)) - delay
        t = F.unix_seconds(time_col)
        late = part.where(t < limit).withColumn("seconds_late", limit - t)
        late.write.mode("overwrite").parquet(f"{root}/late/batch={k}")
        trades_to_bars(part.where(t >= limit), interval).select(*CANDLE).write.mode("overwrite").parquet(f"{root}/bars/batch={k}")
        part.agg(F.greatest(F.max(t), F.lit(seen)).alias("newest")).write.mode("overwrite").parquet(f"{root}/newest/batch={k}")

    return trades.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def newest_seen(spark: SparkSession, root: str, before: int) -> int | None:
    """The newest time that the batches before one have seen: the last of them wrote it down."""
    return spark.read.schema("newest long").parquet(f"{root}/newest/batch={before - 1}").first()[0] if before else None


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """Number of late trades and the most seconds by which one was late, for each series."""
    late = spark.read.schema("exchange string, symbol string, seconds_late long").parquet(f"{root}/late")
    return late.groupBy(*KEY).agg(F.count(F.lit(1)).alias("late"), F.max("seconds_late").alias("most_seconds"))
