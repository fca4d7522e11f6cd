"""Streams over stored tables, run to their end, with the result read back as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.trades import event_trades
from .bars import newest_of, stream_bars


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one all executors share (spark.checkpoint.dir). Where that is unset, a local one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table (file or folder) as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{folder}/[{name[0]}]{name[1:]}")


def bars_of_stream(spark: SparkSession, events_path: str, interval: int, delay: Column | None = None) -> DataFrame:
    """Bars of an events table taken as a stream: the last state of each window that the stream emitted in update mode.

    delay: seconds between the time of a trade and its receipt; the bars are then by the time of receipt.

    Nothing is added to what the stream emits; rows that it loses (late beyond the watermark) are missing here, too.
    """
    from ..sources.lake import COLUMNS

    at = work_dir(spark)
    trades, time_col = event_trades(table_stream(spark, events_path)), "ts"
    if delay is not None:
        trades, time_col = trades.withColumn("recv_ts", F.timestamp_seconds(F.unix_micros("ts") / 1000000 + delay)), "recv_ts"
    bars = stream_bars(trades, {}, interval, "1 minute", time_col).select(*COLUMNS)
    write = lambda part, k: part.write.mode("overwrite").parquet(f"{at}/bars/batch={k}")
    q = bars.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bars.schema)
    return newest_of(spark, f"{at}/bars", kept, ["window_start", "exchange", "symbol"]).select(*COLUMNS)
