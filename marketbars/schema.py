"""Schemas of bars and the small tables around them."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"timestamp": T.TimestampType(), "string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


TRADE_SCHEMA = _struct("exchange string, symbol string, price double, qty double, ts timestamp, is_buyer_maker boolean, trade_id bigint")
BARS_SCHEMA = _struct(
    "window_start timestamp, exchange string, symbol string, open double, high double, low double, close double, "
    "volume_base double, volume_quote double, trade_count bigint, vwap double, bid double, ask double, spread double, source string"
)
GAP_SCHEMA = _struct("exchange string, symbol string, gap_start timestamp, gap_end timestamp, duration_sec bigint")
EVENT_SCHEMA = _struct("event string, exchange string, ts string, reason string, gap_seconds double")
HEALTH_SCHEMA = (
    "ts_utc string, mode string, collector struct<status:string,uptime_seconds:bigint,exchanges:array<string>,symbols_count:bigint>, "
    "counters map<string,bigint>, disk struct<data_path:string,raw_files_today:bigint,parquet_files_total:bigint>"
)
#: A series.
KEY = ("exchange", "symbol")
