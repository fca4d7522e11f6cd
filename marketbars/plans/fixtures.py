"""The tables that registered queries work on, all derived from the given tables, and the same in SQL for DuckDB.

Bars are hourly, from the trades view over events; filled adds the empty bars; labelled marks some live bars as
back-filled by a rule on the hour, so that audits have several sources. Times are epoch seconds (t) in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..schema import KEY
from ..sources.trades import event_trades

HOUR = 3600
INTERVALS = {"alpha": 900, "beta": 3600, "gamma": 3600}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its times have no zone and count as UTC, so the session has to, too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_trades(table(spark, sf_dir, "events"))


def bars(spark: SparkSession, sf_dir: str, interval: int = HOUR) -> DataFrame:
    return B.reusable(B.trades_to_bars(trades(spark, sf_dir), interval))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fill_empty_bars(bars(spark, sf_dir), HOUR)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filled without the bars of hours 5 and 17 of every ninth day, with some live bars marked as back-filled."""
    hour, day = F.hour("window_start"), F.dayofmonth("window_start")
    rows = filled(spark, sf_dir).where(~((day % 9 == 4) & hour.isin(5, 6, 7, 17)))
    return rows.withColumn("source", F.when((F.col("source") == "live") & (hour % 7 == 3), "backfill_1m").otherwise(F.col("source")))


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exchange, symbol, interval_sec of the configured series; one more symbol than there is data for."""
    series = trades(spark, sf_dir).select(*KEY).distinct()
    extra = series.select("exchange").distinct().withColumn("symbol", F.lit("ABSENT"))
    seconds = F.element_at(F.create_map(*[F.lit(x) for kv in INTERVALS.items() for x in kv]), F.col("exchange"))
    return series.unionByName(extra).withColumn("interval_sec", seconds)


def bounds(df: DataFrame) -> tuple[Column, Column, Column]:
    """First day, last day and newest time of bars, as literals."""
    r = df.agg(F.min("window_start"), F.max("window_start")).first()
    return F.to_date(F.lit(r[0])), F.to_date(F.lit(r[1])), F.lit(r[1])


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily trades of line items: price per unit, symbol from flag and status."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("items").alias("exchange"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("qty"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_linenumber") % 2 == 0).alias("is_buyer_maker"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("trade_id"))


def order_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("exchange"), F.upper(F.substring("o_orderpriority", 1, 1)).alias("symbol"), F.col("o_totalprice").cast("double").alias("price"), F.lit(1.0).alias("qty"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderkey") % 2 == 0).alias("is_buyer_maker"), F.col("o_orderkey").cast("long").alias("trade_id"))


def _ohlcv(source: str, bucket: str) -> str:
    o = "ORDER BY ts, trade_id, price"
    return f"""SELECT exchange, symbol, {bucket} AS t, first(price {o}) AS open, max(price) AS high, min(price) AS low, last(price {o}) AS close,
      sum(qty) AS volume_base, sum(price * qty) AS volume_quote, count(*) AS trade_count,
      CASE WHEN sum(qty) > 0 THEN sum(price * qty) / sum(qty) ELSE last(price {o}) END AS vwap, 'live' AS source
    FROM {source} GROUP BY 1, 2, 3"""


def epoch(ts: str) -> str:
    return f"(epoch_us({ts}) // 1000000)"


#: Named common table expressions; each may use those before it.
CTES = {
    "trades": r"""SELECT ['alpha','beta','gamma'][user_id % 3 + 1] AS exchange, upper(event_type) AS symbol, value AS price,
      CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS qty, ts, event_id % 2 = 0 AS is_buyer_maker, event_id AS trade_id FROM events""",
    "bars": _ohlcv("trades", f"{epoch('ts')} // 3600 * 3600"),
    "holes": "SELECT *, lead(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS nxt FROM bars",
    "filled": """SELECT exchange, symbol, t, open, high, low, close, volume_base, volume_quote, trade_count, vwap, source FROM bars
      UNION ALL SELECT exchange, symbol, unnest(range(t + 3600, nxt, 3600)), close, close, close, close, 0.0, 0.0, 0, close, 'empty' FROM holes WHERE nxt - t > 3600""",
    "labelled": """SELECT * REPLACE (CASE WHEN source = 'live' AND (t // 3600 % 24) % 7 = 3 THEN 'backfill_1m' ELSE source END AS source) FROM filled
      WHERE NOT (day(make_timestamp(t * 1000000)) % 9 = 4 AND (t // 3600 % 24) IN (5, 6, 7, 17))""",
    "dim": """SELECT exchange, symbol, CASE exchange WHEN 'alpha' THEN 900 ELSE 3600 END AS interval_sec FROM
      (SELECT DISTINCT exchange, symbol FROM trades UNION SELECT DISTINCT exchange, 'ABSENT' FROM trades)""",
    "intervals": "SELECT DISTINCT exchange, interval_sec FROM dim",
    "clock": "SELECT max(t) AS now, max(t) // 86400 AS today, min(t) // 86400 AS first_day FROM labelled",
    "diffs": "SELECT exchange, symbol, lag(t) OVER w AS prev, t, t - lag(t) OVER w AS diff FROM labelled WINDOW w AS (PARTITION BY exchange, symbol ORDER BY t)",
    "gaps": "SELECT exchange, symbol, prev AS gap_start, t AS gap_end, diff AS duration_sec FROM diffs WHERE diff > 3600",
    "daygaps": """SELECT d.exchange, d.symbol, prev AS gap_start, t AS gap_end, diff AS duration_sec FROM
      (SELECT exchange, symbol, lag(t) OVER w AS prev, t, t - lag(t) OVER w AS diff FROM labelled WINDOW w AS (PARTITION BY exchange, symbol, t // 86400 ORDER BY t)) d
      JOIN intervals i USING (exchange) WHERE diff > 2 * i.interval_sec""",
    "spine": "SELECT dim.*, d.day FROM dim, (SELECT unnest(range(first_day, today + 1)) AS day FROM clock) d",
    "daystats": """SELECT exchange, symbol, t // 86400 AS day, count(*) AS bars, min(t) AS first_t, max(t) AS last_t, count_if(source = 'live') AS live,
      count_if(source LIKE 'backfill%') AS backfill, count_if(source = 'empty') AS empty, sum(trade_count)::BIGINT AS trades, count(DISTINCT source) AS n_sources FROM labelled GROUP BY 1, 2, 3""",
    "q4": """SELECT exchange, symbol, t // 14400 * 14400 AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume_base) AS volume_base,
      sum(trade_count)::BIGINT AS trade_count, CASE WHEN sum(volume_base) > 0 THEN sum(vwap * volume_base) / sum(volume_base) ELSE last(close ORDER BY t) END AS vwap, bool_or(source = 'live') AS is_live
      FROM labelled GROUP BY 1, 2, 3""",
    "lab1": "SELECT exchange, symbol, t, open, high, low, close, volume_base, trade_count, vwap, source = 'live' AS is_live FROM labelled",
}
ORDER = list(CTES)


def with_ctes(body: str, last: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """body after all named expressions up to `last` (lazy in DuckDB), then extra ones."""
    named = {k: CTES[k] for k in ORDER[: ORDER.index(last) + 1]} | (extra or {})
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{k} AS ({v})" for k, v in named.items()) + f"\n{body}"


def r(x: str, digits: int = 6) -> str:
    """round_half_away in SQL."""
    p = 10**digits
    return f"(sign({x}) * floor(abs({x}) * {p}.0 + 0.5) / {p}.0)"
