"""All registered market queries over the given tables, each with its SQL for DuckDB where SQL can express it.

Times are epoch seconds and doubles are rounded alike on both sides, so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import signals as S
from ..operators import audit as A
from ..operators import bars as B
from ..operators import gaps as G
from ..operators import indicators as I
from ..operators import planning as P
from ..schema import KEY
from ..sources import lake as L
from . import fixtures as Z
from . import market as M
from .fixtures import epoch, r, with_ctes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import lake_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import lake_queries  # noqa: F401

    return dict(_SQL)


def t(c: str = "window_start", name: str = "t") -> Column:
    return F.unix_seconds(c).alias(name)


def rr(*names: str, digits: int = 6) -> list[Column]:
    return [X.round_half_away(F.col(c).cast("double"), digits).alias(c) for c in names]


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


PRICES = ("open", "high", "low", "close", "volume_base", "vwap")
ISO = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def iso(x: str) -> str:
    return ISO.format(x)


# --- bars


@query("bars_hourly", with_ctes(f"SELECT exchange, symbol, {iso('t')} AS ts, {rs('open', 'high', 'low', 'close', 'volume_base')}, trade_count, {rs('vwap')} FROM bars", "bars"))
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: hourly bars of all series, newest first."""
    rows = M.select_bars_output(Z.bars(spark, sf).orderBy(F.desc("window_start"), *KEY))
    return rows.select("exchange", "symbol", "ts", *rr("open", "high", "low", "close", "volume_base"), "trade_count", *rr("vwap"))




@query("a2_bars_by_exchange_interval", with_ctes(
    f"SELECT exchange, symbol, t, {rs(*PRICES)}, {rs('volume_quote')}, trade_count, source FROM (" + Z._ohlcv("(SELECT trades.*, CASE exchange WHEN 'alpha' THEN 900 ELSE 3600 END AS iv FROM trades)", f"{epoch('ts')} // iv * iv") + ")", "trades"))
def a2(spark: SparkSession, sf: str) -> DataFrame:
    dim = Z.dim(spark, sf).select("exchange", "interval_sec").distinct()
    return B.trades_to_bars(Z.trades(spark, sf), 1, dim).select(*KEY, t(), *rr(*PRICES, "volume_quote"), "trade_count", "source")


@query("a3_fill_empty_bars", with_ctes(f"SELECT exchange, symbol, t, {rs(*PRICES)}, trade_count, source FROM filled", "filled"))
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return Z.filled(spark, sf).select(*KEY, t(), *rr(*PRICES), "trade_count", "source")


@query("a3_dense_fill_daily", with_ctes("SELECT exchange, symbol, t // 86400 AS day, count(*) AS bars, count_if(n = 0) AS empty_bars FROM filled5 GROUP BY 1, 2, 3", "trades", {
    "b5": f"SELECT exchange, symbol, {epoch('ts')} // 300 * 300 AS t, count(*) AS n FROM trades GROUP BY 1, 2, 3",
    "h5": "SELECT *, lead(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS nxt FROM b5",
    "filled5": "SELECT exchange, symbol, t, n FROM b5 UNION ALL SELECT exchange, symbol, unnest(range(t + 300, nxt, 300)), 0 FROM h5 WHERE nxt - t > 300"}))
def a3_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute bars with all empty ones (some 130,000 a month for each series at any scale), counted by day."""
    rows = B.fill_empty_bars(Z.bars(spark, sf, 300), 300)
    return rows.groupBy(*KEY, F.floor(F.unix_seconds("window_start") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("trade_count") == 0).alias("empty_bars"))


@query("a4_resample_4h", with_ctes(f"SELECT exchange, symbol, t, {rs(*PRICES)}, trade_count, is_live FROM q4", "q4"))
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return B.resample_bars(Z.labelled(spark, sf), 14400).select(*KEY, t(), *rr(*PRICES), "trade_count", "is_live")


@query("a4_resample_all_exchanges", with_ctes(
    f"""SELECT symbol, t // 86400 * 86400 AS t, {r('first(open ORDER BY t, exchange)')} AS open, {r('max(high)')} AS high, {r('min(low)')} AS low, {r('last(close ORDER BY t, exchange)')} AS close,
      {r('sum(volume_base)')} AS volume_base, sum(trade_count)::BIGINT AS trade_count FROM labelled GROUP BY 1, 2""", "labelled"))  # fmt: skip
def a4_all(spark: SparkSession, sf: str) -> DataFrame:
    return B.resample_bars(Z.labelled(spark, sf), 86400, by_exchange=False).select("symbol", t(), *rr("open", "high", "low", "close", "volume_base"), "trade_count")


@query("a5_resample_rule", with_ctes(
    f"""SELECT exchange, symbol, t // 86400 * 86400 AS t, {r('first(open ORDER BY t)')} AS open, {r('max(high)')} AS high, {r('min(low)')} AS low, {r('last(close ORDER BY t)')} AS close,
      {r('sum(volume_base)')} AS volume_base, sum(trade_count)::BIGINT AS trade_count FROM bars GROUP BY 1, 2, 3""", "bars"))  # fmt: skip
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return B.resample_rule(Z.bars(spark, sf), "1 day").select(*KEY, t("window"), *rr("open", "high", "low", "close", "volume_base"), "trade_count")


_DAILY = """SELECT exchange, symbol, {d} AS t, {o} AS open, {h} AS high, {l} AS low, {c} AS close, {v} AS volume_base, count(*) AS trade_count FROM {src} GROUP BY 1, 2, 3"""


@query("a1_lineitem_bars", "WITH trades AS (SELECT 'items' AS exchange, l_returnflag || l_linestatus AS symbol, CAST(l_extendedprice / l_quantity AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS qty, CAST(l_shipdate AS TIMESTAMP) AS ts, l_orderkey * 10 + l_linenumber AS trade_id FROM lineitem) "
       + _DAILY.format(src="trades", d=f"{epoch('ts')} // 86400 * 86400", o=r("first(price ORDER BY ts, trade_id, price)", 4), h=r("max(price)", 4), l=r("min(price)", 4), c=r("last(price ORDER BY ts, trade_id, price)", 4), v=r("sum(qty)", 4)))
def a1_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return B.trades_to_bars(Z.lineitem_trades(spark, sf), 86400).select(*KEY, t(), *rr("open", "high", "low", "close", "volume_base", digits=4), "trade_count")


@query("u1_union_sources", "WITH o AS (SELECT 'orders' AS exchange, upper(substr(o_orderpriority, 1, 1)) AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders), l AS (SELECT 'items' AS exchange, l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS TIMESTAMP) AS ts FROM lineitem) "
       f"SELECT exchange, symbol, {epoch('ts')} // 86400 * 86400 AS t, count(*) AS trade_count FROM (SELECT * FROM o UNION ALL SELECT * FROM l) GROUP BY 1, 2, 3")  # fmt: skip
def u1(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.trades_to_bars(Z.order_trades(spark, sf), 86400).unionByName(B.trades_to_bars(Z.lineitem_trades(spark, sf), 86400))
    return rows.select(*KEY, t(), "trade_count")


@query("u2_dedup_bars", with_ctes("SELECT exchange, symbol, t, source, trade_count FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol, t ORDER BY p) AS k FROM (SELECT *, CASE source WHEN 'live' THEN 1 WHEN 'backfill_1m' THEN 3 ELSE 4 END AS p FROM (SELECT exchange, symbol, t, source, trade_count FROM labelled UNION ALL SELECT exchange, symbol, t, 'backfill_1m', trade_count FROM bars))) WHERE k = 1", "labelled"))
def u2(spark: SparkSession, sf: str) -> DataFrame:
    again = Z.bars(spark, sf).withColumn("source", F.lit("backfill_1m"))
    return B.dedup_bars(Z.labelled(spark, sf).unionByName(again)).select(*KEY, t(), "source", "trade_count")


@query("s14_source_default", with_ctes("SELECT coalesce(CASE WHEN source = 'empty' THEN NULL ELSE source END, 'unknown') AS source, count(*) AS bars FROM labelled GROUP BY 1", "labelled"))
def s14(spark: SparkSession, sf: str) -> DataFrame:
    rows = Z.labelled(spark, sf).withColumn("source", F.nullif("source", F.lit("empty")))
    return B.with_source_default(rows).groupBy("source").agg(F.count(F.lit(1)).alias("bars"))


@query("p5_trade_messages", with_ctes("SELECT exchange, symbol, CASE WHEN is_buyer_maker THEN 'sell' ELSE 'buy' END AS side, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS ts_event, count(*) AS n FROM trades GROUP BY 1, 2, 3, 4", "trades"))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    m = B.trade_message(Z.trades(spark, sf))
    get = lambda k: F.get_json_object("message", f"$.{k}").alias(k)
    return m.select(get("exchange"), get("symbol"), get("side"), get("ts_event")).groupBy("exchange", "symbol", "side", "ts_event").agg(F.count(F.lit(1)).alias("n"))


# --- scans, filters, sorts


@query("s3_query_symbol", with_ctes(f"SELECT t, {rs('open', 'close')}, source FROM labelled, clock WHERE exchange = 'beta' AND symbol = (SELECT min(symbol) FROM trades) AND t // 86400 BETWEEN first_day + 3 AND first_day + 9", "clock"))
def s3(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    first = bars.agg(F.to_date(F.min("window_start")), F.min("symbol")).first()
    from datetime import timedelta

    return L.query_symbol(bars, "beta", first[1], str(first[0] + timedelta(3)), str(first[0] + timedelta(9)), ["window_start", "open", "close", "source"]).select(t(), *rr("open", "close"), "source")


@query("s4_read_latest", with_ctes("SELECT exchange, symbol, t FROM labelled JOIN (SELECT exchange, symbol, max(t) AS m FROM labelled GROUP BY 1, 2) USING (exchange, symbol) WHERE t > m - 25 * 3600", "labelled"))
def s4(spark: SparkSession, sf: str) -> DataFrame:
    return B.recent_window(Z.labelled(spark, sf), Z.HOUR, 24).select(*KEY, t())


@query("s5_discover_series", with_ctes("SELECT DISTINCT exchange, symbol FROM labelled", "labelled"))
def s5(spark: SparkSession, sf: str) -> DataFrame:
    return L.discover_series(Z.labelled(spark, sf))


@query("s6_symbols_by_exchange", with_ctes("SELECT exchange, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM dim GROUP BY 1", "dim"))
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return L.symbols_by_exchange(Z.dim(spark, sf)).select("exchange", F.concat_ws(",", "symbols").alias("symbols"))


@query("f2_lookback", with_ctes("SELECT exchange, symbol, t, source FROM labelled, clock WHERE t >= now - 48 * 3600 AND trade_count > 0 AND source LIKE 'backfill%' AND t // 86400 < today", "clock"))
def f2(spark: SparkSession, sf: str) -> DataFrame:
    """Lookback, trade count, source prefix and the partial last day in one filter."""
    bars = Z.labelled(spark, sf)
    _, today, now = Z.bounds(bars)
    rows = bars.where((F.unix_seconds("window_start") >= F.unix_seconds(now) - 48 * 3600) & (F.col("trade_count") > 0) & F.col("source").like("backfill%") & (F.to_date("window_start") < today))
    return rows.select(*KEY, t(), "source")


@query("f10_prefix_filter", with_ctes("SELECT exchange, symbol, count(*) AS bars FROM labelled WHERE exchange = 'alpha' OR (exchange || '/' || symbol) LIKE 'beta/C%' GROUP BY 1, 2", "labelled"))
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return L.prefix_filter(Z.labelled(spark, sf), ["alpha", "beta/C"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("bars"))


@query("f13_complete_bars", with_ctes("SELECT exchange, symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k, count(*) OVER (PARTITION BY exchange, symbol) AS n FROM q4) WHERE k > 1 OR n = 1", "q4"))
def f13(spark: SparkSession, sf: str) -> DataFrame:
    return B.complete_bars(B.resample_bars(Z.labelled(spark, sf), 14400)).select(*KEY, t())


@query("t3_last_bars", with_ctes(f"SELECT exchange, symbol, t, {rs('close')} FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM q4) WHERE k <= 20", "q4"))
def t3(spark: SparkSession, sf: str) -> DataFrame:
    return B.newest(B.resample_bars(Z.labelled(spark, sf), 14400), 20).select(*KEY, t(), *rr("close"))


@query("t4_top_gaps", with_ctes("SELECT exchange, symbol, gap_start, duration_sec FROM gaps ORDER BY duration_sec DESC, exchange, symbol, gap_start LIMIT 200", "gaps"))
def t4(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_gaps(G.find_gaps(Z.labelled(spark, sf), Z.HOUR)).select(*KEY, t("gap_start", "gap_start"), "duration_sec")


@query("t7_last_trades", with_ctes(f"SELECT trade_id, exchange, symbol, {rs('price')} FROM trades ORDER BY ts DESC, trade_id DESC LIMIT 8", "trades"))
def t7(spark: SparkSession, sf: str) -> DataFrame:
    return Z.trades(spark, sf).orderBy(F.desc("ts"), F.desc("trade_id")).limit(8).select("trade_id", *KEY, *rr("price"))


@query("t7_last_price", with_ctes(f"SELECT exchange, symbol, {r('last(price ORDER BY ts, trade_id)')} AS price FROM trades GROUP BY 1, 2", "trades"))
def t7_price(spark: SparkSession, sf: str) -> DataFrame:
    return Z.trades(spark, sf).groupBy(*KEY).agg(F.max_by("price", F.struct("ts", "trade_id")).alias("price")).select(*KEY, *rr("price"))


@query("c16_bars_latest", with_ctes(
    f"SELECT exchange, symbol, {iso('t')} AS ts, {rs('open', 'high', 'low', 'close', 'volume_base')}, trade_count, {rs('vwap')} FROM q4 WHERE symbol = 'CLICK' ORDER BY t DESC, exchange LIMIT 50", "q4"))
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return M.bars_latest(Z.labelled(spark, sf), "CLICK", "4h", 50).select("exchange", "symbol", "ts", *rr("open", "high", "low", "close", "volume_base"), "trade_count", *rr("vwap"))


@query("p11_bars_sample", with_ctes(
    f"SELECT exchange, symbol, string_agg(ts || '=' || c, ',' ORDER BY t) AS sample FROM (SELECT *, {iso('t')} AS ts, CAST(CAST(floor(abs(close) * 100.0 + 0.5) * sign(close) AS BIGINT) AS VARCHAR) AS c, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM q4) WHERE k <= 5 GROUP BY 1, 2", "q4"))
def p11(spark: SparkSession, sf: str) -> DataFrame:
    s = M.bars_sample(B.resample_bars(Z.labelled(spark, sf), 14400))
    return s.select(*KEY, F.concat_ws(",", F.transform("bars_sample", lambda x: F.concat_ws("=", x["ts"], F.round(x["close"] * 100).cast("long").cast("string")))).alias("sample"))


# --- summaries and audits


@query("a6_symbol_summary", with_ctes(
    f"""SELECT exchange, symbol, count(*) AS total_bars, count_if(source = 'live') AS live_bars, count_if(trade_count = 0) AS empty_bars, sum(trade_count)::BIGINT AS total_trades, {iso('min(t)')} AS earliest, {iso('max(t)')} AS latest,
      {r('last(close ORDER BY t)')} AS last_close, {r("(max(t) - min(t)) / 3600.0")} AS data_hours, {r("count_if(source = 'live') * 100.0 / count(*)")} AS live_pct FROM labelled GROUP BY 1, 2""", "labelled"))  # fmt: skip
def a6(spark: SparkSession, sf: str) -> DataFrame:
    s = A.symbol_summary(Z.labelled(spark, sf))
    return s.select(*KEY, "total_bars", "live_bars", "empty_bars", "total_trades", X.iso_utc("earliest").alias("earliest"), X.iso_utc("latest").alias("latest"), *rr("last_close", "data_hours", "live_pct"))


@query("a7_lake_rollup", with_ctes(f"SELECT count(*) AS symbols, sum(n)::BIGINT AS bars, sum(l)::BIGINT AS live, sum(tr)::BIGINT AS trades, {r('avg(l * 100.0 / n)')} AS avg_live_pct FROM (SELECT count(*) AS n, count_if(source = 'live') AS l, sum(trade_count) AS tr FROM labelled GROUP BY exchange, symbol)", "labelled"))
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return A.lake_rollup(A.symbol_summary(Z.labelled(spark, sf))).select("symbols", "bars", "live", "trades", *rr("avg_live_pct"))


@query("a8_day_stats", with_ctes("SELECT * FROM daystats", "daystats"))
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return A.day_stats(Z.labelled(spark, sf)).select(*KEY, F.unix_date("day").cast("long").alias("day"), "bars", t("first_ts", "first_t"), t("last_ts", "last_t"), "live", "backfill", "empty", "trades", "n_sources")


@query("a9_fast_day_stats", with_ctes(f"SELECT exchange, symbol, day, bars, {r('live * 100.0 / bars')} AS live_pct, {r('empty * 100.0 / bars')} AS empty_pct FROM daystats", "daystats"))
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return A.fast_day_stats(Z.labelled(spark, sf)).select(*KEY, F.unix_date("day").cast("long").alias("day"), "bars", *rr("live_pct", "empty_pct"))


@query("a10_recent_quality", with_ctes(
    f"""SELECT d.exchange, d.symbol, coalesce(total, 0) AS total, with_trades, ws_live, empty, backfill, first, last, {rs('max_close', 'min_close')}, {r('with_trades * 100.0 / total')} AS live_pct, {r('ws_live * 100.0 / total')} AS ws_pct,
      CASE WHEN total IS NULL THEN 'no data in window' ELSE '' END AS note FROM dim d LEFT JOIN (SELECT exchange, symbol, count(*) AS total, count_if(trade_count > 0) AS with_trades, count_if(source = 'live') AS ws_live, count_if(source = 'empty') AS empty,
      count_if(source LIKE 'backfill%') AS backfill, min(t) AS first, max(t) AS last, max(close) AS max_close, min(close) AS min_close FROM labelled, clock WHERE t >= now - 48 * 3600 GROUP BY 1, 2) USING (exchange, symbol)""", "clock"))  # fmt: skip
def a10(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    q = A.recent_quality(bars, Z.dim(spark, sf), Z.bounds(bars)[2])
    return q.select(*KEY, F.col("total").cast("long").alias("total"), "with_trades", "ws_live", "empty", "backfill", t("first", "first"), t("last", "last"), *rr("max_close", "min_close", "live_pct", "ws_pct"), "note")


@query("a11_source_distribution", with_ctes(f"SELECT exchange, source, n AS bars, {r('n * 100.0 / sum(n) OVER (PARTITION BY exchange)')} AS pct FROM (SELECT exchange, source, count(*) AS n FROM labelled GROUP BY 1, 2)", "labelled"))
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return A.source_distribution(Z.labelled(spark, sf), ("exchange",)).select("exchange", "source", "bars", *rr("pct"))


@query("a12_source_breakdown", with_ctes("SELECT exchange, symbol, string_agg(source || '=' || n, ',' ORDER BY source) AS sources FROM (SELECT exchange, symbol, source, count(*) AS n FROM labelled GROUP BY GROUPING SETS ((exchange, symbol, source), (source))) GROUP BY 1, 2", "labelled"))
def a12(spark: SparkSession, sf: str) -> DataFrame:
    s = A.source_breakdown(Z.labelled(spark, sf))
    return s.select(*KEY, F.concat_ws(",", F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("sources"))


@query("a13_hourly_profile", with_ctes(f"SELECT lpad(CAST(t // 3600 % 24 AS VARCHAR), 2, '0') AS hour, count(*) AS bars, sum(trade_count)::BIGINT AS trades, {r('avg(close)')} AS avg_close, {r('sum(volume_base)')} AS volume FROM labelled GROUP BY 1", "labelled"))
def a13(spark: SparkSession, sf: str) -> DataFrame:
    return A.hourly_profile(Z.labelled(spark, sf)).select("hour", "bars", "trades", *rr("avg_close", "volume"))


_BROKEN = "CASE WHEN t % 50400 = 0 THEN low - 1 ELSE high END"
_ISSUES = ("high<low", "high<open", "high<close", "low>open", "low>close", "neg_vol", "zero_open")


def _violations(high: str) -> str:
    """Per series: the count of each violation, extremes of live bars, and the status of all seven. high: that of the bars to be judged."""
    return f"""SELECT *, CASE WHEN {' + '.join(f'v{i}' for i in range(len(_ISSUES)))} = 0 THEN 'OK' ELSE 'FAIL: ' || concat_ws(', ', {', '.join(f"CASE WHEN v{i} > 0 THEN '{name}:' || v{i} END" for i, name in enumerate(_ISSUES))}) END AS status FROM
      (SELECT exchange, symbol, count(*) AS total, count_if(h < low) AS v0, count_if(h < open AND source = 'live') AS v1, count_if(h < close AND source = 'live') AS v2, count_if(low > open AND source = 'live') AS v3, count_if(low > close AND source = 'live') AS v4,
         count_if(volume_base < 0) AS v5, count_if(open <= 0 AND source = 'live') AS v6, min(open) FILTER (source = 'live') AS min_open, max(open) FILTER (source = 'live') AS max_open, min(volume_base) FILTER (source = 'live') AS min_volume
       FROM (SELECT *, {high} AS h FROM labelled) GROUP BY 1, 2)"""


_VALID = {"violations": _violations("high")}


@query("a14_ohlcv_violations", with_ctes(f"SELECT exchange, symbol, total, v0, v1, v2, {rs('min_open', 'max_open', 'min_volume')}, status FROM violations", "labelled", {"violations": _violations(_BROKEN)}))
def a14(spark: SparkSession, sf: str) -> DataFrame:
    broken = Z.labelled(spark, sf).withColumn("high", F.when(F.unix_seconds("window_start") % 50400 == 0, F.col("low") - 1).otherwise(F.col("high")))
    return A.ohlcv_violations(broken).select(*KEY, "total", "v0", "v1", "v2", *rr("min_open", "max_open", "min_volume"), "status")


@query("a15_all_ok", with_ctes("SELECT coalesce(bool_and(status = 'OK'), true) AS all_ok, count_if(status <> 'OK')::BIGINT AS failed FROM violations", "labelled", _VALID))
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return A.all_ok(A.ohlcv_violations(Z.labelled(spark, sf)))


@query("a16_count_bars", with_ctes("SELECT exchange, symbol, day, bars FROM daystats", "daystats"))
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return A.count_bars(Z.labelled(spark, sf)).select(*KEY, F.unix_date("day").cast("long").alias("day"), "bars")


@query("a18_interval_mode", with_ctes(
    """SELECT exchange, symbol, max(diff) FILTER (k = 1) AS mode_sec, max(n) FILTER (k = 1) AS mode_count, string_agg(diff || 'x' || n, ',' ORDER BY k) FILTER (k <= 3) AS top3, CASE WHEN max(diff) FILTER (k = 1) = max(interval_sec) THEN 'OK' ELSE 'MISMATCH' END AS status FROM
      (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY n DESC, diff) AS k FROM (SELECT exchange, symbol, diff, count(*) AS n FROM (SELECT exchange, symbol, t - lag(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS diff, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t) AS rn FROM bars) WHERE rn <= 51 AND diff IS NOT NULL GROUP BY 1, 2, 3)) JOIN intervals USING (exchange) GROUP BY 1, 2""", "intervals"))  # fmt: skip
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return A.interval_mode(Z.bars(spark, sf), Z.dim(spark, sf))


_HMS = "strftime(make_timestamp({} * 1000000), '%H:%M:%S')"
_REPORT = f"""SELECT s.exchange, s.symbol, s.day, coalesce(bars, 0) AS bar_count, coalesce(live, 0) AS live, coalesce(backfill, 0) AS backfill, coalesce(empty, 0) AS empty, coalesce(n, 0) AS gaps, {_HMS.format('first_t')} AS first, {_HMS.format('last_t')} AS last,
      round(coalesce(bars, 0) * 100.0 / (86400 // s.interval_sec), 1) AS pct, CASE WHEN bars IS NULL THEN 'MISSING' WHEN s.day = today THEN 'partial' WHEN round(bars * 100.0 / (86400 // s.interval_sec), 1) >= 90 THEN 'OK' ELSE 'LOW' END AS status
      FROM spine s CROSS JOIN clock LEFT JOIN daystats USING (exchange, symbol, day) LEFT JOIN (SELECT exchange, symbol, gap_start // 86400 AS day, count(*) AS n FROM daygaps GROUP BY 1, 2, 3) USING (exchange, symbol, day)"""


def _report(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    first, today, _ = Z.bounds(bars)
    return A.completeness_report(bars, Z.dim(spark, sf), first, today, today)


@query("a20_completeness_report", with_ctes(_REPORT, "daystats"))
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).withColumn("day", F.unix_date("day").cast("long"))


@query("a19_full_audit_summary", with_ctes(
    "SELECT exchange, symbol, count_if(bar_count > 0) AS days_present, sum(bar_count)::BIGINT AS total_bars, sum(gaps)::BIGINT AS total_gaps, CASE WHEN sum(bar_count) > 0 THEN round(sum(live) * 100.0 / sum(bar_count), 1) ELSE 0 END AS live_pct, CASE WHEN sum(bar_count) > 0 THEN round(sum(backfill) * 100.0 / sum(bar_count), 1) ELSE 0 END AS backfill_pct FROM report GROUP BY 1, 2", "daystats", {"report": _REPORT}))
def a19(spark: SparkSession, sf: str) -> DataFrame:
    return A.full_audit_summary(_report(spark, sf))


@query("a21_audit_day_notes", with_ctes(
    f"""SELECT d.exchange, d.symbol, d.day, bars, concat_ws('; ', CASE WHEN round(bars * 100.0 / (86400 // interval_sec), 1) < 80 THEN 'INCOMPLETE' END, coalesce(g, '')) AS notes FROM daystats d JOIN intervals USING (exchange) LEFT JOIN
      (SELECT exchange, symbol, day, string_agg({_HMS.format('gap_start')} || ' ' || (duration_sec // 3600) || 'h' || lpad(CAST(duration_sec % 3600 // 60 AS VARCHAR), 2, '0') || 'm', ', ' ORDER BY gap_start) AS g FROM (SELECT *, gap_start // 86400 AS day, row_number() OVER (PARTITION BY exchange, symbol, gap_start // 86400 ORDER BY gap_start) AS k FROM daygaps) WHERE k <= 2 GROUP BY 1, 2, 3) g USING (exchange, symbol, day)""", "daystats"))  # fmt: skip
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return A.audit_day_notes(Z.labelled(spark, sf), Z.dim(spark, sf)).withColumn("day", F.unix_date("day").cast("long"))


@query("a22_missing_days", with_ctes("SELECT exchange, symbol, day FROM spine, clock WHERE day <> today AND NOT EXISTS (FROM daystats d WHERE d.exchange = spine.exchange AND d.symbol = spine.symbol AND d.day = spine.day)", "daystats"))
def a22(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    first, today, _ = Z.bounds(bars)
    return A.missing_days(bars, Z.dim(spark, sf), first, today, today).select(*KEY, F.unix_date("day").cast("long").alias("day"))


_COVER = "SELECT exchange, symbol, bars, span_sec, trade_pct, coalesce(gap_count, 0) AS gap_count, coalesce(gap_sec, 0)::BIGINT AS gap_sec FROM (SELECT exchange, symbol, count(*) AS bars, max(t) - min(t) AS span_sec, count_if(trade_count > 0) * 100.0 / count(*) AS trade_pct FROM labelled GROUP BY 1, 2 HAVING count(*) >= 2) LEFT JOIN (SELECT exchange, symbol, count(*) AS gap_count, sum(duration_sec) AS gap_sec FROM gaps GROUP BY 1, 2) USING (exchange, symbol)"


@query("a23_coverage", with_ctes(f"SELECT exchange, symbol, bars, span_sec, {rs('trade_pct')}, gap_count, gap_sec, {r('(span_sec - gap_sec) * 100.0 / span_sec')} AS coverage_pct FROM cover", "gaps", {"cover": _COVER}))
def a23(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    return A.coverage(bars, G.find_gaps(bars, Z.HOUR)).select(*KEY, "bars", "span_sec", *rr("trade_pct"), "gap_count", "gap_sec", *rr("coverage_pct"))


_CAUSE = "CASE WHEN duration_sec > 3600 THEN 'Computer shutdown/restart' WHEN duration_sec > 300 THEN 'App restart or extended network outage' WHEN duration_sec > 60 THEN 'Network switch or brief disconnect' WHEN duration_sec > 5 THEN 'WebSocket reconnect' ELSE 'Unknown' END"
_TRADE_GAPS = {
    "secs": f"SELECT DISTINCT exchange, symbol, {epoch('ts')} AS t FROM trades",
    "tg": "SELECT exchange, symbol, prev AS gap_start, t AS gap_end, t - prev AS duration_sec FROM (SELECT exchange, symbol, t, lag(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS prev FROM secs) WHERE t - prev > 5",
}


def _trade_gaps(spark: SparkSession, sf: str, threshold: int = 5) -> DataFrame:
    return G.find_gaps(B.trades_to_bars(Z.trades(spark, sf), 1), threshold)


@query("a24_gap_causes", with_ctes(f"SELECT cause, count(*) AS n_gaps, sum(duration_sec)::BIGINT AS total_sec, {r('avg(duration_sec)', 3)} AS avg_sec FROM (SELECT *, {_CAUSE} AS cause FROM tg) GROUP BY 1", "trades", _TRADE_GAPS))
def a24(spark: SparkSession, sf: str) -> DataFrame:
    return G.cause_breakdown(_trade_gaps(spark, sf)).select("cause", "n_gaps", "total_sec", *rr("avg_sec", digits=3))


@query("a25_gap_overall", with_ctes("SELECT min(t) AS first, max(t) AS last, count(*) AS bars, count_if(trade_count > 0) AS with_trades, count_if(trade_count = 0) AS no_trades, count(DISTINCT exchange) AS exchanges, count(DISTINCT symbol) AS symbols, (SELECT sum(span_sec)::BIGINT FROM cover) AS span_sec, (SELECT sum(gap_count)::BIGINT FROM cover) AS gaps FROM labelled", "gaps", {"cover": _COVER}))
def a25(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    o = A.gap_overall(bars, A.coverage(bars, G.find_gaps(bars, Z.HOUR)))
    return o.withColumn("first", F.unix_seconds("first")).withColumn("last", F.unix_seconds("last"))


@query("a26_stats_24h", with_ctes(
    f"""SELECT exchange, symbol, {rs('price', 'open_24h')}, {r('h')} AS high_24h, {r('l')} AS low_24h, {r('v')} AS volume_24h, n AS trades_24h, {r('CASE WHEN v > 0 THEN vv / v ELSE price END')} AS vwap_24h, {r('CASE WHEN open_24h > 0 THEN (price - open_24h) * 100.0 / open_24h ELSE 0.0 END')} AS change_24h_pct FROM
      (SELECT exchange, symbol, last(close ORDER BY t) AS price, first(open ORDER BY t) AS open_24h, max(high) AS h, min(low) AS l, sum(CASE WHEN is_live THEN volume_base ELSE 0 END) AS v, sum(CASE WHEN is_live THEN volume_base * vwap ELSE 0 END) AS vv, sum(trade_count)::BIGINT AS n FROM
        (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM lab1) WHERE k <= 24 GROUP BY 1, 2)""", "lab1"))  # fmt: skip
def a26(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf).withColumn("is_live", F.col("source") == "live")
    s = A.stats_24h(bars, Z.HOUR)
    return s.select(*KEY, *rr("price", "open_24h", "high_24h", "low_24h", "volume_24h"), "trades_24h", *rr("vwap_24h", "change_24h_pct"))


@query("a27_last_bar_age", with_ctes(f"SELECT {r('(max(now) + 1234 - max(t)) / 60.0')} AS age_minutes FROM labelled, clock", "clock"))
def a27(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    return A.last_bar_age(bars, Z.bounds(bars)[2] + F.expr("interval 1234 seconds")).select(*rr("age_minutes"))


@query("a28_latest_timestamp", with_ctes("SELECT exchange, symbol, max(t) AS latest FROM labelled, clock WHERE t < now - 86400 GROUP BY 1, 2", "clock"))
def a28(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    return A.latest_timestamp(bars, Z.bounds(bars)[2] - F.expr("interval 86400 seconds")).select(*KEY, t("latest", "latest"))


#: Connection events from the events table: a view is a disconnect, a click a reconnect.
_CONN = {"conn": "SELECT ['alpha','beta','gamma'][user_id % 3 + 1] AS exchange, CASE WHEN event_id % 7 = 0 THEN 'disconnect' ELSE 'reconnect' END AS event, ts FROM events WHERE event_id % 7 < 2"}


def _connections(spark: SparkSession, sf: str) -> DataFrame:
    e = Z.table(spark, sf, "events").where("event_id % 7 < 2")
    exchange = F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(exchange.alias("exchange"), F.when(F.col("event_id") % 7 == 0, "disconnect").otherwise("reconnect").alias("event"), F.col("ts").cast("timestamp").alias("ts"))


@query("a29_collector_counters", with_ctes("SELECT (SELECT count(*) FROM trades) AS messages, (SELECT count(price) FROM trades) AS trades, (SELECT count(*) FROM bars) AS bars, count_if(event = 'disconnect') AS disconnects, count_if(event = 'reconnect') AS reconnects FROM conn", "bars", _CONN))
def a29(spark: SparkSession, sf: str) -> DataFrame:
    return A.collector_counters(Z.trades(spark, sf), Z.bars(spark, sf), _connections(spark, sf))


@query("r9_disconnect_gaps", with_ctes(
    f"SELECT exchange, epoch_us(ts) AS gap_start, {r('(epoch_us(u) - epoch_us(ts)) / 1e6', 3)} AS gap_seconds FROM (SELECT *, min(CASE WHEN event = 'reconnect' THEN ts END) OVER (PARTITION BY exchange ORDER BY ts, event ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM conn) WHERE event = 'disconnect' AND u IS NOT NULL AND epoch_us(u) - epoch_us(ts) >= 60000000", "trades", _CONN))
def r9(spark: SparkSession, sf: str) -> DataFrame:
    return G.disconnect_gaps(_connections(spark, sf), 60.0).select("exchange", F.unix_micros("gap_start").alias("gap_start"), *rr("gap_seconds", digits=3))


@query("r9_debounced_requests", with_ctes(
    """SELECT epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) AS to_us, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges, count(*) AS n_events FROM
      (SELECT *, sum(new) OVER (ORDER BY ts, exchange ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT exchange, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, exchange) <= 60000000 THEN 0 ELSE 1 END AS new FROM conn WHERE event = 'reconnect')) GROUP BY k""", "trades", _CONN))  # fmt: skip
def r9_debounced(spark: SparkSession, sf: str) -> DataFrame:
    d = G.debounced(_connections(spark, sf).where("event = 'reconnect'"), 60)
    return d.select(F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"), F.concat_ws(",", "exchanges").alias("exchanges"), "n_events")


@query("c17_freshness", with_ctes("SELECT CASE WHEN max(now) + 400 - max(t) > 300 THEN 'stale' ELSE 'ok' END AS status, round(CAST(max(now) + 400 - max(t) AS DOUBLE), 1) AS age_sec FROM labelled, clock", "clock"))
def c17(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    return A.freshness(bars, Z.bounds(bars)[2] + F.expr("interval 400 seconds"))


@query("c17_freshness_by_health", with_ctes("SELECT CASE WHEN max(now) + 200 - max(first_day) * 86400 > 600 THEN 'stale' ELSE 'ok' END AS status, 200.0::DOUBLE AS age_sec FROM clock", "clock"))
def c17_health(spark: SparkSession, sf: str) -> DataFrame:
    """A fresh lake counts as stale if the health record is old: here from the first day."""
    bars = Z.labelled(spark, sf)
    first, _, now = Z.bounds(bars)
    return A.freshness(bars, now + F.expr("interval 200 seconds"), health_ts=first.cast("timestamp"))


@query("c18_alerts", with_ctes(
    """SELECT 'LOW LIVE DATA' AS kind, exchange || '/' || symbol AS subject, CAST(l AS DOUBLE) AS value FROM (SELECT exchange, symbol, count(*) AS n, count_if(source = 'live' AND exchange <> 'beta') AS l FROM labelled, clock WHERE t >= now - 172800 GROUP BY 1, 2) WHERE l < n * 0.1 / 100
      UNION ALL SELECT 'GAP', exchange || '/' || symbol, CAST(m AS DOUBLE) FROM (SELECT exchange, symbol, max(d) AS m FROM (SELECT exchange, symbol, t - lag(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS d FROM labelled, clock WHERE t >= now - 864000) WHERE d > 3600 GROUP BY 1, 2) WHERE m >= 7200
      UNION ALL SELECT 'STALE HEALTH', 'lake', 7.5 UNION ALL SELECT 'NO RAW', 'lake', NULL""", "clock"))  # fmt: skip
def c18(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    now = Z.bounds(bars)[2]
    odd = bars.withColumn("source", F.when((F.col("source") == "live") & (F.col("exchange") == "beta"), "backfill_1s").otherwise(F.col("source")))
    quality = A.recent_quality(odd, Z.dim(spark, sf).where("symbol <> 'ABSENT'"), now)
    ages = bars.limit(1).select(F.explode(F.array(F.struct(F.lit("health").alias("kind"), F.lit(7.5).alias("minutes")), F.struct(F.lit("raw").alias("kind"), F.lit(None).cast("double").alias("minutes")))).alias("a")).select("a.*")
    return A.alerts(quality, G.recent_gaps(bars, now, 240, 3600, 7200), ages)


# --- gaps


@query("w1_bar_diffs", with_ctes("SELECT exchange, symbol, t, diff FROM diffs", "diffs"))
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return G.bar_diffs(Z.labelled(spark, sf)).select(*KEY, t(), "diff")


_HUMAN = "CASE WHEN d < 60 THEN d || 's' WHEN d < 3600 THEN d // 60 || 'm ' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') || 's' WHEN d < 86400 THEN d // 3600 || 'h ' || lpad(CAST(d % 3600 // 60 AS VARCHAR), 2, '0') || 'm' ELSE d // 86400 || 'd ' || lpad(CAST(d % 86400 // 3600 AS VARCHAR), 2, '0') || 'h' END"


@query("w2_find_gaps", with_ctes(f"SELECT exchange, symbol, prev AS gap_start, t AS gap_end, d AS duration_sec, {_HUMAN} AS duration_human FROM (SELECT exchange, symbol, prev, t, t - prev AS d FROM (SELECT exchange, symbol, t, lag(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS prev FROM bars) JOIN intervals USING (exchange) WHERE t - prev > 2 * interval_sec)", "intervals"))
def w2(spark: SparkSession, sf: str) -> DataFrame:
    dim = Z.dim(spark, sf).select("exchange", "interval_sec").distinct()
    g = G.with_human_duration(G.find_gaps(Z.bars(spark, sf), 2, dim=dim))
    return g.select(*KEY, t("gap_start", "gap_start"), t("gap_end", "gap_end"), "duration_sec", "duration_human")


@query("w3_day_gaps", with_ctes("SELECT * FROM daygaps", "daygaps"))
def w3(spark: SparkSession, sf: str) -> DataFrame:
    dim = Z.dim(spark, sf).select("exchange", "interval_sec").distinct()
    return G.find_gaps(Z.labelled(spark, sf), 2, within_day=True, dim=dim).select(*KEY, t("gap_start", "gap_start"), t("gap_end", "gap_end"), "duration_sec")


@query("w4_recent_gaps", with_ctes(
    "SELECT exchange, symbol, count(*) AS n_gaps, count_if(d >= 10800) AS significant, count_if(d < 10800) AS minor, max(d) AS longest_sec, max(prev) FILTER (d = m) AS longest_start FROM (SELECT *, max(d) OVER (PARTITION BY exchange, symbol) AS m FROM (SELECT exchange, symbol, lag(t) OVER w AS prev, t - lag(t) OVER w AS d FROM bars, (SELECT max(t) AS now FROM bars) WHERE t >= now - 432000 WINDOW w AS (PARTITION BY exchange, symbol ORDER BY t)) WHERE d > 3600) GROUP BY 1, 2", "bars"))
def w4(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.bars(spark, sf)
    g = G.recent_gaps(bars, Z.bounds(bars)[2], 120, 3600, 10800)
    return g.select(*KEY, "n_gaps", "significant", "minor", "longest_sec", t("longest_start", "longest_start"))


@query("w5_trade_gaps", with_ctes(f"SELECT exchange, symbol, gap_start, duration_sec, {_CAUSE} AS cause FROM tg", "trades", _TRADE_GAPS))
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return G.with_cause(_trade_gaps(spark, sf)).select(*KEY, t("gap_start", "gap_start"), "duration_sec", "cause")


@query("w7_correlated_outages", with_ctes(
    """SELECT start, "end", n_gaps, num_affected, exchanges, avg_duration, CASE WHEN a > 3600 THEN 'Computer shutdown/restart' WHEN a > 300 THEN 'App restart' WHEN ne > 1 THEN 'Network switch' ELSE 'Exchange-specific outage' END AS likely_cause FROM
      (SELECT min(s) AS start, max(e) AS "end", count(*) AS n_gaps, count(DISTINCT k) AS num_affected, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges, count(DISTINCT exchange) AS ne, avg(e - s) AS a, """ + r("avg(e - s)", 3) + """ AS avg_duration FROM
        (SELECT *, sum(new) OVER (ORDER BY s, e, exchange, symbol ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, exchange || '/' || symbol AS k, CASE WHEN s <= max(e) OVER (ORDER BY s, e, exchange, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 0 ELSE 1 END AS new FROM
          (SELECT exchange, symbol, gap_start AS s, gap_end AS e FROM gp))) GROUP BY c) WHERE n_gaps > 1""", "bars", {"gp": "SELECT exchange, symbol, lag(t) OVER w AS gap_start, t AS gap_end FROM bars WHERE exchange <> 'none' WINDOW w AS (PARTITION BY exchange, symbol ORDER BY t) QUALIFY t - lag(t) OVER w > 14400"}))  # fmt: skip
def w7(spark: SparkSession, sf: str) -> DataFrame:
    o = G.correlated_outages(G.find_gaps(Z.bars(spark, sf), 14400))
    return o.select("start", "end", "n_gaps", "num_affected", F.concat_ws(",", "exchanges").alias("exchanges"), *rr("avg_duration", digits=3), "likely_cause")


@query("w8_chart_markers", with_ctes("SELECT exchange, symbol, prev AS at, CASE WHEN m >= 60 THEN 'GAP ' || CAST(floor(m / 60.0 + 0.5) AS BIGINT) || 'h' ELSE 'GAP ' || m || 'm' END AS label FROM (SELECT *, CAST(floor(diff / 60.0 + 0.5) AS BIGINT) AS m FROM diffs WHERE diff > 5400)", "diffs"))
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return G.chart_markers(Z.labelled(spark, sf), Z.HOUR).select(*KEY, t("at", "at"), "label")


@query("w9_price_change", with_ctes(f"SELECT exchange, symbol, {r('c')} AS close, {r('coalesce(p, o)')} AS base, {r('CASE WHEN coalesce(p, o) <> 0 THEN (c - coalesce(p, o)) / coalesce(p, o) * 100 ELSE 0.0 END')} AS change_pct FROM (SELECT exchange, symbol, close AS c, open AS o, lag(close) OVER (PARTITION BY exchange, symbol ORDER BY t) AS p, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM q4) WHERE k = 1", "q4"))
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return G.price_change(B.resample_bars(Z.labelled(spark, sf), 14400)).select(*KEY, *rr("close", "base", "change_pct"))


#: Files of a lake: runs of bars by a rule on the time.
_FILES = {"files": "SELECT exchange, symbol, t // 100000 AS f, min(t) AS min_t, max(t) + (t // 100000 % 5) * 40000 AS max_t FROM bars GROUP BY exchange, symbol, t // 100000"}


def _files(spark: SparkSession, sf: str) -> DataFrame:
    f = F.floor(F.unix_seconds("window_start") / 100000)
    rows = Z.bars(spark, sf).groupBy(*KEY, f.alias("f")).agg(F.min("window_start").alias("min_ts"), F.unix_seconds(F.max("window_start")).alias("m"))
    return rows.select(*KEY, "min_ts", F.timestamp_seconds(F.col("m") + F.pmod("f", F.lit(5)) * 40000).alias("max_ts"))


def _w6_sql(prev: str) -> str:
    return with_ctes(f"SELECT exchange, symbol, p AS gap_start, min_t AS gap_end, min_t - p AS duration_sec FROM (SELECT *, {prev} AS p FROM files WINDOW w AS (PARTITION BY exchange, symbol ORDER BY min_t, max_t)) WHERE min_t - p > 7200", "bars", _FILES)


@query("w6_file_gaps", _w6_sql("lag(max_t) OVER w"))
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return G.internal_file_gaps(_files(spark, sf), 7200).select(*KEY, t("gap_start", "gap_start"), t("gap_end", "gap_end"), "duration_sec")


@query("w6_file_gaps_running", _w6_sql("max(max_t) OVER (PARTITION BY exchange, symbol ORDER BY min_t, max_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").replace(" WINDOW w AS (PARTITION BY exchange, symbol ORDER BY min_t, max_t)", ""))
def w6_running(spark: SparkSession, sf: str) -> DataFrame:
    return G.internal_file_gaps(_files(spark, sf), 7200, running=True).select(*KEY, t("gap_start", "gap_start"), t("gap_end", "gap_end"), "duration_sec")


@query("f8_horizon", with_ctes("SELECT exchange, symbol, p AS gap_start, min_t AS gap_end, min_t - p AS duration_sec FROM (SELECT *, lag(max_t) OVER (PARTITION BY exchange, symbol ORDER BY min_t, max_t) AS p FROM files, (SELECT max(t) AS now FROM bars) WHERE max_t >= now - 1000000) WHERE min_t - p > 7200", "bars", _FILES))
def f8(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between files that end within the horizon."""
    gaps = G.internal_file_gaps(_files(spark, sf), 7200, Z.bounds(Z.bars(spark, sf))[2], 1_000_000)
    return gaps.select(*KEY, t("gap_start", "gap_start"), t("gap_end", "gap_end"), "duration_sec")


@query("w10_carry_forward", with_ctes(f"SELECT exchange, symbol, t, {r('c')} AS close FROM (SELECT exchange, symbol, t, last_value(c IGNORE NULLS) OVER (PARTITION BY exchange, symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT exchange, symbol, t, CASE WHEN t // 3600 % 5 = 0 OR t // 86400 % 4 = 1 THEN NULL ELSE close END AS c FROM labelled))", "labelled"))
def w10(spark: SparkSession, sf: str) -> DataFrame:
    """The last close before each bar without one: within a day, and over days that have none."""
    sec = F.unix_seconds("window_start")
    holes = Z.labelled(spark, sf).withColumn("close", F.when(~((F.floor(sec / 3600) % 5 == 0) | (F.floor(sec / 86400) % 4 == 1)), F.col("close")))
    return B.carry_forward(holes, "close").select(*KEY, t(), *rr("close"))


@query("x15_up_down", with_ctes(
    "SELECT exchange, symbol, t, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction, CASE WHEN close > 100 THEN printf('%.2f', close) WHEN close > 1 THEN printf('%.4f', close) ELSE printf('%.6f', close) END AS price, CASE WHEN u // 3600 > 24 THEN (u // 86400) || 'd ' || (u // 3600 % 24) || 'h' WHEN u >= 3600 THEN (u // 3600) || 'h ' || (u % 3600 // 60) || 'm' ELSE (u // 60) || 'm' END AS uptime FROM (SELECT exchange, symbol, t, floor(open * 4 + 0.5) / 4 AS open, floor(close * 4 + 0.5) / 4 AS close, t % 200000 AS u FROM labelled)", "labelled"))
def x15(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of a candle, its price as text, and a time as an uptime; prices in quarters, which no rounding of text can split."""
    b = Z.labelled(spark, sf)
    b = b.select(*KEY, "window_start", *[(F.floor(F.col(c) * 4 + 0.5) / 4).alias(c) for c in ("open", "close")])
    return b.select(*KEY, t(), X.up_down("close", "open").alias("direction"), X.fmt_price("close").alias("price"), X.fmt_uptime(F.unix_seconds("window_start") % 200000).alias("uptime"))


@query("s11_file_ts_ranges", with_ctes("SELECT exchange, symbol, min_t, max_t FROM files", "bars", _FILES))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).select(*KEY, t("min_ts", "min_t"), t("max_ts", "max_t"))


# --- back-fill plans and joins

_PLAN = """SELECT exchange, symbol, 'internal' AS kind, p + 1 AS start_s, min_t - 1 AS end_s FROM (SELECT *, lag(max_t) OVER (PARTITION BY exchange, symbol ORDER BY min_t, max_t) AS p FROM files) WHERE min_t - p > 7200 AND min_t - p - 2 <= 40000
      UNION ALL SELECT exchange, symbol, 'trailing', max(t), least(max(n.now), max(t) + 40000) FROM bars, (SELECT max(t) + 5000 AS now FROM bars) n WHERE t < n.now GROUP BY 1, 2 HAVING max(n.now) - max(t) >= 7200"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.bars(spark, sf)
    now = Z.bounds(bars)[2] + F.expr("interval 5000 seconds")
    return P.plan_backfill(bars, _files(spark, sf), Z.dim(spark, sf), now, 7200, 40000)


@query("w11_plan_backfill", with_ctes(_PLAN, "bars", _FILES))
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


@query("w12_plan_pages", with_ctes("SELECT exchange, symbol, kind, k AS page, start_s + k * 18000 AS from_s, least(start_s + (k + 1) * 18000, end_s) AS to_s FROM (SELECT *, unnest(range(0, CAST(ceil((end_s - start_s) / 18000.0) AS BIGINT))) AS k FROM plan WHERE end_s > start_s)", "bars", _FILES | {"plan": _PLAN}))
def w12(spark: SparkSession, sf: str) -> DataFrame:
    return P.plan_pages(_plan(spark, sf), 60, 300).select(*KEY, "kind", "page", "from_s", "to_s")


@query("w13_deep_backfill", with_ctes("SELECT exchange, symbol, day * 86400 AS start_s, day * 86400 + 86400 AS end_s FROM (SELECT exchange, symbol, unnest(range(first_day - 5, today)) AS day FROM (SELECT DISTINCT exchange, symbol FROM trades), clock) s WHERE NOT EXISTS (FROM labelled l WHERE l.exchange = s.exchange AND l.symbol = s.symbol AND l.t // 86400 = s.day)", "clock"))
def w13(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    first, _, now = Z.bounds(bars)
    return P.plan_deep_backfill(bars, Z.trades(spark, sf), F.date_sub(first, 5), now).select(*KEY, "start_s", "end_s")


@query("j4_asof_join", with_ctes(
    f"SELECT b.exchange, b.symbol, b.t, {r('d.rate', 6)} AS rate FROM q4 b ASOF LEFT JOIN (SELECT exchange, symbol, {epoch('ts')} AS s, first(price ORDER BY trade_id DESC) AS rate FROM trades WHERE trade_id % 10 = 0 GROUP BY 1, 2, 3) d ON b.exchange = d.exchange AND b.symbol = d.symbol AND b.t >= d.s", "q4"))
def j4(spark: SparkSession, sf: str) -> DataFrame:
    """The newest derivative record (every tenth trade stands for one) at or before each bar."""
    sec = F.timestamp_seconds(F.unix_seconds("ts"))
    d = Z.trades(spark, sf).where("trade_id % 10 = 0").groupBy(*KEY, sec.alias("window_start")).agg(F.max_by("price", "trade_id").alias("rate"))
    return P.asof_join(B.resample_bars(Z.labelled(spark, sf), 14400), d, list(KEY), "window_start", ["rate"]).select(*KEY, t(), *rr("rate"))


@query("j5_staging_audit", with_ctes(
    """SELECT exchange, symbol, day, CASE WHEN day = today THEN 'TODAY' WHEN bars % 10 = 0 THEN 'NO_FILES' WHEN live = 0 THEN 'ALL_CORRUPT' ELSE 'HAS_VALID' END AS reason FROM daystats, clock WHERE day % 3 <> 0""", "daystats"))  # fmt: skip
def j5(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    days = A.day_stats(bars)
    source = days.select(*KEY, "day", F.pmod("bars", F.lit(10)).alias("n_files"), F.col("live").alias("n_valid"))
    staged = days.where(F.unix_date("day") % 3 == 0)
    return P.staging_audit(source, staged, Z.bounds(bars)[1]).select(*KEY, F.unix_date("day").cast("long").alias("day"), "reason")


@query("j6_skip_existing", with_ctes("SELECT exchange, symbol, day FROM spine WHERE NOT EXISTS (FROM daystats d WHERE d.exchange = spine.exchange AND d.symbol = spine.symbol AND d.day = spine.day AND d.live > 10)", "daystats"))
def j6(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    first, today, _ = Z.bounds(bars)
    wanted = A.calendar(Z.dim(spark, sf), first, today)
    return P.skip_existing(wanted, A.day_stats(bars).where("live > 10")).select(*KEY, F.unix_date("day").cast("long").alias("day"))


@query("j7_present_series", with_ctes("SELECT exchange, symbol, interval_sec FROM dim WHERE (exchange, symbol) IN (SELECT (exchange, symbol) FROM labelled)", "labelled", {"dim": Z.CTES["dim"]}))
def j7(spark: SparkSession, sf: str) -> DataFrame:
    return P.present(Z.dim(spark, sf), Z.labelled(spark, sf))


# --- indicators and composite queries

_RN = "SELECT exchange, symbol, t, close, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t) AS rn FROM labelled"


def _frame(n: int) -> str:
    return f"OVER (PARTITION BY exchange, symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _smooth(name: str, src: str, x: str, n: int, b: float, start: int) -> str:
    """A recursive expression: name(exchange, symbol, rn, y)."""
    seed = start + n - 1
    return f"""SELECT exchange, symbol, {seed}::BIGINT AS rn, avg({x}) AS y FROM {src} WHERE rn BETWEEN {start} AND {seed} GROUP BY 1, 2 HAVING count(*) = {n}
      UNION ALL SELECT s.exchange, s.symbol, s.rn, {1 - b!r} * p.y + {b!r} * s.{x} FROM {name} p JOIN {src} s ON s.exchange = p.exchange AND s.symbol = p.symbol AND s.rn = p.rn + 1"""


_IND = {
    "rn": _RN,
    "e12": _smooth("e12", "rn", "close", 12, 2.0 / 13, 1),
    "e26": _smooth("e26", "rn", "close", 26, 2.0 / 27, 1),
    "mline": "SELECT exchange, symbol, rn, e12.y AS f, e26.y AS s, e12.y - e26.y AS m FROM e12 JOIN e26 USING (exchange, symbol, rn)",
    "e9": _smooth("e9", "mline", "m", 9, 2.0 / 10, 26),
    "d": "SELECT *, greatest(x, 0) AS up, greatest(-x, 0) AS down FROM (SELECT exchange, symbol, rn, close - lag(close) OVER (PARTITION BY exchange, symbol ORDER BY rn) AS x FROM rn)",
    "gu": _smooth("gu", "d", "up", 14, 1.0 / 14, 2),
    "gd": _smooth("gd", "d", "down", 14, 1.0 / 14, 2),
}


@query("i1_sma", with_ctes("SELECT exchange, symbol, t, " + ", ".join(f"CASE WHEN rn >= {n} THEN {r(f'avg(close) {_frame(n)}', 5)} END AS sma{n}" for n in (20, 50, 200)) + " FROM rn", "labelled", {"rn": _RN}))
def i1(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.with_row_number(Z.labelled(spark, sf))
    return I.own_rows(I.over_blocks(rows, 199).withColumns({f"sma{n}": I.sma("close", n) for n in (20, 50, 200)})).select(*KEY, t(), *rr("sma20", "sma50", "sma200", digits=5))


@query("i4_bollinger", with_ctes(f"SELECT exchange, symbol, t, CASE WHEN rn >= 20 THEN {r('m + 2 * s', 5)} END AS bb_upper, CASE WHEN rn >= 20 THEN {r('m', 5)} END AS bb_middle, CASE WHEN rn >= 20 THEN {r('m - 2 * s', 5)} END AS bb_lower FROM (SELECT *, avg(close) {_frame(20)} AS m, stddev_pop(close) {_frame(20)} AS s FROM rn)", "labelled", {"rn": _RN}))
def i4(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.with_row_number(Z.labelled(spark, sf))
    return I.own_rows(I.over_blocks(rows, 19).withColumns(I.bollinger("close"))).select(*KEY, t(), *rr("bb_upper", "bb_middle", "bb_lower", digits=5))


@query("i2_ema", with_ctes(f"SELECT exchange, symbol, t, {r('e12.y', 5)} AS ema12, {r('e26.y', 5)} AS ema26 FROM rn LEFT JOIN e12 USING (exchange, symbol, rn) LEFT JOIN e26 USING (exchange, symbol, rn)", "labelled", {k: _IND[k] for k in ("rn", "e12", "e26")}, True))
def i2(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.with_row_number(Z.labelled(spark, sf))
    return I.ema(rows, "close", {"ema12": 12, "ema26": 26}).select(*KEY, t(), *rr("ema12", "ema26", digits=5))


@query("i3_rsi", with_ctes(f"SELECT exchange, symbol, t, {r('CASE WHEN gd.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + gu.y / gd.y) END', 5)} AS rsi FROM rn LEFT JOIN gu USING (exchange, symbol, rn) LEFT JOIN gd USING (exchange, symbol, rn)", "labelled", {k: _IND[k] for k in ("rn", "d", "gu", "gd")}, True))
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return I.rsi(I.with_row_number(Z.labelled(spark, sf))).select(*KEY, t(), *rr("rsi", digits=5))


@query("i5_macd", with_ctes(f"SELECT exchange, symbol, t, {r('m', 5)} AS macd, {r('e9.y', 5)} AS macd_signal, {r('m - e9.y', 5)} AS macd_hist FROM rn LEFT JOIN mline USING (exchange, symbol, rn) LEFT JOIN e9 USING (exchange, symbol, rn)", "labelled", {k: _IND[k] for k in ("rn", "e12", "e26", "mline", "e9")}, True))
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return I.macd(I.with_row_number(Z.labelled(spark, sf))).select(*KEY, t(), *rr("macd", "macd_signal", "macd_hist", digits=5))


@query("i7_volume_ratio", with_ctes(
    f"""SELECT exchange, symbol, {r('v')} AS current_volume, {r('a')} AS avg_volume, {r('CASE WHEN a > 0 THEN v / a ELSE 1.0 END')} AS volume_ratio FROM (SELECT b.exchange, b.symbol, last(volume_base ORDER BY t) AS v, coalesce(max(m), 1.0) AS a FROM lab1 b LEFT JOIN
      (SELECT exchange, symbol, avg(volume_base) AS m FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM lab1 WHERE is_live) WHERE k <= 20 GROUP BY 1, 2) l USING (exchange, symbol) GROUP BY 1, 2)""", "lab1"))  # fmt: skip
def i7(spark: SparkSession, sf: str) -> DataFrame:
    return I.volume_ratio(Z.labelled(spark, sf).withColumn("is_live", F.col("source") == "live")).select(*KEY, *rr("current_volume", "avg_volume", "volume_ratio"))


_DIRECTION = "CASE WHEN h > 0 AND h >= p THEN 'bullish_accelerating' WHEN h > 0 THEN 'bullish_weakening' WHEN h < 0 AND abs(h) <= abs(p) THEN 'bearish_weakening' WHEN h < 0 THEN 'bearish_accelerating' ELSE 'neutral' END"
_REGIME = "CASE WHEN bullish >= total - 1 THEN 'bullish_momentum' WHEN bullish > total - bullish + 1 THEN 'bullish_bias' WHEN total - bullish > bullish + 1 THEN 'bearish_bias' ELSE 'neutral_ranging' END"
_ALL = _IND | {
    "w": f"SELECT exchange, symbol, rn, avg(close) {_frame(20)} AS s20, avg(close) {_frame(50)} AS s50, avg(close) {_frame(200)} AS s200, stddev_pop(close) {_frame(20)} AS sd FROM rn",
    "vr": "SELECT b.exchange, b.symbol, last(volume_base ORDER BY t) AS v, coalesce(max(m), 1.0) AS a FROM lab1 b LEFT JOIN (SELECT exchange, symbol, avg(volume_base) AS m FROM (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM lab1 WHERE is_live) WHERE k <= 20 GROUP BY 1, 2) l USING (exchange, symbol) GROUP BY 1, 2",
    "now": """SELECT rn.exchange, rn.symbol, rn.rn, rn.t, rn.close AS price, lb.vwap, CASE WHEN gd.y = 0 THEN 100.0 ELSE 100 - 100 / (1 + gu.y / gd.y) END AS rsi, m, e9.y AS sig, m - e9.y AS h, f, s, s20, s50, s200, s20 + 2 * sd AS bu, s20 - 2 * sd AS bl,
      lag(m - e9.y) OVER z AS p, lag(f) OVER z AS pf, lag(s) OVER z AS ps, row_number() OVER (PARTITION BY rn.exchange, rn.symbol ORDER BY rn.rn DESC) AS k FROM rn JOIN lab1 lb USING (exchange, symbol, t) JOIN w USING (exchange, symbol, rn) LEFT JOIN gu USING (exchange, symbol, rn) LEFT JOIN gd USING (exchange, symbol, rn)
      LEFT JOIN mline USING (exchange, symbol, rn) LEFT JOIN e9 USING (exchange, symbol, rn) WINDOW z AS (PARTITION BY rn.exchange, rn.symbol ORDER BY rn.rn)""",
    "doc": f"""SELECT *, (rsi > 50)::INT + (h > 0)::INT + (pos > 0.5)::INT + (f > s)::INT + (price > vwap)::INT + (trend = 'bullish_aligned')::INT AS bullish, 5 + (trend <> 'mixed')::INT AS total FROM
      (SELECT now.*, v, a, CASE WHEN bu > bl THEN (price - bl) / (bu - bl) ELSE 0.5 END AS pos, CASE WHEN price > s20 AND s20 > s50 AND s50 > s200 THEN 'bullish_aligned' WHEN price < s20 AND s20 < s50 AND s50 < s200 THEN 'bearish_aligned' ELSE 'mixed' END AS trend, {_DIRECTION} AS macd_direction FROM now JOIN vr USING (exchange, symbol) WHERE k = 1)""",
}
_DOC_SQL = f"""SELECT exchange, symbol, rn AS n_bars, {iso('t')} AS ts, {r('price')} AS price, {r('rsi', 2)} AS rsi, CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END AS rsi_signal,
      CASE WHEN rsi < 30 THEN 'approaching support' WHEN rsi > 70 THEN 'approaching resistance' WHEN rsi > 60 THEN 'approaching overbought' WHEN rsi < 40 THEN 'approaching oversold' ELSE 'mid-range' END AS rsi_note,
      {r('m', 4)} AS macd, {r('sig', 4)} AS macd_signal, {r('h', 4)} AS macd_hist, macd_direction, CASE WHEN m > sig AND m - sig < abs(m) * 0.01 + 0.001 THEN 'bullish_crossover' WHEN m < sig AND sig - m < abs(sig) * 0.01 + 0.001 THEN 'bearish_crossover' ELSE 'none' END AS macd_crossover,
      {r('bu', 2)} AS bb_upper, {r('s20', 2)} AS bb_middle, {r('bl', 2)} AS bb_lower, {r('pos', 3)} AS bb_position, CASE WHEN pos > 0.8 THEN 'near_upper' WHEN pos < 0.2 THEN 'near_lower' WHEN pos >= 0.5 THEN 'upper_half' ELSE 'lower_half' END AS bb_signal,
      {r('s20', 2)} AS sma20, {r('s50', 2)} AS sma50, {r('s200', 2)} AS sma200, trend AS sma_trend, {r('f', 2)} AS ema12, {r('s', 2)} AS ema26, CASE WHEN f > s THEN CASE WHEN pf IS NULL OR ps IS NULL OR pf <= ps THEN 'bullish_crossover' ELSE 'bullish' END WHEN pf IS NULL OR pf >= coalesce(ps, 0) THEN 'bearish_crossover' ELSE 'bearish' END AS ema_signal,
      {r('vwap', 2)} AS vwap, CASE WHEN price > vwap THEN 'above' ELSE 'below' END AS price_vs_vwap, CASE WHEN price > vwap THEN 'bullish' ELSE 'bearish' END AS vwap_signal, {r('v', 4)} AS current_volume, {r('a', 4)} AS avg_volume, {r('CASE WHEN a > 0 THEN v / a ELSE 1.0 END', 2)} AS volume_ratio,
      CASE WHEN (CASE WHEN a > 0 THEN v / a ELSE 1.0 END) > 1.5 THEN 'elevated' WHEN (CASE WHEN a > 0 THEN v / a ELSE 1.0 END) < 0.5 THEN 'low' ELSE 'normal' END AS volume_signal, bullish, total, {_REGIME} AS regime, CASE WHEN greatest(bullish, total - bullish) >= total - 1 THEN 'high' WHEN greatest(bullish, total - bullish) >= floor(total * 0.6) THEN 'medium' ELSE 'low' END AS confidence FROM doc"""


#: The newest 500 bars of each series, which is what indicators are asked for by default.
_NEWEST = {"labelled": f"SELECT * FROM ({Z.CTES['labelled']}) QUALIFY row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) <= 500"}
_ALL_NEWEST = _NEWEST | _ALL


@query("c11_indicators", with_ctes(_DOC_SQL, "lab1", _ALL, True))
def c11(spark: SparkSession, sf: str) -> DataFrame:
    """The last row of all indicators, signals and the regime, of all series at once, over all their bars."""
    return M.indicators(Z.labelled(spark, sf), Z.HOUR, None, complete=False).withColumn("price", X.round_half_away("price", 6))


@query("c13_funding_vote", with_ctes(
    f"""SELECT exchange, symbol, bullish, total, basis, {_REGIME} AS regime FROM (SELECT exchange, symbol, bullish + (rate > 0)::INT AS bullish, total + CASE WHEN rate > 0 THEN 1 ELSE 2 END AS total, CASE WHEN rate > 0 THEN 'positive_funding' ELSE 'negative_funding' END AS basis FROM (SELECT *, m AS rate FROM doc))""", "lab1", _ALL_NEWEST, True))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    """The funding vote, with the MACD line in the place of a rate."""
    d = M.indicators(Z.labelled(spark, sf), Z.HOUR, complete=False)
    b, n, basis = S.funding_vote(F.col("bullish"), F.col("total"), "macd")
    return d.select(*KEY, b.alias("bullish"), n.alias("total"), basis.alias("basis")).withColumn("regime", S.regime_label(F.col("bullish"), F.col("total")))


def _scan_sql(score: str) -> str:
    return with_ctes(f"SELECT symbol, {r('score', 4)} AS score, rsi, volume_ratio, bb_position, regime, row_number() OVER (ORDER BY {r('score', 4)} DESC, symbol) AS rank FROM (SELECT *, {score} AS score FROM flat WHERE exchange = 'beta' AND n_bars >= 14) ORDER BY rank LIMIT 3", "lab1", _ALL_NEWEST | {"flat": _DOC_SQL}, True)


def _scan(sort: str) -> Query:
    return lambda spark, sf: M.scan(_with_open_bar(Z.labelled(spark, sf)), "beta", sort, 3, Z.HOUR, 500).select("symbol", "score", "rsi", "volume_ratio", "bb_position", "regime", F.col("rank").cast("long").alias("rank"))


def _with_open_bar(bars: DataFrame) -> DataFrame:
    """bars and, after the last of each series, one more bar like it, which counts as incomplete."""
    cols = bars.columns
    last = bars.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in cols if c not in KEY]), "window_start").alias("x")).select(*KEY, "x.*")
    return bars.unionByName(last.withColumn("window_start", F.timestamp_seconds(F.unix_seconds("window_start") + Z.HOUR)).select(*cols))


for _sort, _score in {
    "momentum": "((rsi - 50) / 50 + CASE WHEN macd_hist > 0 THEN 1.0 ELSE -1.0 END + CASE WHEN price > sma20 THEN 1.0 ELSE -1.0 END) / 3",
    "volume": "volume_ratio",
    "volatility": "CASE WHEN bb_middle > 0 THEN (bb_upper - bb_lower) / bb_middle ELSE 0 END",
    "rsi_extreme": "abs(rsi - 50) / 50",
}.items():
    query(f"c15_scan_{_sort}", _scan_sql(_score))(_scan(_sort))


_STATS = f"""SELECT exchange, symbol, price, open_24h, h AS high_24h, l AS low_24h, v AS volume_24h, CASE WHEN v > 0 THEN vv / v ELSE price END AS vwap_24h, CASE WHEN open_24h > 0 THEN (price - open_24h) * 100.0 / open_24h ELSE 0.0 END AS change_24h_pct FROM
      (SELECT exchange, symbol, last(close ORDER BY t) AS price, first(open ORDER BY t) AS open_24h, max(high) AS h, min(low) AS l, sum(CASE WHEN is_live THEN volume_base ELSE 0 END) AS v, sum(CASE WHEN is_live THEN volume_base * vwap ELSE 0 END) AS vv FROM
        (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) AS k FROM lab1) WHERE k <= 24 GROUP BY 1, 2)"""
_STATS_COLS = ("price", "open_24h", "high_24h", "low_24h", "volume_24h", "vwap_24h", "change_24h_pct")
#: A funding rate for each symbol, from its largest price and number of trades; of one sign or the other.
_RATES = "SELECT symbol, (max(price) * 2 - count(*) % 200) / 1000000 AS rate, max(price) AS mark FROM trades GROUP BY 1"


def _snapshot_sql(rate: str, more: str, extra: dict[str, str]) -> str:
    basis = "concat_ws(',', 'price_' || price_vs_vwap || '_vwap', CASE WHEN rate > 0 THEN 'positive_funding' WHEN rate <= 0 THEN 'negative_funding' END)"
    return with_ctes(
        f"""SELECT exchange, symbol, {rs(*_STATS_COLS)}, rsi, macd_direction, {_REGIME} AS regime, CASE WHEN greatest(bullish, total - bullish) >= total - 1 THEN 'high' WHEN greatest(bullish, total - bullish) >= floor(total * 0.6) THEN 'medium' ELSE 'low' END AS confidence, {basis} AS basis, 5 AS n_sample{more}
      FROM (SELECT s.*, d.rsi, d.macd_direction, d.price_vs_vwap, rate, mark, d.bullish + CASE WHEN rate > 0 THEN 1 ELSE 0 END AS bullish, d.total + CASE WHEN rate IS NULL THEN 0 WHEN rate > 0 THEN 1 ELSE 2 END AS total FROM stats s JOIN docs d USING (exchange, symbol) LEFT JOIN ({rate}) f USING (exchange, symbol))""",
        "lab1", _ALL_NEWEST | {"docs": _DOC_SQL, "stats": _STATS} | extra, True)


def _snapshot(s: DataFrame, *more: Column) -> DataFrame:
    return s.select(*KEY, *rr(*_STATS_COLS), "rsi", "macd_direction", "regime", "confidence", F.concat_ws(",", "basis").alias("basis"), F.size("bars_sample").alias("n_sample"), *more)


@query("c14_snapshot", _snapshot_sql("SELECT '' AS exchange, '' AS symbol, NULL::DOUBLE AS rate, NULL::DOUBLE AS mark", "", {}))
def c14(spark: SparkSession, sf: str) -> DataFrame:
    """Price, day statistics, indicators and regime of every series as one flat row."""
    return _snapshot(M.snapshot(_with_open_bar(Z.labelled(spark, sf)), Z.HOUR))


@query("j4_snapshot_with_derivatives", _snapshot_sql(f"SELECT 'alpha' AS exchange, symbol, rate, mark FROM ({_RATES})", f", {r('rate', 8)} AS rate, {r('mark', 2)} AS mark_price", {}).replace("SELECT exchange, symbol, (sign(price)", "SELECT CASE exchange WHEN 'alpha' THEN 'binance' ELSE exchange END AS exchange, symbol, (sign(price)", 1))
def j4_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot with the derivatives of its symbol, on one exchange; the funding rate has a vote there."""
    from ..sources.trades import derivatives

    text = lambda c: c.cast("string")
    rate = (F.max("price") * 2 - F.count(F.lit(1)) % 200) / 1000000
    s = Z.trades(spark, sf).groupBy("symbol").agg(rate.alias("rate"), F.max("price").alias("mark"))
    kinds = {
        "funding": F.to_json(F.array(F.struct(text(F.col("rate")).alias("fundingRate"), F.lit(1704067200000).alias("fundingTime")))),
        "ticker": F.to_json(F.struct(text(F.col("mark")).alias("lastPrice"), F.lit("1.5").alias("priceChangePercent"))),
    }
    raw = s.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x")).select("symbol", "x.*")
    bars = _with_open_bar(Z.labelled(spark, sf)).withColumn("exchange", F.when(F.col("exchange") == "alpha", "binance").otherwise(F.col("exchange")))
    s = M.snapshot(bars, Z.HOUR, derivatives(raw))
    return _snapshot(s, *rr("funding_rate", digits=8), F.col("derivatives.mark_price").alias("mark_price")).withColumnRenamed("funding_rate", "rate")


@query("c11_document", with_ctes(f"SELECT exchange, symbol, ts, rsi AS rsi_value, rsi_note, macd_hist, macd_direction, bb_position, bb_signal, sma200, sma_trend, ema12, ema_signal, vwap_signal, volume_ratio, regime, confidence FROM ({_DOC_SQL})", "lab1", _ALL_NEWEST, True))
def c11_document(spark: SparkSession, sf: str) -> DataFrame:
    """The indicators as nested documents, some fields of each taken out again."""
    d = M.indicator_document(M.indicators(Z.labelled(spark, sf), Z.HOUR, complete=False))
    field = {"rsi_value": "rsi.value", "rsi_note": "rsi.note", "macd_hist": "macd.histogram", "macd_direction": "macd.direction", "bb_position": "bollinger.position", "bb_signal": "bollinger.signal", "sma200": "sma.sma200", "sma_trend": "sma.trend", "ema12": "ema.ema12",
             "ema_signal": "ema.signal", "vwap_signal": "vwap.signal", "volume_ratio": "volume.ratio", "regime": "regime.label", "confidence": "regime.confidence"}
    return d.select(*KEY, "ts", *[F.col(v).alias(k) for k, v in field.items()])


@query("c20_release_check", with_ctes(
    """SELECT *, missing_days = 0 AND status = 'ok' AND all_ok AS passed FROM (SELECT
      (SELECT count(*) FROM spine, clock WHERE day <> today AND NOT EXISTS (FROM daystats d WHERE d.exchange = spine.exchange AND d.symbol = spine.symbol AND d.day = spine.day)) AS missing_days,
      (SELECT CASE WHEN max(t) IS NULL THEN 'unknown' WHEN max(now) - max(t) > 300 THEN 'stale' ELSE 'ok' END FROM labelled, clock) AS status, (SELECT coalesce(bool_and(status = 'OK'), true) FROM violations) AS all_ok)""", "daystats", _VALID))  # fmt: skip
def c20(spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    first, today, now = Z.bounds(bars)
    return M.release_check(bars, Z.dim(spark, sf), first, today, today, now)


# --- scalar functions over a table

_FMT = {"g": "SELECT exchange, symbol, t, diff AS d FROM diffs WHERE diff IS NOT NULL"}


@query("x_formats", with_ctes(
    f"""SELECT exchange, symbol, t, {_HUMAN} AS padded, CASE WHEN d < 60 THEN d || 's' WHEN d < 3600 THEN d // 60 || 'm ' || d % 60 || 's' WHEN d < 86400 THEN d // 3600 || 'h ' || d % 3600 // 60 || 'm' ELSE d // 86400 || 'd ' || d % 86400 // 3600 || 'h' END AS plain,
      CASE WHEN d < 120 THEN d || 's ago' WHEN d < 3600 THEN d // 60 || 'm ago' WHEN d < 86400 THEN d // 3600 || 'h ago' ELSE d // 86400 || 'd ago' END AS ago, CASE WHEN d > 100 THEN 2 WHEN d > 1 THEN 4 ELSE 6 END AS decimals,
      CASE WHEN d >= 1000000 THEN printf('%.1fM', d / 1e6) WHEN d >= 1000 THEN printf('%.1fK', d / 1e3) ELSE CAST(d AS VARCHAR) END AS n, CASE WHEN d * 1000.0 >= 1073741824 THEN printf('%.2f GB', d * 1000 / 1073741824.0) WHEN d * 1000.0 >= 1048576 THEN printf('%.1f MB', d * 1000 / 1048576.0) WHEN d * 1000 >= 1024 THEN printf('%.0f KB', d * 1000 / 1024.0) ELSE d * 1000 || ' B' END AS bytes FROM g""", "diffs", _FMT))  # fmt: skip
def x_formats(spark: SparkSession, sf: str) -> DataFrame:
    d = G.bar_diffs(Z.labelled(spark, sf)).where("diff IS NOT NULL")
    return d.select(*KEY, t(), X.fmt_dur("diff").alias("padded"), X.fmt_dur("diff", "plain").alias("plain"), X.fmt_ago("diff").alias("ago"), X.price_decimals("diff").alias("decimals"), X.fmt_count("diff").alias("n"), X.fmt_bytes(F.col("diff") * 1000).alias("bytes"))


@query("x_scalars", with_ctes(
    """SELECT event_id, CASE ['1s','1m','5m','15m','1h','4h','1d','7w'][event_id % 8 + 1] WHEN '1s' THEN 1 WHEN '1m' THEN 60 WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 WHEN '1d' THEN 86400 ELSE 300 END AS tf, replace(event_type || '/' || 'usd', '/', '-') AS safe, upper(event_type) AS up,
      strftime(date_trunc('second', ts), '%H:%M:%S') AS hms, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) AS us, CASE WHEN value >= 80 THEN 'high' WHEN value >= 40 THEN 'mid' ELSE 'low' END AS quality, """ + r("value", 2) + """ AS v2, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, event_id % 2 = 0 AS even FROM events""", "trades"))  # fmt: skip
def x_scalars(spark: SparkSession, sf: str) -> DataFrame:
    e = Z.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    tf = F.element_at(F.array(*map(F.lit, ("1s", "1m", "5m", "15m", "1h", "4h", "1d", "7w"))), (F.col("event_id") % 8 + 1).cast("int"))
    return e.select(
        "event_id", X.tf_seconds(tf).alias("tf"), X.safe_symbol(F.concat("event_type", F.lit("/usd"))).alias("safe"), F.upper("event_type").alias("up"), X.hms_utc("at").alias("hms"), F.unix_seconds("at").alias("sec"), F.unix_micros("at").alias("us"),
        X.quality_class("value").alias("quality"), X.round_half_away("value", 2).alias("v2"), F.datediff(F.to_date("at"), F.lit("2024-01-01").cast("date")).cast("long").alias("days"), (F.col("event_id") % 2 == 0).alias("even"))


# --- parsing: raw records are made from the tables and read back


def _klines(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars written as the JSON arrays that an exchange returns."""
    b = Z.bars(spark, sf)
    s = lambda c: F.col(c).cast("string")
    ms = (F.unix_seconds("window_start") * 1000).cast("string")
    arr = F.array(ms, s("open"), s("high"), s("low"), s("close"), s("volume_base"), F.lit("0"), s("volume_quote"), s("trade_count"), F.lit("0"), F.lit("0"))
    return b.select(F.concat_ws("/", *KEY).alias("symbol"), F.to_json(arr).alias("value"))


@query("p6_binance_klines", with_ctes(f"SELECT exchange || '/' || symbol AS symbol, t, {rs('open', 'high', 'low', 'close', 'volume_base')}, trade_count, {rs('vwap')}, 'backfill_1m' AS source FROM bars", "bars"))
def p6(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.trades import parse_binance_klines

    return parse_binance_klines(_klines(spark, sf)).select("symbol", t(), *rr("open", "high", "low", "close", "volume_base"), "trade_count", *rr("vwap"), "source")


@query("p7_coinbase_candles", with_ctes(f"SELECT exchange || '/' || symbol AS symbol, t, {rs('open', 'high', 'low', 'close', 'volume_base')}, {r('volume_base * (low + high) / 2')} AS volume_quote, {r('CASE WHEN volume_base > 0 THEN volume_base * (low + high) / 2 / volume_base ELSE close END')} AS vwap FROM bars", "bars"))
def p7(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.trades import parse_coinbase_candles

    s = lambda c: F.col(c).cast("string")
    raw = Z.bars(spark, sf).select(F.concat_ws("/", *KEY).alias("symbol"), F.to_json(F.array(F.unix_seconds("window_start").cast("string"), s("low"), s("high"), s("open"), s("close"), s("volume_base"))).alias("value"))
    return parse_coinbase_candles(raw).select("symbol", t(), *rr("open", "high", "low", "close", "volume_base", "volume_quote", "vwap"))


@query("p8_kraken_ohlc", with_ctes(f"SELECT exchange || '-' || symbol AS symbol, t, {rs('open', 'high', 'low', 'close', 'vwap', 'volume_base')}, {r('volume_base * vwap')} AS volume_quote, trade_count FROM bars WHERE t < (SELECT max(t) FROM bars)", "bars"))
def p8(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.trades import parse_kraken_ohlc

    b = Z.bars(spark, sf)
    s = lambda c: F.col(c).cast("string")
    row = F.array(F.unix_seconds("window_start").cast("string"), s("open"), s("high"), s("low"), s("close"), s("vwap"), s("volume_base"), s("trade_count"))
    day = b.groupBy(F.concat_ws("/", *KEY).alias("symbol"), F.to_date("window_start").alias("day")).agg(F.collect_list(row).alias("rows"))
    body = F.to_json(F.struct(F.array().cast("array<string>").alias("error"), F.struct(F.col("rows").alias("PAIR"), F.lit(0).alias("last")).alias("result")))
    return parse_kraken_ohlc(day.select("symbol", body.alias("value")), Z.bounds(b)[2]).select("symbol", t(), *rr("open", "high", "low", "close", "vwap", "volume_base", "volume_quote"), "trade_count")


@query("p4_normalise_trades", with_ctes("SELECT CASE exchange WHEN 'alpha' THEN 'binance' WHEN 'beta' THEN 'coinbase' ELSE 'kraken' END AS exchange, symbol, epoch_us(ts) // 1000 AS ms, " + rs("price", "qty") + ", is_buyer_maker FROM trades", "trades"))
def p4(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade written as its exchange's raw record and normalised again."""
    from ..sources.trades import normalise_trades

    ms, p, q = F.unix_millis("ts"), F.col("price").cast("string"), F.col("qty").cast("string")
    side = X.side_of("is_buyer_maker")
    at = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    b = F.to_json(F.struct(F.col("symbol").alias("s"), p.alias("p"), q.alias("q"), F.col("is_buyer_maker").alias("m"), ms.alias("T"), F.lit("binance").alias("_exchange")))
    c = F.to_json(F.struct(F.lit("match").alias("type"), F.col("symbol").alias("product_id"), p.alias("price"), q.alias("size"), side.alias("side"), at.alias("time"), F.lit("coinbase").alias("_exchange")))
    k = F.to_json(F.struct(F.col("symbol"), F.col("price"), F.col("qty"), side.alias("side"), at.alias("timestamp"), F.lit("trade").alias("_channel"), F.lit("kraken").alias("_exchange")))
    raw = Z.trades(spark, sf).select(F.when(F.col("exchange") == "alpha", b).when(F.col("exchange") == "beta", c).otherwise(k).alias("value"))
    return normalise_trades(raw).select(*KEY, F.unix_millis("ts").alias("ms"), *rr("price", "qty"), "is_buyer_maker")


@query("r1_stream_bars", with_ctes(f"SELECT exchange, symbol, t, {rs(*PRICES)}, trade_count FROM bars", "bars"))
def r1(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream to hourly bars: the last state of every window that the stream emitted in update mode."""
    from ..streaming.runs import bars_of_stream

    return bars_of_stream(spark, f"{sf}/events.parquet", Z.HOUR).select(*KEY, t(), *rr(*PRICES), "trade_count")


@query("r2_receive_time_bars", with_ctes(f"SELECT exchange, symbol, t, {rs('open', 'high', 'low', 'close', 'volume_base')}, trade_count FROM (" + Z._ohlcv("(SELECT * REPLACE (ts + INTERVAL (trade_id % 7 * 100) SECOND AS ts) FROM trades)", f"{epoch('ts')} // 3600 * 3600") + ")", "trades"))
def r2(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a stream by the time of receipt, up to ten minutes after the trade."""
    from ..streaming.runs import bars_of_stream

    bars = bars_of_stream(spark, f"{sf}/events.parquet", Z.HOUR, F.col("trade_id") % 7 * 100)
    return bars.select(*KEY, t(), *rr("open", "high", "low", "close", "volume_base"), "trade_count")
