"""Exchange records to trades and bars: projections over raw JSON text (column `value`), never a Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import iso_to_epoch_ms, lenient_double, safe_ratio, safe_symbol

SHAPE = ["exchange", "symbol", "price", "qty", "ts", "is_buyer_maker"]


def event_trades(events: DataFrame) -> DataFrame:
    """Trades from an events table (event_id, ts, user_id, event_type, value, props): three exchanges, a symbol per event type."""
    exchange = F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (F.col("user_id") % 3 + 1).cast("int"))
    return events.select(exchange.alias("exchange"), F.upper("event_type").alias("symbol"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("qty"),
                         F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"), F.col("event_id").alias("trade_id"))


def read_raw_trades(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of raw trade files below path, compressed or not, with the file they are from."""
    reader = spark.readStream if stream else spark.read
    return reader.option("recursiveFileLookup", "true").text(path).withColumn("path", F.col("_metadata.file_path"))


def _get(path: str) -> Column:
    return F.get_json_object("value", f"$.{path}")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def parse_binance_trades(raw: DataFrame) -> DataFrame:
    """`{stream, data: {p, q, m, T}}`: trades of `@trade` streams with all of price, quantity and side."""
    name = F.split(_get("stream"), "@")
    rows = raw.where(_get("stream").endswith("@trade")).select(
        F.lit("binance").alias("exchange"), F.upper(name[0]).alias("symbol"), _number(_get("data.p")).alias("price"), _number(_get("data.q")).alias("qty"),
        F.timestamp_millis(_get("data.T").try_cast("long")).alias("ts"), _get("data.m").try_cast("boolean").alias("is_buyer_maker"))
    return rows.where("price IS NOT NULL AND qty IS NOT NULL AND is_buyer_maker IS NOT NULL")


def parse_coinbase_trades(raw: DataFrame) -> DataFrame:
    rows = raw.where(_get("type").isin("match", "last_match")).select(
        F.lit("coinbase").alias("exchange"), _get("product_id").alias("symbol"), _number(_get("price")).alias("price"), _number(_get("size")).alias("qty"),
        F.timestamp_millis(iso_to_epoch_ms(_get("time"), F.unix_millis(F.current_timestamp()))).alias("ts"), (_get("side") == "sell").alias("is_buyer_maker"))
    return rows.where("price IS NOT NULL AND qty IS NOT NULL AND symbol IS NOT NULL")


KRAKEN = "array<struct<symbol:string,price:string,qty:string,side:string,timestamp:string>>"


def _kraken(t: Column) -> list[Column]:
    return [F.lit("kraken").alias("exchange"), safe_symbol(t["symbol"]).alias("symbol"), _number(t["price"]).alias("price"), _number(t["qty"]).alias("qty"),
            F.timestamp_millis(iso_to_epoch_ms(t["timestamp"], F.unix_millis(F.current_timestamp()))).alias("ts"), (t["side"] == "sell").alias("is_buyer_maker")]


def parse_kraken_trades(raw: DataFrame) -> DataFrame:
    """Channel `trade`: one trade for each element of data; prices may be numbers or text."""
    each = raw.where(_get("channel") == "trade").select(F.explode(F.from_json(_get("data"), KRAKEN)).alias("t"))
    return each.select(*_kraken(F.col("t"))).where("price IS NOT NULL AND qty IS NOT NULL AND symbol IS NOT NULL")


#: The fields of the stored records of all exchanges, as text.
RECORD = ("_exchange", "_channel", "s", "p", "q", "T", "m", "type", "product_id", "symbol", "price", "size", "qty", "side", "time", "timestamp")


def normalise_trades(raw: DataFrame) -> DataFrame:
    """Trades from stored lines of all exchanges (inner record with `_exchange`): one scan, each line parsed once.

    json_tuple makes all fields in one parse; the optimiser would copy a from_json into each expression that uses it.
    """
    f = lambda k: F.col(f"_{k}")
    own, by = f("_exchange"), lambda b, c, k: F.when(f("_exchange") == "binance", b).when(f("_exchange") == "coinbase", c).when(f("_exchange") == "kraken", k)
    fits = (own == "binance") | ((own == "coinbase") & f("type").isin("match", "last_match")) | ((own == "kraken") & (f("_channel") == "trade"))
    ms = by(f("T").try_cast("long"), *[iso_to_epoch_ms(f(k), F.unix_millis(F.current_timestamp())) for k in ("time", "timestamp")])
    sold = f("side") == "sell"
    rows = raw.select(F.json_tuple("value", *RECORD).alias(*[f"_{k}" for k in RECORD])).where(fits).select(
        own.alias("exchange"), by(F.upper(f("s")), f("product_id"), safe_symbol(f("symbol"))).alias("symbol"), _number(by(f("p"), f("price"), f("price"))).alias("price"),
        _number(by(f("q"), f("size"), f("qty"))).alias("qty"), F.timestamp_millis(ms).alias("ts"), by(f("m").try_cast("boolean"), sold, sold).alias("is_buyer_maker"))
    named = F.col("exchange") == "binance"
    return rows.where("price IS NOT NULL AND qty IS NOT NULL AND is_buyer_maker IS NOT NULL").where(named | F.col("symbol").isNotNull())


def not_message_types(raw: DataFrame, types: tuple[str, ...] = ("status", "heartbeat", "subscriptions", "subscribe", "error")) -> DataFrame:
    """Without control messages and blank lines."""
    kind = F.coalesce(_get("type"), _get("channel"), _get("method"), F.lit("data"))
    return raw.where((F.trim("value") != "") & ~kind.isin(*types))


def _bar(exchange: str | Column, symbol: Column, ts: Column, o: Column, h: Column, lo: Column, c: Column, base: Column, quote: Column, n: Column, vwap: Column, source: str) -> list[Column]:
    zero = F.lit(0.0)
    values = (("open", o), ("high", h), ("low", lo), ("close", c), ("volume_base", base), ("volume_quote", quote), ("trade_count", n.cast("long")), ("vwap", vwap), ("bid", zero), ("ask", zero), ("spread", zero))
    return [ts.alias("window_start"), (F.lit(exchange) if isinstance(exchange, str) else exchange).alias("exchange"), symbol.alias("symbol"), *[v.alias(k) for k, v in values], F.lit(source).alias("source")]


def _rows(raw: DataFrame, least: int) -> DataFrame:
    """symbol and a (fields as text) of each JSON array of at least `least` elements."""
    return raw.select("symbol", F.from_json("value", "array<string>").alias("a")).where(F.size("a") >= least)


def parse_binance_klines(raw: DataFrame, interval: str = "1m") -> DataFrame:
    """(symbol, value: a JSON array of 11 or more) to bars; the source tells the interval."""
    n = lambda i: lenient_double(F.col("a")[i])
    ts = F.timestamp_millis(F.col("a")[0].try_cast("long"))
    bars = _rows(raw, 11).select(*_bar("binance", F.col("symbol"), ts, n(1), n(2), n(3), n(4), n(5), n(7), n(8), safe_ratio(n(7), n(5), n(4)), f"backfill_{interval}"))
    return bars.where("window_start IS NOT NULL")


def parse_coinbase_candles(raw: DataFrame) -> DataFrame:
    """(symbol, value: [ts, low, high, open, close, volume]); quote volume at the middle of high and low, no trade count."""
    n = lambda i: lenient_double(F.col("a")[i])
    quote = n(5) * (n(1) + n(2)) / 2
    ts = F.timestamp_seconds(F.col("a")[0].try_cast("long"))
    bars = _rows(raw, 6).select(*_bar("coinbase", F.col("symbol"), ts, n(3), n(2), n(1), n(4), n(5), quote, F.lit(0), safe_ratio(quote, n(5), n(4)), "backfill_1m"))
    return bars.where("window_start IS NOT NULL")


def parse_kraken_ohlc(raw: DataFrame, end: Column) -> DataFrame:
    """(symbol, value: the response) to bars before end; a response with errors gives none, the key `last` is no pair."""
    fine = raw.where(F.coalesce(F.size(F.from_json(_get("error"), "array<string>")), F.lit(0)) <= 0)
    pairs = fine.select("symbol", F.explode(F.map_filter(F.from_json(_get("result"), "map<string,string>"), lambda k, v: k != "last")).alias("pair", "rows"))
    each = pairs.select("symbol", F.explode(F.from_json("rows", "array<string>")).alias("row")).select("symbol", F.from_json("row", "array<string>").alias("a")).where(F.size("a") >= 8)
    n = lambda i: lenient_double(F.col("a")[i])
    ts = F.timestamp_seconds(F.col("a")[0].try_cast("long"))
    bars = each.select(*_bar("kraken", safe_symbol("symbol"), ts, n(1), n(2), n(3), n(4), n(6), n(6) * n(5), n(7), n(5), "backfill_1m"))
    return bars.where(F.col("window_start") < end)


def derivatives(raw: DataFrame) -> DataFrame:
    """Landed records (symbol, kind: funding, open_interest, long_short or ticker, value) to one row per symbol; a missing block is null.

    Of several records of a kind the one with the largest text is taken, so that repeated rows do no harm.
    """
    from ..functions.columns import iso_utc, round_half_away

    one = raw.groupBy("symbol").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("funding", "open_interest", "long_short", "ticker")])
    get = lambda c, p: F.get_json_object(c, p)
    rate = F.coalesce(_number(get("funding", "$[0].fundingRate")), F.lit(0.0))
    at = F.timestamp_millis(F.coalesce(get("funding", "$[0].fundingTime").try_cast("long"), F.lit(0).cast("long")))
    ratio = F.coalesce(_number(get("long_short", "$[0].longShortRatio")), F.lit(1.0))
    sign = F.when(rate > 0.0001, "bullish").when(rate < -0.0001, "bearish").otherwise("neutral")
    note = F.when(rate > 0, "positive funding: longs paying shorts").otherwise("negative funding: shorts paying longs")
    num = lambda c, p: F.coalesce(_number(get(c, p)), F.lit(0.0))
    return one.select(
        "symbol",
        F.when(get("funding", "$[0]").isNotNull(), F.struct(rate.alias("rate"), round_half_away(rate * 3.0 * 365.0, 4).alias("rate_8h_annualised"), iso_utc(at).alias("next_funding_time"), sign.alias("signal"), note.alias("note"))).alias("funding"),
        F.when(F.col("open_interest").isNotNull(), F.struct(round_half_away(num("open_interest", "$.openInterest"), 2).alias("value_contracts"), F.lit("unknown").alias("signal"))).alias("open_interest"),
        F.when(get("long_short", "$[0]").isNotNull(), F.struct(round_half_away(ratio, 4).alias("value"), F.when(ratio > 1.1, "longs_dominant").when(ratio < 0.9, "shorts_dominant").otherwise("balanced").alias("signal"))).alias("long_short_ratio"),
        round_half_away(num("ticker", "$.lastPrice"), 2).alias("mark_price"), round_half_away(num("ticker", "$.priceChangePercent"), 4).alias("change_24h_pct"),
    )
