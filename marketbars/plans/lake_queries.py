"""Registered queries that write and read files and streams: each makes a lake (or raw records) from the given tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import columns as X
from ..operators import audit as A
from ..operators import bars as B
from ..operators import daybook as D
from ..schema import BARS_SCHEMA, KEY
from ..sources import daybook as K
from ..sources import lake as L
from ..sources import trades as R
from ..streaming import bars as ST
from ..streaming.runs import table_stream, work_dir
from ..streaming.state import disconnect_gap_stream, request_stream, rocksdb
from . import fixtures as Z
from . import market as M
from .fixtures import r, with_ctes
from .registry import PRICES, _ALL, _CAUSE, _CONN, _COVER, _DOC_SQL, _REPORT, _connections, query, rr, rs, t

DAYS = "t // 86400"


def _lake(spark: SparkSession, sf: str, parts: int = 1) -> tuple[str, DataFrame]:
    """A new lake of the labelled bars, written in `parts` appends."""
    root, bars = f"{work_dir(spark)}/lake", Z.labelled(spark, sf)
    for k in range(parts):
        L.write_bars(bars.where(F.pmod(F.unix_seconds("window_start") / 3600, F.lit(parts)) == k), root)
    return root, bars


def _days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.unix_date("day").cast("long"))


@query("k1_s1_lake_round_trip", with_ctes(f"SELECT exchange, symbol, t, {rs(*PRICES)}, trade_count, source FROM labelled", "labelled"))
def k1(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written by series and day and read back."""
    root, _ = _lake(spark, sf)
    return L.read_bars(spark, root).select(*KEY, t(), *rr(*PRICES), "trade_count", "source")


@query("s2_read_day", with_ctes(f"SELECT exchange, symbol, t, {rs('close')} FROM labelled, clock WHERE exchange = 'gamma' AND {DAYS} = first_day + 2", "clock"))
def s2(spark: SparkSession, sf: str) -> DataFrame:
    root, bars = _lake(spark, sf)
    day = bars.agg(F.to_date(F.min("window_start"))).first()[0] + timedelta(2)
    return L.read_day(spark, root, day, "gamma").select(*KEY, t(), *rr("close"))


@query("k2_write_backfill", with_ctes("SELECT exchange, symbol, t FROM bars JOIN (SELECT exchange, symbol, min(t) + 7200 AS a, min(t) + 90000 AS b FROM bars GROUP BY 1, 2) USING (exchange, symbol) WHERE t BETWEEN a AND b", "bars"))
def k2(spark: SparkSession, sf: str) -> DataFrame:
    root, bars = f"{work_dir(spark)}/lake", Z.bars(spark, sf)
    s = F.unix_seconds(F.min("window_start"))
    L.write_backfill(bars, bars.groupBy(*KEY).agg((s + 7200).alias("start_s"), (s + 90000).alias("end_s")), root)
    return L.read_bars(spark, root).select(*KEY, t())


@query("k3_compact", with_ctes("""SELECT exchange, symbol, day, p AS files, 1 AS files_after, true AS smaller FROM (SELECT exchange, symbol, t // 86400 AS day, count(DISTINCT t // 3600 % 3) AS p FROM labelled GROUP BY 1, 2, 3), clock WHERE day < today AND p > 1""", "daystats"))
def k3(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each whole day before and after a compaction of three appends, and whether they take less room."""
    root, bars = _lake(spark, sf, 3)
    today = bars.agg(F.to_date(F.max("window_start"))).first()[0]
    plan = L.compact(spark, root, F.lit(today), f"{work_dir(spark)}/staging")
    return _days(plan).select(*KEY, "day", "files", "files_after", (F.col("bytes_after") < F.col("bytes")).alias("smaller"))


@query("k3_compacted_rows", with_ctes("SELECT exchange, symbol, day, bars FROM daystats", "daystats"))
def k3_rows(spark: SparkSession, sf: str) -> DataFrame:
    """No row is lost or doubled by a compaction."""
    root, _ = _lake(spark, sf, 3)
    L.compact(spark, root, F.lit("2100-01-01").cast("date"), f"{work_dir(spark)}/staging")
    return _days(A.count_bars(L.read_bars(spark, root)))


@query("k4_stage_copy", with_ctes("SELECT exchange, symbol, day, bars AS rows FROM daystats, clock WHERE day < today AND day % 3 <> 0", "daystats"))
def k4(spark: SparkSession, sf: str) -> DataFrame:
    """A staged mirror without today and the days that are staged already."""
    root, bars = _lake(spark, sf)
    dst = f"{work_dir(spark)}/mirror"
    staged = A.count_bars(bars).where(F.unix_date("day") % 3 == 0)
    L.stage_copy(spark, root, dst, bars.agg(F.to_date(F.max("window_start"))).first()[0], staged)
    return _days(A.count_bars(L.read_bars(spark, dst))).withColumnRenamed("bars", "rows")


@query("k6_retention_plan", with_ctes("SELECT exchange, symbol, day, 1 AS files FROM daystats, clock WHERE day < today - 10", "daystats"))
def k6(spark: SparkSession, sf: str) -> DataFrame:
    root, bars = _lake(spark, sf)
    return _days(L.retain(spark, root, 10, bars.agg(F.to_date(F.max("window_start"))).first()[0])).select(*KEY, "day", "files")


@query("k5_fill_unstaged", with_ctes("SELECT exchange, symbol, day, bars AS rows FROM daystats, clock WHERE day < today AND (exchange = 'beta' OR day % 3 = 0)", "daystats"))
def k5(spark: SparkSession, sf: str) -> DataFrame:
    """A mirror of every third day, filled up for one exchange."""
    root, bars = _lake(spark, sf)
    dst, today = f"{work_dir(spark)}/mirror", bars.agg(F.to_date(F.max("window_start"))).first()[0]
    L.stage_copy(spark, root, dst, today, A.count_bars(bars).where(F.unix_date("day") % 3 != 0))
    L.fill_unstaged(spark, root, dst, ["beta"], today)
    return _days(A.count_bars(L.read_bars(spark, dst))).withColumnRenamed("bars", "rows")


@query("k6_retain_raw_archive", with_ctes("SELECT exchange, symbol, epoch_us(ts) // 86400000000 AS day, count(*) AS lines FROM trades WHERE epoch_us(ts) // 86400000000 >= (SELECT max(epoch_us(ts)) // 86400000000 FROM trades) - 10 GROUP BY 1, 2, 3", "trades"))
def k6_raw(spark: SparkSession, sf: str) -> DataFrame:
    """What a retention of ten days leaves of a raw archive by date."""
    root, trades = f"{work_dir(spark)}/raw", Z.trades(spark, sf)
    rows = trades.select(F.col("trade_id").cast("string").alias("value"), *KEY, F.to_date("ts").alias("date"))
    rows.repartition(*KEY, "date").write.partitionBy(*KEY, "date").option("compression", "gzip").text(root)
    L.retain(spark, root, 10, trades.agg(F.to_date(F.max("ts"))).first()[0], dry_run=False)
    files = R.read_raw_trades(spark, root).groupBy("path").agg(F.count(F.lit(1)).alias("lines"))
    return _days(files.withColumns(X.path_parts("path")).groupBy(*KEY, "day").agg(F.sum("lines").alias("lines")))


@query("k8_write_report", with_ctes(f"SELECT exchange, symbol, count(*) AS total_bars, sum(trade_count)::BIGINT AS total_trades, {r('last(close ORDER BY t)')} AS last_close FROM labelled GROUP BY 1, 2", "labelled"))
def k8(spark: SparkSession, sf: str) -> DataFrame:
    """A summary persisted as JSON and read back."""
    path = f"{work_dir(spark)}/report"
    L.write_report(A.symbol_summary(Z.labelled(spark, sf)), path)
    return spark.read.schema("exchange string, symbol string, total_bars long, total_trades long, last_close double").json(path).select(*KEY, "total_bars", "total_trades", *rr("last_close"))


@query("s4_read_latest_days", with_ctes("SELECT exchange, symbol, t FROM labelled JOIN (SELECT exchange, symbol, max(t) AS m FROM labelled GROUP BY 1, 2) USING (exchange, symbol) WHERE t > m - 25 * 3600 AND exchange = 'gamma'", "labelled"))
def s4_days(spark: SparkSession, sf: str) -> DataFrame:
    """The newest bars of a lake, from the directories of its newest days."""
    root, _ = _lake(spark, sf)
    return L.read_latest(spark, root, Z.HOUR, 24, "gamma").select(*KEY, t())


@query("s9_read_health", "WITH h AS (SELECT event_type, max(epoch_us(ts)) // 1000000 AS s, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1) SELECT 'live-' || event_type AS mode, n AS messages, u AS symbols_count, ((SELECT max(s) FROM h) + 90 - s) / 60.0::DOUBLE AS age_minutes FROM h")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """Nested health snapshots, one file each, with their age."""
    path = f"{work_dir(spark)}/health"
    h = Z.table(spark, sf, "events").groupBy("event_type").agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("s"), F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"))
    doc = h.select("event_type", X.iso_utc(F.timestamp_seconds("s")).alias("ts_utc"), F.concat(F.lit("live-"), F.col("event_type")).alias("mode"), F.struct(F.lit("running").alias("status"), F.col("u").alias("symbols_count")).alias("collector"), F.create_map(F.lit("messages"), "n").alias("counters"))
    doc.repartition("event_type").write.partitionBy("event_type").json(path)
    newest = h.agg(F.timestamp_seconds(F.max("s") + 90)).first()[0]
    return L.read_health(spark, path, F.lit(newest)).select("mode", F.col("counters")["messages"].alias("messages"), "collector.symbols_count", F.col("age_minutes").cast("double").alias("age_minutes"))


@query("s10_file_inventory", with_ctes("SELECT exchange, symbol, count(*) AS files FROM daystats GROUP BY 1, 2", "daystats"))
def s10(spark: SparkSession, sf: str) -> DataFrame:
    root, _ = _lake(spark, sf)
    return L.inventory_totals(L.file_inventory(spark, root, "*.parquet"), KEY).where("bytes > 0").select(*KEY, "files")


@query("s11_ranges_of_files", with_ctes("SELECT exchange, symbol, day, first_t AS min_t, last_t AS max_t FROM daystats", "daystats"))
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """First and last time of each file, from its footer."""
    root, _ = _lake(spark, sf)
    return _days(L.file_ts_ranges(L.file_inventory(spark, root, "*.parquet"))).select(*KEY, "day", t("min_ts", "min_t"), t("max_ts", "max_t"))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(text.encode()))
    out.close()


@query("s12_s13_readable_files", with_ctes("SELECT count(*) + 3 AS files, count(*) AS valid, sum(bars)::BIGINT AS rows, 3 AS unreadable FROM daystats", "daystats"))
def s12(spark: SparkSession, sf: str) -> DataFrame:
    """A lake with a damaged file for each exchange: found by its footer, passed over by a tolerant read."""
    root, _ = _lake(spark, sf)
    for e in Z.INTERVALS:
        _write_text(spark, f"{root}/exchange={e}/symbol=VIEW/year=2024/month=01/day=02/part-damaged-{e}.parquet", "PAR1 and then no footer: the writer was stopped")
    inv = L.file_inventory(spark, root, "*.parquet")
    rows = L.read_tolerant(spark, root)
    n = lambda c: F.count(F.lit(1)).alias(c)
    checked = L.parquet_footer_check(inv).agg(n("files"), F.count_if("valid").alias("valid"))
    return checked.crossJoin(rows.agg(n("rows"))).crossJoin(L.unreadable(inv, rows).agg(n("unreadable")))  # a row on each side


@query("a17_file_count_matrix", with_ctes("SELECT exchange, symbol, day, CASE WHEN bars IS NULL THEN 0 ELSE 1 END AS files, CASE WHEN bars IS NULL THEN 'MISS' ELSE '1' END AS cell FROM spine LEFT JOIN daystats USING (exchange, symbol, day)", "daystats"))
def a17(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each configured series and day of the whole lake."""
    root, bars = _lake(spark, sf)
    first, last, _ = Z.bounds(bars)
    return _days(A.file_counts_by_day(L.file_inventory(spark, root, "*.parquet"), Z.dim(spark, sf), first, last))


@query("a17_file_count_pivot", with_ctes("SELECT exchange, symbol, CASE WHEN a IS NULL THEN 'MISS' ELSE CAST(a AS VARCHAR) END AS d0, CASE WHEN b IS NULL THEN 'MISS' ELSE CAST(b AS VARCHAR) END AS d1, (a IS NULL)::BIGINT + (b IS NULL)::BIGINT AS missing FROM dim LEFT JOIN (SELECT exchange, symbol, max(1) FILTER (day = first_day) AS a, max(1) FILTER (day = first_day + 1) AS b FROM daystats, clock GROUP BY 1, 2) USING (exchange, symbol)", "daystats"))
def a17_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a matrix, of the first two days."""
    root, bars = _lake(spark, sf)
    first = bars.agg(F.to_date(F.min("window_start"))).first()[0]
    days = [str(first + timedelta(k)) for k in range(2)]
    return A.file_count_matrix(L.file_inventory(spark, root, "*.parquet"), Z.dim(spark, sf), days).toDF(*KEY, "d0", "d1", "missing")


@query("k7_s8_connection_events", with_ctes("SELECT exchange, event, epoch_ms(date_trunc('millisecond', ts)) AS ms, 1.5 AS gap_seconds FROM conn", "trades", _CONN))
def k7(spark: SparkSession, sf: str) -> DataFrame:
    """Connection events written by date as JSON lines and read back."""
    root = f"{work_dir(spark)}/events"
    rows = _connections(spark, sf).withColumn("ts", F.date_trunc("millisecond", "ts")).withColumn("gap_seconds", F.lit(1.46))
    L.write_events(rows.select("event", "exchange", "ts", F.lit("r").alias("reason"), "gap_seconds"), root)
    return L.read_connection_events(spark, root).select("exchange", "event", F.unix_millis("ts").alias("ms"), F.col("gap_seconds").cast("decimal(2,1)").cast("double").alias("gap_seconds"))


# --- day aggregates that are kept beside a lake


def _late_day(spark: SparkSession, sf: str) -> tuple[str, str, DataFrame, DataFrame]:
    """A lake whose day aggregates were kept before one day of an exchange came in, then brought up to date: lake, book, bars, and the plan of the refresh."""
    base = work_dir(spark)
    root, book = f"{base}/lake", f"{base}/book"
    Z.labelled(spark, sf).write.parquet(f"{base}/bars")  # used by five jobs
    bars = spark.read.schema(BARS_SCHEMA).parquet(f"{base}/bars").select(*BARS_SCHEMA.fieldNames())
    first = bars.agg(F.to_date(F.min("window_start"))).first()[0]
    late = (F.to_date("window_start") == F.lit(first + timedelta(2))) & (F.col("exchange") == "gamma")
    hour = F.hour("window_start")
    L.write_bars(bars.where(~late), root)
    K.refresh(spark, root, book)
    L.write_bars(bars.where(late & (hour < 12)), root)
    K.refresh(spark, root, book)
    L.write_bars(bars.where(late & (hour >= 12)), root)
    return root, book, bars, K.refresh(spark, root, book)


@query("a8_kept_day_stats", with_ctes("SELECT * FROM daystats", "daystats"))
def a8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Day aggregates after a back-fill in two parts, of which only the touched days were read."""
    _, book, _, _ = _late_day(spark, sf)
    return _days(D.day_stats(K.read_daybook(spark, book))).select(*KEY, "day", "bars", t("first_ts", "first_t"), t("last_ts", "last_t"), "live", "backfill", "empty", "trades", "n_sources")


@query("a9_kept_fast_stats", with_ctes(f"SELECT exchange, symbol, day, bars, {r('live * 100.0 / bars')} AS live_pct, {r('empty * 100.0 / bars')} AS empty_pct FROM daystats", "daystats"))
def a9_kept(spark: SparkSession, sf: str) -> DataFrame:
    _, book, _, _ = _late_day(spark, sf)
    return _days(D.fast_day_stats(K.read_daybook(spark, book))).select(*KEY, "day", "bars", *rr("live_pct", "empty_pct"))


@query("a16_touched_days", with_ctes("SELECT exchange, symbol, t // 86400 AS day, count(DISTINCT t // 43200) AS files, max(CASE WHEN t % 86400 < 43200 THEN 1 END) AS was FROM labelled, clock WHERE exchange = 'gamma' AND t // 86400 = first_day + 2 GROUP BY 1, 2, 3 HAVING count_if(t % 86400 >= 43200) > 0", "clock"))
def a16_touched(spark: SparkSession, sf: str) -> DataFrame:
    """The days that the last refresh had to read: those that the second part of the back-fill touched."""
    return _days(_late_day(spark, sf)[3]).select(*KEY, "day", "files", "was")


@query("a20_kept_report", with_ctes(_REPORT, "daystats"))
def a20_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The completeness report from kept days; no bar is read."""
    _, book, bars, _ = _late_day(spark, sf)
    first, last, now = Z.bounds(bars)
    return _days(D.completeness_report(K.read_daybook(spark, book), Z.dim(spark, sf), first, last, F.to_date(now)))


@query("a6_kept_summary", with_ctes(f"SELECT exchange, symbol, count(*) AS total_bars, count_if(source = 'live') AS live_bars, count_if(trade_count = 0) AS empty_bars, sum(trade_count)::BIGINT AS total_trades, min(t) AS earliest, max(t) AS latest, {r('last(close ORDER BY t)')} AS last_close FROM labelled GROUP BY 1, 2", "labelled"))
def a6_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of each series, merged from its kept days."""
    _, book, _, _ = _late_day(spark, sf)
    return D.symbol_summary(K.read_daybook(spark, book)).select(*KEY, "total_bars", "live_bars", "empty_bars", "total_trades", t("earliest", "earliest"), t("latest", "latest"), *rr("last_close"))


@query("a22_kept_after_retention", with_ctes("SELECT exchange, symbol, day FROM spine LEFT JOIN daystats USING (exchange, symbol, day), clock WHERE day <> today AND (bars IS NULL OR day < today - 10)", "daystats"))
def a22_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Days that lack after a compaction and a retention of ten days: what is deleted leaves the book."""
    root, book, bars, _ = _late_day(spark, sf)
    first, last, now = Z.bounds(bars)
    newest = bars.agg(F.to_date(F.max("window_start"))).first()[0]
    L.compact(spark, root, F.lit(newest), f"{work_dir(spark)}/staging")
    L.retain(spark, root, 10, newest, dry_run=False)
    K.refresh(spark, root, book)
    return _days(D.missing_days(K.read_daybook(spark, book), Z.dim(spark, sf), first, last, F.to_date(now)))


# --- exchange messages made from trades


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Each trade as the message of its exchange, with control messages in between."""
    ms, p, q = F.unix_millis("ts"), F.col("price").cast("string"), F.col("qty").cast("string")
    at = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    data = F.struct(p.alias("p"), q.alias("q"), F.col("is_buyer_maker").alias("m"), ms.alias("T"))
    b = F.to_json(F.struct(F.concat(F.lower("symbol"), F.lit("@trade")).alias("stream"), data.alias("data")))
    c = F.to_json(F.struct(F.when(F.col("trade_id") % 5 == 0, "last_match").otherwise("match").alias("type"), F.col("symbol").alias("product_id"), p.alias("price"), q.alias("size"), X.side_of("is_buyer_maker").alias("side"), at.alias("time")))
    one = F.struct("symbol", p.alias("price"), q.alias("qty"), X.side_of("is_buyer_maker").alias("side"), at.alias("timestamp"))
    k = F.to_json(F.struct(F.lit("trade").alias("channel"), F.array(one, one).alias("data")))
    trades = Z.trades(spark, sf)
    control = trades.where("trade_id % 50 = 0").select(F.lit('{"type":"heartbeat","channel":"heartbeat","stream":"x@depth"}').alias("value"))
    return trades.select(F.when(F.col("exchange") == "alpha", b).when(F.col("exchange") == "beta", c).otherwise(k).alias("value")).unionByName(control)


def _parsed(name: str, exchange: str, copies: int) -> str:
    return with_ctes(f"SELECT '{name}' AS exchange, symbol, epoch_us(ts) // 1000 AS ms, {rs('price', 'qty')}, is_buyer_maker FROM trades, range({copies}) WHERE exchange = '{exchange}'", "trades")


for _name, _parse, _exchange, _copies in (("binance", R.parse_binance_trades, "alpha", 1), ("coinbase", R.parse_coinbase_trades, "beta", 1), ("kraken", R.parse_kraken_trades, "gamma", 2)):
    query(f"p{1 + ['binance', 'coinbase', 'kraken'].index(_name)}_{_name}_trades", _parsed(_name, _exchange, _copies))(
        lambda spark, sf, parse=_parse: parse(_messages(spark, sf)).select(*KEY, F.unix_millis("ts").alias("ms"), *rr("price", "qty"), "is_buyer_maker")
    )


@query("f11_message_types", with_ctes("SELECT count(*) AS messages FROM trades", "trades"))
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return R.not_message_types(_messages(spark, sf)).agg(F.count(F.lit(1)).alias("messages"))


@query("s7_raw_archive", with_ctes("SELECT exchange, symbol, epoch_us(ts) // 86400000000 AS day, count(*) AS lines, sum(trade_id)::BIGINT AS ids, count_if(is_buyer_maker) AS sold FROM trades GROUP BY 1, 2, 3", "trades"))
def s7(spark: SparkSession, sf: str) -> DataFrame:
    """Raw lines archived by a stream as compressed text and read back, line by line."""
    at = work_dir(spark)
    trades = R.event_trades(table_stream(spark, f"{sf}/events.parquet"))
    raw = trades.select(F.to_json(F.struct("trade_id", X.side_of("is_buyer_maker").alias("side"))).alias("value"), *KEY, "ts")
    ST.raw_archive(raw, f"{at}/raw", f"{at}/state", every=None).start().awaitTermination()
    lines = R.read_raw_trades(spark, f"{at}/raw").select("path", F.json_tuple("value", "trade_id", "side").alias("trade_id", "side"))
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("trade_id").cast("long")).alias("ids"), F.count_if(F.col("side") == "sell").alias("sold"))
    return _days(files.withColumns(X.path_parts("path")).groupBy(*KEY, "day").agg(*[F.sum(c).alias(c) for c in ("lines", "ids", "sold")]))


@query("c12_derivatives", with_ctes(
    f"SELECT symbol, {r('m / 1000000', 8)} AS rate, {r('m / 1000000 * 3.0 * 365.0', 4)} AS annualised, CASE WHEN m / 1000000 > 0.0001 THEN 'bullish' ELSE 'neutral' END AS signal, {r('n / 100.0', 4)} AS ratio, CASE WHEN n / 100.0 > 1.1 THEN 'longs_dominant' WHEN n / 100.0 < 0.9 THEN 'shorts_dominant' ELSE 'balanced' END AS balance, {r('m', 2)} AS mark_price FROM (SELECT symbol, max(price) AS m, count(*) % 200 AS n FROM trades GROUP BY 1)", "trades"))
def c12(spark: SparkSession, sf: str) -> DataFrame:
    """Landed records per symbol, made from the largest price and the number of trades."""
    s = Z.trades(spark, sf).groupBy("symbol").agg(F.max("price").alias("m"), (F.count(F.lit(1)) % 200).alias("n"))
    text = lambda c: c.cast("string")
    kinds = {
        "funding": F.to_json(F.array(F.struct(text(F.col("m") / 1000000).alias("fundingRate"), F.lit(1704067200000).alias("fundingTime")))),
        "long_short": F.to_json(F.array(F.struct(text(F.col("n") / 100.0).alias("longShortRatio")))),
        "ticker": F.to_json(F.struct(text(F.col("m")).alias("lastPrice"), F.lit("1.5").alias("priceChangePercent"))),
    }
    raw = s.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("x")).select("symbol", "x.*")
    d = R.derivatives(raw)
    return d.select("symbol", X.round_half_away("funding.rate", 8).alias("rate"), F.col("funding.rate_8h_annualised").alias("annualised"), F.col("funding.signal").alias("signal"), F.col("long_short_ratio.value").alias("ratio"), F.col("long_short_ratio.signal").alias("balance"), "mark_price")


# --- streams


def _to_end(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Start a stream with RocksDB state and wait for its end."""
    with rocksdb(spark):
        q = writer.start()
    q.awaitTermination()


def _to_folder(rows: DataFrame, at: str) -> DataStreamWriter:
    return rows.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)


@query("r4_stream_fill", with_ctes(f"SELECT exchange, symbol, t, {rs('close', 'volume_base')}, trade_count, source FROM filled", "filled"))
def r4(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars as a stream through the stateful gap filler."""
    at = work_dir(spark)
    bars = Z.bars(spark, sf).select(*BARS_SCHEMA.fieldNames())
    bars.write.parquet(f"{at}/bars.parquet")
    _to_end(spark, _to_folder(ST.stream_fill(table_stream(spark, f"{at}/bars.parquet"), Z.HOUR), at))
    return spark.read.schema(BARS_SCHEMA).parquet(f"{at}/out").select(*KEY, t(), *rr("close", "volume_base"), "trade_count", "source")


@query("r4_stream_fill_disorder", with_ctes(
    f"SELECT exchange, symbol, t, {r('close')} AS close, trade_count, 1 AS times FROM bars UNION ALL SELECT exchange, symbol, unnest(range(t + 3600, nxt, 3600)), {r('close')}, 0, 1 FROM ahead WHERE nxt - t > 3600", "bars",
    {"ahead": "SELECT *, lead(t, 1, (SELECT max(t) + 3600 FROM bars)) OVER (PARTITION BY exchange, symbol ORDER BY t) AS nxt FROM bars"}))
def r4_disorder(spark: SparkSession, sf: str) -> DataFrame:
    """The filler over four batches, each stopped and gone on with: every seventh bar comes a batch late, every fifth once more; a last bar closes the stream."""
    at, bars = work_dir(spark), Z.bars(spark, sf).select(*BARS_SCHEMA.fieldNames())
    first, last = bars.agg(F.unix_seconds(F.min("window_start")), F.unix_seconds(F.max("window_start"))).first()
    sec, third = F.unix_seconds("window_start"), (last - first) // 3 + 1
    part = F.floor((sec - first) / third)
    arrives = part + (F.floor(sec / Z.HOUR) % 7 == 3).cast("int")
    again = F.when(F.floor(sec / Z.HOUR) % 5 == 1, arrives + 1).otherwise(-1)
    delay = 2 * third
    closing = bars.limit(1).withColumns({"exchange": F.lit(ST.CLOSING), "window_start": F.timestamp_seconds(F.lit(last + Z.HOUR + delay))})
    rows = bars.withColumn("batch", F.explode(F.array(arrives, again))).unionByName(closing.withColumn("batch", F.lit(4).cast("long"))).where("batch >= 0")

    def start(stream: DataFrame) -> DataStreamWriter:
        return _to_folder(ST.stream_fill(stream.withWatermark("window_start", f"{delay} seconds"), Z.HOUR, timer=True), at)

    _batches_of(spark, rows, [F.col("batch") == k for k in range(5)], start)
    out = spark.read.schema(BARS_SCHEMA).parquet(f"{at}/out").where(F.col("exchange") != ST.CLOSING)
    return out.groupBy(*KEY, t()).agg(F.round(F.max("close"), 6).alias("close"), F.max("trade_count").alias("trade_count"), F.count(F.lit(1)).cast("int").alias("times"))


#: One exchange falls silent eight days before the end; `kept` are the bars of all exchanges with that.
_SILENT = {
    "kept": "SELECT * FROM bars WHERE exchange <> 'beta' OR t < (SELECT max(t) - 700000 FROM bars)",
    "ahead": "SELECT *, lead(t, 1, (SELECT CAST(ceil((max(t) - 60) / 3600.0) AS BIGINT) * 3600 FROM kept)) OVER (PARTITION BY exchange, symbol ORDER BY t) AS nxt FROM kept",
}


@query("r4_stream_fill_timer", with_ctes(f"SELECT exchange, symbol, t, {r('close')} AS close, trade_count FROM kept UNION ALL SELECT exchange, symbol, unnest(range(t + 3600, nxt, 3600)), {r('close')}, 0 FROM ahead WHERE nxt - t > 3600", "bars", _SILENT))
def r4_timer(spark: SparkSession, sf: str) -> DataFrame:
    """The stateful filler with its timer: a silent exchange gets empty bars as far as event time goes on without it."""
    at, bars = work_dir(spark), Z.bars(spark, sf).select(*BARS_SCHEMA.fieldNames())
    end = bars.agg(F.unix_seconds(F.max("window_start"))).first()[0]
    bars.where((F.col("exchange") != "beta") | (F.unix_seconds("window_start") < end - 700_000)).write.parquet(f"{at}/bars.parquet")
    stream = table_stream(spark, f"{at}/bars.parquet").withWatermark("window_start", "60 seconds")
    _to_end(spark, _to_folder(ST.stream_fill(stream, Z.HOUR, timer=True), at))
    return spark.read.schema(BARS_SCHEMA).parquet(f"{at}/out").select(*KEY, t(), *rr("close"), "trade_count")


@query("r6_stream_filter", with_ctes("SELECT exchange, symbol, CASE WHEN is_buyer_maker THEN 'sell' ELSE 'buy' END AS side, count(*) AS n FROM trades WHERE symbol IN ('CLICK', 'PURCHASE') GROUP BY 1, 2, 3", "trades"))
def r6(spark: SparkSession, sf: str) -> DataFrame:
    at = work_dir(spark)
    trades = R.event_trades(table_stream(spark, f"{sf}/events.parquet"))
    q = ST.stream_filter(trades, ["CLICK", "PURCHASE"]).writeStream.format("json").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    m = spark.read.schema("message string").json(f"{at}/out")
    get = lambda k: F.get_json_object("message", f"$.{k}").alias(k)
    return m.select(get("exchange"), get("symbol"), get("side")).groupBy("exchange", "symbol", "side").agg(F.count(F.lit(1)).alias("n"))


def _batches_of(spark: SparkSession, trades: DataFrame, parts: list[Column], start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Run a stream over some parts of the trades, each a batch of its own (of any number of files): the stream stops and goes on from its checkpoint."""
    path = f"{work_dir(spark)}/arriving"
    for part in parts:
        trades.where(part).write.mode("append").parquet(path)
        _to_end(spark, start(spark.readStream.schema(trades.schema).parquet(path)))


_THIRD = "(SELECT min(epoch_us(ts)) // 1000000 + 700000 FROM trades)"


@query("r8_live_candle", with_ctes(f"SELECT exchange, symbol, t, {rs('open', 'high', 'low', 'close', 'volume_base')}, trade_count FROM bars", "bars"))
def r8(spark: SparkSession, sf: str) -> DataFrame:
    """History up to a moment inside an hour; a stream merges the later trades on, in three batches."""
    trades = Z.trades(spark, sf)
    sec, mid = F.unix_seconds("ts"), trades.agg(F.unix_seconds(F.max("ts")) - 200_000).first()[0]
    history, root = B.trades_to_bars(trades.where(sec < mid), Z.HOUR), work_dir(spark)
    steps = [(sec >= mid + a) & (sec < mid + b) for a, b in ((0, 70_001), (70_001, 141_000), (141_000, 1 << 40))]
    _batches_of(spark, trades, steps, lambda s: ST.live_candle_stream(s, history, root, f"{root}/state", Z.HOUR))
    return ST.newest_candles(spark, history, root).select(*KEY, t(), *rr("open", "high", "low", "close", "volume_base"), "trade_count")


#: As in _ALL, but bars without filling may be fewer than a window has rows.
_SHORT = "SELECT exchange, symbol, rn, " + ", ".join(f"CASE WHEN rn >= {n} THEN {f} OVER (PARTITION BY exchange, symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {k}" for k, f, n in (("s20", "avg(close)", 20), ("s50", "avg(close)", 50), ("s200", "avg(close)", 200), ("sd", "stddev_pop(close)", 20))) + " FROM rn"


@query("r8_live_indicators", with_ctes(f"SELECT exchange, symbol, ts, rsi, macd_hist, bb_position, sma_trend, regime FROM ({_DOC_SQL})", "lab1", {"labelled": "SELECT * FROM bars"} | _ALL | {"w": _SHORT}, True))
def r8_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """The indicators that the same stream refreshed last for each series, from the sums in its state."""
    trades = Z.trades(spark, sf)
    sec, mid = F.unix_seconds("ts"), trades.agg(F.unix_seconds(F.max("ts")) - 400_000).first()[0]
    history, root = B.trades_to_bars(trades.where(sec < mid), Z.HOUR), work_dir(spark)
    _batches_of(spark, trades, [(sec >= mid) & (sec < mid + 200_000), sec >= mid + 200_000], lambda s: ST.live_candle_stream(s, history, root, f"{root}/state", Z.HOUR))
    return ST.newest_indicators(spark, root).select(*KEY, "ts", "rsi", "macd_hist", "bb_position", "sma_trend", "regime")


#: Every tenth trade arrives in the last of three batches; the others come in two, by time.
_ARRIVAL = {
    "arriving": f"SELECT *, epoch_us(ts) // 1000000 AS s, CASE WHEN trade_id % 10 = 0 THEN 2 WHEN epoch_us(ts) // 1000000 < {_THIRD} THEN 0 ELSE 1 END AS batch FROM trades",
    "seen": "SELECT *, CASE batch WHEN 0 THEN NULL WHEN 1 THEN (SELECT max(s) FROM arriving WHERE batch < 1) ELSE (SELECT max(s) FROM arriving WHERE batch < 2) END - 100000 AS lim FROM arriving",
}


def _arriving(spark: SparkSession, sf: str) -> str:
    """A stream over trades that come late in part, with bars and late trades below a folder."""
    trades, root = Z.trades(spark, sf), work_dir(spark)
    third = trades.agg(F.unix_seconds(F.min("ts")) + 700_000).first()[0]
    last = F.col("trade_id") % 10 == 0
    steps = [~last & (F.unix_seconds("ts") < third), ~last & (F.unix_seconds("ts") >= third), last]
    _batches_of(spark, trades, steps, lambda s: ST.late_stream(s, root, f"{root}/state", Z.HOUR, 100_000))
    return root


@query("r10_late_rows", with_ctes("SELECT exchange, symbol, count(*) AS late, max(lim - s) AS most_seconds FROM seen WHERE s < lim GROUP BY 1, 2", "trades", _ARRIVAL))
def r10(spark: SparkSession, sf: str) -> DataFrame:
    """Late trades of a stream, counted by series."""
    return ST.late_counts(spark, _arriving(spark, sf))


@query("r10_bars_in_time", with_ctes("SELECT exchange, symbol, s // 3600 * 3600 AS t, max(price) AS high, count(*) AS trade_count FROM seen WHERE lim IS NULL OR s >= lim GROUP BY 1, 2, 3", "trades", _ARRIVAL))
def r10_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of the trades in time, over all batches."""
    bars = spark.read.schema("window_start timestamp, exchange string, symbol string, high double, trade_count long").parquet(f"{_arriving(spark, sf)}/bars")
    return bars.groupBy(*KEY, t()).agg(F.max("high").alias("high"), F.sum("trade_count").alias("trade_count"))


@query("r10_corrected_bars", with_ctes(f"SELECT exchange, symbol, t, {rs('open', 'high', 'low', 'close', 'volume_base')}, trade_count FROM bars", "bars"))
def r10_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with the corrections that late trades made: the bars of all trades."""
    return ST.current_candles(_corrections(spark, sf, 5000)).select(*KEY, t(), *rr("open", "high", "low", "close", "volume_base"), "trade_count")


@query("r10_changes", with_ctes("SELECT exchange, symbol, s // 3600 * 3600 AS t, count(*) AS trades_left, count(DISTINCT batch) - 1 AS retracted, count(DISTINCT batch) - 1 AS newest_revision FROM arriving GROUP BY 1, 2, 3", "trades", _ARRIVAL))
def r10_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts less retractions plus replacements: what is left of each bar, and how often it was taken back."""
    sign = F.when(F.col("kind") == "retract", -1).otherwise(1)
    return _corrections(spark, sf, 5000).groupBy(*KEY, t()).agg(F.sum(sign * F.col("trade_count")).alias("trades_left"), F.count_if(F.col("kind") == "retract").alias("retracted"), F.max("revision").alias("newest_revision"))


_KEPT = {
    "newest": "SELECT exchange, symbol, t FROM (SELECT DISTINCT exchange, symbol, s // 3600 * 3600 AS t, dense_rank() OVER (PARTITION BY exchange, symbol ORDER BY s // 3600 DESC) AS k FROM arriving WHERE batch < 2) WHERE k = 24",
}


@query("r10_too_late", with_ctes("SELECT exchange, symbol, count(*) AS late, max(t - s) AS most_seconds FROM arriving JOIN newest USING (exchange, symbol) WHERE batch = 2 AND s < t GROUP BY 1, 2", "trades", _ARRIVAL | _KEPT))
def r10_too_late(spark: SparkSession, sf: str) -> DataFrame:
    """Trades older than the newest 24 bars of their series amend nothing: they are counted."""
    late = _corrections(spark, sf, 24).where("kind = 'late'")
    return late.groupBy(*KEY).agg(F.sum("trade_count").alias("late"), F.max("seconds_late").alias("most_seconds"))


def _corrections(spark: SparkSession, sf: str, keep: int) -> DataFrame:
    """The changes of bars by a stream over trades that come late in part, in three batches."""
    trades, root = Z.trades(spark, sf), work_dir(spark)
    third = trades.agg(F.unix_seconds(F.min("ts")) + 700_000).first()[0]
    last = F.col("trade_id") % 10 == 0
    steps = [~last & (F.unix_seconds("ts") < third), ~last & (F.unix_seconds("ts") >= third), last]
    _batches_of(spark, trades, steps, lambda s: ST.live_candle_stream(s, None, f"{root}/out", f"{root}/state", Z.HOUR, keep, indicators=False))
    return ST.changes_below(spark, f"{root}/out")


@query("r5_stream_sink", with_ctes(f"SELECT exchange, symbol, t, {rs(*PRICES)}, trade_count, 1 AS times FROM bars", "bars"))
def r5(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of a stream appended to a lake, in three runs that each go on from the checkpoint; a last trade closes the stream, so every bar comes, once."""
    trades, root = Z.trades(spark, sf), work_dir(spark)
    first, last = trades.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    closing = ST.closing_trade(spark, last + Z.HOUR, 60)
    sec, end = F.unix_seconds("ts"), F.col("exchange") == ST.CLOSING
    steps = [~end & (sec < first + 700_000), ~end & (sec >= first + 700_000), end]
    _batches_of(spark, trades.unionByName(closing.select(*trades.columns)), steps, lambda s: ST.sink(ST.stream_bars(s, {}, Z.HOUR), f"{root}/lake", f"{root}/state", every=None))
    bars = L.read_bars(spark, f"{root}/lake")
    return bars.groupBy(*KEY, t()).agg(*[F.max(c).alias(c) for c in (*PRICES, "trade_count")], F.count(F.lit(1)).cast("int").alias("times")).select(*KEY, "t", *rr(*PRICES), "trade_count", "times")


def _connection_stream(spark: SparkSession, sf: str, watermark: int, after: int, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Connection events as a stream of three runs; the last one brings an event `after` seconds beyond all others, which closes the stream."""
    events = _connections(spark, sf)
    low, high = events.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    closing = events.limit(1).select(F.lit(ST.CLOSING).alias("exchange"), F.lit("reconnect").alias("event"), F.timestamp_seconds(F.lit(high + watermark + after + 1)).alias("ts"))
    end, sec = F.col("exchange") == ST.CLOSING, F.unix_seconds("ts")
    steps = [~end & (sec < (low + high) // 2), ~end & (sec >= (low + high) // 2), end]
    _batches_of(spark, events.select("exchange", "event", "ts").unionByName(closing), steps, lambda s: start(s.withWatermark("ts", f"{watermark} seconds")))


@query("r9_stream_gaps", with_ctes(
    f"SELECT exchange, epoch_us(ts) AS gap_start, CASE WHEN epoch_us(u) - epoch_us(ts) <= 600000000 THEN {r('(epoch_us(u) - epoch_us(ts)) / 1e6', 3)} END AS gap_seconds FROM (SELECT *, min(CASE WHEN event = 'reconnect' THEN ts END) OVER (PARTITION BY exchange ORDER BY ts, event ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM conn) WHERE event = 'disconnect'", "trades", _CONN))
def r9_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Disconnects of a stream paired with the next reconnect; without one for ten minutes they stay unanswered."""
    at = work_dir(spark)
    _connection_stream(spark, sf, 60, 700, lambda e: _to_folder(disconnect_gap_stream(e, 600.0), at))
    out = spark.read.schema("exchange string, gap_start timestamp, gap_end timestamp, gap_seconds double").parquet(f"{at}/out")
    return out.select("exchange", F.unix_micros("gap_start").alias("gap_start"), *rr("gap_seconds", digits=3))


@query("r9_stream_requests", with_ctes(
    """SELECT epoch_us(min(ts)) AS from_us, epoch_us(max(ts)) AS to_us, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges, count(*) AS n_events FROM
      (SELECT *, sum(new) OVER (ORDER BY ts, exchange ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT exchange, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, exchange) <= 60000000 THEN 0 ELSE 1 END AS new FROM conn WHERE event = 'reconnect')) GROUP BY k""", "trades", _CONN))  # fmt: skip
def r9_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Reconnects of a stream debounced to back-fill requests by session windows."""
    at = work_dir(spark)
    _connection_stream(spark, sf, 60, 200, lambda e: _to_folder(request_stream(e.where("event = 'reconnect'"), 60), at))
    out = spark.read.schema("from_ts timestamp, to_ts timestamp, exchanges array<string>, n_events long").parquet(f"{at}/out")
    return out.select(F.unix_micros("from_ts").alias("from_us"), F.unix_micros("to_ts").alias("to_us"), F.concat_ws(",", "exchanges").alias("exchanges"), "n_events")


# --- the newest days of a lake


_RECENT = "SELECT * FROM ({}) QUALIFY t > max(t) OVER (PARTITION BY exchange, symbol) - {} AND row_number() OVER (PARTITION BY exchange, symbol ORDER BY t DESC) <= {}"


@query("c11_lake_indicators", with_ctes(_DOC_SQL, "lab1", {"labelled": _RECENT.format(Z.CTES["labelled"], 301 * 3600, 300)} | _ALL, True))
def c11_lake(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators of the last 300 hours of a lake; the scan is pruned to the days that hold them."""
    root, _ = _lake(spark, sf)
    return M.lake_indicators(spark, root, Z.HOUR, 300, complete=False).withColumn("price", X.round_half_away("price", 6))


@query("c16_lake_bars_latest", with_ctes(f"SELECT exchange, symbol, t // 14400 * 14400 AS t4, {r('max(high)')} AS high, {r('min(low)')} AS low, sum(trade_count)::BIGINT AS trade_count FROM near WHERE symbol = 'CLICK' GROUP BY 1, 2, 3 ORDER BY t4 DESC, exchange LIMIT 50", "labelled",
    {"near": "SELECT * FROM labelled QUALIFY t > max(t) OVER (PARTITION BY exchange, symbol) - 51 * 14400"}))
def c16_lake(spark: SparkSession, sf: str) -> DataFrame:
    """The newest four-hour bars of a symbol from the newest days of a lake."""
    root, _ = _lake(spark, sf)
    rows = M.lake_bars_latest(spark, root, "CLICK", "4h", 14400, 50)
    return rows.select(*KEY, F.unix_seconds(F.to_timestamp("ts")).alias("t4"), *rr("high", "low"), "trade_count")


@query("k2_overlapping_ranges", with_ctes(
    "SELECT exchange, symbol, t FROM bars JOIN (SELECT exchange, symbol, min(t) AS lo FROM bars GROUP BY 1, 2) USING (exchange, symbol) WHERE t BETWEEN lo + 3600 AND lo + 200000 OR t BETWEEN lo + 100000 AND lo + 260000 OR t BETWEEN lo + 432000 AND lo + 432000 OR t BETWEEN lo + 600000 AND lo + 610000", "bars"))
def k2_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Back-fill of ranges that overlap, repeat and go over midnight: each bar once."""
    root, bars = f"{work_dir(spark)}/lake", Z.bars(spark, sf)
    lo = bars.groupBy(*KEY).agg(F.unix_seconds(F.min("window_start")).alias("lo"))
    ends = [(3600, 200_000), (100_000, 260_000), (100_000, 260_000), (432_000, 432_000), (600_000, 610_000), (9, 8)]
    each = F.explode(F.array(*[F.struct((F.col("lo") + a).alias("start_s"), (F.col("lo") + b).alias("end_s")) for a, b in ends]))
    L.write_backfill(bars, lo.select(*KEY, each.alias("x")).select(*KEY, "x.*"), root)
    return L.read_bars(spark, root).select(*KEY, t())


# --- reports: their tables, one query each


def _gap_table(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return M.gap_report(Z.labelled(spark, sf), Z.HOUR)[name]


@query("c19_gap_report", with_ctes(f"SELECT exchange, symbol, gap_start, duration_sec, {_CAUSE} AS cause FROM gaps ORDER BY duration_sec DESC, exchange, symbol, gap_start LIMIT 200", "gaps"))
def c19(spark: SparkSession, sf: str) -> DataFrame:
    """The longest gaps, at most 200."""
    return _gap_table("longest", spark, sf).select(*KEY, t("gap_start", "gap_start"), "duration_sec", "cause")


@query("c19_gap_coverage", with_ctes(f"SELECT exchange, symbol, bars, gap_count, gap_sec, {r('(span_sec - gap_sec) * 100.0 / span_sec')} AS coverage_pct FROM cover", "gaps", {"cover": _COVER}))
def c19_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_table("coverage", spark, sf).select(*KEY, "bars", "gap_count", "gap_sec", *rr("coverage_pct"))


@query("c19_gap_causes", with_ctes(f"SELECT cause, count(*) AS n_gaps, sum(duration_sec)::BIGINT AS total_sec, {r('avg(duration_sec)', 3)} AS avg_sec FROM (SELECT *, {_CAUSE} AS cause FROM gaps) GROUP BY 1", "gaps"))
def c19_causes(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_table("causes", spark, sf).select("cause", "n_gaps", "total_sec", *rr("avg_sec", digits=3))


@query("c19_gap_overall", with_ctes("SELECT count(*) AS bars, count(DISTINCT exchange) AS exchanges, count(DISTINCT symbol) AS symbols, (SELECT sum(span_sec)::BIGINT FROM cover) AS span_sec, (SELECT sum(gap_count)::BIGINT FROM cover) AS gaps FROM labelled", "gaps", {"cover": _COVER}))
def c19_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_table("overall", spark, sf).select("bars", "exchanges", "symbols", "span_sec", "gaps")


@query("c19_gap_outages", with_ctes(
    """SELECT min(s) AS start, max(e) AS "end", count(*) AS n_gaps, count(DISTINCT k) AS num_affected, string_agg(DISTINCT exchange, ',' ORDER BY exchange) AS exchanges FROM
        (SELECT *, sum(new) OVER (ORDER BY s, e, exchange, symbol ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, exchange || '/' || symbol AS k, CASE WHEN s <= max(e) OVER (ORDER BY s, e, exchange, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 30 THEN 0 ELSE 1 END AS new FROM
          (SELECT exchange, symbol, gap_start AS s, gap_end AS e FROM gaps))) GROUP BY c HAVING count(*) > 1""", "gaps"))  # fmt: skip
def c19_outages(spark: SparkSession, sf: str) -> DataFrame:
    return _gap_table("outages", spark, sf).select("start", "end", "n_gaps", "num_affected", F.concat_ws(",", "exchanges").alias("exchanges"))


_DAILY_QUALITY = "SELECT d.exchange, d.symbol, coalesce(total, 0) AS total, with_trades, ws_live, empty FROM dim d LEFT JOIN (SELECT exchange, symbol, count(*) AS total, count_if(trade_count > 0) AS with_trades, count_if(source = 'live') AS ws_live, count_if(source = 'empty') AS empty FROM labelled, clock WHERE t >= now - 48 * 3600 GROUP BY 1, 2) USING (exchange, symbol)"
_DAILY_GAPS = "SELECT exchange, symbol, count(*) AS n_gaps, count_if(d >= 600) AS significant, max(d) AS longest_sec FROM (SELECT exchange, symbol, t - lag(t) OVER (PARTITION BY exchange, symbol ORDER BY t) AS d FROM labelled, clock WHERE t >= now - 172800) WHERE d > 60 GROUP BY 1, 2"


def _daily_table(name: str, spark: SparkSession, sf: str) -> DataFrame:
    bars = Z.labelled(spark, sf)
    return M.daily_report(bars, Z.dim(spark, sf), Z.bounds(bars)[2])[name]


@query("c19_daily_quality", with_ctes(_DAILY_QUALITY, "clock"))
def c19_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_table("quality", spark, sf).select(*KEY, F.col("total").cast("long").alias("total"), "with_trades", "ws_live", "empty")


@query("c19_daily_gaps", with_ctes(_DAILY_GAPS, "clock"))
def c19_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_table("gaps", spark, sf).select(*KEY, "n_gaps", "significant", "longest_sec")


@query("c19_daily_alerts", with_ctes("SELECT 'LOW LIVE DATA' AS kind, exchange || '/' || symbol AS subject, CAST(ws_live AS DOUBLE) AS value FROM dq WHERE total > 0 AND ws_live < total * 0.1 / 100 UNION ALL SELECT 'GAP', exchange || '/' || symbol, CAST(longest_sec AS DOUBLE) FROM dg WHERE significant > 0", "clock", {"dq": _DAILY_QUALITY, "dg": _DAILY_GAPS}))
def c19_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_table("alerts", spark, sf)


@query("c19_daily_age", with_ctes("SELECT 0.0::DOUBLE AS age_minutes, max(t) AS last_bar FROM labelled", "labelled"))
def c19_age(spark: SparkSession, sf: str) -> DataFrame:
    return _daily_table("age", spark, sf).select(F.col("age_minutes").cast("double").alias("age_minutes"), t("last_bar", "last_bar"))
