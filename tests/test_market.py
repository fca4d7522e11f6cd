"""Bars, gaps, indicators, audits, lake and streams on hand-made series and against plain loops."""

from __future__ import annotations

import json
import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketbars.functions import columns as X
from marketbars.functions import signals as S
from marketbars.operators import audit as A
from marketbars.operators import bars as B
from marketbars.operators import gaps as G
from marketbars.operators import indicators as I
from marketbars.operators import planning as P
from marketbars.plans import market as M
from marketbars.schema import BARS_SCHEMA, TRADE_SCHEMA
from marketbars.sources import lake as L
from marketbars.sources import trades as R
from marketbars.streaming import bars as ST

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def bar(sec: int, close: float = 10.0, series: str = "e/s", source: str = "live", volume: float = 1.0, n: int = 1, **more) -> tuple:
    e, s = series.split("/")
    row = {"open": close, "high": close, "low": close} | more
    return (at(sec), e, s, row["open"], row["high"], row["low"], close, volume, close * volume, n, close, 0.0, 0.0, 0.0, source)


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, BARS_SCHEMA)


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_trades_to_bars_and_fill(spark):
    rows = [("e", "s", p, q, at(t), False, i) for i, (t, p, q) in enumerate([(1, 5.0, 2.0), (1, 7.0, 1.0), (59, 3.0, 0.0), (200, 9.0, 0.0), (86400 * 2, 4.0, 1.0)])]
    bars = B.trades_to_bars(spark.createDataFrame(rows, TRADE_SCHEMA), 60)
    got = {r.window_start: r for r in bars.collect()}
    first = got[at(0)]
    assert (first.open, first.high, first.low, first.close, first.trade_count) == (5.0, 7.0, 3.0, 3.0, 3)
    assert first.vwap == pytest.approx(17 / 3) and got[at(180)].vwap == 9.0  # no volume: the close
    full = B.fill_empty_bars(bars, 60)
    assert full.count() == 2880 + 1 and full.select("window_start").distinct().count() == 2881
    assert full.where("source = 'empty'").select("close").distinct().count() == 2
    assert G.find_gaps(full, 60).count() == 0
    total = lambda df: df.agg(F.sum("volume_base")).first()[0]
    assert total(B.resample_bars(full, 3600)) == total(bars)
    assert B.trades_to_bars(spark.createDataFrame([], TRADE_SCHEMA), 60).count() == 0
    assert B.fill_empty_bars(bars.limit(0), 60).count() == 0


def test_resample_twice_is_resample(make):
    rnd = random.Random(1)
    bars = make([bar(60 * i, rnd.uniform(1, 9), volume=rnd.uniform(0, 3), n=i % 3) for i in range(500)])
    a = B.resample_bars(bars, 3600)
    b = B.resample_bars(B.resample_bars(bars, 600).withColumn("source", F.lit("live")), 3600)
    keys = ("window_start", "open", "high", "low", "close", "trade_count")
    assert values(a, *keys) == values(b, *keys)


def test_dedup_and_source_default(make):
    bars = make([bar(0, 1.0, source="backfill_1m"), bar(0, 2.0), bar(60, 3.0, source="empty"), bar(60, 4.0, source="backfill_1s")])
    assert values(B.dedup_bars(bars), "close", "source") == [(2.0, "live"), (4.0, "backfill_1s")]
    assert values(B.with_source_default(bars.drop("source")), "source")[0] == ("unknown",)


def loop_ema(x: list[float], n: int, a: float, start: int = 0) -> list[float | None]:
    out: list[float | None] = [None] * len(x)
    if len(x) >= start + n:
        y = sum(x[start : start + n]) / n
        out[start + n - 1] = y
        for i in range(start + n, len(x)):
            y = a * x[i] + (1 - a) * y
            out[i] = y
    return out


@pytest.mark.parametrize("rows", [5, 14, 15, 26, 40, 7000])
def test_indicators_against_loops(make, rows):
    rnd = random.Random(rows)
    close, series = 100.0, []
    for _ in range(rows):
        close = max(1.0, close + rnd.uniform(-1, 1))
        series.append(close)
    df = make([bar(60 * i, c) for i, c in enumerate(series)])
    got = sorted(I.all_indicators(df).collect(), key=lambda r: r.rn)
    assert [r.rn for r in got] == list(range(1, rows + 1))
    fast, slow = loop_ema(series, 12, 2 / 13), loop_ema(series, 26, 2 / 27)
    line = [f - s if s is not None else None for f, s in zip(fast, slow, strict=True)]
    signal = loop_ema([v or 0.0 for v in line], 9, 0.2, 25)
    diff = [0.0] + [b - a for a, b in zip(series, series[1:], strict=False)]
    up, down = loop_ema([max(d, 0) for d in diff], 14, 1 / 14, 1), loop_ema([max(-d, 0) for d in diff], 14, 1 / 14, 1)
    rsi = [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down, strict=True)]
    close_to = lambda a, b: (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    for i, r in enumerate(got):
        assert close_to(r.ema_fast, fast[i]) and close_to(r.ema_slow, slow[i]) and close_to(r.macd, line[i]) and close_to(r.macd_signal, signal[i]) and close_to(r.rsi, rsi[i]), i
        assert close_to(r.sma20, sum(series[i - 19 : i + 1]) / 20 if i >= 19 else None)


def test_constant_prices(make):
    r = max(I.all_indicators(make([bar(60 * i, 5.0) for i in range(40)])).collect(), key=lambda r: r.rn)
    assert r.rsi == 100.0 and r.bb_upper == r.bb_lower == 5.0
    d = M.indicators(make([bar(60 * i, 5.0) for i in range(40)]), 60).collect()[0]
    assert d.bb_position == 0.5 and d.sma_trend == "mixed" and d.n_bars == 39


def test_period_one_and_long_period(make):
    series = [float(i % 7) for i in range(900)]
    rows = I.with_row_number(make([bar(60 * i, c) for i, c in enumerate(series)]))
    got = sorted(I.ema(rows, "close", {"one": 1, "long": 300}).collect(), key=lambda r: r.rn)
    assert [r.one for r in got] == series
    expected = loop_ema(series, 300, 2 / 301)
    assert all(e is None and r.long is None or math.isclose(r.long, e, rel_tol=1e-9) for r, e in zip(got, expected, strict=True))


def test_regime_table(spark):
    rows = [(b, t) for t in range(9) for b in range(t + 1)]
    df = spark.createDataFrame(rows, "b long, t long")
    got = {(r.b, r.t): r for r in df.select("b", "t", S.regime_label(F.col("b"), F.col("t")).alias("l"), S.regime_label(F.col("b"), F.col("t"), True).alias("sym"), S.regime_confidence(F.col("b"), F.col("t")).alias("c")).collect()}
    assert got[5, 5].l == "bullish_momentum" and got[0, 6].l == "bearish_bias" and got[0, 6].sym == "bearish_momentum" and got[3, 6].l == "neutral_ranging"
    assert not [k for k, r in got.items() if r.l == "bearish_momentum" and k[1] >= 5]
    assert not [k for k, r in got.items() if r.c == "low" and k[1] >= 5]


def test_signals(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [val(S.rsi_note(lit(v))) for v in (20.0, 35.0, 50.0, 65.0, 80.0, None)] == ["approaching support", "approaching oversold", "mid-range", "approaching overbought", "approaching resistance", "mid-range"]
    assert [val(S.macd_direction(lit(h), lit(p))) for h, p in ((2.0, 1.0), (1.0, 2.0), (-1.0, -2.0), (-2.0, -1.0), (0.0, 1.0), (None, None))] == ["bullish_accelerating", "bullish_weakening", "bearish_weakening", "bearish_accelerating", "neutral", "neutral"]
    assert [val(S.macd_crossover(lit(m), lit(s))) for m, s in ((1.0, 0.9995), (0.9995, 1.0), (2.0, 1.0))] == ["bullish_crossover", "bearish_crossover", "none"]
    null = lit(None).cast("double")
    assert val(S.ema_signal(lit(2.0), lit(1.0), null, null, lit(1.0))) == "bullish_crossover"
    assert val(S.ema_signal(lit(2.0), lit(1.0), lit(3.0), lit(2.0), lit(1.0))) == "bullish"
    assert val(S.sma_trend(lit(4.0), lit(3.0), lit(2.0), lit(1.0))) == "bullish_aligned" and val(S.sma_trend(lit(4.0), null, null, null)) == "mixed"
    b, t, basis = S.funding_vote(lit(3), lit(5), lit(-0.1))
    assert (val(b), val(t), val(basis)) == (3, 7, "negative_funding")


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("x")).first()["x"]
    assert [val(X.fmt_dur(F.lit(s), "padded")) for s in (59, 65, 7380, 93600)] == ["59s", "1m 05s", "2h 03m", "1d 02h"]
    assert [val(X.fmt_dur(F.lit(s), "tight")) for s in (65, 93600)] == ["1m05s", "26h00m"]
    assert val(X.fmt_dur(F.lit(93600), "no_days")) == "26h 0m"
    assert [val(X.fmt_uptime(F.lit(s))) for s in (59, 3660, 90000)] == ["0m", "1h 1m", "1d 1h"]
    assert [val(X.fmt_bytes(F.lit(n))) for n in (5, 2048, 5 << 20, 3 << 30)] == ["5 B", "2 KB", "5.0 MB", "3.00 GB"] and val(X.fmt_bytes(F.lit(1 << 19), False)) == "0.5 MB"
    assert [val(X.fmt_count(F.lit(n))) for n in (5, 1500, 2_500_000)] == ["5", "1.5K", "2.5M"]
    assert val(X.round_half_away(F.lit(1.005), 2)) == 1.0 and val(X.round_half_away(F.lit(-0.125), 2)) == -0.13
    assert val(X.lenient_double(F.lit("x"))) == 0.0 and val(X.lenient_double(F.lit("2.5"))) == 2.5
    assert val(X.iso_to_epoch_ms(F.lit("2024-01-01T00:00:01.500Z"), F.lit(7))) == 1704067201500 and val(X.iso_to_epoch_ms(F.lit("bad"), F.lit(7))) == 7
    assert X.parse_tf("4h") == 14400 and X.parse_tf("9x") == 300
    assert [val(X.fmt_price(F.lit(p))) for p in (123.456, 2.0, 0.5)] == ["123.46", "2.0000", "0.500000"]


def test_gaps_and_clusters(make, spark):
    a = [bar(t, series="e/a") for t in (0, 10, 100, 110)]
    b = [bar(t, series="f/b") for t in (0, 130, 400)]
    c = [bar(t, series="f/c") for t in (500, 1000)]
    gaps = G.find_gaps(make(a + b + c), 5)
    assert values(gaps, "symbol", "duration_sec") == [("a", 10), ("a", 10), ("a", 90), ("b", 130), ("b", 270), ("c", 500)]
    out = G.correlated_outages(gaps, 30).collect()
    assert [(r.n_gaps, r.num_affected, r.exchanges, r.end - r.start) for r in out] == [(5, 2, ["e", "f"], 400)]
    assert out[0].likely_cause == "Network switch"  # 100 s on average, two exchanges
    assert values(G.find_gaps(make([bar(86390), bar(86450)]), 50, within_day=True), "duration_sec") == [] and values(G.find_gaps(make([bar(86390), bar(86450)]), 50), "duration_sec") == [(60,)]
    touching = spark.createDataFrame([("e", "a", at(0), at(10), 10), ("e", "b", at(40), at(50), 10), ("e", "c", at(81), at(90), 9)], "exchange string, symbol string, gap_start timestamp, gap_end timestamp, duration_sec long")
    assert [r.n_gaps for r in G.correlated_outages(touching).collect()] == [2]


def test_file_gaps(spark):
    ranges = spark.createDataFrame([("e", "s", at(0), at(100)), ("e", "s", at(10), at(20)), ("e", "s", at(60), at(70))], "exchange string, symbol string, min_ts timestamp, max_ts timestamp")
    assert values(G.internal_file_gaps(ranges, 30), "duration_sec") == [(40,)] and G.internal_file_gaps(ranges, 30, running=True).count() == 0


def test_violations(make):
    bad = make([bar(0, 5.0, high=4.0), bar(60, 5.0, low=6.0, source="empty"), bar(120, 5.0, volume=-1.0), bar(180, 5.0, open=0.0)])
    r = A.ohlcv_violations(bad).collect()[0]
    assert r.status == "FAIL: high<low:2, high<open:1, high<close:1, low>open:1, neg_vol:1, zero_open:1"
    assert A.all_ok(A.ohlcv_violations(make([bar(0)]))).first().all_ok


def test_debounced_requests(spark):
    rnd = random.Random(9)
    events = [(rnd.choice("abc"), at(round(rnd.uniform(0, 3000), 3))) for _ in range(200)]
    expected, group = [], []
    for e, ts in sorted(events, key=lambda x: (x[1], x[0])):
        if group and (ts - group[-1][1]).total_seconds() > 5:
            expected.append(group)
            group = []
        group.append((e, ts))
    expected.append(group)
    got = G.debounced(spark.createDataFrame(events, "exchange string, ts timestamp"), 5)
    assert values(got, "from_ts", "to_ts", "exchanges", "n_events") == sorted((g[0][1], g[-1][1], sorted({e for e, _ in g}), len(g)) for g in expected)


def test_debounced_over_midnight(spark):
    day = 86400
    events = [("a", at(day - 2)), ("b", at(day + 3)), ("c", at(day + 20)), ("a", at(3 * day - 9)), ("b", at(3 * day))]
    got = G.debounced(spark.createDataFrame(events, "exchange string, ts timestamp"), 5)
    assert values(got, "from_ts", "to_ts", "exchanges", "n_events") == [(at(day - 2), at(day + 3), ["a", "b"], 2), (at(day + 20), at(day + 20), ["c"], 1), (at(3 * day - 9), at(3 * day - 9), ["a"], 1), (at(3 * day), at(3 * day), ["b"], 1)]


def test_bars_of_stream_are_the_streams_own(spark, monkeypatch):
    """What the stream doesn't emit isn't filled in from elsewhere."""
    from marketbars.streaming import runs

    events, full = "/root/testdata/sf0.001/events.parquet", runs.stream_bars
    whole = runs.bars_of_stream(spark, events, 3600)
    exchange = whole.first()["exchange"]
    monkeypatch.setattr(runs, "stream_bars", lambda trades, *args: full(trades.where(F.col("exchange") != exchange), *args))
    less = runs.bars_of_stream(spark, events, 3600)
    assert 0 < less.count() < whole.count() and less.where(F.col("exchange") == exchange).count() == 0


def test_pages_and_plans(spark, make):
    ranges = spark.createDataFrame([("e", "s", 0, 650), ("e", "t", 5, 5)], "exchange string, symbol string, start_s long, end_s long")
    assert values(P.plan_pages(ranges, 1, 300), "from_s", "to_s") == [(0, 300), (300, 600), (600, 650)]
    dim = spark.createDataFrame([("e", "s")], "exchange string, symbol string")
    days = P.plan_deep_backfill(make([bar(86400)]), dim, F.lit("2023-12-31").cast("date"), F.lit(at(3 * 86400 + 5)))
    assert [str(r.day) for r in days.orderBy("day").collect()] == ["2023-12-31", "2024-01-01", "2024-01-03"]


LINES = {
    "binance": {"stream": "btcusdt@trade", "data": {"p": "10.5", "q": "2", "m": True, "T": 1704067200123}},
    "bad": {"stream": "btcusdt@depth", "data": {"p": "1", "q": "2", "m": True, "T": 1}},
    "coinbase": {"type": "match", "product_id": "BTC-USD", "price": "10.5", "size": "2", "side": "sell", "time": "2024-01-01T00:00:00.123Z"},
    "kraken": {"channel": "trade", "data": [{"symbol": "BTC/USD", "price": 10.5, "qty": "2", "side": "buy", "timestamp": "2024-01-01T00:00:00.123Z"}, {"symbol": "BTC/USD", "price": "x", "qty": 1, "side": "buy", "timestamp": ""}]},
}


def test_parsers(spark):
    raw = spark.createDataFrame([(json.dumps(v),) for v in LINES.values()] + [("not json",), ("",)], "value string")
    for parse, symbol, maker in ((R.parse_binance_trades, "BTCUSDT", True), (R.parse_coinbase_trades, "BTC-USD", True), (R.parse_kraken_trades, "BTC-USD", False)):
        r = parse(raw).collect()
        assert [(x.symbol, x.price, x.qty, x.is_buyer_maker, x.ts) for x in r] == [(symbol, 10.5, 2.0, maker, datetime(2024, 1, 1, 0, 0, 0, 123000))]
    assert R.not_message_types(spark.createDataFrame([('{"type":"heartbeat"}',), ('{"type":"match"}',), (" ",)], "value string")).count() == 1
    k = spark.createDataFrame([("S", "[1704067200000,\"1\",\"3\",\"0.5\",\"2\",\"4\",0,\"6\",7,0,0,0]"), ("S", "[1]"), ("S", "x")], "symbol string, value string")
    assert [(r.open, r.vwap, r.trade_count, r.source) for r in R.parse_binance_klines(k, "1s").collect()] == [(1.0, 1.5, 7, "backfill_1s")]
    e = spark.createDataFrame([("A/B", '{"error":["E"],"result":{}}'), ("A/B", '{"error":[],"result":{"X":[[1704067200,"1","2","0.5","1.5","1.2","10",4]],"last":9}}')], "symbol string, value string")
    assert [(r.symbol, r.volume_quote, r.trade_count) for r in R.parse_kraken_ohlc(e, F.lit(at(10))).collect()] == [("A-B", 12.0, 4)] and R.parse_kraken_ohlc(e, F.lit(at(0))).count() == 0


def test_derivatives_and_snapshot(spark, make):
    raw = [("S", "funding", '[{"fundingRate":"0.0002","fundingTime":1704067200000}]'), ("S", "open_interest", '{"openInterest":"12.345"}'), ("S", "ticker", '{"lastPrice":"9.876","priceChangePercent":"1.5"}'), ("T", "long_short", '[{"longShortRatio":"0.5"}]')]
    d = R.derivatives(spark.createDataFrame(raw, "symbol string, kind string, value string"))
    got = {r.symbol: r for r in d.collect()}
    assert got["S"].funding.signal == "bullish" and got["S"].funding.rate_8h_annualised == 0.219 and got["S"].long_short_ratio is None and got["S"].mark_price == 9.88
    assert got["T"].long_short_ratio.signal == "shorts_dominant" and got["T"].funding is None
    bars = make([bar(3600 * i, 10.0 + i % 5, series="binance/S") for i in range(60)] + [bar(3600 * i, 10.0, series="x/S") for i in range(60)])
    s = {r.exchange: r for r in M.snapshot(bars, 3600, d).collect()}
    assert s["binance"].basis[1] == "positive_funding" and len(s["x"].basis) == 1 and len(s["x"].bars_sample) == 5
    assert set(M.indicator_document(M.indicators(bars, 3600)).columns) >= {"rsi", "macd", "bollinger", "regime"}


def test_lake_round_trip(spark, make, tmp_path):
    root, dst = f"file://{tmp_path}/lake", f"file://{tmp_path}/dst"
    bars = make([bar(60 * i, 1.0 + i, series=s) for i in range(0, 4000, 7) for s in ("binance/A-B", "kraken/C-D")])
    for part in bars.randomSplit([1.0, 1.0, 1.0], 1):
        L.write_bars(part, root, "snappy")
    back = L.read_bars(spark, root)
    assert values(back.select(bars.columns), *bars.columns) == values(bars, *bars.columns)
    assert L.read_bars(spark, root, "kraken").select("exchange").distinct().count() == 1
    day = L.read_day(spark, root, date(2024, 1, 2))
    assert day.count() == bars.where("date(window_start) = '2024-01-02'").count() and "PartitionFilters: [isnotnull" in day._jdf.queryExecution().toString()
    assert L.query_symbol(back, "kraken", "C-D", "2024-01-01", "2024-01-02", ["window_start", "close"]).count() == bars.where("symbol = 'C-D' AND window_start < '2024-01-03'").count()
    inv = L.file_inventory(spark, root, "*.parquet")
    days = L.inventory_totals(inv, ("exchange", "symbol", "day")).collect()
    assert all(r.files == 3 for r in days) and len(days) == 6
    assert values(L.parquet_footer_check(inv), "valid") == [(True,)] * 18
    ranges = L.file_ts_ranges(inv).collect()
    assert len(ranges) == 18 and all(r.min_ts <= r.max_ts for r in ranges)
    copied = L.stage_copy(spark, root, dst, date(2024, 1, 3), least_files={"binance": 50})
    assert {(r.exchange, str(r.day)) for r in L.file_inventory(spark, dst, "*.parquet").collect()} == {("kraken", "2024-01-01"), ("kraken", "2024-01-02")} and copied.count() == 2
    assert {(r.exchange, str(r.day)) for r in L.fill_unstaged(spark, root, dst, ["binance"], date(2024, 1, 3)).collect()} == {("binance", "2024-01-01"), ("binance", "2024-01-02")}
    plan = L.compact(spark, root, F.lit("2024-01-02").cast("date"), f"file://{tmp_path}/staging")
    assert {(r.exchange, r.files) for r in plan.collect()} == {("binance", 3), ("kraken", 3)}
    after = {(r.exchange, str(r.day)): r.files for r in L.inventory_totals(L.file_inventory(spark, root, "*.parquet"), ("exchange", "symbol", "day")).collect()}
    assert after["binance", "2024-01-01"] == 1 and after["binance", "2024-01-02"] == 3
    assert L.read_bars(spark, root).count() == bars.count()
    assert L.retain(spark, root, 1, date(2024, 1, 3)).count() == 2
    L.retain(spark, root, 1, date(2024, 1, 3), dry_run=False)
    assert L.read_bars(spark, root).agg(F.min("window_start")).first()[0] >= datetime(2024, 1, 2)


def test_damaged_files(spark, make, tmp_path):
    root = f"file://{tmp_path}/lake"
    L.write_bars(make([bar(i, series=s) for i in range(10) for s in ("e/a", "e/b")]), root)
    name = sorted((tmp_path / "lake").rglob("*.parquet"))[0]
    name.write_bytes(name.read_bytes()[:-9])
    inv = L.file_inventory(spark, root, "*.parquet")
    assert values(L.parquet_footer_check(inv), "valid") == [(False,), (True,)]
    rows = L.read_tolerant(spark, root)
    assert rows.count() == 10 and L.unreadable(inv, rows).count() == 1


def test_events_health_and_reports(spark, make, tmp_path):
    ev = spark.createDataFrame([("disconnect", "e", at(0), "x", None), ("reconnect", "e", at(90), None, 90.04)], "event string, exchange string, ts timestamp, reason string, gap_seconds double")
    L.write_events(ev, f"file://{tmp_path}/ev")
    back = L.read_connection_events(spark, f"file://{tmp_path}/ev")
    assert values(G.disconnect_gaps(back), "gap_seconds") == [(90.0,)] and back.where("gap_seconds = 90.0").count() == 1
    (tmp_path / "h.json").write_text(json.dumps({"ts_utc": "2024-01-01T00:00:00Z", "mode": "m", "collector": {"symbols_count": 3}, "counters": {"bars": 4}}))
    h = L.read_health(spark, f"file://{tmp_path}/h.json", F.lit(at(120))).first()
    assert h.age_minutes == 2.0 and h.collector.symbols_count == 3 and h.counters["bars"] == 4
    bars = make([bar(60 * i) for i in range(50)])
    L.write_report(A.symbol_summary(bars), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first()["total_bars"] == 50
    dim = spark.createDataFrame([("e", "s", 60), ("e", "none", 60)], "exchange string, symbol string, interval_sec int")
    rep = M.daily_report(bars, dim, F.lit(at(3600)))
    assert values(rep["quality"], "symbol", "note") == [("none", "no data in window"), ("s", "")] and set(M.gap_report(bars)) == {"coverage", "causes", "overall", "outages", "longest"}
    assert A.freshness(bars.limit(0), F.lit(at(0))).first().status == "unknown"


def test_streams(spark, make, tmp_path):
    rnd = random.Random(2)
    rows = [("e", f"s{i % 2}", rnd.uniform(1, 9), rnd.uniform(0, 2), at(i * 37 + (600 if i > 60 else 0)), i % 2 == 0, i) for i in range(120)]
    trades = spark.createDataFrame(rows, TRADE_SCHEMA).withColumn("value", F.to_json(F.struct("price")))
    trades.repartition(3).write.parquet(f"file://{tmp_path}/t")
    stream = lambda: spark.readStream.schema(trades.schema).parquet(f"file://{tmp_path}/t")
    q = ST.sink(ST.stream_bars(stream(), {"e": 60}, 1), f"file://{tmp_path}/bars", f"file://{tmp_path}/c1", every=None).start()
    q.awaitTermination()
    got, batch = L.read_bars(spark, f"file://{tmp_path}/bars"), B.trades_to_bars(trades, 60)
    keys = ("window_start", "symbol", "open", "high", "low", "close", "volume_base", "trade_count")
    closed = batch.where(F.col("window_start") <= got.agg(F.max("window_start")).first()[0])
    assert got.count() > 40 and values(got, *keys) == values(closed, *keys)
    filled = ST.stream_fill(spark.readStream.schema(BARS_SCHEMA).parquet(_written(batch, tmp_path)), 60)
    filled.writeStream.format("memory").queryName("filled").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    cols = ("window_start", "symbol", "close", "volume_base", "trade_count", "source")
    assert values(spark.table("filled"), *cols) == values(B.fill_empty_bars(batch, 60), *cols)
    ST.raw_archive(stream(), f"file://{tmp_path}/raw", f"file://{tmp_path}/c2", every=None).start().awaitTermination()
    assert R.read_raw_trades(spark, f"file://{tmp_path}/raw").count() == 120
    ST.stream_filter(stream(), ["s1"]).writeStream.format("memory").queryName("msgs").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("msgs").count() == 60
    now = ST.live_candles(batch, trades.limit(0), 60)
    assert values(now, "window_start", "symbol", "close") == values(batch, "window_start", "symbol", "close")


def test_stream_fill_has_a_timer_and_blocks(spark, make, tmp_path, monkeypatch):
    """A silent series gets empty bars up to the watermark; a hole longer than a block is filled whole; state goes over batches."""
    monkeypatch.setattr("marketbars.streaming.state.FILL_ROWS", 7)
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    parts = [[bar(0, 1.0, "e/a"), bar(0, 2.0, "e/b"), bar(300, 3.0, "e/a")], [bar(6000, 4.0, "e/a")], [bar(6600, 5.0, "e/a"), bar(6900, 6.0, "e/c")]]
    for k, rows in enumerate(parts):
        make(rows).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(BARS_SCHEMA).parquet(path).withWatermark("window_start", "60 seconds")
        ST.stream_fill(stream, 60, timer=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.schema(BARS_SCHEMA).parquet(out).collect():
        assert (r.symbol, r.window_start) not in got
        got[r.symbol, r.window_start] = (r.close, r.trade_count)
    a = {at(60 * i): ((1.0, 3.0, 4.0, 5.0)[(i >= 5) + (i >= 100) + (i >= 110)], int(60 * i in (0, 300, 6000, 6600))) for i in range(111)}
    assert {t: v for (s, t), v in got.items() if s == "a" and t <= at(6600)} == a
    b = {t: v for (s, t), v in got.items() if s == "b"}
    assert b[at(0)] == (2.0, 1) and set(b.values()) == {(2.0, 1), (2.0, 0)} and sorted(b) == [at(60 * i) for i in range(len(b))] and at(5880) in b and max(b) < at(6900 - 60)


def test_late_trades_are_counted(spark, tmp_path):
    """By batches: a trade older than the newest before it by more than the delay is late, kept aside and counted."""
    path, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    parts = [[(0, 1.0), (500, 2.0)], [(430, 3.0), (380, 4.0), (100, 5.0), (900, 6.0)], [(839, 7.0), (840, 8.0)]]
    n = 0
    for part in parts:
        rows = [("e", "s", p, 1.0, at(t), False, n + i) for i, (t, p) in enumerate(part)]
        n += len(rows)
        spark.createDataFrame(rows, TRADE_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        ST.late_stream(spark.readStream.schema(TRADE_SCHEMA).parquet(path), root, f"file://{tmp_path}/c", 600, 60).start().awaitTermination()
    assert values(ST.late_counts(spark, root), "symbol", "late", "most_seconds") == [("s", 4, 340)]
    bars = spark.read.schema("window_start timestamp, high double, trade_count long").parquet(f"{root}/bars")
    assert values(bars.groupBy("window_start").agg(F.max("high").alias("h"), F.sum("trade_count").alias("n")), "window_start", "h", "n") == [(at(0), 2.0, 2), (at(600), 8.0, 2)]


def test_live_candle_stream(spark, tmp_path):
    """History and two batches of live trades give the bars of all trades; indicators are refreshed for the series that changed."""
    rnd = random.Random(5)
    trades = spark.createDataFrame([("e", f"s{i % 3}", rnd.uniform(1, 9), rnd.uniform(0.5, 2), at(i * 50), False, i) for i in range(900)], TRADE_SCHEMA)
    history, live = B.trades_to_bars(trades.where("trade_id < 600"), 600), f"file://{tmp_path}/live"
    for low, high in ((600, 750), (750, 900)):
        trades.where(f"trade_id >= {low} AND trade_id < {high} AND symbol <> 's2'").coalesce(1).write.mode("append").parquet(live)
        stream = spark.readStream.schema(TRADE_SCHEMA).parquet(live)
        ST.live_candle_stream(stream, history, f"file://{tmp_path}/out", f"file://{tmp_path}/c", 600).start().awaitTermination()
    expected = B.trades_to_bars(trades.where("trade_id < 600 OR symbol <> 's2'"), 600)
    keys = ("symbol", "window_start", "open", "high", "low", "close", "trade_count")
    got = ST.newest_candles(spark, history, f"file://{tmp_path}/out")
    assert values(got, *keys) == values(expected, *keys)
    fresh = ST.newest_indicators(spark, f"file://{tmp_path}/out")
    whole = {r.symbol: r for r in M.indicators(expected, 600, complete=False).collect()}
    assert {r.symbol for r in fresh.collect()} == {"s0", "s1"} and all(r.rsi == whole[r.symbol].rsi and r.regime == whole[r.symbol].regime for r in fresh.collect())


def _written(batch, tmp_path) -> str:
    path = f"file://{tmp_path}/batch"
    batch.select(*BARS_SCHEMA.fieldNames()).coalesce(1).write.parquet(path)
    return path


# --- streams with state


def _arrive(spark, tmp_path, rows, schema, start) -> None:
    """Rows come as one more file of the stream's input; the stream goes on from its checkpoint and takes them."""
    from marketbars.streaming.state import rocksdb

    path = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    with rocksdb(spark):
        q = start(spark.readStream.schema(schema).parquet(path)).start()
    q.awaitTermination()


def _out(rows, tmp_path):
    return rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True)


def test_stream_fill_takes_disorder(spark, tmp_path):
    """Hours 0, 1, then 5, then 3, then 7: without a timer hour 3 is too late; each bucket comes once and the state never goes back."""
    from marketbars.streaming.state import stream_fill

    for hours in ((0, 1), (5,), (3, 5), (7,)):
        rows = [tuple(r) for h in hours for r in [(at(3600 * h), "e", "s", *[float(h)] * 4, 1.0, 1.0, 1, float(h), 0.0, 0.0, 0.0, "live")]]
        _arrive(spark, tmp_path, rows, BARS_SCHEMA, lambda s: _out(stream_fill(s, 3600), tmp_path))
    got = spark.read.schema(BARS_SCHEMA).parquet(f"file://{tmp_path}/out")
    closes = [0.0, 1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 7.0]
    assert values(got, "window_start", "close", "source") == [(at(3600 * h), c, "live" if h in (0, 1, 5, 7) else "empty") for h, c in enumerate(closes)]


def test_stream_fill_waits_for_the_watermark(spark, tmp_path):
    """With a timer a hole stays open until the watermark passes it: late and repeated bars within it come once, in any order and in pieces."""
    from marketbars.streaming.state import stream_fill

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        for hours in ((2, 0, 2, 9, 6, 0), (4, 3, 4, 8), (1, 2), (20,), (3, 7), (40,)):
            rows = [(at(3600 * h), "e", "s", *[float(h)] * 4, 1.0, 1.0, 1, float(h), 0.0, 0.0, 0.0, "live") for h in hours]
            _arrive(spark, tmp_path, rows, BARS_SCHEMA, lambda s: _out(stream_fill(s.withWatermark("window_start", "10 hours"), 3600, timer=True), tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = values(spark.read.schema(BARS_SCHEMA).parquet(f"file://{tmp_path}/out"), "window_start", "close", "source")
    real = [0, 1, 2, 3, 4, 6, 8, 9, 20, 40]  # 7 comes when the watermark is at 10
    want = [(at(3600 * h), float(max(r for r in real if r <= h)), "live" if h in real else "empty") for h in range(30)] + [(at(3600 * 40), 40.0, "live")]
    assert got == want


def test_runs_of_buckets_equal_sets():
    from marketbars.streaming.state import Runs

    rnd = random.Random(4)
    for _ in range(200):
        runs, seen = Runs(10, [], [], []), {}
        for _ in range(rnd.randint(1, 6)):
            t = np.array(sorted(rnd.sample(range(0, 400, 10), rnd.randint(1, 8))))
            new = runs.new(t)
            assert new.tolist() == [x not in seen for x in t.tolist()]
            runs.add(t[new], t[new] / 2)
            seen |= dict.fromkeys(t.tolist())
        inside = [x for a, b in zip(runs.first, runs.last, strict=True) for x in range(a, b + 10, 10)]
        assert inside == sorted(seen) and (runs.close == runs.last / 2).all() and (runs.first[1:] > runs.last[:-1] + 10).all()


def test_late_trades_correct_their_bars(spark, tmp_path):
    """Trades in random order over batches: changes add up to the bars of all trades; beyond the kept bars they are counted."""
    rnd = random.Random(6)
    rows = [("e", f"s{i % 2}", round(rnd.uniform(1, 9), 2), round(rnd.uniform(0.5, 2), 2), at(i * 20), False, i) for i in range(400)]
    rows += [(*rows[5][:2], 3.0, 1.0, rows[5][4], False, 1000)]  # a tie in time, decided by the id
    rnd.shuffle(rows)
    for k in range(4):
        _arrive(spark, tmp_path, rows[k::4], TRADE_SCHEMA, lambda s: ST.live_candle_stream(s, None, f"file://{tmp_path}/out", f"file://{tmp_path}/c", 60, keep=10_000))
    changes, keys = ST.changes_below(spark, f"file://{tmp_path}/out"), ("symbol", "window_start", "open", "high", "low", "close", "trade_count")
    whole = B.trades_to_bars(spark.createDataFrame(rows, TRADE_SCHEMA), 60)
    assert values(ST.current_candles(changes), *keys) == values(whole, *keys)
    sign = F.when(F.col("kind") == "retract", -1).otherwise(1)
    left = changes.where("kind IN ('insert', 'retract', 'replace')").groupBy("symbol", "window_start").agg(F.sum(sign * F.col("trade_count")).alias("trade_count"), F.round(F.sum(sign * F.col("volume_base")), 6).alias("v"))
    assert values(left, "symbol", "window_start", "trade_count", "v") == values(whole.withColumn("v", F.round("volume_base", 6)), "symbol", "window_start", "trade_count", "v")
    back, forth = (changes.where(F.col("kind") == k) for k in ("retract", "replace"))
    assert back.count() == forth.count() > 0 and back.join(forth.withColumn("revision", F.col("revision") - 1), ["symbol", "window_start", "revision"]).count() == back.count()


def test_trades_beyond_the_kept_candles_are_counted(spark, tmp_path):
    start = lambda s: ST.live_candle_stream(s, None, f"file://{tmp_path}/out", f"file://{tmp_path}/c", 60, keep=3)
    trade = lambda t, n: ("e", "s", 1.0 + n, 1.0, at(t), False, n)
    _arrive(spark, tmp_path, [trade(60 * i, i) for i in range(10)], TRADE_SCHEMA, start)
    _arrive(spark, tmp_path, [trade(100, 20), trade(419, 21), trade(420, 22), trade(630, 23)], TRADE_SCHEMA, start)
    changes = ST.changes_below(spark, f"file://{tmp_path}/out")
    assert values(changes.where("kind = 'late'"), "symbol", "trade_count", "seconds_late") == [("s", 2, 320)]
    assert values(ST.current_candles(changes).where("trade_count > 1 OR window_start >= timestamp'2024-01-01 00:10:00'"), "window_start", "close", "trade_count") == [(at(420), 23.0, 2), (at(600), 24.0, 1)]


def test_live_candles_read_history_once(spark, tmp_path):
    """A batch's plan scans what arrives; the history's scan belongs to the first batch, and state holds the rest."""
    rnd = random.Random(8)
    trades = [("e", "s", rnd.uniform(1, 9), 1.0, at(i * 60), False, i) for i in range(900)]
    history = B.trades_to_bars(spark.createDataFrame(trades[:600], TRADE_SCHEMA), 60)
    history.write.parquet(f"file://{tmp_path}/history")
    stored = spark.read.parquet(f"file://{tmp_path}/history")
    start = lambda s: ST.live_candle_stream(s, stored, f"file://{tmp_path}/out", f"file://{tmp_path}/c", 60, keep=5)
    _arrive(spark, tmp_path, trades[600:700], TRADE_SCHEMA, start)
    for p in (tmp_path / "history").glob("*.parquet"):
        p.unlink()  # later batches go on without it
    _arrive(spark, tmp_path, trades[700:], TRADE_SCHEMA, start)
    fresh = ST.newest_indicators(spark, f"file://{tmp_path}/out").first()
    whole = M.indicators(B.trades_to_bars(spark.createDataFrame(trades, TRADE_SCHEMA), 60), 60, limit=900, complete=False).first()
    assert fresh.asDict() == whole.asDict()


def test_disconnects_of_a_stream_are_paired(spark, tmp_path):
    """Over midnight, out of order, answered, answered too late and unanswered."""
    from marketbars.streaming.state import disconnect_gap_stream

    schema, day = "exchange string, event string, ts timestamp", 86400
    batches = [
        [("a", "reconnect", at(day + 30)), ("a", "disconnect", at(day - 20)), ("b", "disconnect", at(100)), ("b", "disconnect", at(150)), ("b", "reconnect", at(90))],
        [("b", "reconnect", at(day + 9000)), ("a", "disconnect", at(day + 20)), ("c", "disconnect", at(day + 500)), ("c", "reconnect", at(day + 500)), ("a", "connect", at(day))],
        [("z", "reconnect", at(9 * day))],
    ]
    for rows in batches:
        _arrive(spark, tmp_path, rows, spark.createDataFrame([], schema).schema, lambda s: _out(disconnect_gap_stream(s.withWatermark("ts", "2 days"), 600.0), tmp_path))
    got = spark.read.schema("exchange string, gap_start timestamp, gap_end timestamp, gap_seconds double").parquet(f"file://{tmp_path}/out")
    want = {("a", at(day - 20), at(day + 30), 50.0), ("a", at(day + 20), at(day + 30), 10.0), ("b", at(100), None, None), ("b", at(150), None, None), ("c", at(day + 500), at(day + 500), 0.0)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == 5


def test_the_sink_is_flushed_by_a_closing_trade(spark, tmp_path):
    rows = [("e", "s", 1.0, 1.0, at(i * 45), False, i) for i in range(20)]
    start = lambda s: ST.sink(ST.stream_bars(s, {}, 60), f"file://{tmp_path}/lake", f"file://{tmp_path}/c", every=None)
    _arrive(spark, tmp_path, rows[:11], TRADE_SCHEMA, start)
    _arrive(spark, tmp_path, rows[11:], TRADE_SCHEMA, start)
    before = L.read_bars(spark, f"file://{tmp_path}/lake").count()
    _arrive(spark, tmp_path, [tuple(r) for r in ST.closing_trade(spark, int((at(20 * 45) - datetime(1970, 1, 1)).total_seconds()) + 60).collect()], TRADE_SCHEMA, start)
    whole, bars = B.trades_to_bars(spark.createDataFrame(rows, TRADE_SCHEMA), 60), L.read_bars(spark, f"file://{tmp_path}/lake")
    assert before < whole.count() and values(bars, "window_start", "trade_count") == values(whole, "window_start", "trade_count")


def test_upkeep_goes_on_after_a_kill(spark, make, tmp_path):
    """A compaction and a copy that break in the middle are finished by the next run, by the same plan: rows are whole, and each once."""
    from marketbars.sources import upkeep

    root, dst, staging = (f"file://{tmp_path}/{x}" for x in ("lake", "dst", "staging"))
    bars = make([bar(60 * i, 1.0 + i, series=s) for i in range(0, 6000, 11) for s in ("binance/A-B", "kraken/C-D")])
    for part in bars.randomSplit([1.0, 1.0], 1):
        L.write_bars(part, root)
    rows, inv = values(bars, *bars.columns), L.file_inventory(spark, root, "*.parquet")
    before = F.lit("2100-01-01").cast("date")

    def broken(task, bad):
        def run(parts):
            for pdf in parts:
                for k in range(len(pdf)):  # directory by directory; one of them breaks the job
                    if bad in pdf["dir"].iloc[k]:
                        raise RuntimeError("killed")
                    yield from task(iter([pdf.iloc[k : k + 1]]))

        return run

    with pytest.raises(Exception, match="killed"):
        upkeep.work_through(spark, f"{staging}/compact", upkeep.planned_directories(inv, L.compaction_plan(inv, before)), broken(upkeep.whole_day(None, "zstd"), "symbol=C-D/year=2024/month=01/day=03"))
    plan = upkeep.unfinished(spark, f"{staging}/compact")
    assert plan is not None
    done = L.compact(spark, root, before, staging)  # goes on with the plan that it finds
    assert upkeep.unfinished(spark, f"{staging}/compact") is None and {r.files_after for r in done.collect()} == {1} and done.count() == 10
    assert values(L.read_bars(spark, root).select(bars.columns), *bars.columns) == rows
    assert L.compact(spark, root, before, staging).count() == 0
    inv = L.file_inventory(spark, root, "*.parquet")
    with pytest.raises(Exception, match="killed"):
        upkeep.work_through(spark, f"{dst}/_upkeep/stage", upkeep.planned_directories(inv, inv), broken(upkeep.whole_day(dst, "zstd"), "symbol=A-B/year=2024/month=01/day=02"))
    assert L.stage_copy(spark, root, dst, date(2024, 1, 9)).agg(F.sum("rows")).first()[0] == len(rows)
    assert values(L.read_bars(spark, dst).select(bars.columns), *bars.columns) == rows == values(L.read_bars(spark, root).select(bars.columns), *bars.columns)
