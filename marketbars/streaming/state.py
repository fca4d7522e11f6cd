"""Streams with state of their own for each series (transformWithState): gap filling, candles with corrections and live
indicators, and disconnects paired with reconnects.

State is small and bounded: what a series needs to go on, never its rows. Input comes in pieces (Arrow batches), of which
only candles or runs of buckets are kept until the batch ends. These operators need the RocksDB state store: rocksdb() sets it for the streams
that start inside the block, SETTINGS of marketbars.session for a session of one's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.bars import newest
from ..schema import KEY

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _seconds(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[s]").astype(np.int64)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


def _times(seconds: np.ndarray | list) -> np.ndarray:
    return np.asarray(seconds, np.int64).astype("datetime64[s]").astype("datetime64[ns]")


class _Timed(StatefulProcessor):
    """A processor with at most one timer for each key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alarm = handle.getValueState("alarm", "at bigint")

    def wake(self, at: int | None, passed: int) -> None:
        """Have the timer expire when event time (ms) is beyond `at`; a timer of before goes."""
        old = self.alarm.get()[0] if self.alarm.exists() else None
        at = None if at is None else max(at, passed + 1)
        if old == at:
            return
        if old is not None and old > passed:
            self.handle.deleteTimer(old)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def close(self) -> None:
        pass


# --- gap filling

FILLED = "window_start timestamp, exchange string, symbol string, open double, high double, low double, close double, volume_base double, volume_quote double, trade_count long, vwap double, bid double, ask double, spread double, source string"
_NAMES = [c.split()[0] for c in FILLED.split(", ")]
#: Rows that the filler sends at once: a hole of any length is sent in blocks.
FILL_ROWS = 50_000


class Runs:
    """Sets of consecutive buckets as (first, last, close of the last), in order and apart from each other."""

    def __init__(self, interval: int, first: list[int], last: list[int], close: list[float]):
        self.interval = interval
        self.first, self.last, self.close = np.array(first, np.int64), np.array(last, np.int64), np.array(close, np.float64)

    def new(self, t: np.ndarray) -> np.ndarray:
        """Which of t are in no run."""
        at = np.searchsorted(self.first, t, "right") - 1
        return (at < 0) | (t > self.last[np.maximum(at, 0)]) if len(self.first) else np.ones(len(t), bool)

    def add(self, t: np.ndarray, close: np.ndarray) -> None:
        """t, which are new, distinct and in order."""
        first, last, close = (np.concatenate(x) for x in ((self.first, t), (self.last, t), (self.close, close)))
        order = np.argsort(first, kind="stable")
        first, last, close = first[order], last[order], close[order]
        begins = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1] + self.interval]))
        ends = np.append(begins[1:], len(first)) - 1
        self.first, self.last, self.close = first[begins], last[ends], close[ends]


class Filler(_Timed):
    """State of a series: the runs of buckets that have come, what is settled (all buckets up to there) in one run with its fillers."""

    def __init__(self, interval: int, timer: bool):
        self.interval, self.timer = interval, timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("runs", "settled bigint, first array<bigint>, last array<bigint>, close array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, *runs = self.state.get() if self.state.exists() else (None, [], [], [])
        runs = Runs(self.interval, *runs)
        for pdf in rows:
            pdf = pdf.assign(_t=_seconds(pdf["window_start"])).sort_values("_t", kind="stable").drop_duplicates("_t")
            t = pdf["_t"].to_numpy()
            good = runs.new(t) & ((t > settled) if settled is not None else True)
            if good.any():
                runs.add(t[good], pdf["close"].to_numpy()[good])
                yield pdf.loc[good, _NAMES]
        yield from self.settle(key, settled, runs, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled, *runs = self.state.get()
        yield from self.settle(key, settled, Runs(self.interval, *runs), timerValues)

    def settle(self, key: tuple, settled: int | None, runs: Runs, timerValues) -> Iterator[pd.DataFrame]:
        """Empty bars for the holes up to the watermark (without a timer: up to the last bar), in blocks."""
        if not len(runs.first):
            return
        step, passed = self.interval, timerValues.getCurrentWatermarkInMs() if self.timer else 0
        limit = (-(-(passed // 1000) // step) - 1) * step if self.timer else int(runs.last[-1])
        n = int(np.searchsorted(runs.first, limit, "right"))
        if n:
            before, until = runs.last[:n], np.append(runs.first[1:n] - step, max(limit, int(runs.last[n - 1])))
            yield from self.between(key, before, runs.close[:n], np.maximum((until - before) // step, 0))
            runs.first, runs.last, runs.close = np.append(runs.first[0], runs.first[n:]), np.append(until[-1], runs.last[n:]), runs.close[n - 1 :]
            runs.add(np.zeros(0, np.int64), np.zeros(0))  # the next run may begin where this one ends now
            settled = limit
        if self.timer:
            self.wake((int(runs.last[0]) + step) * 1000, passed)
        self.state.update((settled, runs.first.tolist(), runs.last.tolist(), runs.close.tolist()))

    def between(self, key: tuple, last: np.ndarray, closes: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        """n[i] empty bars after last[i]."""
        ends = np.cumsum(n)
        for at in range(0, int(ends[-1]), FILL_ROWS):
            k = np.arange(at, min(at + FILL_ROWS, int(ends[-1])))
            i = np.searchsorted(ends, k, "right")
            one = {"window_start": _times(last[i] + (k - (ends[i] - n[i]) + 1) * self.interval), "exchange": key[0], "symbol": key[1], "trade_count": 0, "source": "empty"}
            zero = dict.fromkeys(("volume_base", "volume_quote", "bid", "ask", "spread"), 0.0)
            yield pd.DataFrame(one | zero | dict.fromkeys(("open", "high", "low", "close", "vwap"), closes[i]))[_NAMES]


def stream_fill(bars: DataFrame, interval: int, timer: bool = False) -> DataFrame:
    """Bars of a stream with the empty bars between them; each bucket comes once.

    Bars may come in any order and more than once: a bar is sent on when it comes, unless its bucket has been sent. Without
    timer a hole is filled when a later bar closes it, and a bar older than that comes too late and is left out. With
    timer, `bars` must have a watermark on window_start: a hole is filled when the watermark passes it, so bars may be late
    by as much, and a series in which no bar arrives gets its empty bars as event time goes on without it.
    """
    return bars.select(*_NAMES).where("window_start IS NOT NULL").groupBy(*KEY).transformWithStateInPandas(Filler(interval, timer), FILLED, "Append", "EventTime" if timer else "None")


# --- candles that trades amend, and indicators of the open one

#: Numbers of a candle, beside its time; open and close with the time and id of their trades, which decide between trades.
_CANDLE = {"open": float, "open_us": int, "open_id": int, "high": float, "low": float, "close": float, "close_us": int, "close_id": int, "base": float, "quote": float, "n": int, "revision": int}
_KINDS = {float: "array<double>", int: "array<bigint>"}
_CANDLES = "t array<bigint>, " + ", ".join(f"{k} {_KINDS[v]}" for k, v in _CANDLE.items())
_PRICES = ("open", "high", "low", "close", "volume_base", "volume_quote", "trade_count", "vwap")
#: What describe() of plans.market needs of a series' newest candle.
_NOW = ("rsi", "macd", "macd_signal", "macd_hist", "prev_hist", "ema_fast", "ema_slow", "prev_fast", "prev_slow", "sma20", "sma50", "sma200", "bb_upper", "bb_middle", "bb_lower", "current_volume", "avg_volume", "volume_ratio")
CHANGES = "kind string, exchange string, symbol string, window_start timestamp, revision long, open double, high double, low double, close double, volume_base double, volume_quote double, trade_count long, vwap double, seconds_late long, rn long, " + ", ".join(f"{c} double" for c in _NOW)
_COLUMNS = [c.split()[0] for c in CHANGES.split(", ")]
#: Rows of history that running sums start from: what lies before weighs less than double precision.
SEED_ROWS = 1000
_FIRST = -(1 << 62)


def _partial(pdf: pd.DataFrame, interval: int) -> dict[int, list]:
    """The candles of some trades: t -> the numbers of _CANDLE."""
    us = _micros(pdf["ts"])
    rows = pdf.assign(_us=us, _t=us // 1_000_000 // interval * interval, _quote=pdf["price"] * pdf["qty"]).sort_values(["_us", "trade_id", "price"], kind="stable")
    g = rows.groupby("_t")
    first, last = g[["price", "_us", "trade_id"]].first(), g[["price", "_us", "trade_id"]].last()
    columns = [first["price"], first["_us"], first["trade_id"], g["price"].max(), g["price"].min(), last["price"], last["_us"], last["trade_id"], g["qty"].sum(), g["_quote"].sum(), g.size()]
    return {int(t): [*x, 0] for t, *x in zip(first.index, *(c.tolist() for c in columns), strict=True)}


def _merged(a: list, b: list) -> list:
    """Two candles of one bucket; the trades' time, id and price decide which one opens and closes it."""
    opens = min((a[1], a[2], a[0]), (b[1], b[2], b[0]))
    closes = max((a[6], a[7], a[5]), (b[6], b[7], b[5]))
    return [opens[2], opens[0], opens[1], max(a[3], b[3]), min(a[4], b[4]), closes[2], closes[0], closes[1], a[8] + b[8], a[9] + b[9], a[10] + b[10], a[11]]


class Running:
    """Indicators of a series as running sums: a step for each candle, whatever there was before."""

    #: name: (rows of the seed, weight of a new value)
    SMOOTH = {"fast": (12, 2 / 13), "slow": (26, 2 / 27), "signal": (9, 0.2), "up": (14, 1 / 14), "down": (14, 1 / 14)}
    STATE = "rn bigint, counts array<bigint>, sums array<double>, closes array<double>, volumes array<double>"

    def __init__(self, rn: int = 0, counts: list | None = None, sums: list | None = None, closes: list | None = None, volumes: list | None = None):
        self.rn, self.counts, self.sums = rn, list(counts or [0] * len(self.SMOOTH)), list(sums or [0.0] * len(self.SMOOTH))
        self.closes, self.volumes = list(closes or []), list(volumes or [])  # of the last 200 candles, of the last 20 live ones

    def state(self) -> tuple:
        return self.rn, self.counts, self.sums, self.closes, self.volumes

    def copy(self) -> Running:
        return Running(*self.state())

    def _feed(self, name: str, x: float) -> None:
        k, (n, b) = list(self.SMOOTH).index(name), self.SMOOTH[name]
        self.counts[k] += 1
        if self.counts[k] <= n:
            self.sums[k] += x
            if self.counts[k] == n:
                self.sums[k] /= n
        else:
            self.sums[k] = (1 - b) * self.sums[k] + b * x

    def _of(self, name: str) -> float | None:
        k = list(self.SMOOTH).index(name)
        return self.sums[k] if self.counts[k] >= self.SMOOTH[name][0] else None

    def step(self, close: float, base: float, live: bool) -> None:
        self.rn += 1
        if self.closes:
            self._feed("up", max(close - self.closes[-1], 0.0))
            self._feed("down", max(self.closes[-1] - close, 0.0))
        self._feed("fast", close)
        self._feed("slow", close)
        if self._of("slow") is not None:
            self._feed("signal", self._of("fast") - self._of("slow"))
        self.closes = [*self.closes[-199:], close]
        if live:
            self.volumes = [*self.volumes[-19:], base]

    def hist(self) -> float | None:
        return None if self._of("signal") is None else self._of("fast") - self._of("slow") - self._of("signal")

    def now(self, before: Running, base: float) -> dict:
        """The columns of _NOW, at the last step; before: the sums at the step before it."""
        fast, slow, up, down = map(self._of, ("fast", "slow", "up", "down"))
        mean = lambda n: math.fsum(self.closes[-n:]) / n if self.rn >= n else None
        mid = mean(20)
        dev = math.sqrt(math.fsum((c - mid) ** 2 for c in self.closes[-20:]) / 20) if mid is not None else None
        average = math.fsum(self.volumes) / len(self.volumes) if self.volumes else 1.0
        return {
            "rsi": None if up is None else 100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down), "macd": None if slow is None else fast - slow, "macd_signal": self._of("signal"), "macd_hist": self.hist(),
            "prev_hist": before.hist(), "ema_fast": fast, "ema_slow": slow, "prev_fast": before._of("fast"), "prev_slow": before._of("slow"), "sma20": mid, "sma50": mean(50), "sma200": mean(200),
            "bb_upper": None if mid is None else mid + 2 * dev, "bb_middle": mid, "bb_lower": None if mid is None else mid - 2 * dev,
            "current_volume": base, "avg_volume": average, "volume_ratio": base / average if average > 0 else 1.0,
        }


class Candles(StatefulProcessor):
    """State of a series: its last `keep` candles, and the running sums of the indicators over those before them."""

    def __init__(self, interval: int, keep: int, now: bool):
        self.interval, self.keep, self.now = interval, keep, now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.candles = handle.getValueState("candles", _CANDLES)
        self.running = handle.getValueState("running", f"refreshed bigint, {Running.STATE}")

    def close(self) -> None:
        pass

    def load(self) -> tuple[dict[int, list], int, Running]:
        t, *columns = self.candles.get() if self.candles.exists() else [[] for _ in range(len(_CANDLE) + 1)]
        refreshed, *running = self.running.get() if self.running.exists() else (0,)
        return dict(zip(t, map(list, zip(*columns, strict=True)), strict=True)), refreshed, Running(*running)

    def save(self, candles: dict[int, list], refreshed: int, running: Running) -> None:
        """The oldest candles beyond `keep` go into the running sums."""
        order = sorted(candles)
        for t in order[: max(0, len(order) - self.keep)]:
            c = candles.pop(t)
            running.step(c[5], c[8], c[10] > 0)
        rows = [candles[t] for t in sorted(candles)]
        columns = [[kind(r[k]) for r in rows] for k, kind in enumerate(_CANDLE.values())]
        self.candles.update((sorted(candles), *columns))
        self.running.update((refreshed, *running.state()))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        """At most SEED_ROWS candles of history; the trades that made them are older than any that come."""
        rows = initialState.sort_values("window_start")
        candles = {int(t): [o, _FIRST, 0, h, low, c, _FIRST, 0, b, q, int(n), 0] for t, o, h, low, c, b, q, n in zip(_seconds(rows["window_start"]), *(rows[c].tolist() for c in _PRICES[:7]), strict=True)}
        self.save(candles, 0, Running())

    def rows(self, kind: str, key: tuple, found: list[tuple[int, list]], **more) -> pd.DataFrame:
        t, c = [x[0] for x in found], list(zip(*(x[1] for x in found), strict=True))
        values = dict(zip(_CANDLE, c, strict=True))
        vwap = [q / b if b > 0 else p for q, b, p in zip(values["quote"], values["base"], values["close"], strict=True)]
        out = {"kind": kind, "exchange": key[0], "symbol": key[1], "window_start": _times(t), "revision": values["revision"], "volume_base": values["base"], "volume_quote": values["quote"], "trade_count": values["n"], "vwap": vwap}
        return self.shaped(pd.DataFrame(out | {k: values[k] for k in ("open", "high", "low", "close")} | more))

    def shaped(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.reindex(columns=_COLUMNS).astype({c: "Int64" for c in ("revision", "trade_count", "seconds_late", "rn")} | {"window_start": "datetime64[ns]"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        candles, refreshed, running = self.load()
        # a candle that has gone into the running sums can't be amended any more; that is settled before the batch
        oldest, old = (min(candles) if running.rn and candles else _FIRST), {}
        for pdf in rows:
            seconds = _seconds(pdf["ts"])
            late = seconds < oldest
            if late.any():
                yield self.shaped(pd.DataFrame({"kind": "late", "exchange": key[0], "symbol": key[1], "trade_count": [int(late.sum())], "seconds_late": [int((oldest - seconds[late]).max())]}))
            for t, c in (_partial(pdf[~late], self.interval) if not late.all() else {}).items():
                old.setdefault(t, candles.get(t))
                candles[t] = _merged(candles[t], c) if t in candles else c
        for t, c in old.items():
            candles[t][-1] = c[-1] + 1 if c else 0
        amended = [t for t, c in old.items() if c]
        for kind, found in (("retract", [(t, old[t]) for t in amended]), ("replace", [(t, candles[t]) for t in amended]), ("insert", [(t, candles[t]) for t, c in old.items() if not c])):
            for at in range(0, len(found), FILL_ROWS):
                yield self.rows(kind, key, found[at : at + FILL_ROWS])
        refreshed += 1
        self.save(candles, refreshed, running)
        if self.now and candles:
            last, before = running.copy(), running
            for t in sorted(candles):
                before = last.copy()
                last.step(candles[t][5], candles[t][8], candles[t][10] > 0)
            yield self.rows("now", key, [(t, candles[t])], rn=last.rn, **last.now(before, candles[t][8])).assign(revision=pd.array([refreshed], "Int64"))


def candle_changes(trades: DataFrame, interval: int, keep: int = 120, history: DataFrame | None = None, now: bool = False) -> DataFrame:
    """Trades (in any order) to changes of candles; a batch costs what its own series have in state, whatever came before.

    kind `insert`: a new candle. `retract` and `replace`: a candle as it was and as it is now, with the next revision; so
    inserts less retractions plus replacements are the candles at any time, and the highest revision is the current one.
    `late`: trades older than the `keep` newest candles of their series are counted (trade_count) with the most seconds by
    which one is older; they amend nothing. `now` (if asked for): the indicators of the series' newest candle, the open one
    included, once a batch. history: candles from before, which trades amend, too; it is read once, when the stream begins.
    """
    first = None
    if history is not None:
        first = newest(history, SEED_ROWS).select(*KEY, "window_start", *_PRICES[:7]).groupBy(*KEY)
    rows = trades.select(*KEY, "ts", "trade_id", "price", "qty").where("ts IS NOT NULL AND price IS NOT NULL")
    return rows.groupBy(*KEY).transformWithStateInPandas(Candles(interval, keep, now), CHANGES, "Append", "None", initialState=first)


def current_candles(changes: DataFrame) -> DataFrame:
    """The candles that changes have left: the highest revision of each."""
    names = ("kind", *_PRICES)
    rows = changes.where(F.col("kind").isin("insert", "replace")).groupBy("window_start", *KEY).agg(F.max_by(F.struct(*names), "revision").alias("c"))
    return rows.select("window_start", *KEY, *[F.col(f"c.{c}").alias(c) for c in _PRICES])


def current_indicators(changes: DataFrame) -> DataFrame:
    """The newest `now` row of each series, as the indicator document's columns."""
    from ..plans.market import describe

    names = [c for c in _COLUMNS if c not in KEY]
    rows = changes.where("kind = 'now'").groupBy(*KEY).agg(F.max_by(F.struct(*names), "revision").alias("c")).select(*KEY, "c.*")
    return describe(rows)


# --- disconnects and reconnects


class Pairing(_Timed):
    """State of an exchange: events that the watermark has not passed, in no order, and disconnects without an answer."""

    def __init__(self, timeout: float):
        self.timeout = int(timeout * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("events", "open array<bigint>, down array<bigint>, up array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, down, up = map(list, self.state.get()) if self.state.exists() else ([], [], [])
        for pdf in rows:
            at = _micros(pdf["ts"])
            down += at[(pdf["event"] == "disconnect").to_numpy()].tolist()
            up += at[(pdf["event"] == "reconnect").to_numpy()].tolist()
        yield from self.settle(key, waiting, down, up, timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.settle(key, *map(list, self.state.get()), timerValues)

    def settle(self, key: tuple, waiting: list[int], down: list[int], up: list[int], timerValues) -> Iterator[pd.DataFrame]:
        """Pair what the watermark has passed: nothing can come between."""
        passed = timerValues.getCurrentWatermarkInMs()
        limit = passed * 1000
        ready = sorted([(x, 0) for x in down if x < limit] + [(x, 1) for x in up if x < limit])
        down, up, out = [x for x in down if x >= limit], [x for x in up if x >= limit], []
        for x, answer in ready:
            if answer:
                out += [(d, x if x - d <= self.timeout else None) for d in waiting]
                waiting = []
            else:
                waiting.append(x)
        out += [(d, None) for d in waiting if d + self.timeout < limit]
        waiting = [d for d in waiting if d + self.timeout >= limit]
        ahead = [min(x) for x in (down, up) if x] + ([min(waiting) + self.timeout] if waiting else [])
        self.wake(min(ahead) // 1000 + 1 if ahead else None, passed)
        self.state.update((waiting, down, up))
        if out:
            times = lambda x: pd.Series(np.array([np.datetime64("NaT") if v is None else np.datetime64(v, "us") for v in x], "datetime64[us]")).astype("datetime64[ns]")
            seconds = [None if u is None else (u - d) / 1e6 for d, u in out]
            yield pd.DataFrame({"exchange": key[0], "gap_start": times([d for d, _ in out]), "gap_end": times([u for _, u in out]), "gap_seconds": pd.array(seconds, "Float64")})


def disconnect_gap_stream(events: DataFrame, timeout: float = 3600.0) -> DataFrame:
    """Connection events (event, exchange, ts with a watermark) to gaps: each disconnect with the next reconnect of its exchange.

    A gap is sent when the watermark has passed its end; one without a reconnect within timeout seconds with null ends.
    """
    rows = events.where(F.col("event").isin("disconnect", "reconnect") & F.col("ts").isNotNull()).select("exchange", "event", "ts")
    return rows.groupBy("exchange").transformWithStateInPandas(Pairing(timeout), "exchange string, gap_start timestamp, gap_end timestamp, gap_seconds double", "Append", "EventTime")


def request_stream(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Back-fill requests of a stream of events (event: one kind; exchange; ts with a watermark): those within `seconds` of each other go together.

    A session window over all exchanges; it is sent when the watermark has passed its end.
    """
    window = F.session_window("ts", f"{seconds} seconds 1 microsecond")  # events just so far apart still go together
    rows = events.groupBy(window, "event").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.collect_set("exchange").alias("exchanges"), F.count(F.lit(1)).alias("n_events"))
    return rows.select("from_ts", "to_ts", F.sort_array("exchanges").alias("exchanges"), "n_events")
