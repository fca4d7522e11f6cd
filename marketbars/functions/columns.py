"""Scalar column functions: time buckets, rounding, labels and text forms. All are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The timeframes and their seconds; anything else counts as five minutes.
TIMEFRAMES = {"1s": 1, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
DEFAULT_TIMEFRAME = 300


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def choose(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first case that holds."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def bucket(ts: Column | str, seconds: int | Column) -> Column:
    """Start of the bucket of a timestamp."""
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.floor(F.unix_seconds(_c(ts)) / s) * s)


def parse_tf(tf: str) -> int:
    return TIMEFRAMES.get(tf, DEFAULT_TIMEFRAME)


def tf_seconds(tf: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TIMEFRAMES.items() for x in kv])
    return F.coalesce(F.element_at(known, _c(tf)), F.lit(DEFAULT_TIMEFRAME))


def round_half_away(v: Column | str, digits: int) -> Column:
    """Rounds the double itself (1.005 to 1.0), unlike F.round, which rounds its decimal text."""
    x, p = _c(v), 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def lenient_double(c: Column | str) -> Column:
    """A number or numeric text, else 0."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


def safe_ratio(x: Column | str, y: Column | str, default: object) -> Column:
    return F.when(_c(y) > 0, _c(x) / _c(y)).otherwise(default)


#: Likely causes of a gap, by least duration in seconds.
GAP_CAUSES = ((3600, "Computer shutdown/restart"), (300, "App restart or extended network outage"), (60, "Network switch or brief disconnect"), (5, "WebSocket reconnect"))


def classify_gap(seconds: Column | str) -> Column:
    return choose([(_c(seconds) > least, label) for least, label in GAP_CAUSES], "Unknown")


def cluster_cause(avg_seconds: Column | str, n_exchanges: Column | str) -> Column:
    return choose([(_c(avg_seconds) > 3600, "Computer shutdown/restart"), (_c(avg_seconds) > 300, "App restart"), (_c(n_exchanges) > 1, "Network switch")], "Exchange-specific outage")


#: style -> (format of minutes, of hours, of days or None); the numbers are the unit and the rest in the next smaller one.
DURATION_STYLES = {
    "padded": ("%dm %02ds", "%dh %02dm", "%dd %02dh"),
    "plain": ("%dm %ds", "%dh %dm", "%dd %dh"),
    "no_days": ("%dm %ds", "%dh %dm", None),
    "tight": ("%dm%02ds", "%dh%02dm", None),
}


def fmt_dur(seconds: Column | str, style: str = "padded") -> Column:
    s, (m, h, d) = _c(seconds).cast("long"), DURATION_STYLES[style]
    part = lambda unit, rest: (F.floor(s / unit), F.floor(F.pmod(s, F.lit(unit)) / rest))
    cases = [(s < 60, F.format_string("%ds", s)), (s < 3600, F.format_string(m, *part(60, 1)))]
    if d:
        cases.append((s < 86400, F.format_string(h, *part(3600, 60))))
    return choose(cases, F.format_string(*((d, *part(86400, 3600)) if d else (h, *part(3600, 60)))))


def fmt_uptime(seconds: Column | str) -> Column:
    s = _c(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return choose([(h > 24, F.format_string("%dd %dh", F.floor(h / 24), F.pmod(h, F.lit(24)))), (h > 0, F.format_string("%dh %dm", h, m))], F.format_string("%dm", m))


def fmt_bytes(n: Column | str, small_units: bool = True) -> Column:
    x = _c(n).cast("double")
    cases = [(x >= 2.0**30, F.format_string("%.2f GB", x / 2.0**30))]
    if small_units:
        cases += [(x >= 2.0**20, F.format_string("%.1f MB", x / 2.0**20)), (x >= 1024, F.format_string("%.0f KB", x / 1024.0))]
        return choose(cases, F.format_string("%d B", _c(n).cast("long")))
    return choose(cases, F.format_string("%.1f MB", x / 2.0**20))


def fmt_count(n: Column | str) -> Column:
    x = _c(n).cast("double")
    return choose([(x >= 1e6, F.format_string("%.1fM", x / 1e6)), (x >= 1e3, F.format_string("%.1fK", x / 1e3))], _c(n).cast("long").cast("string"))


def fmt_ago(seconds: Column | str) -> Column:
    s = _c(seconds).cast("long")
    ago = lambda unit, sign: F.format_string(f"%d{sign} ago", F.floor(s / unit))
    return choose([(s.isNull(), "never"), (s < 120, ago(1, "s")), (s < 3600, ago(60, "m")), (s < 86400, ago(3600, "h"))], ago(86400, "d"))


def price_decimals(p: Column | str) -> Column:
    return choose([(_c(p) > 100, 2), (_c(p) > 1, 4)], 6)


def fmt_price(p: Column | str) -> Column:
    return choose([(price_decimals(p) == d, F.format_string(f"%.{d}f", _c(p))) for d in (2, 4)], F.format_string("%.6f", _c(p)))


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hms_utc(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "HH:mm:ss")


def iso_to_epoch_ms(text: Column | str, otherwise: Column | str) -> Column:
    """RFC 3339 text to milliseconds; text that is no time gives `otherwise` (the receive time)."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(_c(text))), _c(otherwise))


def safe_symbol(c: Column | str) -> Column:
    return F.replace(_c(c), F.lit("/"), F.lit("-"))


def side_of(is_buyer_maker: Column | str) -> Column:
    return F.when(_c(is_buyer_maker), "sell").otherwise("buy")


def quality_class(pct: Column | str) -> Column:
    return choose([(_c(pct) >= 80, "high"), (_c(pct) >= 40, "mid")], "low")


def up_down(close: Column | str, open_: Column | str) -> Column:
    return F.when(_c(close) >= _c(open_), "up").otherwise("down")


def expected_bars(interval: Column | str) -> Column:
    return F.floor(F.lit(86400) / _c(interval))


def path_parts(path: Column | str) -> dict[str, Column]:
    """exchange, symbol and day of a lake path, with or without `key=` before its levels: days as year/month/day, or as one date level as raw archives have.

    Names are given as they were before the writer escaped them (`%3D` is `=`); what is no escape stays.
    """
    p = _c(path)
    level = r"(?:exchange=)?([^/=]+)/(?:symbol=)?([^/=]+)/(?:(?:year=)?(\d{4})/(?:month=)?(\d{1,2})/(?:day=)?(\d{1,2})|(?:date=)?(\d{4}-\d{2}-\d{2}))/"
    get = lambda k: F.regexp_extract(p, level, k)
    day = F.make_date(get(3).try_cast("int"), get(4).try_cast("int"), get(5).try_cast("int"))
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    return {"exchange": plain(get(1)), "symbol": plain(get(2)), "day": F.coalesce(day, get(6).try_cast("date"))}
