"""Audits of a lake of bars: summaries, completeness, sources, OHLC validity, freshness and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.columns import choose, expected_bars, fmt_dur, hms_utc, safe_ratio
from ..schema import KEY
from . import gaps as G

DAY = F.to_date
n_rows = lambda: F.count(F.lit(1))


def pct(part: Column | str, whole: Column | str, default: object = 0.0) -> Column:
    p, w = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return safe_ratio(p * 100.0, w, default)


def _is(source: str) -> Column:
    return F.col("source").startswith("backfill") if source == "backfill" else F.col("source") == source


def symbol_summary(bars: DataFrame) -> DataFrame:
    hours = (F.unix_seconds(F.max("window_start")) - F.unix_seconds(F.min("window_start"))) / 3600.0
    out = bars.groupBy(*KEY).agg(
        n_rows().alias("total_bars"), F.count_if(_is("live")).alias("live_bars"), F.count_if(F.col("trade_count") == 0).alias("empty_bars"), F.sum("trade_count").alias("total_trades"),
        F.min("window_start").alias("earliest"), F.max("window_start").alias("latest"), F.max_by("close", "window_start").alias("last_close"), hours.alias("data_hours"))
    return out.withColumn("live_pct", pct("live_bars", "total_bars"))


def lake_rollup(summary: DataFrame) -> DataFrame:
    return summary.agg(n_rows().alias("symbols"), F.sum("total_bars").alias("bars"), F.sum("live_bars").alias("live"), F.sum("total_trades").alias("trades"), F.avg("live_pct").alias("avg_live_pct"))


def day_stats(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEY, DAY("window_start").alias("day")).agg(
        n_rows().alias("bars"), F.min("window_start").alias("first_ts"), F.max("window_start").alias("last_ts"), F.count_if(_is("live")).alias("live"),
        F.count_if(_is("backfill")).alias("backfill"), F.count_if(_is("empty")).alias("empty"), F.sum("trade_count").alias("trades"), F.count_distinct("source").alias("n_sources"))


def fast_day_stats(bars: DataFrame) -> DataFrame:
    return day_stats(bars).select(*KEY, "day", "bars", pct("live", "bars").alias("live_pct"), pct("empty", "bars").alias("empty_pct"))


def recent_quality(bars: DataFrame, dim: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    """Per configured series over the last hours; a series without rows says so. dim: exchange, symbol."""
    traded = F.col("trade_count") > 0
    q = bars.where(F.unix_seconds("window_start") >= F.unix_seconds(as_of) - hours * 3600).groupBy(*KEY).agg(
        n_rows().alias("total"), F.count_if(traded).alias("with_trades"), F.count_if(_is("live")).alias("ws_live"), F.count_if(_is("empty")).alias("empty"), F.count_if(_is("backfill")).alias("backfill"),
        F.min("window_start").alias("first"), F.max("window_start").alias("last"), F.max("close").alias("max_close"), F.min("close").alias("min_close"))
    q = q.withColumn("live_pct", pct("with_trades", "total")).withColumn("ws_pct", pct("ws_live", "total"))
    out = dim.select(*KEY).join(q, list(KEY), "left")
    return out.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("note", F.when(F.col("total") == 0, "no data in window").otherwise(""))


def source_distribution(bars: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = bars.groupBy(*by, "source").agg(n_rows().alias("bars"))
    return counts.withColumn("pct", pct("bars", F.sum("bars").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0)))))


def source_breakdown(bars: DataFrame) -> DataFrame:
    """Map of source to count for each series, and for all (null keys)."""
    counts = bars.groupBy(*KEY, "source").agg(n_rows().alias("n"))
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources")
    overall = counts.groupBy("source").agg(F.sum("n").alias("n")).agg(entries).select(*[F.lit(None).cast("string").alias(k) for k in KEY], "sources")
    return counts.groupBy(*KEY).agg(entries).unionByName(overall)


def hourly_profile(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.date_format("window_start", "HH").alias("hour")).agg(n_rows().alias("bars"), F.sum("trade_count").alias("trades"), F.avg("close").alias("avg_close"), F.sum("volume_base").alias("volume"))


#: name of a violation -> the test and whether it holds for live bars only.
OHLC_RULES = {
    "high<low": ("high < low", False),
    "high<open": ("high < open", True),
    "high<close": ("high < close", True),
    "low>open": ("low > open", True),
    "low>close": ("low > close", True),
    "neg_vol": ("volume_base < 0", False),
    "zero_open": ("open <= 0", True),
}


def ohlcv_violations(bars: DataFrame) -> DataFrame:
    """Counts of each violation (v0, v1 ... in the order of OHLC_RULES), extremes of live bars, and a status text."""
    counts = [F.count_if(F.expr(test) & (_is("live") if live else F.lit(True))).alias(f"v{i}") for i, (test, live) in enumerate(OHLC_RULES.values())]
    live = lambda f, c: f(F.when(_is("live"), F.col(c)))
    out = bars.groupBy(*KEY).agg(n_rows().alias("total"), *counts, live(F.min, "open").alias("min_open"), live(F.max, "open").alias("max_open"), live(F.min, "volume_base").alias("min_volume"))
    issues = F.concat_ws(", ", *[F.when(F.col(f"v{i}") > 0, F.concat(F.lit(f"{name}:"), F.col(f"v{i}").cast("string"))) for i, name in enumerate(OHLC_RULES)])
    return out.withColumn("status", F.when(issues == "", "OK").otherwise(F.concat(F.lit("FAIL: "), issues)))


def all_ok(violations: DataFrame) -> DataFrame:
    return violations.agg(F.coalesce(F.bool_and(F.col("status") == "OK"), F.lit(True)).alias("all_ok"), F.count_if(F.col("status") != "OK").alias("failed"))


def count_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEY, DAY("window_start").alias("day")).agg(n_rows().alias("bars"))


def calendar(dim: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row for each series of dim and each day of the range."""
    return dim.withColumn("day", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def missing_days(bars: DataFrame, dim: DataFrame, start: Column, end: Column, today: Column) -> DataFrame:
    have = bars.select(*KEY, DAY("window_start").alias("day")).distinct()
    return calendar(dim.select(*KEY), start, end).where(F.col("day") != today).join(have, [*KEY, "day"], "left_anti")


def interval_mode(bars: DataFrame, dim: DataFrame, n: int = 51) -> DataFrame:
    """Most frequent distance among the first n bars of a series, its count, the three most frequent, and whether it is as configured."""
    first = bars.withColumn("_r", F.row_number().over(W.partitionBy(*KEY).orderBy("window_start"))).where(F.col("_r") <= n)
    d = F.unix_seconds("window_start") - F.unix_seconds(F.lag("window_start").over(W.partitionBy(*KEY).orderBy("window_start")))
    counts = first.withColumn("diff", d).where("diff IS NOT NULL").groupBy(*KEY, "diff").agg(n_rows().alias("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "diff")))
    out = counts.groupBy(*KEY).agg(F.slice(order, 1, 3).alias("top")).join(F.broadcast(dim.select("exchange", "interval_sec").distinct()), "exchange")
    mode = F.col("top")[0]
    return out.select(*KEY, mode["diff"].alias("mode_sec"), (-mode["less"]).alias("mode_count"), F.concat_ws(",", F.transform("top", lambda x: F.concat_ws("x", x["diff"].cast("string"), (-x["less"]).cast("string")))).alias("top3"),
                      F.when(mode["diff"] == F.col("interval_sec"), "OK").otherwise("MISMATCH").alias("status"))


def completeness_report(bars: DataFrame, dim: DataFrame, start: Column, end: Column, today: Column) -> DataFrame:
    """Per configured series and day: counts, gaps inside the day, times, percent of expected bars and a status. dim: exchange, symbol, interval_sec."""
    stats = day_stats(bars)
    holes = G.find_gaps(bars, 2, within_day=True, dim=dim).groupBy(*KEY, DAY("gap_start").alias("day")).agg(n_rows().alias("gaps"))
    return report_of_days(stats, holes, dim, start, end, today)


def report_of_days(stats: DataFrame, holes: DataFrame, dim: DataFrame, start: Column, end: Column, today: Column) -> DataFrame:
    """The report from day_stats and the number of gaps (KEY, day, gaps) of each day."""
    rows = calendar(dim, start, end).join(stats, [*KEY, "day"], "left").join(holes, [*KEY, "day"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    share = F.round(zero("bars") * 100.0 / expected_bars("interval_sec"), 1)
    status = choose([(F.col("bars").isNull(), "MISSING"), (F.col("day") == today, "partial"), (share >= 90, "OK")], "LOW")
    return rows.select(*KEY, "day", zero("bars").alias("bar_count"), zero("live").alias("live"), zero("backfill").alias("backfill"), zero("empty").alias("empty"), zero("gaps").alias("gaps"),
                       hms_utc("first_ts").alias("first"), hms_utc("last_ts").alias("last"), share.alias("pct"), status.alias("status"))


def full_audit_summary(report: DataFrame) -> DataFrame:
    total = F.sum("bar_count")
    share = lambda c: F.round(safe_ratio(F.sum(c) * 100.0, total, 0.0), 1)
    return report.groupBy(*KEY).agg(F.count_if(F.col("bar_count") > 0).alias("days_present"), total.alias("total_bars"), F.sum("gaps").alias("total_gaps"), share("live").alias("live_pct"), share("backfill").alias("backfill_pct"))


def audit_day_notes(bars: DataFrame, dim: DataFrame, least_pct: float = 80.0) -> DataFrame:
    """Notes per day: incomplete below least_pct of the expected bars, and the first two gaps."""
    intervals = dim.select("exchange", "interval_sec").distinct()  # a row for each exchange
    holes = G.find_gaps(bars, 2, within_day=True, dim=dim).withColumn("day", DAY("gap_start"))
    firsts = holes.groupBy(*KEY, "day").agg(F.slice(F.sort_array(F.collect_list(F.struct("gap_start", "duration_sec"))), 1, 2).alias("g"))
    texts = F.transform("g", lambda x: F.concat(hms_utc(x["gap_start"]), F.lit(" "), fmt_dur(x["duration_sec"], "tight")))
    rows = count_bars(bars).join(F.broadcast(intervals), "exchange").join(firsts, [*KEY, "day"], "left")
    share = F.round(F.col("bars") * 100.0 / expected_bars("interval_sec"), 1)
    return rows.select(*KEY, "day", "bars", F.concat_ws("; ", F.when(share < least_pct, "INCOMPLETE"), F.concat_ws(", ", texts)).alias("notes"))


def coverage(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    span = F.unix_seconds(F.max("window_start")) - F.unix_seconds(F.min("window_start"))
    base = bars.groupBy(*KEY).agg(n_rows().alias("bars"), span.alias("span_sec"), pct(F.count_if(F.col("trade_count") > 0), n_rows()).alias("trade_pct")).where("bars >= 2")
    holes = gaps.groupBy(*KEY).agg(n_rows().alias("gap_count"), F.sum("duration_sec").alias("gap_sec"))
    out = base.join(holes, list(KEY), "left").withColumn("gap_count", F.coalesce("gap_count", F.lit(0))).withColumn("gap_sec", F.coalesce("gap_sec", F.lit(0)))
    return out.withColumn("coverage_pct", pct(F.col("span_sec") - F.col("gap_sec"), F.col("span_sec")))


def gap_overall(bars: DataFrame, cover: DataFrame) -> DataFrame:
    period = bars.agg(F.min("window_start").alias("first"), F.max("window_start").alias("last"), n_rows().alias("bars"), F.count_if(F.col("trade_count") > 0).alias("with_trades"), F.count_if(F.col("trade_count") == 0).alias("no_trades"), F.count_distinct("exchange").alias("exchanges"), F.count_distinct("symbol").alias("symbols"))
    return period.crossJoin(cover.agg(F.sum("span_sec").alias("span_sec"), F.sum("gap_count").alias("gaps")))  # a row on each side


def stats_24h(bars: DataFrame, tf: int) -> DataFrame:
    """Over the last 86400/tf bars of each series: open, high, low, live volume, trades, live vwap (the price if none), change."""
    rank = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("window_start")))
    day = bars.withColumn("_r", rank).where(F.col("_r") <= 86400 // tf)
    live = lambda c: F.sum(F.when(F.col("is_live"), c).otherwise(0.0))
    price, start = F.max_by("close", "window_start"), F.min_by("open", "window_start")
    return day.groupBy(*KEY).agg(
        price.alias("price"), start.alias("open_24h"), F.max("high").alias("high_24h"), F.min("low").alias("low_24h"), live(F.col("volume_base")).alias("volume_24h"), F.sum("trade_count").alias("trades_24h"),
        safe_ratio(live(F.col("vwap") * F.col("volume_base")), live(F.col("volume_base")), price).alias("vwap_24h"), safe_ratio((price - start) * 100.0, start, 0.0).alias("change_24h_pct"))


def last_bar_age(bars: DataFrame, as_of: Column) -> DataFrame:
    return bars.agg(((F.unix_seconds(as_of) - F.unix_seconds(F.max("window_start"))) / 60.0).alias("age_minutes"), F.max("window_start").alias("last_bar"))


def latest_timestamp(bars: DataFrame, before: Column) -> DataFrame:
    return bars.where(F.col("window_start") < before).groupBy(*KEY).agg(F.max("window_start").alias("latest"))


def collector_counters(trades: DataFrame, bars: DataFrame, events: DataFrame) -> DataFrame:
    one = lambda df, **c: df.agg(*[v.alias(k) for k, v in c.items()])
    parts = [one(trades, messages=n_rows(), trades=F.count("price")), one(bars, bars=n_rows()), one(events, disconnects=F.count_if(F.col("event") == "disconnect"), reconnects=F.count_if(F.col("event") == "reconnect"))]
    return reduce(DataFrame.crossJoin, parts)  # a row on each side


def freshness(bars: DataFrame, as_of: Column, stale: int = 300, health_ts: Column | None = None) -> DataFrame:
    """status and age (seconds, one decimal) of the newest bar; an old health record makes a fresh lake stale."""
    age = F.unix_seconds(as_of) - F.unix_seconds(F.max("window_start"))
    cases = [(F.max("window_start").isNull(), "unknown"), (age > stale, "stale")]
    if health_ts is not None:
        cases.append((F.unix_seconds(as_of) - F.unix_seconds(health_ts) > 2 * stale, "stale"))
    return bars.agg(choose(cases, "ok").alias("status"), F.round(age.cast("double"), 1).alias("age_sec"))


def alerts(quality: DataFrame, recent: DataFrame, ages: DataFrame | None = None) -> DataFrame:
    """Rows (kind, subject, value) of what needs attention. ages: kind ('health' or 'raw'), minutes (null: there is none)."""
    low = quality.where((F.col("total") > 0) & (F.col("ws_live") < F.col("total") * 0.1 / 100)).select(F.lit("LOW LIVE DATA").alias("kind"), F.concat_ws("/", *KEY).alias("subject"), F.col("ws_live").cast("double").alias("value"))
    gap = recent.where("significant > 0").select(F.lit("GAP").alias("kind"), F.concat_ws("/", *KEY).alias("subject"), F.col("longest_sec").cast("double").alias("value"))
    out = low.unionByName(gap)
    if ages is not None:
        limit = F.when(F.col("kind") == "health", 5.0).otherwise(10.0)
        out = out.unionByName(ages.where(F.col("minutes").isNull() | (F.col("minutes") > limit)).select(F.concat(F.when(F.col("minutes").isNull(), "NO ").otherwise("STALE "), F.upper("kind")).alias("kind"), F.lit("lake").alias("subject"), F.col("minutes").cast("double").alias("value")))
    return out


def file_count_matrix(inventory: DataFrame, dim: DataFrame, days: list[str]) -> DataFrame:
    """Per configured series: number of files of each day of the list (MISS if none) and how many days miss."""
    counts = inventory.withColumn("d", F.col("day").cast("string")).groupBy(*KEY).pivot("d", days).agg(n_rows())
    rows = dim.select(*KEY).distinct().join(counts, list(KEY), "left")
    missing = reduce(lambda a, b: a + b, [F.col(f"`{d}`").isNull().cast("long") for d in days])
    return rows.select(*KEY, *[F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("MISS")).alias(d) for d in days], missing.alias("missing"))


def file_counts_by_day(inventory: DataFrame, dim: DataFrame, start: Column, end: Column) -> DataFrame:
    """The matrix in long form, for any range: a row for each configured series and day, with its files and MISS or the number as text."""
    counts = inventory.groupBy(*KEY, "day").agg(n_rows().alias("files"))
    rows = calendar(dim.select(*KEY).distinct(), start, end).join(counts, [*KEY, "day"], "left")
    return rows.select(*KEY, "day", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.coalesce(F.col("files").cast("string"), F.lit("MISS")).alias("cell"))
