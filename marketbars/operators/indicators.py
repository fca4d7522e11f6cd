"""Technical indicators for all series at once, without Python workers and without a task per series.

Rows get their number within the series from two levels (day counts, then the rank inside a day), so that no task sorts
a whole history. All windows then run over blocks of rows, each with a copy of the rows before it: one exchange and one
sort for any number of indicators. Frames of fixed length need that many rows before a block. Smoothing
y(t) = a y(t-1) + b x(t) is a running sum of b x a^-i times a^i inside a block; what lies before the copied rows weighs
less than 1e-18, beyond double precision, so blocks need nothing from each other.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import KEY

BLOCK_ROWS = 65_536
NEGLIGIBLE = math.log(1e-18)
#: Powers of e that doubles hold, with room for the values.
RANGE = 650.0


def with_row_number(df: DataFrame, order: str = "window_start", name: str = "rn") -> DataFrame:
    """Adds the row's number (from 1) in its series."""
    day = df.withColumn("_day", F.floor(F.unix_seconds(order) / 86400))
    counts = day.groupBy(*KEY, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*KEY).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*KEY, "_day", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*KEY, "_day").orderBy(order))
    return day.withColumn("_in", inside).join(starts, [*KEY, "_day"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_day", "_in", "_before")


def over_blocks(df: DataFrame, overlap: int, rn: str = "rn", block: int = BLOCK_ROWS) -> DataFrame:
    """df in blocks of rows, each with the `overlap` rows before it: adds _block, _own (the block a row belongs to) and _i (its place).

    Add window columns with over(), then drop the copies with own_rows().
    """
    own = F.floor((F.col(rn) - 1) / block)
    reach = F.floor((F.col(rn) - 1 + overlap) / block)
    copies = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, reach)))
    return copies.withColumn("_i", F.col(rn) - 1 - F.col("_block") * block + overlap)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_block = _own").drop("_own", "_block", "_i")


def over(rn: str = "rn"):
    return W.partitionBy(*KEY, "_block").orderBy(rn)


def frame(n: int, rn: str = "rn"):
    return over(rn).rowsBetween(-(n - 1), 0)


def sma(col: str, n: int, rn: str = "rn") -> Column:
    """Mean of the last n, null in the warm-up."""
    return F.when(F.col(rn) >= n, F.avg(col).over(frame(n, rn))) if n > 0 else F.lit(None).cast("double")


def bollinger(col: str, n: int = 20, m: float = 2.0, rn: str = "rn") -> dict[str, Column]:
    mid, dev = F.avg(col).over(frame(n, rn)), F.stddev_pop(col).over(frame(n, rn))
    ready = F.col(rn) >= n
    return {"bb_upper": F.when(ready, mid + m * dev), "bb_middle": F.when(ready, mid), "bb_lower": F.when(ready, mid - m * dev)}


def memory(n: int, b: float) -> int:
    """Rows before a block that smoothing by b with a seed of n needs."""
    return n + (math.ceil(NEGLIGIBLE / math.log(1 - b)) if b < 1 else 1)


def block_rows(overlap: int, *bs: float) -> int:
    """The longest block in which the powers of all smoothings stay in range."""
    steepest = min(1 - b for b in bs if b < 1) if any(b < 1 for b in bs) else 0.5
    room = math.floor(RANGE / -math.log(steepest)) - overlap
    if room < 64:
        raise ValueError("these smoothings differ too much for common blocks: take them one by one")
    return min(BLOCK_ROWS, room)


def smooth(blocks: DataFrame, col: str, n: int, b: float, out: str, start: int = 1, rn: str = "rn") -> DataFrame:
    """Adds out to over_blocks(): null before row start+n-1, the mean of the n values from row `start` there, then (1-b) out + b col."""
    a, seed_at, x = 1.0 - b, start + n - 1, F.col(col)
    if a <= 0:
        return blocks.withColumn(out, F.when(F.col(rn) >= seed_at, x))
    rows = blocks.withColumn("_seed", F.avg(x).over(frame(n, rn)))
    part = F.when(F.col(rn) == seed_at, F.col("_seed")).when(F.col(rn) > seed_at, b * x).otherwise(0.0) * F.pow(F.lit(a), -F.col("_i"))
    total = F.sum(part).over(over(rn).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(out, F.when(F.col(rn) >= seed_at, F.pow(F.lit(a), F.col("_i")) * total)).drop("_seed")


def _alpha(n: int) -> float:
    return 2.0 / (n + 1)


def ema(df: DataFrame, col: str, periods: dict[str, int], rn: str = "rn") -> DataFrame:
    """Adds the averages {name: period} of col to rows with their number rn."""
    bs = [_alpha(n) for n in periods.values()]
    overlap = max(memory(n, _alpha(n)) for n in periods.values())
    rows = over_blocks(df, overlap, rn, block_rows(overlap, *bs))
    for name, n in periods.items():
        rows = smooth(rows, col, n, _alpha(n), name, 1, rn)
    return own_rows(rows)


def _rsi(blocks: DataFrame, col: str, n: int, out: str, rn: str) -> DataFrame:
    """Wilder's index; 100 where there is no loss."""
    rows = blocks.withColumn("_diff", F.col(col) - F.lag(col).over(over(rn)))
    rows = rows.withColumn("_gain", F.greatest("_diff", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_diff"), F.lit(0.0)))
    rows = smooth(smooth(rows, "_gain", n, 1.0 / n, "_up", 2, rn), "_loss", n, 1.0 / n, "_down", 2, rn)
    value = F.when(F.col("_down") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_down")))
    return rows.withColumn(out, F.when(F.col("_up").isNotNull(), value)).drop("_diff", "_gain", "_loss", "_up", "_down")


def rsi(df: DataFrame, col: str = "close", n: int = 14, out: str = "rsi", rn: str = "rn") -> DataFrame:
    overlap = memory(n, 1.0 / n) + 1
    return own_rows(_rsi(over_blocks(df, overlap, rn, block_rows(overlap, 1.0 / n)), col, n, out, rn))


def _macd(blocks: DataFrame, col: str, fast: int, slow: int, signal: int, rn: str) -> DataFrame:
    rows = smooth(smooth(blocks, col, fast, _alpha(fast), "ema_fast", 1, rn), col, slow, _alpha(slow), "ema_slow", 1, rn)
    rows = rows.withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    return smooth(rows, "macd", signal, _alpha(signal), "macd_signal", slow, rn).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def _macd_overlap(fast: int, slow: int, signal: int) -> int:
    return max(memory(fast, _alpha(fast)), memory(slow, _alpha(slow))) + memory(signal, _alpha(signal))


def macd(df: DataFrame, col: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, rn: str = "rn") -> DataFrame:
    """Adds ema_fast, ema_slow, macd, macd_signal (seeded by the first values of macd) and macd_hist."""
    overlap = _macd_overlap(fast, slow, signal)
    rows = over_blocks(df, overlap, rn, block_rows(overlap, *map(_alpha, (fast, slow, signal))))
    return own_rows(_macd(rows, col, fast, slow, signal, rn))


def all_indicators(bars: DataFrame, numbered: bool = False) -> DataFrame:
    """Bars with rsi, MACD, bands, averages, and the values of the row before that signals look at, all in one pass over blocks.

    numbered: the rows have their number rn already.
    """
    overlap = _macd_overlap(12, 26, 9) + 1
    rows = over_blocks(bars if numbered else with_row_number(bars), overlap, "rn", block_rows(overlap, _alpha(9)))
    rows = _macd(_rsi(rows, "close", 14, "rsi", "rn"), "close", 12, 26, 9, "rn")
    last = lambda c: F.lag(c).over(over())
    columns = {f"sma{n}": sma("close", n) for n in (20, 50, 200)} | bollinger("close") | {"prev_hist": last("macd_hist"), "prev_fast": last("ema_fast"), "prev_slow": last("ema_slow")}
    return own_rows(rows.select("*", *[c.alias(k) for k, c in columns.items()]))


def volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Per series: volume of the last bar, mean of the last n live bars (1 if none), their ratio (1 if the mean is 0)."""
    live = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("window_start")))
    means = bars.where("is_live").withColumn("_r", live).where(F.col("_r") <= n).groupBy(*KEY).agg(F.avg("volume_base").alias("avg_volume"))
    now = bars.groupBy(*KEY).agg(F.max_by("volume_base", "window_start").alias("current_volume"))
    both = now.join(means, list(KEY), "left").withColumn("avg_volume", F.coalesce("avg_volume", F.lit(1.0)))
    return both.withColumn("volume_ratio", F.when(F.col("avg_volume") > 0, F.col("current_volume") / F.col("avg_volume")).otherwise(1.0))
