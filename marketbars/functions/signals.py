"""Signals and regime labels over indicator columns. Nulls take the neutral value that each rule names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import _c, choose, safe_ratio


def _or(c: Column | str, value: object) -> Column:
    return F.coalesce(_c(c), value if isinstance(value, Column) else F.lit(value))


def rsi_signal(rsi: Column | str) -> Column:
    v = _or(rsi, 50.0)
    return choose([(v < 30, "oversold"), (v > 70, "overbought")], "neutral")


def rsi_note(rsi: Column | str) -> Column:
    v = _or(rsi, 50.0)
    return choose([(v < 30, "approaching support"), (v > 70, "approaching resistance"), (v > 60, "approaching overbought"), (v < 40, "approaching oversold")], "mid-range")


def macd_direction(hist: Column | str, prev: Column | str) -> Column:
    h, p = _or(hist, 0.0), _or(prev, 0.0)
    rising = F.when(h >= p, "bullish_accelerating").otherwise("bullish_weakening")
    falling = F.when(F.abs(h) <= F.abs(p), "bearish_weakening").otherwise("bearish_accelerating")
    return choose([(h > 0, rising), (h < 0, falling)], "neutral")


def macd_crossover(macd: Column | str, signal: Column | str) -> Column:
    m, s = _or(macd, 0.0), _or(signal, 0.0)
    return choose([((m > s) & (m - s < F.abs(m) * 0.01 + 0.001), "bullish_crossover"), ((m < s) & (s - m < F.abs(s) * 0.01 + 0.001), "bearish_crossover")], "none")


def bb_position(price: Column | str, upper: Column | str, lower: Column | str) -> Column:
    p, u, lo = _c(price), _or(upper, _c(price)), _or(lower, _c(price))
    return F.when(u > lo, (p - lo) / (u - lo)).otherwise(0.5)


def bb_signal(pos: Column | str) -> Column:
    return choose([(_c(pos) > 0.8, "near_upper"), (_c(pos) < 0.2, "near_lower"), (_c(pos) >= 0.5, "upper_half")], "lower_half")


def sma_trend(price: Column | str, *smas: Column | str) -> Column:
    """Aligned if price and averages fall (or rise) strictly from the short to the long one."""
    chain = [_c(price), *(_or(s, _c(price)) for s in smas)]
    down = up = F.lit(True)
    for a, b in zip(chain, chain[1:], strict=False):
        down, up = down & (a > b), up & (a < b)
    return choose([(down, "bullish_aligned"), (up, "bearish_aligned")], "mixed")


def ema_signal(fast: Column | str, slow: Column | str, prev_fast: Column | str, prev_slow: Column | str, price: Column | str) -> Column:
    f, s = _or(fast, _c(price)), _or(slow, _c(price))
    pf, ps = _c(prev_fast), _c(prev_slow)
    was_under = pf.isNull() | ps.isNull() | (pf <= ps)
    was_over = pf.isNull() | (pf >= _or(ps, 0.0))
    return F.when(f > s, F.when(was_under, "bullish_crossover").otherwise("bullish")).otherwise(F.when(was_over, "bearish_crossover").otherwise("bearish"))


def vwap_signal(price: Column | str, vwap: Column | str) -> Column:
    return F.when(_c(price) > _c(vwap), "bullish").otherwise("bearish")


def price_vs_vwap(price: Column | str, vwap: Column | str) -> Column:
    return F.when(_c(price) > _c(vwap), "above").otherwise("below")


def volume_signal(ratio: Column | str) -> Column:
    return choose([(_c(ratio) > 1.5, "elevated"), (_c(ratio) < 0.5, "low")], "normal")


def regime_votes(rsi: Column, hist: Column, bb_pos: Column, fast: Column, slow: Column, price: Column, vwap: Column, trend: Column) -> tuple[Column, Column]:
    """(bullish, total): five signals that always vote, and the trend where it is aligned."""
    for_it = [_or(rsi, 50.0) > 50, _or(hist, 0.0) > 0, bb_pos > 0.5, _or(fast, price) > _or(slow, price), price > vwap]
    bullish = F.lit(0)
    for v in [*for_it, trend == "bullish_aligned"]:
        bullish = bullish + v.cast("int")
    return bullish, F.lit(len(for_it)) + (trend != "mixed").cast("int")


def regime_confidence(bullish: Column, total: Column) -> Column:
    most = F.greatest(bullish, total - bullish)
    return choose([(total == 0, "low"), (most >= total - 1, "high"), (most >= F.floor(total * 0.6), "medium")], "low")


def regime_label(bullish: Column, total: Column, symmetric: bool = False) -> Column:
    """symmetric: bearish momentum is told before bearish bias, as bullish momentum is; by default it can't be reached."""
    bearish = total - bullish
    momentum = [(bearish >= total - 1, "bearish_momentum")]
    bias = [(bullish > bearish + 1, "bullish_bias"), (bearish > bullish + 1, "bearish_bias")]
    return choose([(total == 0, "neutral_ranging"), (bullish >= total - 1, "bullish_momentum"), *(momentum + bias if symmetric else bias + momentum)], "neutral_ranging")


def funding_vote(bullish: Column, total: Column, rate: Column | str, doubled: bool = True) -> tuple[Column, Column, Column]:
    """(bullish, total, basis) with the funding rate's vote; doubled: a rate of 0 or less counts twice against."""
    r = _c(rate)
    against = 2 if doubled else 1
    b = bullish + F.coalesce((r > 0).cast("int"), F.lit(0))
    t = total + choose([(r.isNull(), 0), (r > 0, 1)], against)
    return b, t, choose([(r.isNull(), F.lit(None)), (r > 0, "positive_funding")], "negative_funding")


def scan_score(sort: str, rsi: Column, hist: Column, price: Column, sma20: Column, ratio: Column, upper: Column, lower: Column, middle: Column) -> Column:
    sign = lambda test: F.when(test, 1.0).otherwise(-1.0)
    return {
        "momentum": ((rsi - 50) / 50 + sign(hist > 0) + sign(price > sma20)) / 3,
        "volume": ratio,
        "volatility": safe_ratio(upper - lower, middle, 0.0),
        "rsi_extreme": F.abs(rsi - 50) / 50,
    }.get(sort, F.lit(0.0))
