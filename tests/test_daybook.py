"""Day aggregates that are kept beside a lake: equal to the full run, reading only what was touched."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketbars.operators import audit as A
from marketbars.operators import daybook as D
from marketbars.schema import BARS_SCHEMA
from marketbars.sources import daybook as K
from marketbars.sources import lake as L

T0 = datetime(2024, 1, 1)


def bar(sec: int, close: float | None = 10.0, series: str = "e/s", source: str | None = "live", n: int | None = 1) -> tuple:
    e, s = series.split("/")
    return (T0 + timedelta(seconds=sec), e, s, close, close, close, close, 1.0, close, n, close, 0.0, 0.0, 0.0, source)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def place(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return f"file://{tmp_path}/lake", f"file://{tmp_path}/book"


@pytest.fixture(scope="module")
def bars(spark):
    """Three series over five days: gaps, repeated times, null counts, an odd name, a day that one of them lacks."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = []
    for k, s in enumerate(["a/X-Y", "a/Q=1 %", "b/Z"]):
        for i in range(0, 5 * 1440, 7 + k):
            if (i * 31 + k) % 11 < 8 and not (k == 2 and 1440 <= i < 2880):
                out.append(bar(60 * i, 1.0 + i, s, ["live", "empty", "backfill_1m", "backfill_2"][(i + k) % 4], None if i % 1440 < 9 else i % 3))
                out += [out[-1]] * (i % 200 == 0)
    return spark.createDataFrame(out, BARS_SCHEMA)


def same_as_full(spark, root, book):
    full, days = L.read_bars(spark, root), K.read_daybook(spark, book)
    dim = spark.createDataFrame([("a", "X-Y", 60), ("a", "Q=1 %", 60), ("b", "Z", 600), ("b", "NONE", 600)], "exchange string, symbol string, interval_sec int")
    ends = F.lit("2024-01-01").cast("date"), F.lit("2024-01-06").cast("date"), F.lit("2024-01-05").cast("date")
    assert rows(D.day_stats(days)) == rows(A.day_stats(full))
    assert rows(D.fast_day_stats(days)) == rows(A.fast_day_stats(full))
    assert rows(D.count_bars(days)) == rows(A.count_bars(full))
    assert rows(D.completeness_report(days, dim, *ends)) == rows(A.completeness_report(full, dim, *ends))
    assert rows(D.symbol_summary(days)) == rows(A.symbol_summary(full))
    assert rows(D.missing_days(days, dim, *ends)) == rows(A.missing_days(full, dim, *ends))


def test_only_touched_days_are_read(spark, bars, place):
    root, book = place
    late = (F.to_date("window_start") == "2024-01-03") & (F.col("symbol") == "X-Y")
    L.write_bars(bars.where(~late), root)
    assert K.refresh(spark, root, book).count() == 13 and K.refresh(spark, root, book).count() == 0
    same_as_full(spark, root, book)
    L.write_bars(bars.where(late), root)
    plan = K.touched(spark, root, book)
    assert [(r.symbol, str(r.day), r.files, r.was) for r in plan.collect()] == [("X-Y", "2024-01-03", 1, None)]
    read = K.bars_of(spark, root, plan)
    assert read.count() == bars.where(late).count()
    assert "dynamicpruning" in read._jdf.queryExecution().toString()
    assert K.refresh(spark, root, book).count() == 1
    same_as_full(spark, root, book)


def test_what_is_gone_or_lost(spark, bars, place, tmp_path):
    """Deleted directories leave the book; partitions that a killed refresh lost are made again; compaction changes nothing but states."""
    root, book = place
    for part in bars.randomSplit([1.0, 1.0], 3):
        L.write_bars(part, root)
    K.refresh(spark, root, book)
    shutil.rmtree(tmp_path / "book/days/day=2024-01-02")
    assert {str(r.day) for r in K.refresh(spark, root, book).collect()} == {"2024-01-02"}
    same_as_full(spark, root, book)
    before = rows(K.read_daybook(spark, book).select("exchange", "symbol", "day", *D.NAMES))
    L.compact(spark, root, F.lit("2100-01-01").cast("date"), f"file://{tmp_path}/staging")
    assert K.refresh(spark, root, book).count() == len(before)
    assert rows(K.read_daybook(spark, book).select("exchange", "symbol", "day", *D.NAMES)) == before
    shutil.rmtree(next((tmp_path / "lake/exchange=a/symbol=X-Y").rglob("day=04")))
    assert [(r.symbol, r.files) for r in K.refresh(spark, root, book).collect()] == [("X-Y", 0)]
    assert K.refresh(spark, root, book).count() == 0
    same_as_full(spark, root, book)


def test_an_empty_lake(spark, place, tmp_path):
    (tmp_path / "lake").mkdir()
    root, book = place
    assert K.refresh(spark, root, book).count() == 0 and K.read_daybook(spark, book).count() == 0


def test_aggregates_of_small_days(spark):
    """Null times are left out; one bar has no distance; repeated times have a distance of zero; null sources aren't counted."""
    df = spark.createDataFrame([bar(5, 1.0, n=None), bar(86400, 2.0, source=None), bar(86400, 2.0, source="empty"), bar(86460, 3.0, n=0)], BARS_SCHEMA)
    lost = df.limit(1).withColumn("window_start", F.lit(None).cast("timestamp"))
    got = [(str(r.day), r.bars, r.trades, r.idle, r.last_close, r.sources, [tuple(x) for x in r.steps]) for r in D.day_aggregates(df.unionByName(lost)).orderBy("day").collect()]
    assert got == [("2024-01-01", 1, None, 0, 1.0, ["live"], []), ("2024-01-02", 3, 2, 1, 3.0, ["empty", "live"], [(0, 1), (60, 1)])]
