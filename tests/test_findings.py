"""Queries whose SQL, size or reach a review found wrong, on small inputs that show it."""

from __future__ import annotations

import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as E  # noqa: E402
from marketbars.operators import gaps as G  # noqa: E402
from marketbars.plans import lake_queries as LQ  # noqa: E402

SMALL = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def both(spark, tmp_path):
    """Rows of a query over some events (id, seconds, user, type, value, quantity), from Spark and from its SQL."""

    def run(name: str, events: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=s), u, kind, v, f'{{"k": {q}}}') for i, s, u, kind, v, q in events]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
        df = E.queries()[name](spark, str(tmp_path))
        with duckdb.connect() as c:
            c.execute("SET TimeZone = 'UTC'")
            c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
            cur = c.execute(E.oracle_sql()[name])
            at = [[d[0] for d in cur.description].index(k) for k in df.columns]
            return sorted(map(tuple, df.collect())), sorted(tuple(r[k] for k in at) for r in cur.fetchall())

    return run


#: Two series of live bars; a bar of the first one opens at nothing.
ZERO_OPEN = [(1, 0, 0, "view", 5.0, 2), (2, 3600, 0, "view", 0.0, 2), (3, 3700, 0, "view", 7.0, 9), (4, 7200, 1, "click", 5.0, 2)]


def test_violations_of_all_kinds_are_in_the_sql(both):
    spark_rows, sql_rows = both("a14_ohlcv_violations", ZERO_OPEN)
    assert spark_rows == sql_rows
    assert [r[-1] for r in sql_rows] == ["FAIL: zero_open:1", "FAIL: high<low:1, high<open:1, high<close:1"]


def test_series_that_fail_are_counted(both):
    spark_rows, sql_rows = both("a15_all_ok", ZERO_OPEN)
    assert spark_rows == sql_rows == [(False, 1)]


def test_release_check_judges_all_violations(both):
    spark_rows, sql_rows = both("c20_release_check", ZERO_OPEN)
    assert spark_rows == sql_rows == [(0, "ok", False, False)]


def test_release_check_can_pass(both):
    """All bars are of today, which no series can miss."""
    spark_rows, sql_rows = both("c20_release_check", [(1, 0, 0, "view", 5.0, 2), (2, 3600, 0, "view", 6.0, 2)])
    assert spark_rows == sql_rows == [(0, "ok", True, True)]


def test_indicators_start_from_the_first_bar(both):
    """600 bars of a series: none of them is left out."""
    spark_rows, sql_rows = both("c11_indicators", [(i, i * 3600, 0, "view", 50.0 + i * 7 % 11 + (i % 13) * 0.25, 1 + i % 5) for i in range(600)])
    assert spark_rows == sql_rows and spark_rows[0][2] == 600 - 4 * len({i // 24 for i in range(600) if (i // 24 + 1) % 9 == 4})


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_disconnects_look_back_not_ahead(spark):
    """A frame up to the end of a day would be gone through again for each row; equal times, nulls and midnight as by loops."""
    rnd, day = random.Random(4), 86_400
    events = [(rnd.choice("ab"), rnd.choice(["disconnect", "reconnect"]), rnd.randrange(4 * day - 300, 4 * day + 300)) for _ in range(300)] + [("a", "disconnect", None), ("c", "disconnect", 5), ("c", "reconnect", 3 * day)]
    df = spark.createDataFrame(events, "exchange string, event string, s long").select("exchange", "event", F.timestamp_seconds("s").alias("ts"))
    got = G.disconnect_gaps(df, 10.0)
    expected = []
    for e, kind, s in events:
        later = [r for x, k, r in events if x == e and k == "reconnect" and s is not None and r >= s]
        if kind == "disconnect" and later and min(later) - s >= 10:
            expected.append((e, s, float(min(later) - s)))
    assert sorted(map(tuple, got.select("exchange", F.unix_seconds("gap_start"), "gap_seconds").collect())) == sorted(expected)
    assert "unboundedfollowing" not in plan(got)


@pytest.mark.parametrize("name", ["s7_raw_archive", "k6_retain_raw_archive"])
def test_names_of_raw_files_are_taken_apart_once_a_file(spark, name):
    """Lines are folded by file first: no name is taken apart before the lowest aggregation."""
    lines = plan(E.queries()[name](spark, SMALL)).splitlines()
    lowest = max(k for k, x in enumerate(lines) if "Aggregate [" in x)
    assert "regexp_extract" in "".join(lines[: lowest + 1]) and "regexp_extract" not in "".join(lines[lowest + 1 :])


def test_parts_of_a_stream_are_written_by_many_tasks(spark):
    """A part is one batch of as many files as its table has partitions, not one file that one task writes."""
    files, batches = [], []

    def start(stream):
        def see(part, k):
            batches.append(part.count())
            files.append(part.select(F.input_file_name()).distinct().count())

        return stream.writeStream.foreachBatch(see).option("checkpointLocation", f"{LQ.work_dir(spark)}/state").trigger(availableNow=True)

    LQ._batches_of(spark, spark.range(0, 90, 1, 3), [F.lit(True)], start)
    assert batches == [90] and files == [3]


def test_bars_of_a_kept_lake_are_made_once(spark):
    """They are read from a stored table by the jobs that use them; the events are not folded again."""
    bars = LQ._late_day(spark, SMALL)[2]
    assert "events.parquet" not in "".join(bars.inputFiles()) and "Aggregate" not in plan(bars)
