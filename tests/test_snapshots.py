"""Changes and newest priorities from turning batches against those from every batch."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import corpus
from missive.operators import priority
from missive.plans.ledger import Ledger
from missive.sources import csv

HEAD = "message_id,timestamp,sender,message\n"
#: ends of later batches: day by day past every bound, a leap, back in time, a day that can't be told
ENDS = ["2026-10-09 08:00:00", "2026-10-10 08:00:00", "2026-10-13 08:00:00", "2026-10-14 08:00:00", "2026-10-17 08:00:00", "2026-10-19 08:00:00", "2026-10-20 08:00:00", "2026-10-21 08:00:00", "2026-11-30 08:00:00", "2026-10-12 08:00:00", "some day", "2026-10-01 08:00:00", "2026-12-01 08:00:00"]
EXTRA = "C01,2026-10-08 11:00:00,Mira,Please review the harbour lease before 2026-10-20.\nC02,2026-10-08 11:10:00,Mira,Please paint the boat shed by 2026-10-13.\n"


@pytest.fixture(scope="module")
def led(spark):
    texts = [corpus.FIRST, corpus.SECOND + EXTRA, *(f"{HEAD}D{i:02},{end},Sam,The canteen is closed tomorrow.\n" for i, end in enumerate(ENDS))]
    return Ledger(csv.stacked([(f"batch {i}", csv.read_messages(spark, t)) for i, t in enumerate(texts)]))


def _rows(df):
    names = sorted(df.columns)
    return sorted(str(r.asDict(recursive=True)) for r in df.select(*names).collect())


def test_changes_equal_those_of_all_batches(led):
    every = _rows(priority.changes(led.decisions))
    assert _rows(led.changes) == every
    timed = led.changes.filter("trigger = 'elapsed_time'")
    assert timed.count() > 5 and timed.filter("change = 'de_escalation' or new = 'low'").count() > 0


def test_newest_equal_the_last_batch(led):
    assert _rows(led.priorities) == _rows(led.decisions.filter(F.col("batch_idx") == len(ENDS) + 1))


def test_rows_grow_with_events(led):
    """Batches that pass no bound add no row."""
    turning = priority.turning_states(led.last_states, led.batches)
    n = led.groups.count()
    assert turning.count() < led.decisions.count()
    idle = led.batches.filter("batch_idx = 1").select("tenant", F.explode(F.sequence(F.lit(100), F.lit(400))).alias("batch_idx"), "batch_name", "batch_kind", "messages", "first_seen", F.lit("2027-01-01").alias("last_seen"))
    more = led.batches.unionByName(idle)
    # the step to 2027 itself passes no bound, as the last end lies past all of them
    assert priority.turning_states(led.last_states, more).count() == turning.count()
    assert priority.snapshot_states(led.last_states, more).count() == led.decisions.count() + 301 * n


def test_calendar(spark):
    day = lambda n: str(date(2026, 3, 1) + timedelta(n))
    batches = spark.createDataFrame([("", 0, day(0)), ("", 1, day(0)), ("", 2, day(2)), ("", 5, day(1)), ("", 6, None), ("", 7, None), ("", 8, day(3)), ("t", 0, day(9))], "tenant string, batch_idx int, last_seen string")
    got = {(r["batch_idx"], r["day"] and str(r["day"])) for r in priority.calendar(batches).collect()}
    assert got == {(2, day(1)), (2, day(2)), (5, day(2)), (6, None), (8, None)}


def test_snapshots_are_spread_however_few_bytes_they_are(spark):
    """The work a snapshot is large, so groups x batches rows aren't merged into one task."""
    last = spark.createDataFrame([("", i, 0, (i,), ["M"]) for i in range(50)], "tenant string, group_no long, batch_idx int, state struct<seq:long>, new_message_ids array<string>")
    batches = spark.createDataFrame([("", 0, "2024-01-01"), ("", 1, "2024-01-02")], "tenant string, batch_idx int, last_seen string")
    rows = priority.snapshot_states(last, batches)
    assert rows.count() == 100 and rows.rdd.getNumPartitions() > 1
