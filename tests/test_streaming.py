import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import timeseries
from lodestone.streaming import stateful

SCHEMA = "user long, at timestamp, value double, id long, on boolean"
HOUR = 3600


def event(spark, rows):
    """Rows of (user, second, value, id, on); times as seconds since 2024."""
    raw = spark.createDataFrame(rows, "user long, s long, value double, id long, on boolean")
    return raw.select("user", F.timestamp_seconds(F.col("s") + 1704067200).alias("at"), "value", "id", "on")


def series(seed=1, users=4, hours=60):
    rng = random.Random(seed)
    out = []
    for user in range(users):
        for h in range(hours):
            for _ in range(rng.randrange(0, 4)):
                value = None if rng.random() < 0.1 else (10.0 if user == 3 else rng.gauss(10, 2) + (14 if h > 35 and user != 2 else 0))
                out.append((user, h * HOUR + rng.randrange(HOUR), value, len(out), rng.random() < 0.2))
    return out


DRAIN = [(None, 9_999_999, None, None, None)]


def test_alarms_equal_the_batch_ones_whatever_the_parts_and_order(spark):
    rows = series()
    batch = event(spark, rows).groupBy("user", F.floor(F.unix_timestamp("at") / HOUR).alias("bucket")).agg(F.sum("value").alias("x"))
    expected = {(r.user, r.bucket): pytest.approx(r.cusum, abs=1e-6) for r in timeseries.cusum_alarms(batch, "user", "bucket", "x", warm=20).collect()}
    assert len(expected) > 10
    mixed = sorted(rows, key=lambda r: r[1] + random.Random(r[3]).randrange(4 * HOUR))  # up to four hours late
    parts = [mixed[:200], mixed[200:230], mixed[230:]]
    build = lambda s: stateful.cusum_alarms(s, "user", "at", "value", HOUR, "6 hours", warm=20)
    out = stateful.run_in_parts(spark, [event(spark, p) for p in parts], build, event(spark, DRAIN)).filter("user IS NOT NULL").collect()
    assert {(r.user, r.bucket): r.cusum for r in out} == expected and len(out) == len(expected)


def test_the_mask_equals_the_batch_one_and_late_rows_are_left_out(spark):
    rng = random.Random(7)
    # days apart, a run about midnight, several rows a minute
    rows = [(k % 2, 86_400 * day + 86_400 - 1500 + rng.randrange(3000), 1.0, None, rng.random() < 0.1) for day in range(2) for k in range(60)]
    rows = [(*r[:3], i, r[4]) for i, r in enumerate(sorted(rows, key=lambda r: r[1]))]
    late = [(0, rows[0][1], 1.0, 900, True), (1, rows[3][1], 1.0, 901, True)]  # their minutes ended a day before
    cut = next(i for i, r in enumerate(rows) if r[1] > 86_400 + 30_000)
    parts = [rows[:cut], rows[cut:], late]
    build = lambda s: stateful.resting_mask(s, "user", "at", "id", F.col("on"), "2 minutes")
    out = stateful.run_in_parts(spark, [event(spark, p) for p in parts], build, event(spark, DRAIN)).filter("user IS NOT NULL").collect()
    expected = {r.id: r.resting for r in timeseries.resting_mask(event(spark, rows), "user", "at", F.col("on")).collect()}
    assert {r.row_id: r.resting for r in out} == expected and len(out) == len(rows)
    assert len(set(expected.values())) == 2


def test_without_a_drain_what_waits_is_not_given_out(spark):
    rows = [(1, h * HOUR, 5.0, h, h == 3) for h in range(6)]
    build = lambda s: stateful.resting_mask(s, "user", "at", "id", F.col("on"), "90 minutes")
    out = stateful.run_in_parts(spark, [event(spark, rows[:3]), event(spark, rows[3:])], build).collect()
    assert sorted(r.row_id for r in out) == [0, 1, 2, 3]  # the watermark stands at half past three


def test_participants_share_a_group_and_keep_their_own_state(spark, monkeypatch):
    monkeypatch.setattr(stateful, "SHARDS", 1)
    big = 1 << 60  # not exact as a float, with a null beside it
    rows = [(big + u, 60 * (3 * m + u), 1.0, None if (u, m) == (1, 3) else big + 100 * u + m, u == m % 7) for u in range(5) for m in range(40)]
    build = lambda s: stateful.resting_mask(s, "user", "at", "id", F.col("on"), "2 minutes")
    out = stateful.run_in_parts(spark, [event(spark, rows)], build, event(spark, DRAIN)).filter("user IS NOT NULL").collect()
    expected = timeseries.resting_mask(event(spark, rows), "user", "at", F.col("on")).collect()
    assert sorted((r.user, r.row_id or 0, r.resting) for r in out) == sorted((r.user, r.id or 0, r.resting) for r in expected)
