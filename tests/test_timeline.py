"""Ordered operators against plain loops, with one key that holds most rows and spans several ranges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pressweave.operators import timeline as tl

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def samples(spark):
    """Rows ``(key, ts, pos, v)``: key ``a`` has 900 of 1,000, a third of them within one second; nulls in key and value."""
    rnd = random.Random(5)
    rows = []
    for pos in range(1000):
        key = "a" if pos < 900 else rnd.choice(["b", "c", None])
        at = 40_000 if pos % 3 == 0 else rnd.randrange(400_000)
        rows.append((key, START + dt.timedelta(seconds=at, microseconds=rnd.randrange(1000) * 1000), pos,
                     None if rnd.random() < 0.4 else rnd.randrange(50)))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, samples):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would become one range
    yield spark.createDataFrame(samples, "key string, ts timestamp_ntz, pos bigint, v bigint").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def by_key(samples):
    found = {}
    for row in sorted(samples, key=lambda r: (r[1], r[2])):
        found.setdefault(row[0], []).append(row)
    return found


def test_a_hot_key_spans_ranges(frame):
    parts = tl.ranged(frame, ["key"], ["ts", "pos"]).where("key = 'a'").groupBy("_slice").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 600


def test_previous_carried_and_summed(frame, samples):
    t = tl.lag_value(frame, "key", ["ts", "pos"], "v", "previous")
    t = tl.carry_forward(t, "key", ["ts", "pos"], "v", "last")
    t = tl.running_sum(t.withColumn("one", F.lit(1)), "key", ["ts", "pos"], "one", "n")
    got = {r["pos"]: (r["previous"], r["last"], r["n"]) for r in t.collect()}
    want = {}
    for rows in by_key(samples).values():
        before = last = None
        for n, (_, _, pos, v) in enumerate(rows, 1):
            last = last if v is None else v
            want[pos] = before, last, n
            before = v
    assert got == want


@pytest.mark.parametrize("seconds", [1, 60, 30 * 86400])
def test_trailing_count_of_any_length(frame, samples, seconds):
    got = {r["pos"]: r["n"] for r in tl.trailing_count(frame, "key", "ts", seconds, "n").collect()}
    second = lambda r: int((r[1] - START).total_seconds() // 1)
    want = {row[2]: sum(second(row) - seconds < second(o) <= second(row) for o in rows)
            for rows in by_key(samples).values() for row in rows}
    assert got == want


def test_running_sum_over_all_rows(frame, samples):
    got = {r["pos"]: r["n"] for r in tl.running_sum(frame.withColumn("one", F.lit(1)), [], ["ts", "pos"], "one", "n").collect()}
    assert got == {row[2]: n for n, row in enumerate(sorted(samples, key=lambda r: (r[1], r[2])), 1)}


def test_empty_table(frame):
    none = frame.limit(0)
    assert tl.lag_value(none, "key", ["ts", "pos"], "v").isEmpty()
    assert tl.trailing_count(none, "key", "ts", 60, "n").isEmpty()
