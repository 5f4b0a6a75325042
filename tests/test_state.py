"""State tables of streams: folding, replays, and jobs that die between two writes."""

import tempfile

import pytest
from pyspark.sql import functions as F

from pressweave import fixtures as fx
from pressweave.plans import usage as us
from pressweave.streaming import jobs
from pressweave.streaming.state import BatchTable, parquet_stream
from test_streams import split_events

SCHEMA = "k string, x bigint"


def filled(spark, batches):
    table = BatchTable(spark, tempfile.mkdtemp(prefix="state-") + "/t", SCHEMA).create()
    for n, rows in enumerate(batches):
        table.write(spark.createDataFrame(rows, SCHEMA), n)
    return table


def state(df):
    return {r["k"]: r["x"] for r in df.collect()}


def test_fold_keeps_the_newest_rows(spark):
    table = filled(spark, [[("a", 1), ("b", 1), (None, 1)], [("a", 2)], [("c", 3), (None, 3)]])
    want = {"a": 2, "b": 1, "c": 3, None: 3}
    assert state(table.latest(["k"])) == want
    table.fold(["k"], 2)
    assert table.version() == 2 and state(table.latest(["k"])) == want
    assert state(table.latest(["k"], before=2)) == {"a": 2, "b": 1, None: 1}
    assert state(table.latest(["k"], before=1)) == {"a": 1, "b": 1, None: 1}  # an earlier batch doesn't see the fold
    table.fold(["k"], 2)  # a batch that runs again
    table.fold(["k"], 3)
    assert state(table.latest(["k"])) == want


def test_a_folded_table_reads_no_earlier_batch(spark):
    table = filled(spark, [[("a", n)] for n in range(6)])
    table.fold(["k"], 5)
    read = {p.rsplit("/", 2)[1] for p in table.latest(["k"]).inputFiles()}
    plan = table.latest(["k"])._jdf.queryExecution().executedPlan().toString()
    assert "v=5" in read and "batch#" in plan and ">= 5" in plan.split("PartitionFilters", 1)[1]
    assert state(table.latest(["k"])) == {"a": 5}


def test_a_fold_that_died_is_not_read(spark, monkeypatch):
    table = filled(spark, [[("a", 1)], [("a", 2)]])
    monkeypatch.setattr(table, "_mark", lambda v: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.fold(["k"], 1)
    assert table.version() == -1 and state(table.latest(["k"])) == {"a": 2}


def test_empty_table(spark):
    table = filled(spark, [])
    assert table.latest(["k"]).isEmpty()
    table.fold(["k"], 0)
    assert table.latest(["k"]).isEmpty()


def test_a_claimed_batch_is_found_again(spark, sf, monkeypatch):
    """The job dies in its third batch after the deltas and before the tails; with folds it ends as if undisturbed."""
    work = tempfile.mkdtemp(prefix="work-")
    e = parquet_stream(spark, split_events(spark, sf, 4), "*.parquet", files_per_batch=1)
    samples = e.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("project_id"),
                       F.when(F.col("user_id") % 3 == 0, None).otherwise(F.lit("b")).alias("branch_id"),
                       F.col("ts").alias("collected_at"), F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"))
    tails = BatchTable(spark, work + "/t", jobs.TAIL).create()
    deltas = BatchTable(spark, work + "/d", jobs.DELTAS).create()
    write = tails.write

    def dying(df, n):
        if n == 2:
            raise OSError("lost")
        write(df, n)
    monkeypatch.setattr(tails, "write", dying)
    with pytest.raises(Exception, match="lost"):
        jobs.counter_delta_stream(samples, tails, deltas, work + "/c", fold_every=2)
    monkeypatch.undo()
    jobs.counter_delta_stream(samples, tails, deltas, work + "/c", fold_every=2)
    want = us.counter_deltas(fx.counter_samples(spark, sf), ["project_id", "branch_id"]).select(
        "sample_id", "previous", "counter_reset", "delta")
    assert deltas.rows().exceptAll(want).isEmpty() and want.exceptAll(deltas.rows()).isEmpty()
    assert tails.version() == 2
