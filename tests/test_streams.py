"""Streaming jobs: several micro-batches, replays, same results as the batch form."""

import tempfile

from pyspark.sql import functions as F

from pressweave import fixtures as fx
from pressweave.operators.timeline import quota_windows
from pressweave.plans import usage as us
from pressweave.streaming import jobs
from pressweave.streaming.state import BatchTable, parquet_stream, run_available


def split_events(spark, sf, parts=3):
    """The events in time order as several files."""
    folder = tempfile.mkdtemp(prefix="events-")
    e = fx.table(spark, sf, "events")
    n = e.count()
    for i in range(parts):
        (e.where((F.col("event_id") >= n * i // parts) & (F.col("event_id") < n * (i + 1) // parts)).coalesce(1)
         .write.mode("append").parquet(folder))
    return folder


def test_counter_deltas_across_batches(spark, sf):
    folder = split_events(spark, sf)
    work = tempfile.mkdtemp(prefix="work-")
    e = parquet_stream(spark, folder, "*.parquet", files_per_batch=1)
    s = e.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("project_id"),
                 F.when(F.col("user_id") % 3 == 0, None).otherwise(F.lit("b")).alias("branch_id"),
                 F.col("ts").alias("collected_at"), F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"))
    tails = BatchTable(spark, work + "/t", jobs.TAIL).create()
    deltas = BatchTable(spark, work + "/d", jobs.DELTAS).create()
    jobs.counter_delta_stream(s, tails, deltas, work + "/c")
    want = us.counter_deltas(fx.counter_samples(spark, sf), ["project_id", "branch_id"]).select(
        "sample_id", "previous", "counter_reset", "delta")
    assert deltas.rows().exceptAll(want).isEmpty() and want.exceptAll(deltas.rows()).isEmpty()


def test_late_sample_does_not_move_the_tail(spark):
    work = tempfile.mkdtemp(prefix="work-")
    for i, (hour, size) in enumerate([(10, 100), (5, 50), (11, 110)]):
        spark.sql(f"SELECT {i}L AS sample_id, 1L AS project_id, 'b' AS branch_id, CAST('2024-01-01 {hour:02d}:00:00' AS timestamp_ntz) "
                  f"AS collected_at, {size}L AS bytes").coalesce(1).write.mode("append").parquet(f"{work}/in")
    tails = BatchTable(spark, work + "/t", jobs.TAIL).create()
    deltas = BatchTable(spark, work + "/d", jobs.DELTAS).create()
    jobs.counter_delta_stream(parquet_stream(spark, work + "/in", "*.parquet", files_per_batch=1), tails, deltas, work + "/c")
    assert {r["sample_id"]: (r["previous"], r["delta"]) for r in deltas.rows().collect()} == {0: (None, None), 1: (None, None), 2: (100, 10)}


def test_quota_across_batches(spark, sf):
    folder = split_events(spark, sf)
    work = tempfile.mkdtemp(prefix="work-")
    r = parquet_stream(spark, folder, "*.parquet", files_per_batch=1).select(
        F.col("user_id").alias("key"), "ts", F.col("event_id").alias("pos"))
    table = BatchTable(spark, work + "/q", jobs.QUOTA_OUT).create()
    run_available(jobs.quota_stream(r, 2, 86400), table.write, work + "/c")
    want = quota_windows(fx.requests(spark, sf), "key", "ts", "pos", 2, 86400).select(
        "key", "pos", "allowed", F.col("remaining").cast("bigint"), "reset_seconds", "retry_after_seconds")
    assert table.rows().exceptAll(want).isEmpty() and want.exceptAll(table.rows()).isEmpty()


def test_ingest_replay_is_idempotent(spark, sf):
    work = tempfile.mkdtemp(prefix="work-")
    a = fx.news_articles(spark, sf).withColumns({
        "lead": F.col("summary"), "category": F.get("topics", F.lit(0))}).drop("story_id", "summary")
    job = jobs.Ingest(spark, work, dims=64, threshold=0.9, rounds=1)
    first, second = a.where("id < 60"), a.where("id between 40 and 90")
    job.on_batch(first, 0)
    job.on_batch(second, 1)
    before = sorted(job.articles.rows().select("id", "story_id").collect())
    job.on_batch(second, 1)
    assert sorted(job.articles.rows().select("id", "story_id").collect()) == before
    ids = [r["id"] for r in before]
    assert len(ids) == len(set(ids))
    urls = job.articles.rows()
    assert urls.count() == urls.select("url").distinct().count() == urls.select("fingerprint").distinct().count()
    stories = {r["id"]: r["article_count"] for r in job.stories.latest(["id"]).collect()}
    counted = {r["story_id"]: r["count"] for r in job.articles.rows().where("story_id is not null").groupBy("story_id").count().collect()}
    assert stories == counted
