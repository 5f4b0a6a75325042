"""Streaming jobs, run over everything that is in the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import parsing as ps
from ..plans import repair as rp
from ..session import scratch_path
from ..streaming import jobs
from ..streaming.state import BatchTable, parquet_stream, run_available
from . import ORACLES, query
from .costs import DELTA, SUMS
from .ingesting import REPAIR_NOW


class _Stream:
    """Lets the fixture views read one table as a stream."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf

    @property
    def read(self):
        return self

    def parquet(self, path):
        return parquet_stream(self.spark, self.sf, path.rsplit("/", 1)[1])


def stream(view, spark, sf):
    return view(_Stream(spark, sf), sf)


def dirs(spark, name):
    base = scratch_path(spark, name)
    return base + "/table", base + "/checkpoint"


@query("usage_hourly_stream", f"""
SELECT date_trunc('hour', called_at) AS hour, activity, mode, provider, model, operation, {SUMS}
FROM usage_log GROUP BY ALL""")
def usage_hourly_stream(spark, sf):
    path, ckpt = dirs(spark, "usage")
    log = stream(fx.usage_log, spark, sf).withColumn("total_tokens", ps.total_tokens("prompt_tokens", "completion_tokens"))
    table = BatchTable(spark, path, jobs.USAGE_TABLE).create()
    jobs.usage_hourly_stream(log, table, ckpt)
    return table.latest(["hour", "activity", "mode", "provider", "model", "operation"])


@query("counter_delta_stream", f"""
WITH {DELTA} SELECT sample_id, previous, coalesce(bytes < previous, false) AS counter_reset,
  CASE WHEN bytes >= previous THEN bytes - previous END AS delta FROM d""")
def counter_delta_stream(spark, sf):
    path, ckpt = dirs(spark, "counters")
    tails = BatchTable(spark, path + "/tails", jobs.TAIL).create()
    deltas = BatchTable(spark, path + "/deltas", jobs.DELTAS).create()
    jobs.counter_delta_stream(stream(fx.counter_samples, spark, sf), tails, deltas, ckpt)
    return deltas.rows()


@query("quota_stream")
def quota_stream(spark, sf):
    path, ckpt = dirs(spark, "quota")
    table = BatchTable(spark, path, jobs.QUOTA_OUT).create()
    run_available(jobs.quota_stream(stream(fx.requests, spark, sf), 3, 172800), table.write, ckpt)
    return table.rows().drop("key")


@query("deduplicated_stream", "SELECT DISTINCT user_id, event_type FROM events")
def deduplicated_stream(spark, sf):
    path, ckpt = dirs(spark, "dedup")
    table = BatchTable(spark, path, "user_id bigint, event_type string").create()
    e = parquet_stream(spark, sf, "events.parquet").select("user_id", "event_type", "ts")
    out = jobs.dedup_stream(e, ["user_id", "event_type"], "ts", "60 days")
    run_available(out.select("user_id", "event_type"), table.write, ckpt)
    return table.rows()


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR
  THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 6 HOUR AS ended_at, count(*) AS events FROM s GROUP BY user_id, n"""


@query("story_sessions", SESSIONS)
def story_sessions(spark, sf):
    return jobs.story_sessions(fx.table(spark, sf, "events"), "user_id", "ts", "6 hours")


@query("session_stream", f"""
SELECT * FROM ({SESSIONS}) WHERE ended_at <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
def session_stream(spark, sf):
    path, ckpt = dirs(spark, "sessions")
    table = BatchTable(spark, path, "user_id bigint, started_at timestamp_ntz, ended_at timestamp_ntz, events bigint").create()
    e = parquet_stream(spark, sf, "events.parquet").select("user_id", "ts")
    run_available(jobs.story_sessions(e, "user_id", "ts", "6 hours"), table.write, ckpt)
    return table.rows()


@query("sliding_counts", """
SELECT event_type, w AS window_start, count(*) AS events FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * k) FOR k IN range(4)]) AS w FROM events)
GROUP BY 1, 2""")
def sliding_counts(spark, sf):
    return jobs.sliding_counts(fx.table(spark, sf, "events"), "event_type", "ts")


@query("repair_window_scan", f"""
SELECT id FROM news_articles WHERE created_at > TIMESTAMP '{REPAIR_NOW}' - INTERVAL 24 HOUR
  AND created_at <= TIMESTAMP '{REPAIR_NOW}' - INTERVAL 90 MINUTE""")
def repair_window_scan(spark, sf):
    return fx.news_articles(spark, sf).where(rp.in_repair_window("created_at", REPAIR_NOW)).select("id")


@query("ingest_stream")
def ingest_stream(spark, sf):
    path, ckpt = dirs(spark, "ingest")
    a = stream(fx.news_articles, spark, sf).withColumns({
        "lead": F.col("summary"), "category": F.get("topics", F.lit(0))}).drop("story_id", "summary")
    job = jobs.Ingest(spark, path, threshold=0.90)
    job.run(a, ckpt)
    return job.articles.rows().select("id", "source_slug", "story_id")


ORACLES["quota_stream"] = ORACLES["quota_decisions"]
