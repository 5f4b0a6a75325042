"""Streaming jobs: hourly usage, counters, quotas, de-duplication, sessions, ingest."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hooks import embed_texts
from ..functions.text import cluster_text, event_role
from ..operators.keyed import drop_known, first_per_key
from ..plans import usage as us
from ..plans.assign import assign_stories, renewed
from ..plans.screening import route_low_value, validate_articles
from ..session import cut
from .state import BatchTable, run_available

def with_event_time(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermark on ``ts``; zone-less timestamps are read in the session zone, as watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


USAGE_TABLE = ("hour timestamp_ntz, activity string, mode string, provider string, model string, operation string, "
               "requests bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint")


def usage_hourly_stream(log: DataFrame, table: BatchTable, checkpoint: str, lateness: str = "24 hours") -> None:
    """Hourly roll-up that is corrected as late rows arrive; every changed hour is written again."""
    labels = {c: F.coalesce(c, F.lit("")) for c in us.USAGE_KEYS[1:]}

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)

    hours = (with_event_time(log, "called_at", lateness).withColumns(labels)
             .groupBy(F.window("called_at", "1 hour").alias("w"), *us.USAGE_KEYS[1:])
             .agg(F.count(F.lit(1)).alias("requests"), total("prompt_tokens"), total("completion_tokens"),
                  total("total_tokens"))
             .select(F.col("w.start").cast("timestamp_ntz").alias("hour"), *us.USAGE_KEYS[1:], "requests",
                     "prompt_tokens", "completion_tokens", "total_tokens"))
    run_available(hours, table.write, checkpoint, mode="update")


#: State tables read by key are folded before every so many batches, so a batch reads a bounded number of earlier ones.
FOLD_EVERY = 16
TAIL = "project_id bigint, branch_id string, collected_at timestamp_ntz, sample_id bigint, bytes bigint"
DELTAS = "sample_id bigint, previous bigint, counter_reset boolean, delta bigint"


def counter_delta_stream(samples: DataFrame, tails: BatchTable, deltas: BatchTable, checkpoint: str,
                         keys=("project_id", "branch_id"), fold_every: int = FOLD_EVERY) -> None:
    """Counter deltas across micro-batches: the newest sample of every key is carried as one row.

    A sample that arrives late is compared with what its own batch holds before it, else has no previous one; it never
    takes the place of a newer carried sample."""
    keys = list(keys)

    def on_batch(batch: DataFrame, n: int) -> None:
        if n and n % fold_every == 0:
            tails.fold(keys, n)
        batch = cut(batch.select(*keys, "collected_at", "sample_id", "bytes"))
        last = tails.latest(keys, before=n).withColumn("_old", F.lit(True))
        both = last.unionByName(batch.withColumn("_old", F.lit(False)))
        out = cut(us.counter_deltas(both, keys).where("not _old"))
        deltas.write(out.select("sample_id", "previous", "counter_reset", "delta"), n)
        newest = both.groupBy(*keys).agg(F.max(F.struct("collected_at", "sample_id", "bytes")).alias("t"))
        tails.write(newest.select(*keys, "t.*"), n)

    run_available(samples, on_batch, checkpoint)


QUOTA_OUT = "key bigint, pos bigint, allowed boolean, remaining bigint, reset_seconds bigint, retry_after_seconds bigint"


def quota_stream(requests: DataFrame, max_requests: int, window_seconds: float) -> DataFrame:
    """Quota decision for every request ``(key, ts, pos)``; a key's state is its open window."""
    width = int(window_seconds * 1_000_000)

    def decide(key, frames, state: GroupState):
        start, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["us", "pos"])
        out = []
        for us_, pos in zip(rows["us"], rows["pos"]):
            if start is None or start + width <= us_:
                start, count = us_, 0
            count += 1
            reset = max(-(-(start + width - us_) // 1_000_000), 0)
            ok = count <= max_requests
            out.append((key[0], pos, ok, max(max_requests - count, 0), reset, 0 if ok else reset))
        state.update((int(start), int(count)))
        yield pd.DataFrame(out, columns=["key", "pos", "allowed", "remaining", "reset_seconds", "retry_after_seconds"])

    timed = requests.select("key", "pos", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("key").applyInPandasWithState(
        decide, QUOTA_OUT, "start bigint, count bigint", "append", GroupStateTimeout.NoTimeout)


def dedup_stream(df: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """First row per key; keys are forgotten once the watermark is ``ttl`` past them."""
    return with_event_time(df, ts, ttl).dropDuplicatesWithinWatermark(keys)


def story_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Activity sessions per key, closed after ``gap`` without events; works on tables and streams."""
    src = with_event_time(events, ts, lateness) if events.isStreaming else events
    return (src.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.col("s.start").cast("timestamp_ntz").alias("started_at"),
                    F.col("s.end").cast("timestamp_ntz").alias("ended_at"), "events"))


def sliding_counts(events: DataFrame, key: str, ts: str, size: str = "24 hours", slide: str = "6 hours",
                   lateness: str = "10 minutes") -> DataFrame:
    src = with_event_time(events, ts, lateness) if events.isStreaming else events
    return (src.groupBy(key, F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "events"))


# ---- ingest -----------------------------------------------------------------------

ARTICLES = ("id bigint, url string, fingerprint string, title string, source_slug string, story_id bigint, "
            "created_at timestamp_ntz")
DISCARDS = ("source_slug string, url string, title string, category string, reason string, rule_id string, "
            "confidence double, stage string, detector string, published_at timestamp_ntz")
STORIES = ("id bigint, title string, article_count bigint, entities array<string>, centroid array<double>, "
           "created_at timestamp_ntz, updated_at timestamp_ntz")


class Ingest:
    """Screen, de-duplicate, embed and assign each micro-batch; state lives in tables under one folder."""

    def __init__(self, spark, folder: str, embed=None, dims: int = 256, fold_every: int = FOLD_EVERY, **assign_options):
        def table(name, schema):
            return BatchTable(spark, f"{folder}/{name}", schema).create()
        self.articles, self.discards, self.stories = (
            table("articles", ARTICLES), table("discards", DISCARDS), table("stories", STORIES))
        self.embed, self.dims, self.fold_every, self.options = embed, dims, fold_every, assign_options

    def on_batch(self, batch: DataFrame, n: int) -> None:
        if n and n % self.fold_every == 0:
            self.stories.fold(["id"], n)
        known = self.articles.before(n)
        new = drop_known(batch, known, "url")
        kept, log = route_low_value(new, "extracted")
        logged = self.discards.before(n)
        self.discards.write(first_per_key(drop_known(log, logged, "url"), ["url"], [F.col("title")]), n)
        ok, _ = validate_articles(kept)
        fresh = drop_known(ok, known, "fingerprint", within_batch=True, order=[F.col("id")])
        fresh = cut(first_per_key(fresh, ["url"], [F.col("id")]))
        if fresh.isEmpty():
            self.articles.write(known.select(*[c.split()[0] for c in ARTICLES.split(", ")]).limit(0), n)
            self.stories.write(self.stories.rows().limit(0), n)
            return
        role = ("title", "story_identity", "main_event", "article_type")
        fresh = fresh.withColumns({"role": event_role(*role),
                                   "matching_text": cluster_text(*role, "location", "entities", "topics")})
        vec = embed_texts(fresh.select("id", F.col("matching_text").alias("text")), fn=self.embed, dims=self.dims,
                          idf=False)
        now = fresh.agg(F.max("created_at").alias("m")).first()["m"] + dt.timedelta(seconds=1)
        before = cut(self.stories.latest(["id"], before=n))
        ready = fresh.join(vec, "id")
        assigned, founded, changed = assign_stories(ready, before, now, **self.options)
        placed = fresh.join(assigned, "id", "left").select("id", "url", "fingerprint", "title", "source_slug",
                                                         "story_id", "created_at")
        self.articles.write(placed, n)
        at = F.lit(now).cast("timestamp_ntz")
        self.stories.write(renewed(before, founded, changed, at).select(*before.columns), n)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        run_available(stream, self.on_batch, checkpoint)
