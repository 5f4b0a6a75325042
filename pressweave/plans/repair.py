"""Work lists of the repair and backfill jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import is_broken, strip
from ..operators.timeline import running_sum
from .feed import as_datetime, ntz


def repair_window(now, lookback_hours: int = vocab.REPAIR_LOOKBACK_HOURS,
                  grace_minutes: int = vocab.REPAIR_GRACE_MINUTES):
    t = as_datetime(now)
    return t - dt.timedelta(hours=lookback_hours), t - dt.timedelta(minutes=grace_minutes)


def in_repair_window(ts: str, now, **window) -> Column:
    """Newer than the lookback and no younger than the grace period."""
    oldest, newest = repair_window(now, **window)
    return (F.col(ts) > ntz(oldest)) & (F.col(ts) <= ntz(newest))


def article_needs_repair(summary: str, has_embedding: str) -> Column:
    return is_broken(summary) | ~F.col(has_embedding)


def story_needs_summary(summary: str, article_count: str) -> Column:
    return (F.col(article_count) >= 2) & is_broken(summary)


def usable_summary(verdict: str) -> Column:
    """A coherent verdict with a real summary."""
    v = F.col(verdict)
    return F.coalesce(v["coherent"], F.lit(False)) & ~is_broken(v["summary"])


def _capped(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(max(n, 0))


def with_embedding_flag(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    have = vectors.select("id").withColumn("has_embedding", F.lit(True))
    return articles.join(have, "id", "left").withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))


def repair_articles(articles: DataFrame, now, limit: int = vocab.REPAIR_MAX_ARTICLES, **window) -> DataFrame:
    todo = articles.where(in_repair_window("created_at", now, **window)
                          & article_needs_repair("summary", "has_embedding"))
    return _capped(todo, [F.col("created_at").desc(), F.col("id")], limit)


def repair_images(articles: DataFrame, now, limit: int = vocab.REPAIR_MAX_ARTICLES, **window) -> DataFrame:
    todo = articles.where(in_repair_window("created_at", now, **window) & (strip("image_url") != ""))
    return _capped(todo, [F.col("created_at").desc(), F.col("id")], limit)


def repair_stories(stories: DataFrame, now, limit: int = vocab.REPAIR_MAX_STORIES, **window) -> DataFrame:
    todo = stories.where(in_repair_window("updated_at", now, **window)
                         & story_needs_summary("summary", "article_count"))
    return _capped(todo, [F.col("updated_at").desc(), F.col("id")], limit)


def backfill_batches(articles: DataFrame, size: int = 50) -> DataFrame:
    """Number the articles without vector, oldest first, in batches of ``size``.

    The position is a running count over ranges of (created_at, id), so no single task sorts the whole backlog, also
    when most of it was created at one time.
    """
    todo = articles.where(~F.col("has_embedding")).select("id", "created_at", F.lit(1).cast("bigint").alias("_one"))
    pos = running_sum(todo, [], ["created_at", "id"], "_one", "position")
    return pos.select("id", "created_at", "position", F.ceil(F.col("position") / size).alias("batch"))
