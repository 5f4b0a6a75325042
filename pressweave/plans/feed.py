"""The ranked front page: predicates, score, paging, thin-day backfill, enrichment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.news import seconds_between, topic_weight
from .stories import story_bias, story_image, story_sources


def as_datetime(now) -> dt.datetime:
    return now if isinstance(now, dt.datetime) else dt.datetime.fromisoformat(now)


def ntz(ts: dt.datetime) -> Column:
    return F.expr(f"timestamp_ntz'{ts:%Y-%m-%d %H:%M:%S.%f}'")


def since_bounds(now, since: str | None):
    """Half-open ``[from, until)`` bounds on the latest publication date; week leaves out yesterday."""
    day = as_datetime(now).replace(hour=0, minute=0, second=0, microsecond=0)
    days = dt.timedelta
    return {
        None: (None, None),
        "today": (day, None),
        "yesterday": (day - days(1), day),
        "week": (day - days(7), day - days(1)),
    }.get(since, (dt.datetime(1970, 1, 1), None))


def feed_filter(stories: DataFrame, now, topic: str | None = None, since: str | None = None) -> DataFrame:
    out = stories if topic is None else stories.where(F.array_contains("topics", topic))
    lo, hi = since_bounds(now, since)
    if lo is not None:
        out = out.where(F.col("latest_published_at") >= ntz(lo))
    if hi is not None:
        out = out.where(F.col("latest_published_at") < ntz(hi))
    return out


def feed_score(now, topic: str | None = None, since: str | None = None) -> Column:
    first = F.get("topics", F.lit(0))
    score = F.col("relevance_score") * (F.lit(1.0) if topic else topic_weight(first))
    if since != "week":
        age = seconds_between(ntz(as_datetime(now)), "first_seen_at")
        score = score + F.greatest(F.lit(0.0), F.exp(-age / 86400.0) * 6.0)
    if topic:
        score = score + F.when(first == topic, 5.0).otherwise(0.0)
    return score


def _order(sort: str):
    if sort == "latest":
        return [F.col("latest_published_at").desc_nulls_last(), F.col("id")]
    return [F.col("score").desc(), F.col("id")]


def feed(stories: DataFrame, now, topic=None, sort="relevance", since=None, page=1, limit=20,
         backfill: bool = False, thin: int = 5) -> DataFrame:
    """One page of the feed with its rank. ``stories`` carries ``latest_published_at``.

    With ``backfill`` a ``today`` page of fewer than ``thin`` rows is topped up with yesterday's
    stories. Both pieces are top-k reads, so the tier decision runs on at most ``2 * limit`` rows.
    """
    def top(period, n, offset=0):
        rows = (feed_filter(stories, now, topic, period)
                .withColumn("score", feed_score(now, topic, since)).orderBy(*_order(sort)))
        return (rows.offset(offset) if offset else rows).limit(n)

    rows = top(since, limit, (page - 1) * limit).withColumn("tier", F.lit(0))
    if backfill and since == "today":
        older = top("yesterday", limit).withColumn("tier", F.lit(1))
        both = rows.unionByName(older)
        n_today = F.sum(F.when(F.col("tier") == 0, 1).otherwise(0)).over(Window.partitionBy())
        rows = (both.withColumn("_today", n_today)
                .where((F.col("tier") == 0) | (F.col("_today") < thin)).drop("_today"))
        # a story shown today is never repeated: the two periods are disjoint in time
        rows = rows.orderBy("tier", *_order(sort)).limit(limit)
    w = Window.partitionBy().orderBy("tier", *_order(sort))
    return rows.withColumn("rank", F.row_number().over(w))


def feed_total(stories: DataFrame, now, topic=None, since=None) -> DataFrame:
    return feed_filter(stories, now, topic, since).agg(F.count(F.lit(1)).alias("total"))


def feed_page(page_rows: DataFrame, articles: DataFrame, sources: DataFrame,
              excluded=vocab.EXCLUDED_IMAGE_SOURCES) -> DataFrame:
    """Enrich one page. Articles are cut to the page's stories before anything is aggregated."""
    ids = page_rows.select(F.col("id").alias("story_id"))
    mine = articles.select("id", "story_id", "source_id", "published_at", "created_at", "image_url").join(
        ids, "story_id", "left_semi")
    out = page_rows.withColumnRenamed("id", "story_id")
    for extra in (story_bias(mine, sources), story_image(mine, sources, excluded),
                  story_sources(mine, sources)):
        out = out.join(extra, "story_id", "left")
    return (out.withColumn("latest_published_at", F.coalesce("latest_published_at", "updated_at"))
            .fillna(0, ["left_count", "center_count", "right_count"]))


def page_info(total: DataFrame, page: int, limit: int) -> DataFrame:
    return total.select(F.lit(page).cast("bigint").alias("page"), F.lit(limit).cast("bigint").alias("limit"),
                        "total", (F.col("total") > page * limit).alias("has_more"))


def page_slots(ranked: DataFrame, strip_end: int = 8, shown: int = 6) -> DataFrame:
    """Hero, trending strip and topic blocks of an already ranked page."""
    known = F.array(*[F.lit(t) for t in vocab.TOPICS])
    primary = F.get(F.filter("topics", lambda t: F.array_contains(known, t)), F.lit(0))
    slot = F.when(F.col("rank") == 1, "hero").when(F.col("rank") <= strip_end, "trending").otherwise(
        F.coalesce(primary, F.lit("more")))
    return ranked.withColumn("slot", slot).withColumn(
        "visible", (F.col("slot") != "trending") | (F.col("rank") <= shown + 1))
