"""Story pages: detail, related stories, outlet comparison, timeline, entity matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.news import bias_group
from .feed import ntz, as_datetime
from .stories import latest_per_story_source, story_bias, story_image


def story_detail(stories: DataFrame, articles: DataFrame, sources: DataFrame, story_ids: list[int],
                 excluded=vocab.EXCLUDED_IMAGE_SOURCES) -> DataFrame:
    """Articles of the asked stories with their outlet, newest first, plus hero image and latest date.

    ``is_hero`` marks the first article in that order that has an image."""
    wanted = stories.where(F.col("id").isin(story_ids)).select(
        F.col("id").alias("story_id"), F.col("title").alias("story_title"))
    dims = sources.select(F.col("id").alias("source_id"), "slug", "bias_rating")
    rows = (articles.where(F.col("story_id").isin(story_ids))
            .select("story_id", "id", "title", "url", "published_at", "image_url", "location", "source_id")
            .join(wanted, "story_id").join(dims, "source_id"))
    heads = rows.groupBy("story_id").agg(
        F.max(F.when(F.col("image_url").isNotNull(),
                     F.struct("published_at", (-F.col("id")).alias("neg"), "image_url"))).alias("h"),
        F.max("published_at").alias("latest_published_at"))
    return (rows.join(heads, "story_id")
            .withColumn("is_hero", F.coalesce(F.col("id") == -F.col("h.neg"), F.lit(False)))
            .drop("h", "source_id")
            .orderBy("story_id", F.col("published_at").desc_nulls_last(), "id"))


def shared_stories(stories: DataFrame, articles: DataFrame, sources: DataFrame, slug_a: str, slug_b: str,
                   limit: int = 50) -> DataFrame:
    """Stories both outlets covered, each side by its newest article."""
    pair = sources.where(F.col("slug").isin(slug_a, slug_b)).select(
        F.col("id").alias("source_id"), "slug", "bias_rating")
    newest = latest_per_story_source(articles.join(pair.select("source_id"), "source_id", "left_semi"))
    newest = newest.join(pair, "source_id")

    def side(slug, tag):
        return newest.where(F.col("slug") == slug).select(
            "story_id", F.col("title").alias(f"title_{tag}"), F.col("bias_rating").alias(f"bias_{tag}"),
            F.col("published_at").alias(f"_p{tag}"))

    st = stories.select(F.col("id").alias("story_id"), F.col("title").alias("story_title"), "updated_at")
    later = F.greatest("_pa", "_pb")
    return (side(slug_a, "a").join(side(slug_b, "b"), "story_id").join(st, "story_id")
            .withColumn("_later", later)
            .withColumn("latest_published_at", F.coalesce("_later", "updated_at"))
            .orderBy(F.col("_later").desc_nulls_last(), "story_id").limit(limit)
            .drop("_pa", "_pb", "_later", "updated_at"))


def story_tags(stories: DataFrame) -> DataFrame:
    """One row per story and tag; topics and entities are separate name spaces."""
    def kind(column):
        return stories.select(F.col("id").alias("story_id"), "updated_at",
                              F.explode(F.array_distinct(column)).alias("_v")).select(
            "story_id", "updated_at", F.concat(F.lit(column + ":"), "_v").alias("tag"))
    return kind("topics").unionByName(kind("entities"))


def related_pairs(stories: DataFrame, limit: int = 4) -> DataFrame:
    """For every story, the newest other stories that share a topic or an entity.

    The order is by date only, so the answer lies within the ``limit + 1`` newest stories of each of
    its tags. Only those are joined: a tag carried by a third of all stories adds ``limit + 1`` rows
    per story, never a pair per two stories.
    """
    tags = story_tags(stories)
    newest = Window.partitionBy("tag").orderBy(F.col("updated_at").desc(), "story_id")
    heads = (tags.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= limit + 1)
             .select("tag", F.col("story_id").alias("related_id"), F.col("updated_at").alias("related_updated_at")))
    pairs = (tags.select("story_id", "tag").join(heads, "tag").where("story_id <> related_id")
             .select("story_id", "related_id", "related_updated_at").distinct())
    best = Window.partitionBy("story_id").orderBy(F.col("related_updated_at").desc(), "related_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def related_stories(stories: DataFrame, articles: DataFrame, sources: DataFrame, story_id: int,
                    limit: int = 4, excluded=vocab.EXCLUDED_IMAGE_SOURCES) -> DataFrame:
    """The same for one story, with the facts shown on a card."""
    tags = story_tags(stories)
    mine = tags.where(F.col("story_id") == story_id).select("tag")
    ids = (tags.where(F.col("story_id") != story_id).join(mine, "tag", "left_semi")
           .select("story_id", "updated_at").distinct()
           .orderBy(F.col("updated_at").desc(), "story_id").limit(limit))
    near = articles.join(ids, "story_id", "left_semi")
    out = stories.withColumnRenamed("id", "story_id").join(ids.select("story_id"), "story_id", "left_semi")
    return (out.join(story_bias(near, sources), "story_id", "left")
            .join(story_image(near, sources, excluded), "story_id", "left")
            .withColumn("latest_published_at", F.coalesce("latest_published_at", "updated_at"))
            .fillna(0, ["left_count", "center_count", "right_count"]))


def coverage_timeline(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Position of each dated article between its story's first and last one, as percent clamped to 2-98.

    The span comes from an aggregate joined back, so no story has to fit in one window partition.
    """
    dated = articles.where("story_id is not null and published_at is not null").select(
        "story_id", "id", "source_id", "published_at")
    span = dated.groupBy("story_id").agg(
        F.min(F.struct("published_at", "id")).alias("first"), F.max("published_at").alias("last"),
        F.count(F.lit(1)).alias("n")).where("n >= 2")
    dims = sources.select(F.col("id").alias("source_id"), "slug", bias_group("bias_rating", "right").alias("side"))

    def us(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    width = us("last") - us("first.published_at")
    pos = (us("published_at") - us("first.published_at")) * 100.0 / F.when(width == 0, 1000).otherwise(width)
    return (dated.join(span, "story_id").join(dims, "source_id")
            .select("story_id", "id", "slug", "side", "published_at",
                    F.least(F.greatest(pos, F.lit(2.0)), F.lit(98.0)).alias("position"),
                    (F.col("id") == F.col("first.id")).alias("is_first")))


def entity_bias(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Mentions of each entity per political side, for every story."""
    n = (articles.where("story_id is not null").select("story_id", "source_id", F.explode("entities").alias("entity"))
         .groupBy("story_id", "source_id", "entity").agg(F.count(F.lit(1)).alias("n")))
    dims = sources.select(F.col("id").alias("source_id"), bias_group("bias_rating", "right").alias("side"))

    def side(s):
        return F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"{s}_count")

    return (n.join(dims, "source_id").groupBy("story_id", "entity")
            .agg(side("left"), side("center"), side("right"), F.sum("n").alias("mentions"),
                 F.count_distinct("source_id").alias("sources")))


def headline_sides(articles: DataFrame, sources: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """Headlines per side for stories told by at least two visible sides, one of them left or right."""
    dims = sources.select(F.col("id").alias("source_id"), bias_group("bias_rating", "right").alias("side"))
    rows = (articles.where("story_id is not null").select("story_id", "id", "source_id", "title")
            .join(dims, "source_id").where(~F.col("side").isin(hidden or [""])))
    ok = (rows.groupBy("story_id")
          .agg(F.count_distinct("side").alias("n"), F.bool_or(F.col("side") != "center").alias("lr"))
          .where("n >= 2 and lr"))
    return rows.join(ok, "story_id", "left_semi").select("story_id", "side", "id", "title")


def top_stories(stories: DataFrame, n: int = 10) -> DataFrame:
    return stories.orderBy(F.col("article_count").desc(), "id").limit(n)


# ---- corpus diagnostics ---------------------------------------------------------

def cluster_sizes(assignments: DataFrame, key: str = "story_id") -> DataFrame:
    return (assignments.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size"))
            .groupBy("size").agg(F.count(F.lit(1)).alias("clusters")))


def cluster_size_stats(assignments: DataFrame, key: str = "story_id") -> DataFrame:
    """Average, maximum and upper median of the cluster sizes, and the number of unassigned rows.

    The median is read off the size histogram, whose length is the number of distinct sizes."""
    hist = cluster_sizes(assignments, key)
    w = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("clusters").over(Window.partitionBy())
    cum = hist.withColumn("cum", F.sum("clusters").over(w)).withColumn("total", total)
    noise = assignments.agg(F.count_if(F.col(key).isNull()).alias("noise"))
    stats = cum.agg((F.sum(F.col("size") * F.col("clusters")) / F.max("total")).alias("avg_size"),
                    F.max("size").alias("max_size"),
                    F.min(F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("size"))).alias("median_size"),
                    F.max("total").alias("clusters"))
    return stats.withColumn("_k", F.lit(1)).join(noise.withColumn("_k", F.lit(1)), "_k").drop("_k")


def corpus_counts(articles: DataFrame, embedded: DataFrame) -> DataFrame:
    """All corpus counters in one pass; ``embedded`` holds the ids that have a vector."""
    have = embedded.select("id").withColumn("_e", F.lit(1))
    return (articles.select("id", "story_id", "article_type").join(have, "id", "left")
            .agg(F.count(F.lit(1)).alias("articles"), F.count("_e").alias("embedded"),
                 F.count_if(F.col("story_id").isNull()).alias("unassigned"),
                 F.count_if(F.col("article_type") == "aggregation").alias("aggregation"),
                 F.count_distinct("story_id").alias("stories")))


def recent(articles: DataFrame, now, hours: int) -> DataFrame:
    import datetime as dt
    return articles.where(F.col("created_at") > ntz(as_datetime(now) - dt.timedelta(hours=hours)))
