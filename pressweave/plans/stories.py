"""Facts about a story (or any cluster) in one pass over its articles.

Articles are first reduced to one row per (story, source); outlet attributes are
joined onto that reduced table, so neither a hot story nor a hot outlet moves
more than one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.news import bias_group, relevance
from ..operators.groups import merge_entities, top_topics


def by_story_source(articles: DataFrame, key: str = "story_id", extra: list | None = None) -> DataFrame:
    return (articles.where(F.col(key).isNotNull())
            .groupBy(key, "source_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.max("published_at").alias("latest_published_at"),
                 F.min(F.coalesce("published_at", "created_at")).alias("first_seen_at"),
                 F.max("created_at").alias("updated_at"),
                 F.min("id").alias("min_id"), *(extra or [])))


def _with_bias(facts: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    dims = sources.select(F.col("id").alias("source_id"), "slug", "name", "bias_rating")
    return facts.join(dims, "source_id", how)


def story_bias(articles: DataFrame, sources: DataFrame, key: str = "story_id") -> DataFrame:
    """Article counts per political side; unknown ratings are not counted."""
    group = bias_group("bias_rating", unknown=None)

    def side(s):
        return F.coalesce(F.sum(F.when(group == s, F.col("n"))), F.lit(0)).alias(f"{s}_count")

    counts = articles.where(F.col(key).isNotNull()).groupBy(key, "source_id").agg(
        F.count(F.lit(1)).alias("n"))
    return _with_bias(counts, sources).groupBy(key).agg(side("left"), side("center"), side("right"))


def bias_share(bias: DataFrame, key: str = "story_id") -> DataFrame:
    total = F.col("left_count") + F.col("center_count") + F.col("right_count")

    def pct(s):
        return (F.col(f"{s}_count") * 100.0 / F.nullif(total, F.lit(0))).alias(f"{s}_pct")

    return bias.select(key, pct("left"), pct("center"), pct("right")).where("left_pct is not null")


def story_latest(articles: DataFrame, stories: DataFrame) -> DataFrame:
    latest = (articles.where("story_id is not null").groupBy("story_id")
              .agg(F.max("published_at").alias("_latest")))
    return (stories.select(F.col("id").alias("story_id"), "updated_at").join(latest, "story_id", "left")
            .select("story_id", F.coalesce("_latest", "updated_at").alias("latest_published_at")))


def story_sources(articles: DataFrame, sources: DataFrame, key: str = "story_id") -> DataFrame:
    """Distinct outlets of a story, by name; bounded by the number of outlets."""
    pairs = articles.where(F.col(key).isNotNull()).select(key, "source_id").distinct()
    return (_with_bias(pairs, sources).groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("name", "slug", "bias_rating"))).alias("sources")))


def story_image(articles: DataFrame, sources: DataFrame, excluded: list[str],
                key: str = "story_id") -> DataFrame:
    """Newest image of a story whose outlet allows re-use (undated articles last, then lowest id)."""
    usable = sources.where(~F.col("slug").isin(excluded)).select(F.col("id").alias("source_id"))
    best = (articles.where(F.col(key).isNotNull() & F.col("image_url").isNotNull())
            .groupBy(key, "source_id")
            .agg(F.max(F.struct("published_at", (-F.col("id")).alias("neg"), "image_url")).alias("b")))
    return (best.join(usable, "source_id").groupBy(key).agg(F.max("b").alias("b"))
            .select(key, F.col("b.image_url").alias("image_url")))


def cluster_facts(articles: DataFrame, sources: DataFrame, key: str = "story_id",
                  topics: bool = True, entities: bool = True) -> DataFrame:
    """Counts, dates, relevance, title, topics and entities for every cluster."""
    head = F.min(F.struct("id", "title", "summary")).alias("head")
    per = _with_bias(by_story_source(articles, key, [head]), sources, "left")
    facts = (per.groupBy(key)
             .agg(F.sum("n").alias("article_count"),
                  F.count(F.lit(1)).alias("source_count"),
                  F.count_distinct(bias_group("bias_rating")).alias("bias_groups"),
                  F.min("first_seen_at").alias("first_seen_at"),
                  F.max("updated_at").alias("updated_at"),
                  F.max("latest_published_at").alias("latest_published_at"),
                  F.min("head").alias("head"))
             .withColumn("relevance_score", relevance("source_count", "article_count", "bias_groups"))
             .withColumn("title", F.col("head.title")).withColumn("summary", F.col("head.summary"))
             .drop("head"))
    if topics:
        facts = facts.join(top_topics(articles, key), key, "left")
    if entities:
        facts = facts.join(merge_entities(articles, key), key, "left")
    return facts


def story_locations(articles: DataFrame, key: str = "story_id") -> DataFrame:
    """One row per story and distinct location."""
    return (articles.where(F.col(key).isNotNull() & F.col("location").isNotNull())
            .select(key, "location").distinct())


def source_counts(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Active outlets with their article counts, zero included."""
    n = articles.groupBy("source_id").agg(F.count("id").alias("article_count"))
    return (sources.where("is_active").join(n, sources["id"] == n["source_id"], "left")
            .select("id", "name", "slug", "url", "bias_rating",
                    F.coalesce("article_count", F.lit(0)).alias("article_count")))


def source_spectrum(sources: DataFrame, zones: list[str]) -> DataFrame:
    """Outlets in the ordered bias zones; empty zones keep one row with a null outlet."""
    spark = sources.sparkSession
    frame = spark.createDataFrame([(i, z) for i, z in enumerate(zones)], "zone_order int, zone string")
    s = sources.select(F.col("bias_rating").alias("zone"), "slug")
    return frame.join(s, "zone", "left").select("zone_order", "zone", "slug")


def latest_per_story_source(articles: DataFrame) -> DataFrame:
    """Newest article of each (story, outlet); undated last, then lowest id."""
    w = Window.partitionBy("story_id", "source_id").orderBy(F.col("published_at").desc_nulls_last(), "id")
    return (articles.where("story_id is not null")
            .select("story_id", "source_id", "id", "title", "published_at")
            .withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))
