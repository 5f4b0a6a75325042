"""Feed items to article candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import non_empty
from ..operators.groups import cap_per_group

ITEM_SCHEMA = ("source_slug string, pos bigint, link string, title string, contentSnippet string, content string, "
               "isoDate string, creator string, author string, categories array<string>, "
               "enclosure struct<url:string,type:string>")


def read_feed_dump(spark: SparkSession, path: str) -> DataFrame:
    """Feed items stored as JSON lines."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def read_rss(spark: SparkSession, path: str, source_slug: str) -> DataFrame:
    """Items of stored RSS files (splittable XML source)."""
    schema = ("title string, link string, description string, pubDate string, author string, "
              "category array<string>, enclosure struct<_url:string,_type:string>")
    x = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return x.select(
        F.lit(source_slug).alias("source_slug"), F.monotonically_increasing_id().alias("pos"), "link", "title",
        F.col("description").alias("contentSnippet"), F.lit(None).cast("string").alias("content"),
        F.col("pubDate").alias("isoDate"), F.lit(None).cast("string").alias("creator"), "author",
        F.col("category").alias("categories"),
        F.struct(F.col("enclosure._url").alias("url"), F.col("enclosure._type").alias("type")).alias("enclosure"))


def _category(item_type: str):
    """First category: a string, or an object with a ``name``."""
    first = F.get("categories", F.lit(0))
    named = "struct" in item_type
    return first["name"] if named else first


def feed_candidates(items: DataFrame, max_per_source: int | None = None) -> DataFrame:
    kind = dict(items.dtypes)["categories"]
    kept = items.where(non_empty("link").isNotNull() & non_empty("title").isNotNull())
    kept = cap_per_group(kept, "source_slug", [F.col("pos")], max_per_source)
    return kept.select(
        "source_slug", F.col("link").alias("url"), "title",
        F.coalesce(non_empty("contentSnippet"), non_empty("content")).alias("body_fallback"),
        _category(kind).alias("category"), F.coalesce("creator", "author").alias("author"),
        F.when(F.col("enclosure.type").startswith("image/"), non_empty("enclosure.url")).alias("image_url"),
        F.try_to_timestamp(non_empty("isoDate")).cast("timestamp_ntz").alias("published_at"))
