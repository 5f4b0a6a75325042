"""Full-text search over a weighted inverted index.

Words are lower-cased and neither stemmed nor stopped. The rank of an article is the sum over terms and
fields of ``weight * tf / (1 + tf)`` with title weight 1.0 and body weight 0.4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import cut
from .stories import story_image

WEIGHTS = {"title": 1.0, "body": 0.4}
SPLIT = r"[^\p{L}\p{N}]+"


def terms(c) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), SPLIT), lambda t: t != "")


def query_terms(text: str) -> list[str]:
    word, out = "", []
    for ch in text.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return sorted(set(out))


def build_index(articles: DataFrame, positions: bool = True) -> DataFrame:
    """Postings ``(term, article_id, field, tf, positions)``; positions count from 1.

    Texts are dealt by article, not words: all words of an article are then counted in the task that splits its texts."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), terms(f).alias("words")) for f in WEIGHTS])
    dealt = articles.select("id", *WEIGHTS).repartition("id").select(F.col("id").alias("article_id"), F.explode(fields).alias("f"))
    both = dealt.select("article_id", "f.field", F.posexplode("f.words").alias("pos", "term"))
    aggs = [F.count(F.lit(1)).alias("tf")]
    if positions:
        aggs.append(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"))
    return both.groupBy("term", "article_id", "field").agg(*aggs)


def write_index(index: DataFrame, path: str) -> None:
    """Range-partition by (term, article): a very common term spans several files, and the file
    statistics let a search skip all others."""
    (index.repartitionByRange("term", "article_id").sortWithinPartitions("term", "article_id")
     .write.mode("overwrite").parquet(path))


def refresh_index(index: DataFrame, changed: DataFrame) -> DataFrame:
    """Index after some articles changed: their old postings go, their new ones come."""
    kept = index.join(changed.select(F.col("id").alias("article_id")).distinct(), "article_id", "left_anti")
    fresh = build_index(changed, positions="positions" in index.columns)
    return kept.unionByName(fresh.select(*kept.columns))


def _rank() -> Column:
    weight = F.when(F.col("field") == "title", WEIGHTS["title"]).otherwise(WEIGHTS["body"])
    # rounded, so that equal ranks stay equal whatever the order of summation
    return F.round(F.sum(weight * F.col("tf") / (F.col("tf") + 1.0)), 9)


def matching_articles(index: DataFrame, words: list[str]) -> DataFrame:
    """Articles that contain every word, with their rank."""
    hits = index.where(F.col("term").isin(words)) if words else index.limit(0)
    return (hits.groupBy("article_id").agg(F.count_distinct("term").alias("n"), _rank().alias("rank"))
            .where(F.col("n") == len(words)).drop("n"))


def roll_up(hits: DataFrame, articles: DataFrame, keys: list[str]) -> DataFrame:
    """Stories of the articles found: how many, the newest and the best rank."""
    a = articles.select(F.col("id").alias("article_id"), "story_id", "published_at").where("story_id is not null")
    return (hits.join(a, "article_id").groupBy(*keys, "story_id")
            .agg(F.count(F.lit(1)).alias("matched_articles"), F.max("published_at").alias("latest_published_at"),
                 F.max("rank").alias("relevance_score")))


def _present(top: DataFrame, stories: DataFrame, articles: DataFrame, sources: DataFrame, excluded) -> DataFrame:
    s = stories.select(F.col("id").alias("story_id"), F.col("title").alias("story_title"), "source_count",
                       "article_count")
    image = story_image(articles.join(top.select("story_id"), "story_id", "left_semi"), sources, excluded)
    return top.join(s, "story_id").join(image, "story_id", "left")


def search(index: DataFrame, articles: DataFrame, stories: DataFrame, sources: DataFrame, query: str,
           limit: int = 50, fallback: bool = True, excluded=()) -> DataFrame:
    """Stories with matching articles, best first; a title substring search when there are none."""
    top = cut(roll_up(matching_articles(index, query_terms(query)), articles, [])
              .orderBy(F.col("relevance_score").desc(), "story_id").limit(limit))  # the search runs once
    if fallback and top.isEmpty():
        top = substring_search(articles, stories, query, limit)
    return _present(top, stories, articles, sources, excluded)


def substring_search(articles: DataFrame, stories: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Case-insensitive literal substring of the article or story title, newest first, rank 1."""
    q = F.lower(F.lit(query))
    st = stories.select(F.col("id").alias("story_id"), F.contains(F.lower("title"), q).alias("_story"))
    hit = (articles.where("story_id is not null")
           .select("story_id", "published_at", F.contains(F.lower("title"), q).alias("_art"))
           .join(st, "story_id").where("_art or _story"))
    return (hit.groupBy("story_id").agg(F.count(F.lit(1)).alias("matched_articles"),
                                        F.max("published_at").alias("latest_published_at"))
            .withColumn("relevance_score", F.lit(1.0))
            .orderBy(F.col("latest_published_at").desc_nulls_last(), "story_id").limit(limit))


def _all_words(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(query_id, article_id, rank)`` of articles with all words of ``wanted`` ``(query_id, need, term)``.

    A query's rarest word gives its articles; its next two, four, ... words in order of frequency are looked up in those that
    are left. So a word that stands everywhere is never joined with every query that has it."""
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("query_id", "need").orderBy("df", "term")
    t = wanted.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("nth", F.dense_rank().over(order))
    t = cut(t.withColumn("_none", F.min("df").over(Window.partitionBy("query_id", "need"))).where("_none > 0").drop("df", "_none"))
    most = t.agg(F.max("need")).first()[0] or 0
    weight = F.when(F.col("field") == "title", WEIGHTS["title"]).otherwise(WEIGHTS["body"])
    score, found = F.sum(weight * F.col("tf") / (F.col("tf") + 1.0)), F.count_distinct("term").alias("n")
    left = cut(index.join(t.where("nth = 1"), "term").groupBy("query_id", "need", "article_id").agg(score.alias("score")))
    low, high = 1, 3
    while low < most:
        words = t.where((F.col("nth") > low) & (F.col("nth") <= high))
        asked = left.join(words.select("query_id", "need", "term"), ["query_id", "need"])
        more = asked.drop("score").join(index, ["term", "article_id"]).groupBy("query_id", "need", "article_id").agg(score.alias("more"), found)
        full = more.where(F.col("n") == F.least(F.col("need"), F.lit(high)) - F.lit(low)).drop("n")
        done = left.where(F.col("need") <= low)
        left = cut(left.join(full, ["query_id", "need", "article_id"]).withColumn("score", F.col("score") + F.col("more")).drop("more").unionByName(done))
        low, high = high, 2 * high + 1
    return left.select("query_id", "article_id", F.round("score", 9).alias("rank"))


def search_many(index: DataFrame, articles: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """Many queries ``(query_id, text)`` at once: best ``limit`` stories of each."""
    q = queries.select("query_id", F.array_distinct(terms("text")).alias("words"))
    wanted = q.select("query_id", F.size("words").alias("need"), F.explode("words").alias("term"))
    mine = cut(index.join(wanted.select("term").distinct(), "term", "left_semi").select("term", "article_id", "field", "tf"))
    # one id for several texts: their words count together, as soon as there are enough
    mixed = wanted.groupBy("query_id", "need").agg(F.count_distinct("term").alias("n")).where("n <> need").select("query_id", "need")
    plain = mine.join(wanted.join(mixed, ["query_id", "need"], "left_semi"), "term").groupBy("query_id", "need", "article_id").agg(
        F.count_distinct("term").alias("n"), _rank().alias("rank")).where("n = need").select("query_id", "article_id", "rank")
    hits = _all_words(mine, wanted.join(mixed, ["query_id", "need"], "left_anti")).unionByName(plain)
    stories = roll_up(hits, articles, ["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.col("relevance_score").desc(), "story_id")
    return stories.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
