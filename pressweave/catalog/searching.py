"""Full-text search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..plans import search as se
from ..plans.searchindex import StoredIndex
from ..session import scratch_path, spread
from . import query

POSTINGS = """words AS (
  SELECT id, field, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
    SELECT id, 'title' AS field, list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM news_articles UNION ALL
    SELECT id, 'body', list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')
    FROM news_articles)),
idx AS (SELECT term, id AS article_id, field, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM words GROUP BY 1, 2, 3)"""
RANK = "sum(CASE WHEN field = 'title' THEN 1.0 ELSE 0.4 END::DOUBLE * tf / (tf + 1.0))"


def parts(spark, sf):
    return fx.news_articles(spark, sf), fx.news_stories(spark, sf), fx.news_sources(spark, sf)


def texts(spark, sf):
    return spread(fx.news_articles(spark, sf).select("id", "title", "body"))


@query("search_index", f"""
WITH {POSTINGS} SELECT term, article_id, field, tf, positions[1] AS first_pos, positions[-1] AS last_pos FROM idx""")
def search_index(spark, sf):
    i = se.build_index(texts(spark, sf))
    return i.select("term", "article_id", "field", "tf", F.get("positions", F.lit(0)).cast("bigint").alias("first_pos"),
                    F.element_at("positions", -1).cast("bigint").alias("last_pos"))


@query("search_stories", f"""
WITH {POSTINGS},
t AS (SELECT a.story_id, count(*) AS matched_articles, max(published_at) AS latest_published_at, max(rank) AS r
  FROM (SELECT article_id, {RANK} AS rank FROM idx WHERE term IN ('the', 'with') GROUP BY 1
        HAVING count(DISTINCT term) = 2) h JOIN news_articles a ON a.id = h.article_id
  WHERE story_id IS NOT NULL GROUP BY 1 ORDER BY round(r, 9) DESC, a.story_id LIMIT 50)
SELECT t.story_id, matched_articles, t.latest_published_at, round(r, 6) AS relevance_score, s.title AS story_title,
  s.source_count, s.article_count, i.image_url
FROM t JOIN news_stories s ON s.id = t.story_id LEFT JOIN story_image i ON i.story_id = t.story_id""")
def search_stories(spark, sf):
    a, s, src = parts(spark, sf)
    out = se.search(se.build_index(texts(spark, sf), positions=False), a, s, src, "The with", excluded=fx.EXCLUDED_IMAGES)
    return out.withColumn("relevance_score", F.round("relevance_score", 6))


@query("search_fallback", f"""
WITH {POSTINGS}, f2 AS (SELECT a.story_id, count(*) AS matched_articles, max(published_at) AS latest_published_at,
    max(rank) AS relevance_score FROM (SELECT article_id, {RANK} AS rank FROM idx WHERE term IN ('ing', 't') GROUP BY 1
    HAVING count(DISTINCT term) = 2) h JOIN news_articles a ON a.id = h.article_id WHERE story_id IS NOT NULL
  GROUP BY 1 ORDER BY round(relevance_score, 9) DESC, a.story_id LIMIT 50),
fb AS (SELECT a.story_id, count(*) AS matched_articles, max(published_at) AS latest_published_at,
    1.0::DOUBLE AS relevance_score FROM news_articles a JOIN news_stories s ON s.id = a.story_id
  WHERE contains(lower(a.title), 'ing t') OR contains(lower(s.title), 'ing t') GROUP BY 1
  ORDER BY latest_published_at DESC NULLS LAST, a.story_id LIMIT 50),
t AS (SELECT * FROM f2 UNION ALL SELECT * FROM fb WHERE NOT EXISTS (SELECT 1 FROM f2))
SELECT t.story_id, matched_articles, t.latest_published_at, round(t.relevance_score, 6) AS relevance_score,
  s.title AS story_title, s.source_count, s.article_count, i.image_url
FROM t JOIN news_stories s ON s.id = t.story_id LEFT JOIN story_image i ON i.story_id = t.story_id""")
def search_fallback(spark, sf):
    a, s, src = parts(spark, sf)
    return se.search(se.build_index(texts(spark, sf), positions=False), a, s, src, "ING t", excluded=fx.EXCLUDED_IMAGES).withColumn(
        "relevance_score", F.round("relevance_score", 6))


QSQL = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"


@query("search_many", f"""
WITH {POSTINGS}, q AS (SELECT item_id AS query_id, {QSQL} AS w FROM benchmark),
qt AS (SELECT query_id, len(w) AS need, unnest(w) AS term FROM q),
h AS (SELECT query_id, need, article_id, {RANK} AS rank, count(DISTINCT qt.term) AS n FROM idx JOIN qt ON qt.term = idx.term
  GROUP BY 1, 2, 3),
s AS (SELECT query_id, story_id, count(*) AS matched_articles, max(published_at) AS latest_published_at,
  round(max(rank), 6) AS relevance_score FROM h JOIN news_articles a ON a.id = h.article_id
  WHERE n = need AND story_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, story_id, matched_articles, latest_published_at, relevance_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, story_id) AS place FROM s)
WHERE place <= 50""")
def search_many(spark, sf):
    a = fx.news_articles(spark, sf)
    q = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = se.search_many(se.build_index(texts(spark, sf), positions=False), a, q)
    return out.drop("place").withColumn("relevance_score", F.round("relevance_score", 6))


@query("search_index_refresh", f"""
WITH {POSTINGS} SELECT term, article_id, field, tf FROM idx WHERE article_id % 10 <> 0
UNION ALL SELECT term, article_id, 'title' AS field, count(*) AS tf FROM (
  SELECT id AS article_id, unnest(list_filter(regexp_split_to_array(lower('new ' || title), '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> '')) AS term FROM news_articles WHERE id % 10 = 0) GROUP BY 1, 2""")
def search_index_refresh(spark, sf):
    a = fx.news_articles(spark, sf)
    changed = a.where("id % 10 = 0").select("id", F.concat(F.lit("new "), "title").alias("title"), F.lit("").alias("body"))
    return se.refresh_index(se.build_index(texts(spark, sf), positions=False), changed)


#: The articles after the refreshes below.
EDITED = """cur AS (SELECT id, story_id, published_at, CASE WHEN id % 10 = 0 THEN 'new ' || title ELSE title END AS title,
  CASE WHEN id % 10 = 0 THEN '' WHEN id % 7 = 1 THEN 'the end with ' || body ELSE body END AS body
  FROM news_articles WHERE id % 10 <> 3)"""
EDITED_POSTINGS = POSTINGS.replace("news_articles", "cur")


def kept_index(spark, sf) -> StoredIndex:
    """All articles written, then two refreshes: some rewritten and some removed, then others lengthened."""
    a = texts(spark, sf)
    index = StoredIndex(spark, scratch_path(spark, "index")).create(a)
    index.refresh(a.where("id % 10 = 0").select("id", F.concat(F.lit("old "), "title").alias("title"), "body"),
                  a.where("id % 10 = 3").select("id"))
    renamed = F.when(F.col("id") % 10 == 0, F.concat(F.lit("new "), "title")).otherwise(F.col("title"))
    body = F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit("the end with "), "body"))
    index.refresh(a.where("id % 10 = 0 or id % 7 = 1 and id % 10 <> 3").select("id", renamed.alias("title"), body.alias("body")))
    return index


@query("stored_index", f"WITH {EDITED}, {EDITED_POSTINGS} SELECT term, article_id, field, tf FROM idx")
def stored_index(spark, sf):
    index = kept_index(spark, sf)
    index.merge()
    return index.postings()


@query("stored_search", f"""
WITH {EDITED}, {EDITED_POSTINGS},
h AS (SELECT article_id, {RANK} AS rank FROM idx WHERE term IN ('the', 'with') GROUP BY 1 HAVING count(DISTINCT term) = 2)
SELECT story_id, count(*) AS matched_articles, max(published_at) AS latest_published_at, round(max(rank), 6) AS relevance_score
FROM h JOIN cur ON cur.id = h.article_id WHERE story_id IS NOT NULL GROUP BY 1""")
def stored_search(spark, sf):
    words = se.query_terms("The with")
    found = se.matching_articles(kept_index(spark, sf).postings(words), words)
    out = se.roll_up(found, fx.news_articles(spark, sf), [])
    return out.withColumn("relevance_score", F.round("relevance_score", 6))


@query("stored_search_many", f"""
WITH {EDITED}, {EDITED_POSTINGS}, q AS (SELECT item_id AS query_id, {QSQL} AS w FROM benchmark),
qt AS (SELECT query_id, len(w) AS need, unnest(w) AS term FROM q),
h AS (SELECT query_id, need, article_id, {RANK} AS rank, count(DISTINCT qt.term) AS n FROM idx JOIN qt ON qt.term = idx.term
  GROUP BY 1, 2, 3),
s AS (SELECT query_id, story_id, count(*) AS matched_articles, max(published_at) AS latest_published_at,
  round(max(rank), 6) AS relevance_score FROM h JOIN cur ON cur.id = h.article_id
  WHERE n = need AND story_id IS NOT NULL GROUP BY 1, 2)
SELECT query_id, story_id, matched_articles, latest_published_at, relevance_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, story_id) AS place FROM s)
WHERE place <= 50""")
def stored_search_many(spark, sf):
    q = fx.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = se.search_many(kept_index(spark, sf).postings(), fx.news_articles(spark, sf), q)
    return out.drop("place").withColumn("relevance_score", F.round("relevance_score", 6))
