"""Read queries: feed, story pages, comparisons, corpus diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from .. import vocab
from ..functions import news
from ..operators.groups import cap_per_group, merge_entities, top_topics
from ..plans import feed as fd
from ..plans import pages as pg
from ..plans import stories as st
from . import query
from .views import GROUP3, LEFT, NOW_SQL, RIGHT, TOPIC_WEIGHT_CASE, sql_list


def r6(c):
    return F.round(c, 6)


def data(spark, sf):
    return fx.news_articles(spark, sf), fx.news_sources(spark, sf)


AGE = f"(epoch_us({NOW_SQL}) - epoch_us(first_seen_at)) / 1e6"
SCORE = f"relevance_score * ({TOPIC_WEIGHT_CASE}) + greatest(0, 6.0 * exp(-({AGE}) / 86400.0))"


def flagship(spark, sf):
    """Front page: rank all stories, then enrich only the page."""
    a, s = data(spark, sf)
    rows = fd.feed(fx.news_stories(spark, sf), fx.NOW, limit=20)
    out = fd.feed_page(rows, a, s, fx.EXCLUDED_IMAGES)
    return out.select(
        F.col("rank").cast("bigint").alias("rank"), "story_id", "title", "article_count", "source_count",
        r6("score").alias("score"), "left_count", "center_count", "right_count", "image_url",
        F.array_join(F.transform("sources", lambda x: x["slug"]), ",").alias("source_slugs"),
        "latest_published_at")


query("feed_page", f"""
SELECT CAST(row_number() OVER (ORDER BY score DESC, s.id) AS BIGINT) AS rank, s.id AS story_id, s.title,
  s.article_count, s.source_count, round(score, 6) AS score, b.left_count, b.center_count, b.right_count,
  i.image_url, src.slugs AS source_slugs, coalesce(s.latest_published_at, s.updated_at) AS latest_published_at
FROM (SELECT *, {SCORE} AS score FROM news_stories ORDER BY score DESC, id LIMIT 20) s
LEFT JOIN story_bias b ON b.story_id = s.id LEFT JOIN story_image i ON i.story_id = s.id
LEFT JOIN (SELECT story_id, string_agg(slug, ',' ORDER BY name) AS slugs FROM (
  SELECT DISTINCT a.story_id, x.slug, x.name FROM news_articles a JOIN news_sources x ON x.id = a.source_id
  WHERE a.story_id IS NOT NULL) GROUP BY 1) src ON src.story_id = s.id""")(flagship)


def _feed_cols(df):
    return df.select(F.col("rank").cast("bigint").alias("rank"), "id", r6("score").alias("score"))


@query("feed_topic_week", f"""
SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank, id, round(score, 6) AS score FROM (
  SELECT id, relevance_score * 1.0 + CASE WHEN topics[1] = 'sport' THEN 5.0 ELSE 0.0 END AS score
  FROM news_stories WHERE list_contains(topics, 'sport')
    AND latest_published_at >= {NOW_SQL} - INTERVAL 7 DAY AND latest_published_at < {NOW_SQL} - INTERVAL 1 DAY
  ORDER BY score DESC, id LIMIT 20)""")
def feed_topic_week(spark, sf):
    return _feed_cols(fd.feed(fx.news_stories(spark, sf), fx.NOW, topic="sport", since="week"))


@query("feed_latest", f"""
SELECT CAST(row_number() OVER (ORDER BY latest_published_at DESC NULLS LAST, id) AS BIGINT) + 20 - 20 AS rank,
  id, round(score, 6) AS score FROM (
  SELECT id, latest_published_at, {SCORE} AS score FROM news_stories
  ORDER BY latest_published_at DESC NULLS LAST, id LIMIT 20 OFFSET 20)""")
def feed_latest(spark, sf):
    return _feed_cols(fd.feed(fx.news_stories(spark, sf), fx.NOW, sort="latest", page=2))


BF_NOW = "2024-01-26 16:00:00"


@query("feed_backfill", f"""
WITH scored AS (SELECT id, latest_published_at, relevance_score * 1.0
    + greatest(0, 6.0 * exp(-((epoch_us(TIMESTAMP '{BF_NOW}') - epoch_us(first_seen_at)) / 1e6) / 86400.0))
    + CASE WHEN topics[1] = 'sport' THEN 5.0 ELSE 0.0 END AS score
  FROM news_stories WHERE list_contains(topics, 'sport')),
t AS (SELECT id, score, 0 AS tier FROM scored WHERE latest_published_at >= TIMESTAMP '2024-01-26'
      ORDER BY score DESC, id LIMIT 20),
y AS (SELECT id, score, 1 AS tier FROM scored WHERE latest_published_at < TIMESTAMP '2024-01-26'
        AND latest_published_at >= TIMESTAMP '2024-01-25' ORDER BY score DESC, id LIMIT 20),
u AS (SELECT * FROM t UNION ALL SELECT * FROM y WHERE (SELECT count(*) FROM t) < 5)
SELECT CAST(row_number() OVER (ORDER BY tier, score DESC, id) AS BIGINT) AS rank, id, round(score, 6) AS score
FROM (SELECT * FROM u ORDER BY tier, score DESC, id LIMIT 20)""")
def feed_backfill(spark, sf):
    return _feed_cols(fd.feed(fx.news_stories(spark, sf), BF_NOW, topic="sport", since="today", backfill=True))


@query("feed_paging", f"""
SELECT CAST(2 AS BIGINT) AS page, CAST(20 AS BIGINT) AS "limit", count(*) AS total, count(*) > 40 AS has_more
FROM news_stories WHERE list_contains(topics, 'politika')""")
def feed_paging(spark, sf):
    stories = fx.news_stories(spark, sf)
    return fd.page_info(fd.feed_total(stories, fx.NOW, topic="politika"), 2, 20)


@query("feed_slots", f"""
WITH ranked AS (SELECT id, topics, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (
  SELECT id, topics, {SCORE} AS score FROM news_stories) ORDER BY score DESC, id LIMIT 30)
SELECT CAST(rank AS BIGINT) AS rank, id, CASE WHEN rank = 1 THEN 'hero' WHEN rank <= 8 THEN 'trending'
  ELSE coalesce(topics[1], 'more') END AS slot, rank = 1 OR rank > 8 OR rank <= 7 AS visible FROM ranked""")
def feed_slots(spark, sf):
    out = fd.page_slots(fd.feed(fx.news_stories(spark, sf), fx.NOW, limit=30))
    return out.select(F.col("rank").cast("bigint").alias("rank"), "id", "slot", "visible")


@query("story_bias_counts", "SELECT * FROM story_bias")
def story_bias_counts(spark, sf):
    return st.story_bias(*data(spark, sf))


@query("story_bias_share", """
SELECT story_id, round(left_count * 100.0 / t, 6) AS left_pct, round(center_count * 100.0 / t, 6) AS center_pct,
  round(right_count * 100.0 / t, 6) AS right_pct
FROM (SELECT *, left_count + center_count + right_count AS t FROM story_bias) WHERE t > 0""")
def story_bias_share(spark, sf):
    out = st.bias_share(st.story_bias(*data(spark, sf)))
    return out.select("story_id", *[r6(c).alias(c) for c in out.columns if c.endswith("_pct")])


@query("story_latest_published", """
SELECT id AS story_id, coalesce(latest_published_at, updated_at) AS latest_published_at FROM news_stories""")
def story_latest_published(spark, sf):
    a, _ = data(spark, sf)
    return st.story_latest(a, fx.news_stories(spark, sf))


@query("story_source_list", """
SELECT story_id, string_agg(slug || ':' || bias_rating, ',' ORDER BY name) AS sources FROM (
  SELECT DISTINCT a.story_id, s.slug, s.name, s.bias_rating FROM news_articles a
  JOIN news_sources s ON s.id = a.source_id WHERE story_id IS NOT NULL) GROUP BY 1""")
def story_source_list(spark, sf):
    out = st.story_sources(*data(spark, sf))
    return out.select("story_id", F.array_join(F.transform(
        "sources", lambda x: F.concat(x["slug"], F.lit(":"), x["bias_rating"])), ",").alias("sources"))


@query("story_hero_image", "SELECT * FROM story_image")
def story_hero_image(spark, sf):
    return st.story_image(*data(spark, sf), fx.EXCLUDED_IMAGES)


@query("story_facts", """
SELECT id AS story_id, article_count, source_count, CAST(bias_groups AS BIGINT) AS bias_groups, first_seen_at,
  updated_at, title, summary, CAST(relevance_score AS DOUBLE) AS relevance_score,
  array_to_string(topics, ',') AS topics, array_to_string(entities, ',') AS entities FROM news_stories""")
def story_facts(spark, sf):
    s = fx.news_stories(spark, sf, entities=True)
    return s.select(F.col("id").alias("story_id"), "article_count", "source_count", "bias_groups", "first_seen_at",
                    "updated_at", "title", "summary", "relevance_score",
                    F.array_join("topics", ",").alias("topics"), F.array_join("entities", ",").alias("entities"))


@query("story_top_topics", """
SELECT story_id, string_agg(topic, ',' ORDER BY rn) AS topics FROM topic_rank WHERE rn <= 3 GROUP BY 1""")
def story_top_topics(spark, sf):
    a, _ = data(spark, sf)
    out = top_topics(a.where("story_id is not null"), "story_id")
    return out.select("story_id", F.array_join("topics", ",").alias("topics"))


@query("story_entities", """
SELECT story_id, string_agg(form, ',' ORDER BY rn) AS entities FROM entity_rank WHERE rn <= 15 GROUP BY 1""")
def story_entities(spark, sf):
    a, _ = data(spark, sf)
    out = merge_entities(a.where("story_id is not null"), "story_id")
    return out.select("story_id", F.array_join("entities", ",").alias("entities"))


@query("story_locations", """
SELECT DISTINCT story_id, location FROM news_articles WHERE story_id IS NOT NULL AND location IS NOT NULL""")
def story_locations(spark, sf):
    return st.story_locations(data(spark, sf)[0])


@query("source_article_counts", """
SELECT s.id, s.name, s.slug, s.url, s.bias_rating, count(a.id) AS article_count
FROM news_sources s LEFT JOIN news_articles a ON a.source_id = s.id WHERE s.is_active GROUP BY ALL""")
def source_article_counts(spark, sf):
    a, s = data(spark, sf)
    return st.source_counts(s, a)


@query("source_spectrum", f"""
SELECT CAST(z.i - 1 AS BIGINT) AS zone_order, z.zone, s.slug FROM (
  SELECT unnest({sql_list(vocab.BIAS_ZONES)}) AS zone, generate_subscripts({sql_list(vocab.BIAS_ZONES)}, 1) AS i) z
LEFT JOIN news_sources s ON s.bias_rating = z.zone""")
def source_spectrum(spark, sf):
    out = st.source_spectrum(data(spark, sf)[1], vocab.BIAS_ZONES)
    return out.withColumn("zone_order", F.col("zone_order").cast("bigint"))


@query("latest_article_per_source", """
SELECT story_id, source_id, id, title, published_at FROM (
  SELECT *, row_number() OVER (PARTITION BY story_id, source_id ORDER BY published_at DESC NULLS LAST, id) AS rn
  FROM news_articles WHERE story_id IS NOT NULL) WHERE rn = 1""")
def latest_article_per_source(spark, sf):
    return st.latest_per_story_source(data(spark, sf)[0])


@query("story_detail", """
WITH r AS (SELECT a.*, s.slug, s.bias_rating FROM news_articles a JOIN news_sources s ON s.id = a.source_id
           WHERE story_id IN (5, 17, 40)),
h AS (SELECT story_id, id AS hero FROM (SELECT *, row_number() OVER (
        PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, id) AS rn FROM r WHERE image_url IS NOT NULL)
      WHERE rn = 1)
SELECT r.story_id, r.id, r.title, r.url, r.published_at, r.image_url, r.location, st.title AS story_title, r.slug,
  r.bias_rating, max(r.published_at) OVER (PARTITION BY r.story_id) AS latest_published_at,
  coalesce(r.id = h.hero, false) AS is_hero
FROM r JOIN news_stories st ON st.id = r.story_id LEFT JOIN h ON h.story_id = r.story_id""")
def story_detail(spark, sf):
    a, s = data(spark, sf)
    return pg.story_detail(fx.news_stories(spark, sf), a, s, [5, 17, 40])


@query("shared_stories", """
WITH l AS (SELECT story_id, slug, bias_rating, title, published_at FROM (
  SELECT a.story_id, s.slug, s.bias_rating, a.title, a.published_at, row_number() OVER (
    PARTITION BY story_id, source_id ORDER BY published_at DESC NULLS LAST, a.id) AS rn
  FROM news_articles a JOIN news_sources s ON s.id = a.source_id WHERE story_id IS NOT NULL) WHERE rn = 1)
SELECT a.story_id, a.title AS title_a, a.bias_rating AS bias_a, b.title AS title_b, b.bias_rating AS bias_b,
  st.title AS story_title, coalesce(greatest(a.published_at, b.published_at), st.updated_at) AS latest_published_at
FROM l a JOIN l b ON a.story_id = b.story_id JOIN news_stories st ON st.id = a.story_id
WHERE a.slug = 'src1' AND b.slug = 'src2'
ORDER BY greatest(a.published_at, b.published_at) DESC NULLS LAST, a.story_id LIMIT 50""")
def shared_stories(spark, sf):
    a, s = data(spark, sf)
    return pg.shared_stories(fx.news_stories(spark, sf), a, s, "src1", "src2")


TAGS = """tags AS (
  SELECT DISTINCT id, updated_at, 't:' || unnest(topics) AS tag FROM news_stories
  UNION SELECT DISTINCT id, updated_at, 'e:' || unnest(entities) AS tag FROM news_stories)"""


@query("related_stories", f"""
WITH {TAGS}, r AS (SELECT DISTINCT t.id, t.updated_at FROM tags t JOIN tags m ON m.tag = t.tag
  WHERE m.id = 5 AND t.id <> 5 ORDER BY t.updated_at DESC, t.id LIMIT 4)
SELECT s.id AS story_id, s.title, s.article_count, s.source_count, s.updated_at,
  coalesce(s.latest_published_at, s.updated_at) AS latest_published_at, i.image_url,
  b.left_count, b.center_count, b.right_count
FROM r JOIN news_stories s ON s.id = r.id LEFT JOIN story_image i ON i.story_id = s.id
LEFT JOIN story_bias b ON b.story_id = s.id""")
def related_stories(spark, sf):
    a, s = data(spark, sf)
    out = pg.related_stories(fx.news_stories(spark, sf, entities=True), a, s, 5, excluded=fx.EXCLUDED_IMAGES)
    return out.select("story_id", "title", "article_count", "source_count", "updated_at", "latest_published_at",
                      "image_url", "left_count", "center_count", "right_count")


@query("related_pairs", f"""
WITH {TAGS}, p AS (SELECT DISTINCT a.id AS story_id, b.id AS related_id, b.updated_at AS related_updated_at
  FROM tags a JOIN tags b ON a.tag = b.tag WHERE a.id <> b.id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY related_updated_at DESC, related_id)
  AS rank FROM p) WHERE rank <= 4""")
def related_pairs(spark, sf):
    out = pg.related_pairs(fx.news_stories(spark, sf, entities=True))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("coverage_timeline", f"""
WITH d AS (SELECT a.story_id, a.id, s.slug, a.published_at, epoch_us(published_at) AS us,
    CASE WHEN bias_rating IN {LEFT} THEN 'left' WHEN bias_rating = 'center' THEN 'center' ELSE 'right' END AS side
  FROM news_articles a JOIN news_sources s ON s.id = a.source_id
  WHERE story_id IS NOT NULL AND published_at IS NOT NULL),
w AS (SELECT *, min(us) OVER (PARTITION BY story_id) AS f, max(us) OVER (PARTITION BY story_id) AS l,
  count(*) OVER (PARTITION BY story_id) AS n, row_number() OVER (PARTITION BY story_id ORDER BY us, id) AS rn FROM d)
SELECT story_id, id, slug, side, published_at, rn = 1 AS is_first,
  round(least(greatest((us - f) * 100.0 / CASE WHEN l = f THEN 1000 ELSE l - f END, 2.0), 98.0), 6) AS position
FROM w WHERE n >= 2""")
def coverage_timeline(spark, sf):
    return pg.coverage_timeline(*data(spark, sf)).withColumn("position", r6("position"))


@query("entity_bias_matrix", f"""
SELECT e.story_id, e.entity, count(*) FILTER (WHERE bias_rating IN {LEFT}) AS left_count,
  count(*) FILTER (WHERE bias_rating = 'center') AS center_count,
  count(*) FILTER (WHERE bias_rating IN {RIGHT}) AS right_count, count(*) AS mentions,
  count(DISTINCT e.source_id) AS sources
FROM article_entities e JOIN news_sources s ON s.id = e.source_id WHERE story_id IS NOT NULL GROUP BY 1, 2""")
def entity_bias_matrix(spark, sf):
    return pg.entity_bias(*data(spark, sf))


@query("headline_sides", f"""
WITH r AS (SELECT a.story_id, a.id, a.title, {GROUP3} AS side FROM news_articles a
  JOIN news_sources s ON s.id = a.source_id WHERE story_id IS NOT NULL),
v AS (SELECT * FROM r WHERE side <> 'center')
SELECT story_id, side, id, title FROM v WHERE story_id IN (
  SELECT story_id FROM v GROUP BY 1 HAVING count(DISTINCT side) >= 2)""")
def headline_sides(spark, sf):
    return pg.headline_sides(*data(spark, sf), hidden=["center"])


@query("largest_stories", """
SELECT id, title, article_count, source_count FROM news_stories ORDER BY article_count DESC, id LIMIT 10""")
def largest_stories(spark, sf):
    return pg.top_stories(fx.news_stories(spark, sf)).select("id", "title", "article_count", "source_count")


@query("cluster_size_histogram", """
SELECT size, count(*) AS clusters FROM (SELECT count(*) AS size FROM news_articles WHERE story_id IS NOT NULL
  GROUP BY story_id) GROUP BY 1""")
def cluster_size_histogram(spark, sf):
    return pg.cluster_sizes(data(spark, sf)[0])


@query("cluster_size_stats", """
WITH s AS (SELECT count(*) AS size FROM news_articles WHERE story_id IS NOT NULL GROUP BY story_id)
SELECT round(avg(size), 6) AS avg_size, max(size) AS max_size,
  list_sort(list(size))[count(*) // 2 + 1] AS median_size, count(*) AS clusters,
  (SELECT count(*) FROM news_articles WHERE story_id IS NULL) AS noise FROM s""")
def cluster_size_stats(spark, sf):
    return pg.cluster_size_stats(data(spark, sf)[0]).withColumn("avg_size", r6("avg_size"))


@query("corpus_counts", """
SELECT count(*) AS articles, count(v.id) AS embedded, count(*) FILTER (WHERE story_id IS NULL) AS unassigned,
  count(*) FILTER (WHERE article_type = 'aggregation') AS aggregation, count(DISTINCT story_id) AS stories
FROM news_articles a LEFT JOIN article_vectors v ON v.id = a.id""")
def corpus_counts(spark, sf):
    return pg.corpus_counts(data(spark, sf)[0], fx.article_vectors(spark, sf))


@query("age_buckets", f"""
WITH x AS (SELECT id, created_at, floor((epoch_us({NOW_SQL}) - epoch_us(created_at)) / 1e6) AS s FROM news_articles)
SELECT id, CASE WHEN s < 60 THEN 'most recently' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || ' min ago'
  WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
  WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago'
  ELSE strftime(created_at, '%Y-%m-%d') END AS age, s < 3600 AS fresh FROM x""")
def age_buckets(spark, sf):
    a, _ = data(spark, sf)
    return a.select("id", news.age_bucket("created_at", fx.now_lit()).alias("age"),
                    news.is_fresh("created_at", fx.now_lit()).alias("fresh"))


@query("coverage_flags", """
SELECT b.story_id, source_count >= 8 AS widely_covered,
  CASE WHEN left_count + center_count + right_count < 4 THEN NULL
       WHEN left_count > 0 AND right_count > 0 AND right_count >= 3 * left_count THEN 'right'
       WHEN left_count > 0 AND right_count > 0 AND left_count >= 3 * right_count THEN 'left' END AS lopsided
FROM story_bias b JOIN news_stories s ON s.id = b.story_id""")
def coverage_flags(spark, sf):
    a, s = data(spark, sf)
    facts = st.cluster_facts(a.where("story_id is not null"), s, topics=False, entities=False)
    return (st.story_bias(a, s).join(facts, "story_id")
            .select("story_id", news.widely_covered("source_count").alias("widely_covered"),
                    news.lopsided("left_count", "center_count", "right_count").alias("lopsided")))


@query("articles_capped_per_source", """
SELECT source_id, id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM news_articles)
WHERE rn <= 50""")
def articles_capped_per_source(spark, sf):
    return cap_per_group(data(spark, sf)[0].select("source_id", "id"), "source_id", [F.col("id")], 50)


@query("bias_group_relevance", f"""
SELECT s.id, {GROUP3} AS side, CAST(3.0 + x.n + 0.0 AS DOUBLE) AS relevance FROM news_sources s
JOIN (SELECT source_id, count(*) AS n FROM news_articles GROUP BY 1) x ON x.source_id = s.id""")
def bias_group_relevance(spark, sf):
    a, s = data(spark, sf)
    n = a.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, s["id"] == n["source_id"]).select(
        "id", news.bias_group("bias_rating").alias("side"),
        news.relevance(F.lit(1), "n", F.lit(1)).alias("relevance"))
