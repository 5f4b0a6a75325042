"""Similarity, clustering and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import hooks
from ..functions.text import cluster_text, event_role
from ..operators import density as dn
from ..operators import simjoin as sj
from ..operators.groups import centroid, merge_centroids
from ..operators.merging import merge_clusters
from ..operators.vectorindex import VectorIndex
from ..plans import assign as asg
from ..plans import quality as ql
from ..plans import recluster as rc
from ..session import cut, scratch_path
from . import query
from .texts import EMPTY, tokens_sql

HOURS = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(coalesce(published_at, created_at))) / 3.6e9"


def r6(c):
    return F.round(c, 6).alias(c)


def articles(spark, sf):
    return fx.news_articles(spark, sf)


def vectors(spark, sf):
    return fx.article_vectors(spark, sf)


def with_vectors(spark, sf):
    return articles(spark, sf).where("story_id is not null").join(vectors(spark, sf), "id")


def centroids(spark, sf):
    return centroid(with_vectors(spark, sf), "story_id")


CENTROIDS = """flat AS (SELECT a.story_id, a.id, unnest(v.embedding) AS x, generate_subscripts(v.embedding, 1) AS p
  FROM news_articles a JOIN article_vectors v ON v.id = a.id WHERE story_id IS NOT NULL),
means AS (SELECT story_id, p, avg(x) AS x, count(*) AS n FROM flat GROUP BY 1, 2),
cent AS (SELECT story_id, list(x ORDER BY p) AS c, max(n) AS n FROM means GROUP BY 1)"""


@query("story_centroids", f"WITH {CENTROIDS} SELECT story_id, p AS pos, round(x, 6) AS value FROM means")
def story_centroids(spark, sf):
    c = centroids(spark, sf)
    return c.select("story_id", F.posexplode("centroid").alias("pos", "value")).select(
        "story_id", (F.col("pos") + 1).cast("bigint").alias("pos"), r6("value"))


@query("centroid_updates", f"""
WITH {CENTROIDS}, f AS (SELECT story_id, p, arg_min(x, id) AS v FROM flat GROUP BY 1, 2)
SELECT m.story_id, m.p AS pos, round((m.x * m.n + f.v) / (m.n + 1), 6) AS value FROM means m JOIN f USING (story_id, p)""")
def centroid_updates(spark, sf):
    first = with_vectors(spark, sf).groupBy("story_id").agg(F.min_by("embedding", "id").alias("v"))
    t = centroids(spark, sf).join(first, "story_id").select(
        "story_id", F.posexplode(merge_centroids("centroid", "n", "v", F.lit(1))).alias("pos", "value"))
    return t.select("story_id", (F.col("pos") + 1).cast("bigint").alias("pos"), r6("value"))


@query("nearest_stories", f"""
WITH {CENTROIDS}, s AS (SELECT v.id, c.story_id, list_cosine_similarity(v.embedding, c.c) AS sim
  FROM article_vectors v, cent c)
SELECT id, story_id, round(sim, 6) AS sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, story_id) AS rank FROM s WHERE sim > 0.25)
WHERE rank <= 10""")
def nearest_stories(spark, sf):
    left = vectors(spark, sf).select(F.lit("").alias("grp"), "id", F.col("embedding").alias("vec"))
    right = centroids(spark, sf).select(F.lit("").alias("grp"), F.col("story_id").alias("id"), F.col("centroid").alias("vec"))
    out = sj.knn_join(left, right, 10, 0.25)
    return out.select("id", F.col("nbr").alias("story_id"), r6("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("indexed_neighbours", """
WITH p AS (SELECT a.vec_id AS id, b.vec_id AS nbr, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT id, nbr, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank
  FROM p WHERE sim > 0.2) WHERE rank <= 5""")
def indexed_neighbours(spark, sf):
    """An index is built, written by cells, read back and searched exactly."""
    e = fx.table(spark, sf, "embeddings").select(F.lit("").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    path = scratch_path(spark, "index")
    VectorIndex.build(e, block=128).write(path)
    out = sj.index_knn(e, VectorIndex.read(spark, path), 5, 0.2, self_join=True)
    return out.select("id", "nbr", r6("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("story_pair_similarity", """
WITH v AS (SELECT a.story_id, a.id, e.embedding FROM news_articles a JOIN article_vectors e ON e.id = a.id
  WHERE story_id IS NOT NULL), p AS (SELECT a.story_id, list_cosine_similarity(a.embedding, b.embedding) AS s
  FROM v a JOIN v b ON a.story_id = b.story_id AND a.id < b.id)
SELECT CAST(story_id AS VARCHAR) AS story_id, count(*) AS pairs, round(avg(s), 6) AS avg_sim, round(min(s), 6) AS min_sim,
  round(max(s), 6) AS max_sim FROM p GROUP BY 1""")
def story_pair_similarity(spark, sf):
    out = rc.story_pair_stats(articles(spark, sf), vectors(spark, sf))
    return out.select("story_id", "pairs", r6("avg_sim"), r6("min_sim"), r6("max_sim"))


@query("cross_story_similarity", """
WITH v AS (SELECT a.story_id, a.id, e.embedding FROM news_articles a JOIN article_vectors e ON e.id = a.id
  WHERE story_id IS NOT NULL), t AS (SELECT *, md5(CAST(id AS VARCHAR)) AS h FROM v ORDER BY h, id LIMIT 2000),
p AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS p FROM t),
s AS (SELECT list_cosine_similarity(a.embedding, b.embedding) AS s FROM p a JOIN p b ON b.p = a.p + 1
  WHERE a.p % 2 = 0 AND a.story_id <> b.story_id)
SELECT count(*) AS pairs, round(avg(s), 6) AS avg_sim, round(min(s), 6) AS min_sim, round(max(s), 6) AS max_sim FROM s""")
def cross_story_similarity(spark, sf):
    out = rc.cross_story_stats(articles(spark, sf), vectors(spark, sf))
    return out.select("pairs", r6("avg_sim"), r6("min_sim"), r6("max_sim"))


def timed_points(spark, sf):
    a = articles(spark, sf)
    scope = a.join(vectors(spark, sf), "id")
    return rc.cluster_input(scope, fx.NOW)


PAIRS = f"""t AS (SELECT a.id, v.embedding AS e, {HOURS} AS h FROM news_articles a JOIN article_vectors v ON v.id = a.id),
d AS (SELECT a.id, b.id AS nbr, greatest(0.45 * (1 - list_cosine_similarity(a.e, b.e))
    + 0.55 * least(abs(a.h - b.h) / 12.0, 1), 0.0) AS dist FROM t a, t b WHERE a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nbr) AS rank FROM d)"""


@query("composite_neighbours", f"WITH {PAIRS} SELECT id, rank, round(dist, 6) AS dist FROM n WHERE rank <= 3")
def composite_neighbours(spark, sf):
    p = timed_points(spark, sf).select(F.lit("").alias("grp"), "id", "vec", "hours", F.lit(1).cast("bigint").alias("mult"))
    return dn.nearest(p, 3, 0.55).select("id", F.col("rank").cast("bigint").alias("rank"), r6("dist"))


@query("core_distances", f"WITH {PAIRS} SELECT id, round(dist, 6) AS core FROM n WHERE rank = 2")
def core_distances(spark, sf):
    points, members = dn.collapse(timed_points(spark, sf).withColumn("grp", F.lit("")))
    points = cut(points)
    cores = dn.core_distances(points, 3, 0.55)
    return members.join(cores.withColumnRenamed("id", "point"), "point").select(F.col("member").alias("id"), r6("core"))


def text_points(spark, sf, dims=256):
    a = articles(spark, sf)
    vec = hooks.embed_texts(a.select("id", F.col("body").alias("text")), dims=dims)
    hours = rc.cluster_input(a.withColumn("embedding", F.array().cast("array<double>")), fx.NOW).select("id", "hours")
    return vec.join(hours, "id")


@query("text_vectors")
def text_vectors(spark, sf):
    v = hooks.embed_texts(articles(spark, sf).select("id", F.col("body").alias("text")), dims=256)
    return v.select("id", F.size(F.filter("vec", lambda x: x > 0)).alias("nonzero"))


@query("model_vectors", """
SELECT id, length(body)::DOUBLE AS chars, (length(body) - length(replace(body, ' ', '')))::DOUBLE AS spaces FROM news_articles""")
def model_vectors(spark, sf):
    def lengths(texts):
        return [[float(len(t)), float(t.count(" "))] for t in texts]
    v = hooks.embed_texts(articles(spark, sf).select("id", F.col("body").alias("text")), fn=lengths)
    return v.select("id", F.get("vec", F.lit(0)).alias("chars"), F.get("vec", F.lit(1)).alias("spaces"))


@query("reduced_vectors")
def reduced_vectors(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return hooks.reduce_dims(e, 8).select("id", F.size("vec").alias("dims"))


@query("density_clusters")
def density_clusters(spark, sf):
    return dn.density_clusters(text_points(spark, sf), min_samples=2)


@query("noise_singletons", """
SELECT id, coalesce(story_id, -1) AS label, coalesce(story_id, -id) AS cluster FROM news_articles""")
def noise_singletons(spark, sf):
    return dn.with_singletons(articles(spark, sf).select("id", F.coalesce("story_id", F.lit(-1)).alias("label")))


@query("split_oversize")
def split_oversize(spark, sf):
    p = timed_points(spark, sf)
    labels = articles(spark, sf).select("id", F.coalesce(F.col("source_id"), F.lit(-1)).alias("label"))
    return dn.split_oversize(p, labels, 24)


@query("chunked_clusters", """
WITH r AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn,
  count(*) OVER (PARTITION BY source_id) AS n FROM news_articles),
c AS (SELECT *, CASE WHEN n > 24 THEN (rn - 1) // 24 ELSE -1 END AS run FROM r)
SELECT id, CASE WHEN run < 0 THEN source_id ELSE min(id) OVER (PARTITION BY source_id, run) END AS label FROM c""")
def chunked_clusters(spark, sf):
    labels = articles(spark, sf).select("id", F.col("source_id").alias("label"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return dn._chunk(labels, sizes, 24)


# ---- small clusters: at most five articles of one story ---------------------------

def small_clusters(spark, sf):
    a = articles(spark, sf).where("story_id is not null")
    q = F.floor(F.col("id") / 199)
    return a.withColumn("cluster", (F.floor(q / 5) * 199 + F.col("story_id")).cast("bigint"))


SMALL = """small AS (SELECT *, (id // 199 // 5) * 199 + story_id AS cluster FROM news_articles WHERE story_id IS NOT NULL),
sv AS (SELECT s.*, v.embedding FROM small s JOIN article_vectors v ON v.id = s.id),
sflat AS (SELECT cluster, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM sv),
scent AS (SELECT cluster, list(x ORDER BY p) AS c FROM (SELECT cluster, p, avg(x) AS x FROM sflat GROUP BY 1, 2) GROUP BY 1)"""


@query("embedding_outliers", f"""
WITH {SMALL}, n AS (SELECT cluster, count(*) AS n FROM sv GROUP BY 1),
m AS (SELECT a.cluster, a.id, max(list_cosine_similarity(a.embedding, b.embedding)) AS s FROM sv a
  JOIN sv b ON a.cluster = b.cluster AND a.id <> b.id GROUP BY 1, 2)
SELECT sv.cluster, sv.id, round(list_cosine_similarity(sv.embedding, scent.c), 6) AS centroid_similarity,
  round(greatest(m.s, 0.0), 6) AS max_member_similarity
FROM sv JOIN n USING (cluster) JOIN scent USING (cluster) JOIN m ON m.cluster = sv.cluster AND m.id = sv.id
WHERE n >= 3 AND (list_cosine_similarity(sv.embedding, scent.c) < 0.55 OR m.s < 0.1)""")
def embedding_outliers(spark, sf):
    m = small_clusters(spark, sf).join(vectors(spark, sf), "id").select("cluster", "id", "embedding")
    out = ql.embedding_outliers(m, 0.55, 0.1)
    return out.select("cluster", "id", r6("centroid_similarity"), r6("max_member_similarity"))


IDENT = "concat_ws(' ', nullif(story_identity, ''), nullif(main_event, ''), nullif(title, ''))"
SUSPICION = f"""{SMALL}, tok AS (SELECT cluster, id, article_type, {tokens_sql(IDENT)} AS t,
  coalesce(list_distinct(list_transform(entities, lambda x: lower(x))), {EMPTY}) AS e FROM small),
rest AS (SELECT a.cluster, a.id, list_distinct(flatten(list(b.t))) AS rt, list_distinct(flatten(list(b.e))) AS re
  FROM tok a JOIN tok b ON a.cluster = b.cluster AND a.id <> b.id GROUP BY 1, 2),
sc AS (SELECT tok.*, coalesce(len(list_intersect(e, re)), 0) AS sh, CASE WHEN len(t) = 0 OR coalesce(len(rt), 0) = 0 THEN 0.0
  ELSE len(list_intersect(t, rt)) / len(list_distinct(list_concat(t, rt))) END AS ts
  FROM tok LEFT JOIN rest ON rest.cluster = tok.cluster AND rest.id = tok.id),
sus AS (SELECT *, (article_type IN ('opinion', 'background', 'reaction', 'analysis') AND (sh < 1 OR ts < 0.18))
  OR (sh = 0 AND ts < 0.14) AS suspicious FROM sc)"""


@query("metadata_suspicion", f"""
WITH {SUSPICION} SELECT cluster, id, CAST(sh AS BIGINT) AS shared_entities, round(ts, 6) AS token_score, suspicious
FROM sus""")
def metadata_suspicion(spark, sf):
    out = ql.metadata_suspicion(small_clusters(spark, sf))
    return out.withColumn("token_score", F.round("token_score", 6))


@query("cluster_suspicion", f"""
WITH {SUSPICION} SELECT cluster, count(*) AS articles, count(*) FILTER (WHERE suspicious) AS suspicious_articles,
  count(*) >= 2 AND count(*) FILTER (WHERE suspicious) > 0
    AND NOT (count(*) FILTER (WHERE suspicious) = count(*) AND count(*) <= 2) AS suspicious FROM sus GROUP BY 1""")
def cluster_suspicion(spark, sf):
    return ql.cluster_suspicious(small_clusters(spark, sf))


@query("guarded_splits")
def guarded_splits(spark, sf):
    m = small_clusters(spark, sf).join(vectors(spark, sf), "id")
    return ql.split_outliers(m)


def cluster_vectors(spark, sf):
    m = small_clusters(spark, sf).select("cluster", "id").join(vectors(spark, sf), "id")
    c = centroid(m, "cluster")
    return c.select(F.col("cluster").alias("id"), F.col("n").alias("size"), "centroid")


@query("merged_clusters")
def merged_clusters(spark, sf):
    return merge_clusters(cluster_vectors(spark, sf), 0.55, 24)


@query("merged_cluster_facts")
def merged_cluster_facts(spark, sf):
    m = cut(small_clusters(spark, sf).select("cluster", "id"))
    a = articles(spark, sf)
    merged = merge_clusters(cluster_vectors(spark, sf), 0.6, 24)
    titles = m.join(a, "id").groupBy("cluster").agg(F.min(F.struct("id", "title", "summary")).alias("t")).select(
        "cluster", "t.title", "t.summary")
    out = rc.merged_facts(m, merged, a, fx.news_sources(spark, sf), titles)
    return out.select("cluster", "article_count", "source_count", "relevance_score", "first_seen_at", "title")


@query("near_merge_pairs", f"""
WITH {SMALL} SELECT a, b, round(sim, 6) AS sim, rank FROM (
  SELECT *, row_number() OVER (ORDER BY sim DESC, a, b) AS rank FROM (
    SELECT x.cluster AS a, y.cluster AS b, list_cosine_similarity(x.c, y.c) AS sim FROM scent x JOIN scent y
    ON x.cluster < y.cluster) WHERE sim > 0.3) WHERE rank <= 10""")
def near_merge_pairs(spark, sf):
    out = rc.near_merge_pairs(cluster_vectors(spark, sf), 0.4)
    return out.select("a", "b", r6("sim"), F.col("rank").cast("bigint").alias("rank"))


# ---- assignment -------------------------------------------------------------------

def assignable(spark, sf):
    a = articles(spark, sf).join(vectors(spark, sf), "id")
    role = ("title", "story_identity", "main_event", "article_type")
    return a.select("id", F.col("embedding").alias("vec"), "title", "article_type", "entities", "created_at",
                    "story_id", event_role(*role).alias("role"),
                    cluster_text(*role, "location", "entities", "topics").alias("matching_text"))


@query("assigned_stories")
def assigned_stories(spark, sf):
    new = assignable(spark, sf).where("story_id is null").drop("story_id")
    s = fx.news_stories(spark, sf, entities=True)
    s = s.join(centroids(spark, sf).select(F.col("story_id").alias("id"), "centroid"), "id").select(
        "id", "title", "article_count", "entities", "centroid", F.col("first_seen_at").alias("created_at"), "updated_at")
    done, _, _ = asg.assign_stories(new, s, fx.NOW, threshold=0.30, max_size=60, lookback_hours=24 * 31)
    return done


@query("rebuilt_stories")
def rebuilt_stories(spark, sf):
    return asg.rebuild(assignable(spark, sf).drop("story_id"), ["2024-01-01", "2024-01-16", "2024-02-01"], fx.NOW,
                       threshold=0.40, lookback_hours=24 * 31)
