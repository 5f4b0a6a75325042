"""Scopes, verdict cache, reconciliation, story maintenance."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import hooks
from ..functions import parsing as ps
from ..operators import matching as mt
from ..operators.keyed import drop_empty, upsert
from ..plans import quality as ql
from ..plans import recluster as rc
from ..plans import repair as rp
from ..plans.stories import cluster_facts
from ..session import cut
from . import query
from .vectors import SMALL, articles, small_clusters, vectors

SCOPE_NOW = "2024-01-25 00:00:00"


@query("recluster_scope", f"""
WITH r AS (SELECT * FROM news_articles WHERE created_at > TIMESTAMP '{SCOPE_NOW}' - INTERVAL 24 HOUR),
o AS (SELECT * FROM news_articles WHERE created_at <= TIMESTAMP '{SCOPE_NOW}' - INTERVAL 24 HOUR
  AND story_id IN (SELECT story_id FROM r))
SELECT id, story_id FROM (SELECT * FROM r UNION ALL SELECT * FROM o) WHERE article_type <> 'aggregation'""")
def recluster_scope(spark, sf):
    return rc.recluster_scope(articles(spark, sf), vectors(spark, sf), SCOPE_NOW).select("id", "story_id")


@query("remaining_stories", """
SELECT s.id FROM (SELECT DISTINCT story_id AS id FROM news_articles WHERE story_id IS NOT NULL) s
WHERE NOT (s.id % 2 = 0 AND s.id NOT IN (SELECT story_id FROM news_articles WHERE story_id IS NOT NULL AND id % 4 <> 0))""")
def remaining_stories(spark, sf):
    a = articles(spark, sf)
    stories = a.where("story_id is not null").select(F.col("story_id").alias("id")).distinct()
    return drop_empty(stories, a.where("id % 4 <> 0"), stories.where("id % 2 = 0"))


def new_clusters(spark, sf):
    """Freshly formed clusters: runs of neighbouring article ids."""
    return articles(spark, sf).where("article_type <> 'aggregation'").select(
        F.floor(F.col("id") / 398).alias("_b"), "id").select(
        (F.col("_b") * 398 + F.col("id") % 199 % 61).cast("bigint").alias("cluster"), "id")


NEW = """nc AS (SELECT (id // 398) * 398 + id % 199 % 61 AS cluster, id FROM news_articles WHERE article_type <> 'aggregation'),
ov AS (SELECT cluster, story_id, count(*) AS overlap, count(*) / any_value(n)::DOUBLE AS ratio FROM nc
  JOIN news_articles a ON a.id = nc.id JOIN (SELECT story_id, count(*) AS n FROM news_articles
  WHERE story_id IS NOT NULL GROUP BY 1) s USING (story_id) GROUP BY 1, 2)"""


@query("best_overlapping_story", f"""
WITH {NEW} SELECT cluster, story_id, overlap, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (
  PARTITION BY cluster ORDER BY overlap DESC, ratio DESC, story_id) AS rn FROM ov) WHERE rn = 1""")
def best_overlapping_story(spark, sf):
    a = articles(spark, sf).select("story_id", "id")
    return mt.best_overlap(new_clusters(spark, sf), a).withColumn("ratio", F.round("ratio", 6))


#: Clusters served one by one, in order of their least article, each with its best story that is still free.
MATCHED = f"""{NEW}, c AS (SELECT cluster, row_number() OVER (ORDER BY min(id)) AS turn FROM nc GROUP BY 1),
o AS (SELECT c.turn, c.cluster, ov.story_id, ov.overlap, ov.ratio FROM c LEFT JOIN ov USING (cluster)),
g AS (SELECT 0 AS turn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS cluster, CAST(NULL AS BIGINT) AS story_id
  UNION ALL SELECT n.turn, CASE WHEN n.pick IS NULL THEN n.used ELSE list_append(n.used, n.pick) END, n.cluster, n.pick
  FROM (SELECT g.turn + 1 AS turn, g.used, any_value(o.cluster) AS cluster, arg_min(o.story_id, [-o.overlap, -o.ratio,
      o.story_id]) FILTER (WHERE o.story_id IS NOT NULL AND NOT list_contains(g.used, o.story_id)) AS pick
    FROM g JOIN o ON o.turn = g.turn + 1 GROUP BY g.turn, g.used) n)"""
MOVES = """mv AS (SELECT nc.id, nc.cluster, g.story_id, a.story_id AS old_story_id FROM nc JOIN g ON g.cluster = nc.cluster
  JOIN news_articles a ON a.id = nc.id WHERE g.turn > 0 AND (g.story_id IS NULL OR g.story_id IS DISTINCT FROM a.story_id))"""


@query("story_matches", f"WITH RECURSIVE {MATCHED} SELECT cluster, story_id FROM g WHERE turn > 0")
def story_matches(spark, sf):
    matches, _, _, _ = mt.reconcile(new_clusters(spark, sf), articles(spark, sf).select("id", "story_id"))
    return matches


@query("article_moves", f"WITH RECURSIVE {MATCHED}, {MOVES} SELECT id, cluster, story_id, old_story_id FROM mv")
def article_moves(spark, sf):
    return mt.reconcile(new_clusters(spark, sf), articles(spark, sf).select("id", "story_id"))[1]


@query("cleared_articles", """
SELECT id, story_id AS old_story_id FROM news_articles WHERE story_id IS NOT NULL AND article_type = 'aggregation'""")
def cleared_articles(spark, sf):
    return mt.reconcile(new_clusters(spark, sf), articles(spark, sf).select("id", "story_id"))[2]


@query("stories_losing_articles", f"""
WITH RECURSIVE {MATCHED}, {MOVES} SELECT old_story_id AS story_id FROM mv WHERE old_story_id IS NOT NULL
UNION SELECT story_id FROM news_articles WHERE story_id IS NOT NULL AND id NOT IN (SELECT id FROM nc)""")
def stories_losing_articles(spark, sf):
    return mt.reconcile(new_clusters(spark, sf), articles(spark, sf).select("id", "story_id"))[3]


def changed_facts(spark, sf):
    """Stories before and after half of the articles moved on by one story."""
    a = articles(spark, sf).where("story_id is not null")
    s = fx.news_sources(spark, sf)
    moved = a.withColumn("story_id", F.when(F.col("story_id") % 10 == 3, F.col("story_id") + 199)
                         .when((F.col("story_id") % 10 == 4) & (F.col("id") % 2 == 0), F.col("story_id") + 1)
                         .otherwise(F.col("story_id")))
    f = dict(topics=False, entities=False)
    return cluster_facts(moved, s, **f), cluster_facts(a, s, **f)


FACTS = ("SELECT story_id, count(*) AS n, min(coalesce(published_at, created_at)) AS f, arg_min(title, id) AS t, "
         "count(DISTINCT source_id) AS s FROM {} GROUP BY 1")


@query("story_changes", f"""
WITH a AS (SELECT * FROM news_articles WHERE story_id IS NOT NULL),
m AS (SELECT id, title, source_id, published_at, created_at, CASE WHEN story_id % 10 = 3 THEN story_id + 199
  WHEN story_id % 10 = 4 AND id % 2 = 0 THEN story_id + 1 ELSE story_id END AS story_id FROM a),
o AS ({FACTS.format('a')}), n AS ({FACTS.format('m')})
SELECT coalesce(n.story_id, o.story_id) AS story_id, CASE WHEN o.story_id IS NULL THEN 'insert'
  WHEN n.story_id IS NULL THEN 'delete' WHEN n.n = o.n AND n.f = o.f AND n.t = o.t AND n.s = o.s THEN 'skip'
  ELSE 'update' END AS change FROM n FULL JOIN o ON n.story_id = o.story_id""")
def story_changes(spark, sf):
    new, old = changed_facts(spark, sf)
    return mt.story_changes(new, old, ["article_count", "first_seen_at", "title", "source_count"])


# ---- verdicts ---------------------------------------------------------------------

def cache(spark, sf):
    """Stored verdicts on every fifth small cluster: some coherent, some split by id parity."""
    m = small_clusters(spark, sf).where("cluster % 5 = 0")
    f = ql.fingerprints(m).where("size(article_ids) >= 3")
    odd = F.filter("article_ids", lambda i: i % 2 == 1)
    even = F.filter("article_ids", lambda i: i % 2 == 0)
    coherent = F.col("cluster") % 10 == 0
    return f.select(
        "fingerprint", "article_ids", coherent.alias("coherent"),
        F.when(coherent, F.when(F.col("cluster") % 20 == 0, "").otherwise(
            F.concat(F.lit("Stored "), F.col("cluster").cast("string")))).alias("title"),
        F.lit(None).cast("string").alias("summary"), F.when(~coherent, F.array(odd, even)).alias("groups"),
        F.lit("m").alias("model"), fx.now_lit().alias("created_at"))


CACHE = f"""{SMALL}, fp AS (SELECT cluster, string_agg(id, ',' ORDER BY id) AS fingerprint, list(id ORDER BY id) AS ids
  FROM small WHERE cluster % 5 = 0 GROUP BY 1 HAVING count(*) >= 3),
cache AS (SELECT *, cluster % 10 = 0 AS coherent, CASE WHEN cluster % 10 = 0 THEN CASE WHEN cluster % 20 = 0 THEN ''
  ELSE 'Stored ' || cluster END END AS title, list_filter(ids, lambda i: i % 2 = 1) AS odd,
  list_filter(ids, lambda i: i % 2 = 0) AS even FROM fp)"""


@query("valid_decisions", f"""
WITH {CACHE} SELECT fingerprint, coherent, title, CASE WHEN NOT coherent THEN array_to_string(odd, ',') || '|'
  || array_to_string(even, ',') END AS groups FROM cache
WHERE (coherent AND title <> '') OR (NOT coherent AND len(odd) > 0 AND len(even) > 0)""")
def valid_decisions(spark, sf):
    v = ql.valid_decisions(cache(spark, sf))
    joined = F.array_join(F.transform("groups", lambda g: F.array_join(
        F.transform(g, lambda i: i.cast("string")), ",")), "|")
    return v.select("fingerprint", "coherent", "title", joined.alias("groups"))


@query("reused_decisions", f"""
WITH {CACHE} SELECT cluster, fingerprint, coherent, title FROM cache
WHERE (coherent AND title <> '') OR (NOT coherent AND len(odd) > 0 AND len(even) > 0)""")
def reused_decisions(spark, sf):
    return ql.reuse_by_fingerprint(small_clusters(spark, sf).select("cluster", "id"), cache(spark, sf)).select(
        "cluster", "fingerprint", "coherent", "title")


@query("prior_splits", f"""
WITH {CACHE}, bad AS (SELECT cluster AS verdict, unnest(ids) AS id FROM cache
  WHERE NOT coherent AND len(odd) > 0 AND len(even) > 0),
wide AS (SELECT id, cluster // 199 * 199 + cluster % 199 // 2 * 2 AS cluster FROM small),
big AS (SELECT * FROM wide WHERE cluster IN (SELECT cluster FROM wide GROUP BY 1 HAVING count(*) >= 3)),
hit AS (SELECT h.cluster, min(verdict) AS v, fp.fingerprint FROM (SELECT big.cluster, bad.verdict,
    count(*) AS n, count(DISTINCT bad.id % 2) AS g FROM big JOIN bad ON bad.id = big.id GROUP BY 1, 2) h
  JOIN fp ON fp.cluster = h.verdict WHERE n >= 2 AND g >= 2 GROUP BY 1, 3),
best AS (SELECT cluster, arg_min(v, fingerprint) AS v FROM hit GROUP BY 1)
SELECT big.cluster, big.id, CASE WHEN bad.id IS NULL THEN -big.id - 1 WHEN big.id % 2 = 1 THEN 0 ELSE 1 END AS part
FROM big JOIN best ON best.cluster = big.cluster LEFT JOIN bad ON bad.id = big.id AND bad.verdict = best.v""")
def prior_splits(spark, sf):
    c = F.col("cluster")
    wide = small_clusters(spark, sf).select(
        "id", (F.floor(c / 199) * 199 + F.floor(c % 199 / 2) * 2).cast("bigint").alias("cluster"))
    return ql.prior_splits(wide, cache(spark, sf))


@query("applied_verdicts")
def applied_verdicts(spark, sf):
    m = small_clusters(spark, sf).select("cluster", "id")
    members, titles = ql.apply_verdicts(m, articles(spark, sf), cache(spark, sf))
    return members.join(titles, "cluster").select("cluster", "id", "title", "reused")


def judged(spark, sf):
    """Coherence answers derived from the small clusters: keep, coherent, split, fallback, nonsense."""
    l = hooks.cluster_listing(small_clusters(spark, sf))
    k = F.col("cluster") % 5
    answer = (F.when(k == 0, " 1 ").when(k == 1, '{"coherent": true, "title": " New title ", "summary": " Sum "}')
              .when(k == 2, 'Split: {"coherent": false, "groups": [[1, 9], [2, 3], []]}')
              .when(k == 3, '{"headline": "Only a headline"}').otherwise("no idea"))
    return l.select("cluster", "listing", "article_ids", answer.alias("answer"),
                    F.when(F.col("cluster") % 2 == 0, "Old title").alias("old_title"))


@query("parsed_verdicts", f"""
WITH {SMALL}, c AS (SELECT cluster, cluster % 5 AS k, count(*) AS n, list(id ORDER BY id) AS ids FROM small GROUP BY 1)
SELECT cluster, CASE WHEN k = 2 THEN false ELSE true END AS coherent,
  CASE k WHEN 0 THEN 'Old title' WHEN 1 THEN 'New title' WHEN 3 THEN 'Only a headline' END AS title,
  CASE k WHEN 1 THEN 'Sum' END AS summary,
  CASE k WHEN 2 THEN ids[1] || '|' || ids[2] || CASE WHEN n >= 3 THEN ',' || ids[3] ELSE '' END END AS groups
FROM c WHERE (k = 0 AND cluster % 2 = 0) OR k IN (1, 3) OR (k = 2 AND n >= 2)""")
def parsed_verdicts(spark, sf):
    j = judged(spark, sf)
    v = j.select("cluster", ps.parse_coherence("answer", "article_ids", "old_title").alias("v")).where("v is not null")
    groups = F.array_join(F.transform("v.groups", lambda g: F.array_join(
        F.transform(g, lambda i: i.cast("string")), ",")), "|")
    return v.select("cluster", "v.coherent", "v.title", "v.summary", groups.alias("groups"))


@query("cluster_listings", f"""
WITH {SMALL} SELECT cluster, md5(string_agg(rn || '. [' || title || '] ' || coalesce(summary, title), chr(10) ORDER BY rn))
  AS digest FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS rn FROM small) GROUP BY 1""")
def cluster_listings(spark, sf):
    return hooks.cluster_listing(small_clusters(spark, sf)).select("cluster", F.md5("listing").alias("digest"))


@query("usable_summaries", f"""
WITH {SMALL}, c AS (SELECT DISTINCT cluster FROM small) SELECT cluster, cluster % 5 = 1 AS usable FROM c
WHERE (cluster % 5 = 0 AND cluster % 2 = 0) OR cluster % 5 IN (1, 3)""")
def usable_summaries(spark, sf):
    j = judged(spark, sf).where("cluster % 5 <> 2")
    v = j.select("cluster", ps.parse_coherence("answer", "article_ids", "old_title").alias("v")).where("v is not null")
    return v.select("cluster", rp.usable_summary("v").alias("usable"))


@query("decision_rows", f"""
WITH {SMALL}, c AS (SELECT cluster, list(id ORDER BY id) AS ids FROM small GROUP BY 1)
SELECT array_to_string(ids, ',') AS fingerprint, cluster % 5 <> 2 AS coherent,
  CASE cluster % 5 WHEN 0 THEN 'Old title' WHEN 1 THEN 'New title' WHEN 3 THEN 'Only a headline' END AS title
FROM c WHERE (cluster % 5 = 0 AND cluster % 2 = 0) OR cluster % 5 IN (1, 3) OR (cluster % 5 = 2 AND len(ids) >= 2)""")
def decision_rows(spark, sf):
    j = judged(spark, sf).withColumns({
        "verdict": ps.parse_coherence("answer", "article_ids", "old_title"), "model": F.lit("m")})
    return ql.decision_rows(j).select("fingerprint", "coherent", "title")


@query("refreshed_stories", f"""
WITH hit AS (SELECT DISTINCT story_id FROM news_articles WHERE story_id IS NOT NULL AND created_at > TIMESTAMP '{SCOPE_NOW}')
SELECT s.id AS story_id, CASE WHEN s.id % 2 = 0 THEN 'Fresh ' || s.id ELSE s.title END AS title,
  array_to_string(s.topics, ',') AS topics FROM news_stories s JOIN hit ON hit.story_id = s.id""")
def refreshed_stories(spark, sf):
    a = articles(spark, sf)
    changed = a.where(f"created_at > timestamp_ntz'{SCOPE_NOW}'").select("id")
    s = fx.news_stories(spark, sf)
    v = s.where("id % 2 = 0").select(F.col("id").alias("story_id"), F.lit(True).alias("coherent"), F.concat(
        F.lit("Fresh "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("summary"))
    out = rc.refresh_stories(s, a, changed, v)
    return out.select("story_id", "title", F.array_join("topics", ",").alias("topics"))


SCOPED = "2024-01-25 18:00:00"


def size_judge(listing, old_title):
    """A stand-in judge: lists of up to six articles are coherent, longer ones fall into halves."""
    n = len(re.findall(r"(?m)^[0-9]+\. \[", listing))
    if n <= 6:
        return '{"coherent": true, "title": "Judged %d"}' % n
    return '{"coherent": false, "groups": [%s, %s]}' % (list(range(1, n // 2 + 1)), list(range(n // 2 + 1, n + 1)))


@query("reclustered_stories")
def reclustered_stories(spark, sf):
    """The whole periodic job on the recent window: final clusters, their stories, and what happens to these."""
    job = rc.recluster(articles(spark, sf), vectors(spark, sf), fx.news_sources(spark, sf), cache(spark, sf), SCOPED,
                       stories=fx.news_stories(spark, sf, entities=True), judge=size_judge, model="m", seed_hours=24)
    facts = job.facts.select("cluster", "title", "article_count", "source_count", "relevance_score")
    return job.members.join(facts, "cluster").join(job.changes.where("cluster is not null"), "cluster")


@query("settled_verdicts")
def settled_verdicts(spark, sf):
    """Verdicts of two runs over the small clusters, the second with those of the first in its store: only titles that the
    outlier gate holds back are asked for again."""
    m, a, store = small_clusters(spark, sf).select("cluster", "id"), articles(spark, sf).join(vectors(spark, sf), "id"), cache(spark, sf)
    out = None
    for run in (1, 2):
        m, _, new = ql.settle(m, a, store, judge=size_judge, model="m", now=SCOPED)
        store = cut(upsert(store, new.select(*store.columns), "fingerprint"))
        rows = new.select("fingerprint", "coherent", "title", F.size("groups").alias("parts"), F.lit(run).alias("run"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("judged_clusters")
def judged_clusters(spark, sf):
    """A stand-in judge called inside the tasks: clusters whose listing is short are coherent."""
    def judge(listing, old_title):
        if old_title:
            return "1"
        n = listing.count("\n") + 1
        return '{"coherent": true, "title": "Short"}' if n < 3 else '{"coherent": false, "groups": [[1], [2, 3]]}'

    l = hooks.cluster_listing(small_clusters(spark, sf)).withColumn(
        "old_title", F.when(F.col("cluster") % 3 == 0, "Old title"))
    answers = hooks.judge(l, judge)
    v = l.join(answers, ["cluster", "part"]).select("cluster", ps.parse_coherence("answer", "article_ids", "old_title").alias("v"))
    return v.select("cluster", "v.coherent", "v.title", F.size("v.groups").alias("n_groups"))
