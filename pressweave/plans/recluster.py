"""The periodic re-clustering job and its parts."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.news import seconds_between
from ..functions.text import event_role
from ..operators.density import density_clusters, split_oversize, with_singletons
from ..operators.groups import centroid, top_topics
from ..operators.keyed import drop_empty, upsert
from ..operators.matching import reconcile, story_changes
from ..operators.merging import merge_clusters, split_marks
from ..operators.simjoin import pair_stats, top_pairs
from ..session import cut
from .feed import as_datetime, ntz
from .pairing import needs_validation
from .quality import fingerprints, judged_clusters, regroup, settle, valid_decisions
from .stories import cluster_facts


def recluster_scope(articles: DataFrame, vectors: DataFrame, now, seed_hours: int = 24) -> DataFrame:
    """Recent articles plus the older ones of every story they touch, without aggregation articles and
    articles that have no vector."""
    cutoff = ntz(as_datetime(now) - dt.timedelta(hours=seed_hours))
    recent = articles.where(F.col("created_at") > cutoff)
    active = recent.where("story_id is not null").select("story_id").distinct()
    tails = articles.where(F.col("created_at") <= cutoff).join(active, "story_id", "left_semi")
    both = recent.unionByName(tails.select(*recent.columns))
    return both.where("article_type is null or article_type <> 'aggregation'").join(vectors, "id")


def cluster_input(scope: DataFrame, now) -> DataFrame:
    hours = seconds_between(ntz(as_datetime(now)), F.coalesce("published_at", "created_at")) / 3600.0
    return scope.select("id", F.col("embedding").alias("vec"), hours.alias("hours"))


def facts_with_centroid(members: DataFrame, scope: DataFrame, sources: DataFrame) -> DataFrame:
    """Cluster facts, mean vector and number of members."""
    rows = members.join(scope, "id")
    facts = cluster_facts(rows, sources, key="cluster")
    return facts.join(centroid(rows, "cluster").select("cluster", "centroid"), "cluster", "left")


def merged_facts(members: DataFrame, merged: DataFrame, scope: DataFrame, sources: DataFrame,
                 titles: DataFrame) -> DataFrame:
    """Facts of merged clusters; the title is that of the largest part (then the lowest key)."""
    whole = members.join(merged.select(F.col("id").alias("cluster"), "merged"), "cluster")
    facts = cluster_facts(whole.drop("cluster").withColumnRenamed("merged", "cluster").join(scope, "id"), sources,
                          key="cluster").drop("title", "summary")
    part = whole.groupBy("merged", "cluster").agg(F.count(F.lit(1)).alias("n"))
    best = part.join(titles, "cluster").groupBy("merged").agg(F.max_by(
        F.struct("title", "summary"), F.struct("n", (-F.col("cluster")).alias("k"))).alias("t"))
    return facts.join(best.withColumnRenamed("merged", "cluster"), "cluster").select("*", "t.*").drop("t")


def near_merge_pairs(clusters: DataFrame, threshold: float = vocab.MERGE_THRESHOLD, margin: float = 0.10,
                     n: int = 10) -> DataFrame:
    """Most similar centroid pairs down to ``margin`` below the merge threshold."""
    side = clusters.select(F.lit("").alias("grp"), "id", F.col("centroid").alias("vec"))
    return top_pairs(side, n, threshold - margin).drop("grp")


def story_pair_stats(articles: DataFrame, vectors: DataFrame) -> DataFrame:
    """Similarity inside each story: pairs, average, minimum, maximum."""
    rows = articles.where("story_id is not null").select("id", "story_id").join(vectors, "id")
    return pair_stats(rows.select(F.col("story_id").cast("string").alias("grp"), "id",
                                  F.col("embedding").alias("vec"))).withColumnRenamed("grp", "story_id")


def cross_story_stats(articles: DataFrame, vectors: DataFrame, sample: int = 1000) -> DataFrame:
    """Similarity across stories on a repeatable sample: the articles with the smallest id hashes are paired off
    by position, so the sample costs one top-k read and an equi join."""
    from pyspark.sql import Window

    from ..operators.simjoin import cosine
    have = articles.where("story_id is not null").select("id", "story_id").join(
        vectors.select("id", "embedding"), "id")
    picked = have.withColumn("_h", F.md5(F.col("id").cast("string"))).orderBy("_h", "id").limit(2 * sample)
    pos = picked.withColumn("_p", F.row_number().over(Window.orderBy("_h", "id")) - 1)
    even = pos.where("_p % 2 = 0").select(F.floor(F.col("_p") / 2).alias("slot"), F.col("id").alias("a"),
                                          F.col("story_id").alias("sa"), F.col("embedding").alias("va"))
    odd = pos.where("_p % 2 = 1").select(F.floor(F.col("_p") / 2).alias("slot"), F.col("id").alias("b"),
                                         F.col("story_id").alias("sb"), F.col("embedding").alias("vb"))
    sims = even.join(odd, "slot").where("sa <> sb").select(cosine("va", "vb").alias("sim"))
    return sims.agg(F.count(F.lit(1)).alias("pairs"), F.avg("sim").alias("avg_sim"), F.min("sim").alias("min_sim"),
                    F.max("sim").alias("max_sim"))


class Reclustered(NamedTuple):
    """What a re-clustering run leaves: final clusters and everything that has to be written."""

    members: DataFrame    #: cluster, id
    facts: DataFrame      #: one row per cluster
    matches: DataFrame    #: cluster, story_id (null: a new story)
    moves: DataFrame      #: articles whose story changes
    cleared: DataFrame    #: articles that leave their story
    check_deletion: DataFrame  #: stories that lose articles
    titles: DataFrame     #: titles before merging, with ``reused``
    decisions: DataFrame  #: verdicts of this run
    cache: DataFrame      #: the verdict store with them
    flagged: DataFrame    #: merged clusters that a judge should see, with their parts
    changes: DataFrame    #: insert, update, skip or delete per story


def _old_stories(scope: DataFrame, stories: DataFrame) -> DataFrame:
    """Fingerprints, titles and summaries of the stories that articles in scope stand in."""
    held = scope.where("story_id is not null").select(F.col("story_id").alias("cluster"), "id")
    t = stories.select(F.col("id").alias("cluster"), "title", "summary")
    return fingerprints(held).join(t, "cluster").select("fingerprint", "title", "summary")


def _revalidated(final: DataFrame, merged: DataFrame, flagged: DataFrame, scope: DataFrame, judge, max_size: int):
    """Merged clusters sent back to the judge: ``(final, titles, decisions)``, split ones as the judge says."""
    rows = final.join(flagged.select("cluster"), "cluster", "left_semi").join(scope, "id")
    verdicts = judged_clusters(rows, judge, max_size)
    split = verdicts.where(~F.col("coherent")).select("cluster", F.posexplode("groups").alias("part", "ids")).select(
        "cluster", F.explode("ids").alias("id"), "part").groupBy("cluster", "id").agg(F.min("part").cast("bigint").alias("part"))
    split = cut(split.join(final, ["cluster", "id"], "left_semi"))
    parts = regroup(split)
    whole = final.join(split.select("cluster").distinct(), "cluster", "left_anti")
    return cut(whole.unionByName(parts)), parts, verdicts.where("coherent").select("cluster", F.struct("title", "summary").alias("v"))


def recluster(articles: DataFrame, vectors: DataFrame, sources: DataFrame, cache: DataFrame, now, stories: DataFrame | None = None,
              judge=None, model: str = "", seed_hours: int = 24, max_size: int = vocab.MAX_CLUSTER_SIZE,
              merge_threshold: float = vocab.MERGE_THRESHOLD, merge_max_size: int = vocab.MERGE_MAX_SIZE, **density) -> Reclustered:
    """One run of the periodic job: scope, cluster, split, settle by verdicts, merge, validate, reconcile.

    ``cache`` is the verdict store that the run reads and that comes back with the new verdicts upserted; verdicts that split
    articles also keep the merge from joining them again. ``stories`` are the existing ones: a cluster with just the members of one
    keeps its title, and ``changes`` says what happens to each (new stories get ids above the existing ones). ``judge`` is asked
    about clusters without a verdict and about merged ones that :func:`needs_validation` flags; without it these stay
    merged and are only listed in ``flagged``."""
    scope = cut(recluster_scope(articles, vectors, now, seed_hours))
    points = cluster_input(scope, now)
    labels = density_clusters(points, **density)
    labels = split_oversize(points, labels, max_size)
    members = cut(with_singletons(labels).select("cluster", "id"))
    known = _old_stories(scope, stories) if stories is not None else None
    at = ntz(as_datetime(now))
    members, titles, decisions = settle(members, scope, cache, known, judge, model, at, max_size)
    new_cache = cut(upsert(cache, decisions.select(*cache.columns), "fingerprint"))
    base = centroid(members.join(scope, "id"), "cluster").join(
        members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")
    splits = valid_decisions(new_cache).where(~F.col("coherent")).select("fingerprint", "groups")
    base = base.join(split_marks(members, splits), "cluster", "left")
    merged = merge_clusters(base.select(F.col("cluster").alias("id"), "size", "centroid", "marks"), merge_threshold, merge_max_size)
    merged = cut(members.select("cluster").distinct().join(merged.withColumnRenamed("id", "cluster"), "cluster", "left").select(
        F.col("cluster").alias("id"), F.coalesce("merged", "cluster").alias("merged")))  # clusters without a centroid stay
    placed = cut(members.join(merged.select(F.col("id").alias("cluster"), "merged"), "cluster").select(
        F.col("merged").alias("cluster"), F.col("cluster").alias("part"), "id"))
    final = placed.select("cluster", "id")
    roles = placed.join(scope, "id").select("cluster", "part", event_role("title", "story_identity", "main_event", "article_type").alias("role"))
    flagged = needs_validation(roles, "cluster", "part").where("needs_validation").select("cluster")
    flagged = cut(placed.join(flagged, "cluster", "left_semi").groupBy("cluster").agg(
        F.array_sort(F.collect_set("part")).alias("parts"), F.array_sort(F.collect_list("id")).alias("article_ids")))
    facts = merged_facts(members, merged, scope, sources, titles)
    if judge is not None:
        final, parts, given = _revalidated(final, merged, flagged, scope, judge, max_size)
        own = facts_with_centroid(parts, scope, sources).drop("centroid").select(*facts.columns)
        gone = flagged.select("cluster").join(given, "cluster", "left_anti").join(parts.join(placed.withColumnRenamed("cluster", "_m"), "id").select(
            F.col("_m").alias("cluster")).distinct(), "cluster", "left_semi")
        kept = facts.join(gone, "cluster", "left_anti").join(given, "cluster", "left")
        kept = kept.withColumns({"title": F.coalesce("v.title", "title"), "summary": F.when(F.col("v").isNotNull(), F.col("v.summary")).otherwise(
            F.col("summary"))}).drop("v")
        facts = kept.select(*facts.columns).unionByName(own)
    facts = cut(facts)
    matches, moves, cleared, loses = reconcile(final, scope.select("id", "story_id"))
    matches, moves = cut(matches), cut(moves)
    changes = planned_changes(facts, matches, moves, cleared, loses, articles, stories) if stories is not None else None
    return Reclustered(final, facts, matches, moves, cleared, loses, titles, decisions, new_cache, flagged, changes)


STORY_FIELDS = ["title", "summary", "topics", "entities", "article_count", "source_count", "relevance_score", "first_seen_at"]


def planned_changes(facts: DataFrame, matches: DataFrame, moves: DataFrame, cleared: DataFrame, loses: DataFrame, articles: DataFrame,
                    stories: DataFrame) -> DataFrame:
    """``story_id, cluster, change``: insert for new stories, update where a field or a member changes, skip, and delete for
    stories that lost their last article. A new story's id is the greatest existing one plus its cluster's key plus one."""
    top = stories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    final = facts.join(matches, "cluster")
    fresh = final.where("story_id is null").join(top).select((F.col("_top") + F.col("cluster") + 1).alias("story_id"), "cluster", F.lit("insert").alias("change"))
    old = final.where("story_id is not null")
    cols = [f for f in STORY_FIELDS if f in facts.columns and f in stories.columns]
    held = stories.withColumnRenamed("id", "story_id").join(old.select("story_id"), "story_id", "left_semi")
    joined = moves.where("story_id is not null").select("story_id").distinct().withColumn("_moved", F.lit(True))
    same = story_changes(old, held, cols).join(old.select("story_id", "cluster"), "story_id").join(joined, "story_id", "left").select(
        "story_id", "cluster", F.when(F.col("_moved") & (F.col("change") == "skip"), "update").otherwise(F.col("change")).alias("change"))
    leaving = moves.select("id").union(cleared.select("id"))
    still = articles.select("id", "story_id").join(leaving, "id", "left_anti").unionByName(
        moves.where("story_id is not null").select("id", "story_id"))
    candidates = loses.select(F.col("story_id").alias("id"))
    left = drop_empty(stories, still, candidates).select("id")
    gone = stories.join(candidates, "id", "left_semi").join(left, "id", "left_anti").select(
        F.col("id").alias("story_id"), F.lit(None).cast("bigint").alias("cluster"), F.lit("delete").alias("change"))
    return cut(fresh.unionByName(same).unionByName(gone))


def refresh_stories(stories: DataFrame, articles: DataFrame, changed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """New topics and, where a coherent verdict exists, title and summary for stories with changed articles."""
    hit = articles.where("story_id is not null").join(changed.select("id"), "id", "left_semi").select(
        "story_id").distinct()
    mine = articles.join(hit, "story_id", "left_semi")
    topics = top_topics(mine, "story_id").withColumnRenamed("topics", "_topics")
    v = verdicts.where("coherent").select("story_id", F.col("title").alias("_title"), F.col("summary").alias("_summary"))
    t = stories.withColumnRenamed("id", "story_id").join(hit, "story_id", "left_semi")
    return (t.join(topics, "story_id", "left").join(v, "story_id", "left")
            .select("story_id", F.coalesce("_title", "title").alias("title"),
                    F.coalesce("_summary", "summary").alias("summary"), F.col("_topics").alias("topics")))
