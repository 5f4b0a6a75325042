"""Matching new clusters to existing stories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def overlaps(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """``cluster, story_id, overlap, ratio`` for clusters ``(cluster, id)`` and stories ``(story_id, id)``."""
    have = assigned.where("story_id is not null").select("story_id", "id")
    size = have.groupBy("story_id").agg(F.count(F.lit(1)).alias("_n"))
    both = members.select("cluster", "id").join(have, "id").groupBy("cluster", "story_id").agg(
        F.count(F.lit(1)).alias("overlap"))
    return both.join(size, "story_id").select("cluster", "story_id", "overlap",
                                              (F.col("overlap") / F.col("_n")).alias("ratio"))


def _preference():
    return [F.col("overlap").desc(), F.col("ratio").desc(), F.col("story_id")]


def best_overlap(members: DataFrame, assigned: DataFrame) -> DataFrame:
    w = Window.partitionBy("cluster").orderBy(*_preference())
    return overlaps(members, assigned).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def match_stories(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """``cluster, story_id``: clusters in order of their smallest member each take their best free story.

    All clusters ask for their best remaining story at once and a story keeps the first cluster in order;
    what it turns down is struck out. Since every story ranks clusters alike, this ends in exactly the
    matching that serving the clusters one by one gives."""
    rank = members.groupBy("cluster").agg(F.min("id").alias("ord"))
    cand = cut(overlaps(members, assigned).join(rank, "cluster"))
    w = Window.partitionBy("cluster").orderBy(*_preference())
    while True:
        top = cand.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
        kept = top.groupBy("story_id").agg(F.min_by("cluster", F.struct("ord", "cluster")).alias("holder"))
        lost = cut(top.join(kept, "story_id").where("cluster <> holder").select("cluster", "story_id"))
        if lost.isEmpty():
            return top.select("cluster", "story_id")
        cand = cut(cand.join(lost, ["cluster", "story_id"], "left_anti"))


def reconcile(members: DataFrame, assigned: DataFrame):
    """``(matches, moves, cleared, check_deletion)``.

    matches: every cluster with its story id, null for a new story. moves: articles whose story changes (new
    stories included). cleared: articles that had a story and are in no final cluster. check_deletion: stories
    that lose articles."""
    match = match_stories(members, assigned)
    clusters = members.select("cluster").distinct()
    matches = clusters.join(match, "cluster", "left")
    old = assigned.select("id", F.col("story_id").alias("old_story_id"))
    placed = members.join(match, "cluster", "left").join(old, "id", "left")
    moves = placed.where(~F.col("story_id").eqNullSafe(F.col("old_story_id")) | F.col("story_id").isNull()).select(
        "id", "cluster", "story_id", "old_story_id")
    cleared = old.where("old_story_id is not null").join(members.select("id"), "id", "left_anti")
    loses = (moves.where("old_story_id is not null").select("old_story_id")
             .union(cleared.select("old_story_id")).distinct().withColumnRenamed("old_story_id", "story_id"))
    return matches, moves, cleared, loses


def story_changes(final: DataFrame, existing: DataFrame, fields: list[str], key: str = "story_id") -> DataFrame:
    """``insert`` / ``update`` / ``skip`` for final stories and ``delete`` for existing ones not among them."""
    new = final.select(key, F.struct(*fields).alias("_new"), F.lit(True).alias("_in"))
    old = existing.select(key, F.struct(*fields).alias("_old"), F.lit(True).alias("_ex"))
    j = new.join(old, key, "full_outer")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"_new.{f}").eqNullSafe(F.col(f"_old.{f}"))
    change = (F.when(F.col("_ex").isNull(), "insert").when(F.col("_in").isNull(), "delete")
              .when(same, "skip").otherwise("update"))
    return j.select(key, change.alias("change"))
