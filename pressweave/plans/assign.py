"""Assigning new articles to existing stories, or to new ones."""

from __future__ import annotations

import datetime as dt
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.news import seconds_between
from ..operators.groups import centroid, merge_centroids, merge_entities
from ..operators.simjoin import BLOCK, knn_join
from ..session import cut
from .feed import as_datetime, ntz
from .pairing import assign_compatible, pair_scores, rescue_allowed, terms

STORY = ["id", "title", "article_count", "entities", "centroid", "created_at"]


def _side(df: DataFrame, vec: str) -> DataFrame:
    return df.select(F.lit("").alias("grp"), "id", F.col(vec).alias("vec"), *[c for c in ("ord",) if c in df.columns])


def candidate_scores(articles: DataFrame, stories: DataFrame, now, k: int = 10,
                     threshold: float = vocab.SIM_THRESHOLD, block: int = BLOCK, earlier: bool = False) -> DataFrame:
    """Acceptable (article, story) pairs with their combined score.

    Articles: ``id, vec, matching_text, role, entities``. Stories are open ones; with ``earlier`` only those of a smaller ``ord``."""
    near = knn_join(_side(articles, "vec"), _side(stories, "centroid"), k, threshold - vocab.CANDIDATE_MARGIN,
                    block=block, earlier=earlier).select("id", F.col("nbr").alias("story_id"), "sim")
    st = terms(stories, "title", "entities", "_b").select(F.col("id").alias("story_id"), "article_count", "created_at", "_b", "_be")
    mine = terms(articles, "matching_text", "entities", "_a").select("id", "role", "_a", "_ae")
    t = pair_scores(near.join(mine, "id").join(st, "story_id"), "_a", "_b")
    age_h = seconds_between(ntz(as_datetime(now)), "created_at") / 3600.0
    score = (F.col("sim") * F.exp(-age_h / 24.0) * vocab.WEIGHT_SEMANTIC
             + F.col("entity_score") * vocab.WEIGHT_ENTITY + F.col("token_score") * vocab.WEIGHT_TOKEN)
    penalty = F.when(F.col("sim") >= 0.90, 0.0).otherwise(F.col("article_count") / vocab.MAX_STORY_SIZE * 0.05)
    good = F.col("score") >= threshold + penalty
    rescue = rescue_allowed("role", "sim", "token_score", "entity_score", "shared_entities")
    return (t.withColumn("score", score)
            .where(assign_compatible("role", "token_score", "entity_score", "shared_entities"))
            .where(good | rescue).where((F.col("sim") >= min(vocab.MIN_COHERENCE, threshold)) & (F.col("score") > 0))
            .select("id", "story_id", "sim", "score"))


def _founders(lonely: DataFrame, first: DataFrame, max_size: int, parts: int = 64) -> DataFrame:
    """Ids of ``first`` and, as its exact copies (equal ``_same``) fill one story each ``max_size``, of every so-many-th copy.

    Copies are numbered in ``parts`` slices by a hash of their id, so a hot group is not one task."""
    slices = Window.partitionBy("_same").orderBy("_part")
    t = lonely.select("id", "_same").join(first.select("_same").distinct(), "_same", "left_semi").join(
        first.select("id", F.lit(-1).alias("_at")), "id", "left").withColumn(
        "_part", F.coalesce("_at", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")))
    before = t.groupBy("_same", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(slices.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_same", "_part").orderBy("id"))
    numbered = t.withColumn("_nth", nth).join(before, ["_same", "_part"])
    return numbered.where((F.col("_part") == -1) | ((F.col("_before") + F.col("_nth") - 1) % max_size == 0)).select("id")


def assign_stories(articles: DataFrame, stories: DataFrame, now, threshold: float = vocab.SIM_THRESHOLD,
                   max_size: int = vocab.MAX_STORY_SIZE, lookback_hours: int = vocab.ASSIGN_LOOKBACK_HOURS,
                   rounds: int | None = None, k: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(assignments, new_stories, changed_stories)`` for one batch of articles.

    Articles ``id, vec, title, matching_text, role, entities, article_type, created_at``; stories ``id, title,
    article_count, entities, centroid, created_at, updated_at``. Aggregation articles get no story.

    One round scores everything still open against the current stories, gives each article its best story,
    lets a story take its best articles up to its free places, and moves centroids, counts and entities. An
    article without any story founds one, unless it would take the story that one of the ``k`` nearest earlier articles of
    the same kind would found: then it waits for that one. Who is merely near waits for nobody, so rounds do not follow
    chains of near articles, which grow with their number.
    Of exact copies every ``max_size``-th founds one at once, so a hot event takes few rounds. Rounds go on until
    nothing is open: each one has a founder or an article that finds a place. With ``rounds`` given, what is left
    after the last one founds a story each. Existing stories that took articles come back with their new centroid,
    count and entities. New ids are the largest story id plus the founder's
    id plus one. Within a batch the outcome does not depend on row order.
    """
    cutoff = ntz(as_datetime(now) - dt.timedelta(hours=lookback_hours))
    todo = cut(articles.where("article_type is null or article_type <> 'aggregation'").withColumns({
        "ord": F.col("id"), "_same": F.xxhash64("vec", "matching_text", "role", "entities")}))
    top_id = stories.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    now_stories = cut(stories.where((F.col("updated_at") > cutoff) & F.col("centroid").isNotNull()).select(*STORY))
    done, founded = [], []

    def found(rows: DataFrame, *more: str) -> DataFrame:
        return rows.select((F.col("id") + F.lit(top_id + 1)).alias("id"), "title", F.lit(1).cast("bigint").alias(
            "article_count"), "entities", F.col("vec").alias("centroid"), ntz(as_datetime(now)).alias("created_at"), *more)

    for turn in itertools.count():
        if todo.isEmpty():
            break
        if turn == rounds:
            seeds, taken = todo, None
        else:
            free = now_stories.where(F.col("article_count") < max_size)
            scored = cut(candidate_scores(todo, free, now, k, threshold, block))
            mine = Window.partitionBy("id").orderBy(F.col("score").desc(), F.xxhash64("id", "story_id"), "story_id")
            best = scored.withColumn("_rn", F.row_number().over(mine)).where("_rn = 1").drop("_rn")
            queue = Window.partitionBy("story_id").orderBy(F.col("score").desc(), "id")
            room = free.select(F.col("id").alias("story_id"), (F.lit(max_size) - F.col("article_count")).alias("room"))
            taken = cut(best.withColumn("_rn", F.row_number().over(queue)).where(F.col("_rn") <= max_size)
                        .join(room, "story_id").where(F.col("_rn") <= F.col("room"))
                        .select("id", "story_id", "score", "sim"))
            lonely = cut(todo.join(scored.select("id"), "id", "left_anti"))
            # ids are given in arrival order, so the lower id is the earlier article
            waiting = candidate_scores(lonely, found(lonely, "ord"), now, k, threshold, block, earlier=True).select("id")
            first = lonely.join(waiting, "id", "left_anti").select("id", "_same")
            seeds = cut(lonely.join(_founders(lonely, first, max_size), "id", "left_semi"))
        fresh = cut(found(seeds))
        founded.append(fresh)
        seeded = seeds.select("id", (F.col("id") + F.lit(top_id + 1)).alias("story_id"))
        done.append(cut(seeded if taken is None else seeded.unionByName(taken.select("id", "story_id"))))
        if taken is None:
            break
        grown = taken.join(todo.select("id", "vec", "entities"), "id")
        hit = now_stories.join(taken.select(F.col("story_id").alias("id")).distinct(), "id", "left_semi")
        means = centroid(grown, "story_id", vec="vec").select(F.col("story_id").alias("id"), F.col("centroid").alias(
            "_m"), F.col("n").alias("_n"))
        names = merge_entities(
            hit.select(F.col("id").alias("story_id"), F.lit(-1).cast("bigint").alias("id"), "entities").unionByName(
                grown.select("story_id", "id", "entities")).where("entities is not null"), "story_id")
        moved = (hit.drop("entities").join(means, "id").join(names.withColumnRenamed("story_id", "id"), "id", "left")
                 .withColumn("centroid", merge_centroids("centroid", "article_count", "_m", "_n"))
                 .withColumn("article_count", F.col("article_count") + F.col("_n")).select(*STORY))
        now_stories = cut(now_stories.join(hit.select("id"), "id", "left_anti").unionByName(moved).unionByName(fresh))
        todo = cut(todo.join(done[-1].select("id"), "id", "left_anti"))

    def union(frames, like):
        out = frames[0] if frames else like.limit(0)
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    assigned = union(done, todo.select("id", F.lit(0).cast("bigint").alias("story_id")))
    current = now_stories.select("id", "title", "article_count", "entities", "centroid")
    founders = union(founded, now_stories).select("id").distinct()
    late = union(founded[-1:], now_stories).select(*current.columns)
    new = current.join(founders, "id", "left_semi").unionByName(late.join(current.select("id"), "id", "left_anti"))
    changed = now_stories.join(stories.select("id"), "id", "left_semi").join(
        assigned.select(F.col("story_id").alias("id")), "id", "left_semi").select(*current.columns)
    return assigned, new, changed


def renewed(stories: DataFrame, new: DataFrame, changed: DataFrame, at, everything: bool = False) -> DataFrame:
    """Rows to write after a batch: new stories and changed ones, dated ``at``; with ``everything`` the others too."""
    moved = changed.join(stories.select("id", "created_at"), "id").withColumn("updated_at", at)
    rows = moved.unionByName(new.withColumns({"created_at": at, "updated_at": at}))
    return rows.unionByName(stories.join(changed.select("id"), "id", "left_anti")) if everything else rows


def rebuild(articles: DataFrame, bounds: list, now, **options) -> DataFrame:
    """Forget all assignments and assign again in time order, one batch per ``bounds`` interval.

    Stories founded in one batch are open to the next ones."""
    spark = articles.sparkSession
    empty = spark.createDataFrame(
        [], "id bigint, title string, article_count bigint, entities array<string>, centroid array<double>, "
            "created_at timestamp_ntz, updated_at timestamp_ntz")
    stories, out = empty, None
    for lo, hi in zip(bounds, bounds[1:]):
        batch = articles.where((F.col("created_at") >= ntz(as_datetime(lo))) & (F.col("created_at") < ntz(as_datetime(hi))))
        done, new, changed = assign_stories(batch, stories, hi, **options)
        stories = cut(renewed(stories, new, changed, ntz(as_datetime(hi)), everything=True).select(*empty.columns))
        out = done if out is None else out.unionByName(done)
    return out
