"""Mixing sources to target weights by repetition rates.

Every source gets a target number of words: a share of all words by its weight, at most ``cap`` times its own
size, the excess reshared by weight. Its rate is target / size. A document comes ``floor(rate)`` times and once
more if a hash of its key falls below the fraction. Hashes hold several independent draws; each source uses
the draw whose total is nearest to its target, so that few long documents do not carry it far off.

Documents are aggregated to a row per source once; all that is iterated is that table, and what comes back to
the driver is two sums a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_BYTES, attach, word_count

#: Draws of 32 bits in one SHA-256 of a key.
DRAWS = 8
SCALE = float(1 << 32)


def draw_hash(doc_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)


def drawn(hashed: Column, which: Column | int) -> Column:
    """The ``which``-th 32 bits of a key's hash."""
    which = F.lit(which) if isinstance(which, int) else which
    return F.conv(F.substr(hashed, which * 8 + 1, F.lit(8)), 16, 10).cast("bigint")


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``(source, source_size)``: the words of every source, null being one."""
    return docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size"))


def cycled_weights(sources: DataFrame, weights: tuple = (3, 1, 2)) -> DataFrame:
    """``sources`` with ``weight``: ``weights`` over and over, in order of the names' code points, null last.

    Positions come from a range shuffle and one row of counts per range, not from one sorted task."""
    order = F.col("source").asc_nulls_last()
    row = F.monotonically_increasing_id()
    placed = cut(sources.repartitionByRange(order).sortWithinPartitions(order).select(
        "*", F.shiftright(row, 33).alias("_part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    before = placed.groupBy("_part").count().select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row per task
    turn = F.pmod(F.col("_row") + F.col("_base"), F.lit(len(weights)))
    return placed.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(
        "weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))).drop("_part", "_row", "_p", "_base")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sources`` (``source, source_size, weight``) with ``target`` words.

    ``share`` of all words goes by weight; no target is above ``cap`` times its source's size, and what is cut off is
    reshared by weight until none is above. A round is two sums over the source table; the set of sources at their
    cap only grows. An empty source has target 0, and so has a source of weight 0."""
    sources = cut(sources.select("source", "source_size", "weight"))
    most = F.col("source_size") * F.lit(float(cap))
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    whole = float(share) * (total or 0)
    rest, weight, full, capped = whole, weight or 0.0, 0, F.lit(False)
    while weight > 0:
        capped = most * F.lit(weight) <= F.col("weight") * F.lit(rest)
        n, given, left = sources.agg(F.count_if(capped), F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == full:
            break
        full, rest, weight = n, whole - given, left or 0.0
    level = F.col("weight") * F.lit(rest) / F.lit(weight) if weight > 0 else F.lit(0.0)  # no weight left: the rest gets none
    return sources.withColumn("target", F.when(capped, most).otherwise(level))


def _rate() -> tuple[Column, Column]:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return F.floor(rate), (rate - F.floor(rate)) * SCALE


def rates(sized: DataFrame, planned: DataFrame, seed: int = 0, draws: int = DRAWS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(source, source_size, target, draw)``: the planned sources and the draw that each of them uses.

    ``sized`` holds ``(doc_id, source, size)``. The draw is the first of those whose words are nearest to the target."""
    whole, bound = _rate()
    hashed = attach(sized, planned.select("source", "source_size", "target"), "source", "doc_id", limit).withColumn(
        "_h", draw_hash(F.col("doc_id"), seed))
    sums = hashed.groupBy("source", "source_size", "target").agg(*(
        F.sum(F.when(drawn(F.col("_h"), i) < bound, F.col("size")).otherwise(0)).alias(f"_{i}") for i in range(draws)))
    off = F.array(*(F.struct(F.abs(whole * F.col("source_size") + F.col(f"_{i}") - F.col("target")).alias("off"),
                             F.lit(i).alias("draw")) for i in range(draws)))
    return sums.select("source", "source_size", "target", F.array_min(off)["draw"].alias("draw"))


def copies(doc_id: str = "doc_id", seed: int = 0) -> Column:
    """How often a document comes, beside the columns of ``rates``; null where its source isn't in them."""
    whole, bound = _rate()
    return whole + (drawn(draw_hash(F.col(doc_id), seed), F.col("draw")) < bound).cast("bigint")


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple | DataFrame = (3, 1, 2), seed: int = 0,
         doc_id: str = "doc_id", source: str = "source", text: str = "text", limit: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(documents, sources)``: ``(doc_id, source, size, source_size, target, copies)`` of every row and the table of rates.

    ``weights`` is a cycle over the ordered sources or a frame ``(source, weight)``; sources that it lacks weigh 0.
    A null text has size 0 and a null source is a source of its own. Rows with equal keys, null ones too, are drawn
    alike. An empty table gives empty frames. Each text is read once."""
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                            word_count(F.col(text).cast("string")).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").cast("string").alias("source"), F.col("weight").cast("double").alias("weight"))
        sources = attach(sources, given, "source", "source", limit).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        sources = cycled_weights(sources, weights)
    chosen = cut(rates(sized, targets(sources, share, cap), seed, limit=limit))
    return attach(sized, chosen, "source", "doc_id", limit).select(
        "doc_id", "source", "size", "source_size", "target", copies(seed=seed).alias("copies")), chosen


def mix(docs: DataFrame, copy: str = "copy", seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        limit: int = BROADCAST_BYTES, **options) -> DataFrame:
    """The mixture itself: all columns of ``docs``, every document as often as ``plan`` says, numbered from 1 in ``copy``."""
    _, chosen = plan(docs, seed=seed, doc_id=doc_id, source=source, text=text, limit=limit, **options)
    packed = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"))
    some = attach(packed, chosen, "source", "doc_id", limit).withColumn("_n", copies(seed=seed)).where("_n > 0")
    return some.select(*(F.col("_row")[c].alias(c) for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias(copy))
