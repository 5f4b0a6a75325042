"""Ordered per-key operators that stay parallel when one key holds much of the data.

All rows are put in the order of (key, time) by one range shuffle, whose borders Spark samples from the data: a key with
many rows spans several ranges, many small keys share one. Work inside a range is a window over (key, range); what
crosses a border - the previous value, the last message, the sum so far - comes from an aggregate with one row per
(key, range). No task has to hold a whole key, however its rows lie in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def micros(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_slice``, the range of (keys, order) they lie in; ranges ascend with the order, equal rows share one.

    Written once, so that every later reader sees the same borders."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))


def _join_slices(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe keys and the slice."""
    right = facts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_slice").alias("_r_slice"),
                         *[c for c in facts.columns if c not in (*keys, "_slice")])
    cond = F.col("_slice") == F.col("_r_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(right, cond, "left").drop(*[f"_r_{k}" for k in keys], "_r_slice")


def lag_value(df: DataFrame, keys, order: list[str], value: str, out: str = "previous") -> DataFrame:
    """Value of the previous row of the key in the order."""
    keys = _keys(keys)
    t = ranged(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    tails = t.groupBy(*keys, "_slice").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_tail"))
    heads = tails.withColumn("_before", F.lag(F.col(f"_tail.{value}")).over(
        Window.partitionBy(*keys).orderBy("_slice"))).drop("_tail")
    t = t.withColumns({"_rn": F.row_number().over(inside), "_in": F.lag(value).over(inside)})
    return (_join_slices(t, heads, keys)
            .withColumn(out, F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_in")))
            .drop("_slice", "_rn", "_in", "_before"))


def carry_forward(df: DataFrame, keys, order: list[str], value: str, out: str) -> DataFrame:
    """Last non-null ``value`` of the key up to and including the row."""
    keys = _keys(keys)
    t = ranged(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    tails = t.groupBy(*keys, "_slice").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.withColumn("_before", F.last("_tail", ignorenulls=True).over(before)).drop("_tail")
    t = t.withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    return (_join_slices(t, heads, keys).withColumn(out, F.coalesce("_in", "_before"))
            .drop("_slice", "_in", "_before"))


def running_sum(df: DataFrame, keys, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the key's rows up to and including the row; without keys, over all rows."""
    keys = _keys(keys)
    t = ranged(df, keys, order)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = (t.groupBy(*keys, "_slice").agg(F.sum(value).alias("_s"))
             .withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s"))
    t = t.withColumn("_in", F.sum(value).over(inside))
    return (_join_slices(t, heads, keys).withColumn(out, F.col("_in") + F.col("_before"))
            .drop("_slice", "_in", "_before"))


def trailing_count(df: DataFrame, keys, ts: str, seconds: int, out: str) -> DataFrame:
    """Rows of the key in the ``seconds`` whole seconds ending with the row's own second, whatever the length.

    Seconds are counted first, so a burst is one row per second. The count is the running total at the second less
    the running total ``seconds`` earlier; both are points of one running sum."""
    keys = _keys(keys)
    t = df.withColumn("_sec", F.floor(micros(ts) / F.lit(1_000_000)))
    point = lambda at, kind, n, sign: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), n.alias("_n"),
                                               F.lit(sign).alias("_sign"))
    points = t.groupBy(*keys, "_sec").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_sec", F.inline(F.array(
        point(F.col("_sec"), 0, F.col("_n"), 1), point(F.col("_sec") - seconds, 1, F.lit(0).cast("bigint"), -1))))
    totals = running_sum(points, keys, ["_at", "_kind"], "_n", "_total")
    counts = totals.groupBy(*keys, F.col("_sec").alias("_slice")).agg(F.sum(F.col("_sign") * F.col("_total")).alias(out))
    return _join_slices(t.withColumnRenamed("_sec", "_slice"), counts, keys).drop("_slice")


def quota_windows(df: DataFrame, key: str, ts: str, pos: str, max_requests: int,
                  window_seconds: float) -> DataFrame:
    """Fixed-window quota per key: a window opens at the first request after the last one ended.

    Window starts form a chain (each start points at the first request at or after its end). The chain
    is followed for all keys at once by pointer doubling, so a key with very many requests costs more
    rounds' width, not a longer single task.
    """
    us = F.lit(int(window_seconds * 1_000_000))
    base = df.select(key, ts, pos, micros(ts).alias("_us"))
    asked = base.select(key, pos, F.col("_us"), F.lit(1).alias("_kind"))
    ends = base.select(key, pos, (F.col("_us") + us).alias("_us"), F.lit(0).alias("_kind"))
    ranked = cut(running_sum(asked.unionByName(ends), key, ["_us", "_kind", pos], "_kind", "_c"))
    idx = ranked.where("_kind = 1").select(key, pos, "_us", F.col("_c").alias("idx"))
    nxt = ranked.where("_kind = 0").select(key, pos, (F.col("_c") + 1).alias("nxt"))
    rows = cut(idx.join(nxt, [key, pos]))
    jump = rows.select(key, F.col("idx").alias("i"), F.col("nxt").alias("j"))
    exists = rows.select(key, F.col("idx").alias("i"))
    starts = rows.where("idx = 1").select(key, F.col("idx").alias("i"))
    found = starts.count()
    while True:
        # every start known so far jumps once; the jump then doubles its reach
        reached = starts.join(jump, [key, "i"]).select(key, F.col("j").alias("i"))
        reached = reached.join(exists, [key, "i"], "left_semi")
        starts = cut(starts.unionByName(reached).distinct())
        now = starts.count()
        if now == found:
            break
        found = now
        far = jump.select(key, F.col("i").alias("j"), F.col("j").alias("k"))
        jump = cut(jump.join(far, [key, "j"]).select(key, "i", F.col("k").alias("j")))
    marks = starts.select(key, F.col("i").alias("idx"), F.lit(True).alias("_start"))
    t = rows.join(marks, [key, "idx"], "left").withColumn(
        "_w", F.when(F.col("_start"), F.struct("idx", "_us")))
    t = carry_forward(t, key, ["idx"], "_w", "_win")
    count = F.col("idx") - F.col("_win.idx") + 1
    reset = F.ceil((F.col("_win._us") + us - F.col("_us")) / F.lit(1_000_000)).cast("bigint")
    allowed = count <= max_requests
    return t.select(
        key, pos, allowed.alias("allowed"), F.greatest(F.lit(max_requests) - count, F.lit(0)).alias("remaining"),
        F.greatest(reset, F.lit(0)).alias("reset_seconds"),
        F.when(allowed, F.lit(0)).otherwise(F.greatest(reset, F.lit(0))).cast("bigint").alias("retry_after_seconds"))
