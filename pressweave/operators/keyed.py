"""Keyed joins and writes: anti joins, upserts, value-list updates, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def drop_known(df: DataFrame, known: DataFrame, key: str, within_batch: bool = False,
               order: list[Column] | None = None) -> DataFrame:
    """Rows whose key is not in ``known``; optionally one row per key inside the batch as well."""
    out = df.join(known.select(key), key, "left_anti")
    if within_batch:
        return first_per_key(out, [key], order or [F.lit(0)])
    return out


def first_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*_keys(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_ignore(base: DataFrame, new: DataFrame, keys, order: list[Column]) -> DataFrame:
    """Existing rows win; inside the batch the first row per key wins."""
    keys = _keys(keys)
    fresh = first_per_key(new, keys, order)
    return base.unionByName(fresh.join(base.select(*keys), _null_safe(fresh, base, keys), "left_anti"))


def upsert(base: DataFrame, changes: DataFrame, keys) -> DataFrame:
    """Rows of ``changes`` replace rows of ``base`` with the same key; null keys equal each other."""
    keys = _keys(keys)
    kept = base.join(changes.select(*keys), _null_safe(base, changes, keys), "left_anti")
    return kept.unionByName(changes)


def update_from(base: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Overwrite columns of ``base`` with the non-null values given for its key."""
    cols = [c for c in values.columns if c != key]
    fresh = values.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = base.join(fresh, key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return out.select(*base.columns)


def lookup_ids(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Every asked id with its row; ``found`` is false for ids without one."""
    return ids.join(table.withColumn("_f", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_f", F.lit(False))).drop("_f")


def lookup_summary(looked_up: DataFrame) -> DataFrame:
    return looked_up.agg(F.count(F.lit(1)).alias("requested"), F.count_if(~F.col("found")).alias("missing"))


def drop_empty(stories: DataFrame, articles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Stories without those candidates that no article points at any more."""
    used = articles.where("story_id is not null").select(F.col("story_id").alias("id"))
    empty = candidates.select("id").join(used, "id", "left_anti")
    return stories.join(empty, "id", "left_anti")
