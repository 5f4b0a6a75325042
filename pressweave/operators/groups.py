"""Per-group top-k, topic and entity operators.

Nothing here gathers an unbounded group: groups are reduced by partial
aggregation or by ``row_number() <= k`` (which Spark prunes before the shuffle)
and only then turned into arrays.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, strip


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def cap_per_group(df: DataFrame, keys, order: list[Column], n: int | None) -> DataFrame:
    """First ``n`` rows of each group; no cap when ``n`` is null or not positive."""
    if not n or n <= 0:
        return df
    w = Window.partitionBy(*_keys(keys)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def top_topics(df: DataFrame, keys, topics: str = "topics", order: str = "id", n: int = 3) -> DataFrame:
    """The ``n`` most frequent topics per group; ties go to the topic seen first."""
    keys = _keys(keys)
    seen = (df.select(*keys, F.col(order).alias("_o"), F.posexplode(topics).alias("_p", "topic"))
            .groupBy(*keys, "topic")
            .agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_o", "_p")).alias("_first")))
    w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_first")
    ranked = seen.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return (ranked.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_rn", "topic"))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: x["topic"]).alias("topics")))


#: Characters of a form's anchor: its first ones, looked up among all windows of that length in other forms.
ANCHOR = 8


def _windows(c: Column) -> Column:
    """All distinct runs of up to ``ANCHOR`` characters."""
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(ANCHOR))), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: c.substr(i, k)))))


def contained_forms(forms: DataFrame, keys, how: str = "left_semi") -> DataFrame:
    """Forms ``(keys, _l)`` that are part of a longer one in their group; ``how='inner'`` names that one in ``_in``.

    A form is looked up by its first characters among the windows of the group's forms, then compared: windows
    grow with the length of a form, not with its square. They are many times the forms whose size Catalyst knows, so the
    join is one by sorting: a broadcast of them would pass through the driver."""
    keys = _keys(keys)
    inner = forms.select(*keys, "_l", F.left("_l", F.lit(ANCHOR)).alias("_a"))
    outer = forms.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_l").alias("_in"), F.explode(_windows(F.col("_l"))).alias("_w"))
    cond = (F.col("_a") == F.col("_w")) & (F.length("_l") < F.length("_in")) & F.contains("_in", "_l")
    for i, k in enumerate(keys):
        cond = cond & (inner[k] == F.col(f"_k{i}"))
    return inner.join(outer.hint("merge"), cond, how).select(*keys, "_l", *(["_in"] if how == "inner" else []))


def entity_forms(df: DataFrame, keys, entities: str = "entities", order: str = "id") -> DataFrame:
    """``(keys, _l, _first)``: lower-cased forms and where they are seen first (``_o`` row, ``_p`` position, ``_e`` spelling)."""
    keys = _keys(keys)
    return (df.select(*keys, F.col(order).alias("_o"), F.posexplode(entities).alias("_p", "_e"))
            .withColumn("_l", strip(F.lower("_e"))).where("_l <> ''")
            .groupBy(*keys, "_l")
            .agg(F.min(F.struct("_o", "_p", "_e")).alias("_first")))


def merge_entities(df: DataFrame, keys, entities: str = "entities", order: str = "id",
                   limit: int = 15) -> DataFrame:
    """Case-insensitive distinct entities in first-seen order, without any form that is part of a
    longer one in the same group."""
    keys = _keys(keys)
    forms = entity_forms(df, keys, entities, order)
    kept = forms.join(contained_forms(forms, keys), [*keys, "_l"], "left_anti")
    w = Window.partitionBy(*keys).orderBy("_first")
    return (kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "_first"))).alias("_l"))
            .select(*keys, F.transform("_l", lambda x: x["_first"]["_e"]).alias("entities")))


def centroid(df: DataFrame, keys, vec: str = "embedding", order: str = "id") -> DataFrame:
    """Mean vector ``centroid`` and row count ``n`` per group; vectors whose length differs from the first
    one's are skipped.

    Vectors are summed where they lie (one buffer per group and map task), so a hot group moves one partial
    sum per task."""
    keys = _keys(keys)
    valid = df.where(F.size(vec) > 0).withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    per = valid.groupBy(*keys, F.size(vec).alias("_d")).agg(
        Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = per.select(*keys, "_first", F.struct(vector_to_array("_m").alias("centroid"), "n").alias("_c"))
    return best.groupBy(*keys).agg(F.min_by("_c", "_first").alias("_c")).select(*keys, "_c.*")


def merge_centroids(a, na, b, nb) -> Column:
    """Weighted mean of two vectors: empty sides give way, mismatched lengths give an empty vector."""
    a, b, na, nb = col(a), col(b), col(na).cast("double"), col(nb).cast("double")
    empty = F.array().cast("array<double>")
    return (F.when(F.size(a) == 0, b).when(F.size(b) == 0, a)
            .when((F.size(a) != F.size(b)) | (na + nb <= 0), empty)
            .otherwise(F.zip_with(a, b, lambda x, y: (x * na + y * nb) / (na + nb))))
