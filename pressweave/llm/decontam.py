"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are runs of ``size`` consecutive words (a shorter item is one window). A window's tokens are its
shingles of three words; all of them are necessary, so the rarest one, by its count over all documents, is a
sufficient prefix. Documents are read once for the places of item shingles; prefix matches that pass the position
and length bounds are then compared word by word with the window.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

SHINGLE = 3
#: Up to so many shingle hashes (16 bytes each in a broadcast table) are sent to all executors; more are shuffled.
BROADCAST_KEYS = 1_000_000
_KEY = ["_d", "_t"]


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Words of a text in order, as they stand there; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def item_windows(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """``(item_id, n, window)`` of every different window (an array of folded words) of every item."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item_id"),
                     words(folded(F.col(text).cast("string"))).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(size)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i")
    return w.select("item_id", "n", "w", at).select("item_id", "n", F.slice("w", F.col("i"), F.col("n")).alias("window")).distinct()


def hash_of(k: int, *parts: Column) -> Column:
    """Shingle hash. Full lower-casing may only equate more than the folding does, so no match is lost."""
    return F.xxhash64(F.lit(k), *(F.lower(p) for p in parts))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every document.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. ``n_hit`` counts the words inside
    occurring windows, ``n_items`` the items they belong to. A null or empty text has no words and no hits; an item
    without words has no window. Repeated documents are answered one by one; items with the same text all count."""
    base = docs.select(F.col(doc_id).alias("_d"), F.xxhash64(F.col(text).cast("string")).alias("_t"), F.col(text).cast("string").alias("_x"))
    windows = cut(item_windows(items, size, item_id, item_text))
    lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    plain_windows = windows.select("n", "window").distinct()
    shingles = None
    for k in lengths:
        some = plain_windows.where(F.least("n", F.lit(SHINGLE)) == k)
        rows = some.select("n", "window", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("o")).select(
            "n", "window", "o", F.slice("window", F.col("o") + 1, k).alias("s"))
        rows = rows.select("n", "window", "o", "s", hash_of(k, *(F.col("s")[j] for j in range(k))).alias("h"))
        shingles = rows if shingles is None else shingles.union(rows)
    counted = base.select("_d", "_t", F.size(words(F.col("_x"))).cast("bigint").alias("n_words"))
    empty = F.sha2(F.lit(""), 256)
    if shingles is None:  # no item has a word
        return counted.select(F.col("_d").alias("doc_id"), "n_words", F.lit(0).cast("bigint").alias("n_hit"),
                              F.lit(0).cast("bigint").alias("n_items"), empty.alias("items_sha256"), F.lit(False).alias("contaminated"))
    shingles = cut(shingles)
    keys = shingles.select("h").distinct()
    n_keys = keys.count()

    # places of item shingles in documents, with the words themselves
    w = base.select("_d", "_t", words(F.col("_x")).alias("w"))
    parts = [F.slice("w", F.lit(j + 1), F.greatest(F.size("w") - j, F.lit(0))) for j in range(SHINGLE)]
    places = w.select("_d", "_t", F.size("w").alias("n_words"), F.posexplode(F.arrays_zip(
        *(p.alias(f"w{j}") for j, p in enumerate(parts))))).select("_d", "_t", "n_words", "pos", *(
            F.col("col").getField(f"w{j}").alias(f"w{j}") for j in range(SHINGLE)))
    cols = [F.col(f"w{j}") for j in range(SHINGLE)]
    coded = [F.when(cols[k - 1].isNotNull(), hash_of(k, *cols[:k])) for k in lengths]
    if len(coded) == 1:
        places = places.withColumn("h", coded[0])
    else:
        places = places.withColumn("h", F.explode(F.array_compact(F.array(*coded))))
    found = cut(places.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, "h", "left_semi"))

    # the rarest shingle of every window; a window with a shingle that no document has can't occur
    rarity = found.groupBy("h").count()
    prefix = shingles.join(rarity, "h", "left").groupBy("n", "window").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "o", "h")).alias("p")).where("p.count > 0")
    prefix = prefix.select("n", "window", F.col("p.o").alias("o"), F.col("p.h").alias("h"))
    start = F.col("pos") - F.col("o")
    maybe = found.select(*_KEY, "n_words", "pos", "h").join(prefix, "h").where(
        (start >= 0) & (start + F.col("n") <= F.col("n_words"))).select(*_KEY, start.alias("start"), "n", "window")

    # every shingle of the window must stand at its place, word by word
    k = F.least("n", F.lit(SHINGLE))
    needed = maybe.distinct().select("*", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("o")).select(
        *_KEY, "start", "n", "window", (F.col("start") + F.col("o")).alias("pos"), F.slice("window", F.col("o") + 1, k).alias("s"))
    there = found.select(*_KEY, "pos", F.transform(F.array(*cols), folded).alias("own"))
    same = needed.join(there, [needed["_d"].eqNullSafe(there["_d"]), needed["_t"] == there["_t"], needed["pos"] == there["pos"],
                               F.col("s") == F.slice("own", F.lit(1), F.size("s"))])
    hits = cut(same.groupBy(needed["_d"], needed["_t"], "start", "n", "window").agg(F.count_distinct(needed["pos"]).alias("count")).where(
        F.col("count") == F.col("n") - k + 1).select("_d", "_t", "start", "n", "window"))

    before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy(*_KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    reach = hits.groupBy(*_KEY, "start").agg(F.max("n").alias("n")).withColumn("before", before)
    covered = reach.groupBy(*_KEY).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(
        F.col("start"), F.coalesce("before", F.lit(0))))).cast("bigint").alias("n_hit"))
    ids = hits.select(*_KEY, "window").distinct().join(windows.select("item_id", "window"), "window").groupBy(*_KEY).agg(
        F.sort_array(F.collect_set("item_id")).alias("ids"))
    result = counted
    for side in (covered, ids):
        side = side.select(F.col("_d").alias("_d2"), F.col("_t").alias("_t2"), *[c for c in side.columns if c not in _KEY])
        result = result.join(side, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_t") == F.col("_t2")), "left").drop("_d2", "_t2")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return result.select(F.col("_d").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
                         F.coalesce(F.size("ids"), F.lit(0)).cast("bigint").alias("n_items"),
                         F.coalesce(F.sha2(F.array_join("ids", ","), 256), empty).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; all columns and repeated rows of the others stay."""
    bad = contamination(docs, items, size, doc_id, text, **names).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["_bad"]), "left_anti")
