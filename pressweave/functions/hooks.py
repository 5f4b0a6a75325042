"""Pluggable model calls: embedder, analyser, judge. All of them are functions over small batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed_texts(df: DataFrame, text: str = "text", fn=None, batch: int = 20, dims: int = 1024,
                out: str = "vec", id_col: str = "id", idf: bool = True) -> DataFrame:
    """Vectors for ``(id, text)``.

    ``fn(list[str]) -> list[list[float]]`` is called on sub-batches of ``batch`` texts inside the tasks, so
    concurrency is the number of partitions. Without ``fn`` a deterministic hashed bag of words, weighted by
    inverse document frequency and normalised, is used; ``idf=False`` leaves the weights out, so that
    vectors of different batches stay comparable."""
    if fn is None:
        from pyspark.ml.feature import IDF, HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array
        words = df.select(id_col, F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "").alias("_w"))
        tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words)
        weighted = IDF(inputCol="_tf", outputCol="_x").fit(tf).transform(tf) if idf else tf.withColumn("_x", F.col("_tf"))
        unit = Normalizer(inputCol="_x", outputCol="_u").transform(weighted)
        return unit.select(id_col, vector_to_array("_u").alias(out))

    def run(frames):
        for f in frames:
            vectors = []
            texts = f[text].tolist()
            for i in range(0, len(texts), batch):
                vectors += fn(texts[i:i + batch])
            yield pd.DataFrame({id_col: f[id_col], out: vectors})

    return df.select(id_col, text).mapInPandas(run, f"{id_col} bigint, {out} array<double>")


def analyze(df: DataFrame, fn=None, responses: DataFrame | None = None, min_chars: int = 50) -> DataFrame:
    """Raw model answers for ``(id, title, lead, body)``: from ``fn(title, lead, body)`` or a table
    ``(id, answer)``. Articles with less than ``min_chars`` of text are not sent and get no answer."""
    enough = F.length(F.coalesce("body", F.lit(""))) + F.length(F.coalesce("lead", F.lit(""))) >= min_chars
    t = df.withColumn("_send", enough)
    if responses is not None:
        r = responses.select("id", F.col("answer").alias("_a"))
        return t.join(r, "id", "left").withColumn("answer", F.when(F.col("_send"), F.col("_a"))).drop("_a", "_send")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "answer": [
                fn(a, b, c) if s else None for a, b, c, s in zip(f["title"], f["lead"], f["body"], f["_send"])]})

    answers = t.select("id", "title", "lead", "body", "_send").mapInPandas(run, "id bigint, answer string")
    return df.join(answers, "id", "left")


def judge(listings: DataFrame, fn) -> DataFrame:
    """Answers of a coherence judge ``fn(listing, old_title)`` for ``(cluster[, part], listing, old_title)``."""
    keys = [c for c in ("cluster", "part") if c in listings.columns]

    def run(frames):
        for f in frames:
            yield pd.DataFrame({**{k: f[k] for k in keys}, "answer": [fn(a, b) for a, b in zip(f["listing"], f["old_title"])]})
    schema = ", ".join(f"{k} {listings.schema[k].dataType.simpleString()}" for k in keys)
    return listings.select(*keys, "listing", "old_title").mapInPandas(run, f"{schema}, answer string")


def cluster_listing(members: DataFrame, max_size: int = 24) -> DataFrame:
    """Numbered lists ``n. [title] summary`` of every cluster, with the ids in the same order.

    ``(cluster, part, listing, article_ids)``: a cluster above ``max_size`` members comes in several parts, each numbered from 1,
    so that no row grows with the cluster. Parts are runs of ids (see :func:`pressweave.operators.density.id_runs`)."""
    from ..operators.density import id_runs

    rows = id_runs(members.select(F.col("cluster").alias("label"), "id", "title", "summary"), max_size).select(
        F.col("label").alias("cluster"), F.col("run").cast("int").alias("part"), "id", "title", "summary")
    line = F.struct("id", "title", F.coalesce("summary", "title").alias("s"))
    g = rows.groupBy("cluster", "part").agg(F.array_sort(F.collect_list(line)).alias("l"))
    text = F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["title"], F.lit("] "), x["s"]))
    return g.select("cluster", "part", F.array_join(text, "\n").alias("listing"),
                    F.transform("l", lambda x: x["id"]).alias("article_ids"))


def reduce_dims(df: DataFrame, k: int = 22, vec: str = "vec") -> DataFrame:
    """Principal components of the vectors; only worth while before clustering many long vectors."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    t = df.withColumn("_v", array_to_vector(F.col(vec)))
    return PCA(k=k, inputCol="_v", outputCol="_r").fit(t).transform(t).withColumn(vec, vector_to_array("_r")).drop("_v", "_r")
