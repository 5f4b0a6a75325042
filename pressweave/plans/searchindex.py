"""A search index that is written once and kept up to date.

    path/postings/seq=N   postings sorted by (term, article)
    path/gone/seq=N       articles whose postings in earlier segments no longer count
    path/live/v=N         the segments that count as of version N; written last

A refresh writes one more segment and never touches an earlier one. Its version row comes last, so a refresh that dies
half way leaves the index as it was, and running it again overwrites what it left. Folders of segments that no version
in use names may be deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .search import build_index, write_index

POSTINGS = "term string, article_id bigint, field string, tf bigint, seq bigint"
GONE = "article_id bigint, seq bigint"
#: More live segments than this are merged by the next refresh.
MAX_SEGMENTS = 8


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)

    def version(self) -> tuple[int, list[int]]:
        """``(version, its live segments)``: one row per refresh is read."""
        last = self._read("live", "seqs array<bigint>, v bigint").agg(F.max(F.struct("v", "seqs")).alias("m")).first()["m"]
        return last["v"], list(last["seqs"])

    def _commit(self, version: int, seqs: list[int]) -> None:
        self.spark.createDataFrame([(seqs,)], "seqs array<bigint>").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/live/v={version}")

    def _built(self, articles: DataFrame) -> DataFrame:
        """Their postings, written as they come: the range borders are sampled from these, not from texts split once more."""
        return cut(build_index(articles, positions=False))

    def _write(self, postings: DataFrame, gone: DataFrame, version: int) -> None:
        gone.write.mode("overwrite").parquet(f"{self.path}/gone/seq={version}")
        write_index(postings.select("term", "article_id", "field", "tf"), f"{self.path}/postings/seq={version}")

    def create(self, articles: DataFrame) -> "StoredIndex":
        """The first segment, of all ``(id, title, body)``. Null texts have no words; an empty table gives an empty index."""
        self._write(self._built(articles), self.spark.createDataFrame([], "article_id bigint"), 0)
        self._commit(0, [0])
        return self

    def refresh(self, changed: DataFrame, removed: DataFrame | None = None, max_segments: int = MAX_SEGMENTS) -> None:
        """New postings of the changed or new articles ``(id, title, body)``; earlier ones of these and of ``removed``
        ``(id)`` go. An article in both is a changed one."""
        version, seqs = self.version()
        ids = changed.select("id") if removed is None else changed.select("id").unionByName(removed.select("id"))
        self._write(self._built(changed),
                    ids.distinct().select(F.col("id").cast("bigint").alias("article_id")), version + 1)
        self._commit(version + 1, seqs + [version + 1])
        if len(seqs) + 1 > max_segments:
            self.merge()

    def merge(self) -> None:
        """All live postings into one segment; readers of an earlier version are not disturbed."""
        version, _ = self.version()
        self._write(self.postings(), self.spark.createDataFrame([], "article_id bigint"), version + 1)
        self._commit(version + 1, [version + 1])

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """Live postings ``(term, article_id, field, tf)``, of the given words only if any are named.

        The word filter reaches the files, which are sorted by term; postings that remain are checked against the
        latest refresh that replaced their article."""
        _, seqs = self.version()
        found = self._read("postings", POSTINGS).where(F.col("seq").isin(seqs))
        if words is not None:
            found = found.where(F.col("term").isin(words)) if words else found.limit(0)
        if len(seqs) > 1:
            gone = (self._read("gone", GONE).where(F.col("seq").isin(seqs)).groupBy(F.col("article_id").alias("_id"))
                    .agg(F.max("seq").alias("_gone")))
            found = found.join(gone, (F.col("article_id") == F.col("_id")) & (F.col("seq") < F.col("_gone")), "left_anti")
        return found.drop("seq")
