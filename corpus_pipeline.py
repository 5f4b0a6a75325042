"""From raw documents to token ids: the stages in order, each reading what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressweave.llm import decontam, linededup, neardup, ruleensemble, wordbpe
from pressweave.llm.catalog import vocabulary
from pressweave.llm.common import load
from pressweave.session import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores below 0.3 go."""
    return ruleensemble.reject_low_quality(docs, load(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated passages are cut out, all their whole lines; a document of which nothing is left goes."""
    return linededup.dedup_lines(docs, n_chars="n_chars", drop_emptied=True, whole=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontam.clean_documents(docs, load(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    return wordbpe.round_trip(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("bpe", bpe)]

#: Trees, lasso weights and merge rounds are not for SQL; tests compare the stages with plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
