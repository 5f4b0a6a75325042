"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown on text statistics of labelled documents; every path from a root is a conjunctive rule.
A logistic model with lasso weights over all rules keeps a few, and those are compiled into one Spark column
expression that scores any table of statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .cascade import Rows, count_bytes
from .common import hash_sample, map_slices, pick

PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
WIDE = np.zeros(256, dtype=bool)
WIDE[0xC0:] = True

#: Statistics of a text; all are 0 for an empty one.
STATISTICS = ("words", "word_length", "symbols", "punctuation", "capitals", "digits", "wide", "line_words", "line_copies",
              "repeats", "top_word", "different")


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    rows = Rows(texts)
    ids, n = rows.words()
    base = int(ids.max()) + 1 if len(ids) else 1
    key = np.unique(np.repeat(np.arange(len(n)), n) * base + ids)
    words, chars = np.maximum(n, 1), np.maximum(rows["word_chars"], 1)
    lines = np.maximum(rows["n_lines"], 1)
    return {
        "words": np.log1p(n), "word_length": rows["word_chars"] / words, "symbols": rows["n_symbols"] / words,
        "punctuation": count_bytes(rows, PUNCTUATION) / words, "capitals": rows["n_upper"] / np.maximum(rows["n_ascii_letters"], 1),
        "digits": count_bytes(rows, DIGIT) / chars, "wide": count_bytes(rows, WIDE) / chars, "line_words": np.log1p(n / lines),
        "line_copies": rows["n_dup_lines"] / lines, "repeats": rows["n_repeat_words"] / words,
        "top_word": rows["n_top_word"] / words, "different": np.bincount(key // base, minlength=len(n)) / words}


def text_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, *STATISTICS)`` of every whole text; null counts as empty."""
    def body(part, texts):
        return {"doc_id": part.column("doc_id"), **{k: pa.array(v, type=pa.float64()) for k, v in statistics(texts).items()}}
    return map_slices(pick(docs, doc_id, text), body, "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class PathRule:
    """A conjunction of ``(statistic, is it at most, threshold)``."""
    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, of=F.col) -> Column:
        out = F.lit(True)
        for name, at_most, threshold in self.conditions:
            out = out & (of(name) <= F.lit(threshold) if at_most else of(name) > F.lit(threshold))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[PathRule, float], ...]

    def score(self, of=F.col) -> Column:
        """Chance of label 1 as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(of), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def paths(trees) -> list[PathRule]:
    """Every node below a root as the conjunction of the conditions that lead to it, without repeats."""
    found: dict[PathRule, None] = {}

    def walk(node, conditions):
        if conditions:
            found.setdefault(PathRule(conditions))
        if node.subtreeDepth() > 0:
            split = node.split()
            name, threshold = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*conditions, (name, True, threshold)))
            walk(node.rightChild(), (*conditions, (name, False, threshold)))

    for tree in trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def learn(statistics: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", max_rows: int = 20_000,
          trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on about ``max_rows`` labelled rows, picked by a hash of the key.

    Rows with a null key or label are left out. With labels of one kind only, or none, the model is a constant."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labels.select(F.col(doc_id).cast("bigint").alias("k"), F.col(label).cast("double").alias("label")).where(
        "k IS NOT NULL AND label IS NOT NULL")
    known = hash_sample(known, "k", max_rows, known.count(), seed)
    # written by as many tasks as scan the statistics; only what is written, the bounded sample, is read by two
    train = cut(statistics.join(known, statistics["doc_id"] == known["k"]).select("label", *STATISTICS)).coalesce(2)
    kinds = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    if len(kinds) < 2:
        share = 0.5 if not kinds else min(max(next(iter(kinds)), 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), ())
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, seed=seed).fit(
        VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train))
    rules = paths(forest.trees)
    names = [f"r{i}" for i in range(len(rules))]
    binary = train.select("label", *(r.column().cast("double").alias(n) for r, n in zip(rules, names)))
    fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, maxIter=60).fit(
        VectorAssembler(inputCols=names, outputCol="features").transform(binary).select("label", "features"))
    weights = fit.coefficients.toArray()
    return RuleModel(float(fit.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0.0))


def classify(statistics: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)``; repeated rows stay, an empty table gives none."""
    scored = statistics.select("doc_id", model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns under neutral names plus the statistics, written once, so that a model can
    be fitted and applied without joining texts."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    frame = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)), F.col(f"`{text}`").cast("string").alias("_text"))
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]

    def body(part, texts):
        return {**{n: part.column(n) for n in names}, **{k: pa.array(v, type=pa.float64()) for k, v in statistics(texts).items()}}
    return map_slices(frame, body, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", " + ", ".join(f"{s} double" for s in STATISTICS), text="_text")


def reject_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", doc_id: str = "doc_id",
                       text: str = "text", **fit) -> DataFrame:
    """``docs`` without those whose chance of label 1 is below ``threshold``; all columns and repeated rows of the rest stay."""
    wide = cut(with_statistics(docs, text))
    key = f"_c{docs.columns.index(doc_id)}"
    model = learn(wide.select(F.col(key).cast("bigint").alias("doc_id"), *STATISTICS), labels, label, doc_id, **fit)
    return wide.where(model.score() >= threshold).select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))
