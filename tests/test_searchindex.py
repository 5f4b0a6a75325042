"""The stored index: refreshes, removals, merges, a refresh that died, and what reaches the files."""

import tempfile

import pytest
from pyspark.sql import functions as F

from pressweave.plans.search import build_index, matching_articles
from pressweave.plans.searchindex import StoredIndex

SCHEMA = "id bigint, title string, body string"
FIRST = [(1, "Red fox", "the fox runs, the fox sleeps"), (2, "Blue sea", "ships at sea"), (3, None, None), (4, "Fox", "")]


@pytest.fixture
def index(spark):
    return StoredIndex(spark, tempfile.mkdtemp(prefix="index-")).create(spark.createDataFrame(FIRST, SCHEMA))


def rows(df):
    return sorted(tuple(r) for r in df.select("term", "article_id", "field", "tf").collect())


def built(spark, articles):
    return rows(build_index(spark.createDataFrame(articles, SCHEMA), positions=False))


def test_refreshed_equals_rebuilt(spark, index):
    assert rows(index.postings()) == built(spark, FIRST)
    index.refresh(spark.createDataFrame([(2, "Green sea", "fox at sea"), (5, "Owl", "fox")], SCHEMA),
                  spark.createDataFrame([(1,), (99,)], "id bigint"))
    now = [FIRST[2], FIRST[3], (2, "Green sea", "fox at sea"), (5, "Owl", "fox")]
    assert rows(index.postings()) == built(spark, now)
    index.refresh(spark.createDataFrame([(1, "Red fox", "back")], SCHEMA), spark.createDataFrame([(5,)], "id bigint"))
    now = now[:3] + [(1, "Red fox", "back")]
    assert rows(index.postings()) == built(spark, now)
    assert {r["article_id"] for r in matching_articles(index.postings(["fox"]), ["fox"]).collect()} == {1, 2, 4}
    index.merge()
    assert index.version() == (3, [3]) and rows(index.postings()) == built(spark, now)


def test_an_article_changed_and_removed_is_changed(spark, index):
    index.refresh(spark.createDataFrame([(1, "New", "")], SCHEMA), spark.createDataFrame([(1,)], "id bigint"))
    assert rows(index.postings(["new", "red"])) == [("new", 1, "title", 1)]


def test_a_refresh_that_died_leaves_the_index_as_it_was(spark, index, monkeypatch):
    changed = spark.createDataFrame([(1, "Grey wolf", "")], SCHEMA)
    monkeypatch.setattr(index, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.refresh(changed)
    assert rows(index.postings()) == built(spark, FIRST)
    monkeypatch.undo()
    index.refresh(changed)
    assert rows(index.postings()) == built(spark, [(1, "Grey wolf", ""), *FIRST[1:]])


def test_many_refreshes_are_merged(spark, index):
    for n in range(3):
        index.refresh(spark.createDataFrame([(10 + n, f"word{n}", "")], SCHEMA), max_segments=3)
    assert len(index.version()[1]) == 1
    assert rows(index.postings()) == built(spark, FIRST + [(10 + n, f"word{n}", "") for n in range(3)])


def test_words_filter_the_scan(spark, index):
    plan = index.postings(["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,fox)" in plan or "In(term, [fox])" in plan


def test_empty(spark):
    index = StoredIndex(spark, tempfile.mkdtemp(prefix="index-")).create(spark.createDataFrame([], SCHEMA))
    assert index.postings().isEmpty() and index.postings([]).isEmpty()
    index.refresh(spark.createDataFrame(FIRST, SCHEMA))
    assert index.postings().where(F.col("term") == "sea").count() == 2
