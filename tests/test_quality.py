"""Verdicts, guarded splits and reconciliation plans on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pressweave.operators.matching import reconcile
from pressweave.plans import quality as ql

T0 = dt.datetime(2024, 1, 1)
CACHE = ("fingerprint string, article_ids array<bigint>, coherent boolean, title string, summary string, "
         "groups array<array<bigint>>, created_at timestamp_ntz")


def cache_of(spark, rows):
    return spark.createDataFrame([(",".join(map(str, sorted(i))), sorted(i), c, t, None, g, T0 + dt.timedelta(days=d))
                                  for i, c, t, g, d in rows], CACHE)


def articles_of(spark, ids, text="alpha beta gamma delta"):
    rows = [(i, f"{text} {i}", f"sum {i}", None, None, "event", ["Ent", "Org"]) for i in ids]
    return spark.createDataFrame(rows, "id bigint, title string, summary string, main_event string, "
                                       "story_identity string, article_type string, entities array<string>")


def groups_of(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["cluster"], set()).add(r["id"])
    return sorted(map(tuple, map(sorted, out.values())))


def test_verdicts_split_and_title(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (10, 10), (10, 11), (20, 20)], "cluster bigint, id bigint")
    cache = cache_of(spark, [
        ([1, 2, 3], False, None, [[1, 2], [3]], 1),        # shares 1,2,3 with the first cluster
        ([1, 3], False, None, [[1], [3]], 0),              # older verdict, ignored
        ([10, 11], True, "Kept title", None, 0),
        ([1, 2], True, "Pair title", None, 0)])
    now, titles = ql.apply_verdicts(members, articles_of(spark, [1, 2, 3, 4, 10, 11, 20]), cache)
    assert groups_of(now) == [(1, 2), (3,), (4,), (10, 11), (20,)]
    got = {r["cluster"]: (r["title"], r["reused"]) for r in titles.collect()}
    assert got[10] == ("Kept title", True) and got[1] == ("Pair title", True)
    assert got[20] == ("alpha beta gamma delta 20", False)


def test_stored_split_applies(spark):
    members = spark.createDataFrame([(1, 1), (1, 2)], "cluster bigint, id bigint")
    now, _ = ql.apply_verdicts(members, articles_of(spark, [1, 2]), cache_of(spark, [([1, 2], False, None, [[1], [2]], 0)]))
    assert groups_of(now) == [(1,), (2,)]


def test_prior_split_in_one_group_does_not_block(spark):
    members = spark.createDataFrame([(1, i) for i in (1, 2, 9)], "cluster bigint, id bigint")
    assert ql.prior_splits(members, cache_of(spark, [([1, 2, 3], False, None, [[1, 2], [3]], 0)])).isEmpty()


@pytest.mark.parametrize("kind,entities,expect", [("event", ["Other"], True), ("event", ["Ent"], False)])
def test_guarded_split(spark, kind, entities, expect):
    base = articles_of(spark, [1, 2, 3])
    odd = spark.createDataFrame([(4, "zulu yankee xray whiskey", "s", None, None, kind, entities)], base.schema)
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.05]), (4, [-1.0, 1.0])],
                                 "id bigint, embedding array<double>")
    m = base.unionByName(odd).join(vecs, "id").withColumn("cluster", F.lit(1).cast("bigint"))
    parts = {r["id"]: r["part"] for r in ql.split_outliers(m).collect()}
    assert parts == {1: 0, 2: 0, 3: 0, 4: 4 if expect else 0}


def test_reconciliation_plan(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)], "cluster bigint, id bigint")
    assigned = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, None), (5, None), (6, 8)], "id bigint, story_id bigint")
    matches, moves, cleared, loses = reconcile(members, assigned)
    assert {r["cluster"]: r["story_id"] for r in matches.collect()} == {1: 7, 3: None, 5: None}
    assert {r["id"] for r in moves.collect()} == {3, 4, 5}
    assert {r["id"] for r in cleared.collect()} == {6}
    assert {r["story_id"] for r in loses.collect()} == {7, 8}


# ---- one outlier rule at every size -------------------------------------------------

def words_of(text):
    return {w for w in (text or "").lower().split() if len(w) >= 4}


def plain_suspicious(rows, cluster_vectors):
    """The rule straight from its definition, one outlier after the other."""
    import numpy as np

    v = np.array([cluster_vectors[r["id"]] for r in rows])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    mean = v.mean(axis=0)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    out = []
    for k, r in enumerate(rows):
        if unit[k] @ mean / np.linalg.norm(mean) >= 0.80 and max(sims[k].max(), 0) >= 0.82:
            continue
        rest = [x for x in rows if x["id"] != r["id"]]
        seen = {}
        for x in rest:
            for e in x["entities"] or []:
                if e.strip():
                    seen.setdefault(e.strip().lower(), None)
        names = [e for e in seen if not any(e != o and e in o for o in seen)][:15]
        shared = len({e.strip().lower() for e in r["entities"] or []} & set(names))
        a = words_of(" ".join(filter(None, (r["story_identity"], r["main_event"], r["title"]))))
        b = set().union(*(words_of(x["story_identity"] or x["main_event"] or x["title"]) for x in rest))
        score = len(a & b) / len(a | b) if a and b else 0.0
        soft = r["article_type"] in ("opinion", "background", "reaction", "analysis")
        if (soft and (shared < 1 or score < 0.18)) or (shared == 0 and score < 0.14):
            out.append(r["id"])
    return sorted(out)


def test_outlier_rule_follows_its_definition_above_the_size_limit(spark, n=60):
    import random

    import numpy as np
    rnd, rng = random.Random(n), np.random.default_rng(n)
    words = [f"word{i:02d}" for i in range(40)]
    names = ["Ann", "Ann Lee", "Ann Lee Jones", "Bob", "Bobby", "EU", "EU Council"] + [f"Name {i}" for i in range(30)]
    rows, vecs = [], {}
    for i in range(n):
        odd = i % 4 == 0
        few = words[30:] if odd else words[:12]
        rows.append({"id": i, "title": " ".join(rnd.sample(few, 4)), "summary": "s", "main_event": " ".join(rnd.sample(few, 3)) if i % 3 else None,
                     "story_identity": None if i % 5 else " ".join(rnd.sample(words, 3)), "article_type": rnd.choice(["event", "event", "opinion"]),
                     "entities": None if i % 9 == 8 else rnd.sample(names[:7] if not odd else names, rnd.randrange(0, 5))})
        vecs[i] = (rng.normal(size=4) if odd else np.array([1.0, 0, 0, 0]) + 0.05 * rng.normal(size=4)).tolist()
    df = spark.createDataFrame([(1, r["id"], r["title"], r["summary"], r["main_event"], r["story_identity"], r["article_type"], r["entities"], vecs[r["id"]])
                                for r in rows], "cluster bigint, id bigint, title string, summary string, main_event string, story_identity string, "
                                                "article_type string, entities array<string>, embedding array<double>")
    got = sorted(r["id"] for r in ql.suspicious_outliers(df).collect())
    assert got == plain_suspicious(rows, vecs) and got


def test_large_clusters_are_listed_in_parts(spark):
    from pressweave.functions.hooks import cluster_listing
    m = articles_of(spark, range(60)).withColumn("cluster", F.lit(7).cast("bigint"))
    rows = sorted(cluster_listing(m, 24).collect(), key=lambda r: r["part"])
    assert [len(r["article_ids"]) for r in rows] == [24, 24, 12]
    assert [i for r in rows for i in r["article_ids"]] == list(range(60)) and rows[2]["listing"].startswith("1. [")


# ---- the store of verdicts ----------------------------------------------------------

def test_settled_clusters_and_new_decisions(spark):
    members = spark.createDataFrame([(c, i) for c, ids in ((1, range(1, 9)), (20, (20,)), (30, (30, 31)), (40, (40, 41))) for i in ids],
                                    "cluster bigint, id bigint")
    articles = articles_of(spark, [*range(1, 9), 20, 30, 31, 40, 41])
    articles = articles.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    cache = cache_of(spark, [([30, 31], True, "Kept", None, 0)])

    def judge(listing, old_title):
        n = listing.count("\n") + 1
        if n == 2:
            return "no answer"
        return '{"coherent": true, "title": "Whole"}' if n <= 4 else '{"coherent": false, "groups": [[1, 2, 3, 4], [5, 6, 7]]}'
    now, titles, decisions = ql.settle(members, articles, cache, judge=judge, model="m", now=T0)
    assert groups_of(now) == [(1, 2, 3, 4), (5, 6, 7), (20,), (30, 31), (40, 41)]  # 8 is in no group
    got = {r["cluster"]: (r["title"], r["reused"]) for r in titles.collect()}
    assert got[1] == ("Whole", False) and got[30] == ("Kept", True) and got[40] == ("alpha beta gamma delta 40", False)
    rows = {r["fingerprint"]: (r["coherent"], r["groups"]) for r in decisions.collect()}
    assert rows == {"1,2,3,4,5,6,7,8": (False, [[1, 2, 3, 4], [5, 6, 7]]), "1,2,3,4": (True, None), "5,6,7": (True, None)}
    store = cache.unionByName(decisions.select(*cache.columns))
    again, titles, decisions = ql.settle(now, articles, store, judge=judge, model="m", now=T0)
    assert decisions.isEmpty() and groups_of(again) == groups_of(now)
    assert {r["cluster"] for r in titles.where("reused").collect()} == {1, 5, 30}


def test_an_outlier_keeps_a_title_from_being_reused(spark):
    base = articles_of(spark, [1, 2, 3])
    odd = spark.createDataFrame([(4, "zulu yankee xray whiskey", "s", None, None, "event", ["Other"])], base.schema)
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.05]), (4, [-1.0, 1.0])], "id bigint, embedding array<double>")
    members = spark.createDataFrame([(1, i) for i in (1, 2, 3, 4)], "cluster bigint, id bigint")
    cache = cache_of(spark, [([1, 2, 3, 4], True, "Stored", None, 0)])
    now, titles, decisions = ql.settle(members, base.unionByName(odd).join(vecs, "id"), cache)
    assert groups_of(now) == [(1, 2, 3), (4,)] and titles.where("reused").isEmpty()
    assert [(r["coherent"], r["groups"]) for r in decisions.collect()] == [(False, [[1, 2, 3], [4]])]


def test_earlier_verdicts_keep_clusters_apart(spark):
    from pressweave.operators.merging import merge_clusters, split_marks
    members = spark.createDataFrame([(c, 10 * c + k) for c in range(1, 7) for k in range(2)], "cluster bigint, id bigint")
    splits = cache_of(spark, [([10, 20, 30], False, None, [[10], [20, 30]], 0), ([41, 50], False, None, [[41], [50]], 0)])
    marks = split_marks(members, splits.select("fingerprint", "groups"))
    clusters = spark.createDataFrame([(c, 2, [1.0, 0.0]) for c in range(1, 7)], "cluster bigint, size bigint, centroid array<double>").join(
        marks, "cluster", "left").withColumnRenamed("cluster", "id")
    got = {}
    for r in merge_clusters(clusters, 0.9, 24).collect():
        got.setdefault(r["merged"], set()).add(r["id"])
    merged = list(got.values())
    assert len(merged) == 2 and not any({1, 2} <= g or {1, 3} <= g or {4, 5} <= g for g in merged)
