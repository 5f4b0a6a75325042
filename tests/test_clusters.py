"""Clustering, merging, matching and assignment against plain definitions on small data."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from brute import composite, hdbscan_labels, partition
from pyspark.sql import functions as F

from pressweave.operators import density as dn
from pressweave.operators import merging
from pressweave.operators.components import connected_components
from pressweave.operators.matching import match_stories
from pressweave.operators.merging import merge_clusters
from pressweave.operators.simjoin import knn_join, pair_stats


def points(n, c, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(c, 8))
    v = centres[rng.integers(0, c, n)] + 0.35 * rng.normal(size=(n, 8))
    h = rng.uniform(0, 48, n)
    for i, j in ((3, 2), (5, 4), (6, 4)):  # exact copies
        v[i], h[i] = v[j], h[j]
    return v, h


def frame(spark, v, h):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(v)), "vec": list(map(list, v)), "hours": h}))


@pytest.mark.parametrize("n,c,samples,eps,weight,seed,block,band", [
    (60, 6, 3, 0.0, 0.55, 1, 1024, 50000), (60, 6, 1, 0.10, 0.0, 2, 1024, 50000),
    (90, 5, 2, 0.0, 0.35, 3, 40, 200), (90, 5, 1, 0.15, 0.3, 4, 50, 150)])
def test_density(spark, n, c, samples, eps, weight, seed, block, band):
    v, h = points(n, c, seed)
    got = {r["id"]: r["label"] for r in dn.density_clusters(
        frame(spark, v, h), min_samples=samples, epsilon=eps, time_weight=weight, block=block,
        band_edges=band).collect()}
    assert partition([got[i] for i in range(n)]) == partition(hdbscan_labels(v, h, samples, eps, weight))


def test_density_cut_off_separates_far_times(spark):
    v, h = points(40, 2, 5)
    h[:20], h[20:] = h[:20] / 48, 500 + h[20:] / 48
    got = dn.density_clusters(frame(spark, v, h), min_samples=2, max_dist=0.3, block=16)
    label = {r["id"]: r["label"] for r in got.collect()}
    assert len(label) == 40
    for x in set(label.values()) - {-1}:
        assert len({i < 20 for i, y in label.items() if y == x}) == 1


def test_forest_is_minimal(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    v = centres[rng.integers(0, 6, 240)] + 0.1 * rng.normal(size=(240, 8))
    df = frame(spark, v, np.zeros(240)).select(F.lit("").alias("grp"), "id", F.lit(1).cast("bigint").alias("mult"), "vec", "hours")
    index = dn._indexed(df, 0.0, 12.0, None, 40, pairwise=1)
    cores = dn.cut(dn.core_distances(df, 3, 0.0, 12.0, None, 40, index))
    d = composite(v, np.zeros(240), 0.0, 12.0)
    core = np.sort(d, axis=1)[:, 2]
    got = {r["id"]: r["core"] for r in cores.collect()}
    assert np.allclose([got[i] for i in range(240)], core)
    edges = dn.spanning_forest(index, cores, 0.0, 12.0, None, pairwise=1).toPandas()
    assert len(edges) == 239 and len(connected_components(spark.createDataFrame(edges)).select("component").distinct().collect()) == 1
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    plain = sorted(w for *_, w in dn._prim(reach, np.inf))
    assert np.allclose(sorted(edges["w"]), plain)
    some = np.full((240, 240), np.inf)
    for e in dn.spanning_forest(index, cores, 0.0, 12.0, None, pairwise=1000).collect():
        some[e["a"], e["b"]] = some[e["b"], e["a"]] = e["w"]
    assert np.allclose(sorted(w for *_, w in dn._prim(some, 1e9)), plain)
    compared, every = index.pairs(index, float(np.cos(0.5)))
    assert compared < every / 2


def test_points_all_equally_far_apart(spark):
    n = 600
    v = np.eye(n)
    out = dn.density_clusters(frame(spark, v, np.zeros(n)), min_samples=2, time_weight=0.0, block=128).toPandas()
    assert sorted(out["id"]) == list(range(n)) and out["label"].nunique() == 1


def test_split_keeps_everyone(spark):
    v, h = points(80, 3, 6)
    df = frame(spark, v, h)
    labels = df.select("id", F.lit(0).cast("bigint").alias("label"))
    out = dn.split_oversize(df, labels, 10).toPandas()
    assert sorted(out["id"]) == list(range(80))
    sizes = out[out["label"] >= 0].groupby("label").size()
    assert sizes.max() <= 10


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {r[0]: r[1] for r in connected_components(df).collect()} == want


def greedy(clusters, threshold, cap, marks=()):
    """One pair after the other, most similar first (then by the hash of the pair), as far as sizes and verdicts allow."""
    from pressweave.operators.merging import pair_hash
    marks = dict(marks)
    groups = {i: ([i], n, np.asarray(c, float), set(marks.get(i, ()))) for i, n, c in clusters}
    while True:
        best = None
        for i in groups:
            for j in groups:
                a, b = groups[i], groups[j]
                if i >= j or a[1] + b[1] > cap or any(f == g and x != y for f, x in a[3] for g, y in b[3]):
                    continue
                s = round(float(a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2])), 9)
                rank = (-s, int(pair_hash(np.array([i]), np.array([j]))[0]))
                if s >= threshold and (best is None or rank < best[0]):
                    best = (rank, i, j)
        if best is None:
            return {frozenset(g[0]) for g in groups.values()}
        _, i, j = best
        a, b = groups[i], groups.pop(j)
        groups[i] = (a[0] + b[0], a[1] + b[1], (a[2] * a[1] + b[2] * b[1]) / (a[1] + b[1]), a[3] | b[3])


@pytest.mark.parametrize("seed,block", [(2, 2048), (3, 10)])
def test_merge_matches_sequential(spark, seed, block):
    """Tight sizes, close centroids and blocked pairs."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 5))
    rows = [(i, int(rng.integers(1, 6)), (centres[i % 6] + 0.25 * rng.normal(size=5)).tolist()) for i in range(30)]
    marks = {i: [(int(rng.integers(0, 3)), int(rng.integers(0, 2)))] for i in range(0, 30, 3)}
    df = spark.createDataFrame([(*r, marks.get(r[0])) for r in rows],
                               "id bigint, size bigint, centroid array<double>, marks array<struct<f:bigint,g:int>>")
    got = merge_clusters(df, 0.9, 10, block=block).toPandas()
    assert {frozenset(g["id"]) for _, g in got.groupby("merged")} == greedy(rows, 0.9, 10, marks)


@pytest.mark.parametrize("tail", [0, 40, 50_000])
def test_components_of_any_tail(spark, tail):
    """A path, a star, a circle and loose pairs in mixed order; rounds alone, rounds and a last task, the last task alone."""
    rnd = random.Random(5)
    names = rnd.sample(range(1000), 200)
    edges = [*zip(names[:60], names[1:60]), *((names[60], x) for x in names[61:100]), *zip(names[100:140], [*names[101:140], names[100]]), *zip(names[140::2], names[141::2])]
    rnd.shuffle(edges)
    want = {x: min(g) for g in (names[:60], names[60:100], names[100:140], *zip(names[140::2], names[141::2])) for x in g}
    df = spark.createDataFrame([*edges, edges[0], (names[0], names[0])], "a bigint, b bigint")
    assert {r["node"]: r["component"] for r in connected_components(df, tail=tail).collect()} == want


def test_small_graphs_take_two_tables(spark, monkeypatch):
    from pressweave.operators import components
    made = []
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or merging.cut(df))
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(path, tail=components.TAIL).where("component <> 0").isEmpty() and len(made) == 2
    assert connected_components(path.limit(0), tail=components.TAIL).isEmpty()


def test_merge_blocks_hold_every_pair_once_in_few_copies(spark):
    """A short side against a long one does not copy the long one sixteen times; a table against itself is halved."""
    def side(n):
        return spark.range(n).select("id", F.array(F.col("id") + 1.0).alias("vec"))
    lt, rt = merging.grid(side(40), side(4000), 10)
    assert rt.count() == 4000 * 2 and lt.count() <= 40 * merging.TASKS
    pairs = lt.join(rt.withColumnRenamed("id", "other"), ["lc", "rc"]).select("id", "other")
    assert pairs.count() == pairs.distinct().count() == 40 * 4000
    lt, rt = merging.half_grid(side(320), 10)
    assert lt.count() + rt.count() == 320 * 17
    met = lt.join(rt.withColumnRenamed("id", "other"), ["lc", "rc"]).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    assert met.count() == 320 * 321 // 2


def test_merged_cluster_makes_a_worse_pair_wait(spark):
    """1 and 2 merge into what 3 prefers to 4, so the pair of 3 and 4 waits."""
    at = {1: 0.0, 2: 20.0, 3: 35.0, 4: 61.0}
    rows = [(i, 1, [float(np.cos(np.radians(x))), float(np.sin(np.radians(x)))]) for i, x in at.items()]
    df = spark.createDataFrame(rows, "id bigint, size bigint, centroid array<double>")
    better = F.col("id") < 3
    parts = df.select("id", F.col("centroid").alias("vec"), "size", F.lit(None).cast(merging.MARKS).alias("marks"), F.when(better, 1).otherwise(3).cast("bigint").alias("pair"),
                      F.when(better, 0.94).otherwise(0.80).alias("psim"), F.when(better, 5).otherwise(7).cast("bigint").alias("ptie"))
    made = parts.where("id = 1").withColumn("size", F.lit(2).cast("bigint"))
    assert [r["pair"] for r in merging.disturbed(merging.grid(made, parts, 10), 0.5, 24).collect()] == [3]


def test_merge_of_many_copies_ends(spark):
    rows = [(i, 1, [1.0, 2.0]) for i in range(100)]
    got = merge_clusters(spark.createDataFrame(rows, "id bigint, size bigint, centroid array<double>"), 0.97, 24).toPandas()
    sizes = got.groupby("merged").size().sort_values().tolist()
    assert sum(sizes) == 100 and max(sizes) <= 24 and sizes[0] + sizes[1] > 24


def test_matching_is_the_sequential_one(spark):
    rnd = random.Random(2)
    members = [(rnd.randrange(25) * 100, i) for i in range(200)]
    assigned = [(rnd.choice([None, *range(20)]), i) for i in range(220)]
    story = {i: s for s, i in assigned}
    size = {}
    for s, _ in assigned:
        size[s] = size.get(s, 0) + 1
    clusters, used, want = {}, set(), {}
    for c, i in members:
        clusters.setdefault(c, []).append(i)
    for c in sorted(clusters, key=lambda c: (min(clusters[c]), c)):
        count = {}
        for i in clusters[c]:
            s = story[i]
            if s is not None and s not in used:
                count[s] = count.get(s, 0) + 1
        if count:
            best = min(count, key=lambda s: (-count[s], -count[s] / size[s], s))
            used.add(best)
            want[c] = best
    got = match_stories(spark.createDataFrame(members, "cluster bigint, id bigint"),
                        spark.createDataFrame(assigned, "story_id bigint, id bigint"))
    assert {r["cluster"]: r["story_id"] for r in got.collect()} == want


def test_blocks_do_not_change_results(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame(pd.DataFrame({"grp": ["a" if i % 3 else "b" for i in range(60)], "id": np.arange(60),
                                             "vec": list(map(list, v))}))
    def near(block):
        return {(r["id"], r["nbr"], round(r["sim"], 9)) for r in knn_join(
            df, df, 4, 0.1, block=block, self_join=True).collect()}
    assert near(7) == near(1000)
    def stats(block):
        return {(r["grp"], r["pairs"], round(r["avg_sim"], 9), round(r["max_sim"], 9)) for r in pair_stats(
            df, block).collect()}
    assert stats(7) == stats(1000)


def test_assignment_invariants(spark):
    from pressweave.catalog.vectors import assignable
    from pressweave import fixtures as fx
    from pressweave.plans.assign import assign_stories
    sf = "/root/testdata/sf0.001"
    new = assignable(spark, sf).drop("story_id").where("id < 80")
    stories = spark.createDataFrame([], "id bigint, title string, article_count bigint, entities array<string>, "
                                        "centroid array<double>, created_at timestamp_ntz, updated_at timestamp_ntz")
    done, founded, _ = assign_stories(new, stories, fx.NOW, threshold=0.2, max_size=5)
    rows = done.toPandas()
    kinds = {r["id"]: r["article_type"] for r in new.collect()}
    assert sorted(rows["id"]) == sorted(i for i, k in kinds.items() if k != "aggregation")
    assert rows.groupby("story_id").size().max() <= 5
    counts = {r["id"]: r["article_count"] for r in founded.collect()}
    assert counts == rows.groupby("story_id").size().to_dict()


def assign_rows(spark, rows):
    return spark.createDataFrame([(i, list(v), "t", "t", "event", ["A", "B"], None, dt.datetime(2024, 1, 1)) for i, v in rows],
                                 "id bigint, vec array<double>, title string, matching_text string, role string, "
                                 "entities array<string>, article_type string, created_at timestamp_ntz")


NO_STORIES = ("id bigint, title string, article_count bigint, entities array<string>, centroid array<double>, "
              "created_at timestamp_ntz, updated_at timestamp_ntz")


def test_equal_articles_fill_whole_stories(spark):
    from pressweave.plans.assign import assign_stories
    done, _, _ = assign_stories(assign_rows(spark, [(i, (1.0, 0.0)) for i in range(60)]), spark.createDataFrame([], NO_STORIES),
                                "2024-01-01", max_size=12)
    rows = done.toPandas()
    assert len(rows) == 60 and rows["id"].is_unique
    assert sorted(rows.groupby("story_id").size()) == [12] * 5


def test_near_articles_that_would_not_join_do_not_wait(spark, monkeypatch):
    import math

    from pressweave.plans import assign
    turns, founders = [], assign._founders
    monkeypatch.setattr(assign, "_founders", lambda *a: turns.append(1) or founders(*a))
    ring = [(math.cos(math.pi * i / 4), math.sin(math.pi * i / 4)) for i in range(8)]  # similarity to the next: 0.707
    rows = [(i, [float(x) for x in v], f"title{i}", f"words{i}", "event", [f"Name{i}"], None, dt.datetime(2024, 1, 1)) for i, v in enumerate(ring)]
    rows.append((8, [1.0, 0.0], "title0", "title0", "event", ["Name0"], None, dt.datetime(2024, 1, 1)))
    articles = spark.createDataFrame(rows, assign_rows(spark, [(0, (1.0, 0.0))]).schema)
    done, _, _ = assign.assign_stories(articles, spark.createDataFrame([], NO_STORIES), "2024-01-01")
    assert dict(map(tuple, done.collect())) == {**{i: i + 1 for i in range(8)}, 8: 1}
    assert len(turns) == 2  # the founders, then who waited for one of them


def test_terms_are_taken_once_per_row(spark):
    from pressweave.plans.pairing import pair_scores, terms
    a = terms(spark.createDataFrame([(1, "flood hits harbour town", ["Ann", "Bo"])], "id bigint, text string, entities array<string>"), "text", "entities", "_a")
    b = terms(spark.createDataFrame([(2, "flood leaves harbour", ["bo"])], "nbr bigint, title string, entities array<string>"), "title", "entities", "_b")
    got = pair_scores(a.select("id", "_a", "_ae").crossJoin(b.select("nbr", "_b", "_be")), "_a", "_b").first()
    mine, theirs = set(a.first()["_a"]), set(b.first()["_b"])
    assert got.asDict() == {"id": 1, "nbr": 2, "token_score": len(mine & theirs) / len(mine | theirs), "entity_score": 0.5, "shared_entities": 1}


def test_changed_stories_come_back(spark):
    from pressweave.plans.assign import assign_stories, renewed
    old = spark.createDataFrame([(7, "t", 1, ["A", "B"], [1.0, 0.0], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)),
                                 (8, "u", 1, ["C"], [0.0, -1.0], dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))], NO_STORIES)
    done, new, changed = assign_stories(assign_rows(spark, [(1, (0.8, 0.6))]), old, "2024-01-01")
    assert [tuple(r) for r in done.collect()] == [(1, 7)] and new.isEmpty()
    rows = {r["id"]: r for r in renewed(old, new, changed, F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz"), everything=True).collect()}
    assert set(rows) == {7, 8} and rows[7]["article_count"] == 2 and rows[8]["article_count"] == 1
    assert rows[7]["centroid"][1] > 0.2 and rows[7]["created_at"] == dt.datetime(2024, 1, 1)


def test_registered_queries_have_no_round_limits():
    import inspect

    from pressweave.catalog import streams, vectors

    for query in (vectors.assigned_stories, vectors.rebuilt_stories, vectors.split_oversize, streams.ingest_stream):
        assert "rounds=" not in inspect.getsource(query) and "max_depth=" not in inspect.getsource(query)
