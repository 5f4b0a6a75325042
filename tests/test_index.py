"""The vector index: exact joins equal brute force, chunks are skipped, probes recall most neighbours."""

import numpy as np
import pytest

from pressweave.operators.simjoin import index_knn, knn_join, pair_stats, ranked, top_pairs
from pressweave.operators.vectorindex import VectorIndex, fit_pivots


def clustered(n=400, dims=12, centres=20, noise=0.08, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    own = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % centres)  # a third of all rows in one cluster
    v = c[own] + noise * rng.normal(size=(n, dims))
    v[::17] = c[0]  # copies
    return v


def frame(spark, v, grp="", start=0):
    return spark.createDataFrame([(grp, start + i, list(map(float, x))) for i, x in enumerate(v)], "grp string, id bigint, vec array<double>")


def unit(v):
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n > 0, n, 1)[:, None]


def brute(v, k, min_sim):
    s = unit(v) @ unit(v).T
    np.fill_diagonal(s, -np.inf)
    out = {}
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if s[i, j] > min_sim), key=lambda j: (-round(s[i, j], 9), j))[:k]
        out[i] = [round(s[i, j], 7) for j in order]
    return out


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["id"], []).append((r["rank"], round(r["sim"], 7)))
    return {i: [s for _, s in sorted(x)] for i, x in out.items()}


def test_exact_neighbours_skip_chunks(spark, min_sim=-1.0):
    v = clustered()
    v[5] = 0.0  # no angle
    df = frame(spark, v).unionByName(frame(spark, v[:30], "other", 1000)).unionByName(spark.createDataFrame([("", 5000, [1.0, 2.0])], "grp string, id bigint, vec array<double>"))
    index = VectorIndex.build(df, 32)
    assert index.pivots and index.chunks.agg({"n": "max"}).first()[0] <= 80
    got = found(index_knn(df.where("grp = ''"), index, 4, min_sim, self_join=True))
    want = brute(v, 4, min_sim)
    assert all(got.get(i, []) == w for i, w in want.items())
    some, every = index.pairs(index, 0.9)
    print("chunk pairs compared", some, "of", every)
    assert some < every / 3


def test_probes_recall_most_neighbours_and_the_index_can_be_stored(spark, tmp_path):
    v = clustered(noise=0.3)
    df = frame(spark, v)
    VectorIndex.build(df, 32).write(str(tmp_path / "index"))
    index = VectorIndex.read(spark, str(tmp_path / "index"))
    exact = {(r["id"], r["nbr"]) for r in index_knn(df, index, 10, 0.0, self_join=True).collect()}
    near = {(r["id"], r["nbr"]) for r in index_knn(df, index, 10, 0.0, self_join=True, probes=5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    plan = index_knn(df, index, 10, 0.0, probes=1)._jdf.queryExecution().toString()
    assert "_pid" in plan
    again = VectorIndex.build(df.where("id < 200"), 32, index.pivots)  # other rows, same cells
    assert again.rows.count() == 200


def test_best_pairs_and_statistics_equal_brute_force(spark):
    v = clustered(300)
    df = frame(spark, v)
    s = unit(v) @ unit(v).T
    i, j = np.triu_indices(len(v), 1)
    order = sorted(zip(-np.round(s[i, j], 9), i, j))[:15]
    got = [(r["a"], r["b"]) for r in top_pairs(df, 15, 0.5, block=32).orderBy("rank").collect()]
    assert [round(s[a, b], 9) for a, b in got] == [-x[0] for x in order]
    r = pair_stats(df, block=32).first()
    assert r["pairs"] == len(i) and r["avg_sim"] == pytest.approx(s[i, j].mean())
    assert r["min_sim"] == pytest.approx(s[i, j].min()) and r["max_sim"] == pytest.approx(s[i, j].max())


def test_index_of_hard_rows(spark):
    rows = [("a", 1, []), ("a", 2, [0.0, 0.0]), ("a", 3, [1.0, 0.0]), ("b", 4, [1.0, 0.0])] + [("a", 10 + i, [1.0, 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "grp string, id bigint, vec array<double>")
    got = found(knn_join(df, df, 2, 0.5, block=8, self_join=True))
    assert 1 not in got and 2 not in got and 4 not in got and got[3] == [0.7071068] * 2 and all(got[10 + i] == [1.0, 1.0] for i in range(100))
    assert knn_join(df.where("false"), df, 2, 0.5).count() == 0 and knn_join(df, df.where("false"), 2, 0.5).count() == 0
    assert fit_pivots(df.where("false"), 8) == {}
    assert pair_stats(df.where("id < 3")).count() == 0
