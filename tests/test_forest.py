"""Forests of chunks and least distances against plain definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressweave.operators import density as dn


def rows(n, seed, core, even=0):
    """Random points; ``even`` rounds them so that many distances are equal."""
    rng = np.random.default_rng(seed)
    v, h = rng.normal(size=(n, 6)), rng.uniform(0, 30, n)
    if even:
        v, h = np.round(v[:, :2]) + [0.0, 0.5], np.round(h / even)
    return pd.DataFrame({"id": rng.permutation(3 * n)[:n], "vec": list(v), "hours": h, "core": np.round(rng.uniform(0, core, n), 2)})


@pytest.mark.parametrize("n,weight,limit,core,even", [(300, 0.55, np.inf, 0.1, 0), (500, 0.0, np.inf, 0.6, 0), (600, 0.55, 0.2, 0.0, 0), (400, 0.55, np.inf, 0.3, 3), (1, 0.5, 1.0, 0, 0)])
def test_forest_of_a_chunk(n, weight, limit, core, even):
    pdf = rows(n, 3, core, even)
    got = dn.chunk_forest(pdf, weight, 12.0, limit)
    at = pdf.sort_values("id", ignore_index=True)
    want = dn._prim(dn._reach(at, at, weight, 12.0), limit)
    assert len(got) == len(want) and np.allclose(sorted(got["w"]), sorted(w for *_, w in want))
    up = {}

    def find(i):
        while up.get(i, i) != i:
            i = up[i]
        return i
    for a, b in zip(got["a"], got["b"]):  # no circle
        x, y = find(a), find(b)
        assert x != y
        up[x] = y


@pytest.mark.parametrize("even", [0, 3])
def test_closest_is_exact_and_weighs_few_pairs(even, monkeypatch):
    a, b = rows(300, 4, 0.2, even).sort_values("id", ignore_index=True), rows(4000, 5, 0.2, even).sort_values("id", ignore_index=True)
    dense, top = [], dn._top_k
    monkeypatch.setattr(dn, "_top_k", lambda d, *rest: dense.append(d.size) or top(d, *rest))
    p, q = dn._Points.of(a), dn._Points.of(b)
    r, c, w = dn.closest(p, q, 3, 0.55, 12.0, np.full(len(a), np.inf))
    d = dn._reach(a, b, 0.55, 12.0)
    d[p.ids[:, None] == q.ids[None, :]] = np.inf
    assert np.allclose(w[np.lexsort((w, r))].reshape(300, 3), np.sort(d, axis=1)[:, :3])
    assert even or sum(dense) < d.size / 4


def test_core_of_one_sample_takes_no_search(spark, monkeypatch):
    monkeypatch.setattr(dn, "nearest", None)
    p = spark.range(5).select(F.lit("").alias("grp"), "id", F.lit(1).alias("mult"))
    assert {r["core"] for r in dn.core_distances(p, 1, 0.5).collect()} == {0.0}


def test_own_chunks_are_compared_once(spark, monkeypatch):
    """Boruvka rounds read the forests of chunks, not the chunks."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(400, 5))
    df = spark.createDataFrame([("", i, list(map(float, x)), float(h)) for i, (x, h) in enumerate(zip(v, rng.uniform(0, 300, 400)))], "grp string, id bigint, vec array<double>, hours double")
    points = dn.cut(df.withColumn("mult", F.lit(1).cast("bigint")))
    index = dn._indexed(points, 0.55, 12.0, None, 16)
    cores = dn.cut(dn.core_distances(points, 3, 0.55, block=16, index=index))
    made, forest = spark.sparkContext.accumulator(0), dn.chunk_forest

    def counted(pdf, *rest):
        made.add(1)
        return forest(pdf, *rest)
    monkeypatch.setattr(dn, "chunk_forest", counted)
    got = dn.spanning_forest(index, cores, 0.55, 12.0, None).toPandas()
    assert made.value == index.chunks.count()
    at = df.join(cores, ["grp", "id"]).toPandas().sort_values("id", ignore_index=True)
    want = dn._prim(dn._reach(at, at, 0.55, 12.0), np.inf)
    assert len(got) == 399 and np.allclose(sorted(got["w"]), sorted(w for *_, w in want))
