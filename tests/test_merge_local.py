"""Sets of clusters that cannot meet others are merged by one task each, with the outcome of the rounds over all tasks."""

import numpy as np

from pressweave.operators import merging

SCHEMA = "id bigint, size bigint, centroid array<double>, marks array<struct<f:bigint,g:int>>"


def heaps(seed=4, heaps=30, each=8, dims=16):
    """Heaps of near clusters of several lengths; some marked, some copies, one without a centroid and one of another length."""
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(heaps, dims))
    rows = []
    for i in range(heaps * each):
        v = (c[i % heaps] + 0.2 * rng.normal(size=dims)) * rng.uniform(0.1, 3)
        v = c[i % heaps] if i % 11 == 0 else v
        rows.append((i, int(rng.integers(1, 5)), v.tolist(), [(i % heaps, int(rng.integers(0, 2)))] if i % 4 == 0 else None))
    return [*rows, (900, 1, [], None), (901, 1, [1.0, 2.0], None)]


def test_local_merging_equals_rounds(spark):
    df = spark.createDataFrame(heaps(), SCHEMA)
    for block in (2048, 20):
        got = {r["id"]: r["merged"] for r in merging.merge_clusters(df, 0.95, 12, block=block).collect()}
        want = {r["id"]: r["merged"] for r in merging.merge_clusters(df, 0.95, 12, block=block, local=0).collect()}
        assert got == want and len(set(got.values())) < 150
    mixed = {r["id"]: r["merged"] for r in merging.merge_clusters(df, 0.95, 12, local=5).collect()}  # larger sets take rounds
    assert mixed == want


def test_local_merging_takes_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(merging, "best_partners", None)  # every round asks it
    df = spark.createDataFrame(heaps(), SCHEMA)
    assert merging.merge_clusters(df, 0.95, 12).count() == 242


def test_what_may_meet_is_bounded():
    """Chains of joins at the threshold never bring together what lies farther apart than the bound."""
    rng = np.random.default_rng(9)
    t, cap = 0.9, 6
    least = merging.least_similarity(t, cap)
    for _ in range(2000):
        v = rng.normal(size=3) * rng.uniform(0.1, 5)
        parts = {0: [v], 1: [v + 0.6 * np.linalg.norm(v) * rng.normal(size=3)]}
        for side in parts.values():
            while len(side) < cap // 2:
                x = np.sum(side, axis=0)
                y = (x / np.linalg.norm(x) + 0.5 * rng.normal(size=3)) * rng.uniform(0.1, 10)
                if x @ y >= t * np.linalg.norm(x) * np.linalg.norm(y):
                    side.append(y)
        x, y = (np.sum(p, axis=0) for p in parts.values())
        if x @ y >= t * np.linalg.norm(x) * np.linalg.norm(y):
            near = max(a @ b / np.linalg.norm(a) / np.linalg.norm(b) for a in parts[0] for b in parts[1])
            assert near >= least
