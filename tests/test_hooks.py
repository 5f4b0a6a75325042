"""Reduced vectors against numpy."""

import numpy as np

from pressweave.functions.hooks import reduce_dims


def test_reduced_vectors_are_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)) * np.array([5.0, 3.0, 2.0, 1.0, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0]
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id bigint, vec array<double>").repartition(3)
    got = np.array([r["vec"] for r in reduce_dims(table, k=3).orderBy("id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0))
    want = x @ axes[:3].T
    assert np.allclose(np.abs(got), np.abs(want))  # an axis may point either way
    assert np.allclose((got * np.sign(got[0])).var(axis=0), np.sort(got.var(axis=0))[::-1])
