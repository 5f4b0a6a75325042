"""Nearest rows are found in single precision and weighed in double; short sides need no index."""

import numpy as np

from pressweave.operators import simjoin as sj
from pressweave.operators.vectorindex import VectorIndex


def unit(v):
    return v / np.linalg.norm(v, axis=1)[:, None]


def frame(spark, v, start=0):
    return spark.createDataFrame([("", start + i, list(map(float, x))) for i, x in enumerate(v)], "grp string, id bigint, vec array<double>")


def plain(a, b, ids, k, banned):
    """The k greatest cosines per row, ties by id, one row at a time."""
    out = {}
    for i, x in enumerate(a):
        s = np.einsum("ij,j->i", b, x)
        order = sorted((j for j in range(len(b)) if not banned(i, j)), key=lambda j: (-round(s[j], 12), ids[j]))[:k]
        out[i] = [int(ids[j]) for j in order]
    return out


def test_few_pairs_are_weighed_in_double_precision(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = unit(rng.normal(size=(700, 24))), unit(rng.normal(size=(9000, 24)))
    b[100:140] = b[50]  # copies: ties by id
    a[3] = b[50]
    ids = rng.permutation(len(b))
    dense, top = [], sj._top_k
    monkeypatch.setattr(sj, "_top_k", lambda s, *rest: dense.append(s.size) or top(s, *rest))
    r, c, s = sj.nearest_rows(a, b, ids, 5, np.full(len(a), -1.0), lambda r, c: ids[c] == r)
    assert sum(dense) < a.shape[0] * b.shape[0] / 8
    got = {}
    for i, j in zip(r, c):
        got.setdefault(int(i), []).append(int(ids[j]))
    assert got == plain(a, b, ids, 5, lambda i, j: ids[j] == i)
    assert np.allclose(s, np.einsum("ij,ij->i", a[r], b[c]))


def test_a_short_side_needs_no_index(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(900, 8))
    monkeypatch.setattr(VectorIndex, "build", None)  # the long side is neither placed nor written
    rows = sj.knn_join(frame(spark, a), frame(spark, b, 100), 3, -1.0, block=16).collect()
    want = plain(unit(a), unit(b), np.arange(100, 1000), 3, lambda i, j: False)
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append(r["nbr"])
    assert got == want


def test_best_pairs_copy_few_rows(spark, monkeypatch):
    """Vectors without structure: no pair of chunks can be skipped, so rows go to few large chunks; and equal pairs go by id."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 24))
    v[[5, 700, 1900, 2500]] = v[40]
    sent, grid = [], sj.index_self_grid

    def counted(index, pairs):
        rows = grid(index, pairs)
        sent.append(rows.count())
        return rows
    monkeypatch.setattr(sj, "index_self_grid", counted)
    got = [(r["a"], r["b"]) for r in sj.top_pairs(frame(spark, v), 8, 0.1, block=32).orderBy("rank").collect()]
    s = unit(v) @ unit(v).T
    i, j = np.triu_indices(len(v), 1)
    assert got == [(int(a), int(b)) for _, a, b in sorted(zip(-np.round(s[i, j], 9), i, j))[:8]]
    assert sum(sent) <= 3000 * 20


def test_a_stored_index_has_few_files_and_a_probe_few_copies(spark, tmp_path):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.normal(size=(2000, 8))).repartition(8)
    index = VectorIndex.build(df, 16)
    spread = VectorIndex(index.rows.repartition(8), index.chunks, index.counts, index.pivots, index.block)
    spread.write(str(tmp_path / "index"))
    cells = index.chunks.select("_pid").distinct().count()
    assert len(list((tmp_path / "index" / "rows").rglob("*.parquet"))) <= cells + 8
    lt, rt = VectorIndex.read(spark, str(tmp_path / "index")).probe(df, 1)
    assert lt.count() == 2000 and rt.count() <= 2000  # not one copy for every chunk of a cell
