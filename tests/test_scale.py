"""Plans and layouts that decide whether a query still runs on large tables."""

import numpy as np

import pressweave.operators.density as dn
from pressweave.operators.density import TimeIndex, id_runs
from pressweave.operators.groups import contained_forms
from pressweave.operators.simjoin import index_knn, knn_join, pair_stats
from pressweave.operators.vectorindex import COPIES, VectorIndex
from pressweave.plans import quality as ql
from pressweave.plans import searchindex as sx
from pressweave.plans.search import build_index
from test_index import brute, found, frame, unit


def test_windows_of_forms_are_not_broadcast(spark):
    forms = spark.createDataFrame([(1, "ent"), (1, "ent 12"), (2, "ent 12"), (2, "org")], "cluster bigint, _l string")
    for how in ("left_semi", "inner"):
        t = contained_forms(forms, "cluster", how)
        assert "Broadcast" not in t._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r)[:2] for r in t.collect()] == [(1, "ent")]


def test_small_groups_are_compared_in_packs(spark):
    v = np.random.default_rng(3).normal(size=(60, 8))
    rows = [(f"g{i // 3}", i, list(map(float, x))) for i, x in enumerate(v)] + [("large", 100 + i, list(map(float, x))) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "grp string, id bigint, vec array<double>")
    index = VectorIndex.build(df, 40, {})
    lt, rt = index.grid(index, -1.0)
    assert {r["lc"][0] for r in lt.where("grp <> 'large'").collect()} == {"*"} == {r["rc"][0] for r in rt.where("grp <> 'large'").collect()}
    assert lt.where("grp = 'large'").count() == 120  # two chunks, so two copies
    got = found(knn_join(df, df, 2, -2.0, block=40, self_join=True))
    for g in range(20):
        for i, w in brute(v[3 * g:3 * g + 3], 2, -2.0).items():
            assert got[3 * g + i] == w
    assert all(got[100 + i] == w for i, w in brute(v, 2, -2.0).items())


def test_vectors_without_structure_are_copied_a_bounded_number_of_times(spark):
    v = np.random.default_rng(5).normal(size=(1200, 16))
    df = frame(spark, v)
    index = VectorIndex.build(df, 8)
    assert index.pivots
    lt, rt = index.grid(index, 0.1)
    assert lt.count() <= (COPIES + 1) * 1200 and rt.count() <= (COPIES + 1) * 1200
    got = found(index_knn(df, index, 3, 0.1, self_join=True))
    assert all(got.get(i, []) == w for i, w in brute(v, 3, 0.1).items())


def test_ties_keep_the_least_ids(spark):
    df = spark.createDataFrame([("", i, [1.0, float(i % 2)]) for i in range(50)], "grp string, id bigint, vec array<double>")
    got = {}
    for r in knn_join(df, df, 3, 0.0, block=7, self_join=True).collect():
        got.setdefault(r["id"], []).append(r["nbr"])
    assert sorted(got[0]) == [2, 4, 6] and sorted(got[9]) == [1, 3, 5]


def test_statistics_of_groups_of_few_chunks_use_no_cells(spark, monkeypatch):
    import pressweave.operators.simjoin as sj
    v = np.random.default_rng(6).normal(size=(150, 6))
    seen = []
    build = VectorIndex.build.__func__
    monkeypatch.setattr(sj.VectorIndex, "build", classmethod(lambda c, *a: seen.append(build(c, *a)) or seen[-1]))
    r = pair_stats(frame(spark, v), block=32).first()
    s = (unit(v) @ unit(v).T)[np.triu_indices(150, 1)]
    assert not seen[0].pivots and abs(r["min_sim"] - s.min()) < 1e-9 and abs(r["max_sim"] - s.max()) < 1e-9


def test_points_spread_over_time_are_cut_by_time(spark, monkeypatch):
    import pressweave.operators.density as dn
    rng = np.random.default_rng(8)
    v, h = rng.normal(size=(700, 6)), np.round(rng.uniform(0, 400, 700), 2)
    h[:120] = 7.0  # more than a run at one time
    df = spark.createDataFrame([("", i, list(map(float, x)), float(t), 1) for i, (x, t) in enumerate(zip(v, h))], "grp string, id bigint, vec array<double>, hours double, mult bigint")
    index = dn._indexed(df, 0.55, 12.0, None, 16)
    assert isinstance(index, dn.TimeIndex) and index.rows.count() == 700 and index.chunks.agg({"n": "max"}).first()[0] <= 120
    d = dn.composite(v, v, h, h, 0.55, 12.0)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in dn.nearest(df, 3, 0.55, block=16, index=index).collect():
        got.setdefault(r["id"], []).append(round(r["dist"], 8))
    assert all(sorted(got[i]) == np.round(np.sort(d[i])[:3], 8).tolist() for i in range(700))
    rows = index.rows.withColumn("_need", dn.F.lit(5.0))
    lt, _ = dn._other_chunks(index, rows)
    assert lt.count() < 8 * 700  # of more than 30 runs

    core = np.sort(d, axis=1)[:, 1]
    m = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    cores = spark.createDataFrame([(i, float(c)) for i, c in enumerate(core)], "id bigint, core double")
    edges = dn.spanning_forest(index, cores, 0.55, 12.0, None, pairwise=1).collect()
    want = sorted(w for *_, w in dn._prim(m, np.inf))
    assert np.allclose(sorted(e["w"] for e in edges), want)


def test_frequent_words_are_not_joined_with_every_query(spark):
    from pressweave.plans import search as se
    rows = [(i, "the sea", "the and of " + " ".join(f"w{j}" for j in range(12) if i >> j & 1)) for i in range(300)]
    a = spark.createDataFrame(rows, "id bigint, title string, body string")
    index = se.build_index(a, positions=False)
    asked = [(q, "the and of sea " + " ".join(f"w{j}" for j in range(9) if q >> j & 1)) for q in range(200, 260)] + [(900, "the nowhere"), (901, "the"), (902, "")]
    queries = spark.createDataFrame(asked, "query_id bigint, text string").withColumn("words", se.F.array_distinct(se.terms("text")))
    wanted = queries.select("query_id", se.F.size("words").alias("need"), se.F.explode("words").alias("term"))
    got = {(r["query_id"], r["article_id"]): r["rank"] for r in se._all_words(index, wanted).collect()}
    plain = index.join(wanted, "term").groupBy("query_id", "need", "article_id").agg(
        se.F.count_distinct("term").alias("n"), se._rank().alias("rank")).where("n = need").collect()
    assert got == {(r["query_id"], r["article_id"]): r["rank"] for r in plain} and len(got) > 300
    plan = se._all_words(index, wanted)  # a few articles a query are left when its frequent words are looked up
    assert plan.where("query_id < 900").count() < 60 * 300 / 8


def test_clusters_and_their_verdicts_are_not_broadcast(spark, tmp_path):
    members = spark.createDataFrame([(c, 10 * c + i) for c in range(4) for i in range(3)], "cluster bigint, id bigint")
    rows = [(f"{10 * c},{10 * c + 1},{10 * c + 2}", [10 * c, 10 * c + 1, 10 * c + 2], False, None, None, [[10 * c], [10 * c + 1, 10 * c + 2]], "m", None)
            for c in (1, 2)]
    cache = spark.createDataFrame(rows, ql.CACHE_COLUMNS)
    for name, df in (("members", members), ("cache", cache)):  # files tell a small size
        df.write.parquet(str(tmp_path / name))
    members, cache = spark.read.parquet(str(tmp_path / "members")), spark.read.parquet(str(tmp_path / "cache"))
    for t in (ql.prior_splits(members, cache), ql.regroup(ql.prior_splits(members, cache)), ql._parted(members, members.where("id % 10 = 2"))):
        assert "BroadcastExchange" not in t._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ql.prior_splits(members, cache).collect())) == [(c, 10 * c + i, min(i, 1)) for c in (1, 2) for i in range(3)]


def test_labels_of_one_run_need_no_ranges(spark):
    rows = spark.createDataFrame([(7, i) for i in range(50)] + [(8, 100), (8, 105)], "label bigint, id bigint")
    got = {r["id"]: r["run"] for r in id_runs(rows, 24).collect()}
    assert got == {**{i: i // 24 for i in range(50)}, 100: 0, 105: 0}


def test_postings_are_counted_where_the_texts_are_split(spark):
    rows = [(1, "A b a", "b b"), (2, None, "a"), (1, "a", None), (3, "", "...")]
    articles = spark.createDataFrame(rows, "id bigint, title string, body string")
    index = build_index(articles)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(id" in plan
    got = {tuple(r)[:4]: r["positions"] for r in index.collect()}
    assert got == {("a", 1, "title", 3): [1, 1, 3], ("b", 1, "title", 1): [2], ("b", 1, "body", 2): [1, 2], ("a", 2, "body", 1): [1]}


def test_a_segment_splits_its_texts_once(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(sx, "write_index", lambda postings, path, write=sx.write_index: (
        seen.append(postings._jdf.queryExecution().executedPlan().toString()), write(postings, path)))
    articles = spark.createDataFrame([(1, "a b", "c"), (2, "b", "c c")], "id bigint, title string, body string")
    index = sx.StoredIndex(spark, str(tmp_path)).create(articles)
    assert "Generate" not in seen[0]  # the borders of the ranges are sampled from written postings
    assert sorted(map(tuple, index.postings().collect())) == [
        ("a", 1, "title", 1), ("b", 1, "title", 1), ("b", 2, "title", 1), ("c", 1, "body", 1), ("c", 2, "body", 2)]


def test_points_are_cut_into_runs_where_they_are(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(dn, "cut", lambda df, cut=dn.cut: seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = [("a", i, [1.0, float(i)], float(i % 90)) for i in range(180)] + [("a", 1000 + i, [1.0, 0.0], 95.0) for i in range(100)]
    rows += [("b", 2000 + i, [0.0, 1.0], 5.0) for i in range(7)]
    index = TimeIndex(spark.createDataFrame(rows, "grp string, id bigint, vec array<double>, hours double"), 20)
    placed = [p for p in seen if "_chunk" in p and "vec" in p][0]
    assert "hashpartitioning" not in placed and "SortMergeJoin" not in placed
    chunks = {(r["grp"], r["_chunk"]): r for r in index.chunks.collect()}
    assert sum(r["n"] for r in chunks.values()) == 287 and max(r["n"] for r in chunks.values()) <= 60
    assert [k for k in chunks if k[0] == "b"] == [("b", "2:0:0")] and len(chunks) >= 10
