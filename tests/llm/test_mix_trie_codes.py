"""Mixing, prefix tries and vector codes against plain definitions and hard inputs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pressweave.llm import mixing, prefixtrie, vectorcode
from pressweave.llm.catalog import QUERIES

# ---- mixing -----------------------------------------------------------------------


def plain_targets(sizes, weights, share, cap):
    left, target, rest = set(sizes), {}, share * sum(sizes.values())
    while left:
        w = sum(weights[s] for s in left)
        full = {s for s in left if w and cap * sizes[s] * w <= weights[s] * rest}
        if not full:
            return target | {s: weights[s] * rest / w if w else 0.0 for s in left}
        for s in full:
            target[s] = cap * sizes[s]
        rest -= sum(target[s] for s in full)
        left -= full
    return target


@pytest.mark.parametrize("share", [0.4, 1.5])
def test_targets_stop_at_the_cap_and_the_excess_is_reshared(spark, share):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 300, "e": 5, "z": 20_000}
    weights = {"a": 3.0, "b": 1.0, "c": 2.0, "d": 3.0, "e": 0.0, "z": 2.0}
    table = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size bigint, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(table, share, 2.0).collect()}
    want = plain_targets(sizes, weights, share, 2.0)
    assert got == pytest.approx(want)


def test_targets_without_weights_or_rows(spark):
    table = spark.createDataFrame([("a", 10, 0.0)], "source string, source_size bigint, weight double")
    assert mixing.targets(table).first()["target"] == 0
    assert mixing.targets(table.where("false")).count() == 0


def test_weights_follow_code_points_null_last(spark):
    names = ["b", "B", "é", "a", None, "", "Z", "\U0001f600"]
    rows = spark.createDataFrame([(n, 1) for n in names], "source string, source_size bigint").repartition(5)
    got = {r["source"]: r["weight"] for r in mixing.cycled_weights(rows).collect()}
    order = sorted((n for n in names if n is not None)) + [None]
    assert got == {n: float((3, 1, 2)[i % 3]) for i, n in enumerate(order)}


def docs_of(spark, n=3000):
    rows = [(i, "w " * (1 + i * 7919 % 50), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}", "x", 1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, _row string, size int, _k int")


@pytest.mark.parametrize("limit", [mixing.BROADCAST_BYTES, 0])
def test_sources_come_near_their_targets_either_way(spark, limit):
    rows, rates = mixing.plan(docs_of(spark), limit=limit)
    got = rows.collect()
    assert len(got) == 3000 and all(0 <= r["copies"] <= 2 for r in got)
    for source in rates.collect():
        taken = sum(r["size"] * r["copies"] for r in got if r["source"] == source["source"])
        assert taken == pytest.approx(source["target"], rel=0.02)
    again, _ = mixing.plan(docs_of(spark).repartition(7), limit=limit)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_each_document_comes_as_often_as_planned(spark):
    docs = docs_of(spark, 300)
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan(docs)[0].collect()}
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["copy"])
        assert r["text"] == docs_text(r["doc_id"]) and r["_row"] == "x"
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(1, n + 1)) for k, n in planned.items() if n}


def docs_text(i):
    return "w " * (1 + i * 7919 % 50)


def test_given_weights_and_sources_without_one(spark):
    weights = spark.createDataFrame([("hot", 1.0)], "source string, weight double")
    rows = mixing.plan(docs_of(spark, 200), share=0.2, weights=weights)[0].collect()
    assert all(r["copies"] == 0 for r in rows if r["source"] != "hot")
    assert any(r["copies"] for r in rows)


def test_mix_hard_rows(hard, nothing):
    docs = hard.withColumn("source", F.when(F.col("lang") == "en", "src0"))
    rows = mixing.plan(docs)[0].collect()
    assert len(rows) == docs.count() and all(r["size"] == 0 and r["source_size"] > 0 for r in rows if r["doc_id"] in (2, 3))
    assert mixing.mix(docs).columns == [*docs.columns, "copy"]
    empty = nothing.withColumn("source", F.lit("a"))
    assert mixing.plan(empty)[0].count() == 0 and mixing.mix(empty).count() == 0


# ---- prefix trie ------------------------------------------------------------------

def plain_trie(turns):
    """``turns``: conversation -> list of (role, text). Straight from the definition."""
    members, parent_of = {}, {}
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def below(node):
        todo, out = [node], []
        while todo:
            out.append(todo.pop())
            todo += children.get(out[-1], [])
        return out
    rows = []
    for node, cs in members.items():
        tree = below(node)
        ends = sorted(c for c in cs if len(turns[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].split()) for x in tree if x)
        rows.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])),
                     sum(x not in children for x in tree), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def rebuilt(rows):
    """Conversations as the query rebuilds them."""
    own = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    return out


def trie_rows(frame):
    return sorted((tuple(r[c] for c in prefixtrie.RESULT) for r in frame.collect()), key=str)


def talk():
    rows = []
    for c in range(400):
        if c % 3 == 0:  # many copies of one conversation
            rows += [(c, t, "user" if t % 2 else "assistant", f"same words {t}") for t in range(5)]
        elif c % 7 == 0:  # chains that share long heads
            rows += [(c, t, "user", f"chain {t if t < 30 else (t, c % 4)}") for t in range(30 + c % 5)]
        else:
            rows += [(c, t, "system" if t == 0 else "user", "hello" if t == 0 else f"w {c * t % 11}") for t in range(1 + c % 4)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, path string, words int")


def rebuilt_paths(df):
    c = F.col("conv_id")
    return prefixtrie.with_heads(prefixtrie.conversation_paths(df), c - c % 20, F.crc32(c.cast("string")) % 4, most=3)


@pytest.mark.parametrize("shards,limit", [(1, 1 << 20), (15, 1 << 20), (15, 700)])
def test_trie_follows_the_definition_at_any_number_of_shards(spark, shards, limit):
    rows = talk()
    got = trie_rows(prefixtrie.prefix_trie(rebuilt_paths(table(spark, rows).repartition(6)), shards, limit))
    assert got == plain_trie(rebuilt(rows))


def test_pieces_of_ids_are_hashed_as_one_list(spark, monkeypatch):
    rows = [(c, 0, "user", "one") for c in range(3000)]
    paths = prefixtrie.conversation_paths(table(spark, rows))
    got = trie_rows(prefixtrie.prefix_trie(paths, 12))
    assert got == plain_trie({c: [("user", "one")] for c in range(3000)})
    stack = prefixtrie._Stack(prefixtrie.Skeleton([(b"k" * 16, 5)]), 0)
    monkeypatch.setattr(prefixtrie, "PIECE", 10)
    for c in range(9):
        stack.add(b"k" * 16, c, [1])
    stack.close(0)
    pieces = [r[-1] for r in stack.rows if r[0] == prefixtrie.IDS]
    assert len(pieces) > 1 and ",".join(pieces) == ",".join(map(str, range(9)))


def test_hard_conversations(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, 0, "user", "x " * 50_000), (2, 0, "assistant", "tie"), (40, 5, "user", "a"),
            (47, 1, "user", "only its own"), (None, 1, "user", "no conversation"), (-3, 1, "user", "a"), (9, 1, "user", None), (9, 1, "user", None)]
    df = table(spark, rows)
    paths = {r["conv_id"]: r for r in rebuilt_paths(df).collect()}
    assert set(paths) == {1, 2, 40, 47, -3, 9} and all(len(p["path"]) == 16 * len(p["words"]) for p in paths.values())
    got = prefixtrie.prefix_trie(rebuilt_paths(df)).collect()
    root = [r for r in got if r["depth"] == 0]
    assert len(root) == 1 and root[0]["n_convs"] == 6 and root[0]["conv_id"] == -3 and root[0]["parent_conv_id"] is None
    assert prefixtrie.prefix_trie(rebuilt_paths(df.where("false"))).count() == 0


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 1000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    got = prefixtrie.prefix_trie(rebuilt_paths(table(spark, [(c, 0, "user", "gone")]))).collect()
    assert len(got) == 1 and got[0]["n_leaves"] == 1 and got[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


# ---- vector codes -----------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """``rows``: (id, integer vector)."""
    rows = sorted(rows)
    dims = len(rows[0][1])
    ends = [p * dims // parts for p in range(parts + 1)]
    books = [[list(v[a:b]) for _, v in rows[:entries]] for a, b in zip(ends, ends[1:])]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(ends, ends[1:])):
            found = [near(v[a:b], books[p])[1] for _, v in rows]
            for e in range(len(books[p])):
                mine = [v[a:b] for (_, v), f in zip(rows, found) if f == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    out = {}
    for i, v in rows:
        best = [near(v[a:b], books[p]) for p, (a, b) in enumerate(zip(ends, ends[1:]))]
        out[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return out, digest


def numbers(i, dims):
    return [((i * 7919 + j * 104729 + (i * j) % 13 * 31) % 2001 - 1000) / 700 for j in range(dims)]


@pytest.mark.parametrize("n,dims,entries", [(300, 32, 64), (40, 16, 64), (90, 5, 4)])
def test_codes_follow_the_definition(spark, monkeypatch, n, dims, entries):
    data = [(i * 37 % 1009 - 50, numbers(i, dims), None if i % 4 == 0 else i % 3) for i in range(n)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = vectorcode.vector_codes(df, entries=entries).collect()
    want, digest = plain_codes([(i, [int(x * 256 // 1) for x in v]) for i, v, _ in data], entries=entries)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {digest}
    labels = {i: k for i, _, k in data}
    for r in got:
        assert r["label_error"] == sum(want[i][1] for i in want if labels[i] == labels[r["vec_id"]])


def test_small_blocks_and_salted_labels_change_nothing(spark):
    df = spark.createDataFrame([(i, numbers(i, 16), "hot" if i % 3 else None, 1) for i in range(200)],
                               "vec_id bigint, embedding array<float>, label string, code int")
    want = sorted(vectorcode.vector_codes(df).collect())
    block, vectorcode.BLOCK = vectorcode.BLOCK, 16
    try:
        rows = vectorcode.whole_vectors(df)
        assert vectorcode.blocks(rows.repartition(2), 16).count() >= 200 // 16
    finally:
        vectorcode.BLOCK = block
    assert sorted(vectorcode.vector_codes(df.repartition(9), limit=0).collect()) == want


def test_hard_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5] * 16, 1), (2, None, 1), (3, [nan] + [0.0] * 15, 1), (4, [None] + [0.0] * 15, 1), (5, [inf] * 16, 2), (6, [0.5] * 16, None),
            (6, [-0.001] * 16, None), (7, [1.0] * 8, 3), (None, [0.25] * 16, 1), (8, [3e38] * 16, 1), (9, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = vectorcode.vector_codes(df).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "6", "6", "7", "8", "9", "None"]
    assert all((r["code"] is None) == (r["vec_id"] in (7, 9)) for r in got)
    assert len({r["code"] for r in got if r["vec_id"] == 6}) == 2
    assert vectorcode.vector_codes(df.where("false")).columns == vectorcode.vector_codes(df).columns
    assert vectorcode.vector_codes(df.where("embedding is null")).count() == 0
    assert vectorcode.vector_codes(df.where("vec_id = 9")).first()["code"] == "00" * 16


def test_floors_go_down(spark):
    df = spark.createDataFrame([(1, [-0.001] * 16, 0)], "vec_id bigint, embedding array<double>, label int")
    assert vectorcode.whole_vectors(df).first()["v"] == [-1] * 16


# ---- the queries ------------------------------------------------------------------

def test_mix_query_is_near_every_target(spark, sf):
    rows = QUERIES["op11_source_mix"](spark, sf).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), rel=0.1)
