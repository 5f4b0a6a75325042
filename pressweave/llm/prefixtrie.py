"""The trie of conversation prefixes, with member counts, leaves and savings per node.

A conversation is a path of 16-byte turn digests. Paths are range-partitioned at splitters taken from a bounded
sample. A node whose members lie in more than one shard is a prefix of a splitter path, so the trie of the splitter
paths (the skeleton, of bounded bytes) is broadcast: a sorted shard finishes every other node by itself in one pass with
a stack, and gives partial sums of the skeleton nodes, which are reduced per node and then rolled up along the skeleton.

Ids of the members that end in a skeleton node leave the shards as bounded pieces in order, and are hashed as a stream,
so that a conversation with very many copies is never held as a whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import hash_sample, word_count

#: Bytes of a turn in a path.
TURN = 16
#: Turns that a shard takes, on average; a session's shuffle partitions are the least number of shards.
SHARD_TURNS = 400_000
#: Sampled paths per shard, and bytes of all splitter paths; beyond those there are fewer shards.
SAMPLE = 16
SKELETON_BYTES = 32 << 20
PIECE = 1 << 16

_OUT = ("kind int, node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, words bigint, shard int, seq int, ends string")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]
#: Kinds of rows that shards give: finished nodes, finished children of a skeleton node, partial sums, pieces of ids.
DONE, CHILD, PARTIAL, IDS = range(4)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_paths(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, path, words)``: digests and word counts of the turns in order.

    Order is by turn, null first, ties by digest; a null role or text is empty, and rows without a conversation
    are left out. Only digests and counts are shuffled; a conversation is one row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN))
    turns = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("t"), digest.alias("k"), word_count(text).alias("w")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x["k"])), "")).alias("path"),
                        F.transform("x", lambda x: x["w"]).alias("words"))


def with_heads(paths: DataFrame, base: Column, turns: Column, most: int) -> DataFrame:
    """Every path's first ``turns`` (at most ``most``) replaced by those of the conversation ``base`` (none if absent)."""
    heads = paths.select(F.col("conv_id").alias("_base"), F.substring(F.col("path"), 1, most * TURN).alias("_path"),
                         F.slice("words", 1, most).alias("_words"))
    rows = paths.withColumn("_b", base).withColumn("_h", turns.cast("int"))
    n, empty = F.col("_h"), F.array().cast("array<bigint>")
    return rows.join(heads, F.col("_b") == F.col("_base"), "left").select(
        "conv_id",
        F.concat(F.coalesce(F.substr(F.col("_path"), F.lit(1), n * TURN), F.lit(b"")),
                 F.substr(F.col("path"), n * TURN + 1, F.octet_length("path"))).alias("path"),
        F.concat(F.coalesce(F.slice("_words", F.lit(1), n), empty),
                 F.slice("words", n + 1, F.greatest(F.size("words") - n, F.lit(0)))).alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // TURN


class Skeleton:
    """The trie of splitter paths: nodes are numbers, 0 the root, each after its parent."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.nodes = [-1], [0], {}
        known = {}
        for path, _ in splitters:
            if path in self.nodes:
                continue
            at, line = 0, [0]
            for d in range(0, len(path), TURN):
                step = (at, path[d:d + TURN])
                if step not in known:
                    known[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = known[step]
                line.append(at)
            self.nodes[path] = np.array(line, dtype=np.int32)

    def around(self, shard: int) -> list[bytes]:
        """The splitter paths before and after a shard."""
        return [self.splitters[i][0] for i in (shard - 1, shard) if 0 <= i < len(self.splitters)]


def splitters(paths: DataFrame, shards: int, total: int, limit: int = SKELETON_BYTES) -> list[tuple[bytes, int]]:
    """Borders of about equal ranges of ``(path, conv_id)``, from a hash sample of ``SAMPLE`` rows a shard."""
    wanted = SAMPLE * shards
    sample = hash_sample(paths, "conv_id", wanted, total, seed=12).where(F.octet_length("path") <= limit).select("path", "conv_id")
    n = sample.count()
    step = max(1, n // shards)
    row = F.row_number().over(Window.orderBy("path", "conv_id"))  # over the sample only
    some = cut(sample.withColumn("_r", row).where(F.col("_r") % step == 0))
    sizes = some.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    thin = 1
    while sizes > limit * thin:
        thin *= 2
    kept = some.where(F.col("_r") % (step * thin) == 0).select("path", "conv_id").collect()
    return sorted((bytes(r["path"]), r["conv_id"]) for r in kept)


class _Stack:
    """Open nodes of the current path in one shard."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.around = skeleton, shard, skeleton.around(shard)
        self.path, self.known, self.rows = None, 0, []
        self.line = np.zeros(1, np.int32)
        self.open: list[dict] = []

    def node(self, words: int) -> dict:
        return {"min": None, "n": 0, "children": 0, "leaves": 0, "saved": 0, "words": words, "sha": None, "ids": [], "held": 0, "seq": 0, "below": []}

    def add(self, path: bytes, conv_id: int, words: list[int]):
        if path != self.path:
            same = common_turns(path, self.path) if self.path is not None else 0
            if self.open:
                self.close(same + 1)
            else:
                self.open.append(self.node(0))
            self.known = 0
            for other in self.around:
                if (n := common_turns(path, other)) >= self.known:
                    self.known, self.line = n, self.skeleton.nodes[other]
            for w in words[same:]:
                self.open.append(self.node(w))
            self.path = path
        last = self.open[-1]
        last["n"] += 1
        last["min"] = conv_id if last["min"] is None else min(last["min"], conv_id)
        if len(self.open) - 1 <= self.known:
            text = str(conv_id)
            last["ids"].append(text)
            last["held"] += len(text) + 1
            if last["held"] >= PIECE:
                self.piece(last, len(self.open) - 1)
        elif last["sha"] is None:
            last["sha"] = hashlib.sha256(str(conv_id).encode())
        else:
            last["sha"].update(f",{conv_id}".encode())

    def piece(self, node: dict, depth: int):
        self.rows.append((IDS, int(self.line[depth]), None, depth, None, None, None, None, None, None, self.shard, node["seq"], ",".join(node["ids"])))
        node["ids"], node["held"], node["seq"] = [], 0, node["seq"] + 1

    def close(self, least: int):
        """Close the open nodes from depth ``least`` on, deepest first."""
        while len(self.open) > least:
            depth, node = len(self.open) - 1, self.open.pop()
            if depth <= self.known:
                if node["ids"]:
                    self.piece(node, depth)
                self.rows.append((PARTIAL, int(self.line[depth]), node["min"], depth, None, node["n"], node["children"], node["leaves"],
                                  node["saved"], node["words"], self.shard, None, None))
                continue
            saved = node["saved"] + (node["n"] - 1) * node["words"]
            leaves = node["leaves"] or 1
            ends = node["sha"].hexdigest() if node["sha"] else None
            for row in node["below"]:
                self.rows.append((DONE, None, row[0], depth + 1, node["min"], *row[1:5], None, self.shard, None, row[5]))
            done = (node["min"], node["n"], node["children"], leaves, saved, ends)
            up = self.open[-1]
            if depth - 1 <= self.known:
                self.rows.append((CHILD, int(self.line[depth - 1]), done[0], depth, None, *done[1:5], None, self.shard, None, ends))
            else:
                up["below"].append(done)
            up["min"] = node["min"] if up["min"] is None else min(up["min"], node["min"])
            up["n"] += node["n"]
            up["children"] += 1
            up["leaves"] += leaves
            up["saved"] += saved


def _batch(rows: list) -> pa.RecordBatch:
    types = {"kind": pa.int32(), "node": pa.int32(), "shard": pa.int32(), "seq": pa.int32(), "ends": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(_NAMES, zip(*rows))], names=_NAMES)


def shard_nodes(paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """What the sorted shards give; see the kinds of rows above."""
    shared = paths.sparkSession.sparkContext.broadcast(skeleton)  # at most SKELETON_BYTES of paths

    def place(batches):
        marks = shared.value.splitters
        for batch in batches:
            found = [bisect_right(marks, (p, c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=["conv_id", "path", "words", "shard"])

    def finish(batches):
        stack = None
        for batch in batches:
            for shard, path, conv_id, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "words"))):
                if stack is None or stack.shard != shard:
                    if stack is not None:
                        stack.close(0)
                        yield _batch(stack.rows)
                    stack = _Stack(shared.value, shard)
                stack.add(path, conv_id, words)
                if len(stack.rows) >= 20_000:
                    yield _batch(stack.rows)
                    stack.rows = []
        if stack is not None:
            stack.close(0)
            yield _batch(stack.rows)

    placed = paths.select("conv_id", "path", "words").mapInArrow(place, "conv_id bigint, path binary, words array<bigint>, shard int")
    sorted_rows = placed.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    return sorted_rows.mapInArrow(finish, _OUT)


def end_digests(pieces: DataFrame) -> DataFrame:
    """``(node, ends)``: SHA-256 of each skeleton node's ids, its pieces taken in order one after the other."""
    def run(batches):
        at, sha = None, None
        for batch in batches:
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node != at:
                    if sha:
                        yield pa.RecordBatch.from_pydict({"node": pa.array([at], pa.int32()), "ends": [sha.hexdigest()]})
                    at, sha = node, hashlib.sha256(ends.encode())
                else:
                    sha.update(f",{ends}".encode())
        if sha:
            yield pa.RecordBatch.from_pydict({"node": pa.array([at], pa.int32()), "ends": [sha.hexdigest()]})
    ordered = pieces.select("node", "shard", "seq", "ends").repartition("node").sortWithinPartitions("node", "shard", "seq")
    return ordered.select("node", "ends").mapInArrow(run, "node int, ends string")


def roll_up(skeleton: Skeleton, partial: dict[int, dict], ends: dict[int, str]) -> list[tuple]:
    """Rows of the skeleton nodes: reduced partial sums, children added to their parents from the deepest on."""
    nodes = {i: dict(p) for i, p in partial.items()}
    for i in range(len(skeleton.parent) - 1, -1, -1):  # a parent comes before its children
        if i not in nodes:
            continue
        node = nodes[i]
        node["leaves"] = node["leaves"] or 1
        node["saved"] += (node["n"] - 1) * node["words"]
        up = nodes.get(skeleton.parent[i])
        if up is not None:
            up["min"] = node["min"] if up["min"] is None else min(up["min"], node["min"])
            up["n"] += node["n"]
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
    return [(i, v["min"], skeleton.depth[i], nodes[skeleton.parent[i]]["min"] if i else None, v["n"], v["children"], v["leaves"], v["saved"],
             ends.get(i)) for i, v in nodes.items()]


def prefix_trie(paths: DataFrame, shards: int | None = None, limit: int = SKELETON_BYTES) -> DataFrame:
    """A row per distinct prefix of the paths ``(conv_id, path, words)``, the root included.

    ``conv_id`` is the node's smallest member, ``parent_conv_id`` that of its parent (root: null); ``n_convs`` members,
    ``n_children`` children, ``n_leaves`` childless nodes of its subtree, ``saved_tokens`` the words of last turns that its subtree
    need not hold twice, ``ends_sha256`` the members that end here. An empty path is a member of the root only;
    equal paths end in one node; no path at all gives no rows, not even a root. Ids are taken to be unique."""
    spark = paths.sparkSession
    paths = cut(paths)
    total, turns = paths.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(turns or 0) // SHARD_TURNS))
    skeleton = Skeleton(splitters(paths, shards, total, limit))
    rows = cut(shard_nodes(paths, skeleton))
    reduced = rows.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("min"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"))
    partial = {r["node"]: r.asDict() for r in reduced.collect()}  # skeleton nodes only
    ends = {r["node"]: r["ends"] for r in end_digests(rows.where(F.col("kind") == IDS)).collect()}
    top = spark.createDataFrame(roll_up(skeleton, partial, ends), "node int, conv_id bigint, depth bigint, parent_conv_id bigint, "
                                "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string")
    below = rows.where(F.col("kind") == CHILD).drop("parent_conv_id").join(
        F.broadcast(top.select(F.col("node").alias("_up"), F.col("conv_id").alias("parent_conv_id"))), F.col("node") == F.col("_up"))
    digest = F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return top.select(*RESULT[:-1], digest).unionByName(below.select(*RESULT[:-1], digest)).unionByName(
        rows.where(F.col("kind") == DONE).select(*RESULT[:-1], digest))
