"""Product codes of integer vectors with exact, reproducible codebooks.

Vectors are cut into parts; every part position has a codebook whose entries are moved a fixed number of rounds.
Rows are kept as blocks: each dimension of a block has a dictionary of its distinct integers, and the block
holds only codes into it. To assign a block, the squared differences of every dictionary value to all entries are tabulated; the
distance of a part is then a gather and an add per dimension over the codes. Sums for the next codebook are counts of
(entry, code) times the dictionary, so everything is whole numbers and the order of rows does not matter.

The driver holds codebooks and their sums (entries x dimensions); blocks are at most ``BLOCK`` rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_BYTES, attach, starts_of

BLOCK = 4096
#: Integers beyond this count as this, so that squared distances fit in 64 bits up to 2,000 dimensions.
MOST = 1 << 25


def whole_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``(vec_id, label, v)``: ``floor(scale * x)`` per component, without rows that are or hold null or non-finite."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    near = F.transform(x, lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * F.lit(float(scale)))))
    return table.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
                                                              F.transform(near, lambda c: F.floor(c)).alias("v"))


def part_ends(dims: int, parts: int) -> list[int]:
    """Borders of ``parts`` consecutive parts, equal if ``dims`` can be divided."""
    return [p * dims // parts for p in range(parts + 1)]


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of rows: ids and labels as lists, per dimension a dictionary (``sizes``, ``values``) and the rows' codes."""
    id_type, label_type = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                n = some.num_rows
                m = np.asarray(some.column("v").flatten(), dtype=np.int64).reshape(n, dims)
                found = [np.unique(m[:, d], return_inverse=True) for d in range(dims)]
                values = np.concatenate([u for u, _ in found] or [np.zeros(0, np.int64)])
                codes = np.concatenate([c.reshape(-1) for _, c in found] or [np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.ListArray.from_arrays([0, n], some.column("vec_id")),
                    "labels": pa.ListArray.from_arrays([0, n], some.column("label")),
                    "sizes": pa.array([np.array([len(u) for u, _ in found], dtype="<i4").tobytes()], pa.binary()),
                    "dictionary": pa.array([values.astype("<i8").tobytes()], pa.binary()),
                    "codes": pa.array([codes.astype("<u2").tobytes()], pa.binary())})
    return rows.select("vec_id", "label", "v").mapInArrow(
        run, f"ids array<{id_type}>, labels array<{label_type}>, sizes binary, dictionary binary, codes binary")


class Block:
    """One block's dictionaries and codes."""

    def __init__(self, n: int, sizes: bytes, dictionary: bytes, codes: bytes):
        self.off = starts_of(np.frombuffer(sizes, "<i4").astype(np.int64))
        self.values = np.frombuffer(dictionary, "<i8")
        self.codes = np.frombuffer(codes, "<u2").reshape(len(self.off) - 1, n)
        self.n = n

    def dim(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        return self.values[self.off[d]:self.off[d + 1]], self.codes[d]

    def nearest(self, book: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of a part that starts at dimension ``first`` (ties to the lower), and its distance."""
        distance = np.zeros((self.n, len(book)), dtype=np.int64)
        for j in range(book.shape[1]):
            values, codes = self.dim(first + j)
            table = (values[:, None] - book[None, :, j]) ** 2
            distance += table[codes]
        best = distance.argmin(axis=1)
        return best, distance[np.arange(self.n), best]

    def sums(self, best: np.ndarray, entries: int, first: int, width: int) -> np.ndarray:
        """``[entry, position]`` sums of the part over the rows of each entry."""
        out = np.zeros((entries, width), dtype=np.int64)
        for j in range(width):
            values, codes = self.dim(first + j)
            seen = np.bincount(best * len(values) + codes, minlength=entries * len(values)).reshape(entries, len(values))
            out[:, j] = seen @ values
        return out


def _read(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        yield ids, batch.column("labels")[i].values, Block(len(ids), *(batch.column(c)[i].as_py() for c in ("sizes", "dictionary", "codes")))


def moved(table: DataFrame, books: list[np.ndarray], ends: list[int]) -> list[np.ndarray]:
    """The codebooks after one round: every entry the floor of the mean of its parts, unused ones as they were."""
    entries = len(books[0])

    def run(batches):
        count = np.zeros((len(books), entries), dtype=np.int64)
        total = [np.zeros(b.shape, dtype=np.int64) for b in books]
        for batch in batches:
            for _, _, block in _read(batch):
                for p, book in enumerate(books):
                    best, _ = block.nearest(book, ends[p])
                    count[p] += np.bincount(best, minlength=entries)
                    total[p] += block.sums(best, entries, ends[p], book.shape[1])
        for p, book in enumerate(books):
            used = np.flatnonzero(count[p])
            if len(used):
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(used), p, np.int32)), "entry": pa.array(used.astype(np.int32)),
                                                  "n": pa.array(count[p][used]), "s": pa.array(list(total[p][used]), pa.list_(pa.int64()))})
    width = max(b.shape[1] for b in books)
    sums = table.mapInArrow(run, "part int, entry int, n bigint, s array<bigint>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(j))) for j in range(width))).alias("s"))
    out = [b.copy() for b in books]
    for row in sums.collect():  # a row per part and entry
        for j in range(out[row["part"]].shape[1]):
            out[row["part"]][row["entry"], j] = row["s"][j] // row["n"]
    return out


def codebooks(rows: DataFrame, table: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """Entries start as the parts of the ``entries`` smallest ids (ties by vector, null ids last)."""
    ends = part_ends(dims, parts)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    first = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), dims)
    books = [first[:, a:b].copy() for a, b in zip(ends, ends[1:])]
    for _ in range(rounds):
        books = moved(table, books, ends)
    return books


def encode(table: DataFrame, books: list[np.ndarray], ends: list[int], id_type: str, label_type: str) -> DataFrame:
    """``(vec_id, label, code, error)`` of every row of the blocks: entry numbers in hex, squared distances summed over parts."""
    def run(batches):
        for batch in batches:
            for ids, labels, block in _read(batch):
                found = [block.nearest(book, ends[p]) for p, book in enumerate(books)]
                codes = np.stack([best.astype(np.uint8) for best, _ in found], axis=1).tobytes().hex()
                w = 2 * len(books)
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "label": labels, "code": [codes[i:i + w] for i in range(0, len(codes), w)],
                                                  "error": pa.array(sum(d for _, d in found))})
    return table.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error bigint")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id",
                 vector: str = "embedding", label: str = "label", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every row whose vector is whole and finite.

    ``entries`` is at most 256. Null labels are one label. Rows with the same id are coded one by one. Vectors are as long as that of
    the smallest id; rows of another length come with null code and error. With fewer rows than entries the codebooks are
    that much smaller; a table without such a row gives none."""
    rows = whole_vectors(vectors, vec_id, vector, label, scale)
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    id_type, label_type = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = f"vec_id {id_type}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if head is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, fitting = head[0], F.size("v") == head[0]
    rows = cut(rows)
    table = cut(blocks(rows.where(fitting), dims))
    books = codebooks(rows.where(fitting), table, dims, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    coded = encode(table, books, part_ends(dims, parts), id_type, label_type)
    coded = cut(coded.unionByName(rows.where(~fitting).select("vec_id", "label", F.lit(None).cast("string").alias("code"),
                                                              F.lit(None).cast("bigint").alias("error"))))
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return attach(coded, by_label, "label", "vec_id", limit).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
