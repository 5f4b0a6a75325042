"""What the operators of this package share: bounded slices of Arrow text columns and flat byte views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20

#: Bytes that the regex class ``[\x20\x09-\x0D]`` names.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a null-free string array; offsets start at 0."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of ``batch`` with at most ``limit`` bytes of text (a single longer text is a part of its own)."""
    at = batch.schema.get_field_index(name)
    text = plain(batch.column(at))
    ends = np.cumsum(np.asarray(pc.binary_length(text)), dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start), text.slice(start, stop - start)
        start = stop


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many set bytes of ``mask`` lie in each row."""
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All ``[^\\x20\\x09-\\x0D]+`` words of a null-free column in order, and how many each row has."""
    lists = pc.ascii_split_whitespace(column)
    words = lists.flatten()
    row = np.asarray(pc.list_parent_indices(lists))
    real = np.asarray(pc.binary_length(words)) > 0
    if not real.all():
        words, row = words.filter(pa.array(real)), row[real]
    return words, np.bincount(row, minlength=len(column)).astype(np.int64)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Running offsets (one more than rows) for row lengths."""
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gather(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``which`` of a ragged array, one after the other, and their lengths."""
    sizes = np.diff(offsets)[which]
    starts = starts_of(sizes)
    at = np.arange(starts[-1]) + np.repeat(offsets[:-1][which] - starts[:-1], sizes)
    return values[at], sizes


class Memo:
    """Keeps what ``encode(words) -> (ids, offsets)`` gave for the first ``limit`` different words of this process.

    Frequent words come early; once full, other words are encoded anew in each slice, with the same result."""

    def __init__(self, encode: Callable, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.at: dict[str, int] = {}
        self.ids, self.off = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        which = np.array([self.at.get(w, -1) for w in words], dtype=np.int64)
        missing = np.flatnonzero(which < 0)
        new = [words[i] for i in missing.tolist()]
        ids, off = self.encode(new) if new else (np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))
        which[missing] = len(self.at) + np.arange(len(new))
        all_ids = np.concatenate([self.ids, ids.astype(np.int32)])
        all_off = np.concatenate([self.off, self.off[-1] + off[1:]])
        room = min(len(new), self.limit - len(self.at))
        if room > 0:
            self.at.update(zip(new[:room], range(len(self.at), len(self.at) + room)))
            self.ids, self.off = all_ids[:all_off[len(self.at)]].copy(), all_off[:len(self.at) + 1].copy()
        out, sizes = gather(all_ids, all_off, which)
        return out, starts_of(sizes)


def map_slices(df: DataFrame, body: Callable, schema: str, text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over bounded slices: ``body(part, texts) -> dict of columns``."""
    def run(batches):
        for batch in batches:
            for part, column in slices(batch, text, limit):
                yield pa.RecordBatch.from_pydict(body(part, column))
    return df.mapInArrow(run, schema)


def pick(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, under fixed names: other columns of the input can't clash with ours."""
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def remainder(key: Column, n: int) -> Column:
    """``crc32(key as text) mod n``; a null key counts as the text ``null``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null"))) % n


def hash_sample(df: DataFrame, key: str, wanted: int, total: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, picked by a hash of ``key``: the same rows at any partitioning."""
    if total <= wanted:
        return df
    limit = int(wanted / total * (1 << 40))
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) < limit)


#: A side table is broadcast up to so many bytes (its key's text and 64 bytes a row).
BROADCAST_BYTES = 64 << 20
SALTS = 64


def attach(left: DataFrame, right: DataFrame, key: str, salt: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` with the other columns of ``right`` (one row per ``key``, null a key too).

    ``right`` is broadcast if its counted bytes are within ``limit``; beyond that the rows of one key are dealt
    over ``SALTS`` tasks by a hash of the column ``salt``, so that a key with a third of all rows isn't one task."""
    right = right.withColumnRenamed(key, "_k")
    size = right.agg(F.sum(F.coalesce(F.octet_length(F.col("_k").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    if size <= limit:
        return left.join(F.broadcast(right), left[key].eqNullSafe(F.col("_k")), "left").drop("_k")
    left = left.withColumn("_s", F.pmod(F.xxhash64(F.lit(7), salt), F.lit(SALTS)))
    right = right.withColumn("_s2", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return left.join(right, left[key].eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_s2")), "left").drop("_k", "_s", "_s2")


def word_count(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
