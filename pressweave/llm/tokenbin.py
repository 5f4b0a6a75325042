"""Token-id output: concatenated ids with Elias-Fano coded document boundaries.

A *segment* is the ids of neighbouring documents behind each other plus their boundaries. Boundaries are
a rising sequence, so each is cut into low bits (stored plainly) and a high part (stored in unary): about
``2 + log2(ids / documents)`` bits a document. ``select`` finds the k-th boundary from sampled positions of
set bits, without a table of 64-bit offsets. Segments are rows of a Parquet table in ascending order of the
key, so executors write and read them on their own and a lost task is simply run again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, scratch_path
from .common import Memo, flat, gather, pick, slices, starts_of

SAMPLE = 64
SEGMENT = "part int, seq int, doc_ids array<bigint>, n_ids bigint, width int, ids binary, low_bits int, low binary, high binary, ranks binary"
IDS_BYTES = 4 << 20
#: Up to so many segment offsets (16 bytes each) are sent to all executors, so that ids need no second shuffle.
BROADCAST_SEGMENTS = 1_000_000


# ---- Elias-Fano -------------------------------------------------------------------

def ef_encode(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """``(low_bits, low, high, ranks)`` of a rising sequence of ends; ``ranks`` has every 64th set bit's place."""
    n = len(ends)
    universe = int(ends[-1]) if n else 0
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.int64)
    low = (ends[:, None] >> np.arange(low_bits)) & 1
    places = (ends >> low_bits) + np.arange(n)
    bits = np.zeros((int(places[-1]) + 1) if n else 0, dtype=np.uint8)
    bits[places] = 1
    pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return low_bits, pack(low), pack(bits), places[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, ranks: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high = np.frombuffer(low, dtype=np.uint8), np.frombuffer(high, dtype=np.uint8)
        self.ranks = np.frombuffer(ranks, dtype="<u4")

    def select(self, k: int) -> int:
        """The k-th end (from 0): at most 64 set bits are looked at."""
        place = int(self.ranks[k // SAMPLE])
        left = k % SAMPLE
        byte = place >> 3
        word = int(self.high[byte]) >> (place & 7) << (place & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = (byte << 3) + (word & -word).bit_length() - 1 - k
        low = 0
        for j in range(self.low_bits):
            bit = k * self.low_bits + j
            low |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << j
        return high << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every end at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (places - np.arange(self.n)) << self.low_bits | low


# ---- encoding ---------------------------------------------------------------------

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, dtype=bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut where the byte-level pre-tokenizer always cuts, and the number of units of each text.

    That is before a single space after something that is no white space, and between an ASCII letter and
    ASCII punctuation. Units are encoded one by one with the same ids as the whole text, so repeated ones
    need encoding once.
    """
    data, off = flat(texts)
    n = len(data)
    if not n:
        return pa.array([], type=pa.string()), np.zeros(len(texts), dtype=np.int64)
    before, after = data[:-1], data[1:]
    cut = np.zeros(n + 1, dtype=bool)
    follows = np.append(after[1:], 32)  # what comes after ``after``
    cut[1:n] = ((after == 32) & ~ASCII_SPACE[before] & ~ASCII_SPACE[follows] & ((before < 128) | (follows < 128))) \
        | (MARK[after] & LETTER[before])
    cut[off] = True
    places = np.flatnonzero(cut).astype(np.int32)
    counts = np.diff(np.searchsorted(places, off))
    return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data))), counts


class ByteBpe:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in names.items() if t[0] == "\u0120"]] = True  # the byte-level form of a space
        self.coded = Memo(self.encode_units)

    def encode_units(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units with one space, a leading one, are encoded some hundreds at a time: a token that starts with a space starts a unit."""
        line = np.array([p[0] == " " and p.count(" ") == 1 and not p[-1].isspace() for p in parts], dtype=bool)
        rows = np.flatnonzero(line)
        lines = ["".join(parts[i] for i in rows[k:k + 500].tolist()) for k in range(0, len(rows), 500)]
        ids, _ = self._batch(lines)
        sizes = np.zeros(len(parts), dtype=np.int64)
        sizes[rows] = np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        if line.all():
            return ids, starts_of(sizes)
        rest = np.flatnonzero(~line)
        other, off = self._batch([parts[i] for i in rest.tolist()])
        sizes[rest] = np.diff(off)
        out = np.empty(len(ids) + len(other), dtype=np.int32)
        spaced = np.repeat(line, sizes)
        out[spaced], out[~spaced] = ids, other
        return out, starts_of(sizes)

    def _batch(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.library.encode_batch_fast(parts, add_special_tokens=False)
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        ids = np.fromiter((i for c in coded for i in c.ids), dtype=np.int32, count=int(sizes.sum()))
        return ids, starts_of(sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, sizes, odd)``; texts marked odd hold a special token and are left to the caller."""
        import pyarrow.compute as pc

        odd = np.zeros(len(texts), dtype=bool)  # special tokens may span units: such texts are encoded whole
        for token in self.special:
            odd |= np.asarray(pc.match_substring(texts, token))
        if odd.any():
            texts = pc.if_else(pa.array(odd), "", texts)
        parts, counts = units(texts)
        coded = parts.dictionary_encode()
        ids, off = self.coded(coded.dictionary.to_pylist())
        out, sizes = gather(ids, off, np.asarray(coded.indices))
        return out, np.diff(starts_of(sizes)[starts_of(counts)]), odd


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_texts(path: str, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, ends)`` with ``end_id`` after every text."""
    bpe = loaded(path)
    ids, sizes, odd = bpe.encode(texts)
    if odd.any():
        rows = np.flatnonzero(odd)
        whole, off = bpe._batch([texts[int(i)].as_py() for i in rows])
        starts = starts_of(sizes)
        ids = np.insert(ids, np.repeat(starts[rows], np.diff(off)), whole)
        sizes[rows] = np.diff(off)
    if end_id is not None:
        ids = np.insert(ids, starts_of(sizes)[1:], end_id)
        sizes = sizes + 1
    return ids, starts_of(sizes)


def _segment(part: int, seq: int, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> dict:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    low_bits, low, high, ranks = ef_encode(ends)
    return {"part": part, "seq": seq, "doc_ids": doc_ids, "n_ids": len(ids), "width": width,
            "ids": ids.astype(f"<u{width}").tobytes(), "low_bits": low_bits, "low": low, "high": high, "ranks": ranks}


def segments(docs: DataFrame, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Segments of all documents in ascending order of ``doc_id`` (nulls first, ties by text).

    One range shuffle of the texts; each task encodes its range slice by slice and emits segments of about 4 MB."""
    ordered = pick(docs, doc_id, text).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()),
                        ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()),
                        ("high", pa.binary()), ("ranks", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        keys, chunks, sizes, held = [], [], [], 0
        for batch in batches:
            for some, texts in slices(batch, "text"):
                ids, ends = encode_texts(tokenizer, texts, end_id)
                keys += some.column("doc_id").to_pylist()
                chunks.append(ids)
                sizes.append(np.diff(ends))
                held += 4 * len(ids)
                if held >= IDS_BYTES:
                    row = _segment(part, seq, keys, np.concatenate(chunks), starts_of(np.concatenate(sizes))[1:])
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                    keys, chunks, sizes, held, seq = [], [], [], 0, seq + 1
        if keys:
            row = _segment(part, seq, keys, np.concatenate(chunks), starts_of(np.concatenate(sizes))[1:])
            yield pa.RecordBatch.from_pylist([row], schema=schema)
    return ordered.mapInArrow(run, SEGMENT)


def read_documents(table: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, from a segment table.

    ``start`` counts the ids of all documents before. Id totals are summed per task of the writer first, so the
    running sum over those goes over one row per task; the second sum runs inside each task's segments."""
    from pyspark.sql import Window

    sums = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = sums.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    heads = table.select("part", "seq", "n_ids").join(bases, F.col("part") == F.col("p"))
    heads = heads.select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("base") + F.sum("n_ids").over(
        Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("base"))
    heads = cut(heads)  # a row per segment of about 4 MB
    if heads.count() <= BROADCAST_SEGMENTS:
        heads = F.broadcast(heads)
    full = table.join(heads, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).drop("p", "s")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_ids"])
                ends = EliasFano(n, row["low_bits"], row["low"], row["high"], row["ranks"]).all()
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}")
                raw = memoryview(ids.astype("<u4").tobytes())
                starts = np.append(0, ends[:-1])
                out = {"doc_id": pa.array(row["doc_ids"], type=pa.int64()), "start": pa.array(starts + row["base"]),
                       "n_tokens": pa.array(ends - starts),
                       "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                                             type=pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), type=pa.int32()),
                                                          pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)
    return full.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
                           + (", ids array<int>" if with_ids else ""))


def write_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, doc_id: str = "doc_id",
                    text: str = "text") -> None:
    """Encode every document and write the segments under ``path`` (any store Spark can write to)."""
    segments(docs, tokenizer, end_id, doc_id, text).write.parquet(path)


def binary_round_trip(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents and read them back: ``(doc_id, start, n_tokens, ids_crc32)``.

    Null and empty texts have only the end id. Rows with the same key stand in order of their texts; a null key
    comes first. An empty table gives no rows."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_documents(docs, tokenizer, path, end_id, doc_id, text)
    return read_documents(spark.read.schema(SEGMENT).parquet(path))
