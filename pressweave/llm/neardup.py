"""Near-duplicate documents: MinHash with tensored banding, every candidate confirmed on the full sets.

Instead of one group of minhashes per table, ``collections`` small groups are hashed once and every *pair* of them
keys a table: 16 groups of 3 minhashes make 120 tables of 6. Two documents become candidates when at least two
groups agree. At a similarity of 0.8 that fails for one pair in about 5,500, at 0.85 for one in 80,000.

Before sets are compared, a pair has to pass a sketch: four bits of the least hash in each of 512 ranges. Every range
that differs takes a shingle that only one of the two sets has, so few ranges differ in similar sets.

Large buckets are not expanded into pairs: their members are first compared with the bucket's least document, and
only members that are still in different components are compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from .common import map_slices, pick, starts_of, words_of

COLLECTIONS, ROWS = 16, 3
SKETCH, PLANES = 512, 4
#: Up to so many keys (8 bytes each) are sent to all executors; more are shuffled.
BROADCAST_KEYS = 2_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: the different ``width``-word shingles of each text, sorted, as 64-bit hashes.

    A text with fewer words has its whole sequence as the only one; without words it has none."""
    words, counts = words_of(pc.ascii_lower(texts))
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    word = each[np.asarray(coded.indices)]
    factor = _odd(17, width)
    n = len(word)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(min(width, n)):
        total[:n - j] += word[j:] * factor[j]
    total = mixed(total)
    starts = starts_of(counts)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(total[a:b - width + 1]))
        elif b > a:
            short = (word[a:b] * factor[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([short])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    sizes = np.array([len(x) for x in out], dtype=np.int64)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), starts_of(sizes)


def digests(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(n, f1, f2)``: size and a 128-bit digest of each set."""
    n = np.diff(off)
    real = n > 0
    f1, f2 = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
    if len(hashes):
        f1[real] = np.add.reduceat(hashes, off[:-1][real])
        f2[real] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), off[:-1][real])
    return n, f1.view(np.int64), f2.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, t, n, f1, f2, c, k)``: the text's hash, set size and digest, the collections' hashes and the sketch."""
    factors = _odd(29, COLLECTIONS * ROWS)

    def body(part, texts):
        hashes, off = shingle_sets(texts, width)
        n, f1, f2 = digests(hashes, off)
        real = n > 0
        at = off[:-1][real]
        c = np.zeros((len(n), COLLECTIONS), dtype=np.uint64)
        if len(hashes):
            for k, factor in enumerate(factors):
                least = np.minimum.reduceat(hashes * factor, at)
                c[real, k // ROWS] = mixed(c[real, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel().view(np.int64)), x.shape[1]).cast(pa.list_(pa.int64()))
        return {"doc_id": part.column("doc_id"), "t": part.column("t"), "n": pa.array(n), "f1": pa.array(f1), "f2": pa.array(f2),
                "c": lists(c), "k": lists(sketches(hashes, off))}
    return map_slices(docs, body, "doc_id bigint, t bigint, n bigint, f1 bigint, f2 bigint, c array<bigint>, k array<bigint>")


def sketches(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """``PLANES`` bits of the least hash in each of ``SKETCH`` ranges, 0 for an empty range: plane after plane, as
    rows of 64-bit numbers."""
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    place = (hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    key = rows * SKETCH + place
    least = np.append(True, key[1:] != key[:-1])[:len(key)]  # hashes are sorted within a row
    bits = np.zeros((len(off) - 1, PLANES, SKETCH), dtype=np.uint8)
    for plane in range(PLANES):
        bits[rows[least], plane, place[least]] = (hashes[least] >> np.uint64(20 + plane)) & np.uint64(1)
    return np.packbits(bits.reshape(-1, PLANES * SKETCH), axis=1).view(np.uint64)


def alike(na: Column, ka: Column, nb: Column, kb: Column, percent: int) -> Column:
    """Whether sizes and sketches leave it possible that two sets are similar enough.

    Similar sets differ in at most ``(na + nb) * (1 - s) / (1 + s)`` shingles, so in as many ranges at most; this bound
    is exact. Large sets differ in ``1 - s`` of all ranges on average; five standard deviations are granted on top, by
    which one similar pair in millions is lost."""
    s, words = percent / 100, SKETCH // 64
    most = F.least((na + nb) * ((1 - s) / (1 + s)), F.lit((1 - s) * SKETCH + 5 * (s * (1 - s) * SKETCH) ** 0.5))
    differ = F.lit(0)
    for i in range(words):
        word = ka[i].bitwiseXOR(kb[i])
        for plane in range(1, PLANES):
            word = word.bitwiseOR(ka[plane * words + i].bitwiseXOR(kb[plane * words + i]))
        differ = differ + F.bit_count(word)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ <= most + 1e-6)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n, f1, f2, set)`` with all shingle hashes."""
    def body(part, texts):
        hashes, off = shingle_sets(texts, width)
        n, f1, f2 = digests(hashes, off)
        return {"doc_id": part.column("doc_id"), "n": pa.array(n), "f1": pa.array(f1), "f2": pa.array(f2),
                "set": pa.ListArray.from_arrays(pa.array(off, type=pa.int32()), pa.array(hashes.view(np.int64)))}
    return map_slices(docs, body, "doc_id bigint, n bigint, f1 bigint, f2 bigint, set array<bigint>")


def semi(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys`` (a written table of one column), by broadcast only below a counted size."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_semi")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                                                 F.size(F.array_intersect("sa", "sb")).alias("m"))
    return both.where(100 * F.col("m") >= percent * (F.col("na") + F.col("nb") - F.col("m"))).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets of ``width``-word shingles
    (words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z). ``component_id`` is the least key reachable.
    A null or empty text has an empty set and is linked with nothing; a null key is linked with nothing and has a
    null component. Rows are answered one by one, also where they share a key: each has the links of its own set."""
    return _answered(docs, doc_id, text, width, percent).drop("t")


def _answered(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """The rows of ``near_duplicates`` with ``t``, the hash of their text."""
    frame = pick(docs, doc_id, text).withColumn("t", F.xxhash64("text"))
    signed = cut(signatures(frame, width))
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")

    # equal sets are one class: a number in order of its least key, and the hashes that all its members have
    wide = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = cut(linked.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("least"), F.any_value("c").alias("c"), F.any_value("k").alias("k")).repartitionByRange(
        wide, "least").sortWithinPartitions("least", "n", "f1", "f2").withColumn("rep", F.monotonically_increasing_id()))
    reps = classes.select("rep", "n", "c", "k").repartition(wide)  # 120 keys a row follow: many small tasks

    pairs = [(i, j) for i in range(COLLECTIONS) for j in range(i + 1, COLLECTIONS)]
    keys = reps.select("rep", F.inline(F.array(*(F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.xxhash64(F.lit(i * COLLECTIONS + j), F.col("c")[i], F.col("c")[j]).alias("key"))
        for i, j in pairs))))
    buckets = cut(keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count(F.lit(1)).alias("many")).where("a < b"))
    large = cut(buckets.where("many > 2").select("key"))
    crowd = cut(semi(keys, large, "key"))
    stars = crowd.join(buckets.select("key", "a"), "key").where("rep <> a").select("a", F.col("rep").alias("b"))
    facts = cut(reps.select("rep", F.col("n").alias("size"), "c", "k"))

    def promising(some: DataFrame) -> DataFrame:
        a = facts.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.col("k").alias("ka"))
        b = facts.select(F.col("rep").alias("b"), F.col("size").alias("nb"), F.col("k").alias("kb"))
        return some.join(a, "a").join(b, "b").where(alike(F.col("na"), F.col("ka"), F.col("nb"), F.col("kb"), percent)).select("a", "b")

    tried = cut(promising(buckets.where("many = 2").select("a", "b").union(stars).distinct()))

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = some.select(F.col("a").alias("rep")).union(some.select("b")).distinct()
        wanted = cut(classes.join(wanted, "rep", "left_semi").select("rep", F.col("least").alias("doc_id"), "n", "f1", "f2"))
        full = full_sets(semi(frame, cut(wanted.select("doc_id").distinct()), "doc_id"), width)
        return cut(full.join(wanted, ["doc_id", "n", "f1", "f2"]).select("rep", "set").dropDuplicates(["rep"]))

    edges = cut(_confirm(tried, sets_of(tried), percent))
    parts = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("part"))

    # members of a bucket that are in different components after that are compared with each other
    seen = crowd.join(parts, "rep", "left").join(facts, "rep").select("key", "i", "j", "rep", "size", "c", "k", F.coalesce("part", "rep").alias("part"))
    per_part = seen.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))
    main = per_part.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("m", "part")).alias("x")).where("parts > 1").select(
        "key", F.col("x.part").alias("main"))
    open_ = cut(seen.join(main, "key"))
    x = open_.where("part <> main").select("key", "i", "j", *(F.col(n).alias(n[0] + "x") for n in ("rep", "part", "size", "c", "k")))
    y = open_.select("key", "main", *(F.col(n).alias(n[0] + "y") for n in ("rep", "part", "size", "c", "k")))
    agree = F.lit(0)
    for t in range(COLLECTIONS):
        agree = agree.bitwiseOR(F.when(F.col("cx")[t] == F.col("cy")[t], F.lit(1 << t)).otherwise(F.lit(0)))
    first = agree.bitwiseAND(F.expr("shiftleft(1, j) - 1")) == F.expr("shiftleft(1, i)")  # only the first table that has the pair reports it
    cross = x.join(y, (x["key"] == y["key"]) & (F.col("px") != F.col("py")) & ((F.col("py") == F.col("main")) | (F.col("rx") < F.col("ry")))
                   & first & alike(F.col("sx"), F.col("kx"), F.col("sy"), F.col("ky"), percent)).select(
        F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"))
    rest = cut(cut(cross).distinct().join(tried, ["a", "b"], "left_anti"))
    more = cut(_confirm(rest, sets_of(rest), percent))
    if not more.isEmpty():
        parts = connected_components(edges.union(more)).select(F.col("node").alias("rep"), F.col("component").alias("part"))

    least = parts.join(classes.select("rep", "least"), "rep").groupBy("part").agg(F.min("least").alias("component_id"))
    known = parts.join(least, "part").select("rep", "component_id")
    # written, so that the join is between plain shuffles and a class with very many members is split over tasks
    found = cut(classes.select("rep", "n", "f1", "f2", "least").join(known, "rep", "left").select(
        F.col("n").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("component_id", "least").alias("component_id")))
    out = signed.select("doc_id", "t", "n", "f1", "f2").join(found, (F.col("n") == F.col("_n")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(
        F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the least key. Other columns stay.

    Rows that share the least key of their group all stay; a row whose namesake goes stays if its own text does."""
    gone = _answered(docs, doc_id, text, width, percent).where("NOT kept").select(F.col("doc_id").alias("_gone"), F.col("t").alias("_t")).distinct()
    own = F.xxhash64(F.col(text).cast("string"))
    return docs.join(gone, (docs[doc_id].cast("bigint") == gone["_gone"]) & (own == gone["_t"]), "left_anti")
