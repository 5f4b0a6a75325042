"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of byte strings up to ``order``. A byte's code length under a language starts
at the longest context seen there; a byte not seen in it costs an escape (as often as the context has different
followers) and the next shorter context is asked, without the bytes already ruled out. Statistics are frozen
after training, so the code length of a text is a sum over its byte windows: each window's lengths under all
languages are worked out once and looked up afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, map_slices, slices

PIECE = 1 << 20
CACHE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray, offsets: np.ndarray, order: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The last ``order + 1`` bytes at each place of ``[start, stop)`` as one number; zeros stand before a text."""
    stop = len(data) if stop is None else stop
    left = max(0, start - order)
    bytes_ = data[left:stop].astype(np.uint64)
    keys = np.zeros(stop - start, dtype=np.uint64)
    for k in range(order + 1):
        lo = start - left - k
        part = bytes_[max(lo, 0):len(bytes_) - k]
        keys[len(keys) - len(part):] |= part << np.uint64(8 * k)
    for j in range(order):  # places so near the start of a text that the window reaches over it
        at = offsets[:-1][offsets[1:] - offsets[:-1] > j] + j
        at = at[(at >= start) & (at < stop)] - start
        keys[at] &= np.uint64((1 << 8 * (j + 1)) - 1)
    return keys


class Trees:
    """Frozen statistics of all languages: from ``(language number, window, count)``."""

    def __init__(self, names: list[str], language: np.ndarray, window: np.ndarray, count: np.ndarray, order: int):
        self.names, self.order = names, order
        self.levels = []
        for i in range(len(names)):
            mine = language == i
            levels = []
            for k in range(order + 1):
                grams = window[mine] & np.uint64((1 << 8 * (k + 1)) - 1)
                keys, place = np.unique(grams, return_inverse=True)
                counts = np.bincount(place, weights=count[mine], minlength=len(keys)).astype(np.float64)
                contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
                total = np.bincount(place, weights=counts, minlength=len(contexts))
                kinds = np.bincount(place, minlength=len(contexts)).astype(np.float64)
                if k:  # what the next shorter context counts for the followers seen here: left out after an escape
                    at = np.searchsorted(levels[k - 1][0], keys & np.uint64((1 << 8 * k) - 1))
                    seen = np.bincount(place, weights=levels[k - 1][1][at], minlength=len(contexts))
                else:
                    seen = np.zeros(len(contexts))
                levels.append((keys, counts, contexts, np.stack([total, kinds, seen], axis=1)))
            self.levels.append(levels)

    def lengths(self, window: np.ndarray) -> np.ndarray:
        """Code lengths in nats, one column per language."""
        out = np.zeros((len(window), len(self.names)))
        for i, levels in enumerate(self.levels):
            cost = np.zeros(len(window))
            gone = np.zeros(len(window))   # counts ruled out in the present context
            ruled = np.zeros(len(window))  # different bytes ruled out
            left = np.arange(len(window))
            for k in range(self.order, -1, -1):
                keys, counts, contexts, facts = levels[k]
                if not len(left) or not len(keys):
                    continue
                gram = window[left] & np.uint64((1 << 8 * (k + 1)) - 1)
                context = gram >> np.uint64(8)
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                known = contexts[at] == context
                total, kinds, seen = facts[at].T
                fresh = kinds - ruled[left]
                whole = total - gone[left] + fresh
                there = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
                hit = keys[there] == gram
                cost[left[hit]] += np.log(whole[hit]) - np.log(counts[there[hit]])
                miss = known & ~hit
                pays = miss & (fresh > 0)
                cost[left[pays]] += np.log(whole[pays]) - np.log(fresh[pays])
                gone[left[miss]], ruled[left[miss]] = seen[miss], kinds[miss]
                left = left[~hit]
            cost[left] += np.log(np.maximum(256 - ruled[left], 1))
            out[:, i] = cost
        return out


class Scorer:
    """Looks windows up in an open-addressing table that grows with what it meets, up to ``CACHE`` windows."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.bits = 22
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rows = np.zeros(1 << self.bits, dtype=np.int32)
        self.table = np.zeros((0, len(trees.names)))

    def _find(self, window: np.ndarray) -> np.ndarray:
        """Row of each window, -1 where it is not there."""
        slot = (window * MULTIPLIER) >> np.uint64(64 - self.bits)
        found = self.keys[slot]
        row = np.where(found == window, self.rows[slot], -1)
        open_ = np.flatnonzero((found != window) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        slot = slot[open_]
        while len(open_):
            slot = (slot + np.uint64(1)) & np.uint64((1 << self.bits) - 1)
            found = self.keys[slot]
            hit = found == window[open_]
            row[open_[hit]] = self.rows[slot[hit]]
            go = ~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))
            open_, slot = open_[go], slot[go]
        return row

    def _add(self, window: np.ndarray, first_row: int) -> None:
        rest = np.arange(len(window))
        slot = (window * MULTIPLIER) >> np.uint64(64 - self.bits)
        while len(rest):
            free = self.keys[slot[rest]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[rest[free]], return_index=True)
            put = rest[free][one]
            self.keys[slot[put]] = window[put]
            self.rows[slot[put]] = first_row + put
            rest = np.setdiff1d(rest, put, assume_unique=True)
            slot[rest] = (slot[rest] + np.uint64(1)) & np.uint64((1 << self.bits) - 1)

    def lengths(self, window: np.ndarray) -> np.ndarray:
        row = self._find(window)
        missing = np.flatnonzero(row < 0)
        table = self.table
        if len(missing):
            new, place = np.unique(window[missing], return_inverse=True)
            table = np.concatenate([table, self.trees.lengths(new)])
            row[missing] = len(self.table) + place
            room = CACHE - len(self.table)
            if room > 0:
                self._add(new[:room], len(self.table))
                self.table = table[:len(self.table) + min(room, len(new))]
        return table[row]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Summed code lengths of each text."""
        out = np.zeros((len(offsets) - 1, len(self.trees.names)))
        for start in range(0, len(data), PIECE):
            stop = min(len(data), start + PIECE)
            nats = self.lengths(windows(data, offsets, self.trees.order, start, stop))
            first = int(np.searchsorted(offsets, start, side="right")) - 1
            last = int(np.searchsorted(offsets, stop, side="left"))
            rows = np.arange(first, last)
            rows = rows[offsets[rows + 1] > offsets[rows]]
            begins = np.maximum(offsets[rows], start) - start
            out[rows] += np.add.reduceat(nats, begins, axis=0)
        return out


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", order: int = 3,
          docs_per_language: int = 1500, seed: int = 11) -> Trees:
    """Context trees from a bounded sample: about ``docs_per_language`` rows of each language, picked by a hash of the key.

    Rows without language or text are not learned from. Executors count the windows; what reaches the driver is
    bounded by the sample."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang)).count().collect()}
    names = sorted(sizes)
    if not names:
        return Trees([], *(np.zeros(0, dtype=np.uint64) for _ in range(3)), order)
    total = len(names)
    limit = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, docs_per_language / sizes[n])))])
    known = known.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), F.pmod(
        F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(1 << 30)).alias("h")).where(F.col("h") < limit[F.col("lang")] * (1 << 30))

    def count(batches):
        for batch in batches:
            for part, texts in slices(batch, "text", 2 << 20):
                data, off = flat(texts)
                grams = windows(data, off, order)
                who = np.repeat(np.searchsorted(names, np.array(part.column("lang").to_pylist())), np.diff(off))
                for i in range(total):
                    keys, n = np.unique(grams[who == i], return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_pydict({
                            "language": np.full(len(keys), i, dtype=np.int32), "gram": keys.astype(np.int64), "n": n.astype(np.int64)})

    counts = known.select("lang", "text").mapInArrow(count, "language int, gram bigint, n bigint")
    got = counts.groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    return Trees(names, got["language"].to_numpy(), got["gram"].to_numpy().astype(np.uint64), got["n"].to_numpy(), order)


def identify(docs: DataFrame, trees: Trees, doc_id: str = "doc_id", text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, lang_pred, score, *keep)``: the language with the shortest code of the whole text and its posterior.

    A null text, and one without any letter, is ``und`` with score 0. Equal code lengths go to the first name in
    order. Repeated rows stay; without learned languages everything is ``und``."""
    spark, keep = docs.sparkSession, keep or {}
    shared = spark.sparkContext.broadcast(trees)
    frame = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"),
                        F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("readable"),
                        *(c.alias(n) for n, c in keep.items()))
    extra = [f.simpleString().split(":", 1) for f in frame.schema.fields[3:]]
    cache: list = []
    kept = list(keep)

    def body(part, texts):
        if not cache:
            cache.append(Scorer(shared.value))
        scorer = cache[0]
        readable = np.asarray(part.column("readable"))
        names = scorer.trees.names
        if names:
            nats = scorer.texts(*flat(texts))
            best = nats.argmin(axis=1)
            chance = 1 / np.exp(np.minimum(nats.min(axis=1, keepdims=True) - nats, 0)).sum(axis=1)
            label = [names[b] if r else "und" for b, r in zip(best.tolist(), readable.tolist())]
            score = np.where(readable, chance, 0.0)
        else:
            label, score = ["und"] * len(texts), np.zeros(len(texts))
        return {"doc_id": part.column("doc_id"), "lang_pred": label, "score": score,
                **{n: part.column(n) for n in kept}}
    return map_slices(frame, body, "doc_id bigint, lang_pred string, score double"
                      + "".join(f", {n} {t}" for n, t in extra))
