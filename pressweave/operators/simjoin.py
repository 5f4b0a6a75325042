"""Exact similarity joins over vectors as pairs of bounded blocks.

Rows are indexed into chunks of about ``block`` rows (see :mod:`pressweave.operators.vectorindex`); every pair of
chunks that can hold a result is one task that does one matrix product and keeps a bounded number of results per
row (the k best) or block (the best pairs, the extremes). A group that holds a third of all rows becomes more tasks, not a
larger one, and no task ever emits all of its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .vectorindex import COPIES, SIDE, SLACK, VectorIndex, chunk_bound, chunk_pairs, radius

BLOCK = 2048
#: Pairs of blocks in a grid without pivots, where blocks of ``SIDE`` rows need no more.
TASKS = 128


# ---- column helpers ---------------------------------------------------------------

def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for empty, mismatched or zero vectors."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(
        F.coalesce(dot(a, b) / F.nullif(norm, F.lit(0.0)), F.lit(0.0)))


# ---- block bodies -----------------------------------------------------------------

def matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(n > 0, n, 1.0)[:, None]


def same_length(left: pd.DataFrame, right: pd.DataFrame):
    """Split two frames by vector length: vectors of different lengths never match."""
    ll, rl = left["vec"].map(len), right["vec"].map(len)
    for n in sorted(set(ll) & set(rl)):
        if n:
            yield left[ll == n].reset_index(drop=True), right[rl == n].reset_index(drop=True)


NEIGHBOURS = "grp string, id bigint, nbr bigint, sim double"


def stacked(frames: list[pd.DataFrame], *names: str) -> pd.DataFrame:
    """The frames as one; group names stay objects, also where there is no row (Arrow can't type them otherwise)."""
    return (pd.concat(frames) if frames else pd.DataFrame(columns=names)).astype({"grp": object})


#: Similarities held at once in a task.
CELLS = 1 << 22


def _top_k(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest per row; ties by id."""
    order = np.argsort(ids, kind="stable")
    sim = sim[:, order]
    if k >= sim.shape[1]:
        r, c = np.indices(sim.shape)
        return r.ravel(), order[c.ravel()]
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k][:, None]
    kept = sim >= least
    many = np.flatnonzero(kept.sum(axis=1) > k)
    if len(many):
        s, low = sim[many], least[many]
        above, even = s > low, s == low
        kept[many] = above | (even & (np.cumsum(even, axis=1) <= k - above.sum(axis=1)[:, None]))
    r, c = np.nonzero(kept)
    return r, order[c]


#: Rows and columns of a tile that is weighed at once in single precision; the first tiles of a run of rows are smaller.
RUN = 512
TILE = 2048
FIRST = 256


def single_slack(n: int) -> float:
    """No less than the error of a cosine of ``n`` components in single precision."""
    return 1e-5 + 2e-7 * n


def _best_of(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int):
    """The ``k`` greatest per row, ties by column, in the order of the rows; and which of them are the last of ``k``."""
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    nth = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
    ok = nth < k
    return r[ok], c[ok], s[ok], nth[ok] == k - 1


def nearest_rows(ua: np.ndarray, ub: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray, ban=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``ua``, rows of ``ub`` and their cosines: for each unit row of ``ua`` the ``k`` nearest of ``ub`` (with ``ids``), ties by id.

    What lies clearly below ``least`` (one bound a row) may be left out. Single precision finds the few pairs that can be among the best
    of what was seen so far; these alone are weighed in double precision. ``ban(rows, columns)`` names pairs that don't count."""
    order = np.argsort(ids, kind="stable")
    ub = ub[order]
    fb, slack = np.ascontiguousarray(ub.astype(np.float32).T), single_slack(ua.shape[1])
    edges, at = [], 0
    while at < len(ub):
        edges.append((at, min(len(ub), at + min(TILE, max(FIRST, at)))))
        at = edges[-1][1]
    out = []
    for i in range(0, len(ua), RUN):
        a = ua[i:i + RUN]
        fa, low = a.astype(np.float32), np.array(least[i:i + RUN], dtype=np.float64)
        kept, more, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
        for lo, hi in edges:
            sim, width = fa @ fb[:, lo:hi], hi - lo
            hit = np.flatnonzero(sim >= (low - slack).astype(np.float32)[:, None])
            if len(hit) * 8 > sim.size:  # copies, or no bound yet: a dense product costs less
                d = a @ ub[lo:hi].T
                if ban is not None:
                    r, c = np.divmod(np.arange(d.size), width)
                    d[ban(r + i, order[c + lo]).reshape(d.shape)] = -np.inf
                r, c = _top_k(d, np.arange(width), k)
                ok = np.isfinite(d[r, c])
                r, c = r[ok], c[ok] + lo
            else:
                r, c = np.divmod(hit, width)
                c += lo
                if ban is not None:
                    ok = ~ban(r + i, order[c])
                    r, c = r[ok], c[ok]
            if not len(r):
                continue
            more.append((r, c, np.einsum("ij,ij->i", a[r], ub[c])))
            waiting += len(r)
            if waiting >= len(a) * k or hi == edges[-1][1]:
                *kept, full = _best_of(*(np.concatenate(x) for x in zip(kept, *more)), k)
                low[kept[0][full]] = np.maximum(low[kept[0][full]], kept[2][full])
                more, waiting = [], 0
        if more:
            *kept, _ = _best_of(*(np.concatenate(x) for x in zip(kept, *more)), k)
        out.append((kept[0] + i, order[kept[1]], kept[2]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def by_group(left: pd.DataFrame, right: pd.DataFrame):
    """The two sides of every group that both have."""
    if len(left) and len(right) and left["grp"].nunique() == 1 and right["grp"].nunique() == 1:
        if left["grp"].iloc[0] == right["grp"].iloc[0]:
            yield left, right
        return
    theirs = right.groupby("grp", sort=False).indices
    for g, at in left.groupby("grp", sort=False).indices.items():
        if g in theirs:
            yield left.iloc[at], right.iloc[theirs[g]]


def block_knn(lt: DataFrame, rt: DataFrame, k: int, min_sim: float, strict: bool, self_join: bool, earlier: bool) -> DataFrame:
    """The ``k`` best of every pair of blocks ``(lc, rc)`` in the same group, per left row.

    Left rows may carry ``_kth``: a similarity that ``k`` right rows are known to reach."""
    known = "_kth" in lt.columns
    rt = rt.select(*[F.col(c).alias(f"r_{c}") for c in rt.columns])  # both sides may be the same frame

    def best(_key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x, y in by_group(l, r.rename(columns=lambda c: c[2:])):
            for a, b in same_length(x, y):
                ai, bi, g = a["id"].to_numpy(), b["id"].to_numpy(), a["grp"].iloc[0]
                ao, bo = (a["ord"].to_numpy(), b["ord"].to_numpy()) if earlier else (None, None)

                def ban(r, c):
                    own = ai[r] == bi[c] if self_join else np.zeros(len(r), dtype=bool)
                    return own | (bo[c] >= ao[r]) if earlier else own
                least = np.full(len(a), float(min_sim))
                if known:
                    least = np.fmax(least, a["_kth"].to_numpy(float))
                r, c, s = nearest_rows(unit_rows(matrix(a["vec"])), unit_rows(matrix(b["vec"])), bi, k, least, ban if self_join or earlier else None)
                keep = s > min_sim if strict else s >= min_sim
                out.append((g, ai[r[keep]], bi[c[keep]], s[keep]))
        if not out:
            return stacked([], "grp", "id", "nbr", "sim")
        sizes = [len(s) for *_, s in out]
        return stacked([pd.DataFrame({"grp": np.repeat(np.array([g for g, *_ in out], object), sizes), "id": np.concatenate([i for _, i, _, _ in out]),
                                      "nbr": np.concatenate([j for _, _, j, _ in out]), "sim": np.concatenate([s for *_, s in out])})])

    return lt.groupBy("lc", "rc").cogroup(rt.groupBy("r_lc", "r_rc")).applyInPandas(best, NEIGHBOURS)


def ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("grp", "id").orderBy(F.col("sim").desc(), "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def index_knn(left: DataFrame, index: VectorIndex, k: int = 10, min_sim: float = 0.67, strict: bool = True, self_join: bool = False,
              earlier: bool = False, probes: int | None = None) -> DataFrame:
    """``grp, id, nbr, sim, rank``: the ``k`` most similar rows of an index for each left row above ``min_sim``.

    Exact without ``probes``: the best of a row's own cell give it an angle beyond which no chunk is looked at. With
    ``probes`` only that many nearest cells are."""
    cols = ["grp", "id", "vec", *(["ord"] if earlier else [])]
    left = left.select(*cols)

    def near(n):
        lt, rt = index.probe(left, n)
        return ranked(block_knn(lt, rt.select(*cols, "lc", "rc"), k, min_sim, strict, self_join, earlier), k)
    if probes is not None:
        return near(probes)
    own = VectorIndex.build(left, index.block, index.pivots)
    reach = None
    if index.pivots:
        kth = cut(near(1).where(F.col("rank") == k).select(F.col("grp").alias("_g"), F.col("id").alias("_i"), F.col("sim").alias("_kth")))
        rows = own.rows.join(kth, (F.col("grp") == F.col("_g")) & (F.col("id") == F.col("_i")), "left").drop("_g", "_i")
        own = VectorIndex(rows, own.chunks, None, own.pivots, own.block)
        reach = F.least(F.lit(radius(min_sim)), F.coalesce(F.acos(F.greatest(F.lit(-1.0), F.least("_kth", F.lit(1.0)))) + SLACK, F.lit(10.0)))
    lt, rt = own.grid(index, min_sim, reach)
    known = [c for c in lt.columns if c == "_kth"]
    return ranked(block_knn(lt.select(*cols, *known, "lc", "rc"), rt.select(*cols, "lc", "rc"), k, min_sim, strict, self_join, earlier), k)


def grid(left: DataFrame, right: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides per pair of blocks ``(lc, rc)``, all pairs. About ``TASKS`` pairs of blocks, so cut that the fewest
    copies of rows are made: a short side is sent to many parts of a long one, whose rows are sent but once or twice."""
    m, n = max(left.count(), 1), max(right.count(), 1)
    parts = [min(math.ceil(max(p / SIDE, (TASKS * p / q) ** 0.5)), math.ceil(p / block)) for p, q in ((m, n), (n, m))]

    def dealt(rows, own, k, theirs, copies):
        rows = rows.where(F.size("vec") > 0).withColumn(own, F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(k)).cast("int"))
        return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    return dealt(left, "lc", parts[0], "rc", parts[1]), dealt(right, "rc", parts[1], "lc", parts[0])


def knn_join(left: DataFrame, right: DataFrame, k: int = 10, min_sim: float = 0.67, strict: bool = True,
             block: int = BLOCK, self_join: bool = False, earlier: bool = False) -> DataFrame:
    """The ``k`` most similar right rows of each left row with similarity above ``min_sim``.

    Both sides: ``(grp, id, vec)``; only rows of the same group are compared. With ``self_join`` a row
    is not its own neighbour; with ``earlier`` only right rows with a smaller ``ord`` count. A short left side of one group meets
    every right row once; an index of these would cost more than it saves."""
    cols = ["grp", "id", "vec", *(["ord"] if earlier else [])]
    asked = left.agg(F.count(F.lit(1)).alias("n"), F.min("grp").eqNullSafe(F.max("grp")).alias("one")).first()
    if asked["n"] <= COPIES * block and asked["one"]:
        lt, rt = grid(left.select(*cols), right.select(*cols), block)
        return ranked(block_knn(lt, rt, k, min_sim, strict, self_join, earlier), k)
    return index_knn(left, VectorIndex.build(right.select(*cols), block), k, min_sim, strict, self_join, earlier)


def index_self_grid(index: VectorIndex, pairs: DataFrame) -> DataFrame:
    """Rows per unordered pair of chunks ``(ci <= cj)``; ``chunk`` says on which side a row stands."""
    base = [c for c in index.rows.columns if not c.startswith("_") or c == "_low"]
    sides = pairs.select("grp", F.col("lc").alias("ci"), F.col("rc").alias("cj")).where("ci <= cj")
    sides = sides.hint("merge") if index.pivots else sides  # there may be far more pairs than their small files tell
    a = index.rows.withColumn("ci", F.col("_chunk")).join(sides, ["grp", "ci"]).select(*base, "ci", "cj", F.col("ci").alias("chunk"))
    b = index.rows.withColumn("cj", F.col("_chunk")).join(sides.where("ci < cj"), ["grp", "cj"]).select(*base, "ci", "cj", F.col("cj").alias("chunk"))
    return a.unionByName(b)


STATS = "grp string, low double, high double"


def _extremes(index: VectorIndex, pairs: DataFrame) -> DataFrame:
    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        ci, cj = pdf["ci"].iloc[0], pdf["cj"].iloc[0]
        a, b = pdf[pdf["chunk"] == ci], pdf[pdf["chunk"] == cj]
        lo, hi = np.inf, -np.inf
        if len(a) and len(b):
            for x, y in same_length(a, b):
                ux, uy = unit_rows(matrix(x["vec"])), unit_rows(matrix(y["vec"])).T
                xi, yi = x["id"].to_numpy(), y["id"].to_numpy()
                step = max(1, CELLS // len(y))
                for i in range(0, len(x), step):
                    sim = ux[i:i + step] @ uy
                    if ci == cj:
                        sim = sim[xi[i:i + step, None] < yi[None, :]]
                    if sim.size:
                        lo, hi = min(lo, float(sim.min())), max(hi, float(sim.max()))
        ok = np.isfinite(lo)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "low": [lo if ok else None], "high": [hi if ok else None]})

    return index_self_grid(index, pairs).groupBy("grp", "ci", "cj").applyInPandas(ends, STATS)


def pair_stats(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Number, mean, minimum and maximum of the cosine over all pairs of each group, without listing them.

    Number and mean come from the sum of the unit vectors. For the extremes, pairs inside chunks come first; other
    pairs of chunks are compared only where their angles can beat what is known."""
    df = cut(df.select("grp", "id", F.col("vec").cast("array<double>").alias("vec")))
    sums = Normalizer(inputCol="v", outputCol="u").transform(df.where(F.size("vec") > 0).select(
        "grp", F.size("vec").alias("d"), array_to_vector("vec").alias("v"), F.exists("vec", lambda x: x != 0).cast("double").alias("one")))
    sums = sums.groupBy("grp", "d").agg(Summarizer.sum(F.col("u")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("one").alias("own"))
    per = sums.withColumn("s", vector_to_array("s")).select("grp", "n", ((dot(F.col("s"), F.col("s")) - F.col("own")) / 2).alias("total"))
    means = per.groupBy("grp").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"), F.sum("total").alias("total")).where("pairs > 0")
    most = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    index = VectorIndex.build(df, block, {} if most <= COPIES * block else None)  # few chunks a group: every pair of them, no tiny cells
    spark = df.sparkSession
    own = index.chunks.where("n > 1").select("grp", F.col("_chunk").alias("lc"), F.col("_chunk").alias("rc"))
    found = cut(_extremes(index, own))
    known = found.groupBy("grp").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    others = chunk_pairs(spark, index.pivots, index.chunks, index.chunks, float(np.pi) + SLACK).where("lc < rc").join(known, "grp", "left")
    nearest = chunk_bound(F.col("g"), F.col("llo"), F.col("lhi"), F.col("rlo"), F.col("rhi"))
    farthest = F.least(F.col("g") + F.col("lhi") + F.col("rhi"), F.lit(2 * float(np.pi)) - F.col("g") - F.col("llo") - F.col("rlo"))
    better = F.col("high").isNull() | (nearest < F.acos(F.least("high", F.lit(1.0))) + SLACK) | (farthest > F.acos(F.greatest("low", F.lit(-1.0))) - SLACK)
    found = found.unionByName(_extremes(index, cut(others.where(better).select("grp", "lc", "rc"))))
    ends = found.groupBy("grp").agg(F.min("low").alias("min_sim"), F.max("high").alias("max_sim"))
    return means.join(ends, "grp").select("grp", "pairs", (F.col("total") / F.col("pairs")).alias("avg_sim"), "min_sim", "max_sim")


TOP_PAIRS = "grp string, a bigint, b bigint, sim double"


def _top_of(x: pd.DataFrame, y: pd.DataFrame, n: int, above: float, known: float, same: bool) -> pd.DataFrame:
    """``a, b, sim``: the ``n`` most similar pairs of two blocks (of one, if ``same``) above a similarity; those below ``known`` may be left out."""
    ux, uy, xs, ys = unit_rows(matrix(x["vec"])), unit_rows(matrix(y["vec"])), x["id"].to_numpy(), y["id"].to_numpy()
    fx, fy, slack, low = ux.astype(np.float32), np.ascontiguousarray(uy.astype(np.float32).T), single_slack(ux.shape[1]), max(above, known)
    best = pd.DataFrame({"a": xs[:0], "b": ys[:0], "sim": np.zeros(0)})
    for i in range(0, len(ux), RUN):
        for lo in range(0, len(uy), TILE):
            sim = fx[i:i + RUN] @ fy[:, lo:lo + TILE]
            hit = np.flatnonzero(sim >= np.float32(low - slack))
            if len(hit) > max(n, sim.size // 8):  # no bound yet, or copies
                d = ux[i:i + RUN] @ uy[lo:lo + TILE].T
                if same:
                    d = np.where(xs[i:i + RUN, None] < ys[None, lo:lo + TILE], d, -np.inf)
                hit = np.flatnonzero(d >= np.partition(d.ravel(), d.size - n)[d.size - n] - 1e-12)
            r, c = np.divmod(hit, sim.shape[1])
            r, c = r + i, c + lo
            if same:
                r, c = r[xs[r] < ys[c]], c[xs[r] < ys[c]]
            exact = np.concatenate([np.einsum("ij,ij->i", ux[r[j:j + CELLS // 64]], uy[c[j:j + CELLS // 64]]) for j in range(0, len(r), CELLS // 64)] or [np.zeros(0)])
            ok = (exact > above) & (exact >= low)
            if ok.any():
                r, c = r[ok], c[ok]
                more = pd.DataFrame({"a": np.minimum(xs[r], ys[c]), "b": np.maximum(xs[r], ys[c]), "sim": exact[ok]})
                best = pd.concat([best, more]).sort_values(["sim", "a", "b"], ascending=[False, True, True]).head(n)
                if len(best) == n:
                    low = max(low, best["sim"].iloc[-1])
    return best


def top_pairs(df: DataFrame, n: int = 10, above: float = -1.0, block: int = BLOCK) -> DataFrame:
    """The ``n`` most similar pairs (a < b) of each group above a similarity; each block reports at most ``n``.

    Pairs inside chunks come first; the ``n``-th best of them bounds the angle of better ones. Where the angles still skip little,
    larger chunks without pivots make fewer copies of rows."""
    index = VectorIndex.build(df.select("grp", "id", "vec"), block)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        ci, cj = pdf["ci"].iloc[0], pdf["cj"].iloc[0]
        a, b = pdf[pdf["chunk"] == ci], pdf[pdf["chunk"] == cj]
        known = pdf["_low"].iloc[0] if "_low" in pdf else None
        out = []
        if len(a) and len(b):
            for x, y in same_length(a, b):
                f = _top_of(x, y, n, above, -2.0 if known is None or np.isnan(known) else known, ci == cj)
                out.append(f.assign(grp=np.full(len(f), pdf["grp"].iloc[0], object))[["grp", "a", "b", "sim"]])
        return stacked(out, "grp", "a", "b", "sim")

    def of(index, pairs):
        return index_self_grid(index, pairs).groupBy("grp", "ci", "cj").applyInPandas(best, TOP_PAIRS)

    w = Window.partitionBy("grp").orderBy(F.col("sim").desc(), "a", "b")
    if index.pivots:
        own = cut(of(index, index.chunks.where("n > 1").select("grp", F.col("_chunk").alias("lc"), F.col("_chunk").alias("rc"))))
        nth = cut(own.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == n).select("grp", F.col("sim").alias("_low")))
        groups = index.chunks.groupBy("grp").agg(F.sum("n").alias("_n")).where("_n > 1")
        least = groups.join(nth, "grp", "left").agg(F.min(F.coalesce("_low", F.lit(above)))).first()[0]
        most = radius(max(above, -1.0 if least is None else least))
        index = VectorIndex(index.rows.join(nth, "grp", "left"), index.chunks, index.counts, index.pivots, block)
        if index.skips(index, most):
            pairs = chunk_pairs(df.sparkSession, index.pivots, index.chunks, index.chunks, most)
            found = own.unionByName(of(index, cut(pairs.where("lc < rc"))))
        else:
            index = index.plain()
            found = of(index, cut(chunk_pairs(df.sparkSession, {}, index.chunks, index.chunks, most)))
    else:
        found = of(index, chunk_pairs(df.sparkSession, index.pivots, index.chunks, index.chunks, radius(above)))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
