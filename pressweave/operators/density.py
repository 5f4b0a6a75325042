"""Hierarchical density clustering (Campello, Moulavi, Zimek, Sander 2015) as DataFrame jobs.

1. Exact copies collapse to one point with a multiplicity.
2. Core distances over the vector index: the nearest of a point's own chunk bound the angle beyond which no other
   chunk is looked at.
3. The minimum spanning forest of the mutual-reachability graph by Boruvka rounds over the same index: every
   component takes its least outgoing edge, found in its own chunks first; that edge bounds the search in the others. The own
   chunks' edges are those of their spanning forests, which are made once.
   At most log2(n) rounds and n - 1 edges. Cells of few chunks need no rounds: the forests of all their pairs of chunks hold theirs.
4. The hierarchy is built bottom-up in bands of ascending weight. A band holds a bounded number of edges;
   its connected pieces are contracted in parallel, and every open cluster leaves the band as one summary row
   (size, sum of densities, best stability below it). No task sees the whole tree.

Edges of equal weight merge at once, so the result does not depend on row order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..session import cut
from .components import TAIL, connected_components
from .simjoin import CELLS, RUN, _best_of, _top_k, matrix, single_slack, stacked, unit_rows
from .vectorindex import SIDE, SLACK, VectorIndex, _sent, chunk_bound, chunk_pairs, radius

FLOOR = 1e-9
BAND_EDGES = 200_000
#: Pieces of a band are dealt to so many tasks; most of them are small.
DEALT = 64
BLOCK = 1024
#: Cells of up to this many chunks are compared pair of chunks by pair of chunks; larger ones take Boruvka rounds.
PAIRWISE = 16
#: Points whose times span more than this many time scales are cut into about ``RUNS`` runs of times, of no more than ``SIDE`` rows.
SPAN = 8
RUNS = 32


# ---- distances --------------------------------------------------------------------

def composite(va: np.ndarray, vb: np.ndarray, ta, tb, weight: float, scale: float) -> np.ndarray:
    """``(1-w) * cosine distance + w * min(|dt|/scale, 1)``; cosine alone when times are missing."""
    return _composed(unit_rows(va), unit_rows(vb), ta, tb, weight, scale)


def _composed(ua: np.ndarray, ub: np.ndarray, ta, tb, weight: float, scale: float) -> np.ndarray:
    d = 1.0 - ua @ ub.T
    if weight > 0 and ta is not None:
        d = (1 - weight) * d + weight * np.minimum(np.abs(ta[:, None] - tb[None, :]) / scale, 1.0)
    return np.maximum(d, 0.0)


def _dist(a: pd.DataFrame, b: pd.DataFrame, weight: float, scale: float) -> np.ndarray:
    return next(_dists(a, b, weight, scale, len(a)))[1]


def _dists(a: pd.DataFrame, b: pd.DataFrame, weight: float, scale: float, step: int | None = None):
    """``(slice of a, distances to b)``, a bounded number of distances at a time."""
    ta, tb = a["hours"].to_numpy(float), b["hours"].to_numpy(float)
    timed = weight > 0 and not (np.isnan(ta).any() or np.isnan(tb).any())
    ua, ub, step = unit_rows(matrix(a["vec"])), unit_rows(matrix(b["vec"])), step or max(1, CELLS // len(b))
    for i in range(0, len(a), step):
        at = slice(i, i + step)
        yield at, _composed(ua[at], ub, ta[at] if timed else None, tb if timed else None, weight, scale)


class _Points(NamedTuple):
    """Unit vectors, hours, core distances and owners (points of one owner don't count for each other) in the order of their ids."""

    ids: np.ndarray
    unit: np.ndarray
    hours: np.ndarray
    core: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, owner: str = "id") -> _Points:
        core = rows["core"].to_numpy(float) if "core" in rows else np.zeros(len(rows))
        return cls(rows["id"].to_numpy(), unit_rows(matrix(rows["vec"])), rows["hours"].to_numpy(float), core, rows[owner].to_numpy())


#: Columns that are weighed at once; near ones in time come first.
STRIP = 512


def closest(a: _Points, b: _Points, k: int, weight: float, scale: float, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``a``, rows of ``b`` and their mutual reachability: for each row of ``a`` the ``k`` least of other owners, ties by id,
    and none above ``least`` (one bound a row).

    Strips of ``b`` that lie too far off in time are skipped. In the others single precision finds the few pairs that can be among
    the best of what was seen so far; these alone are weighed in double precision."""
    timed = weight > 0 and not (np.isnan(a.hours).any() or np.isnan(b.hours).any())
    weight = weight if timed else 0.0
    ta, tb = (x.hours if timed else np.zeros(len(x.ids)) for x in (a, b))
    oa, ob = np.argsort(ta, kind="stable"), np.argsort(tb, kind="stable")
    middle = float(np.median(tb)) if len(tb) else 0.0
    pace = weight / scale if timed else 0.0
    far = max(np.abs(ta - middle).max(initial=0.0), np.abs(tb - middle).max(initial=0.0)) * pace
    slack = single_slack(a.unit.shape[1]) + 1e-6 * (1 + far)
    fb, fh = np.ascontiguousarray(b.unit[ob].astype(np.float32).T), ((tb[ob] - middle) * pace).astype(np.float32)
    starts = np.arange(0, len(ob), STRIP)
    first, last = tb[ob[starts]], tb[ob[np.minimum(starts + STRIP, len(ob)) - 1]]

    def weighed(r, c):
        d = 1.0 - np.einsum("ij,ij->i", a.unit[r], b.unit[c])
        if timed:
            d = (1 - weight) * d + weight * np.minimum(np.abs(ta[r] - tb[c]) / scale, 1.0)
        return np.maximum(np.maximum(d, 0.0), np.maximum(a.core[r], b.core[c]))

    out = []
    for i in range(0, len(oa), RUN):
        rows = oa[i:i + RUN]
        fa, ha = (a.unit[rows] * -(1 - weight)).astype(np.float32), ((ta[rows] - middle) * pace).astype(np.float32)
        low = np.array(least[rows], dtype=np.float64)
        bound = np.minimum(np.maximum(np.maximum(first - ta[rows[-1]], ta[rows[0]] - last), 0.0) * pace, weight)
        kept, more, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

        def settled(kept, more):
            r, c, s, full = _best_of(*(np.concatenate(x) for x in zip(kept, *more)), k)
            low[r[full]] = np.minimum(low[r[full]], -s[full])
            return r, c, s

        for strip in np.argsort(bound, kind="stable"):
            if bound[strip] > low.max() + 1e-9:
                break
            lo = starts[strip]
            cols = ob[lo:lo + STRIP]
            d = fa @ fb[:, lo:lo + STRIP]
            d += np.float32(1 - weight)
            if timed:
                gap = np.abs(ha[:, None] - fh[None, lo:lo + STRIP])
                np.minimum(gap, np.float32(weight), out=gap)
                d += gap
            hit = np.flatnonzero(d <= np.minimum(low + slack, 1e30).astype(np.float32)[:, None])
            if len(hit) * 8 > d.size:  # no bound yet, or copies
                exact = _composed(a.unit[rows], b.unit[cols], ta[rows] if timed else None, tb[cols] if timed else None, weight, scale)
                exact = np.maximum(exact, np.maximum(a.core[rows][:, None], b.core[cols][None, :]))
                exact[a.owner[rows][:, None] == b.owner[cols][None, :]] = np.inf
                r, c = _top_k(-exact, cols, k)
                ok = np.isfinite(exact[r, c])
                r, c = r[ok], cols[c[ok]]
            else:
                r, c = np.divmod(hit, len(cols))
                c = cols[c]
                ok = (a.owner[rows[r]] != b.owner[c]) & (b.core[c] <= low[r])
                r, c = r[ok], c[ok]
            if not len(r):
                continue
            w = weighed(rows[r], c)
            ok = w <= low[r]
            more.append((r[ok], c[ok], -w[ok]))
            waiting += int(ok.sum())
            if waiting >= len(rows) * k:
                kept, more, waiting = settled(kept, more), [], 0
        if more:
            kept = settled(kept, more)
        out.append((rows[kept[0]], kept[1], -kept[2]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def time_weight_for(df: DataFrame, weight: float) -> float:
    """No time term at all when any row lacks its time."""
    return 0.0 if not df.where("hours is null").isEmpty() else weight


def collapse(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(points, members)``: one row per distinct (group, vector, time), and each id's point."""
    t = df.withColumn("_key", F.sha2(F.to_json(F.struct("vec", "hours")), 256))
    points = t.groupBy("grp", "_key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"),
                                          F.min_by(F.struct("vec", "hours"), "id").alias("_p"))
    members = t.select("grp", "_key", F.col("id").alias("member")).join(
        points.select("grp", "_key", "id"), ["grp", "_key"]).select("member", "grp", F.col("id").alias("point"))
    return points.select("grp", "id", "mult", "_p.vec", "_p.hours"), members


def _with_cells(points: DataFrame, weight: float, scale: float, max_dist: float | None) -> DataFrame:
    """Time cells for a cut-off below the time weight: partners lie in the same or the next cell,
    so each point joins its own and the following one. Without such a cut-off there is one cell."""
    if max_dist is None or weight <= 0 or max_dist >= weight:
        return points.withColumn("cell", F.lit(0).cast("bigint"))
    reach = scale * max_dist / weight
    own = F.floor(F.col("hours") / F.lit(reach))
    return points.withColumn("cell", F.explode(F.array(own, own + 1)))


class TimeIndex:
    """Rows ``(grp, id, vec, hours, ...)`` in runs of times: chunks know their first and last hour instead of angles."""

    timed, pivots = True, {}

    def __init__(self, rows: DataFrame, block: int):
        n = F.count(F.lit(1))
        t = cut(rows.withColumn("_len", F.size("vec")))
        size = F.greatest(F.lit(block), F.least(F.lit(SIDE), F.ceil(n / F.lit(RUNS))))
        steps = F.array(*(F.lit((i + 1) / 256) for i in range(255)))
        # groups of more than one run and runs of more than one part: less than one for every ``block`` rows, so that vectors stay
        # where they are instead of being dealt by a group that may hold all of them
        cells = cut(t.groupBy("grp", "_len").agg(n.alias("_n"), F.ceil(n / size).alias("_k"), F.percentile_approx("hours", steps, 2000).alias("_q")).where(
            "_k > 1"))
        # 256 slices of equal counts are dealt to the runs; a run that equal times make too large is cut by a hash
        run = F.floor(F.size(F.filter("_q", lambda q: q < F.col("hours"))) * F.least("_k", F.lit(256)) / 256)
        t = t.join(F.broadcast(cells), ["grp", "_len"], "left").withColumn("_run", F.when(F.col("_k").isNull(), F.lit(0)).otherwise(run))
        subs = t.where("_k is not null").groupBy("grp", "_len", "_run").agg(n.alias("_c"), F.first("_k").alias("_k"), F.first("_n").alias("_n"))
        subs = cut(subs.select("grp", "_len", "_run", F.ceil(F.col("_c") / (F.lit(2.0) * F.ceil(F.col("_n") / F.col("_k")))).alias("_subs")).where("_subs > 1"))
        part = F.pmod(F.xxhash64(F.lit(3), "id"), F.coalesce("_subs", F.lit(1)))
        t = t.join(F.broadcast(subs), ["grp", "_len", "_run"], "left").withColumn("_chunk", F.concat_ws(":", "_len", "_run", part))
        self.rows = cut(t.drop("_q", "_k", "_n", "_run", "_subs"))
        self.chunks = cut(self.rows.groupBy("grp", "_len", "_chunk").agg(F.min("hours").alias("lo"), F.max("hours").alias("hi"), n.alias("n")))


def _indexed(points: DataFrame, weight: float, scale: float, max_dist: float | None, block: int, pairwise: int = PAIRWISE) -> VectorIndex | TimeIndex:
    """The points by group and time cell; ``og`` is the group itself. Without pivots where no cell has more than ``pairwise`` chunks.

    Larger ones are cut by time where every point has one and a cell spans many time scales: far-off times alone make a
    distance that near ones undercut whatever the vectors are. Else by angle."""
    t = _with_cells(points, weight, scale, max_dist).withColumn("og", F.col("grp"))
    t = t.withColumn("grp", F.concat_ws("|", "og", F.col("cell").cast("string"))).drop("cell")
    known = F.col("hours").isNotNull() & ~F.isnan("hours")
    per = t.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.bool_and(known).alias("known"), (F.max("hours") - F.min("hours")).alias("span"))
    most = per.agg(F.max("n").alias("n"), F.bool_and("known").alias("known"), F.max_by("span", "n").alias("span")).first()
    if (most["n"] or 0) <= pairwise * block:
        return VectorIndex.build(t, block, {})
    if weight > 0 and most["known"] and most["span"] > SPAN * scale:
        return TimeIndex(t, block)
    return VectorIndex.build(t, block)


def _widest(weight: float, max_dist: float | None) -> float:
    """The greatest angle of two points within the cut-off."""
    return float(np.pi) + SLACK if max_dist is None or weight >= 1 else radius(1 - max_dist / (1 - weight))


def _angle_for(dist, weight: float, widest: float):
    """The angle beyond which a composite distance exceeds ``dist``; the widest one where it is null."""
    if weight >= 1:
        return F.lit(widest)
    angle = F.acos(F.greatest(F.lit(-1.0), F.lit(1.0) - F.col(dist) / F.lit(1 - weight))) + F.lit(SLACK)
    return F.least(F.coalesce(angle, F.lit(widest)), F.lit(widest))


def _need_for(index: VectorIndex | TimeIndex, dist, weight: float, scale: float, widest: float, limit: float):
    """How far from a row others can lie within the distance: an angle, or hours for an index by time."""
    if not isinstance(index, TimeIndex):
        return _angle_for(dist, weight, widest)
    d = F.coalesce(F.least(F.col(dist), F.lit(limit)), F.lit(limit)) + F.lit(1e-9)
    return F.when(d < weight, d * F.lit(scale / weight) + F.lit(1e-6)).otherwise(F.lit(float("inf")))


def _gap(lo, hi, lo2, hi2):
    return F.greatest(lo2 - hi, lo - hi2, F.lit(0.0))


def _other_chunks(index: VectorIndex, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides per pair of different chunks ``(lc, rc)`` in which a left row has a partner within its angle ``_need``.

    ``rows`` are those of the index that still count. With a column ``comp``, pairs of chunks that lie in one and the same
    component are left out."""
    spark = rows.sparkSession
    owner = ["comp"] if "comp" in rows.columns else []
    marks = [f(c).alias(f"{n}_{c}") for c in owner for n, f in (("least", F.min), ("most", F.max))]
    live = cut(rows.groupBy("grp", "_chunk").agg(F.max("_need").alias("need"), *marks))
    reach = live.agg(F.max("need")).first()[0]
    if reach is None:
        reach = 0.0
    timed = isinstance(index, TimeIndex)
    if timed:
        c = index.chunks.where("_len > 0")
        pairs = c.select("grp", "_len", F.col("_chunk").alias("lc"), F.col("lo").alias("llo"), F.col("hi").alias("lhi")).join(
            c.select("grp", "_len", F.col("_chunk").alias("rc"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi")), ["grp", "_len"]).where("lc <> rc").drop("_len")
        pairs = pairs.withColumn("g", F.lit(0.0))
    else:
        pairs = chunk_pairs(spark, index.pivots, index.chunks, index.chunks, reach).where("lc <> rc")
    left = live.withColumnRenamed("_chunk", "lc")
    right = live.drop("need").withColumnRenamed("_chunk", "rc").withColumnsRenamed({"least_comp": "least_r", "most_comp": "most_r"})
    pairs = pairs.join(left, ["grp", "lc"]).join(right, ["grp", "rc"])
    bound = [F.col(c) for c in ("llo", "lhi", "rlo", "rhi")]
    pairs = pairs.where((_gap(*bound) if timed else chunk_bound(F.col("g"), *bound)) <= F.col("need"))
    if owner:
        pairs = pairs.where("least_comp < most_comp or least_r < most_r or least_comp <> least_r")
    pairs = cut(pairs.select("grp", "lc", "rc", "g", "llo", "lhi", "rlo", "rhi", "need"))
    def sent(own, lo, hi, need):
        if not timed:
            return _sent(rows, pairs, own, lo, hi, need)
        t = rows.join(pairs.withColumnRenamed(own, "_chunk").withColumn(own, F.col("_chunk")), ["grp", "_chunk"])
        return t.where(_gap(F.col("hours"), F.col("hours"), F.col(lo), F.col(hi)) <= need).select(*rows.columns, "lc", "rc")
    rt = sent("rc", "llo", "lhi", F.col("need"))
    return sent("lc", "rlo", "rhi", F.col("_need")), rt.select(*[F.col(c).alias(f"r_{c}") for c in rt.columns])


def _per_pair(sides: tuple[DataFrame, DataFrame], body, schema: str) -> DataFrame:
    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return body(left, right.rename(columns=lambda c: c[2:]))

    return sides[0].groupBy("grp", "lc", "rc").cogroup(sides[1].groupBy("r_grp", "r_lc", "r_rc")).applyInPandas(run, schema)


NEAREST = "grp string, id bigint, og string, nbr bigint, dist double, mult bigint"


def nearest(points: DataFrame, k: int, weight: float, scale: float = vocab.TIME_SCALE_HOURS,
            max_dist: float | None = None, block: int = BLOCK, index: VectorIndex | None = None) -> DataFrame:
    """The ``k`` nearest other points of each point by composite distance: ``grp, id, nbr, dist, mult, rank``.

    Exact: the ``k`` best of a point's own chunk bound the angle of better ones, so chunks and rows beyond it are skipped."""
    limit, widest = np.inf if max_dist is None else max_dist, _widest(weight, max_dist)
    index = index or _indexed(points, weight, scale, max_dist, block)
    names = [x.split()[0] for x in NEAREST.split(", ")]

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return stacked([], *names)
        a, b = a.sort_values("id", ignore_index=True), b.sort_values("id", ignore_index=True)
        known = a["_kth"].fillna(np.inf).to_numpy(float) if "_kth" in a else np.inf
        r, c, v = closest(_Points.of(a), _Points.of(b), k, weight, scale, np.minimum(np.full(len(a), limit), known))
        out = [pd.DataFrame({"grp": a["grp"].to_numpy(object)[r], "id": a["id"].to_numpy()[r], "og": a["og"].to_numpy(object)[r],
                             "nbr": b["id"].to_numpy()[c], "dist": v, "mult": b["mult"].to_numpy()[c]})]
        return stacked(out, *names)

    own = cut(index.rows.groupBy("grp", "_chunk").applyInPandas(lambda pdf: near(pdf, pdf), NEAREST))
    larger = index.chunks.groupBy("grp").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("grp")
    full = own.groupBy("grp", "id").agg(F.count(F.lit(1)).alias("_n"), F.max("dist").alias("_kth")).where(F.col("_n") >= k).drop("_n")
    rows = index.rows.join(larger, "grp").join(full, ["grp", "id"], "left").withColumn("_need", _need_for(index, "_kth", weight, scale, widest, limit))
    found = own.unionByName(_per_pair(_other_chunks(index, cut(rows)), near, NEAREST))
    found = found.drop("grp").withColumnRenamed("og", "grp").select("grp", "id", "nbr", "dist", "mult")
    if max_dist is not None:
        found = found.distinct()  # a pair may be seen in two neighbouring cells
    w = Window.partitionBy("grp", "id").orderBy("dist", "nbr")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def core_distances(points: DataFrame, k: int, weight: float, scale: float = vocab.TIME_SCALE_HOURS,
                   max_dist: float | None = None, block: int = BLOCK, index: VectorIndex | None = None) -> DataFrame:
    """Distance to the ``k``-th point, itself and its copies included; the farthest one known when there are fewer.
    With a cut-off, points with too few neighbours inside it get no core distance."""
    if k <= 1:  # the point itself
        return points.select("grp", "id", F.lit(0.0).alias("core"))
    base = points.select("grp", "id", "mult")
    near = nearest(points, max(k - 1, 1), weight, scale, max_dist, block, index)
    w = Window.partitionBy("grp", "id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = near.withColumn("_cum", F.sum("mult").over(w)).select("grp", "id", "_cum", "dist")
    agg = base.join(reach, ["grp", "id"], "left").groupBy("grp", "id").agg(
        F.max("mult").alias("mult"),
        F.min(F.when(F.col("_cum") + F.col("mult") >= k, F.col("dist"))).alias("_kth"), F.max("dist").alias("_far"))
    fallback = F.coalesce("_far", F.lit(0.0)) if max_dist is None else F.lit(None).cast("double")
    return agg.select("grp", "id", F.when(F.col("mult") >= k, F.lit(0.0)).otherwise(
        F.coalesce("_kth", fallback)).alias("core"))


EDGE = "comp bigint, to bigint, w double, a bigint, b bigint"


def _prim(d: np.ndarray, limit: float) -> list[tuple[int, int, float]]:
    """Edges of the minimum spanning forest of a dense symmetric matrix up to ``limit``."""
    near, at = d[0].copy(), np.zeros(len(d), int)
    near[0], out, inside = np.inf, [], np.zeros(len(d), bool)
    inside[0] = True
    for _ in range(len(d) - 1):
        j = int(np.where(inside, np.inf, near).argmin())
        if near[j] <= limit:
            out.append((at[j], j, near[j]))
        inside[j] = True
        closer = d[j] < near
        near, at = np.where(closer, d[j], near), np.where(closer, j, at)
    return out


#: Edges that a point knows at once in a chunk's forest.
LISTED = 8


def chunk_forest(pdf: pd.DataFrame, weight: float, scale: float, limit: float) -> pd.DataFrame:
    """``a, b, w``: the minimum spanning forest of one chunk's points up to ``limit``; edges are ordered by ``(w, a, b)``.

    Every point lists its ``LISTED`` least edges to other components. The least one that a component lists is its least one
    at all unless it comes after the last listed one of a point; only when no component is sure of its edge do the points
    in question list anew, those of the largest component excepted."""
    rows = pdf.sort_values("id", ignore_index=True)
    p, n = _Points.of(rows), len(rows)
    comp, out = np.arange(n), []
    x, y, w = closest(p._replace(owner=comp), p._replace(owner=comp), LISTED, weight, scale, np.full(n, limit))
    while True:
        open_ = comp[x] != comp[y]
        # edges by (w, a, b); one that both ends list has one place
        a, b = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((b, a, w))
        same = (w[order][1:] == w[order][:-1]) & (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
        place = np.empty(len(x), np.int64)
        place[order] = np.cumsum(np.r_[True, ~same]) - 1 if len(x) else 0
        count, last = np.bincount(x, minlength=n), np.full(n, -1, np.int64)
        np.maximum.at(last, x, place)
        last[count < LISTED] = len(x)  # there are no others
        best, known = np.full(n, len(x) + 1), np.full(n, len(x) + 1)
        np.minimum.at(best, comp[x[open_]], place[open_])
        np.minimum.at(known, comp, last)
        some = best <= len(x)
        sure = np.flatnonzero(some & (best <= known))
        if len(sure):
            at = np.full(len(x) + 2, -1)
            at[place] = np.arange(len(x))
            e = np.unique(at[best[sure]])
            out.append((a[e], b[e], w[e]))
            to = np.arange(n)
            u, v = comp[x[e]], comp[y[e]]
            while (to[u] != to[v]).any():
                low = np.minimum(to[u], to[v])
                np.minimum.at(to, to[u], low)
                np.minimum.at(to, to[v], low)
                while (to[to] != to).any():
                    to = to[to]
            comp = to[comp]
            continue
        size = np.bincount(comp, minlength=n)
        short = (known <= len(x) - 1) & (known < best) & (size > 0)  # others may have edges that nobody lists
        short[int(size.argmax())] = False
        again = np.flatnonzero(short[comp] & (last < best[comp]))
        if not len(again):
            break
        sub = _Points(*(f[again] for f in p._replace(owner=comp)))
        r, c, v = closest(sub, p._replace(owner=comp), LISTED, weight, scale, np.full(len(again), limit))
        keep = ~np.isin(x, again)
        x, y, w = np.concatenate([x[keep], again[r]]), np.concatenate([y[keep], c]), np.concatenate([w[keep], v])
    if not out:
        return pd.DataFrame({"a": [], "b": [], "w": []}).astype({"a": "int64", "b": "int64"})
    a, b, w = (np.concatenate(z) for z in zip(*out))
    return pd.DataFrame({"a": p.ids[a], "b": p.ids[b], "w": w})


def _reach(x: pd.DataFrame, y: pd.DataFrame, weight: float, scale: float) -> np.ndarray:
    return np.maximum(_dist(x, y, weight, scale), np.maximum(x["core"].to_numpy(float)[:, None], y["core"].to_numpy(float)[None, :]))


def spanning_forest(index: VectorIndex, cores: DataFrame, weight: float, scale: float, max_dist: float | None,
                    pairwise: int = PAIRWISE) -> DataFrame:
    """Edges ``a, b, w`` that hold a minimum spanning forest of the mutual-reachability graph up to ``max_dist``.

    Cells of at most ``pairwise`` chunks give the forest of every pair of their chunks in one pass, at most ``pairwise`` edges
    per point; larger ones take Boruvka rounds, one edge per point. An edge that either leaves out is the longest of a cycle.
    Edges are ordered by ``(w, a, b)``, so equal weights close no cycle. A component without an edge left is done and its points
    leave the search."""
    limit, widest = np.inf if max_dist is None else max_dist, _widest(weight, max_dist)
    keys = ["grp", "_len"]  # vectors of different lengths never meet
    whole = index.chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"))
    few = index.chunks.join(whole.where(F.col("_k") <= pairwise), keys).groupBy(*keys).agg(
        F.first("_k").alias("_k"), F.collect_list("_chunk").alias("_all"))
    known = index.rows.join(cores.where("core is not null").select("id", "core"), "id")

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id", ignore_index=True)
        ids = rows["id"].to_numpy()
        found = _prim(_reach(rows, rows, weight, scale), limit) if len(rows) > 1 else []
        return pd.DataFrame({"a": [ids[min(i, j)] for i, j, _ in found], "b": [ids[max(i, j)] for i, j, _ in found], "w": [w for *_, w in found]})

    # a chunk alone is a pair with itself only if the cell has no other
    partner = F.when(F.col("_k") == 1, F.col("_all")).otherwise(F.filter("_all", lambda c: c != F.col("_chunk")))
    paired = known.join(few, keys).withColumn("_o", F.explode(partner)).withColumns(
        {"ci": F.least("_chunk", "_o"), "cj": F.greatest("_chunk", "_o")}).select("grp", "ci", "cj", "id", "vec", "hours", "core")
    edges = cut(paired.groupBy("grp", "ci", "cj").applyInPandas(alone, "a bigint, b bigint, w double"))
    larger = cut(known.join(whole.where(F.col("_k") > pairwise).select(*keys), keys))
    if not larger.isEmpty():
        edges = edges.unionByName(_boruvka(index, larger, weight, scale, limit, widest))
    return edges.groupBy("a", "b").agg(F.min("w").alias("w"))


def _boruvka(index: VectorIndex, points: DataFrame, weight: float, scale: float, limit: float, widest: float) -> DataFrame:
    """Minimum spanning forest ``a, b, w`` of the index rows ``points`` (with ``core``)."""
    names = [x.split()[0] for x in EDGE.split(", ")]

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=names)
        x, y = x.sort_values("id", ignore_index=True), y.sort_values("id", ignore_index=True)
        a, b = _Points.of(x, "comp"), _Points.of(y, "comp")
        r, c, w = closest(a, b, 1, weight, scale, np.minimum(limit, x["_w"].fillna(np.inf).to_numpy(float)))
        i, j = a.ids[r], b.ids[c]
        some = pd.DataFrame({"comp": a.owner[r], "to": b.owner[c], "w": w, "a": np.minimum(i, j), "b": np.maximum(i, j)})
        return some.sort_values(["comp", "w", "a", "b"]).drop_duplicates("comp")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return chunk_forest(pdf, weight, scale, limit)

    def least(found: DataFrame) -> DataFrame:
        return found.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("comp", "e.*")

    # of all edges between a component and the rest of a chunk the chunk's own forest holds the least, in every round
    held = cut(points.groupBy("grp", "_chunk").applyInPandas(inside, "a bigint, b bigint, w double").select(
        "a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    comp = cut(points.select("id", F.col("id").alias("comp")).distinct())
    forest = []
    while True:
        ends = F.explode(F.array(F.struct(F.col("ca").alias("comp"), F.col("cb").alias("to")), F.struct(F.col("cb").alias("comp"), F.col("ca").alias("to"))))
        own = cut(least(held.select("a", "b", "w", ends.alias("e")).select("e.comp", "e.to", "w", "a", "b")))
        bound = own.select("comp", F.col("w").alias("_w")).hint("merge")
        asked = points.join(comp.hint("merge"), "id").join(bound, "comp", "left").withColumn("_need", F.when(
            F.col("core") <= F.coalesce("_w", F.lit(float("inf"))), _need_for(index, "_w", weight, scale, widest, limit)).otherwise(F.lit(-1.0)))
        others = _per_pair(_other_chunks(index, asked), best, EDGE)
        picked = cut(least(own.select("comp", "to", "w", "a", "b").unionByName(others.select("comp", "to", "w", "a", "b"))))
        if picked.isEmpty():
            break
        forest.append(picked.select("a", "b", "w"))
        merged = cut(connected_components(picked, "comp", "to", TAIL).withColumnRenamed("node", "comp"))
        comp = cut(comp.join(merged, "comp").select("id", F.col("component").alias("comp")))
        to = [merged.select(F.col("comp").alias(c), F.col("component").alias(f"_{c}")) for c in ("ca", "cb")]
        held = cut(held.join(to[0], "ca").join(to[1], "cb").where("_ca <> _cb").select("a", "b", "w", F.col("_ca").alias("ca"), F.col("_cb").alias("cb")))
    edges = held.select("a", "b", "w").limit(0)
    for some in forest:
        edges = edges.unionByName(some)
    return edges


# ---- hierarchy --------------------------------------------------------------------

SUMMARY = ("node bigint, size bigint, cid string, form double, sum_lambda double, best double, leaf boolean")
STEP = ("node bigint, next bigint, top string, top_birth double, eps_cluster string, outer string, "
        "size bigint, cid string, form double, sum_lambda double, best double, leaf boolean, kind string")


class _Cluster:
    __slots__ = ("cid", "form", "size", "sum_lambda", "best", "leaf", "parent", "birth", "flag")

    def __init__(self, cid, form, size, sum_lambda, best, leaf):
        self.cid, self.form, self.size, self.sum_lambda, self.best, self.leaf = (
            cid, form, size, sum_lambda, best, leaf)
        self.parent = self.birth = self.flag = None

    def close(self, w):
        stability = self.sum_lambda - self.size / max(w, FLOOR)
        self.birth = w
        self.flag = self.leaf or stability >= self.best
        return max(stability, self.best)


def contract(edges: pd.DataFrame, nodes: pd.DataFrame, min_size: int, epsilon: float,
             final_weight: float | None = None) -> pd.DataFrame:
    """Merge connected pieces along their edges in ascending order.

    Returns one ``kind='map'`` row per input node (where it went, the topmost selected cluster around it)
    and one ``kind='open'`` row per resulting open node."""
    ids = nodes["node"].to_numpy()
    where = {n: i for i, n in enumerate(ids)}
    parent = list(range(len(ids)))
    size = nodes["size"].tolist()
    low = [int(n) for n in ids]
    part, first = [], []
    for r in nodes.itertuples(index=False):
        c = None
        if isinstance(r.cid, str):
            c = _Cluster(r.cid, r.form, r.size, r.sum_lambda, r.best, r.leaf)
        part.append(c)
        first.append(c)
    inside = [[i] for i in range(len(ids))]   # nodes of a part that have joined no cluster yet
    made = [c for c in part if c is not None]

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    e = edges.sort_values("w", kind="stable")
    ws = e["w"].to_numpy()
    ea = [where[x] for x in e["a"]]
    eb = [where[x] for x in e["b"]]
    at = 0
    while at < len(ws):
        w, groups = ws[at], {}
        end = at
        while end < len(ws) and ws[end] == w:
            x, y = find(ea[end]), find(eb[end])
            if x != y:
                merged = groups.pop(x, {x}) | groups.pop(y, {y})
                parent[y] = x
                groups[x] = merged
            end += 1
        lam = 1.0 / max(w, FLOOR)
        for root, members in groups.items():
            clusters = [part[m] for m in members if part[m] is not None]
            total = sum(size[m] for m in members)
            lowest = min(low[m] for m in members)
            loose = [i for m in members if part[m] is None for i in inside[m]]
            if len(clusters) == 1:
                c = clusters[0]
                c.sum_lambda += (total - c.size) * lam
                c.size = total
            elif clusters or total >= min_size:
                below = sum(c.close(w) for c in clusters)
                new = _Cluster(f"{lowest}@{float(w)!r}", w, total, total * lam, below, not clusters)
                for c in clusters:
                    c.parent = new
                made.append(new)
                c = new
            else:
                c = None
            if c is not None:
                for i in loose:
                    first[i] = c
                loose = []
            part[root], size[root], low[root], inside[root] = c, total, lowest, loose
        at = end
    if final_weight is not None:
        for i in range(len(ids)):
            if parent[i] == i and part[i] is not None:
                part[i].close(final_weight)
    top, eps_at, outer = {}, {}, {}
    for c in reversed(made):  # parents are made after their children
        up = c.parent
        above = top.get(up) if up is not None else None
        closed = c.birth is not None
        top[c] = above if above is not None else (c if closed and c.flag else None)
        outer[c] = (outer.get(up) if up is not None else None) or (c if closed else None)
        if epsilon > 0:
            if closed and c.birth > epsilon:
                eps_at[c] = c.cid if c.form <= epsilon else ""
            else:
                eps_at[c] = eps_at.get(up) if up is not None else None
    rows = []
    for i, n in enumerate(ids):
        c, r = first[i], find(i)
        t = top[c] if c is not None else None
        rows.append((int(n), low[r], t.cid if t else None, t.birth if t else None,
                     eps_at.get(c) if c is not None else None,
                     outer[c].cid if c is not None and outer[c] else None,
                     None, None, None, None, None, None, "map"))
        if r == i:
            c = part[i] if final_weight is None else None
            rows.append((low[i], low[i], None, None, None, None, size[i], c.cid if c else None,
                         c.form if c else None, c.sum_lambda if c else None, c.best if c else None,
                         c.leaf if c else None, "open"))
    names = [x.split()[0] for x in STEP.split(", ")]
    return pd.DataFrame(rows, columns=names)


def _update(state: DataFrame, maps: DataFrame) -> DataFrame:
    """Fold one band's mapping into the per-point state: outer selections override, inner epsilon marks stay."""
    m = maps.select(F.col("node").alias("cur"), F.col("next").alias("_n"), F.col("top").alias("_t"),
                    F.col("top_birth").alias("_tb"), F.col("eps_cluster").alias("_e"), F.col("outer").alias("_o"))
    return state.join(m, "cur", "left").select(
        "id", F.coalesce("_n", "cur").alias("cur"), F.coalesce("_t", "top").alias("top"),
        F.when(F.col("_t").isNotNull(), F.col("_tb")).otherwise(F.col("top_birth")).alias("top_birth"),
        F.coalesce("eps_cluster", "_e").alias("eps_cluster"), F.coalesce("_o", "outer").alias("outer"))


def select_clusters(points: DataFrame, edges: DataFrame, min_size: int = 2, epsilon: float = 0.0,
                    max_dist: float | None = None, band_edges: int = BAND_EDGES) -> DataFrame:
    """Excess-of-mass selection over the hierarchy the edges span: ``(id, cid)``, null for noise.

    ``points``: ``id, mult``. With ``max_dist`` every remaining tree is a child of a root born there;
    without it the last cluster of a tree is the root and cannot be selected."""
    heavy = F.col("mult") >= min_size
    nodes = cut(points.select(
        F.col("id").alias("node"), F.col("mult").alias("size"),
        F.when(heavy, F.concat(F.col("id").cast("string"), F.lit("@0.0"))).alias("cid"),
        F.when(heavy, F.lit(0.0)).alias("form"), F.when(heavy, F.col("mult") / F.lit(FLOOR)).alias("sum_lambda"),
        F.when(heavy, F.lit(0.0)).alias("best"), F.when(heavy, F.lit(True)).alias("leaf")))
    none = F.lit(None).cast("string")
    state = points.select("id", F.col("id").alias("cur"), none.alias("top"),
                          F.lit(None).cast("double").alias("top_birth"), none.alias("eps_cluster"), none.alias("outer"))
    rest = cut(edges.select("a", "b", "w"))

    def merge(_key, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        return contract(e, n, min_size, epsilon)

    left = rest.count()
    while left:
        if left <= band_edges:
            band, later = rest, None
        else:
            limit = rest.approxQuantile("w", [band_edges / left], 0.0005)[0]
            band, later = rest.where(F.col("w") <= limit), rest.where(F.col("w") > limit)
        comp = connected_components(band, tail=max(TAIL, band_edges))
        def task(piece):
            return F.pmod(F.xxhash64(piece), F.lit(DEALT))

        # by number: the bytes of pieces don't tell their work
        tagged = nodes.join(comp, "node").withColumn("_n_task", task("component")).repartition(DEALT, "_n_task")
        e = band.join(comp.select(F.col("node").alias("a"), F.col("component").alias("piece")), "a").withColumn("_task", task("piece")).repartition(DEALT, "_task")
        step = cut(e.groupBy("_task").cogroup(tagged.groupBy("_n_task")).applyInPandas(merge, STEP))
        maps = step.where("kind = 'map'")
        state = cut(_update(state, maps))
        nodes = cut(nodes.join(comp.select("node"), "node", "left_anti").unionByName(
            step.where("kind = 'open'").select(*nodes.columns)))
        if later is None:
            break
        to = maps.select("node", "next")
        rest = (later.join(to.select(F.col("node").alias("a"), F.col("next").alias("_a")), "a", "left")
                .join(to.select(F.col("node").alias("b"), F.col("next").alias("_b")), "b", "left")
                .select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "w").where("x <> y")
                .groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("w").alias("w")))
        rest = cut(rest)
        left = rest.count()
    if max_dist is not None:
        open_clusters = nodes.where("cid is not null")
        no_edges = ["a", "b", "w"]

        def finish(batches):
            for n in batches:
                out = contract(pd.DataFrame([], columns=no_edges), n, min_size, epsilon, max_dist)
                yield out[out["kind"] == "map"]

        state = _update(state, open_clusters.mapInPandas(finish, STEP))
    eps_first = F.when(F.col("top_birth") > epsilon, F.col("top"))
    if epsilon > 0:
        label = (F.when(F.col("eps_cluster") == "", F.col("top"))
                 .otherwise(F.coalesce(eps_first, "eps_cluster", "outer")))
    else:
        label = F.col("top")
    return state.select("id", label.alias("cid"))


def density_clusters(df: DataFrame, min_cluster_size: int = 2, min_samples: int = vocab.MIN_SAMPLES,
                     epsilon: float = 0.0, time_weight: float = vocab.TIME_WEIGHT,
                     time_scale: float = vocab.TIME_SCALE_HOURS, max_dist: float | None = None,
                     block: int = BLOCK, band_edges: int = BAND_EDGES) -> DataFrame:
    """Cluster ``(id, vec[, hours][, grp])``; rows of different groups never meet.

    Returns ``(id, label)``: the smallest id of the row's cluster, or -1 for noise."""
    t = df if "hours" in df.columns else df.withColumn("hours", F.lit(None).cast("double"))
    t = t if "grp" in t.columns else t.withColumn("grp", F.lit(""))
    t = cut(t.select("grp", "id", "vec", F.col("hours").cast("double").alias("hours")))
    weight = time_weight_for(t, time_weight)
    points, members = collapse(t)
    points = cut(points)
    index = _indexed(points, weight, time_scale, max_dist, block)
    cores = cut(core_distances(points, min_samples, weight, time_scale, max_dist, block, index))
    edges = spanning_forest(index, cores, weight, time_scale, max_dist)
    chosen = select_clusters(points.select("id", "mult"), edges, min_cluster_size, epsilon, max_dist, band_edges)
    tagged = members.join(chosen.withColumnRenamed("id", "point"), "point", "left")
    names = tagged.where("cid is not null").groupBy("grp", "cid").agg(F.min("member").alias("label"))
    return cut(tagged.join(names, ["grp", "cid"], "left").select(
        F.col("member").alias("id"), F.coalesce("label", F.lit(-1)).alias("label")))


def with_singletons(labels: DataFrame) -> DataFrame:
    """Noise rows become clusters of their own, keyed by the negative id."""
    return labels.withColumn("cluster", F.when(F.col("label") < 0, -F.col("id")).otherwise(F.col("label")))


def split_oversize(df: DataFrame, labels: DataFrame, max_size: int = vocab.MAX_CLUSTER_SIZE,
                   epsilon: float = vocab.SPLIT_EPSILON, max_depth: int = 5, order: str = "id", **options) -> DataFrame:
    """Re-cluster every cluster above ``max_size`` on its own, then chunk what is still too large.

    All oversize clusters of a round are processed together, keyed by their label; members lost to noise
    become -1. Labels come out as the smallest id of their cluster. ``df``: ``id, vec[, hours]``."""
    first = labels.where("label >= 0").groupBy("label").agg(F.min("id").alias("_first"))
    now = cut(labels.join(first, "label", "left").select("id", F.coalesce("_first", "label").alias("label")))
    for _ in range(max_depth):
        big = (now.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > max_size).select("label"))
        todo = cut(now.join(big, "label", "left_semi"))
        if todo.isEmpty():
            break
        part = df.join(todo.select("id", F.col("label").cast("string").alias("grp")), "id")
        sub = density_clusters(part, min_samples=1, epsilon=epsilon, **options)
        fresh = sub.select("id", "label")
        now = cut(now.join(todo.select("id"), "id", "left_anti").select("id", "label").unionByName(fresh))
    sizes = now.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return _chunk(now, sizes, max_size)


def id_runs(rows: DataFrame, size: int, slices: int = 256) -> DataFrame:
    """``rows`` ``(label, id, ...)`` with ``run``: runs of ``size`` ids in id order within each label.

    The position inside a label is the count of earlier id ranges plus the position in the range, so a
    huge label is ranked by many tasks. Labels of at most ``size`` rows are one run and need no ranges."""
    span = rows.groupBy("label").agg(F.min("id").alias("_lo"), F.max("id").alias("_hi"), F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > size).drop("_n")
    small = rows.join(span.select("label"), "label", "left_anti").withColumn("run", F.lit(0).cast("bigint"))
    width = F.greatest(F.ceil((F.col("_hi") - F.col("_lo") + 1) / F.lit(slices)), F.lit(1))
    t = rows.join(span, "label").withColumn("_s", F.floor((F.col("id") - F.col("_lo")) / width)).drop("_lo", "_hi")
    before = Window.partitionBy("label").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ahead = t.groupBy("label", "_s").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    w = Window.partitionBy("label", "_s").orderBy("id")
    large = t.withColumn("_rn", F.row_number().over(w)).join(ahead, ["label", "_s"]).withColumn(
        "run", F.floor((F.col("_before") + F.col("_rn") - 1) / F.lit(size))).drop("_s", "_rn", "_before")
    return large.unionByName(small)


def _chunk(now: DataFrame, sizes: DataFrame, max_size: int) -> DataFrame:
    """Cut clusters above ``max_size`` into runs of ``max_size`` ids in id order."""
    big = sizes.where(F.col("n") > max_size)
    pos = id_runs(now.join(big.select("label"), "label", "left_semi"), max_size)
    first = pos.groupBy("label", "run").agg(F.min("id").alias("_new"))
    cutup = pos.join(first, ["label", "run"]).select("id", F.col("_new").alias("label"))
    return now.join(big.select("label"), "label", "left_anti").select("id", "label").unionByName(cutup)
