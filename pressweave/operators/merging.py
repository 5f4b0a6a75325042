"""Greedy merging of near-identical clusters by centroid, under earlier verdicts.

A verdict that put articles into different groups marks the clusters that hold them: ``marks`` is a list of
``(verdict, group)``, and two clusters that hold different groups of one verdict may not meet. A merged cluster carries the
marks of both, so the ban is contracted with every round.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import cut
from .components import TAIL, connected_components
from .groups import merge_centroids
from .simjoin import BLOCK, CELLS, TASKS, grid, matrix, single_slack, unit_rows  # noqa: F401
from .vectorindex import COPIES, SIDE, Pivots, VectorIndex, fit_pivots, radius

MARKS = "array<struct<f:bigint,g:int>>"
PARTNER = "id bigint, partner bigint, sim double, tie bigint"
ORDER = "(sim, tie)"
#: Clusters that could ever meet are settled by one task where they are no more than this many.
LOCAL = 2048
#: Below this similarity nearly everything could meet sooner or later, and looking for what could not is no use.
APART = 0.6


def pair_hash(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Well mixed non-negative 62-bit number of a pair."""
    with np.errstate(over="ignore"):
        z = lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(2)).astype(np.int64)


def split_marks(members: DataFrame, splits: DataFrame) -> DataFrame:
    """``(cluster, marks)`` for clusters ``(cluster, id)`` and verdicts ``(fingerprint, groups)`` that split articles."""
    rows = splits.select(F.xxhash64("fingerprint").alias("f"), F.posexplode("groups").alias("g", "ids")).select("f", "g", F.explode("ids").alias("id"))
    return members.join(rows, "id").groupBy("cluster").agg(F.collect_set(F.struct("f", "g")).alias("marks"))


def banned(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
    """Which pairs of two blocks hold different groups of one verdict."""
    out = np.zeros((len(x), len(y)), dtype=bool)
    def flat(pdf):
        return pd.DataFrame([(i, m["f"], m["g"]) for i, marks in enumerate(pdf["marks"]) if marks is not None for m in marks], columns=["i", "f", "g"])
    a, b = flat(x), flat(y)
    for f, left in a.groupby("f"):
        right = b[b["f"] == f]
        if len(right):
            i, j = np.nonzero(left["g"].to_numpy()[:, None] != right["g"].to_numpy()[None, :])
            out[left["i"].to_numpy()[i], right["i"].to_numpy()[j]] = True
    return out


def _marked(pdf: pd.DataFrame) -> np.ndarray:
    return np.array([m is not None and len(m) > 0 for m in pdf["marks"]], dtype=bool)


def _allowed(a: pd.DataFrame, b: pd.DataFrame, threshold: float, max_size: int):
    """Pairs that may merge, per vector length and run of left rows: the two sides, the positions in them (left ones ascending)
    and the similarities.

    Single precision finds the few pairs near the threshold or above; all else is done for these alone, in double precision."""
    for n in sorted((set(a["vec"].map(len)) & set(b["vec"].map(len))) - {0}):
        x, y = a[a["vec"].map(len) == n].reset_index(drop=True), b[b["vec"].map(len) == n].reset_index(drop=True)
        ux, uy = unit_rows(matrix(x["vec"])), unit_rows(matrix(y["vec"]))
        fx, fy = ux.astype(np.float32), uy.astype(np.float32).T
        xi, yi, xn, yn = x["id"].to_numpy(np.int64), y["id"].to_numpy(np.int64), x["size"].to_numpy(), y["size"].to_numpy()
        xm, ym, least = _marked(x), _marked(y), np.float32(threshold - single_slack(n))
        step, run = max(1, CELLS // len(y)), max(1, CELLS // n)
        for at in range(0, len(x), step):
            r, c = np.nonzero(fx[at:at + step] @ fy >= least)
            r += at
            ok = (xn[r] + yn[c] <= max_size) & (xi[r] != yi[c])
            r, c = r[ok], c[ok]
            sim = np.empty(len(r))
            for i in range(0, len(r), run):
                sim[i:i + run] = np.einsum("ij,ij->i", ux[r[i:i + run]], uy[c[i:i + run]])
            sim = np.round(sim, 9)
            ok = sim >= threshold
            both = np.flatnonzero(ok & xm[r] & ym[c])
            if len(both):
                (rows, i), (cols, j) = np.unique(r[both], return_inverse=True), np.unique(c[both], return_inverse=True)
                ok[both[banned(x.iloc[rows], y.iloc[cols])[i, j]]] = False
            if ok.any():
                yield x, y, r[ok], c[ok], sim[ok]


def _ties(xi: np.ndarray, yi: np.ndarray) -> np.ndarray:
    return pair_hash(np.minimum(xi, yi), np.maximum(xi, yi))


def _first_of(key: np.ndarray, sim: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Per key the position of its greatest ``sim``, among equals that of the least ``tie``."""
    order = np.argsort(key, kind="stable")
    key, sim, tie = key[order], sim[order], tie[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[starts, len(key)])
    tie = np.where(sim == np.repeat(np.maximum.reduceat(sim, starts), n), tie, np.iinfo(np.int64).max)
    hit = np.flatnonzero(tie == np.repeat(np.minimum.reduceat(tie, starts), n))
    return order[hit[np.unique(key[hit], return_index=True)[1]]]


def half_grid(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of all pairs of blocks of one table, each pair of blocks once (``lc <= rc``)."""
    n = rows.count()
    parts = max(math.ceil(n / max(block, min(SIDE, math.ceil(n / COPIES)))), 1)
    t = rows.where(F.size("vec") > 0).withColumn("_own", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(parts)).cast("int"))
    left = t.withColumn("rc", F.explode(F.sequence("_own", F.lit(parts - 1)))).withColumnRenamed("_own", "lc")
    return left, t.withColumn("lc", F.explode(F.sequence(F.lit(0), "_own"))).withColumnRenamed("_own", "rc")


def _per_pair(sides: tuple[DataFrame, DataFrame], cols: list[str], body, schema: str) -> DataFrame:
    lt, rt = sides
    rt = rt.select(*[F.col(c).alias(f"r_{c}") for c in [*cols, "lc", "rc"]])
    return lt.select(*cols, "lc", "rc").groupBy("lc", "rc").cogroup(rt.groupBy("r_lc", "r_rc")).applyInPandas(
        lambda _key, a, b: body(a, b.rename(columns=lambda c: c[2:])), schema)


def best_partners(sides: tuple[DataFrame, DataFrame], threshold: float, max_size: int, both: bool = False) -> DataFrame:
    """``id, partner, sim, tie`` per pair of blocks of ``sides``: the most similar right cluster that each left one may join;
    with ``both`` also the most similar left cluster marked ``made`` for each right one.

    Equal similarities are ordered by a hash of the pair, the same from both ends, so that a large set of
    copies pairs off in parallel."""
    def propose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "partner": [], "sim": [], "tie": []}).astype({"id": "int64", "partner": "int64", "sim": "float64", "tie": "int64"})]
        for x, y, r, c, sim in _allowed(a, b, threshold, max_size):
            xi, yi = x["id"].to_numpy(np.int64)[r], y["id"].to_numpy(np.int64)[c]
            tie = _ties(xi, yi)
            at = _first_of(r, sim, tie)
            out.append(pd.DataFrame({"id": xi[at], "partner": yi[at], "sim": sim[at], "tie": tie[at]}))
            made = np.flatnonzero(x["made"].to_numpy(bool)[r]) if both else []
            if len(made):
                at = made[_first_of(c[made], sim[made], tie[made])]
                out.append(pd.DataFrame({"id": yi[at], "partner": xi[at], "sim": sim[at], "tie": tie[at]}))
        return pd.concat(out)

    return _per_pair(sides, ["id", "vec", "size", "marks", "made"], propose, PARTNER)


def _best(found: DataFrame) -> DataFrame:
    order = F.struct("sim", (-F.col("tie")).alias("t"), (-F.col("partner")).alias("p"))
    return found.groupBy("id").agg(F.max_by(F.struct("partner", "sim", "tie"), order).alias("b")).select(
        "id", "b.partner", "b.sim", "b.tie")


def disturbed(sides: tuple[DataFrame, DataFrame], threshold: float, max_size: int) -> DataFrame:
    """``pair`` of clusters about to merge that a better pair's merged cluster would come closer to.

    The left side has the would-be merged clusters and the right one the clusters of all pairs; both carry ``pair, psim, ptie``."""
    def check(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for x, y, r, c, sim in _allowed(a, b, threshold, max_size):
            tie = _ties(x["id"].to_numpy(np.int64)[r], y["id"].to_numpy(np.int64)[c])
            qs, qt, q = (x[k].to_numpy()[r] for k in ("psim", "ptie", "pair"))
            ps, pt, p = (y[k].to_numpy()[c] for k in ("psim", "ptie", "pair"))
            first = (qs > ps) | ((qs == ps) & (qt < pt))
            closer = (sim > ps) | ((sim == ps) & (tie < pt))
            out |= set(p[first & closer & (q != p)].tolist())
        return pd.DataFrame({"pair": sorted(out)}, dtype="int64")

    return _per_pair(sides, ["id", "vec", "size", "marks", "pair", "psim", "ptie"], check, "pair bigint").distinct()


def least_similarity(threshold: float, max_size: int) -> float:
    """Clusters of at least one article that come to stand in two clusters about to meet: the nearest of them are at least this similar.

    A centroid is a positive sum of its parts. Each join at ``threshold`` leaves no less than ``sqrt((1 + threshold) / 2)`` of the
    length that the parts would have in line, and two clusters that fit together have made at most ``max_size - 2`` joins."""
    return threshold * ((1 + threshold) / 2) ** (max(max_size - 2, 0) / 2) - 1e-6


def linked(sides: tuple[DataFrame, DataFrame], least: float, max_size: int) -> DataFrame:
    """``a, b``: edges that connect what pairs of at least this similarity and of fitting size connect, no more than rows per pair of blocks."""
    def edges(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for n in sorted((set(a["vec"].map(len)) & set(b["vec"].map(len))) - {0}):
            x, y = a[a["vec"].map(len) == n], b[b["vec"].map(len) == n]
            fx, fy = unit_rows(matrix(x["vec"])).astype(np.float32), unit_rows(matrix(y["vec"])).astype(np.float32).T
            xi, yi, xn, yn = x["id"].to_numpy(np.int64), y["id"].to_numpy(np.int64), x["size"].to_numpy(), y["size"].to_numpy()
            names, at = np.unique(np.concatenate([xi, yi]), return_inverse=True)
            xs, ys, to, step = at[:len(xi)], at[len(xi):], np.arange(len(names)), max(1, CELLS // len(y))
            for i in range(0, len(x), step):
                r, c = np.nonzero(fx[i:i + step] @ fy >= np.float32(least - single_slack(n)))
                r += i
                ok = (xn[r] + yn[c] <= max_size) & (xi[r] != yi[c])
                r, c = xs[r[ok]], ys[c[ok]]
                while (to[r] != to[c]).any():
                    low = np.minimum(to[r], to[c])
                    np.minimum.at(to, to[r], low)
                    np.minimum.at(to, to[c], low)
                    while (to[to] != to).any():
                        to = to[to]
            own = np.flatnonzero(to != np.arange(len(to)))
            found.append(pd.DataFrame({"a": names[to[own]], "b": names[own]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return _per_pair(sides, ["id", "vec", "size"], edges, "a bigint, b bigint").distinct()


def merged_within(pdf: pd.DataFrame, threshold: float, max_size: int) -> pd.DataFrame:
    """``id, merged`` of clusters that only meet each other, by the rounds of :func:`merge_clusters`."""
    ids, vec, size = pdf["id"].to_numpy(np.int64), matrix(pdf["vec"]), pdf["size"].to_numpy(np.int64)
    order = np.argsort(ids)
    ids, vec, size = ids[order], vec[order], size[order]
    marks = [{(m["f"], m["g"]) for m in (x if x is not None else ())} for x in pdf["marks"].iloc[order]]
    owner, alive = np.arange(len(ids)), np.ones(len(ids), dtype=bool)

    def allowed(x, y, xm, ym):
        """Similarities of the positions ``x`` and ``y`` with these vectors, sizes and marks; -inf where they may not meet."""
        sim = np.round(np.einsum("ij,kj->ik", unit_rows(x[1]), unit_rows(y[1])), 9)
        sim[(sim < threshold) | (x[2][:, None] + y[2][None, :] > max_size) | (ids[x[0]][:, None] == ids[y[0]][None, :])] = -np.inf
        for i in (i for i, m in enumerate(xm) if m):
            for j in np.flatnonzero(np.isfinite(sim[i])):
                if any(f == f2 and g != g2 for f, g in xm[i] for f2, g2 in ym[j]):
                    sim[i, j] = -np.inf
        return sim

    while True:
        at = np.flatnonzero(alive)
        here = (at, vec[at], size[at])
        mine = [marks[i] for i in at]
        sim = allowed(here, here, mine, mine)
        best = sim.max(axis=1)
        r, c = np.nonzero((sim == best[:, None]) & np.isfinite(best)[:, None])
        if not len(r):
            return pd.DataFrame({"id": ids, "merged": ids[owner]})
        tie = _ties(ids[at[r]], ids[at[c]])
        by = np.lexsort((c, tie, r))
        r, c, tie = r[by], c[by], tie[by]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        r, c, tie = r[first], c[first], tie[first]
        to = np.full(len(at), -1)
        to[r] = c
        pick = np.flatnonzero((to[c] == r) & (r < c))
        if not len(pick):  # rounding broke a symmetry
            pick = np.lexsort((r, tie, -best[r]))[:1]
        lo, hi = np.minimum(at[r[pick]], at[c[pick]]), np.maximum(at[r[pick]], at[c[pick]])
        psim, ptie, n = best[r[pick]], tie[pick], size[lo] + size[hi]
        weight = size.astype(float)
        joined = (vec[lo] * weight[lo][:, None] + vec[hi] * weight[hi][:, None]) / (weight[lo] + weight[hi])[:, None]
        both = [marks[i] | marks[j] for i, j in zip(lo, hi)]
        parts, pair = np.concatenate([lo, hi]), np.tile(np.arange(len(lo)), 2)
        near = allowed((lo, joined, n), (parts, vec[parts], size[parts]), both, [marks[i] for i in parts])
        q, p = np.nonzero(np.isfinite(near))
        s, t, p2 = near[q, p], _ties(ids[lo[q]], ids[parts[p]]), pair[p]
        ahead = (psim[q] > psim[p2]) | ((psim[q] == psim[p2]) & (ptie[q] < ptie[p2]))
        closer = (s > psim[p2]) | ((s == psim[p2]) & (t < ptie[p2]))
        go = np.ones(len(lo), dtype=bool)
        go[p2[ahead & closer & (q != p2)]] = False
        for k in np.flatnonzero(go):
            i, j = lo[k], hi[k]
            vec[i], size[i], marks[i], alive[j] = joined[k], n[k], both[k], False
            owner[owner == j] = i


def merge_clusters(clusters: DataFrame, threshold: float = vocab.MERGE_THRESHOLD,
                   max_size: int = vocab.MERGE_MAX_SIZE, block: int = BLOCK, local: int = LOCAL) -> DataFrame:
    """``(id, merged)`` for clusters ``(id, size, centroid[, marks])``: repeatedly join the most similar pair at or above
    the threshold whose joint size fits and whose marks allow it, with the size-weighted mean as the new centroid.

    A round joins all pairs that are each other's best choice, except those that the merged cluster of a better pair would
    come closer to: these wait, as they would in the sequential order. Only clusters that were made in the last round, or
    lost their partner in it, look for one again; the index keeps them to the cells in reach.

    Clusters that no merging can bring together (see :func:`least_similarity`) know nothing of each other: what can meet is found
    once, and up to ``local`` such clusters go through their rounds in one task. Only larger sets take rounds over all tasks."""
    marks = F.col("marks").cast(MARKS) if "marks" in clusters.columns else F.lit(None).cast(MARKS)
    now = cut(clusters.select(F.lit("").alias("grp"), "id", F.col("centroid").cast("array<double>").alias("vec"), F.col("size").cast("bigint").alias("size"),
                              marks.alias("marks"), F.lit(False).alias("made")))
    near = least_similarity(threshold, max_size)
    few = now.agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).first()
    if not local or near < APART or few["least"] is None or few["least"] < 1:
        return _rounds(now, threshold, max_size, block)
    if few["n"] <= block:
        sides = half_grid(now, block)
    else:
        pivots = fit_pivots(now, block)
        whole = VectorIndex.build(now, block, pivots) if pivots else None
        sides = whole.grid(whole, near) if whole and whole.skips(whole, radius(near)) else half_grid(now, block)
    comp = cut(connected_components(cut(linked(sides, near, max_size)), tail=TAIL))
    many = comp.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    tagged = cut(now.join(comp.join(many, "component").withColumnRenamed("node", "id"), "id"))
    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        return merged_within(pdf, threshold, max_size)

    out = tagged.where(F.col("_n") <= local).groupBy("component").applyInPandas(within, "id bigint, merged bigint").unionByName(
        clusters.select("id", F.col("id").alias("merged")).join(comp.select(F.col("node").alias("id")), "id", "left_anti"))
    large = tagged.where(F.col("_n") > local)
    return cut(out if large.isEmpty() else out.unionByName(_rounds(cut(large.select(*now.columns)), threshold, max_size, block)))


def _rounds(now: DataFrame, threshold: float, max_size: int, block: int) -> DataFrame:
    """``id, merged`` by rounds over all tasks; see :func:`merge_clusters`."""
    member = cut(now.select("id", F.col("id").alias("merged")))
    pivots: Pivots = fit_pivots(now, block)

    def sides(left, right):
        if not pivots:
            return grid(left, right, block)
        return VectorIndex.build(left, block, pivots).grid(VectorIndex.build(right, block, pivots), threshold)

    whole = VectorIndex.build(now, block, pivots) if pivots else None
    if pivots and not whole.skips(whole, radius(threshold)):  # asked once, not in every round
        pivots = {}
    if pivots:
        found = best_partners(whole.grid(whole, threshold), threshold, max_size)
    else:
        found = best_partners(half_grid(now.withColumn("made", F.lit(True)), block), threshold, max_size, both=True)
    want = cut(_best(found))
    while True:
        back = want.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
        mutual = cut(want.join(back, ["id", "partner"]).where("id < partner"))
        if mutual.isEmpty():
            if want.isEmpty():
                return member
            top = want.orderBy(F.col("sim").desc(), "tie", "id").limit(1)  # rounding broke a symmetry
            mutual = cut(top.select(F.least("id", "partner").alias("id"), F.greatest("id", "partner").alias("partner"), "sim", "tie"))
        right = now.select(F.col("id").alias("partner"), F.col("size").alias("_n"), F.col("vec").alias("_v"), F.col("marks").alias("_m"))
        union = F.array_union(F.coalesce("marks", F.array().cast(MARKS)), F.coalesce("_m", F.array().cast(MARKS)))
        tag = [F.col("pair"), F.col("sim").alias("psim"), F.col("tie").alias("ptie")]
        pairs = mutual.withColumn("pair", F.col("id"))
        joined = cut(now.join(pairs, "id").join(right, "partner").select(
            "grp", "id", merge_centroids("vec", "size", "_v", "_n").alias("vec"), (F.col("size") + F.col("_n")).alias("size"), union.alias("marks"),
            F.lit(True).alias("made"), *tag))
        parts = cut(now.join(pairs.select("id", "pair", "sim", "tie").unionByName(pairs.select(F.col("partner").alias("id"), "pair", "sim", "tie")), "id").select(
            *now.columns, *tag))
        waiting = disturbed(sides(joined, parts), threshold, max_size)
        pairs = cut(mutual.join(waiting.select(F.col("pair").alias("id")), "id", "left_anti"))
        made = joined.join(pairs.select("id"), "id", "left_semi").select(*now.columns)
        touched = cut(pairs.select("id").union(pairs.select("partner")))
        now = cut(now.join(touched, "id", "left_anti").withColumn("made", F.lit(False)).unionByName(made))
        to = pairs.select(F.col("partner").alias("merged"), F.col("id").alias("_to"))
        member = cut(member.join(to, "merged", "left").select("id", F.coalesce("_to", "merged").alias("merged")))
        kept = want.join(touched, "id", "left_anti")
        lost = kept.join(touched.withColumnRenamed("id", "partner"), "partner", "left_semi").select("id")
        kept = kept.join(touched.withColumnRenamed("id", "partner"), "partner", "left_anti").select(*want.columns)
        looking = cut(now.join(lost.union(pairs.select("id")), "id", "left_semi"))
        fresh = best_partners(sides(looking, now), threshold, max_size, both=True)
        want = cut(_best(kept.unionByName(fresh)))
