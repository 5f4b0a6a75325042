"""A partitioned inverted-file index over vectors, for exact and approximate cosine joins.

Pivots are fitted on a bounded sample. Every row belongs to the cell of its nearest pivot and knows its angle to it;
large cells are cut into rings of equal angles and, where even a ring is large (copies), by a hash of the id, so
that a chunk has about ``block`` rows however rows are spread. Angles obey the triangle inequality: a row or
chunk whose bound to another chunk exceeds the angle asked for can hold no partner there and is skipped, exactly.
What is left are pairs of chunks, one matrix product each.

Vectors of different lengths never meet. Zero vectors have no angle and small groups no need of cells: both stand in
cells of their own that are never skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

MAX_PIVOTS = 512
#: Sampled rows per pivot that the fit may use; the driver holds no more than this many vectors.
SAMPLE = 8
RINGS = 64
#: Added to every radius: rounding of cosines next to 1.
SLACK = 1e-6
#: Without pivots a group has about this many chunks, as long as a chunk has no more than ``SIDE`` rows: so often is a row copied.
COPIES = 16
SIDE = 32768
#: Groups of one chunk are compared in so many packs, not one by one.
PACKS = 8192
#: Rows of a cell that a probe compares at once with as many queries, if a block is smaller.
PROBED = 8192

Pivots = dict[int, np.ndarray]


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(n > 0, n, 1.0)[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(a) @ unit(b).T, -1.0, 1.0))


def radius(min_sim: float) -> float:
    """The greatest angle of two rows with at least this similarity."""
    return float(np.arccos(np.clip(min_sim, -1.0, 1.0))) + SLACK


def fit_pivots(rows: DataFrame, block: int, most: int = MAX_PIVOTS) -> Pivots:
    """Centres of a bounded sample, per vector length: far-apart rows first, then three rounds of means.

    One pivot for every ``block`` rows of groups that are larger than a block, at most ``most``; none if no group is. The
    sample is picked by a hash of the ids."""
    sizes = rows.groupBy("grp", F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > block) & (F.col("d") > 0))
    counts = {r["d"]: r["n"] for r in sizes.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    whole, out = sum(counts.values()), {}
    for d, n in counts.items():
        k = max(1, min(most, -(-n // block)) * n // whole) if n > block else 0
        if not k:
            continue
        share = min(1.0, 2.0 * SAMPLE * k / n)
        mixed = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30))
        some = rows.where(F.size("vec") == d).where(mixed < int(share * (1 << 30))).select("vec").limit(4 * SAMPLE * k).collect()
        m = unit(np.array([r["vec"] for r in some], dtype=np.float64).reshape(len(some), d))
        m = m[np.einsum("ij,ij->i", m, m) > 0.5]
        if not len(m):
            continue
        picked, near = [0], m @ m[0]
        while len(picked) < min(k, len(m)):
            at = int(near.argmin())
            if near[at] > 1 - 1e-12:  # only copies are left
                break
            picked.append(at)
            near = np.maximum(near, m @ m[at])
        pivots = m[picked]
        for _ in range(3):
            own = (m @ pivots.T).argmax(axis=1)
            total = np.zeros_like(pivots)
            np.add.at(total, own, m)
            kept = np.einsum("ij,ij->i", total, total) > 1e-12
            pivots = np.where(kept[:, None], unit(total), pivots)
        out[d] = pivots
    return out


def place(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """``rows`` with ``_len``, the cell ``_pid`` (-1 without one) and the angle ``_ang`` to its pivot."""
    if not pivots:
        return rows.select("*", F.size("vec").alias("_len"), F.lit(-1).alias("_pid"), F.lit(0.0).alias("_ang"))

    @F.pandas_udf("struct<pid int, ang double>")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        pid, ang = np.full(len(vec), -1, np.int32), np.zeros(len(vec))
        length = vec.map(len).to_numpy()
        for d in set(length.tolist()) & set(pivots):
            at = np.flatnonzero(length == d)
            m = np.stack([np.asarray(v, dtype=np.float64) for v in vec.iloc[at]])
            sim = unit(m) @ pivots[d].T
            best = sim.argmax(axis=1)
            real = np.einsum("ij,ij->i", m, m) > 0
            pid[at] = np.where(real, best, -1)
            ang[at] = np.where(real, np.arccos(np.clip(sim[np.arange(len(at)), best], -1.0, 1.0)), 0.0)
        return pd.DataFrame({"pid": pid, "ang": ang})

    t = rows.withColumn("_p", nearest("vec"))
    return t.select(*rows.columns, F.size("vec").alias("_len"), F.col("_p.pid").alias("_pid"), F.col("_p.ang").alias("_ang"))


CELL = ["grp", "_len", "_pid"]


def chunked(placed: DataFrame, block: int, pivots: Pivots) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """``(rows, chunks, counts)``: rows with ``_chunk``, and ``grp, _len, _pid, _chunk, lo, hi, n`` of every chunk.

    A group of at most ``block`` rows is one chunk without a pivot. Without any pivots, ``counts`` says how many
    chunks a group has (larger ones in larger groups, see ``COPIES``), and the rows know it as ``_own``."""
    def counts(t, keys, copies=None):
        n = F.count(F.lit(1))
        size = F.greatest(F.lit(block), F.least(F.lit(SIDE), F.ceil(n / F.lit(copies)))) if copies else F.lit(block)
        return t.groupBy(*keys).agg(F.greatest(F.ceil(n / size), F.lit(1)).alias("_subs"))

    def cut_up(t, keys, copies=None):
        return t.join(counts(t, keys, copies), keys).withColumn("_chunk", F.concat_ws(":", "_len", "_pid", "_ring", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("_subs")))).drop(
            "_ring")

    def stats(rows, *more):
        return rows.groupBy(*CELL, "_chunk").agg(F.min("_ang").alias("lo"), F.max("_ang").alias("hi"), F.count(F.lit(1)).alias("n"), *more)
    if not pivots:  # hashed chunks only; nothing to write down
        rows = cut_up(placed.withColumn("_ring", F.lit(0)), ["grp", "_len"], COPIES).withColumnRenamed("_subs", "_own")
        return rows, stats(rows, F.max("_own").alias("_own")), counts(placed, ["grp", "_len"], COPIES)
    sizes = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("_gn"))
    t = placed.join(sizes, "grp").withColumn("_pid", F.when(F.col("_gn") > block, F.col("_pid")).otherwise(-1)).drop("_gn")
    t = cut(t.withColumn("_ang", F.when(F.col("_pid") >= 0, F.col("_ang")).otherwise(0.0)))
    steps = F.array(*(F.lit((i + 1) / RINGS) for i in range(RINGS - 1)))
    cells = t.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_ang", steps, 2000).alias("_q"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("_n") / F.lit(block)).cast("int"))
    ringed = t.join(cells, CELL).withColumn("_ring", F.when(F.col("_n") <= block, F.lit(0)).otherwise(
        F.floor(F.size(F.filter("_q", lambda q: q < F.col("_ang"))) * rings / RINGS)).cast("int")).drop("_q", "_n")
    rows = cut(cut_up(ringed, [*CELL, "_ring"]).drop("_subs"))
    return rows, cut(stats(rows)), None


def chunk_bound(g: Column, lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """The least angle that rows within ``[lo, hi]`` and ``[lo2, hi2]`` of two pivots at angle ``g`` can have."""
    return F.greatest(g - hi - hi2, lo - g - hi2, lo2 - g - hi, F.lit(0.0))


def cell_pairs(spark: SparkSession, pivots: Pivots, left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """``(_len, lp, rp, g)``: the pairs of cells within reach and the angles of their pivots (at most pivots squared).

    Cells without a pivot meet every cell of their length."""
    def cells(chunks):
        got = chunks.groupBy("_len", "_pid").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        out = {}
        for r in got:
            out.setdefault(r["_len"], []).append((r["_pid"], r["lo"], r["hi"]))
        return out
    lefts, rights, frames = cells(left), cells(right), []
    for d in sorted(set(lefts) & set(rights) - {0}):
        (lp, _, lhi), (rp, _, rhi) = (np.array(sorted(x[d])).T for x in (lefts, rights))
        lp, rp = lp.astype(int), rp.astype(int)
        g = np.zeros((len(lp), len(rp)))
        real = (lp[:, None] >= 0) & (rp[None, :] >= 0)
        if real.any():
            p = pivots[d]
            between = angles(p, p)
            np.fill_diagonal(between, 0.0)
            g = np.where(real, between[np.ix_(lp, rp)], 0.0)
        i, j = np.nonzero(~real | (g - lhi[:, None] - rhi[None, :] <= reach))
        frames.append(pd.DataFrame({"_len": d, "lp": lp[i], "rp": rp[j], "g": g[i, j]}))
    some = pd.concat(frames) if frames else pd.DataFrame({"_len": [], "lp": [], "rp": [], "g": []})
    return spark.createDataFrame(some, "_len int, lp int, rp int, g double")


def chunk_pairs(spark: SparkSession, pivots: Pivots, left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """``(grp, lc, rc, g, llo, lhi, rlo, rhi)``: the pairs of chunks of one group that can hold a pair within ``reach``."""
    a = left.select("grp", "_len", F.col("_pid").alias("lp"), F.col("_chunk").alias("lc"), F.col("lo").alias("llo"), F.col("hi").alias("lhi"))
    b = right.select("grp", "_len", F.col("_pid").alias("rp"), F.col("_chunk").alias("rc"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    if pivots:
        both = a.join(cell_pairs(spark, pivots, left, right, reach), ["_len", "lp"]).join(b, ["grp", "_len", "rp"])
    else:
        both = a.join(b, ["grp", "_len"]).where("_len > 0").withColumn("g", F.lit(0.0))
    free = (F.col("lp") < 0) | (F.col("rp") < 0)
    for c, value in (("llo", 0.0), ("rlo", 0.0), ("lhi", np.pi), ("rhi", np.pi)):
        both = both.withColumn(c, F.when(free, F.lit(value)).otherwise(F.col(c)))
    return both.where(chunk_bound(F.col("g"), F.col("llo"), F.col("lhi"), F.col("rlo"), F.col("rhi")) <= reach).select(
        "grp", "lc", "rc", "g", "llo", "lhi", "rlo", "rhi")


def _sent(rows: DataFrame, pairs: DataFrame, own: str, lo: str, hi: str, reach) -> DataFrame:
    """Rows copied to the chunk pairs of their chunk in which they can have a partner."""
    pairs = pairs.hint("merge")  # there may be far more pairs than their small files tell
    t = rows.join(pairs, [rows["grp"] == pairs["grp"], rows["_chunk"] == pairs[own]]).drop(pairs["grp"])
    near = chunk_bound(F.col("g"), F.col("_ang"), F.col("_ang"), F.col(lo), F.col(hi)) <= reach
    return t.where(near).select(*rows.columns, "lc", "rc")


def named(rows: DataFrame) -> DataFrame:
    """Chunk names with their group, so that ``(lc, rc)`` alone is a key."""
    return rows.withColumns({c: F.concat_ws("/", c, "grp") for c in ("lc", "rc")})


class VectorIndex:
    """Rows ``(grp, id, vec, ...)`` in chunks, with their pivots."""

    def __init__(self, rows: DataFrame, chunks: DataFrame, counts: DataFrame | None, pivots: Pivots, block: int):
        self.rows, self.chunks, self.counts, self.pivots, self.block = rows, chunks, counts, pivots, block

    @classmethod
    def build(cls, rows: DataFrame, block: int = 2048, pivots: Pivots | None = None) -> VectorIndex:
        """Index every row; pivots are fitted unless given."""
        if pivots is None:
            pivots = fit_pivots(rows, block)
        return cls(*chunked(place(rows, pivots), block, pivots), pivots, block)

    def grid(self, other: VectorIndex, min_sim: float, reach: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows of both sides per pair of blocks ``(lc, rc)`` that may hold a pair of at least ``min_sim``.

        A block is a chunk of one group, or a pack of groups that have a single chunk on either side; ``lc`` and ``rc`` name it
        among those of all groups. ``reach`` is an angle per left row (no more than that of ``min_sim``), if it is known to be
        smaller. Where the angles skip so little that larger chunks without pivots make fewer copies, these are used."""
        if not self.pivots:  # nothing to skip
            def all_of(rows, counts, own, theirs):
                each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_subs") - 1))
                alone = (F.col("_own") == 1) & (F.col("_subs") == 1)
                pack = F.concat(F.lit("*"), F.pmod(F.xxhash64(F.lit(7), "grp"), F.lit(PACKS)).cast("string"))
                t = rows.join(counts, ["grp", "_len"]).where("_len > 0").withColumn("_i", each)
                return t.withColumn(own, F.when(alone, pack).otherwise(F.concat_ws("/", "_chunk", "grp"))).withColumn(theirs, F.when(
                    alone, pack).otherwise(F.concat_ws("/", F.concat_ws(":", "_len", F.lit("-1:0"), "_i"), "grp"))).drop("_subs", "_own", "_i")
            return all_of(self.rows, other.counts, "lc", "rc"), all_of(other.rows, self.counts, "rc", "lc")
        most = radius(min_sim)
        if not self.skips(other, most, reach):
            return self.plain().grid(other.plain(), min_sim)
        pairs = cut(chunk_pairs(self.rows.sparkSession, self.pivots, self.chunks, other.chunks, most))
        return (named(_sent(self.rows, pairs, "lc", "rlo", "rhi", F.lit(most) if reach is None else reach)),
                named(_sent(other.rows, pairs, "rc", "llo", "lhi", F.lit(most))))

    def plain(self) -> VectorIndex:
        """The same rows in hashed chunks without pivots."""
        rows = self.rows.drop("_len", "_pid", "_ang", "_chunk")
        return VectorIndex.build(rows, self.block, {})

    def skips(self, other: VectorIndex, most: float, reach: Column | None = None) -> bool:
        """Do the angles leave fewer copies of a row than chunks without pivots would make?

        An estimate that only decides how rows are laid out: all pairs of chunks within ``most``, or within the mean ``reach`` of
        the left chunk's rows, count whole."""
        need = F.lit(most)
        pairs = chunk_pairs(self.rows.sparkSession, self.pivots, self.chunks, other.chunks, most)
        if reach is not None:
            mean = self.rows.groupBy("grp", F.col("_chunk").alias("lc")).agg(F.avg(reach).alias("_need"))
            pairs, need = pairs.join(mean, ["grp", "lc"]), F.col("_need")
        pairs = pairs.where(chunk_bound(F.col("g"), F.col("llo"), F.col("lhi"), F.col("rlo"), F.col("rhi")) <= need)
        ln, rn = (i.chunks.select("grp", F.col("_chunk").alias(c), F.col("n").alias(f"{c}_n")) for i, c in ((self, "lc"), (other, "rc")))
        made = pairs.join(ln, ["grp", "lc"]).join(rn, ["grp", "rc"]).agg(F.sum(F.col("lc_n") + F.col("rc_n"))).first()[0] or 0

        def sizes(index, name):
            n = index.chunks.groupBy("grp", "_len").agg(F.sum("n").alias(name))
            size = F.greatest(F.lit(index.block), F.least(F.lit(SIDE), F.ceil(F.col(name) / F.lit(COPIES))))
            return n.withColumn(f"{name}_k", F.ceil(F.col(name) / size))
        plain = sizes(self, "_l").join(sizes(other, "_r"), ["grp", "_len"]).agg(
            F.sum(F.col("_l") * F.col("_r_k") + F.col("_r") * F.col("_l_k"))).first()[0] or 0
        return made <= plain

    def pairs(self, other: VectorIndex, min_sim: float) -> tuple[int, int]:
        """``(compared, all)`` pairs of chunks for a join at ``min_sim``."""
        some = chunk_pairs(self.rows.sparkSession, self.pivots, self.chunks, other.chunks, radius(min_sim)).count()
        n = self.chunks.groupBy("grp").agg(F.count(F.lit(1)).alias("l")).join(
            other.chunks.groupBy("grp").agg(F.count(F.lit(1)).alias("r")), "grp").agg(F.sum(F.col("l") * F.col("r"))).first()[0]
        return some, n or 0

    def write(self, path: str) -> None:
        """Cells as partitions, so that a search reads only those that it probes."""
        spark = self.rows.sparkSession
        rows = self.rows.repartitionByRange("_len", "_pid", "_chunk")  # a cell in few files, not in one of every task
        rows.write.mode("overwrite").partitionBy("_len", "_pid").parquet(f"{path}/rows")
        self.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
        flat = [(int(d), i, self.block, [float(x) for x in v]) for d, m in self.pivots.items() for i, v in enumerate(m)] or [(-1, -1, self.block, [])]
        spark.createDataFrame(flat, "d int, i int, block int, v array<double>").write.mode("overwrite").parquet(f"{path}/pivots")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        flat = spark.read.parquet(f"{path}/pivots").orderBy("d", "i").collect()  # at most MAX_PIVOTS per length
        pivots = {}
        for r in flat:
            if r["d"] >= 0:
                pivots.setdefault(r["d"], []).append(r["v"])
        chunks = spark.read.parquet(f"{path}/chunks")
        return cls(spark.read.parquet(f"{path}/rows"), chunks, None if pivots else chunks.groupBy("grp", "_len").agg(F.max("_own").alias("_subs")),
                   {d: np.array(v) for d, v in pivots.items()}, flat[0]["block"])

    def probe(self, queries: DataFrame, probes: int) -> tuple[DataFrame, DataFrame]:
        """Rows of both sides per ``(lc, rc)``: queries ``(grp, id, vec, ...)`` with the chunks of their ``probes`` nearest
        cells (and of cells without a pivot), and those chunks' rows. Approximate: rows of other cells are not seen."""
        pivots = self.pivots

        @F.pandas_udf("array<int>")
        def nearest(vec: pd.Series) -> pd.Series:
            out = []
            for v in vec:
                p = pivots.get(len(v))
                cells = [] if p is None else np.argsort(-(p @ np.asarray(v, dtype=np.float64)), kind="stable")[:probes].tolist()
                out.append([-1, *cells])
            return pd.Series(out)

        cells = nearest("vec") if pivots else F.array(F.lit(-1))
        asked = queries.select("*", F.size("vec").alias("_len"), F.explode(cells).alias("_pid"))
        size, chunk = F.lit(max(self.block, PROBED)), F.concat_ws(":", "_len", "_pid", "_sub")
        parts = asked.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
        subs = self.chunks.groupBy(*CELL).agg(F.ceil(F.sum("n") / size).alias("_subs"))

        def each(n):
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        lt = asked.join(parts, CELL).join(subs, CELL).withColumn("_sub", each("_subs"))
        lt = lt.withColumns({"lc": F.pmod(F.xxhash64(F.lit(5), "id"), F.col("_parts")).cast("string"), "rc": chunk}).select(*queries.columns, "lc", "rc")
        rt = self.rows.join(parts, CELL).join(subs, CELL).withColumn("_sub", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("_subs"))).withColumn("_part", each("_parts"))
        rt = rt.withColumns({"lc": F.col("_part").cast("string"), "rc": chunk}).drop("_len", "_pid", "_ang", "_chunk", "_sub", "_subs", "_part", "_parts")
        return named(lt), named(rt)
