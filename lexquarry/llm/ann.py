"""Approximate nearest neighbours by collision counting over single projections.

Every block of vectors keeps PROJECTIONS sorted arrays, one for each random direction.  A query opens a window of the
same width around its own projection in every array; a vector collides where it lies within the window.  Windows widen
step by step (virtual rehashing: no array is built anew), only the newly opened rings are counted, and a vector whose
collisions reach the threshold is verified with its exact cosine.  A query ends once its k-th best lies within the
radius that its windows stand for; the last step opens the windows wholly, so fewer than k found means that the block
holds no more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import materialise, table

#: Directions; half a window's width for radius 1; first radius, its growth, and the radius at which the windows open wholly.
PROJECTIONS, WIDTH, FIRST, GROWTH, LAST = 128, 0.9, 0.2, 1.15, 2.0
#: A vector at the radius collides with probability 2 Phi(WIDTH) - 1 in each array; the threshold lies this many deviations below.
SLACK = 1.5
#: Vectors and queries of a block.  A vector is read once for each block of queries, a query once for each block of vectors.
VECTORS, QUERIES = 32768, 8192
#: Queries whose counts are held at a time.
HELD = 128


def threshold(m: int = PROJECTIONS) -> int:
    p = math.erf(WIDTH / math.sqrt(2))
    return math.ceil(m * p - SLACK * math.sqrt(m * p * (1 - p)))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component near 1: cosines stay to the last bit, and neither
    squares of large components overflow nor those of small ones vanish."""
    top = np.abs(vectors).max(axis=1)
    return np.ldexp(vectors, -np.frexp(top)[1][:, None])


class CollisionIndex:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        """rows: numbers that no two vectors share; ids: their keys, by which ties are settled."""
        self.number, self.ids, self.vectors = rows, ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], PROJECTIONS))
        at = (vectors / self.norms[:, None]) @ self.axes
        order = np.argsort(at, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(at, order, axis=0).T)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last places in every array for every query."""
        lo, hi = (np.empty(at.shape, dtype=np.int64) for _ in "ab")
        for j, s in enumerate(self.sorted):
            lo[:, j] = np.searchsorted(s, at[:, j] - half, side="left")
            hi[:, j] = np.searchsorted(s, at[:, j] + half, side="right")
        return lo, hi

    def search(self, rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every query (row of queries, with its number) the ids and cosines of the k nearest found but itself, nearest first."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / norms[:, None]) @ self.axes
        n, least = len(self.ids), threshold()
        counts = np.zeros((len(rows), n), dtype=np.int16)
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in rows]
        done = np.zeros((len(rows), n), dtype=bool)
        live = np.arange(len(rows))
        lo = hi = np.stack([np.searchsorted(s, at[:, j]) for j, s in enumerate(self.sorted)], axis=1)
        radius = FIRST
        while len(live):
            whole = radius > LAST
            new_lo, new_hi = self.windows(at[live], np.inf if whole else WIDTH * radius)
            going = []
            for i, q in enumerate(live):
                ring = [r[a:b] for r, a, b in zip(self.rows, new_lo[i], lo[i])] + [r[a:b] for r, a, b in zip(self.rows, hi[i], new_hi[i])]
                counts[q] += np.bincount(np.concatenate(ring), minlength=n).astype(np.int16)
                fresh = np.flatnonzero((counts[q] >= least) & ~done[q])
                done[q, fresh] = True
                fresh = fresh[self.number[fresh] != rows[q]]
                v, s = found[q]
                if len(fresh):
                    score = (self.vectors[fresh] * queries[q]).sum(axis=1) / (self.norms[fresh] * norms[q])
                    v, s = np.concatenate([v, self.ids[fresh]]), np.concatenate([s, score])
                    best = np.lexsort((v, -s))[:k]
                    found[q] = v, s = v[best], s[best]
                if not whole and not (len(s) >= k and 2 - 2 * s[-1] <= radius * radius):
                    going.append(i)
            live, lo, hi = live[going], new_lo[going], new_hi[going]
            radius *= GROWTH
        return found


def _search_block(k: int):
    def work(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        rows, ids = t.column("row").to_numpy(), t.column("vec_id").to_numpy()
        values = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        asked = t.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        out: list[list] = [[], [], [], []]
        if asked.any() and not asked.all():
            index = CollisionIndex(rows[~asked], ids[~asked], scaled(values[~asked]))
            qr, qi, qv = rows[asked], ids[asked], scaled(values[asked])
            for a in range(0, len(qr), HELD):
                for row, q, (v, s) in zip(qr[a : a + HELD], qi[a : a + HELD], index.search(qr[a : a + HELD], qv[a : a + HELD], k)):
                    out[0] += [row] * len(v)
                    out[1] += [q] * len(v)
                    out[2] += v.tolist()
                    out[3] += s.tolist()
        return pa.table({"row": pa.array(out[0], pa.int64()), "query_id": pa.array(out[1], pa.int64()), "vec_id": pa.array(out[2], pa.int64()), "score": pa.array(out[3], pa.float64())})

    return work


def nearest(vectors: DataFrame, asked, *, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest cosine found for each row that meets ``asked``.

    Null and zero vectors and those with null or non-finite components take no part, nor do rows without a key; vectors
    of another length than the query's are not compared.  Of all rows a query's own is left out, not others of its key;
    queries that share a key are asked one by one, and each has its ranks.  Ties go to the smaller key.  Queries meet all
    rows in blocks of bounded size: with a query set that grows with the table, blocks grow with its square.
    """
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), asked.alias("asked"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = base.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    # numbered once and written: a number made anew on a lost executor could differ
    valid = materialise(valid.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
    n, q = valid.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).head()
    nv, nq = max(1, -(-n // VECTORS)), max(1, -(-q // QUERIES))
    part = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ["row", "vec_id", "embedding"]
    rows = valid.select("dim", part(nv).alias("vb"), all_of(nq).alias("qb"), F.lit(False).alias("asked"), *columns)
    queries = valid.where("asked").select("dim", all_of(nv).alias("vb"), part(nq).alias("qb"), F.lit(True).alias("asked"), *columns)
    found = rows.unionByName(queries).groupBy("dim", "vb", "qb").applyInArrow(_search_block(k), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op4_collision_ann(spark, sf_dir: str) -> DataFrame:
    """:func:`nearest` in ``embeddings`` for the rows whose vec_id 50 divides; null keys and unusable vectors take no part."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))
