"""Approximate nearest neighbours by collision counting.

Rows are dealt into shards by a hash of their id. A shard holds, for each of 64 random projections, the sorted array of its
vectors' values. A query opens a window around its own value in every array; the windows grow together (virtual rehashing:
level t is a bucket width of WIDTHS[t] centred on the query), and a vector that lies in at least THRESHOLD of the windows is
verified by its exact distance. A query is done in a shard once the tenth distance found is so small that, by the level's
width, nearer vectors would almost surely have collided, or once a level has covered the shard.

Each shard gives its ten nearest; the ten nearest of those are the result. Equal vectors of a shard are verified once and
keep their smallest ids, so a vector that is repeated any number of times costs no more than one.

Queries go to every shard in blocks: a group is one shard and one block of queries, both of bounded size, so neither all
queries nor all vectors meet in one task.

Defined cases: vectors that are null, of zero length, all zero, or hold null or non-finite components, and rows without an
id take no part; vectors of another length than the query's are no candidates; repeated rows count as one, of different vectors of an id the least
in order counts; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PROJECTIONS, THRESHOLD = 64, 40
#: Half widths of the windows, level by level, in units of the shard's scale (root mean square distance).
WIDTHS = (0.08, 0.12, 0.18, 0.27, 0.4, 0.6, 0.9, 1.35, 2.0)
#: A level is trusted for distances up to this many times its half width.
REACH = 1.05
#: Expected rows of a shard and queries of a block.
SHARD, BLOCK = 8192, 2048
K = 10


class Shard:
    """The sorted projections of one shard's distinct vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        rows = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).reshape(-1)
        _, first, place = np.unique(rows, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by = np.argsort(place, kind="stable")  # ids stay in order within a class
        self.members, self.cuts = ids[by], np.searchsorted(place[by], np.arange(len(first) + 1))
        rng = np.random.Generator(np.random.PCG64(9))
        self.lines = rng.standard_normal((vectors.shape[1], PROJECTIONS))
        values = self.vectors @ self.lines
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, 0).T.copy()
        spread = self.vectors - self.vectors.mean(0)
        self.scale = max(float(np.sqrt(2 * (spread**2).sum(1).mean())), 1e-12)

    def nearest(self, query_id: int, q: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found, the query's own id left out."""
        n = len(self.vectors)
        at = q @ self.lines
        counts, checked = np.zeros(n, np.int16), np.zeros(n, bool)
        lo = hi = None
        who, dist = np.zeros(0, int), np.zeros(0)
        for half in (*WIDTHS, np.inf):
            half *= self.scale
            new_lo = np.array([np.searchsorted(s, v - half) for s, v in zip(self.sorted, at)])
            new_hi = np.array([np.searchsorted(s, v + half, "right") for s, v in zip(self.sorted, at)])
            parts = []
            for j in range(PROJECTIONS):
                if lo is None:
                    parts.append(self.order[j, new_lo[j] : new_hi[j]])
                else:
                    parts += [self.order[j, new_lo[j] : lo[j]], self.order[j, hi[j] : new_hi[j]]]
            counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= THRESHOLD) & ~checked)
            checked[fresh] = True
            if len(fresh):
                who = np.concatenate([who, fresh])
                dist = np.concatenate([dist, np.sqrt(((self.vectors[fresh] - q) ** 2).sum(1))])
            ids, d = self._best(query_id, who, dist, k)
            if len(ids) == k and d[-1] <= REACH * half:
                break
        return ids, d

    def _best(self, query_id: int, who: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(who):
            return np.zeros(0, np.int64), np.zeros(0)
        near = np.flatnonzero(dist <= np.partition(dist, min(k, len(dist) - 1))[min(k, len(dist) - 1)])
        ids, d = [], []
        for i in near:
            a = self.cuts[who[i]]
            some = self.members[a : min(self.cuts[who[i] + 1], a + k + 1)]
            ids.append(some)
            d.append(np.full(len(some), dist[i]))
        ids, d = np.concatenate(ids), np.concatenate(d)
        ids, d = ids[ids != query_id], d[ids != query_id]
        order = np.lexsort((ids, d))[:k]
        return ids[order], d[order]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v (doubles) of the rows that take part, once each; of several vectors of an id the least in order."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, id, score: for every usable row for which `queries` (a condition on `id`) holds, the k nearest others."""
    rows = usable(vectors, key, vector)
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.when(queries, 1).otherwise(0)).alias("q")).first()
    shards, blocks = -(-(sizes["n"] or 1) // SHARD), -(-(sizes["q"] or 1) // BLOCK)
    part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    data = rows.select(F.size("v").alias("dim"), part("shard", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = rows.where(queries).select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part("block", blocks).alias("block"), "id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            index = Shard(left["id"].to_numpy(), np.stack(left["v"].to_numpy()))
            for i, q in zip(right["id"], right["v"]):
                ids, d = index.nearest(i, np.asarray(q), k)
                out.append(pd.DataFrame({"query_id": i, "id": ids, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    keys = ["dim", "shard", "block"]
    found = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(run, "query_id long, id long, score double")
    # the ten of each shard meet by query; the limit is taken before and after that shuffle, so nothing long is gathered
    order = Window.partitionBy("query_id").orderBy("score", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
