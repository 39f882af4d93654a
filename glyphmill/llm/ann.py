"""Approximate nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest pivots in order. Pivot inverted files post each vector, with the pivot's place in
its order, under each of them. A query reads the files of its own nearest pivots and sums for every vector it meets
PREFIX - max(place in the query, place in the vector); the footrule distance of two cut permutations is a constant less twice this sum,
so the largest sums have the smallest footrule. Of each shard, the share REACH of its rows and LEAST more, the best by footrule, are ranked again by the
inner product itself, in double precision. There is no other path: small tables go through the pivot files too.

Pivots are a bounded sample (PIVOTS rows of each vector length with the smallest hash); every vector is indexed. Vectors lie in shards of about
SHARD rows and queries in blocks of about BLOCK; a task searches one shard for one block and keeps the k best of each query,
so no pairs leave it but those. Nothing but the pivots is broadcast: 256 rows for each length that vectors have.

Edge cases. Vectors that are null, zero, empty, or hold a null or a component that isn't finite take no part; neither do rows
without an id. Vectors of different lengths have no inner product: each length is searched by itself. Rows that share an id are rows of their own, as queries
and as candidates; a query's own row is left out. Ties go to the smaller id. Fewer than k candidates: all of them. Empty table: empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

PIVOTS, PREFIX, REACH, LEAST = 256, 64, 0.3, 100
SHARD, BLOCK = 8192, 16384


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, v (array<double>), dim: the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(finite & F.exists("v", lambda x: x != 0))
    return common.written(own.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")), "ann-vectors")


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    near = x @ pivots.T
    part = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(x), 1))
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)


class Shard:
    """Pivot inverted files of some vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, prefix: int):
        order = np.lexsort((rows, ids))
        self.own, self.ids, self.x, self.prefix = rows[order], ids[order], x[order], min(prefix, len(pivots))
        near = prefixes(self.x, pivots, self.prefix).ravel()
        by = np.argsort(near, kind="stable")
        self.rows, self.places = by // self.prefix, (by % self.prefix).astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=len(pivots)))])

    def search(self, row: int, q: np.ndarray, near: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best among the first reach rows by footrule."""
        n = len(self.ids)
        spans = [slice(self.at[p], self.at[p + 1]) for p in near]
        met = np.concatenate([self.rows[s] for s in spans])
        gain = self.prefix - np.concatenate([np.maximum(self.places[s], r) for r, s in enumerate(spans)])
        reach = min(reach, n)
        found = np.sort(np.argpartition(-np.bincount(met, gain, n), reach - 1)[:reach])
        found = found[self.own[found] != row]
        rough = self.x[found] @ q
        if len(found) > k:  # the margin keeps every tie
            found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
        score = (self.x[found] * q).sum(axis=1)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def pivot_rows(own: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Unit vectors of the pivots of each vector length."""
    by = W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v")
    some = own.select("dim", "v", F.row_number().over(by).alias("n")).where(F.col("n") <= pivots).orderBy("dim", "n").select("dim", "v").collect()
    out: dict[int, list] = {}
    for r in some:
        out.setdefault(r.dim, []).append(r.v)
    return {d: (p := np.array(v, float)) / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300) for d, v in out.items()}


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, reach: float = REACH, least: int = LEAST, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    own = usable(vectors, id_col, vector_col)
    held = own.sparkSession.sparkContext.broadcast(pivot_rows(own, pivots))
    per = own.groupBy("dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.count_if(is_query) / block)).cast("int").alias("blocks"))
    own = own.join(per, "dim")
    across = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    there = own.select("dim", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), across("blocks").alias("block"), "row", "vec_id", "v")
    block_of = F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    asks = own.where(is_query).select(F.col("dim").alias("dim"), across("shards").alias("shard"), block_of, *(F.col(c).alias(c) for c in ("row", "vec_id", "v")))  # fresh columns, as both sides come from one table

    def dense(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks()
        flat = flat if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks)
        return t.column("row").to_numpy(), t.column("vec_id").to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if len(queries) and len(rows):
            own, ids, q = dense(queries)
            p = held.value[q.shape[1]]
            index = Shard(*dense(rows), p, prefix)
            most = math.ceil(reach * len(index.ids)) + least
            for row, i, x, n in zip(own.tolist(), ids.tolist(), q, prefixes(q, p, index.prefix), strict=True):
                found, score = index.search(row, x, n, k, most)
                for to, c in zip(out, (np.full(len(found), row), np.full(len(found), i), found, score), strict=True):
                    to.append(c)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"row": pa.array(cols[0].astype(np.int64)), "query_id": pa.array(cols[1].astype(np.int64)), "vec_id": pa.array(cols[2].astype(np.int64)), "score": pa.array(cols[3])})

    common.ship(own.sparkSession)
    key = ("dim", "shard", "block")
    found = asks.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(search, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
