"""Operator 9: exact nearest neighbours by a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and have no null or non-finite component."""
    big = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: exact, and the cosine
    stays the same, but no square over- or underflows (components too small beside the largest to count may go to zero)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values of the unit vectors, their scales, the norms of what they stand for, and the norms of the errors."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    held = q * scale[:, None]
    return q, scale, np.sqrt((held * held).sum(axis=1)), np.sqrt(((unit - held) ** 2).sum(axis=1))


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added in the order of the components, so that equal vectors have equal scores anywhere."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of c for each row of q, own ids left out, as (query, id, cosine).

    The int8 product is off the cosine by at most slack; a pair whose upper bound is under the k-th largest lower bound
    of its query can't be among the k. The others are computed anew in double precision and merged by heaps.
    """
    q, c = _scaled(q), _scaled(c)
    (a, sa, na, ea), (b, sb, nb, eb) = _quantised(q), _quantised(c)
    b32 = b.astype(np.float32).T  # sums of int8 products are exact in float32 up to a thousand components, in float64 beyond
    wide = q.shape[1] > 1000
    norm_q, norm_c = np.sqrt(_summed(q, q)), np.sqrt(_summed(c, c))
    out = []
    for at in range(0, len(q), 128):
        s = slice(at, at + 128)
        dots = (a[s].astype(np.float64) @ b32.astype(np.float64)) if wide else (a[s].astype(np.float32) @ b32)
        near = dots.astype(np.float64) * sa[s, None] * sb
        slack = ea[s, None] * nb + na[s, None] * eb + ea[s, None] * eb + 1e-9
        own = q_ids[s, None] == c_ids
        lower = np.where(own, -np.inf, near - slack)
        least = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(lower), -np.inf)
        i, j = np.nonzero((near + slack >= least[:, None]) & ~own)
        exact = _summed(q[at + i], c[j]) / (norm_q[at + i] * norm_c[j])
        cuts = np.searchsorted(i, np.arange(len(lower) + 1))
        for row in range(len(lower)):
            part = slice(cuts[row], cuts[row + 1])
            best = heapq.nsmallest(k, zip((-exact[part]).tolist(), c_ids[j[part]].tolist(), strict=True))
            out += [(int(q_ids[at + row]), v, -d) for d, v in best]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", candidate_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors of every query by cosine, ties to the smaller id.

    Both sides are dealt into blocks by a hash of the id and every block of queries meets every block of candidates in
    one task; a block has a bounded expected size, so no task or driver holds a whole side. Vectors travel in their own
    type and are quantised in the task, which also has the originals for its survivors: so it returns k rows a query
    however many vectors lie within the error bounds. The result is exact: the index is complete and its recall is 1.

    Unusable vectors (see usable) take no part, as queries or candidates; vectors of another length than the query's
    are no candidates. Rows with a null id take no part either, as no result could name them. Fewer than k candidates:
    all of them. A query id that repeats is asked once; candidates that repeat an id each count. Empty tables give an
    empty result; other columns are ignored.
    """
    vectors, queries = vectors.where(F.col(id_col).isNotNull()), queries.where(F.col(id_col).isNotNull())
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    asked = queries.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).dropDuplicates(["id"])
    n_c, n_q = (max(1, math.ceil(x.count() / size)) for x, size in ((rows, candidate_block), (asked, query_block)))
    hashed = F.xxhash64("id")
    c = rows.withColumn("cb", F.pmod(F.xxhash64("id", "v"), F.lit(n_c)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).withColumn("part", F.lit(1))
    q = asked.withColumn("qb", F.pmod(hashed, F.lit(n_q)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).withColumn("part", F.lit(0))
    cells = c.unionByName(q).withColumn("dim", F.size("v"))

    def run(key, t):
        part, ids = t["part"].to_numpy(), t["id"].to_numpy()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), key[2].as_py())
        order = np.argsort(ids, kind="stable")
        asks, has = order[part[order] == 0], order[part[order] == 1]
        found = tile(ids[asks], v[asks], ids[has], v[has], k) if len(asks) and len(has) else []
        return pa.table({n: pa.array([r[x] for r in found], kind) for x, (n, kind) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    best = cells.groupBy("cb", "qb", "dim").applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
           AND list_aggregate([CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END FOR x IN embedding], 'max') = 0
           AND list_aggregate([CASE WHEN x <> 0 THEN 1 ELSE 0 END FOR x IN embedding], 'max') = 1),
n AS (SELECT *, sqrt(list_dot_product(e, e)) AS l FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.l * c.l) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""
