"""Exact top-k search by no-random-access aggregation.

Vectors become integers floor(scale * x). Candidates and queries are dealt in blocks; each pair of blocks is one unit of
work. A block holds one list per dimension, sorted by value. A query reads the lists in step, from the end that suits
the sign of its component, slice after slice, and keeps running bounds and the lists seen of each candidate: the lower
bound adds the least value of each list not yet seen there, the upper bound the value at which that list stands.
Candidates whose upper bound is below the k-th lower bound are outsiders and are dropped. When few are left, or the lists
are read, their final scores are resolved.
Spark merges the blocks. Where sums could pass 64 bits, products in doubles and their error bound leave few, whose scores
are Python integers. A candidate is sent once per block of queries, which holds 16,384 of them.

Defined results. Vectors that are null or hold null or non-finite components, and rows with null ids take no part.
Repeated rows (equal id and vector) count once; other rows with the query's id are not its candidates. Only vectors of
the query's length are its candidates. Ties go to the smaller id. Fewer than k: all. A score that does not fit a long is
null, its rank is by the exact score.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread

#: Share of the lists read before the first look at the bounds (then twice as much before each next one); a query stops
#: once RESOLVED * k candidates are left.
FIRST, RESOLVED = 1 / 64, 4
QUERIES = 64  # that read together


def no_random_access(lists: np.ndarray, ordered: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query: indexes of candidates among which its k best (and all ties of the k-th) are, and the list entries read.

    lists, ordered: per dimension, the candidates by rising value, and those values. A query reads a list from its top
    where its component is positive, from its bottom where it is negative, and not at all where it is 0; queries of a batch
    read in step, so an entry is fetched once for all of them. It raises its candidate's lower bound from the list's least
    product to its own, and marks the list as seen there. The upper bound takes the product at which a list stands for each
    list not yet seen. Candidates whose upper bound is below the k-th lower bound are dead; those dead for all queries that
    still read leave the arrays. own: (queries, candidates) to leave out."""
    m, d = lists.shape
    found: list = [np.flatnonzero(~o) for o in own]
    read = np.zeros(len(queries), np.int64)
    if m <= RESOLVED * k or not d:
        return found, read
    plus, minus = np.maximum(queries, 0).T.astype(float), np.minimum(queries, 0).T.astype(float)
    bottom, top = ordered[0][:, None], ordered[-1][:, None]
    slack = (d + 4) * d * 2.0**-52 * abs(ordered[[0, -1]]).max() * abs(queries.astype(float)).max(axis=1)  # of sums in doubles
    lowest = (plus * bottom + minus * top).sum(axis=0)
    cols, rows, place = np.arange(len(queries)), np.arange(m), np.arange(m)
    low, alive = np.tile(lowest, (m, 1)), ~own.T
    unseen = np.ones((2, m, d))
    depth = 0
    while depth < m and len(cols):
        until = min(m, max(2 * depth, int(m * FIRST), k))
        read[cols] += (until - depth) * np.count_nonzero(queries[cols], axis=1)
        for way, at, least, weight in ((0, slice(m - until, m - depth), bottom, plus), (1, slice(depth, until), top, minus)):
            c, col = place[lists[at]], np.broadcast_to(np.arange(d), lists[at].shape)
            ok = c >= 0
            c, col = c[ok], col[ok]
            fresh = np.zeros((len(low), d))  # what these entries add to their candidates, dimension by dimension
            fresh[c, col] = (ordered[at] - least.T)[ok]
            unseen[way, c, col] = 0
            touched = np.flatnonzero(np.bincount(c, minlength=len(low)))
            low[touched] += fresh[touched] @ weight
        depth = until
        high = low
        if depth < m:
            high = low + unseen[0] @ ((ordered[m - 1 - depth][:, None] - bottom) * plus) + unseen[1] @ ((ordered[depth][:, None] - top) * minus)
        kth = np.partition(np.where(alive, low, -np.inf).T.copy(), len(low) - k, axis=1)[:, len(low) - k]
        alive &= high + slack[cols] >= kth - slack[cols]
        done = (alive.sum(axis=0) <= RESOLVED * k) | (depth == m)
        for j in np.flatnonzero(done):
            found[cols[j]] = rows[alive[:, j]]
        cols, plus, minus, low, alive = cols[~done], plus[:, ~done], minus[:, ~done], low[:, ~done], alive[:, ~done]
        keep = alive.any(axis=1)
        if keep.sum() < 0.9 * len(keep):
            rows, low, alive, unseen = rows[keep], low[keep], alive[keep], unseen[:, keep]
            place = np.full(m, -1)
            place[rows] = np.arange(len(rows))
    return found, read


def exact(vectors: np.ndarray, doubles: np.ndarray, query: list[int], k: int, own: np.ndarray):
    """Indexes of candidates among which the k best (and all ties of the k-th) are, and their scores as Python integers.

    doubles: the vectors as such, or None if they or the sums would not fit."""
    left = np.flatnonzero(~own)
    if doubles is not None and len(left) > k:
        x, q = doubles[left], np.array([float(a) for a in query])
        s, e = x @ q, (len(q) + 4) * 2.0**-52 * (abs(x) @ abs(q))
        left = left[s + e >= np.partition(s - e, len(left) - k)[len(left) - k]]
    return left, [sum(a * b for a, b in zip(v, query)) for v in vectors[left].tolist()]


def _bits(vectors) -> int:
    return max((abs(int(x)).bit_length() for v in vectors for x in v), default=0)


def _ordered(score: int):
    """score (if it fits a long), over (-1, 0, 1: below, in, above longs) and, beyond longs, bytes in order of the score."""
    if -(2**63) <= score < 2**63:
        return score, 0, None
    size = abs(score).bit_length() // 8 + 1
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (None, 1, key) if score > 0 else (None, -1, bytes(255 - b for b in key))


def _search(k: int, scale: int):
    def wide(v) -> list[int]:
        return [math.floor(Fraction(float(x[1:])) * scale) if x[0] == "f" else int(x) for x in v]

    def of(key, pdf):
        d = int(key[0])
        limit = math.isqrt(2**62 // max(1, d))  # sums of products of components up to this fit 64 bits
        is_query, ids = pdf["query"].to_numpy(bool), pdf["id"].to_numpy()
        fits = pdf["w"].isna().to_numpy()
        small = np.stack(pdf["v"][fits].to_numpy()).astype(np.int64) if fits.any() else np.empty((0, d), np.int64)
        plain = fits.copy()
        plain[fits] = (abs(small) <= limit).all(axis=1)
        ints = dict(zip(np.flatnonzero(fits), small))
        large = {i: ints[i].tolist() if fits[i] else wide(pdf["w"].iat[i]) for i in np.flatnonzero(~plain)}

        def taken(queries: bool):
            """Of the candidates or queries: plain vectors and their ids, the others and theirs."""
            p, o = np.flatnonzero(plain & (is_query == queries)), np.flatnonzero(~plain & (is_query == queries))
            others = np.empty((len(o), d), object)
            for j, i in enumerate(o):
                others[j] = large[i]
            return np.array([ints[i] for i in p], np.int64).reshape(len(p), d), ids[p], others, ids[o]

        cand, cid, big, bid = taken(False)
        asked, qids, huge, hids = taken(True)
        found: dict[int, list] = {}  # by query: its row, and (-score, candidate)
        lists = np.argsort(cand, axis=0, kind="stable")
        ordered = np.take_along_axis(cand, lists, axis=0).astype(float) if len(cand) else cand
        for start in range(0, len(asked) if len(cand) else 0, QUERIES):
            q, qid = asked[start : start + QUERIES], qids[start : start + QUERIES]
            some, _ = no_random_access(lists, ordered, q, k, cid[None, :] == qid[:, None])
            for n, (one, left) in enumerate(zip(q, some)):
                score = cand[left] @ one
                best = np.lexsort((cid[left], -score))[:k]
                found[start + n] = list(zip((-score[best]).tolist(), cid[left][best].tolist()))
        most = max(_bits(asked.max(axis=0, keepdims=True)) if len(asked) else 0, _bits(-asked.min(axis=0, keepdims=True)) if len(asked) else 0, _bits(huge)) if len(big) or len(huge) else 0
        for vectors, names, queries, first in ((big, bid, asked, 0), (big, bid, huge, len(asked)), (cand, cid, huge, len(asked))):
            if len(vectors) and len(queries):
                own_bits = _bits(vectors) if vectors is big else limit.bit_length()
                doubles = vectors.astype(float) if own_bits + most + d.bit_length() < 1000 else None
                for n, one in enumerate(queries.tolist()):
                    i = (qids if queries is asked else hids)[n]
                    left, score = exact(vectors, doubles, one, k, names == i)
                    found[first + n] = sorted([*found.get(first + n, []), *zip([-x for x in score], names[left].tolist())])[:k]
        every = np.r_[qids, hids]
        query, best, score, over, beyond = [list(x) for x in zip(*[(every[n], c, *_ordered(-s)) for n, got in found.items() for s, c in got])] or [[]] * 5
        score = pd.arrays.IntegerArray(np.array([x or 0 for x in score], np.int64), np.array(over, np.int64) != 0)
        return pd.DataFrame({"query_id": np.array(query, np.int64), "vec_id": np.array(best, np.int64), "score": score, "over": np.array(over, np.int32), "key": pd.Series(beyond, dtype=object)})

    return of


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, query_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score."""

    def ready(df: DataFrame) -> DataFrame:
        """id, d (length) and the integers: v, or w as text where one is beyond longs ("f": still to be scaled)."""
        v = F.col(vector_col)
        finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
        fits = lambda x: F.abs(x.cast("double") * scale) < 2.0**62
        whole = lambda x: F.floor(x.cast("double") * scale)
        text = F.transform(v, lambda x: F.when(fits(x), whole(x).cast("string")).otherwise(F.concat(F.lit("f"), x.cast("double").cast("string"))))
        all_fit = F.forall(v, fits)
        d = df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
        return d.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("d"), F.when(all_fit, F.transform(v, whole)).alias("v"), F.when(~all_fit, text).alias("w")).dropDuplicates(["id", "v", "w"])

    def in_blocks(n: int, size: int) -> int:
        return max(1, -(-n // size))

    cand, ask = ready(vectors), ready(queries)
    cb, qb = in_blocks(vectors.count(), block), in_blocks(queries.count(), query_block)
    cand = cand.select("id", "d", "v", "w", F.lit(False).alias("query"), F.pmod(F.xxhash64("id", "v", "w"), F.lit(cb)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))).alias("q"))
    ask = ask.select("id", "d", "v", "w", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cb - 1).cast("long"))).alias("c"), F.pmod(F.xxhash64("id", "v", "w"), F.lit(qb)).alias("q"))
    each = cand.unionByName(ask).groupBy("d", "c", "q").applyInPandas(_search(k, scale), "query_id long, vec_id long, score long, over int, key binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("over"), F.desc("score"), F.desc("key"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_nra(spark, sf_dir: str) -> DataFrame:
    e = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(e, e.where(F.col("vec_id") % 100 == 0))


def op7_sql() -> str:
    """DuckDB, all products."""
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v AS q, v AS c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
