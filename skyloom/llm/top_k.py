"""Exact top-k search by block-at-a-time pruning.

Components are terms. Documents lie in shards of bounded size; in a shard similar documents are
put beside each other, and the order is cut into blocks, each with its largest and smallest
component of every term. For a query, the block's bound is the sum over terms of the query's
component times the maximum (or minimum, for a negative component). Blocks are scored through their
forward index in falling order of bounds until the next bound is below the query's k-th score.

How much is skipped is up to the data: most blocks where vectors come in clusters, next to none
where they point evenly in all of many directions, as no bound is tight there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.storage import stage

#: Rows of one task: so many documents meet so many queries.
SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 4096, 1024, 64
#: Passes over a shard's documents that put similar ones beside each other.
PASSES = 4


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v, row: floor(scale * x), and a number of the row, stored. Vectors that are null or hold
    null, NaN or infinite components and rows without an id are left out."""
    ok = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    )
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    kept = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    return stage(kept.select("vec_id", whole.alias("v"), F.monotonically_increasing_id().alias("row")), "vectors")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every`` the
    ``k`` rows of other ids of highest integer inner product, ties to the smaller id.

    Every row is a candidate, also one that repeats another in id and vector. Rows that share an
    asked id are ranked together, as in the SQL: each brings its scores. Vectors of unequal length
    are taken as padded with zeros. Fewer candidates give fewer rows; an empty table gives none.
    Scores must fit 64 bits. Other columns are ignored.

    Every (shard, query group) pair is one task of bounded size. Queries are replicated to the
    shards and shards to the query groups; the scores leave a task only as its best ``k``.
    """
    rows = integer_vectors(vectors, scale)
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("int")), F.lit(0)).alias("q")
    ).first()
    shards, groups = -(-max(size.n, 1) // SHARD_ROWS), -(-max(size.q, 1) // QUERY_ROWS)
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    documents = rows.select("vec_id", "v", "row", part(shards).alias("shard"), each(groups).alias("query_group"))
    queries = rows.filter(F.col("vec_id") % every == 0).select(
        "vec_id", "v", "row", each(shards).alias("shard"), part(groups).alias("query_group")
    )
    best = (
        documents.groupBy("shard", "query_group")
        .cogroup(queries.groupBy("shard", "query_group"))
        .applyInPandas(lambda d, q: _search(d, q, k)[0], "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _best(query, doc, score, k):
    """The first k of each query by score, then id; flat arrays in and out."""
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    start = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - first < k
    return query[keep], doc[keep], score[keep]


def _similar(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts similar rows beside each other, and where its blocks start: a few passes
    of k-means, whose clusters are cut into blocks of at most ``BLOCK_ROWS``."""
    count = max(1, len(rows) // BLOCK_ROWS)
    points = rows.astype(np.float64)
    centers = points[np.linspace(0, len(rows) - 1, count).astype(int)]
    for _ in range(PASSES):
        near = np.argmax(points @ centers.T - 0.5 * (centers**2).sum(axis=1), axis=1)
        sums, sizes = np.zeros_like(centers), np.bincount(near, minlength=count)
        np.add.at(sums, near, points)
        centers = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centers)
    order = np.argsort(near, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(near, minlength=count))]
    starts = [np.arange(a, b, BLOCK_ROWS) for a, b in zip(first, first[1:], strict=False)]
    return order, np.concatenate(starts)


def _search(docs: pd.DataFrame, queries: pd.DataFrame, k: int) -> tuple[pd.DataFrame, int, int]:
    """The best of every query, and how many of how many (query, block) pairs were scored."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    if docs.empty or queries.empty:
        return none, 0, 0
    docs, queries = docs.sort_values(["vec_id", "row"]), queries.sort_values("row")
    width = max(max(map(len, docs.v)), max(map(len, queries.v)))
    forward, asked = _matrix(docs.v, width), _matrix(queries.v, width)
    order, starts = _similar(forward)
    forward, ids = forward[order], docs.vec_id.to_numpy()[order]
    query_ids = queries.vec_id.to_numpy()
    top = float(np.abs(forward).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(width, 1)
    if top < 2**52:  # then products and sums of doubles are exact
        forward, asked = forward.astype(np.float64), asked.astype(np.float64)
    stops = np.r_[starts[1:], len(ids)]
    high, low = np.maximum.reduceat(forward, starts), np.minimum.reduceat(forward, starts)
    bound = np.maximum(asked, 0) @ high.T + np.minimum(asked, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    kth = np.full(len(asked), -np.inf)
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    active, scored = np.arange(len(asked)), 0
    for step in range(len(starts)):
        block = order[active, step]
        go = bound[active, block] >= kth[active]
        active, block = active[go], block[go]
        if not len(active):
            break
        scored += len(active)
        found = [held]
        for b in np.unique(block):
            who = active[block == b]
            part = slice(starts[b], stops[b])
            scores = asked[who] @ forward[part].T
            own = ids[part][None, :] == query_ids[who][:, None]
            least = kth[who]
            if scores.shape[1] > k:  # rows of the query's id don't count among the best
                lowest = -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min
                others = np.where(own, lowest, scores)
                least = np.maximum(least, np.partition(others, -k, axis=1)[:, -k])
            q, d = np.nonzero((scores >= least[:, None]) & ~own)
            found.append((who[q], ids[part][d], scores[q, d].astype(np.int64)))
        held = _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        at, n = np.unique(held[0], return_counts=True)
        full = n == k
        kth[at[full]] = held[2][np.cumsum(n)[full] - 1]
    best = pd.DataFrame({"query_id": query_ids[held[0]], "vec_id": held[1], "score": held[2]})
    return best, scored, bound.size
