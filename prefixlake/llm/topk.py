"""Exact top-k search by inner product, pruned with segment statistics.

A vector is cut into segments, each known by its mean and deviation. Within a segment of length L
the squared distance of q and c is at least L * ((mean q - mean c)^2 + (dev q - dev c)^2), so with
the norms q.c is at most the sum of L * (mean q * mean c + dev q * dev c). Coarse segments bound
all pairs of a block, finer ones those that remain, and only survivors get exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries; a task holds one of each.
BLOCK, QUERY_BLOCK = 16384, 4096
#: Segments of the two coarser resolutions.
LEVELS = (4, 16)
OUT = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v, floor(256 * x) of each component. Null vectors, and those with null or non-finite components, are left out."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return vectors.where(good).select("vec_id", F.transform(x, lambda y: F.floor(y.cast("double") * 256)).alias("v"))


def statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of m's rows from above: sqrt(L) * mean and sqrt(L) * deviation of each segment."""
    out = []
    for part in np.array_split(m, min(segments, m.shape[1]) or 1, axis=1):
        if part.shape[1]:
            out += [part.mean(axis=1) * np.sqrt(part.shape[1]), part.std(axis=1) * np.sqrt(part.shape[1])]
    return np.stack(out, axis=1) if out else np.zeros((len(m), 1))


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of a block, ties to smaller ids: (query id, ids, scores)."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    cf, qf = c.astype(np.float64), q.astype(np.float64)
    levels = [(statistics(qf, s), statistics(cf, s)) for s in LEVELS]
    slack = 1e-9 * np.sqrt((qf**2).sum(axis=1)) * np.sqrt((cf**2).sum(axis=1).max(initial=0)) + 1e-6
    exact = (lambda i, rows: cf[rows] @ qf[i]) if max(np.abs(qf).max(initial=0), np.abs(cf).max(initial=0)) ** 2 * max(1, q.shape[1]) < 2**52 else (lambda i, rows: c[rows] @ q[i])
    for at in range(0, len(q), 64):
        coarse = levels[0][0][at : at + 64] @ levels[0][1].T
        for j, bound in enumerate(coarse):
            i = at + j
            own = c_ids == q_ids[i]
            first = min(len(c), 4 * k + int(own.sum()))
            if not first:
                continue
            near = np.argpartition(-bound, first - 1)[:first]
            near = near[~own[near]]
            least = np.sort(exact(i, near))[-k] if len(near) >= k else -np.inf
            rows = np.flatnonzero((bound + slack[i] >= least) & ~own)
            rows = rows[levels[1][1][rows] @ levels[1][0][i] + slack[i] >= least]
            got = np.asarray(exact(i, rows))
            if len(rows) > k:
                kth = np.partition(got, len(got) - k)[len(got) - k]
                rows, got = rows[got >= kth], got[got >= kth]
            best = np.lexsort((c_ids[rows], -got))[:k]
            yield int(q_ids[i]), c_ids[rows[best]], got[best].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k highest integer inner products over vectors with other ids: query_id, rank, vec_id, score.

    Both sides hold vec_id and v (array of long). Only vectors of one width meet. Fewer candidates
    than k give fewer rows; none, or an empty table, give none. Repeated vectors tie and the
    smaller id wins; a repeated row counts as often as it is there. Blocks are sized by a count of the rows.
    """
    n, n_q = vectors.count(), queries.count()
    n_c, n_b = max(1, -(-n // block)), max(1, -(-n_q // query_block))
    width = F.size("v").alias("width")
    left = queries.select(
        "vec_id", "v", width, F.pmod(F.xxhash64("vec_id"), F.lit(n_b)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))).alias("cb")
    )
    right = vectors.select(
        "vec_id", "v", width, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_b - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_c)).alias("cb")
    )

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        found = list(search(q["vec_id"].to_numpy(), np.stack(q["v"]), c["vec_id"].to_numpy(), np.stack(c["v"]), k))
        return pd.DataFrame(
            {
                "query_id": np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype("int64"),
                "vec_id": np.concatenate([np.zeros(0, "int64"), *[x[1] for x in found]]),
                "score": np.concatenate([np.zeros(0, "int64"), *[x[2] for x in found]]),
            }
        )

    keys = ["width", "qb", "cb"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, OUT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame) -> DataFrame:
    v = quantised(embeddings)
    return top_k(v, v.where("vec_id % 50 = 0"))
