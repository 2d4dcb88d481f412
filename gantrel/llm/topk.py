"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

A vector is summarised by the mean and deviation of its segments. For segments of length s, the product of two vectors
is at most ``s * (mean * mean + deviation * deviation)`` summed over the segments (Cauchy-Schwarz on what is left after
the means), which bounds the distance from below. Coarse segments come first; only survivors are bounded more finely,
and only the last survivors are multiplied out.

The means of 2**j segments span the first 2**j Haar functions. So that they carry as much of the vectors as they can, all
vectors are first rotated, which leaves products as they are: the principal axes of a bounded sample, strongest first, are
laid onto the Haar functions, coarsest first. Where the vectors have no strong axes the bounds close few pairs; they are
then tried on one strip of candidates in ``RETRY`` only, and the others are multiplied out at once.

Queries and candidates meet in blocks of bounded size, dealt over the cluster by the pair of their block numbers; each
pair of blocks gives at most k rows a query, which a window then merges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_rank

QUERY_BLOCK, CANDIDATE_BLOCK, STRIP = 1024, 16384, 1024
#: With so many pairs of blocks, blocks of ``WIDE`` queries are dealt instead, so that candidates are copied less often.
MANY, WIDE = 512, 8192
LEVELS = (1, 4, 16)
#: Below one pair in so many, survivors are bounded one by one instead of all pairs by matrix products.
FEW = 32
RETRY = 8
#: Most rows that the rotation is fitted on.
SAMPLE = 4096
#: Sums of products up to the first stay exact in double precision; components below the second keep any score in 64 bits.
EXACT, LARGEST = 2.0**53, 2.0**28


def haar(dim: int) -> np.ndarray:
    """The Haar functions of a power of two as orthonormal rows, the constant and the widest first."""
    rows = [np.full(dim, 1.0)]
    width = dim
    while width > 1:
        for start in range(0, dim, width):
            row = np.zeros(dim)
            row[start : start + width // 2], row[start + width // 2 : start + width] = 1.0, -1.0
            rows.append(row)
        width //= 2
    out = np.array(rows)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def rotation(sample: np.ndarray) -> np.ndarray | None:
    """An orthonormal matrix that takes the sample's principal axes to the Haar functions; none for a dimension that is no
    power of two, or without a sample."""
    dim = sample.shape[1]
    if dim & (dim - 1) or not len(sample):
        return None
    largest = np.abs(sample).max()
    x = sample / largest if largest else sample
    _, axes = np.linalg.eigh(x.T @ x)
    return haar(dim).T @ axes[:, ::-1].T


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, scaled so that the product of two rows' features bounds their product."""
    parts = x.reshape(len(x), segments, -1)
    n = parts.shape[2]
    mean = parts.mean(axis=2)
    spread = np.sqrt(np.maximum((parts**2).mean(axis=2) - mean**2, 0.0))
    return np.concatenate((mean, spread), axis=1) * np.sqrt(n)


def block_topk(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels: Sequence[int] = LEVELS, turn: np.ndarray | None = None, survivors: list | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate id, score) of each query's k best candidates, ties to the smaller id, itself excluded.
    Bounds are taken on vectors rotated by ``turn``, scores on the vectors as given. ``survivors`` receives for each strip
    that was bounded the share of pairs that each level left open."""
    dim = q.shape[1]
    levels = [s for s in levels if dim % s == 0]
    order = np.lexsort((c_ids, -np.einsum("ij,ij->i", c, c)))  # long vectors first: thresholds rise early
    c_ids, c = c_ids[order], c[order]
    turned = (lambda x: x) if turn is None else lambda x: x @ turn.T
    q_features = [segment_features(turned(q), s) for s in levels]
    best_score = np.full((len(q), k), -np.inf)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    rest = 0  # strips to multiply out before the bounds are tried again
    for start in range(0, len(c), STRIP):
        ids, x = c_ids[start : start + STRIP], c[start : start + STRIP]
        threshold = best_score[:, -1]
        full = len(q) * len(ids)
        rows = cols = open_ = None  # pairs that no bound has closed yet: all, a mask while they are many, then lists
        if not np.isinf(threshold).any() and levels and not rest:
            slack = 1e-9 * (np.abs(q).max() * np.abs(x).max() * dim + 1.0)
            wanted = threshold[:, None] - slack
            shares = []
            y = turned(x)
            for mine, s in zip(q_features, levels):
                theirs = segment_features(y, s)
                if rows is None:
                    above = mine @ theirs.T >= wanted
                    open_ = above if open_ is None else open_ & above
                    left = np.count_nonzero(open_)
                    if left * FEW < full:
                        rows, cols = np.nonzero(open_)
                elif len(rows):
                    keep = np.einsum("ij,ij->i", mine[rows], theirs[cols]) + slack >= threshold[rows]
                    rows, cols = rows[keep], cols[keep]
                shares.append((left if rows is None else len(rows)) / full)
            if survivors is not None:
                survivors.append(shares)
            rest = RETRY if rows is None else 0
        rest = max(0, rest - 1)
        if rows is not None:
            score = np.einsum("ij,ij->i", q[rows], x[cols])
            keep = (score >= threshold[rows]) & (q_ids[rows] != ids[cols])
            rows, cols, score = rows[keep], cols[keep], score[keep]
        else:
            score = np.where(q_ids[:, None] != ids[None, :], q @ x.T, -np.inf)
            if np.isinf(threshold).any() and len(ids) > k:
                threshold = np.maximum(threshold, np.partition(score, -k, axis=1)[:, -k])
            rows, cols = np.nonzero((score >= threshold[:, None]) & (score > -np.inf))
            score = score[rows, cols]
        if not len(rows):
            continue
        touched = np.unique(rows)
        all_rows = np.concatenate((np.repeat(np.arange(len(touched)), k), np.searchsorted(touched, rows)))
        all_scores = np.concatenate((best_score[touched].ravel(), score))
        all_ids = np.concatenate((best_id[touched].ravel(), ids[cols]))
        by = np.lexsort((all_ids, -all_scores, all_rows))
        all_scores, all_ids = all_scores[by], all_ids[by]
        take = np.searchsorted(all_rows[by], np.arange(len(touched)))[:, None] + np.arange(k)[None, :]
        best_score[touched], best_id[touched] = all_scores[take], all_ids[take]
    found = np.isfinite(best_score)
    return np.nonzero(found)[0], best_id[found], best_score[found]


def block_topk_large(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``block_topk`` for components whose products doubles would round: all pairs in 64-bit integers, strip by strip."""
    score, ids = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
    valid = np.zeros((len(q), 0), bool)
    for start in range(0, len(c), STRIP):
        strip = c_ids[start : start + STRIP]
        score = np.concatenate((score, q.astype(np.int64) @ c[start : start + STRIP].astype(np.int64).T), axis=1)
        ids = np.concatenate((ids, np.broadcast_to(strip, (len(q), len(strip)))), axis=1)
        valid = np.concatenate((valid, q_ids[:, None] != strip[None, :]), axis=1)
        order = np.lexsort((ids, -score, ~valid), axis=1)[:, :k]
        score, ids, valid = (np.take_along_axis(a, order, axis=1) for a in (score, ids, valid))
    return np.nonzero(valid)[0], ids[valid], score[valid]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten() for c in column.chunks]
    return np.concatenate([np.zeros(0), *[f.to_numpy(zero_copy_only=False) for f in flat]]).reshape(-1, dim)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, dim: int = 64, vec_id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id and score for each query's k largest integer inner products among all other rows.

    ``vector`` holds integers as doubles. Rows whose id or vector is null, whose vector holds a null or non-finite
    component, has other than ``dim`` components or one of 2**28 or more in size (whose scores need not fit a long)
    take no part. Rows of equal id count once if they are equal and each for itself if not; none meets its own id.
    Ties go to the smaller id. An empty table, or one without queries, gives no rows; other columns are not read.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("v") == dim) & ~bad)
    rows = rows.groupBy("id", "v").agg(F.max("q").alias("q"))  # before the blocks cut to k
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    c_blocks = -(-max(1, sizes["n"]) // CANDIDATE_BLOCK)
    wide = -(-max(1, sizes["m"]) // QUERY_BLOCK) * c_blocks > MANY
    q_blocks = -(-max(1, sizes["m"]) // (WIDE if wide else QUERY_BLOCK))
    fitted = rows.orderBy(hash_rank("id"), "id").limit(SAMPLE).select("v").collect()
    turn = rotation(np.array([r["v"] for r in fitted], float).reshape(-1, dim))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.filter("q").select("id", "v", block(q_blocks).alias("qb"), numbers(c_blocks).alias("cb"))
    candidates = rows.select("id", "v", block(c_blocks).alias("cb"), numbers(q_blocks).alias("qb"))

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, c_ids = (t.column("id").to_numpy().astype(np.int64) for t in (left, right))
        out = ([], [], [])
        if len(q_ids) and len(c_ids):
            q, c = _matrix(left.column("v"), dim), _matrix(right.column("v"), dim)
            for start in range(0, len(q_ids), QUERY_BLOCK):
                part = slice(start, start + QUERY_BLOCK)
                large = np.abs(q[part]).max() * np.abs(c).max() * dim >= EXACT
                at, ids, score = block_topk_large(q_ids[part], q[part], c_ids, c, k) if large else block_topk(q_ids[part], q[part], c_ids, c, k, turn=turn)
                for held, more in zip(out, (q_ids[part][at], ids, score.astype(np.int64))):
                    held.append(more)
        return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out)})

    met = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
