"""3. Exact top-k inner products by no-random-access aggregation.

A query's score is a sum over dimensions, and each dimension is a sorted list of the candidates'
values, read from the end that suits the query's sign. Rows are dealt into blocks of queries and
blocks of candidates; each pair of blocks is a task's group. In a group the lists are read to a
common depth, round by round. A candidate's lower bound takes the list's last value for what has
not been read of it, the upper bound takes the list's frontier. A candidate whose upper bound is
below the k-th lower bound of a query is an outsider of that query; once the rest is few, reading
goes on for the rest only, which resolves their scores. Queries that never get there read on to the end,
where the bounds meet. Each group returns k rows a query, and a window takes the best k of them.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor
does a row with a null id; shorter vectors count as padded with zeros; a query's own row, and any
row that repeats its id, is no candidate of it; queries that repeat an id count once (largest vector);
ties go to the smaller id; an empty table gives no rows; extra columns are ignored. Scores are exact while
their partial sums stay below 2^63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: First depth, as a share of the block, and the factor between depths.
FIRST_DEPTH, DEEPER = 1 / 2, 2
#: Candidates per result at which reading goes on for the rest of a query's candidates only.
FEW = 8

SCHEMA = "query_id long, vec_id long, score long"


def quantised(values: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as a long; null if a component is null or not finite."""
    v = F.transform(values, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(v, lambda x: F.floor(x * scale).cast("long")))


def block_topk(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int):
    """(query position, candidate position, score) of the k best candidates of each query in this block."""
    n, d = c.shape
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(d, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    low = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
    q, c = q.astype(kind), c.astype(kind)
    signs = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])  # lists read from the top, from the bottom
    lists = np.sort(c, axis=0)
    rank = np.empty((n, d), np.int32)
    np.put_along_axis(rank, np.argsort(c, axis=0, kind="stable"), np.arange(n, dtype=np.int32)[:, None], axis=0)
    active, depth, found = np.arange(len(q)), max(int(n * FIRST_DEPTH), 4 * k), []
    while len(active):
        own = q_ids[active][:, None] == c_ids[None, :]
        if depth >= n:  # all lists are read: both bounds are the score
            score = q[active] @ c.T
            score[own] = low
            kth = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(active), low)
            qi, ci = np.nonzero((score >= kth[:, None]) & ~own)
            found.append((active[qi], ci, score[qi, ci]))
            break
        top, bottom = rank >= n - depth, rank < depth
        lower = signs[active] @ np.hstack([np.where(top, c, lists[0]), np.where(bottom, c, lists[-1])]).T
        lower[own] = low
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        upper = signs[active] @ np.hstack([np.where(top, c, lists[n - depth]), np.where(bottom, c, lists[depth - 1])]).T
        inside = (upper >= kth[:, None]) & ~own
        few = inside.sum(1) <= FEW * k
        for a in np.nonzero(few)[0]:
            rest = np.nonzero(inside[a])[0]
            found.append((np.full(len(rest), active[a]), rest, c[rest] @ q[active[a]]))
        active, depth = active[~few], depth * DEEPER
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.int64)
    qi, ci, score = (np.concatenate(x) for x in zip(*found))
    score = score.astype(np.int64)
    order = np.lexsort((c_ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    first = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.empty(0, bool)
    place = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
    return qi[place < k], ci[place < k], score[place < k]


def _group(k: int, dims: int):
    def run(t: pa.Table) -> pa.Table:
        is_query = t.column("is_query").to_numpy()
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks()
        v = v.flatten().to_numpy().reshape(-1, dims)
        qi, ci, score = block_topk(v[is_query], ids[is_query], v[~is_query], ids[~is_query], k)
        return pa.table({"query_id": ids[is_query][qi], "vec_id": ids[~is_query][ci], "score": score})

    return run


def topk(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", values_col: str = "v",
         query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row where ``is_query``; ``values_col`` array<long>."""
    all_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(values_col).alias("v"),
                              F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    n, n_q, dims = all_rows.agg(F.count(F.lit(1)), F.count_if("q"), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    blocks_c, blocks_q = max(-(-n // candidate_block), 1), max(-(-n_q // query_block), 1)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), dims - F.size("v")))
    rows = all_rows.select("id", padded.alias("v"), "q", F.xxhash64("id").alias("h"))

    def dealt(df, flag, own, own_blocks, other, other_blocks):
        return df.select(F.lit(flag).alias("is_query"), "id", "v", F.pmod("h", F.lit(own_blocks)).alias(own),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_blocks - 1).cast("long"))).alias(other))

    queries = rows.where("q").groupBy("id", "h").agg(F.max("v").alias("v"))
    both = dealt(queries, True, "qb", blocks_q, "cb", blocks_c).unionByName(dealt(rows, False, "cb", blocks_c, "qb", blocks_q))
    best = both.groupBy("qb", "cb").applyInArrow(_group(k, dims), SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
