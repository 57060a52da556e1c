"""Top-k per key without sorting a whole hot key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, salt_cols: list[str],
                  buckets: int = SALT_BUCKETS, rank_col: str = "k") -> DataFrame:
    """The first ``k`` rows of every key in ``order``, with their rank in ``rank_col`` (1-based).

    Two levels: rows are spread over ``buckets`` slices per key by a hash of ``salt_cols``; each
    slice keeps its own top k (a window bounded by the slice), then one window per key ranks the
    at most k * buckets survivors. Exact: every row of the global top k is in its slice's top k."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(buckets))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    cand = df.withColumn("_salt", salt).withColumn("_k1", F.row_number().over(w1)).where(F.col("_k1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    out = cand.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
    return out.drop("_salt", "_k1")
