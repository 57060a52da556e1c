"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.session import cut_lineage, scratch_path  # noqa: F401  (re-exported)

#: Largest table, in rows of a few bytes each, that a driver-checked broadcast may hold.
BROADCAST_ROWS = 1_000_000


#: Rows of whole texts that one Arrow batch takes to a Python worker, where the session has Spark's default.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: the default batch of 10,000 rows can be hundreds of MB on both sides of the pipe. A
    value set by the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def releasing(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, giving freed memory back to the system when a task's input ends or breaks off: a
    worker is kept for later tasks, beside those of other stages."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return run


class Memo(dict):
    """value = memo[token], computed once per token and worker; ``trim`` bounds its memory."""

    def __init__(self, fn: Callable, limit: int = 150_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, token):
        v = self[token] = self.fn(token)
        return v

    def trim(self):
        if len(self) > self.limit:
            self.clear()


class AgingMemo(dict):
    """As :class:`Memo`, but a value is kept from the second time that its token is asked for (about), and ``trim`` lets
    the older half go: values asked for since the last time stay."""

    _SEEN = 1 << 20

    def __init__(self, fn: Callable, limit: int = 150_000):
        super().__init__()
        self.fn, self.limit = fn, limit
        self.old, self.seen = {}, bytearray(self._SEEN)

    def __missing__(self, token):
        v = self.old.pop(token, None)
        if v is None:
            v, at = self.fn(token), hash(token) & self._SEEN - 1
            if not self.seen[at]:
                self.seen[at] = 1
                return v
        self[token] = v
        return v

    def trim(self):
        if 2 * len(self) > self.limit:
            self.old, self.seen = dict(self), bytearray(self._SEEN)
            self.clear()


@lru_cache(1)
def unstable_characters() -> str:
    """A pattern for the characters that libraries with other Unicode tables may class otherwise (letter, number or
    separator): those unassigned in Python's table, and those whose class has changed since Unicode 3.2."""
    old, spans = unicodedata.ucd_3_2_0, []
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        now, then = unicodedata.category(chr(code)), old.category(chr(code))
        if now == "Cn" or now != then and (now[0] in "LNZ" or then[0] in "LNZ") and now[0] != then[0]:
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


class UnstableCharacters:
    """Whether a text holds characters of ``pattern`` (:func:`unstable_characters`). Each character is looked up once."""

    def __init__(self, pattern: str | None = None):
        self.pattern, self.stable = re.compile(pattern or unstable_characters()), set()

    def __call__(self, text: str) -> bool:
        if text.isascii():
            return False
        for c in set(text) - self.stable:
            if self.pattern.match(c):
                return True
            self.stable.add(c)
        return False


def texts_of(batch: pa.RecordBatch, name: str = "text", memo: Memo | None = None) -> Iterator[str]:
    """The text column of an Arrow batch, null as empty, one Python string at a time; ``memo`` is trimmed in between."""
    for v in batch.column(name):
        yield v.as_py() or ""
        if memo is not None:
            memo.trim()


def with_key(df: DataFrame, id_col: str) -> DataFrame:
    """``df`` with a unique, non-null long ``_key`` that a recomputed task finds again.

    The id itself serves if it is a unique non-null integer; otherwise (repeated or null ids)
    the rows are written once to the shared folder with a generated key.
    """
    odd = (df.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull()).limit(1))
    integral = dict(df.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint")
    if integral and odd.isEmpty():
        return df.withColumn("_key", F.col(id_col).cast("long"))
    return cut_lineage(df.withColumn("_key", F.monotonically_increasing_id()))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast. Spark sizes a table by its compressed files and takes an
    explode for as many rows as went in, so that it may send millions of rows through the driver."""
    return df.hint("merge")


def counted(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) as the side of a join: broadcast up to ``bound`` rows, shuffled beyond, whatever Spark takes
    its size for."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else shuffled(df)


def keep_matching(df: DataFrame, keys: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one-column table ``keys`` (already written, distinct).

    Up to ``bound`` keys (counted) are broadcast, so the other rows are dropped before any
    shuffle; a larger key table is joined by a shuffle. Same rows either way.
    """
    return df.join(counted(keys, bound), key, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, key: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The complement of :func:`keep_matching`; rows with a null key stay."""
    return df.join(counted(keys, bound), key, "left_anti")


class Forest:
    """Union-find over positions 0..n-1, the smallest position as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        for a, b in zip(i.tolist(), j.tolist()):
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            if a != b:
                up[max(a, b)] = min(a, b)
        while (up[up] != up).any():
            up[:] = up[up]


def whole_groups(batches, key: list[str]):
    """Tables that each hold whole groups, from batches sorted by ``key``."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = [t.column(c).to_numpy() for c in key]
        starts = np.nonzero(np.any([c[1:] != c[:-1] for c in k], axis=0))[0] + 1
        if held and any(held[-1].column(c)[-1].as_py() != t.column(c)[0].as_py() for c in key):
            yield pa.concat_tables(held)
            held = []
        if len(starts):
            yield pa.concat_tables([*held, t.slice(0, starts[-1])])
            held, t = [], t.slice(starts[-1])
        held.append(t)
    if held:
        yield pa.concat_tables(held)


def _forests(batches, limit: int = 1 << 18):
    """Edges (a, b) folded, up to ``limit`` at a time, into stars around each tree's least node."""

    def stars(parts):
        a, b = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("a", "b"))
        nodes, place = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(place[: len(a)], place[len(a) :])
        child = np.nonzero(forest.up != np.arange(len(nodes)))[0]
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[forest.up[child]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            folded = stars(held)
            if folded.num_rows > limit // 2:  # hardly fewer: go on with an empty hand
                yield folded
                held, n = [], 0
            else:
                held, n = [folded], folded.num_rows
    if held:
        yield stars(held)


def components(edges: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(node, label): connected components of the edges (a, b) of longs, the smallest node as label.

    Each task first folds its edges into stars. Then large and small stars alternate, whose number of edges never
    grows, until nothing changes. The least neighbours are written once per step; a table of up to ``bound`` of them is
    broadcast, a larger one is joined by a shuffle of two plain sides, which splits a hot centre.
    """

    def least(e: DataFrame) -> DataFrame:
        return counted(cut_lineage(e.groupBy("a").agg(F.min("b").alias("m"))), bound)

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.mapInArrow(releasing(_forests), "a long, b long").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b")
        large = cut_lineage(large.distinct())
        low = least(large)
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut_lineage(small.where("a <> b").distinct())
