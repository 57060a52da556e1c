"""1. Toxicity by cumulative-link ordinal regression.

Texts become sparse presence features (hashed lower-case words). One weight vector is shared by all
ordered thresholds: P(grade > j) = sigmoid(x.w - cut_j). The fit (an L1 penalty selects words, which are
then fitted again with almost none) is made in one task
on a sample of labelled rows that is bounded by :data:`SAMPLE` rows a label; every document is scored.
Both labels weigh the same in the fit, so that words are selected alike however rare toxic labels are; the cuts are
then moved by the log odds of the labels' share among all labelled rows.
Results: ``p_toxic`` = P(grade > 0), ``expected_severity`` = the sum of P(grade > j) over the cuts, ``grade`` =
the number of cuts passed with probability one half or more, ``rejected`` = p_toxic >= :data:`REJECT` for a
text with some feature that speaks for toxicity.

Binary labels are graded by :func:`graded`: 0 clean; among the toxic, 2 for those that hold at least the
median number of distinct marker words (words that the sample has almost only in toxic texts), else 1.

Defined cases: null and empty texts have no features and get the sample's base rate; without a
labelled row, or with one label only, all weights are 0, p_toxic is the base rate (0 without rows, at most
0.49) and nothing is rejected; null labels or ids are left out of the fit; labels that repeat an id count each; every
document row is scored by itself; a word counts once however often it occurs, so long texts need no
scaling; an empty table gives no rows; extra columns are carried, those named like a result replaced.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context.llm.common import Memo, cut_lineage, releasing, small_batches, texts_of
from corpus_context.llm.linear import Sparse, fit_ordinal, sigmoid

#: Labelled rows of each label that the fit takes at most (those of the smallest id hash).
SAMPLE = 4_000
#: Bits of the ranges in which labelled rows are counted first; one range has 1 / 4,096 of a label's rows.
RANGE_BITS = 12
#: Features: hashed to this many; those in fewer sampled texts than the least are left out.
DIMENSIONS, LEAST_TEXTS = 1 << 22, 3
GRADES, ROUNDS, ROUNDS_AFTER = 3, 300, 4_000
#: L1 penalty that selects the words, and the weak one of the second fit on the selected words. With few sampled
#: rows (under 2 x L1_ROWS a label) both grow like the standard error of a word's shares in the two labels.
L1, L1_AFTER, L1_ROWS = 2.5e-3, 1.5e-4, 1_000
#: Probability from which a text is rejected: a missed toxic text costs more than a second look.
REJECT = 0.2
#: A marker word is in at least so many sampled toxic texts, and this share of its texts is toxic.
MARKER_TEXTS, MARKER_SHARE = 3, 0.95

_WORD = re.compile(r"\w+")
_RESULTS = {"p_toxic": T.DoubleType(), "expected_severity": T.DoubleType(), "grade": T.IntegerType(), "rejected": T.BooleanType()}


def _features(piece: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh32_intdigest(w) % DIMENSIONS for w in _WORD.findall(piece.lower()))


def sampled(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(id, toxic, share, features) of at most ``bound`` labelled documents a label; ``share`` is the label's
    part of all labelled rows."""
    small_batches(docs.sparkSession)
    lab = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)")
    # the ranges of hashes that hold a label's first ``bound`` rows, so that no task orders all rows of a label
    lab = lab.withColumn("range", F.shiftright(F.xxhash64("id"), 64 - RANGE_BITS))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("toxic").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    ranges = lab.groupBy("toxic", "range").count().withColumn("before", before).where(F.col("before") < bound)
    last = ranges.groupBy("toxic").agg(F.max("range").alias("last"))
    some = lab.join(F.broadcast(last), "toxic").where(F.col("range") <= F.col("last")).drop("range", "last")
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")
    some = some.withColumn("k", F.row_number().over(first)).where(F.col("k") <= bound).drop("k")
    total = lab.groupBy("toxic").agg(F.count(F.lit(1)).alias("share"))
    some = some.join(F.broadcast(total), "toxic")
    ids = F.broadcast(some.select("id").distinct())  # 2 x bound at most
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text")).join(ids, "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(some), "id")  # one text per id, however often it comes

    def run(batches):
        memo = Memo(_features)
        for b in batches:
            lists = [np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, t.split())), np.int32)) for t in texts_of(b, memo=memo)]
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), b.column("share"), pa.array(lists, pa.list_(pa.int32()))], ["toxic", "share", "features"])

    return texts.select("toxic", "share", "text").mapInArrow(releasing(run), "toxic int, share long, features array<int>")


def _matrix(features: pa.ChunkedArray):
    """Rows and compact columns of the features that enough texts hold; the columns' feature numbers."""
    lists = features.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    numbers, cols, texts = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    enough = texts >= LEAST_TEXTS
    held = enough[cols]
    place = np.cumsum(enough) - 1
    return rows[held], place[cols[held]], numbers[enough]


def graded(toxic: np.ndarray, rows: np.ndarray, cols: np.ndarray, d: int) -> np.ndarray:
    """Grades 0, 1, 2 from binary labels and presence features."""
    bad = np.bincount(cols, toxic[rows], d)
    marker = (bad >= MARKER_TEXTS) & (bad >= MARKER_SHARE * np.bincount(cols, minlength=d))
    held = np.bincount(rows, marker[cols], len(toxic))
    severe = held >= np.median(held[toxic == 1]) if (toxic == 1).any() else np.zeros(len(toxic), bool)
    return np.where(toxic == 1, 1 + severe, 0).astype(int)


def _fit(t: pa.Table) -> pa.Table:
    toxic, share = t.column("toxic").to_numpy(), t.column("share").to_numpy().astype(float)
    rows, cols, numbers = _matrix(t.column("features"))
    n, d = len(toxic), len(numbers)
    here = np.bincount(toxic, minlength=2)
    natural = share / here[toxic]  # the sample stands for all labelled rows
    natural = (natural / natural.sum())[toxic == 1].sum()
    w, cuts = np.zeros(d), np.full(GRADES - 1, -np.log(1 / min(max(natural, 1e-9), 0.49) - 1))
    if 0 < toxic.sum() < n and d:
        grade, weight = graded(toxic, rows, cols, d), 0.5 / here[toxic]
        noise = max(1, np.sqrt((L1_ROWS / here).sum()))
        w, cuts = fit_ordinal(Sparse(rows, cols, np.ones(len(rows)), n, d), grade, weight, GRADES, L1 * noise, ROUNDS)
        chosen = np.nonzero(w)[0]
        held = w[cols] != 0
        again = Sparse(rows[held], (np.cumsum(w != 0) - 1)[cols[held]], np.ones(held.sum()), n, len(chosen))
        w = np.zeros(d)
        w[chosen], cuts = fit_ordinal(again, grade, weight, GRADES, L1_AFTER * noise, ROUNDS_AFTER)
        cuts = cuts - np.log(natural / (1 - natural))
    used = w != 0
    return pa.table({"feature": np.concatenate([-1 - np.arange(len(cuts)), numbers[used]]).astype(np.int64),
                     "weight": np.concatenate([cuts, w[used]])})


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> dict[int, float]:
    """The model: weight by feature number; the cuts are at -1, -2, ... At most as large as the sample's vocabulary."""
    sample = cut_lineage(sampled(docs, labels, bound))
    model = sample.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_fit, "feature long, weight double")
    return {r.feature: r.weight for r in model.collect()}


def score(docs: DataFrame, model: dict[int, float], text_col: str = "text") -> DataFrame:
    """``docs`` with p_toxic, expected_severity, grade and rejected."""
    cuts = np.array([model[-1 - j] for j in range(sum(k < 0 for k in model))])
    sent = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k >= 0})
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in _RESULTS])

    def run(batches):
        weights = sent.value
        memo = Memo(lambda piece: tuple(f for f in _features(piece) if f in weights))
        for b in batches:
            eta = np.array([sum(weights[f] for f in set(chain.from_iterable(map(memo.__getitem__, set(t.split())))))
                            for t in texts_of(b, text_col, memo)], dtype=float)
            above = sigmoid(eta[:, None] - cuts[None, :])
            p = above[:, 0] if len(cuts) else np.zeros(len(eta))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32)), pa.array((p >= REJECT) & (eta > 0))],
                [*b.schema.names, *_RESULTS])

    return kept.mapInArrow(releasing(run), T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in _RESULTS.items()]]))


def classify(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, labels, bound))
