"""9. Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. The votes of all documents are
counted by pattern (at most 3^labellers patterns), and expectation-maximisation on these counts estimates
each labeller's two accuracies and the share of good documents, with no hand label. The posterior of a
document's pattern is its soft label; a linear scorer over hashed word shapes is fitted to soft labels, in
one task, on a sample bounded by :data:`SAMPLE` documents (those of the smallest id hash). Every
document is scored: ``posterior`` (weak-label model), ``score`` (linear scorer), ``keep`` = score >= 0.5.

Defined cases: null and empty texts get no votes and no features, hence the prior and the scorer's bias;
an empty table gives no rows; without any vote the prior is 0.5 and everything is kept; repeated rows
count each; null ids are scored but not sampled; whole texts count, whatever their length; extra columns are
carried, those named like a result replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context.llm.common import Memo, cut_lineage, releasing, small_batches, texts_of
from corpus_context.llm.linear import Sparse, fit_logistic, sigmoid

#: Documents that the scorer's fit takes at most, hashed features, ridge penalty and rounds of the fit.
SAMPLE, DIMENSIONS, RIDGE, ROUNDS = 10_000, 1 << 16, 1e-5, 1_500
#: Rounds of expectation-maximisation.
EM_ROUNDS = 200
#: Prior accuracy of a labeller on good documents, and its strength in documents, the same at every size.
RARELY, BELIEF = 0.995, 50.0
#: Accuracy on bad documents that the rounds start from.
SEEN = 0.3
LABELLERS = ("symbols", "capitals", "exclaims", "cells", "stutter", "lines", "variety", "sentences", "letters")
_RESULTS = {"posterior": T.DoubleType(), "score": T.DoubleType(), "keep": T.BooleanType()}
_ENDS = re.compile(r"[.?](?:\s|$)")


def _flags(word: str) -> int:
    """Of a word, a bit each: trailing sign clutter, all capitals, exclamations, table cell border, plain letters."""
    core = word.strip(".,;:!?\"'()")
    return ((len(word) > 2 and sum(not c.isalnum() for c in word[-3:]) == 3) | (len(core) > 1 and core.isupper()) << 1
            | word.endswith("!!") << 2 | (word == "|") << 3 | core.isalpha() << 4)


def _vote(value: float, good_below: float, bad_from: float) -> int:
    return 1 if value < good_below else 0 if value >= bad_from else -1


def votes(text: str, flags: Memo) -> list[int]:
    """1 good, 0 bad, -1 none, in the order of :data:`LABELLERS`."""
    words = text.split()
    n = len(words)
    if not n:
        return [-1] * len(LABELLERS)
    found = Counter(map(flags.__getitem__, words))
    clutter, capitals, exclaims, cells, letters = (sum(c for f, c in found.items() if f >> k & 1) / n for k in range(5))
    stutter = sum(map(eq, words, words[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    variety = len(set(words)) / n
    ends = len(_ENDS.findall(text)) / n
    return [_vote(clutter, 0.05, 0.2), _vote(capitals, 0.1, 0.4), _vote(exclaims, 0.02, 0.1), _vote(cells, 0.05, 0.2),
            _vote(stutter, 0.1, 0.3), -1 if len(lines) < 3 else _vote(repeated, 0.1, 0.4),
            -1 if n < 30 else _vote(-variety, -0.25, -0.12), -1 if n < 30 else _vote(-ends, -0.02, -0.004),
            _vote(-letters, -0.85, -0.6)]


def label(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the vote pattern of each, one character a labeller: g(ood), b(ad) or - (none)."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() != "pattern"])

    def run(batches):
        flags = Memo(_flags)
        for b in batches:
            out = ["".join("bg-"[v] for v in votes(t, flags)) for t in texts_of(b, text_col, flags)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "pattern"])

    return kept.mapInArrow(releasing(run), T.StructType([*kept.schema.fields, T.StructField("pattern", T.StringType())]))


def estimate(patterns: list[str], counts: list[int], rounds: int = EM_ROUNDS):
    """EM over vote patterns: (posterior of each pattern, accuracies on good, on bad documents, share of good).

    Labellers are taken as independent given the class and abstain regardless of it. Each looks for a
    fault of its own, so no two-class model can tell them by agreement alone: the start says that a bad
    document shows a given fault seldom, the prior that a good one hardly ever does. The prior weighs
    :data:`BELIEF` documents, so that a labeller that often misfires on good ones is found out."""
    if not patterns:
        return np.empty(0), np.full(len(LABELLERS), 0.8), np.full(len(LABELLERS), 0.8), 0.5
    v = np.array([["bg-".index(c) for c in p] for p in patterns])
    good, bad, n = v == 1, v == 0, np.array(counts, float)
    on_good, on_bad, share = np.full(v.shape[1], RARELY), np.full(v.shape[1], SEEN), 0.9
    for _ in range(rounds):
        odds = (np.log(share / (1 - share)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad))
        p = sigmoid(odds)
        w = n * p
        on_good = ((w @ good + RARELY * BELIEF) / (w @ (good | bad) + BELIEF)).clip(0.5, 0.9999)
        w = n * (1 - p)
        on_bad = ((w @ bad + 8) / (w @ (good | bad) + 10)).clip(0.05, 0.999)
        share = float(((n @ p + 1) / (n.sum() + 2)).clip(0.01, 0.99))
    return p, on_good, on_bad, share


def _shape(word: str) -> int:
    """Hash of a word's shape: runs of capitals, letters, digits; signs as they are, at most three alike."""
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if s not in "Aa0" or not out or out[-1] != s:
            if out[-3:] != [s] * 3:
                out.append(s)
    return xxhash.xxh32_intdigest("".join(out)) % (DIMENSIONS - 2)


def features(text: str, shapes: Memo) -> dict[int, float]:
    """Shares of word shapes, of repeated neighbours and of repeated lines."""
    words = text.split()
    if not words:
        return {}
    out = {k: v / len(words) for k, v in Counter(map(shapes.__getitem__, words)).items()}
    lines = [x for x in text.split("\n") if x.strip()]
    out[DIMENSIONS - 2] = sum(map(eq, words, words[1:])) / len(words)
    out[DIMENSIONS - 1] = 1 - len(set(lines)) / len(lines)
    return out


def _sample_features(sample: DataFrame) -> DataFrame:
    def run(batches):
        shapes = Memo(_shape)
        for b in batches:
            found = [features(t, shapes) for t in texts_of(b, memo=shapes)]
            yield pa.RecordBatch.from_arrays(
                [b.column("pattern"), pa.array([list(f) for f in found], pa.list_(pa.int32())),
                 pa.array([list(f.values()) for f in found], pa.list_(pa.float64()))], ["pattern", "features", "shares"])

    return sample.select("pattern", "text").mapInArrow(releasing(run), "pattern string, features array<int>, shares array<double>")


def _fit(posterior: dict[str, float]):
    def run(t: pa.Table) -> pa.Table:
        lists = t.column("features").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        numbers, cols = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        x = Sparse(np.repeat(np.arange(len(sizes)), sizes), cols, t.column("shares").combine_chunks().flatten().to_numpy(),
                   len(sizes), len(numbers))
        target = np.array([posterior[p] for p in t.column("pattern").to_pylist()])
        n_bad = max((1 - target).sum(), 1e-9)
        weight = target / max(target.sum(), 1e-9) + (1 - target) / n_bad if min(target.sum(), n_bad) > 1 else np.ones(len(target))
        w, bias = fit_logistic(x, target, weight / weight.sum(), RIDGE, ROUNDS)
        return pa.table({"feature": np.r_[-1, numbers].astype(np.int64), "weight": np.r_[bias, w]})

    return run


def score(labelled: DataFrame, posterior: dict[str, float], model: dict[int, float], text_col: str = "text") -> DataFrame:
    """``labelled`` (with its pattern) with posterior, score and keep."""
    sent = labelled.sparkSession.sparkContext.broadcast((posterior, model))
    kept = labelled.select(*[f"`{c}`" for c in labelled.columns if c.lower() not in _RESULTS])

    def run(batches):
        weak, w = sent.value
        shapes, bias = Memo(_shape), w.get(-1, 0.0)
        for b in batches:
            s = sigmoid(np.array([bias + sum(v * w.get(f, 0.0) for f, v in features(t, shapes).items())
                                  for t in texts_of(b, text_col, shapes)], dtype=float))
            p = [weak[x] for x in b.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(s), pa.array(s >= 0.5)], [*b.schema.names, *_RESULTS])

    return kept.mapInArrow(releasing(run), T.StructType([*kept.schema.fields, *[T.StructField(k, v) for k, v in _RESULTS.items()]]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE) -> DataFrame:
    """``docs`` with pattern, posterior, score and keep."""
    text = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    voted = cut_lineage(label(text).select("_id", "pattern", F.xxhash64("text").alias("_hash")))
    table = voted.groupBy("pattern").count().collect()  # at most 3^labellers rows
    p, *_ = estimate([r["pattern"] for r in table], [r["count"] for r in table])
    posterior = dict(zip([r["pattern"] for r in table], p.tolist()))
    one = voted.where("_id is not null").groupBy("_id").agg(F.min(F.struct("pattern", "_hash")).alias("v")).select("_id", "v.*")
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(bound)
    sample = text.withColumn("_hash", F.xxhash64("text")).join(F.broadcast(chosen), ["_id", "_hash"])
    sample = sample.dropDuplicates(["_id"])  # bound rows, however often an id comes
    fitted = cut_lineage(_sample_features(sample)).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(
        _fit(posterior), "feature long, weight double")
    model = {r.feature: r.weight for r in fitted.collect()}
    return score(label(docs, text_col), posterior, model, text_col)
