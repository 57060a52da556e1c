"""5. Word n-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed five-word shingles (lower case, signs dropped). Documents with equal sets are
one class at once and go on as one representative. Representatives that agree in one of 32 bands of 4 MinHash
values are candidates: at similarity 0.8 a pair is missed with probability (1 - 0.8^4)^32 < 1e-7. A
candidate pair's MinHash values are compared 16 at a time; under a uniform prior the posterior of the
similarity after m matches of n is Beta(m + 1, n - m + 1), and the pair is dropped as soon as the
posterior probability of reaching the threshold is below TOLERANCE. What survives all 128 is verified on the
shingle sets themselves.

Pairs never become rows. Round one splits each band's bucket into blocks, compares the blocks' pairs
inside tasks and returns a spanning forest of the surviving pairs; its components are the groups in which
links can be. Round two brings each member's shingles together once per pair of blocks of its group,
compares and verifies there, and returns for each member the number of its links and a spanning forest
of the links. So one large bucket or group is spread over many bounded tasks and nothing is capped.

Result per document row: class_id (smallest id of the documents that links connect; null if all of theirs are null), n_links (other documents of similarity >= the threshold, copies counted each).

Defined cases: a text of fewer than five words is one shingle of its words; a text without words (null,
empty, signs only) links to nothing and is its own class; repeated rows are documents of equal text; an
empty table gives no rows; extra columns are carried, those named like a result replaced.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_context.llm.common import (Forest, Memo, components, counted, cut_lineage, keep_matching, releasing, shuffled,
                                       small_batches, texts_of, whole_groups, with_key)

WORDS, THRESHOLD = 5, 0.8
BANDS, BAND_VALUES = 32, 4
VALUES, STEP = BANDS * BAND_VALUES, 16
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
#: Members of a bucket, and of a group of candidates, that one side of a task's comparison holds.
BUCKET_BLOCK, GROUP_BLOCK = 1024, 256
_COLUMNS = 8192  # shingles of a group that are counted at a time

_SIGNS = re.compile(r"\W+")
_rng = np.random.default_rng(5)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _word(piece: str) -> int:
    core = _SIGNS.sub("", piece.lower())
    return xxhash.xxh3_64_intdigest(core) | 1 if core else 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, words: Memo, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    w = np.fromiter(map(words.__getitem__, text.split()), np.uint64)
    w = w[w != 0]
    if not len(w):
        return w
    size = min(size, len(w))
    n = len(w) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _P + w[i : i + n]
    return np.unique(_mix(h))


def minhash(u: np.ndarray) -> np.ndarray:
    """128 MinHash values of 16 bits."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(u), 2048):
        np.minimum(low, (_A[:, None] * u[None, at : at + 2048] + _B[:, None]).min(1), out=low)
    return (_mix(low) & np.uint64(0xFFFF)).astype("<u2")


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """By number of values compared (STEP, 2 STEP, ...): the fewest matches with which a pair stays.
    P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


_LEAST = least_matches()


def surviving(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions in (i, j) of the pairs that no partial comparison of MinHash values drops."""
    left = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(_LEAST):
        if not len(left):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (sig[i[left], part] == sig[j[left], part]).sum(1, dtype=np.int32)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
    return left


def documents(docs: DataFrame, with_shingles: bool = False) -> DataFrame:
    """(_key, set_id, n, sig[, shingles]) of (_key, text)."""

    def run(batches):
        words = Memo(_word)
        for b in batches:
            keys, out, held = b.column("_key").to_pylist(), [], 0
            for key, text in zip(keys, texts_of(b, memo=words)):
                u = shingles(text, words)
                raw = u.tobytes()
                out.append((key, xxhash.xxh3_128_digest(raw), len(u), minhash(u).tobytes(), raw))
                held += with_shingles * len(raw)
                if held > 16 << 20:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    names = ["_key", "set_id", "n", "sig", "shingles"][: 4 + with_shingles]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()][: len(names)]

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "_key long, set_id binary, n long, sig binary" + ", shingles binary" * with_shingles
    return docs.select("_key", "text").mapInArrow(releasing(run), schema)


def _pairs(t: pa.Table, key: list[str]):
    """Yields candidate positions (i, j) of all pairs to compare in the groups of ``t``, by distance in the
    sorted table: within a group of one block, across the sides in a group of two."""
    k = [t.column(c).to_numpy() for c in key]
    n = t.num_rows
    group = np.r_[0, np.cumsum(np.any([c[1:] != c[:-1] for c in k], axis=0))] if n else np.empty(0, int)
    end = np.searchsorted(group, group, "right")
    one, side = t.column("bi").to_numpy() == t.column("bj").to_numpy(), t.column("side").to_numpy()
    alive = np.arange(n)
    for gap in range(1, n):
        alive = alive[alive + gap < end[alive]]
        if not len(alive):
            return
        i, j = alive, alive + gap
        wanted = one[i] | (side[i] != side[j])
        if wanted.any():
            yield i[wanted], j[wanted]


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(t.num_rows, VALUES)


def _candidate_forest(batches):
    key = ["group", "bi", "bj"]
    for t in whole_groups(batches, key):
        sig, rep, forest = _signatures(t), t.column("rep").to_numpy(), Forest(t.num_rows)
        for i, j in _pairs(t, key):
            apart = forest.up[i] != forest.up[j]
            i, j = i[apart], j[apart]
            found = surviving(sig, i, j)
            if len(found):
                forest.join(i[found], j[found])
        child = np.nonzero(forest.up != np.arange(t.num_rows))[0]
        yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[forest.up[child]])], ["a", "b"])


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j."""
    if len(i) < 4 * len(sets):
        return np.array([_two(sets[a], sets[b]) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    members = np.unique(np.r_[i, j])
    place = np.searchsorted(members, np.arange(len(sets)))
    values, cols, times = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    shared = times > 1
    column = (np.cumsum(shared) - 1)[cols]
    held = shared[cols]
    rows, column = rows[held], column[held]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    both = np.zeros((len(members), len(members)), np.float32)
    for at in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [at, at + _COLUMNS])
        m = np.zeros((len(members), _COLUMNS), np.float32)
        m[rows[a:b], column[a:b] - at] = 1
        both += m @ m.T
    return both[place[i], place[j]].astype(np.int64)


def _two(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _verified(batches):
    key = ["group", "bi", "bj"]
    for t in whole_groups(batches, key):
        sig, rep, copies = _signatures(t), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        forest, links, left, right = Forest(t.num_rows), np.zeros(t.num_rows, np.int64), [], []
        for i, j in _pairs(t, key):
            fit = np.minimum(n[i], n[j]) >= THRESHOLD * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[fit], j[fit]
            found = surviving(sig, i, j)
            left.append(i[found])
            right.append(j[found])
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            k = [t.column(c).to_numpy() for c in key]
            group = np.r_[0, np.cumsum(np.any([c[1:] != c[:-1] for c in k], axis=0))]
            order = np.argsort(group[i], kind="stable")
            i, j = i[order], j[order]
            edges = np.r_[np.nonzero(np.r_[True, group[i][1:] != group[i][:-1]])[0], len(i)] if len(i) else []
            for a, b in zip(edges[:-1], edges[1:]):  # one group at a time
                first, last = np.searchsorted(group, [group[i[a]], group[i[a]] + 1])
                both = _common(sets[first:last], i[a:b] - first, j[a:b] - first)
                near = both >= THRESHOLD * (n[i[a:b]] + n[j[a:b]] - both) - 1e-9
                x, y = i[a:b][near], j[a:b][near]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                forest.join(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(rep[forest.up])], ["rep", "links", "root"])


def _in_blocks(members: DataFrame, size: str, block: int) -> DataFrame:
    """Members of a group dealt to the pairs of its blocks: one row for each block of the group."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.hash("rep"), blocks)
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other"), "side": F.col("own")}).drop(
        size, "own", "other").repartition("group", "bi", "bj").sortWithinPartitions("group", "bi", "bj")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _key (a key of the row's own), _class (the smallest key of its class), _links (see n_links)."""
    return _classes(with_key(docs, id_col), text_col)


def _classes(keyed: DataFrame, text_col: str) -> DataFrame:
    small_batches(keyed.sparkSession)
    texts = keyed.select("_key", F.col(text_col).alias("text"))
    sigs = cut_lineage(documents(texts))
    reps = sigs.where("n > 0").groupBy("set_id").agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    reps = cut_lineage(reps)

    bands = reps.select("rep", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("sig", b * 8 + 1, F.lit(8)))).alias("band", "v")).select(
        F.xxhash64("band", "v").alias("group"), "rep")
    shared = bands.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = bands.join(shuffled(shared), "group").join(shuffled(reps.select("rep", "sig")), "rep")
    edges = _in_blocks(members, "size", BUCKET_BLOCK).mapInArrow(releasing(_candidate_forest), "a long, b long")

    groups = components(edges)
    sizes = cut_lineage(groups.groupBy("label").agg(F.count(F.lit(1)).alias("size")))
    groups = cut_lineage(groups.join(counted(sizes), "label").join(shuffled(reps.select(F.col("rep").alias("node"), "copies")), "node").select(
        F.col("node").alias("rep"), F.col("label").alias("group"), "size", "copies"))
    again = documents(keep_matching(texts, groups.select(F.col("rep").alias("_key")), "_key"), with_shingles=True)
    full = again.select(F.col("_key").alias("rep"), "sig", "shingles").join(counted(groups), "rep")
    found = cut_lineage(_in_blocks(full, "size", GROUP_BLOCK).mapInArrow(releasing(_verified), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))

    by_set = reps.select("set_id", "rep", "copies").join(shuffled(links), "rep", "left").join(
        shuffled(labels.select(F.col("node").alias("rep"), "label")), "rep", "left")
    of = sigs.where("n > 0").select("_key", "set_id").join(shuffled(by_set), "set_id").select(
        "_key", F.coalesce("label", "rep").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return keyed.join(of.withColumnsRenamed({"class_id": "_class", "n_links": "_links"}), "_key", "left").withColumns({
        "_class": F.coalesce("_class", "_key"), "_links": F.coalesce("_links", F.lit(0).cast("long"))})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with class_id (the smallest id in the row's class) and n_links."""
    keyed = with_key(docs, id_col)
    found = _classes(keyed, text_col)
    if keyed.where(~F.col(id_col).eqNullSafe(F.col("_key"))).isEmpty():  # the keys are the ids
        found = found.withColumn("_id", F.col("_class"))
    else:
        found = cut_lineage(found)
        found = found.join(counted(cut_lineage(found.groupBy("_class").agg(F.min(id_col).alias("_id")))), "_class")
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("class_id", "n_links")]
    return found.select(*kept, F.col("_id").alias("class_id"), F.col("_links").alias("n_links"))
