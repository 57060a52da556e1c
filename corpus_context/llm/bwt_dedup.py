"""6. Removal of repeated byte strings by grouping anchored suffixes and refining what is left open.

Every byte covered by a string of LENGTH bytes that also starts elsewhere (in any document, the same one
included) is removed.

The dealt merge of whole transforms would refine every byte of the corpus LENGTH times. Here the suffixes kept are
those at anchors: each LENGTH-byte window has one, the start of its GRAM-byte string of least hash, so equal
windows have equal anchors at equal offsets and every window belongs to exactly one (anchor, offset).
No transform is built and no sorted orders are merged; of the dealt method, the refinement of blocks (intervals of suffixes
with a common prefix) is left, the first two steps of which are hash grouping:
  1. by the first GRAM bytes, as one symbol: blocks of one suffix are done, nothing there is repeated;
  2. by everything on both sides that the anchor's windows can reach: blocks of two or more are done, all
     their windows are repeated;
  3. what is left (a block whose suffixes begin alike and then differ) byte by byte: the blocks after t
     steps to the right are the intervals of common prefix GRAM + t, those after t steps to the left the
     intervals of common preceding text, and a window is repeated if its interval in both holds another.
Step 3 compares bytes; steps 1 and 2 compare 64-bit hashes (2 within blocks of 1). Repeated windows become
spans of their documents. A block of more than HOT different surroundings is not refined in one task: its
windows are grouped by content in Spark instead.

Defined cases: null is the empty text; texts shorter than LENGTH keep all; repeated rows are separate
documents whose texts repeat each other, so both lose them; spans can cut a character, so ``kept`` is binary;
an empty table gives no rows; extra columns are carried, but for ``raw`` and ``found``, which are dropped, and those named
like a result, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context.llm.common import (cut_lineage, drop_matching, keep_matching, releasing, shuffled, small_batches, whole_groups,
                                       with_key)
from corpus_context.llm.jaccard_join import _mix

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM  # bytes next to an anchor's gram that a window can hold
#: Different surroundings of one gram that a single task refines.
HOT = 100_000
_SEGMENT = 1 << 18  # bytes parsed at a time
_LOW = np.uint64((1 << 21) - 1)  # positions in a segment, below the hash bits that order grams

_RESULTS = ("n_bytes", "spans", "kept")
_SPANS = "array<struct<start:long,end:long>>"


def _powers(n: int):
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out


_POWERS: list = []


def anchors(data: np.ndarray, ends: np.ndarray):
    """(position, least and most offset, gram hash) of the anchors of pieces laid end to end in ``data``;
    ``ends`` has the end of each piece. A window's offset is its anchor's position less its start."""
    if not _POWERS:
        _POWERS.extend(_powers(_SEGMENT + LENGTH + 1))
    power, inverse = _POWERS
    n, grams, wide = len(data), len(data) - GRAM + 1, REACH + 1
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=h[1:])
    g = _mix((h[GRAM:] - h[:-GRAM]) * inverse[:grams])
    key = (g & ~_LOW) | np.arange(grams, dtype=np.uint64)
    blocks = np.full(-(-grams // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    blocks[:grams] = key
    blocks = blocks.reshape(-1, wide)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    at = (np.minimum(before[:windows], after[REACH : REACH + windows]) & _LOW).astype(np.int64)
    piece = np.searchsorted(ends, np.arange(windows), "right")
    fine = np.arange(windows) + LENGTH <= ends[piece]
    start, at, piece = np.nonzero(fine)[0], at[fine], piece[fine]
    if not len(start):
        return start, start, start, g[:0], piece
    first = np.nonzero(np.r_[True, (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])])[0]
    last = np.r_[first[1:], len(start)] - 1
    return at[first], at[first] - start[last], at[first] - start[first], g[at[first]], piece[first]


def _pieces(batches):
    """Lists of (key, offset in the text, bytes) of a segment's size; long texts in overlapping pieces."""
    held, size = [], 0
    for b in batches:
        for key, raw in zip(b.column("_key").to_pylist(), b.column("raw")):
            raw = raw.as_py()
            for base in range(0, max(len(raw) - LENGTH + 1, 0), _SEGMENT // 2):
                part = raw[base : base + _SEGMENT // 2 + LENGTH - 1]
                if size + len(part) > _SEGMENT:
                    yield held
                    held, size = [], 0
                held.append((key, base, part))
                size += len(part)
    if held:
        yield held


def _parse(batches):
    for pieces in _pieces(batches):
        data = b"".join(p[2] for p in pieces)
        ends = np.cumsum([len(p[2]) for p in pieces])
        at, lo, hi, g, piece = anchors(np.frombuffer(data, np.uint8), ends)
        begin = ends - [len(p[2]) for p in pieces]
        keys, bases = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
        around = [xxhash.xxh3_64_intdigest(data[a - h : a - l + LENGTH], l << 8 | h)
                  for a, l, h in zip(at.tolist(), lo.tolist(), hi.tolist())]
        order = np.argsort(g, kind="stable")
        columns = [g.view(np.int64), np.array(around, np.uint64).view(np.int64), keys[piece],
                   at - begin[piece] + bases[piece], lo.astype(np.int16), hi.astype(np.int16)]
        yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in columns], ["sym", "around", "_key", "pos", "lo", "hi"])


def _surroundings(batches):
    """For each document and list of its anchors: the bytes that the anchors' windows cover."""
    for b in batches:
        out, size = [], 0
        for key, raw, found in zip(b.column("_key").to_pylist(), b.column("raw"), b.column("found")):
            raw = raw.as_py()
            for f in found.as_py():
                part = raw[f["pos"] - f["hi"] : f["pos"] - f["lo"] + LENGTH]
                out.append((f["sym"], f["n"], key, f["pos"], f["lo"], f["hi"], part))
                size += len(part)
            if size > 8 << 20:
                yield _as_batch(out)
                out, size = [], 0
        if out:
            yield _as_batch(out)


_AROUND = "sym long, n long, _key long, pos long, lo short, hi short, part binary"


def _as_batch(rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.binary()]
    names = ["sym", "n", "_key", "pos", "lo", "hi", "part"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _refined(blocks: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The blocks split by the next symbol."""
    return np.unique(blocks * 257 + symbols, return_inverse=True)[1]


def repeated_offsets(block: np.ndarray, lo: np.ndarray, hi: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """Boolean rows x (REACH + 1): whether a suffix's window at an offset occurs at another suffix of its block.
    ``parts`` hold the bytes from ``hi`` before the anchor to the end of its last window."""
    n, every = len(parts), np.arange(len(parts))
    size = np.fromiter(map(len, parts), np.int64, n)
    data = np.frombuffer(b"".join(parts) + bytes(1), np.uint8)
    begin = np.cumsum(size) - size
    at = begin + hi  # the anchors

    def symbol(p, there):
        return np.where(there, data[np.where(there, p, 0)].astype(np.int64), 256)

    rights = [block]
    for t in range(REACH):
        p = at + GRAM + t
        rights.append(_refined(rights[-1], symbol(p, p < begin + size)).astype(np.int32))
    out = np.zeros((n, REACH + 1), bool)
    left = block
    for o in range(REACH + 1):
        if o:
            left = _refined(left, symbol(at - o, o <= hi))
        here = every[(lo <= o) & (o <= hi)]
        if len(here):
            pair = left[here].astype(np.int64) * n + rights[REACH - o][here]
            _, own, times = np.unique(pair, return_inverse=True, return_counts=True)
            out[here, o] = times[own] > 1
    return out


def _refine(batches):
    for t in whole_groups(batches, ["sym"]):
        sym = t.column("sym").to_numpy()
        block = np.r_[0, np.cumsum(sym[1:] != sym[:-1])].astype(np.int64)
        lo, hi = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
        found = repeated_offsets(block, lo, hi, t.column("part").to_pylist())
        found &= (t.column("n").to_numpy() == 1)[:, None]  # the others are settled
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        pos, key = t.column("pos").to_numpy(), t.column("_key").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[row]), pa.array(pos[row] - last), pa.array(pos[row] - first + LENGTH)], ["_key", "start", "end"])


def _in_spark(around: DataFrame) -> DataFrame:
    """Step 3 for blocks too large for a task: a block's windows grouped by content."""
    w = around.select("sym", "n", "_key", "pos", "hi", "part", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("o"))
    w = w.select("sym", "o", "n", "_key", "pos", F.md5(F.substring("part", F.col("hi").cast("int") - F.col("o") + 1, F.lit(LENGTH))).alias("content"))
    often = w.groupBy("sym", "o", "content").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return w.where("n = 1").join(often, ["sym", "o", "content"]).select(
        "_key", (F.col("pos") - F.col("o")).alias("start"), (F.col("pos") - F.col("o") + LENGTH).alias("end"))


def repeated_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(_key, start, end): byte ranges, not yet merged, that repeated windows cover, of (_key, raw)."""
    parsed = cut_lineage(texts.mapInArrow(releasing(_parse), "sym long, around long, _key long, pos long, lo short, hi short"))
    # written, so that both sides of the join are plain exchanges, whose large partitions Spark can split
    first = cut_lineage(parsed.groupBy("sym").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("sym"))
    left = cut_lineage(parsed.join(first, "sym"))
    kinds = cut_lineage(left.groupBy("sym", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_key", "pos", "lo", "hi")).alias("one")))
    settled = left.join(shuffled(kinds.where("n > 1").select("sym", "around")), ["sym", "around"]).select(
        "_key", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + LENGTH).alias("end"))

    several = kinds.groupBy("sym").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = kinds.join(several, "sym").select("sym", "n", "one.*", (F.col("kinds") > hot).alias("hot"))
    lists = cut_lineage(open_.groupBy("_key").agg(
        F.collect_list(F.struct("sym", "n", "pos", "lo", "hi")).alias("found"), F.max("hot").alias("hot")))
    around = keep_matching(texts, lists.select("_key"), "_key").join(shuffled(lists), "_key").select("_key", "raw", "found").mapInArrow(
        releasing(_surroundings), _AROUND)
    if lists.where("hot").isEmpty():
        refined = around.repartition("sym").sortWithinPartitions("sym").mapInArrow(releasing(_refine), "_key long, start long, end long")
    else:
        around = cut_lineage(around)
        large = several.where(F.col("kinds") > hot).select("sym")
        refined = around.join(large, "sym", "left_anti").repartition("sym").sortWithinPartitions("sym").mapInArrow(
            releasing(_refine), "_key long, start long, end long").unionByName(_in_spark(around.join(large, "sym", "left_semi")))
    return settled.unionByName(refined)


def _cut(batches):
    """Merged spans and what is left of each text."""
    for b in batches:
        spans, kept = [], []
        for raw, found in zip(b.column("raw"), b.column("found")):
            raw = raw.as_py()
            f = found.values
            start, end = f.field("start").to_numpy(), f.field("end").to_numpy()
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.r_[True, start[1:] > reach[:-1]]
            first, last = start[new], reach[np.r_[new[1:], True]]
            spans.append([{"start": x, "end": y} for x, y in zip(first.tolist(), last.tolist())])
            kept.append(b"".join(raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(raw)])))
        names = [c for c in b.schema.names if c not in ("raw", "found")]
        yield pa.RecordBatch.from_arrays(
            [*[b.column(c) for c in names], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(kept, pa.binary())], [*names, "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with n_bytes, spans (removed byte ranges, merged, ascending) and kept (the remaining bytes)."""
    small_batches(docs.sparkSession)
    keyed = with_key(docs, id_col)
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    spans = repeated_spans(keyed.select("_key", raw.alias("raw")), hot)
    lists = cut_lineage(spans.groupBy("_key", "start", "end").count().groupBy("_key").agg(
        F.collect_list(F.struct("start", "end")).alias("found")))
    carried = [f"`{c}`" for c in keyed.columns if c.lower() not in (*_RESULTS, "raw", "found")]
    rows = keyed.select(*carried, F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"))
    ids = lists.select("_key")
    whole = drop_matching(rows, ids, "_key").withColumns(
        {"spans": F.array().cast(_SPANS), "kept": F.col("raw")}).drop("raw", "_key")
    touched = keep_matching(rows, ids, "_key").join(shuffled(lists), "_key")
    fields = [f for f in touched.schema.fields if f.name not in ("raw", "found")]
    cut = touched.mapInArrow(releasing(_cut), T.StructType([*fields, *T.StructType.fromDDL(f"spans {_SPANS}, kept binary").fields]))
    return whole.unionByName(cut.drop("_key"))
