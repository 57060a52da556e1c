"""12. Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Texts are encoded by both vocabularies, as space + text. The work on tokens is Arrow tables inside tasks, a block
of whole documents at a time: the id lists are flattened with their parent indices, byte offsets are segmented
cumulative sums, and a hash join of the two sides on (document, end) gives the offsets where both end, which cut
the document into groups. Ids are counted per group, joined on the group and summed to the id pairs of each document
with their number of links; ``group_by`` over the block gives the partial document counts of its pairs.

Spark merges the partial counts: a block has one dictionary of its distinct pairs, so a pair crosses the shuffle once
per block and not once per document, and no key is hotter than the number of blocks. The corpus-wide counts return to
the blocks' dictionaries, and blocks and dictionaries meet in a cogroup bounded by the block's size.

Result per document row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (:func:`align`). A pair's
count is the number of documents that hold it linked; an A id's best pairs are those of its highest count.

Defined cases: texts null, empty, or whose tokens do not give back space + text byte by byte have no tokens: zeros and an
empty groups_sha256; repeated rows count as documents each, null ids are carried; a very long text is a block of its own;
an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_context.llm.bpe import byte_characters
from corpus_context.llm.common import UnstableCharacters, cut_lineage, releasing, small_batches, unstable_characters

#: Text bytes of a block; a document is never split, so a longer one is a block by itself.
BLOCK_BYTES = 4 << 20
_SHIFT = 16  # both vocabularies have fewer than 2^16 ids, so a pair has fewer than 2^32
_END_BITS = 36  # an Arrow string has fewer bytes, and a block fewer than 2^27 documents
#: The split pattern of byte-level vocabularies (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids of whole texts under a byte-level vocabulary file (its JSON text); special strings are plain text. Texts whose
    characters are of the same class in every Unicode table are encoded by tiktoken from the same merges, others
    by the file's own library."""

    def __init__(self, spec: str, unstable: str):
        import tiktoken

        j = json.loads(spec)
        self.spec, self.whole, vocab = spec, None, j["model"]["vocab"]
        made = [vocab[a + b] for a, b in j["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of this vocabulary are not in merge order")
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in j["added_tokens"]}
        of = {i: bytes(map(byte.__getitem__, t)) for t, i in vocab.items() if t not in special}
        self.bytes = [of.get(i, b"") for i in range(max(vocab.values()) + 1)]
        self.fast = tiktoken.Encoding("byte_level", pat_str=_PATTERN, mergeable_ranks={t: i for i, t in of.items()}, special_tokens={})
        self.unstable = UnstableCharacters(unstable)

    def ids(self, text: str) -> np.ndarray:
        if not self.unstable(text):
            return np.asarray(self.fast.encode_ordinary(text), np.int32)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.spec)
            self.whole.encode_special_tokens = True
            self.whole.no_truncation()
            self.whole.no_padding()
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """Ids of whole texts under a sentencepiece model, which puts a space before them."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text), np.int32)


@lru_cache(1)
def _encoders(spec: str, unstable: str, model: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(spec, unstable), Pieces(model)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)], dtype=np.int32)), pa.array(flat, pa.int32()))


def _tokens(ids: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """(doc, id, end, row) of every token; ``end`` holds its document and, in the low bits, its last byte's offset + 1 there."""
    flat = pc.list_flatten(ids)
    doc = pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.take(sizes, flat))
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), ids.offsets)
    end = pc.add(pc.shift_left(doc, _END_BITS), pc.subtract(total, pc.take(before, doc)))
    return pa.table({"doc": doc, "id": flat, "end": end, "row": pa.array(np.arange(len(flat)))})


def _joined(ids: np.ndarray, strings: list[bytes]) -> bytes:
    return b"".join(map(strings.__getitem__, ids.tolist()))


def _grouped(t: pa.Table, cut_rows: np.ndarray) -> np.ndarray:
    """Of each token, the number of its group in the block: the cuts before it."""
    ends = np.zeros(t.num_rows + 1, np.int64)
    ends[cut_rows + 1] = 1
    return np.cumsum(ends)[:-1]


def _shown(t: pa.Table, group: np.ndarray, groups: int) -> pa.Array:
    """The ids of each group as ``1,2,3``."""
    offsets = np.searchsorted(group, np.arange(groups + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pc.cast(t.column("id").combine_chunks(), pa.string())), ",")


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, index, values)
    return out


def align_block(a_ids: pa.ListArray, b_ids: pa.ListArray, a_sizes: pa.Array, b_sizes: pa.Array):
    """Per document n_a, n_b, n_groups, n_links and the groups' text; the linked id pairs of the block, and per pair the
    number of its documents; per document its pairs (places in that list) and their links. Both sides of a document
    have the same number of bytes."""
    n = len(a_ids)
    a, b = _tokens(a_ids, a_sizes), _tokens(b_ids, b_sizes)
    cuts = a.select(["end", "row"]).join(b.select(["end", "row"]), "end", join_type="inner", right_suffix="_b", use_threads=False)
    of_a, of_b = (np.sort(cuts.column(c).to_numpy()) for c in ("row", "row_b"))
    group_a, group_b = _grouped(a, of_a), _grouped(b, of_b)
    doc_of = a.column("doc").to_numpy()[of_a]
    groups = pc.binary_join_element_wise(_shown(a, group_a, len(of_a)), _shown(b, group_b, len(of_b)), "|")
    bounds = np.searchsorted(doc_of, np.arange(n + 1)).astype(np.int32)
    shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), groups), ";")

    id_a, id_b = a.column("id").to_numpy().astype(np.int64), b.column("id").to_numpy().astype(np.int64)
    lone = (np.bincount(group_a, minlength=len(of_a)) == 1) & (np.bincount(group_b, minlength=len(of_b)) == 1)

    def counted(group, ids):  # of the groups with several tokens; the others are a pair as they stand
        rest = ~lone[group]
        return pa.table({"group": group[rest], "id": ids[rest]}).group_by(["group", "id"], use_threads=False).aggregate([([], "count_all")])

    pairs = counted(group_a, id_a).join(counted(group_b, id_b), "group", join_type="inner", right_suffix="_b", use_threads=False)
    key = pc.add(pc.shift_left(pairs.column("id"), _SHIFT), pairs.column("id_b")).to_numpy()
    links = pc.multiply(pairs.column("count_all"), pairs.column("count_all_b")).to_numpy()
    key = np.concatenate([doc_of[pairs.column("group").to_numpy()] << 32 | key,
                          doc_of[lone] << 32 | id_a[lone[group_a]] << _SHIFT | id_b[lone[group_b]]])
    held = pa.table({"key": key, "links": np.concatenate([links, np.ones(int(lone.sum()), np.int64)])}).group_by(
        "key", use_threads=False).aggregate([("links", "sum")]).sort_by("key")
    key = held.column("key").to_numpy()
    pair, of = pa.array(key & 0xFFFFFFFF), key >> 32
    holders = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    place = pc.index_in(pair, value_set=holders.column("pair").combine_chunks())
    at = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
    number = held.column("links_sum").combine_chunks()
    per_doc = {"n_a": pc.list_value_length(a_ids), "n_b": pc.list_value_length(b_ids), "n_groups": pa.array(np.diff(bounds)),
               "n_links": pa.array(_sums(of, number.to_numpy(), n)), "shown": shown,
               "place": pa.ListArray.from_arrays(at, place), "links": pa.ListArray.from_arrays(at, number)}
    return per_doc, holders.column("pair").combine_chunks(), holders.column("count_all").combine_chunks()


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(docs: DataFrame, spec, model) -> DataFrame:
    """Rows of documents (with place and links) and, per block, one row of its pairs and their documents' numbers."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"block long, id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + \
        ", groups_sha256 string, place array<int>, links array<long>, pairs array<long>, holders array<long>"

    unstable = unstable_characters()

    def run(batches):
        a_side, b_side = _encoders(spec.value, unstable, model.value)
        a_sizes, b_sizes = (pa.array(np.array(list(map(len, s.bytes)), np.int64)) for s in (a_side, b_side))
        none, task, number = np.empty(0, np.int32), TaskContext.get().partitionId() << 32, 0

        def done(ids, a, b, id_type):
            block = task + number
            out, pairs, holders = align_block(_lists(a), _lists(b), a_sizes, b_sizes)
            n = len(ids)
            sha = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in out["shown"].to_pylist()]
            rows = [pa.array(np.full(n, block)), pa.array(ids, id_type), *[pc.cast(out[c], pa.int64()) for c in _COUNTS], pa.array(sha, pa.string()),
                    out["place"], out["links"], pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]
            names = ["block", "id", *_COUNTS, "groups_sha256", "place", "links", "pairs", "holders"]
            yield pa.RecordBatch.from_arrays(rows, names)
            lone = [pa.array([block]), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
                    pa.array([pairs], pa.list_(pa.int64())), pa.array([holders], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(lone, names)

        ids, a, b, held, id_type = [], [], [], 0, None
        for batch in batches:
            id_type = batch.column("id").type
            for i, v in zip(batch.column("id"), batch.column("text")):
                text = v.as_py() or ""
                x = y = none
                if text:
                    raw = b" " + text.encode()
                    x, y = a_side.ids(" " + text), b_side.ids(text)
                    if _joined(x, a_side.bytes) != raw or _joined(y, b_side.bytes) != raw:
                        x = y = none
                    held += len(raw)
                ids.append(i.as_py())
                a.append(x)
                b.append(y)
                if held >= BLOCK_BYTES:
                    yield from done(ids, a, b, id_type)
                    ids, a, b, held, number = [], [], [], 0, number + 1
        if ids:
            yield from done(ids, a, b, id_type)

    return docs.mapInArrow(releasing(run), schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best) of all linked id pairs; best: no pair of the same A id has a higher count."""
    parts = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = cut_lineage(parts.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count")))
    a = F.shiftright("pair", _SHIFT)  # the A id; the B id is in the low bits
    top = F.broadcast(counts.groupBy(a.alias("a")).agg(F.max("count").alias("top")))  # at most one row per id of the vocabulary
    return counts.withColumn("a", a).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def _looked_up(key: tuple, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    order = np.argsort(pairs.column("at").to_numpy())
    count = pairs.column("count").to_numpy()[order]
    best = pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    place, links = docs.column("place").combine_chunks(), docs.column("links").combine_chunks()
    row = pc.list_parent_indices(place).to_numpy()
    at, times = pc.list_flatten(place).to_numpy(), pc.list_flatten(links).to_numpy()
    n = docs.num_rows
    n_best, total = (pa.array(_sums(row, times * v[at], n)) if len(at) else pa.array(np.zeros(n, np.int64)) for v in (best, count))
    kept = docs.select(["id", *_COUNTS])
    return kept.append_column("n_best", n_best).append_column("count_sum", total).append_column("groups_sha256", docs.column("groups_sha256"))


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``; the vocabularies are paths on the driver (under 2 MB each, broadcast)."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(byte_vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    with open(piece_model, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    blocks = cut_lineage(_blocks(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), spec, model))
    entries = blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "pair"))
    entries = entries.join(pair_counts(blocks), "pair").select("block", "at", "count", "best")
    rows = blocks.where("pairs is null").drop("pairs", "holders")
    schema = f"`{id_col}` {blocks.schema['id'].dataType.simpleString()}, " + ", ".join(
        f"{c} long" for c in (*_COUNTS, "n_best", "count_sum")) + ", groups_sha256 string"

    def looked_up(key, left, right):
        out = _looked_up(key, left, right)
        return out.rename_columns([id_col, *out.column_names[1:]])

    entries = entries.withColumnRenamed("block", "of_block")
    return rows.groupBy("block").cogroup(entries.groupBy("of_block")).applyInArrow(looked_up, schema)
