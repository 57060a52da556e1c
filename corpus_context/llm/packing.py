"""7. Hierarchical packing into windows of several lengths.

Documents become token ids with an end id. A document of 1024 ids or more fills whole windows of the
longest tier; what is left, and every shorter document, is routed to the smallest tier that holds
it. Each tier is packed from the longest down: a piece opens a window, and its gap is filled with
whole pieces of shorter tiers, the longest that fit first, the last one cut to close the window
(if shorter pieces run out, the next of the same tier is cut). So every window is exactly full.
A task packs what its part of the scan gives it, batch by batch, and carries less than a window per
tier to the next batch; there is no shuffle, and only the last window of a task can be short.
Windows of a tier are dealt to step groups of equal token counts.

Defined cases: null text is empty, which is the end id alone; repeated rows are packed each; an empty
table gives no rows; extra columns are dropped. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_context.llm.bpe import byte_characters
from corpus_context.llm.common import UnstableCharacters, releasing, small_batches, unstable_characters

TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 64 * 1024
_FLUSH = 4 << 20  # tokens of pieces handed back at a time
#: The split pattern of byte-level vocabularies (fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = ("{id} {type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


class ByteBpe:
    """Ids, as little-endian 32-bit bytes, of whole texts. tiktoken encodes them by the same vocabulary, whose ids are in
    merge order; texts that hold a special token, or a character that Unicode tables may class differently, go to the
    library of the vocabulary file."""

    def __init__(self, spec: str, unstable: str | None = None):
        import tiktoken

        self.spec, self.whole = spec, None
        self.unstable = UnstableCharacters(unstable)
        j = json.loads(spec)
        self.special = [t["content"] for t in j["added_tokens"]]
        vocab = j["model"]["vocab"]
        merged = [vocab[a + b] for a, b in j["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary are not in merge order")
        byte = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> list[int]:
        if self.whole is None:  # few texts need it
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.spec)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or self.unstable(text):
            return np.array(self._by_library(text), "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


_LOADED: dict[str, ByteBpe] = {}


def _load(spec: str, unstable: str) -> ByteBpe:
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = ByteBpe(spec, unstable)
    return _LOADED[spec]


class Packer:
    """Windows of one task. A piece is [document, start, length]; documents are (id, ids, tokens)."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS, shard: int = 0):
        self.tiers = sorted(tiers, reverse=True)
        self.step_tokens, self.shard = step_tokens, shard
        self.queue = {w: deque() for w in self.tiers}
        self.windows = dict.fromkeys(self.tiers, 0)
        self.n = 0
        self.out: list[tuple] = []

    def route(self, doc: tuple, start: int = 0, length: int | None = None) -> None:
        """Cuts whole windows of the longest tier off and queues the rest."""
        length = doc[2] - start if length is None else length
        longest = self.tiers[0]
        while length >= longest:
            self.emit([[doc, start, longest]], longest)
            start, length = start + longest, length - longest
        if length:
            self.queue[next(w for w in reversed(self.tiers) if length <= w)].append([doc, start, length])

    def emit(self, pieces: list, tier: int) -> None:
        group = self.windows[tier] * tier // self.step_tokens
        self.windows[tier] += 1
        sequence = self.shard << 33 | self.n
        step = (self.shard << 33 | group) * len(self.tiers) + self.tiers.index(tier)
        self.n += 1
        offset = 0
        for (doc_id, ids, tokens), start, length in pieces:
            self.out.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens, sequence, offset, tier, step))
            offset += length

    def fill(self, gap: int, tier: int) -> list:
        """Pieces of ``gap`` tokens together, or as many as there are."""
        got = []
        while gap:
            whole = next((w for w in self.tiers if w <= gap and w < tier and self.queue[w]), None)
            source = whole or next((w for w in reversed(self.tiers) if w <= tier and self.queue[w]), None)
            if source is None:
                break
            piece = self.queue[source].popleft()
            if piece[2] > gap:
                doc, start, length = piece
                self.route(doc, start + gap, length - gap)
                piece = [doc, start, gap]
            got.append(piece)
            gap -= piece[2]
        return got

    def pack(self) -> None:
        """Closes every window that the queued pieces can fill."""
        for tier in self.tiers:
            while self.queue[tier]:
                first = self.queue[tier].popleft()
                pieces = [first, *self.fill(tier - first[2], tier)]
                if sum(p[2] for p in pieces) < tier:
                    self.queue[tier].extendleft(reversed(pieces))
                    break
                self.emit(pieces, tier)

    def close(self) -> None:
        """The rest, less than a window per tier, as one run cut at the tiers' lengths; only the last may be short."""
        self.pack()
        rest = deque(p for w in self.tiers for p in self.queue[w])
        left = sum(p[2] for p in rest)
        while left:
            tier = next((w for w in self.tiers if w <= left), self.tiers[-1])
            gap, pieces = min(tier, left), []
            left -= gap
            while gap:
                doc, start, length = rest.popleft()
                if length > gap:
                    rest.appendleft([doc, start + gap, length - gap])
                    length = gap
                pieces.append([doc, start, length])
                gap -= length
            self.emit(pieces, tier)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of ``docs`` (:data:`SCHEMA`; ids as little-endian 32-bit bytes); ``tokenizer`` is a path on the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    schema = SCHEMA.format(id=id_col, type=dict(docs.dtypes)[id_col])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    end, unstable = np.array([end_id], "<u4").tobytes(), unstable_characters()

    def run(batches):
        bpe = _load(spec.value, unstable)
        packer = Packer(tiers, step_tokens, TaskContext.get().partitionId())

        def out():
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = bpe.ids(text.as_py() or "") + end
                packer.route((doc_id.as_py(), ids, len(ids) // 4))
                held += len(ids) // 4
                if held > _FLUSH:
                    packer.pack()
                    held = 0
                    yield out()
            packer.pack()
            if packer.out:
                yield out()
        packer.close()
        if packer.out:
            yield out()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(releasing(run), schema)


def digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of each piece's ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
