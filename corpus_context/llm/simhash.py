"""11. SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the majority vote of its shingles' hashes, bit by bit. Fingerprints within RADIUS bits of each
other link. Each of the 64 bits gets a nonzero vector of RADIUS + 1 bits, dealt in turn; table v (again a nonzero vector)
compares the bits whose vector has an odd inner product with v. Up to RADIUS differing bits never span the whole space,
so for some v all of them are outside its mask: every pair within the radius meets in some of the 15 tables, with certainty.

Equal fingerprints are one node. A bucket of up to BLOCK fingerprints is compared in one task, which returns a spanning
forest of its links, never pairs. A larger bucket is covered again: its fingerprints differ only in the bits outside
its masks, and 15 masks over these split it further with the same certainty. The bits left halve each time, so a bucket
of any size ends in small ones and nothing is capped. Components are joined over the forests.

Defined cases: a text without words (null, empty, white space only) has fingerprint zero and links like any other; fewer
words than a shingle are one shingle; words may be of any bytes but ASCII white space; repeated rows are documents of equal
fingerprint; null ids take no part in the smallest id of a component, which is null if it has no other; an empty table
gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_context.llm.common import (Forest, components, cut_lineage, drop_matching, keep_matching, releasing, small_batches,
                                       whole_groups)

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints that one task compares with each other.
BLOCK = 512
_AT_ONCE = 1 << 16  # shingles of a text that are counted at a time
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, size: int = WORDS) -> int:
    words = text.lower().split()  # on bytes: A-Z, and cut at ASCII white space
    if not words:
        return 0
    size = min(size, len(words))
    n = len(words) - size + 1
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _AT_ONCE):
        part = words[at : at + _AT_ONCE + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size))))
        h = np.fromiter(map(_HASH, shingles), "<u8", len(part) - size + 1)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def masks(bits: int, radius: int = RADIUS) -> list[int]:
    """Masks within ``bits``: any up to ``radius`` of these bits miss one of the masks."""
    places = [i for i in range(64) if bits >> i & 1]
    of = {p: 1 + k % (2 ** (radius + 1) - 1) for k, p in enumerate(places)}
    return [sum(1 << p for p, vector in of.items() if (vector & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fp) of (id, text); fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(v.as_buffer().to_pybytes()) if v.is_valid else 0 for v in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(releasing(run), f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(batches):
    for t in whole_groups(batches, ["bucket"]):
        bucket = t.column("bucket").to_numpy()
        fp = t.column("fp").to_numpy()
        bits, forest, n = fp.view(np.uint64), Forest(t.num_rows), t.num_rows
        end, alive = np.searchsorted(bucket, bucket, "right"), np.arange(n)
        for gap in range(1, n):
            alive = alive[alive + gap < end[alive]]
            if not len(alive):
                break
            near = np.bitwise_count(bits[alive] ^ bits[alive + gap]) <= RADIUS
            i = alive[near]
            i = i[forest.up[i] != forest.up[i + gap]]
            if len(i):
                forest.join(i, i + gap)
        child = np.nonzero(forest.up != np.arange(n))[0]
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[forest.up[child]])], ["a", "b"])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints ``nodes`` (fp) that span the components of their links.

    Each round deals the members of all buckets that are still too large to their next 15 tables. A bucket's ``path``
    names the tables taken so far, and with them the bits in which its members can differ. Masks over eight bits or more
    leave at least one bit fewer, and within seven bits there are no more than 2^7 fingerprints, so rounds end.
    """
    spark, found, block = nodes.sparkSession, [], max(block, 2**7)
    free = {0: 2**64 - 1}  # by path
    members = nodes.select("fp", F.lit(0).alias("path"), F.lit(0).cast("long").alias("bucket"))
    while free:
        cover = [(path, path * 16 + t + 1, _signed(m), left & ~m) for path, left in free.items() for t, m in enumerate(masks(left))]
        table = spark.createDataFrame([c[:3] for c in cover], "path int, next int, mask long")  # 15 rows a path, at most 15^3 paths
        value = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = members.join(F.broadcast(table), "path").select("fp", F.col("next").alias("path"), F.xxhash64("bucket", "next", value).alias("bucket"))
        large = cut_lineage(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.first("path").alias("path")).where(F.col("n") > block))
        paths = {r.path for r in large.select("path").distinct().collect()}
        small = drop_matching(dealt, large.select("bucket"), "bucket") if paths else dealt
        together = small.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
        found.append(together.mapInArrow(releasing(_links), "a long, b long"))
        if not paths:
            break
        members = cut_lineage(keep_matching(dealt, large.select("bucket"), "bucket"))
        free = {path: left for _, path, _, left in cover if path in paths}
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    fps = cut_lineage(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("id").alias("least")))
    label = components(links(nodes.select("fp"), block)).select(F.col("node").alias("fp"), "label")
    of = nodes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = cut_lineage(of.join(least, "label").select("fp", "component_id"))
    return fps.join(linked, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
