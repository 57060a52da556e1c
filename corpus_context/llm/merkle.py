"""13. Merkle manifest: a content-addressed store of digest-to-children records, and proofs by descent.

Rows become leaf digests in the scan. Leaves are ranked within their source by a range-partitioned sort (a
row's place in its task plus the sizes of the tasks before it), so a source of any size is spread over many
tasks. Trees grow bottom up in blocks of 3^7 neighbours, each block one bounded row; every inner node leaves
a record (height, digest, children). The roots of the sources are the leaves of one more tree of the same kind.

A proof is read from the store alone: a request starts at the root and, digit by digit of its rank in base 3, joins
the record of its current digest, goes on with the child that the digit selects and collects the others. Requests
with the same digits so far share one row. At the leaf, the collected path segments are reversed.

Digests are lowercase hex SHA-256; a node is the digest of its children's hex digests, concatenated.

Defined cases: null fields count as ``-``; a null source is a source of its own, before the others; null ids come first
in their source; rows of equal id are ordered by their leaf digest, fully equal rows are leaves each (their records
coincide); a lone leaf is its source's root and a lone source's root is the root; an empty table has no rows and
no root. Extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_context.llm.common import BROADCAST_ROWS, cut_lineage

RUN = 3
#: Levels that one block of neighbours (RUN ** BLOCK_LEVELS nodes) grows in one task.
BLOCK_LEVELS = 7
#: Records of a height that may be broadcast (about 300 bytes each); more are joined by a shuffle.
BROADCAST_RECORDS = 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "array<struct<left:string,right:string>>"


def _digest(c: Column) -> Column:
    return F.sha2(c, 256)


def _field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return _digest(F.concat(*map(_field, fields)))


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, from 0, in the order of ``order`` within ``group``; a group's rows must be neighbours in
    that order."""
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    return placed.join(runs, [group, "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_part", "_at", "_first", "_n", "_before")


def height_of(n: Column) -> Column:
    """Levels above ``n`` leaves: the least h with 3^h >= n."""
    return sum((F.when(n > RUN**k, 1).otherwise(0) for k in range(39)), F.lit(0))


def _parents(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(nodes) - 1).cast("int"), F.lit(RUN)),
                       lambda i: _digest(F.array_join(F.slice(nodes, i + 1, RUN), "")))


def grow(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, digest) and records (height, digest, children) of (tree, rank, digest, height), where height is the tree's."""
    spark, nodes, base, roots, records = leaves.sparkSession, leaves, 0, [], []
    while True:
        roots.append(nodes.where(F.col("height") <= base).select("tree", "digest"))
        nodes = nodes.where(F.col("height") > base)
        up = F.least(F.lit(BLOCK_LEVELS), F.col("height") - base).cast("int")
        blocks = nodes.groupBy("tree", "height", F.floor(F.col("rank") / RUN**BLOCK_LEVELS).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("row")).select(
            "tree", "height", "block", up.alias("up"), F.col("row.digest").alias("nodes"))
        start = F.struct(F.col("nodes").alias("now"), F.array(F.col("nodes")).alias("levels"))

        def level(a, _):
            return F.transform(F.array(a["now"]), _parents)[0]

        def step(a, i):
            above = level(a, i)
            return F.struct(above.alias("now"), F.concat(a["levels"], F.array(above)).alias("levels"))

        blocks = cut_lineage(blocks.withColumn("levels", F.aggregate(
            F.sequence(F.lit(1), F.col("up")), start, step)["levels"]).drop("nodes"))
        if blocks.isEmpty():
            break
        rows = blocks.select("levels", F.explode(F.sequence(F.lit(1), F.col("up"))).alias("l"))
        rows = rows.select("l", F.posexplode(F.col("levels")[F.col("l")]).alias("i", "digest"),
                           F.col("levels")[F.col("l") - 1].alias("below"))
        records.append(rows.select((F.col("l") + base).alias("height"), "digest",
                                   F.slice("below", F.col("i") * RUN + 1, F.lit(RUN)).alias("children")))
        nodes = blocks.select("tree", F.col("block").alias("rank"), F.col("levels")[F.col("up")][0].alias("digest"), "height")
        base += BLOCK_LEVELS
    none = spark.createDataFrame([], "height int, digest string, children array<string>")
    return cut_lineage(reduce(DataFrame.unionByName, roots)), cut_lineage(reduce(DataFrame.unionByName, records, none))


@dataclass
class Manifest:
    """rows: (tree, rank, the columns kept, leaf); sources: (tree, height, rank, digest of the source's root);
    records: (kind, height, digest, children), kind 0 within sources and 1 above them; root: its digest or None."""

    rows: DataFrame
    sources: DataFrame
    records: DataFrame
    root: str | None


def build(docs: DataFrame, fields=FIELDS, source: str = "source", id_col: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``keep`` names further values of a row to hold beside its leaf."""
    q = lambda c: F.col(f"`{c}`")
    rows = cut_lineage(docs.select(
        q(id_col).alias("id"), q(source).cast("string").alias("source"), _field(q(source)).alias("tree_key"),
        leaf_digest([q(c) for c in fields]).alias("leaf"), F.monotonically_increasing_id().alias("tie"),
        *[c.alias(n) for n, c in (keep or {}).items()]))
    rows = ranked(rows, "tree_key", [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("tie")])
    sources = rows.groupBy("tree_key", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    sources = cut_lineage(ranked(cut_lineage(sources), "all", [F.col("source").asc_nulls_first()]).select(
        "tree_key", F.col("rank").alias("tree"), height_of(F.col("n")).alias("height")))
    n_sources = sources.count()
    joined = F.broadcast(sources) if n_sources <= BROADCAST_ROWS else sources
    rows = cut_lineage(rows.join(joined, "tree_key").drop("tree_key", "source", "tie"))
    roots, records = grow(rows.select("tree", "rank", F.col("leaf").alias("digest"), "height"))
    sources = cut_lineage(sources.drop("tree_key").join(roots, "tree"))
    top = sources.select(F.lit(0).alias("tree"), F.col("tree").alias("rank"), "digest", height_of(F.lit(n_sources)).alias("height"))
    root, above = grow(top)
    found = root.first()
    store = cut_lineage(records.withColumn("kind", F.lit(0)).unionByName(above.withColumn("kind", F.lit(1))))
    return Manifest(rows, sources, store, found["digest"] if found else None)


def _descend(front: DataFrame, records: DataFrame, sizes: dict, kind: int, heights: range, prefixes, entering=None) -> DataFrame:
    """``front`` (tree, at, digest, path) taken down through the records of ``heights``; rows of ``entering`` join in at
    theirs; ``prefixes(h)`` holds the (tree, at) wanted at height h, or is None for all."""
    for h in heights:
        here = records.where((F.col("kind") == kind) & (F.col("height") == h)).groupBy("digest").agg(F.first("children").alias("children"))
        if sizes.get((kind, h), 0) <= BROADCAST_RECORDS:
            here = F.broadcast(here)
        children = front.join(here, "digest").select("tree", "at", "path", "children", F.posexplode("children").alias("digit", "child"))
        segment = F.struct(F.array_join(F.slice("children", F.lit(1), F.col("digit")), "").alias("left"),
                           F.array_join(F.slice("children", F.col("digit") + 2, F.lit(RUN)), "").alias("right"))
        front = children.select("tree", (F.col("at") * RUN + F.col("digit")).alias("at"), F.col("child").alias("digest"),
                                F.array_append("path", segment).alias("path"))
        if prefixes is not None:
            front = front.join(prefixes(h - 1), ["tree", "at"], "left_semi")
        if entering is not None:
            front = front.unionByName(entering.where(F.col("height") == h - 1).drop("height"))
    return front


def prove(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """m.rows, of (tree, rank) in ``requests`` (all if None), with ``path``: the siblings left and right, from the leaf up
    to the root, as read from the store by descent."""
    sizes = {(r["kind"], r["height"]): r["count"] for r in m.records.groupBy("kind", "height").count().collect()}  # one row a height
    top = max([h for k, h in sizes if k == 1], default=0)
    deep = max([h for k, h in sizes if k == 0], default=0)
    spark = m.rows.sparkSession
    wanted = top_wanted = None
    if requests is not None:
        asked = cut_lineage(requests.select("tree", "rank").distinct())
        wanted = lambda h: asked.select("tree", F.floor(F.col("rank") / RUN**h).alias("at")).distinct()
        top_wanted = lambda h: asked.select(F.lit(0).alias("tree"), F.floor(F.col("tree") / RUN**h).alias("at")).distinct()
    start = spark.range(0 if m.root is None else 1).select(
        F.lit(0).alias("tree"), F.lit(0).cast("long").alias("at"), F.lit(m.root).alias("digest"), F.array().cast(_NODE).alias("path"))
    subroots = cut_lineage(_descend(start, m.records, sizes, 1, range(top, 0, -1), top_wanted))
    entering = m.sources.select("tree", "height").join(
        subroots.select(F.col("at").alias("tree"), "digest", "path"), "tree").select(
        "tree", F.lit(0).cast("long").alias("at"), "digest", "path", "height")
    front = entering.where(F.col("height") == deep).drop("height")
    front = _descend(front, m.records, sizes, 0, range(deep, 1, -1), wanted, entering)
    if deep:  # the last step is taken by whole runs, so that the long paths move once per run
        lowest = entering.where(F.col("height") == 0).drop("height")
        here = m.records.where("kind = 0 and height = 1").groupBy("digest").agg(F.first("children").alias("children"))
        if sizes[0, 1] <= BROADCAST_RECORDS:
            here = F.broadcast(here)
        front = front.join(here, "digest").select("tree", "at", "path", "children").unionByName(
            lowest.select("tree", "at", "path", F.array("digest").alias("children")))
        lone = F.col("height") == 0
    else:
        front = front.select("tree", "at", "path", F.array("digest").alias("children"))
        lone = F.lit(True)
    rows = m.rows
    if requests is not None:
        rows = rows.join(asked, ["tree", "rank"], "left_semi")
    names = [c for c in rows.columns if c not in ("tree", "height")]
    runs = rows.groupBy("tree", F.floor(F.col("rank") / RUN).alias("at")).agg(
        F.collect_list(F.struct(*names)).alias("run"), F.first("height").alias("height"))
    out = front.join(runs, ["tree", "at"]).select("tree", "height", "path", "children", F.explode("run").alias("r"))
    digit = (F.col("r.rank") % RUN).cast("int")
    last = F.struct(F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"),
                    F.array_join(F.slice("children", digit + 2, F.lit(RUN)), "").alias("right"))
    path = F.when(lone, F.col("path")).otherwise(F.array_append("path", last))
    return out.select("tree", "r.*", F.reverse(path).alias("path"))


def proof_digest(path: Column) -> Column:
    return _digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on ``path`` lead to."""
    return F.aggregate(path, leaf, lambda a, s: _digest(F.concat(s["left"], a, s["right"])))


def verify(docs: DataFrame) -> DataFrame:
    """Every row's proof, checked against the root after the row was tampered with: where 2 divides crc32 of the decimal
    id, the line ends of its text are deleted (a null id or text stays)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    changed = leaf_digest([text if c == "text" else F.col(f"`{c}`") for c in FIELDS])
    m = build(docs.select(*FIELDS), keep={"changed": changed})
    subroots = m.sources.select("tree", F.col("digest").alias("subroot"))
    if subroots.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        subroots = F.broadcast(subroots)
    return prove(m).join(subroots, "tree").select(
        F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(m.root).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
