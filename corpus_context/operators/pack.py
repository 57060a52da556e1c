"""Packing: file tree text (R6/R7), next-fit chunking (W4/W5), context assembly (R8-R10),
chunk checks (G6-G8) and the running totals of W2.

Next-fit is sequential inside one context; the plan keeps text out of it:

1. ``parts(context_id, rank, t)`` -- no text, ~20 bytes per file, ranked by one range-partitioned sort;
2. next-fit by blocks of ranks (operators/nextfit.py) gives every chunk's (lo, hi) rank range, for contexts of any size;
3. the range is exploded back to one row per file and equi-joined with the parts -- no range join, no second window;
4. text is joined in last and concatenated per (context, chunk): each group
   is bounded by the chunk limit (a single oversize file excepted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.functions import text as X
from corpus_context.functions import tokens as TK
from corpus_context.operators.nextfit import BLOCK, block_offsets, chunk_ranges
from corpus_context.session import cut_lineage

PACKER_LIMIT = 600_000
XML_LIMIT = 500_000


# ---------------------------------------------------------------------------
# file tree
# ---------------------------------------------------------------------------

def tree_nodes(sel: DataFrame) -> DataFrame:
    """sel(context_id, rel) -> one row per tree node (files and the folders above them).

    key = array of (is_dir, name) along the path: sorting by it gives the tree
    order (a parent first, then files before folders, then by name).
    """
    s = sel.select("context_id", F.split("rel", "/").alias("c")).distinct()
    nodes = s.select("context_id", "c", F.explode(F.sequence(F.lit(1), F.size("c"))).alias("d"))
    nodes = nodes.select(
        "context_id", "d",
        F.array_join(F.slice("c", 1, F.col("d")), "/").alias("node"),
        F.element_at("c", F.col("d")).alias("name"),
        (F.col("d") < F.size("c")).alias("is_dir"),
    )
    # a node can be a folder for one path and the end of another: keep one row, folder wins
    nodes = nodes.groupBy("context_id", "node").agg(
        F.max("is_dir").alias("is_dir"), F.first("name").alias("name"), F.first("d").alias("d"))
    nodes = nodes.withColumn("parent", F.when(F.col("d") > 1, P.dirname("node")).otherwise(F.lit("")))
    comps = F.split("node", "/")
    return nodes.withColumn("key", F.transform(comps, lambda x, i: F.struct(
        ((i + 1 < F.col("d")) | F.col("is_dir")).alias("is_dir"), x.alias("name"))))


def render_tree(sel: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per context the tree text: '{root name}/' then one line per node.

    contexts(context_id, root). Siblings: files before folders, then by name;
    4 spaces per level, '└── ' for the last sibling, '├── ' otherwise; folders end in '/'.
    The lines are built and ordered in parallel; only the final ordered
    concatenation is per context (its size is that of the tree text itself).
    """
    n = tree_nodes(sel)
    w = Window.partitionBy("context_id", "parent").orderBy("is_dir", "name")
    n = n.withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    line = F.concat(F.repeat(F.lit(" "), (F.col("d") - 1) * 4),
                    F.when(F.col("is_last"), F.lit("└── ")).otherwise(F.lit("├── ")),
                    F.col("name"), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))
    lines = n.groupBy("context_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("key"), line.alias("line")))).alias("ls"))
    lines = lines.select("context_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("body"))
    c = contexts.select("context_id", F.concat(P.basename("root"), F.lit("/")).alias("head"))
    out = c.join(lines, "context_id", "left")
    return out.select("context_id", F.when(F.col("body").isNull() | (F.col("body") == ""), F.col("head"))
                      .otherwise(F.concat(F.col("head"), F.lit("\n"), F.col("body"))).alias("tree"),
                      F.col("body").isNotNull().alias("has_sel"))


def render_tree_flat(sel: DataFrame, contexts: DataFrame) -> DataFrame:
    """R7: 'Project: {name}', then per folder '├── {dir}/' ('├── (root)' for the root) and its files
    as '│   ├── ' / '│   └── ' (last)."""
    s = sel.select("context_id", "rel", P.dirname("rel").alias("dir"), P.basename("rel").alias("name")).distinct()
    w = Window.partitionBy("context_id", "dir").orderBy("name")
    s = s.withColumn("is_last", F.lead(F.lit(1)).over(w).isNull())
    fl = F.concat(F.when(F.col("is_last"), F.lit("│   └── ")).otherwise(F.lit("│   ├── ")), F.col("name"))
    per_dir = s.groupBy("context_id", "dir").agg(F.array_sort(F.collect_list(F.struct("name", fl.alias("l")))).alias("fs"))
    per_dir = per_dir.select("context_id", "dir", F.concat_ws(
        "\n", F.concat(F.lit("├── "), F.when(F.col("dir") == "", F.lit("(root)")).otherwise(F.concat("dir", F.lit("/")))),
        F.array_join(F.transform("fs", lambda x: x["l"]), "\n")).alias("block"))
    body = per_dir.groupBy("context_id").agg(F.array_sort(F.collect_list(F.struct("dir", "block"))).alias("bs"))
    body = body.select("context_id", F.array_join(F.transform("bs", lambda x: x["block"]), "\n").alias("body"))
    c = contexts.select("context_id", F.concat(F.lit("Project: "), P.basename("root")).alias("head"))
    return c.join(body, "context_id", "left").select(
        "context_id", F.concat_ws("\n", "head", "body").alias("tree"))


# ---------------------------------------------------------------------------
# next-fit (W4, W5)
# ---------------------------------------------------------------------------

def assign_chunks(parts: DataFrame, limit: int, header: Column | int = 0, guard: bool = True,
                  block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(parts with chunk_no, chunk table (context_id, chunk_no, h, lo, hi)).

    The parts (no text: a few small columns per file) are read by the chunking and by the final join, so they are
    computed once into the checkpoint folder."""
    parts = cut_lineage(parts)
    ranges = chunk_ranges(parts, limit, header, guard, block)
    return parts.join(files_of(ranges), ["context_id", "rank"]), ranges


def files_of(ranges: DataFrame) -> DataFrame:
    """(context_id, chunk_no, rank) of the files in the chunks' ranges."""
    return ranges.where("hi >= lo").select("context_id", "chunk_no", F.explode(F.sequence("lo", "hi")).alias("rank"))


def ranked(parts: DataFrame, order_cols, keys=("context_id",), written: bool = False) -> DataFrame:
    """``parts`` with their 0-based rank per key in ``order_cols`` order.

    One range-partitioned sort on (key, order); a row's rank is its place in its task, less that of its key's first row
    there, plus the key's rows in the tasks before (a table of a row per key and task). No window spans a key.
    The sort samples its input first, so that is written unless it is a ``written`` table already."""
    keys = list(keys)
    x = (parts if written else cut_lineage(parts)).repartitionByRange(*keys, *order_cols).sortWithinPartitions(*keys, *order_cols)
    x = cut_lineage(x.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")))
    runs = x.groupBy(*keys, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return x.join(runs, [*keys, "_task"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_task", "_at", "_first", "_n", "_before")


# ---------------------------------------------------------------------------
# contexts (R8, R9, R10)
# ---------------------------------------------------------------------------

def packable(parts: DataFrame) -> DataFrame:
    """B9 (packer) / B10 / B11: drop known binaries, NUL-heavy and empty texts."""
    return parts.where(~R.binary_suffix("path", "packer")).where(~R.too_many_nuls("text")).where(R.non_empty("text"))


def build_context(sel_files: DataFrame, contexts: DataFrame, estimator="chars4", limit: int = PACKER_LIMIT,
                  with_text: bool = True) -> DataFrame:
    """The flagship. Selected files -> token-bounded chunks with header, tree and fenced files.

    sel_files(context_id, rel, path, text): the selected files that exist, text
    decoded in text mode. contexts(context_id, root, prompt): one row per context;
    a context without selected files yields one row 'No files selected'.
    Output: chunks(context_id, chunk_no, tokens, chars, n_files[, text]).

    The texts are read twice, for their tokens and, in the end, for the chunks; only (context, rel, tokens) is ranked,
    packed and written in between.
    """
    est = TK.estimator(estimator)
    ok = ~R.binary_suffix("path", "packer") & ~R.too_many_nuls("text") & R.non_empty("text")
    size = est("text") + est(F.concat(X.part_header("rel"), F.lit(X.PART_FOOTER)))
    listed = cut_lineage(sel_files.select("context_id", "rel", F.when(ok, size).cast("long").alias("t")))
    tree = render_tree(listed.select("context_id", "rel"), contexts)
    hdr = contexts.join(tree, "context_id").where(F.col("has_sel")).select(
        "context_id", X.render_header("prompt", "tree").alias("header"))
    hdr = cut_lineage(hdr.withColumn("h", est("header").cast("long")))

    parts = cut_lineage(ranked(listed.where("t is not null"), ["rel"], written=True).join(hdr.select("context_id", "h"), "context_id"))
    ranges = chunk_ranges(parts, limit, F.col("h"), guard=True)
    # contexts with a selection but no packable file still give their header chunk
    empty_ctx = hdr.join(ranges.select("context_id").distinct(), "context_id", "left_anti")
    ranges = cut_lineage(ranges.unionByName(empty_ctx.select(
        "context_id", "h", F.lit(1).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"))))
    last = ranges.groupBy("context_id").agg(F.max("chunk_no").alias("last_no"))

    files_in = parts.select("context_id", "rel", "rank", "t").join(files_of(ranges), ["context_id", "rank"])
    if with_text:
        files_in = sel_files.select("context_id", "rel", "text").join(files_in, ["context_id", "rel"])
    per_chunk = files_in.groupBy("context_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("t").alias("ft"),
        *([F.array_sort(F.collect_list(F.struct("rank", X.render_part("rel", "text").alias("p")))).alias("ps")] if with_text else []))
    ch = ranges.select("context_id", "chunk_no", "h").join(per_chunk, ["context_id", "chunk_no"], "left").join(last, "context_id")
    ch = ch.select("context_id", F.col("chunk_no").cast("int").alias("chunk_no"), (F.col("h") + F.coalesce("ft", F.lit(0))).cast("long").alias("tokens"),
                   F.coalesce("ft", F.lit(0)).cast("long").alias("file_tokens"),
                   F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
                   *(["ps"] if with_text else []), (F.col("chunk_no") == F.col("last_no")).alias("is_last"))
    if with_text:
        body = F.coalesce(F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit(""))
        ch = ch.join(hdr.select("context_id", "header"), "context_id").withColumn(
            "text", F.concat("header", body, F.when(F.col("is_last"), F.lit("\n")).otherwise(F.lit(""))))
        ch = ch.withColumn("chars", F.char_length("text").cast("long")).drop("ps", "header")
    none = contexts.select("context_id").join(hdr.select("context_id"), "context_id", "left_anti").select(
        "context_id", F.lit(1).alias("chunk_no"), F.lit(0).cast("long").alias("tokens"),
        F.lit(0).cast("long").alias("file_tokens"), F.lit(0).cast("long").alias("n_files"),
        F.lit(True).alias("is_last"),
        *([F.lit("No files selected").alias("text"), F.lit(17).cast("long").alias("chars")] if with_text else []))
    return ch.unionByName(none)


def build_context_xml(paths: DataFrame, mode: str = "xml", limit: int = XML_LIMIT) -> DataFrame:
    """B9 (xml) -> R1 -> R3 (xml or markdown) -> T2 -> W5 (characters, order as given).

    paths(context_id, ord, path, text), ord unique in its context. file_count counts every input, skipped ones too.
    Output per chunk: (context_id, chunk_no, chars, n_files, text); per context totals via G6.
    """
    total = paths.groupBy("context_id").agg(F.count(F.lit(1)).alias("file_count"))
    ok = paths.where(~R.binary_suffix("path", "xml")).select(
        "context_id", "ord", X.render_part("path", X.strip_nuls("text"), style=mode, path="path").alias("part"))
    sizes = ok.select("context_id", "ord", F.char_length("part").cast("long").alias("t"))
    assigned, ranges = assign_chunks(ranked(sizes, ["ord"]), limit, 0, guard=False)
    files_in = ok.join(assigned, ["context_id", "ord"])  # the texts come back last
    per_chunk = files_in.groupBy("context_id", "chunk_no").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("t").alias("chars"),
        F.sum(F.floor(F.col("t") / 4)).cast("long").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("ps"))
    ch = ranges.select("context_id", "chunk_no").join(per_chunk, ["context_id", "chunk_no"], "left").select(
        "context_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"),
        F.coalesce("chars", F.lit(0)).cast("long").alias("chars"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.array_join(F.transform("ps", lambda x: x["part"]), ""), F.lit("")).alias("text"))
    return ch.join(total, "context_id")


def build_context_panel(sel_files: DataFrame, item_tokens: DataFrame | None = None) -> DataFrame:
    """Sorted by path; B14 placeholder, R2 fence escape, R3 'panel' parts; one text per context.

    sel_files(context_id, rel, path, size, text). Tokens come from the item table when given.
    """
    p = sel_files.withColumn("body", R.oversize_placeholder("size", "text"))
    p = p.withColumn("part", X.render_part("rel", "body", style="panel"))
    if item_tokens is not None:
        p = p.join(item_tokens.select("path", F.col("token_count").alias("tk")), "path", "left")
    else:
        p = p.withColumn("tk", F.lit(None).cast("long"))
    g = p.groupBy("context_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "part"))).alias("ps"),
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum(F.coalesce("tk", F.lit(0))), F.lit(0)).cast("long").alias("tokens"))
    return g.select("context_id", "n_files", "tokens",
                    F.array_join(F.transform("ps", lambda x: x["part"]), "").alias("text"))


# ---------------------------------------------------------------------------
# checks and totals
# ---------------------------------------------------------------------------

def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunk count, per-chunk tokens in order, total tokens (headers excluded), total characters."""
    return chunks.groupBy("context_id").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "tokens"))),
                                 lambda x: x["tokens"].cast("string")), ",").alias("chunk_tokens"),
        F.sum("file_tokens").cast("long").alias("total_tokens"),
        F.sum("chars").cast("long").alias("total_chars"),
        F.sum("n_files").cast("long").alias("n_files"))


def fence_check(chunks: DataFrame) -> DataFrame:
    """Triple-backtick markers per context; expected 2 per packed file."""
    g = chunks.groupBy("context_id").agg(
        F.sum(F.regexp_count("text", F.lit("```"))).cast("long").alias("fences"),
        F.sum("n_files").cast("long").alias("n_files"))
    return g.withColumn("expected", 2 * F.col("n_files")).withColumn("ok", F.col("fences") == F.col("expected"))


def conservation_check(chunks: DataFrame, parts: DataFrame, overhead: DataFrame | None = None) -> DataFrame:
    """Characters out = characters in (parts plus per-chunk overhead)."""
    out = chunks.groupBy("context_id").agg(F.sum("chars").cast("long").alias("chars_out"))
    inn = parts.groupBy("context_id").agg(F.sum(F.char_length("part")).cast("long").alias("chars_in"))
    j = out.join(inn, "context_id", "full")
    if overhead is not None:
        j = j.join(overhead, "context_id", "left")
    else:
        j = j.withColumn("overhead", F.lit(0))
    return j.select("context_id", F.coalesce("chars_out", F.lit(0)).alias("chars_out"),
                    F.coalesce("chars_in", F.lit(0)).alias("chars_in"),
                    (F.coalesce("chars_out", F.lit(0)) == F.coalesce("chars_in", F.lit(0)) + F.coalesce("overhead", F.lit(0))).alias("ok"))


def running_tokens(parts: DataFrame) -> DataFrame:
    """Running total of tokens and the percent done, in path order.

    parts(context_id, path, size, t, counted). Percent = processed bytes / total bytes
    when <= 300 files and total > 0, else i / n (i = files before this one), truncated.
    Skipped files add to the byte total, never to the processed bytes. The two running sums are blocked prefix sums (every
    window is bounded by a block of ranks)."""
    r = ranked(parts, ["path"])
    r = cut_lineage(r.withColumn("ct", F.when(F.col("counted"), F.col("t")).otherwise(F.lit(0)).cast("long")).withColumn(
        "cb", F.when(F.col("counted"), F.col("size")).otherwise(F.lit(0)).cast("long")).withColumn("blk", F.floor(F.col("rank") / BLOCK)))
    bs = block_offsets(r, ["context_id"], {"t": "ct", "b": "cb"}).drop("t_sum", "b_sum")
    tot = r.groupBy("context_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_bytes"))
    wl = Window.partitionBy("context_id", "blk").orderBy("rank")
    x = r.join(bs, ["context_id", "blk"]).join(tot, "context_id").select(
        "context_id", "path", "n", "total_bytes", F.col("rank").alias("i"),
        (F.col("t_off") + F.sum("ct").over(wl.rowsBetween(Window.unboundedPreceding, 0))).cast("long").alias("running_tokens"),
        (F.col("b_off") + F.coalesce(F.sum("cb").over(wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("processed_bytes"))
    pct = F.when((F.col("n") <= 300) & (F.col("total_bytes") > 0),
                 F.floor(F.col("processed_bytes") * 100 / F.col("total_bytes"))).otherwise(F.floor(F.col("i") * 100 / F.col("n")))
    return x.select("context_id", "path", "running_tokens", pct.cast("int").alias("percent"))


def blocked_running_sum(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` per key in rank order (dense 0-based ranks), by
    blocks: block sums, per-key offsets over the small block table, a window inside each block."""
    keys = list(keys)
    d = df.withColumn("blk", F.floor(F.col("rank") / BLOCK))
    bs = block_offsets(d, keys, {"_v": value}).drop("_v_sum")
    wl = Window.partitionBy(*keys, "blk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return d.join(bs, [*keys, "blk"]).withColumn(out, F.col("_v_off") + F.sum(value).over(wl)).drop("blk", "_v_off")
