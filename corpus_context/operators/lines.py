"""The texts of R6, R7 and R10 as ordered rows, for contexts of any size.

Each operator gives (context_id, ord, ...) with ``ord`` from 0 without gaps; the rows of a context joined in that order are
the text that ``render_tree``, ``render_tree_flat`` and ``build_context_panel`` build. Rows get their place from one
range-partitioned sort (``pack.ranked``), so a context, or a folder, that holds most of the files is spread over many
tasks. The last child of a folder is found by a partial aggregate per folder and joined back by its own name, which is unique,
not by the folder's.

An empty table of files gives the heads alone; repeated paths count once in the trees and are parts of their own, in
no fixed order, in the panel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.functions import text as X
from corpus_context.operators.pack import ranked, tree_nodes


def _below_heads(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """The head of every context at place 0, its lines from 1."""
    return heads.select("context_id", F.lit(0).cast("long").alias("ord"), "line").unionByName(
        lines.select("context_id", (F.col("rank") + 1).alias("ord"), "line"))


def _with_last(rows: DataFrame, folder: str, order: list[str], own: str) -> DataFrame:
    """``rows`` with ``is_last``: the greatest by ``order`` in its ``folder``; ``own`` names a row in its context."""
    last = rows.groupBy("context_id", folder).agg(F.max(F.struct(*order, own))[own].alias(own))
    last = last.select("context_id", own, F.lit(True).alias("is_last"))
    return rows.join(last, ["context_id", own], "left").withColumn("is_last", F.coalesce("is_last", F.lit(False)))


def tree_lines(sel: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context_id, ord, line). sel(context_id, rel), contexts(context_id, root)."""
    n = _with_last(tree_nodes(sel), "parent", ["is_dir", "name"], "node")
    line = F.concat(F.repeat(F.lit(" "), (F.col("d") - 1) * 4), F.when(F.col("is_last"), "└── ").otherwise("├── "),
                    F.col("name"), F.when(F.col("is_dir"), "/").otherwise(""))
    heads = contexts.select("context_id", F.concat(P.basename("root"), F.lit("/")).alias("line"))
    return _below_heads(heads, ranked(n.select("context_id", "key", line.alias("line")), ["key"]))


def tree_flat_lines(sel: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context_id, ord, line). sel(context_id, rel), contexts(context_id, root)."""
    files = sel.select("context_id", "rel", P.dirname("rel").alias("dir"), P.basename("rel").alias("name")).distinct()
    files = _with_last(files, "dir", ["name"], "rel").select(
        "context_id", "dir", F.lit(1).alias("below"), "name",
        F.concat(F.when(F.col("is_last"), "│   └── ").otherwise("│   ├── "), F.col("name")).alias("line"))
    dirs = files.select("context_id", "dir").distinct().select(
        "context_id", "dir", F.lit(0).alias("below"), F.lit("").alias("name"),
        F.concat(F.lit("├── "), F.when(F.col("dir") == "", "(root)").otherwise(F.concat("dir", F.lit("/")))).alias("line"))
    heads = contexts.select("context_id", F.concat(F.lit("Project: "), P.basename("root")).alias("line"))
    return _below_heads(heads, ranked(dirs.unionByName(files), ["dir", "below", "name"]))


def panel_parts(sel_files: DataFrame, item_tokens: DataFrame | None = None, style: str = "panel") -> DataFrame:
    """(context_id, ord, rel, tokens, part), a row per file in path order.

    sel_files(context_id, rel, path, size, text[, error]); a null text is a file that could not be read, for the reason in
    ``error`` if there is one. item_tokens(path, token_count): a file that is not in it counts 0. ``style``: 'panel' (B14
    placeholder, R2 escape, parts joined by nothing) or 'lines' (the text as it is, parts joined by a newline; an unreadable
    file is one line and counts 0). Only (context, path, tokens) is sorted; the texts are joined last."""
    error = F.coalesce(F.col("error"), F.lit("")) if "error" in sel_files.columns else F.lit("")
    if style == "panel":
        body = F.coalesce(R.oversize_placeholder("size", "text"), F.concat(F.lit("[Error reading file: "), error, F.lit("]")))
        part = X.render_part("rel", body, style="panel")
        counts = F.lit(True)
    elif style == "lines":
        part = F.when(F.col("text").isNotNull(), X.render_part("rel", "text", style="lines")).otherwise(
            F.concat(F.lit("[Error reading "), F.col("rel"), F.lit(": "), error, F.lit("]\n")))
        counts = F.col("text").isNotNull()
    else:
        raise ValueError(style)
    places = ranked(sel_files.select("context_id", "path").distinct(), ["path"])
    if item_tokens is None:
        places = places.withColumn("token_count", F.lit(0).cast("long"))
    else:
        places = places.join(item_tokens.select("path", "token_count"), "path", "left")
    x = sel_files.select("context_id", "path", "rel", counts.alias("_counts"), part.alias("part"))
    return x.join(places, ["context_id", "path"]).select(
        "context_id", F.col("rank").alias("ord"), "rel",
        F.when(F.col("_counts"), F.coalesce("token_count", F.lit(0))).otherwise(0).cast("long").alias("tokens"), "part")
