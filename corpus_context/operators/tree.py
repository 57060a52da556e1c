"""Folder-tree operators. There is no tree object: a file's ancestors are
exploded into rows and every tree algorithm becomes a groupBy or join on the
directory column (partial + final hash aggregation, no recursion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_context.functions import paths as P


def _file_rows(items: DataFrame) -> DataFrame:
    return items.where(~F.col("is_dir"))


def _ancestor_rows(df: DataFrame, *cols: str) -> DataFrame:
    """One row per (file, ancestor dir incl. root) carrying ``cols``."""
    return df.select("root", F.explode(P.ancestors("path", "root")).alias("dir"), *cols)


def _dir_rows(items: DataFrame) -> DataFrame:
    """Every directory of the items (the roots included)."""
    d = items.where(F.col("is_dir")).select("root", F.col("path").alias("dir"))
    r = items.select("root", F.col("root").alias("dir"))
    return d.unionByName(r)


def folder_tokens(items: DataFrame) -> DataFrame:
    """G1: per directory (root included) the sum of tokens of all files below; counts <= 0 ignored."""
    t = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(F.lit(0)).alias("t")
    up = _ancestor_rows(_file_rows(items).select("root", "path", t), "t")
    dirs = _dir_rows(items).withColumn("t", F.lit(0).cast("long"))
    return up.unionByName(dirs).groupBy("root", "dir").agg(F.sum("t").cast("long").alias("tokens"))


def mark_selected(items: DataFrame, sel: DataFrame) -> DataFrame:
    """Flag file rows whose (root, path) is in ``sel`` (absolute paths)."""
    s = sel.select("root", "path").distinct().withColumn("_sel", F.lit(True))
    return items.join(s, ["root", "path"], "left").withColumn("selected", F.coalesce("_sel", F.lit(False))).drop("_sel")


def folder_selected_tokens(items: DataFrame, sel: DataFrame) -> DataFrame:
    """Per directory 'selected / total' tokens and its display text."""
    f = mark_selected(_file_rows(items), sel)
    t = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(F.lit(0))
    up = _ancestor_rows(f.select("root", "path", t.alias("t"), F.when(F.col("selected"), t).otherwise(0).alias("s")), "t", "s")
    dirs = _dir_rows(items).select("root", "dir", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("s"))
    g = up.unionByName(dirs).groupBy("root", "dir").agg(
        F.sum("s").cast("long").alias("selected_tokens"), F.sum("t").cast("long").alias("total_tokens"))
    return g.withColumn("label", F.concat(F.format_number("selected_tokens", 0), F.lit(" / "),
                                          F.format_number("total_tokens", 0), F.lit(" tokens")))


def selection_total(items: DataFrame, sel: DataFrame) -> DataFrame:
    """Total tokens of the selected files per root (directories ignored)."""
    f = _file_rows(items).join(sel.select("root", "path").distinct(), ["root", "path"], "left_semi")
    return f.groupBy("root").agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.coalesce(F.sum(F.when(F.col("token_count") > 0, F.col("token_count"))), F.lit(0)).cast("long").alias("selected_tokens"))


def empty_dirs(items: DataFrame) -> DataFrame:
    """Directories with nothing below them (possible in hand-built or event-updated items)."""
    d = items.where(F.col("is_dir")).select("root", F.col("path").alias("dir"))
    parents = items.where(F.col("path") != F.col("root")).select("root", P.dirname("path").alias("dir")).distinct()
    return d.join(parents, ["root", "dir"], "left_anti")


def folder_state(items: DataFrame, sel: DataFrame, mode: str = "tri") -> DataFrame:
    """Checked / partial / unchecked per directory.

    tri: checked if every leaf below is checked, unchecked if none, else partial
    (an empty directory is an unchecked leaf). any: checked if at least one is.
    """
    files = mark_selected(_file_rows(items), sel).select("root", "path", F.col("selected").cast("int").alias("c"))
    leaves = files.unionByName(empty_dirs(items).select("root", F.col("dir").alias("path"), F.lit(0).alias("c")))
    up = _ancestor_rows(leaves, "c")
    own_empty = empty_dirs(items).select("root", "dir", F.lit(0).alias("c"))
    g = up.unionByName(own_empty).groupBy("root", "dir").agg(F.count(F.lit(1)).alias("n_leaves"), F.sum("c").alias("n_checked"))
    if mode == "tri":
        st = (F.when(F.col("n_checked") == F.col("n_leaves"), "checked")
              .when(F.col("n_checked") == 0, "unchecked").otherwise("partial"))
    else:
        st = F.when(F.col("n_checked") > 0, "checked").otherwise("unchecked")
    return g.select("root", "dir", F.col("n_leaves").cast("long"), F.col("n_checked").cast("long"), st.alias("state"))


def sort_items(items: DataFrame) -> DataFrame:
    """Directories first, then by path (a distributed range sort)."""
    return items.orderBy(F.col("is_dir").desc(), F.col("path"))


def rank_position(items: DataFrame) -> DataFrame:
    """Position among siblings (files first, then by name) and the is_last flag."""
    from corpus_context.operators.pack import ranked

    x = items.where(F.col("path") != F.col("root")).select(
        "root", "path", P.dirname("path").alias("parent"), "is_dir", P.basename("path").alias("name"))
    r = ranked(x, ["is_dir", "name"], keys=("root", "parent"))
    n = r.groupBy("root", "parent").agg(F.count(F.lit(1)).alias("_n"))
    return r.join(n, ["root", "parent"]).select(
        "root", "path", "parent", "is_dir", "name", (F.col("rank") + 1).cast("int").alias("position"),
        (F.col("rank") + 1 == F.col("_n")).alias("is_last"))


def restore_selection(sel: DataFrame, items: DataFrame) -> DataFrame:
    """Selected paths that exist as files; unknown paths and directories dropped."""
    return sel.join(_file_rows(items).select("root", "path"), ["root", "path"], "left_semi")


def toggle_paths(items: DataFrame, sel: DataFrame, toggles: DataFrame) -> DataFrame:
    """Selected files (root, path) after the paths of ``toggles(root, path)`` were toggled at once.

    A file flips. A folder that is checked (G4) unchecks all files below it, any other folder checks them.
    Every toggle sees the state before; under several toggled folders the deepest decides, and a file's own
    toggle goes before those of its folders. Unknown paths do nothing; toggles in turn are calls in turn."""
    files = mark_selected(_file_rows(items), sel).select("root", "path", "selected")
    toggles = toggles.select("root", "path").distinct()
    of_files = files.join(toggles, ["root", "path"], "left_semi").select("root", F.col("path").alias("up"), (~F.col("selected")).alias("to"))
    of_dirs = folder_state(items, sel).join(toggles.withColumnRenamed("path", "dir"), ["root", "dir"], "left_semi").select(
        "root", F.col("dir").alias("up"), (F.col("state") != "checked").alias("to"))
    chain = files.select("root", "path", F.explode(F.array_union(P.ancestors("path", "root"), F.array("path"))).alias("up"))
    decided = chain.join(of_files.unionByName(of_dirs), ["root", "up"]).groupBy("root", "path").agg(
        F.max_by("to", F.length("up")).alias("to"))
    return files.join(decided, ["root", "path"], "left").where(F.coalesce("to", "selected")).select("root", "path")


def items_from_paths(paths: DataFrame) -> DataFrame:
    """Items from remembered relative paths only: root row, each path (P7), all parents; no duplicates.

    paths(root, rel). '.' is skipped.
    """
    r = F.col("root")
    ab = paths.where(F.col("rel") != ".").select(
        P.normalize_path("root").alias("root"),
        P.to_absolute("rel", "root").alias("path"))
    own = ab.select("root", "path", P.guess_is_dir("path").alias("is_dir"))
    par = ab.select("root", F.explode(P.ancestors("path", "root")).alias("path")).where(F.col("path") != r).select(
        "root", "path", F.lit(True).alias("is_dir"))
    roots = ab.select("root", F.col("root").alias("path"), F.lit(True).alias("is_dir"))
    allp = roots.unionByName(own).unionByName(par)
    # a path listed itself keeps its own guess over the parent rule; the root stays a directory
    pr = F.when(F.col("path") == F.col("root"), 0).when(~F.col("is_dir"), 1).otherwise(2)
    out = allp.groupBy("root", "path").agg(F.min_by("is_dir", pr).alias("is_dir"))
    return out.select("root", "path", "is_dir", F.lit(True).alias("is_valid"), F.lit("").alias("reason"),
                      F.when(F.col("is_dir"), 0).otherwise(-1).cast("long").alias("token_count"))


def match_paths(paths: DataFrame, items: DataFrame, case_insensitive: bool = False) -> DataFrame:
    """Resolve remembered absolute paths to items: exact, then slash-normalised, then (option) case-folded.

    paths(root, path) -> (root, path, item_path, how).
    """
    it = items.select("root", F.col("path").alias("item_path"))
    exact = paths.join(it, (paths["root"] == it["root"]) & (paths["path"] == it["item_path"]), "inner").select(
        paths["root"], paths["path"], it["item_path"], F.lit("exact").alias("how"))
    rest = paths.join(exact.select("root", "path"), ["root", "path"], "left_anti")
    itn = items.select("root", F.col("path").alias("item_path"), F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("k"))
    restn = rest.withColumn("k", F.replace(F.col("path"), F.lit("\\"), F.lit("/")))
    norm = restn.join(itn, ["root", "k"]).select("root", "path", "item_path", F.lit("normalised").alias("how"))
    out = exact.unionByName(norm)
    if case_insensitive:
        rest2 = rest.join(norm.select("root", "path"), ["root", "path"], "left_anti").withColumn(
            "k", F.lower(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))))
        itl = itn.withColumn("k", F.lower("k"))
        out = out.unionByName(rest2.join(itl, ["root", "k"]).select("root", "path", "item_path", F.lit("case_folded").alias("how")))
    return out
