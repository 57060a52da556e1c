"""Scan operators: items table (A2), corpus token counts (T4), scan summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.functions import tokens as TK
from corpus_context.functions.text import read_text
from corpus_context.functions.util import array_of


def attach_settings(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Per-root scan settings (ignore list, include_subfolders) joined onto the files.

    One row per workspace: a small side, which AQE broadcasts when its measured size allows.
    """
    ws = workspaces.select(
        F.col("folder_path").alias("root"),
        F.coalesce(F.col("scan_settings.ignore_folders"), array_of(R.DEFAULT_IGNORE_FOLDERS)).alias("ignore"),
        F.coalesce(F.col("scan_settings.include_subfolders"), F.lit(True)).alias("include_subfolders"),
    ).dropDuplicates(["root"])
    return files.join(ws, "root", "left").withColumn(
        "ignore", F.coalesce("ignore", array_of(R.DEFAULT_IGNORE_FOLDERS))
    ).withColumn("include_subfolders", F.coalesce("include_subfolders", F.lit(True)))


def _ignore(files: DataFrame, ignore):
    if ignore is None:
        return F.col("ignore") if "ignore" in files.columns else array_of(R.DEFAULT_IGNORE_FOLDERS)
    return array_of(ignore)


def _kept(files: DataFrame, ignore) -> DataFrame:
    ig = _ignore(files, ignore)
    out = files.where(R.prune_ignored("path", "root", ig))
    if "include_subfolders" in files.columns:
        out = out.where(R.include_subfolders("path", "root", F.col("include_subfolders")))
    return out


def directories(files: DataFrame, ignore=None) -> DataFrame:
    """Non-root directories the walk would list: ancestors of the files whose own path is not pruned."""
    ig = _ignore(files, ignore)
    cols = ["root", "path"] + (["ignore"] if "ignore" in files.columns else [])
    d = files.select(*cols).select("root", F.explode(P.ancestors("path", "root")).alias("path"),
                                   *(["ignore"] if "ignore" in files.columns else []))
    d = d.where((F.col("path") != F.col("root")) & R.dir_pruned("path", "root", ig))
    return d.select("root", "path").distinct()


#: Reason of a file that is listed but whose content is missing (fixed value: the prefix).
READ_ERROR = "Error: the file cannot be read"


def list_items(files: DataFrame, ignore=None) -> DataFrame:
    """A2: one row per non-root directory plus one per kept file (no token counts yet)."""
    dirs = directories(files, ignore).select(
        "root", "path", F.lit(True).alias("is_dir"), F.lit(True).alias("is_valid"), F.lit("").alias("reason"),
        F.lit(0).cast("long").alias("token_count"), F.lit(None).cast("string").alias("strategy"))
    fl = _kept(files, ignore).select(
        "root", "path", F.lit(False).alias("is_dir"), F.lit(True).alias("is_valid"), F.lit("").alias("reason"),
        F.lit(-1).cast("long").alias("token_count"), R.token_strategy("path", "size").alias("strategy"))
    return dirs.unionByName(fl)


def corpus_tokens(files: DataFrame, estimator="chars4", ignore=None, max_bytes: int = R.READ_LIMIT,
                  two_pass: bool = False) -> DataFrame:
    """T4: the full scan result: strategy, validity, reason and token count per item.

    Table sources (parquet, one column chunk per column) are read once: each
    file row yields its own item and its ancestor folders, and one shuffle of
    these small rows (no text) removes duplicate folders. Decoding and counting
    sit behind the strategy test, so skipped files are never decoded.

    ``two_pass=True`` is for ``binaryFile`` sources: the skip branch projects
    (root, path, size) only and the counting branch filters ``size <= 50 KiB``
    before it touches ``content``; the filter is pushed into the listing, so
    large files are never read at all.

    A file to be counted whose content is null (it could not be read) keeps its row: invalid, READ_ERROR, 0 tokens.
    """
    if not two_pass:
        return _corpus_tokens_one_pass(files, estimator, ignore, max_bytes)
    est = TK.estimator(estimator)
    kept = _kept(files, ignore)
    strategy = R.token_strategy("path", "size")
    skipped = kept.where((F.col("size") > R.SKIP_LIMIT) | R.skip_pattern_reason("path").isNotNull()).select(
        "root", "path", F.lit(False).alias("is_dir"), F.lit(True).alias("is_valid"),
        R.skip_reason("path", "size").alias("reason"), F.lit(0).cast("long").alias("token_count"),
        F.lit("skip").alias("strategy"))
    counted = kept.where(F.col("size") <= R.SKIP_LIMIT).where(R.skip_pattern_reason("path").isNull())
    unread = F.col("text" if "text" in counted.columns else "content").isNull()
    counted = counted.select(
        "root", "path", F.lit(False).alias("is_dir"), (~unread).alias("is_valid"), F.when(unread, F.lit(READ_ERROR)).otherwise(F.lit("")).alias("reason"),
        F.coalesce(est(read_text(counted, max_bytes=max_bytes)), F.lit(0)).cast("long").alias("token_count"), strategy.alias("strategy"))
    dirs = directories(files, ignore).select(
        "root", "path", F.lit(True).alias("is_dir"), F.lit(True).alias("is_valid"), F.lit("").alias("reason"),
        F.lit(0).cast("long").alias("token_count"), F.lit(None).cast("string").alias("strategy"))
    return dirs.unionByName(skipped).unionByName(counted)


def scan_summary(items: DataFrame) -> DataFrame:
    """Per root: items, files, directories, tokenised, skipped, invalid, total tokens."""
    f = ~F.col("is_dir")
    return items.groupBy("root").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(f).alias("n_files"),
        F.count_if(F.col("is_dir")).alias("n_dirs"),
        F.count_if(f & (F.col("strategy") != "skip") & F.col("is_valid")).alias("n_tokenised"),
        F.count_if(f & (F.col("strategy") == "skip")).alias("n_skipped"),
        F.count_if(~F.col("is_valid")).alias("n_invalid"),
        F.coalesce(F.sum(F.when(f & (F.col("token_count") > 0), F.col("token_count"))), F.lit(0)).cast("long").alias("total_tokens"),
    )


def skipped_by_reason(items: DataFrame) -> DataFrame:
    """Skipped files per root and reason."""
    return items.where(~F.col("is_dir") & (F.col("strategy") == "skip")).groupBy("root", "reason").agg(
        F.count(F.lit(1)).alias("n_files"))


def scan_corpus(spark, roots: list[str], estimator="chars4", ignore=None, max_bytes: int = R.READ_LIMIT) -> DataFrame:
    """T4 over file trees, listing and reading as two tables: what is listed keeps its row when it can't be read (invalid,
    with the reason and no tokens). Only files within the size limit are read, and only their counts are joined."""
    from corpus_context.sources.files import scan_files

    listed = scan_files(spark, roots).drop("content")
    items = list_items(listed, ignore).join(listed.select("root", "path", "size"), ["root", "path"], "left")
    read = scan_files(spark, roots, max_size=R.SKIP_LIMIT, skip_unreadable=True).where(R.skip_pattern_reason("path").isNull())
    counts = read.select("root", "path", TK.estimator(estimator)(read_text(read, max_bytes=max_bytes)).cast("long").alias("tokens"))
    reason = R.skip_reason("path", "size")
    to_read = ~F.col("is_dir") & reason.isNull()
    unread = to_read & F.col("tokens").isNull()
    return items.join(counts, ["root", "path"], "left").select(
        "root", "path", "is_dir", (~unread).alias("is_valid"),
        F.when(unread, F.lit(READ_ERROR)).when(F.col("is_dir"), F.lit("")).otherwise(F.coalesce(reason, F.lit(""))).alias("reason"),
        F.when(to_read, F.coalesce("tokens", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("token_count"), "strategy")


def _corpus_tokens_one_pass(files: DataFrame, estimator, ignore, max_bytes: int) -> DataFrame:
    est = TK.estimator(estimator)
    ig = _ignore(files, ignore)
    kept = R.prune_ignored("path", "root", ig)
    if "include_subfolders" in files.columns:
        kept = kept & R.include_subfolders("path", "root", F.col("include_subfolders"))
    reason = R.skip_reason("path", "size")
    x = files.select("root", "path", "size", *(["text"] if "text" in files.columns else ["content"]),
                     *(["ignore"] if "ignore" in files.columns else []), kept.alias("_kept"), reason.alias("_reason"))
    strategy = (F.when(F.col("_reason").isNotNull(), F.lit("skip"))
                .when(F.col("size") <= R.IMMEDIATE_LIMIT, F.lit("immediate")).otherwise(F.lit("defer")))
    unread = F.col("_reason").isNull() & F.col("text" if "text" in files.columns else "content").isNull()
    tokens = F.when(F.col("_reason").isNull() & ~unread, est(read_text(x, max_bytes=max_bytes))).otherwise(F.lit(0)).cast("long")
    reason = F.when(unread, F.lit(READ_ERROR)).otherwise(F.coalesce(F.col("_reason"), F.lit("")))
    file_row = F.when(F.col("_kept"), F.struct(
        F.col("path").alias("path"), F.lit(False).alias("is_dir"), (~unread).alias("is_valid"), reason.alias("reason"),
        tokens.alias("token_count"), strategy.alias("strategy")))
    dirs = F.transform(
        F.filter(P.ancestors("path", "root"), lambda d: (d != F.col("root")) & R.dir_pruned(d, F.col("root"), ig)),
        lambda d: F.struct(d.alias("path"), F.lit(True).alias("is_dir"), F.lit(True).alias("is_valid"), F.lit("").alias("reason"),
                           F.lit(0).cast("long").alias("token_count"), F.lit(None).cast("string").alias("strategy")))
    rows = x.select("root", F.explode(F.filter(F.concat(F.array(file_row), dirs), lambda r: r.isNotNull())).alias("r"))
    out = rows.select("root", "r.*").dropDuplicates(["root", "path"])
    return out.select("root", "path", "is_dir", "is_valid", "reason", "token_count", "strategy")


def gitignore_rules(files: DataFrame) -> DataFrame:
    """Rules from the corpus's own ``.gitignore`` rows -> (root, gdir, ord, negate, dir_only, regex).

    The regex is for the whole path of a file or folder relative to the ``.gitignore``'s folder. A pattern with
    no inner '/' matches at any depth; a trailing '/' matches folders only; blanks at the end go unless escaped. Patterns
    are turned into regexes by Catalyst functions, so the rules stay data (no driver-side parsing)."""
    from corpus_context.functions.globs import path_pattern_regex
    from corpus_context.functions.text import read_text

    g = files.where(P.basename("path") == ".gitignore")
    g = g.select("root", P.dirname("path").alias("gdir"),
                 F.posexplode(F.split(read_text(g, newline="universal"), "\n")).alias("ord", "line"))
    g = g.withColumn("line", F.regexp_replace("line", r"(?<!\\)\s+$", "")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    g = g.withColumn("negate", F.col("line").startswith("!")).withColumn("p", F.regexp_replace("line", "^!", ""))
    g = g.withColumn("dir_only", F.col("p").endswith("/")).withColumn("p", F.regexp_replace("p", "/+$", "")).where("p <> ''")
    head = F.when(F.col("p").contains("/"), F.lit("^")).otherwise(F.lit("^(?:.*/)?"))
    regex = F.concat(F.lit("(?s)"), head, path_pattern_regex(F.regexp_replace("p", "^/", "")), F.lit(r"\z"))
    return g.select("root", "gdir", "ord", "negate", "dir_only", regex.alias("regex"))


def gitignore_filter(files: DataFrame) -> DataFrame:
    """Files not ignored by the ``.gitignore`` rules of their folders.

    Every folder, and then the file, is decided by the last rule that matches it (deeper files' rules after shallower ones;
    '!' re-includes). An ignored folder ends the search: nothing below it can be re-included. Folders are decided once,
    however many files they hold, and each node meets only the rules of the folders above it (an equi-join on the folder)."""
    rules = gitignore_rules(files)
    f = files.select("root", "path").where(P.basename("path") != ".gitignore").distinct()
    folders = f.select("root", F.explode(P.ancestors("path", "root")).alias("path")).where(F.col("path") != F.col("root")).distinct()
    nodes = f.withColumn("is_dir", F.lit(False)).unionByName(folders.withColumn("is_dir", F.lit(True)))
    m = nodes.select("*", F.explode(P.ancestors("path", "root")).alias("gdir")).join(rules, ["root", "gdir"])
    rel = F.substr("path", F.length("gdir") + 2)
    m = m.where((F.col("is_dir") | ~F.col("dir_only")) & F.call_function("regexp_like", rel, F.col("regex")))
    last = m.groupBy("root", "path", "is_dir").agg(F.max_by("negate", F.struct(F.length("gdir"), "ord")).alias("negate"))
    ignored = last.where("not negate").select("root", F.col("path").alias("up"), "is_dir")
    chain = f.select("root", "path", F.explode(F.array_append(P.ancestors("path", "root"), F.col("path"))).alias("up"), )
    chain = chain.withColumn("is_dir", F.col("up") != F.col("path"))
    gone = chain.join(ignored, ["root", "up", "is_dir"], "left_semi").select("root", "path").distinct()
    return files.join(gone, ["root", "path"], "left_anti")
