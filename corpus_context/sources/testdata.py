"""Views over the driver's testdata (FIXTURES.md §2), built with the DataFrame API.

``documents`` becomes a corpus of files under 20 roots; ``labels`` becomes
two selection groups per root; ``events`` becomes a file-event stream. The
same views are written in SQL for the DuckDB oracle (plans/oracle_views.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.functions.rules import DEFAULT_IGNORE_FOLDERS
from corpus_context.functions.util import lit_array

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC
_GROUPS_TYPE = "map<string,struct<description:string,checked_paths:array<string>,last_updated:double>>"

_SUBDIRS = {3: "node_modules/", 4: "src/app/", 5: "src/build/", 6: ".hidden/"}
_EXTS = [".py", ".md", ".js", ".txt", ".json", ".min.js", ".TS", ".log",
         ".html", ".rs", "", ".png", ".lock", ".tar.gz", ".so", ".sql"]


_KEYS = {"documents": "doc_id", "events": "event_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A testdata table. A file with fewer splits than the cluster has cores (one row group
    here) would put all per-row work of the first stage into one task, so such an input is
    hash-partitioned by its key right after the scan (columns are still pruned below it)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = _KEYS.get(name)
    if key is not None:
        try:
            n = spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < n:
                df = df.repartition(n, key)
        except Exception:  # no RDD access (e.g. a remote session): keep the scan as it is
            pass
    return df


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(root, path, doc_id, size, mtime, text, content)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    doc = F.col("doc_id")
    sub = F.lit("")
    for k in sorted(_SUBDIRS, reverse=True):
        sub = F.when(doc % 7 == k, F.lit(_SUBDIRS[k])).otherwise(sub)
    ext = F.element_at(lit_array(_EXTS), (doc % 16 + 1).cast("int"))
    root = F.concat(F.lit("/corpus/"), F.col("source"))
    path = F.concat(root, F.lit("/"), F.col("lang"), F.lit("/"), sub, F.lit("doc_"),
                    F.format_string("%06d", doc), ext)
    text = (
        F.when(doc % 13 == 0, F.repeat(F.col("text"), 16))
        .when(doc % 29 == 0, F.lit(""))
        .when(doc % 11 == 0, F.concat(F.col("text"), F.lit("\n```\n")))
        .otherwise(F.col("text"))
    )
    out = d.select(
        root.alias("root"),
        path.alias("path"),
        doc.alias("doc_id"),
        text.alias("text"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + doc * 60).alias("mtime"),
    )
    return out.withColumn("size", F.octet_length("text").cast("long")).withColumn(
        "content", F.col("text").cast("binary"))


def _rel(f: DataFrame) -> F.Column:
    return F.substr(f["path"], F.length(f["root"]) + 2)


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """selections(workspace, group_name, path) with paths relative to the root.

    Default: files labelled quality = 1, plus a '.gone' twin of every doc_id % 10 = 9 file;
    Flagged: files labelled toxic = 1. One scan, one join, one explode.
    """
    f = files(spark, sf_dir).select("root", "path", "doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = f.join(lab, "doc_id", "left")
    rel = _rel(j)
    opts = F.array(
        F.when(F.col("quality") == 1, F.struct(F.lit("Default").alias("g"), rel.alias("p"))),
        F.when(F.col("toxic") == 1, F.struct(F.lit("Flagged").alias("g"), rel.alias("p"))),
        F.when(F.col("doc_id") % 10 == 9, F.struct(F.lit("Default").alias("g"), F.concat(rel, F.lit(".gone")).alias("p"))),
    )
    e = j.select(F.col("root").alias("workspace"), F.explode(F.filter(opts, lambda x: x.isNotNull())).alias("s"))
    return e.select("workspace", F.col("s.g").alias("group_name"), F.col("s.p").alias("path"))


def selection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = files(spark, sf_dir).select(F.col("root").alias("workspace")).distinct()
    a = roots.select("workspace", F.lit("Default").alias("group_name"),
                     F.lit("Default selection").alias("description"),
                     F.timestamp_seconds(F.lit(EPOCH_2024 + 3 * 3600)).alias("last_updated"))
    b = roots.select("workspace", F.lit("Flagged").alias("group_name"),
                     F.lit("Flagged selection").alias("description"),
                     F.lit(None).cast("timestamp").alias("last_updated"))
    return a.unionByName(b)


def fs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fs_events(root, seq, ts, action, src_path, dst_path, tokens); ts is timestamp_ntz."""
    e = table(spark, sf_dir, "events")
    u = F.concat(F.lit("/corpus/live/u"), F.lpad((F.col("user_id") % 40).cast("string"), 3, "0"), F.lit("/f"))
    action = (
        F.when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "error", "deleted")
        .when(F.col("event_type") == "purchase", "moved")
        .otherwise("modified")
    )
    return e.select(
        F.lit("/corpus/live").alias("root"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        action.alias("action"),
        F.concat(u, (F.col("event_id") % 5).cast("string"), F.lit(".py")).alias("src_path"),
        F.when(F.col("event_type") == "purchase",
               F.concat(u, ((F.col("event_id") + 1) % 5).cast("string"), F.lit(".py"))).alias("dst_path"),
        F.floor("value").cast("long").alias("tokens"),
    )


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(F.col("doc_id") % 10 != 0)


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where(F.col("doc_id") % 10 != 1)
    f = f.withColumn("path", F.when(F.col("doc_id") % 37 == 0, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")))
    f = f.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return f.withColumn("size", F.octet_length("text").cast("long")).withColumn("content", F.col("text").cast("binary"))


def workspaces(spark: SparkSession, sf_dir: str, with_groups: bool = True) -> DataFrame:
    """One workspace per root (plus the live-events root), default settings.

    instructions = 'Summarise {source}.' for even source numbers, else ''.
    Groups: Default and Flagged, as maps of (description, checked_paths, last_updated);
    without ``with_groups`` the map is empty (settings-only jobs skip the selection join).
    """
    if with_groups:
        sel = selections(spark, sf_dir)
        grp = selection_groups(spark, sf_dir)
        paths = sel.groupBy("workspace", "group_name").agg(F.array_sort(F.collect_set("path")).alias("checked_paths"))
        g = grp.join(paths, ["workspace", "group_name"], "left").select(
            "workspace", "group_name",
            F.struct(F.col("description"),
                     F.coalesce("checked_paths", F.array().cast("array<string>")).alias("checked_paths"),
                     F.unix_timestamp("last_updated").cast("double").alias("last_updated")).alias("g"))
        maps = g.groupBy("workspace").agg(F.map_from_entries(F.collect_list(F.struct("group_name", "g"))).alias("selection_groups"))
    else:
        maps = table(spark, sf_dir, "documents").select(
            F.concat(F.lit("/corpus/"), F.col("source")).alias("workspace")).distinct().withColumn(
            "selection_groups", F.lit(None).cast(_GROUPS_TYPE))
    live = spark.range(1).select(F.lit("/corpus/live").alias("workspace"))
    ws = maps.unionByName(live, allowMissingColumns=True)
    num = F.regexp_extract("workspace", r"(\d+)$", 1)
    return ws.select(
        "workspace",
        F.col("workspace").alias("folder_path"),
        F.struct(F.lit(True).alias("include_subfolders"), lit_array(DEFAULT_IGNORE_FOLDERS).alias("ignore_folders"),
                 F.lit(True).alias("live_watcher")).alias("scan_settings"),
        F.when((num != "") & (num.cast("int") % 2 == 0),
               F.concat(F.lit("Summarise "), F.regexp_extract("workspace", r"([^/]+)$", 1), F.lit("."))).otherwise(F.lit("")).alias("instructions"),
        F.lit("Default").alias("active_selection_group"),
        F.coalesce("selection_groups", F.create_map().cast(_GROUPS_TYPE)).alias("selection_groups"),
        F.lit(False).alias("use_local_templates"),
        F.create_map().cast("map<string,string>").alias("local_custom_instructions"),
    )
