"""Configuration and versions: workspace documents (A4, A5, B15), templates (A6, J4),
write-if-changed (K2), checksums (K3), retention (K4), latest valid version (K5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_context import schemas as SC
from corpus_context.functions import rules as R
from corpus_context.functions.util import array_of

# Fixed value: the stock 'Default' template text.
DEFAULT_TEMPLATE_TEXT = (
    "Instructions for the output format:\n"
    "Output code without descriptions, unless it is important.\n"
    "Minimize prose, comments and empty lines."
)

_DOC_V1 = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("last_active_workspace", T.StringType()),
    T.StructField("workspaces", T.MapType(T.StringType(), SC.WORKSPACE)),
])


def complete_settings(settings) -> F.Column:
    """Missing fields get defaults; a null ignore list -> the default list; an empty list stays empty."""
    s = settings if not isinstance(settings, str) else F.col(settings)
    return F.when(s.isNull(), F.struct(F.lit(True).alias("include_subfolders"),
                                       array_of(R.DEFAULT_IGNORE_FOLDERS).alias("ignore_folders"),
                                       F.lit(True).alias("live_watcher"))).otherwise(F.struct(
        F.coalesce(s["include_subfolders"], F.lit(True)).alias("include_subfolders"),
        F.coalesce(s["ignore_folders"], array_of(R.DEFAULT_IGNORE_FOLDERS)).alias("ignore_folders"),
        F.coalesce(s["live_watcher"], F.lit(True)).alias("live_watcher")))


def migrate_documents(docs: DataFrame) -> DataFrame:
    """A5: docs(doc_id, json). A document without schema_version is v0: its keys are the workspaces.

    -> (doc_id, schema_version, last_active_workspace, workspaces map).
    """
    v1 = F.from_json("json", _DOC_V1)
    v0 = F.from_json("json", T.MapType(T.StringType(), SC.WORKSPACE))
    d = docs.select("doc_id", v1.alias("v1"), v0.alias("v0"), F.from_json("json", "map<string,string>").alias("raw"))
    old = F.col("v1.schema_version").isNull()
    ws = F.when(old, F.map_filter("v0", lambda k, v: ~k.isin("last_active_workspace", "schema_version"))).otherwise(F.col("v1.workspaces"))
    last = F.when(old, F.coalesce(F.col("raw")["last_active_workspace"], F.element_at(F.map_keys(ws), 1), F.lit("Default"))
                  ).otherwise(F.col("v1.last_active_workspace"))
    return d.select("doc_id", F.lit(1).alias("schema_version"), last.alias("last_active_workspace"), ws.alias("workspaces"))


def read_workspaces(docs: DataFrame) -> DataFrame:
    """A4 + B15: one row per workspace with defaults filled: instructions '', active group 'Default',
    groups {}, use_local_templates false, local templates {}."""
    m = migrate_documents(docs)
    e = m.select("doc_id", F.explode("workspaces").alias("workspace", "w"))
    return e.select(
        "doc_id", "workspace", F.col("w.folder_path").alias("folder_path"),
        complete_settings(F.col("w.scan_settings")).alias("scan_settings"),
        F.coalesce("w.instructions", F.lit("")).alias("instructions"),
        F.coalesce("w.active_selection_group", F.lit("Default")).alias("active_selection_group"),
        F.coalesce("w.selection_groups", F.create_map().cast(SC.WORKSPACE["selection_groups"].dataType)).alias("selection_groups"),
        F.coalesce("w.use_local_templates", F.lit(False)).alias("use_local_templates"),
        F.coalesce("w.local_custom_instructions", F.create_map().cast("map<string,string>")).alias("local_custom_instructions"))


def read_templates(docs: DataFrame, scope: str = "global") -> DataFrame:
    """docs(workspace, json) name -> text; 'Default' added with the stock text if missing;
    an invalid or non-object document gives only the default."""
    m = docs.select("workspace", F.from_json("json", "map<string,string>").alias("m"))
    e = m.select("workspace", F.explode_outer("m").alias("name", "text")).where(F.col("name").isNotNull())
    dflt = docs.select("workspace").distinct().join(e.where(F.col("name") == "Default").select("workspace"), "workspace", "left_anti")
    out = e.unionByName(dflt.select("workspace", F.lit("Default").alias("name"), F.lit(DEFAULT_TEMPLATE_TEXT).alias("text")))
    return out.select(F.lit(scope).alias("scope"), "workspace", "name", "text")


def resolve_templates(ws: DataFrame, templates: DataFrame, wanted: DataFrame) -> DataFrame:
    """The template text a workspace sees: its local set if use_local_templates, else the global set;
    an unknown name -> ''. wanted(workspace, name)."""
    w = wanted.join(ws.select("workspace", "use_local_templates"), "workspace", "left").withColumn(
        "scope", F.when(F.coalesce("use_local_templates", F.lit(False)), F.lit("local")).otherwise(F.lit("global")))
    loc = templates.where(F.col("scope") == "local").select("workspace", "name", F.col("text").alias("lt"))
    glo = templates.where(F.col("scope") == "global").select("name", F.col("text").alias("gt")).dropDuplicates(["name"])
    j = w.join(loc, ["workspace", "name"], "left").join(glo, "name", "left")
    return j.select("workspace", "name", "scope",
                    F.coalesce(F.when(F.col("scope") == "local", F.col("lt")).otherwise(F.col("gt")), F.lit("")).alias("text"))


def content_hash(cols) -> F.Column:
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def write_if_changed(new: DataFrame, old: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """K2: rows of ``new`` whose content hash differs from the stored one (or that are new),
    with a flag per key; appending these as a new version skips unchanged keys."""
    n = new.select(*key, content_hash(cols).alias("nh"))
    o = old.select(*key, content_hash(cols).alias("oh"))
    j = n.join(o, key, "full")
    return j.select(*key, F.when(F.col("nh").isNull(), F.lit("deleted")).when(F.col("oh").isNull(), F.lit("new"))
                    .when(F.col("nh") != F.col("oh"), F.lit("changed")).otherwise(F.lit("unchanged")).alias("status"),
                    (F.col("nh").isNotNull() & (F.col("oh").isNull() | (F.col("nh") != F.col("oh")))).alias("saved"))


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """K3: recompute SHA-256 and compare with the recorded one: ok / missing checksum / mismatch."""
    f = files.select("path", F.sha2(F.col("content"), 256).alias("h"))
    j = f.join(manifest.select("path", "checksum"), "path", "left")
    return j.select("path", F.when(F.col("checksum").isNull(), F.lit("missing checksum"))
                    .when(F.col("checksum") == F.col("h"), F.lit("ok")).otherwise(F.lit("mismatch")).alias("status"))


def retain_versions(versions: DataFrame, keep: int = 5, days: int = 7, now=None) -> DataFrame:
    """K4: keep the newest ``keep`` versions per name, then drop those older than ``days`` before now."""
    from corpus_context.operators.topk import top_k_per_key

    v = top_k_per_key(versions, ["name"], [F.col("ts").desc(), F.col("version").desc()], keep, ["version"])
    now = F.current_timestamp() if now is None else now
    return v.where(F.col("ts") >= now - F.expr(f"INTERVAL {int(days)} DAYS")).drop("k")


def latest_valid_version(versions: DataFrame, names: DataFrame) -> DataFrame:
    """K5: per name the newest version whose checksum verifies; none -> a default empty document."""
    ok = versions.where(F.sha2(F.col("content"), 256) == F.col("checksum"))
    best = ok.groupBy("name").agg(F.max_by(F.struct("version", "ts", "content"), F.struct("ts", "version")).alias("b"))
    j = names.select("name").distinct().join(best, "name", "left")
    return j.select("name", F.col("b.version").alias("version"),
                    F.coalesce(F.col("b.content").cast("string"), F.lit("{}")).alias("document"),
                    F.col("b.version").isNull().alias("is_default"))
