"""Registered queries: workspace documents, templates, versions and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_context.operators import config as CF
from corpus_context.plans.oracle_views import with_views
from corpus_context.plans.registry import query
from corpus_context.sources import testdata as TD

JOB_NOW = "2024-02-01 00:00:00"  # the 'now' parameter of the retention job


def workspace_docs(spark, sf):
    """One JSON document per workspace, written from the workspaces table: odd-numbered roots in
    the legacy (unversioned) form without scan settings, the others as schema v1."""
    ws = TD.workspaces(spark, sf, with_groups=True)
    num = F.regexp_extract("workspace", r"(\d+)$", 1)
    odd = (num != "") & (num.cast("int") % 2 == 1)
    w = F.struct("folder_path", F.when(odd, F.lit(None)).otherwise(F.col("scan_settings")).alias("scan_settings"),
                 "instructions", "active_selection_group", "selection_groups", "use_local_templates",
                 "local_custom_instructions")
    v1 = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("workspace").alias("last_active_workspace"),
                            F.create_map(F.col("workspace"), w).alias("workspaces")))
    v0 = F.to_json(F.create_map(F.col("workspace"), w))
    return ws.select(F.col("workspace").alias("doc_id"), F.when(odd, v0).otherwise(v1).alias("json"))


@query("read_workspaces", "A4 A5 B15", with_views("""
SELECT workspace AS doc_id, workspace, workspace AS folder_path, TRUE AS include_subfolders, 16 AS n_ignore,
       instructions, 'Default' AS active_selection_group, 2 AS n_groups, workspace AS last_active_workspace FROM ws
UNION ALL SELECT '/corpus/live', '/corpus/live', '/corpus/live', TRUE, 16, '', 'Default', 0, '/corpus/live'""", "ws"))
def q_read_workspaces(spark, sf):
    docs = workspace_docs(spark, sf)
    w = CF.read_workspaces(docs)
    last = CF.migrate_documents(docs).select("doc_id", "last_active_workspace")
    return w.join(last, "doc_id").select(
        "doc_id", "workspace", "folder_path", F.col("scan_settings.include_subfolders").alias("include_subfolders"),
        F.size("scan_settings.ignore_folders").alias("n_ignore"), "instructions", "active_selection_group",
        F.size("selection_groups").alias("n_groups"), "last_active_workspace")


def _templates(spark, sf):
    """Global templates: one small JSON document per benchmark row ({"bench_<id>": text})."""
    b = TD.table(spark, sf, "benchmark")
    doc = b.select(F.lit("*").alias("workspace"), F.to_json(F.create_map(
        F.concat(F.lit("bench_"), F.col("item_id").cast("string")), F.col("text"))).alias("json"))
    return CF.read_templates(doc, "global")


_TPL_NAMES = ["Default", "bench_1", "no_such_template"]


@query("resolve_templates", "J4 A6", with_views(f"""
WITH t AS (SELECT 'bench_' || CAST(item_id AS VARCHAR) AS name, text FROM benchmark
           UNION ALL SELECT 'Default', '{CF.DEFAULT_TEMPLATE_TEXT.replace(chr(10), "' || chr(10) || '")}'),
w AS (SELECT workspace, unnest({_TPL_NAMES!r}) AS name FROM ws UNION ALL SELECT '/corpus/live', unnest({_TPL_NAMES!r}))
SELECT w.workspace, w.name, 'global' AS scope, coalesce(t.text, '') AS text FROM w LEFT JOIN t ON t.name = w.name""", "ws"))
def q_resolve_templates(spark, sf):
    ws = TD.workspaces(spark, sf, with_groups=False)
    wanted = ws.select("workspace", F.explode(F.array(*[F.lit(x) for x in _TPL_NAMES])).alias("name"))
    return CF.resolve_templates(ws, _templates(spark, sf), wanted)


@query("verify_checksums", "K3", with_views("""
SELECT n.path, CASE WHEN o.path IS NULL THEN 'missing checksum' WHEN sha256(o.text) = sha256(n.text) THEN 'ok' ELSE 'mismatch' END AS status
FROM new_files n LEFT JOIN old_files o ON o.path = n.path""", "old_files", "new_files"))
def q_verify_checksums(spark, sf):
    manifest = TD.old_files(spark, sf).select("path", F.sha2("content", 256).alias("checksum"))
    return CF.verify_checksums(TD.new_files(spark, sf), manifest)


@query("retain_versions", "K4", with_views(f"""
SELECT name, version, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts FROM (
  SELECT src_path AS name, seq AS version, ts, row_number() OVER (PARTITION BY src_path ORDER BY ts DESC, seq DESC) AS k FROM fs_events)
WHERE k <= 5 AND ts >= TIMESTAMP '{JOB_NOW}' - INTERVAL 7 DAY""", "fs_events"))
def q_retain_versions(spark, sf):
    v = TD.fs_events(spark, sf).select(F.col("src_path").alias("name"), F.col("seq").alias("version"), "ts")
    out = CF.retain_versions(v, 5, 7, F.lit(JOB_NOW).cast("timestamp_ntz"))
    return out.select("name", "version", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))


@query("latest_valid_version", "K5", with_views("""
WITH v AS (SELECT path AS name, 1 AS version, mtime AS ts, text, sha256(text) AS checksum FROM old_files
           UNION ALL
           SELECT n.path, 2, n.mtime + INTERVAL 1 DAY, n.text, (SELECT sha256(o.text) FROM old_files o WHERE o.path = n.path)
           FROM new_files n),
ok AS (SELECT * FROM v WHERE sha256(text) = checksum),
best AS (SELECT name, arg_max(version, ts) AS version, arg_max(text, ts) AS text FROM ok GROUP BY name),
names AS (SELECT DISTINCT name FROM v)
SELECT n.name, b.version, md5(coalesce(b.text, '{}')) AS document_md5, b.version IS NULL AS is_default
FROM names n LEFT JOIN best b ON b.name = n.name""", "old_files", "new_files"))
def q_latest_valid_version(spark, sf):
    o = TD.old_files(spark, sf)
    n = TD.new_files(spark, sf)
    man = o.select("path", F.sha2("content", 256).alias("checksum"))
    v1 = o.select(F.col("path").alias("name"), F.lit(1).alias("version"), F.col("mtime").alias("ts"), "content",
                  F.sha2("content", 256).alias("checksum"))
    v2 = n.join(man, "path", "left").select(F.col("path").alias("name"), F.lit(2).alias("version"),
                                            (F.col("mtime") + F.expr("INTERVAL 1 DAY")).alias("ts"), "content", "checksum")
    vs = v1.unionByName(v2)
    out = CF.latest_valid_version(vs, vs.select("name"))
    return out.select("name", "version", F.md5("document").alias("document_md5"), "is_default")


@query("write_if_changed", "K2", with_views("""
WITH old AS (SELECT path AS k, text FROM old_files), new AS (SELECT path AS k, text FROM new_files)
SELECT coalesce(new.k, old.k) AS k,
       CASE WHEN new.k IS NULL THEN 'deleted' WHEN old.k IS NULL THEN 'new' WHEN new.text <> old.text THEN 'changed' ELSE 'unchanged' END AS status,
       new.k IS NOT NULL AND (old.k IS NULL OR new.text <> old.text) AS saved
FROM new FULL JOIN old ON new.k = old.k""", "old_files", "new_files"))
def q_write_if_changed(spark, sf):
    o = TD.old_files(spark, sf).select(F.col("path").alias("k"), "text")
    n = TD.new_files(spark, sf).select(F.col("path").alias("k"), "text")
    return CF.write_if_changed(n, o, ["k"], ["text"])


@query("resolve_templates_local", "J4 A6", with_views("""
WITH wanted AS (SELECT DISTINCT root AS workspace, 'bench_' || CAST(doc_id AS VARCHAR) AS name, regexp_extract(root, '(\\d+)$', 1)::INTEGER % 2 = 1 AS own FROM files),
loc AS (SELECT root AS workspace, 'bench_' || CAST(doc_id AS VARCHAR) AS name, 'local ' || path AS text FROM files WHERE doc_id % 3 = 0),
glo AS (SELECT 'bench_' || CAST(item_id AS VARCHAR) AS name, text FROM benchmark)
SELECT w.workspace, w.name, CASE WHEN w.own THEN 'local' ELSE 'global' END AS scope,
       coalesce(CASE WHEN w.own THEN loc.text ELSE glo.text END, '') AS text
FROM wanted w LEFT JOIN loc ON loc.workspace = w.workspace AND loc.name = w.name LEFT JOIN glo ON glo.name = w.name""", "files"))
def q_resolve_templates_local(spark, sf):
    """J4 for a name per file of every workspace: odd workspaces see a local set (a third of the names), even ones the benchmark's."""
    f = TD.files(spark, sf).select(F.col("root").alias("workspace"), F.concat(F.lit("bench_"), F.col("doc_id").cast("string")).alias("name"),
                                   "doc_id", "path")
    odd = F.regexp_extract("workspace", r"(\d+)$", 1).cast("int") % 2 == 1
    ws = f.select("workspace").distinct().withColumn("use_local_templates", odd)
    docs = f.where("doc_id % 3 = 0").select("workspace", F.to_json(F.create_map("name", F.concat(F.lit("local "), "path"))).alias("json"))
    templates = _templates(spark, sf).unionByName(CF.read_templates(docs, "local"))
    return CF.resolve_templates(ws, templates, f.select("workspace", "name").distinct())


@query("read_workspace_files", "A4 A5 A6", with_views("""
SELECT workspace AS doc_id, TRUE AS is_valid, 1 AS n_workspaces, workspace AS last_active_workspace FROM ws
UNION ALL SELECT '/corpus/live', TRUE, 1, '/corpus/live'
UNION ALL SELECT workspace || '#cut', FALSE, 0, 'Default' FROM ws""", "ws"))
def q_read_workspace_files(spark, sf):
    """Workspace documents written as one JSON file each, v0 and v1, and a cut copy of most; read, checked and migrated."""
    import os
    import uuid

    from corpus_context.session import checkpoint_dir
    from corpus_context.sources.files import read_documents

    docs = workspace_docs(spark, sf)
    cut = docs.where("doc_id <> '/corpus/live'").select(F.concat("doc_id", F.lit("#cut")).alias("doc_id"), F.expr("left(json, length(json) - 5)").alias("json"))
    out = os.path.join(checkpoint_dir(spark), f"workspaces-{uuid.uuid4().hex[:12]}")
    docs.unionByName(cut).select(F.hex("doc_id").alias("name"), "json").repartition("name").write.partitionBy("name").text(out)
    read = read_documents(spark, out, id_col="name").withColumn("doc_id", F.unhex("doc_id").cast("string"))
    m = CF.migrate_documents(read.where("is_valid")).select("doc_id", F.size("workspaces").alias("n"), "last_active_workspace")
    return read.join(m, "doc_id", "left").select("doc_id", "is_valid", F.coalesce("n", F.lit(0)).alias("n_workspaces"),
                                                 F.coalesce("last_active_workspace", F.lit("Default")).alias("last_active_workspace"))
