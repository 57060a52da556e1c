"""Registered queries: selection groups, drift, active selection, token cache, live workspaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.operators import selection as SEL
from corpus_context.plans.oracle_views import VIEWS, DEPS, with_views
from corpus_context.plans.q_scan import corpus_items
from corpus_context.plans.registry import query
from corpus_context.sources import testdata as TD

SAVED_AT = 1706745600.0  # 2024-02-01 00:00:00 UTC, the "now" of the upsert query

VIEWS["sel_abs"] = """
SELECT DISTINCT workspace, group_name, workspace || '/' || path AS path FROM selections"""
DEPS["sel_abs"] = ["selections"]

VIEWS["missing"] = """
SELECT s.workspace, s.group_name, s.path FROM sel_abs s WHERE s.path NOT IN (SELECT path FROM files)"""
DEPS["missing"] = ["sel_abs", "files"]

VIEWS["newf"] = """
SELECT DISTINCT d.workspace, d.group_name, f.path FROM (
  SELECT DISTINCT s.workspace, s.group_name, g.last_updated, regexp_extract(s.path, '^(.*)/[^/]*$', 1) AS dir
  FROM sel_abs s JOIN selection_groups g ON g.workspace = s.workspace AND g.group_name = s.group_name
  WHERE g.last_updated IS NOT NULL) d
JOIN files f ON regexp_extract(f.path, '^(.*)/[^/]*$', 1) = d.dir AND f.mtime > d.last_updated + INTERVAL 1 SECOND
WHERE NOT EXISTS (SELECT 1 FROM sel_abs s2 WHERE s2.workspace = d.workspace AND s2.group_name = d.group_name AND s2.path = f.path)"""
DEPS["newf"] = ["sel_abs", "selection_groups", "files"]


def sel_abs(spark, sf):
    s = TD.selections(spark, sf)
    return s.select("workspace", "group_name", P.to_absolute("path", "workspace").alias("path")).distinct()


def groups_table(spark, sf):
    g = TD.selection_groups(spark, sf)
    return g.select("workspace", "group_name", "description", F.unix_timestamp("last_updated").cast("double").alias("last_updated"))


@query("active_selection", "J3 P3", with_views("""
SELECT DISTINCT workspace, workspace AS root, group_name, path AS rel, workspace || '/' || path AS path
FROM selections WHERE group_name = 'Default'""", "selections"))
def q_active_selection(spark, sf):
    return SEL.selected_files(TD.workspaces(spark, sf, with_groups=False), TD.selections(spark, sf))


@query("load_groups", "E1 A4", with_views("""
WITH g AS (SELECT workspace, group_name, description, CAST(epoch(last_updated) AS DOUBLE) AS last_updated FROM selection_groups),
p AS (SELECT workspace, group_name, count(*) AS n_paths, min(path) AS first_path FROM sel_abs GROUP BY ALL)
SELECT g.workspace, g.group_name, g.description, g.last_updated, coalesce(p.n_paths, 0) AS n_paths, p.first_path
FROM g LEFT JOIN p ON p.workspace = g.workspace AND p.group_name = g.group_name
UNION ALL SELECT '/corpus/live', 'Default', 'Default selection', NULL, 0, NULL""", "selection_groups", "sel_abs"))
def q_load_groups(spark, sf):
    groups, paths = SEL.load_groups(TD.workspaces(spark, sf, with_groups=True))
    p = paths.groupBy("workspace", "group_name").agg(F.count(F.lit(1)).alias("n_paths"), F.min("path").alias("first_path"))
    return groups.join(p, ["workspace", "group_name"], "left").select(
        "workspace", "group_name", "description", "last_updated",
        F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "first_path")


@query("drift_missing", "D1", with_views("SELECT workspace, group_name, path FROM missing", "missing"))
def q_drift_missing(spark, sf):
    return SEL.drift_missing(sel_abs(spark, sf), TD.files(spark, sf))


@query("drift_new", "D2", with_views("SELECT workspace, group_name, path FROM newf", "newf"))
def q_drift_new(spark, sf):
    return SEL.drift_new(sel_abs(spark, sf), groups_table(spark, sf).withColumn(
        "last_updated", F.timestamp_seconds("last_updated")), TD.files(spark, sf))


@query("resolve_drift", "D3 E5", with_views("""
WITH res AS (SELECT workspace, group_name, path FROM sel_abs EXCEPT SELECT workspace, group_name, path FROM missing
             UNION SELECT workspace, group_name, path FROM newf),
nm AS (SELECT workspace, group_name, count(*) AS n_missing FROM missing GROUP BY ALL),
nn AS (SELECT workspace, group_name, count(*) AS n_new FROM newf GROUP BY ALL),
msg AS (SELECT coalesce(nm.workspace, nn.workspace) AS workspace, coalesce(nm.group_name, nn.group_name) AS group_name,
               coalesce(n_missing, 0) AS n_missing, coalesce(n_new, 0) AS n_new
        FROM nm FULL JOIN nn ON nm.workspace = nn.workspace AND nm.group_name = nn.group_name),
cnt AS (SELECT workspace, group_name, count(*) AS n_after FROM res GROUP BY ALL)
SELECT m.workspace, m.group_name, m.n_missing, m.n_new, coalesce(c.n_after, 0) AS n_after,
       'Repo changes detected since this group was last saved:' || chr(10) || chr(10) ||
       CASE WHEN m.n_missing > 0 THEN '❌ ' || m.n_missing || ' selected files have been deleted.' || chr(10) ELSE '' END ||
       CASE WHEN m.n_new > 0 THEN '🆕 ' || m.n_new || ' new files added to selected folders.' || chr(10) ELSE '' END ||
       chr(10) || 'Do you want to update the selection?' AS message
FROM msg m LEFT JOIN cnt c ON c.workspace = m.workspace AND c.group_name = m.group_name""", "missing", "newf"))
def q_resolve_drift(spark, sf):
    s = sel_abs(spark, sf)
    files = TD.files(spark, sf)
    g = groups_table(spark, sf).withColumn("last_updated", F.timestamp_seconds("last_updated"))
    miss = SEL.drift_missing(s, files)
    new = SEL.drift_new(s, g, files)
    out, msg = SEL.resolve_drift(s, miss, new, True)
    cnt = out.groupBy("workspace", "group_name").agg(F.count(F.lit(1)).alias("n_after"))
    return msg.join(cnt, ["workspace", "group_name"], "left").select(
        "workspace", "group_name", "n_missing", "n_new", F.coalesce("n_after", F.lit(0)).alias("n_after"), "message")


@query("selection_dirty", "E4", with_views("""
WITH res AS (SELECT workspace, group_name, path FROM sel_abs EXCEPT SELECT workspace, group_name, path FROM missing
             UNION SELECT workspace, group_name, path FROM newf),
d AS (SELECT * FROM (SELECT * FROM res EXCEPT SELECT * FROM sel_abs) UNION ALL SELECT * FROM (SELECT * FROM sel_abs EXCEPT SELECT * FROM res)),
k AS (SELECT DISTINCT workspace, group_name FROM res UNION SELECT DISTINCT workspace, group_name FROM sel_abs),
n AS (SELECT workspace, group_name, count(*) AS n_diff FROM d GROUP BY ALL)
SELECT k.workspace, k.group_name, coalesce(n.n_diff, 0) AS n_diff, coalesce(n.n_diff, 0) > 0 AS dirty
FROM k LEFT JOIN n ON n.workspace = k.workspace AND n.group_name = k.group_name""", "missing", "newf"))
def q_selection_dirty(spark, sf):
    s = sel_abs(spark, sf)
    files = TD.files(spark, sf)
    g = groups_table(spark, sf).withColumn("last_updated", F.timestamp_seconds("last_updated"))
    out, _ = SEL.resolve_drift(s, SEL.drift_missing(s, files), SEL.drift_new(s, g, files), True)
    return SEL.selection_dirty(out, s)


@query("upsert_group", "E2 P2", with_views(f"""
WITH upd AS (SELECT s.workspace, CASE WHEN s.group_name = 'Default' THEN 'Default' ELSE 'Reviewed' END AS group_name,
                    substr(s.path, length(s.workspace) + 2) AS rel
             FROM sel_abs s WHERE s.path IN (SELECT path FROM files)),
g AS (SELECT workspace, group_name, description, CAST(epoch(last_updated) AS DOUBLE) AS last_updated FROM selection_groups),
ng AS (SELECT * FROM g WHERE (workspace, group_name) NOT IN (SELECT DISTINCT workspace, group_name FROM upd)
       UNION ALL
       SELECT DISTINCT u.workspace, u.group_name, coalesce(g.description, u.group_name || ' selection'), {SAVED_AT}
       FROM upd u LEFT JOIN g ON g.workspace = u.workspace AND g.group_name = u.group_name),
ns AS (SELECT workspace, group_name, path AS rel FROM selections
       WHERE (workspace, group_name) NOT IN (SELECT DISTINCT workspace, group_name FROM upd)
       UNION SELECT workspace, group_name, rel FROM upd),
c AS (SELECT workspace, group_name, count(DISTINCT rel) AS n_paths, min(rel) AS first_rel FROM ns GROUP BY ALL)
SELECT ng.workspace, ng.group_name, ng.description, ng.last_updated, coalesce(c.n_paths, 0) AS n_paths, c.first_rel
FROM ng LEFT JOIN c ON c.workspace = ng.workspace AND c.group_name = ng.group_name""", "sel_abs", "selection_groups", "files"))
def q_upsert_group(spark, sf):
    s = sel_abs(spark, sf)
    existing = s.join(TD.files(spark, sf).select("path"), "path", "left_semi")
    upd = existing.select("workspace", F.when(F.col("group_name") == "Default", "Default").otherwise("Reviewed").alias("group_name"),
                          "path", F.lit(SAVED_AT).alias("now"))
    roots = TD.files(spark, sf).select(F.col("root").alias("workspace"), "root").distinct()
    groups, sel = SEL.upsert_group(groups_table(spark, sf), TD.selections(spark, sf), upd, roots)
    c = sel.groupBy("workspace", "group_name").agg(F.count_distinct("path").alias("n_paths"), F.min("path").alias("first_rel"))
    return groups.join(c, ["workspace", "group_name"], "left").select(
        "workspace", "group_name", "description", "last_updated", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "first_rel")


@query("delete_groups", "E3", with_views("""
WITH ws2 AS (SELECT DISTINCT workspace, CASE WHEN CAST(regexp_extract(workspace, '(\\d+)$', 1) AS INTEGER) % 2 = 1
                                             THEN 'Flagged' ELSE 'Default' END AS active FROM selection_groups),
g AS (SELECT workspace, group_name FROM selection_groups WHERE group_name NOT IN ('Flagged')),
s AS (SELECT workspace, group_name, path FROM selections WHERE group_name NOT IN ('Flagged')),
c AS (SELECT workspace, count(*) AS n_paths FROM s GROUP BY ALL),
n AS (SELECT workspace, count(*) AS n_groups FROM g GROUP BY ALL)
SELECT w.workspace, CASE WHEN w.active = 'Flagged' THEN 'Default' ELSE w.active END AS active_selection_group,
       coalesce(n.n_groups, 0) AS n_groups, coalesce(c.n_paths, 0) AS n_paths
FROM ws2 w LEFT JOIN n ON n.workspace = w.workspace LEFT JOIN c ON c.workspace = w.workspace""", "selection_groups", "selections"))
def q_delete_groups(spark, sf):
    g = TD.selection_groups(spark, sf)
    ws = g.select("workspace").distinct().withColumn(
        "active_selection_group",
        F.when(F.regexp_extract("workspace", r"(\d+)$", 1).cast("int") % 2 == 1, "Flagged").otherwise("Default"))
    names = ws.select("workspace", F.explode(F.array(F.lit("Flagged"), F.lit("Default"), F.lit("Unknown"))).alias("group_name"))
    g2, s2, ws2 = SEL.delete_groups(g, TD.selections(spark, sf), ws, names)
    n = g2.groupBy("workspace").agg(F.count(F.lit(1)).alias("n_groups"))
    c = s2.groupBy("workspace").agg(F.count(F.lit(1)).alias("n_paths"))
    return ws2.join(n, "workspace", "left").join(c, "workspace", "left").select(
        "workspace", "active_selection_group", F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        F.coalesce("n_paths", F.lit(0)).alias("n_paths"))


@query("live_events", "J6", with_views("""
SELECT seq, action, src_path FROM fs_events WHERE root IN ('/corpus/live')""", "fs_events"))
def q_live_events(spark, sf):
    ev = TD.fs_events(spark, sf)
    return SEL.live_events(ev, TD.workspaces(spark, sf, with_groups=False)).select("seq", "action", "src_path")


@query("lookup_tokens", "T5", with_views("""
WITH s AS (SELECT DISTINCT path FROM sel_abs WHERE group_name = 'Default'),
c AS (SELECT path, token_count AS tokens FROM items WHERE NOT is_dir)
SELECT s.path, CASE WHEN c.tokens > 0 THEN c.tokens
                    WHEN f.path IS NOT NULL THEN CAST(length(f.text) // 4 AS BIGINT) ELSE 0 END AS tokens,
       coalesce(c.tokens > 0, FALSE) AS cached
FROM s LEFT JOIN c ON c.path = s.path LEFT JOIN files f ON f.path = s.path""", "sel_abs", "items", "files"))
def q_lookup_tokens(spark, sf):
    cache = corpus_items(spark, sf).where(~F.col("is_dir")).select("path", F.col("token_count").alias("tokens"))
    paths = sel_abs(spark, sf).where(F.col("group_name") == "Default").select("path")
    res, _ = SEL.lookup_tokens(paths, cache, TD.files(spark, sf))
    return res


@query("invalidate_cache", "T6", with_views("""
WITH cache AS (SELECT src_path AS path, max(tokens) AS tokens FROM fs_events WHERE action = 'created' GROUP BY src_path)
SELECT path, tokens FROM cache WHERE path NOT IN (
  SELECT src_path FROM fs_events WHERE action IN ('deleted', 'moved', 'modified'))""", "fs_events"))
def q_invalidate_cache(spark, sf):
    ev = TD.fs_events(spark, sf)
    cache = ev.where(F.col("action") == "created").groupBy(F.col("src_path").alias("path")).agg(F.max("tokens").alias("tokens"))
    return SEL.invalidate_cache(cache, ev)


@query("compare_estimators", "T7 T2 T3", with_views("""
WITH p AS (SELECT root, CAST(length(text) // 4 AS BIGINT) AS a,
                  CAST(length(text) // 4 + len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS BIGINT) AS b
           FROM files)
SELECT root, CAST(sum(a) AS BIGINT) AS total_a, CAST(sum(b) AS BIGINT) AS total_b, sum(a) = sum(b) AS consistent,
       count(*) FILTER (WHERE a <> b) AS n_differ
FROM p GROUP BY root""", "files"))
def q_compare_estimators(spark, sf):
    per, tot = SEL.compare_estimators(TD.files(spark, sf))
    n = per.groupBy("root").agg(F.count_if(F.col("diff") != 0).alias("n_differ"))
    return tot.join(n, "root")


@query("validate_file", "B13", with_views("""
SELECT s.path, CASE WHEN f.path IS NULL THEN FALSE WHEN strlen(f.text) > 204800 THEN FALSE ELSE TRUE END AS is_valid,
       CASE WHEN f.path IS NULL THEN 'File not found'
            WHEN strlen(f.text) > 204800 THEN 'File too large (' || CAST(strlen(f.text) AS VARCHAR) || ' bytes)'
            ELSE '' END AS reason
FROM (SELECT DISTINCT path FROM sel_abs) s LEFT JOIN files f ON f.path = s.path""", "sel_abs", "files"))
def q_validate_file(spark, sf):
    from corpus_context.functions import rules as R

    s = sel_abs(spark, sf).select("path").distinct()
    f = TD.files(spark, sf).select("path", "size", F.lit(True).alias("exists"))
    j = s.join(f, "path", "left")
    v = R.validate_file(F.coalesce("exists", F.lit(False)), "size")
    return j.select("path", v["is_valid"].alias("is_valid"), v["reason"].alias("reason"))


@query("items_from_paths", "P8 P3 P4 P7", with_views("""
WITH p AS (SELECT DISTINCT workspace AS root, workspace || '/' || path AS path FROM selections WHERE path <> '.'),
own AS (SELECT root, path, regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1) = '' AS is_dir FROM p),
par AS (SELECT DISTINCT root, dir AS path FROM (
          SELECT root, path, unnest(range(1, len(string_split(substr(path, length(root) + 2), '/')))) AS i,
                 string_split(substr(path, length(root) + 2), '/') AS c FROM p) x,
        LATERAL (SELECT root || '/' || array_to_string(list_slice(c, 1, i), '/') AS dir)),
allp AS (SELECT root, root AS path, TRUE AS is_dir, 0 AS pr FROM p
         UNION ALL SELECT root, path, is_dir, CASE WHEN is_dir THEN 2 ELSE 1 END FROM own
         UNION ALL SELECT root, path, TRUE, 2 FROM par)
SELECT root, path, arg_min(is_dir, pr) AS is_dir, TRUE AS is_valid, '' AS reason,
       CAST(CASE WHEN arg_min(is_dir, pr) THEN 0 ELSE -1 END AS BIGINT) AS token_count
FROM allp GROUP BY root, path""", "selections"))
def q_items_from_paths(spark, sf):
    from corpus_context.operators import tree as TR

    s = TD.selections(spark, sf).select(F.col("workspace").alias("root"), F.col("path").alias("rel")).distinct()
    return TR.items_from_paths(s)


@query("match_paths", "P9 J1", with_views("""
WITH s AS (SELECT DISTINCT workspace AS root, path FROM sel_abs)
SELECT s.root, s.path, i.path AS item_path, 'exact' AS how FROM s JOIN items i ON i.root = s.root AND i.path = s.path""",
                                          "sel_abs", "items"))
def q_match_paths(spark, sf):
    from corpus_context.operators import tree as TR

    s = sel_abs(spark, sf).select(F.col("workspace").alias("root"), "path").distinct()
    return TR.match_paths(s, corpus_items(spark, sf), case_insensitive=False)
