"""Registered queries: snapshots and file events (batch forms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.operators import events as EV
from corpus_context.operators import selection as SEL
from corpus_context.plans.oracle_views import VIEWS, DEPS, with_views
from corpus_context.plans.registry import query
from corpus_context.sources import testdata as TD

IGNORE_GLOBS = ["*/u001/*", "f3.py", "*.log"]

# S2 oracle: the sequential rule itself, one recursive step per event, a map as the cache
VIEWS["tc"] = """
SELECT root, seq, path, diff FROM (
  WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq) AS rn FROM fs_events),
  walk(root, rn, cache, seq, path, diff) AS (
    SELECT DISTINCT root, 0, MAP {}::MAP(VARCHAR, BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT) FROM ev
    UNION ALL
    SELECT w.root, w.rn + 1,
      CASE e.action
        WHEN 'modified' THEN map_concat(w.cache, MAP {e.src_path: e.tokens})
        WHEN 'deleted' THEN map_from_entries(list_filter(map_entries(w.cache), lambda x: x.key <> e.src_path))
        WHEN 'moved' THEN CASE WHEN w.cache[e.src_path] IS NOT NULL THEN map_concat(
               map_from_entries(list_filter(map_entries(w.cache), lambda x: x.key <> e.src_path)),
               MAP {e.dst_path: w.cache[e.src_path]}) ELSE w.cache END
        ELSE w.cache END,
      e.seq, e.src_path,
      CASE WHEN e.action = 'modified' THEN e.tokens - coalesce(w.cache[e.src_path], e.tokens) END
    FROM walk w JOIN ev e ON e.root = w.root AND e.rn = w.rn + 1)
  SELECT root, seq, path, diff FROM walk WHERE diff IS NOT NULL AND diff <> 0)"""
DEPS["tc"] = ["fs_events"]

# S3: every seventh delete removes the whole folder; a third of the modified files are there from the start
VIEWS["tree_events"] = """
SELECT root, seq, action, CASE WHEN action = 'deleted' AND seq % 7 = 0 THEN regexp_extract(src_path, '^(.*)/[^/]*$', 1)
                               ELSE src_path END AS src_path, dst_path, tokens FROM fs_events"""
DEPS["tree_events"] = ["fs_events"]

VIEWS["tree_base"] = """
SELECT root, src_path AS path, arg_min(tokens, seq) AS token_count FROM fs_events
WHERE action = 'modified' AND seq % 3 = 0 GROUP BY ALL"""
DEPS["tree_base"] = ["fs_events"]

VIEWS["births"] = """
SELECT root, path, -1 AS step, token_count AS tokens FROM tree_base
UNION ALL SELECT root, src_path, 2 * seq, tokens FROM tree_events WHERE action = 'created'
UNION ALL SELECT root, dst_path, 2 * seq + 1, tokens FROM tree_events WHERE action = 'moved'"""
DEPS["births"] = ["tree_base", "tree_events"]

VIEWS["removals"] = """
SELECT root, src_path AS path, max(2 * seq) AS step FROM tree_events WHERE action IN ('deleted', 'moved') GROUP BY ALL"""
DEPS["removals"] = ["tree_events"]

VIEWS["applied"] = """
SELECT f.root, f.path, FALSE AS is_dir,
       coalesce((SELECT arg_max(m.tokens, m.seq) FROM tree_events m WHERE m.action = 'modified' AND m.root = f.root
                 AND m.src_path = f.path AND 2 * m.seq > f.birth), f.tokens, 0) AS token_count
FROM (SELECT b.root, b.path, min(b.step) AS birth, arg_min(b.tokens, b.step) AS tokens FROM births b
      WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE r.root = b.root AND r.step > b.step
                        AND (r.path = b.path OR starts_with(b.path, r.path || '/'))) GROUP BY ALL) f
UNION ALL
SELECT DISTINCT d.root, d.path, TRUE, 0
FROM (SELECT root, regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, max(step) AS step FROM births GROUP BY ALL) d
WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE r.root = d.root AND r.step > d.step
                  AND (r.path = d.path OR starts_with(d.path, r.path || '/')))"""
DEPS["applied"] = ["births", "removals", "tree_events"]

VIEWS["entries"] = """
SELECT root, seq, path, CASE WHEN diff > 0 THEN '+' ELSE '' END || CAST(diff AS VARCHAR) || ' tokens' AS change FROM tc
UNION ALL
SELECT root, seq, CASE WHEN action = 'moved' THEN dst_path ELSE src_path END,
       CASE action WHEN 'created' THEN 'added' WHEN 'deleted' THEN 'removed'
            ELSE 'renamed from ' || substr(src_path, length(root) + 2) END
FROM fs_events WHERE action IN ('created', 'deleted', 'moved')"""
DEPS["entries"] = ["tc", "fs_events"]

VIEWS["clog"] = """
SELECT root, path, min(seq) AS first_seq,
       string_agg(change, ', ' ORDER BY seq DESC) FILTER (WHERE k <= 5) AS changes
FROM (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY seq DESC) AS k FROM entries) GROUP BY ALL"""
DEPS["clog"] = ["entries"]


def _events(spark, sf):
    return TD.fs_events(spark, sf)


def _tree(spark, sf):
    """Base files and events for S3 (views tree_base, tree_events)."""
    ev = _events(spark, sf)
    base = ev.where("action = 'modified' and seq % 3 = 0").groupBy("root", F.col("src_path").alias("path")).agg(
        F.min_by("tokens", "seq").alias("token_count"))
    whole = (F.col("action") == "deleted") & (F.col("seq") % 7 == 0)
    return base, ev.withColumn("src_path", F.when(whole, P.dirname("src_path")).otherwise(F.col("src_path")))


@query("snapshot_diff", "A9 K3", with_views("""
WITH o AS (SELECT root, path, strlen(text) AS sz, sha256(text) AS h FROM old_files),
n AS (SELECT root, path, strlen(text) AS sz, sha256(text) AS h FROM new_files),
j AS (SELECT coalesce(o.root, n.root) AS root, coalesce(o.path, n.path) AS path, o.sz AS osz, n.sz AS nsz, o.h AS oh, n.h AS nh
      FROM o FULL JOIN n ON o.root = n.root AND o.path = n.path),
cr AS (SELECT root, path, nh AS h FROM j WHERE oh IS NULL),
de AS (SELECT root, path, oh AS h FROM j WHERE nh IS NULL),
cu AS (SELECT root, h, min(path) AS dst FROM cr GROUP BY ALL HAVING count(*) = 1),
du AS (SELECT root, h, min(path) AS src FROM de GROUP BY ALL HAVING count(*) = 1),
mv AS (SELECT cu.root, du.src, cu.dst FROM cu JOIN du ON cu.root = du.root AND cu.h = du.h)
SELECT root, 'created' AS action, path AS src_path, CAST(NULL AS VARCHAR) AS dst_path FROM cr WHERE path NOT IN (SELECT dst FROM mv)
UNION ALL SELECT root, 'deleted', path, NULL FROM de WHERE path NOT IN (SELECT src FROM mv)
UNION ALL SELECT root, 'modified', path, NULL FROM j WHERE oh IS NOT NULL AND nh IS NOT NULL AND (osz <> nsz OR oh <> nh)
UNION ALL SELECT root, 'moved', src, dst FROM mv""", "old_files", "new_files"))
def q_snapshot_diff(spark, sf):
    return EV.snapshot_diff(TD.old_files(spark, sf), TD.new_files(spark, sf))


def _glob_sql(col):
    c = " OR ".join(f"({col} GLOB '{p}' OR regexp_extract({col}, '([^/]*)$', 1) GLOB '{p}')" for p in IGNORE_GLOBS)
    return f"({c})"


@query("event_filter", "B12 A8", with_views(f"""
SELECT seq, action, src_path FROM fs_events WHERE NOT {_glob_sql('src_path')}""", "fs_events"))
def q_event_filter(spark, sf):
    return EV.filter_events(_events(spark, sf), IGNORE_GLOBS).select("seq", "action", "src_path")


@query("batch_events", "S1", with_views("""
WITH e AS (SELECT root, seq, action, src_path, epoch_us(ts) // 150000 AS b FROM fs_events WHERE action <> 'modified')
SELECT root, strftime(make_timestamp(b * 150000), '%Y-%m-%d %H:%M:%S.%g') AS batch_start, count(*) AS n_events,
       string_agg(action || ':' || src_path, ';' ORDER BY seq) AS events
FROM e GROUP BY root, b""", "fs_events"))
def q_batch_events(spark, sf):
    return EV.batch_events(_events(spark, sf))


@query("token_changes", "S2", with_views("SELECT root, seq, path, diff FROM tc", "tc"))
def q_token_changes(spark, sf):
    return EV.token_changes(_events(spark, sf))


@query("apply_events", "S3", with_views("SELECT root, path, is_dir, token_count FROM applied", "applied"))
def q_apply_events(spark, sf):
    return EV.apply_events(*_tree(spark, sf))


@query("drop_empty_parents", "S5", with_views("""
SELECT root, path, is_dir, token_count FROM applied WHERE NOT is_dir
UNION ALL
SELECT a.root, a.path, a.is_dir, a.token_count FROM applied a WHERE a.is_dir AND EXISTS (
  SELECT 1 FROM applied f WHERE NOT f.is_dir AND f.root = a.root AND starts_with(f.path, a.path || '/'))""", "applied"))
def q_drop_empty_parents(spark, sf):
    return EV.drop_empty_parents(EV.apply_events(*_tree(spark, sf)))


@query("debounce", "S6", with_views("""
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY root ORDER BY ts, seq) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS brk FROM fs_events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY root ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM e)
SELECT root, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS burst_start,
       strftime(max(ts) + INTERVAL 10 MINUTE, '%Y-%m-%d %H:%M:%S.%g') AS burst_end, count(*) AS n_events,
       max(seq) AS seq, arg_max(action, seq) AS action, arg_max(src_path, seq) AS src_path
FROM s GROUP BY root, sid""", "fs_events"))
def q_debounce(spark, sf):
    return EV.debounce(_events(spark, sf), "root", "10 minutes")


@query("change_log", "W3 R11 P6", with_views("""
SELECT root, path, first_seq, changes, substr(path, length(root) + 2) || '  (' || changes || ')' AS line FROM clog""", "clog"))
def q_change_log(spark, sf):
    ev = _events(spark, sf)
    return EV.change_log(EV.change_entries(ev, EV.token_changes(ev)))


@query("watched_changes", "J5", with_views("""
WITH w AS (SELECT DISTINCT src_path AS path FROM fs_events WHERE action = 'created')
SELECT c.root, c.path, c.first_seq, c.changes, w.path IS NOT NULL AS watched,
       CASE WHEN w.path IS NOT NULL THEN '⚠️ [WATCHED] ' ELSE '' END || substr(c.path, length(c.root) + 2) || '  (' || c.changes || ')' AS line
FROM clog c LEFT JOIN w ON w.path = c.path""", "clog", "fs_events"))
def q_watched_changes(spark, sf):
    ev = _events(spark, sf)
    log = EV.change_log(EV.change_entries(ev, EV.token_changes(ev)))
    sel = ev.where(F.col("action") == "created").select(F.col("src_path").alias("path")).distinct()
    return SEL.watched_changes(log, sel)


@query("event_summary", "G9", with_views("""
SELECT root, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%g') AS window_start,
       count(*) FILTER (WHERE action = 'created') AS n_created, count(*) FILTER (WHERE action = 'deleted') AS n_deleted,
       count(*) FILTER (WHERE action = 'modified') AS n_modified, count(*) FILTER (WHERE action = 'moved') AS n_moved,
       'Directory updated – ' || (count(*) FILTER (WHERE action = 'created') + count(*) FILTER (WHERE action = 'moved')) || ' added, '
       || (count(*) FILTER (WHERE action = 'deleted') + count(*) FILTER (WHERE action = 'moved')) || ' removed, '
       || count(*) FILTER (WHERE action = 'modified') || ' modified' AS message
FROM fs_events GROUP BY root, date_trunc('day', ts)""", "fs_events"))
def q_event_summary(spark, sf):
    return EV.event_summary(_events(spark, sf), "1 day")


@query("keep_selection_snapshot", "S4 A9 E5", with_views("""
WITH s AS (SELECT DISTINCT workspace AS root, workspace || '/' || path AS path FROM selections WHERE group_name = 'Default'),
o AS (SELECT root, path, sha256(text) AS h, strlen(text) AS sz FROM old_files),
n AS (SELECT root, path, sha256(text) AS h FROM new_files),
cr AS (SELECT n.root, n.path, n.h FROM n WHERE n.path NOT IN (SELECT path FROM o)),
de AS (SELECT o.root, o.path, o.h FROM o WHERE o.path NOT IN (SELECT path FROM n)),
cu AS (SELECT root, h, min(path) AS dst FROM cr GROUP BY ALL HAVING count(*) = 1),
du AS (SELECT root, h, min(path) AS src FROM de GROUP BY ALL HAVING count(*) = 1),
mv AS (SELECT cu.root, du.src, cu.dst FROM cu JOIN du ON cu.root = du.root AND cu.h = du.h),
kept AS (SELECT o.root, o.path, o.path IN (SELECT path FROM s) AS selected FROM o
         WHERE o.path NOT IN (SELECT path FROM de))
SELECT root, path, selected FROM kept
UNION ALL SELECT mv.root, mv.dst, mv.src IN (SELECT path FROM s) FROM mv
UNION ALL SELECT root, path, FALSE FROM cr WHERE path NOT IN (SELECT dst FROM mv)""", "old_files", "new_files", "selections"))
def q_keep_selection_snapshot(spark, sf):
    old = TD.old_files(spark, sf)
    ev = EV.snapshot_diff(old, TD.new_files(spark, sf))
    sel = TD.selections(spark, sf).where(F.col("group_name") == "Default").select(
        F.col("workspace").alias("root"), F.concat("workspace", F.lit("/"), "path").alias("path"))
    return EV.keep_selection_snapshot(old.select("root", "path"), sel, ev)


# Of the moves, two in five take a whole user folder along (to the next user's, into old/), one in five all of old/ (to back/)
VIEWS["folder_events"] = """
SELECT root, seq, action,
       CASE WHEN action = 'moved' AND seq % 5 = 2 THEN root || '/old'
            WHEN action = 'moved' AND seq % 5 < 2 OR action = 'deleted' AND seq % 7 = 0 THEN regexp_extract(src_path, '^(.*)/[^/]*$', 1)
            ELSE src_path END AS src_path,
       CASE WHEN action <> 'moved' THEN NULL WHEN seq % 5 = 2 THEN root || '/back'
            WHEN seq % 5 = 1 THEN root || '/old/' || regexp_extract(src_path, '([^/]+)/[^/]*$', 1)
            WHEN seq % 5 = 0 THEN root || '/u' || lpad(CAST((CAST(regexp_extract(src_path, 'u(\\d+)/[^/]*$', 1) AS INTEGER) + 1) % 40 AS VARCHAR), 3, '0')
            ELSE dst_path END AS dst_path FROM fs_events"""
DEPS["folder_events"] = ["fs_events"]


def _folder_events(spark, sf):
    """Events for S4 (view folder_events)."""
    ev = _events(spark, sf).select("root", "seq", "action", "src_path", "dst_path")
    moved, k, folder = F.col("action") == "moved", F.col("seq") % 5, P.dirname("src_path")
    user = P.basename(folder)
    following = F.lpad(((F.substring(user, 2, 3).cast("int") + 1) % 40).cast("string"), 3, "0")
    src = (F.when(moved & (k == 2), F.concat("root", F.lit("/old")))
           .when(moved & (k < 2) | (F.col("action") == "deleted") & (F.col("seq") % 7 == 0), folder).otherwise(F.col("src_path")))
    dst = (F.when(~moved, None).when(k == 2, F.concat("root", F.lit("/back"))).when(k == 1, F.concat("root", F.lit("/old/"), user))
           .when(k == 0, F.concat("root", F.lit("/u"), following)).otherwise(F.col("dst_path")))
    return ev.select("root", "seq", "action", src.alias("src_path"), dst.alias("dst_path"))


# S4 oracle: the sequential rule itself, one recursive step per event, a map of the present files as the state
@query("apply_events_keep_selection", "S4", with_views("""
SELECT root, path, selected FROM (
  WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY seq) AS rn FROM folder_events WHERE action <> 'modified'),
  walk(root, rn, state) AS (
    SELECT r.root, 0::BIGINT, (SELECT map_from_entries(list({'k': path, 'v': token_count % 2 = 0})) FROM tree_base b WHERE b.root = r.root)
    FROM (SELECT DISTINCT root FROM tree_base) r
    UNION ALL
    SELECT w.root, w.rn + 1,
      CASE e.action
        WHEN 'created' THEN CASE WHEN w.state[e.src_path] IS NULL THEN map_concat(w.state, MAP {e.src_path: FALSE}) ELSE w.state END
        WHEN 'deleted' THEN map_from_entries(list_filter(map_entries(w.state), lambda x: x.key <> e.src_path AND NOT starts_with(x.key, e.src_path || '/')))
        ELSE map_concat(
          map_from_entries(list_filter(map_entries(w.state), lambda x: x.key <> e.src_path AND NOT starts_with(x.key, e.src_path || '/'))),
          map_from_entries(list_transform(list_filter(map_entries(w.state), lambda x: x.key = e.src_path OR starts_with(x.key, e.src_path || '/')),
                                          lambda x: {'k': e.dst_path || substr(x.key, length(e.src_path) + 1), 'v': x.value}))) END
    FROM walk w JOIN ev e ON e.root = w.root AND e.rn = w.rn + 1),
  final AS (SELECT w.root, unnest(map_entries(state)) AS x FROM walk w JOIN (SELECT root, max(rn) AS rn FROM walk GROUP BY root) m USING (root, rn))
  SELECT root, x.key AS path, x.value AS selected FROM final)""", "folder_events", "tree_base"))
def q_apply_events_keep_selection(spark, sf):
    """S4 over the event table, folder moves and deletes included; the base files' selected ones have an even count."""
    base, _ = _tree(spark, sf)
    return EV.apply_events_keep_selection(base.select("root", "path"), base.where("token_count % 2 = 0").select("root", "path"), _folder_events(spark, sf))
