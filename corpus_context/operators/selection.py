"""Selections: groups (E1-E5), drift (D1-D3), active selection (J3), watched
changes (J5), live workspaces (J6), token cache (T5, T6), estimator check (T7).

All are joins and anti-joins on (workspace, group, path): the selection
tables are keyed, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import tokens as TK


def selected_files(ws: DataFrame, sel: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Paths of each workspace's active group; unset, or not among the workspace's groups -> 'Default';
    no folder -> no rows. The groups are ``groups(workspace, group_name)``, by default those of ``sel`` and of
    the workspace's own ``selection_groups``.

    -> (workspace, root, group_name, rel, path) with path absolute (P3).
    """
    w = ws.where(F.col("folder_path").isNotNull() & (F.col("folder_path") != "")).select(
        "workspace", F.col("folder_path").alias("root"),
        F.coalesce(F.col("active_selection_group"), F.lit("Default")).alias("group_name"),
        *([F.col("selection_groups")] if "selection_groups" in ws.columns and groups is None else []))
    there = (sel if groups is None else groups).select("workspace", "group_name").distinct().withColumn("_there", F.lit(True))
    known = F.coalesce("_there", F.lit(False))
    if "selection_groups" in w.columns:
        known = known | F.coalesce(F.map_contains_key("selection_groups", F.col("group_name")), F.lit(False))
    w = w.join(there, ["workspace", "group_name"], "left").select(
        "workspace", "root", F.when(known, F.col("group_name")).otherwise("Default").alias("group_name"))
    j = sel.select("workspace", "group_name", F.col("path").alias("rel")).distinct().join(w, ["workspace", "group_name"])
    return j.select("workspace", "root", "group_name", "rel", P.to_absolute("rel", "root").alias("path"))


def load_groups(ws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and their absolute paths; a workspace without groups gets 'Default' / 'Default selection'.

    -> (groups(workspace, group_name, description, last_updated), selections(workspace, group_name, path)).
    """
    g = ws.select("workspace", "folder_path", F.explode_outer("selection_groups").alias("group_name", "g"))
    has = g.where(F.col("group_name").isNotNull())
    groups = has.select("workspace", "group_name", F.col("g.description").alias("description"),
                        F.col("g.last_updated").alias("last_updated"))
    default = ws.select("workspace").join(has.select("workspace").distinct(), "workspace", "left_anti").select(
        "workspace", F.lit("Default").alias("group_name"), F.lit("Default selection").alias("description"),
        F.lit(None).cast("double").alias("last_updated"))
    paths = has.select("workspace", "folder_path", "group_name", F.explode("g.checked_paths").alias("rel")).select(
        "workspace", "group_name", P.to_absolute("rel", "folder_path").alias("path"))
    return groups.unionByName(default), paths


def upsert_group(groups: DataFrame, sel: DataFrame, updates: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Save paths into a group: relative (P2), distinct, sorted; last_updated = now; replaces the group.

    updates(workspace, group_name, path, now) one row per path (absolute or relative); a row with a null
    path only names the group, so a group saved empty is one such row;
    roots(workspace, root). A new group gets the description '{name} selection'.
    -> (groups, selections(workspace, group_name, rel)).
    """
    u = updates.join(roots, "workspace")
    keys = u.select("workspace", "group_name").distinct()
    now = u.groupBy("workspace", "group_name").agg(F.max("now").alias("now"))
    u = u.where(F.col("path").isNotNull()).select("workspace", "group_name", "now", P.to_relative(P.to_absolute("path", "root"), "root").alias("rel"))
    kept_groups = groups.join(keys, ["workspace", "group_name"], "left_anti")
    upd_groups = now.join(groups.select("workspace", "group_name", "description"), ["workspace", "group_name"], "left").select(
        "workspace", "group_name",
        F.coalesce("description", F.concat(F.col("group_name"), F.lit(" selection"))).alias("description"),
        F.col("now").alias("last_updated"))
    kept_sel = sel.join(keys, ["workspace", "group_name"], "left_anti")
    new_sel = u.select("workspace", "group_name", F.col("rel").alias("path")).distinct()
    return kept_groups.unionByName(upd_groups), kept_sel.unionByName(new_sel)


def delete_groups(groups: DataFrame, sel: DataFrame, ws: DataFrame, names: DataFrame):
    """Remove groups by name; 'Default' is protected; unknown names ignored; a deleted active group
    falls back to 'Default'. names(workspace, group_name)."""
    d = names.where(F.col("group_name") != "Default").select("workspace", "group_name").distinct()
    g = groups.join(d, ["workspace", "group_name"], "left_anti")
    s = sel.join(d, ["workspace", "group_name"], "left_anti")
    act = ws.join(d.withColumn("_del", F.lit(True)).withColumnRenamed("group_name", "active_selection_group"),
                  ["workspace", "active_selection_group"], "left")
    act = act.withColumn("active_selection_group",
                         F.when(F.col("_del"), F.lit("Default")).otherwise(F.col("active_selection_group"))).drop("_del")
    return g, s, act


def selection_dirty(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Per (workspace, group) whether the current selection differs from the saved one."""
    k = ["workspace", "group_name", "path"]
    a = current.select(*k).distinct()
    b = saved.select(*k).distinct()
    diff = a.exceptAll(b).unionByName(b.exceptAll(a))
    keys = a.select("workspace", "group_name").union(b.select("workspace", "group_name")).distinct()
    d = diff.groupBy("workspace", "group_name").agg(F.count(F.lit(1)).alias("n_diff"))
    return keys.join(d, ["workspace", "group_name"], "left").select(
        "workspace", "group_name", F.coalesce("n_diff", F.lit(0)).alias("n_diff"),
        (F.coalesce("n_diff", F.lit(0)) > 0).alias("dirty"))


def drift_missing(sel_abs: DataFrame, files: DataFrame) -> DataFrame:
    """Selected paths no longer present. sel_abs(workspace, group_name, path)."""
    return sel_abs.join(files.select("path"), "path", "left_anti").select("workspace", "group_name", "path")


def drift_new(sel_abs: DataFrame, groups: DataFrame, files: DataFrame) -> DataFrame:
    """Files directly in the folder of some selected path, not selected, with
    mtime > last_updated + 1 s (strict); only groups having last_updated."""
    g = groups.where(F.col("last_updated").isNotNull()).select("workspace", "group_name", "last_updated")
    dirs = sel_abs.join(g, ["workspace", "group_name"]).select(
        "workspace", "group_name", "last_updated", P.dirname("path").alias("dir")).distinct()
    f = files.select("path", "mtime", P.dirname("path").alias("dir"))
    cand = dirs.join(f, "dir").where(F.col("mtime") > F.col("last_updated") + F.expr("INTERVAL 1 SECOND"))
    cand = cand.select("workspace", "group_name", "path")
    return cand.join(sel_abs.select("workspace", "group_name", "path"), ["workspace", "group_name", "path"], "left_anti").distinct()


def resolve_drift(sel_abs: DataFrame, missing: DataFrame, new: DataFrame, accept: bool | Column = True) -> tuple[DataFrame, DataFrame]:
    """D3: (selection - missing) + new when accepted, else unchanged; plus a message per group.
    ``accept`` is for all groups, or a Column over (workspace, group_name); null is no."""
    k = ["workspace", "group_name", "path"]
    yes = F.coalesce(accept if isinstance(accept, Column) else F.lit(bool(accept)), F.lit(False))
    gone = missing.select(*k).where(yes)
    out = sel_abs.select(*k).join(gone, k, "left_anti").unionByName(new.select(*k).where(yes)).distinct()
    nm = missing.groupBy("workspace", "group_name").agg(F.count(F.lit(1)).alias("n_missing"))
    nn = new.groupBy("workspace", "group_name").agg(F.count(F.lit(1)).alias("n_new"))
    msg = nm.join(nn, ["workspace", "group_name"], "full").fillna(0, ["n_missing", "n_new"])
    text = F.concat(
        F.lit("Repo changes detected since this group was last saved:\n\n"),
        F.when(F.col("n_missing") > 0, F.concat(F.lit("❌ "), F.col("n_missing").cast("string"),
                                                 F.lit(" selected files have been deleted.\n"))).otherwise(F.lit("")),
        F.when(F.col("n_new") > 0, F.concat(F.lit("🆕 "), F.col("n_new").cast("string"),
                                             F.lit(" new files added to selected folders.\n"))).otherwise(F.lit("")),
        F.lit("\nDo you want to update the selection?"))
    return out, msg.select("workspace", "group_name", "n_missing", "n_new", text.alias("message"))


def watched_changes(log: DataFrame, sel_abs: DataFrame) -> DataFrame:
    """Flag change-log lines of selected files with the prefix '⚠️ [WATCHED] '."""
    s = sel_abs.select("path").distinct().withColumn("_w", F.lit(True))
    j = log.join(s, "path", "left")
    w = F.coalesce("_w", F.lit(False))
    return j.withColumn("watched", w).withColumn(
        "line", F.concat(F.when(w, F.lit("⚠️ [WATCHED] ")).otherwise(F.lit("")), F.col("line"))).drop("_w")


def live_events(events: DataFrame, ws: DataFrame) -> DataFrame:
    """Keep events of workspaces with a folder and live_watcher true (a missing flag counts as true).

    The workspace table is small next to an event stream; the join also works stream-static.
    """
    w = ws.where(F.col("folder_path").isNotNull() & (F.col("folder_path") != "")).where(
        F.coalesce(F.col("scan_settings.live_watcher"), F.lit(True))).select(F.col("folder_path").alias("root")).distinct()
    return events.join(w, "root", "left_semi")


def lookup_tokens(paths: DataFrame, cache: DataFrame, files: DataFrame, estimator="chars4") -> tuple[DataFrame, DataFrame]:
    """T5: cached count when present and > 0, else count now and add to the cache.

    paths(path) ; cache(path, tokens) ; files(path, text|content). -> (result(path, tokens, cached), new cache).
    """
    from corpus_context.functions.text import read_text

    est = TK.estimator(estimator)
    p = paths.select("path").distinct()
    hit = p.join(cache.where(F.col("tokens") > 0).select("path", "tokens"), "path")
    miss = p.join(hit.select("path"), "path", "left_anti")
    f = files.join(miss, "path", "left_semi")
    counted = f.select("path", est(read_text(f, newline="universal")).alias("tokens"))
    missing_file = miss.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("tokens"))
    now = counted.unionByName(missing_file)
    result = hit.withColumn("cached", F.lit(True)).unionByName(now.withColumn("cached", F.lit(False)))
    new_cache = cache.join(now.select("path"), "path", "left_anti").unionByName(now.select("path", "tokens"))
    return result, new_cache


def invalidate_cache(cache: DataFrame, events: DataFrame) -> DataFrame:
    """Drop cached counts of the source path of deleted, moved and modified events."""
    gone = events.where(F.col("action").isin("deleted", "moved", "modified")).select(F.col("src_path").alias("path")).distinct()
    return cache.join(gone, "path", "left_anti")


def compare_estimators(files: DataFrame, a="chars4", b="words_chars4") -> tuple[DataFrame, DataFrame]:
    """Per file both counts and their difference; per root the totals and whether they agree."""
    from corpus_context.functions.text import read_text

    ea, eb = TK.estimator(a), TK.estimator(b)
    t = read_text(files, newline="universal")
    per = files.select("root", "path", ea(t).alias("a"), eb(t).alias("b")).withColumn("diff", F.col("a") - F.col("b"))
    tot = per.groupBy("root").agg(F.sum("a").cast("long").alias("total_a"), F.sum("b").cast("long").alias("total_b"))
    tot = tot.withColumn("consistent", F.col("total_a") == F.col("total_b"))
    return per, tot
