"""File events, batch form: snapshot diff (A9), event filter (B12), batching (S1),
token changes (S2), table after events (S3, S4, S5), debounce (S6), change
log (W3, R11), event summary (G9).

Event order is always ``seq``, never arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.operators.moves import apply_events_keep_selection  # noqa: F401  (S4)
from corpus_context.session import cut_lineage

TS_FMT = "yyyy-MM-dd HH:mm:ss.SSS"


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots -> created / deleted / modified / moved events.

    modified: same path, different size or SHA-256. moved: a deleted and a
    created file with identical content hash, the hash unique on both sides;
    the pair replaces its deleted + created rows.
    """
    o = old.select("root", "path", F.col("size").alias("o_size"), F.sha2(F.col("content"), 256).alias("o_h"))
    n = new.select("root", "path", F.col("size").alias("n_size"), F.sha2(F.col("content"), 256).alias("n_h"))
    j = cut_lineage(o.join(n, ["root", "path"], "full"))  # sizes and hashes: each side's content is read once
    created = j.where(F.col("o_h").isNull()).select("root", "path", F.col("n_h").alias("h"))
    deleted = j.where(F.col("n_h").isNull()).select("root", "path", F.col("o_h").alias("h"))
    modified = j.where(F.col("o_h").isNotNull() & F.col("n_h").isNotNull() &
                       ((F.col("o_size") != F.col("n_size")) | (F.col("o_h") != F.col("n_h"))))
    cu = created.groupBy("root", "h").agg(F.count(F.lit(1)).alias("c"), F.first("path").alias("dst"))
    du = deleted.groupBy("root", "h").agg(F.count(F.lit(1)).alias("c"), F.first("path").alias("src"))
    moves = cu.where("c = 1").select("root", "h", "dst").join(du.where("c = 1").select("root", "h", "src"), ["root", "h"])
    cr = created.join(moves.select("root", F.col("dst").alias("path")), ["root", "path"], "left_anti")
    de = deleted.join(moves.select("root", F.col("src").alias("path")), ["root", "path"], "left_anti")
    ev = (cr.select("root", F.lit("created").alias("action"), F.col("path").alias("src_path"), F.lit(None).cast("string").alias("dst_path"))
          .unionByName(de.select("root", F.lit("deleted").alias("action"), F.col("path").alias("src_path"), F.lit(None).cast("string").alias("dst_path")))
          .unionByName(modified.select("root", F.lit("modified").alias("action"), F.col("path").alias("src_path"), F.lit(None).cast("string").alias("dst_path")))
          .unionByName(moves.select("root", F.lit("moved").alias("action"), F.col("src").alias("src_path"), F.col("dst").alias("dst_path"))))
    return ev


def filter_events(events: DataFrame, patterns, component_match: bool = False) -> DataFrame:
    """Drop events whose source path matches an ignore glob."""
    return events.where(~R.event_ignored("src_path", patterns, component_match))


def batch_events(events: DataFrame, every: str = "150 milliseconds") -> DataFrame:
    """Fixed batches of all but 'modified' events, in seq order within a batch."""
    e = events.where(F.col("action") != "modified")
    g = e.groupBy("root", F.window("ts", every).alias("w")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "action", "src_path"))).alias("evs"))
    return g.select("root", F.date_format("w.start", TS_FMT).alias("batch_start"), F.size("evs").alias("n_events"),
                    F.array_join(F.transform("evs", lambda x: F.concat(x["action"], F.lit(":"), x["src_path"])), ";").alias("events"))


def token_flow(events: DataFrame, cache: DataFrame | None = None, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S2 without a replay: (root, seq, path, diff) and the cache after the events, (root, path, tokens).

    ``cache`` is the one before. A path's events in seq order are its touches: a count seen (M), forgotten (D),
    moved out (O) or moved in (I). What a path holds follows from its last touch, and only I asks further: it holds
    what the source held or, if that was nothing, what the target held. Each touch is asked by the next one alone,
    so the moved-in touches form trees, which moves.settle answers by pointer doubling. Its steps, log2 of the longest
    chain of moves, are written to ``scratch``."""
    from corpus_context.operators.moves import settle, writer

    spark = events.sparkSession if cache is None else cache.sparkSession
    cut = writer(spark, scratch)

    act = F.col("action")
    e = events.select("root", F.col("seq").cast("long").alias("seq"), "action", "src_path", "dst_path", F.col("tokens").cast("long").alias("tokens"))
    e = e.where((act == "modified") | (act == "deleted") | ((act == "moved") & ~F.col("src_path").eqNullSafe(F.col("dst_path"))))
    if cache is not None:
        none = F.lit(None).cast("string")
        e = e.unionByName(cache.select("root", F.lit(None).cast("long").alias("seq"), F.lit("modified").alias("action"),
                                       F.col("path").alias("src_path"), none.alias("dst_path"), "tokens"))
    e = cut(e.withColumn("eid", F.monotonically_increasing_id()))
    side = lambda path, kind: F.struct(F.col(path).alias("path"), F.lit(kind).alias("kind"))
    t = e.select("root", "seq", "eid", F.when(act == "modified", F.col("tokens")).alias("tokens"), F.explode(
        F.when(act == "moved", F.array(side("src_path", "O"), side("dst_path", "I")))
        .when(act == "deleted", F.array(side("src_path", "D"))).otherwise(F.array(side("src_path", "M")))).alias("t"))
    t = t.select("root", "seq", "eid", "tokens", "t.path", "t.kind")
    w = Window.partitionBy("root", "path").orderBy(F.col("seq").asc_nulls_first(), "eid")
    moved_in = F.lag("kind").over(w) == "I"
    t = cut(t.withColumns({"held": F.lag("tokens").over(w), "asks": F.when(moved_in, F.lag("eid").over(w)),
                           "last": F.lead("eid").over(w).isNull()}))

    def of(kind, col):
        return F.max(F.when(F.col("kind") == kind, F.col(col)))

    moves = cut(t.where("kind in ('O', 'I')").groupBy("eid").agg(
        of("O", "held").alias("src"), of("O", "asks").alias("src_asks"), of("I", "held").alias("dst"), of("I", "asks").alias("dst_asks")))
    taken = settle(moves, cut).withColumnRenamed("value", "count")
    m = t.where("kind = 'M'")
    counts = taken.select(F.col("eid").alias("asks"), "count")
    seen = m.where("asks is null").select("root", "seq", "path", (F.col("tokens") - F.col("held")).alias("diff")).unionByName(
        m.where("asks is not null").join(counts, "asks").select("root", "seq", "path", (F.col("tokens") - F.col("count")).alias("diff")))
    after = t.where("last and kind = 'M'").select("root", "path", "tokens").unionByName(
        t.where("last and kind = 'I'").join(taken, "eid").select("root", "path", F.col("count").alias("tokens")))
    return seen.where("diff <> 0"), after.where("tokens is not null")


def token_changes(events: DataFrame) -> DataFrame:
    """Per 'modified' event the token difference to the last observed count of that path.

    The first observation gives no output, zero diffs are dropped, 'deleted'
    forgets the path, 'moved' hands the remembered count to the destination,
    'created' does not seed.
    """
    return token_flow(events)[0]


def token_changes_no_moves(events: DataFrame) -> DataFrame:
    """S2 for event sets without moves: a declarative form (lag over path, reset by deletes)."""
    e = events.where(F.col("action").isin("modified", "deleted")).select("root", "seq", "action", F.col("src_path").alias("path"), "tokens")
    w = Window.partitionBy("root", "path").orderBy("seq")
    e = e.withColumn("epoch", F.sum(F.when(F.col("action") == "deleted", 1).otherwise(0)).over(w))
    m = e.where(F.col("action") == "modified")
    w2 = Window.partitionBy("root", "path", "epoch").orderBy("seq")
    m = m.withColumn("prev", F.lag("tokens").over(w2))
    return m.where(F.col("prev").isNotNull() & (F.col("tokens") != F.col("prev"))).select(
        "root", "seq", "path", (F.col("tokens") - F.col("prev")).alias("diff"))


def apply_events(base: DataFrame, events: DataFrame) -> DataFrame:
    """S3: files and folders after the events. base(root, path, token_count[, is_dir]); folders in it count as there.

    created adds a path with the event's count and does nothing where the path is present; deleted removes the
    path and everything below; moved is a delete of the source, then a creation of the target; modified only
    sets the count of a present file. Parent folders come with what is created below and stay when it goes; a
    path that is such a folder is not a file.

    Without a replay: only the last removal of a path or of a folder above it matters, and a path is present
    if it was created (or a folder's content was) after that. The first such creation gives the count.
    """
    e = events.select("root", F.col("seq").cast("long").alias("seq"), "action", "src_path", "dst_path", "tokens")

    def ord_at(seq, step):  # a move's removal comes before its creation
        return F.struct(seq.alias("seq"), F.lit(step).alias("step")).alias("ord")

    first = ord_at(F.lit(-(1 << 63)).cast("long"), 0)
    folders = base.where("is_dir").select("root", "path", first) if "is_dir" in base.columns else None
    base = base.where("not is_dir") if "is_dir" in base.columns else base
    births = (base.select("root", "path", first, F.col("token_count").cast("long").alias("tokens"))
              .unionByName(e.where(F.col("action") == "created").select(
                  "root", F.col("src_path").alias("path"), ord_at(F.col("seq"), 0), F.col("tokens").cast("long").alias("tokens")))
              .unionByName(e.where(F.col("action") == "moved").select(
                  "root", F.col("dst_path").alias("path"), ord_at(F.col("seq"), 1), F.col("tokens").cast("long").alias("tokens"))))
    removals = e.where(F.col("action").isin("deleted", "moved")).groupBy("root", F.col("src_path").alias("up")).agg(
        F.max(ord_at(F.col("seq"), 0)).alias("removed"))
    above = births.select("root", F.explode(P.ancestors("path", "root")).alias("path"), "ord").where(F.col("path") != F.col("root"))
    above = above if folders is None else above.unionByName(folders)
    dirs = above.groupBy("root", "path").agg(F.max("ord").alias("ord"))
    nodes = births.select("root", "path").unionByName(dirs.select("root", "path")).distinct()
    chain = nodes.select("root", "path", F.explode(F.array_union(P.ancestors("path", "root"), F.array("path"))).alias("up"))
    removed = chain.join(removals, ["root", "up"]).groupBy("root", "path").agg(F.max("removed").alias("removed"))

    def present(df):
        return df.join(removed, ["root", "path"], "left").where(F.col("removed").isNull() | (F.col("ord") > F.col("removed")))

    dirs = present(dirs).select("root", "path")
    files = present(births).groupBy("root", "path").agg(F.min("ord").alias("birth"), F.min_by("tokens", "ord").alias("tokens"))
    files = files.join(dirs, ["root", "path"], "left_anti")
    changes = e.where(F.col("action") == "modified").select("root", F.col("src_path").alias("path"), ord_at(F.col("seq"), 0),
                                                            F.col("tokens").cast("long").alias("new_tokens"))
    latest = files.select("root", "path", "birth").join(changes, ["root", "path"]).where(F.col("ord") > F.col("birth")).groupBy(
        "root", "path").agg(F.max_by("new_tokens", "ord").alias("new_tokens"))
    files = files.join(latest, ["root", "path"], "left").select(
        "root", "path", F.lit(False).alias("is_dir"), F.coalesce("new_tokens", "tokens", F.lit(0)).cast("long").alias("token_count"))
    return files.unionByName(dirs.select("root", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("token_count")))


def drop_empty_parents(items: DataFrame) -> DataFrame:
    """Folders with no file below disappear (the root stays)."""
    files = items.where(~F.col("is_dir"))
    live = files.select("root", F.explode(P.ancestors("path", "root")).alias("path")).distinct()
    dirs = items.where(F.col("is_dir")).join(live, ["root", "path"], "left_semi")
    return files.unionByName(dirs)


def debounce(events: DataFrame, key: str = "root", gap: str = "500 milliseconds") -> DataFrame:
    """A burst (events closer than ``gap``) collapses into its last event.

    Sessions without a per-key window: events are ranked in (ts, seq) order per key, each meets its predecessor by an equi-join on rank - 1, a gap of at least ``gap`` opens a
    session, and the session number is a blocked running count of those openings."""
    from corpus_context.operators.pack import blocked_running_sum, ranked

    e = events.select(key, "seq", "ts", "action", "src_path")
    r = ranked(e.withColumnRenamed(key, "context_id"), ["ts", "seq"]).withColumnRenamed("context_id", key)
    prev = r.select(key, (F.col("rank") + 1).alias("rank"), F.col("ts").alias("prev_ts"))
    j = r.join(prev, [key, "rank"], "left")
    opens = F.when(F.col("prev_ts").isNull() | (F.col("ts") - F.col("prev_ts") >= F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    j = blocked_running_sum(j.withColumn("_open", opens), [key], "_open", "session")
    g = j.groupBy(key, "session").agg(
        F.min("ts").alias("s0"), F.max("ts").alias("s1"), F.count(F.lit(1)).alias("n_events"),
        F.max_by(F.struct("seq", "action", "src_path"), "seq").alias("last"))
    return g.select(key, F.date_format("s0", TS_FMT).alias("burst_start"),
                    F.date_format(F.col("s1") + F.expr(f"INTERVAL {gap}"), TS_FMT).alias("burst_end"),
                    "n_events", F.col("last.seq").alias("seq"), F.col("last.action").alias("action"),
                    F.col("last.src_path").alias("src_path"))


def debounce_session_window(events: DataFrame, key: str = "root", gap: str = "500 milliseconds") -> DataFrame:
    """S6 with Spark's session windows (the form the stream uses, with a watermark)."""
    g = events.groupBy(key, F.session_window("ts", gap).alias("s")).agg(
        F.max_by(F.struct("seq", "action", "src_path"), "seq").alias("last"), F.count(F.lit(1)).alias("n_events"))
    return g.select(key, F.date_format("s.start", TS_FMT).alias("burst_start"), F.date_format("s.end", TS_FMT).alias("burst_end"),
                    "n_events", F.col("last.seq").alias("seq"), F.col("last.action").alias("action"),
                    F.col("last.src_path").alias("src_path"))


def change_entries(events: DataFrame, diffs: DataFrame) -> DataFrame:
    """Change-log entries: token diffs ('+5 tokens' / '-3 tokens') and structural events
    ('added', 'removed', 'renamed from {rel}' on the destination)."""
    d = diffs.where(F.col("diff") != 0).select(
        "root", "seq", "path", F.concat(F.when(F.col("diff") > 0, F.lit("+")).otherwise(F.lit("")),
                                        F.col("diff").cast("string"), F.lit(" tokens")).alias("change"))
    s = events.where(F.col("action").isin("created", "deleted", "moved")).select(
        "root", "seq",
        F.when(F.col("action") == "moved", F.col("dst_path")).otherwise(F.col("src_path")).alias("path"),
        F.when(F.col("action") == "created", F.lit("added")).when(F.col("action") == "deleted", F.lit("removed"))
        .otherwise(F.concat(F.lit("renamed from "), P.display_path("src_path", "root"))).alias("change"))
    return d.unionByName(s)


def change_log(entries: DataFrame, n: int = 5) -> DataFrame:
    """W3 + R11: per path the last n changes, newest first, and its display line."""
    from corpus_context.operators.topk import top_k_per_key

    first = entries.groupBy("root", "path").agg(F.min("seq").alias("first_seq"))
    last = top_k_per_key(entries, ["root", "path"], [F.col("seq").desc()], n, ["seq"])
    g = last.groupBy("root", "path").agg(F.sort_array(F.collect_list(F.struct("k", "change"))).alias("cs"))
    g = g.join(first, ["root", "path"])
    g = g.withColumn("changes", F.array_join(F.transform("cs", lambda x: x["change"]), ", "))
    return g.select("root", "path", "first_seq", "changes",
                    F.concat(P.display_path("path", "root"), F.lit("  ("), F.col("changes"), F.lit(")")).alias("line"))


def event_summary(events: DataFrame, every: str = "1 day") -> DataFrame:
    """Per window added / removed / modified / moved counts and the summary line
    (a move counts as one removal and one addition)."""
    g = events.groupBy("root", F.window("ts", every).alias("w")).agg(
        F.count_if(F.col("action") == "created").alias("n_created"),
        F.count_if(F.col("action") == "deleted").alias("n_deleted"),
        F.count_if(F.col("action") == "modified").alias("n_modified"),
        F.count_if(F.col("action") == "moved").alias("n_moved"))
    a = F.col("n_created") + F.col("n_moved")
    r = F.col("n_deleted") + F.col("n_moved")
    return g.select("root", F.date_format("w.start", TS_FMT).alias("window_start"), "n_created", "n_deleted", "n_modified", "n_moved",
                    F.concat(F.lit("Directory updated – "), a.cast("string"), F.lit(" added, "), r.cast("string"),
                             F.lit(" removed, "), F.col("n_modified").cast("string"), F.lit(" modified")).alias("message"))


def keep_selection_snapshot(items: DataFrame, sel: DataFrame, events: DataFrame) -> DataFrame:
    """S4 / E5 for a snapshot diff (each path in at most one event, as A9 produces): pure joins.

    Deleted and moved-out paths leave; a moved-in path takes the selected state of its source;
    created paths come in unselected. -> (root, path, selected)."""
    s = sel.select("root", "path").distinct().withColumn("_s", F.lit(True))
    gone = events.where(F.col("action").isin("deleted", "moved")).select("root", F.col("src_path").alias("path"))
    kept = items.select("root", "path").join(gone, ["root", "path"], "left_anti").join(s, ["root", "path"], "left")
    kept = kept.select("root", "path", F.coalesce("_s", F.lit(False)).alias("selected"))
    mv = events.where(F.col("action") == "moved").select("root", F.col("src_path").alias("path"), F.col("dst_path").alias("dst"))
    moved = mv.join(s, ["root", "path"], "left").select("root", F.col("dst").alias("path"),
                                                       F.coalesce("_s", F.lit(False)).alias("selected"))
    new = events.where(F.col("action") == "created").select("root", F.col("src_path").alias("path"), F.lit(False).alias("selected"))
    return kept.unionByName(moved).unionByName(new)
