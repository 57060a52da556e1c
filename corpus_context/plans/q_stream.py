"""Registered queries that run the streaming forms to completion over the event table.

The event table is written as four files in seq order into the shared
checkpoint folder; the stream reads one file per micro-batch, so state and
watermarks are exercised across batches. The results are compared with the
same oracle as the batch forms.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from corpus_context.plans import q_events  # (registers the event views)
from corpus_context.plans.oracle_views import with_views
from corpus_context.plans.registry import QUERIES, query
from corpus_context.session import checkpoint_dir
from corpus_context.sources import testdata as TD
from corpus_context.sources.files import fs_event_source
from corpus_context.streaming import live as L

N_FILES = 4


def _event_files(spark, sf, ev=None):
    """Write the events (fs_events) as N_FILES parquet files, one seq range each, in order; return the folder."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex[:12]}")
    ev = (TD.fs_events(spark, sf) if ev is None else ev).withColumn("ts", F.col("ts").cast("timestamp"))
    b = ev.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    lo, hi = int(b["lo"]), int(b["hi"])
    step = (hi - lo) // N_FILES + 1
    src = os.path.join(base, "in")
    for i in range(N_FILES):
        part = ev.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(src)
    return base, src


@query("stream_token_changes", "A8 S2 (stream)", QUERIES["token_changes"].sql)
def q_stream_token_changes(spark, sf):
    base, src = _event_files(spark, sf)
    ev = fs_event_source(spark, src, max_files_per_trigger=1)
    L.run_append(L.token_changes_stream(ev), os.path.join(base, "out"), os.path.join(base, "ckpt"))
    return spark.read.parquet(os.path.join(base, "out")).select("root", "seq", "path", "diff")


@query("stream_batch_events", "A8 S1 (stream)", QUERIES["batch_events"].sql)
def q_stream_batch_events(spark, sf):
    base, src = _event_files(spark, sf)
    ev = L.with_event_time(fs_event_source(spark, src, max_files_per_trigger=1), "1 hour")
    out = os.path.join(base, "out")
    L.run_versioned(L.batch_events_stream(ev), out, os.path.join(base, "ckpt"))
    return L.latest_versions(spark, out, ["root", "batch_start"])


@query("stream_event_summary", "A8 G9 (stream)", QUERIES["event_summary"].sql)
def q_stream_event_summary(spark, sf):
    base, src = _event_files(spark, sf)
    ev = L.with_event_time(fs_event_source(spark, src, max_files_per_trigger=1), "1 hour")
    out = os.path.join(base, "out")
    L.run_versioned(L.event_summary_stream(ev, "1 day"), out, os.path.join(base, "ckpt"))
    return L.latest_versions(spark, out, ["root", "window_start"])


@query("stream_selection_tokens", "S8 (stream)", with_views("""
WITH w AS (SELECT DISTINCT src_path AS path FROM fs_events WHERE action = 'created')
SELECT root, CAST(sum(diff) AS BIGINT) AS selected_diff, count(*) AS n_changes FROM tc WHERE path IN (SELECT path FROM w) GROUP BY root""",
                                                          "tc", "fs_events"))
def q_stream_selection_tokens(spark, sf):
    base, src = _event_files(spark, sf)
    ev = fs_event_source(spark, src, max_files_per_trigger=1)
    diffs_dir = os.path.join(base, "diffs")
    L.run_append(L.token_changes_stream(ev), diffs_dir, os.path.join(base, "ckpt"))
    sel = TD.fs_events(spark, sf).where(F.col("action") == "created").select(F.col("src_path").alias("path")).distinct()
    diffs = spark.readStream.schema("root string, seq long, path string, diff long").parquet(diffs_dir)
    out = os.path.join(base, "sel")
    L.run_versioned(L.selection_tokens_stream(diffs, sel), out, os.path.join(base, "ckpt2"))
    return L.latest_versions(spark, out, ["root"]).select("root", F.col("selected_diff").cast("long"), "n_changes")


@query("stream_change_log", "S7 S2 W3 R11 (stream)", QUERIES["change_log"].sql)
def q_stream_change_log(spark, sf):
    """Token diffs from the stateful stream plus structural events, merged into the stored log per micro-batch."""
    from corpus_context.operators.events import change_entries

    base, src = _event_files(spark, sf)
    ev = fs_event_source(spark, src, max_files_per_trigger=1)
    diffs_dir = os.path.join(base, "diffs")
    L.run_append(L.token_changes_stream(ev), diffs_dir, os.path.join(base, "ckpt"))
    diffs = spark.readStream.schema("root string, seq long, path string, diff long").option("maxFilesPerTrigger", 256).parquet(diffs_dir)
    structural = fs_event_source(spark, src, max_files_per_trigger=1).where(F.col("action") != "modified")
    empty_ev = structural.where(F.lit(False))
    entries = change_entries(structural, diffs.where(F.lit(False))).unionByName(change_entries(empty_ev, diffs))
    ckpt = os.path.join(base, "ckpt2")
    log = L.run_change_log(entries, os.path.join(base, "log"), ckpt)
    return L.change_log_lines(log, L.batches_done(ckpt, spark))


@query("stream_apply_events", "S3 A8 (stream)", QUERIES["apply_events"].sql)
def q_stream_apply_events(spark, sf):
    """S3 over micro-batches, from the base files on; with a new base table after every second batch."""
    files, events = q_events._tree(spark, sf)
    base, src = _event_files(spark, sf, events)
    ckpt = os.path.join(base, "ckpt")
    items = L.run_apply_events(fs_event_source(spark, src, max_files_per_trigger=1), os.path.join(base, "items"), ckpt, files, every=2)
    return items.before(L.batches_done(ckpt, spark)).select("root", "path", "is_dir", "token_count")


@query("stream_debounce", "S6 A8 (stream)", QUERIES["debounce"].sql)
def q_stream_debounce(spark, sf):
    """S6 with session windows and a watermark, in append mode. One last event of a root of its own, a day after the others,
    moves the watermark past their bursts (its own burst stays open and is not sent)."""
    base, src = _event_files(spark, sf)
    ev = spark.read.parquet(src)
    last = ev.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), (F.max("seq") + 1).alias("seq"))
    end = last.select(F.lit("/corpus/end").alias("root"), "seq", "ts", F.lit("modified").alias("action"), F.lit("/corpus/end/x").alias("src_path"))
    ev.limit(0).unionByName(end, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(src)
    stream = L.with_event_time(fs_event_source(spark, src, max_files_per_trigger=1), "1 hour")
    out = os.path.join(base, "out")
    L.run_debounce(stream, out, os.path.join(base, "ckpt"), "10 minutes")
    return spark.read.parquet(out)


@query("stream_live_events", "J6 A8 (stream)", with_views("""
SELECT root, seq, action, src_path FROM (
  SELECT regexp_extract(src_path, '^(.*)/[^/]*$', 1) AS root, seq, action, src_path FROM fs_events)
WHERE CAST(right(root, 3) AS INTEGER) % 3 <> 0""", "fs_events"))
def q_stream_live_events(spark, sf):
    """J6 per user folder: every third one's watcher is off, every third one has no flag (which counts as on)."""
    ev = TD.fs_events(spark, sf).withColumn("root", F.regexp_extract("src_path", "^(.*)/[^/]*$", 1))
    base, src = _event_files(spark, sf, ev)
    k = F.substring("root", -3, 3).cast("int") % 3
    flag = F.struct(F.when(k == 0, False).when(k == 1, True).alias("live_watcher"))
    table = os.path.join(base, "workspaces")
    ev.select("root").distinct().select(F.col("root").alias("folder_path"), flag.alias("scan_settings")).write.parquet(table)
    out = os.path.join(base, "out")
    L.run_live_events(fs_event_source(spark, src, max_files_per_trigger=1), lambda: spark.read.parquet(table), out, os.path.join(base, "ckpt"))
    return spark.read.parquet(out).select("root", "seq", "action", "src_path")
