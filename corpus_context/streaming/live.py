"""Structured Streaming forms of the event operators.

Event time is ``ts`` with a caller-set watermark; later rows are dropped
(Spark default). Windowed results are written per micro-batch in update
mode by ``foreachBatch`` into batch-id folders, so a replayed batch rewrites
the same folder; the final table keeps the newest version of each key.
What S2, S3 and S7 remember is a table keyed by (root, path), of which a
micro-batch reads the paths it touches and writes those that changed
(streaming/state.py).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.operators import events as EV
from corpus_context.operators import selection as SEL
from corpus_context.operators.moves import prefixes
from corpus_context.operators.topk import top_k_per_key
from corpus_context.session import path_exists, remove_path
from corpus_context.streaming.state import PathState

TS_FMT = EV.TS_FMT


def with_event_time(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


# -- S1 / G9 / S6: windows, update mode, versioned per batch ---------------------------------

def batch_events_stream(events: DataFrame, every: str = "150 milliseconds") -> DataFrame:
    return EV.batch_events(events, every)


def event_summary_stream(events: DataFrame, every: str = "1 day") -> DataFrame:
    return EV.event_summary(events, every)


def run_versioned(df: DataFrame, out_dir: str, ckpt: str, trigger_available_now: bool = True):
    """Run an update-mode aggregation to completion; each batch lands in out_dir/batch=<id>."""

    def sink(bdf: DataFrame, batch_id: int):
        bdf.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

    w = df.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(sink)
    q = w.trigger(availableNow=True).start() if trigger_available_now else w.start()
    q.awaitTermination()
    return q


def latest_versions(spark: SparkSession, out_dir: str, key: list[str]) -> DataFrame:
    """The newest row per key over all batch folders."""
    d = spark.read.parquet(out_dir)
    cols = [c for c in d.columns if c not in key + ["batch"]]
    g = d.groupBy(*key).agg(F.max_by(F.struct(*cols), "batch").alias("v"))
    return g.select(*key, *[F.col("v")[c].alias(c) for c in cols])


# -- S2: stateful token changes ---------------------------------------------------------------

def token_changes_stream(events: DataFrame) -> DataFrame:
    """S2 as a stream: the events that :func:`run_append` turns into token changes.

    Micro-batches must arrive in seq order (each is ordered internally)."""
    return events.select("root", "seq", "action", "src_path", "dst_path", F.col("tokens").cast("long"))


def _stepped(events: DataFrame, spark: SparkSession, folder: str, batch_id: int, step) -> None:
    """``step(events, scratch)`` over one micro-batch, read again in the caller's session (a stream's own is not adaptive)."""
    scratch = os.path.join(folder, f"scratch-{batch_id}")
    remove_path(spark, scratch)
    events.write.parquet(os.path.join(scratch, "events"))
    step(spark.read.schema(events.schema).parquet(os.path.join(scratch, "events")), os.path.join(scratch, "steps"))
    remove_path(spark, scratch)


def _run(df: DataFrame, ckpt: str, step):
    """Runs the stream to completion; ``step(events, scratch, batch id)`` for each micro-batch."""
    spark = df.sparkSession
    q = (df.writeStream.option("checkpointLocation", ckpt)
         .foreachBatch(lambda bdf, bid: _stepped(bdf, spark, os.path.join(ckpt, "steps"), bid, lambda e, s: step(e, s, bid)))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def touched_paths(events: DataFrame) -> DataFrame:
    """(root, path) of the events' sources and targets."""
    return events.select("root", F.explode(F.array("src_path", "dst_path")).alias("path")).where("path is not null").distinct()


def run_append(df: DataFrame, out_dir: str, ckpt: str):
    """Run :func:`token_changes_stream` to completion; each batch's changes land in out_dir/batch=<id>, made from the counts
    before it of the paths it touches."""
    cache = PathState(df.sparkSession, os.path.join(ckpt, "token_cache"), "tokens long")
    return _run(df, ckpt, lambda events, scratch, batch_id: token_changes_step(events, cache, out_dir, batch_id, scratch))


def token_changes_step(events: DataFrame, cache: PathState, out_dir: str, batch_id: int, scratch: str | None = None) -> None:
    """S2 step: the token changes of one micro-batch, and the watcher's counts of the paths it touches."""
    touched = touched_paths(events.where("action <> 'created'"))
    diffs, after = EV.token_flow(events, cache.before(batch_id, touched), scratch)
    diffs.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))
    cache.commit(batch_id, after, touched)


# -- S3: files and folders as events arrive -----------------------------------------------------

def run_apply_events(df: DataFrame, state_dir: str, ckpt: str, base: DataFrame | None = None, every: int = 10) -> PathState:
    """S3 as a stream: the table of files and folders after each micro-batch, from ``base`` on (as in EV.apply_events).

    A micro-batch applies its events to the rows of the paths they create or change, and of the folders above them; what it
    removes becomes one tombstone per path, which stands for everything below. Micro-batches must arrive in seq order.
    The state is written anew from ``base`` by the first run only."""
    items = PathState(df.sparkSession, state_dir, "is_dir boolean, token_count long", below=True, seeded=base is not None, every=every)
    if base is not None and not path_exists(df.sparkSession, os.path.join(ckpt, "offsets")):
        whole = EV.apply_events(base, df.sparkSession.createDataFrame([], "root string, seq long, action string, src_path string, dst_path string, tokens long"))
        items.seed(whole)

    _run(df, ckpt, lambda events, scratch, batch_id: apply_events_step(events, items, batch_id))
    return items


def apply_events_step(events: DataFrame, items: PathState, batch_id: int) -> None:
    """S3 step: one micro-batch of events against the files and folders before it."""
    made = events.select("root", F.when(F.col("action") == "moved", F.col("dst_path")).when(F.col("action") != "deleted", F.col("src_path")).alias("path"))
    touched = made.where("path is not null").select("root", F.explode(prefixes("path")).alias("path")).distinct()
    after = EV.apply_events(items.before(batch_id, touched), events).join(touched, ["root", "path"], "left_semi")
    gone = events.where("action in ('deleted', 'moved')").select("root", F.col("src_path").alias("path"))
    items.commit(batch_id, after, gone)


# -- S8: selected-file tokens as changes arrive ----------------------------------------------

def selection_tokens_stream(diffs: DataFrame, selection: DataFrame) -> DataFrame:
    """Running token total of the selected files: stream-static semi join + running sum."""
    s = diffs.join(selection.select("path").distinct(), "path", "left_semi")
    return s.groupBy("root").agg(F.sum("diff").alias("selected_diff"), F.count(F.lit(1)).alias("n_changes"))


# -- S7: live change log, merged per micro-batch -----------------------------------------------

def run_change_log(entries: DataFrame, log_dir: str, ckpt: str, n: int = 5) -> PathState:
    """Per path its last ``n`` changes and the seq it was first seen at, kept as a table: a micro-batch of change entries is
    merged with the rows of the paths it holds."""
    log = PathState(entries.sparkSession, log_dir, "first_seq long, changes array<struct<seq:long,change:string>>")

    def step(batch, scratch, batch_id):
        keys = batch.select("root", "path").distinct()
        held = log.before(batch_id, keys)
        new = top_k_per_key(batch, ["root", "path"], [F.col("seq").desc()], n, ["seq"]).select("root", "path", "seq", "change")
        new = new.groupBy("root", "path").agg(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "change")).alias("new"))
        first = batch.groupBy("root", "path").agg(F.min("seq").cast("long").alias("first"))
        both = F.sort_array(F.concat(F.coalesce("changes", F.array().cast("array<struct<seq:long,change:string>>")), "new"), asc=False)
        merged = new.join(first, ["root", "path"]).join(held, ["root", "path"], "left").select(
            "root", "path", F.least("first", "first_seq").alias("first_seq"), F.slice(both, 1, n).alias("changes"))
        log.commit(batch_id, merged, keys.limit(0))

    _run(entries, ckpt, step)
    return log


def change_log_lines(log: PathState, batches: int) -> DataFrame:
    """The log after ``batches`` micro-batches as display lines (same form as the batch W3/R11)."""
    g = log.before(batches).withColumn("changes", F.array_join(F.transform("changes", lambda x: x["change"]), ", "))
    return g.select("root", "path", "first_seq", "changes",
                    F.concat(P.display_path("path", "root"), F.lit("  ("), F.col("changes"), F.lit(")")).alias("line"))


# -- J6: events of live workspaces --------------------------------------------------------------

def run_live_events(events: DataFrame, workspaces, out_dir: str, ckpt: str):
    """J6 as a stream: each micro-batch meets the workspace table as it then is (``workspaces()`` reads it), so a workspace
    whose watcher is switched off falls silent from the next batch on. Batches land in out_dir/batch=<id>."""
    return _run(events, ckpt, lambda batch, scratch, batch_id: SEL.live_events(batch, workspaces()).write.mode("overwrite").parquet(
        os.path.join(out_dir, f"batch={batch_id}")))


def batches_done(ckpt: str, spark: SparkSession) -> int:
    """The number of micro-batches that a stream's checkpoint has committed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(os.path.join(ckpt, "commits"))
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return max(int(x) for x in names if x.isdigit()) + 1


# -- S6: bursts as a stream ---------------------------------------------------------------------

def debounce_stream(events: DataFrame, gap: str = "500 milliseconds", key: str = "root") -> DataFrame:
    """S6 as a stream, for append mode: a burst is sent once the watermark has passed its end; a row whose time lies before the
    watermark is dropped. ``events`` carry a watermark (:func:`with_event_time`)."""
    return EV.debounce_session_window(events, key, gap)


def run_debounce(events: DataFrame, out_dir: str, ckpt: str, gap: str = "500 milliseconds"):
    q = (debounce_stream(events, gap).writeStream.outputMode("append").option("checkpointLocation", ckpt).format("parquet")
         .option("path", out_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
