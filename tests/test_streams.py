"""Streams that keep a table of paths: what a micro-batch writes, replays, new bases, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from corpus_context.operators import events as EV
from corpus_context.streaming import live as L
from corpus_context.streaming.state import PathState

EVENTS = "root string, seq long, action string, src_path string, dst_path string, tokens long"
PATHS = "root string, path string"


def some_events(n, seed):
    r, out = random.Random(seed), []
    for k in range(n):
        root = f"/r{r.randrange(6)}"
        path = lambda: root + "".join("/" + r.choice("abc") for _ in range(r.randint(1, 3)))
        action = r.choice(["created", "created", "modified", "modified", "moved", "deleted"])
        out.append((root, k, action, path(), path() if action == "moved" else None, r.randrange(50)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("every", [2, 10])
def test_apply_events_in_micro_batches(spark, tmp_path, every):
    events = spark.createDataFrame(some_events(700, 3), EVENTS)
    base = spark.createDataFrame([(f"/r{k % 6}", f"/r{k % 6}/" + "/".join("abc"[(k // 6) % 3] for _ in range(1 + k % 3)), k) for k in range(30)],
                                 "root string, path string, token_count long").distinct()
    items = PathState(spark, str(tmp_path / "items"), "is_dir boolean, token_count long", below=True, seeded=True, every=every)
    items.seed(EV.apply_events(base, events.limit(0)))
    for b in (0, 1, 1, 2, 3, 3, 4, 5, 6):
        L.apply_events_step(events.where(f"seq div 100 = {b}"), items, b)
        if b in (0, 3):
            expected = EV.apply_events(base, events.where(f"seq < {100 * (b + 1)}"))
            assert rows(items.before(b + 1).select("root", "path", "is_dir", "token_count")) == rows(expected)
    assert rows(items.before(7).select("root", "path", "is_dir", "token_count")) == rows(EV.apply_events(base, events))


def test_a_batch_writes_what_changed(spark, tmp_path):
    items = PathState(spark, str(tmp_path / "i"), "is_dir boolean, token_count long", below=True, seeded=True)
    items.seed(spark.createDataFrame([("/r", f"/r/d{k % 2}/f{k}", False, 1) for k in range(500)] + [("/r", "/r/d0", True, 0), ("/r", "/r/d1", True, 0)],
                                     "root string, path string, is_dir boolean, token_count long"))
    ev = spark.createDataFrame([("/r", 1, "deleted", "/r/d0", None, 0), ("/r", 2, "modified", "/r/d1/f1", None, 9), ("/r", 3, "created", "/r/d0/new", None, 4)], EVENTS)
    L.apply_events_step(ev, items, 0)
    written = spark.read.parquet(str(tmp_path / "i" / "delta=0"))
    assert written.count() <= 5 and written.where("gone").count() == 1
    after = {r.path: r.token_count for r in items.before(1).where("not is_dir").collect()}
    assert len(after) == 251 and after["/r/d1/f1"] == 9 and after["/r/d0/new"] == 4
    assert items.before(1, spark.createDataFrame([("/r", "/r/d0/f2"), ("/r", "/r/d1/f1")], PATHS)).count() == 1


def test_state_of_a_missing_batch_fails(spark, tmp_path):
    s = PathState(spark, str(tmp_path / "s"), "v long")
    one = spark.createDataFrame([("/r", "/r/a", 1)], "root string, path string, v long")
    s.commit(0, one, one.limit(0))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        s.before(2).collect()


def test_change_log_restarts_from_its_checkpoint(spark, tmp_path):
    r = random.Random(1)
    entries = [("/r", f"/r/f{r.randrange(12)}", k, f"+{k} tokens") for k in range(400)]
    schema = "root string, path string, seq long, change string"
    df, src = spark.createDataFrame(entries, schema), str(tmp_path / "in")
    for part in (0, 1), (2, 3):  # the second run goes on where the first one ended
        for b in part:
            df.where(f"seq div 100 = {b}").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        log = L.run_change_log(stream, str(tmp_path / "log"), str(tmp_path / "ck"))
    n = L.batches_done(str(tmp_path / "ck"), spark)
    assert rows(L.change_log_lines(log, n)) == rows(EV.change_log(df))


def test_a_watcher_switched_off_between_batches(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "ws")
    ev = spark.createDataFrame([("/a", k, "created", f"/a/{k}", None, 0) for k in range(4)] + [("/b", 9, "created", "/b/9", None, 0)], EVENTS)
    settings = "folder_path string, scan_settings struct<live_watcher:boolean>"
    out, stream = str(tmp_path / "out"), spark.readStream.schema(EVENTS)
    for on, cond in (True, "seq < 2"), (False, "seq >= 2"):
        spark.createDataFrame([("/a", (on,)), ("/b", (None,))], settings).write.mode("overwrite").parquet(table)
        ev.where(cond).coalesce(1).write.mode("append").parquet(src)
        L.run_live_events(stream.parquet(src), lambda: spark.read.parquet(table), out, str(tmp_path / "ck"))
    assert sorted(r.seq for r in spark.read.parquet(out).select("seq").collect()) == [0, 1, 9]


def test_late_rows_are_dropped_from_bursts(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "root string, seq long, ts timestamp, action string, src_path string, dst_path string, tokens long"
    at = lambda s: F.timestamp_seconds(F.lit(1704067200 + s))
    for batch in ([(1, 0), (2, 100)], [(3, 7200)], [(4, 50), (5, 7300)], [(6, 90000)]):  # 4 comes after its burst was closed
        for k, s in batch:
            spark.range(1).select(F.lit("/r").alias("root"), F.lit(k).cast("long").alias("seq"), at(s).alias("ts"), F.lit("modified").alias("action"),
                                  F.lit(f"/r/{k}").alias("src_path"), F.lit(None).cast("string").alias("dst_path"), F.lit(0).cast("long").alias("tokens")).write.mode("append").parquet(src)
        stream = L.with_event_time(spark.readStream.schema(schema).parquet(src), "10 minutes")
        L.run_debounce(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "5 minutes")
    got = sorted((r.seq, r.n_events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(2, 2), (5, 2)]
