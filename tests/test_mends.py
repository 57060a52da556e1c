"""Cases that the testdata does not show: many chunks, long move chains, missing groups, mixed answers, empty saves."""

import os

from pyspark.sql import functions as F

from corpus_context.operators import events as EV
from corpus_context.operators import selection as SEL
from corpus_context.sinks import chunks as CH


def test_chunk_names_keep_all_digits(spark, tmp_path):
    c = spark.createDataFrame([("c", k, 1, 1, 1, f"t{k}") for k in (9, 10, 99, 100, 101)],
                              "context_id string, chunk_no int, tokens long, chars long, n_files long, text string")
    CH.write_chunks(c, str(tmp_path), text_files=True)
    got = {r.chunk: r.text for r in CH.read_chunk_texts(spark, str(tmp_path)).collect()}
    assert got == {f"aggregation_chunk_{k:02d}.md": f"t{k}" for k in (9, 10, 99, 100, 101)}
    assert os.path.isdir(tmp_path / "parquet")


def test_token_change_over_a_long_move_chain(spark):
    n = 70
    rows = [("/r", 0, "modified", "/r/p0", None, 5)]
    rows += [("/r", k + 1, "moved", f"/r/p{k}", f"/r/p{k + 1}", None) for k in range(n)]
    rows += [("/r", n + 1, "modified", f"/r/p{n}", None, 9)]
    e = spark.createDataFrame(rows, "root string, seq long, action string, src_path string, dst_path string, tokens long")
    assert [(r.path, r["diff"]) for r in EV.token_changes(e).select("path", "diff").collect()] == [(f"/r/p{n}", 4)]


def _replay_tokens(rows):
    cache, out = {}, []
    for root, seq, action, src, dst, tokens in rows:
        if action == "modified":
            old = cache.get(src, tokens)
            cache[src] = tokens
            if tokens != old:
                out.append((root, seq, src, tokens - old))
        elif action == "deleted":
            cache.pop(src, None)
        elif action == "moved" and src in cache:
            cache[dst] = cache.pop(src)
    return sorted(out)


def test_token_changes_equal_a_replay_without_python_groups(spark, tmp_path):
    """One root whose moves link all paths: same rows as the replay, by no task that holds a root or component."""
    import contextlib
    import io
    import random

    from corpus_context.streaming import live as L
    from corpus_context.streaming.state import PathState

    r, schema = random.Random(7), "root string, seq long, action string, src_path string, dst_path string, tokens long"
    rows = []
    for k in range(1500):
        action = r.choice(["modified", "modified", "moved", "moved", "moved", "deleted", "created"])
        rows.append(("/r", k, action, f"/r/{r.randrange(7)}", f"/r/{r.randrange(7)}" if action == "moved" else None, r.randrange(9)))
    e = spark.createDataFrame(r.sample(rows, len(rows)), schema)
    got = EV.token_changes(e)
    assert sorted(map(tuple, got.collect())) == _replay_tokens(rows)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        got.explain()
    assert "InPandas" not in text.getvalue()
    out, cache = str(tmp_path / "out"), PathState(spark, str(tmp_path / "state"), "tokens long", every=2)
    for b in (0, 1, 1, 2):  # batch 1 is replayed, and followed by a new base
        L.token_changes_step(e.where(f"seq div 500 = {b}"), cache, out, b)
    assert sorted(map(tuple, spark.read.parquet(out).select("root", "seq", "path", "diff").collect())) == _replay_tokens(rows)
    assert {x.root for x in cache.before(3).collect()} == {"/r"}


def test_unknown_active_group_falls_back(spark):
    ws = spark.createDataFrame([("w", "/r", "Gone"), ("v", "/r", "Mine")], "workspace string, folder_path string, active_selection_group string")
    sel = spark.createDataFrame([("w", "Default", "a.py"), ("v", "Default", "a.py"), ("v", "Mine", "b.py")],
                                "workspace string, group_name string, path string")
    got = {(r.workspace, r.group_name, r.rel) for r in SEL.selected_files(ws, sel).collect()}
    assert got == {("w", "Default", "a.py"), ("v", "Mine", "b.py")}


def test_drift_answer_per_group(spark):
    schema = "workspace string, group_name string, path string"
    sel = spark.createDataFrame([("w", "A", "/a"), ("w", "B", "/a")], schema)
    gone, new = sel, spark.createDataFrame([("w", "A", "/n"), ("w", "B", "/n")], schema)
    out, _ = SEL.resolve_drift(sel, gone, new, F.col("group_name") == "A")
    assert {(r.group_name, r.path) for r in out.collect()} == {("A", "/n"), ("B", "/a")}
    for answer, expect in ((F.lit(True), "/n"), (False, "/a"), (True, "/n")):
        out, _ = SEL.resolve_drift(sel, gone, new, answer)
        assert {r.path for r in out.collect()} == {expect}


def test_saving_an_empty_group(spark):
    groups = spark.createDataFrame([("w", "A", "d", 1.0)], "workspace string, group_name string, description string, last_updated double")
    sel = spark.createDataFrame([("w", "A", "x.py")], "workspace string, group_name string, path string")
    upd = spark.createDataFrame([("w", "A", None, 2.0)], "workspace string, group_name string, path string, now double")
    roots = spark.createDataFrame([("w", "/r")], "workspace string, root string")
    g, s = SEL.upsert_group(groups, sel, upd, roots)
    assert [(r.description, r.last_updated) for r in g.collect()] == [("d", 2.0)] and s.count() == 0


def test_events_on_folders_and_present_paths(spark):
    base = spark.createDataFrame([("/r", "/r/a/x.py", 10), ("/r", "/r/a/y.py", 20), ("/r", "/r/b.py", 7), ("/r", "/r/ab.py", 1)],
                                 "root string, path string, token_count long")
    ev = spark.createDataFrame([("/r", 1, "deleted", "/r/a", None, None), ("/r", 2, "created", "/r/b.py", None, 99),
                                ("/r", 3, "created", "/r/c/d/e.py", None, 4), ("/r", 4, "moved", "/r/c/d", "/r/f/g.py", 6),
                                ("/r", 5, "modified", "/r/f/g.py", None, 8), ("/r", 6, "created", "/r/c", None, 3)],
                               "root string, seq long, action string, src_path string, dst_path string, tokens long")
    got = {(r.path, r.is_dir, r.token_count) for r in EV.apply_events(base, ev).collect()}
    assert got == {("/r/b.py", False, 7), ("/r/ab.py", False, 1), ("/r/f/g.py", False, 8), ("/r/f", True, 0), ("/r/c", True, 0)}


def test_toggle_files_and_folders(spark):
    from corpus_context.operators.tree import toggle_paths

    paths = ["/r/a/x", "/r/a/y", "/r/b/u", "/r/b/k/v", "/r/w"]
    items = spark.createDataFrame([("/r", p, False) for p in paths] + [("/r", p, True) for p in ("/r/a", "/r/b", "/r/b/k")],
                                  "root string, path string, is_dir boolean")
    sel = spark.createDataFrame([("/r", "/r/a/x"), ("/r", "/r/b/u"), ("/r", "/r/b/k/v")], "root string, path string")

    def toggled(*at):
        t = spark.createDataFrame([("/r", p) for p in at], "root string, path string")
        return sorted(r.path for r in toggle_paths(items, sel, t).collect())

    assert toggled("/r/a") == ["/r/a/x", "/r/a/y", "/r/b/k/v", "/r/b/u"]  # partial: all below are checked
    assert toggled("/r/b") == ["/r/a/x"]  # checked: all below are unchecked
    assert toggled("/r/w", "/r/a/x", "/r/gone") == ["/r/b/k/v", "/r/b/u", "/r/w"]
    assert toggled("/r/a", "/r/a/x") == ["/r/a/y", "/r/b/k/v", "/r/b/u"]  # the file's own toggle decides
