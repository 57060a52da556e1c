"""Hand-built rows with literal expectations (the reference's own small cases)."""

import os
import posixpath

import pytest

from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.functions import text as X
from corpus_context.operators import events as EV
from corpus_context.operators import pack as PK
from corpus_context.operators import tree as TR


def test_paths_match_posixpath(spark):
    cases = ["/a/b/../c", "a//b/./c", "", "/", "//x/y", "///x", "../a", "a/..", "/a/./b/", "x/../../y"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r["p"]: r["n"] for r in df.select("p", P.normalize_path("p").alias("n")).collect()}
    for c in cases:
        assert got[c] == posixpath.normpath(c), c


def test_extension_like_splitext(spark):
    names = [".bashrc", "a.tar.gz", "x.", "Makefile", "..a", "a..b", "dir/file.PY"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r["p"]: r["e"] for r in df.select("p", P.extension("p").alias("e")).collect()}
    for n in names:
        assert got[n] == os.path.splitext(posixpath.basename(n))[1], n


def test_skip_rules(spark):
    rows = [("/r/Cargo.lock", 10), ("/r/thumbs.db", 10), ("/r/.DS_Store", 10), ("/r/package-lock.json", 10),
            ("/r/app.min.js", 10), ("/r/big.py", 51201), ("/r/ok.py", 51200), ("/r/a.tar.gz", 5)]
    df = spark.createDataFrame(rows, "path string, size long")
    got = {r["path"]: (r["reason"], r["s"]) for r in df.select(
        "path", R.skip_reason("path", "size").alias("reason"), R.token_strategy("path", "size").alias("s")).collect()}
    assert got["/r/Cargo.lock"] == (None, "immediate")  # patterns are not lower-cased
    assert got["/r/thumbs.db"] == ("Skipped *.db file", "skip")
    assert got["/r/.DS_Store"] == (None, "immediate")
    assert got["/r/package-lock.json"] == ("Skipped package-lock.json", "skip")
    assert got["/r/app.min.js"] == ("Skipped *.min.js file", "skip")
    assert got["/r/big.py"] == ("File too large (50KB)", "skip")
    assert got["/r/ok.py"] == (None, "defer")
    assert got["/r/a.tar.gz"] == ("Skipped *.gz file", "skip")


def test_text_content_bytes(spark):
    rows = [(b"",), (b"abc\x00",), (b"\xff\xfe",), ("hé".encode(),)]
    df = spark.createDataFrame(rows, "content binary")
    got = [r[0] for r in df.select(R.is_text_content("content")).collect()]
    assert got == [True, False, False, True]
    dec = [r[0] for r in df.select(X.decode_utf8("content")).collect()]
    assert dec == [b.decode("utf-8", errors="replace") for (b,) in rows]


def test_folder_totals_and_labels(spark):
    items = spark.createDataFrame([
        ("/project", "/project/file1.py", False, True, "", 100, "immediate"),
        ("/project", "/project/subdir", True, True, "", 0, None),
        ("/project", "/project/subdir/file2.py", False, True, "", 250, "immediate"),
        ("/project", "/project/subdir/file3.txt", False, True, "", 50, "immediate"),
    ], "root string, path string, is_dir boolean, is_valid boolean, reason string, token_count long, strategy string")
    sel = spark.createDataFrame([("/project", "/project/subdir/file2.py")], "root string, path string")
    got = {r["dir"]: r["label"] for r in TR.folder_selected_tokens(items, sel).collect()}
    assert got == {"/project/subdir": "250 / 300 tokens", "/project": "250 / 400 tokens"}
    sel2 = spark.createDataFrame([("/project", "/project/subdir/file2.py"), ("/project", "/project/file1.py")],
                                 "root string, path string")
    got = {r["dir"]: r["label"] for r in TR.folder_selected_tokens(items, sel2).collect()}
    assert got["/project"] == "350 / 400 tokens"
    st = {r["dir"]: r["state"] for r in TR.folder_state(items, sel, "tri").collect()}
    assert st == {"/project/subdir": "partial", "/project": "partial"}


def test_next_fit_matches_loop(spark):
    import random

    rnd = random.Random(7)
    rows, expect = [], {}
    for c in range(12):
        ts = [rnd.choice([1, 5, 30, 90, 150, 400]) for _ in range(rnd.randint(1, 25))]
        limit, h = 200, rnd.choice([0, 10])
        cur, k, chunks = h, 1, []
        for i, t in enumerate(ts):
            if cur > 0 and cur + t > limit:
                k += 1
                cur = h
            cur += t
            chunks.append(k)
            rows.append((f"c{c}", i, t, h))
        expect[f"c{c}"] = chunks
    parts = spark.createDataFrame(rows, "context_id string, rank int, t long, h long")
    a, _ = PK.assign_chunks(parts, 200, F.col("h"), guard=True)
    got = {}
    for r in a.orderBy("context_id", "rank").collect():
        got.setdefault(r["context_id"], []).append(r["chunk_no"])
    assert got == expect


def test_render_tree_order(spark):
    sel = spark.createDataFrame([("c", "src/b.py"), ("c", "a.md"), ("c", "src/util/x.py"), ("c", "z.txt")],
                                "context_id string, rel string")
    ctx = spark.createDataFrame([("c", "/w/proj")], "context_id string, root string")
    tree = PK.render_tree(sel, ctx).collect()[0]["tree"]
    assert tree == "\n".join(["proj/", "├── a.md", "├── z.txt", "└── src/", "    ├── b.py", "    └── util/",
                              "        └── x.py"])


def test_token_changes_events(spark):
    ev = spark.createDataFrame([
        ("/p", 1, "modified", "/p/file1.py", None, 7),
        ("/p", 2, "modified", "/p/file1.py", None, 12),
        ("/p", 3, "moved", "/p/file1.py", "/p/file2.py", 12),
        ("/p", 4, "modified", "/p/file2.py", None, 10),
        ("/p", 5, "deleted", "/p/file2.py", None, 0),
        ("/p", 6, "modified", "/p/file2.py", None, 3),
    ], "root string, seq long, action string, src_path string, dst_path string, tokens long")
    got = [(r["seq"], r["diff"]) for r in EV.token_changes(ev).orderBy("seq").collect()]
    assert got == [(2, 5), (4, -2)]


def test_event_glob(spark):
    ev = spark.createDataFrame([("/w/src/main.py",), ("/w/app.log",), ("/w/build/output.bin",), ("/w/__pycache__/cache.bin",)],
                               "src_path string")
    pats = ["*.log", "build/*", "__pycache__"]
    plain = [r[0] for r in ev.where(~R.event_ignored("src_path", pats)).collect()]
    assert plain == ["/w/src/main.py", "/w/build/output.bin", "/w/__pycache__/cache.bin"]
    comp = [r[0] for r in ev.where(~R.event_ignored("src_path", pats, component_match=True)).collect()]
    assert comp == ["/w/src/main.py"]


def test_change_log_format(spark):
    diffs = spark.createDataFrame([("/r", 1, "/r/file1", 150), ("/r", 2, "/r/file2", -75), ("/r", 3, "/r/file3", 0)],
                                  "root string, seq long, path string, diff long")
    none = spark.createDataFrame([], "root string, seq long, action string, src_path string, dst_path string")
    log = EV.change_log(EV.change_entries(none, diffs))
    got = {r["path"]: r["line"] for r in log.collect()}
    assert got == {"/r/file1": "file1  (+150 tokens)", "/r/file2": "file2  (-75 tokens)"}


def next_fit_loop(sizes, h, limit, guard):
    """Chunk numbers of the parts, and the number of chunks, by the sequential rule."""
    cur, k, out = h, 1, []
    for t in sizes:
        if (cur > 0 or not guard) and cur + t > limit:
            k, cur = k + 1, h
        cur += t
        out.append(k)
    return out, k


@pytest.mark.parametrize("guard", [True, False])
@pytest.mark.parametrize("block, level", [(None, None), (8, 4), (1, 2)])
def test_next_fit_equals_the_sequential_rule(spark, guard, block, level):
    """Parts of no tokens, oversize parts, headers over the limit, one part, contexts spread over many blocks."""
    import random

    from corpus_context.operators.nextfit import chunk_ranges

    rnd, rows, expect = random.Random(11), [], {}
    given = [[0, 12, 0, 0, 5, 6, 0], [0], [0, 0, 0], [11], [11, 0], [11, 0, 0, 0], [0, 0, 11, 11, 0, 3], [5, 5, 1], [10, 0, 10, 0]]
    given += [[rnd.choice([0, 0, 1, 2, 3, 9, 10, 11, 40]) for _ in range(rnd.randint(1, 90))] for _ in range(24)]
    given += [[0] * 40 + [11] + [0] * 40 + [5] * 9, [rnd.choice([0, 1]) for _ in range(300)], [30] * 50]
    for c, sizes in enumerate(given):
        for h in (0, 4, 15):
            name = f"c{c}-{h}"
            rows += [(name, i, t, h) for i, t in enumerate(sizes)]
            expect[name] = next_fit_loop(sizes, h, 10, guard)
    parts = spark.createDataFrame(rows, "context_id string, rank int, t long, h long").repartition(5)
    got = {}
    for r in chunk_ranges(parts, 10, F.col("h"), guard, block, level).collect():
        got.setdefault(r["context_id"], []).append((r["chunk_no"], r["lo"], r["hi"]))
    assert got.keys() == expect.keys()
    for name, chunks in got.items():
        of, n = expect[name]
        chunks.sort()
        assert [c[0] for c in chunks] == list(range(1, n + 1)), name
        assert [k for k, lo, hi in chunks for _ in range(lo, hi + 1)] == of, name
        assert chunks[0][1] == 0 and all(a[2] + 1 == b[1] for a, b in zip(chunks, chunks[1:])), name
    assert chunk_ranges(parts.limit(0), 10, F.col("h"), guard).count() == 0


def test_rank_matches_window(spark):
    from pyspark.sql import Window

    rows = [(f"c{i % 3}", f"p{(i * 7919) % 1000:04d}") for i in range(600)]
    df = spark.createDataFrame(rows, "context_id string, rel string")
    got = PK.ranked(df, ["rel"])
    w = Window.partitionBy("context_id").orderBy("rel")
    exp = df.withColumn("rank", F.row_number().over(w) - 1)
    assert sorted(map(tuple, got.select("context_id", "rel", "rank").collect())) == \
        sorted(map(tuple, exp.select("context_id", "rel", "rank").collect()))


def test_scan_files_binaryfile(spark, tmp_path):
    from corpus_context.operators import scan as S
    from corpus_context.sources.files import scan_files

    root = tmp_path / "repo"
    (root / "folder1").mkdir(parents=True)
    (root / "folder_to_ignore").mkdir()
    (root / "file1.py").write_text("print('hello')")
    (root / "folder1" / "file2.txt").write_text("world")
    (root / "folder_to_ignore" / "ignored_file.txt").write_text("x")
    files = scan_files(spark, [str(root)])
    items = S.corpus_tokens(files, "chars4", ignore=["folder_to_ignore"], two_pass=True)
    got = {r["path"].replace(str(root), ""): (r["is_dir"], r["token_count"]) for r in items.collect()}
    assert got == {"/file1.py": (False, 3), "/folder1": (True, 0), "/folder1/file2.txt": (False, 1)}


def test_bpe_with_stub_encoder(spark):
    from corpus_context.functions import tokens as TK

    class Stub:
        def encode(self, text, disallowed_special=()):
            return text.split()

    df = spark.createDataFrame([("a b c",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(TK.tokens_bpe(Stub)("t")).collect()]
    assert got == [3, 0, 0]


def test_truncate_notice(spark):
    df = spark.createDataFrame([(b"a" * 1500,), (b"short",)], "content binary")
    got = [r[0] for r in df.select(X.truncate_notice("content", 1)).collect()]
    assert got[0].startswith("a" * 1024) and got[0].endswith("... (truncated at 1KB)")
    assert got[1] == "short"


def test_apply_events_structure(spark):
    base = spark.createDataFrame([("/p", "/p/file1.py", 7), ("/p", "/p/src/main.py", 5)], "root string, path string, token_count long")
    ev = spark.createDataFrame([
        ("/p", 1, "created", "/p/src/utils.py", None, 3),
        ("/p", 2, "deleted", "/p/file1.py", None, 0),
        ("/p", 3, "moved", "/p/src/main.py", "/p/src/app.py", 5),
    ], "root string, seq long, action string, src_path string, dst_path string, tokens long")
    out = EV.apply_events(base, ev)
    files = sorted(r["path"] for r in out.where("NOT is_dir").collect())
    assert files == ["/p/src/app.py", "/p/src/utils.py"]


def test_chunk_text_objects(spark, tmp_path):
    from corpus_context.sinks.chunks import read_chunk_texts, read_chunks, write_chunks

    ch = spark.createDataFrame([("ctx", 1, 5, 20, 1, "first\nchunk"), ("ctx", 2, 3, 12, 1, "second")],
                               "context_id string, chunk_no int, tokens long, chars long, n_files long, text string")
    write_chunks(ch, str(tmp_path / "out"), text_files=True)
    texts = {r["chunk"]: r["text"] for r in read_chunk_texts(spark, str(tmp_path / "out")).collect()}
    assert texts == {"aggregation_chunk_01.md": "first\nchunk", "aggregation_chunk_02.md": "second"}
    tot = read_chunks(spark, str(tmp_path / "out")).collect()[0]
    assert (tot["n_chunks"], tot["total_chars"]) == (2, 17)


def test_keep_selection_replay_chain(spark):
    items = spark.createDataFrame([("/p", "/p/a.py"), ("/p", "/p/b.py"), ("/p", "/p/d/x.py")], "root string, path string")
    sel = spark.createDataFrame([("/p", "/p/a.py"), ("/p", "/p/d/x.py")], "root string, path string")
    ev = spark.createDataFrame([
        ("/p", 1, "moved", "/p/a.py", "/p/c.py"),
        ("/p", 2, "moved", "/p/c.py", "/p/e.py"),
        ("/p", 3, "moved", "/p/d", "/p/d2"),
        ("/p", 4, "created", "/p/n.py", None),
        ("/p", 5, "deleted", "/p/b.py", None),
    ], "root string, seq long, action string, src_path string, dst_path string")
    got = {r["path"]: r["selected"] for r in EV.apply_events_keep_selection(items, sel, ev).collect()}
    assert got == {"/p/e.py": True, "/p/d2/x.py": True, "/p/n.py": False}


def test_stream_restart_from_checkpoint(spark, tmp_path):
    """The stateful token stream stopped after two micro-batches and restarted from its checkpoint
    gives the same rows as the batch operator over all events."""
    from corpus_context.sources import testdata as TD
    from corpus_context.sources.files import fs_event_source
    from corpus_context.streaming import live as L

    ev = TD.fs_events(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    b = ev.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    lo, hi = int(b["lo"]), int(b["hi"])
    step = (hi - lo) // 4 + 1
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for i in range(2):
        ev.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(src)
    L.run_append(L.token_changes_stream(fs_event_source(spark, src, max_files_per_trigger=1)), out, ck)
    for i in range(2, 4):
        ev.where((F.col("seq") >= lo + i * step) & (F.col("seq") < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(src)
    L.run_append(L.token_changes_stream(fs_event_source(spark, src, max_files_per_trigger=1)), out, ck)
    got = sorted(map(tuple, spark.read.parquet(out).select("seq", "path", "diff").collect()))
    exp = sorted(map(tuple, EV.token_changes(TD.fs_events(spark, "/root/testdata/sf0.001")).select("seq", "path", "diff").collect()))
    assert got == exp and len(got) > 0


def test_gitignore_filter(spark):
    from corpus_context.operators import scan as S

    rows = [
        ("/r", "/r/.gitignore", "*.log\nbuild/\n!keep.log\n/secret.txt\n# comment\n"),
        ("/r", "/r/a.log", "x"), ("/r", "/r/keep.log", "x"), ("/r", "/r/src/b.log", "x"),
        ("/r", "/r/build/out.bin", "x"), ("/r", "/r/src/build/o.bin", "x"),
        ("/r", "/r/secret.txt", "x"), ("/r", "/r/src/secret.txt", "x"), ("/r", "/r/main.py", "x"),
        ("/r", "/r/src/.gitignore", "*.tmp\n"), ("/r", "/r/src/x.tmp", "x"), ("/r", "/r/y.tmp", "x"),
    ]
    files = spark.createDataFrame(rows, "root string, path string, text string")
    kept = sorted(r["path"] for r in S.gitignore_filter(files).collect() if not r["path"].endswith(".gitignore"))
    assert kept == ["/r/keep.log", "/r/main.py", "/r/src/secret.txt", "/r/y.tmp"]


def test_gitignore_parents_sets_and_escapes(spark):
    from corpus_context.operators import scan as S

    rules = ["build/", "!build/keep.txt", "a[b", "x[0-9].c", "y[!a-c].c", "z[z-a].c", "w[]x].c", "docs/**/tmp", "**/cache", "out/**",
             r"\#hash", r"\!bang", r"sp\ ", "trail   ", "q?.c", "/only.c", "deep/er/f", "!x7.c", "m[^k].c", "p[&&a].c"]
    ignored = ["build/keep.txt", "s/build/keep.txt", "x1.c", "s/x0.c", "yd.c", "w].c", "wx.c", "docs/tmp", "docs/a/b/tmp", "cache/f", "s/cache",
               "out/a", "out/b/c", "#hash", "!bang", "sp ", "trail", "qa.c", "only.c", "deep/er/f", "ml.c", "p&.c", "pa.c"]
    kept = ["a[b", "ab", "xa.c", "ya.c", "y/.c", "zz.c", "wy.c", "docs/tmpx", "out", "q/.c", "s/only.c", "s/deep/er/f", "x7.c", "mk.c", "p[.c", "s/out/a"]
    rows = [("/r", "/r/.gitignore", "\n".join(rules))] + [("/r", "/r/" + p, "") for p in ignored + kept]
    rows += [("/r", "/r/s/.gitignore", "!x0.c\n"), ("/r", "/r/s/t/x0.c", ""), ("/q", "/q/build/a", "")]
    got = {r.path for r in S.gitignore_filter(spark.createDataFrame(rows, "root string, path string, text string")).collect()}
    back = {"/r/s/x0.c", "/r/s/t/x0.c", "/q/build/a", "/r/.gitignore", "/r/s/.gitignore"}
    assert got == {"/r/" + p for p in kept} | back


def test_globs_equal_fnmatch(spark):
    import fnmatch
    import random

    from corpus_context.functions.globs import glob_to_regex

    r = random.Random(4)
    names = ["".join(r.choice("ab-]!^[*?&.\\/\n") for _ in range(r.randint(0, 6))) for _ in range(300)]
    given = ["".join(r.choice("ab-]!^[[]*?&.\\/") for _ in range(r.randint(0, 7))) for _ in range(120)] + ["[a&&b]", "[[a]", "[b-a]", "[!b-a]", "[]a]", "[!]a]", "[a-", "*"]
    df = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1)
    got = df.select(*[F.col("n").rlike(glob_to_regex(g)).alias(str(i)) for i, g in enumerate(given)]).collect()
    for n, row in zip(names, got):
        for g, match in zip(given, row):
            assert match == fnmatch.fnmatchcase(n, g), (n, g)


def test_running_tokens_are_prefix_sums(spark):
    rows = [(f"c{i % 2}", f"f{i:03d}", 100 + i, i % 7, i % 5 != 0) for i in range(90)]
    parts = spark.createDataFrame(rows, "context_id string, path string, size long, t long, counted boolean")
    a = sorted(map(tuple, PK.running_tokens(parts).collect()))
    # the running total is a prefix sum of counted tokens in path order
    c0 = [r for r in a if r[0] == "c0"]
    exp, acc = [], 0
    for (ctx, path, size, t, counted) in sorted(r for r in rows if r[0] == "c0"):
        acc += t if counted else 0
        exp.append(acc)
    assert [r[2] for r in sorted(c0, key=lambda r: r[1])] == exp


def test_include_subfolders_and_file_globs(spark):
    df = spark.createDataFrame([("/w", "/w/a.py"), ("/w", "/w/sub/b.py"), ("/w", "/w/app.log"), ("/w", "/w/sub/x.LOG")],
                               "root string, path string")
    top = sorted(r[0] for r in df.where(R.include_subfolders("path", "root", False)).select("path").collect())
    assert top == ["/w/a.py", "/w/app.log"]
    allp = df.where(R.include_subfolders("path", "root", True)).count()
    assert allp == 4
    kept = sorted(r[0] for r in df.where(~R.ignore_globs("path", ["*.log"])).select("path").collect())
    assert kept == ["/w/a.py", "/w/sub/b.py", "/w/sub/x.LOG"]  # globs match case-sensitively


def test_debounce_forms_agree(spark):
    from corpus_context.sources import testdata as TD

    ev = TD.fs_events(spark, "/root/testdata/sf0.001")
    a = sorted(map(tuple, EV.debounce(ev, "root", "10 minutes").collect()))
    b = sorted(map(tuple, EV.debounce_session_window(ev, "root", "10 minutes").collect()))
    assert a == b and len(a) > 0
