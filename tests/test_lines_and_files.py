"""R6, R7 and R10 as ordered rows, and chunks as files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpus_context.operators import lines as LN
from corpus_context.operators import pack as PK
from corpus_context.sinks.chunk_files import MARKER, context_dir_name, read_chunk_files, write_chunk_files

CHUNKS = "context_id string, chunk_no int, text string"


def _paths():
    r = random.Random(3)
    names = ["a", "b", "B.py", "ü", "x y", "z.md"]
    out = {("big", f"src/f{i:04d}.py") for i in range(700)}  # one folder with nearly all files
    out |= {(c, "/".join(r.choice(names) + str(k) for k in range(r.randint(1, 4)))) for c in ("big", "c1", "c2") for _ in range(40)}
    return sorted(out) + [("c1", "top.txt"), ("c1", "top.txt")]


def _joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["context_id"], r["ord"])):
        out.setdefault(r["context_id"], []).append((r["ord"], r["line"]))
    assert all([o for o, _ in v] == list(range(len(v))) for v in out.values())
    return {c: "\n".join(x for _, x in v) for c, v in out.items()}


@pytest.mark.parametrize("as_lines, as_text", [(LN.tree_lines, PK.render_tree), (LN.tree_flat_lines, PK.render_tree_flat)])
def test_tree_lines_join_to_the_tree_text(spark, as_lines, as_text):
    sel = spark.createDataFrame(_paths(), "context_id string, rel string").repartition(7)
    ctx = spark.createDataFrame([(c, f"/p/{c}") for c in ("big", "c1", "c2", "empty")], "context_id string, root string")
    want = {r["context_id"]: r["tree"] for r in as_text(sel, ctx).collect()}
    assert _joined(as_lines(sel, ctx).collect()) == want and len(want) == 4
    assert _joined(as_lines(sel.limit(0), ctx).collect()).keys() == want.keys()
    assert as_lines(sel.limit(0), ctx.limit(0)).count() == 0


def test_last_child_is_found_by_partial_aggregates(spark):
    sel = spark.createDataFrame(_paths(), "context_id string, rel string")
    rows = LN._with_last(PK.tree_nodes(sel), "parent", ["is_dir", "name"], "node")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_" not in plan
    assert rows.where("is_last").count() == rows.select("context_id", "parent").distinct().count()


def test_panel_parts_in_both_styles(spark):
    rows = [("c", "b.PY", "/r/b.PY", 3, "x```y", None), ("c", "a.md", "/r/a.md", 3, "two\nlines", None),
            ("c", "gone", "/r/gone", 3, None, "denied"), ("c", "huge.txt", "/r/huge.txt", 11 << 20, "t", None), ("d", "e", "/q/e", 0, "", None)]
    f = spark.createDataFrame(rows, "context_id string, rel string, path string, size long, text string, error string")
    tokens = spark.createDataFrame([("/r/b.PY", 5), ("/r/gone", 7), ("/other", 9)], "path string, token_count long")
    get = lambda style: {(r["context_id"], r["ord"]): (r["tokens"], r["part"]) for r in LN.panel_parts(f, tokens, style).collect()}
    assert get("panel") == {
        ("c", 0): (0, "a.md\n```md\ntwo\nlines\n```\n\n"), ("c", 1): (5, "b.PY\n```py\nx``·y\n```\n\n"),
        ("c", 2): (7, "gone\n```\n[Error reading file: denied]\n```\n\n"),
        ("c", 3): (0, "huge.txt\n```txt\n[File too large: 11,534,336 bytes - skipped for performance]\n```\n\n"),
        ("d", 0): (0, "e\n```\n\n```\n\n")}
    assert get("lines") == {
        ("c", 0): (0, "a.md\n```md\ntwo\nlines\n```\n"), ("c", 1): (5, "b.PY\n```PY\nx```y\n```\n"), ("c", 2): (0, "[Error reading gone: denied]\n"),
        ("c", 3): (0, "huge.txt\n```txt\nt\n```\n"), ("d", 0): (0, "e\n```\n\n```\n")}
    whole = "".join(p for (c, _), (_, p) in sorted(get("panel").items()) if c == "c")
    good = f.where("text is not null")
    ctx = {r["context_id"]: r["text"] for r in PK.build_context_panel(good).collect()}
    assert whole.replace("gone\n```\n[Error reading file: denied]\n```\n\n", "") == ctx["c"]
    assert LN.panel_parts(f.limit(0), tokens).count() == 0
    with pytest.raises(ValueError):
        LN.panel_parts(f, tokens, "other")


def test_chunk_files_of_many_chunks(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = [("ctx", k, f"chunk {k}\r\n" + "é" * k) for k in range(1, 121)] + [("other", 1, "\x00one"), ("other", 2, ""), ("other", 3, None)]
    df = spark.createDataFrame(rows, CHUNKS).repartition(5)
    write_chunk_files(df, out)
    dirs = {r[1]: r[0] for r in df.select("context_id", context_dir_name("context_id")).distinct().collect()}
    got = {(dirs[r["ctx_dir"]], r["chunk_no"]): r["text"] for r in read_chunk_files(spark, out).collect()}
    assert got == {(c, k): t for c, k, t in rows if t}
    found = [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".md")]
    assert len(found) == 123 and {"aggregation_chunk_01.md", "aggregation_chunk_120.md"} <= set(found)
    write_chunk_files(df.where("context_id = 'ctx' and chunk_no < 3"), out)  # the last committed job counts
    assert read_chunk_files(spark, out).count() == 2
    write_chunk_files(df.limit(0), out)
    assert read_chunk_files(spark, out).count() == 0


def test_chunk_files_of_a_job_that_fails(spark, tmp_path):
    out = str(tmp_path / "out")
    write_chunk_files(spark.createDataFrame([("c", 1, "kept")], CHUNKS), out)
    bad = spark.createDataFrame([("c", 1, "a"), ("c", 1, "b"), ("d", 1, "x")], CHUNKS)
    with pytest.raises(Exception, match="two chunks are"):
        write_chunk_files(bad, out)
    assert [r["text"] for r in read_chunk_files(spark, out).collect()] == ["kept"]
    assert len([d for d in os.listdir(out) if d.startswith("job=")]) == 1 and os.path.isfile(os.path.join(out, MARKER))
