"""Files that can't be read, documents that don't parse, events of directories."""

import json
import os

from pyspark.sql import functions as F

from corpus_context.functions import rules as R
from corpus_context.operators import config as CF
from corpus_context.operators import scan as S
from corpus_context.sources import files as SF


def test_an_unreadable_file_keeps_its_row(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "src").mkdir(parents=True)
    (root / "src" / "good.py").write_text("a" * 40)
    (root / "src" / "bad.py").write_text("b" * 40)
    (root / "src" / ".bad.py.crc").write_bytes(b"crc\0\0\0\2\0wrong sum")  # a checksum that the content doesn't meet
    (root / "pic.png").write_text("x" * 100)
    for given in (str(root), f"file:{root}", f"file://{root}/"):
        rows = {os.path.relpath(r.path, str(root)): r for r in S.scan_corpus(spark, [given]).collect()}
        assert set(rows) == {"src", "src/good.py", "src/bad.py", "pic.png"}
        assert (rows["src/good.py"].is_valid, rows["src/good.py"].reason, rows["src/good.py"].token_count) == (True, "", 10)
        assert (rows["src/bad.py"].is_valid, rows["src/bad.py"].reason, rows["src/bad.py"].token_count) == (False, S.READ_ERROR, 0)
        assert rows["src"].is_dir
        assert rows["pic.png"].strategy == "skip" and rows["pic.png"].is_valid and rows["pic.png"].token_count == 0


def test_missing_content_in_a_table(spark):
    f = spark.createDataFrame([("/r", "/r/a.py", 5, None), ("/r", "/r/b.py", 5, bytearray(b"12345")), ("/r", "/r/c.png", 5, None)],
                              "root string, path string, size long, content binary")
    for two in (False, True):
        got = {r.path: (r.is_valid, r.reason, r.token_count) for r in S.corpus_tokens(f, two_pass=two).collect()}
        assert got["/r/a.py"] == (False, S.READ_ERROR, 0) and got["/r/b.py"] == (True, "", 1) and got["/r/c.png"][0]


def test_validate_file_reasons(spark):
    df = spark.createDataFrame([(False, None, None), (True, 300_000, None), (True, 10, "broken pipe"), (True, 10, None)], "e boolean, s long, x string")
    got = [tuple(r.v) for r in df.select(R.validate_file("e", "s", error="x").alias("v")).collect()]
    assert got == [(False, "File not found"), (False, "File too large (300000 bytes)"), (False, "Read error: broken pipe"), (True, "")]


def test_documents_v0_v1_and_corrupt(spark, tmp_path):
    w = {"folder_path": "/a", "instructions": "x"}
    given = {"v0": {"one": w, "two": w}, "v1": {"schema_version": 1, "last_active_workspace": "one", "workspaces": {"one": w}}, "list": [1, 2]}
    for name, doc in given.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "cut.json").write_text('{"one": {"folder_pa')
    (tmp_path / "empty.json").write_text(" ")
    docs = SF.read_documents(spark, str(tmp_path))
    assert {r.doc_id: r.is_valid for r in docs.collect()} == {"v0": True, "v1": True, "list": False, "cut": False, "empty": False}
    got = sorted((r.doc_id, r.workspace, r.active_selection_group) for r in CF.read_workspaces(docs.where("is_valid")).collect())
    assert got == [("v0", "one", "Default"), ("v0", "two", "Default"), ("v1", "one", "Default")]
    t = CF.read_templates(docs.where("doc_id in ('cut', 'list')").select(F.col("doc_id").alias("workspace"), "json")).collect()
    assert {(r.workspace, r.name) for r in t} == {("cut", "Default"), ("list", "Default")}


def test_directory_events_are_dropped(spark, tmp_path):
    one = spark.createDataFrame([("/r", 1, "created", "/r/a", False), ("/r", 2, "created", "/r/d", True), ("/r", 3, "created", "/r/b", None)],
                                "root string, seq long, action string, src_path string, is_directory boolean")
    one.write.parquet(str(tmp_path / "in"))
    one.where("seq = 3").drop("is_directory").withColumn("seq", F.lit(4).cast("long")).write.mode("append").parquet(str(tmp_path / "in"))
    got = []
    q = SF.fs_event_source(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: got.extend(r.seq for r in df.collect()))
    q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [1, 3, 4]
