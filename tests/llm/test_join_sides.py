"""What may be broadcast: tables of counted rows, never what Spark takes for small."""

import random

import pytest

from corpus_context.llm import bwt_dedup, common, jaccard_join


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def near(spark):
    """40 texts of 60 words, each with a near copy."""
    r = random.Random(4)
    rows = []
    for k in range(40):
        text = " ".join(f"{r.choice('abcdefg')}{r.randint(1, 900)}" for _ in range(60))
        rows += [(2 * k, text), (2 * k + 1, text + " more")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_exploded_bands_are_not_broadcast(spark, near, monkeypatch):
    seen, dealt = [], jaccard_join._in_blocks
    monkeypatch.setattr(jaccard_join, "_in_blocks", lambda members, size, block: seen.append(members) or dealt(members, size, block))
    out = jaccard_join.near_duplicates(near).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in out} == {(k, k // 2 * 2, 1) for k in range(80)}
    bands = plan(seen[0])
    assert "SortMergeJoin" in bands and "Broadcast" not in bands


def test_sides_are_broadcast_by_their_rows_alone(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    rows = spark.range(50, 150)
    for join, want in ((common.keep_matching, range(50, 100)), (common.drop_matching, range(100, 150))):
        for bound, kind in ((100, "BroadcastHashJoin"), (99, "SortMergeJoin")):
            out = join(rows, keys, "id", bound)
            assert kind in plan(out) and [r.id for r in out.orderBy("id").collect()] == list(want)


def test_lists_of_repeats_are_not_broadcast(spark):
    """Their rows are as long as a document has repeats, and their files a seventh of that."""
    r = random.Random(5)
    passage = "".join(r.choices("abcdef ", k=300))
    texts = ["".join(r.choices("abcdef ", k=249)) + chr(65 + k) + passage * (k % 3) for k in range(12)]
    out = bwt_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "Inner, Build" not in plan(out) and "SortMergeJoin" in plan(out)
    kept = {x.doc_id: bytes(x.kept).decode() for x in out.collect()}
    assert kept == {k: t[:250] for k, t in enumerate(texts)}
