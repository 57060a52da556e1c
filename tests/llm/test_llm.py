"""The ten training-data operators and the pipeline against brute force, the libraries and SQL."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_context.llm import (bpe, bwt_dedup, chat, common, exact_dedup, jaccard_join, packing, quality, queries, topk,
                                toxicity, url_filter)
from tools.oracle_check import check, duck

SF = "/root/testdata/sf0.001"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, kept string, rank int, file string, n_chars long"


def texts(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, empties, nulls and one long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = say(70)
    out = [say(r.randint(1, 120)) for _ in range(n)]
    out += [out[0], out[0], out[1] + " ", passage, say(20) + " " + passage + " " + say(9), passage + say(30)]
    long = say(150).split()
    for k in range(4):
        near = list(long)
        near[10 + 30 * k] = "changed"
        out.append(" ".join(near))
    return out + ["", None, None, "a" * 1000, say(9000), "!!! ... ??", "Hi. one two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "f", len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: (r.text or "") for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    r = check(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert r["status"] == "ok", r


# 1 and 9 --------------------------------------------------------------------------------------
def test_toxicity_learns_and_handles_odd_rows(spark, none):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    bad = ["vile", "scum", "idiot"]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(40)] + toxic * [r.choice(bad) for _ in range(4)]), "x", 1, "f", 0))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "x", 1, "f", 0), (901, "", "x", 1, "f", 0), (902, "scum " * 5000, "x", 1, "f", 0), (None, "idiot vile", "x", 1, "f", 0)]
    d = spark.createDataFrame(rows + rows[:1], DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.classify(d, lab).collect()
    assert len(out) == len(rows) + 1
    held = [x for x in out if x.doc_id is not None and 300 <= x.doc_id < 400]
    assert sum(x.rejected == (x.doc_id % 4 == 0) for x in held) >= 0.95 * len(held)
    for x in out:
        assert 0 <= x.p_toxic <= 1 and x.p_toxic <= x.expected_severity <= 2 and 0 <= x.grade <= 2
        if x.doc_id in (900, 901):
            assert not x.rejected
    model = toxicity.fit(d, lab.limit(0))
    assert not any(x.rejected for x in toxicity.score(d, model).collect())
    assert toxicity.score(none, model).count() == 0


def test_toxicity_with_rare_toxic_labels(spark):
    r = random.Random(5)
    bad = [f"slur{k}" for k in range(8)]

    def text(toxic):
        words = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(30)] + toxic * r.sample(bad, 4)
        return " ".join(r.sample(words, len(words)))

    rows = [(i, text(i % 1001 == 0)) for i in range(12 * 1001)]  # 0.1 % toxic; the sample takes 4,000 clean ones
    new = [(100_000 + i, text(i < 200)) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 1001 == 0)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.score(spark.createDataFrame(new, d.schema), toxicity.fit(d, lab)).collect()
    assert sum(x.rejected for x in out if x.doc_id < 100_200) >= 140  # of 200, from 12 toxic rows
    assert sum(x.rejected for x in out if x.doc_id >= 100_200) <= 4


def test_ordinal_cuts_are_ordered_and_shared():
    from corpus_context.llm.linear import Sparse, fit_ordinal

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 5))
    grade = np.digitize(x @ [2.0, -1, 0, 1, 0] + rng.logistic(0, 0.3, 600), [0.5, 2.0])
    rows, cols = np.nonzero(x)
    w, cuts = fit_ordinal(Sparse(rows, cols, np.ones(len(rows)), 600, 5), grade, np.full(600, 1 / 600), 3, 1e-4, 2000)
    assert cuts[0] < cuts[1] and w[0] > 0 > w[1] and abs(w[2]) < 0.5


def test_toxicity_held_out_on_testdata(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = lab.where("doc_id % 2 = 0")
    out = toxicity.classify(d, half).join(lab.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [x for x in out if x.toxic == 0]
    assert sum(x.rejected for x in clean) <= 0.05 * len(clean)


@pytest.mark.parametrize("sf, caught, lost", [("sf0.1", 0.85, 0.006), ("check_s", 0.97, 0.001)])
def test_toxicity_held_out_at_the_shipped_threshold(spark, sf, caught, lost):
    if not os.path.exists(f"/root/testdata/{sf}"):
        pytest.skip(f"no {sf} on this machine")
    lab = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").join(lab.select("doc_id"), "doc_id", "left_semi")
    odd = lab.where("doc_id % 2 = 1")
    model = toxicity.fit(d, lab.where("doc_id % 2 = 0"))
    n = toxicity.score(d, model).join(odd, "doc_id").groupBy("toxic").agg(
        F.count_if("rejected").alias("rejected"), F.count(F.lit(1)).alias("all")).collect()
    n = {r.toxic: (r.rejected, r.all) for r in n}
    print(sf, n)
    assert n[1][0] >= caught * n[1][1] and n[0][0] <= lost * n[0][1], n


def test_quality_against_labels_and_odd_rows(spark, none):
    out = queries.QUERIES["op9_quality"](spark, "/root/testdata/sf0.01")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(lab, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None, "x", 1, "f", 0), (None, "", "x", 1, "f", 0), (2, "a", "x", 1, "f", 0)], DOCS)
    assert quality.classify(odd).count() == 3
    assert quality.classify(none).count() == 0


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.9
    pats = Counter()
    for g in good:
        pats["".join("g" if (g and rng.random() < 0.995) or (not g and rng.random() > 0.6) else "b" for _ in range(9))] += 1
    p, on_good, on_bad, share = quality.estimate(list(pats), list(pats.values()))
    assert abs(share - 0.9) < 0.02 and np.abs(on_bad - 0.6).max() < 0.1 and on_good.min() > 0.98


@pytest.mark.parametrize("on_good, on_bad, share", [
    (np.linspace(0.7, 0.9, 9), 0.6, 0.8), (np.linspace(0.9, 0.7, 9), 0.5, 0.9), (np.r_[0.7, [0.99] * 8], 0.4, 0.9)])
def test_em_finds_labellers_that_misfire_on_good_documents(on_good, on_bad, share):
    """The prior says 0.995; the votes say otherwise, and outweigh it."""
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < share
    faults = np.where(good[:, None], rng.random((20_000, 9)) >= on_good, rng.random((20_000, 9)) < on_bad)
    pats = Counter("".join("gb"[int(f)] for f in row) for row in faults)
    _, found_good, found_bad, found_share = quality.estimate(list(pats), list(pats.values()))
    assert np.abs(found_good - on_good).max() < 0.03 and np.abs(found_bad - on_bad).max() < 0.06
    assert abs(found_share - share) < 0.03


# 2 --------------------------------------------------------------------------------------------
def test_exact_dedup_with_colliding_digests_and_several_batches(spark, docs, tmp_path, none):
    path = str(tmp_path / "d")
    docs.repartition(5).write.parquet(path)
    expect = defaultdict(list)
    for i, t in by_id(docs).items():
        expect[t].append(i)
    weak = lambda t: F.length(t).cast("string")
    for digest in (exact_dedup.sha256, weak):
        out = exact_dedup.dedup_path(spark, path, digest=digest, bytes_per_trigger=1).collect()
        assert len(out) == docs.count()
        for r in out:
            own = expect[r.text or ""]
            assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
            assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
            assert (r.rank, r.n_chars) == (1, len(r.text or ""))
    twice = docs.where("doc_id = 1").unionByName(docs.where("doc_id = 1")).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.kept for r in exact_dedup.dedup(twice).collect()) == [False, True]
    assert exact_dedup.dedup(none).count() == 0


def test_exact_dedup_state_goes_on_with_new_files(spark, docs, tmp_path):
    path, state = str(tmp_path / "d"), str(tmp_path / "s")
    docs.where("doc_id < 30").write.parquet(path)
    assert exact_dedup.dedup_path(spark, path, state_dir=state).count() == 30
    docs.where("doc_id >= 30").write.mode("append").parquet(path)
    out = {r.doc_id: r.group_size for r in exact_dedup.dedup_path(spark, path, state_dir=state).collect()}
    same = Counter(by_id(docs).values())
    assert out == {i: same[t] for i, t in by_id(docs).items()}


# 3 --------------------------------------------------------------------------------------------
def test_topk_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-3, 4, (300, 6))
    rows = [(i, [float(x) / 64 for x in a]) for i, a in enumerate(v)]
    odd = [(500, None), (501, [1.0, None]), (502, [float("nan")] * 6), (503, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").select(
        "vec_id", topk.quantised(F.col("embedding")).alias("v"))
    out = topk.topk(df, F.col("vec_id") % 20 == 0, 20, query_block=4, candidate_block=64).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 300, 20):
        s = sorted((-int(v[q] @ v[c]), c) for c in range(300) if c != q)[:20]
        assert got[q] == [(c, -x) for x, c in s]
    assert set(got) == set(range(0, 300, 20))
    assert topk.topk(df.limit(0), F.lit(True)).count() == 0


# 4 --------------------------------------------------------------------------------------------
def test_url_filter_intervals_and_precedence(spark):
    ts = lambda d: f"2024-{d} 00:00:00"
    changes = spark.createDataFrame([
        ("a", "block", "x.com", "added", ts("01-10")), ("a", "block", "x.com", "added", ts("01-20")),
        ("a", "block", "x.com", "removed", ts("03-01")), ("a", "block", "x.com", "added", ts("05-01")),
        ("b", "allow", "x.com/ok", "added", ts("01-01")), ("b", "block", "y.org", "removed", ts("01-01")),
        ("b", "block", "z.org", "added", ts("02-02")), ("b", "block", "z.org", "removed", ts("02-02")),
        ("b", "block", None, "added", ts("01-01")), ("b", "block", "y.org", "added", None)],
        "list string, verdict string, key string, action string, at string").withColumn("at", F.col("at").cast("timestamp"))
    caps = [(1, "http://www.X.com/a", ts("01-09")), (2, "http://www.x.com/a", ts("02-15")), (3, "http://x.com/ok/1", ts("02-15")),
            (4, "http://x.com", ts("04-01")), (5, "http://x.com", ts("12-01")), (6, "http://y.org", ts("02-01")),
            (7, "http://z.org", ts("02-02")), (8, None, ts("02-02")), (9, "nonsense", ts("02-02")), (10, "http://x.com", None),
            (2, "http://x.com/a", ts("01-01"))]
    df = spark.createDataFrame(caps, "page_id long, url string, fetched_at string").withColumn(
        "fetched_at", F.col("fetched_at").cast("timestamp")).withColumn("verdict", F.lit("old"))
    got = sorted((r.page_id, r.blocked) for r in url_filter.evaluate(df, changes, "page_id").collect())
    assert got == [(1, False), (2, False), (2, True), (3, False), (4, False), (5, True), (6, False), (7, False),
                   (8, False), (9, False), (10, False)]
    assert url_filter.evaluate(df, changes.limit(0), "page_id").where("blocked").count() == 0
    assert url_filter.evaluate(df.limit(0), changes, "page_id").count() == 0


# 5 --------------------------------------------------------------------------------------------
def links_of(found):
    sets = {}
    for i, t in found.items():
        w = [x for x in (re.sub(r"\W+", "", c.lower()) for c in t.split()) if x]
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    near = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    label = {}
    for i in sorted(near):
        stack = [] if i in label else [i]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = i
                stack += near[x]
    return label, {i: len(n) for i, n in near.items()}


def test_jaccard_join_against_all_pairs(spark, docs, none, monkeypatch):
    label, n = links_of(by_id(docs))
    for block in (256, 2):  # 2: every bucket and group is split
        monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", block)
        monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", block)
        out = jaccard_join.near_duplicates(docs).collect()
        assert {r.doc_id: r.class_id for r in out} == label and {r.doc_id: r.n_links for r in out} == n
    assert any(n.values()) and jaccard_join.near_duplicates(none).count() == 0
    odd = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_links for r in jaccard_join.near_duplicates(odd).collect()) == sorted(n.values())


def test_pruning_keeps_pairs_at_the_threshold():
    rng, lost = np.random.default_rng(4), 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 900, dtype=np.uint64)
        x, y = np.unique(a), np.unique(np.r_[a[100:], rng.integers(0, 2**63, 100, dtype=np.uint64)])
        sig = np.stack([jaccard_join.minhash(x), jaccard_join.minhash(y)])
        lost += not len(jaccard_join.surviving(sig, np.array([0]), np.array([1])))
    assert lost == 0


# 6 --------------------------------------------------------------------------------------------
def spans_of(found):
    seen = Counter(t[s : s + 200] for t in found.values() for s in range(len(t) - 199))
    out = {}
    for i, t in found.items():
        cover = np.zeros(len(t) + 1, int)
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                cover[s] += 1
                cover[s + 200] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out[i] = [tuple(x) for x in edge.reshape(-1, 2).tolist()], np.frombuffer(t, np.uint8)[~gone].tobytes()
    return out


@pytest.mark.parametrize("hot", [bwt_dedup.HOT, 1])
def test_repeats_against_all_windows(spark, docs, none, hot):
    expect = spans_of({i: t.encode() for i, t in by_id(docs).items()})
    for r in bwt_dedup.remove_repeats(docs.withColumn("spans", F.lit(1)), hot=hot).collect():
        assert ([(s["start"], s["end"]) for s in r.spans], bytes(r.kept)) == expect[r.doc_id]
    assert bwt_dedup.remove_repeats(none).count() == 0
    same = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert len({bytes(r.kept) for r in bwt_dedup.remove_repeats(same).collect()}) == 1


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "_SEGMENT", 4096)
    r = random.Random(6)
    body = "".join(r.choice("abcd") for _ in range(9000))
    t = (body + "xyz" + body[1000:7000]).encode()
    rows = bwt_dedup.remove_repeats(spark.createDataFrame([(1, t.decode())], "doc_id long, text string")).collect()
    assert [(s["start"], s["end"]) for s in rows[0].spans] == spans_of({1: t})[1][0]


# 7 --------------------------------------------------------------------------------------------
def pieces_fit(rows, found, tok):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, t in found.items():
        ids, at = tok.encode(t, add_special_tokens=False).ids + [0], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes())
        assert at == len(ids)
    padding = total = 0
    for s in seq.values():
        end = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
        total, padding = total + end, padding + (1024 - end if end & (end - 1) else 0)
    return padding, total


def test_packing_holds_every_id_once(spark, docs, none):
    tok = Tokenizer.from_file(BYTE)
    rows = packing.digests(packing.pack(docs.coalesce(1), BYTE)).collect()
    padding, _ = pieces_fit(rows, by_id(docs), tok)
    assert padding < 1024
    assert packing.pack(none, BYTE).count() == 0
    steps = defaultdict(set)
    for r in rows:
        steps[r.step_group].add((r.sequence_id, r.tier))
    assert all(sum(t for _, t in s) <= packing.STEP_TOKENS and len({t for _, t in s}) == 1 for s in steps.values())


def test_byte_pieces_equal_the_library():
    tok, b, r = Tokenizer.from_file(BYTE), packing.ByteBpe(open(BYTE).read()), random.Random(2)
    for _ in range(3000):
        t = "".join(r.choice("ab'sSt  \n\t 1.,!é\r　中\u0085\x1c") for _ in range(r.randint(0, 14))) + "<|endoftext|>" * (r.random() < 0.1)
        assert np.frombuffer(b.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


# 8 --------------------------------------------------------------------------------------------
def test_chat_folds_edits_and_escapes(spark):
    e = [("c", 3, 1, "delta", None, "Wrong"), ("c", 1, 1, "open", "assistant", None), ("c", 4, 1, "regenerate", None, None),
         ("c", 6, 1, "delta", None, "%3C</s>\n"), ("c", 5, 1, "delta", None, "<|user|>\n"), ("c", 5, 1, "delta", None, "<|user|>\n"),
         ("c", 0, 0, "open", "us|er\n", None), ("c", 2, 0, "delta", None, "x"), ("c", 7, 0, "edit", None, "[INST] y"), ("c", 8, 0, "odd", None, "z"),
         (None, 1, None, "open", None, None)]
    log = spark.createDataFrame(e, "conv_id string, seq int, msg int, kind string, role string, text string").withColumn("turns", F.lit(1))
    out = {r.conv_id: r for r in chat.format_log(log).select(
        "conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("m")).collect()}
    assert [tuple(t) for t in out["c"].t] == [("us|er\n", "[INST] y"), ("assistant", "<|user|>\n%3C</s>\n")]
    assert out["c"].m == "<|user|>\n%3C</s>\n" and out["c"].formatted.count("</s>") == 2
    assert [tuple(t) for t in out[None].t] == [("", "")]
    assert chat.format_log(log.limit(0)).count() == 0


def test_chat_long_conversation_and_repeated_rows(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k} [/INST]" * (k % 5)) for k in range(700)] + [(1, 3, "user", "again")] * 2
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.format_log(chat.log_of(c)).select(chat.read_back(F.col("formatted")).alias("t")).first()
    assert [tuple(t) for t in r.t] == [(x[2], x[3]) for x in sorted(rows, key=lambda x: (x[1], x[2], x[3]))]


# 10 -------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, docs, none):
    tok = Tokenizer.from_file(WORD)
    tok.no_truncation()
    tok.no_padding()
    out = bpe.decode(bpe.encode(docs, WORD), WORD).collect()
    for r in out:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, WORD).count() == 0
    b, r = bpe.PrefixBpe(open(WORD).read()), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab'sStTrevmldl  \n\té́Éßẞ1２İΣσς!?x\x1c　中") for _ in range(r.randint(0, 30))) + "<|endoftext|>" * (r.random() < 0.2)
        assert b.encode(t) == tok.encode(t, add_special_tokens=False).ids, t
    for t in ("a" * 3000, "ab" * 900, "xxx" * 500):
        assert b.encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_code_points_equal_the_libraries():
    """Every 13th code point, beside letters, digits and itself; those whose class has changed over the years among them."""
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    b, p = bpe.PrefixBpe(open(WORD).read()), packing.ByteBpe(open(BYTE).read())
    found = [f"a{chr(c)}b 1{chr(c)} {chr(c)}A" for c in [*range(0x80, 0x20000, 13), 0x558, 0xC5C, 0x1C89, 0x1E6E5, 0x180E] if not 0xD800 <= c < 0xE000]
    for tok, ids in (word, b.encode), (byte, lambda t: np.frombuffer(p.ids(t), "<u4").tolist()):
        tok.no_truncation()
        tok.no_padding()
        for t, e in zip(found, tok.encode_batch(found, add_special_tokens=False)):
            assert ids(t) == e.ids, t


def test_bpe_digests_and_memo_turnover(spark, docs, none, monkeypatch):
    tok = Tokenizer.from_file(WORD)
    tok.no_truncation()
    tok.no_padding()
    odd = docs.withColumn("n_tokens", F.lit("x")).withColumn("_x", F.lit(1))
    rows = bpe.digests(odd.unionByName(odd.limit(3)), WORD).collect()
    found = by_id(docs)
    assert len(rows) == len(found) + 3
    for r in rows:
        ids = tok.encode(found[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.digests(none, WORD).count() == 0
    asked = []
    memo = common.AgingMemo(lambda t: asked.append(t) or t * 2, limit=8)
    for _ in range(3):
        assert memo[3] == 6
    assert asked == [3, 3]  # kept from the second time on
    for k in range(100, 110):
        memo[k], memo[k], memo[3]
        memo.trim()
    assert asked.count(3) == 2 and len(memo) + len(memo.old) <= 8


# pipeline -------------------------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = d.columns, d
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = by_id(now)
        path = str(tmp_path / str(k))
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        if name == "packing":
            pieces_fit(now.collect(), before, Tokenizer.from_file(BYTE))
            break
        assert now.columns == columns
        after = by_id(now)
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity.classify(d, spark.read.parquet(f"{SF}/labels.parquet")).where("rejected").collect()}
            assert after == {i: t for i, t in before.items() if i not in rejected}
        elif name == "exact_dedup":
            last = {t: i for i, t in sorted(before.items())}
            assert after == {i: t for t, i in last.items()}
        elif name == "near_duplicates":
            label, _ = links_of(before)
            assert after == {i: t for i, t in before.items() if label[i] == i}
        else:
            expect = spans_of({i: t.encode() for i, t in before.items()})
            assert after == {i: expect[i][1].decode("utf-8", "replace") for i in before}
    assert k == len(corpus_pipeline.STAGES) - 1


def test_pipeline_keeps_extra_columns_of_any_name(spark, tmp_path):
    names = ["file", "row", "n", "digest", "top", "raw", "found", "row_key", "class_id", "n_links", "spans", "p_toxic", "rejected", "kept", "id",
             "pattern", "_key_", "a.b", "Text2"]
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    now = d.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    columns = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = str(tmp_path / str(k))
        stage(spark, now, SF).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == columns
        rows = now.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() > 0


def test_classes_keep_their_ids_beside_repeated_ones(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(100, long), (200, long + " end"), (300, "x y z"), (300, "x y z"), (7, "other " + "words " * 9), (None, long)]
    out = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("x"))).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.n_links) for r in out) == [(0, 100, 2), (7, 7, 0), (100, 100, 2), (200, 100, 2), (300, 300, 1), (300, 300, 1)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} - {100, 200, None} == {300, 7}


def test_samples_hold_one_text_per_id(spark):
    rows = [(1, f"bad text {k}") for k in range(300)] + [(k, f"good text {k}") for k in range(2, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 40)], "doc_id long, toxic int")
    n = {r.toxic: r["count"] for r in toxicity.sampled(d, lab, bound=10).groupBy("toxic").count().collect()}
    assert n == {0: 10, 1: 1}
    assert quality.classify(d, bound=50).count() == len(rows)


def test_pipeline_on_an_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0
