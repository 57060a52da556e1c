"""SimHash components, cross-tokenizer alignment and the Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus_context.llm import alignment, merkle, simhash
from corpus_context.llm.bpe import byte_characters
from corpus_context.llm.common import components

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns named like columns that the operators use or return.
SCHEMA = ("doc_id long, source string, lang string, n_chars long, text string, id long, fp long, bucket string, component_id long, "
          "fingerprint string, block int, pairs string, n_a string, place int, leaf string, tree int, rank int, path string, root string")
EXTRA = (7, 1, "b", 2, "f", 3, "p", "n", 4, "l", 5, 6, "p", "r")


def texts(seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßЖ中") for _ in range(r.randint(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    base = say(400).split()
    near = []
    for k in range(30):
        t = list(base)
        t[k * 13] = r.choice(words)
        near.append(" ".join(t))
    return [say(r.randint(1, 80)) for _ in range(60)] + near + near[:2] + [
        None, None, "", " ", "\n\t\x0b", "one", "One  two", "ONE\ttwo", "a\x1cb c\x85d é", "x" * 3000, say(20_000), "▁low line", "  two  spaces ",
        "line\nend\r\n", "<|endoftext|> </s> <0x41> <unk>", "🤔🏳️‍🌈 é Ᲊ Ɤ ՘", "\0 nul", "ﬁ ﷺ"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, r.choice([None, "a", "é", "Z", "hot", "hot", "hot"]), r.choice([None, "en"]), r.choice([None, 3]), t, *EXTRA)
           for i, t in enumerate(texts())]
    return out + out[:3] + out[:1] + [(None, "a", None, None, "null id", *EXTRA), (None, None, None, None, None, *EXTRA), (-5, "lone", "x", 1, "one", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def ordered(found):
    return sorted(map(tuple, found), key=str)


# 11 -------------------------------------------------------------------------------------------
def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=3):
    """Component (as a representative) of each fingerprint, all pairs compared."""
    u = np.array(sorted(set(fps)), np.uint64)
    up = list(range(len(u)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k in range(len(u)):
        for j in np.nonzero(np.bitwise_count(u[k + 1 :] ^ u[k]) <= radius)[0] + k + 1:
            a, b = find(k), find(int(j))
            up[max(a, b)] = min(a, b)
    return {int(x): find(k) for k, x in enumerate(u)}


@pytest.mark.parametrize("block", [512, 1])
def test_simhash_components_equal_brute_force(spark, docs, rows, block):
    fps = [fingerprint(r[4]) for r in rows]
    of, least = linked(fps), {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[of[f]] = min(least.get(of[f], r[0]), r[0])
    out = simhash.near_duplicates(docs, block=block)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert ordered(out.collect()) == ordered((r[0], f"{f:016x}", least.get(of[f])) for r, f in zip(rows, fps))
    assert len(set(least.values())) < len(set(fps))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_every_pair_within_the_radius_meets_in_a_mask():
    r = random.Random(1)
    for free in (2**64 - 1, simhash.masks(2**64 - 1)[3] ^ (2**64 - 1), 0b1111111000):
        places = [i for i in range(64) if free >> i & 1]
        found = simhash.masks(free)
        assert len(found) == 15 and all(m & ~free == 0 for m in found)
        for _ in range(3000):
            flip = sum(1 << p for p in r.sample(places, r.randint(1, 3)))
            assert any(m & flip == 0 for m in found)


@pytest.mark.parametrize("block", [1024, 128])
def test_dense_buckets_lose_no_link(spark, block):
    """Thousands of fingerprints that agree in most bits: buckets are covered again and again."""
    r = random.Random(3)
    fps = {(r.getrandbits(12) << 40 | r.getrandbits(3)) ^ (0x9E3779B97F4A7C15 if r.random() < 0.5 else 0) for _ in range(1500)}
    signed = [(f - 2**64 if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    label = {x.node: x.label for x in components(simhash.links(nodes, block), bound=10).collect()}
    of, got = linked(fps), defaultdict(set)
    for f in fps:
        s = f - 2**64 if f >> 63 else f
        got[label.get(s, s)].add(f)
    expected = defaultdict(set)
    for f in fps:
        expected[of[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_stars_chains_and_nothing(spark):
    edges = [(1000, k) for k in range(2000, 2300)] + [(k, k + 1) for k in range(100)] + [(-3, 2299), (5, 5)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), bound=5).collect()}
    assert found == {-3: -3, 1000: -3, **{k: -3 for k in range(2000, 2300)}, **{k: 0 for k in range(101)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 12 -------------------------------------------------------------------------------------------
def aligned(rows):
    a_lib, b_lib = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_characters())}

    def a_bytes(i):
        return bytes(byte[c] for c in a_lib.id_to_token(i))

    def b_bytes(i):
        piece = b_lib.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(ids, of):
        return np.cumsum([len(of(i)) for i in ids]).tolist()

    count, per = Counter(), []
    for key, text in rows:
        a = b = []
        if text:
            raw = (" " + text).encode()
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
                a = b = []
        ends_a, ends_b = ends(a, a_bytes), ends(b, b_bytes)
        groups, i, j = [], 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        count.update(links.keys())
        shown = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        per.append((key, len(a), len(b), len(groups), links, hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    return [(key, n_a, n_b, n, sum(links.values()), sum(m for p, m in links.items() if count[p] == top[p[0]]),
             sum(m * count[p] for p, m in links.items()), sha) for key, n_a, n_b, n, links, sha in per]


@pytest.mark.parametrize("block", [4 << 20, 700])
def test_alignment_equals_brute_force(spark, docs, rows, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    out = alignment.align(docs, BYTE, PIECE)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = aligned([(r[0], r[4]) for r in rows])
    assert ordered(out.collect()) == ordered(expected)
    assert any(x[1] == 0 and r[4] for x, r in zip(expected, rows)) and any(x[4] > x[3] for x in expected)
    assert alignment.align(docs.limit(0), BYTE, PIECE).count() == 0
    assert alignment.align(docs.where("text is null"), BYTE, PIECE).where("n_a = 0 and groups_sha256 = ''").count() == 3


# 13 -------------------------------------------------------------------------------------------
def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        start = at // 3 * 3
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + 3])))
        at //= 3
    return out


def manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in by[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for place, s in enumerate(sources):
        for at, r in enumerate(by[s]):
            path = siblings(trees[s], at) + siblings(top, place)
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in path:
                node = digest(left + node + right)
            yield (r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), node, node == top[-1][0])


@pytest.mark.parametrize("block_levels, records", [(7, 10_000), (2, 1)])
def test_merkle_proofs_equal_brute_force(spark, docs, rows, block_levels, records, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    monkeypatch.setattr(merkle, "BROADCAST_RECORDS", records)
    out = merkle.verify(docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = list(manifest(rows))
    assert ordered(out.collect()) == ordered(expected)
    assert {x[-1] for x in expected} == {True, False}


def test_merkle_of_one_row_one_source_and_nothing(spark, docs, rows):
    one = docs.where("doc_id = -5")
    [r] = merkle.verify(one).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == digest("")
    hot = [r for r in rows if r[1] == "hot"]
    assert ordered(merkle.verify(docs.where("source = 'hot'")).collect()) == ordered(manifest(hot))
    assert merkle.verify(docs.limit(0)).count() == 0


def test_merkle_requests_read_only_their_paths(spark, docs):
    m = merkle.build(docs)
    every = {(r.tree, r["rank"]): (r.leaf, r.path) for r in merkle.prove(m).collect()}
    asked = [k for k in every if k[1] % 7 == 3 or k[0] == 1]
    got = merkle.prove(m, spark.createDataFrame(asked + asked[:1], "tree long, rank long")).collect()
    assert {(r.tree, r["rank"]): (r.leaf, r.path) for r in got} == {k: every[k] for k in asked} and len(got) == len(asked)
    folded = merkle.prove(m).select(merkle.folded(F.col("leaf"), F.col("path")).alias("root")).distinct().collect()
    assert [r.root for r in folded] == [m.root]


def test_tree_heights(spark):
    got = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 9, 10, 243, 244, 3**30, 3**30 + 1)], "n long").select(merkle.height_of(F.col("n")))
    assert [r[0] for r in got.collect()] == [0, 1, 1, 2, 2, 3, 5, 6, 30, 31]
