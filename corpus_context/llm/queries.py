"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_context.llm import (alignment, bpe, bwt_dedup, chat, exact_dedup, jaccard_join, merkle, packing, quality, simhash, topk,
                                toxicity, url_filter)
from corpus_context.llm.common import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# 2 ------------------------------------------------------------------------------------------
@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_path(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# 4 ------------------------------------------------------------------------------------------
EPOCH, DAY = 1704067200, 86400  # 2024-01-01


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated list changes derived from the hosts of ``pages`` (three lists; entries are added,
    removed and added again on days that follow from the host's pages)."""
    h = pages.select(url_filter.host(F.col("url")).alias("h"), "page_id").where("h != ''").groupBy("h").agg(
        F.min("page_id").alias("p"), F.count(F.lit(1)).alias("n"))
    day, gap = F.col("p") % 200, F.col("n") % 50

    def change(when, name, verdict, key, action, on):
        return F.when(when, F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), key.alias("key"),
                                     F.lit(action).alias("action"), F.timestamp_seconds(EPOCH + on * DAY).alias("at")))

    abuse = (F.col("p") % 2 == 0) | F.col("h").startswith("spam-farm")
    parent = F.regexp_replace("h", r"^[^.]*\.", "")
    deep = (F.size(F.split("h", r"\.")) >= 4) & (F.col("p") % 4 == 1)
    c = F.array(
        change(abuse, "abuse", "block", F.col("h"), "added", day),
        change(abuse & (F.col("p") % 3 != 0), "abuse", "block", F.col("h"), "removed", day + 20 + gap),
        change(abuse & (F.col("p") % 3 == 1), "abuse", "block", F.col("h"), "added", day + 100 + gap),
        change(F.col("p") % 5 == 0, "partners", "allow", F.concat("h", F.lit("/en")), "added", F.lit(30)),
        change(deep, "domains", "block", parent, "added", F.col("p") % 100),
        change(deep, "domains", "block", parent, "removed", F.col("p") % 100 + 60))
    return h.select(F.explode(F.filter(c, lambda x: x.isNotNull())).alias("c")).select("c.*")


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(EPOCH + F.col("page_id") * 7919 % (365 * DAY)))
    return url_filter.evaluate(captures, list_changes(pages), "page_id").drop("url", "fetched_at")


SQL["op4_url_filter"] = r"""
WITH c AS (SELECT page_id, url, 1704067200 + page_id * 7919 % (365 * 86400) AS fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', '') AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
hosts AS (SELECT h, min(page_id) AS p, count(*) AS n FROM c WHERE h <> '' GROUP BY h),
abuse AS (SELECT *, p % 200 AS d, n % 50 AS gap FROM hosts WHERE p % 2 = 0 OR starts_with(h, 'spam-farm')),
deep AS (SELECT *, regexp_replace(h, '^[^.]*\.', '') AS parent FROM hosts
         WHERE len(string_split(h, '.')) >= 4 AND p % 4 = 1),
changes AS (
  SELECT 'abuse' AS list_name, 'block' AS verdict, h AS key, 'added' AS action, d AS on_day FROM abuse
  UNION ALL SELECT 'abuse', 'block', h, 'removed', d + 20 + gap FROM abuse WHERE p % 3 <> 0
  UNION ALL SELECT 'abuse', 'block', h, 'added', d + 100 + gap FROM abuse WHERE p % 3 = 1
  UNION ALL SELECT 'partners', 'allow', h || '/en', 'added', 30 FROM hosts WHERE p % 5 = 0
  UNION ALL SELECT 'domains', 'block', parent, 'added', p % 100 FROM deep
  UNION ALL SELECT 'domains', 'block', parent, 'removed', p % 100 + 60 FROM deep),
edges AS (SELECT *, lag(action) OVER (PARTITION BY list_name, verdict, key ORDER BY on_day, action) AS before FROM changes),
iv AS (SELECT *, lead(on_day) OVER (PARTITION BY list_name, verdict, key ORDER BY on_day, action) AS until
       FROM edges WHERE action <> coalesce(before, 'removed')),
active AS (SELECT list_name, verdict, key, 1704067200 + on_day * 86400 AS f, 1704067200 + until * 86400 AS t FROM iv
           WHERE action = 'added' AND (until IS NULL OR until > on_day)),
labels_of AS (SELECT page_id, fetched, h, string_split(h, '.') AS l FROM c WHERE h <> ''),
keys AS (
  SELECT page_id, fetched, 0 AS r, h || '/' || seg AS key FROM c WHERE h <> '' AND seg <> ''
  UNION ALL SELECT page_id, fetched, i AS r, array_to_string(l[i:], '.') FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM labels_of)),
hits AS (SELECT page_id, r, verdict, list_name, active.key FROM keys JOIN active USING (key)
         WHERE fetched >= f AND (t IS NULL OR fetched < t)),
ranked AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n_active,
                  row_number() OVER (PARTITION BY page_id ORDER BY r, verdict, list_name, key) AS k FROM hits)
SELECT pages.page_id, coalesce(verdict = 'block', false) AS blocked, verdict, key AS matched_key,
       list_name AS matched_list, coalesce(n_active, 0) AS n_active
FROM pages LEFT JOIN ranked ON ranked.page_id = pages.page_id AND k = 1
"""

# 8 ------------------------------------------------------------------------------------------
_CONTROL_CASE = "</s>[INST] ok [/INST]"


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                 F.lit(_CONTROL_CASE))
    out = chat.format_log(chat.log_of(rows.union(case)))
    back = out.select("*", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '%', '%25')"
    for s in chat.CONTROL:
        out = f"replace({out}, '{s}', '{chat._CODES[s[0]] + s[1:]}')"
    return out


SQL["op8_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL_CASE}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL_CASE}'),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS shown,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
        sum(10 + length(role) + length({_sql_escape('text')})) AS formatted_chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(shown) AS turns_sha256, length(learned) AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""


# 7 ------------------------------------------------------------------------------------------
@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


# 10 -----------------------------------------------------------------------------------------
@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)


# 3 ------------------------------------------------------------------------------------------
@query
def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    return topk.topk(e, F.col("vec_id") % 20 == 0)


SQL["op3_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


# 1 ------------------------------------------------------------------------------------------
@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels")).drop("text")


# 9 ------------------------------------------------------------------------------------------
@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


# 5 ------------------------------------------------------------------------------------------
@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "class_id", "n_links")


# 6 ------------------------------------------------------------------------------------------
@query
def op6_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bwt_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


# 11 -----------------------------------------------------------------------------------------
@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# 12 -----------------------------------------------------------------------------------------
@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


# 13 -----------------------------------------------------------------------------------------
@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def _sql_field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_CRC_BIT = "xor(c.x // 2, CASE c.x % 2 WHEN 1 THEN 3988292384 ELSE 0 END)"  # the reversed polynomial (fixed value)

SQL["op13_merkle"] = f"""
WITH RECURSIVE crc(doc_id, rest, bit, x) AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR, 8, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, CASE bit WHEN 8 THEN rest[2:] ELSE rest END, CASE bit WHEN 8 THEN 1 ELSE bit + 1 END,
         CASE bit WHEN 8 THEN xor(xor(c.x, ascii(rest[1])) // 2, CASE xor(c.x, ascii(rest[1])) % 2 WHEN 1 THEN 3988292384 ELSE 0 END)
                  ELSE {_CRC_BIT} END
  FROM crc c WHERE bit < 8 OR rest <> ''),
odd AS (SELECT doc_id FROM crc WHERE rest = '' AND bit = 8 AND x % 2 = 1),
d AS (SELECT *, {_sql_leaf('text')} AS leaf, doc_id IN (SELECT doc_id FROM odd) AS tampered FROM documents),
e AS (SELECT doc_id, source, leaf, CASE WHEN tampered THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE leaf END AS changed,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
        count(*) OVER (PARTITION BY source) AS n FROM d),
nodes(h, source, i, digest, n) AS (
  SELECT 0, source, rank, leaf, n FROM e
  UNION ALL SELECT h + 1, source, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY h, source, i // 3, n),
subroots AS (SELECT source, h AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
above(h, i, digest, n) AS (
  SELECT 0, rank, digest, n FROM subroots
  UNION ALL SELECT h + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM above WHERE n > 1 GROUP BY h, i // 3, n),
steps AS (
  SELECT a.h, a.source, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.h = b.h AND a.source IS NOT DISTINCT FROM b.source AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
steps_above AS (
  SELECT a.h, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM above a JOIN above b ON a.h = b.h AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
fold(source, rank, h, node, proof) AS (
  SELECT source, rank, 0, changed, '' FROM e
  UNION ALL SELECT f.source, f.rank, f.h + 1, sha256(s.l || node || s.r), proof || s.l || s.r
  FROM fold f JOIN steps s ON s.h = f.h AND s.source IS NOT DISTINCT FROM f.source AND s.i = f.rank // (3 ** f.h)::BIGINT),
up(source, rank, place, h, node, proof, subroot) AS (
  SELECT f.source, f.rank, s.rank, 0, node, proof, s.digest FROM fold f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source AND s.height = f.h
  UNION ALL SELECT u.source, u.rank, place, u.h + 1, sha256(s.l || node || s.r), proof || s.l || s.r, subroot
  FROM up u JOIN steps_above s ON s.h = u.h AND s.i = place // (3 ** u.h)::BIGINT),
root AS (SELECT h, digest FROM above WHERE n = 1)
SELECT e.doc_id, e.leaf, u.subroot, root.digest AS root, sha256(u.proof) AS proof_sha256, u.node AS folded_root, u.node = root.digest AS verified
FROM e JOIN up u ON u.source IS NOT DISTINCT FROM e.source AND u.rank = e.rank JOIN root ON root.h = u.h
"""
