"""Registered queries: packing, tree text, contexts and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.functions import text as X
from corpus_context.functions import tokens as TK
from corpus_context.operators import lines as LN
from corpus_context.operators import pack as PK
from corpus_context.operators import scan as S
from corpus_context.operators import selection as SEL
from corpus_context.plans.oracle_views import IGNORE_SQL, VIEWS, DEPS, with_views
from corpus_context.plans.registry import QUERIES, query
from corpus_context.sources import testdata as TD

TOKEN_LIMIT = 2000
CHAR_LIMIT = 8000


def contexts(spark, sf):
    ws = TD.workspaces(spark, sf, with_groups=False)
    return ws.select(F.col("workspace").alias("context_id"), F.col("folder_path").alias("root"),
                     F.col("instructions").alias("prompt"))


def selected_files(spark, sf):
    """J3 + J1: files of each workspace's active group that exist and are not in ignored folders."""
    ws = TD.workspaces(spark, sf, with_groups=False)
    sel = SEL.selected_files(ws, TD.selections(spark, sf))
    f = S.attach_settings(TD.files(spark, sf), ws)
    f = f.where(R.prune_ignored("path", "root", F.col("ignore")))
    j = sel.join(f.select("root", "path", "size", "content"), ["root", "path"])
    return j.select(F.col("workspace").alias("context_id"), "rel", "path", "size",
                    X.read_text(j, newline="universal").alias("text"))


def all_files(spark, sf):
    """Every kept file of each root as a packing part (context = root), text mode."""
    ws = TD.workspaces(spark, sf, with_groups=False)
    f = S.attach_settings(TD.files(spark, sf), ws)
    f = f.where(R.prune_ignored("path", "root", F.col("ignore")))
    return f.select(F.col("root").alias("context_id"), P.to_relative("path", "root").alias("rel"), "path", "size",
                    X.read_text(f, newline="universal").alias("text"))


# ---------------------------------------------------------------------------
# oracle building blocks
# ---------------------------------------------------------------------------

VIEWS["ctx"] = """
SELECT workspace AS context_id, workspace AS root, instructions AS prompt FROM ws
UNION ALL SELECT '/corpus/live', '/corpus/live', ''"""
DEPS["ctx"] = ["ws"]

VIEWS["sel_files"] = f"""
SELECT s.workspace AS context_id, s.path AS rel, k.path, k.size, regexp_replace(k.text, '\\r\\n?', chr(10), 'g') AS text
FROM (SELECT DISTINCT workspace, path FROM selections WHERE group_name = 'Default') s
JOIN kept k ON k.root = s.workspace AND k.rel = s.path"""
DEPS["sel_files"] = ["selections", "kept"]

VIEWS["all_parts"] = """
SELECT root AS context_id, rel, path, size, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM kept"""
DEPS["all_parts"] = ["kept"]


def _lang_sql(rel):
    return f"lower(regexp_replace(regexp_extract(regexp_extract({rel}, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1), '^\\.', ''))"


def _hf_sql(rel):
    return f"chr(10) || '`' || {rel} || '`' || chr(10) || '```' || {_lang_sql(rel)} || chr(10)"


_PACKER_BIN = " OR ".join(f"ends_with(path, '{s}')" for s in R.PACKER_BINARY_SUFFIXES)
_XML_BIN_LIST = ", ".join("'" + e + "'" for e in R.XML_BINARY_NAMES)


def _tree_sql(src: str) -> str:
    """CTEs building tree(context_id, tree) from src(context_id, rel) and ctx."""
    return f"""
tn0 AS (SELECT DISTINCT context_id, string_split(rel, '/') AS c FROM {src}),
tn1 AS (SELECT context_id, c, unnest(range(1, len(c) + 1)) AS d FROM tn0),
tn AS (SELECT context_id, array_to_string(list_slice(c, 1, d), '/') AS node, c[d] AS name, d,
              bool_or(d < len(c)) AS is_dir FROM tn1 GROUP BY ALL),
tk AS (SELECT *, list_transform(range(1, d + 1), lambda i: {{'is_dir': i < d OR is_dir, 'name': string_split(node, '/')[i]}}) AS key,
              CASE WHEN d > 1 THEN regexp_extract(node, '^(.*)/[^/]*$', 1) ELSE '' END AS parent FROM tn),
tl AS (SELECT context_id, key,
              repeat(' ', CAST((d - 1) * 4 AS BIGINT)) ||
              CASE WHEN lead(1) OVER (PARTITION BY context_id, parent ORDER BY is_dir, name) IS NULL THEN '└── ' ELSE '├── ' END ||
              name || CASE WHEN is_dir THEN '/' ELSE '' END AS line FROM tk),
tb AS (SELECT context_id, string_agg(line, chr(10) ORDER BY key) AS body FROM tl GROUP BY context_id),
tree AS (SELECT c.context_id, regexp_extract(c.root, '([^/]+)$', 1) || '/' || coalesce(chr(10) || tb.body, '') AS tree
         FROM ctx c LEFT JOIN tb ON tb.context_id = c.context_id)"""


def _walk_sql(parts: str, seeds: str, limit: int, guard: bool) -> str:
    """CTEs: walk(context_id, rn, h, cur, chunk_no), the sequential next-fit rule, one step per file.

    parts(context_id, rn (1-based), t); seeds(context_id, h)."""
    cond = f"w.cur + p.t > {limit}" + (" AND w.cur > 0" if guard else "")
    return f"""
walk(context_id, rn, h, cur, chunk_no) AS (
  SELECT context_id, 0, h, h, 1 FROM {seeds}
  UNION ALL
  SELECT w.context_id, w.rn + 1, w.h,
         CASE WHEN {cond} THEN w.h + p.t ELSE w.cur + p.t END,
         CASE WHEN {cond} THEN w.chunk_no + 1 ELSE w.chunk_no END
  FROM walk w JOIN {parts} p ON p.context_id = w.context_id AND p.rn = w.rn + 1)"""


def _packer_parts_sql(src: str) -> str:
    return f"""
pp AS (SELECT context_id, rel, text,
              CAST(length(text) // 4 + length({_hf_sql('rel')} || chr(10) || '```' || chr(10)) // 4 AS BIGINT) AS t,
              row_number() OVER (PARTITION BY context_id ORDER BY rel) AS rn
       FROM {src} WHERE NOT ({_PACKER_BIN}) AND length(text) - length(replace(text, chr(0), '')) <= 10 AND text <> '')"""


# ---------------------------------------------------------------------------


@query("render_tree", "R6 J3 J1", with_views(f"""
WITH {_tree_sql('sel_files')}
SELECT context_id, tree FROM tree""", "ctx", "sel_files"))
def q_render_tree(spark, sf):
    return PK.render_tree(selected_files(spark, sf).select("context_id", "rel"), contexts(spark, sf)).select("context_id", "tree")


@query("render_tree_flat", "R7", with_views("""
WITH d AS (SELECT context_id, rel, regexp_extract(rel, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(rel, '([^/]*)$', 1) AS name
           FROM (SELECT DISTINCT context_id, rel FROM sel_files)),
l AS (SELECT context_id, dir, name,
             CASE WHEN lead(1) OVER (PARTITION BY context_id, dir ORDER BY name) IS NULL THEN '│   └── ' ELSE '│   ├── ' END || name AS l FROM d),
b AS (SELECT context_id, dir, '├── ' || CASE WHEN dir = '' THEN '(root)' ELSE dir || '/' END || chr(10) || string_agg(l, chr(10) ORDER BY name) AS block
      FROM l GROUP BY context_id, dir),
body AS (SELECT context_id, string_agg(block, chr(10) ORDER BY dir) AS body FROM b GROUP BY context_id)
SELECT c.context_id, 'Project: ' || regexp_extract(c.root, '([^/]+)$', 1) || coalesce(chr(10) || body.body, '') AS tree
FROM ctx c LEFT JOIN body ON body.context_id = c.context_id""", "ctx", "sel_files"))
def q_render_tree_flat(spark, sf):
    return PK.render_tree_flat(selected_files(spark, sf).select("context_id", "rel"), contexts(spark, sf))


@query("pack_tokens", "W4 B9 B10 B11 R3 R5 T2", with_views(f"""
WITH RECURSIVE {_packer_parts_sql('all_parts')},
seeds AS (SELECT DISTINCT context_id, CAST(0 AS BIGINT) AS h FROM pp),
{_walk_sql('pp', 'seeds', TOKEN_LIMIT, True)}
SELECT p.context_id, w.chunk_no, count(*) AS n_files, CAST(sum(p.t) AS BIGINT) AS tokens,
       min(p.rel) AS first_rel, max(p.rel) AS last_rel
FROM pp p JOIN walk w ON w.context_id = p.context_id AND w.rn = p.rn
GROUP BY p.context_id, w.chunk_no""", "all_parts"))
def q_pack_tokens(spark, sf, block=None):
    parts = PK.packable(all_files(spark, sf))
    parts = parts.select("context_id", "rel",
                         (TK.tokens_chars4("text") + TK.tokens_chars4(F.concat(X.part_header("rel"), F.lit(X.PART_FOOTER)))).alias("t"))
    a, _ = PK.assign_chunks(PK.ranked(parts, ["rel"]), TOKEN_LIMIT, 0, guard=True, block=block)
    return a.groupBy("context_id", F.col("chunk_no").cast("int").alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("t").cast("long").alias("tokens"),
        F.min("rel").alias("first_rel"), F.max("rel").alias("last_rel"))


def _xml_sql(mode: str) -> str:
    fmt = ("chr(10) || '<file path=\"' || path || '\">' || chr(10) || replace(text, chr(0), '') || chr(10) || '</file>' || chr(10)"
           if mode == "xml" else
           "chr(10) || '## File: ' || path || chr(10) || '```' || chr(10) || replace(text, chr(0), '') || chr(10) || '```' || chr(10)")
    return with_views(f"""
WITH RECURSIVE xp AS (
  SELECT context_id, {fmt} AS part, row_number() OVER (PARTITION BY context_id ORDER BY path) AS rn
  FROM all_parts
  WHERE NOT (regexp_extract(path, '([^/]*)$', 1) IN ({_XML_BIN_LIST})
             OR regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1) IN ({_XML_BIN_LIST}))),
xt AS (SELECT context_id, part, rn, CAST(length(part) AS BIGINT) AS t FROM xp),
seeds AS (SELECT DISTINCT context_id, CAST(0 AS BIGINT) AS h FROM xt),
{_walk_sql('xt', 'seeds', CHAR_LIMIT, False)},
chunks AS (SELECT DISTINCT context_id, chunk_no FROM walk),
per AS (SELECT x.context_id, w.chunk_no, count(*) AS n_files, CAST(sum(x.t) AS BIGINT) AS chars,
               CAST(sum(x.t // 4) AS BIGINT) AS tokens, string_agg(x.part, '' ORDER BY x.rn) AS text
        FROM xt x JOIN walk w ON w.context_id = x.context_id AND w.rn = x.rn GROUP BY ALL),
tot AS (SELECT context_id, count(*) AS file_count FROM all_parts GROUP BY context_id)
SELECT c.context_id, c.chunk_no, coalesce(per.n_files, 0) AS n_files, coalesce(per.chars, 0) AS chars,
       coalesce(per.tokens, 0) AS tokens, md5(coalesce(per.text, '')) AS text_md5, tot.file_count
FROM chunks c LEFT JOIN per ON per.context_id = c.context_id AND per.chunk_no = c.chunk_no
JOIN tot ON tot.context_id = c.context_id""", "all_parts")


def _xml_spark(spark, sf, mode):
    f = all_files(spark, sf).select("context_id", F.col("path").alias("ord"), "path", "text")
    out = PK.build_context_xml(f, mode=mode, limit=CHAR_LIMIT)
    return out.select("context_id", "chunk_no", "n_files", "chars", "tokens", F.md5("text").alias("text_md5"), "file_count")


@query("pack_chars_xml", "W5 R9 B9(xml) R1 R3(xml) T2", _xml_sql("xml"))
def q_pack_chars_xml(spark, sf):
    return _xml_spark(spark, sf, "xml")


@query("pack_chars_markdown", "W5 R9 R3(markdown)", _xml_sql("markdown"))
def q_pack_chars_markdown(spark, sf):
    return _xml_spark(spark, sf, "markdown")


def _build_context_sql(select: str) -> str:
    return with_views(f"""
WITH RECURSIVE {_tree_sql('sel_files')},
hdr AS (SELECT c.context_id,
               CASE WHEN c.prompt IS NOT NULL AND c.prompt <> '' THEN '--- System Prompt ---' || chr(10) || c.prompt || chr(10) || chr(10) ELSE '' END
               || '--- File Tree ---' || chr(10) || t.tree || chr(10) || chr(10) || '---' || chr(10) AS header
        FROM ctx c JOIN tree t ON t.context_id = c.context_id),
hd AS (SELECT context_id, header, CAST(length(header) // 4 AS BIGINT) AS h FROM hdr
       WHERE context_id IN (SELECT context_id FROM sel_files)),
{_packer_parts_sql('sel_files')},
{_walk_sql('pp', 'hd', TOKEN_LIMIT, True)},
chunks AS (SELECT context_id, chunk_no, max(h) AS h FROM walk GROUP BY ALL),
lastc AS (SELECT context_id, max(chunk_no) AS last_no FROM chunks GROUP BY ALL),
per AS (SELECT p.context_id, w.chunk_no, count(*) AS n_files, CAST(sum(p.t) AS BIGINT) AS ft,
               string_agg({_hf_sql('p.rel')} || p.text || chr(10) || '```' || chr(10), '' ORDER BY p.rn) AS body
        FROM pp p JOIN walk w ON w.context_id = p.context_id AND w.rn = p.rn GROUP BY ALL),
out AS (
  SELECT c.context_id, c.chunk_no, CAST(c.h + coalesce(per.ft, 0) AS BIGINT) AS tokens,
         CAST(coalesce(per.ft, 0) AS BIGINT) AS file_tokens, CAST(coalesce(per.n_files, 0) AS BIGINT) AS n_files,
         hd.header || coalesce(per.body, '') || CASE WHEN c.chunk_no = l.last_no THEN chr(10) ELSE '' END AS text
  FROM chunks c JOIN hd ON hd.context_id = c.context_id JOIN lastc l ON l.context_id = c.context_id
  LEFT JOIN per ON per.context_id = c.context_id AND per.chunk_no = c.chunk_no
  UNION ALL
  SELECT context_id, 1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'No files selected'
  FROM ctx WHERE context_id NOT IN (SELECT context_id FROM sel_files))
{select}""", "ctx", "sel_files")


@query("build_context", "R8 J3 J1 A3 B9 B10 B11 R3 R4 R5 R6 W4 T2", _build_context_sql(
    "SELECT context_id, chunk_no, tokens, file_tokens, n_files, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM out"))
def q_build_context(spark, sf):
    ch = PK.build_context(selected_files(spark, sf), contexts(spark, sf), "chars4", TOKEN_LIMIT)
    return ch.select("context_id", "chunk_no", "tokens", "file_tokens", "n_files", "chars", F.md5("text").alias("text_md5"))


@query("chunk_totals", "G6 X4", _build_context_sql("""
SELECT context_id, count(*) AS n_chunks, string_agg(CAST(tokens AS VARCHAR), ',' ORDER BY chunk_no) AS chunk_tokens,
       CAST(sum(file_tokens) AS BIGINT) AS total_tokens, CAST(sum(length(text)) AS BIGINT) AS total_chars,
       CAST(sum(n_files) AS BIGINT) AS n_files, max(tokens) > 2000 AS over_budget
FROM out GROUP BY context_id"""))
def q_chunk_totals(spark, sf):
    ch = PK.build_context(selected_files(spark, sf), contexts(spark, sf), "chars4", TOKEN_LIMIT)
    t = PK.chunk_totals(ch)
    over = ch.groupBy("context_id").agg((F.max("tokens") > TOKEN_LIMIT).alias("over_budget"))
    return t.join(over, "context_id")


@query("fence_check", "G7", _build_context_sql("""
SELECT context_id, CAST(sum(length(text) - length(replace(text, '```', ''))) // 3 AS BIGINT) AS fences,
       CAST(sum(n_files) AS BIGINT) AS n_files, 2 * CAST(sum(n_files) AS BIGINT) AS expected,
       CAST(sum(length(text) - length(replace(text, '```', ''))) // 3 AS BIGINT) = 2 * CAST(sum(n_files) AS BIGINT) AS ok
FROM out GROUP BY context_id"""))
def q_fence_check(spark, sf):
    ch = PK.build_context(selected_files(spark, sf), contexts(spark, sf), "chars4", TOKEN_LIMIT)
    return PK.fence_check(ch)


@query("running_tokens", "W2", with_views(f"""
WITH p AS (SELECT context_id, path, size, CAST(length(text) // 4 AS BIGINT) AS t,
                  NOT ({_PACKER_BIN}) AND text <> '' AS counted FROM sel_files),
x AS (SELECT context_id, path,
             CAST(sum(CASE WHEN counted THEN t ELSE 0 END) OVER (PARTITION BY context_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_tokens,
             row_number() OVER (PARTITION BY context_id ORDER BY path) - 1 AS i,
             count(*) OVER (PARTITION BY context_id) AS n,
             sum(size) OVER (PARTITION BY context_id) AS total_bytes,
             coalesce(sum(CASE WHEN counted THEN size ELSE 0 END) OVER (PARTITION BY context_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb
      FROM p)
SELECT context_id, path, running_tokens,
       CAST(CASE WHEN n <= 300 AND total_bytes > 0 THEN floor(pb * 100 / total_bytes) ELSE floor(i * 100 / n) END AS INTEGER) AS percent
FROM x""", "sel_files"))
def q_running_tokens(spark, sf):
    p = selected_files(spark, sf)
    p = p.select("context_id", "path", "size", TK.tokens_chars4("text").alias("t"),
                 (~R.binary_suffix("path", "packer") & R.non_empty("text")).alias("counted"))
    return PK.running_tokens(p)


@query("build_context_panel", "R10 B14 R2 R3(panel)", with_views("""
SELECT context_id, count(*) AS n_files, CAST(0 AS BIGINT) AS tokens,
       md5(string_agg(rel || chr(10) || '```' || lower(regexp_replace(regexp_extract(regexp_extract(rel, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1), '^\\.', '')) || chr(10)
           || replace(CASE WHEN size > 10485760 THEN '[File too large: ' || format('{:,}', size) || ' bytes - skipped for performance]' ELSE text END, '```', '``·')
           || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY path)) AS text_md5
FROM sel_files GROUP BY context_id""", "sel_files"))
def q_build_context_panel(spark, sf):
    out = PK.build_context_panel(selected_files(spark, sf))
    return out.select("context_id", "n_files", "tokens", F.md5("text").alias("text_md5"))


@query("chunks_roundtrip", "K1 A7 R1", _build_context_sql("""
SELECT context_id, count(*) AS n_chunks, CAST(sum(length(text) // 4) AS BIGINT) AS tokens,
       CAST(sum(length(text)) AS BIGINT) AS total_chars
FROM out WHERE text <> '' GROUP BY context_id"""))
def q_chunks_roundtrip(spark, sf):
    """Write the contexts' chunks (parquet per context + named text objects) into the shared
    checkpoint folder, then read them back."""
    import os
    import uuid

    from corpus_context.session import checkpoint_dir
    from corpus_context.sinks.chunks import read_chunks, write_chunks

    out = os.path.join(checkpoint_dir(spark), f"chunks-{uuid.uuid4().hex[:12]}")
    ch = PK.build_context(selected_files(spark, sf), contexts(spark, sf), "chars4", TOKEN_LIMIT)
    write_chunks(ch, out, text_files=True)
    return read_chunks(spark, out)


@query("pack_tokens_distributed", "W4 (next-fit with every context spread over many blocks)",
       QUERIES["pack_tokens"].sql)
def q_pack_tokens_distributed(spark, sf):
    """W4 with blocks of eight ranks, so that every context takes the steps that a hot one would."""
    return q_pack_tokens(spark, sf, block=8)


@query("conservation_check", "G8 W5 R9", with_views("""
SELECT context_id, CAST(sum(length(path) + length(replace(text, chr(0), '')) + length('<file path=""></file>') + 4) AS BIGINT) AS chars_out,
       CAST(sum(length(path) + length(replace(text, chr(0), '')) + length('<file path=""></file>') + 4) AS BIGINT) AS chars_in, TRUE AS ok
FROM all_parts
WHERE NOT (regexp_extract(path, '([^/]*)$', 1) IN ({0})
           OR regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1) IN ({0}))
GROUP BY context_id""".replace("{0}", _XML_BIN_LIST), "all_parts"))
def q_conservation_check(spark, sf):
    """The characters of the chunks against those of the parts that went in."""
    f = all_files(spark, sf).select("context_id", F.col("path").alias("ord"), "path", "text")
    chunks = PK.build_context_xml(f, mode="xml", limit=CHAR_LIMIT)
    parts = f.where(~R.binary_suffix("path", "xml")).select("context_id", X.render_part("path", X.strip_nuls("text"), style="xml", path="path").alias("part"))
    return PK.conservation_check(chunks, parts)


@query("render_tree_lines", "R6 as ordered rows, J3 J1", with_views(f"""
WITH {_tree_sql('sel_files')}
SELECT context_id, CAST(0 AS BIGINT) AS ord, regexp_extract(root, '([^/]+)$', 1) || '/' AS line FROM ctx
UNION ALL SELECT context_id, CAST(row_number() OVER (PARTITION BY context_id ORDER BY key) AS BIGINT), line FROM tl""", "ctx", "sel_files"))
def q_render_tree_lines(spark, sf):
    return LN.tree_lines(selected_files(spark, sf).select("context_id", "rel"), contexts(spark, sf))


@query("render_tree_flat_lines", "R7 as ordered rows", with_views("""
WITH f AS (SELECT context_id, regexp_extract(rel, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(rel, '([^/]*)$', 1) AS name
           FROM (SELECT DISTINCT context_id, rel FROM sel_files)),
l AS (SELECT context_id, dir, 1 AS below, name,
             CASE WHEN name = max(name) OVER (PARTITION BY context_id, dir) THEN '│   └── ' ELSE '│   ├── ' END || name AS line FROM f
      UNION ALL
      SELECT DISTINCT context_id, dir, 0, '', '├── ' || CASE WHEN dir = '' THEN '(root)' ELSE dir || '/' END FROM f)
SELECT context_id, CAST(0 AS BIGINT) AS ord, 'Project: ' || regexp_extract(root, '([^/]+)$', 1) AS line FROM ctx
UNION ALL SELECT context_id, CAST(row_number() OVER (PARTITION BY context_id ORDER BY dir, below, name) AS BIGINT), line FROM l""",
                                                                       "ctx", "sel_files"))
def q_render_tree_flat_lines(spark, sf):
    return LN.tree_flat_lines(selected_files(spark, sf).select("context_id", "rel"), contexts(spark, sf))


#: Files of which one in seven could not be read, for R10's error texts.
_PANEL_SRC = """
SELECT s.*, row_number() OVER (PARTITION BY context_id ORDER BY s.path) - 1 AS ord, coalesce(i.token_count, 0) AS token_count,
       s.size % 7 = 3 AS lost,
       regexp_replace(regexp_extract(regexp_extract(rel, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1), '^\\.', '') AS ext
FROM sel_files s LEFT JOIN items i ON i.path = s.path"""


def _panel_parts(spark, sf, style):
    from corpus_context.plans.q_scan import corpus_items

    lost = F.col("size") % 7 == 3
    f = selected_files(spark, sf).withColumn("error", F.when(lost, "denied")).withColumn("text", F.when(~lost, F.col("text")))
    out = LN.panel_parts(f, corpus_items(spark, sf).where("not is_dir").select("path", "token_count"), style)
    return out.select("context_id", "ord", "rel", "tokens", F.md5("part").alias("part_md5"))


@query("context_panel_parts", "R10 as ordered rows, with item tokens and unreadable files; B14 R2 R3(panel) T4", with_views(f"""
WITH p AS ({_PANEL_SRC})
SELECT context_id, ord, rel, CAST(token_count AS BIGINT) AS tokens,
       md5(rel || chr(10) || '```' || lower(ext) || chr(10)
           || CASE WHEN size > 10485760 THEN '[File too large: ' || format('{{:,}}', size) || ' bytes - skipped for performance]'
                   WHEN lost THEN '[Error reading file: denied]' ELSE replace(text, '```', '``·') END
           || chr(10) || '```' || chr(10) || chr(10)) AS part_md5
FROM p""", "sel_files", "items"))
def q_context_panel_parts(spark, sf):
    return _panel_parts(spark, sf, "panel")


@query("context_line_parts", "R10 in its lines form, R3(lines) T4", with_views(f"""
WITH p AS ({_PANEL_SRC})
SELECT context_id, ord, rel, CAST(CASE WHEN lost THEN 0 ELSE token_count END AS BIGINT) AS tokens,
       md5(CASE WHEN lost THEN '[Error reading ' || rel || ': denied]' || chr(10)
                ELSE rel || chr(10) || '```' || ext || chr(10) || text || chr(10) || '```' || chr(10) END) AS part_md5
FROM p""", "sel_files", "items"))
def q_context_line_parts(spark, sf):
    return _panel_parts(spark, sf, "lines")


@query("chunk_files", "K1 A7 as files named aggregation_chunk_NN.md", _build_context_sql("""
SELECT context_id, chunk_no, CAST(length(text) AS BIGINT) AS chars, md5(text) AS text_md5 FROM out WHERE text <> ''"""))
def q_chunk_files(spark, sf):
    """Write every chunk as a file of its own into the shared checkpoint folder and read the files back."""
    import uuid

    from corpus_context.session import scratch_path
    from corpus_context.sinks.chunk_files import context_dir_name, read_chunk_files, write_chunk_files

    out = scratch_path(spark, f"chunk-files-{uuid.uuid4().hex}")
    ctx = contexts(spark, sf)
    write_chunk_files(PK.build_context(selected_files(spark, sf), ctx, "chars4", TOKEN_LIMIT), out)
    read = read_chunk_files(spark, out).join(ctx.select("context_id", context_dir_name("context_id").alias("ctx_dir")), "ctx_dir")
    return read.select("context_id", "chunk_no", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))
