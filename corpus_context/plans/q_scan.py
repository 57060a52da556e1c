"""Registered queries: scan, rules, paths and tree roll-ups over the testdata corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions import rules as R
from corpus_context.functions import tokens as TK
from corpus_context.functions import text as X
from corpus_context.operators import scan as S
from corpus_context.operators import tree as TR
from corpus_context.plans.oracle_views import IGNORE_SQL, SKIP_REASON_SQL, with_views
from corpus_context.plans.registry import query
from corpus_context.sources import testdata as TD


def corpus_items(spark, sf):
    """T4 over the corpus, per-root settings from the workspaces table."""
    f = S.attach_settings(TD.files(spark, sf), TD.workspaces(spark, sf, with_groups=False))
    return S.corpus_tokens(f, "chars4")


def selected_abs(spark, sf, group="Default"):
    """Selections of one group as absolute (root, path)."""
    s = TD.selections(spark, sf).where(F.col("group_name") == group)
    return s.select(F.col("workspace").alias("root"), P.to_absolute("path", "workspace").alias("path"))


ITEM_COLS = "root, path, is_dir, is_valid, reason, token_count, strategy"


@query("corpus_tokens", "T4 B1 B3 B4 B5 A3 T2", with_views(f"SELECT {ITEM_COLS} FROM items", "items"))
def q_corpus_tokens(spark, sf):
    return corpus_items(spark, sf).select(*ITEM_COLS.split(", "))


@query("list_items", "A2 B1 B5", with_views(
    "SELECT root, path, is_dir, CASE WHEN is_dir THEN NULL ELSE strategy END AS strategy FROM items", "items"))
def q_list_items(spark, sf):
    f = S.attach_settings(TD.files(spark, sf), TD.workspaces(spark, sf, with_groups=False))
    return S.list_items(f).select("root", "path", "is_dir", "strategy")


@query("scan_summary", "G5", with_views("""
SELECT root, count(*) AS n_items, count(*) FILTER (WHERE NOT is_dir) AS n_files,
       count(*) FILTER (WHERE is_dir) AS n_dirs,
       count(*) FILTER (WHERE NOT is_dir AND strategy <> 'skip' AND is_valid) AS n_tokenised,
       count(*) FILTER (WHERE NOT is_dir AND strategy = 'skip') AS n_skipped,
       count(*) FILTER (WHERE NOT is_valid) AS n_invalid,
       CAST(coalesce(sum(token_count) FILTER (WHERE NOT is_dir AND token_count > 0), 0) AS BIGINT) AS total_tokens
FROM items GROUP BY root""", "items"))
def q_scan_summary(spark, sf):
    return S.scan_summary(corpus_items(spark, sf))


@query("skipped_by_reason", "G5 B3 B4", with_views("""
SELECT root, reason, count(*) AS n_files FROM items WHERE NOT is_dir AND strategy = 'skip'
GROUP BY root, reason""", "items"))
def q_skipped_by_reason(spark, sf):
    return S.skipped_by_reason(corpus_items(spark, sf))


# all directories of the items, the roots included
_DIRS_SQL = "SELECT root, path AS dir FROM items WHERE is_dir UNION SELECT DISTINCT root, root FROM items"
# (file, ancestor) pairs from the items table
_ITEM_ANC_SQL = """
SELECT a.root, a.path, a.dir FROM anc a JOIN items i ON a.root = i.root AND a.path = i.path AND NOT i.is_dir"""


@query("folder_tokens", "G1 P4", with_views(f"""
WITH d AS ({_DIRS_SQL}), fa AS ({_ITEM_ANC_SQL})
SELECT d.root, d.dir, CAST(coalesce(sum(CASE WHEN i.token_count > 0 THEN i.token_count ELSE 0 END), 0) AS BIGINT) AS tokens
FROM d LEFT JOIN fa ON fa.root = d.root AND fa.dir = d.dir
LEFT JOIN items i ON i.root = fa.root AND i.path = fa.path
GROUP BY d.root, d.dir""", "items", "anc"))
def q_folder_tokens(spark, sf):
    return TR.folder_tokens(corpus_items(spark, sf))


_SEL_SQL = "SELECT DISTINCT workspace AS root, workspace || '/' || path AS path FROM selections WHERE group_name = 'Default'"


@query("folder_selected_tokens", "G2 P3", with_views(f"""
WITH d AS ({_DIRS_SQL}), fa AS ({_ITEM_ANC_SQL}), s AS ({_SEL_SQL}),
agg AS (
  SELECT d.root, d.dir,
         CAST(coalesce(sum(CASE WHEN s.path IS NOT NULL AND i.token_count > 0 THEN i.token_count ELSE 0 END), 0) AS BIGINT) AS selected_tokens,
         CAST(coalesce(sum(CASE WHEN i.token_count > 0 THEN i.token_count ELSE 0 END), 0) AS BIGINT) AS total_tokens
  FROM d LEFT JOIN fa ON fa.root = d.root AND fa.dir = d.dir
  LEFT JOIN items i ON i.root = fa.root AND i.path = fa.path
  LEFT JOIN s ON s.root = fa.root AND s.path = fa.path
  GROUP BY d.root, d.dir)
SELECT *, format('{{:,}}', selected_tokens) || ' / ' || format('{{:,}}', total_tokens) || ' tokens' AS label FROM agg""",
                                                               "items", "anc", "selections"))
def q_folder_selected_tokens(spark, sf):
    return TR.folder_selected_tokens(corpus_items(spark, sf), selected_abs(spark, sf))


@query("selection_total", "G3 J1", with_views(f"""
WITH s AS ({_SEL_SQL})
SELECT i.root, count(*) AS n_selected,
       CAST(coalesce(sum(CASE WHEN i.token_count > 0 THEN i.token_count END), 0) AS BIGINT) AS selected_tokens
FROM items i JOIN s ON s.root = i.root AND s.path = i.path WHERE NOT i.is_dir GROUP BY i.root""", "items", "selections"))
def q_selection_total(spark, sf):
    return TR.selection_total(corpus_items(spark, sf), selected_abs(spark, sf))


def _state_sql(mode):
    st = ("CASE WHEN n_checked = n_leaves THEN 'checked' WHEN n_checked = 0 THEN 'unchecked' ELSE 'partial' END"
          if mode == "tri" else "CASE WHEN n_checked > 0 THEN 'checked' ELSE 'unchecked' END")
    return with_views(f"""
WITH fa AS ({_ITEM_ANC_SQL}), s AS ({_SEL_SQL}),
ed AS (SELECT d.root, d.path FROM items d WHERE d.is_dir AND NOT EXISTS (
         SELECT 1 FROM items c WHERE c.root = d.root AND regexp_extract(c.path, '^(.*)/[^/]*$', 1) = d.path)),
leaf_anc AS (
  SELECT root, path, dir FROM fa
  UNION ALL
  SELECT ed.root, ed.path, a.dir FROM ed JOIN (
    SELECT root, path, dir FROM (
      SELECT ed2.root, ed2.path, unnest(range(0, len(string_split(substr(ed2.path, length(ed2.root) + 2), '/')) + 1)) AS i,
             string_split(substr(ed2.path, length(ed2.root) + 2), '/') AS c FROM ed ed2) x
    CROSS JOIN LATERAL (SELECT CASE WHEN i = 0 THEN x.root ELSE x.root || '/' || array_to_string(list_slice(c, 1, i), '/') END AS dir) y
  ) a ON a.root = ed.root AND a.path = ed.path),
agg AS (SELECT la.root, la.dir, count(*) AS n_leaves,
               CAST(sum(CASE WHEN s.path IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_checked
        FROM leaf_anc la LEFT JOIN s ON s.root = la.root AND s.path = la.path GROUP BY la.root, la.dir)
SELECT root, dir, n_leaves, n_checked, {st} AS state FROM agg""", "items", "anc", "selections")


@query("folder_state_tri", "G4 (tri)", _state_sql("tri"))
def q_folder_state_tri(spark, sf):
    return TR.folder_state(corpus_items(spark, sf), selected_abs(spark, sf), "tri")


@query("folder_state_any", "G4 (any)", _state_sql("any"))
def q_folder_state_any(spark, sf):
    return TR.folder_state(corpus_items(spark, sf), selected_abs(spark, sf), "any")


@query("sort_items", "W1", with_views("SELECT root, path, is_dir FROM items ORDER BY is_dir DESC, path", "items"))
def q_sort_items(spark, sf):
    return TR.sort_items(corpus_items(spark, sf)).select("root", "path", "is_dir")


@query("rank_position", "W6 P4", with_views("""
SELECT root, path, parent, is_dir, name,
       row_number() OVER w AS position, lead(1) OVER w IS NULL AS is_last
FROM (SELECT root, path, is_dir, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
             regexp_extract(path, '([^/]*)$', 1) AS name FROM items)
WINDOW w AS (PARTITION BY root, parent ORDER BY is_dir, name)""", "items"))
def q_rank_position(spark, sf):
    return TR.rank_position(corpus_items(spark, sf))


@query("restore_selection", "J1 P3", with_views(f"""
WITH s AS ({_SEL_SQL})
SELECT s.root, s.path FROM s WHERE EXISTS (SELECT 1 FROM items i WHERE i.root = s.root AND i.path = s.path AND NOT i.is_dir)""",
                                                "items", "selections"))
def q_restore_selection(spark, sf):
    return TR.restore_selection(selected_abs(spark, sf).distinct(), corpus_items(spark, sf))


@query("toggle_paths", "J2", with_views(f"""
WITH s AS ({_SEL_SQL}),
f AS (SELECT i.root, i.path, s.path IS NOT NULL AS checked FROM items i LEFT JOIN s ON s.root = i.root AND s.path = i.path
      WHERE NOT i.is_dir),
t AS (SELECT root, path FROM items WHERE CASE WHEN is_dir THEN regexp_matches(path, '/(src|app)$') ELSE ends_with(path, '.py') END),
d AS (SELECT t.root, t.path, NOT bool_and(f.checked) AS target FROM t
      JOIN f ON f.root = t.root AND (f.path = t.path OR starts_with(f.path, t.path || '/')) GROUP BY ALL),
r AS (SELECT f.root, f.path, f.checked, arg_max(d.target, length(d.path)) AS target FROM f
      LEFT JOIN d ON d.root = f.root AND (f.path = d.path OR starts_with(f.path, d.path || '/')) GROUP BY ALL)
SELECT root, path FROM r WHERE coalesce(target, checked)""", "items", "selections"))
def q_toggle_paths(spark, sf):
    items = corpus_items(spark, sf)
    hit = F.when(F.col("is_dir"), F.col("path").rlike("/(src|app)$")).otherwise(F.col("path").endswith(".py"))
    return TR.toggle_paths(items, selected_abs(spark, sf), items.where(hit))


@query("file_rules", "B3 B4 B5 B6 B7 B9 B11 B14 X1 X6 P5 P7", with_views(f"""
SELECT root, path,
       {SKIP_REASON_SQL} AS skip_reason,
       CASE WHEN ({SKIP_REASON_SQL}) IS NOT NULL THEN 'skip' WHEN size <= 20480 THEN 'immediate' ELSE 'defer' END AS strategy,
       CASE WHEN ({SKIP_REASON_SQL}) IS NOT NULL THEN 0 WHEN size <= 20480 THEN -2 ELSE -1 END AS placeholder,
       (lower(ext) IN ({", ".join("'" + e + "'" for e in R.TEXT_EXTENSIONS)}) OR ext = '') AS likely_text,
       ({" OR ".join(f"ends_with(path, '{s}')" for s in R.PACKER_BINARY_SUFFIXES)}) AS binary_packer,
       (name IN ({", ".join("'" + e + "'" for e in R.XML_BINARY_NAMES)}) OR ext IN ({", ".join("'" + e + "'" for e in R.XML_BINARY_NAMES)})) AS binary_xml,
       text <> '' AS non_empty,
       CASE WHEN size > 10485760 THEN 'placeholder' ELSE 'text' END AS content_kind,
       NOT list_bool_or(list_transform(comps, lambda x: starts_with(x, '.'))) AS not_hidden,
       ext = '' AS guess_dir,
       CASE WHEN size > 204800 THEN 'Too Large' END AS badge
FROM (SELECT *, regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext FROM fparts)""", "fparts"))
def q_file_rules(spark, sf):
    f = TD.files(spark, sf)
    ph = R.display_info("path", "size", R.token_strategy("path", "size"))
    return f.select(
        "root", "path",
        R.skip_reason("path", "size").alias("skip_reason"),
        R.token_strategy("path", "size").alias("strategy"),
        ph["tokens"].alias("placeholder"),
        R.likely_text_by_extension("path").alias("likely_text"),
        R.binary_suffix("path", "packer").alias("binary_packer"),
        R.binary_suffix("path", "xml").alias("binary_xml"),
        R.non_empty("text").alias("non_empty"),
        F.when(R.oversize_placeholder("size", "text") == F.col("text"), "text").otherwise("placeholder").alias("content_kind"),
        R.skip_hidden("path", "root").alias("not_hidden"),
        P.guess_is_dir("path").alias("guess_dir"),
        R.skip_badge(F.lit(True), "size").alias("badge"),
    )


@query("path_parts", "P1 P2 P3 P4 P5 P6", with_views("""
SELECT root, path, rel, name AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent,
       regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext,
       lower(regexp_replace(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1), '^\\.', '')) AS lang,
       rel AS display, path AS normalized, root || '/' || rel AS absolute, len(dcomps) + 1 AS n_ancestors
FROM fparts""", "fparts"))
def q_path_parts(spark, sf):
    f = TD.files(spark, sf)
    messy = F.concat(F.col("root"), F.lit("/./"), F.regexp_replace(P.to_relative("path", "root"), "/", "//"))
    return f.select(
        "root", "path",
        P.to_relative("path", "root").alias("rel"),
        P.basename("path").alias("base"),
        P.dirname("path").alias("parent"),
        P.extension("path").alias("ext"),
        P.language_tag("path").alias("lang"),
        P.display_path("path", "root").alias("display"),
        P.normalize_path(messy).alias("normalized"),
        P.to_absolute(P.to_relative("path", "root"), "root").alias("absolute"),
        F.size(P.ancestors("path", "root")).alias("n_ancestors"),
    )


@query("token_estimators", "T2 T3 T7 A3", with_views("""
SELECT root, path, CAST(length(text) // 4 AS BIGINT) AS chars4,
       CAST(length(text) // 4 + len(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS BIGINT) AS words_chars4
FROM files""", "files"))
def q_token_estimators(spark, sf):
    f = TD.files(spark, sf)
    t = X.read_text(f)
    return f.select("root", "path", TK.tokens_chars4(t).alias("chars4"), TK.tokens_words_chars4(t).alias("words_chars4"))


#: Ignore files of the corpus: one per root, one in each root's first language folder.
ROOT_RULES = """# logs, builds
*.log
build/
!src/build/doc_000*
*.min.js
!doc_00[0-4]*.min.js
doc_*[!02468].txt
**/node_modules/**
un[closed
"""
LANGUAGE_RULES = """!*.log
*.sql
/src
"""


def _with_ignore_files(spark, sf):
    f = TD.files(spark, sf).select("root", "path", "text")
    first = TD.table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("lang"))
    root = F.concat(F.lit("/corpus/"), F.col("source"))
    of_root = first.select(root.alias("root"), F.concat(root, F.lit("/.gitignore")).alias("path"), F.lit(ROOT_RULES).alias("text"))
    of_lang = first.select(root.alias("root"), F.concat(root, F.lit("/"), "lang", F.lit("/.gitignore")).alias("path"), F.lit(LANGUAGE_RULES).alias("text"))
    return f.unionByName(of_root).unionByName(of_lang)


@query("gitignore_filter", "X2", with_views("""
WITH first AS (SELECT '/corpus/' || source AS root, min(lang) AS lang FROM documents GROUP BY source),
n AS (SELECT f.root, f.path, regexp_extract(f.path, '([^/]*)$', 1) AS name, substr(f.path, length(f.root) + 2) AS rel,
             starts_with(substr(f.path, length(f.root) + 2), first.lang || '/') AS own, first.lang
      FROM files f JOIN first ON first.root = f.root)
SELECT root, path FROM n
WHERE NOT (contains(rel, '/build/') OR (contains(rel, '/node_modules/') AND NOT (own AND ends_with(name, '.log')))
           OR (ends_with(name, '.log') AND NOT own)
           OR (ends_with(name, '.min.js') AND NOT regexp_matches(name, '^doc_00[0-4]'))
           OR regexp_matches(name, '^doc_.*[^02468]\\.txt$')
           OR (own AND (ends_with(name, '.sql') OR starts_with(rel, lang || '/src/'))))""", "files"))
def q_gitignore_filter(spark, sf):
    """X2 over the corpus with ignore files; build/ stays out although a file in it is re-included."""
    return S.gitignore_filter(_with_ignore_files(spark, sf)).where(P.basename("path") != ".gitignore").select("root", "path")


@query("unreadable_files", "T4 B13", with_views("""
SELECT i.root, i.path, i.is_dir, bad IS NULL AS is_valid, CASE WHEN bad IS NULL THEN i.reason ELSE 'Error: the file cannot be read' END AS reason,
       CASE WHEN bad IS NULL THEN i.token_count ELSE 0 END AS token_count, i.strategy
FROM items i LEFT JOIN (SELECT root, path, doc_id AS bad FROM files WHERE doc_id % 17 = 0) f
     ON f.root = i.root AND f.path = i.path AND NOT i.is_dir AND i.strategy <> 'skip'""", "items", "files"))
def q_unreadable_files(spark, sf):
    """T4 where the content of every 17th document could not be read: its row stays, invalid and without tokens."""
    f = TD.files(spark, sf)
    lost = F.col("doc_id") % 17 == 0
    f = f.withColumns({c: F.when(~lost, F.col(c)) for c in ("text", "content")})
    f = S.attach_settings(f, TD.workspaces(spark, sf, with_groups=False))
    return S.corpus_tokens(f, "chars4").select(*ITEM_COLS.split(", "))
