"""The testdata views of FIXTURES.md as DuckDB SQL, for the oracle queries.

The driver registers only the base tables, so every oracle statement starts
with the views it needs as CTEs (``with_views``).
"""

from __future__ import annotations

from corpus_context.functions.rules import DEFAULT_IGNORE_FOLDERS

VIEWS: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}

VIEWS["files"] = """
SELECT '/corpus/' || source AS root,
       '/corpus/' || source || '/' || lang || '/' ||
       CASE doc_id % 7 WHEN 3 THEN 'node_modules/' WHEN 4 THEN 'src/app/' WHEN 5 THEN 'src/build/'
                       WHEN 6 THEN '.hidden/' ELSE '' END ||
       'doc_' || printf('%06d', doc_id) ||
       CASE doc_id % 16 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.js' WHEN 3 THEN '.txt'
            WHEN 4 THEN '.json' WHEN 5 THEN '.min.js' WHEN 6 THEN '.TS' WHEN 7 THEN '.log'
            WHEN 8 THEN '.html' WHEN 9 THEN '.rs' WHEN 10 THEN '' WHEN 11 THEN '.png'
            WHEN 12 THEN '.lock' WHEN 13 THEN '.tar.gz' WHEN 14 THEN '.so' ELSE '.sql' END AS path,
       doc_id,
       CASE WHEN doc_id % 13 = 0 THEN repeat(text, 16)
            WHEN doc_id % 29 = 0 THEN ''
            WHEN doc_id % 11 = 0 THEN text || chr(10) || '```' || chr(10)
            ELSE text END AS text,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS mtime
FROM documents"""
DEPS["files"] = []

VIEWS["filesz"] = "SELECT *, CAST(strlen(text) AS BIGINT) AS size FROM files"
DEPS["filesz"] = ["files"]

VIEWS["selections"] = """
SELECT f.root AS workspace, 'Default' AS group_name, substr(f.path, length(f.root) + 2) AS path
FROM files f JOIN labels l ON f.doc_id = l.doc_id WHERE l.quality = 1
UNION ALL
SELECT f.root, 'Flagged', substr(f.path, length(f.root) + 2)
FROM files f JOIN labels l ON f.doc_id = l.doc_id WHERE l.toxic = 1
UNION ALL
SELECT f.root, 'Default', substr(f.path, length(f.root) + 2) || '.gone'
FROM files f WHERE f.doc_id % 10 = 9"""
DEPS["selections"] = ["files"]

VIEWS["selection_groups"] = """
SELECT DISTINCT root AS workspace, 'Default' AS group_name, 'Default selection' AS description,
       TIMESTAMP '2024-01-01 03:00:00' AS last_updated FROM files
UNION ALL
SELECT DISTINCT root, 'Flagged', 'Flagged selection', CAST(NULL AS TIMESTAMP) FROM files"""
DEPS["selection_groups"] = ["files"]

VIEWS["fs_events"] = """
SELECT '/corpus/live' AS root, event_id AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted'
                       WHEN 'purchase' THEN 'moved' ELSE 'modified' END AS action,
       '/corpus/live/u' || lpad(CAST(user_id % 40 AS VARCHAR), 3, '0') || '/f' ||
       CAST(event_id % 5 AS VARCHAR) || '.py' AS src_path,
       CASE WHEN event_type = 'purchase' THEN
       '/corpus/live/u' || lpad(CAST(user_id % 40 AS VARCHAR), 3, '0') || '/f' ||
       CAST((event_id + 1) % 5 AS VARCHAR) || '.py' END AS dst_path,
       CAST(floor(value) AS BIGINT) AS tokens
FROM events"""
DEPS["fs_events"] = []

VIEWS["old_files"] = "SELECT * FROM files WHERE doc_id % 10 <> 0"
DEPS["old_files"] = ["files"]

VIEWS["new_files"] = """
SELECT root, CASE WHEN doc_id % 37 = 0 THEN path || '.moved' ELSE path END AS path, doc_id,
       CASE WHEN doc_id % 9 = 0 THEN text || 'x' ELSE text END AS text, mtime
FROM files WHERE doc_id % 10 <> 1"""
DEPS["new_files"] = ["files"]

# Per-workspace instructions: 'Summarise {source}.' for even source numbers.
VIEWS["ws"] = """
SELECT DISTINCT root AS workspace,
       CASE WHEN CAST(regexp_extract(root, '(\\d+)$', 1) AS INTEGER) % 2 = 0
            THEN 'Summarise ' || regexp_extract(root, '([^/]+)$', 1) || '.' ELSE '' END AS instructions
FROM files"""
DEPS["ws"] = ["files"]

IGNORE_SQL = "[" + ", ".join("'" + x + "'" for x in DEFAULT_IGNORE_FOLDERS) + "]"


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        for d in DEPS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    b = body.lstrip()
    if b[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{b[15:]}"
    if b[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{b[5:]}"
    return f"WITH {ctes}\n{b}"


def _skip_reason_sql(name: str, size: str) -> str:
    """B3 then B4 as a DuckDB CASE (same fixed pattern lists, same precedence)."""
    from corpus_context.functions.rules import SKIP_EXACT_NAMES, SKIP_LIMIT, SKIP_SUFFIX_PATTERNS

    parts = [f"WHEN {size} > {SKIP_LIMIT} THEN 'File too large (' || CAST({size} // 1024 AS VARCHAR) || 'KB)'"]
    for e in SKIP_EXACT_NAMES:
        parts.append(f"WHEN lower({name}) = '{e}' THEN 'Skipped {e}'")
    for p in sorted(SKIP_SUFFIX_PATTERNS, key=lambda s: (-len(s), s)):
        parts.append(f"WHEN ends_with(lower({name}), '{p[1:]}') THEN 'Skipped {p} file'")
    return "CASE " + " ".join(parts) + " END"


SKIP_REASON_SQL = _skip_reason_sql("name", "size")

# file parts: relative path, components, directory components, base name
VIEWS["fparts"] = """
SELECT *, string_split(rel, '/') AS comps,
       list_slice(string_split(rel, '/'), 1, len(string_split(rel, '/')) - 1) AS dcomps,
       regexp_extract(path, '([^/]*)$', 1) AS name
FROM (SELECT *, substr(path, length(root) + 2) AS rel FROM filesz)"""
DEPS["fparts"] = ["filesz"]

# ancestors of every file, the root (i = 0) included
VIEWS["anc"] = """
SELECT root, path, i,
       CASE WHEN i = 0 THEN root ELSE root || '/' || array_to_string(list_slice(dcomps, 1, i), '/') END AS dir,
       list_slice(dcomps, 1, i) AS dir_comps
FROM (SELECT root, path, dcomps, unnest(range(0, len(dcomps) + 1)) AS i FROM fparts)"""
DEPS["anc"] = ["fparts"]

VIEWS["kept"] = f"SELECT * FROM fparts WHERE NOT list_has_any(dcomps, {IGNORE_SQL})"
DEPS["kept"] = ["fparts"]

VIEWS["items"] = f"""
SELECT DISTINCT root, dir AS path, TRUE AS is_dir, TRUE AS is_valid, '' AS reason,
       CAST(0 AS BIGINT) AS token_count, CAST(NULL AS VARCHAR) AS strategy
FROM anc WHERE i > 0 AND NOT list_has_any(dir_comps, {IGNORE_SQL})
UNION ALL
SELECT root, path, FALSE, TRUE, coalesce(sr, ''),
       CASE WHEN sr IS NULL THEN CAST(length(text) // 4 AS BIGINT) ELSE 0 END,
       CASE WHEN sr IS NOT NULL THEN 'skip' WHEN size <= 20480 THEN 'immediate' ELSE 'defer' END
FROM (SELECT *, {SKIP_REASON_SQL} AS sr FROM kept)"""
DEPS["items"] = ["anc", "kept"]
