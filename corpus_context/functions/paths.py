"""Path functions (P1-P7) as Catalyst Column expressions.

All of them are pure built-in expressions, so they stay inside whole-stage
codegen and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpus_context.functions.util import col_of

def _empty():
    return F.array().cast("array<string>")


def normalize_path(p) -> Column:
    """POSIX normpath (collapse '//', '.', '..'; '' -> '.'), then '\\' -> '/'."""
    p = col_of(p)
    lead = (
        F.when(p.startswith("//") & ~p.startswith("///"), F.lit("//"))
        .when(p.startswith("/"), F.lit("/"))
        .otherwise(F.lit(""))
    )
    absolute = p.startswith("/")

    def step(acc, c):
        n = F.size(acc)
        keep = (
            (c != "..")
            | (~absolute & (n == 0))
            | ((n > 0) & (F.element_at(acc, F.greatest(n, F.lit(1))) == ".."))
        )
        return (
            F.when((c == "") | (c == "."), acc)
            .when(keep, F.concat(acc, F.array(c)))
            .when(n > 0, F.slice(acc, 1, n - 1))
            .otherwise(acc)
        )

    parts = F.aggregate(F.split(p, "/"), _empty(), step)
    out = F.concat(lead, F.array_join(parts, "/"))
    return F.replace(F.when(out == "", F.lit(".")).otherwise(out), F.lit("\\"), F.lit("/"))


def _root_prefix(root: Column) -> Column:
    return F.when(root.endswith("/"), root).otherwise(F.concat(root, F.lit("/")))


def to_relative(p, root) -> Column:
    """Path relative to root with '/'; outside the root keeps the slash-normalised original."""
    p, root = col_of(p), col_of(root)
    pre = _root_prefix(root)
    return (
        F.when(p == root, F.lit("."))
        .when(p.startswith(pre), F.substr(p, F.length(pre) + 1))
        .otherwise(F.replace(p, F.lit("\\"), F.lit("/")))
    )


def to_absolute(rel, root) -> Column:
    """normpath(join(root, rel)); an absolute path stays (normalised)."""
    rel, root = col_of(rel), col_of(root)
    joined = F.when(rel.startswith("/"), rel).otherwise(F.concat(_root_prefix(root), rel))
    return normalize_path(joined)


def basename(p) -> Column:
    """Last component."""
    return F.substring_index(col_of(p), "/", -1)


def dirname(p) -> Column:
    """Parent ('/' for a top-level absolute path, '' for a bare name)."""
    p = col_of(p)
    cut = F.length(p) - F.length(F.substring_index(p, "/", -1)) - 1
    return F.when(cut < 0, F.lit("")).when(cut == 0, F.lit("/")).otherwise(F.substring(p, 1, cut))


def slash_count(p) -> Column:
    p = col_of(p)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def depth_below(p, root) -> Column:
    """Number of components of p below the root (0 for the root itself)."""
    root = col_of(root)
    rs = F.when(root.endswith("/"), slash_count(root) - 1).otherwise(slash_count(root))
    return F.when(col_of(p) == root, F.lit(0)).otherwise(slash_count(p) - rs)


def rel_components(p, root) -> Column:
    """Components of the path below the root (empty for the root itself)."""
    rel = to_relative(p, root)
    return F.when(rel == ".", _empty()).otherwise(F.split(rel, "/"))


def dir_components(p, root) -> Column:
    """Directory components below the root (the file name excluded)."""
    comps = rel_components(p, root)
    n = F.size(comps)
    return F.when(n <= 1, _empty()).otherwise(F.slice(comps, 1, n - 1))


def ancestors(p, root) -> Column:
    """All ancestor directories of p from the root (included) down to its parent.

    The k-th ancestor is the prefix of p before its (root slashes + 1 + k)-th '/',
    one ``substring_index`` per ancestor. ``sequence(0, -1)`` would descend, so
    the root itself (depth 0) gets no ancestors.
    """
    p, root = col_of(p), col_of(root)
    d = depth_below(p, root)
    rs = F.when(root.endswith("/"), slash_count(root) - 1).otherwise(slash_count(root))
    return F.when(d <= 0, _empty()).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(d - 1, F.lit(0))),
                    lambda i: F.when(i == 0, root).otherwise(F.call_function("substring_index", p, F.lit("/"), (rs + 1 + i).cast("int")))))


def extension(p) -> Column:
    """P5: os.path.splitext extension of the base name, with its dot ('' if none)."""
    return F.regexp_extract(basename(p), r"^\.*[^.].*(\.[^.]*)$", 1)


def language_tag(p, lower: bool = True) -> Column:
    """P5: extension without the dot, lower-cased for the code fence (case kept if lower=False)."""
    e = F.regexp_replace(extension(p), r"^\.", "")
    return F.lower(e) if lower else e


def display_path(p, root) -> Column:
    """Relative to the root when there is one, else the base name."""
    root = col_of(root)
    return F.when(root.isNull() | (root == ""), basename(p)).otherwise(to_relative(p, root))


def guess_is_dir(p) -> Column:
    """A directory unless the base name has a non-empty extension."""
    return extension(p) == ""
