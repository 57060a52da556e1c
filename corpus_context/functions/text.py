"""Text functions: decoding (A3) and rendering (R1-R5), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_context.functions import paths as P
from corpus_context.functions.util import col_of


def decode_utf8(content, max_bytes: int | None = None) -> Column:
    """A3: bytes (the first max_bytes) decoded as UTF-8, bad bytes -> U+FFFD."""
    b = col_of(content)
    if max_bytes is not None:
        b = F.substring(b, 1, max_bytes)
    return F.make_valid_utf8(b.cast("string"))


def universal_newlines(text) -> Column:
    """Text-mode reading: '\\r\\n' and '\\r' become '\\n'."""
    t = col_of(text)
    return F.when(F.instr(t, "\r") == 0, t).otherwise(F.regexp_replace(t, "\r\n?", "\n"))


def read_text(files: DataFrame, max_bytes: int | None = None, newline: str = "keep") -> Column:
    """A3 over a files table: decodes ``content`` (or uses an already decoded ``text``)."""
    if "text" in files.columns:
        # already decoded (a compacted corpus table): cut by bytes only when it is longer
        t = F.col("text")
        if max_bytes is not None:
            size = F.col("size") if "size" in files.columns else F.octet_length("text")
            t = F.when(size > max_bytes, decode_utf8(F.col("text").cast("binary"), max_bytes)).otherwise(t)
    else:
        t = decode_utf8("content", max_bytes)
    return universal_newlines(t) if newline == "universal" else t


def strip_nuls(text) -> Column:
    """R1."""
    t = col_of(text)
    return F.when(F.instr(t, "\u0000") == 0, t).otherwise(F.replace(t, F.lit("\u0000"), F.lit("")))


def escape_fences(text) -> Column:
    """R2: ``` -> ``· (middle dot)."""
    return F.replace(col_of(text), F.lit("```"), F.lit("``·"))


def part_header(rel, style: str = "packer") -> Column:
    rel = col_of(rel)
    if style == "packer":
        return F.concat(F.lit("\n`"), rel, F.lit("`\n```"), P.language_tag(rel), F.lit("\n"))
    raise ValueError(style)


PART_FOOTER = "\n```\n"


def render_part(rel, text, style: str = "packer", path=None) -> Column:
    """One file as it appears in the packed output."""
    rel, text = col_of(rel), col_of(text)
    path = rel if path is None else col_of(path)
    if style == "packer":
        return F.concat(part_header(rel), text, F.lit(PART_FOOTER))
    if style == "markdown":
        return F.concat(F.lit("\n## File: "), path, F.lit("\n```\n"), text, F.lit("\n```\n"))
    if style == "xml":
        return F.concat(F.lit('\n<file path="'), path, F.lit('">\n'), text, F.lit("\n</file>\n"))
    if style == "panel":
        return F.concat(rel, F.lit("\n```"), P.language_tag(rel), F.lit("\n"), escape_fences(text), F.lit("\n```\n\n"))
    if style == "lines":
        return F.concat_ws("\n", rel, F.concat(F.lit("```"), P.language_tag(rel, lower=False)), text, F.lit("```\n"))
    raise ValueError(style)


def render_header(prompt, tree) -> Column:
    """Optional system prompt block, then the file tree block."""
    prompt, tree = col_of(prompt), col_of(tree)
    pre = F.when(prompt.isNotNull() & (prompt != ""),
                 F.concat(F.lit("--- System Prompt ---\n"), prompt, F.lit("\n\n"))).otherwise(F.lit(""))
    return F.concat(pre, F.lit("--- File Tree ---\n"), tree, F.lit("\n\n---\n"))


def truncate_notice(content, kb: int) -> Column:
    """The first kb KiB (decoded) and a notice, when the file is longer."""
    c = col_of(content)
    limit = kb * 1024
    return F.when(F.length(c) > limit,
                  F.concat(decode_utf8(c, limit), F.lit(f"\n\n... (truncated at {kb}KB)"))).otherwise(decode_utf8(c))
