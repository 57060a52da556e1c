"""Glob patterns as Java regular expressions: of literal patterns, and of patterns that are data.

A pattern is cut into pieces (wildcards, bracket sets, escaped and plain characters), and every piece stands for a piece
of the expression. A bracket set is made of its members: single characters and ascending ranges; a descending range has
no members.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = re.compile(r"\[(?P<inverse>!?)(?P<members>\]?[^\]]*)\]|(?P<run>\*)|(?P<one>\?)|(?P<plain>.)", re.S)
_MEMBER = re.compile(r"(?P<low>.)-(?P<high>.)|(?P<single>.)", re.S)


def _code(c: str) -> str:
    return rf"\x{{{ord(c):x}}}"


def _set(inverse: bool, members: str) -> str:
    found = []
    for m in _MEMBER.finditer(members):
        if m["single"]:
            found.append(_code(m["single"]))
        elif m["low"] <= m["high"]:
            found.append(f"{_code(m['low'])}-{_code(m['high'])}")
    if not found:
        return "." if inverse else "(?!)"
    return f"[{'^' if inverse else ''}{''.join(found)}]"


def glob_to_regex(pattern: str) -> str:
    """A shell glob for whole strings: '*' any characters ('/' too), '?' one, '[a-z]' and '[!a-z]' sets; an unclosed '[' is
    itself."""
    kinds = {"run": lambda m: ".*", "one": lambda m: ".", "plain": lambda m: _code(m["plain"])}
    pieces = (kinds[m.lastgroup](m) if m.lastgroup in kinds else _set(bool(m["inverse"]), m["members"]) for m in _PIECE.finditer(pattern))
    return "(?s)^" + "".join(pieces) + r"\z"


#: Pieces of a path pattern: an escaped character, a set, '**' with its slashes, runs of '*', '?', any other character.
_PATH_PIECES = r"\\[\s\S]|\[[!^]?\]?[^\]]*\]|^\*\*/|/\*\*/|/\*\*$|\*+|[\s\S]"


def _literal(c: Column) -> Column:
    """A character as itself (punctuation is escaped)."""
    return F.when(F.rlike(c, F.lit(r"[\p{Punct}]")), F.concat(F.lit("\\"), c)).otherwise(c)


def _path_set(piece: Column) -> Column:
    inverse = F.rlike(piece, F.lit(r"^\[[!^]"))
    inner = F.regexp_extract(piece, r"^\[[!^]?([\s\S]*)\]$", 1)
    members = F.regexp_extract_all(inner, F.lit(r"[\s\S]-[\s\S]|[\s\S]"), F.lit(0))

    def member(m):
        low, high = F.substring(m, 1, 1), F.substring(m, 3, 1)
        return F.when(F.length(m) == 1, _literal(m)).when(low <= high, F.concat(_literal(low), F.lit("-"), _literal(high))).otherwise(F.lit(""))

    found = F.array_join(F.transform(members, member), "")
    return (F.when((found == "") & inverse, F.lit("[^/]")).when(found == "", F.lit("(?!)"))
            .otherwise(F.concat(F.lit("(?!/)["), F.when(inverse, F.lit("^")).otherwise(F.lit("")), found, F.lit("]"))))


def path_pattern_regex(pattern: Column) -> Column:
    """An ignore-file pattern (without '!' and end slashes) as the expression of a whole relative path: '*' and '?' stay
    within a name, '**' goes over folders, a backslash escapes; a pattern with an unclosed '[' matches nothing."""

    def piece(p):
        return (F.when(F.rlike(p, F.lit(r"^\\[\s\S]$")), _literal(F.substring(p, 2, 1)))
                .when(p == "**/", F.lit("(?:.*/)?")).when(p == "/**/", F.lit("/(?:.*/)?")).when(p == "/**", F.lit("/.+"))
                .when(F.startswith(p, F.lit("*")), F.lit("[^/]*")).when(p == "?", F.lit("[^/]"))
                .when(p == "[", F.lit("(?!)")).when(F.startswith(p, F.lit("[")), _path_set(p)).otherwise(_literal(p)))

    return F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(_PATH_PIECES), F.lit(0)), piece), "")
