"""Regular expressions written for RE2 or Python, run by Spark's Java engine.

The dialects differ in four ways that change matches: which characters
``.`` refuses to cross, whether case folding reaches beyond ASCII, what counts
as a word edge, and whether ``$`` also matches before a final newline.  The two functions below make a pattern mean on Spark
what it means in its home dialect.
"""

from __future__ import annotations

from pyspark.sql import Column

_WORD = "[0-9A-Za-z_]"
_ASCII_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
# str.split()/strip() also treat the four ASCII separators as white space
PY_SPACE = r"[\s\x1c-\x1f]"


def _end_of_text(pattern: str) -> str:
    """``$`` outside classes and escapes becomes ``\\z``."""
    out, in_class, escaped = [], False, False
    for c in pattern:
        if c == "$" and not in_class and not escaped:
            c = r"\z"
        elif not escaped and c in "[]":
            in_class = c == "["
        escaped = c == "\\" and not escaped
        out.append(c)
    return "".join(out)


def from_re2(pattern: str) -> str:
    """RE2 -> Java: newline-only ``.``, Unicode case folding, ASCII ``\\b`` and ``\\s``, ``$`` at the very end."""
    flags = "d"
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], "diu"
    pattern = _end_of_text(pattern).replace(r"\b", _ASCII_EDGE).replace(r"\s", r"[\t\n\f\r ]")
    return f"(?{flags}){pattern}"


def from_python(pattern: str, ignore_case: bool = False) -> str:
    """Python ``re`` -> Java: Unicode ``\\b``, ``\\s``, ``\\d`` and newline-only ``.``."""
    return f"(?{'diu' if ignore_case else 'd'}U){pattern}"


def re2_match(col: Column, pattern: str) -> Column:
    return col.rlike(from_re2(pattern))


def python_match(col: Column, pattern: str, ignore_case: bool = False) -> Column:
    return col.rlike(from_python(pattern, ignore_case))
