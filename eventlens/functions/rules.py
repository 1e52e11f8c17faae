"""Ordered, first-match rules compiled to one Column.

A rule set is plain data (see ``config.TOOL_RULES``): a list of
``(label, signals)`` where a signal is ``(column, kind, value)``.  Nulls keep
SQL's three-valued logic: a null column makes its signal unknown, which leaves
the arm untaken, while other signals of the same arm may still match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.regex import re2_match

Signal = tuple[str, str, str]


def phrase_pattern(phrase: str) -> str:
    """RE2 pattern of a phrase search: its words in order, in any case, with anything but letters and digits between them."""
    words = re.findall("[0-9A-Za-z]+", phrase)
    return "(?i)(^|[^0-9A-Za-z])" + "[^0-9A-Za-z]+".join(words) + "($|[^0-9A-Za-z])"


def signal(column: str, kind: str, value: str) -> Column:
    if kind == "equals":
        return F.col(column) == F.lit(value)
    if kind == "regex":
        return re2_match(F.col(column), value)
    if kind == "phrase":
        return re2_match(F.col(column), phrase_pattern(value))
    raise ValueError(f"unknown signal kind {kind!r}")


def any_signal(signals, known: dict[Signal, Column] | None = None) -> Column:
    known = known or {}
    return reduce(lambda a, b: a | b, [known[s] if s in known else signal(*s) for s in signals])


def first_match(rules, default: str | None = None, known: dict[Signal, Column] | None = None) -> Column:
    """CASE over the rules in order; ``default`` (or null) when none matches.

    ``known`` holds signals that are columns already (see ``with_signals``).
    """
    expr = None
    for label, signals in rules:
        cond = any_signal(signals, known)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def with_signals(df: DataFrame, signals: list[Signal]) -> tuple[DataFrame, dict[Signal, Column]]:
    """``df`` with each signal evaluated once, and the columns that hold them.

    The columns come out of a generator, so that filters and cases on them read a stored value.
    """
    names = {s: f"_signal_{i}" for i, s in enumerate(signals)}
    out = df.select("*", F.inline(F.array(F.struct(*[signal(*s).alias(n) for s, n in names.items()]))))
    return out, {s: F.col(n) for s, n in names.items()}


def rule_table(rules_of: dict[str, list]) -> list[tuple[str, str, str, str, str]]:
    """Rules of several sources as rows (source, label, column, kind, value), in order."""
    return [(source, label, *s) for source, rules in rules_of.items() for label, signals in rules for s in signals]


def first_match_by_source(rows: list[tuple[str, str, str, str, str]], source: str = "source") -> Column:
    """One CASE over the rules of all sources: a row is held against the rules of its own source, in their order.

    Labels keep the order in which the table first names them for a source; a source without rules has no label.
    """
    cases = None
    for name in dict.fromkeys(r[0] for r in rows):
        rules: dict[str, list[Signal]] = {}
        for _, label, *s in (r for r in rows if r[0] == name):
            rules.setdefault(label, []).append(tuple(s))
        case = first_match(list(rules.items()))
        cases = F.when(F.col(source) == name, case) if cases is None else cases.when(F.col(source) == name, case)
    return cases


def account_identity(login: Column) -> Column:
    """A bot's account has one identity, however a source writes it."""
    return F.regexp_replace(login, r"\[bot\]$", "")


def arm(rules, label: str) -> Column:
    """The predicate of a single arm."""
    return any_signal(dict(rules)[label])


def contains_any(col: Column, needles) -> Column:
    """OR of case-sensitive substring tests; cheap enough to run before any JSON parsing."""
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def threshold_class(col: Column, classes, default: str) -> Column:
    """First class whose upper bound (inclusive) holds the value."""
    expr = None
    for bound, label in classes:
        cond = col <= bound
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default)
