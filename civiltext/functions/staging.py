"""Keeping an expensive expression evaluated once.

Catalyst pushes filters down by replacing column names with the expressions
behind them. For a scoring expression this repeats the whole scoring inside the
filter, several times over. ``computed`` puts the expressions into a generator
instead; filters on its output stay above it, and the row is computed once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` plus ``columns``, each evaluated exactly once per row; a row-local step without a shuffle.

    The projection below shares common subexpressions; the one-row generator on
    top only passes the finished values on. Columns should be flat: struct fields
    are pruned through generators, which would split the stages again.
    """
    kept = [c for c in df.columns if c not in columns and c not in drop]
    out = df.select(*kept, *[c.alias(f"__{name}") for name, c in columns.items()])
    row = F.struct(*[F.col(f"__{name}").alias(name) for name in columns])
    return out.select(*kept, F.inline(F.array(row)))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it, so that ``body`` may use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def guarded(text: Column, needles: list[str], value: Column, otherwise: Column) -> Column:
    """``value`` only for texts that contain one of ``needles``; a byte scan instead of a regular expression."""
    possible = F.lit(False)
    for needle in needles:
        possible = possible | F.contains(text, F.lit(needle))
    return F.when(possible, value).otherwise(otherwise)


def required_literal(pattern: str) -> str | None:
    """The longest of ``required_literals``, or ``None``."""
    return max(required_literals(pattern), key=len, default=None)


def required_literals(pattern: str) -> list[str]:
    """Texts of two characters or more that every match of ``pattern`` must contain, in their order; none where none is certain.

    Only characters outside groups and classes count; one that a quantifier makes optional doesn't,
    one that may be repeated ends its run. Flags that change how a pattern is read give none.
    """
    return [run for run, _ in spaced_literals(pattern)]


def spaced_literals(pattern: str) -> list[tuple[str, int | None]]:
    """``required_literals``, each with the most characters that a match has between it and the one before, ``None`` for no bound."""
    if re.search(r"\\[^bBsSwWdD.!?*+$^-]", pattern) or re.search(r"\(\?[a-z]*[xdmsuU]", pattern):
        return []
    out, run, at = [], "", 0
    between: float = 0

    def close(run: str) -> float:
        if len(run) < 2:
            return between + len(run)
        out.append((run.lower(), None if between == math.inf else int(between)))
        return 0

    while at < len(pattern):
        c, step, plain = pattern[at], 1, False
        if c == "\\":
            step = 2
        elif c in "([":
            step = _closing(pattern, at)
            if not step:
                return []
        elif c in "|)":
            return []
        else:
            plain = c not in ".^$" and not c.isspace()
        at += step
        quantifier = re.match(r"(?:[*+?]|\{(\d+)(?:(,)(\d*))?\})[?+]?", pattern[at:])
        at += quantifier.end() if quantifier else 0
        if plain and not quantifier and c not in "{}*+?":
            run += c
            continue
        optional = quantifier and (quantifier[0][0] in "*?" or quantifier[1] and int(quantifier[1]) == 0)
        between = close(run + c if plain and quantifier and not optional else run)
        run = ""
        if c in "({}*+?" or quantifier and (quantifier[0][0] in "*+" or quantifier[2] and not quantifier[3]):
            between = math.inf
        else:
            between += int(quantifier[3] or quantifier[1]) if quantifier and quantifier[1] else 1
    close(run)
    return out


def widest_match(pattern: str) -> int | None:
    """The most bytes a match can have, for patterns that look at nothing outside it: literals and classes of a bounded number. ``None`` for others."""
    if re.search(r"\\[^sSwWdD.!?*+$^-]", pattern):
        return None
    at = total = 0
    while at < len(pattern):
        c, step, width = pattern[at], 1, 4
        if c == "\\":
            step = 2
        elif c == "[":
            step = _closing(pattern, at)
            if not step or re.search(r"[\[\]&]", pattern[at + 1 : at + step - 1]):
                return None
        elif c in "()|^$*+?{}":
            return None
        elif c != ".":
            width = len(c.encode("utf-8", "surrogatepass"))
        at += step
        quantifier = re.match(r"\?|\{(\d+)(?:,(\d+))?\}", pattern[at:])
        at += quantifier.end() if quantifier else 0
        if pattern[at : at + 1] in {"*", "+", "?", "{"}:
            return None
        total += width * int(quantifier[2] or quantifier[1] or 1) if quantifier else width
    return total


def _closing(pattern: str, at: int) -> int:
    """The length of the group or class that begins at ``at``; 0 where it doesn't end."""
    depth, i, inside = 0, at, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        i += 1
        if not inside and not depth:
            return i - at
    return 0


def pattern_hits(low: Column, pattern: str) -> Column:
    """All matches of a pattern in lower-cased text; texts without its required literal are skipped."""
    found = F.regexp_extract_all(low, F.lit("(?i)" + pattern), F.lit(0))
    literal = required_literal(pattern)
    return found if literal is None else guarded(low, [literal], found, F.array().cast("array<string>"))


def pattern_found(low: Column, pattern: str) -> Column:
    found = F.regexp_like(low, F.lit("(?i)" + pattern))
    literal = required_literal(pattern)
    return found if literal is None else guarded(low, [literal], found, F.lit(False))


def quoted(term: str) -> str:
    return "'" + term.replace("\\", "\\\\").replace("'", "\\'") + "'"


def members(array: str, terms: list[str]) -> Column:
    """Elements of an array column that are terms, every occurrence kept; one hash look-up per element."""
    if not terms:
        return F.array().cast("array<string>")
    return F.expr(f"filter({array}, t -> t in ({', '.join(map(quoted, terms))}))")


def any_member(array: str, terms: list[str]) -> Column:
    if not terms:
        return F.lit(False)
    return F.expr(f"exists({array}, t -> t in ({', '.join(map(quoted, terms))}))")
