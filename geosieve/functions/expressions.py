"""Small Column helpers for attribute filters: combinators, value lists, casts that do not fail."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the combine operators in six languages.
OPERATOR_NAMES = {
    "AND": "AND", "ET": "AND", "UND": "AND", "Y": "AND", "E": "AND",
    "OR": "OR", "OU": "OR", "ODER": "OR", "O": "OR",
    "AND NOT": "AND NOT", "ET NON": "AND NOT", "UND NICHT": "AND NOT", "Y NO": "AND NOT", "E NON": "AND NOT",
    "E NÃO": "AND NOT",
    "NOT": "NOT", "NON": "NOT", "NICHT": "NOT", "NO": "NOT", "NÃO": "NOT",
    "REPLACE": "REPLACE",
}


def operator_name(name: str | None, default: str = "AND") -> str:
    """The English name of a combine operator; AND where none is given."""
    if not name or not name.strip():
        return default
    key = name.strip().upper()
    if key not in OPERATOR_NAMES:
        raise ValueError(f"unknown operator {name!r}")
    return OPERATOR_NAMES[key]


def as_column(expression: Column | str) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression


def all_of(expressions: Iterable[Column | str]) -> Column:
    return reduce(lambda a, b: a & b, map(as_column, expressions))


def any_of(expressions: Iterable[Column | str]) -> Column:
    return reduce(lambda a, b: a | b, map(as_column, expressions))


def none_of(expressions: Iterable[Column | str]) -> Column:
    """NOT of the alternatives; a row for which they are unknown stays out."""
    return ~any_of(expressions)


def combine_exprs(old: Column | str | None, new: Column | str | None, op: str | None = None) -> Column | None:
    """Old and new filter as one: AND (default), OR, AND NOT, or REPLACE."""
    if old is None or new is None:
        return as_column(new if old is None else old) if (old is not None or new is not None) else None
    old, new, name = as_column(old), as_column(new), operator_name(op)
    return {"AND": old & new, "OR": old | new, "AND NOT": old & ~new, "NOT": old & ~new, "REPLACE": new}[name]


def compare(value: Column, op: str, threshold, threshold_max=None) -> Column:
    """``= != <> > >= < <= BETWEEN`` and ``NOT BETWEEN``; BETWEEN includes both ends."""
    name = op.strip().upper()
    if "BETWEEN" in name:
        if threshold_max is None:
            raise ValueError("BETWEEN needs an upper bound")
        if not isinstance(threshold, Column) and not isinstance(threshold_max, Column) and threshold_max < threshold:
            raise ValueError(f"upper bound {threshold_max} is below {threshold}")
        inside = value.between(threshold, threshold_max)
        return ~inside if name.startswith("NOT") else inside
    table = {"=": value == threshold, "!=": value != threshold, "<>": value != threshold, ">": value > threshold,
             ">=": value >= threshold, "<": value < threshold, "<=": value <= threshold}
    if name not in table:
        raise ValueError(f"unknown comparison {op!r}")
    return table[name]


def similar_pattern(pattern: str) -> str:
    """The regular expression of a SIMILAR TO pattern: ``%`` and ``_`` match any text and character, ``. ^ $`` are
    themselves, and a backslash makes the next character literal."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif in_class:
            in_class = c != "]"
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
        else:
            out.append({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$", "\\": r"\\"}.get(c, c))
        i += 1
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def matches(text: Column, op: str, pattern: str) -> Column:
    """``LIKE ILIKE SIMILAR TO ~ ~*`` and their negations (``NOT ...``, ``!~``, ``!~*``)."""
    name = " ".join(op.upper().split())
    if name.startswith("NOT "):
        return ~matches(text, name[4:], pattern)
    if name.startswith("!"):
        return ~matches(text, name[1:], pattern)
    if name == "SIMILAR TO":
        return text.rlike(similar_pattern(pattern))
    table = {"LIKE": text.like, "ILIKE": text.ilike, "~": text.rlike,
             "~*": lambda p: text.rlike("(?i)" + p)}
    if name not in table:
        raise ValueError(f"unknown text comparison {op!r}")
    return table[name](pattern)


def as_number(c: Column) -> Column:
    """Text as a number, NULL where it is none."""
    return F.trim(c.cast("string")).try_cast("double")


def condition(df: DataFrame, expression: Column | str | None) -> Column | None:
    """A boolean expression as a filter; a plain field or display expression filters nothing."""
    if expression is None:
        return None
    c = as_column(expression)
    return c if isinstance(df.select(c.alias("c")).schema["c"].dataType, T.BooleanType) else None
