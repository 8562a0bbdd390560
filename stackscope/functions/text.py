"""String predicates built from fixed lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quote(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def bind(value: Column, body) -> Column:
    """``body`` of a value computed once. A column written several times into conditions and struct fields is computed, and
    its code generated, as often; nested uses multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(col: Column, needles) -> Column:
    needles = list(needles)
    if not needles:
        return F.lit(False)
    if len(needles) == 1:
        return col.contains(needles[0])
    return col.rlike("|".join(_quote(n) for n in needles))


def starts_with_any(col: Column, prefixes) -> Column:
    return col.rlike("^(?:" + "|".join(_quote(p) for p in prefixes) + ")")


def full_match(col: Column, pattern: str) -> Column:
    return col.rlike("^(?:" + pattern + ")$")


def strip(col) -> Column:
    """Trim every kind of ASCII white space, not blanks alone."""
    return F.btrim(col, F.lit(" \t\r\n\f\x0b"))
