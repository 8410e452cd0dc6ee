"""Filter expressions shared by the reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketreach.functions.text import BLANKS, class_of, norm_keyword, norm_text


def matches_all(filters: Mapping[str, Sequence], columns: Iterable[str] | None = None) -> Column:
    """AND of `column IN values`; an empty list means no filter, an unknown column is skipped."""
    known = None if columns is None else set(columns)
    parts = [
        F.col(c).isin(list(v)) for c, v in filters.items() if v and (known is None or c in known)
    ]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def year_between_or_unknown(date: Column, first: int, last: int) -> Column:
    """Year in range, or no date at all."""
    return date.isNull() | F.year(date).between(first, last)


def mentions(query: str, *fields: Column) -> Column:
    """Literal, case-insensitive search in any of the fields; NULL fields do not match."""
    needle = F.lower(F.lit(query))
    hits = [F.coalesce(F.contains(F.lower(f), needle), F.lit(False)) for f in fields]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def is_active(status: Column) -> Column:
    """Establishment status is active."""
    return F.trim(status) == "02"


def in_context(served: Column, context: Column) -> Column:
    """Keep every unserved row, and served rows only inside the context."""
    return ~served | (served & F.coalesce(context, F.lit(False)))


def has_text(c: Column) -> Column:
    """Not NULL and not blank."""
    return F.length(F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))) > 0


def names_any(name: Column, keywords: Iterable[str]) -> Column:
    """Normalised name contains one of the normalised keywords; a NULL name counts as empty."""
    plain = norm_text(F.coalesce(name, F.lit("")))
    hits = [F.contains(plain, F.lit(k)) for k in map(norm_keyword, keywords) if k]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def in_classes(code: Column, classes: Sequence[str]) -> Column:
    """The code's 4-digit class is one of the given ones."""
    return class_of(code).isin(list(classes))


def not_in(c: Column, values: Sequence) -> Column:
    """`NOT IN` where NULL counts as not in."""
    return ~F.coalesce(c.isin(list(values)), F.lit(False))
