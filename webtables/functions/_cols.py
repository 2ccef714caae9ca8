"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_control(col: Column) -> Column:
    """Trim every character up to and including the space at both ends."""
    return F.regexp_replace(col, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, inside an expression."""
    return F.transform(F.array(value), use)[0]


def once(**columns: Column) -> Column:
    """Generator giving the columns as they are, each evaluated exactly once per row.

    A plain projection may be inlined into every lambda or filter that uses it and be computed again there.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
