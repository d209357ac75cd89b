"""Name an intermediate Column so that it is evaluated once."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time per row.

    Regex-heavy intermediates are used by several ``when`` branches.  Common
    subexpression elimination does not reach into conditional branches or
    lambda bodies, so the value is bound as the one element of an array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def blank_to_null(value: Column) -> Column:
    """Empty string -> NULL, for a plain column."""
    return F.when(value != "", value)


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of ``pattern`` (or one group of it), NULL on a miss.

    Only for groups that cannot match an empty string.
    """
    return let(F.regexp_extract(text, pattern, group), blank_to_null)


def settled(value: Column) -> Column:
    """``value`` as a generated column, for ``select`` beside other columns.

    A filter on a computed column is pushed down by copying the whole
    expression, JSON parsing included, into the filter.  A generated column
    cannot be pushed through, so it is computed once.
    """
    return F.explode(F.array(value))
