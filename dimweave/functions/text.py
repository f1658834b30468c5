"""Text column helpers. All build native Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def substr(c, pos: int, length: int) -> Column:
    """1-based substring; text shorter than ``pos`` gives '' (NULL stays NULL)."""
    return F.substring(col(c), pos, length)


def int_or_null(c) -> Column:
    """Text to int, NULL for text that is not an integer. Surrounding spaces are accepted."""
    return col(c).try_cast("int")


def strict_int(c) -> Column:
    """``int_or_null`` that fails the query on text that is not an integer, whatever the ANSI mode; NULL stays NULL."""
    c, parsed = col(c), int_or_null(c)
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not an integer: "), c))).otherwise(
        parsed
    )


def first_match_label(name, rules, default: str) -> Column:
    """Label of the first case-insensitive LIKE pattern that matches, else ``default``.

    ``rules`` is an ordered sequence of (pattern, label); order decides overlaps. A NULL name
    matches nothing and takes the default.
    """
    name = col(name)
    expr = None
    for pattern, label in rules:
        cond = name.ilike(pattern)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def place_label(municipio, uf) -> Column:
    """'<municipality trimmed>, <state>' when both are known, the state alone when only it is,
    else NULL. The state is not trimmed."""
    m, u = col(municipio), col(uf)
    return (
        F.when(m.isNotNull() & u.isNotNull(), F.concat(F.trim(m), F.lit(", "), u))
        .when(u.isNotNull(), u)
        .otherwise(F.lit(None).cast("string"))
    )


def executor_label(login, status, completed_status: str, finished: str, unassigned: str) -> Column:
    """Current executor: '' on a completed demand reads ``finished``, '' otherwise ``unassigned``;
    a NULL login stays NULL."""
    lg, st = col(login), col(status)
    return F.when((lg == "") & (st == completed_status), F.lit(finished)).when(lg == "", F.lit(unassigned)).otherwise(lg)

