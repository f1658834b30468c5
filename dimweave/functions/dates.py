"""Date column helpers: strict text-to-date, month names, business days, open intervals.

All are native Catalyst expressions; the business-day count is closed-form arithmetic and two binary
searches among the holidays, so it costs the same for a one-day and a ten-year interval and never builds
per-row arrays of dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from dimweave.functions.text import col

# A date as PostgreSQL's ::DATE reads ISO text: unpadded month and day, and a time part that is dropped.
_ISO = r"^\s*\d{4,}-\d{1,2}-\d{1,2}([ T].*)?\s*$"


def date_or_null(c, formats=()) -> Column:
    """Text to date, NULL for text that is no date.

    ISO text is read first (surrounding spaces, unpadded parts and a time part are accepted), then
    each of ``formats`` in order, on the trimmed text.
    """
    c = col(c)
    return F.coalesce(F.when(c.rlike(_ISO), c.try_cast("date")), *[F.try_to_date(F.trim(c), f) for f in formats])


def strict_date(c, formats=()) -> Column:
    """``date_or_null`` that fails the query on text that is no date, whatever the ANSI mode."""
    c, parsed = col(c), date_or_null(c, formats)
    return F.when(c.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("not a date: "), c))).otherwise(parsed)


def to_day(c) -> Column:
    """Timestamp (without time zone) to its calendar day."""
    return col(c).cast("date")


def month_name(d, names) -> Column:
    """Full month name of date ``d`` from the 12 ``names`` (January first); NULL stays NULL.

    The explicit NULL guard is needed: in generated code ``element_at`` over a literal array
    reads a NULL index as -1 (the last element) on Spark 4.1.
    """
    d = col(d)
    return F.when(d.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in names]), F.month(d)))


def ntz_literal(ts: dt.datetime) -> Column:
    """A timestamp-without-zone literal, the same whatever the session or Python time zone."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def close_interval(end, as_of: dt.datetime | None = None) -> Column:
    """End of an interval, the ``as_of`` instant when still open (NULL).

    With ``as_of`` None the session's local time is used (``localtimestamp``, timestamp
    without zone, like the stored ends); pass a fixed instant for repeatable runs.
    """
    now = F.localtimestamp() if as_of is None else ntz_literal(as_of)
    return F.coalesce(col(end).cast("timestamp_ntz"), now)


def count_up_to(d, ordered) -> Column:
    """How many of the dates ``ordered`` (ascending, distinct, not empty) are ``d`` or earlier, by binary search."""
    n = len(ordered)
    dates = F.array(*[F.lit(x) for x in ordered])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def step(found: Column, size: Column) -> Column:
        there = found + size
        return F.when((there <= n) & (F.element_at(dates, F.least(there, F.lit(n))) <= d), there).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def business_days(start, end, holidays=()) -> Column:
    """Monday-to-Friday days in [start, end], both ends counted, minus weekday ``holidays``.

    End before start gives 0; a NULL end or start gives NULL. Whole weeks count 5 each; the
    0-6 remaining days start on the weekday of ``start`` (0 = Monday), and of the offsets
    ``w0 .. w0+r-1`` those in 0-4 or 7-11 are weekdays.
    """
    s, e = col(start).cast("date"), col(end).cast("date")
    n = F.datediff(e, s) + 1
    weeks = F.floor(n / F.lit(7)).cast("int")
    r = n - weeks * 7
    w0 = F.weekday(s)
    tail = F.greatest(F.lit(0), F.least(F.lit(4), w0 + r - 1) - w0 + 1) + F.greatest(F.lit(0), w0 + r - 7)
    count = weeks * 5 + tail
    days = sorted({d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)) for d in holidays})
    days = [d for d in days if d.weekday() < 5]  # a weekend holiday is not a business day anyway
    if days:
        count = count - (count_up_to(e, days) - count_up_to(F.date_sub(s, 1), days))
    return F.when(s.isNull() | e.isNull(), F.lit(None).cast("int")).when(e < s, F.lit(0)).otherwise(count)
