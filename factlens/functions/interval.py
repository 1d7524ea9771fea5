"""Validity intervals as column expressions: dates, both ends inclusive, null for an open end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand in for open ends inside expressions only.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def low(start) -> Column:
    return F.coalesce(_col(start), F.to_date(F.lit(FIRST_DAY)))


def high(end) -> Column:
    return F.coalesce(_col(end), F.to_date(F.lit(LAST_DAY)))


def overlaps(s1, e1, s2, e2) -> Column:
    """Whether two intervals share a day. Written without stand-ins, so that scans can prune by it."""
    s1, e1, s2, e2 = map(_col, (s1, e1, s2, e2))
    return (s1.isNull() | e2.isNull() | (s1 <= e2)) & (s2.isNull() | e1.isNull() | (s2 <= e1))


def valid_within(start, end, window_start=None, window_end=None) -> Column:
    """Whether an interval overlaps a constant window; a missing bound asks for nothing."""
    start, end, out = _col(start), _col(end), F.lit(True)
    if window_start is not None:
        out = out & (end.isNull() | (end >= F.to_date(F.lit(str(window_start)))))
    if window_end is not None:
        out = out & (start.isNull() | (start <= F.to_date(F.lit(str(window_end)))))
    return out


def valid_at(start, end, day) -> Column:
    return valid_within(start, end, day, day)


def contains(start, end, day) -> Column:
    start, end, day = map(_col, (start, end, day))
    return (start.isNull() | (start <= day)) & (end.isNull() | (day <= end))


def contains_interval(s1, e1, s2, e2) -> Column:
    return (low(s1) <= low(s2)) & (high(e2) <= high(e1))


def intersection(s1, e1, s2, e2, faithful: bool = False) -> Column:
    """The common part as struct(start, end); null if there is none, or with `faithful` an interval open at both ends."""
    start, end = F.greatest(low(s1), low(s2)), F.least(high(e1), high(e2))
    common = F.struct(F.nullif(start, F.to_date(F.lit(FIRST_DAY))).alias("start"), F.nullif(end, F.to_date(F.lit(LAST_DAY))).alias("end"))
    nothing = F.struct(F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"))
    return F.when(start <= end, common).otherwise(nothing) if faithful else F.when(start <= end, common)


def is_open_ended(start, end) -> Column:
    return _col(end).isNull() & _col(start).isNotNull()


def is_open_started(start, end) -> Column:
    return _col(start).isNull() & _col(end).isNotNull()


def rendered(start, end) -> Column:
    """`start → end` with … for an open end."""
    part = lambda x: F.coalesce(_col(x).cast("string"), F.lit("…"))
    return F.concat(part(start), F.lit(" → "), part(end))


def rendered_validity(start, end, start_label=None, end_label=None) -> Column:
    """The same with labels first, and `untemporal` where both ends are open."""
    part = lambda x, y: F.coalesce(*([F.nullif(_col(y), F.lit(""))] if y is not None else []), _col(x).cast("string"), F.lit("…"))
    return F.when(_col(start).isNull() & _col(end).isNull(), F.lit("untemporal")).otherwise(F.concat(part(start, start_label), F.lit(" → "), part(end, end_label)))
