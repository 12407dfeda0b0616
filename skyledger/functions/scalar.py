"""Scalar column functions, all built-in Spark expressions.

Nothing here is a Python UDF: every helper returns a ``Column`` that stays
inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from skyledger import schemas as S

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_lit(as_of: dt.datetime | str) -> Column:
    """F5 — the query clock as a zone-less timestamp literal (replaces NOW())."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    # built from text: the string -> TIMESTAMP_NTZ cast involves no time zone
    # (a Python datetime literal would pass through the local zone first)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def add_seconds(ts: ColumnOrName, seconds: ColumnOrName | int) -> Column:
    """F1 — ``DATE_ADD(ts, INTERVAL n SECOND)``; keeps TIMESTAMP_NTZ."""
    q = F.lit(seconds) if isinstance(seconds, int) else _c(seconds)
    return F.timestamp_add("SECOND", q, _c(ts))


def add_hours(ts: ColumnOrName, hours: ColumnOrName | int) -> Column:
    q = F.lit(hours) if isinstance(hours, int) else _c(hours)
    return F.timestamp_add("HOUR", q, _c(ts))


def month_text(c: ColumnOrName) -> Column:
    """F2 — ``DATE_FORMAT(d, '%Y-%m')``."""
    return F.date_format(_c(c), "yyyy-MM")


def day_of(c: ColumnOrName) -> Column:
    """F3 — ``DATE(ts)``."""
    return F.to_date(_c(c))


def hours_of(seconds: ColumnOrName) -> Column:
    """F4 — ``TIME_TO_SEC(d) / 3600.0`` as double."""
    return _c(seconds).cast("double") / F.lit(3600.0)


def round2(c: ColumnOrName) -> Column:
    """F6 — ``ROUND(x, 2)`` (HALF_UP in Spark)."""
    return F.round(_c(c), 2)


def ifnull(c: ColumnOrName, default) -> Column:
    """F7 — ``IFNULL(x, d)``."""
    return F.coalesce(_c(c), F.lit(default))


def route_pair(src: ColumnOrName = "SourceField", dst: ColumnOrName = "DestinationField") -> Column:
    """F8 — ``CONCAT(src, ' - ', dst)``."""
    return F.concat(_c(src), F.lit(" - "), _c(dst))


def full_name(first: ColumnOrName = "FirstName", last: ColumnOrName = "LastName") -> Column:
    """F8 — name join used by the report labels."""
    return F.concat_ws(" ", _c(first), _c(last))


def binary_flag(value: bool) -> Column:
    """F9 — ``BINARY(0/1)`` flags are plain booleans here."""
    return F.lit(bool(value))


def split_list(c: ColumnOrName, sep: str = ",") -> Column:
    """F10 — ``'a, b ,c'`` -> array of trimmed, non-empty items."""
    parts = F.split(_c(c), sep)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != F.lit(""))


def seat_token_line(token: ColumnOrName) -> Column:
    """F10 — seat token ``'r-c'`` -> row number."""
    return F.try_element_at(F.split(F.trim(_c(token)), "-"), F.lit(1)).try_cast("int")


def seat_token_col(token: ColumnOrName) -> Column:
    """F10 — seat token ``'r-c'`` -> column number."""
    return F.try_element_at(F.split(F.trim(_c(token)), "-"), F.lit(2)).try_cast("int")


# Accepted input formats of the source application
DATETIME_INPUT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parse_datetime(c: ColumnOrName) -> Column:
    """F11 — parse ``%Y-%m-%d[ %H:%M[:%S]]`` text; NULL when none matches."""
    return F.coalesce(*[F.try_to_timestamp(_c(c), F.lit(f)).cast("timestamp_ntz")
                        for f in DATETIME_INPUT_FORMATS])


def format_datetime(c: ColumnOrName, fmt: str = "yyyy-MM-dd HH:mm") -> Column:
    """F12 — timestamp (or timestamp text) -> text; unparsable text passes through."""
    col = _c(c)
    parsed = parse_datetime(col.cast("string"))
    return F.coalesce(F.date_format(parsed, fmt), col.cast("string"))


def month_start(month: str) -> dt.datetime:
    """F13 — first instant of ``'YYYY-MM'``."""
    y, m = (int(x) for x in month.split("-"))
    return dt.datetime(y, m, 1)


def month_bounds(month: str) -> tuple[dt.datetime, dt.datetime]:
    """F13 — (last second of the previous month, first instant of the next month).

    The month filter keeps take-offs strictly between the two, as the source
    application does (year roll-over included).
    """
    start = month_start(month)
    prev_last = start - dt.timedelta(seconds=1)
    nxt = dt.datetime(start.year + (start.month == 12), start.month % 12 + 1, 1)
    return prev_last, nxt


def days_in_month(c: ColumnOrName) -> Column:
    """F13 — number of days of the month of a date."""
    return F.dayofmonth(F.last_day(_c(c)))


def format_number(c: ColumnOrName, digits: int = 2) -> Column:
    """F14 — ``'%.2f'`` text (no thousands separator)."""
    return F.format_string(f"%.{digits}f", _c(c).cast("double"))


def capitalize(c: ColumnOrName) -> Column:
    """F15 — ``'regular'`` -> ``'Regular'``."""
    return F.initcap(_c(c))


# Report badge bands
BAND_GOOD, BAND_WARN, BAND_BAD = "success", "warning", "danger"


def cancellation_band(rate: ColumnOrName) -> Column:
    """F16 — rate < 5 good, < 15 warn, else bad."""
    r = _c(rate)
    return F.when(r < 5, BAND_GOOD).when(r < 15, BAND_WARN).otherwise(BAND_BAD)


def utilisation_band(pct: ColumnOrName) -> Column:
    """F16 — utilisation > 70 good, > 40 warn, else bad."""
    p = _c(pct)
    return F.when(p > 70, BAND_GOOD).when(p > 40, BAND_WARN).otherwise(BAND_BAD)


def trunc_second(c: ColumnOrName) -> Column:
    """F17 — drop fractional seconds."""
    return F.date_trunc("second", _c(c)).cast("timestamp_ntz")


def trunc_day(c: ColumnOrName) -> Column:
    """F17 — midnight of the same day."""
    return F.date_trunc("day", _c(c)).cast("timestamp_ntz")


def seconds_until(ts: ColumnOrName, as_of: dt.datetime) -> Column:
    """F18 — ``ts - now`` in seconds (negative when already past)."""
    return F.timestamp_diff("SECOND", as_of_lit(as_of), _c(ts))


def more_than_hours_ahead(ts: ColumnOrName, as_of: dt.datetime, hours: int) -> Column:
    """F18 — ``ts - now > INTERVAL hours`` (strict).

    Written as ``ts > literal`` so that a Parquet scan can use it as a pushed filter.
    """
    return _c(ts) > as_of_lit(as_of + dt.timedelta(hours=hours))


def is_long(duration_sec: ColumnOrName) -> Column:
    """Long flight iff the route takes strictly more than six hours."""
    return _c(duration_sec) > F.lit(S.LONG_FLIGHT_SECONDS)
