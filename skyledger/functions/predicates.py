"""Predicates as typed Columns — never spliced SQL text."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skyledger import schemas as S
from skyledger.functions.scalar import as_of_lit, month_bounds, month_start

ColumnOrName = Column | str


def email_key(email: str | Column = "Email") -> Column:
    """What all spellings of one e-mail address share: addresses compare without regard to case.

    The order of the ``UTF8_LCASE`` collation as a plain key, so that joins
    hash it and aggregates stay partial.
    """
    return F.lower(email)


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def conj(preds) -> Column | None:
    """P7 — AND of the predicates that were supplied (``None`` entries skipped)."""
    preds = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, preds) if preds else None


def apply_filter(df, pred: Column | None):
    """P6 — ``WHERE`` only when there is something to filter."""
    return df if pred is None else df.filter(pred)


def contains_ci(c: ColumnOrName, text: str) -> Column:
    """P10 — ``LIKE '%text%'`` under a case-insensitive collation.

    ``contains`` matches the text literally, so ``%`` and ``_`` in the input
    need no escaping.
    """
    return F.lower(_c(c)).contains(text.lower())


def not_cancelled(status: ColumnOrName = "OrderStatus") -> Column:
    """P9 — ``NOT IN ('System_Cancelled', 'Customer_Cancelled')``."""
    return ~_c(status).isin(*S.CANCELLED_STATUSES)


def revenue_status(status: ColumnOrName = "OrderStatus") -> Column:
    """P11 — ``NOT LIKE '%Cancelled%' OR = 'Customer_Cancelled'``."""
    st = _c(status)
    return (~st.like("%Cancelled%")) | (st == S.ORDER_CUSTOMER_CANCELLED)


def not_system(status: ColumnOrName = "OrderStatus") -> Column:
    """P11 — ``NOT LIKE '%System%'``."""
    return ~_c(status).like("%System%")


def departed(ts: ColumnOrName, as_of: dt.datetime) -> Column:
    """P8/F5 — ``TakeOffTime <= NOW()``."""
    return _c(ts) <= as_of_lit(as_of)


def in_month(ts: ColumnOrName, month: str) -> Column:
    """P14 — take-off inside calendar month ``'YYYY-MM'``.

    Expressed as the source application's open interval (last second of the
    previous month, first instant of the next month); both ends are literals,
    so the predicate is pushed into the Parquet scan.
    """
    lo, hi = month_bounds(month)
    return (_c(ts) > as_of_lit(lo)) & (_c(ts) < as_of_lit(hi))


def stored_months(df: DataFrame, ts: str, first: str | None, last: str | None) -> Column | None:
    """P14 — months ``first`` to ``last`` by the partition column of a table stored by the month of ``ts``.

    None for a table that is not stored that way (:data:`skyledger.schemas.MONTHS`), or without bounds.
    """
    name = {taken_from: col for col, taken_from in S.MONTHS.values()}.get(ts)
    if name not in df.columns:
        return None
    return conj([F.col(name) >= first if first else None, F.col(name) <= last if last else None])


def months_between(df: DataFrame, ts: str, first: str | None, last: str | None) -> DataFrame:
    """P14 — rows of the calendar months ``first`` to ``last`` (both whole, None: open).

    The bounds on ``ts`` are pushed into the scan; a table stored by month is read in those months only.
    """
    return apply_filter(df, conj([
        stored_months(df, ts, first, last),
        _c(ts) >= as_of_lit(month_start(first)) if first else None,
        _c(ts) < as_of_lit(month_bounds(last)[1]) if last else None]))


def from_day(ts: ColumnOrName, day: dt.date | dt.datetime) -> Column:
    """P15 — "on or after a day": ``ts > day - 1 minute``."""
    if not isinstance(day, dt.datetime):
        day = dt.datetime(day.year, day.month, day.day)
    return _c(ts) > as_of_lit(day - dt.timedelta(minutes=1))


def status_group(status: ColumnOrName = "OrderStatus") -> Column:
    """P16 — display group: ``Active``, anything containing ``Cancelled``, other."""
    st = _c(status)
    return (F.when(st == S.ORDER_ACTIVE, F.lit("active"))
            .when(st.contains("Cancelled"), F.lit("cancelled"))
            .otherwise(F.lit("other")))
