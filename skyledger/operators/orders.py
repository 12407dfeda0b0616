"""Orders, pricing and lifecycle updates.

Read operators return DataFrames over all orders (one customer's history is
a filter on ``Email``). Lifecycle operators are copy-on-write: they return
the *new* version of the table as a DataFrame, leaving the write to
:func:`skyledger.sources.io.commit_table` (never read and overwrite one path in one plan).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from skyledger import schemas as S
from skyledger.functions import predicates as P
from skyledger.functions.predicates import email_key
from skyledger.functions.scalar import as_of_lit, more_than_hours_ahead, round2, trunc_day
from skyledger.operators.inventory import flight_search
from skyledger.operators.relational import rewrite_update, union_all
from skyledger.sources.io import rewrite_rows, store
from skyledger.sources.views import Tables

ORDER_KEY = ["CustomerKind", "OrderID"]


def seats_per_order(t) -> DataFrame:
    """Seat count per order (orders without seat rows are absent)."""
    return t.seats.groupBy(*ORDER_KEY).agg(F.count(F.lit(1)).alias("NumSeats"))


def quote_price(t, requests: DataFrame) -> DataFrame:
    """D20 — ``price × seats`` for (FlightID, ClassType, NumSeats) requests."""
    return (requests.join(t.prices.select("FlightID", "ClassType", "Price"), ["FlightID", "ClassType"])
            .withColumn("TotalPrice", F.col("Price") * F.col("NumSeats")))


def _history_base(t) -> DataFrame:
    """Orders with seat counts, price and flight columns.

    Prices meet flights first (flight-sized inputs, both keyed by FlightID),
    so the order-sized side is shuffled only twice: by order key for the
    seat counts and by (flight, class) for the price.
    """
    per_order = seats_per_order(t)
    status = F.col("OrderStatus")
    base = F.col("NumSeats") * F.col("Price")
    flight_class = (t.prices.select("FlightID", "ClassType", "Price")
                    .join(t.flights.select("FlightID", "SourceField", "DestinationField", "TakeOffTime"), "FlightID"))
    return (t.orders.join(per_order, ORDER_KEY)
            .join(flight_class, ["FlightID", "ClassType"])
            .withColumn("OrderPrice", round2(F.when(status == S.ORDER_CUSTOMER_CANCELLED, base * S.CANCELLATION_FEE)
                                             .when(status == S.ORDER_SYSTEM_CANCELLED, F.lit(0.0))
                                             .otherwise(base))))


HISTORY_COLUMNS = ["CustomerKind", "Email", "OrderID", "FlightID", "ClassType", "NumSeats", "OrderStatus",
                   "OrderDate", "OrderPrice", "SourceField", "DestinationField", "TakeOffTime"]


def order_history(t, status: str | None = None, sort: bool = True) -> DataFrame:
    """D21 — per order: seats, route, take-off, status and price.

    ``OrderPrice`` is seats × price, × 0.05 when customer-cancelled, 0 when
    system-cancelled. Orders without seat rows vanish (inner join), as in the
    source application. Sorted by order id, newest first.
    """
    h = _history_base(t)
    if status:
        h = h.filter(F.col("OrderStatus") == S.normalize_status(status))
    h = h.select(*HISTORY_COLUMNS)
    return h.orderBy(F.desc("OrderID"), "CustomerKind") if sort else h


def order_lookup(t, requests: DataFrame) -> DataFrame:
    """D22 — history row for each (OrderID, Email) request, however the email is spelled; NULLs when not found."""
    h = order_history(t, sort=False).withColumn("_email", email_key()).drop("Email")
    return (requests.select("OrderID", "Email", email_key().alias("_email"))
            .join(h, ["OrderID", "_email"], "left").drop("_email"))


def order_cancellable(t, as_of: dt.datetime) -> DataFrame:
    """D23 — take-off more than 36 h ahead; detail page also needs a live order, the list an Active one."""
    h = order_history(t, sort=False)
    ahead = more_than_hours_ahead("TakeOffTime", as_of, S.ORDER_CANCEL_WINDOW_HOURS)
    return h.select("CustomerKind", "OrderID", "Email", "OrderStatus", "TakeOffTime",
                    ahead.alias("CanCancel"),
                    (ahead & P.not_cancelled("OrderStatus")).alias("DetailCancellable"),
                    (ahead & (F.col("OrderStatus") == S.ORDER_ACTIVE)).alias("ListCancellable"))


def flight_cancellable(t, as_of: dt.datetime) -> DataFrame:
    """D24 — a flight can be cancelled when it leaves more than 72 h after ``as_of`` and is not Deleted."""
    f = flight_search(t, as_of, sort=False)
    return f.select("FlightID", "TakeOffTime", "FlightStatus",
                    (more_than_hours_ahead("TakeOffTime", as_of, S.FLIGHT_CANCEL_WINDOW_HOURS)
                     & (F.col("FlightStatus") != S.FLIGHT_DELETED)).alias("CanCancel"))


def cancel_quote(t) -> DataFrame:
    """D25 — cancellation fee (5 %) and refund (95 %) of the undiscounted order price."""
    h = _history_base(t)
    base = F.col("NumSeats") * F.col("Price")
    return h.select("CustomerKind", "OrderID", round2(base).alias("BasePrice"),
                    round2(base * S.CANCELLATION_FEE).alias("CancellationFee"),
                    round2(base * (1 - S.CANCELLATION_FEE)).alias("Refund"))


def complete_orders(t, as_of: dt.datetime) -> DataFrame:
    """D26 — live orders whose flight left at or before midnight of ``as_of`` become Complete.

    Returns the whole new orders table.
    """
    midnight = trunc_day(as_of_lit(as_of))
    fl = t.flights.select("FlightID", F.col("TakeOffTime").alias("_to"))
    o = t.orders.join(fl, "FlightID", "left")
    out = rewrite_update(o, (F.col("_to") <= midnight) & P.not_cancelled("OrderStatus"),
                         {"OrderStatus": S.ORDER_COMPLETE})
    return out.select(*t.orders.columns)


def cancel_orders(t, requests: DataFrame) -> DataFrame:
    """D27 — listed orders (CustomerKind, OrderID) become Customer_Cancelled; whole new table."""
    hit = requests.select(*ORDER_KEY).distinct().withColumn("_hit", F.lit(True))
    o = t.orders.join(hit, ORDER_KEY, "left")
    return rewrite_update(o, F.col("_hit"), {"OrderStatus": S.ORDER_CUSTOMER_CANCELLED}).select(*t.orders.columns)


def cancel_flights(t, flight_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D28 — mark flights deleted and set *all* their orders System_Cancelled.

    Returns ``(new_flights, new_orders)`` computed from one id list.
    """
    hit = flight_ids.select("FlightID").distinct().withColumn("_hit", F.lit(True))
    flights = (rewrite_update(t.flights.join(hit, "FlightID", "left"), F.col("_hit"), {"IsDeleted": True})
               .select(*t.flights.columns))
    orders = (rewrite_update(t.orders.join(hit, "FlightID", "left"), F.col("_hit"),
                             {"OrderStatus": S.ORDER_SYSTEM_CANCELLED})
              .select(*t.orders.columns))
    return flights, orders


# ---- the same on a versioned table: only file sets with changed rows are rewritten (S5) ------------

def complete_orders_stored(t, spark, root: str, as_of: dt.datetime) -> int:
    """D26 on the ``orders`` stored under ``root``; returns the version that holds the result."""
    fl = t.flights.where(F.col("TakeOffTime") <= trunc_day(as_of_lit(as_of))).select("FlightID")
    due = P.not_cancelled("OrderStatus") & (F.col("OrderStatus") != S.ORDER_COMPLETE)
    return rewrite_rows(spark, root, "orders", lambda rows: complete_orders(Tables(t, orders=rows), as_of),
                        lambda rows: rows.where(due).join(fl, "FlightID", "left_semi"))


def cancel_orders_stored(t, spark, root: str, requests: DataFrame) -> int:
    """D27 on the ``orders`` stored under ``root``; returns the version that holds the result."""
    return rewrite_rows(spark, root, "orders", lambda rows: cancel_orders(Tables(t, orders=rows), requests),
                        lambda rows: rows.where(F.col("OrderStatus") != S.ORDER_CUSTOMER_CANCELLED)
                        .join(requests.select(*ORDER_KEY), ORDER_KEY, "left_semi"))


def cancel_flights_stored(t, spark, root: str, flight_ids: DataFrame) -> tuple[int, int]:
    """D28 on the ``flights`` and ``orders`` stored under ``root``; returns both versions, the orders' last.

    The flights come first: a job lost in between is repeated as a whole and finds them done.
    """
    ids = store(flight_ids.select("FlightID").distinct(), "cancelled-flights")  # read by every file set's rewrite
    flights = rewrite_rows(spark, root, "flights", lambda rows: cancel_flights(Tables(t, flights=rows), ids)[0],
                           lambda rows: rows.where("NOT IsDeleted").join(ids, "FlightID", "left_semi"))
    orders = rewrite_rows(spark, root, "orders", lambda rows: cancel_flights(Tables(t, orders=rows), ids)[1],
                          lambda rows: rows.where(F.col("OrderStatus") != S.ORDER_SYSTEM_CANCELLED)
                          .join(ids, "FlightID", "left_semi"))
    return flights, orders


def customer_profile(t) -> DataFrame:
    """D29 — customer columns plus their phones, sorted and comma-joined ('' when none).

    The per-customer list is bounded by the 10-phone rule enforced at ingestion.
    """
    phones = (t.customer_phones.groupBy(email_key().alias("_email"))
              .agg(F.array_join(F.sort_array(F.collect_list("Phone")), ",").alias("Phones")))
    return (t.customers.withColumn("_email", email_key()).join(phones, "_email", "left")
            .withColumn("Phones", F.coalesce("Phones", F.lit(""))).drop("_email"))


def known_emails(t, of: tuple[str, ...] = ("customers", "guests", "managers")) -> DataFrame:
    """One row per address (its :func:`email_key`, ``_email``) that any of the tables holds, with a flag per table.

    The tables meet in one union and one aggregate, so asking all three costs
    the shuffle of one.
    """
    flags = {"customers": "IsCustomer", "guests": "IsGuest", "managers": "IsManager"}
    frames = [t[name].select(email_key().alias("_email"), *[F.lit(other == name).alias(flags[other]) for other in of])
              for name in of]
    return (union_all(frames).where("_email IS NOT NULL").groupBy("_email")
            .agg(*[F.bool_or(flags[name]).alias(flags[name]) for name in of]))


def membership_flags(t, emails: DataFrame) -> DataFrame:
    """J8 — for a batch of emails: is it a registered customer, a guest, a manager, however it is spelled."""
    e = emails.select("Email").distinct().withColumn("_email", email_key())
    return (e.join(known_emails(t), "_email", "left")
            .select("Email", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("IsCustomer", "IsGuest", "IsManager")]))


def known_phones(t, pairs: DataFrame, kind: str = S.KIND_CUSTOMER) -> DataFrame:
    """J8 — for (Email, Phone) pairs: is the pair already stored."""
    stored = ((t.customer_phones if kind == S.KIND_CUSTOMER else t.guest_phones)
              .select(email_key().alias("_email"), "Phone").distinct().withColumn("Known", F.lit(True)))
    p = pairs.select("Email", F.trim("Phone").alias("Phone")).distinct().withColumn("_email", email_key())
    return (p.join(stored, ["_email", "Phone"], "left")
            .select("Email", "Phone", F.coalesce("Known", F.lit(False)).alias("Known")))
