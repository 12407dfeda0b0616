"""Seat inventory, prices, flight status and search.

All functions take the :class:`~skyledger.sources.views.Tables` bundle and
return a lazy DataFrame over *all* flights; a single flight is a filter on
the result. Aggregations run before joins wherever the semantics allow, so
the wide fact tables (orders, seats) are reduced map-side to one row per
(flight, class) before they meet another table.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skyledger import schemas as S
from skyledger.functions import predicates as P
from skyledger.functions.scalar import add_seconds, as_of_lit, is_long

CABIN_KEY = ["FlightID", "ClassType", "PlainID"]


def occupied_seats(t, include_cancelled: bool = False) -> DataFrame:
    """D1 — one row per booked seat with all order columns (both customer kinds)."""
    orders = t.orders if include_cancelled else t.orders.filter(P.not_cancelled("OrderStatus"))
    return (orders.join(t.seats, ["CustomerKind", "OrderID"])
            .select("Line", "SeatLetter", *t.orders.columns))


def _live_seat_counts(t, only_flights: DataFrame | None = None) -> DataFrame:
    """(cabin key, n): seats of live orders — counted per order first, or, for a
    selection of flights, only the seats of their orders, counted after the join."""
    orders = t.orders.filter(P.not_cancelled("OrderStatus")).select("CustomerKind", "OrderID", *CABIN_KEY)
    if only_flights is not None:
        chosen = orders.join(only_flights, "FlightID", "left_semi")
        return (t.seats.select("CustomerKind", "OrderID").join(chosen, ["CustomerKind", "OrderID"])
                .groupBy(*CABIN_KEY).agg(F.count(F.lit(1)).alias("n")))
    seats_per_order = t.seats.groupBy("CustomerKind", "OrderID").agg(F.count(F.lit(1)).alias("n"))
    return orders.join(seats_per_order, ["CustomerKind", "OrderID"]).select(*CABIN_KEY, "n")


def occupied_count(t) -> DataFrame:
    """D2 — booked seats per (flight, class, plane), zero for priced cabins without bookings.

    ``agg ∪ (prices ∖ agg)`` as one union of booked rows and priced keys and
    one aggregate on the cabin key: a single shuffle, after map-side partial
    aggregation (a hot flight never lands whole in one task).
    """
    booked = _live_seat_counts(t)
    priced = t.prices.select(*CABIN_KEY, F.lit(None).cast("long").alias("n"))
    return (booked.unionByName(priced).groupBy(*CABIN_KEY)
            .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("OccupiedSeats")))


def flight_capacity(t) -> DataFrame:
    """D3 — rows × cols per (flight, class) through the flight's plane."""
    return (t.flights.select("FlightID", "PlainID")
            .join(t.cabins, "PlainID")
            .select("FlightID", "PlainID", "ClassType",
                    (F.col("NumberRows") * F.col("NumberCols")).alias("Capacity")))


def available_seats(t) -> DataFrame:
    """D4 — capacity − occupied per (flight, plane, class).

    The keys of D2 that also have a cabin (D3): the ``InAvail`` rows of
    :func:`cabin_state`, so one union + aggregate instead of two joins.
    """
    return (cabin_state(t).filter(F.col("InAvail"))
            .select("FlightID", "PlainID", "ClassType", "Capacity", "OccupiedSeats",
                    (F.col("Capacity") - F.col("OccupiedSeats")).alias("AvailableSeats")))


def available_class_prices(t, atleast: int = 0) -> DataFrame:
    """D5 — (flight, class, price) of cabins with at least ``max(atleast, 0)`` free seats."""
    atleast = max(int(atleast or 0), 0)
    return (available_seats(t).filter(F.col("AvailableSeats") >= atleast)
            .select("FlightID", "ClassType")
            .join(t.prices.select("FlightID", "ClassType", "Price"), ["FlightID", "ClassType"])
            .select("FlightID", "ClassType", "Price"))


def known_class(classes: Sequence[str]) -> Column:
    """True for a class of the list; any other class fails the query instead of dropping out of a pivot."""
    return (F.when(F.col("ClassType").isin(*classes), F.lit(True))
            .otherwise(F.raise_error(F.concat(F.lit("class without a price column: "),
                                              F.coalesce("ClassType", F.lit("NULL")))).cast("boolean")))


def class_price_pivot(t, atleast: int = 0, classes: Sequence[str] | None = S.CLASSES) -> DataFrame:
    """D5b/A10 — one ``<class>_price`` column per class; NULL where the class is short.

    With a class list passed in the schema is stable and no job looks for it (a
    class outside it is an error); ``classes=None`` takes the classes of the
    data, from a job of its own (:func:`class_list`).
    """
    classes = class_list(t) if classes is None else classes
    out = (available_class_prices(t, atleast).filter(known_class(classes))
           .groupBy("FlightID").pivot("ClassType", list(classes)).agg(F.max("Price")))
    return out.select("FlightID", *[F.col(c).alias(f"{c}_price") for c in classes])


def class_price_map(t, atleast: int = 0) -> DataFrame:
    """A10/D5b — (FlightID, Prices): a map from every class that has the seats to its price.

    The classes are those of the data, whatever they are, and no job looks for
    them first. A flight's map holds a class once (the higher price, as in
    :func:`class_price_pivot`), so it is no longer than the plane has cabins.
    """
    return (available_class_prices(t, atleast).groupBy("FlightID", "ClassType").agg(F.max("Price").alias("Price"))
            .groupBy("FlightID")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ClassType", "Price")))).alias("Prices")))


def class_list(t, most: int = 32) -> list[str]:
    """Classes that any flight is priced in, in order; more than ``most`` are an error (columns are no place for them)."""
    found = sorted(r[0] for r in t.prices.select("ClassType").where("ClassType IS NOT NULL").distinct()
                   .limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"over {most} classes; class_price_map holds any number")
    return found


def flights_with_landing(t) -> DataFrame:
    """D7 — flights with ``LandingTime = TakeOffTime + route duration`` (inner join on route)."""
    return (t.flights.join(t.routes, ["SourceField", "DestinationField"])
            .select(*t.flights.columns, add_seconds("TakeOffTime", "DurationSec").alias("LandingTime")))


def cabin_state(t, only_flights: DataFrame | None = None) -> DataFrame:
    """Per cabin key (FlightID, ClassType, PlainID): Price, Capacity, OccupiedSeats, InAvail.

    One row for every key that is priced, booked or part of the flight's
    plane: the three inputs are unioned and aggregated once on the cabin key
    (one shuffle, partial aggregation first). ``OccupiedSeats`` is NULL for
    keys outside D2, ``InAvail`` marks the keys of D4 (priced-or-booked and
    with a cabin). Assumes orders and prices carry their flight's plane, as
    the schema's foreign keys require. ``only_flights`` (FlightID, PlainID of selected
    flights) takes the place of the flights and restricts the other inputs with a semi join before
    any aggregation — the plan for a selective search touches only the selected
    flights' orders and prices, and on flights stored by month only their partitions.
    """
    def keep(df: DataFrame) -> DataFrame:
        return df if only_flights is None else df.join(only_flights, "FlightID", "left_semi")

    none_l = F.lit(None).cast("long")
    booked = _live_seat_counts(t, only_flights).select(
        *CABIN_KEY, F.lit(None).cast("double").alias("Price"), F.lit(False).alias("_priced"),
        "n", F.lit(None).cast("int").alias("Capacity"))
    priced = keep(t.prices).select(*CABIN_KEY, "Price", F.lit(True).alias("_priced"), none_l.alias("n"),
                                   F.lit(None).cast("int").alias("Capacity"))
    flights = t.flights if only_flights is None else only_flights
    capacity = (flights.select("FlightID", "PlainID").join(t.cabins, "PlainID")
                .select("FlightID", "ClassType", "PlainID", F.lit(None).cast("double").alias("Price"),
                        F.lit(False).alias("_priced"), none_l.alias("n"),
                        (F.col("NumberRows") * F.col("NumberCols")).alias("Capacity")))
    c = (booked.unionByName(priced).unionByName(capacity).groupBy(*CABIN_KEY)
         .agg(F.max("Price").alias("Price"), F.bool_or("_priced").alias("_priced"),
              F.sum("n").alias("_booked"), F.max("Capacity").alias("Capacity")))
    in_occ = F.col("_priced") | F.col("_booked").isNotNull()
    return c.select(*CABIN_KEY, "Price", "Capacity",
                    F.when(in_occ, F.coalesce(F.col("_booked"), F.lit(0)).cast("long")).alias("OccupiedSeats"),
                    (in_occ & F.col("Capacity").isNotNull()).alias("InAvail"))


def flight_totals(t, atleast: int = 0, classes: Sequence[str] = S.CLASSES,
                  only_flights: DataFrame | None = None) -> DataFrame:
    """Everything the board needs per flight, in one aggregation over :func:`cabin_state`.

    TotalAvailableSeats (D8 input), ``<class>_price`` (D5b), TotalSeats (ΣD3),
    BookedSeats (ΣD2) and presence flags telling which of those inputs the
    flight appears in (the source joins them with inner joins).
    """
    atleast = max(int(atleast or 0), 0)
    c = cabin_state(t, only_flights).filter(known_class(classes))
    avail = F.col("Capacity") - F.col("OccupiedSeats")
    offer = F.col("InAvail") & (avail >= atleast) & F.col("Price").isNotNull()
    return c.groupBy("FlightID").agg(
        F.sum(F.when(F.col("InAvail"), avail)).alias("TotalAvailableSeats"),
        F.bool_or(F.col("InAvail")).alias("_in_status"),
        *[F.max(F.when(offer & (F.col("ClassType") == cls), F.col("Price"))).alias(f"{cls}_price")
          for cls in classes],
        F.bool_or(offer).alias("_in_prices"),
        F.sum("Capacity").alias("TotalSeats"),
        F.bool_or(F.col("Capacity").isNotNull()).alias("_in_capacity"),
        F.sum("OccupiedSeats").alias("BookedSeats"),
        F.bool_or(F.col("OccupiedSeats").isNotNull()).alias("_in_booked"))


def _status_expr(as_of: dt.datetime):
    left = F.col("TotalAvailableSeats")
    return (F.when(F.col("IsDeleted"), S.FLIGHT_DELETED)
            .when(~F.col("IsDeleted") & (left == 0), S.FLIGHT_FULL)
            .when(~F.col("IsDeleted") & (left > 0) & (F.col("TakeOffTime") <= as_of_lit(as_of)),
                  S.FLIGHT_COMPLETE)
            .otherwise(S.FLIGHT_ACTIVE))


def flight_status(t, as_of: dt.datetime) -> DataFrame:
    """D8 — first match of Deleted / Full Capacity / Complete (departed, seats left) / Active.

    Only flights with seat totals appear (the totals drive a right join).
    """
    totals = flight_totals(t).filter("_in_status").select("FlightID", "TotalAvailableSeats")
    fs = totals.join(t.flights.select("FlightID", "TakeOffTime", "IsDeleted"), "FlightID", "left")
    return fs.select("FlightID", _status_expr(as_of).alias("FlightStatus"))


def flight_search(t, as_of: dt.datetime, flight_id: int | None = None, source_field: str | None = None,
                  destination_field: str | None = None, take_off_time: dt.datetime | None = None,
                  before_time: dt.datetime | None = None, after_time: dt.datetime | None = None,
                  status: str | None = None, num_seats: int | None = None,
                  classes: Sequence[str] | None = S.CLASSES, sort: bool = True) -> DataFrame:
    """D9 — flights with status, per-class prices, TotalSeats and BookedSeats.

    ``classes=None``: a price column for each class of the data (:func:`class_list`).

    Optional filters (P7) are typed predicates; ``None``/empty means "not
    supplied". Flight-column predicates are applied to the flights side
    (pushed into the scan where they are literals); the seat inventory is
    aggregated once per flight (:func:`flight_totals`) and joined to the
    filtered flights, so one shuffle by FlightID serves status, prices and
    seat totals.
    """
    classes = class_list(t) if classes is None else classes
    f = t.flights
    preds = P.conj([
        (F.col("FlightID") == F.lit(int(flight_id))) if flight_id not in (None, "") else None,
        P.contains_ci("SourceField", source_field) if source_field else None,
        P.contains_ci("DestinationField", destination_field) if destination_field else None,
        (F.col("TakeOffTime") == as_of_lit(take_off_time.replace(microsecond=0))) if take_off_time else None,
        (F.col("TakeOffTime") < as_of_lit(before_time.replace(microsecond=0))) if before_time else None,
        (F.col("TakeOffTime") > as_of_lit(after_time.replace(microsecond=0))) if after_time else None,
        P.stored_months(f, "TakeOffTime", after_time and f"{after_time:%Y-%m}",
                        before_time and f"{before_time.replace(microsecond=0) - dt.timedelta(microseconds=1):%Y-%m}"),
    ])
    f = P.apply_filter(f, preds)
    subset = None if preds is None else f.select("FlightID", "PlainID")
    totals = (flight_totals(t, num_seats or 0, classes, subset)
              .filter(F.col("_in_status") & F.col("_in_prices") & F.col("_in_capacity") & F.col("_in_booked")))
    out = (f.select("FlightID", "SourceField", "DestinationField", "TakeOffTime", "PlainID", "IsDeleted")
           .join(totals, "FlightID")
           .withColumn("FlightStatus", _status_expr(as_of)))
    if status:
        out = out.filter(F.col("FlightStatus") == S.normalize_status(status))
    out = out.select("FlightID", "SourceField", "DestinationField", "TakeOffTime", "PlainID", "FlightStatus",
                     *[f"{c}_price" for c in classes], "TotalSeats", "BookedSeats")
    return out.orderBy("TakeOffTime", "FlightID") if sort else out


def fields_list(t, to_field: str | None = None) -> DataFrame:
    """D10 — departure fields (distinct), or the fields with a route to ``to_field``."""
    r = t.routes
    if to_field:
        return r.filter(F.col("DestinationField") == to_field).select("SourceField")
    return r.select("SourceField").distinct()


def destinations_list(t) -> DataFrame:
    """D10 — distinct destination fields."""
    return t.routes.select("DestinationField").distinct()


def flight_category(t, requests: DataFrame | None = None) -> DataFrame:
    """D11 — ``Long`` iff the route takes more than 6 h, ``Short`` otherwise, NULL without route."""
    req = t.flights if requests is None else requests
    cat = F.when(is_long("DurationSec"), "Long").when(F.col("DurationSec").isNotNull(), "Short")
    return (req.join(t.routes, ["SourceField", "DestinationField"], "left")
            .select(*req.columns, cat.alias("FlightCategory")))


def seat_map_long(t) -> DataFrame:
    """D6 (long form) — one row per seat cell of every priced cabin, ``IsFree`` per cell.

    Cells are generated per cabin with ``sequence`` + ``explode`` (rows × cols
    per cabin), occupied cells are removed with an anti join on the cell key.
    """
    shape = (t.prices.select("FlightID", "PlainID", "ClassType")
             .join(t.cabins, ["PlainID", "ClassType"]))
    cells = (shape.select("FlightID", "ClassType", F.explode(F.sequence(F.lit(1), "NumberRows")).alias("Line"),
                          "NumberCols")
             .select("FlightID", "ClassType", "Line",
                     F.explode(F.sequence(F.lit(1), "NumberCols")).alias("SeatLetter")))
    taken = (occupied_seats(t).select("FlightID", "ClassType", "Line", "SeatLetter")
             .withColumn("taken", F.lit(True)).dropDuplicates(["FlightID", "ClassType", "Line", "SeatLetter"]))
    return (cells.join(taken, ["FlightID", "ClassType", "Line", "SeatLetter"], "left")
            .select("FlightID", "ClassType", "Line", "SeatLetter",
                    F.col("taken").isNull().alias("IsFree")))


WORD = 64  # seats per number of an occupancy bitmap


def seat_bitmap(t) -> DataFrame:
    """D6 (bitmap form) — per priced cabin its shape, ``Taken`` and ``FreeSeats``.

    Cell ``(Line - 1) * cols + SeatLetter - 1`` is bit ``cell % 64`` of number ``cell / 64`` of ``Taken``
    (array of long, one per 64 cells begun). Numbers are made by ``bit_or`` with map-side
    partial aggregation, so a seat that is booked twice, or a third of all seat rows on one flight, still meet as
    one long per task; seats outside the cabin are left out. ``FreeSeats`` counts the bits that are not set.
    A cabin takes 8 bytes per 64 seats; Spark's own bitmap aggregate takes 4,096 bytes per cabin and task.
    """
    shape = (t.prices.select("FlightID", "PlainID", "ClassType")
             .join(t.cabins, ["PlainID", "ClassType"]))
    cell = (F.col("Line") - 1) * F.col("NumberCols") + F.col("SeatLetter") - 1
    numbers = (occupied_seats(t)
               .join(t.cabins.select("PlainID", "ClassType", "NumberRows", "NumberCols"), ["PlainID", "ClassType"])
               .filter((F.col("Line") >= 1) & (F.col("Line") <= F.col("NumberRows"))
                       & (F.col("SeatLetter") >= 1) & (F.col("SeatLetter") <= F.col("NumberCols")))
               .select("FlightID", "ClassType", cell.alias("cell"))
               .groupBy("FlightID", "ClassType", F.expr(f"int(cell div {WORD})").alias("word"))
               .agg(F.expr(f"bit_or(shiftleft(1L, cell % {WORD}))").alias("bits")))
    taken = (numbers.groupBy("FlightID", "ClassType")
             .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
                  F.sum(F.bit_count("bits")).alias("n")))
    m = shape.join(taken, ["FlightID", "ClassType"], "left")
    cells = F.col("NumberRows") * F.col("NumberCols")
    words = F.when(cells > 0, F.transform(
        F.sequence(F.lit(0), F.expr(f"int((NumberRows * NumberCols - 1) div {WORD})")),
        lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0).cast("long")))).otherwise(
            F.array().cast("array<bigint>"))
    return m.select("FlightID", "ClassType", "NumberRows", "NumberCols", words.alias("Taken"),
                    (cells - F.coalesce("n", F.lit(0))).cast("long").alias("FreeSeats"))


def seat_map(t) -> DataFrame:
    """D6 — per (flight, class) a rows × cols matrix of booleans, True = free, read from the bitmap."""
    def free(r, c):
        cell = r * F.col("NumberCols") + c
        return F.getbit(F.get("Taken", F.floor(cell / WORD).cast("int")), cell % WORD) == 0

    matrix = F.transform(
        F.sequence(F.lit(0), F.col("NumberRows") - 1),
        lambda r: F.transform(F.sequence(F.lit(0), F.col("NumberCols") - 1), lambda c: free(r, c)))
    return seat_bitmap(t).select("FlightID", "ClassType", "NumberRows", "NumberCols", matrix.alias("Seats"))
