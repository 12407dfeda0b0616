"""Validated batch ingestion.

The source application inserted one row per statement and relied on the
database to refuse bad rows. Here each operator takes a whole batch of new
rows (with a unique ``Seq`` giving arrival order) and returns every batch row
with ``RejectReason`` — NULL for accepted rows. The first applicable reason
wins. In-batch duplicates follow insert order: the first valid row for a key
is accepted, later ones are rejected, exactly as sequential inserts against a
primary key would behave.

:func:`accepted` / :func:`rejected` split a result; accepted rows are
appended with :func:`skyledger.sources.io.append_rows` in one write.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger import schemas as S
from skyledger.functions.predicates import email_key
from skyledger.functions.scalar import add_seconds, as_of_lit, is_long, seat_token_col, seat_token_line, trunc_day
from skyledger.operators.assign import can_take, qualifies, resource_profiles, staffing_feasibility
from skyledger.operators.inventory import occupied_seats
from skyledger.operators.orders import known_emails
from skyledger.operators.relational import allocate_ids, first_k_per_group
from skyledger.sources.io import store

REASON = "RejectReason"


def accepted(result: DataFrame) -> DataFrame:
    return result.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(result: DataFrame) -> DataFrame:
    return result.filter(F.col(REASON).isNotNull())


def _first_reason(checks: list[tuple[Column, str | Column]]) -> Column:
    """First failing check's label; NULL when all pass (NULL checks count as passing)."""
    out = F.lit(None).cast("string")
    for cond, label in reversed(checks):
        out = F.when(F.coalesce(cond, F.lit(False)), label if isinstance(label, Column) else F.lit(label)).otherwise(out)
    return out


def _missing(*cols: str) -> Column:
    """Any of the required columns is NULL."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def _flag(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(name, F.lit(True))


def _mark_in_batch_duplicates(df: DataFrame, keys: list[str], label: str = "duplicate in batch") -> DataFrame:
    """Among rows without a reason yet, only the first (by Seq) per key is kept.

    The first Seq per key is a partial aggregate, so a key that many requests
    share meets in no single task; the join back is split by AQE if it is skewed.
    The first Seqs come from the very rows that they are joined to, without a filter that would reach below
    them, so Spark computes and shuffles those once.
    """
    first = (df.groupBy(*keys).agg(F.min(F.when(F.col(REASON).isNull(), F.col("Seq"))).alias("_first"))
             .toDF(*[f"_key{i}" for i in range(len(keys))], "_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    # a null is no key: no duplicate of another
    late = F.col(REASON).isNull() & (F.col("Seq") != F.col("_first")) & ~_missing(*keys)
    return (df.join(first, same, "left")
            .withColumn(REASON, F.when(late, F.lit(label)).otherwise(F.col(REASON))).drop(*first.columns))


# ---- I1 customers / guests --------------------------------------------------------

def ingest_customers(t, batch: DataFrame) -> DataFrame:
    """I1 — batch: Email, EngFirstName, EngLastName, PassportNumber, Birthdate, SignUpDate, IsSignedUp, Seq.

    Registered customers need passport, birth and sign-up dates; guests only
    names and email. Manager emails and emails already registered (in the
    target table) are refused; an email is the same in any case of letters.
    """
    b = batch.withColumn("_email", email_key()).join(known_emails(t), "_email", "left")
    signed = F.col("IsSignedUp")
    missing = (_missing("Email", "EngFirstName", "EngLastName", "IsSignedUp")
               | (signed & (F.col("PassportNumber").isNull() | F.col("Birthdate").isNull()
                            | F.col("SignUpDate").isNull())))
    b = b.withColumn(REASON, _first_reason([
        (missing, "missing field"),
        (F.col("IsManager"), "manager email"),
        (F.when(signed, F.col("IsCustomer")).otherwise(F.col("IsGuest")), "exists"),
    ]))
    return _mark_in_batch_duplicates(b, ["_email", "IsSignedUp"]).select(*batch.columns, REASON)


# ---- I2 phones ------------------------------------------------------------------------

def ingest_phones(t, batch: DataFrame) -> DataFrame:
    """I2 — batch: Email, Phone, IsSignedUp, Seq. Phones are trimmed; stored pairs are
    skipped; a user keeps at most 10 phones (stored + new, in arrival order).

    Stored phones and valid requests are reduced together to one row per
    (user, phone); the ranking of the new ones and the count of the stored ones
    then work on those, and the verdicts go back to the requests in one join.
    """
    user = ["_email", "IsSignedUp"]
    stored = (t.customer_phones.withColumn("IsSignedUp", F.lit(True))
              .unionByName(t.guest_phones.withColumn("IsSignedUp", F.lit(False))).withColumn("_email", email_key()))
    b = (batch.withColumn("Phone", F.trim("Phone")).withColumn("_email", email_key())
         .withColumn(REASON, _first_reason([
             (_missing("Email", "IsSignedUp"), "missing field"),
             (F.col("Phone").isNull() | (F.col("Phone") == ""), "empty phone")])))
    pairs = (stored.select(*user, "Phone", F.lit(None).cast("long").alias("Seq"), F.lit(True).alias("_known"))
             .unionByName(b.filter(F.col(REASON).isNull()).select(*user, "Phone", F.col("Seq").cast("long").alias("Seq"),
                                                                  F.lit(False).alias("_known")))
             .groupBy(*user, "Phone").agg(F.min("Seq").alias("_first"), F.bool_or("_known").alias("_known")))
    have = pairs.filter("_known").groupBy(*user).agg(F.count(F.lit(1)).alias("_have"))
    new = first_k_per_group(pairs.filter("NOT _known"), user, "_first", S.MAX_PHONES_PER_USER)
    kept = (new.join(have, user, "left")
            .filter(F.col("_rank") + F.coalesce("_have", F.lit(0)) <= S.MAX_PHONES_PER_USER)
            .select(F.col("_first").alias("Seq"), F.lit(True).alias("_kept")))
    return (b.join(pairs, [*user, "Phone"], "left").join(kept, "Seq", "left")
            .select(*batch.columns, F.coalesce(REASON, _first_reason([
                (F.col("_known"), "exists"),
                (F.col("Seq") != F.col("_first"), "duplicate in batch"),
                (F.col("_kept").isNull(), "too many phones")])).alias(REASON)))


# ---- I3 orders -----------------------------------------------------------------------------

def ingest_orders(t, batch: DataFrame, as_of: dt.datetime) -> DataFrame:
    """I3 — batch: Email, FlightID, ClassType, Seq.

    Accepted rows get a new OrderID (after the largest existing one, in Seq
    order), status Active, today's date, the flight's plane, and go to the
    customer table when the email is registered, else to the guest table.
    """
    return _as_orders(t, _order_requests(t, batch, as_of), as_of)


def _order_requests(t, batch: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Requests with their flight's plane, whether the email is registered, and the reject reason."""
    fl = t.flights.select("FlightID", F.col("PlainID").alias("_plane"), "TakeOffTime", "IsDeleted",
                          F.lit(True).alias("_fl"))
    priced = _flag(t.prices, ["FlightID", "ClassType"], "_priced")
    b = (batch.withColumn("_email", email_key()).join(known_emails(t, ("customers", "managers")), "_email", "left")
         .join(fl, "FlightID", "left")
         .join(priced, ["FlightID", "ClassType"], "left"))
    return b.withColumn(REASON, _first_reason([
        (_missing("Seq", "Email", "FlightID", "ClassType"), "missing field"),
        (F.col("IsManager"), "manager email"),
        (F.col("_fl").isNull(), "unknown flight"),
        (F.col("IsDeleted"), "flight deleted"),
        (F.col("TakeOffTime") <= as_of_lit(as_of), "flight departed"),
        (F.col("_priced").isNull(), "class not offered"),
    ])).select(*batch.columns, "_plane", F.coalesce("IsCustomer", F.lit(False)).alias("_cust"), REASON)


def _as_orders(t, b: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Order columns of validated requests; accepted ones get their new ids."""
    start = t.orders.agg(F.coalesce(F.max("OrderID"), F.lit(0)).cast("long")).scalar()
    out = allocate_ids(b, "Seq", start, "OrderID", F.col(REASON).isNull())
    return out.select(
        "Seq", "Email", "FlightID", "ClassType", REASON,
        "OrderID",
        F.when(F.col(REASON).isNull(),
               F.when(F.col("_cust"), S.KIND_CUSTOMER).otherwise(S.KIND_GUEST)).alias("CustomerKind"),
        F.when(F.col(REASON).isNull(), F.lit(S.ORDER_ACTIVE)).alias("OrderStatus"),
        F.when(F.col(REASON).isNull(), F.to_date(as_of_lit(as_of))).alias("OrderDate"),
        F.when(F.col(REASON).isNull(), F.col("_plane")).alias("PlainID"))


# ---- I4 seats ------------------------------------------------------------------------------

def ingest_order_seats(t, batch: DataFrame) -> DataFrame:
    """I4 — batch: CustomerKind, OrderID, SeatToken ('row-col'), Seq.

    The seat must exist in the order's cabin, must not be held by a live
    order on the same flight and class, and may be requested only once per
    batch (first request wins).
    """
    o = t.orders.select("CustomerKind", "OrderID", "FlightID", "PlainID", "ClassType", F.lit(True).alias("_o"))
    b = _seat_checks(t, batch.join(o, ["CustomerKind", "OrderID"], "left"), [
        (_missing("CustomerKind", "OrderID", "SeatToken"), "missing field"),
        (F.col("_o").isNull(), "unknown order")])
    b = _mark_in_batch_duplicates(b, ["FlightID", "ClassType", "Line", "SeatLetter"], "seat requested twice")
    return b.select("Seq", "CustomerKind", "OrderID", "SeatToken", "Line", "SeatLetter", "FlightID", "ClassType",
                    REASON)


SEAT = ["FlightID", "ClassType", "Line", "SeatLetter"]


def _seat_checks(t, requests: DataFrame, before: list[tuple[Column, str]]) -> DataFrame:
    """Line, SeatLetter and reason of seat requests that carry FlightID, PlainID, ClassType and SeatToken."""
    cab = t.cabins.select("PlainID", "ClassType", "NumberRows", "NumberCols")
    taken = _flag(occupied_seats(t), SEAT, "_taken")
    b = (requests.withColumn("Line", seat_token_line("SeatToken"))
         .withColumn("SeatLetter", seat_token_col("SeatToken"))
         .join(cab, ["PlainID", "ClassType"], "left").join(taken, SEAT, "left"))
    bad_seat = (F.col("Line").isNull() | F.col("SeatLetter").isNull() | F.col("NumberRows").isNull()
                | (F.col("Line") < 1) | (F.col("SeatLetter") < 1)
                | (F.col("Line") > F.col("NumberRows")) | (F.col("SeatLetter") > F.col("NumberCols")))
    return b.withColumn(REASON, _first_reason([
        *before, (bad_seat, "no such seat"), (F.col("_taken").isNotNull(), "seat taken")]))


# ---- I5/I6 planes and cabins -------------------------------------------------------------------

def ingest_planes(t, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """I5/I6 — batch: PlainID, Manufacturer, PurchaseDate, RegularRows, RegularCols,
    BusinessRows, BusinessCols, Seq. Classes with zero rows or columns are dropped;
    the plane is Large iff both classes remain (D16). Returns (planes result, new cabin rows)."""
    reg = (F.col("RegularRows") > 0) & (F.col("RegularCols") > 0)
    bus = (F.col("BusinessRows") > 0) & (F.col("BusinessCols") > 0)
    b = (batch.join(_flag(t.planes, ["PlainID"], "_exists"), "PlainID", "left")
         .withColumn(REASON, _first_reason([
             (F.col("PlainID").isNull() | F.col("Manufacturer").isNull(), "missing field"),
             (F.col("_exists").isNotNull(), "exists"),
             (~F.coalesce(reg, F.lit(False)) & ~F.coalesce(bus, F.lit(False)), "no cabin")]))
         .drop("_exists"))
    b = _mark_in_batch_duplicates(b, ["PlainID"])
    planes = b.withColumn("Size", F.when(reg & bus, S.SIZE_LARGE).otherwise(S.SIZE_SMALL))
    ok = accepted(planes)
    cabins = (ok.select("PlainID", F.inline(F.array(
        F.struct(F.lit(S.CLASS_REGULAR).alias("ClassType"), F.col("RegularRows").cast("int").alias("NumberRows"),
                 F.col("RegularCols").cast("int").alias("NumberCols")),
        F.struct(F.lit(S.CLASS_BUSINESS).alias("ClassType"), F.col("BusinessRows").cast("int").alias("NumberRows"),
                 F.col("BusinessCols").cast("int").alias("NumberCols")))))
              .filter((F.col("NumberRows") > 0) & (F.col("NumberCols") > 0))
              .select("ClassType", "PlainID", "NumberRows", "NumberCols"))
    return planes, cabins


# ---- I7 flights --------------------------------------------------------------------------------

def ingest_flights(t, batch: DataFrame, as_of: dt.datetime, check_staffing: bool = True) -> DataFrame:
    """I7 — batch: PlainID, TakeOffTime, SourceField, DestinationField, Seq.

    Refused: same source and destination, no such route, unknown plane, a
    take-off day that is not after ``as_of``; a flight that cannot be staffed
    (D14: the batch's valid flights are the planning candidates, landing =
    take-off + route duration), a plane that cannot take the flight (D12), and
    all but the first flight of a plane in the batch, as the first one changes where
    the plane is. Accepted rows get a new FlightID (after the largest existing
    one, in Seq order) and IsDeleted = false. ``check_staffing=False`` leaves
    the last three checks out (flights whose crews are planned elsewhere).

    The requests that pass the first checks are stored once in the shared
    folder; the staffing checks and the result read them from there.
    """
    b = (batch.join(t.routes.select("SourceField", "DestinationField", "DurationSec"),
                    ["SourceField", "DestinationField"], "left")
         .join(_flag(t.planes, ["PlainID"], "_plane"), "PlainID", "left"))
    b = b.withColumn(REASON, _first_reason([
        (_missing("Seq", "PlainID", "TakeOffTime", "SourceField", "DestinationField"), "missing field"),
        (F.col("SourceField") == F.col("DestinationField"), "same field"),
        (F.col("DurationSec").isNull(), "no route"),
        (F.col("_plane").isNull(), "unknown plane"),
        (trunc_day("TakeOffTime") <= as_of_lit(as_of), "not in the future"),
    ])).drop("_plane")
    if check_staffing:
        b = _staffing_checks(t, store(b, "flight-requests"))
    start = t.flights.agg(F.coalesce(F.max("FlightID"), F.lit(0)).cast("long")).scalar()
    return (allocate_ids(b, "Seq", start, "FlightID", F.col(REASON).isNull())
            .withColumn("IsDeleted", F.when(F.col(REASON).isNull(), F.lit(False)))
            .select("Seq", "FlightID", "PlainID", "TakeOffTime", "SourceField", "DestinationField", "IsDeleted",
                    REASON))


def _staffing_checks(t, b: DataFrame) -> DataFrame:
    landing = add_seconds("TakeOffTime", "DurationSec")
    long = is_long("DurationSec")
    cands = (b.filter(F.col(REASON).isNull())
             .select(F.col("Seq").alias("CandidateID"), "SourceField", "DestinationField", "TakeOffTime",
                     landing.alias("LandingTime"), "DurationSec", long.alias("IsLong")))
    feasible = staffing_feasibility(t, cands).select(F.col("CandidateID").alias("Seq"), "Feasible")
    planes = resource_profiles(t, ("planes",)).withColumnRenamed("ResourceID", "PlainID").drop("Kind")
    fits = can_take(F.col("SourceField"), F.col("DestinationField"), F.col("TakeOffTime"), landing, long)
    b = (b.join(feasible, "Seq", "left").join(planes, "PlainID", "left")
         .withColumn(REASON, F.coalesce(REASON, _first_reason([(~F.col("Feasible"), "cannot be staffed"),
                                                               (~fits, "plane not available")])))
         .drop("Feasible", *[c for c in planes.columns if c != "PlainID"]))
    return _mark_in_batch_duplicates(b, ["PlainID"], "plane used twice in batch")


# ---- I8 prices -----------------------------------------------------------------------------------

def ingest_flight_prices(t, batch: DataFrame) -> DataFrame:
    """I8 — batch: FlightID, ClassType, Price, Seq. The class must exist on the flight's
    plane (small planes have no Business); one price per (flight, class)."""
    fl = t.flights.select("FlightID", "PlainID")
    cab = _flag(t.cabins, ["PlainID", "ClassType"], "_cab")
    have = _flag(t.prices, ["FlightID", "ClassType"], "_have")
    b = (batch.join(fl, "FlightID", "left").join(cab, ["PlainID", "ClassType"], "left")
         .join(have, ["FlightID", "ClassType"], "left"))
    b = b.withColumn(REASON, _first_reason([
        (_missing("FlightID", "ClassType"), "missing field"),
        (F.col("PlainID").isNull(), "unknown flight"),
        (F.col("_cab").isNull(), "class not on plane"),
        (F.col("Price").isNull() | (F.col("Price") < 0), "bad price"),
        (F.col("_have").isNotNull(), "exists"),
    ])).drop("_cab", "_have")
    b = _mark_in_batch_duplicates(b, ["FlightID", "ClassType"])
    return b.select("Seq", "ClassType", "FlightID", "PlainID", F.col("Price").cast("double").alias("Price"), REASON)


# ---- I9 crew -------------------------------------------------------------------------------------------

def ingest_crew(t, batch: DataFrame) -> DataFrame:
    """I9 — batch: EmployeeID, Role ('Pilot' / 'Flight Attendant'), FirstName, LastName,
    Qualified4LongFlights, Seq. An id may hold one role only, across both tables."""
    held = (t.pilots.select(F.col("PilotID").alias("EmployeeID"))
            .unionByName(t.attendants.select(F.col("AttendantID").alias("EmployeeID"))))
    b = batch.join(_flag(held, ["EmployeeID"], "_held"), "EmployeeID", "left")
    b = b.withColumn(REASON, _first_reason([
        (_missing("EmployeeID", "Role", "FirstName", "LastName", "Qualified4LongFlights"), "missing field"),
        (~F.col("Role").isin(S.ROLE_PILOT, S.ROLE_ATTENDANT), "unknown role"),
        (F.col("_held").isNotNull(), "id holds a role"),
    ])).drop("_held")
    return _mark_in_batch_duplicates(b, ["EmployeeID"])


# ---- I10 crew assignments --------------------------------------------------------------------------------

def ingest_crew_assignments(t, batch: DataFrame) -> DataFrame:
    """I10 — batch: FlightID, PilotIDs array, AttendantIDs array. One row per
    (flight, crew member) with whether the number chosen meets the plane-size
    requirement (D15).

    Refused, in this order: a flight that does not exist, a person without the
    role, a person not qualified for a long flight, one already on this
    flight, one whose schedule cannot take the flight (D12), a flight whose
    chosen crew is too small, and all but the person's first flight (by
    FlightID) in the batch, as that one changes where the person is.
    """
    people_of = lambda k, col: F.transform(F.coalesce(F.array_distinct(col), F.array()), lambda e: F.struct(
        F.lit(k).alias("Kind"), e.alias("EmployeeID")))
    chosen = batch.select("FlightID", F.size(F.array_distinct("PilotIDs")).alias("_np"),
                          F.size(F.array_distinct("AttendantIDs")).alias("_na"))
    large = F.col("Size") == S.SIZE_LARGE
    flight = (t.flights.join(t.planes.select("PlainID", "Size"), "PlainID", "left")
              .join(t.routes, ["SourceField", "DestinationField"], "left"))
    req = (chosen.join(flight, "FlightID", "left")
           .withColumn("CrewComplete", (F.col("_np") >= F.when(large, 3).otherwise(2))
                       & (F.col("_na") >= F.when(large, 6).otherwise(3))))
    people = resource_profiles(t, ("pilots", "attendants")).withColumnRenamed("ResourceID", "EmployeeID")
    on_flight = (t.working_pilots.select("FlightID", F.col("PilotID").alias("EmployeeID"), F.lit("pilots").alias("Kind"))
                 .unionByName(t.working_attendants.select("FlightID", F.col("AttendantID").alias("EmployeeID"),
                                                          F.lit("attendants").alias("Kind"))))
    # The batch meets its flights before it is dealt out by person, so the shuffle by flight holds a row a request.
    rows = (batch.select("FlightID", F.concat(people_of("pilots", "PilotIDs"), people_of("attendants", "AttendantIDs"))
                         .alias("_crew")).join(req.withColumnRenamed("FlightID", "_f"), F.col("FlightID") == F.col("_f"), "left")
            .select("FlightID", F.inline("_crew"), *[c for c in req.columns if c != "FlightID"]))
    b = (rows.join(people, ["Kind", "EmployeeID"], "left")
         .join(on_flight.withColumn("_there", F.lit(True)), ["FlightID", "EmployeeID", "Kind"], "left"))
    long = F.coalesce(is_long("DurationSec"), F.lit(False))
    fits = can_take(F.col("SourceField"), F.col("DestinationField"), F.col("TakeOffTime"),
                    add_seconds("TakeOffTime", "DurationSec"), long)
    b = b.withColumn("Seq", F.col("FlightID")).withColumn(REASON, _first_reason([
        (F.col("Size").isNull(), "unknown flight"),
        (F.col("Qualified").isNull(), "no such employee in the role"),
        (~qualifies(long), "not qualified for long flights"),
        (F.col("_there").isNotNull(), "already on the flight"),
        (~fits, "not available"),
        (~F.col("CrewComplete"), "crew short of requirement"),
    ]))
    role = F.when(F.col("Kind") == "pilots", S.ROLE_PILOT).otherwise(S.ROLE_ATTENDANT).alias("Role")
    return (_mark_in_batch_duplicates(b, ["Kind", "EmployeeID"], "assigned twice in batch")
            .select("FlightID", "EmployeeID", role, "Size", "CrewComplete", REASON))


# ---- I11 key audit ---------------------------------------------------------------------------------------------

def check_keys(t) -> DataFrame:
    """I11 — PRIMARY KEY, NOT NULL and FOREIGN KEY audit over every table.

    One row per check: (TableName, CheckName, Columns, Violations). A table is
    reduced once to one row per key with its row count and the number of NULLs
    in every required column, so a repeated key meets in no single task; one
    global aggregate of those yields all its key and NULL checks. A foreign key
    groups child and parent keys together and counts the child rows of groups without
    a parent (a key with a NULL refers to nothing, and counts).
    """
    checks = []

    def row(name: str, columns: list[str], value: Column) -> Column:
        return F.struct(F.lit(name).alias("CheckName"), F.lit(",".join(columns)).alias("Columns"),
                        F.coalesce(value, F.lit(0)).cast("long").alias("Violations"))

    for table, keys in S.PRIMARY_KEYS.items():
        if t.get(table) is None:
            continue
        required = [c for c in S.REQUIRED[table] if c in t[table].columns]
        null = lambda c: F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{c}")
        per_key = t[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[null(c) for c in required if c not in keys])
        total = {c: F.sum(F.when(F.col(c).isNull(), F.col("_n"))) if c in keys else F.sum(f"_null_{c}") for c in required}
        one = per_key.agg(F.sum(F.col("_n") - 1).alias("_pk"), *[v.alias(f"_t_{c}") for c, v in total.items()])
        checks.append(one.select(F.lit(table).alias("TableName"), F.inline(F.array(
            row("primary key", keys, F.col("_pk")), *[row("not null", [c], F.col(f"_t_{c}")) for c in required]))))
    for child, ccols, parent, pcols in S.FOREIGN_KEYS:
        if t.get(child) is None or t.get(parent) is None:
            continue
        own = t[child] if child != "orders" or parent not in ("customers", "guests") else \
            t[child].filter(F.col("CustomerKind") == (S.KIND_CUSTOMER if parent == "customers" else S.KIND_GUEST))
        both = (own.select(*ccols, F.lit(1).alias("_child"), F.lit(0).alias("_parent"))
                .unionByName(t[parent].select(*[F.col(p).alias(c) for p, c in zip(pcols, ccols)],
                                              F.lit(0).alias("_child"), F.lit(1).alias("_parent"))))
        groups = both.groupBy(*ccols).agg(F.sum("_child").alias("_c"), F.sum("_parent").alias("_p"))
        lost = (F.col("_p") == 0) | reduce(lambda a, b: a | b, [F.col(c).isNull() for c in ccols])
        checks.append(groups.agg(F.sum(F.when(lost, F.col("_c"))).alias("_v"))
                      .select(F.lit(child).alias("TableName"),
                              F.inline(F.array(row(f"foreign key -> {parent}", ccols, F.col("_v"))))))
    return reduce(lambda a, b: a.unionByName(b), checks)


# ---- booking write path (I3 + I4 as one batch) ------------------------------------------------

def ingest_bookings(t, batch: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Booking requests — Email, FlightID, ClassType, SeatTokens (array of 'row-col'), Seq.

    The order is validated as in :func:`ingest_orders`, its seats as in
    :func:`ingest_order_seats`; a booking is accepted only with all its seats, as one
    purchase. Bookings count in the order of ``Seq``: one that is refused holds
    no seat, so a later booking of the same seat may still have it. Accepted
    bookings get their ids after that, without gaps. Returns ``(bookings,
    seats)``: one row per request with the first reason, and the seat rows of
    the accepted bookings, ready to append.

    Seats are settled in rounds. A pending booking that comes first on every
    seat it asks for wins; those that share a seat with a winner are refused;
    the rest go to the next round, and the first of a cabin always wins, so a
    cabin takes no more rounds than it has seats. Each round is stored in the
    shared folder.
    """
    requests = store(_order_requests(t, batch, as_of), "booking-requests")
    seats = (requests.filter(F.col(REASON).isNull())
             .select("Seq", "FlightID", "ClassType", F.col("_plane").alias("PlainID"),
                     F.posexplode("SeatTokens").alias("_pos", "SeatToken")))
    seats = _seat_checks(t, seats, []).withColumn(
        "_twice", F.row_number().over(W.partitionBy("Seq", *SEAT[2:]).orderBy("_pos")) > 1)  # one booking's few seats
    seats = store(seats.withColumn(REASON, F.coalesce(REASON, F.when(F.col("_twice"), F.lit("seat requested twice"))))
                  .select("Seq", "_pos", *SEAT, REASON), "booking-seats")
    bad = seats.filter(F.col(REASON).isNotNull()).groupBy("Seq").agg(F.min_by(REASON, "_pos").alias("_bad"))
    pending = seats.join(bad, "Seq", "left_anti").select("Seq", *SEAT)
    won, lost = [], []
    while True:
        pending = store(pending, "pending-seats")
        if pending.isEmpty():
            break
        first = pending.groupBy(*SEAT).agg(F.min("Seq").alias("_first"))
        state = (pending.join(first, SEAT).groupBy("Seq")
                 .agg(F.bool_and(F.col("Seq") == F.col("_first")).alias("_wins")))
        winners = store(state.filter("_wins").select("Seq"), "booking-winners")
        gone = pending.join(winners, "Seq", "left_semi").select(*SEAT)
        losers = store(pending.join(gone, SEAT, "left_semi").select("Seq").distinct()
                       .join(winners, "Seq", "left_anti"), "booking-losers")
        won.append(winners)
        lost.append(losers)
        pending = pending.join(winners.unionByName(losers), "Seq", "left_anti")
    none = requests.select("Seq").limit(0)
    winners = reduce(DataFrame.unionByName, won, none).withColumn("_won", F.lit(True))
    verdict = (requests.join(bad, "Seq", "left").join(winners, "Seq", "left")
               .withColumn(REASON, F.coalesce(REASON, _first_reason([
                   (F.coalesce(F.size("SeatTokens"), F.lit(0)) <= 0, "no seats"),
                   (F.col("_bad").isNotNull(), F.col("_bad")),
                   (F.col("_won").isNull(), "seat requested twice")])))
               .drop("_bad", "_won"))
    bookings = _as_orders(t, verdict, as_of)
    taken = (seats.join(bookings.filter(F.col(REASON).isNull()).select("Seq", "CustomerKind", "OrderID"), "Seq")
             .select("CustomerKind", "OrderID", "Line", "SeatLetter"))
    return bookings, taken
