"""Registry of named queries: Spark callable + optional oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs one operator over the
airline views derived from the driver tables at ``sf_dir``; ``ORACLE[name]``
is the equivalent DuckDB SQL over the same driver tables; ``OPS[name](t,
spark, sf_dir)`` runs the same operator on a given table bundle (e.g. tables
already stored as Parquet).
"""

from __future__ import annotations

import datetime as dt
import functools
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger import schemas as S
from skyledger.functions.scalar import month_bounds, more_than_hours_ahead
from skyledger.operators import assign as asg, ingest as ing, inventory as inv, key_ledger, orders as ords, reports as rep
from skyledger.plans import batches as bt
from skyledger.plans.oracle_sql import SQL
from skyledger.sources import io as sio
from skyledger.sources.views import DEFAULT_AS_OF, Tables, airline_views

AS_OF = DEFAULT_AS_OF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# the same queries as functions of a table bundle (e.g. tables already stored as Parquet)
OPS: dict[str, Callable] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(airline_views(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        OPS[name] = lambda t, spark, sf_dir: fn(t)
        s = sql if sql is not None else SQL.get(name)
        if s is not None:
            ORACLE[name] = s
        return fn
    return deco


# ---- inventory, status, search (D1–D11) --------------------------------------
register("occupied_seats")(lambda t: inv.occupied_seats(t))
register("occupied_count")(lambda t: inv.occupied_count(t))
register("flight_capacity")(lambda t: inv.flight_capacity(t))
register("available_seats")(lambda t: inv.available_seats(t))
register("available_class_prices")(lambda t: inv.available_class_prices(t, 0))
register("class_price_pivot")(lambda t: inv.class_price_pivot(t, 0))
# a third class, First, on every fourth plane
register("class_price_map")(lambda t: inv.class_price_map(bt.with_first_class(t)).select(
    "FlightID", F.to_json("Prices").alias("Prices")))
register("class_price_pivot_three")(lambda t: inv.class_price_pivot(bt.with_first_class(t), 0, bt.THREE_CLASSES))
register("flight_search_three")(lambda t: inv.flight_search(bt.with_first_class(t), AS_OF, classes=bt.THREE_CLASSES))
register("flights_with_landing")(lambda t: inv.flights_with_landing(t))
register("flight_status")(lambda t: inv.flight_status(t, AS_OF))
register("flight_search")(lambda t: inv.flight_search(t, AS_OF))

# ---- reports (R1–R7) -------------------------------------------------------------

register("report_average_occupancy")(lambda t: rep.report_average_occupancy(t, AS_OF))
register("report_occupancy_split")(lambda t: rep.report_occupancy_split(t, AS_OF))
register("report_revenue_breakdown")(lambda t: rep.report_revenue_breakdown(t, AS_OF))
register("report_business_share")(lambda t: rep.report_business_share(t, AS_OF))
register("report_employee_hours")(lambda t: rep.report_employee_hours(t, AS_OF))
register("report_top_employees")(lambda t: rep.report_top_employees(t, AS_OF, 20))
register("report_cancellation_rate")(lambda t: rep.report_cancellation_rate(t))
register("report_rate_bands")(lambda t: rep.report_rate_bands(t))
register("report_plane_activity")(lambda t: rep.report_plane_activity(t))
register("report_utilization_bands")(lambda t: rep.report_utilization_bands(t))
register("dominant_route")(lambda t: rep.dominant_route(t))
register("report_summary")(lambda t: rep.report_summary(t))

# ---- assignability (D12–D17) --------------------------------------------------------

register("assignable_planes")(lambda t: asg.assignable_resources(t, "planes"))
register("assignable_pilots")(lambda t: asg.assignable_resources(t, "pilots"))
register("assignable_attendants")(lambda t: asg.assignable_resources(t, "attendants"))
register("available_planes")(lambda t: asg.available_planes(t))
register("available_pilots")(lambda t: asg.available_pilots(t))
register("available_attendants")(lambda t: asg.available_attendants(t))
register("staffing_feasibility")(lambda t: asg.staffing_feasibility(t))
for _kind in asg.KINDS:
    register(f"class_members_{_kind}")(lambda t, k=_kind: asg.class_members(t, k))
    register(f"class_candidates_{_kind}")(lambda t, k=_kind: asg.class_candidates(t, k))
register("crew_requirement")(lambda t: asg.crew_requirement(t))
register("plane_size")(lambda t: asg.plane_size(t))
register("chain_continuity")(lambda t: asg.chain_continuity(t))
register("missing_return_routes")(lambda t: asg.missing_return_routes(t))
# every ninth route is taken away first, so that the ways back of some are missing
register("missing_return_routes_thinned")(lambda t: asg.missing_return_routes(
    Tables(t, routes=t.routes.where(F.col("DurationSec") % 540 != 0))))

# ---- orders, pricing, lifecycle (D20–D29, J8) ---------------------------------------



def _seat_requests(t):
    return (t.orders.join(ords.seats_per_order(t), ords.ORDER_KEY)
            .select("CustomerKind", "OrderID", "FlightID", "ClassType", "NumSeats"))


def _cancel_order_requests(t):
    """Cancellation requests: every Active guest order whose flight leaves more than 36 h after as_of."""
    fl = t.flights.filter(more_than_hours_ahead("TakeOffTime", AS_OF, S.ORDER_CANCEL_WINDOW_HOURS)).select("FlightID")
    return (t.orders.filter((F.col("CustomerKind") == S.KIND_GUEST) & (F.col("OrderStatus") == S.ORDER_ACTIVE))
            .join(fl, "FlightID", "left_semi").select(*ords.ORDER_KEY))


def _cancel_flight_ids(t):
    """Flights the manager table marks cancellable (more than 72 h ahead, not Deleted)."""
    return ords.flight_cancellable(t, AS_OF).filter(F.col("CanCancel")).select("FlightID")


register("quote_price")(lambda t: ords.quote_price(t, _seat_requests(t)))
register("order_history")(lambda t: ords.order_history(t))
register("order_lookup")(lambda t: ords.order_lookup(t, t.orders))
register("order_cancellable")(lambda t: ords.order_cancellable(t, AS_OF))
register("flight_cancellable")(lambda t: ords.flight_cancellable(t, AS_OF))
register("cancel_quote")(lambda t: ords.cancel_quote(t))
register("complete_orders")(lambda t: ords.complete_orders(t, AS_OF))
register("cancel_orders")(lambda t: ords.cancel_orders(t, _cancel_order_requests(t)))
register("cancel_flights_flights")(lambda t: ords.cancel_flights(t, _cancel_flight_ids(t))[0])
register("cancel_flights_orders")(lambda t: ords.cancel_flights(t, _cancel_flight_ids(t))[1])
register("customer_profile")(lambda t: ords.customer_profile(t))
register("membership_flags")(lambda t: ords.membership_flags(t, t.orders))
# the same with every second address in capitals (J8, D22: an email is the same in any case of letters)
register("membership_flags_mixed_case")(lambda t: ords.membership_flags(t, bt.mixed_case(t.orders, "OrderID")))
register("order_lookup_mixed_case")(lambda t: ords.order_lookup(t, bt.mixed_case(t.orders, "OrderID")))
register("known_phones")(lambda t: ords.known_phones(
    t, t.guest_phones.select(F.regexp_replace("Email", "^g", "c").alias("Email"), "Phone")))

# ---- seat maps, field lists, category, scans (D6, D10, D11, S1, S2, S7) ------------------

register("seat_map_long")(lambda t: inv.seat_map_long(t))
register("seat_bitmap")(lambda t: inv.seat_bitmap(t))
register("seat_map")(lambda t: inv.seat_map(t))
register("fields_list")(lambda t: inv.fields_list(t))
register("fields_to")(lambda t: inv.fields_list(t, "NATION_7"))
register("destinations_list")(lambda t: inv.destinations_list(t))
register("flight_category")(lambda t: inv.flight_category(t))
register("scan_table")(lambda t: sio.scan_table(t, "flights", ["FlightID", "TakeOffTime"]))
register("scan_derived")(lambda t: sio.scan_derived(
    inv.flights_with_landing(t), "landing",
    "SELECT FlightID, LandingTime FROM {landing} WHERE LandingTime > timestamp_ntz'2000-01-01 00:00:00'"))
register("report_to_json")(lambda t: sio.to_json_records(rep.report_revenue_breakdown(t, AS_OF)))

# ---- search with filters (P7, P10, P14, P15, Q7) -------------------------------------------


def _search_month(t):
    lo, hi = month_bounds("1998-03")
    # status spelled as the manager table's filter sends it; normalised to the stored value
    return inv.flight_search(t, AS_OF, source_field="nation_1", before_time=hi, after_time=lo, status="completed")


def _search_from_day(t):
    day = dt.datetime(2001, 7, 1)
    return inv.flight_search(t, AS_OF, destination_field="Nation_2", after_time=day - dt.timedelta(minutes=1))


register("flight_search_filtered")(_search_month)
register("flight_search_from_day")(_search_from_day)

# ---- batch ingestion (I1–I11) -------------------------------------------------------------


def register_batch(name: str, build):
    """Register an ingestion query whose batch is derived from the driver tables."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(airline_views(spark, sf_dir), spark, sf_dir)
    run.__name__ = name
    QUERIES[name] = run
    OPS[name] = build
    if name in SQL:
        ORACLE[name] = SQL[name]


register_batch("ingest_customers", lambda t, s, d: ing.ingest_customers(t, bt.signup_batch(s, d)))
register_batch("ingest_phones", lambda t, s, d: ing.ingest_phones(t, bt.phone_batch(s, d)))
register_batch("ingest_orders", lambda t, s, d: ing.ingest_orders(t, bt.order_batch(s, d), AS_OF))
register_batch("ingest_customers_mixed_case",
               lambda t, s, d: ing.ingest_customers(t, bt.mixed_case(bt.signup_batch(s, d))))
register_batch("ingest_phones_mixed_case", lambda t, s, d: ing.ingest_phones(t, bt.mixed_case(bt.phone_batch(s, d))))
register_batch("ingest_orders_mixed_case",
               lambda t, s, d: ing.ingest_orders(t, bt.mixed_case(bt.order_batch(s, d)), AS_OF))
register_batch("ingest_order_seats", lambda t, s, d: ing.ingest_order_seats(t, bt.seat_batch(s, d)))
register_batch("ingest_planes", lambda t, s, d: ing.ingest_planes(t, bt.plane_batch(s, d))[0])
register_batch("ingest_cabins", lambda t, s, d: ing.ingest_planes(t, bt.plane_batch(s, d))[1])
register_batch("ingest_flights",
               lambda t, s, d: ing.ingest_flights(t, bt.flight_batch(s, d), AS_OF, check_staffing=False))
register_batch("ingest_flights_staffed", lambda t, s, d: ing.ingest_flights(t, bt.flight_batch(s, d), AS_OF))
register_batch("ingest_flight_prices", lambda t, s, d: ing.ingest_flight_prices(t, bt.price_batch(s, d)))
register_batch("ingest_crew", lambda t, s, d: ing.ingest_crew(t, bt.crew_batch(s, d)))
register_batch("ingest_crew_assignments",
               lambda t, s, d: ing.ingest_crew_assignments(t, bt.crew_assignment_batch(s, d)))
register_batch("ingest_bookings", lambda t, s, d: ing.ingest_bookings(t, bt.booking_batch(s, d), AS_OF)[0])
register_batch("ingest_booking_seats", lambda t, s, d: ing.ingest_bookings(t, bt.booking_batch(s, d), AS_OF)[1])
# a customer's orders all ask for seats of one flight, so bookings of a batch compete
register_batch("ingest_bookings_contended",
               lambda t, s, d: ing.ingest_bookings(t, bt.booking_batch(s, d, "o_custkey"), AS_OF)[0])
# ---- stored tables: typed load (S3), append (S4), partial rewrite (S5) ------------------------


def _csv_of_flights(t, spark, sf_dir):
    path = sio.staging_path(spark, "flights-csv")
    bt.flight_lines(t).write.text(path)
    return sio.load_csv(spark, path, "flights")


def _appended(t, spark, sf_dir):
    """Guest orders as the first version, customer orders as a batch that arrives twice."""
    root = sio.staging_path(spark, "append")
    sio.append_rows(t.orders.where(F.col("CustomerKind") == S.KIND_GUEST), root, "orders")
    for _ in range(2):
        sio.append_rows(t.orders.where(F.col("CustomerKind") == S.KIND_CUSTOMER), root, "orders", batch="customers")
    return sio.read_version(spark, root, "orders")


def _derived_once(t, spark, sf_dir):
    """The bundle with the two intermediates that its tables are built on stored, for queries that store many of them."""
    if "_orders_ext" not in t:
        return t
    flights = sio.store(t["_flights_ext"], "flights-ext")
    orders = sio.store(airline_views(spark, sf_dir, flights_ext=flights)["_orders_ext"], "orders-ext")
    return airline_views(spark, sf_dir, flights_ext=flights, orders_ext=orders)


def _orders_by_year(t, spark) -> str:
    root = sio.staging_path(spark, "by-year")
    sio.commit_table(t.orders, root, "orders", split_by="year(OrderDate)")
    return root


def _completed(t, spark, sf_dir):
    root = _orders_by_year(t, spark)
    return sio.read_version(spark, root, "orders", ords.complete_orders_stored(t, spark, root, AS_OF))


def _completed_file_sets(t, spark, sf_dir):
    """File sets of the first version, their rows, and whether the second still lists them."""
    root = _orders_by_year(t, spark)
    ords.complete_orders_stored(t, spark, root, AS_OF)
    before, after = (sio.version_parts(spark, root, "orders", v) for v in (1, 2))
    rows = [spark.read.schema(S.SCHEMAS["orders"]).parquet(p).agg(F.count(F.lit(1)).alias("Rows"))
            .select(F.lit(int(p.rpartition("=")[2])).cast("long").alias("OrderYear"), "Rows", F.lit(p in after).alias("Kept"))
            for p in before]
    return functools.reduce(DataFrame.unionByName, rows)


def _cancelled(t, spark, sf_dir):
    t = _derived_once(t, spark, sf_dir)
    root = _orders_by_year(t, spark)
    sio.commit_table(t.flights, root, "flights", split_by="year(TakeOffTime)")
    return sio.read_version(spark, root, "orders", ords.cancel_flights_stored(t, spark, root, _cancel_flight_ids(t))[1])


def _by_month(t, spark):
    return sio.save_by_month(t, sio.staging_path(spark, "by-month"))


def _activity_of_months(t, spark, sf_dir):
    """Plane activity in the months in which customers cancelled at least 27 % of the orders."""
    t = _by_month(t, spark)
    busy = rep.report_cancellation_rate(t).where(F.col("Cancellation_Rate_Percent") >= 27)
    return rep.report_plane_activity(t, months=busy.select(F.col("Order_Month").alias("Month")))


AUDITED = ["planes", "cabins", "routes", "flights", "prices", "orders", "seats"]


def _audits(t, spark, sf_dir):
    """Audits of three versions: without the orders of 1997 and later, with them, and without deleted flights."""
    t = _derived_once(t, spark, sf_dir)
    root = sio.staging_path(spark, "audited")
    late = F.col("OrderDate") >= F.lit(dt.date(1997, 1, 1))
    for name in AUDITED:
        rows = t.orders.where(~late) if name == "orders" else t[name]
        sio.commit_table(rows, root, name, split_by="year(TakeOffTime)" if name == "flights" else None)
    found = [key_ledger.audit(spark, root, AUDITED)]
    sio.append_rows(t.orders.where(late), root, "orders", batch="late")
    found.append(key_ledger.audit(spark, root, AUDITED))
    sio.rewrite_rows(spark, root, "flights", change=lambda f: f.where(~F.col("IsDeleted")),
                     hit=lambda f: f.where(F.col("IsDeleted")))
    found.append(key_ledger.audit(spark, root, AUDITED))
    return functools.reduce(DataFrame.unionByName, [
        a.select(F.lit(i).alias("Audit"), "*") for i, a in enumerate(found, 1)])


register_batch("report_cancellation_rate_months",
               lambda t, s, d: rep.report_cancellation_rate(_by_month(t, s), "1996-07", "1997-06"))
register_batch("report_plane_activity_months", _activity_of_months)
register_batch("flight_search_by_month", lambda t, s, d: _search_month(_by_month(t, s)))
register_batch("check_keys_versions", _audits)
register_batch("load_csv_rows", lambda t, s, d: _csv_of_flights(t, s, d)[0])
register_batch("load_csv_rejects", lambda t, s, d: _csv_of_flights(t, s, d)[1])
register_batch("append_rows", _appended)
register_batch("complete_orders_stored", _completed)
register_batch("complete_orders_file_sets", _completed_file_sets)
register_batch("cancel_flights_stored", _cancelled)
register("check_keys")(lambda t: ing.check_keys(t))

# ---- relational primitives (§2.2–2.8), one query each ---------------------------------------
from skyledger.plans import primitives as _prim  # noqa: E402  (registers into this module)

_prim.build(register, register_batch)
