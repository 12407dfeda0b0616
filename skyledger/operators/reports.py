"""Management reports.

Each report is one lazy DataFrame. The wide inputs (orders, crew shifts,
flights) are aggregated to one row per (flight, class) or per employee
*before* they are joined to prices, planes or names, so the joins see
compact inputs and a hot flight or employee is absorbed by map-side partial
aggregation instead of landing in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window as W, functions as F

from skyledger import schemas as S
from skyledger.functions import predicates as P
from skyledger.functions.scalar import (as_of_lit, cancellation_band, day_of, month_text, route_pair,
                                        utilisation_band)
from skyledger.operators.relational import top_k
from skyledger.sources.views import Tables

CABIN_KEY = ["FlightID", "ClassType", "PlainID"]


def _order_counts(orders: DataFrame) -> DataFrame:
    """Orders per cabin key split into full-price and customer-cancelled counts."""
    cc = F.col("OrderStatus") == S.ORDER_CUSTOMER_CANCELLED
    return (orders.groupBy(*CABIN_KEY)
            .agg(F.sum(F.when(cc, 0).otherwise(1)).alias("n_full"),
                 F.sum(F.when(cc, 1).otherwise(0)).alias("n_cc")))


def _revenue(price: str = "Price") -> F.Column:
    return F.col(price) * F.col("n_full") + F.col(price) * F.lit(S.CANCELLATION_FEE) * F.col("n_cc")


def report_average_occupancy(t, as_of: dt.datetime) -> DataFrame:
    """R1 — mean over departed, non-deleted flights of Complete orders / plane capacity × 100."""
    cap = (t.cabins.groupBy("PlainID")
           .agg(F.sum(F.col("NumberRows") * F.col("NumberCols")).alias("TotalCapacity")))
    pax = (t.orders.filter(F.col("OrderStatus") == S.ORDER_COMPLETE)
           .groupBy("FlightID").agg(F.count(F.lit(1)).alias("ActualPax")))
    f = (t.flights.filter(~F.col("IsDeleted") & P.departed("TakeOffTime", as_of))
         .select("FlightID", "PlainID"))
    ratio = F.coalesce(F.col("ActualPax"), F.lit(0)).cast("double") / F.col("TotalCapacity") * 100
    return (f.join(cap, "PlainID").join(pax, "FlightID", "left")
            .agg(F.round(F.avg(ratio), 2).alias("Average_Occupancy_Percent")))


def report_occupancy_split(t, as_of: dt.datetime) -> DataFrame:
    """R7 — occupied share and the remainder to 100 (pie chart input)."""
    r1 = report_average_occupancy(t, as_of)
    occ = F.coalesce(F.col("Average_Occupancy_Percent"), F.lit(0.0))
    return r1.select(occ.alias("Occupied_Percent"), F.round(F.lit(100.0) - occ, 2).alias("Free_Percent"))


def report_revenue_breakdown(t, as_of: dt.datetime) -> DataFrame:
    """R2 — revenue by (Manufacturer, Size) and class; one price per order, 5 % if customer-cancelled."""
    counts = _order_counts(t.orders.filter(P.revenue_status("OrderStatus")))
    window_end = as_of_lit(as_of + dt.timedelta(hours=S.ORDER_CANCEL_WINDOW_HOURS))
    flights = t.flights.filter(~F.col("IsDeleted") & (F.col("TakeOffTime") <= window_end)).select("FlightID")
    rows = (counts.join(t.prices, CABIN_KEY).join(flights, "FlightID")
            .join(t.planes.select("PlainID", "Manufacturer", "Size"), "PlainID")
            .withColumn("rev", _revenue()))
    cls = F.col("ClassType")
    return (rows.groupBy("Manufacturer", "Size")
            .agg(F.round(F.sum(F.when(cls == S.CLASS_REGULAR, F.col("rev")).otherwise(0.0)), 2)
                 .alias("Regular_Safe_Revenue"),
                 F.round(F.sum(F.when(cls == S.CLASS_BUSINESS, F.col("rev")).otherwise(0.0)), 2)
                 .alias("Business_Safe_Revenue"),
                 F.round(F.sum("rev"), 2).alias("Total_Safe_Revenue"))
            .orderBy(F.desc("Total_Safe_Revenue"), "Manufacturer", "Size"))


def report_business_share(t, as_of: dt.datetime) -> DataFrame:
    """R2b — Business / Total × 100, 0 when Total ≤ 0."""
    r2 = report_revenue_breakdown(t, as_of)
    share = F.when(F.col("Total_Safe_Revenue") > 0,
                   F.col("Business_Safe_Revenue") / F.col("Total_Safe_Revenue") * 100).otherwise(0.0)
    return r2.select("Manufacturer", "Size", F.round(share, 2).alias("Business_Share_Percent"))


def _shift_seconds(t, as_of: dt.datetime) -> DataFrame:
    """Crew shifts on departed, non-deleted flights with the route duration in seconds."""
    flights = (t.flights.filter(~F.col("IsDeleted") & P.departed("TakeOffTime", as_of))
               .join(t.routes, ["SourceField", "DestinationField"])
               .select("FlightID", "DurationSec"))
    crew = (t.working_pilots.select(F.lit(S.ROLE_PILOT).alias("Role"), F.col("PilotID").alias("EmployeeID"),
                                    "FlightID")
            .unionByName(t.working_attendants.select(F.lit(S.ROLE_ATTENDANT).alias("Role"),
                                                     F.col("AttendantID").alias("EmployeeID"), "FlightID")))
    return crew.join(flights, "FlightID")


def report_employee_hours(t, as_of: dt.datetime) -> DataFrame:
    """R3 — hours on ≤ 6 h legs, > 6 h legs and in total per employee (departed, not deleted).

    Seconds are summed as integers and converted once, so the hours are exact
    before rounding. Names are attached after the aggregation.
    """
    d = F.col("DurationSec")
    short = d <= S.LONG_FLIGHT_SECONDS
    agg = (_shift_seconds(t, as_of).groupBy("Role", "EmployeeID")
           .agg(F.sum(F.when(short, d).otherwise(0)).alias("short_s"),
                F.sum(F.when(short, 0).otherwise(d)).alias("long_s"),
                F.sum(d).alias("total_s")))
    names = (t.pilots.select(F.lit(S.ROLE_PILOT).alias("Role"), F.col("PilotID").alias("EmployeeID"),
                             "FirstName", "LastName")
             .unionByName(t.attendants.select(F.lit(S.ROLE_ATTENDANT).alias("Role"),
                                              F.col("AttendantID").alias("EmployeeID"), "FirstName", "LastName")))
    hrs = lambda c: F.round(F.col(c).cast("double") / 3600.0, 2)
    return (agg.join(names, ["Role", "EmployeeID"])
            .select("Role", "EmployeeID", "FirstName", "LastName",
                    hrs("short_s").alias("Short_Flight_Hours"), hrs("long_s").alias("Long_Flight_Hours"),
                    hrs("total_s").alias("Total_Hours"))
            .orderBy(F.desc("Total_Hours"), "Role", "EmployeeID"))


def report_top_employees(t, as_of: dt.datetime, k: int = 20) -> DataFrame:
    """R3b — first ``k`` employees by total hours (ties by role, id)."""
    return top_k(report_employee_hours(t, as_of), k, [F.desc("Total_Hours"), F.asc("Role"), F.asc("EmployeeID")])


def report_cancellation_rate(t, first_month: str | None = None, last_month: str | None = None) -> DataFrame:
    """R4 — orders, customer-cancelled orders and rate % per order month (``'YYYY-MM'`` bounds: those months only)."""
    cc = F.col("OrderStatus") == S.ORDER_CUSTOMER_CANCELLED
    orders = P.months_between(t.orders, "OrderDate", first_month, last_month)
    return (orders.groupBy(month_text("OrderDate").alias("Order_Month"))
            .agg(F.count(F.lit(1)).alias("Total_Orders"),
                 F.sum(F.when(cc, 1).otherwise(0)).alias("Cancelled_Orders"))
            .withColumn("Cancellation_Rate_Percent",
                        F.round(F.col("Cancelled_Orders").cast("double") / F.col("Total_Orders") * 100, 2))
            .orderBy("Order_Month"))


def report_rate_bands(t) -> DataFrame:
    """R4b — badge band of each month's cancellation rate."""
    return report_cancellation_rate(t).withColumn("Rate_Band", cancellation_band("Cancellation_Rate_Percent"))


def dominant_route(t) -> DataFrame:
    """W1 — most frequent route per (plane, month) among non-deleted flights; ties by route name.

    Flights are first counted per (plane, month, route); the window then
    ranks at most one row per route inside each (plane, month).
    """
    counts = (t.flights.filter(~F.col("IsDeleted"))
              .groupBy("PlainID", month_text("TakeOffTime").alias("Activity_Month"),
                       route_pair().alias("RoutePair"))
              .agg(F.count(F.lit(1)).alias("n")))
    w = W.partitionBy("PlainID", "Activity_Month").orderBy(F.desc("n"), F.asc("RoutePair"))
    return (counts.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
            .select("PlainID", "Activity_Month", F.col("RoutePair").alias("Dominant_Route")))


def flights_of_months(t, months: DataFrame) -> DataFrame:
    """P14 — flights that leave in one of ``months`` (a column ``Month`` of ``'YYYY-MM'`` texts).

    ``months`` is broadcast as one row per calendar month, so at most twelve a year whatever the data; on
    flights stored by month the scan then reads the partitions found at run time only.
    """
    month = F.col("TakeOffMonth") if "TakeOffMonth" in t.flights.columns else month_text("TakeOffTime")
    return (t.flights.withColumn("Month", month)
            .join(F.broadcast(months.select("Month").distinct()), "Month", "left_semi").drop("Month"))


def report_plane_activity(t, first_month: str | None = None, last_month: str | None = None,
                          months: DataFrame | None = None) -> DataFrame:
    """R5 — per (plane, month): executed, cancelled, utilisation % (distinct active days / 30), dominant route.

    ``first_month`` / ``last_month`` (``'YYYY-MM'``) and ``months`` (:func:`flights_of_months`) restrict it.
    """
    flights = P.months_between(t.flights, "TakeOffTime", first_month, last_month)
    if months is not None:
        flights = flights_of_months(Tables(t, flights=flights), months)
    t = Tables(t, flights=flights)
    live = ~F.col("IsDeleted")
    act = (t.flights.groupBy("PlainID", month_text("TakeOffTime").alias("Activity_Month"))
           .agg(F.sum(F.when(live, 1).otherwise(0)).alias("Executed_Flights"),
                F.sum(F.when(live, 0).otherwise(1)).alias("Cancelled_Flights"),
                F.count_distinct(F.when(live, day_of("TakeOffTime"))).alias("active_days")))
    return (act.join(t.planes.select("PlainID", "Manufacturer"), "PlainID")
            .join(dominant_route(t), ["PlainID", "Activity_Month"], "left")
            .select("Manufacturer", "PlainID", "Activity_Month", "Executed_Flights", "Cancelled_Flights",
                    F.round(F.col("active_days").cast("double") / S.UTILISATION_DAYS * 100, 2)
                    .alias("Utilization_Percent"),
                    "Dominant_Route")
            .orderBy("PlainID", "Activity_Month"))


def report_utilization_bands(t) -> DataFrame:
    """R5b — badge band of each plane-month's utilisation."""
    return report_plane_activity(t).withColumn("Utilization_Band", utilisation_band("Utilization_Percent"))


def report_summary(t) -> DataFrame:
    """R6 — one row: non-deleted flights, Active orders, revenue (no flight filter), fleet size.

    Four global aggregates combined as scalar subqueries (no cross join).
    """
    flights_n = t.flights.filter(~F.col("IsDeleted")).agg(F.count(F.lit(1))).scalar()
    active_n = t.orders.filter(F.col("OrderStatus") == S.ORDER_ACTIVE).agg(F.count(F.lit(1))).scalar()
    revenue = (_order_counts(t.orders.filter(P.not_system("OrderStatus"))).join(t.prices, CABIN_KEY)
               .agg(F.round(F.coalesce(F.sum(_revenue()), F.lit(0.0)), 2)).scalar())
    return (t.planes.agg(F.count(F.lit(1)).alias("fleet_size"))
            .select(flights_n.alias("total_flights"), active_n.alias("active_orders"),
                    revenue.alias("total_revenue"), "fleet_size"))
