"""One query per relational primitive of SURVEY §2.2–2.8, each with its SQL twin.

The domain operators already use these primitives; registering each one
separately makes the inventory checkable line by line. Every query reads
the whole airline views (or whole driver tables where no airline shape is
needed) through the library helpers.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from skyledger import schemas as S
from skyledger.functions import predicates as P
from skyledger.functions import scalar as FS
from skyledger.operators import assign, inventory as inv, relational as R, reports
from skyledger.plans.oracle_sql import SQL, inv as inv_sql
from skyledger.plans.oracle_views import AS_OF_SQL as A, with_views
from skyledger.sources.views import DEFAULT_AS_OF as AS_OF, read_driver


def _p(name, sql, fn, registry):
    SQL[name] = sql
    registry[name] = fn


def build(register, register_batch) -> None:
    q = {}

    # ---- §2.2 projections / filters -------------------------------------------------
    _p("project", with_views("SELECT F.FlightID, F.SourceField AS Src, F.DestinationField AS Dst FROM flights F"),
       lambda t: R.project(t.flights.alias("F"), ["F.FlightID", F.col("F.SourceField").alias("Src"),
                                                  F.col("F.DestinationField").alias("Dst")]), q)
    _p("project_literal", with_views("SELECT PlainID, 0 AS OccupiedSeats, 'Pilot' AS RoleType, 1 AS One FROM planes"),
       lambda t: t.planes.select("PlainID", F.lit(0).alias("OccupiedSeats"), F.lit(S.ROLE_PILOT).alias("RoleType"),
                                 F.lit(1).alias("One")), q)
    _p("project_arith", with_views(
        "SELECT FlightID, ClassType, ROUND(Price * 0.05, 2) AS Fee, Price * 2 AS DoublePrice FROM prices"),
       lambda t: t.prices.select("FlightID", "ClassType", FS.round2(F.col("Price") * 0.05).alias("Fee"),
                                 (F.col("Price") * 2).alias("DoublePrice")), q)
    _p("case_when", with_views(f"""
SELECT FlightID, CASE WHEN IsDeleted THEN 'Deleted' WHEN TakeOffTime <= {A} THEN 'Departed' ELSE 'Scheduled' END
       AS Phase FROM flights"""),
       lambda t: t.flights.select("FlightID", R.case_when(
           [(F.col("IsDeleted"), "Deleted"), (P.departed("TakeOffTime", AS_OF), "Departed")], "Scheduled")
           .alias("Phase")), q)
    _p("nested_case", with_views("""
SELECT FlightID, round(coalesce(sum(if(OrderStatus = 'Customer_Cancelled', 0.05, 1) * Price)
                                FILTER (ClassType = 'Regular'), 0), 2) AS Regular_Revenue
FROM prices JOIN orders_v USING (FlightID, ClassType, PlainID) GROUP BY ALL"""),
       lambda t: t.orders.join(t.prices, ["FlightID", "ClassType", "PlainID"]).groupBy("FlightID").agg(
           FS.round2(R.sum_when(F.col("ClassType") == S.CLASS_REGULAR,
                                R.case_when([(F.col("OrderStatus") == S.ORDER_CUSTOMER_CANCELLED,
                                              F.col("Price") * S.CANCELLATION_FEE)], F.col("Price")), 0.0))
           .alias("Regular_Revenue")), q)
    _p("filter", with_views("SELECT * FROM flights WHERE SourceField = 'NATION_3'"),
       lambda t: P.apply_filter(t.flights, F.col("SourceField") == "NATION_3"), q)
    _p("filter_optional_conjuncts", with_views(
        "SELECT * FROM flights WHERE lower(SourceField) LIKE '%nation_2%' AND TakeOffTime < TIMESTAMP '1997-01-01'"),
       lambda t: P.apply_filter(t.flights, P.conj([P.contains_ci("SourceField", "nation_2"), None,
                                                   F.col("TakeOffTime") < FS.as_of_lit(dt.datetime(1997, 1, 1))])), q)
    _p("filter_compare", with_views("""
SELECT OrderID, CustomerKind, OrderDate, OrderStatus FROM orders_v
WHERE OrderDate >= DATE '1998-01-01' AND OrderDate < DATE '1999-01-01' AND OrderStatus <> 'Active'"""),
       lambda t: t.orders.filter((F.col("OrderDate") >= F.lit(dt.date(1998, 1, 1)))
                                 & (F.col("OrderDate") < F.lit(dt.date(1999, 1, 1)))
                                 & (F.col("OrderStatus") != S.ORDER_ACTIVE))
       .select("OrderID", "CustomerKind", "OrderDate", "OrderStatus"), q)
    _p("filter_in_list", with_views("""
SELECT OrderID, CustomerKind, OrderStatus FROM orders_v
WHERE OrderStatus NOT IN ('System_Cancelled', 'Customer_Cancelled')"""),
       lambda t: t.orders.filter(P.not_cancelled()).select("OrderID", "CustomerKind", "OrderStatus"), q)
    _p("filter_like_contains", with_views("SELECT * FROM flights WHERE lower(SourceField) LIKE '%ion_1%'"),
       lambda t: t.flights.filter(P.contains_ci("SourceField", "ION_1")), q)
    _p("filter_not_like_or_eq", with_views("""
SELECT OrderID, CustomerKind, OrderStatus FROM orders_v
WHERE OrderStatus NOT LIKE '%Cancelled%' OR OrderStatus = 'Customer_Cancelled'"""),
       lambda t: t.orders.filter(P.revenue_status()).select("OrderID", "CustomerKind", "OrderStatus"), q)
    _p("filter_is_null", with_views("""
SELECT f.FlightID, r.DurationSec FROM flights f
LEFT JOIN routes r ON f.SourceField = r.SourceField AND f.DestinationField = r.DestinationField
WHERE r.DurationSec IS NULL OR r.DurationSec > 21600"""),
       lambda t: t.flights.join(t.routes, ["SourceField", "DestinationField"], "left")
       .filter(F.col("DurationSec").isNull() | FS.is_long("DurationSec")).select("FlightID", "DurationSec"), q)
    _p("filter_bool_flag", with_views("SELECT PilotID FROM pilots WHERE Qualified4LongFlights"),
       lambda t: t.pilots.filter(F.col("Qualified4LongFlights")).select("PilotID"), q)
    _p("filter_month", with_views("""
SELECT FlightID, TakeOffTime FROM flights
WHERE TakeOffTime > TIMESTAMP '1998-11-30 23:59:59' AND TakeOffTime < TIMESTAMP '1999-01-01 00:00:00'"""),
       lambda t: t.flights.filter(P.in_month("TakeOffTime", "1998-12")).select("FlightID", "TakeOffTime"), q)
    _p("filter_from_day", with_views(
        "SELECT FlightID, TakeOffTime FROM flights WHERE TakeOffTime > TIMESTAMP '2001-06-30 23:59:00'"),
       lambda t: t.flights.filter(P.from_day("TakeOffTime", dt.date(2001, 7, 1))).select("FlightID", "TakeOffTime"), q)
    _p("status_group", with_views("""
SELECT CustomerKind, OrderID, CASE WHEN OrderStatus = 'Active' THEN 'active'
       WHEN OrderStatus LIKE '%Cancelled%' THEN 'cancelled' ELSE 'other' END AS StatusGroup FROM orders_v"""),
       lambda t: t.orders.select("CustomerKind", "OrderID", P.status_group().alias("StatusGroup")), q)

    # ---- §2.3 joins ------------------------------------------------------------------
    _p("join_inner", with_views("""
SELECT o.OrderID, o.CustomerKind, o.FlightID, f.TakeOffTime FROM orders_v o JOIN flights f ON o.FlightID = f.FlightID"""),
       lambda t: R.join_on(t.orders.select("OrderID", "CustomerKind", "FlightID"),
                           t.flights.select("FlightID", "TakeOffTime"), ["FlightID"]), q)
    _p("join_left", with_views("""
SELECT f.FlightID, o.n FROM flights f
LEFT JOIN (SELECT FlightID, COUNT(*) AS n FROM orders_v GROUP BY FlightID) o ON f.FlightID = o.FlightID"""),
       lambda t: R.join_on(t.flights.select("FlightID"),
                           t.orders.groupBy("FlightID").agg(F.count(F.lit(1)).alias("n")), ["FlightID"], "left"), q)

    def _join_right(t, spark, sf_dir):
        o = read_driver(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        c = read_driver(spark, sf_dir, "customer").select("c_custkey")
        return o.join(c, "c_custkey", "right").select("c_custkey", "o_orderkey")
    SQL["join_right"] = ("SELECT c.c_custkey, o.o_orderkey FROM orders o "
                         "RIGHT JOIN customer c ON o.o_custkey = c.c_custkey")
    register_batch("join_right", _join_right)

    _p("join_multi", with_views("""
SELECT o.OrderID, o.CustomerKind, pl.Manufacturer, f.TakeOffTime, p.Price
FROM orders_v o JOIN flights f ON o.FlightID = f.FlightID JOIN planes pl ON o.PlainID = pl.PlainID
JOIN prices p ON o.FlightID = p.FlightID AND o.ClassType = p.ClassType AND o.PlainID = p.PlainID"""),
       lambda t: t.orders.join(t.flights.select("FlightID", "TakeOffTime"), "FlightID")
       .join(t.planes.select("PlainID", "Manufacturer"), "PlainID")
       .join(t.prices, ["FlightID", "ClassType", "PlainID"])
       .select("OrderID", "CustomerKind", "Manufacturer", "TakeOffTime", "Price"), q)
    _p("join_left_with_on_filter", with_views("""
SELECT FlightID, (SELECT arg_min(pair, (-n, pair)) FROM (
    SELECT concat(g.SourceField, ' - ', g.DestinationField) AS pair, count(*) AS n FROM flights g
    WHERE g.IsDeleted = FALSE AND g.PlainID = f.PlainID
      AND date_trunc('month', g.TakeOffTime) = date_trunc('month', f.TakeOffTime) GROUP BY ALL) flown) AS Dominant_Route
FROM flights f"""),
       lambda t: t.flights.select("FlightID", "PlainID", FS.month_text("TakeOffTime").alias("Activity_Month"))
       .join(reports.dominant_route(t), ["PlainID", "Activity_Month"], "left").select("FlightID", "Dominant_Route"), q)
    _p("anti_join", inv_sql("""
SELECT FlightID, ClassType, PlainID FROM prices EXCEPT SELECT FlightID, ClassType, PlainID FROM occ_seats"""),
       lambda t: R.anti_join(t.prices.select("FlightID", "ClassType", "PlainID"), inv.occupied_seats(t),
                             ["FlightID", "ClassType", "PlainID"]), q)
    _p("anti_join_unassigned", with_views("""
SELECT p.PilotID FROM pilots p WHERE NOT EXISTS (SELECT 1 FROM working_pilots w WHERE w.PilotID = p.PilotID)"""),
       lambda t: R.anti_join(t.pilots.select("PilotID"), t.working_pilots, ["PilotID"]), q)
    _p("semi_join_exists", with_views("""
SELECT f.FlightID FROM flights f WHERE EXISTS (SELECT 1 FROM orders_v o WHERE o.FlightID = f.FlightID)"""),
       lambda t: R.semi_join(t.flights.select("FlightID"), t.orders, ["FlightID"]), q)
    _p("correlated_extreme", inv_sql("""
SELECT a.PlainID, a.FlightID, a.LandingTime FROM flights_landing a
WHERE a.LandingTime = (SELECT MAX(b.LandingTime) FROM flights_landing b WHERE b.PlainID = a.PlainID)"""),
       lambda t: R.rows_at_extreme(inv.flights_with_landing(t), ["PlainID"], "LandingTime", "max")
       .select("PlainID", "FlightID", "LandingTime"), q)
    _p("join_back_dim", with_views("""
SELECT p.* FROM pilots p WHERE NOT EXISTS (SELECT 1 FROM working_pilots w WHERE w.PilotID = p.PilotID)"""),
       lambda t: R.join_back(R.anti_join(t.pilots.select("PilotID"), t.working_pilots, ["PilotID"]), t.pilots,
                             "PilotID"), q)

    from skyledger.plans.oracle_sql import asg as asg_sql
    _p("semi_join_selected", asg_sql("""
SELECT a.CandidateID, p.* FROM assign_pilots a JOIN pilots p ON a.PilotID = p.PilotID
WHERE a.PilotID IN (SELECT PilotID FROM pilots WHERE Qualified4LongFlights)"""),
       # the chosen list: pilots marked for long flights (a form selection in the source)
       lambda t: R.semi_join(assign.available_pilots(t),
                             t.pilots.filter(F.col("Qualified4LongFlights")), ["PilotID"]), q)

    # ---- §2.4 aggregations ---------------------------------------------------------------
    _p("group_by", with_views("SELECT FlightID, COUNT(*) AS n FROM orders_v GROUP BY FlightID"),
       lambda t: t.orders.groupBy("FlightID").agg(F.count(F.lit(1)).alias("n")), q)

    def _having(t, spark, sf_dir):
        li = read_driver(spark, sf_dir, "lineitem")
        return R.having(li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")), F.col("qty") > 150)
    SQL["having"] = "SELECT l_orderkey, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 150"
    register_batch("having", _having)

    _p("distinct_by_group", with_views("SELECT ClassType FROM cabins GROUP BY ClassType"),
       lambda t: t.cabins.select("ClassType").distinct(), q)
    _p("count_star", with_views("""
SELECT f.PlainID, COUNT(*) AS n_rows, COUNT(o.OrderID) AS n_orders
FROM flights f LEFT JOIN orders_v o ON f.FlightID = o.FlightID GROUP BY f.PlainID"""),
       lambda t: t.flights.select("FlightID", "PlainID").join(t.orders.select("FlightID", "OrderID"), "FlightID", "left")
       .groupBy("PlainID").agg(F.count(F.lit(1)).alias("n_rows"), F.count("OrderID").alias("n_orders")), q)
    _p("sum", with_views("SELECT FlightID, SUM(Price) AS TotalPrice FROM prices GROUP BY FlightID"),
       lambda t: t.prices.groupBy("FlightID").agg(F.sum("Price").alias("TotalPrice")), q)
    _p("sum_case", with_views("""
SELECT ClassType, CAST(SUM(CASE WHEN OrderStatus = 'Active' THEN 1 ELSE 0 END) AS BIGINT) AS active,
       CAST(SUM(CASE WHEN OrderStatus <> 'Active' THEN 1 ELSE 0 END) AS BIGINT) AS other FROM orders_v GROUP BY ClassType"""),
       lambda t: t.orders.groupBy("ClassType").agg(R.sum_when(F.col("OrderStatus") == S.ORDER_ACTIVE, 1).alias("active"),
                                                   R.sum_when(F.col("OrderStatus") != S.ORDER_ACTIVE, 1).alias("other")), q)
    _p("avg_ratio", inv_sql("""
SELECT PlainID, ROUND(AVG(COALESCE(OccupiedSeats, 0) / Capacity * 100), 2) AS AvgOccupancy FROM avail GROUP BY PlainID"""),
       lambda t: inv.available_seats(t).groupBy("PlainID").agg(
           F.round(F.avg(F.try_divide(F.coalesce("OccupiedSeats", F.lit(0)).cast("double"), F.col("Capacity")) * 100), 2)
           .alias("AvgOccupancy")), q)
    _p("min_max", with_views("""
SELECT PlainID, MIN(TakeOffTime) AS FirstTakeOff, MAX(TakeOffTime) AS LastTakeOff, MAX(FlightID) AS MaxFlight
FROM flights GROUP BY PlainID"""),
       lambda t: t.flights.groupBy("PlainID").agg(F.min("TakeOffTime").alias("FirstTakeOff"),
                                                  F.max("TakeOffTime").alias("LastTakeOff"),
                                                  F.max("FlightID").alias("MaxFlight")), q)
    _p("count_distinct_case", with_views("""
SELECT PlainID, COUNT(DISTINCT CASE WHEN NOT IsDeleted THEN CAST(TakeOffTime AS DATE) END) AS ActiveDays
FROM flights GROUP BY PlainID"""),
       lambda t: t.flights.groupBy("PlainID").agg(
           F.count_distinct(F.when(~F.col("IsDeleted"), FS.day_of("TakeOffTime"))).alias("ActiveDays")), q)
    _p("string_agg", with_views("""
SELECT SourceField, string_agg(DestinationField, ',' ORDER BY DestinationField) AS Destinations
FROM routes GROUP BY SourceField"""),
       lambda t: t.routes.groupBy("SourceField").agg(R.string_agg("DestinationField").alias("Destinations")), q)
    _p("global_agg", with_views("""
SELECT COUNT(*) AS n_orders, COUNT(DISTINCT Email) AS n_emails,
       CAST(COALESCE(SUM(CASE WHEN OrderStatus = 'Active' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_active FROM orders_v"""),
       lambda t: t.orders.agg(F.count(F.lit(1)).alias("n_orders"), F.count_distinct("Email").alias("n_emails"),
                              F.coalesce(R.sum_when(F.col("OrderStatus") == S.ORDER_ACTIVE, 1), F.lit(0))
                              .alias("n_active")), q)
    _p("bool_and", with_views("""
SELECT FlightID, COALESCE(bool_and(OrderStatus = 'Active'), TRUE) AS AllActive FROM orders_v GROUP BY FlightID"""),
       lambda t: t.orders.groupBy("FlightID").agg(R.all_true(F.col("OrderStatus") == S.ORDER_ACTIVE).alias("AllActive")), q)
    _p("result_count", inv_sql("SELECT COUNT(*) AS n FROM search"),
       lambda t: inv.flight_search(t, AS_OF, sort=False).agg(F.count(F.lit(1)).alias("n")), q)

    # ---- §2.5 windows -------------------------------------------------------------------------
    _p("latest_leg", inv_sql("""
SELECT W.PilotID AS ResourceID, FT.FlightID, FT.LandingTime
FROM working_pilots W JOIN pilots P ON P.PilotID = W.PilotID JOIN flights_landing FT ON W.FlightID = FT.FlightID
WHERE FT.LandingTime = (SELECT MAX(F2.LandingTime) FROM working_pilots W2
                        JOIN flights_landing F2 ON W2.FlightID = F2.FlightID WHERE W2.PilotID = W.PilotID)"""),
       lambda t: R.rows_at_extreme(assign.resource_legs(t, "pilots"), ["ResourceID"], "LandingTime", "max")
       .select("ResourceID", "FlightID", "LandingTime"), q)
    _p("earliest_leg", inv_sql("""
SELECT FT.PlainID AS ResourceID, FT.FlightID, FT.TakeOffTime
FROM flights_landing FT JOIN planes P ON P.PlainID = FT.PlainID
WHERE FT.TakeOffTime = (SELECT MIN(F2.TakeOffTime) FROM flights_landing F2 WHERE F2.PlainID = FT.PlainID)"""),
       lambda t: R.rows_at_extreme(assign.resource_legs(t, "planes"), ["ResourceID"], "TakeOffTime", "min")
       .select("ResourceID", "FlightID", "TakeOffTime"), q)

    def _ids(t, spark, sf_dir):
        batch = read_driver(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Seq"))
        start = t.flights.agg(F.coalesce(F.max("FlightID"), F.lit(0)).cast("long")).scalar()
        return R.allocate_ids(batch, "Seq", start, "NewID")
    SQL["id_allocator"] = with_views("""
SELECT o_orderkey AS Seq, (SELECT COALESCE(MAX(FlightID), 0) FROM flights) + ROW_NUMBER() OVER (ORDER BY o_orderkey)
       AS NewID FROM orders""")
    register_batch("id_allocator", _ids)

    def _wide_ids(t, spark, sf_dir):
        batch = read_driver(spark, sf_dir, "orders")
        start = t.flights.agg(F.coalesce(F.max("FlightID"), F.lit(0)).cast("long")).scalar()
        return R.allocate_ids(batch, "o_orderkey", start, "NewID", F.col("o_orderstatus") != "P")
    SQL["id_allocator_wide"] = with_views("""
SELECT o.*, n.NewID FROM orders o LEFT JOIN (
  SELECT o_orderkey, (SELECT COALESCE(MAX(FlightID), 0) FROM flights) + ROW_NUMBER() OVER (ORDER BY o_orderkey) AS NewID
  FROM orders WHERE o_orderstatus <> 'P') n USING (o_orderkey)""")
    register_batch("id_allocator_wide", _wide_ids)
    _p("rewrite_delete", with_views("SELECT * FROM orders_v WHERE OrderStatus <> 'System_Cancelled'"),
       lambda t: R.rewrite_delete(t.orders, F.col("OrderStatus") == S.ORDER_SYSTEM_CANCELLED), q)
    _p("text_functions", with_views("""
SELECT PilotID, concat(FirstName, ' ', LastName) AS FullName, len(string_split(LastName, '#')) AS NameParts,
       'Supplier' AS FirstPart, FlightID, strftime(TakeOffTime, '%d/%m/%Y %H:%M') AS FromSeconds,
       strftime(TakeOffTime, '%d/%m/%Y %H:%M') AS FromMinutes, strftime(TakeOffTime, '%d/%m/%Y 00:00') AS FromDay,
       'not a date' AS PassedThrough, date_trunc('second', TakeOffTime) AS WholeSecond
FROM working_pilots JOIN pilots USING (PilotID) JOIN flights USING (FlightID)"""), _texts, q)

    # ---- §2.6 ordering --------------------------------------------------------------------------
    _p("order_by", with_views("SELECT * FROM routes ORDER BY DurationSec DESC, SourceField, DestinationField"),
       lambda t: R.order_by(t.routes, ["DurationSec", "SourceField", "DestinationField"], [True, False, False]), q)
    _p("top_k", with_views("SELECT * FROM routes ORDER BY DurationSec DESC, SourceField, DestinationField LIMIT 10"),
       lambda t: R.top_k(t.routes, 10, [F.desc("DurationSec"), F.asc("SourceField"), F.asc("DestinationField")]), q)

    # ---- §2.7 set operations ------------------------------------------------------------------------
    _p("union_distinct", with_views("SELECT SourceField AS Field FROM routes UNION SELECT DestinationField FROM routes"),
       lambda t: R.union_distinct([t.routes.select(F.col("SourceField").alias("Field")),
                                   t.routes.select(F.col("DestinationField").alias("Field"))]), q)
    _p("union_all", with_views("""
SELECT OrderID, CustomerKind FROM orders_v WHERE CustomerKind = 'customer'
UNION ALL SELECT OrderID, CustomerKind FROM orders_v WHERE CustomerKind = 'guest'"""),
       lambda t: R.union_all([t.orders.filter(F.col("CustomerKind") == S.KIND_CUSTOMER).select("OrderID", "CustomerKind"),
                              t.orders.filter(F.col("CustomerKind") == S.KIND_GUEST).select("OrderID", "CustomerKind")]), q)

    # ---- §2.8 scalar functions (F1–F18) ---------------------------------------------------------------
    _p("scalar_functions", with_views(f"""
SELECT f.FlightID,
  f.TakeOffTime + to_seconds(CAST(r.DurationSec AS BIGINT)) AS LandingTime,
  strftime(f.TakeOffTime, '%Y-%m') AS MonthText,
  CAST(f.TakeOffTime AS DATE) AS TakeOffDay,
  ROUND(r.DurationSec / 3600.0, 2) AS Hours,
  COALESCE(bp.Price, 0.0) AS BusinessPriceOrZero,
  f.SourceField || ' - ' || f.DestinationField AS RoutePair,
  FALSE AS Flag,
  TRY_CAST(split_part(CAST(f.FlightID % 7 + 1 AS VARCHAR) || '-' || CAST(f.FlightID % 3 + 1 AS VARCHAR), '-', 1) AS INTEGER) AS SeatLine,
  TRY_CAST(split_part(CAST(f.FlightID % 7 + 1 AS VARCHAR) || '-' || CAST(f.FlightID % 3 + 1 AS VARCHAR), '-', 2) AS INTEGER) AS SeatCol,
  strptime(strftime(f.TakeOffTime, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AS Reparsed,
  strftime(f.TakeOffTime, '%d/%m/%Y %H:%M') AS Formatted,
  CAST(dayofmonth(last_day(f.TakeOffTime)) AS INTEGER) AS DaysInMonth,
  printf('%.2f', r.DurationSec / 3600.0) AS HoursText,
  upper(substr(f.SourceField, 1, 1)) || lower(substr(f.SourceField, 2)) AS Capitalized,
  CASE WHEN (r.DurationSec // 60) % 100 > 70 THEN 'success' WHEN (r.DurationSec // 60) % 100 > 40 THEN 'warning'
       ELSE 'danger' END AS Band,
  date_trunc('day', f.TakeOffTime) AS TakeOffMidnight,
  date_diff('second', {A}, f.TakeOffTime) AS SecondsUntil
FROM flights f JOIN routes r ON f.SourceField = r.SourceField AND f.DestinationField = r.DestinationField
LEFT JOIN prices bp ON bp.FlightID = f.FlightID AND bp.ClassType = 'Business'"""), _scalars, q)

    for name, fn in q.items():
        register(name)(fn)


def _scalars(t):
    token = F.concat((F.col("FlightID") % 7 + 1).cast("string"), F.lit("-"), (F.col("FlightID") % 3 + 1).cast("string"))
    bp = t.prices.filter(F.col("ClassType") == S.CLASS_BUSINESS).select("FlightID", F.col("Price").alias("bp"))
    return (t.flights.join(t.routes, ["SourceField", "DestinationField"])
            .join(bp, "FlightID", "left")
            .select("FlightID",
                    FS.add_seconds("TakeOffTime", "DurationSec").alias("LandingTime"),
                    FS.month_text("TakeOffTime").alias("MonthText"),
                    FS.day_of("TakeOffTime").alias("TakeOffDay"),
                    FS.round2(FS.hours_of("DurationSec")).alias("Hours"),
                    FS.ifnull("bp", 0.0).alias("BusinessPriceOrZero"),
                    FS.route_pair().alias("RoutePair"),
                    FS.binary_flag(False).alias("Flag"),
                    FS.seat_token_line(token).alias("SeatLine"),
                    FS.seat_token_col(token).alias("SeatCol"),
                    FS.parse_datetime(FS.format_datetime("TakeOffTime", "yyyy-MM-dd HH:mm")).alias("Reparsed"),
                    FS.format_datetime("TakeOffTime", "dd/MM/yyyy HH:mm").alias("Formatted"),
                    FS.days_in_month("TakeOffTime").alias("DaysInMonth"),
                    FS.format_number(FS.hours_of("DurationSec")).alias("HoursText"),
                    FS.capitalize("SourceField").alias("Capitalized"),
                    FS.utilisation_band(F.expr("DurationSec div 60") % 100).alias("Band"),
                    FS.trunc_day("TakeOffTime").alias("TakeOffMidnight"),
                    FS.seconds_until("TakeOffTime", AS_OF).alias("SecondsUntil")))


def _texts(t):
    at = lambda fmt: FS.format_datetime(F.date_format("TakeOffTime", fmt), "dd/MM/yyyy HH:mm")
    parts = FS.split_list("LastName", "#")
    return (t.working_pilots.join(t.pilots, "PilotID").join(t.flights, "FlightID")
            .select("PilotID", FS.full_name().alias("FullName"), F.size(parts).cast("long").alias("NameParts"),
                    F.element_at(parts, 1).alias("FirstPart"), "FlightID", at("yyyy-MM-dd HH:mm:ss").alias("FromSeconds"),
                    at("yyyy-MM-dd HH:mm").alias("FromMinutes"), at("yyyy-MM-dd").alias("FromDay"),
                    FS.format_datetime(F.lit("not a date"), "dd/MM/yyyy HH:mm").alias("PassedThrough"),
                    FS.trunc_second(F.expr("TakeOffTime + INTERVAL '0.25' SECOND")).alias("WholeSecond")))
