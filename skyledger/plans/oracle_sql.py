"""Independent SQL formulations (DuckDB dialect) of the domain operators.

Written from the described semantics, not from the Spark code: NOT EXISTS
instead of anti joins, correlated MIN/MAX instead of extremes by aggregation,
counts over a left join instead of unions, filtered aggregates instead of CASE
sums, a recursive walk instead of rounds.
``INV_CTES`` are shared building blocks appended after the view CTEs.
"""

from __future__ import annotations

import re

from skyledger.plans.oracle_views import AS_OF_SQL, with_views

A = AS_OF_SQL

INV_CTES = f"""
live AS (SELECT * FROM orders_v WHERE OrderStatus IN ('Active', 'Complete')),
occ_seats AS (
  SELECT Line, SeatLetter, OrderID, CustomerKind, OrderStatus, OrderDate, Email, PlainID, ClassType, FlightID
  FROM seats JOIN live USING (CustomerKind, OrderID)),
sold_cabin AS (
  SELECT FlightID, ClassType, PlainID FROM prices
  UNION
  SELECT FlightID, ClassType, PlainID FROM occ_seats),
occ_count AS (
  SELECT k.FlightID, k.ClassType, k.PlainID, count(x.Line) AS OccupiedSeats
  FROM sold_cabin k LEFT JOIN occ_seats x
    ON (x.FlightID, x.ClassType, x.PlainID) = (k.FlightID, k.ClassType, k.PlainID)
  GROUP BY k.FlightID, k.ClassType, k.PlainID),
capacity AS (
  SELECT f.FlightID, f.PlainID, c.ClassType, c.NumberRows * c.NumberCols AS Capacity
  FROM flights f JOIN cabins c ON f.PlainID = c.PlainID),
avail AS (
  SELECT os.FlightID, os.PlainID, os.ClassType, cs.Capacity, os.OccupiedSeats,
         cs.Capacity - os.OccupiedSeats AS AvailableSeats
  FROM occ_count os JOIN capacity cs
    ON os.FlightID = cs.FlightID AND os.PlainID = cs.PlainID AND os.ClassType = cs.ClassType),
acp AS (
  SELECT a.FlightID, a.ClassType, p.Price FROM avail a
  JOIN prices p ON a.FlightID = p.FlightID AND a.ClassType = p.ClassType
  WHERE a.AvailableSeats >= 0),
price_pivot AS (
  SELECT t.FlightID, b.Price AS Business_price, r.Price AS Regular_price
  FROM (SELECT FlightID FROM acp GROUP BY FlightID) t
  LEFT JOIN acp b ON b.FlightID = t.FlightID AND b.ClassType = 'Business'
  LEFT JOIN acp r ON r.FlightID = t.FlightID AND r.ClassType = 'Regular'),
flights_landing AS (
  SELECT f.*, f.TakeOffTime + to_seconds(CAST(r.DurationSec AS BIGINT)) AS LandingTime
  FROM flights f JOIN routes r ON f.SourceField = r.SourceField AND f.DestinationField = r.DestinationField),
seats_left AS (SELECT FlightID, sum(AvailableSeats) AS n FROM avail GROUP BY FlightID),
fstatus AS (
  SELECT l.FlightID, CASE
           WHEN f.IsDeleted THEN 'Deleted'
           WHEN f.FlightID IS NULL OR l.n < 0 THEN 'Active'
           WHEN l.n = 0 THEN 'Full Capacity'
           ELSE if(f.TakeOffTime > {A}, 'Active', 'Complete') END AS FlightStatus
  FROM seats_left l LEFT JOIN flights f USING (FlightID)),
search AS (
  SELECT f.FlightID, f.SourceField, f.DestinationField, f.TakeOffTime, f.PlainID, st.FlightStatus,
         pp.Business_price, pp.Regular_price, cap.TotalSeats, bk.BookedSeats
  FROM flights f
  JOIN fstatus st ON st.FlightID = f.FlightID
  JOIN price_pivot pp ON pp.FlightID = f.FlightID
  JOIN (SELECT FlightID, CAST(sum(Capacity) AS BIGINT) AS TotalSeats FROM capacity GROUP BY FlightID) cap ON cap.FlightID = f.FlightID
  JOIN (SELECT FlightID, CAST(sum(OccupiedSeats) AS BIGINT) AS BookedSeats FROM occ_count GROUP BY FlightID) bk ON bk.FlightID = f.FlightID)
"""


def inv(body: str, extra: str = "") -> str:
    ctes = INV_CTES.strip()
    if extra.strip():
        ctes += ",\n" + extra.strip()
    return with_views(body, ctes)


SQL: dict[str, str] = {}

SQL["occupied_seats"] = inv("SELECT * FROM occ_seats")
SQL["occupied_count"] = inv("SELECT * FROM occ_count")
SQL["flight_capacity"] = inv("SELECT * FROM capacity")
SQL["available_seats"] = inv("SELECT * FROM avail")
SQL["available_class_prices"] = inv("SELECT * FROM acp")
SQL["class_price_pivot"] = inv("SELECT * FROM price_pivot")
SQL["flights_with_landing"] = inv("SELECT * FROM flights_landing")
SQL["flight_status"] = inv("SELECT * FROM fstatus")
SQL["flight_search"] = inv("SELECT * FROM search")

# ---- reports (R1–R7) ----------------------------------------------------------
_R1 = f"""
SELECT round(avg(coalesce(flown.n, 0) / room.n * 100), 2) AS Average_Occupancy_Percent
FROM (SELECT PlainID, sum(NumberRows * NumberCols) AS n FROM cabins GROUP BY ALL) room
JOIN (SELECT FlightID, PlainID FROM flights WHERE IsDeleted = FALSE AND TakeOffTime <= {A}) done USING (PlainID)
LEFT JOIN (SELECT FlightID, count(*) FILTER (OrderStatus = 'Complete') AS n FROM orders_v GROUP BY ALL) flown
  USING (FlightID)"""
SQL["report_average_occupancy"] = with_views(_R1)
SQL["report_occupancy_split"] = with_views(
    f"SELECT COALESCE(Average_Occupancy_Percent, 0.0) AS Occupied_Percent, "
    f"ROUND(100.0 - COALESCE(Average_Occupancy_Percent, 0.0), 2) AS Free_Percent FROM ({_R1}) r1")

_R2 = f"""
SELECT Manufacturer, Size, round(sum(earned) FILTER (ClassType = 'Regular'), 2) AS Regular_Safe_Revenue,
       round(coalesce(sum(earned) FILTER (ClassType = 'Business'), 0), 2) AS Business_Safe_Revenue,
       round(sum(earned), 2) AS Total_Safe_Revenue
FROM (SELECT cabin.PlainID, cabin.ClassType, (cabin.kept + 0.05 * cabin.fee) * prices.Price AS earned
      FROM (SELECT FlightID, ClassType, PlainID, count(*) FILTER (OrderStatus IN ('Active', 'Complete')) AS kept,
                   count(*) FILTER (OrderStatus = 'Customer_Cancelled') AS fee
            FROM orders_v WHERE OrderStatus <> 'System_Cancelled' GROUP BY ALL) cabin
      JOIN prices USING (FlightID, ClassType, PlainID)
      WHERE cabin.FlightID IN (SELECT FlightID FROM flights
                               WHERE IsDeleted = FALSE AND TakeOffTime - INTERVAL 36 HOUR <= {A})) money
JOIN planes USING (PlainID)
GROUP BY ALL"""
SQL["report_revenue_breakdown"] = with_views(_R2 + "\nORDER BY Total_Safe_Revenue DESC")
SQL["report_business_share"] = with_views(
    f"SELECT Manufacturer, Size, ROUND(CASE WHEN Total_Safe_Revenue > 0 THEN "
    f"Business_Safe_Revenue / Total_Safe_Revenue * 100 ELSE 0 END, 2) AS Business_Share_Percent FROM ({_R2}) r2")

_R3 = f"""
SELECT Role, EmployeeID, FirstName, LastName,
       round(coalesce(sum(sec) FILTER (sec <= 21600), 0) / 3600.0, 2) AS Short_Flight_Hours,
       round(coalesce(sum(sec) FILTER (sec > 21600), 0) / 3600.0, 2) AS Long_Flight_Hours,
       round(sum(sec) / 3600.0, 2) AS Total_Hours
FROM (SELECT FlightID, DurationSec AS sec FROM routes JOIN flights USING (SourceField, DestinationField)
      WHERE IsDeleted = FALSE AND TakeOffTime <= {A}) leg
JOIN (SELECT FlightID, PilotID AS EmployeeID, 'Pilot' AS Role FROM working_pilots
      UNION ALL BY NAME
      SELECT FlightID, AttendantID AS EmployeeID, 'Flight Attendant' AS Role FROM working_attendants) shift
  USING (FlightID)
JOIN (SELECT PilotID AS EmployeeID, 'Pilot' AS Role, FirstName, LastName FROM pilots
      UNION ALL BY NAME
      SELECT AttendantID AS EmployeeID, 'Flight Attendant' AS Role, FirstName, LastName FROM attendants) person
  USING (EmployeeID, Role)
GROUP BY ALL"""
SQL["report_employee_hours"] = with_views(_R3 + "\nORDER BY Total_Hours DESC, Role, EmployeeID")
SQL["report_top_employees"] = with_views(_R3 + "\nORDER BY Total_Hours DESC, Role, EmployeeID LIMIT 20")

_R4 = """
SELECT strftime(OrderDate, '%Y-%m') AS Order_Month, count(*) AS Total_Orders,
       count(*) FILTER (OrderStatus = 'Customer_Cancelled') AS Cancelled_Orders,
       round(avg(if(OrderStatus = 'Customer_Cancelled', 100.0, 0.0)::DOUBLE), 2) AS Cancellation_Rate_Percent
FROM orders_v GROUP BY ALL"""
SQL["report_cancellation_rate"] = with_views(_R4 + "\nORDER BY Order_Month")
SQL["report_rate_bands"] = with_views(
    f"SELECT *, CASE WHEN Cancellation_Rate_Percent < 5 THEN 'success' "
    f"WHEN Cancellation_Rate_Percent < 15 THEN 'warning' ELSE 'danger' END AS Rate_Band FROM ({_R4}) r4")

# The busiest route of a plane and month: the first by name among those flown most often.
_ROUTE_OF_MONTH = """
SELECT PlainID, m, min(pair) AS pair FROM (
  SELECT PlainID, m, pair, n, max(n) OVER (PARTITION BY PlainID, m) AS most FROM (
    SELECT PlainID, strftime(TakeOffTime, '%Y-%m') AS m, concat(SourceField, ' - ', DestinationField) AS pair,
           count(*) AS n FROM flights WHERE IsDeleted = FALSE GROUP BY ALL) per_pair) rated
WHERE n = most GROUP BY ALL"""
_R5 = f"""
SELECT Manufacturer, act.PlainID, act.m AS Activity_Month, act.flown AS Executed_Flights,
       act.gone AS Cancelled_Flights, round(act.days / 30.0 * 100, 2) AS Utilization_Percent, top.pair AS Dominant_Route
FROM (SELECT PlainID, strftime(TakeOffTime, '%Y-%m') AS m, count(*) FILTER (IsDeleted = FALSE) AS flown,
             count(*) FILTER (IsDeleted) AS gone,
             count(DISTINCT TakeOffTime::DATE) FILTER (IsDeleted = FALSE) AS days
      FROM flights GROUP BY ALL) act
JOIN planes ON planes.PlainID = act.PlainID
LEFT JOIN ({_ROUTE_OF_MONTH}) top ON (top.PlainID, top.m) = (act.PlainID, act.m)"""
SQL["report_plane_activity"] = with_views("SELECT * FROM (" + _R5 + ") r5 ORDER BY PlainID, Activity_Month")
SQL["report_utilization_bands"] = with_views(
    "SELECT *, CASE WHEN Utilization_Percent > 70 THEN 'success' WHEN Utilization_Percent > 40 THEN 'warning' "
    "ELSE 'danger' END AS Utilization_Band FROM (" + _R5 + ") r5")
SQL["dominant_route"] = with_views(
    f"SELECT PlainID, m AS Activity_Month, pair AS Dominant_Route FROM ({_ROUTE_OF_MONTH}) best")

SQL["report_cancellation_rate_months"] = with_views(
    f"SELECT * FROM ({_R4}) r4 WHERE Order_Month BETWEEN '1996-07' AND '1997-06'")
SQL["report_plane_activity_months"] = with_views(
    f"SELECT * FROM ({_R5}) r5 WHERE Activity_Month IN "
    f"(SELECT Order_Month FROM ({_R4}) r4 WHERE Cancellation_Rate_Percent >= 27)")

SQL["report_summary"] = with_views("""
SELECT * FROM (SELECT count(*) FILTER (IsDeleted = FALSE) AS total_flights FROM flights),
     (SELECT count(*) FILTER (OrderStatus = 'Active') AS active_orders FROM orders_v),
     (SELECT round(coalesce(sum(Price * if(OrderStatus = 'Customer_Cancelled', 0.05, 1)), 0), 2) AS total_revenue
      FROM prices JOIN orders_v USING (FlightID, ClassType, PlainID) WHERE OrderStatus <> 'System_Cancelled'),
     (SELECT count(*) AS fleet_size FROM planes)""")

# ---- assignability (D12–D17) ----------------------------------------------------
def _legs_cte(kind: str) -> str:
    if kind == "planes":
        return ("SELECT FT.PlainID AS ResourceID, (P.Size = 'Large') AS Q, FT.FlightID, FT.SourceField, "
                "FT.DestinationField, FT.TakeOffTime, FT.LandingTime "
                "FROM flights_landing FT JOIN planes P ON FT.PlainID = P.PlainID")
    rid, dim, shifts = {"pilots": ("PilotID", "pilots", "working_pilots"),
                        "attendants": ("AttendantID", "attendants", "working_attendants")}[kind]
    return (f"SELECT W.{rid} AS ResourceID, D.Qualified4LongFlights AS Q, FT.FlightID, FT.SourceField, "
            f"FT.DestinationField, FT.TakeOffTime, FT.LandingTime "
            f"FROM {dim} D JOIN {shifts} W ON D.{rid} = W.{rid} JOIN flights_landing FT ON W.FlightID = FT.FlightID")


def _assign_ctes(kind: str) -> str:
    rid, dim, shifts = {"planes": ("PlainID", "planes", "flights"),
                        "pilots": ("PilotID", "pilots", "working_pilots"),
                        "attendants": ("AttendantID", "attendants", "working_attendants")}[kind]
    q = "(D.Size = 'Large')" if kind == "planes" else "D.Qualified4LongFlights"
    return f"""
legs_{kind} AS ({_legs_cte(kind)}),
ab_{kind} AS (
  SELECT c.CandidateID, b.ResourceID FROM candidates c JOIN legs_{kind} b
    ON (b.Q OR NOT c.IsLong) AND b.TakeOffTime > c.LandingTime AND b.SourceField = c.DestinationField
   AND b.TakeOffTime = (SELECT MIN(m.TakeOffTime) FROM legs_{kind} m WHERE m.ResourceID = b.ResourceID)
  UNION
  SELECT c.CandidateID, a.ResourceID FROM candidates c JOIN legs_{kind} a
    ON (a.Q OR NOT c.IsLong) AND a.LandingTime < c.TakeOffTime AND a.DestinationField = c.SourceField
   AND a.LandingTime = (SELECT MAX(m.LandingTime) FROM legs_{kind} m WHERE m.ResourceID = a.ResourceID)),
nofl_{kind} AS (
  SELECT c.CandidateID, D.{rid} AS ResourceID FROM candidates c JOIN {dim} D ON ({q} OR NOT c.IsLong)
  WHERE NOT EXISTS (SELECT 1 FROM {shifts} s WHERE s.{rid} = D.{rid})),
assign_{kind} AS (
  SELECT CandidateID, ResourceID AS {rid} FROM ab_{kind}
  UNION
  SELECT CandidateID, ResourceID AS {rid} FROM nofl_{kind})"""


ASSIGN_CTES = ",".join(_assign_ctes(k).strip().rstrip(",") for k in ("planes", "pilots", "attendants"))


def asg(body: str) -> str:
    return inv(body, ASSIGN_CTES)


SQL["assignable_planes"] = asg("SELECT * FROM assign_planes")
SQL["assignable_pilots"] = asg("SELECT * FROM assign_pilots")
SQL["assignable_attendants"] = asg("SELECT * FROM assign_attendants")
SQL["available_planes"] = asg(
    "SELECT a.CandidateID, a.PlainID, p.Size FROM assign_planes a JOIN planes p ON a.PlainID = p.PlainID")
SQL["available_pilots"] = asg("SELECT a.CandidateID, p.* FROM assign_pilots a JOIN pilots p ON a.PilotID = p.PilotID")
SQL["available_attendants"] = asg(
    "SELECT a.CandidateID, p.* FROM assign_attendants a JOIN attendants p ON a.AttendantID = p.AttendantID")
SQL["staffing_feasibility"] = asg("""
SELECT c.CandidateID, c.IsLong, x.AvailablePlanes, x.AllPlanesLarge, x.AvailablePilots, x.AvailableAttendants,
       x.RequiredPilots, x.RequiredAttendants,
       (x.AvailablePlanes >= 1 AND x.AvailablePilots >= x.RequiredPilots
        AND x.AvailableAttendants >= x.RequiredAttendants) AS Feasible
FROM candidates c JOIN (
  SELECT c.CandidateID,
    (SELECT COUNT(*) FROM assign_planes a WHERE a.CandidateID = c.CandidateID) AS AvailablePlanes,
    (SELECT COUNT(*) FROM assign_pilots a WHERE a.CandidateID = c.CandidateID) AS AvailablePilots,
    (SELECT COUNT(*) FROM assign_attendants a WHERE a.CandidateID = c.CandidateID) AS AvailableAttendants,
    COALESCE((SELECT bool_and(p.Size = 'Large') FROM assign_planes a JOIN planes p ON a.PlainID = p.PlainID
              WHERE a.CandidateID = c.CandidateID), TRUE) AS AllPlanesLarge,
    CASE WHEN c.IsLong OR COALESCE((SELECT bool_and(p.Size = 'Large') FROM assign_planes a
              JOIN planes p ON a.PlainID = p.PlainID WHERE a.CandidateID = c.CandidateID), TRUE) THEN 3 ELSE 2 END
      AS RequiredPilots,
    CASE WHEN c.IsLong OR COALESCE((SELECT bool_and(p.Size = 'Large') FROM assign_planes a
              JOIN planes p ON a.PlainID = p.PlainID WHERE a.CandidateID = c.CandidateID), TRUE) THEN 6 ELSE 3 END
      AS RequiredAttendants
  FROM candidates c) x ON x.CandidateID = c.CandidateID""")

SQL["crew_requirement"] = with_views("""
SELECT f.FlightID, f.PlainID, p.Size,
       CASE WHEN p.Size = 'Large' THEN 3 ELSE 2 END AS RequiredPilots,
       CASE WHEN p.Size = 'Large' THEN 6 ELSE 3 END AS RequiredAttendants,
       (SELECT COUNT(*) FROM working_pilots w WHERE w.FlightID = f.FlightID) AS AssignedPilots,
       (SELECT COUNT(*) FROM working_attendants w WHERE w.FlightID = f.FlightID) AS AssignedAttendants,
       ((SELECT COUNT(*) FROM working_pilots w WHERE w.FlightID = f.FlightID) >= CASE WHEN p.Size = 'Large' THEN 3 ELSE 2 END
        AND (SELECT COUNT(*) FROM working_attendants w WHERE w.FlightID = f.FlightID) >= CASE WHEN p.Size = 'Large' THEN 6 ELSE 3 END)
        AS CrewComplete
FROM flights f JOIN planes p ON f.PlainID = p.PlainID""")

SQL["plane_size"] = with_views("""
SELECT PlainID, COUNT(DISTINCT CASE WHEN NumberRows > 0 AND NumberCols > 0 THEN ClassType END) AS NumClasses,
       CASE WHEN COUNT(DISTINCT CASE WHEN NumberRows > 0 AND NumberCols > 0 THEN ClassType END) = 2
            THEN 'Large' ELSE 'Small' END AS DerivedSize
FROM cabins GROUP BY PlainID""")

SQL["chain_continuity"] = with_views("""
SELECT FlightID, PlainID, TakeOffTime, SourceField, PrevDestination FROM (
  SELECT FlightID, PlainID, TakeOffTime, SourceField,
         LAG(DestinationField) OVER (PARTITION BY PlainID ORDER BY TakeOffTime, FlightID) AS PrevDestination
  FROM flights WHERE NOT IsDeleted) x
WHERE PrevDestination IS NOT NULL AND PrevDestination <> SourceField""")

SQL["missing_return_routes"] = with_views("""
SELECT r.* FROM routes r WHERE NOT EXISTS (
  SELECT 1 FROM routes b WHERE b.SourceField = r.DestinationField AND b.DestinationField = r.SourceField)""")

# ---- orders, pricing, lifecycle (D20–D29, J8) -------------------------------------
HIST_CTE = """
held AS (SELECT CustomerKind, OrderID, count(*) AS NumSeats FROM seats GROUP BY ALL),
hist AS (
  SELECT CustomerKind, Email, OrderID, FlightID, ClassType, NumSeats, OrderStatus, OrderDate,
         round(Price * NumSeats * CASE OrderStatus WHEN 'System_Cancelled' THEN 0
                                                   WHEN 'Customer_Cancelled' THEN 0.05 ELSE 1 END, 2) AS OrderPrice,
         SourceField, DestinationField, TakeOffTime, Price
  FROM flights JOIN prices USING (FlightID)
  JOIN (SELECT * EXCLUDE (PlainID) FROM orders_v) USING (FlightID, ClassType)
  JOIN held USING (CustomerKind, OrderID))"""

HIST_COLS = ("CustomerKind, Email, OrderID, FlightID, ClassType, NumSeats, OrderStatus, OrderDate, OrderPrice, "
             "SourceField, DestinationField, TakeOffTime")
ORDER_COLS = "OrderID, CustomerKind, OrderStatus, OrderDate, Email, PlainID, ClassType, FlightID"


def hist(body: str) -> str:
    return inv(body, HIST_CTE)


SQL["quote_price"] = with_views("""
SELECT o.CustomerKind, o.OrderID, o.FlightID, o.ClassType, sp.NumSeats, p.Price, p.Price * sp.NumSeats AS TotalPrice
FROM orders_v o
JOIN (SELECT CustomerKind, OrderID, COUNT(*) AS NumSeats FROM seats GROUP BY CustomerKind, OrderID) sp
  ON o.CustomerKind = sp.CustomerKind AND o.OrderID = sp.OrderID
JOIN prices p ON p.FlightID = o.FlightID AND p.ClassType = o.ClassType""")
SQL["order_history"] = hist(f"SELECT {HIST_COLS} FROM hist ORDER BY OrderID DESC")
SQL["order_lookup"] = hist(f"""
SELECT r.OrderID, r.Email, h.CustomerKind, h.FlightID, h.ClassType, h.NumSeats, h.OrderStatus, h.OrderDate,
       h.OrderPrice, h.SourceField, h.DestinationField, h.TakeOffTime
FROM orders_v r LEFT JOIN hist h ON r.OrderID = h.OrderID AND r.Email = h.Email""")
SQL["order_cancellable"] = hist(f"""
SELECT CustomerKind, OrderID, Email, OrderStatus, TakeOffTime,
       TakeOffTime > {A} + INTERVAL 36 HOUR AS CanCancel,
       TakeOffTime > {A} + INTERVAL 36 HOUR AND OrderStatus NOT IN ('System_Cancelled', 'Customer_Cancelled')
         AS DetailCancellable,
       TakeOffTime > {A} + INTERVAL 36 HOUR AND OrderStatus = 'Active' AS ListCancellable
FROM hist""")
SQL["flight_cancellable"] = inv(f"""
SELECT FlightID, TakeOffTime, FlightStatus,
       (TakeOffTime > {A} + INTERVAL 72 HOUR AND FlightStatus <> 'Deleted') AS CanCancel FROM search""")
SQL["cancel_quote"] = hist("""
SELECT CustomerKind, OrderID, ROUND(NumSeats * Price, 2) AS BasePrice,
       ROUND(NumSeats * Price * 0.05, 2) AS CancellationFee, ROUND(NumSeats * Price * 0.95, 2) AS Refund
FROM hist""")
SQL["complete_orders"] = with_views(f"""
SELECT o.OrderID, o.CustomerKind,
       CASE WHEN f.TakeOffTime <= date_trunc('day', {A})
             AND o.OrderStatus <> 'Customer_Cancelled' AND o.OrderStatus <> 'System_Cancelled'
            THEN 'Complete' ELSE o.OrderStatus END AS OrderStatus,
       o.OrderDate, o.Email, o.PlainID, o.ClassType, o.FlightID
FROM orders_v o LEFT JOIN flights f ON o.FlightID = f.FlightID""")
SQL["cancel_orders"] = with_views(f"""
SELECT o.OrderID, o.CustomerKind,
       CASE WHEN EXISTS (SELECT 1 FROM orders_v r JOIN flights f ON r.FlightID = f.FlightID
                         WHERE r.CustomerKind = 'guest' AND r.OrderStatus = 'Active'
                           AND f.TakeOffTime > {A} + INTERVAL 36 HOUR
                           AND r.CustomerKind = o.CustomerKind AND r.OrderID = o.OrderID)
            THEN 'Customer_Cancelled' ELSE o.OrderStatus END AS OrderStatus,
       o.OrderDate, o.Email, o.PlainID, o.ClassType, o.FlightID
FROM orders_v o""")
_CANCEL_IDS = f"SELECT FlightID FROM search WHERE TakeOffTime > {A} + INTERVAL 72 HOUR AND FlightStatus <> 'Deleted'"
SQL["cancel_flights_flights"] = inv(f"""
SELECT f.FlightID, f.PlainID, f.TakeOffTime, f.SourceField, f.DestinationField,
       CASE WHEN f.FlightID IN ({_CANCEL_IDS}) THEN TRUE ELSE f.IsDeleted END AS IsDeleted
FROM flights f""")
SQL["cancel_flights_orders"] = inv(f"""
SELECT o.OrderID, o.CustomerKind,
       CASE WHEN o.FlightID IN ({_CANCEL_IDS}) THEN 'System_Cancelled' ELSE o.OrderStatus END AS OrderStatus,
       o.OrderDate, o.Email, o.PlainID, o.ClassType, o.FlightID
FROM orders_v o""")
SQL["customer_profile"] = with_views("""
SELECT c.*, COALESCE((SELECT string_agg(p.Phone, ',' ORDER BY p.Phone) FROM customer_phones p
                      WHERE p.Email = c.Email), '') AS Phones
FROM customers c""")
SQL["membership_flags"] = with_views("""
SELECT e.Email,
       EXISTS (SELECT 1 FROM customers c WHERE c.Email = e.Email) AS IsCustomer,
       EXISTS (SELECT 1 FROM guests g WHERE g.Email = e.Email) AS IsGuest,
       EXISTS (SELECT 1 FROM managers m WHERE m.Email = e.Email) AS IsManager
FROM (SELECT DISTINCT Email FROM orders_v) e""")
SQL["known_phones"] = with_views("""
SELECT p.Email, p.Phone,
       EXISTS (SELECT 1 FROM customer_phones c WHERE c.Email = p.Email AND c.Phone = p.Phone) AS Known
FROM (SELECT DISTINCT regexp_replace(Email, '^g', 'c') AS Email, trim(Phone) AS Phone FROM guest_phones) p""")

# ---- seat maps, field lists, category (D6, D10, D11) ---------------------------------
_SHAPE = """(SELECT p.FlightID, p.ClassType, c.NumberRows, c.NumberCols
   FROM prices p JOIN cabins c ON p.PlainID = c.PlainID AND p.ClassType = c.ClassType)"""
SQL["seat_map_long"] = inv(f"""
SELECT sh.FlightID, sh.ClassType, CAST(r.i AS INTEGER) AS Line, CAST(s.j AS INTEGER) AS SeatLetter,
       NOT EXISTS (SELECT 1 FROM occ_seats o WHERE o.FlightID = sh.FlightID AND o.ClassType = sh.ClassType
                   AND o.Line = r.i AND o.SeatLetter = s.j) AS IsFree
FROM {_SHAPE} sh,
     LATERAL (SELECT unnest(range(1, sh.NumberRows + 1)) AS i) r,
     LATERAL (SELECT unnest(range(1, sh.NumberCols + 1)) AS j) s""")
SQL["seat_map"] = inv(f"""
SELECT sh.FlightID, sh.ClassType, sh.NumberRows, sh.NumberCols,
       [[NOT list_contains(COALESCE(tk.taken, []), r * sh.NumberCols + c) for c in range(sh.NumberCols)]
        for r in range(sh.NumberRows)] AS Seats
FROM {_SHAPE} sh
LEFT JOIN (SELECT o.FlightID, o.ClassType, list(DISTINCT CAST((o.Line - 1) * c.NumberCols + o.SeatLetter - 1 AS BIGINT)) AS taken
           FROM occ_seats o JOIN cabins c ON o.PlainID = c.PlainID AND o.ClassType = c.ClassType
           GROUP BY o.FlightID, o.ClassType) tk
  ON tk.FlightID = sh.FlightID AND tk.ClassType = sh.ClassType""")
SQL["seat_bitmap"] = inv(f"""
SELECT sh.FlightID, sh.ClassType, sh.NumberRows, sh.NumberCols,
       [CAST(coalesce(list_sum([CASE WHEN x % 64 = 63 THEN -9223372036854775808::HUGEINT
                                     ELSE (1::HUGEINT << CAST(x % 64 AS INTEGER)) END
                                for x in coalesce(tk.taken, []) if x // 64 = w]), 0) AS BIGINT)
        for w in range(0, (sh.NumberRows * sh.NumberCols + 63) // 64)] AS Taken,
       CAST(sh.NumberRows * sh.NumberCols - coalesce(len(tk.taken), 0) AS BIGINT) AS FreeSeats
FROM {_SHAPE} sh
LEFT JOIN (SELECT o.FlightID, o.ClassType, list(DISTINCT CAST((o.Line - 1) * c.NumberCols + o.SeatLetter - 1 AS BIGINT)) AS taken
           FROM occ_seats o JOIN cabins c ON o.PlainID = c.PlainID AND o.ClassType = c.ClassType
           WHERE o.Line BETWEEN 1 AND c.NumberRows AND o.SeatLetter BETWEEN 1 AND c.NumberCols
           GROUP BY o.FlightID, o.ClassType) tk
  ON tk.FlightID = sh.FlightID AND tk.ClassType = sh.ClassType""")
SQL["fields_list"] = with_views("SELECT SourceField FROM routes GROUP BY SourceField")
SQL["fields_to"] = with_views("SELECT SourceField FROM routes WHERE DestinationField = 'NATION_7'")
SQL["destinations_list"] = with_views("SELECT DestinationField FROM routes GROUP BY DestinationField")
SQL["flight_category"] = with_views("""
SELECT f.*, CASE WHEN r.DurationSec > 21600 THEN 'Long' WHEN r.DurationSec IS NOT NULL THEN 'Short' END
         AS FlightCategory
FROM flights f LEFT JOIN routes r ON f.SourceField = r.SourceField AND f.DestinationField = r.DestinationField""")
SQL["scan_table"] = with_views("SELECT FlightID, TakeOffTime FROM flights")
SQL["scan_derived"] = inv(f"""
SELECT FlightID, LandingTime FROM flights_landing WHERE LandingTime > {A}""")

# ---- search with filters (P7, P10, P14, P15, Q7) ----------------------------------------
SQL["flight_search_filtered"] = inv(f"""
SELECT * FROM search
WHERE lower(SourceField) LIKE '%nation_1%'
  AND TakeOffTime > TIMESTAMP '1998-02-28 23:59:59' AND TakeOffTime < TIMESTAMP '1998-04-01 00:00:00'
  AND FlightStatus = 'Complete'""")
SQL["flight_search_by_month"] = SQL["flight_search_filtered"]
SQL["flight_search_from_day"] = inv(f"""
SELECT * FROM search
WHERE lower(DestinationField) LIKE '%nation_2%' AND TakeOffTime > TIMESTAMP '2001-06-30 23:59:00'""")

# ---- batch ingestion (I1–I11) ------------------------------------------------------------
BATCH_CTES = """
b_signup AS (
  SELECT o_orderkey AS Seq,
         (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'c' ELSE 'n' END) || CAST(o_custkey AS VARCHAR)
           || '@example.com' AS Email,
         'New' AS EngFirstName, 'Cust' || CAST(o_custkey AS VARCHAR) AS EngLastName,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 10000000 + o_custkey END AS PassportNumber,
         CAST(CAST(o_orderdate AS DATE) - 9000 AS DATE) AS Birthdate, CAST(o_orderdate AS DATE) AS SignUpDate,
         (o_orderstatus <> 'P') AS IsSignedUp
  FROM orders),
b_phone AS (
  SELECT o_orderkey AS Seq,
         (CASE WHEN o_orderstatus = 'O' THEN 'g' ELSE 'c' END) || CAST(o_custkey AS VARCHAR) || '@example.com' AS Email,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN '  '
              ELSE ' 05' || lpad(CAST(o_custkey * 10 + o_orderkey % 13 AS VARCHAR), 8, '0') || ' ' END AS Phone,
         (o_orderstatus <> 'O') AS IsSignedUp
  FROM orders),
b_order AS (
  SELECT o_orderkey AS Seq,
         (CASE WHEN o_orderkey % 3 = 0 THEN 'g' ELSE 'c' END) || CAST(o_custkey AS VARCHAR) || '@example.com' AS Email,
         (o_orderkey * 7 + 3) % (SELECT count(*) FROM orders) AS FlightID,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'Business' ELSE 'Regular' END AS ClassType
  FROM orders),
b_seat AS (
  SELECT o_orderkey AS Seq,
         CASE WHEN (1 + o_orderkey % 7) % 2 = 1 THEN 'customer' ELSE 'guest' END AS CustomerKind,
         o_orderkey * 10 + (1 + o_orderkey % 7) AS OrderID,
         CAST(1 + o_custkey % 3 AS VARCHAR) || '-' || CAST(1 + o_orderkey % 4 AS VARCHAR) AS SeatToken
  FROM orders),
b_plane AS (
  SELECT p_partkey AS Seq, p_partkey % ((SELECT count(*) FROM supplier) * 2) AS PlainID, p_brand AS Manufacturer,
         CAST(DATE '2000-01-01' + p_size AS DATE) AS PurchaseDate,
         p_size % 5 AS RegularRows, 3 AS RegularCols, p_size % 2 AS BusinessRows, 2 AS BusinessCols
  FROM part),
b_flight AS (
  SELECT o.o_orderkey AS Seq, o.o_custkey % ((SELECT count(*) FROM supplier) + 5) AS PlainID,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT)) AS TakeOffTime,
         s.n_name AS SourceField, d.n_name AS DestinationField
  FROM orders o JOIN nation s ON s.n_nationkey = o.o_custkey % 25
  JOIN nation d ON d.n_nationkey = (o.o_custkey + o.o_orderkey) % 25),
b_price AS (
  SELECT p_partkey AS Seq, (p_partkey * 7) % ((SELECT count(*) FROM orders) + 10) AS FlightID,
         CASE WHEN p_size % 2 = 0 THEN 'Business' ELSE 'Regular' END AS ClassType,
         CASE WHEN p_size % 10 = 0 THEN -1.0 ELSE p_retailprice END AS Price
  FROM part),
b_crew AS (
  SELECT c_custkey AS Seq, c_custkey AS EmployeeID,
         CASE WHEN c_custkey % 2 = 0 THEN 'Pilot' ELSE 'Flight Attendant' END AS Role,
         'New' AS FirstName, c_name AS LastName, (c_acctbal > 0) AS Qualified4LongFlights
  FROM customer)"""


def bat(body: str) -> str:
    """Batch query; leading ``name AS (...)`` definitions before the final SELECT become CTEs."""
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return inv(body, BATCH_CTES)
    idx = body.rfind("\nSELECT ")
    return inv(body[idx:], BATCH_CTES + ",\n" + body[:idx].strip().rstrip(","))


def _dup(keys: str, label: str = "duplicate in batch") -> str:
    return (f"CASE WHEN R IS NOT NULL THEN R WHEN Seq <> MIN(CASE WHEN R IS NULL THEN Seq END) "
            f"OVER (PARTITION BY {keys}) THEN '{label}' END")


SQL["ingest_customers"] = bat(f"""
SELECT Seq, Email, EngFirstName, EngLastName, PassportNumber, Birthdate, SignUpDate, IsSignedUp,
       {_dup('Email, IsSignedUp')} AS RejectReason
FROM (SELECT b.*, CASE
        WHEN Email IS NULL OR EngFirstName IS NULL OR EngLastName IS NULL
             OR (IsSignedUp AND (PassportNumber IS NULL OR Birthdate IS NULL OR SignUpDate IS NULL)) THEN 'missing field'
        WHEN EXISTS (SELECT 1 FROM managers m WHERE m.Email = b.Email) THEN 'manager email'
        WHEN IsSignedUp AND EXISTS (SELECT 1 FROM customers c WHERE c.Email = b.Email) THEN 'exists'
        WHEN NOT IsSignedUp AND EXISTS (SELECT 1 FROM guests g WHERE g.Email = b.Email) THEN 'exists'
      END AS R FROM b_signup b) r""")

SQL["ingest_phones"] = bat(f"""
, stored AS (SELECT Email, Phone, TRUE AS IsSignedUp FROM customer_phones
             UNION ALL SELECT Email, Phone, FALSE AS IsSignedUp FROM guest_phones),
r1 AS (SELECT b.Seq, b.Email, b.IsSignedUp, trim(b.Phone) AS Phone,
         CASE WHEN b.Email IS NULL OR b.IsSignedUp IS NULL THEN 'missing field'
              WHEN trim(b.Phone) IS NULL OR trim(b.Phone) = '' THEN 'empty phone'
              WHEN EXISTS (SELECT 1 FROM stored s WHERE s.Email = b.Email AND s.IsSignedUp = b.IsSignedUp
                           AND s.Phone = trim(b.Phone)) THEN 'exists' END AS R
       FROM b_phone b),
r2 AS (SELECT Seq, Email, IsSignedUp, Phone, {_dup('Email, IsSignedUp, Phone')} AS R2 FROM r1),
r3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Email, IsSignedUp, (R2 IS NULL) ORDER BY Seq) AS rk FROM r2)
SELECT Seq, Email, IsSignedUp, Phone,
       CASE WHEN R2 IS NOT NULL THEN R2
            WHEN rk + COALESCE((SELECT COUNT(*) FROM stored s WHERE s.Email = r3.Email
                                AND s.IsSignedUp = r3.IsSignedUp), 0) > 10 THEN 'too many phones' END AS RejectReason
FROM r3""".replace("\n, stored", "\nstored"))

def _orders_body(batch_cte: str) -> str:
    return f"""
, r AS (SELECT b.*, f.PlainID AS FPlain, CASE
          WHEN b.Email IS NULL OR b.FlightID IS NULL OR b.ClassType IS NULL THEN 'missing field'
          WHEN EXISTS (SELECT 1 FROM managers m WHERE m.Email = b.Email) THEN 'manager email'
          WHEN f.FlightID IS NULL THEN 'unknown flight'
          WHEN f.IsDeleted THEN 'flight deleted'
          WHEN f.TakeOffTime <= {A} THEN 'flight departed'
          WHEN NOT EXISTS (SELECT 1 FROM prices p WHERE p.FlightID = b.FlightID AND p.ClassType = b.ClassType)
            THEN 'class not offered' END AS R
        FROM {batch_cte} b LEFT JOIN flights f ON f.FlightID = b.FlightID)
SELECT Seq, Email, FlightID, ClassType, R AS RejectReason,
       CASE WHEN R IS NULL THEN (SELECT COALESCE(MAX(OrderID), 0) FROM orders_v)
            + ROW_NUMBER() OVER (PARTITION BY (R IS NULL) ORDER BY Seq) END AS OrderID,
       CASE WHEN R IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM customers c WHERE c.Email = r.Email)
                                     THEN 'customer' ELSE 'guest' END END AS CustomerKind,
       CASE WHEN R IS NULL THEN 'Active' END AS OrderStatus,
       CASE WHEN R IS NULL THEN CAST({A} AS DATE) END AS OrderDate,
       CASE WHEN R IS NULL THEN FPlain END AS PlainID
FROM r""".replace("\n, r AS", "\nr AS")


SQL["ingest_orders"] = bat(_orders_body("b_order"))

SQL["ingest_order_seats"] = bat(f"""
, r AS (SELECT b.Seq, b.CustomerKind, b.OrderID, b.SeatToken,
          TRY_CAST(split_part(trim(b.SeatToken), '-', 1) AS INTEGER) AS Line,
          TRY_CAST(split_part(trim(b.SeatToken), '-', 2) AS INTEGER) AS SeatLetter,
          o.FlightID, o.ClassType, o.OrderID AS OID, c.NumberRows, c.NumberCols
        FROM b_seat b LEFT JOIN orders_v o ON o.CustomerKind = b.CustomerKind AND o.OrderID = b.OrderID
        LEFT JOIN cabins c ON c.PlainID = o.PlainID AND c.ClassType = o.ClassType),
r2 AS (SELECT *, CASE WHEN CustomerKind IS NULL OR OrderID IS NULL OR SeatToken IS NULL THEN 'missing field'
          WHEN OID IS NULL THEN 'unknown order'
          WHEN Line IS NULL OR SeatLetter IS NULL OR NumberRows IS NULL OR Line < 1 OR SeatLetter < 1
               OR Line > NumberRows OR SeatLetter > NumberCols THEN 'no such seat'
          WHEN EXISTS (SELECT 1 FROM occ_seats s WHERE s.FlightID = r.FlightID AND s.ClassType = r.ClassType
                       AND s.Line = r.Line AND s.SeatLetter = r.SeatLetter) THEN 'seat taken' END AS R
       FROM r)
SELECT Seq, CustomerKind, OrderID, SeatToken, Line, SeatLetter, FlightID, ClassType,
       {_dup('FlightID, ClassType, Line, SeatLetter', 'seat requested twice')} AS RejectReason
FROM r2""".replace("\n, r AS", "\nr AS"))

_PLANES_R = """
, r AS (SELECT b.*, CASE WHEN PlainID IS NULL OR Manufacturer IS NULL THEN 'missing field'
          WHEN EXISTS (SELECT 1 FROM planes p WHERE p.PlainID = b.PlainID) THEN 'exists'
          WHEN NOT (RegularRows > 0 AND RegularCols > 0) AND NOT (BusinessRows > 0 AND BusinessCols > 0)
            THEN 'no cabin' END AS R
        FROM b_plane b),
pr AS (SELECT Seq, PlainID, Manufacturer, PurchaseDate, RegularRows, RegularCols, BusinessRows, BusinessCols,
              {dup} AS RejectReason,
              CASE WHEN RegularRows > 0 AND RegularCols > 0 AND BusinessRows > 0 AND BusinessCols > 0
                   THEN 'Large' ELSE 'Small' END AS Size
       FROM r)""".replace("{dup}", _dup("PlainID")).replace("\n, r AS", "\nr AS")
SQL["ingest_planes"] = inv("SELECT * FROM pr", BATCH_CTES + "," + _PLANES_R)
SQL["ingest_cabins"] = inv("""
SELECT 'Regular' AS ClassType, PlainID, CAST(RegularRows AS INTEGER) AS NumberRows,
       CAST(RegularCols AS INTEGER) AS NumberCols
FROM pr WHERE RejectReason IS NULL AND RegularRows > 0 AND RegularCols > 0
UNION ALL
SELECT 'Business', PlainID, CAST(BusinessRows AS INTEGER), CAST(BusinessCols AS INTEGER)
FROM pr WHERE RejectReason IS NULL AND BusinessRows > 0 AND BusinessCols > 0""", BATCH_CTES + "," + _PLANES_R)

SQL["ingest_flights"] = bat(f"""
, r AS (SELECT b.*, CASE WHEN b.PlainID IS NULL OR b.TakeOffTime IS NULL OR b.SourceField IS NULL
               OR b.DestinationField IS NULL THEN 'missing field'
          WHEN b.SourceField = b.DestinationField THEN 'same field'
          WHEN NOT EXISTS (SELECT 1 FROM routes x WHERE x.SourceField = b.SourceField
                           AND x.DestinationField = b.DestinationField) THEN 'no route'
          WHEN NOT EXISTS (SELECT 1 FROM planes p WHERE p.PlainID = b.PlainID) THEN 'unknown plane'
          WHEN date_trunc('day', b.TakeOffTime) <= {A} THEN 'not in the future' END AS R
        FROM b_flight b)
SELECT Seq, CASE WHEN R IS NULL THEN (SELECT COALESCE(MAX(FlightID), 0) FROM flights)
                 + ROW_NUMBER() OVER (PARTITION BY (R IS NULL) ORDER BY Seq) END AS FlightID,
       PlainID, TakeOffTime, SourceField, DestinationField,
       CASE WHEN R IS NULL THEN FALSE END AS IsDeleted, R AS RejectReason
FROM r""".replace("\n, r AS", "\nr AS"))

SQL["ingest_flight_prices"] = bat(f"""
, r AS (SELECT b.Seq, b.ClassType, b.FlightID, f.PlainID, CAST(b.Price AS DOUBLE) AS Price, CASE
          WHEN b.FlightID IS NULL OR b.ClassType IS NULL THEN 'missing field'
          WHEN f.PlainID IS NULL THEN 'unknown flight'
          WHEN NOT EXISTS (SELECT 1 FROM cabins c WHERE c.PlainID = f.PlainID AND c.ClassType = b.ClassType)
            THEN 'class not on plane'
          WHEN b.Price IS NULL OR b.Price < 0 THEN 'bad price'
          WHEN EXISTS (SELECT 1 FROM prices p WHERE p.FlightID = b.FlightID AND p.ClassType = b.ClassType)
            THEN 'exists' END AS R
        FROM b_price b LEFT JOIN flights f ON f.FlightID = b.FlightID)
SELECT Seq, ClassType, FlightID, PlainID, Price, {_dup('FlightID, ClassType')} AS RejectReason FROM r
""".replace("\n, r AS", "\nr AS"))

SQL["ingest_crew"] = bat(f"""
, r AS (SELECT b.*, CASE WHEN EmployeeID IS NULL OR Role IS NULL OR FirstName IS NULL OR LastName IS NULL
                OR Qualified4LongFlights IS NULL THEN 'missing field'
          WHEN Role NOT IN ('Pilot', 'Flight Attendant') THEN 'unknown role'
          WHEN EXISTS (SELECT 1 FROM pilots p WHERE p.PilotID = b.EmployeeID)
            OR EXISTS (SELECT 1 FROM attendants a WHERE a.AttendantID = b.EmployeeID) THEN 'id holds a role' END AS R
        FROM b_crew b)
SELECT Seq, EmployeeID, Role, FirstName, LastName, Qualified4LongFlights, {_dup('EmployeeID')} AS RejectReason
FROM r""".replace("\n, r AS", "\nr AS"))


def _check_keys_body(names=None, sources=None) -> str:
    from skyledger import schemas as S
    tbl = {"orders": "orders_v"} | (sources or {})
    parts = []
    for table, keys in S.PRIMARY_KEYS.items():
        if names and table not in names:
            continue
        src, k = tbl.get(table, table), ", ".join(keys)
        parts.append(f"SELECT '{table}' AS TableName, 'primary key' AS CheckName, '{','.join(keys)}' AS Columns, "
                     f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {src})) FROM {src}) AS Violations")
        for c in S.REQUIRED[table]:
            parts.append(f"SELECT '{table}', 'not null', '{c}', (SELECT count(*) FROM {src} WHERE {c} IS NULL)")
    kinds = {("orders", "customers"): "c.CustomerKind = 'customer' AND ", ("orders", "guests"): "c.CustomerKind = 'guest' AND "}
    for child, ccols, parent, pcols in S.FOREIGN_KEYS:
        if names and not {child, parent} <= set(names):
            continue
        cond = " AND ".join(f"p.{pc} = c.{cc}" for cc, pc in zip(ccols, pcols))
        parts.append(f"SELECT '{child}', 'foreign key -> {parent}', '{','.join(ccols)}', "
                     f"(SELECT count(*) FROM {tbl.get(child, child)} c WHERE {kinds.get((child, parent), '')}NOT EXISTS "
                     f"(SELECT 1 FROM {tbl.get(parent, parent)} p WHERE {cond}))")
    return "\nUNION ALL\n".join(parts)


SQL["check_keys"] = with_views(_check_keys_body())
# the stored tables at three times: without late orders, with them, without deleted flights
_TIMES = [{"orders": "(SELECT * FROM orders_v WHERE OrderDate < DATE '1997-01-01')"}, {},
          {"flights": "(SELECT * FROM flights WHERE NOT IsDeleted)"}]
SQL["check_keys_versions"] = with_views("\nUNION ALL\n".join(
    f"SELECT {i} AS Audit, * FROM (" + _check_keys_body(
        ["planes", "cabins", "routes", "flights", "prices", "orders", "seats"], at) + f") audit_{i}"
    for i, at in enumerate(_TIMES, 1)))

SQL["report_to_json"] = with_views(
    "SELECT CAST(to_json({'Manufacturer': Manufacturer, 'Size': Size, 'Regular_Safe_Revenue': Regular_Safe_Revenue, "
    "'Business_Safe_Revenue': Business_Safe_Revenue, 'Total_Safe_Revenue': Total_Safe_Revenue}) AS VARCHAR) AS json "
    "FROM (" + _R2 + ") r2")

_CREW_ASSIGN = """
b_ca AS (
  SELECT o_orderkey AS FlightID,
         CASE WHEN o_orderpriority = '1-URGENT' THEN [o_custkey % 50, (o_custkey + 1) % 50, (o_custkey + 2) % 50]
              ELSE [o_custkey % 50, (o_custkey + 1) % 50] END AS PilotIDs,
         CASE WHEN o_orderpriority = '1-URGENT' THEN [o_custkey % 70, (o_custkey + 1) % 70, (o_custkey + 2) % 70,
                                                      (o_custkey + 3) % 70, (o_custkey + 4) % 70, (o_custkey + 5) % 70]
              ELSE [o_custkey % 70, (o_custkey + 1) % 70, (o_custkey + 2) % 70] END AS AttendantIDs
  FROM orders),
req AS (
  SELECT b.FlightID, p.Size,
         (len(list_distinct(b.PilotIDs)) >= CASE WHEN p.Size = 'Large' THEN 3 ELSE 2 END
          AND len(list_distinct(b.AttendantIDs)) >= CASE WHEN p.Size = 'Large' THEN 6 ELSE 3 END) AS CrewComplete
  FROM b_ca b LEFT JOIN flights f ON f.FlightID = b.FlightID LEFT JOIN planes p ON p.PlainID = f.PlainID),
crew_rows AS (
  SELECT FlightID, unnest(list_distinct(PilotIDs)) AS EmployeeID, 'Pilot' AS Role FROM b_ca
  UNION ALL
  SELECT FlightID, unnest(list_distinct(AttendantIDs)) AS EmployeeID, 'Flight Attendant' AS Role FROM b_ca),
acand AS (
  SELECT f.FlightID AS CandidateID, f.SourceField, f.DestinationField, f.TakeOffTime,
         f.TakeOffTime + to_seconds(CAST(rt.DurationSec AS BIGINT)) AS LandingTime, coalesce(rt.DurationSec > 21600, FALSE) AS IsLong
  FROM flights f LEFT JOIN routes rt USING (SourceField, DestinationField)
  WHERE f.FlightID IN (SELECT FlightID FROM b_ca)),
person AS (
  SELECT PilotID AS EmployeeID, 'Pilot' AS Role, Qualified4LongFlights AS Q FROM pilots
  UNION ALL SELECT AttendantID, 'Flight Attendant', Qualified4LongFlights FROM attendants),
""" + ",".join(_assign_ctes(k).strip() for k in ("pilots", "attendants")).replace(
    "FROM candidates c", "FROM acand c") + """,
able AS (SELECT CandidateID, PilotID AS EmployeeID, 'Pilot' AS Role FROM assign_pilots
         UNION SELECT CandidateID, AttendantID, 'Flight Attendant' FROM assign_attendants),
on_it AS (SELECT FlightID, PilotID AS EmployeeID, 'Pilot' AS Role FROM working_pilots
          UNION SELECT FlightID, AttendantID, 'Flight Attendant' FROM working_attendants),
judged AS (
  SELECT r.FlightID, r.EmployeeID, r.Role, q.Size, q.CrewComplete, CASE
      WHEN q.Size IS NULL THEN 'unknown flight'
      WHEN (r.EmployeeID, r.Role) NOT IN (SELECT (EmployeeID, Role) FROM person) THEN 'no such employee in the role'
      WHEN a.IsLong AND EXISTS (SELECT 1 FROM person p WHERE p.EmployeeID = r.EmployeeID AND p.Role = r.Role AND NOT p.Q)
        THEN 'not qualified for long flights'
      WHEN (r.FlightID, r.EmployeeID, r.Role) IN (SELECT (FlightID, EmployeeID, Role) FROM on_it) THEN 'already on the flight'
      WHEN (r.FlightID, r.EmployeeID, r.Role) NOT IN (SELECT (CandidateID, EmployeeID, Role) FROM able) THEN 'not available'
      WHEN NOT q.CrewComplete THEN 'crew short of requirement' END AS R
  FROM crew_rows r LEFT JOIN req q USING (FlightID) LEFT JOIN acand a ON a.CandidateID = r.FlightID)
SELECT FlightID, EmployeeID, Role, Size, CrewComplete,
       CASE WHEN R IS NOT NULL THEN R
            WHEN FlightID <> MIN(CASE WHEN R IS NULL THEN FlightID END) OVER (PARTITION BY Role, EmployeeID)
              THEN 'assigned twice in batch' END AS RejectReason
FROM judged"""
SQL["ingest_crew_assignments"] = inv(_CREW_ASSIGN[_CREW_ASSIGN.rindex("\nSELECT FlightID"):],
                                     BATCH_CTES + "," + _CREW_ASSIGN[:_CREW_ASSIGN.rindex("\nSELECT FlightID")])


_BOOKING = f"""
b_booking AS (
  SELECT b.*, CASE WHEN o.o_orderpriority = '1-URGENT'
                   THEN [CAST(1 + o.o_custkey % 3 AS VARCHAR) || '-' || CAST(1 + o.o_orderkey % 3 AS VARCHAR),
                         CAST(1 + o.o_orderkey % 2 AS VARCHAR) || '-' || CAST(1 + o.o_custkey % 2 AS VARCHAR)]
                   ELSE [CAST(1 + o.o_custkey % 3 AS VARCHAR) || '-' || CAST(1 + o.o_orderkey % 3 AS VARCHAR)] END
           AS SeatTokens
  FROM b_order b JOIN orders o ON o.o_orderkey = b.Seq),
ord AS (WITH {_orders_body("b_booking").strip()}),
seat_req AS (
  SELECT o.Seq AS BookingSeq, o.CustomerKind, o.OrderID, o.FlightID, o.ClassType, o.PlainID,
         u.pos, u.SeatToken
  FROM ord o
  JOIN (SELECT Seq, generate_subscripts(SeatTokens, 1) - 1 AS pos, unnest(SeatTokens) AS SeatToken
        FROM b_booking) u ON u.Seq = o.Seq
  WHERE o.RejectReason IS NULL),
seat_chk AS (
  SELECT s.*, TRY_CAST(split_part(trim(s.SeatToken), '-', 1) AS INTEGER) AS Line,
         TRY_CAST(split_part(trim(s.SeatToken), '-', 2) AS INTEGER) AS SeatLetter,
         c.NumberRows, c.NumberCols
  FROM seat_req s LEFT JOIN cabins c ON c.PlainID = s.PlainID AND c.ClassType = s.ClassType),
seat_r AS (
  SELECT *, CASE
      WHEN Line IS NULL OR SeatLetter IS NULL OR NumberRows IS NULL OR Line < 1 OR SeatLetter < 1
           OR Line > NumberRows OR SeatLetter > NumberCols THEN 'no such seat'
      WHEN EXISTS (SELECT 1 FROM occ_seats x WHERE x.FlightID = seat_chk.FlightID AND x.ClassType = seat_chk.ClassType
                   AND x.Line = seat_chk.Line AND x.SeatLetter = seat_chk.SeatLetter) THEN 'seat taken' END AS R
  FROM seat_chk),
whole AS (  -- bookings whose order and seats are all good, with the seats they want
  SELECT BookingSeq AS Seq, FlightID, ClassType, list(Line * 1000 + SeatLetter) AS wants
  FROM seat_r GROUP BY ALL HAVING count(R) = 0 AND count(*) = count(DISTINCT (Line, SeatLetter))),
queue AS (SELECT *, row_number() OVER (PARTITION BY FlightID, ClassType ORDER BY Seq) AS k FROM whole),
walk AS (  -- one booking of each cabin after the other, with the seats given away so far
  SELECT FlightID, ClassType, k, Seq, wants AS given, TRUE AS ok FROM queue WHERE k = 1
  UNION ALL
  SELECT q.FlightID, q.ClassType, q.k, q.Seq,
         CASE WHEN list_has_any(w.given, q.wants) THEN w.given ELSE list_concat(w.given, q.wants) END,
         NOT list_has_any(w.given, q.wants)
  FROM walk w JOIN queue q ON (q.FlightID, q.ClassType, q.k) = (w.FlightID, w.ClassType, w.k + 1)),
own_fault AS (
  SELECT BookingSeq AS Seq, arg_min(why, pos) AS why FROM (
    SELECT BookingSeq, pos, coalesce(R, CASE WHEN row_number() OVER (PARTITION BY BookingSeq, Line, SeatLetter ORDER BY pos) > 1
                                             THEN 'seat requested twice' END) AS why FROM seat_r) x
  WHERE why IS NOT NULL GROUP BY ALL),
booked AS (
  SELECT o.* EXCLUDE (RejectReason, OrderID, CustomerKind, OrderStatus, OrderDate, PlainID), o.CustomerKind AS k_, o.PlainID AS p_,
         COALESCE(o.RejectReason, CASE WHEN coalesce(len(b.SeatTokens), 0) = 0 THEN 'no seats' END, f.why,
                  CASE WHEN w.ok IS NOT TRUE THEN 'seat requested twice' END) AS RejectReason
  FROM ord o JOIN b_booking b ON b.Seq = o.Seq LEFT JOIN own_fault f ON f.Seq = o.Seq LEFT JOIN walk w ON w.Seq = o.Seq),
booked_ids AS (
  SELECT Seq, Email, FlightID, ClassType, RejectReason,
         CASE WHEN RejectReason IS NULL THEN (SELECT COALESCE(MAX(OrderID), 0) FROM orders_v)
              + count(*) FILTER (RejectReason IS NULL) OVER (ORDER BY Seq) END AS OrderID,
         CASE WHEN RejectReason IS NULL THEN k_ END AS CustomerKind,
         CASE WHEN RejectReason IS NULL THEN 'Active' END AS OrderStatus,
         CASE WHEN RejectReason IS NULL THEN CAST({A} AS DATE) END AS OrderDate,
         CASE WHEN RejectReason IS NULL THEN p_ END AS PlainID
  FROM booked)"""

SQL["ingest_bookings"] = inv("SELECT * FROM booked_ids", BATCH_CTES + "," + _BOOKING)

SQL["ingest_bookings_contended"] = SQL["ingest_bookings"].replace("(o_orderkey * 7 + 3)", "(o_custkey * 7 + 3)")

SQL["ingest_booking_seats"] = inv("""
SELECT b.CustomerKind, b.OrderID, s.Line, s.SeatLetter FROM booked_ids b JOIN seat_r s ON s.BookingSeq = b.Seq
WHERE b.RejectReason IS NULL""", BATCH_CTES + "," + _BOOKING)


def _staffed_flights_sql() -> str:
    feas_body = SQL["staffing_feasibility"].split("\nSELECT c.CandidateID, c.IsLong, x.AvailablePlanes", 1)[1]
    feas = ("SELECT c.CandidateID, c.IsLong, x.AvailablePlanes" + feas_body).replace("candidates c", "fcand c")
    assign = ASSIGN_CTES.replace("FROM candidates c", "FROM fcand c")
    return inv(f"""
SELECT r3.Seq, CASE WHEN r3.R3 IS NULL THEN (SELECT COALESCE(MAX(FlightID), 0) FROM flights)
                 + ROW_NUMBER() OVER (PARTITION BY (r3.R3 IS NULL) ORDER BY r3.Seq) END AS FlightID,
       r3.PlainID, r3.TakeOffTime, r3.SourceField, r3.DestinationField,
       CASE WHEN r3.R3 IS NULL THEN FALSE END AS IsDeleted, r3.R3 AS RejectReason
FROM r3""", BATCH_CTES + """,
fr AS (SELECT b.*, CASE WHEN b.PlainID IS NULL OR b.TakeOffTime IS NULL OR b.SourceField IS NULL
               OR b.DestinationField IS NULL THEN 'missing field'
          WHEN b.SourceField = b.DestinationField THEN 'same field'
          WHEN NOT EXISTS (SELECT 1 FROM routes x WHERE x.SourceField = b.SourceField
                           AND x.DestinationField = b.DestinationField) THEN 'no route'
          WHEN NOT EXISTS (SELECT 1 FROM planes p WHERE p.PlainID = b.PlainID) THEN 'unknown plane'
          WHEN date_trunc('day', b.TakeOffTime) <= """ + A + """ THEN 'not in the future' END AS R
        FROM b_flight b),
fcand AS (SELECT CAST(fr.Seq AS VARCHAR) AS CandidateID, fr.SourceField, fr.DestinationField, fr.TakeOffTime,
                 fr.TakeOffTime + to_seconds(CAST(rt.DurationSec AS BIGINT)) AS LandingTime, rt.DurationSec,
                 (rt.DurationSec > 21600) AS IsLong
          FROM fr JOIN routes rt ON fr.SourceField = rt.SourceField AND fr.DestinationField = rt.DestinationField
          WHERE fr.R IS NULL),
""" + assign + """,
feas AS (""" + feas + """),
r2 AS (SELECT fr.*, COALESCE(fr.R, CASE WHEN f.Feasible = FALSE THEN 'cannot be staffed'
              WHEN (CAST(fr.Seq AS VARCHAR), fr.PlainID) NOT IN (SELECT (CandidateID, PlainID) FROM assign_planes)
                THEN 'plane not available' END) AS R2
       FROM fr LEFT JOIN feas f ON f.CandidateID = CAST(fr.Seq AS VARCHAR)),
r3 AS (SELECT *, CASE WHEN R2 IS NOT NULL THEN R2
              WHEN Seq <> MIN(CASE WHEN R2 IS NULL THEN Seq END) OVER (PARTITION BY PlainID)
                THEN 'plane used twice in batch' END AS R3 FROM r2)""")


SQL["ingest_flights_staffed"] = _staffed_flights_sql()


# ---- addresses in any case of letters (J8, D22, I1–I3) ------------------------------------
def _capitals(relation: str, key: str = "Seq") -> str:
    return (f"(SELECT * REPLACE (CASE WHEN {key} % 2 = 0 THEN upper(Email) ELSE Email END AS Email) "
            f"FROM {relation})")


def _caseless(sql: str, relation: str, key: str = "Seq") -> str:
    """The same query over ``relation`` with every second address in capitals, addresses compared by ``lower``."""
    sql = re.sub(r"(\w+)\.Email = (\w+)\.Email", r"lower(\1.Email) = lower(\2.Email)", sql)
    sql = sql.replace("PARTITION BY Email", "PARTITION BY lower(Email)")
    return sql.replace(f"FROM {relation} ", f"FROM {_capitals(relation, key)} ")


SQL["ingest_customers_mixed_case"] = _caseless(SQL["ingest_customers"], "b_signup")
SQL["ingest_phones_mixed_case"] = _caseless(SQL["ingest_phones"] + "\n", "b_phone")
SQL["ingest_orders_mixed_case"] = _caseless(SQL["ingest_orders"], "b_order")
SQL["membership_flags_mixed_case"] = with_views(f"""
SELECT e.Email, lower(e.Email) IN (SELECT lower(Email) FROM customers) AS IsCustomer,
       lower(e.Email) IN (SELECT lower(Email) FROM guests) AS IsGuest,
       lower(e.Email) IN (SELECT lower(Email) FROM managers) AS IsManager
FROM (SELECT DISTINCT Email FROM {_capitals('orders_v', 'OrderID')}) e""")
SQL["order_lookup_mixed_case"] = hist(f"""
SELECT r.OrderID, r.Email, h.CustomerKind, h.FlightID, h.ClassType, h.NumSeats, h.OrderStatus, h.OrderDate,
       h.OrderPrice, h.SourceField, h.DestinationField, h.TakeOffTime
FROM {_capitals('orders_v', 'OrderID')} r
LEFT JOIN hist h ON r.OrderID = h.OrderID AND lower(r.Email) = lower(h.Email)""")


# ---- a third class (A10, D5b, D9) ------------------------------------------------------------
def _three(body: str) -> str:
    more = """
cabins3 AS (SELECT * FROM cabins UNION ALL
            SELECT * REPLACE ('First' AS ClassType, 1 AS NumberRows, 2 AS NumberCols) FROM cabins
            WHERE ClassType = 'Regular' AND PlainID % 4 = 0),
prices3 AS (SELECT * FROM prices UNION ALL
            SELECT * REPLACE ('First' AS ClassType, Price * 2 AS Price) FROM prices
            WHERE ClassType = 'Regular' AND PlainID % 4 = 0),
"""
    return with_views(body, more + re.sub(r"\b(cabins|prices)\b", r"\g<1>3", INV_CTES.strip()))


SQL["class_price_map"] = _three("""
SELECT FlightID, '{' || string_agg('"' || ClassType || '":' || CAST(Price AS VARCHAR), ',' ORDER BY ClassType) || '}' AS Prices
FROM (SELECT FlightID, ClassType, max(Price) AS Price FROM acp GROUP BY ALL) GROUP BY FlightID""")
_FARES = """(SELECT FlightID, max(Price) FILTER (ClassType = 'Business') AS Business_price,
   max(Price) FILTER (ClassType = 'First') AS First_price, max(Price) FILTER (ClassType = 'Regular') AS Regular_price
   FROM acp GROUP BY FlightID)"""
SQL["class_price_pivot_three"] = _three(f"SELECT * FROM {_FARES} fares")
SQL["flight_search_three"] = _three(f"""
SELECT s.* EXCLUDE (Business_price, Regular_price), x.Business_price, x.First_price, x.Regular_price
FROM search s JOIN {_FARES} x USING (FlightID)""")

# ---- classes of equal profiles (D12, J11), ways back that are missing (D17) ---------------------
_CLASS_DIMS = {"planes": ("PlainID", "planes", "flights", "D.Size = 'Large'"),
               "pilots": ("PilotID", "pilots", "working_pilots", "D.Qualified4LongFlights"),
               "attendants": ("AttendantID", "attendants", "working_attendants", "D.Qualified4LongFlights")}
for _kind, (_rid, _dim, _shifts, _q) in _CLASS_DIMS.items():
    _member = f"""
(SELECT D.{_rid}, concat_ws('|', CASE WHEN {_q} THEN 'q' ELSE 'n' END,
        CASE WHEN D.{_rid} NOT IN (SELECT {_rid} FROM {_shifts}) THEN 'free'
             ELSE concat_ws('|', coalesce(strftime(x.a, '%Y-%m-%d %H:%M:%S'), '-'),
                  coalesce((SELECT string_agg(DISTINCT l.SourceField, ',' ORDER BY l.SourceField) FROM legs_{_kind} l
                            WHERE l.ResourceID = D.{_rid} AND l.TakeOffTime = x.a), ''),
                  coalesce(strftime(x.b, '%Y-%m-%d %H:%M:%S'), '-'),
                  coalesce((SELECT string_agg(DISTINCT l.DestinationField, ',' ORDER BY l.DestinationField)
                            FROM legs_{_kind} l WHERE l.ResourceID = D.{_rid} AND l.LandingTime = x.b), '')) END) AS ClassID
 FROM {_dim} D LEFT JOIN (SELECT ResourceID, min(TakeOffTime) AS a, max(LandingTime) AS b FROM legs_{_kind}
                          GROUP BY ResourceID) x ON x.ResourceID = D.{_rid})"""
    SQL[f"class_members_{_kind}"] = asg(f"SELECT ClassID, {_rid} FROM {_member} m")
    SQL[f"class_candidates_{_kind}"] = asg(
        f"SELECT DISTINCT CandidateID, ClassID FROM assign_{_kind} JOIN {_member} m USING ({_rid})")
SQL["missing_return_routes_thinned"] = with_views("""
SELECT r.* FROM routes r WHERE r.DurationSec % 540 <> 0 AND NOT EXISTS (
  SELECT 1 FROM routes b WHERE b.SourceField = r.DestinationField AND b.DestinationField = r.SourceField
  AND b.DurationSec % 540 <> 0)""")

# ---- stored tables (S3–S5) -----------------------------------------------------------------------
SQL["load_csv_rows"] = with_views(
    "SELECT FlightID, PlainID, TakeOffTime, SourceField, DestinationField, IsDeleted FROM flights "
    "WHERE FlightID % 13 <> 0 AND FlightID % 17 <> 0 AND FlightID % 19 <> 0")
SQL["load_csv_rejects"] = with_views("""
SELECT concat(FlightID, ',', CASE WHEN FlightID % 13 = 0 THEN 'x' ELSE '' END, PlainID, ',',
              strftime(TakeOffTime, '%Y-%m-%d %H:%M:%S'),
              CASE WHEN FlightID % 17 = 0 THEN ''
                   ELSE concat(',', CASE WHEN FlightID % 19 = 0 THEN '' ELSE SourceField END, ',', DestinationField, ',',
                               IsDeleted) END) AS Line,
       CASE WHEN FlightID % 13 = 0 OR FlightID % 17 = 0 THEN 'malformed' ELSE 'missing field' END AS RejectReason
FROM flights WHERE FlightID % 13 = 0 OR FlightID % 17 = 0 OR FlightID % 19 = 0""")
SQL["append_rows"] = with_views(f"SELECT {ORDER_COLS} FROM orders_v")
SQL["complete_orders_stored"] = SQL["complete_orders"]
SQL["complete_orders_file_sets"] = with_views(f"""
SELECT year(o.OrderDate) AS OrderYear, count(*) AS Rows,
       NOT bool_or(coalesce(f.TakeOffTime < date_trunc('day', {A}) + INTERVAL 1 SECOND AND o.OrderStatus = 'Active', FALSE))
         AS Kept
FROM orders_v o LEFT JOIN flights f USING (FlightID) GROUP BY year(o.OrderDate)""")
SQL["cancel_flights_stored"] = SQL["cancel_flights_orders"]
