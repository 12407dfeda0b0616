"""The airline views of :mod:`skyledger.sources.views` written as plain SQL.

Used only to build the independent oracle (DuckDB) queries that check the
Spark operators; the driver tables are pre-registered as views there.
``with_views(body)`` prefixes a query with the common table expressions.
"""

from __future__ import annotations

VIEW_CTES = r"""
n_sup AS (SELECT count(*) AS n FROM supplier),
planes AS (
  SELECT s_suppkey AS PlainID,
         CASE s_suppkey % 3 WHEN 0 THEN 'Boeing' WHEN 1 THEN 'Airbus' ELSE 'Dassault' END AS Manufacturer,
         CASE WHEN s_suppkey % 2 = 0 THEN 'Large' ELSE 'Small' END AS Size,
         CAST(DATE '1990-01-01' + CAST(s_suppkey % 1000 AS INTEGER) AS DATE) AS PurchaseDate
  FROM supplier),
cabins AS (
  SELECT 'Regular' AS ClassType, PlainID, CAST(1 + PlainID % 3 AS INTEGER) AS NumberRows, 3 AS NumberCols FROM planes
  UNION ALL
  SELECT 'Business' AS ClassType, PlainID, 1 AS NumberRows, 2 AS NumberCols FROM planes WHERE Size = 'Large'),
routes AS (
  SELECT a.n_name AS SourceField, b.n_name AS DestinationField,
         CAST((60 + (a.n_nationkey * 37 + b.n_nationkey * 53) % 660) * 60 AS INTEGER) AS DurationSec
  FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey),
flights_ext AS (
  SELECT o.o_orderkey AS FlightID,
         o.o_orderkey % (SELECT n FROM n_sup) AS PlainID,
         o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT)) AS TakeOffTime,
         s.n_name AS SourceField, d.n_name AS DestinationField,
         (o.o_orderkey % 20 = 0) AS IsDeleted,
         o.o_custkey AS CustKey, CAST(o.o_orderdate AS DATE) AS BaseDate
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation s ON s.n_nationkey = c.c_nationkey
  JOIN nation d ON d.n_nationkey = (c.c_nationkey + 1 + o.o_orderkey % 24) % 25),
flights AS (
  SELECT FlightID, PlainID, TakeOffTime, SourceField, DestinationField, IsDeleted FROM flights_ext),
prices AS (
  SELECT c.ClassType, f.FlightID, f.PlainID,
         CAST((100 + (f.FlightID % 40) * 10) * (CASE WHEN c.ClassType = 'Business' THEN 2.5 ELSE 1.0 END) AS DOUBLE) AS Price
  FROM flights f JOIN cabins c ON f.PlainID = c.PlainID),
li AS (
  SELECT l_orderkey, l_linenumber, min(l_returnflag) AS rf FROM lineitem GROUP BY l_orderkey, l_linenumber),
orders_ext AS (
  SELECT li.l_orderkey * 10 + li.l_linenumber AS OrderID,
         CASE WHEN li.l_linenumber % 2 = 1 THEN 'customer' ELSE 'guest' END AS CustomerKind,
         CASE WHEN f.IsDeleted THEN 'System_Cancelled'
              WHEN li.rf = 'R' THEN 'Customer_Cancelled'
              WHEN li.rf = 'N' THEN 'Complete'
              ELSE 'Active' END AS OrderStatus,
         CAST(f.BaseDate - CAST(7 * li.l_linenumber AS INTEGER) AS DATE) AS OrderDate,
         (CASE WHEN li.l_linenumber % 2 = 1 THEN 'c' ELSE 'g' END) || CAST(f.CustKey AS VARCHAR) || '@example.com' AS Email,
         f.PlainID,
         CASE WHEN li.l_linenumber % 3 = 0 AND f.PlainID % 2 = 0 THEN 'Business' ELSE 'Regular' END AS ClassType,
         f.FlightID,
         li.l_linenumber AS LineNo
  FROM li JOIN flights_ext f ON li.l_orderkey = f.FlightID),
orders_v AS (
  SELECT OrderID, CustomerKind, OrderStatus, OrderDate, Email, PlainID, ClassType, FlightID FROM orders_ext),
seat_idx AS (
  SELECT o.CustomerKind, o.OrderID, c.NumberRows, c.NumberCols,
         CASE WHEN o.ClassType = 'Business' THEN o.LineNo // 3 - 1 ELSE (o.LineNo - 1) * 2 + js.j END AS idx
  FROM orders_ext o
  JOIN cabins c ON o.PlainID = c.PlainID AND o.ClassType = c.ClassType
  JOIN (VALUES (0), (1)) AS js(j) ON (o.ClassType = 'Regular' OR js.j = 0)),
seats AS (
  SELECT CustomerKind, OrderID, CAST(idx // NumberCols + 1 AS INTEGER) AS Line,
         CAST(idx % NumberCols + 1 AS INTEGER) AS SeatLetter
  FROM seat_idx WHERE idx < NumberRows * NumberCols),
pilots AS (
  SELECT s_suppkey AS PilotID, 'Pilot' AS FirstName, s_name AS LastName,
         (s_suppkey % 3 <> 0) AS Qualified4LongFlights FROM supplier),
attendants AS (
  SELECT s_suppkey AS AttendantID, 'Attendant' AS FirstName, s_name AS LastName,
         (s_suppkey % 3 <> 0) AS Qualified4LongFlights FROM supplier),
working_pilots AS (
  SELECT (f.FlightID * 7 + k.k * 13) % CAST(floor((SELECT n FROM n_sup) * 4 / 5) AS BIGINT) AS PilotID, f.FlightID
  FROM flights_ext f CROSS JOIN (VALUES (0), (1)) AS k(k)),
working_attendants AS (
  SELECT (f.FlightID * 7 + k.k * 13) % CAST(floor((SELECT n FROM n_sup) * 4 / 5) AS BIGINT) AS AttendantID, f.FlightID
  FROM flights_ext f CROSS JOIN (VALUES (0), (1), (2)) AS k(k)),
candidates AS (
  SELECT r.SourceField || '>' || r.DestinationField || ':' || t.tag AS CandidateID,
         r.SourceField, r.DestinationField, t.ts AS TakeOffTime,
         t.ts + to_seconds(CAST(r.DurationSec AS BIGINT)) AS LandingTime,
         r.DurationSec, (r.DurationSec > 21600) AS IsLong
  FROM routes r
  CROSS JOIN (VALUES ('L', TIMESTAMP '2002-01-01 08:00:00'), ('E', TIMESTAMP '1994-12-01 08:00:00')) AS t(tag, ts)),
customers AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email, 'Customer' AS EngFirstName,
         c_name AS EngLastName, 10000000 + c_custkey AS PassportNumber,
         CAST(DATE '1950-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS DATE) AS Birthdate,
         CAST(DATE '1990-01-01' + CAST(c_custkey % 3000 AS INTEGER) AS DATE) AS SignUpDate
  FROM customer),
guests AS (
  SELECT 'g' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email, 'Guest' AS EngFirstName,
         c_name AS EngLastName FROM customer),
customer_phones AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email,
         '05' || lpad(CAST(c_custkey * 10 + k.k AS VARCHAR), 8, '0') AS Phone
  FROM customer CROSS JOIN (VALUES (0), (1), (2)) AS k(k) WHERE k.k <= c_custkey % 3),
guest_phones AS (
  SELECT 'g' || CAST(c_custkey AS VARCHAR) || '@example.com' AS Email,
         '05' || lpad(CAST(c_custkey * 10 + k.k AS VARCHAR), 8, '0') AS Phone
  FROM customer CROSS JOIN (VALUES (0), (1)) AS k(k) WHERE k.k <= c_custkey % 2),
managers AS (
  SELECT CAST(r_regionkey AS BIGINT) AS ManagerID, 'Manager' AS FirstName, r_name AS LastName,
         'c' || CAST(r_regionkey * 100 AS VARCHAR) || '@example.com' AS Email FROM region)
"""

AS_OF_SQL = "TIMESTAMP '2000-01-01 00:00:00'"


def with_views(body: str, extra_ctes: str = "") -> str:
    """``WITH <views>[, extra] <body>`` — unused CTEs are dropped by the planner."""
    ctes = VIEW_CTES.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"
