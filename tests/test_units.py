"""Hand-made edge rows (FIXTURES.md §5) for the operators' boundary semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from skyledger import schemas as S
from skyledger.functions import predicates as P
from skyledger.functions import scalar as FS
from skyledger.operators import assign, ingest, inventory as inv, orders as ords, relational as R, reports
from skyledger.sources.views import Tables

AS_OF = dt.datetime(2026, 12, 1, 0, 0, 0)
CREW = T.StructType([T.StructField("ID", T.LongType()), T.StructField("FirstName", T.StringType()),
                     T.StructField("LastName", T.StringType()),
                     T.StructField("Qualified4LongFlights", T.BooleanType())])


def crew_df(spark, id_col, rows):
    return spark.createDataFrame(rows, CREW).withColumnRenamed("ID", id_col)


@pytest.fixture(scope="module")
def t(spark):
    """Three fields, four planes, a handful of flights crafted for the boundaries."""
    planes = spark.createDataFrame([
        (1, "Boeing", "Large", dt.date(2020, 1, 1)), (2, "Airbus", "Small", dt.date(2020, 1, 1)),
        (3, "Dassault", "Large", dt.date(2020, 1, 1)), (4, "Boeing", "Small", dt.date(2020, 1, 1)),
    ], S.PLANES)
    cabins = spark.createDataFrame([
        ("Regular", 1, 2, 2), ("Business", 1, 1, 2), ("Regular", 2, 1, 2),
        ("Regular", 3, 2, 2), ("Business", 3, 1, 1), ("Regular", 4, 1, 1),
    ], S.CABINS)
    routes = spark.createDataFrame([
        ("AAA", "BBB", 6 * 3600), ("BBB", "AAA", 6 * 3600), ("AAA", "CCC", 6 * 3600 + 60),
        ("CCC", "AAA", 6 * 3600 + 60), ("BBB", "CCC", 3600), ("CCC", "BBB", 3600),
    ], S.ROUTES)
    flights = spark.createDataFrame([
        # 10: departed, full (plane 2 has 2 seats, both booked) -> Full Capacity wins over Complete
        (10, 2, dt.datetime(2026, 11, 1, 8), "AAA", "BBB", False),
        # 11: departed with seats left -> Complete
        (11, 1, dt.datetime(2026, 11, 2, 8), "BBB", "AAA", False),
        # 12: deleted -> Deleted
        (12, 1, dt.datetime(2026, 12, 10, 8), "AAA", "CCC", True),
        # 13: overbooked (plane 4 has 1 seat, 2 booked) -> negative seats -> Active
        (13, 4, dt.datetime(2026, 12, 20, 8), "AAA", "BBB", False),
        # 14: leaves exactly at as_of -> departed (<= now) -> Complete
        (14, 3, AS_OF, "CCC", "AAA", False),
        # 15: later on the as_of day: not departed for D8, but after midnight for D26
        (15, 3, dt.datetime(2026, 12, 1, 18), "AAA", "CCC", False),
        # 16: exactly 36 h / 72 h ahead boundaries
        (16, 1, AS_OF + dt.timedelta(hours=36), "AAA", "BBB", False),
        (17, 1, AS_OF + dt.timedelta(hours=72), "BBB", "CCC", False),
        # 18: no prices -> absent from status / search
        (18, 1, dt.datetime(2027, 1, 5, 8), "CCC", "BBB", False),
    ], S.FLIGHTS)
    prices = spark.createDataFrame([
        ("Regular", 10, 2, 100.0), ("Regular", 11, 1, 110.0), ("Business", 11, 1, 275.0),
        ("Regular", 12, 1, 120.0), ("Regular", 13, 4, 130.0), ("Regular", 14, 3, 140.0),
        ("Business", 14, 3, 350.0), ("Regular", 15, 3, 150.0), ("Regular", 16, 1, 160.0),
        ("Regular", 17, 1, 170.0),
    ], S.PRICES)
    o = [
        (1, "customer", "Active", dt.date(2026, 10, 1), "a@x", 2, "Regular", 10),
        (2, "guest", "Active", dt.date(2026, 10, 1), "b@x", 2, "Regular", 10),
        (3, "customer", "Customer_Cancelled", dt.date(2026, 10, 2), "a@x", 1, "Regular", 11),
        (4, "customer", "Active", dt.date(2026, 10, 3), "a@x", 1, "Business", 11),
        (5, "guest", "Customer_Cancelled", dt.date(2026, 11, 3), "c@x", 1, "Regular", 12),
        (6, "customer", "Active", dt.date(2026, 11, 4), "a@x", 4, "Regular", 13),
        (7, "guest", "Active", dt.date(2026, 11, 4), "d@x", 4, "Regular", 13),
        (8, "customer", "Active", dt.date(2026, 11, 5), "a@x", 3, "Regular", 15),
        (9, "customer", "System_Cancelled", dt.date(2026, 11, 5), "e@x", 1, "Regular", 16),
        (20, "guest", "Active", dt.date(2026, 11, 6), "f@x", 1, "Regular", 16),  # no seat rows
    ]
    orders = spark.createDataFrame(o, S.ORDERS)
    seats = spark.createDataFrame([
        ("customer", 1, 1, 1), ("guest", 2, 1, 2), ("customer", 3, 1, 1), ("customer", 4, 1, 1),
        ("customer", 4, 1, 2), ("guest", 5, 1, 1), ("customer", 6, 1, 1), ("guest", 7, 1, 1),
        ("customer", 8, 2, 2), ("customer", 9, 1, 2),
    ], S.SEATS)
    pilots = crew_df(spark, "PilotID", [(100, "P", "A", True), (101, "P", "B", False), (102, "P", "C", True)])
    atts = crew_df(spark, "AttendantID", [(200, "A", "A", True), (201, "A", "B", False)])
    wp = spark.createDataFrame([(100, 10), (100, 11), (101, 11)], "PilotID long, FlightID long")
    wa = spark.createDataFrame([(200, 14)], "AttendantID long, FlightID long")
    customers = spark.createDataFrame([("a@x", "A", "A", 1, dt.date(1990, 1, 1), dt.date(2020, 1, 1))], S.CUSTOMERS)
    guests = spark.createDataFrame([("b@x", "B", "B")], S.GUESTS)
    cphones = spark.createDataFrame([("a@x", "0501"), ("a@x", "0500")], S.PHONES)
    gphones = spark.createDataFrame([], S.PHONES)
    managers = spark.createDataFrame([(1, "M", "M", "m@x")],
                                     "ManagerID long, FirstName string, LastName string, Email string")
    cands = spark.createDataFrame([
        ("late", "BBB", "AAA", dt.datetime(2026, 12, 30, 8), dt.datetime(2026, 12, 30, 14), 6 * 3600, False),
        ("long", "AAA", "CCC", dt.datetime(2026, 12, 30, 8), dt.datetime(2026, 12, 30, 14, 1), 6 * 3600 + 60, True),
    ], "CandidateID string, SourceField string, DestinationField string, TakeOffTime timestamp_ntz, "
       "LandingTime timestamp_ntz, DurationSec int, IsLong boolean")
    return Tables(planes=planes, cabins=cabins, routes=routes, flights=flights, prices=prices, orders=orders,
                  seats=seats, pilots=pilots, attendants=atts, working_pilots=wp, working_attendants=wa,
                  customers=customers, guests=guests, customer_phones=cphones, guest_phones=gphones,
                  managers=managers, candidates=cands)


def test_flight_status_precedence(t):
    got = dict(inv.flight_status(t, AS_OF).collect())
    assert got == {10: "Full Capacity", 11: "Complete", 12: "Deleted", 13: "Active", 14: "Complete",
                   15: "Active", 16: "Active", 17: "Active"}  # 18 has no prices -> absent


def test_available_seats_overbooked(t):
    r = {(x.FlightID, x.ClassType): x.AvailableSeats for x in inv.available_seats(t).collect()}
    assert r[(13, "Regular")] == -1 and r[(10, "Regular")] == 0 and r[(11, "Business")] == 0


def test_pivot_drops_short_class_and_flight(t):
    rows = {x.FlightID: (x.Business_price, x.Regular_price) for x in inv.class_price_pivot(t, 1).collect()}
    assert rows[11] == (None, 110.0)     # Business full -> NULL
    assert 10 not in rows                 # no class with a free seat -> flight gone


def test_long_is_strict(t):
    cat = dict(inv.flight_category(t).select("FlightID", "FlightCategory").collect())
    assert cat[10] == "Short" and cat[12] == "Long"


def test_order_window_strict(t):
    r = dict(ords.order_cancellable(t, AS_OF).select("OrderID", "CanCancel").collect())
    assert r[9] is False  # exactly 36 h ahead is not "more than 36 h"
    f = dict(ords.flight_cancellable(t, AS_OF).select("FlightID", "CanCancel").collect())
    assert f[17] is False and f[16] is False


def test_complete_orders_midnight(t):
    r = dict(ords.complete_orders(t, AS_OF).select("OrderID", "OrderStatus").collect())
    assert r[1] == "Complete" and r[3] == "Customer_Cancelled" and r[8] == "Active"  # flight 15 leaves after midnight


def test_cancel_flight_overwrites_customer_cancelled(t):
    ids = t.flights.filter("FlightID = 11").select("FlightID")
    fl, od = ords.cancel_flights(t, ids)
    assert dict(fl.select("FlightID", "IsDeleted").collect())[11] is True
    st = dict(od.select("OrderID", "OrderStatus").collect())
    assert st[3] == "System_Cancelled" and st[4] == "System_Cancelled" and st[1] == "Active"


def test_history_prices(t):
    h = {x.OrderID: x.OrderPrice for x in ords.order_history(t).collect()}
    assert h[3] == pytest.approx(5.5) and h[4] == pytest.approx(550.0) and h[9] == 0.0
    assert 20 not in h  # no seat rows


def test_cancel_quote_uses_full_price(t):
    q = {x.OrderID: (x.CancellationFee, x.Refund) for x in ords.cancel_quote(t).collect()}
    assert q[3] == (5.5, 104.5)


def test_extreme_rows_keep_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 3)], "k int, v int")
    assert sorted(R.rows_at_extreme(df, ["k"], "v", "min").collect()) == sorted([(1, 5), (1, 5), (2, 3)])


def test_allocate_ids_dense(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 3 - 900).alias("Seq"))
    out = R.allocate_ids(df, "Seq", F.lit(41), "NewID", F.col("Seq") % 2 == 0).collect()
    ids = [r.NewID for r in sorted(out, key=lambda r: r.Seq) if r.Seq % 2 == 0]
    assert ids == list(range(42, 542)) and len(out) == 1000
    assert all(r.NewID is None for r in out if r.Seq % 2)


def test_allocate_ids_without_a_key(spark):
    """Rows without a key, many of them, stay and get no id; the others' ids have no holes."""
    df = spark.range(0, 3000, 1, 5).select(F.when(F.col("id") % 3 > 0, F.col("id") * 50_000 - 10**7).alias("Seq"), "id")
    out = R.allocate_ids(df, "Seq", F.lit(5), "NewID").collect()
    assert len(out) == 3000 and all((r.NewID is None) == (r.Seq is None) for r in out)
    assert [r.NewID for r in sorted(out, key=lambda r: r.id) if r.Seq is not None] == list(range(6, 2006))
    assert R.allocate_ids(df.where("Seq IS NULL"), "Seq", F.lit(5), "NewID").where("NewID IS NULL").count() == 1000


def test_ingest_orders_without_a_place_in_line(t, spark):
    batch = spark.createDataFrame([(None, "z@x", 17, "Regular"), (None, "z@x", 17, "Regular"), (7, "z@x", 17, "Regular")],
                                  "Seq long, Email string, FlightID long, ClassType string")
    got = sorted((r.Seq is None, r.RejectReason, r.OrderID is None) for r in ingest.ingest_orders(t, batch, AS_OF).collect())
    assert got == [(False, None, False), (True, "missing field", True), (True, "missing field", True)]


def test_allocate_ids_whatever_the_plan_does(spark):
    """A million wide rows: no row lost, ids dense, the same under every way to coalesce partitions."""
    wide = spark.range(0, 1_000_000, 1, 16).select(
        ((F.col("id") * 7919) % 1_000_003 * 37 - 10_000_000).alias("Seq"),
        F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("a"), (F.col("id") * 2).alias("b"))
    keys = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k, None) for k in keys}
    seen = set()
    try:
        for values in (("true", "64k", "64"), ("true", "64m", "64"), ("false", "1m", "11")):
            for k, v in zip(keys, values):
                spark.conf.set(k, v)
            out = R.allocate_ids(wide, "Seq", F.lit(10), "NewID")
            seen.add(tuple(out.agg(F.count("a"), F.min("NewID"), F.max("NewID"), F.count_distinct("NewID"),
                                   F.sum(F.xxhash64("Seq", "b", "NewID").cast("decimal(38,0)"))).first()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(seen) == 1 and next(iter(seen))[:4] == (1_000_000, 11, 1_000_010, 1_000_000)


def test_first_k_per_group_hot_key(spark):
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, F.lit(1)).otherwise(F.col("id") % 7)
                                     .alias("k"), (F.col("id") * 100).alias("seq"))
    got = R.first_k_per_group(df, ["k"], "seq", 3)
    hot = sorted((r.seq, r._rank) for r in got.filter("k = 1").collect())
    assert hot == [(0, 1), (100, 2), (200, 3)]


def test_update_null_condition_keeps_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    cond = F.when(F.col("id") == 1, F.lit(True))  # NULL for id 2
    assert sorted(R.rewrite_update(df, cond, {"s": "z"}).collect()) == [(1, "z"), (2, "b")]
    assert R.rewrite_delete(df, cond).collect() == [(2, "b")]


def test_month_filter_rollover(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 12, 31, 23, 59, 59),), (dt.datetime(2026, 1, 1),),
                                (dt.datetime(2026, 1, 31, 23, 59, 59),), (dt.datetime(2026, 2, 1),)],
                               "ts timestamp_ntz")
    got = [r.ts for r in df.filter(P.in_month("ts", "2026-01")).collect()]
    assert got == [dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 31, 23, 59, 59)]
    dec = [r.ts for r in df.filter(P.in_month("ts", "2025-12")).collect()]
    assert dec == [dt.datetime(2025, 12, 31, 23, 59, 59)]  # year roll-over: upper bound is 2026-01-01


def test_contains_is_literal_and_case_insensitive(spark):
    df = spark.createDataFrame([("A%B",), ("axb",), ("a_b",)], "s string")
    assert [r.s for r in df.filter(P.contains_ci("s", "a%")).collect()] == ["A%B"]
    assert [r.s for r in df.filter(P.contains_ci("s", "_")).collect()] == ["a_b"]


def test_seat_tokens_and_parsing(spark):
    df = spark.createDataFrame([(" 3-2 ",), ("x",), ("4",)], "tok string")
    got = [(r[0], r[1]) for r in df.select(FS.seat_token_line("tok"), FS.seat_token_col("tok")).collect()]
    assert got == [(3, 2), (None, None), (4, None)]
    d = spark.createDataFrame([("2026-01-02 03:04",), ("2026-01-02",), ("junk",)], "s string")
    out = [r[0] for r in d.select(FS.format_datetime("s", "dd/MM/yyyy HH:mm")).collect()]
    assert out == ["02/01/2026 03:04", "02/01/2026 00:00", "junk"]


def test_seat_map_matrix(t):
    m = {(r.FlightID, r.ClassType): r.Seats for r in inv.seat_map(t).collect()}
    assert m[(10, "Regular")] == [[False, False]]
    assert m[(11, "Business")] == [[False, False]]
    assert m[(15, "Regular")] == [[True, True], [True, False]]


def test_assignability_branches(t):
    got = {(r.CandidateID, r.PilotID) for r in assign.assignable_resources(t, "pilots").collect()}
    # 100 last landed at AAA (flight 11 BBB->AAA) before the late candidate leaves BBB? no: needs source BBB.
    # 101 last leg is flight 11 too (ends AAA). 102 never flew -> free for both (qualified).
    assert ("late", 102) in got and ("long", 102) in got
    assert ("long", 101) not in got  # not qualified for a long flight
    # 100's latest leg ends at AAA and the long candidate leaves AAA later -> branch (b)
    assert ("long", 100) in got


def test_feasibility_counts_match_listing(t):
    f = {r.CandidateID: r for r in assign.staffing_feasibility(t).collect()}
    for kind, col in (("pilots", "AvailablePilots"), ("attendants", "AvailableAttendants"),
                      ("planes", "AvailablePlanes")):
        listed = assign.assignable_resources(t, kind).groupBy("CandidateID").count().collect()
        for r in listed:
            assert getattr(f[r.CandidateID], col) == r["count"]


def test_chain_continuity(t):
    got = {r.FlightID: r.PrevDestination for r in assign.chain_continuity(t).collect()}
    # plane 1 non-deleted legs in time order: 11 (BBB->AAA), 16 (AAA->BBB), 17 (BBB->CCC), 18 (CCC->BBB)
    assert 16 not in got and 17 not in got and 18 not in got
    # plane 3: 14 (CCC->AAA) then 15 (AAA->CCC): continuous
    assert 15 not in got


def test_reports_small(t):
    r4 = {r.Order_Month: (r.Total_Orders, r.Cancelled_Orders, r.Cancellation_Rate_Percent)
          for r in reports.report_cancellation_rate(t).collect()}
    assert r4["2026-10"] == (4, 1, 25.0)
    s = reports.report_summary(t).collect()[0]
    assert s.total_flights == 8 and s.active_orders == 7 and s.fleet_size == 4
    # revenue: every non-system-cancelled order with a price, 5 % for customer-cancelled
    assert s.total_revenue == pytest.approx(100 + 100 + 5.5 + 275 + 6 + 130 + 130 + 150 + 160)


def test_ingest_phones_limit_and_trim(t, spark):
    batch = spark.createDataFrame(
        [(i, "a@x", f" 06{i:02d} ", True) for i in range(12)] + [(99, "a@x", "0501", True), (100, "a@x", "   ", True)],
        "Seq long, Email string, Phone string, IsSignedUp boolean")
    out = {r.Seq: r.RejectReason for r in ingest.ingest_phones(t, batch).collect()}
    assert out[99] == "exists" and out[100] == "empty phone"
    accepted = sorted(k for k, v in out.items() if v is None)
    assert accepted == list(range(8))  # 2 stored + 8 new = 10
    assert all(out[i] == "too many phones" for i in range(8, 12))


def test_ingest_orders_ids_and_reasons(t, spark):
    batch = spark.createDataFrame([(1, "a@x", 16, "Regular"), (2, "m@x", 16, "Regular"), (3, "z@x", 10, "Regular"),
                                   (4, "z@x", 12, "Regular"), (5, "z@x", 17, "Business"), (6, "z@x", 99, "Regular"),
                                   (7, "z@x", 17, "Regular")],
                                  "Seq long, Email string, FlightID long, ClassType string")
    out = {r.Seq: r for r in ingest.ingest_orders(t, batch, AS_OF).collect()}
    assert out[2].RejectReason == "manager email" and out[3].RejectReason == "flight departed"
    assert out[4].RejectReason == "flight deleted" and out[5].RejectReason == "class not offered"
    assert out[6].RejectReason == "unknown flight"
    assert (out[1].OrderID, out[1].CustomerKind) == (21, "customer")
    assert (out[7].OrderID, out[7].CustomerKind) == (22, "guest")


def test_check_keys_flags_duplicates(t, spark):
    bad = Tables(t)
    bad["flights"] = t.flights.unionByName(t.flights.filter("FlightID = 10"))
    res = {(r.TableName, r.CheckName): r.Violations for r in ingest.check_keys(bad).collect()}
    assert res[("flights", "primary key")] == 1
    assert res[("orders", "primary key")] == 0


def test_feasibility_counts_equal_the_listing(t):
    listed = {}
    for kind in ("planes", "pilots", "attendants"):
        for r in assign.assignable_resources(t, kind).collect():
            listed.setdefault((r.CandidateID, kind), set()).add(r[1])
    for r in assign.staffing_feasibility(t).collect():
        assert (r.AvailablePlanes, r.AvailablePilots, r.AvailableAttendants) == tuple(
            len(listed.get((r.CandidateID, kind), ())) for kind in ("planes", "pilots", "attendants"))


def test_a_class_without_a_column_is_an_error(t, spark):
    t2 = Tables(t)
    t2["cabins"] = t.cabins.unionByName(spark.createDataFrame([("First", 1, 1, 1)], S.CABINS))
    t2["prices"] = t.prices.unionByName(spark.createDataFrame([("First", 11, 1, 900.0)], S.PRICES))
    for query in (inv.class_price_pivot(t2, 0), inv.flight_search(t2, AS_OF)):
        with pytest.raises(Exception, match="class without a price column"):
            query.collect()
    three = inv.flight_search(t2, AS_OF, classes=("Business", "First", "Regular"))
    assert {r.FlightID: r.First_price for r in three.collect()}[11] == 900.0


def test_ingest_customers_rules(t, spark):
    batch = spark.createDataFrame([
        (1, "a@x", "A", "A", 5, dt.date(1990, 1, 1), dt.date(2026, 1, 1), True),    # already registered
        (2, "m@x", "M", "M", 6, dt.date(1990, 1, 1), dt.date(2026, 1, 1), True),    # manager email
        (3, "n@x", "N", "N", None, dt.date(1990, 1, 1), dt.date(2026, 1, 1), True),  # missing passport
        (4, "n@x", "N", "N", 7, dt.date(1990, 1, 1), dt.date(2026, 1, 1), True),    # first valid row wins
        (5, "n@x", "N", "N", 8, dt.date(1990, 1, 1), dt.date(2026, 1, 1), True),    # duplicate
        (6, "a@x", "A", "A", None, None, None, False),                                # guest with a customer's email: ok
        (7, "b@x", "B", "B", None, None, None, False),                                # existing guest
    ], "Seq long, Email string, EngFirstName string, EngLastName string, PassportNumber long, Birthdate date, "
       "SignUpDate date, IsSignedUp boolean")
    out = {r.Seq: r.RejectReason for r in ingest.ingest_customers(t, batch).collect()}
    assert out == {1: "exists", 2: "manager email", 3: "missing field", 4: None, 5: "duplicate in batch",
                   6: None, 7: "exists"}


def test_ingest_order_seats_rules(t, spark):
    batch = spark.createDataFrame([
        (1, "customer", 8, "1-1"),    # free seat on flight 15
        (2, "customer", 8, "2-2"),    # taken by order 8 itself (live)
        (3, "customer", 8, "3-1"),    # row outside the cabin
        (4, "guest", 8, "1-1"),       # no such order (kind differs)
        (5, "customer", 8, " 1-2 "),  # free, trimmed
        (6, "customer", 8, "1-2"),    # same seat twice in the batch
        (7, "customer", 8, "x"),      # unparsable
    ], "Seq long, CustomerKind string, OrderID long, SeatToken string")
    out = {r.Seq: r.RejectReason for r in ingest.ingest_order_seats(t, batch).collect()}
    assert out == {1: None, 2: "seat taken", 3: "no such seat", 4: "unknown order", 5: None,
                   6: "seat requested twice", 7: "no such seat"}


def test_ingest_planes_sizes_and_cabins(t, spark):
    batch = spark.createDataFrame([
        (1, 9, "Airbus", dt.date(2026, 1, 1), 10, 4, 2, 2),   # both classes -> Large
        (2, 10, "Airbus", dt.date(2026, 1, 1), 10, 4, 0, 2),  # Business dropped -> Small
        (3, 11, "Airbus", dt.date(2026, 1, 1), 0, 4, 0, 2),   # no cabin
        (4, 1, "Boeing", dt.date(2026, 1, 1), 1, 1, 0, 0),    # existing plane
    ], "Seq long, PlainID long, Manufacturer string, PurchaseDate date, RegularRows int, RegularCols int, "
       "BusinessRows int, BusinessCols int")
    planes, cabins = ingest.ingest_planes(t, batch)
    p = {r.Seq: (r.RejectReason, r.Size) for r in planes.collect()}
    assert p[1] == (None, "Large") and p[2] == (None, "Small")
    assert p[3][0] == "no cabin" and p[4][0] == "exists"
    assert sorted(tuple(r) for r in cabins.collect()) == [("Business", 9, 2, 2), ("Regular", 9, 10, 4),
                                                          ("Regular", 10, 10, 4)]


def test_ingest_flights_rules_and_ids(t, spark):
    batch = spark.createDataFrame([
        (1, 1, dt.datetime(2026, 12, 2, 9), "AAA", "BBB"),   # next day: accepted
        (2, 1, dt.datetime(2026, 12, 1, 23), "AAA", "BBB"),  # same day as as_of: not in the future
        (3, 1, dt.datetime(2027, 1, 1), "AAA", "AAA"),       # same field
        (4, 1, dt.datetime(2027, 1, 1), "AAA", "DDD"),       # no route
        (5, 77, dt.datetime(2027, 1, 1), "AAA", "BBB"),      # unknown plane
        (6, 2, dt.datetime(2027, 1, 1), "BBB", "CCC"),       # accepted
    ], "Seq long, PlainID long, TakeOffTime timestamp_ntz, SourceField string, DestinationField string")
    out = {r.Seq: (r.RejectReason, r.FlightID) for r in ingest.ingest_flights(t, batch, AS_OF, False).collect()}
    assert out == {1: (None, 19), 2: ("not in the future", None), 3: ("same field", None),
                   4: ("no route", None), 5: ("unknown plane", None), 6: (None, 20)}


@pytest.fixture(scope="module")
def staffed(t, spark):
    """The bundle with a crew that has never flown: enough for a Large plane."""
    out = Tables(t)
    out["pilots"] = t.pilots.unionByName(crew_df(spark, "PilotID", [(900 + i, "P", "N", True) for i in range(3)]))
    out["attendants"] = t.attendants.unionByName(
        crew_df(spark, "AttendantID", [(950 + i, "A", "N", True) for i in range(6)]))
    return out


def test_ingest_flights_staffing(staffed, spark):
    day = dt.datetime(2027, 2, 1, 8)
    batch = spark.createDataFrame([
        (1, 3, day, "BBB", "AAA"),                             # plane 3 ended in CCC
        (2, 1, day, "BBB", "AAA"),                             # plane 1 ended in BBB: accepted
        (3, 1, day + dt.timedelta(days=9), "BBB", "AAA"),      # the same plane again
        (4, 2, day, "BBB", "CCC"),                             # plane 2 ended in BBB too: accepted
    ], "Seq long, PlainID long, TakeOffTime timestamp_ntz, SourceField string, DestinationField string")
    out = {r.Seq: (r.RejectReason, r.FlightID) for r in ingest.ingest_flights(staffed, batch, AS_OF).collect()}
    assert out == {1: ("plane not available", None), 2: (None, 19), 3: ("plane used twice in batch", None), 4: (None, 20)}


def test_ingest_crew_assignments(staffed, spark):
    new = list(range(950, 956))
    batch = spark.createDataFrame([(11, [900, 901, 902], new), (14, [900, 998], new[:3]), (404, [901], new[:1])],
                                  "FlightID long, PilotIDs array<long>, AttendantIDs array<long>")
    out = {(r.FlightID, r.EmployeeID, r.Role): r.RejectReason
           for r in ingest.ingest_crew_assignments(staffed, batch).collect()}
    assert {out[11, e, "Pilot"] for e in (900, 901, 902)} == {None}
    assert {out[11, e, "Flight Attendant"] for e in new} == {None}
    assert out[14, 998, "Pilot"] == "no such employee in the role"
    assert out[14, 900, "Pilot"] == out[14, 950, "Flight Attendant"] == "crew short of requirement"
    assert out[404, 901, "Pilot"] == "unknown flight"
    two = spark.createDataFrame([(11, [900, 901, 902], new), (14, [900, 901, 902], new)], batch.schema)
    again = {(r.FlightID, r.EmployeeID): r.RejectReason for r in ingest.ingest_crew_assignments(staffed, two).collect()}
    assert again[11, 900] is None and again[14, 900] == "assigned twice in batch"


def test_ingest_prices_and_crew(t, spark):
    prices = spark.createDataFrame([(1, 18, "Regular", 99.0), (2, 18, "Business", 250.0), (3, 10, "Business", 1.0),
                                    (4, 10, "Regular", 5.0), (5, 18, "Regular", 98.0), (6, 18, "Business", -1.0),
                                    (7, 404, "Regular", 1.0)],
                                   "Seq long, FlightID long, ClassType string, Price double")
    out = {r.Seq: r.RejectReason for r in ingest.ingest_flight_prices(t, prices).collect()}
    assert out == {1: None, 2: None, 3: "class not on plane", 4: "exists", 5: "duplicate in batch",
                   6: "bad price", 7: "unknown flight"}
    crew = spark.createDataFrame([(1, 100, "Pilot", "X", "Y", True), (2, 300, "Flight Attendant", "X", "Y", False),
                                  (3, 300, "Pilot", "X", "Y", False), (4, 301, "Navigator", "X", "Y", True),
                                  (5, 200, "Pilot", "X", "Y", True)],
                                 "Seq long, EmployeeID long, Role string, FirstName string, LastName string, "
                                 "Qualified4LongFlights boolean")
    out = {r.Seq: r.RejectReason for r in ingest.ingest_crew(t, crew).collect()}
    assert out == {1: "id holds a role", 2: None, 3: "duplicate in batch", 4: "unknown role", 5: "id holds a role"}


def test_io_roundtrip_and_commit(t, spark):
    import tempfile
    from skyledger.sources import io
    root = tempfile.mkdtemp(prefix="tables-")
    stored = io.materialize(t, root, ["flights", "orders"])
    assert sorted(stored.flights.collect()) == sorted(t.flights.collect())
    versions = f"{root}/store"
    with pytest.raises(ValueError):
        io.read_version(spark, versions, "orders")
    assert io.append_rows(t.orders, versions, "orders") == 1
    assert io.append_rows(t.orders.limit(2), versions, "orders") == 2
    assert io.read_version(spark, versions, "orders").count() == t.orders.count() + 2
    now = Tables(t)
    now["orders"] = io.read_version(spark, versions, "orders", 1)
    assert io.commit_table(ords.complete_orders(now, AS_OF), versions, "orders") == 3
    done = io.read_version(spark, versions, "orders")
    assert sorted(done.collect()) == sorted(ords.complete_orders(t, AS_OF).collect())
    assert sorted(io.read_version(spark, versions, "orders", 1).collect()) == sorted(t.orders.collect())


def test_accepted_rows_join_the_table_and_the_next_batch_sees_them(t, spark):
    import tempfile
    from skyledger.sources import io
    root = tempfile.mkdtemp(prefix="store-")
    io.append_rows(t.orders, root, "orders")
    batch = lambda seq: spark.createDataFrame([(seq, "z@x", 16, "Regular")],
                                              "Seq long, Email string, FlightID long, ClassType string")
    ids = []
    for seq in (1, 2):
        now = Tables(t)
        now["orders"] = io.read_version(spark, root, "orders")
        new = ingest.accepted(ingest.ingest_orders(now, batch(seq), AS_OF))
        ids.append(new.first().OrderID)
        io.append_rows(new, root, "orders")
    assert ids == [21, 22] and io.read_version(spark, root, "orders").count() == t.orders.count() + 2


def test_load_normalises_the_seed_status(t, spark):
    import tempfile
    from skyledger.sources import io
    root = tempfile.mkdtemp(prefix="seed-")
    t.orders.withColumn("OrderStatus", F.lit("Completed")).write.parquet(f"{root}/orders")
    assert {r.OrderStatus for r in io.load_tables(spark, root, ["orders"]).orders.collect()} == {"Complete"}


def test_every_key_check_fires(t, spark):
    """A table bundle with one fault per check: a repeated row, NULLs everywhere, keys that lead nowhere."""
    broken = Tables()
    for name, schema in S.SCHEMAS.items():
        if name == "candidates":
            continue
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        value = lambda f: (S.KIND_CUSTOMER if f.name == "CustomerKind" else {
            "string": name + "?", "bigint": 9000 + len(name), "int": 3, "double": 1.0, "boolean": True,
            "date": dt.date(2020, 1, 1), "timestamp_ntz": dt.datetime(2020, 1, 1)}[f.dataType.simpleString()])
        row = tuple(value(f) for f in schema.fields)
        rows = [row, row, tuple(None for _ in row)]
        if name == "orders":
            rows.append(tuple(S.KIND_GUEST if f.name == "CustomerKind" else value(f) for f in schema.fields))
        broken[name] = spark.createDataFrame(rows, loose)
    found = {(r.TableName, r.CheckName, r.Columns): r.Violations for r in ingest.check_keys(broken).collect()}
    assert len(found) >= 60
    assert [k for k, v in found.items() if not v] == []


def test_ingest_bookings_all_or_nothing(t, spark):
    batch = spark.createDataFrame([
        (1, "z@x", 16, "Regular", ["1-1", "1-2"]),   # both seats free on flight 16 (plane 1, 2x2)
        (2, "z@x", 16, "Regular", ["2-1", "9-9"]),   # one bad seat -> whole booking refused
        (3, "z@x", 16, "Regular", ["1-1"]),          # seat requested by booking 1 already
        (4, "z@x", 10, "Regular", ["1-1"]),          # flight departed
        (5, "z@x", 17, "Regular", []),               # no seats
    ], "Seq long, Email string, FlightID long, ClassType string, SeatTokens array<string>")
    out, seats = ingest.ingest_bookings(t, batch, AS_OF)
    r = {x.Seq: (x.RejectReason, x.OrderID) for x in out.collect()}
    assert r[1][0] is None and r[2][0] == "no such seat" and r[3][0] == "seat requested twice"
    assert r[4] == ("flight departed", None) and r[5][0] == "no seats"
    got = sorted((x.OrderID, x.Line, x.SeatLetter) for x in seats.collect())
    assert got == [(r[1][1], 1, 1), (r[1][1], 1, 2)]


def test_refused_bookings_hold_no_seats_and_no_ids(t, spark):
    batch = spark.createDataFrame([
        (1, "z@x", 11, "Regular", ["1-1"]),          # flight departed
        (2, "z@x", 16, "Regular", ["1-1", "9-9"]),   # no such seat
        (3, "z@x", 16, "Regular", ["1-1", "1-2"]),   # accepted
        (4, "z@x", 16, "Regular", ["1-2", "2-1"]),   # shares 1-2 with booking 3
        (5, "z@x", 16, "Regular", ["2-1"]),          # booking 4 holds nothing: accepted
        (6, "z@x", 16, "Regular", ["2-2", "2-2"]),   # twice in one booking
        (7, "z@x", 16, "Regular", ["2-2"]),          # accepted
        (8, "z@x", 16, "Regular", None),             # no seats
    ], "Seq long, Email string, FlightID long, ClassType string, SeatTokens array<string>")
    out, seats = ingest.ingest_bookings(t, batch, AS_OF)
    got = {r.Seq: (r.RejectReason, r.OrderID) for r in out.collect()}
    assert got == {1: ("flight departed", None), 2: ("no such seat", None), 3: (None, 21),
                   4: ("seat requested twice", None), 5: (None, 22), 6: ("seat requested twice", None),
                   7: (None, 23), 8: ("no seats", None)}
    assert sorted((s.OrderID, s.Line, s.SeatLetter) for s in seats.collect()) == [
        (21, 1, 1), (21, 1, 2), (22, 2, 1), (23, 2, 2)]


def test_search_num_seats_and_status_spelling(t):
    ids = lambda df: sorted(r.FlightID for r in df.collect())
    assert ids(inv.flight_search(t, AS_OF, status="full_capacity")) == [10]
    assert ids(inv.flight_search(t, AS_OF, status="cancelled")) == [12]
    five = {r.FlightID: (r.Business_price, r.Regular_price) for r in inv.flight_search(t, AS_OF, num_seats=4).collect()}
    assert 11 in five and five[11] == (None, 110.0)       # Regular still has 4 free seats, Business has none
    assert 10 not in five and 13 not in five               # nothing left with 4 free seats
    one = {r.FlightID: (r.TotalSeats, r.BookedSeats) for r in inv.flight_search(t, AS_OF, flight_id=11).collect()}
    assert one == {11: (6, 2)}                              # cancelled order 3 does not hold its seat


def test_ingest_missing_fields(t, spark):
    orders = spark.createDataFrame([(1, None, 16, "Regular"), (2, "z@x", None, "Regular")],
                                   "Seq long, Email string, FlightID long, ClassType string")
    assert {r.RejectReason for r in ingest.ingest_orders(t, orders, AS_OF).collect()} == {"missing field"}
    phones = spark.createDataFrame([(1, None, "0599", True), (2, None, "0599", True)],
                                   "Seq long, Email string, Phone string, IsSignedUp boolean")
    assert {r.RejectReason for r in ingest.ingest_phones(t, phones).collect()} == {"missing field"}
    seats = spark.createDataFrame([(1, "customer", 8, None)], "Seq long, CustomerKind string, OrderID long, SeatToken string")
    assert [r.RejectReason for r in ingest.ingest_order_seats(t, seats).collect()] == ["missing field"]
    fl = spark.createDataFrame([(1, 1, None, "AAA", "BBB")],
                               "Seq long, PlainID long, TakeOffTime timestamp_ntz, SourceField string, DestinationField string")
    assert [r.RejectReason for r in ingest.ingest_flights(t, fl, AS_OF).collect()] == ["missing field"]


def test_crew_assignments_meet_flights_as_requests(staffed, spark):
    batch = spark.createDataFrame([(1, [1, 1, 2], [3]), (1, [2], None), (None, [1], [])],
                                  "FlightID long, PilotIDs array<long>, AttendantIDs array<long>")
    result = ingest.ingest_crew_assignments(staffed, batch)
    # a flight listed twice meets both requests; a person listed twice in one counts once
    assert result.where("FlightID = 1").count() == 2 * 4 and result.where("FlightID IS NULL").count() == 1
    # the crews are listed only after the request has met its flight
    assert "inline(_crew" in result._jdf.queryExecution().optimizedPlan().toString()
