"""Versioned tables under concurrent writers, partial rewrites, typed loading, caseless addresses, classes of the data."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_SF
from skyledger import schemas as S
from skyledger.operators import assign, ingest, inventory, orders
from skyledger.plans import batches
from skyledger.sources import io
from skyledger.sources.views import Tables, airline_views

AS_OF = dt.datetime(2000, 1, 1)
ORDER = "OrderID long, CustomerKind string, OrderStatus string, OrderDate date, Email string, PlainID long, ClassType string, FlightID long"


def order(i, status="Active", flight=1, day=dt.date(1999, 5, 1)):
    return (i, "guest", status, day, f"g{i}@x", 1, "Regular", flight)


@pytest.fixture()
def stored(spark, tmp_path):
    """Orders of three years in a file set each; flight 1 has left, flight 2 has not."""
    flights = spark.createDataFrame([(1, 1, dt.datetime(1999, 6, 1), "A", "B", False), (2, 1, dt.datetime(2001, 6, 1), "A", "B", False)],
                                    S.SCHEMAS["flights"])
    rows = [order(1), order(2, flight=2, day=dt.date(2000, 1, 1)), order(3, "Complete", day=dt.date(1998, 1, 1)),
            order(4, "Customer_Cancelled"), order(5, flight=2, day=dt.date(1998, 2, 1))]
    root = str(tmp_path / "store")
    io.commit_table(spark.createDataFrame(rows, ORDER), root, "orders", split_by="year(OrderDate)")
    io.commit_table(flights, root, "flights")
    return root, Tables(flights=flights, orders=spark.createDataFrame(rows, ORDER))


def labels(parts):
    return [p.rpartition("=")[2] for p in parts]


def test_only_file_sets_with_changed_rows_are_rewritten(spark, stored):
    root, t = stored
    first = io.version_parts(spark, root, "orders")
    assert labels(first) == ["1998", "1999", "2000"]
    assert orders.complete_orders_stored(t, spark, root, AS_OF) == 2
    second = io.version_parts(spark, root, "orders")
    assert labels(second) == labels(first)
    assert [a == b for a, b in zip(first, second)] == [True, False, True]
    want = sorted(map(tuple, orders.complete_orders(t, AS_OF).select(*S.SCHEMAS["orders"].names).collect()))
    assert sorted(map(tuple, io.read_version(spark, root, "orders").collect())) == want
    assert orders.complete_orders_stored(t, spark, root, AS_OF) == 2  # nothing left to change: no new version
    assert sorted(map(tuple, io.read_version(spark, root, "orders", 1).collect())) == sorted(
        map(tuple, t.orders.select(*S.SCHEMAS["orders"].names).collect()))


def test_cancellations_on_stored_tables(spark, stored):
    root, t = stored
    asked = spark.createDataFrame([("guest", 5), ("guest", 4), ("guest", 99)], "CustomerKind string, OrderID long")
    before = io.version_parts(spark, root, "orders")
    orders.cancel_orders_stored(t, spark, root, asked)
    after = io.version_parts(spark, root, "orders")
    assert [a == b for a, b in zip(before, after)] == [False, True, True]  # order 4 is cancelled already
    ids = spark.createDataFrame([(2,), (77,)], "FlightID long")
    assert orders.cancel_flights_stored(t, spark, root, ids) == (2, 3)
    got = {r.OrderID: r.OrderStatus for r in io.read_version(spark, root, "orders").collect()}
    assert got == {1: "Active", 2: "System_Cancelled", 3: "Complete", 4: "Customer_Cancelled", 5: "System_Cancelled"}
    assert {r.FlightID: r.IsDeleted for r in io.read_version(spark, root, "flights").collect()} == {1: False, 2: True}
    gone = io.remove_unreferenced(spark, root, "orders")
    assert len(gone) == 3 and len(labels(gone)) == 3  # 1998 twice, 2000 once
    assert io.read_version(spark, root, "orders").count() == 5
    assert io.remove_unreferenced(spark, root, "orders") == []


def test_two_writers_at_once_and_a_repeated_batch(spark, tmp_path):
    root = str(tmp_path / "store")
    batch = lambda i: spark.createDataFrame([order(10 * i), order(10 * i + 1)], ORDER)
    with ThreadPoolExecutor(4) as pool:
        versions = sorted(pool.map(lambda i: io.append_rows(batch(i), root, "orders", batch=f"b{i}"), range(4)))
    assert versions == [1, 2, 3, 4]
    assert sorted(r.OrderID for r in io.read_version(spark, root, "orders").collect()) == [0, 1, 10, 11, 20, 21, 30, 31]
    assert io.append_rows(batch(2), root, "orders", batch="b2") in versions  # the batch comes again: nothing is added
    assert io.read_version(spark, root, "orders").count() == 8
    assert io.append_rows(batch(2), root, "orders") == 5  # without a token it is another batch
    assert io.read_version(spark, root, "orders").count() == 10


def test_a_batch_sent_twice_at_once_is_added_once(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([order(1), order(2)], ORDER)
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda _: io.append_rows(rows, root, "orders", batch="same"), range(2)))
    assert got == [1, 1]
    assert io.read_version(spark, root, "orders").count() == 2
    assert len(io.remove_unreferenced(spark, root, "orders")) <= 1  # what the slower writer left
    assert io.read_version(spark, root, "orders").count() == 2


def test_a_taken_version_is_refused(spark, tmp_path):
    root = str(tmp_path / "store")
    io.append_rows(spark.createDataFrame([order(1)], ORDER), root, "orders")
    with pytest.raises(io.VersionTaken):
        io._publish(spark, root, "orders", ["nowhere"], 1)
    assert io.read_version(spark, root, "orders").count() == 1


def test_typed_loading_with_rejects(spark, tmp_path):
    lines = ["FlightID,PlainID,TakeOffTime,SourceField,DestinationField,IsDeleted",
             "1,2,2000-01-01 10:00:00,A,B,false", '3,4,2000-02-01 00:00:00,"C, D",E,true', "5,x,2000-01-01 10:00:00,A,B,false",
             "6,2,2000-01-01 10:00:00", "7,2,2000-01-01 10:00:00,A,B,false,more", "8,2,2000-13-01 10:00:00,A,B,false",
             "9,2,2000-01-01 10:00:00,,B,false", "", "  "]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "flights.csv").write_text("\n".join(lines))
    rows, rejects = io.load_csv(spark, str(tmp_path / "in"), "flights", header=True)
    assert rows.columns == S.SCHEMAS["flights"].names
    assert sorted(map(tuple, rows.collect())) == [(1, 2, dt.datetime(2000, 1, 1, 10), "A", "B", False),
                                                  (3, 4, dt.datetime(2000, 2, 1), "C, D", "E", True)]
    assert {r.Line: r.RejectReason for r in rejects.collect()} == {
        **{line: "malformed" for line in lines[3:7]}, lines[7]: "missing field"}


def test_loading_all_tables(spark, tmp_path):
    t = airline_views(spark, SMALL_SF)
    for name in ("orders", "routes"):
        (t[name].withColumn("OrderStatus", F.regexp_replace("OrderStatus", "^Complete$", "Completed"))
         if name == "orders" else t[name]).select(*S.SCHEMAS[name].names).write.csv(str(tmp_path / name))
    tables, rejects = io.load_csv_tables(spark, str(tmp_path), ["orders", "routes"])
    for name in ("orders", "routes"):
        assert rejects[name].count() == 0
        assert sorted(map(tuple, tables[name].collect())) == sorted(map(tuple, t[name].select(*S.SCHEMAS[name].names).collect()))


def test_derived_tables_leave_no_view_behind(spark):
    before = {v.name for v in spark.catalog.listTables()}
    got = io.scan_derived(spark.range(5).toDF("n"), "few", "SELECT n FROM {few} WHERE n > 2")
    assert {v.name for v in spark.catalog.listTables()} == before
    assert sorted(r.n for r in got.collect()) == [3, 4]


# ---- one address, many spellings ---------------------------------------------------------

def test_addresses_in_any_case(spark):
    mails = lambda *m: spark.createDataFrame([(x,) for x in m], "Email string")
    t = Tables(customers=mails("Ann@X", "bob@x"), guests=mails("ANN@x", "eve@x"), managers=mails("Boss@x"))
    got = {r.Email: tuple(r)[1:] for r in orders.membership_flags(t, mails("ann@x", "ANN@X", "EVE@X", "boss@X", "no@x", None)).collect()}
    assert got == {"ann@x": (True, True, False), "ANN@X": (True, True, False), "EVE@X": (False, True, False),
                   "boss@X": (False, False, True), "no@x": (False, False, False), None: (False, False, False)}
    day = dt.date(1999, 1, 1)
    batch = spark.createDataFrame([(1, "BOB@x", True), (2, "New@x", True), (3, "NEW@X", True), (4, "new@x", False),
                                   (5, "BOSS@X", True), (6, "Eve@x", False)], "Seq long, Email string, IsSignedUp boolean")
    full = batch.selectExpr("Seq", "Email", "'a' EngFirstName", "'b' EngLastName", "1 PassportNumber",
                            f"date'{day}' Birthdate", f"date'{day}' SignUpDate", "IsSignedUp")
    reasons = {r.Seq: r.RejectReason for r in ingest.ingest_customers(t, full).collect()}
    assert reasons == {1: "exists", 2: None, 3: "duplicate in batch", 4: None, 5: "manager email", 6: "exists"}


# ---- classes of the data, classes of profiles -----------------------------------------------

def test_classes_found_at_run_time(spark):
    t = batches.with_first_class(airline_views(spark, SMALL_SF))
    assert inventory.class_list(t) == ["Business", "First", "Regular"]
    found = inventory.class_price_pivot(t, 0, None)
    assert found.columns == ["FlightID", "Business_price", "First_price", "Regular_price"]
    maps = {r.FlightID: r.Prices for r in inventory.class_price_map(t).collect()}
    assert {r.FlightID: {c[:-6]: r[c] for c in found.columns[1:] if r[c] is not None} for r in found.collect()} == maps
    assert {len(m) for m in maps.values()} == {1, 2, 3} or {len(m) for m in maps.values()} == {1, 3}
    with pytest.raises(ValueError):
        inventory.class_list(t, most=2)


def test_profiles_of_one_class_and_bins(spark):
    """Every class and candidate against the definition, with times on both sides of a bin's border."""
    at = lambda day, hour=0: dt.datetime(1999, 1, 1) + dt.timedelta(days=day, hours=hour)
    flights, shifts = [], []
    for i, day in enumerate((0, 1, 31, 32, 33, 63, 64, 65, 200)):
        flights.append((i, 100, at(day, 12), "A" if i % 2 else "B", "B" if i % 2 else "A", False))
        shifts.append((i % 7, i))
    shifts += [(20, 3), (21, 3), (99, 3)]  # 20 and 21 fly together; nobody knows 99
    pilots = spark.createDataFrame([(i, i % 2 == 0) for i in [*range(7), 20, 21, 30, 31, 32]], "PilotID long, Qualified4LongFlights boolean")
    routes = spark.createDataFrame([("A", "B", 3600), ("B", "A", 7 * 3600)], "SourceField string, DestinationField string, DurationSec int")
    t = Tables(flights=spark.createDataFrame(flights, S.SCHEMAS["flights"]), routes=routes, pilots=pilots,
               working_pilots=spark.createDataFrame(shifts, "PilotID long, FlightID long"))
    candidates = [(f"c{d}{h}{s}{int(q)}", s, "B" if s == "A" else "A", at(d, h), at(d, h + 3), q)
                  for d in (-3, 0, 1, 31, 32, 40, 64, 199, 200, 300) for h in (9, 13, 20) for s in "AB" for q in (True, False)]
    c = spark.createDataFrame(candidates, "CandidateID string, SourceField string, DestinationField string, "
                                          "TakeOffTime timestamp_ntz, LandingTime timestamp_ntz, IsLong boolean")
    legs = {}
    lasts = {"A": 1, "B": 7}
    for p, f in shifts:
        _, _, off, src, dst, _ = flights[f]
        legs.setdefault(p, []).append((off, src, off + dt.timedelta(hours=lasts[src]), dst))
    want = set()
    for cid, src, dst, off, land, long in candidates:
        for p, q in [(r.PilotID, r.Qualified4LongFlights) for r in pilots.collect()]:
            own = legs.get(p)
            ok = own is None
            if own:
                first, last = min(x[0] for x in own), max(x[2] for x in own)
                ok = (first > land and any(x[0] == first and x[1] == dst for x in own)
                      or last < off and any(x[2] == last and x[3] == src for x in own))
            if ok and (q or not long):
                want.add((cid, p))
    got = [tuple(r) for r in assign.assignable_resources(t, "pilots", c).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    members = {r.PilotID: r.ClassID for r in assign.class_members(t, "pilots").collect()}
    assert members[20][1:] == members[21][1:] and members[30] == members[32] == "q|free" and members[31] == "n|free"
    assert 99 not in members


def test_cancelled_flights_are_derived_once(spark, stored):
    root, t = stored
    io.commit_table(t.flights, root, "flights", split_by="year(TakeOffTime)")
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    ids = t.flights.select("FlightID").mapInArrow(count, "FlightID long")
    _, version = orders.cancel_flights_stored(t, spark, root, ids)
    found = io.read_version(spark, root, "orders", version).collect()
    assert {r.OrderStatus for r in found} == {S.ORDER_SYSTEM_CANCELLED} and len(found) == 5
    assert read.value == 2  # not once more for every file set
