"""Tables stored by month and what their scans read; seat bitmaps; key audits of successive versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SMALL_SF
from skyledger import schemas as S
from skyledger.operators import ingest, inventory, key_ledger, reports
from skyledger.sources import io
from skyledger.sources.views import Tables, airline_views


@pytest.fixture(scope="module")
def monthly(spark, tmp_path_factory):
    return io.save_by_month(airline_views(spark, SMALL_SF), str(tmp_path_factory.mktemp("months") / "tables"))


@pytest.fixture()
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def scans(df, column):
    """(files read, plan text) of the run scans of tables with a partition column."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "FileSourceScanExec" and column in p.toString():
            found.append((p.metrics().apply("numFiles").value(), p.toString()))
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_a_range_of_months_reads_those_partitions(spark, monthly, plain_plans):
    (n, plan), = scans(reports.report_cancellation_rate(monthly, "1997-01", "1997-03"), "OrderMonth")
    assert n == 3 and "PartitionFilters: [isnotnull(OrderMonth" in plan
    (every, _), = scans(reports.report_cancellation_rate(monthly), "OrderMonth")
    assert every > 50
    for n, plan in scans(reports.report_plane_activity(monthly, "1997-01", "1997-01"), "TakeOffMonth"):
        assert n == 1


def test_months_found_at_run_time_prune_the_scan(spark, monthly, plain_plans):
    rate = reports.report_cancellation_rate(monthly).where("Cancellation_Rate_Percent >= 30")
    months = rate.select(F.col("Order_Month").alias("Month"))
    found = scans(reports.report_plane_activity(monthly, months=months), "TakeOffMonth")
    few = months.count()
    assert len(found) == 2 and all(0 < n <= few and "dynamicpruning" in plan for n, plan in found)


def test_search_of_a_month_reads_its_partitions(spark, monthly, plain_plans):
    found = scans(inventory.flight_search(monthly, dt.datetime(2000, 1, 1), after_time=dt.datetime(1998, 2, 28, 23, 59, 59),
                                          before_time=dt.datetime(1998, 4, 1)), "TakeOffMonth")
    assert found and all(n <= 2 for n, _ in found)  # the open interval begins in the month before


def test_month_bounds_on_plain_and_stored_tables_agree(spark, monthly):
    plain = airline_views(spark, SMALL_SF)
    for a, b in [(None, "1993-02"), ("1998-06", None), ("1997-12", "1998-01"), ("1998-01", "1997-01")]:
        got = [sorted(map(tuple, reports.report_plane_activity(t, a, b).collect())) for t in (plain, monthly)]
        assert got[0] == got[1]
        assert all((a or "") <= r[2] <= (b or "9999") for r in got[0])


def test_seat_bitmaps_beyond_one_number(spark):
    t = Tables(
        prices=spark.createDataFrame([("Regular", 1, 7, 1.0), ("Business", 1, 7, 1.0), ("Empty", 1, 7, 1.0)], S.PRICES),
        cabins=spark.createDataFrame([("Regular", 7, 20, 8), ("Business", 7, 8, 8), ("Empty", 7, 0, 4)], S.CABINS),
        orders=spark.createDataFrame([(1, "guest", "Active", dt.date(2000, 1, 1), "g@x", 7, "Regular", 1),
                                      (2, "guest", "Active", dt.date(2000, 1, 1), "g@x", 7, "Business", 1),
                                      (3, "guest", "System_Cancelled", dt.date(2000, 1, 1), "g@x", 7, "Regular", 1)], S.ORDERS),
        seats=spark.createDataFrame([("guest", 1, 1, 1), ("guest", 1, 1, 1), ("guest", 1, 8, 8), ("guest", 1, 9, 1),
                                     ("guest", 1, 20, 8), ("guest", 1, 21, 1), ("guest", 1, 1, 9), ("guest", 1, 0, 3),
                                     ("guest", 2, 8, 8), ("guest", 3, 2, 2)], S.SEATS))
    got = {r.ClassType: (r.Taken, r.FreeSeats) for r in inventory.seat_bitmap(t).collect()}
    assert got == {"Regular": ([1 - 2**63, 1, 2**31], 156), "Business": ([-2**63], 63), "Empty": ([], 0)}
    seats = {r.ClassType: r.Seats for r in inventory.seat_map(t.__class__(t, cabins=t.cabins.where("NumberRows > 0"))).collect()}
    taken = [(i + 1, j + 1) for i, row in enumerate(seats["Regular"]) for j, free in enumerate(row) if not free]
    assert taken == [(1, 1), (8, 8), (9, 1), (20, 8)]
    assert sum(map(sum, seats["Business"])) == 63 and seats["Business"][7][7] is False


# ---- I11 over versions --------------------------------------------------------------

NAMES = ["planes", "cabins", "flights"]


def rows_of(df):
    return sorted((r.TableName, r.CheckName, r.Columns, r.Violations) for r in df.collect())


def full(spark, root, names):
    return rows_of(ingest.check_keys(Tables({n: io.read_version(spark, root, n) for n in names})))


def plane(i):
    return i, "Boeing", "Large", dt.date(1990, 1, 1)


def flight(i, plane=1, source="A"):
    return i, plane, dt.datetime(2000, 1, 1), source, "B", False


def loose(spark, table, rows):
    """Rows that break the schema's NOT NULL."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in S.SCHEMAS[table].fields]
    return spark.createDataFrame(rows, ", ".join(fields))


@pytest.fixture()
def store(spark, tmp_path):
    root = str(tmp_path / "store")
    io.append_rows(loose(spark, "planes", [plane(1), plane(1), plane(2)]), root, "planes")
    io.append_rows(loose(spark, "cabins", [("Regular", 1, 2, 2), ("Regular", 9, 2, 2)]), root, "cabins")
    io.append_rows(loose(spark, "flights", [flight(1), flight(2, plane=3), flight(None), flight(None, None)]), root, "flights")
    return root


def test_audits_of_successive_versions_equal_the_full_one(spark, store):
    add = lambda name, *rows: io.append_rows(loose(spark, name, list(rows)), store, name)
    first = rows_of(key_ledger.audit(spark, store, NAMES))
    assert first == full(spark, store, NAMES)
    assert ("flights", "foreign key -> planes", "PlainID", 2) in first and ("planes", "primary key", "PlainID", 1) in first
    steps = [lambda: add("planes", plane(3)),                                 # an orphan finds its parent
             lambda: add("flights", flight(1), flight(5, plane=8), flight(6, source=None)),
             lambda: (add("planes", plane(3), plane(9)), add("cabins", ("Regular", 1, 5, 5))),
             lambda: io.rewrite_rows(spark, store, "planes", change=lambda p: p.where("PlainID <> 1"),
                                     hit=lambda p: p.where("PlainID = 1")),   # parents go, a repeated key too
             lambda: io.commit_table(loose(spark, "flights", []), store, "flights")]
    for step in steps:
        step()
        assert rows_of(key_ledger.audit(spark, store, NAMES)) == full(spark, store, NAMES)
    assert rows_of(key_ledger.audit(spark, store, NAMES[:1])) == full(spark, store, NAMES[:1])  # other tables: afresh


def test_an_audit_reads_changed_file_sets_only(spark, store, monkeypatch):
    key_ledger.audit(spark, store, NAMES)
    read = []
    seen = key_ledger._touched
    monkeypatch.setattr(key_ledger, "_touched", lambda s, changes, tables: read.append(changes) or seen(s, changes, tables))
    key_ledger.audit(spark, store, NAMES)
    assert read == []  # nothing changed
    io.append_rows(loose(spark, "flights", [flight(7)]), store, "flights")
    key_ledger.audit(spark, store, NAMES)
    new = io.version_parts(spark, store, "flights")[-1]
    assert read == [{"planes": ([], []), "cabins": ([], []), "flights": ([new], [])}]


def test_an_audit_after_file_sets_were_removed_starts_afresh(spark, store):
    key_ledger.audit(spark, store, NAMES)
    io.commit_table(loose(spark, "planes", [plane(4)]), store, "planes")
    io.remove_unreferenced(spark, store, "planes")
    assert rows_of(key_ledger.audit(spark, store, NAMES)) == full(spark, store, NAMES)


def test_ledgers_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(key_ledger, "MERGE_AFTER", 2)
    for i in range(4):
        io.append_rows(loose(spark, "flights", [flight(1, plane=20 + i)]), store, "flights")
        io.append_rows(loose(spark, "planes", [plane(20 + i - 1)]), store, "planes")
        assert rows_of(key_ledger.audit(spark, store, NAMES)) == full(spark, store, NAMES)
        assert len(io.version_parts(spark, store, key_ledger.LEDGER)) <= 2


def test_audit_without_a_version_is_refused(spark, store):
    with pytest.raises(ValueError):
        key_ledger.audit(spark, store, [*NAMES, "orders"])
