"""Plan-shape guards for every registered query (scale properties, not values)."""

import pytest

from conftest import SMALL_SF

from skyledger.plans import catalog
from skyledger.plans.catalog import QUERIES
from skyledger.sources.views import airline_views

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas")


# Operators that settle their batch in stored rounds, or store it once, before the result is read.
STORING = {"load_csv_rows", "load_csv_rejects", "append_rows", "complete_orders_stored", "complete_orders_file_sets",
           "cancel_flights_stored", "report_cancellation_rate_months", "report_plane_activity_months",
           "flight_search_by_month", "check_keys_versions", "ingest_bookings", "ingest_booking_seats", "ingest_bookings_contended", "ingest_flights_staffed"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_no_python_no_job(spark, name):
    sc = spark.sparkContext
    sc.setJobGroup(f"building {name}", name)
    df = QUERIES[name](spark, SMALL_SF)
    jobs = sc.statusTracker().getJobIdsForGroup(f"building {name}")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert name in STORING or not jobs, name
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in FORBIDDEN if k in plan], name


def _without_broadcasts(spark, build):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        return build()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_selected_seats_meet_their_orders_before_they_are_counted(spark, tmp_path):
    from skyledger.operators.inventory import _live_seat_counts
    from skyledger.sources.io import materialize
    from skyledger.sources.views import airline_views
    t = materialize(airline_views(spark, SMALL_SF), str(tmp_path / "tables"), ["flights", "orders", "seats"])
    chosen = t.flights.filter("FlightID = 7").select("FlightID")
    plan = _without_broadcasts(spark, lambda: _live_seat_counts(t, chosen))
    assert plan.index("HashAggregate") < plan.index("Join") and "HashAggregate" not in plan[plan.index("Join"):]


@pytest.mark.parametrize("name,most", [("ingest_phones", 10), ("ingest_customers", 8), ("ingest_crew", 8),
                                       ("staffing_feasibility", 20)])
def test_shuffles_of_stored_tables(spark, tmp_path_factory, name, most):
    from skyledger.plans.catalog import OPS
    from skyledger.sources.io import materialize_views
    root = tmp_path_factory.getbasetemp() / "stored"
    if not root.exists():
        _STORED["t"] = materialize_views(spark, SMALL_SF, str(root))
    plan = _without_broadcasts(spark, lambda: OPS[name](_STORED["t"], spark, SMALL_SF))
    assert plan.count("Exchange hashpartitioning") <= most, plan.count("Exchange hashpartitioning")


_STORED: dict = {}


def test_month_filter_reaches_scan(spark, tmp_path):
    import datetime as dt
    from skyledger.functions.scalar import month_bounds
    from skyledger.operators.inventory import flight_search
    from skyledger.sources.io import materialize
    from skyledger.sources.views import airline_views
    t = materialize(airline_views(spark, SMALL_SF), str(tmp_path / "tables"), ["flights", "orders", "seats",
                                                                              "prices", "cabins", "routes"])
    lo, hi = month_bounds("1998-03")
    df = flight_search(t, dt.datetime(2000, 1, 1), before_time=hi, after_time=lo)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(TakeOffTime" in plan and "GreaterThan(TakeOffTime" in plan


def test_bucketed_layout_same_rows_fewer_shuffles(spark, tmp_path):
    from skyledger.plans.catalog import OPS
    from skyledger.sources.io import materialize_views
    plain = materialize_views(spark, SMALL_SF, str(tmp_path / "plain"))
    buck = materialize_views(spark, SMALL_SF, str(tmp_path / "bucketed"), buckets=4)
    for n in ("complete_orders", "order_history", "crew_requirement"):
        assert sorted(OPS[n](plain, spark, SMALL_SF).collect()) == sorted(OPS[n](buck, spark, SMALL_SF).collect())
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        plan = OPS["complete_orders"](buck, spark, SMALL_SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan   # orders ⋈ flights read co-bucketed files
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _exchanges_above(plan, table):
    """Hash exchanges between the scan of a stored table and the next join or aggregate above it."""
    found, todo = [], [(plan, [])]
    while todo:
        p, path = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "FileSourceScanExec" and f"/{table}" in p.metadata().toString():
            up = path[::-1]
            stop = next((i for i, k in enumerate(up) if "Join" in k or "Aggregate" in k), len(up))
            found.append([k for k in up[:stop] if k == "ShuffleExchangeExec"])
        todo += [(p.children().apply(i), [*path, kind]) for i in range(p.children().size())]
    return found


def test_a_selective_search_shuffles_no_seats(spark, tmp_path):
    from skyledger.plans.catalog import OPS
    from skyledger.sources.io import materialize_views
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    plain = materialize_views(spark, SMALL_SF, str(tmp_path / "plain"))
    stored = materialize_views(spark, SMALL_SF, str(tmp_path / "bucketed"), buckets=4)
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], "-1")
        spark.conf.set(keys[1], "false")
        for name in ("flight_search_filtered", "flight_search"):
            plan = OPS[name](stored, spark, SMALL_SF)._jdf.queryExecution().executedPlan()
            found = _exchanges_above(plan, "seats")
            assert found and not any(found), name
        plan = OPS["flight_search_filtered"](plain, spark, SMALL_SF)._jdf.queryExecution().executedPlan()
        assert all(_exchanges_above(plan, "seats"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows = [sorted(map(str, OPS["flight_search_filtered"](t, spark, SMALL_SF).collect())) for t in (plain, stored)]
    assert rows[0] and rows[0] == rows[1]


def test_stored_queries_derive_their_intermediates_once(spark):
    t = catalog._derived_once(airline_views(spark, SMALL_SF), spark, SMALL_SF)
    for name in ("flights", "orders"):
        files = t[name].inputFiles()
        assert files and all("-ext" in f for f in files)
        assert sorted(map(str, t[name].collect())) == sorted(map(str, airline_views(spark, SMALL_SF)[name].collect()))
    assert catalog._derived_once(catalog.Tables(orders=t.orders), spark, SMALL_SF).keys() == {"orders"}
