"""Airline-shaped tables derived from the driver's TPC-H-ish Parquet tables.

The application's data model (planes, cabins, routes, flights, prices, orders,
seats, crew, customers) is laid over ``supplier``, ``nation``, ``customer``,
``orders`` and ``lineitem`` with integer arithmetic only, so that the same
rows can be rebuilt in any SQL engine (see :mod:`skyledger.plans.oracle_views`).

Everything here is lazy. Scale notes:

* ``flights`` is ``orders`` joined to ``customer`` (a shuffle join on the
  customer key; AQE splits a hot customer) and to ``nation`` twice
  (broadcast: 25 rows by specification).
* ``orders`` groups ``lineitem`` by its (order, line) pair first, so the join
  to ``flights`` sees one row per pair; partial aggregation absorbs hot keys.
* ``n_sup`` (supplier count) is a scalar subquery, evaluated once.
* No cartesian products: expansions (cabins per plane, crew shifts per
  flight, route targets per nation) are ``explode``/``inline`` of short
  literal arrays followed by equi-joins.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger import schemas as S

# Fixed values of the derived model (see FIXTURES.md §3)
MANUFACTURERS = ("Boeing", "Airbus", "Dassault")      # by PlainID % 3
EMAIL_DOMAIN = "@example.com"
CANDIDATE_TIMES = (("L", dt.datetime(2002, 1, 1, 8, 0, 0)), ("E", dt.datetime(1994, 12, 1, 8, 0, 0)))
DEFAULT_AS_OF = dt.datetime(2000, 1, 1, 0, 0, 0)

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")


# Declared, so that building a query opens no file to learn a schema.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


class Tables(dict):
    """Named lazy DataFrames; ``t.flights`` is ``t["flights"]``."""

    def __getattr__(self, name):
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S1 — scan one driver table (Parquet: pushdown and pruning happen in the scan)."""
    return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ts(v: dt.datetime):
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def airline_views(spark: SparkSession, sf_dir: str, flights_ext: DataFrame | None = None,
                  orders_ext: DataFrame | None = None) -> Tables:
    """All airline tables, lazily derived from the driver tables at ``sf_dir``.

    ``flights_ext`` / ``orders_ext`` may be passed in already stored (see
    :func:`skyledger.sources.io.materialize_views`), so that the tables built on
    them read the stored copy instead of deriving it again.
    """
    rd = lambda n: read_driver(spark, sf_dir, n)
    supplier, nation, customer = rd("supplier"), rd("nation"), rd("customer")
    orders, lineitem, region = rd("orders"), rd("lineitem"), rd("region")

    n_sup = supplier.agg(F.count(F.lit(1))).scalar()
    n_nat = nation.agg(F.count(F.lit(1))).scalar()

    s = F.col("s_suppkey")
    planes = supplier.select(
        s.alias("PlainID"),
        F.when(s % 3 == 0, MANUFACTURERS[0]).when(s % 3 == 1, MANUFACTURERS[1])
         .otherwise(MANUFACTURERS[2]).alias("Manufacturer"),
        F.when(s % 2 == 0, S.SIZE_LARGE).otherwise(S.SIZE_SMALL).alias("Size"),
        F.date_add(F.lit(dt.date(1990, 1, 1)), (s % 1000).cast("int")).alias("PurchaseDate"),
    )

    regular = F.struct(F.lit(S.CLASS_REGULAR).alias("ClassType"),
                       (F.lit(1) + F.col("PlainID") % 3).cast("int").alias("NumberRows"),
                       F.lit(3).alias("NumberCols"))
    business = F.struct(F.lit(S.CLASS_BUSINESS).alias("ClassType"),
                        F.lit(1).alias("NumberRows"), F.lit(2).alias("NumberCols"))
    cabins = (planes
              .select("PlainID", F.inline(F.when(F.col("Size") == S.SIZE_LARGE,
                                                 F.array(regular, business))
                                          .otherwise(F.array(regular))))
              .select("ClassType", "PlainID", "NumberRows", "NumberCols"))

    src_nat = nation.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("SourceField"))
    dst_nat = F.broadcast(nation.select(F.col("n_nationkey").alias("b"),
                                        F.col("n_name").alias("DestinationField")))
    routes = (src_nat
              .select("a", "SourceField", F.explode(F.sequence(F.lit(0), (n_nat - 1).cast("int"))).alias("b"))
              .filter(F.col("a") != F.col("b"))
              .join(dst_nat, "b")
              .select("SourceField", "DestinationField",
                      ((F.lit(60) + (F.col("a") * 37 + F.col("b") * 53) % 660) * 60)
                      .cast("int").alias("DurationSec")))

    ok = F.col("o_orderkey")
    src_names = F.broadcast(nation.select(F.col("n_nationkey").alias("src_key"),
                                          F.col("n_name").alias("SourceField")))
    dst_names = F.broadcast(nation.select(F.col("n_nationkey").alias("dst_key"),
                                          F.col("n_name").alias("DestinationField")))
    derived_flights = (orders.select("o_orderkey", "o_custkey", "o_orderdate")
                   .join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
                   .select(ok.alias("FlightID"),
                           (ok % n_sup).alias("PlainID"),
                           F.timestamp_add("HOUR", ok % 24, F.col("o_orderdate")).alias("TakeOffTime"),
                           F.col("c_nationkey").alias("src_key"),
                           ((F.col("c_nationkey") + 1 + ok % 24) % 25).alias("dst_key"),
                           (ok % 20 == 0).alias("IsDeleted"),
                           F.col("o_custkey").alias("CustKey"),
                           F.to_date("o_orderdate").alias("BaseDate"))
                   .join(src_names, "src_key")
                   .join(dst_names, "dst_key"))
    flights_ext = derived_flights if flights_ext is None else flights_ext
    flights = flights_ext.select("FlightID", "PlainID", "TakeOffTime", "SourceField",
                                 "DestinationField", "IsDeleted")

    li = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("rf"))
    ln = F.col("l_linenumber")
    kind = F.when(ln % 2 == 1, F.lit(S.KIND_CUSTOMER)).otherwise(F.lit(S.KIND_GUEST))
    derived_orders = (li.join(flights_ext.select("FlightID", "PlainID", "IsDeleted", "CustKey", "BaseDate"),
                          li.l_orderkey == F.col("FlightID"))
                  .select((F.col("l_orderkey") * 10 + ln).alias("OrderID"),
                          kind.alias("CustomerKind"),
                          F.when(F.col("IsDeleted"), S.ORDER_SYSTEM_CANCELLED)
                           .when(F.col("rf") == "R", S.ORDER_CUSTOMER_CANCELLED)
                           .when(F.col("rf") == "N", S.ORDER_COMPLETE)
                           .otherwise(S.ORDER_ACTIVE).alias("OrderStatus"),
                          F.date_sub("BaseDate", ln * 7).alias("OrderDate"),
                          F.concat(F.when(ln % 2 == 1, "c").otherwise("g"),
                                   F.col("CustKey").cast("string"), F.lit(EMAIL_DOMAIN)).alias("Email"),
                          "PlainID",
                          F.when((ln % 3 == 0) & (F.col("PlainID") % 2 == 0), S.CLASS_BUSINESS)
                           .otherwise(S.CLASS_REGULAR).alias("ClassType"),
                          "FlightID",
                          ln.alias("LineNo")))
    orders_ext = derived_orders if orders_ext is None else orders_ext
    orders_v = orders_ext.drop("LineNo")

    seat_idx = (orders_ext.select("CustomerKind", "OrderID", "PlainID", "ClassType", "LineNo")
                .join(cabins, ["PlainID", "ClassType"])
                .select("CustomerKind", "OrderID", "ClassType", "LineNo", "NumberRows", "NumberCols",
                        F.explode(F.when(F.col("ClassType") == S.CLASS_BUSINESS, F.array(F.lit(0)))
                                  .otherwise(F.array(F.lit(0), F.lit(1)))).alias("j"))
                .withColumn("idx", F.when(F.col("ClassType") == S.CLASS_BUSINESS,
                                          F.expr("LineNo div 3") - 1)
                            .otherwise((F.col("LineNo") - 1) * 2 + F.col("j"))))
    seats = (seat_idx.filter(F.col("idx") < F.col("NumberRows") * F.col("NumberCols"))
             .select("CustomerKind", "OrderID",
                     (F.expr("idx div NumberCols") + 1).cast("int").alias("Line"),
                     (F.col("idx") % F.col("NumberCols") + 1).cast("int").alias("SeatLetter")))

    def crew(id_col: str, first: str):
        return supplier.select(s.alias(id_col), F.lit(first).alias("FirstName"),
                               F.col("s_name").alias("LastName"),
                               (s % 3 != 0).alias("Qualified4LongFlights"))

    def shifts(id_col: str, n_slots: int):
        m = F.floor(n_sup * 4 / 5).cast("long")
        return (flights_ext.select("FlightID", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("k"))
                .select(((F.col("FlightID") * 7 + F.col("k") * 13) % m).alias(id_col), "FlightID"))

    pilots = crew("PilotID", "Pilot")
    attendants = crew("AttendantID", "Attendant")
    working_pilots = shifts("PilotID", 2)
    working_attendants = shifts("AttendantID", 3)

    slots = F.array(*[F.struct(F.lit(tag).alias("tag"), _ts(ts).alias("ts")) for tag, ts in CANDIDATE_TIMES])
    # every route planned at both times: the batch is bounded by the route network
    candidates = (routes.select("*", F.inline(slots))
                  .select(F.concat_ws("", "SourceField", F.lit(">"), "DestinationField", F.lit(":"), "tag")
                          .alias("CandidateID"),
                          "SourceField", "DestinationField",
                          F.col("ts").alias("TakeOffTime"),
                          F.timestamp_add("SECOND", F.col("DurationSec"), F.col("ts")).alias("LandingTime"),
                          "DurationSec",
                          (F.col("DurationSec") > S.LONG_FLIGHT_SECONDS).alias("IsLong")))

    ck = F.col("c_custkey")
    email_of = lambda prefix: F.concat(F.lit(prefix), ck.cast("string"), F.lit(EMAIL_DOMAIN))
    customers = customer.select(
        email_of("c").alias("Email"), F.lit("Customer").alias("EngFirstName"),
        F.col("c_name").alias("EngLastName"), (F.lit(10000000) + ck).alias("PassportNumber"),
        F.date_add(F.lit(dt.date(1950, 1, 1)), ((ck * 37) % 18000).cast("int")).alias("Birthdate"),
        F.date_add(F.lit(dt.date(1990, 1, 1)), (ck % 3000).cast("int")).alias("SignUpDate"))
    guests = customer.select(email_of("g").alias("Email"), F.lit("Guest").alias("EngFirstName"),
                             F.col("c_name").alias("EngLastName"))

    def phones(prefix: str, n_mod: int):
        return (customer.select("c_custkey", F.explode(F.sequence(F.lit(0), (ck % n_mod).cast("int"))).alias("k"))
                .select(email_of(prefix).alias("Email"),
                        F.concat(F.lit("05"), F.lpad((ck * 10 + F.col("k")).cast("string"), 8, "0"))
                        .alias("Phone")))

    customer_phones = phones("c", 3)
    guest_phones = phones("g", 2)
    managers = region.select(F.col("r_regionkey").cast("long").alias("ManagerID"),
                             F.lit("Manager").alias("FirstName"), F.col("r_name").alias("LastName"),
                             F.concat(F.lit("c"), (F.col("r_regionkey") * 100).cast("string"),
                                      F.lit(EMAIL_DOMAIN)).alias("Email"))

    return Tables(
        _flights_ext=flights_ext, _orders_ext=orders_ext,
        planes=planes, cabins=cabins, routes=routes, flights=flights, prices=_prices(flights, cabins),
        orders=orders_v, seats=seats, pilots=pilots, attendants=attendants,
        working_pilots=working_pilots, working_attendants=working_attendants,
        candidates=candidates, customers=customers, guests=guests,
        customer_phones=customer_phones, guest_phones=guest_phones, managers=managers,
    )


def _prices(flights: DataFrame, cabins: DataFrame) -> DataFrame:
    fid = F.col("FlightID")
    return (flights.select("FlightID", "PlainID")
            .join(cabins.select("PlainID", "ClassType"), "PlainID")
            .select("ClassType", "FlightID", "PlainID",
                    ((F.lit(100) + (fid % 40) * 10) *
                     F.when(F.col("ClassType") == S.CLASS_BUSINESS, 2.5).otherwise(1.0))
                    .cast("double").alias("Price")))


def with_tables(t: Tables, **replace) -> Tables:
    """Copy of ``t`` with some tables replaced (e.g. after a lifecycle update)."""
    out = Tables(t)
    out.update(replace)
    return out
