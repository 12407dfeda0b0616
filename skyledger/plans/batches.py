"""Request batches derived from the driver tables, for the ingestion operators.

Each batch is a deterministic function of a driver table (one request per
driver row, ``Seq`` = the row's unique key), so its size grows with the data
and it exercises the validation rules: existing keys, manager emails,
missing fields, in-batch duplicates, departed flights, unknown references.
The SQL twins live in :mod:`skyledger.plans.oracle_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyledger.sources.views import EMAIL_DOMAIN, Tables, read_driver


def _email(prefix: F.Column, key: str) -> F.Column:
    return F.concat(prefix, F.col(key).cast("string"), F.lit(EMAIL_DOMAIN))


def mixed_case(batch: DataFrame, key: str = "Seq") -> DataFrame:
    """The batch with the email of every second row in capitals."""
    return batch.withColumn("Email", F.when(F.col(key) % 2 == 0, F.upper("Email")).otherwise(F.col("Email")))


THREE_CLASSES = ("Business", "First", "Regular")


def with_first_class(t) -> Tables:
    """The tables with a class First (one row of two seats, twice the regular price) on every fourth plane."""
    first = F.lit("First").alias("ClassType")
    cabins = t.cabins.where((F.col("ClassType") == "Regular") & (F.col("PlainID") % 4 == 0)).withColumns(
        {"ClassType": first, "NumberRows": F.lit(1), "NumberCols": F.lit(2)})
    prices = t.prices.where((F.col("ClassType") == "Regular") & (F.col("PlainID") % 4 == 0)).withColumns(
        {"ClassType": first, "Price": F.col("Price") * 2})
    return Tables(t, cabins=t.cabins.unionByName(cabins.select(*t.cabins.columns)),
                  prices=t.prices.unionByName(prices.select(*t.prices.columns)))


def flight_lines(t) -> DataFrame:
    """The flights as CSV lines: some with text for the plane, some cut short, some without a source field."""
    f = F.col("FlightID")
    plane = F.when(f % 13 == 0, F.concat(F.lit("x"), "PlainID")).otherwise(F.col("PlainID").cast("string"))
    source = F.when(f % 19 == 0, F.lit("")).otherwise(F.col("SourceField"))
    head = F.concat_ws(",", f.cast("string"), plane, F.date_format("TakeOffTime", "yyyy-MM-dd HH:mm:ss"))
    rest = F.concat_ws(",", source, "DestinationField", F.col("IsDeleted").cast("string"))
    return t.flights.select(F.when(f % 17 == 0, head).otherwise(F.concat_ws(",", head, rest)).alias("value"))


def signup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    pri = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("Seq"),
        _email(F.when(pri.isin("1-URGENT", "2-HIGH"), "c").otherwise("n"), "o_custkey").alias("Email"),
        F.lit("New").alias("EngFirstName"),
        F.concat(F.lit("Cust"), F.col("o_custkey").cast("string")).alias("EngLastName"),
        F.when(pri == "5-LOW", F.lit(None)).otherwise(F.lit(10000000) + F.col("o_custkey")).alias("PassportNumber"),
        F.date_sub(F.to_date("o_orderdate"), 9000).alias("Birthdate"),
        F.to_date("o_orderdate").alias("SignUpDate"),
        (F.col("o_orderstatus") != "P").alias("IsSignedUp"))


def phone_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    guest = F.col("o_orderstatus") == "O"
    blank = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    number = F.lpad((F.col("o_custkey") * 10 + F.col("o_orderkey") % 13).cast("string"), 8, "0")
    return o.select(
        F.col("o_orderkey").alias("Seq"),
        _email(F.when(guest, "g").otherwise("c"), "o_custkey").alias("Email"),
        F.when(blank, F.lit("  ")).otherwise(F.concat(F.lit(" 05"), number, F.lit(" "))).alias("Phone"),
        (~guest).alias("IsSignedUp"))


def order_batch(spark: SparkSession, sf_dir: str, flight_from: str = "o_orderkey") -> DataFrame:
    """Order requests; the flights follow ``flight_from``: one request a flight, or one flight a customer."""
    o = read_driver(spark, sf_dir, "orders")
    n_orders = o.agg(F.count(F.lit(1))).scalar()
    return o.select(
        F.col("o_orderkey").alias("Seq"),
        _email(F.when(F.col("o_orderkey") % 3 == 0, "g").otherwise("c"), "o_custkey").alias("Email"),
        ((F.col(flight_from) * 7 + 3) % n_orders).alias("FlightID"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Business").otherwise("Regular").alias("ClassType"))


def seat_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    line = F.lit(1) + F.col("o_orderkey") % 7
    return o.select(
        F.col("o_orderkey").alias("Seq"),
        F.when(line % 2 == 1, "customer").otherwise("guest").alias("CustomerKind"),
        (F.col("o_orderkey") * 10 + line).alias("OrderID"),
        F.concat((F.lit(1) + F.col("o_custkey") % 3).cast("string"), F.lit("-"),
                 (F.lit(1) + F.col("o_orderkey") % 4).cast("string")).alias("SeatToken"))


def plane_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_driver(spark, sf_dir, "part")
    n_sup = read_driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    return p.select(
        F.col("p_partkey").alias("Seq"),
        (F.col("p_partkey") % (n_sup * 2)).alias("PlainID"),
        F.col("p_brand").alias("Manufacturer"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_size")).alias("PurchaseDate"),
        (F.col("p_size") % 5).alias("RegularRows"), F.lit(3).alias("RegularCols"),
        (F.col("p_size") % 2).alias("BusinessRows"), F.lit(2).alias("BusinessCols"))


def flight_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    nation = read_driver(spark, sf_dir, "nation")
    n_sup = read_driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    src = F.broadcast(nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("SourceField")))
    dst = F.broadcast(nation.select(F.col("n_nationkey").alias("dk"), F.col("n_name").alias("DestinationField")))
    return (o.select(F.col("o_orderkey").alias("Seq"),
                     (F.col("o_custkey") % (n_sup + 5)).alias("PlainID"),
                     F.timestamp_add("HOUR", F.col("o_orderkey") % 24, F.col("o_orderdate")).alias("TakeOffTime"),
                     (F.col("o_custkey") % 25).cast("int").alias("sk"),
                     ((F.col("o_custkey") + F.col("o_orderkey")) % 25).cast("int").alias("dk"))
            .join(src, "sk").join(dst, "dk").drop("sk", "dk"))


def price_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_driver(spark, sf_dir, "part")
    n_orders = read_driver(spark, sf_dir, "orders").agg(F.count(F.lit(1))).scalar()
    return p.select(
        F.col("p_partkey").alias("Seq"),
        ((F.col("p_partkey") * 7) % (n_orders + 10)).alias("FlightID"),
        F.when(F.col("p_size") % 2 == 0, "Business").otherwise("Regular").alias("ClassType"),
        F.when(F.col("p_size") % 10 == 0, F.lit(-1.0)).otherwise(F.col("p_retailprice")).alias("Price"))


def crew_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_driver(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("Seq"),
        F.col("c_custkey").alias("EmployeeID"),
        F.when(F.col("c_custkey") % 2 == 0, "Pilot").otherwise("Flight Attendant").alias("Role"),
        F.lit("New").alias("FirstName"), F.col("c_name").alias("LastName"),
        (F.col("c_acctbal") > 0).alias("Qualified4LongFlights"))


def crew_assignment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_driver(spark, sf_dir, "orders")
    ck = F.col("o_custkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    pilots = F.when(urgent, F.array(ck % 50, (ck + 1) % 50, (ck + 2) % 50)).otherwise(F.array(ck % 50, (ck + 1) % 50))
    atts = F.when(urgent, F.array(*[(ck + i) % 70 for i in range(6)])).otherwise(F.array(*[(ck + i) % 70 for i in range(3)]))
    return o.select(F.col("o_orderkey").alias("FlightID"), pilots.alias("PilotIDs"), atts.alias("AttendantIDs"))


def booking_batch(spark: SparkSession, sf_dir: str, flight_from: str = "o_orderkey") -> DataFrame:
    """One purchase per driver order: the order request of :func:`order_batch` plus
    one seat token, two for urgent orders."""
    o = read_driver(spark, sf_dir, "orders")
    tok = lambda r, c: F.concat((F.lit(1) + r).cast("string"), F.lit("-"), (F.lit(1) + c).cast("string"))
    first = tok(F.col("o_custkey") % 3, F.col("o_orderkey") % 3)
    second = tok(F.col("o_orderkey") % 2, F.col("o_custkey") % 2)
    seats = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(first, second)).otherwise(F.array(first))
    return order_batch(spark, sf_dir, flight_from).join(o.select(F.col("o_orderkey").alias("Seq"), seats.alias("SeatTokens")), "Seq")
