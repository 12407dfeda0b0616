"""Table schemas, enumerations and status normalisation.

Fixed values that must equal the reference application's stored text
(status words, class names, plane sizes, role labels) are listed together
here, in natural order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# ---- fixed values (stored text of the source application) -----------------
ORDER_ACTIVE = "Active"
ORDER_COMPLETE = "Complete"
ORDER_CUSTOMER_CANCELLED = "Customer_Cancelled"
ORDER_SYSTEM_CANCELLED = "System_Cancelled"
ORDER_STATUSES = (ORDER_ACTIVE, ORDER_COMPLETE, ORDER_CUSTOMER_CANCELLED, ORDER_SYSTEM_CANCELLED)
CANCELLED_STATUSES = (ORDER_SYSTEM_CANCELLED, ORDER_CUSTOMER_CANCELLED)

FLIGHT_DELETED = "Deleted"
FLIGHT_FULL = "Full Capacity"
FLIGHT_COMPLETE = "Complete"
FLIGHT_ACTIVE = "Active"
FLIGHT_STATUSES = (FLIGHT_DELETED, FLIGHT_FULL, FLIGHT_COMPLETE, FLIGHT_ACTIVE)

CLASS_REGULAR = "Regular"
CLASS_BUSINESS = "Business"
CLASSES = (CLASS_BUSINESS, CLASS_REGULAR)  # sorted, as a GROUP BY of class names returns them

SIZE_LARGE = "Large"
SIZE_SMALL = "Small"

ROLE_PILOT = "Pilot"
ROLE_ATTENDANT = "Flight Attendant"

KIND_CUSTOMER = "customer"
KIND_GUEST = "guest"

LONG_FLIGHT_SECONDS = 6 * 3600          # Long iff duration is strictly greater
ORDER_CANCEL_WINDOW_HOURS = 36          # order cancellable iff take-off - now > 36 h
FLIGHT_CANCEL_WINDOW_HOURS = 72         # flight cancellable iff take-off - now > 72 h
CANCELLATION_FEE = 0.05                 # customer-cancelled order keeps 5 % of its price
MAX_PHONES_PER_USER = 10
UTILISATION_DAYS = 30.0                 # plane activity report divides by a fixed 30 days

# UI spellings seen in filters -> stored value (flight and order status)
STATUS_ALIASES = {
    "full_capacity": FLIGHT_FULL,
    "full capacity": FLIGHT_FULL,
    "cancelled": FLIGHT_DELETED,
    "deleted": FLIGHT_DELETED,
    "active": FLIGHT_ACTIVE,
    "complete": FLIGHT_COMPLETE,
    "completed": FLIGHT_COMPLETE,
    "system cancelled": ORDER_SYSTEM_CANCELLED,
    "system_cancelled": ORDER_SYSTEM_CANCELLED,
    "customer cancelled": ORDER_CUSTOMER_CANCELLED,
    "customer_cancelled": ORDER_CUSTOMER_CANCELLED,
}


def normalize_status(value: str | None) -> str | None:
    """Map a UI/status spelling to the stored value (driver-side, for parameters)."""
    if value is None:
        return None
    return STATUS_ALIASES.get(value.strip().lower(), value)


def normalize_order_status_col(c: Column) -> Column:
    """Seed rows spell a finished order ``Completed``; the code writes ``Complete``."""
    return F.when(c == F.lit("Completed"), F.lit(ORDER_COMPLETE)).otherwise(c)


# ---- schemas ----------------------------------------------------------------

def _s(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PLANES = _s(("PlainID", T.LongType(), False), ("Manufacturer", T.StringType(), False),
            ("Size", T.StringType(), False), ("PurchaseDate", T.DateType(), False))
CABINS = _s(("ClassType", T.StringType(), False), ("PlainID", T.LongType(), False),
            ("NumberRows", T.IntegerType(), False), ("NumberCols", T.IntegerType(), False))
ROUTES = _s(("SourceField", T.StringType(), False), ("DestinationField", T.StringType(), False),
            ("DurationSec", T.IntegerType(), False))
FLIGHTS = _s(("FlightID", T.LongType(), False), ("PlainID", T.LongType(), False),
             ("TakeOffTime", T.TimestampNTZType(), False), ("SourceField", T.StringType(), False),
             ("DestinationField", T.StringType(), False), ("IsDeleted", T.BooleanType(), False))
PRICES = _s(("ClassType", T.StringType(), False), ("FlightID", T.LongType(), False),
            ("PlainID", T.LongType(), False), ("Price", T.DoubleType(), False))
ORDERS = _s(("OrderID", T.LongType(), False), ("CustomerKind", T.StringType(), False),
            ("OrderStatus", T.StringType(), False), ("OrderDate", T.DateType(), False),
            ("Email", T.StringType(), False), ("PlainID", T.LongType(), False),
            ("ClassType", T.StringType(), False), ("FlightID", T.LongType(), False))
SEATS = _s(("CustomerKind", T.StringType(), False), ("OrderID", T.LongType(), False),
           ("Line", T.IntegerType(), False), ("SeatLetter", T.IntegerType(), False))
def _crew(key):
    return _s((key, T.LongType(), False), ("FirstName", T.StringType(), False),
              ("LastName", T.StringType(), False), ("Qualified4LongFlights", T.BooleanType(), False))


def _shift(key):
    return _s((key, T.LongType(), False), ("FlightID", T.LongType(), False))


MANAGERS = _s(("ManagerID", T.LongType(), False), ("FirstName", T.StringType(), False),
              ("LastName", T.StringType(), False), ("Email", T.StringType(), False))
CANDIDATES = _s(("CandidateID", T.StringType(), False), ("SourceField", T.StringType(), False),
                ("DestinationField", T.StringType(), False), ("TakeOffTime", T.TimestampNTZType(), False),
                ("LandingTime", T.TimestampNTZType(), False), ("DurationSec", T.IntegerType(), False),
                ("IsLong", T.BooleanType(), False))
CUSTOMERS = _s(("Email", T.StringType(), False), ("EngFirstName", T.StringType(), False),
               ("EngLastName", T.StringType(), False), ("PassportNumber", T.LongType(), False),
               ("Birthdate", T.DateType(), True), ("SignUpDate", T.DateType(), False))
GUESTS = _s(("Email", T.StringType(), False), ("EngFirstName", T.StringType(), False),
            ("EngLastName", T.StringType(), False))
PHONES = _s(("Email", T.StringType(), False), ("Phone", T.StringType(), False))

SCHEMAS = {
    "planes": PLANES, "cabins": CABINS, "routes": ROUTES, "flights": FLIGHTS,
    "prices": PRICES, "orders": ORDERS, "seats": SEATS, "customers": CUSTOMERS,
    "guests": GUESTS, "customer_phones": PHONES, "guest_phones": PHONES,
    "pilots": _crew("PilotID"), "attendants": _crew("AttendantID"),
    "working_pilots": _shift("PilotID"), "working_attendants": _shift("AttendantID"),
    "managers": MANAGERS, "candidates": CANDIDATES,
}

# Tables stored by calendar month: the column that names it ('YYYY-MM') and the one it is taken from.
MONTHS = {"flights": ("TakeOffMonth", "TakeOffTime"), "orders": ("OrderMonth", "OrderDate")}

# Columns the DDL declares NOT NULL, audited by ingest.check_keys.
REQUIRED = {table: [f.name for f in schema.fields if not f.nullable] for table, schema in SCHEMAS.items()}

# Primary keys (the DDL's PRIMARY KEY / UNIQUE), audited by ingest.check_keys.
PRIMARY_KEYS = {
    "planes": ["PlainID"],
    "cabins": ["ClassType", "PlainID"],
    "routes": ["SourceField", "DestinationField"],
    "flights": ["FlightID"],
    "prices": ["ClassType", "FlightID", "PlainID"],
    "orders": ["CustomerKind", "OrderID"],
    "seats": ["CustomerKind", "OrderID", "Line", "SeatLetter"],
    "pilots": ["PilotID"],
    "attendants": ["AttendantID"],
    "working_pilots": ["PilotID", "FlightID"],
    "working_attendants": ["AttendantID", "FlightID"],
    "customers": ["Email"],
    "guests": ["Email"],
    "customer_phones": ["Email", "Phone"],
    "guest_phones": ["Email", "Phone"],
    "managers": ["ManagerID"],
}

# Foreign keys: (child table, child cols, parent table, parent cols)
FOREIGN_KEYS = [
    ("cabins", ["PlainID"], "planes", ["PlainID"]),
    ("flights", ["PlainID"], "planes", ["PlainID"]),
    ("flights", ["SourceField", "DestinationField"], "routes", ["SourceField", "DestinationField"]),
    ("prices", ["FlightID"], "flights", ["FlightID"]),
    ("prices", ["ClassType", "PlainID"], "cabins", ["ClassType", "PlainID"]),
    ("orders", ["FlightID"], "flights", ["FlightID"]),
    ("orders", ["ClassType", "FlightID", "PlainID"], "prices", ["ClassType", "FlightID", "PlainID"]),
    ("orders", ["Email"], "customers", ["Email"]),
    ("orders", ["Email"], "guests", ["Email"]),
    ("customer_phones", ["Email"], "customers", ["Email"]),
    ("guest_phones", ["Email"], "guests", ["Email"]),
    ("seats", ["CustomerKind", "OrderID"], "orders", ["CustomerKind", "OrderID"]),
    ("working_pilots", ["PilotID"], "pilots", ["PilotID"]),
    ("working_pilots", ["FlightID"], "flights", ["FlightID"]),
    ("working_attendants", ["AttendantID"], "attendants", ["AttendantID"]),
    ("working_attendants", ["FlightID"], "flights", ["FlightID"]),
]
