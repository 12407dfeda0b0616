"""Which planes and crew can take a planned flight.

A *candidate* is a planned flight: ``CandidateID, SourceField,
DestinationField, TakeOffTime, LandingTime, IsLong``. A resource (plane,
pilot, attendant) qualifies for a candidate when

(a) its earliest leg starts at the candidate's destination after the
    candidate lands, or
(b) its latest leg ended at the candidate's source before take-off, or
(c) it has never been scheduled,

and, for a long candidate, it is qualified (Large plane / long-flight crew).
Gaps in the middle of a schedule are never used; cancelled flights still
count as legs.

Plan shape: every kind's shifts are read once and reduced to one *profile* per
resource (first and last leg, their fields); a field matters only at the two
extremes, so a profile holds at most a few fields however long the schedule.
The listing operators join classes of equal profiles with candidates on (field,
bin of days) and attach the members afterwards; the feasibility check counts
without listing pairs. No hint forces a join: AQE broadcasts a side only
after measuring it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from skyledger import schemas as S
from skyledger.functions.scalar import add_seconds, day_of
from skyledger.operators.inventory import flights_with_landing

KINDS = {
    # kind: (id column, dimension table, shifts table)
    "planes": ("PlainID", "planes", "flights"),
    "pilots": ("PilotID", "pilots", "working_pilots"),
    "attendants": ("AttendantID", "attendants", "working_attendants"),
}


def _resources(t, kind: str) -> DataFrame:
    """(Kind, ResourceID, Qualified) for every resource of a kind."""
    rid, dim, _ = KINDS[kind]
    q = (F.col("Size") == S.SIZE_LARGE) if kind == "planes" else F.col("Qualified4LongFlights")
    return t[dim].select(F.lit(kind).alias("Kind"), F.col(rid).alias("ResourceID"), q.alias("Qualified"))


def _shifts(t, kind: str) -> DataFrame:
    rid, _, shifts = KINDS[kind]
    return t[shifts].select(F.lit(kind).alias("Kind"), F.col(rid).alias("ResourceID"), "FlightID")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def resource_legs(t, kind: str) -> DataFrame:
    """Every scheduled leg of every resource, with landing time (flights without a route drop out)."""
    fl = flights_with_landing(t).select("FlightID", "SourceField", "DestinationField", "TakeOffTime", "LandingTime")
    return _shifts(t, kind).join(fl, "FlightID").join(_resources(t, kind), ["Kind", "ResourceID"]).drop("Kind")


def resource_profiles(t, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """One row per resource: Kind, ResourceID, Qualified, Used, FirstTime, FirstFields, LastTime, LastFields.

    ``Used``: it has a shift at all. ``FirstFields`` are the departure fields of
    its legs at the earliest take-off, ``LastFields`` the arrival fields at the
    latest landing (several on ties); legs whose flight or route is unknown
    have no times. All kinds share one pass: shifts meet the flights once and
    are reduced map-side to one row per (resource, field).
    """
    legs = (t.flights.join(t.routes, ["SourceField", "DestinationField"], "left")
            .select("FlightID", "SourceField", "DestinationField",
                    F.when(F.col("DurationSec").isNotNull(), F.col("TakeOffTime")).alias("Leaves"),
                    add_seconds("TakeOffTime", "DurationSec").alias("Lands")))
    none = F.lit(None).cast("timestamp_ntz")
    ends = (_union([_shifts(t, k) for k in kinds]).join(legs, "FlightID", "left")
            .select("Kind", "ResourceID", F.inline(F.array(
                F.struct(F.col("SourceField").alias("Field"), F.col("Leaves").alias("First"), none.alias("Last")),
                F.struct(F.col("DestinationField").alias("Field"), none.alias("First"), F.col("Lands").alias("Last")))),
                    F.lit(None).cast("boolean").alias("Qualified"), F.lit(True).alias("Shift")))
    # The resources themselves take part in the aggregation instead of a join after it.
    there = (_union([_resources(t, k) for k in kinds])
             .select("Kind", "ResourceID", F.lit(None).cast("string").alias("Field"), none.alias("First"),
                     none.alias("Last"), "Qualified", F.lit(False).alias("Shift")))
    by_field = (ends.unionByName(there).groupBy("Kind", "ResourceID", "Field")
                .agg(F.min("First").alias("First"), F.max("Last").alias("Last"),
                     F.bool_or("Qualified").alias("Qualified"), F.bool_or("Shift").alias("Shift")))
    one = (by_field.groupBy("Kind", "ResourceID")
           .agg(F.collect_list(F.when(F.col("Shift"), F.struct("Field", "First", "Last"))).alias("f"),
                F.min("First").alias("FirstTime"), F.max("Last").alias("LastTime"),
                F.bool_or("Qualified").alias("Qualified"), F.bool_or("Shift").alias("Used"))
           .where("Qualified IS NOT NULL"))  # shifts of unknown resources drop out
    fields = lambda column, time: F.when(F.col("Used"), F.sort_array(F.expr(
        f"transform(filter(f, x -> x.{column} = {time}), x -> x.Field)")))
    return one.select("Kind", "ResourceID", "Qualified", "Used", "FirstTime", fields("First", "FirstTime").alias("FirstFields"),
                      "LastTime", fields("Last", "LastTime").alias("LastFields"))


def qualifies(is_long: Column) -> Column:
    return F.col("Qualified") | ~is_long


def fits_before(destination: Column, landing: Column) -> Column:
    """(a) the resource's first leg starts at the destination after the landing."""
    return F.coalesce(F.array_contains("FirstFields", destination) & (F.col("FirstTime") > landing), F.lit(False))


def fits_after(source: Column, take_off: Column) -> Column:
    """(b) the resource's last leg ended at the source before the take-off."""
    return F.coalesce(F.array_contains("LastFields", source) & (F.col("LastTime") < take_off), F.lit(False))


def can_take(source: Column, destination: Column, take_off: Column, landing: Column, is_long: Column) -> Column:
    """(a), (b) or (c) for a profile and a flight that stand in one row."""
    return qualifies(is_long) & (~F.col("Used") | fits_before(destination, landing) | fits_after(source, take_off))


CLASS_KEY = ("Qualified", "Used", "FirstTime", "FirstFields", "LastTime", "LastFields")


def _class_id() -> Column:
    """Text that all resources of one profile share; what it holds decides every candidate alike."""
    at = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    fields = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return F.concat_ws("|", F.when(F.col("Qualified"), "q").otherwise("n"),
                       F.when(F.col("Used"), F.concat_ws("|", at("FirstTime"), fields("FirstFields"),
                                                         at("LastTime"), fields("LastFields"))).otherwise("free"))


def class_members(t, kind: str) -> DataFrame:
    """D12 — (ClassID, <id column>): the equivalence class of every resource of a kind.

    Resources with one profile (qualification, first and last times and fields) can take the
    same candidates. Crews that fly together form a class, and all
    resources never scheduled form two.
    """
    return resource_profiles(t, (kind,)).select(_class_id().alias("ClassID"), F.col("ResourceID").alias(KINDS[kind][0]))


BIN_DAYS = 32


def _bin(time: str) -> Column:
    return F.floor(F.unix_date(F.to_date(time)) / BIN_DAYS).cast("int")


def class_candidates(t, kind: str, candidates: DataFrame | None = None) -> DataFrame:
    """D12/J11 — (CandidateID, ClassID) of every class that can take a candidate; each pair once.

    A range join in bins of :data:`BIN_DAYS` days: classes and candidates meet
    on (field, bin), so a busy field is spread over its bins. A candidate asks
    every whole bin after its landing (a) or before its take-off (b), between
    the flights' first and last take-offs; only in its own bin are times
    compared. The free classes, two at most, meet the candidates on
    qualification alone.
    """
    c = (t.candidates if candidates is None else candidates).select(
        "CandidateID", "SourceField", "DestinationField", "TakeOffTime", "LandingTime", "IsLong")
    classes = (resource_profiles(t, (kind,)).select(_class_id().alias("ClassID"), *CLASS_KEY)
               .groupBy("ClassID", "Qualified", "Used").agg(*[F.any_value(k).alias(k) for k in CLASS_KEY[2:]]))
    span = t.flights.agg(F.struct(F.min(_bin("TakeOffTime")).alias("lo"), F.max(_bin("TakeOffTime")).alias("hi"))).scalar()
    long = F.col("IsLong")
    whole = lambda start, stop: F.when(start <= stop, F.sequence(start, stop)).otherwise(
        F.array().cast("array<int>"))
    land, leave = _bin("LandingTime"), _bin("TakeOffTime")
    c = c.withColumn("lo", span["lo"]).withColumn("hi", span["hi"])
    after = c.select("*", F.explode(whole(F.greatest(land, "lo"), F.col("hi"))).alias("bin"))
    before = c.select("*", F.explode(whole(F.col("lo"), leave)).alias("bin"))
    used = classes.where("Used")
    a = (used.select("*", _bin("FirstTime").alias("bin"), F.explode("FirstFields").alias("DestinationField"))
         .join(after, ["DestinationField", "bin"])
         .where(((F.col("bin") > land) | (F.col("FirstTime") > F.col("LandingTime"))) & qualifies(long)))
    b = (used.select("*", _bin("LastTime").alias("bin"), F.explode("LastFields").alias("SourceField"))
         .join(before, ["SourceField", "bin"])
         .where(((F.col("bin") < leave) | (F.col("LastTime") < F.col("TakeOffTime"))) & qualifies(long)
                & ~fits_before(F.col("DestinationField"), F.col("LandingTime"))))  # (a) has those
    serve = F.when(F.col("Qualified"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    free = (classes.where("NOT Used").select("ClassID", F.explode(serve).alias("IsLong"))
            .join(c.select("CandidateID", "IsLong"), "IsLong"))
    return _union([x.select("CandidateID", "ClassID") for x in (a, b, free)])


FREE_SALT = 64


def assignable_resources(t, kind: str, candidates: DataFrame | None = None) -> DataFrame:
    """D12 — (CandidateID, <id column>) for every resource that can take each candidate.

    The pair listing of :func:`class_candidates` and :func:`class_members`.
    The members of the free classes may be most of a table, so those classes
    are dealt over :data:`FREE_SALT` parts.
    """
    rid = KINDS[kind][0]
    free = F.col("ClassID").endswith("|free")
    members = class_members(t, kind).withColumn(
        "part", F.when(free, F.pmod(F.xxhash64(rid), F.lit(FREE_SALT))).otherwise(F.lit(0).cast("long")))
    able = class_candidates(t, kind, candidates).withColumn("part", F.explode(
        F.when(free, F.sequence(F.lit(0).cast("long"), F.lit(FREE_SALT - 1).cast("long")))
        .otherwise(F.array(F.lit(0).cast("long")))))
    return able.join(members, ["ClassID", "part"]).select("CandidateID", rid)


def available_planes(t, candidates: DataFrame | None = None) -> DataFrame:
    """D13c — assignable planes with their size."""
    return (assignable_resources(t, "planes", candidates)
            .join(t.planes.select("PlainID", "Size"), "PlainID")
            .select("CandidateID", "PlainID", "Size"))


def available_pilots(t, candidates: DataFrame | None = None) -> DataFrame:
    """D13a — assignable pilots with all pilot columns."""
    return assignable_resources(t, "pilots", candidates).join(t.pilots, "PilotID")


def available_attendants(t, candidates: DataFrame | None = None) -> DataFrame:
    """D13b — assignable attendants with all attendant columns."""
    return assignable_resources(t, "attendants", candidates).join(t.attendants, "AttendantID")


_COUNTED = [(kind, q) for kind in KINDS for q in (True, False)]
_COUNTS = [f"{kind}_{'q' if q else 'n'}" for kind, q in _COUNTED]


def staffing_feasibility(t, candidates: DataFrame | None = None) -> DataFrame:
    """D14 — can each candidate be staffed.

    Needs at least one plane; a long candidate, or one whose available planes
    are all Large (vacuously true when there are none), needs 6 attendants and
    3 pilots, otherwise 3 and 2.

    Only counts are needed, so no candidate × resource pair is made: for (b)
    the resources whose last landing at the field lies before the take-off are
    a running count over time, for (a) the total less the running count up to
    the landing. Both run in two levels, by (field, day) and over the days of
    a field, so a busy field is spread over its days. (a) and (b) never hold
    for one resource at once: its first take-off would lie after the landing
    and its last landing before the take-off. A candidate lands after it takes off.
    """
    c = t.candidates if candidates is None else candidates
    one = [F.when((F.col("Kind") == kind) & (F.col("Qualified") == q), 1).otherwise(0).cast("long").alias(n)
           for (kind, q), n in zip(_COUNTED, _COUNTS)]
    none = [F.lit(0).cast("long").alias(n) for n in _COUNTS]
    events = resource_profiles(t).select(*one, F.explode(F.when(F.col("Used"), F.concat(
        F.transform("FirstFields", lambda f: F.struct(F.lit("a").alias("side"), f.alias("field"),
                                                      F.col("FirstTime").alias("at"))),
        F.transform("LastFields", lambda f: F.struct(F.lit("b").alias("side"), f.alias("field"),
                                                     F.col("LastTime").alias("at")))))
        .otherwise(F.array(F.struct(F.lit("c").alias("side"), F.lit(None).cast("string").alias("field"),
                                    F.lit(None).cast("timestamp_ntz").alias("at"))))).alias("e")).select("e.*", *_COUNTS)
    events = events.withColumn("day", day_of("at"))
    days = W.partitionBy("side", "field").orderBy("day")
    field = W.partitionBy("side", "field")
    asked = c.select("CandidateID", "IsLong", F.inline(F.array(
        F.struct(F.lit("a").alias("side"), F.col("DestinationField").alias("field"), F.col("LandingTime").alias("at")),
        F.struct(F.lit("b").alias("side"), F.col("SourceField").alias("field"), F.col("TakeOffTime").alias("at")))))
    asked = asked.withColumn("day", day_of("at"))
    # Days asked about take part in the running totals, so that each finds its own row.
    upto = (events.select("side", "field", "day", *_COUNTS)
            .unionByName(asked.select("side", "field", "day", *none))
            .groupBy("side", "field", "day").agg(*[F.sum(n).alias(n) for n in _COUNTS])
            .select("side", "field", "day",
                    *[(F.sum(n).over(days) - F.col(n)).alias(f"{n}_before") for n in _COUNTS],
                    *[F.sum(n).over(field).alias(f"{n}_all") for n in _COUNTS]))
    # Within a day: events at the very minute of a landing are not after it, of a take-off not before it.
    order = F.when(F.col("side") == "a", F.col("asks")).otherwise(1 - F.col("asks"))
    in_day = W.partitionBy("side", "field", "day").orderBy("at", "order").rowsBetween(W.unboundedPreceding, 0)
    line = (events.select("side", "field", "day", "at", *_COUNTS, F.lit(0).alias("asks"),
                                               F.lit(None).cast(c.schema["CandidateID"].dataType).alias("CandidateID"),
                                               F.lit(None).cast("boolean").alias("IsLong"))
            .unionByName(asked.select("side", "field", "day", "at", *none, F.lit(1).alias("asks"), "CandidateID", "IsLong"))
            .withColumn("order", order))
    seen = (line.select("*", *[F.sum(n).over(in_day).alias(f"{n}_in") for n in _COUNTS]).where("asks = 1")
            .join(upto, ["side", "field", "day"]))
    count = {n: F.when(F.col("side") == "a", F.col(f"{n}_all") - F.col(f"{n}_before") - F.col(f"{n}_in"))
             .otherwise(F.col(f"{n}_before") + F.col(f"{n}_in")) for n in _COUNTS}
    found = seen.groupBy("CandidateID", "IsLong").agg(*[F.sum(count[n]).alias(n) for n in _COUNTS])
    there = _union([_resources(t, k) for k in KINDS]).select("Kind", "ResourceID", "Qualified", F.lit(False).alias("Shift"))
    shifts = _union([_shifts(t, k) for k in KINDS]).select("Kind", "ResourceID", F.lit(None).cast("boolean").alias("Qualified"),
                                                           F.lit(True).alias("Shift"))
    idle = (there.unionByName(shifts).groupBy("Kind", "ResourceID")
            .agg(F.bool_or("Qualified").alias("Qualified"), F.bool_or("Shift").alias("Shift"))
            .where("Qualified IS NOT NULL AND NOT Shift").select(*one))
    free = idle.agg(F.struct(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _COUNTS])).scalar()
    total = found.withColumn("free", free)
    usable = lambda kind: (F.col(f"{kind}_q") + F.col(f"free.{kind}_q")
                           + F.when(F.col("IsLong"), 0).otherwise(F.col(f"{kind}_n") + F.col(f"free.{kind}_n")))
    small_planes = F.when(F.col("IsLong"), 0).otherwise(F.col("planes_n") + F.col("free.planes_n"))
    big = F.col("IsLong") | F.col("AllPlanesLarge")
    return (total.select("CandidateID", "IsLong", usable("planes").alias("AvailablePlanes"),
                         usable("pilots").alias("AvailablePilots"), usable("attendants").alias("AvailableAttendants"),
                         (small_planes == 0).alias("AllPlanesLarge"))
            .withColumn("RequiredPilots", F.when(big, 3).otherwise(2))
            .withColumn("RequiredAttendants", F.when(big, 6).otherwise(3))
            .select("CandidateID", "IsLong", "AvailablePlanes", "AllPlanesLarge", "AvailablePilots",
                    "AvailableAttendants", "RequiredPilots", "RequiredAttendants",
                    ((F.col("AvailablePlanes") >= 1) & (F.col("AvailablePilots") >= F.col("RequiredPilots"))
                     & (F.col("AvailableAttendants") >= F.col("RequiredAttendants"))).alias("Feasible")))


def crew_requirement(t) -> DataFrame:
    """D15 — required vs assigned crew per flight (Large: 3 pilots / 6 attendants; Small: 2 / 3)."""
    pil = t.working_pilots.groupBy("FlightID").agg(F.count(F.lit(1)).alias("AssignedPilots"))
    att = t.working_attendants.groupBy("FlightID").agg(F.count(F.lit(1)).alias("AssignedAttendants"))
    large = F.col("Size") == S.SIZE_LARGE
    return (t.flights.select("FlightID", "PlainID")
            .join(t.planes.select("PlainID", "Size"), "PlainID")
            .join(pil, "FlightID", "left").join(att, "FlightID", "left")
            .select("FlightID", "PlainID", "Size",
                    F.when(large, 3).otherwise(2).alias("RequiredPilots"),
                    F.when(large, 6).otherwise(3).alias("RequiredAttendants"),
                    F.coalesce("AssignedPilots", F.lit(0)).alias("AssignedPilots"),
                    F.coalesce("AssignedAttendants", F.lit(0)).alias("AssignedAttendants"))
            .withColumn("CrewComplete", (F.col("AssignedPilots") >= F.col("RequiredPilots"))
                        & (F.col("AssignedAttendants") >= F.col("RequiredAttendants"))))


def plane_size(t, cabins: DataFrame | None = None) -> DataFrame:
    """D16 — ``Large`` iff the plane has both classes with positive rows and cols."""
    c = t.cabins if cabins is None else cabins
    usable = (F.col("NumberRows") > 0) & (F.col("NumberCols") > 0)
    return (c.groupBy("PlainID")
            .agg(F.count_distinct(F.when(usable, F.col("ClassType"))).alias("NumClasses"))
            .withColumn("DerivedSize", F.when(F.col("NumClasses") == 2, S.SIZE_LARGE).otherwise(S.SIZE_SMALL)))


def chain_continuity(t) -> DataFrame:
    """D17 — non-deleted legs that do not leave from where the plane's previous leg landed.

    The previous leg is found in two levels so that no task holds a plane's
    whole history: a lag inside (plane, day), and for the first leg of a day
    the last destination of the plane's previous active day (one row per
    plane-day, bounded by the calendar).
    """
    legs = (t.flights.filter(~F.col("IsDeleted"))
            .select("PlainID", "FlightID", "TakeOffTime", "SourceField", "DestinationField",
                    day_of("TakeOffTime").alias("day")))
    w_day = W.partitionBy("PlainID", "day").orderBy("TakeOffTime", "FlightID")
    in_day = (legs.withColumn("rn", F.row_number().over(w_day))
              .withColumn("prev_in_day", F.lag("DestinationField").over(w_day)))
    day_last = (legs.groupBy("PlainID", "day")
                .agg(F.max_by("DestinationField", F.struct("TakeOffTime", "FlightID")).alias("last_dst")))
    day_prev = (day_last.withColumn("prev_day_dst",
                                    F.lag("last_dst").over(W.partitionBy("PlainID").orderBy("day")))
                .select("PlainID", "day", "prev_day_dst"))
    prev = F.when(F.col("rn") == 1, F.col("prev_day_dst")).otherwise(F.col("prev_in_day"))
    return (in_day.join(day_prev, ["PlainID", "day"])
            .withColumn("PrevDestination", prev)
            .filter(F.col("PrevDestination").isNotNull() & (F.col("PrevDestination") != F.col("SourceField")))
            .select("FlightID", "PlainID", "TakeOffTime", "SourceField", "PrevDestination"))


def missing_return_routes(t) -> DataFrame:
    """D17 — routes whose reverse direction does not exist."""
    r = t.routes
    rev = r.select(F.col("DestinationField").alias("SourceField"), F.col("SourceField").alias("DestinationField"))
    return r.join(rev, ["SourceField", "DestinationField"], "left_anti")
