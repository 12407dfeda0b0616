"""Sources and sinks.

* S1 ``scan_table`` — named table, optional column list (pruned in the scan).
* S2 ``scan_derived`` — a DataFrame used as a derived table inside SQL text.
* S3 ``load_tables`` / ``save_tables`` — all airline tables with explicit schemas;
  ``load_csv`` — typed reading with the rejected lines apart.
* S4 ``append_rows`` — one batch append, not one statement per row, as the table's next version;
  a lost race is tried again, a repeated batch token adds nothing.
* S5/S6 — copy-on-write update/delete: see :mod:`skyledger.operators.relational`;
  ``rewrite_rows`` rewrites the file sets that hold rows to change, ``commit_table`` the whole table.
* S7 ``to_json_records`` — report rows as JSON objects (chart input).

Writes go to a shared, fault-tolerant location (the cluster's checkpoint
folder by default), never to a machine-local temporary folder.
"""

from __future__ import annotations

import itertools
import json
import random
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from skyledger import schemas as S
from skyledger.session import checkpoint_dir

_VIEW_SEQ = itertools.count()


def scan_table(t, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S1 — a table from the bundle, all columns or a list."""
    df = t[name]
    return df if not columns else df.select(*columns)


def scan_derived(df: DataFrame, alias: str, sql: str) -> DataFrame:
    """S2 — run SQL text over ``df`` registered as ``{alias}``.

    The view gets a unique session name, so concurrent callers do not clash;
    Catalyst plans the SQL and the DataFrame as one query.
    """
    name = f"{alias}_{next(_VIEW_SEQ)}_{uuid.uuid4().hex[:8]}"
    df.createOrReplaceTempView(name)
    try:
        return df.sparkSession.sql(sql.format(**{alias: name}))  # analysed here, so the name is needed no longer
    finally:
        df.sparkSession.catalog.dropTempView(name)


def to_json_records(df: DataFrame) -> DataFrame:
    """S7 — one JSON object per row (``{{ rows | tojson }}`` of the report page)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def load_tables(spark: SparkSession, root: str, names: Sequence[str] | None = None, fmt: str = "parquet"):
    """S3 — read airline tables stored under ``root/<name>`` with their declared schemas.

    The seed spelling of a finished order is mapped to the stored one (Q1).
    """
    from skyledger.sources.views import Tables
    names = list(names or S.SCHEMAS)
    out = Tables()
    for n in names:
        reader = spark.read.format(fmt)
        if n in S.SCHEMAS:
            reader = reader.schema(S.SCHEMAS[n])
        if fmt == "csv":
            reader = reader.option("header", "true")
        out[n] = reader.load(f"{root}/{n}")
        if n == "orders":
            out[n] = out[n].withColumn("OrderStatus", S.normalize_order_status_col(F.col("OrderStatus")))
    return out


def save_tables(tables, root: str, names: Sequence[str] | None = None, partition_by: dict | None = None,
                parallel: int = 4) -> None:
    """S3 — materialise tables (e.g. the derived views) as Parquet under ``root``.

    ``partition_by`` maps a table to its partition columns, e.g. flights by
    take-off month so that month filters (P14) prune whole directories.
    Independent tables are written by up to ``parallel`` concurrent jobs, so
    small tables do not leave the cluster idle between writes.
    """

    def write(n: str) -> None:
        w = tables[n].write.mode("overwrite")
        cols = (partition_by or {}).get(n)
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(f"{root}/{n}")

    names = list(names or tables)
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        list(pool.map(write, names))


def save_by_month(tables, root: str, names: Sequence[str] = ("flights", "orders")):
    """S3, P14 — store tables by calendar month under ``root``; returns the bundle with those read back.

    Flights go by take-off month and orders by order month (:data:`skyledger.schemas.MONTHS`); rows of a month
    are brought together before the write, so it has few files, and a month that holds a third
    of the rows is split again at run time. A row without a time is in the partition of no month.
    """
    from skyledger.sources.views import Tables
    out = Tables(tables)
    for n in names:
        col, ts = S.MONTHS[n]
        rows = _conform(tables[n], n).withColumn(col, F.date_format(ts, "yyyy-MM"))
        rows.hint("rebalance", F.col(col)).write.mode("errorifexists").partitionBy(col).parquet(f"{root}/{n}")
        out[n] = rows.sparkSession.read.schema(
            T.StructType([*S.SCHEMAS[n].fields, T.StructField(col, T.StringType())])).parquet(f"{root}/{n}")
    return out


# Tables keyed by flight: stored bucketed on FlightID, joins and aggregations on
# FlightID between them read co-partitioned buckets instead of shuffling.
FLIGHT_KEYED = ("flights", "prices", "orders", "working_pilots", "working_attendants")
# Seats are bucketed on their order: a search brings the chosen flights' orders to the seats' buckets, and
# no seat is shuffled.
BUCKET_KEYS = {**{n: ["FlightID"] for n in FLIGHT_KEYED}, "seats": ["CustomerKind", "OrderID"]}


def save_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, table: str) -> DataFrame:
    """Write ``df`` hash-bucketed and sorted on ``keys`` at ``path`` and return the table.

    Registered as an external table of the session catalog (bucketing metadata
    lives there); the files stay at ``path`` in shared storage.
    """
    spark = df.sparkSession
    (df.write.mode("errorifexists").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def materialize(tables, root: str, names: Sequence[str] | None = None, partition_by: dict | None = None,
                buckets: int | None = None):
    """Write ``tables`` under ``root`` and return the bundle read back from storage.

    This is how a deployment holds the airline tables: stored once, read by
    every query with scan-level pushdown and pruning, instead of being derived
    again inside each query plan.
    """
    from skyledger.sources.views import Tables
    names = list(names or [n for n, df in tables.items() if df is not None and not n.startswith("_")])
    spark = next(iter(tables.values())).sparkSession
    out = Tables()
    tag = uuid.uuid4().hex[:8]
    plain = [n for n in names if not (buckets and n in BUCKET_KEYS)]
    save_tables(tables, root, plain, partition_by)
    for n in plain:
        out[n] = spark.read.parquet(f"{root}/{n}")
    for n in names:
        if n not in plain:
            out[n] = save_bucketed(tables[n], f"{root}/{n}", BUCKET_KEYS[n], buckets, f"sl_{tag}_{n}")
    return out


def materialize_views(spark: SparkSession, sf_dir: str, root: str, buckets: int | None = None):
    """Derive the airline tables from the driver tables at ``sf_dir`` and store them under ``root``.

    The two shared intermediates (flights with their customer's nation, and
    order lines joined to flights) are written first and read back, so every
    table built on them reads the stored copy: the lineage is cut at a written
    table in shared storage, and the orders ⋈ customer join runs once.
    """
    from skyledger.sources.views import airline_views
    base = airline_views(spark, sf_dir)
    base["_flights_ext"].write.mode("errorifexists").parquet(f"{root}/_flights_ext")
    fe = spark.read.parquet(f"{root}/_flights_ext")
    airline_views(spark, sf_dir, flights_ext=fe)["_orders_ext"].write.mode("errorifexists").parquet(
        f"{root}/_orders_ext")
    oe = spark.read.parquet(f"{root}/_orders_ext")
    t = airline_views(spark, sf_dir, flights_ext=fe, orders_ext=oe)
    return materialize(t, root, [n for n in t if not n.startswith("_")], buckets=buckets)


def store(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back (lineage ends there)."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession, table: str) -> str:
    """A fresh path in the shared checkpoint folder for a new table version."""
    return f"{checkpoint_dir(spark)}/tables/{table}/v-{uuid.uuid4().hex}"


# ---- versioned tables (S4–S6) -----------------------------------------------------
#
# A store is a folder of tables; ``<root>/<table>/data/<file set>`` holds rows and
# ``<root>/<table>/versions/<n>.json`` lists the file sets of version n, with the token of
# the batch that made it. A version is written aside and renamed into place, so it is
# there whole or not at all, and of two writers of one number the second finds it
# taken (on stores whose rename is atomic, as on HDFS; within one driver in any case). Readers take the
# highest version.

VERSION_SCHEMA = "version long, parts array<string>, batch string"
MAX_ATTEMPTS = 20
PARALLEL_REWRITES = 4
_PUBLISHING = threading.Lock()


class VersionTaken(Exception):
    """Another writer published this version first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    try:
        return spark.read.schema(VERSION_SCHEMA).json(f"{root}/{table}/versions/*")
    except AnalysisException:  # no version has been published yet
        return None


def _latest(spark: SparkSession, root: str, table: str, version: int | None = None) -> tuple[int, list[str]]:
    """Number and file sets of the latest version, or of the one asked for; (0, []) if there is none."""
    rows = _versions(spark, root, table)
    if rows is None:
        return 0, []
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    found = rows.orderBy(F.desc("version")).first()
    return (found["version"], found["parts"]) if found else (0, [])


def _snapshot(spark: SparkSession, root: str, table: str, batch: str | None) -> tuple[int, list[str], int | None]:
    """Latest version, its file sets, and the version that carries ``batch``, all from one reading of the versions.

    One reading: a version that it misses holds the next number, so publishing on top of it is refused.
    """
    rows = _versions(spark, root, table)
    if rows is None:
        return 0, [], None
    found = rows.agg(F.max("version").alias("last"), F.max_by("parts", "version").alias("parts"),
                     F.min(F.when(F.col("batch") == F.lit(batch), F.col("version"))).alias("done")).first()
    return found["last"] or 0, found["parts"] or [], found["done"]


def _publish(spark: SparkSession, root: str, table: str, parts: list[str], version: int, batch: str | None = None) -> int:
    """Make ``parts`` version ``version`` of a table; :class:`VersionTaken` if someone was faster."""
    fs, aside = _fs(spark, f"{root}/{table}/claims/{uuid.uuid4().hex}.json")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/versions/{version}.json")
    out = fs.create(aside)
    out.write(bytearray(json.dumps({"version": version, "parts": parts, "batch": batch}).encode()))
    out.close()
    fs.mkdirs(place.getParent())
    with _PUBLISHING:
        if fs.exists(place) or not fs.rename(aside, place):
            fs.delete(aside, False)
            raise VersionTaken(f"version {version} of {table}")
    return version


def _write_part(df: DataFrame, root: str, table: str, label: str | None = None) -> str:
    part = f"{root}/{table}/data/{uuid.uuid4().hex}" + (f"/{label}" if label else "")
    df.write.mode("errorifexists").parquet(part)
    return part


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of the store as of its latest version, or an older one."""
    _, parts = _latest(spark, root, table, version)
    if not parts:
        raise ValueError(f"no such version of {table} under {root}")
    return spark.read.schema(S.SCHEMAS[table]).parquet(*parts)


def version_parts(spark: SparkSession, root: str, table: str, version: int | None = None) -> list[str]:
    """File sets of a version."""
    return _latest(spark, root, table, version)[1]


def _conform(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SCHEMAS[table].fields])


def _next_version(spark: SparkSession, root: str, table: str, batch: str | None, parts_after) -> int:
    """Publish ``parts_after(old parts)`` on top of the latest version, again and again while others are faster.

    A batch that is published already, by an earlier or a concurrent attempt, is not published again.
    """
    for attempt in range(MAX_ATTEMPTS):
        last, old, done = _snapshot(spark, root, table, batch)
        if done is not None:
            return done
        parts = parts_after(old)
        if parts == old and old:
            return last  # nothing to change
        try:
            return _publish(spark, root, table, parts, last + 1, batch)
        except VersionTaken:
            time.sleep(random.uniform(0, 0.05 * 2 ** min(attempt, 6)))
    raise VersionTaken(f"{table} under {root}: lost {MAX_ATTEMPTS} times")


def append_rows(df: DataFrame, root: str, table: str, batch: str | None = None) -> int:
    """S4 — a new version with the rows of a validated batch added, in one write; returns its number.

    The rows are written once; a lost race only repeats the publishing, on top of
    the version that won. With a ``batch`` token the append is idempotent: a
    token that a version carries already adds nothing and gives that version.
    """
    spark = df.sparkSession
    done = _snapshot(spark, root, table, batch)[2]
    if done is not None:
        return done
    part = _write_part(_conform(df, table), root, table)
    return _next_version(spark, root, table, batch, lambda old: [*old, part])


def commit_table(new_version: DataFrame, root: str, table: str, split_by: str | None = None) -> int:
    """S5/S6 — a new version that holds the rewritten rows only; returns its number.

    ``split_by`` (a SQL expression) deals the rows, in the one write, to a file set per value, so that
    :func:`rewrite_rows` can leave most of them alone; the driver lists a path per value. The old
    version stays readable, so a lost executor or failed job leaves no half-written table
    behind. A version that another writer publishes meanwhile is an error: the rows were made without it.
    """
    spark = new_version.sparkSession
    last, _ = _latest(spark, root, table)
    rows = _conform(new_version, table)
    if split_by is None:
        return _publish(spark, root, table, [_write_part(rows, root, table)], last + 1)
    base = f"{root}/{table}/data/{uuid.uuid4().hex}"
    (rows.withColumn("set", F.coalesce(F.expr(split_by).cast("string"), F.lit("none")))
     .write.mode("errorifexists").partitionBy("set").parquet(base))
    fs, at = _fs(spark, base)
    parts = sorted(f"{base}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.isDirectory())
    return _publish(spark, root, table, parts or [_write_part(rows, root, table)], last + 1)


def rewrite_rows(spark: SparkSession, root: str, table: str, change: Callable[[DataFrame], DataFrame],
                 hit: Callable[[DataFrame], DataFrame], batch: str | None = None) -> int:
    """S5 — copy-on-write of the file sets that hold rows to change, and of no other.

    ``hit(rows)`` keeps the rows of a table that an update or delete touches, ``change(rows)`` gives the rows
    after it. One job counts the hits per file set; only those are read in full,
    changed and written as new file sets, and the new version lists them
    beside the untouched ones. A lost race starts again from the version that won.
    Without a hit no version is made.
    """
    def parts_after(old: list[str]) -> list[str]:
        if not old:
            return old
        schema = S.SCHEMAS[table]
        each = [spark.read.schema(schema).parquet(p).withColumn("_part", F.lit(i)) for i, p in enumerate(old)]
        found = hit(reduce(lambda a, b: a.unionByName(b), each)).groupBy("_part").count().collect()  # a row per file set
        touched = {r["_part"] for r in found}

        def rewritten(i: int) -> str:
            return _write_part(_conform(change(each[i].drop("_part")), table), root, table, _label(old[i]))

        with ThreadPoolExecutor(max_workers=PARALLEL_REWRITES) as pool:
            new = dict(zip(sorted(touched), pool.map(rewritten, sorted(touched))))
        return [new.get(i, p) for i, p in enumerate(old)]

    return _next_version(spark, root, table, batch, parts_after)


def _label(part: str) -> str | None:
    """Label of a file set made with ``split_by``."""
    last = part.rsplit("/", 1)[1]
    return last if last.startswith("set=") else None


def remove_unreferenced(spark: SparkSession, root: str, table: str, keep_versions: int = 1) -> list[str]:
    """Delete file sets that none of the latest ``keep_versions`` versions lists; returns their paths.

    Left over by lost races, failed jobs and rewritten rows. Older versions cannot be read any
    more; run it while no writer is at work.
    """
    rows = _versions(spark, root, table)
    if rows is None:
        return []
    listed = {p.split("/data/", 1)[1] for r in rows.orderBy(F.desc("version")).limit(keep_versions).collect()
              for p in r["parts"]}
    fs, data = _fs(spark, f"{root}/{table}/data")
    gone = []
    for top in fs.listStatus(data):
        name = top.getPath().getName()
        if name in listed:
            continue
        sets = [s.getPath() for s in fs.listStatus(top.getPath()) if s.getPath().getName().startswith("set=")]
        used = [p for p in sets if f"{name}/{p.getName()}" in listed]
        gone += [p for p in sets if p not in used] if used else [top.getPath()]
    for path in gone:
        fs.delete(path, True)
    return sorted(p.toString() for p in gone)


# ---- typed loading with rejects (S3) -----------------------------------------------------

def load_csv(spark: SparkSession, path: str, table: str, header: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3 — (rows, rejects) of a table's CSV files, by its declared schema.

    ``rows`` hold the table's columns, typed, with the seed spelling of a
    finished order mapped (Q1). ``rejects`` are the lines that are no such row, as
    ``Line, RejectReason``: ``malformed`` (a value of another type, too few or
    too many values) or ``missing field`` (nothing in a required column). Each line that is not blank is in
    exactly one of the two; a quoted value may hold commas but no line break.
    """
    schema = S.SCHEMAS[table]
    loose = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", _broken string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken",
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    if header:
        lines = lines.where(F.col("value") != ",".join(schema.names))
    read = lines.select("value", F.from_csv("value", loose, options).alias("row"))
    whole = F.col("row._broken").isNull()
    required = [F.col(f"row.{f.name}").isNull() for f in schema.fields if not f.nullable]
    lacking = reduce(lambda a, b: a | b, required, F.lit(False))
    rows = read.where(whole & ~lacking).select(*[F.col(f"row.{n}") for n in schema.names])
    if "OrderStatus" in schema.names:
        rows = rows.withColumn("OrderStatus", S.normalize_order_status_col(F.col("OrderStatus")))
    rejects = read.where(~whole | lacking).select(
        F.col("value").alias("Line"), F.when(whole, "missing field").otherwise("malformed").alias("RejectReason"))
    return rows, rejects


def load_csv_tables(spark: SparkSession, root: str, names: Sequence[str] | None = None, header: bool = False):
    """S3 — :func:`load_csv` of ``<root>/<table>`` for all airline tables: (tables, {table: rejects})."""
    from skyledger.sources.views import Tables
    loaded = {n: load_csv(spark, f"{root}/{n}", n, header) for n in (names or S.SCHEMAS)}
    return Tables({n: rows for n, (rows, _) in loaded.items()}), {n: rejects for n, (_, rejects) in loaded.items()}
