"""I11 over versions — the key audit of stored tables, brought forward by the file sets that changed.

A ledger stands beside the tables of a store. Per check and key it holds how many child
and parent rows have that key, so the violations of every key are a function of its
ledger row alone. A later audit reads the file sets that the tables' new
versions list and the last audit did not (counted once), and those that are listed no more
(counted back), sums them per key, and looks up only the keys they touch.

All checks share one grouping by (check, key) with partial aggregation before its
shuffle, one scan per changed file set, and no key is gathered: a third of the rows under
one key meet as one number per task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skyledger import schemas as S
from skyledger.sources import io

LEDGER = "key_audit"
MERGE_AFTER = 16  # ledgers of so many audits are summed into one
ROW = ["Check", "Key"]


def _checks(tables: list[str]) -> list[tuple[str, str, list[str]]]:
    """(table, check name, columns) of every check among ``tables``, in the order of :func:`ingest.check_keys`."""
    found = []
    for table, keys in S.PRIMARY_KEYS.items():
        if table in tables:
            found += [(table, "primary key", keys), *((table, "not null", [c]) for c in S.REQUIRED[table])]
    return found + [(child, f"foreign key -> {parent}", cols) for child, cols, parent, _ in S.FOREIGN_KEYS
                    if child in tables and parent in tables]


def _name(table: str, check: str, columns: list[str]) -> str:
    return f"{table}|{check}|{','.join(columns)}"


def _entry(name: str, columns: list[str], child: Column, parent: Column) -> Column:
    return F.struct(F.lit(name).alias("Check"), F.array(*[F.col(c).cast("string") for c in columns]).alias("Key"),
                    child.cast("long").alias("C"), parent.cast("long").alias("P"))


def _entries(rows: DataFrame, table: str, tables: list[str]) -> DataFrame:
    """What each row of ``rows`` (with ``_sign``) adds to the ledger: one scan for all checks it takes part in."""
    sign, none = F.col("_sign"), F.lit(0)
    out = [_entry(_name(table, "primary key", S.PRIMARY_KEYS[table]), S.PRIMARY_KEYS[table], sign, none)]
    for c in S.REQUIRED[table]:  # only a null makes an entry
        out.append(F.when(F.col(c).isNull(), _entry(_name(table, "not null", [c]), [c], sign, none)))
    for child, ccols, parent, pcols in S.FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        name = _name(child, f"foreign key -> {parent}", ccols)
        if table == child:
            e = _entry(name, ccols, sign, none)
            if child == "orders" and parent in ("customers", "guests"):
                kind = S.KIND_CUSTOMER if parent == "customers" else S.KIND_GUEST
                e = F.when(F.col("CustomerKind") == kind, e)
            out.append(e)
        if table == parent:
            out.append(_entry(name, pcols, none, sign))
    return rows.select(F.inline(F.filter(F.array(*out), lambda e: e.isNotNull())))


def _violations(child: str, parent: str) -> Column:
    """Violations of one ledger row: rows beyond the first of a key, nulls, child rows without a parent."""
    c, p = F.col(child), F.col(parent)
    orphan = (p <= 0) | F.exists("Key", lambda k: k.isNull())
    return (F.when(F.col("Check").contains("|primary key|"), F.greatest(c - 1, F.lit(0)))
            .when(F.col("Check").contains("|not null|"), c)
            .otherwise(F.when(orphan, c).otherwise(F.lit(0))))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ROW).agg(F.sum("C").alias("C"), F.sum("P").alias("P"))


def changed_file_sets(spark: SparkSession, root: str, tables: list[str], covered: dict[str, list[str]]):
    """{table: (added file sets, file sets no longer listed)} of the latest versions against ``covered``."""
    out = {}
    for table in tables:
        now, then = io.version_parts(spark, root, table), covered.get(table, [])
        out[table] = ([p for p in now if p not in then], [p for p in then if p not in now])
    return out


def _covered(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    rows = spark.read.schema(_COVERED).json(f"{folder}/covered").collect()
    return {r.TableName: r.Parts for r in rows}  # a row per table: paths of file sets, as its version lists them


def _touched(spark: SparkSession, changes: dict, tables: list[str]) -> DataFrame:
    """Ledger rows of the changed file sets, summed per check and key."""
    out = []
    for table, sets in changes.items():
        for parts, sign in zip(sets, (1, -1)):
            if parts:
                rows = spark.read.schema(S.SCHEMAS[table]).parquet(*parts)
                out.append(_entries(rows.withColumn("_sign", F.lit(sign)), table, tables))
    return _summed(reduce(DataFrame.unionByName, out)).filter("C <> 0 OR P <> 0")


def _totals(spark: SparkSession, new: DataFrame, ledgers: list[str], tables: list[str]) -> DataFrame:
    """Violations per check: those of the last audit, and what the touched keys change."""
    names = spark.createDataFrame([(_name(*c), c[0], c[1], ",".join(c[2])) for c in _checks(tables)],
                                  "Check string, TableName string, CheckName string, Columns string")
    if ledgers:
        old = _summed(spark.read.schema(_ROWS).parquet(*ledgers).join(new.select(*ROW), ROW, "left_semi"))
        both = (new.join(old.select(*ROW, F.col("C").alias("_c"), F.col("P").alias("_p")), ROW, "left")
                .withColumns({"_c": F.coalesce("_c", F.lit(0)), "_p": F.coalesce("_p", F.lit(0))})
                .withColumns({"C": F.col("C") + F.col("_c"), "P": F.col("P") + F.col("_p")}))
        change = both.select("Check", (_violations("C", "P") - _violations("_c", "_p")).alias("Violations"))
        change = change.unionByName(spark.read.schema(_TOTALS).parquet(f"{_folder(ledgers)}/totals")
                                    .select("Check", "Violations"))
    else:
        change = new.select("Check", _violations("C", "P").alias("Violations"))
    sums = change.groupBy("Check").agg(F.sum("Violations").alias("Violations"))
    return names.join(sums, "Check", "left").withColumn("Violations", F.coalesce("Violations", F.lit(0)).cast("long"))


def _folder(ledgers: list[str]) -> str:
    return ledgers[-1].rsplit("/", 1)[0]


def _result(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_TOTALS).parquet(f"{folder}/totals").drop("Check")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = io._fs(spark, path)
    return fs.exists(at)


_ROWS = "Check string, Key array<string>, C long, P long"
_COVERED = "TableName string, Parts array<string>"
_TOTALS = "Check string, TableName string, CheckName string, Columns string, Violations long"


def audit(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """I11 — (TableName, CheckName, Columns, Violations) of the latest versions of ``tables`` under ``root``.

    Equal to :func:`skyledger.operators.ingest.check_keys` of those versions, over those tables. The
    first audit, one over other tables, and one after a file set that it must count back was deleted
    (:func:`io.remove_unreferenced`) read everything; every other reads the changed file sets, and of the ledger
    the keys they touch. Tables that did not change cost no reading.

    The ledger's new version is published as those of tables are: a failed audit leaves nothing behind that
    counts, and a lost race is :class:`io.VersionTaken`. A null in a key column refers to nothing and
    counts; an empty table has no violations, one without a version is an error.
    """
    last, ledgers = io._latest(spark, root, LEDGER)
    covered = _covered(spark, _folder(ledgers)) if ledgers else {}
    changes = changed_file_sets(spark, root, tables, covered)
    if set(covered) != set(tables) or not all(_exists(spark, p) for _, gone in changes.values() for p in gone):
        ledgers, covered = [], {}
        changes = changed_file_sets(spark, root, tables, covered)
        if not all(added for added, _ in changes.values()):
            raise ValueError(f"a table of {tables} has no version under {root}")
    elif not any(added or gone for added, gone in changes.values()):
        return _result(spark, _folder(ledgers))
    folder = f"{root}/{LEDGER}/data/{uuid.uuid4().hex}"
    _touched(spark, changes, tables).write.parquet(f"{folder}/rows")
    new = spark.read.schema(_ROWS).parquet(f"{folder}/rows")
    _totals(spark, new, ledgers, tables).write.parquet(f"{folder}/totals")
    ledgers = [*ledgers, f"{folder}/rows"]
    if len(ledgers) > MERGE_AFTER:
        merged = _summed(spark.read.schema(_ROWS).parquet(*ledgers)).filter("C <> 0 OR P <> 0")
        merged.write.parquet(f"{folder}/merged")
        ledgers = [f"{folder}/merged"]
    now = {t: [p for p in covered.get(t, []) if p not in gone] + added for t, (added, gone) in changes.items()}
    spark.createDataFrame(list(now.items()), _COVERED).coalesce(1).write.json(f"{folder}/covered")
    io._publish(spark, root, LEDGER, ledgers, last + 1)
    return _result(spark, folder)
