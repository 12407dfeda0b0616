"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.session import checkpoint_dir


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers, once per application.

    Functions then pickle by reference and find their module-level caches on
    every executor, whether or not the package is installed there.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="skyledger-"), "skyledger.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted((root / "skyledger").rglob("*.py")):
            out.write(source, source.relative_to(root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that survives lost executors; readers see
    exactly one version of every row.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete the folder of a table that :func:`store` returned and no later result reads."""
    jvm = stored.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns are left behind."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None],
              schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch; ``fn`` may return a dict of columns."""
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out if isinstance(out, pa.RecordBatch) else record_batch(out, target)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, column: str, wanted: Callable[[list], list[bool]]) -> DataFrame:
    """The rows, with all their columns, whose ``column`` a batch function accepts."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield batch.filter(pa.array(wanted(batch.column(column)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns[f.name], pa.Array)
         else pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def internal_names(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, …, so that no internal name can meet one of them."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def internal_name(docs: DataFrame, column: str) -> str | None:
    """Name under :func:`internal_names` of a column (None: there is none)."""
    for at, name in enumerate(docs.columns):
        if name == column or name.lower() == column.lower() and column not in docs.columns:
            return f"c{at}"
    return None


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """A value that a Python worker keeps between tasks: the last operator's only.

    Workers serve all operators of an application one after another; each would
    otherwise leave its tables and caches behind.
    """
    if key not in _kept:
        _free()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Drop what an earlier operator left in this worker."""
    if _kept:
        _free()


def _free() -> None:
    """Forget the kept values and hand their memory back: allocators hold on to it otherwise,
    and a reused worker would keep the size of the largest operator that it ever served."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU library has it
        trim(0)


class RecentCache(dict):
    """Cache bounded by the bytes of two generations: a full one becomes the old one and
    words still in use move back, so frequent words stay.

    ``entry``: bytes of an entry with an empty key (table slot, objects, a short value); a value is taken
    to grow by two bytes per character of its key.
    """

    def __init__(self, compute: Callable, megabytes: int = 16, longest: int = 64, entry: int = 140):
        super().__init__()
        self.compute, self.limit, self.longest, self.entry = compute, megabytes << 20, longest, entry
        self.old, self.held = {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if self.held >= self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self.held += self.entry + 3 * len(key)
            self[key] = value
        return value
