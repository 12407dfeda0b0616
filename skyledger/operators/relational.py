"""Generic relational building blocks.

Thin, typed DataFrame helpers for the clauses the source application
assembled as SQL text: projection, CASE, equi-joins, semi/anti joins, rows at
a per-key extreme, ordered top-k, set operations, copy-on-write updates and
dense id allocation. Catalyst and AQE pick the physical join from sizes; no
helper starts a job or forces a broadcast.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


# ---- projection / CASE ------------------------------------------------------

def project(df: DataFrame, columns: Sequence[str | Column] | None = None) -> DataFrame:
    """P1 — column list or ``*``."""
    return df if not columns else df.select(*columns)


def case_when(branches: Sequence[tuple[Column, object]], otherwise=None) -> Column:
    """P4/P5 — ordered searched CASE; values may be literals or Columns."""
    def val(v):
        return v if isinstance(v, Column) else F.lit(v)
    (c0, v0), rest = branches[0], branches[1:]
    out = F.when(c0, val(v0))
    for c, v in rest:
        out = out.when(c, val(v))
    return out if otherwise is None else out.otherwise(val(otherwise))


# ---- joins ----------------------------------------------------------------

def join_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """J1–J4 — equi-join on same-named columns (``inner``/``left``/``right``/``full``)."""
    return left.join(right, list(on), how)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """J8/J12 — rows of ``left`` with a match (``EXISTS``)."""
    return left.join(right.select(*on), list(on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """J6/J7 — rows of ``left`` without a match (``NOT EXISTS``)."""
    return left.join(right.select(*on), list(on), "left_anti")


def rows_at_extreme(df: DataFrame, keys: Sequence[str], value: str, kind: str = "min") -> DataFrame:
    """J9/W2 — rows whose ``value`` equals the per-key MIN/MAX, ties kept.

    Same result as ``value = (SELECT MIN(value) ... WHERE same key)`` or a
    ``rank() == 1`` window, but computed as a partial aggregate plus an equi
    join on ``(keys, value)``: a key holding a large share of the rows is
    aggregated map-side and its rows are spread over the join by value, so no
    single task has to sort a whole hot group.
    """
    agg = F.min(value) if kind == "min" else F.max(value)
    ext = df.groupBy(*keys).agg(agg.alias(value))
    return df.join(ext, [*keys, value], "left_semi")


def join_back(ids: DataFrame, dim: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """J10 — re-attach dimension columns after id-only set work."""
    return ids.join(dim, key if isinstance(key, str) else list(key))


# ---- aggregation ------------------------------------------------------------

def having(grouped: DataFrame, pred: Column) -> DataFrame:
    """A2 — ``HAVING`` is a filter on the aggregated frame."""
    return grouped.filter(pred)


def sum_when(cond: Column, value: Column | float | int, otherwise=0) -> Column:
    """A6 — ``SUM(CASE WHEN cond THEN value ELSE otherwise END)``."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.sum(F.when(cond, v).otherwise(F.lit(otherwise)))


def all_true(cond: Column) -> Column:
    """A13 — ``all(...)`` over a group, true on an empty group."""
    return F.coalesce(F.bool_and(cond), F.lit(True))


def string_agg(value: str, sep: str = ",") -> Column:
    """A11 — sorted comma-joined list (deterministic order)."""
    return F.array_join(F.sort_array(F.collect_list(value)), sep)


# ---- ordering -----------------------------------------------------------------

def order_by(df: DataFrame, cols: Sequence[str], descending: Sequence[bool] | bool = False) -> DataFrame:
    """O1 — ``ORDER BY`` with a direction per column."""
    if isinstance(descending, bool):
        descending = [descending] * len(cols)
    return df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in zip(cols, descending)])


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """O3 — first ``k`` rows by a total order (planned as TakeOrderedAndProject:
    each task keeps its own top ``k`` and only ``k`` rows per task move)."""
    return df.orderBy(*order).limit(k)


# ---- set operations -----------------------------------------------------------

def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """U2 — ``UNION ALL`` by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(frames: Iterable[DataFrame]) -> DataFrame:
    """U1 — ``UNION`` (duplicates removed)."""
    return union_all(frames).distinct()


# ---- copy-on-write updates ----------------------------------------------------

def rewrite_update(df: DataFrame, cond: Column, assignments: dict[str, Column | object]) -> DataFrame:
    """S5 — ``UPDATE t SET c = v WHERE cond`` as a new DataFrame.

    A NULL condition leaves the row unchanged, as in SQL.
    """
    hit = F.coalesce(cond, F.lit(False))
    out = df
    for c, v in assignments.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(c, F.when(hit, v).otherwise(F.col(c)).cast(df.schema[c].dataType))
    return out


def rewrite_delete(df: DataFrame, cond: Column) -> DataFrame:
    """S6 — ``DELETE FROM t WHERE cond``; rows whose condition is NULL stay."""
    return df.filter(~F.coalesce(cond, F.lit(False)))


# ---- id allocation --------------------------------------------------------------

def _before(counts: DataFrame, key: str, parent: str) -> DataFrame:
    """Running total of ``n`` before each ``key``, inside its ``parent`` (2^16 keys at most)."""
    return counts.withColumn("_before", F.sum("n").over(W.partitionBy(parent).orderBy(key)) - F.col("n"))


def allocate_ids(batch: DataFrame, order_col: str, start_after: Column, id_col: str = "NewID",
                 where: Column | None = None) -> DataFrame:
    """W3 — dense ids ``start_after + 1, +2, ...`` in ``order_col`` order to the rows ``where`` holds.

    ``order_col`` is a unique integer per row; other rows, and rows without a key, get a NULL id.
    ``start_after`` is a scalar Column (e.g. ``coalesce(max(id), 0)`` of the
    existing table, as a scalar subquery).

    The numbering is a function of the keys alone: rows are grouped by the
    key without its low 16 bits, a window numbers each group (65,536 rows at
    most), and the groups' counts are summed up 16 bits at a time in the same
    way. No partition number, row position or sampled range takes part, so
    plans that recompute or coalesce parts of it agree.
    """
    key = F.col(order_col).cast("long")
    wanted = key.isNotNull() & (F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
    # Rows without a key stand in groups of their own, behind all others, spread by their contents.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in batch.dtypes if "map<" not in kind]), F.lit(1 << 16))
    group = F.coalesce(F.shiftright(key, 16), F.lit(1 << 47) + spread)
    rows = batch.withColumn("_g1", group).withColumn("_want", wanted.cast("long"))
    place = F.sum("_want").over(W.partitionBy("_g1").orderBy(order_col).rowsBetween(W.unboundedPreceding, 0))
    up = lambda c: F.shiftright(F.col(c), 16)
    first = rows.groupBy("_g1").agg(F.sum("_want").alias("n")).withColumn("_g2", up("_g1"))
    second = first.groupBy("_g2").agg(F.sum("n").alias("n")).withColumn("_g3", up("_g2"))
    third = second.groupBy("_g3").agg(F.sum("n").alias("n"))
    top = (third.withColumn("_top", F.sum("n").over(W.orderBy("_g3")) - F.col("n"))  # 2^16 rows at most
           .select("_g3", "_top"))
    middle = (_before(second, "_g2", "_g3").join(top, "_g3")
              .select("_g2", (F.col("_before") + F.col("_top")).alias("_middle")))
    offsets = (_before(first, "_g1", "_g2").join(middle, "_g2")
               .select("_g1", (F.col("_before") + F.col("_middle")).alias("_offset")))
    numbered = rows.withColumn("_place", place).join(offsets, "_g1")
    return (numbered.withColumn(id_col, F.when(F.col("_want") == 1, start_after + F.col("_offset") + F.col("_place")))
            .drop("_g1", "_want", "_place", "_offset"))


# ---- per-group ranking without hot groups ------------------------------------------

def first_k_per_group(df: DataFrame, keys: Sequence[str], seq: str, k: int, rank_col: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each key group by ``seq`` (a unique integer), with their rank.

    Two levels, so a hot group is never sorted by one task: each group is cut
    into stretches of 65,536 values of ``seq``, the first ``k`` of a stretch
    survive (the group's first ``k`` always do), and the final ranking sees
    ``k`` rows per stretch.
    """
    near = W.partitionBy(*keys, "_stretch").orderBy(seq)
    pre = (df.withColumn("_stretch", F.shiftright(F.col(seq).cast("long"), 16))
           .withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= k))
    whole = W.partitionBy(*keys).orderBy(seq)
    return (pre.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= k)
            .drop("_stretch", "_near"))
