"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors within a cosine of t lie within epsilon = sqrt(2 - 2t) of each
other. They are turned onto their principal axes and sorted by the cells of a
grid of width epsilon on the leading axes. Intervals of that sequence are
joined recursively; two intervals whose boxes lie farther apart than epsilon
are skipped, and small ones are compared by a matrix product in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, ship_package, store
from .components import PlaceForest, connected_components

THRESHOLD = 0.9
GRID_AXES = 6
BLOCK_ROWS = 4096
LEAF_ROWS = 256


def unit_rows(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of length one in double precision, short ones padded with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _classes(vectors: DataFrame) -> DataFrame:
    """One row per distinct usable vector: its least id, how often it occurs."""
    usable = ("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) "
              "OR abs(x) = double('inf')) AND exists(embedding, x -> x != 0)")
    return (vectors.where(F.expr(usable)).groupBy("embedding")
            .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, widest spread first. Tasks send ``width`` rows each; the driver gets ``width``."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(batch.column("embedding").to_pylist(), width)
                total[:width] += x.T @ x
                total[width] += x.sum(axis=0)
                n += len(x)
        yield record_batch({"axis": list(range(width + 1)), "n": [n] * (width + 1), "sums": list(total)},
                           pa.schema([("axis", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64()))]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"axis": pdf["axis"].iloc[:1], "n": [pdf["n"].sum()],
                             "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})

    schema = "axis int, n long, sums array<double>"
    rows = sorted(classes.select("embedding").mapInArrow(moments, schema).groupBy("axis")
                  .applyInPandas(add, schema).collect(), key=lambda r: r["axis"])
    n = max(1, rows[0]["n"])
    second, mean = np.array([r["sums"] for r in rows[:width]]) / n, np.array(rows[width]["sums"]) / n
    return np.ascontiguousarray(np.linalg.eigh(second - np.outer(mean, mean))[1][:, ::-1])


def _in_grid_order(classes: DataFrame, axes: np.ndarray, epsilon: float, block_rows: int) -> DataFrame:
    """Rows with ``block``, their interval of ``block_rows`` in the order of the grid cells."""
    width, lead = len(axes), min(GRID_AXES, len(axes))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = unit_rows(batch.column("embedding").to_pylist(), width) @ axes[:, :lead]
                names = [f"c{i}" for i in range(lead)]
                grid = np.floor(y / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(grid[:, i]) for i in range(lead))],
                                                 [*batch.schema.names, *names])

    element = classes.schema["embedding"].dataType.simpleString()
    names = [f"c{i}" for i in range(lead)]
    placed = store(classes.select("rep", "copies", "embedding").mapInArrow(
        cells, f"rep long, copies long, embedding {element}, " + ", ".join(f"{c} int" for c in names)), "grid-cells")
    parts = max(1, math.ceil(placed.count() / block_rows))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())],
                [*batch.schema.names, "part", "place"])
            at += n

    order = [*names, "rep"]
    numbered = store(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        number, f"rep long, copies long, embedding {element}, " + ", ".join(f"{c} int" for c in names)
                + ", part int, place long"), "grid-order")
    sizes = sorted(numbered.groupBy("part").count().collect())  # one row per partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = F.broadcast(classes.sparkSession.createDataFrame(before, "part int, before long"))
    block = F.floor((F.col("before") + F.col("place")) / block_rows).cast("int").alias("block")
    return numbered.join(offsets, "part").select("rep", "copies", "embedding", *names, block)


def _block_pairs(blocks: DataFrame, lead: int) -> DataFrame:
    """Pairs (a <= b) of blocks whose grid boxes touch on every leading axis."""
    names = [f"c{i}" for i in range(lead)]
    boxes = blocks.groupBy("block").agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))])
    left = boxes.select(*[F.col(c).alias(f"l_{c}") for c in boxes.columns],
                        F.explode(F.expr("sequence(lo_c0 - 1, hi_c0 + 1)")).alias("cell"))
    right = boxes.select(*[F.col(c).alias(f"r_{c}") for c in boxes.columns],
                         F.explode(F.expr("sequence(lo_c0, hi_c0)")).alias("cell"))
    near = F.lit(True)
    for c in names:
        near = near & (F.col(f"l_lo_{c}") <= F.col(f"r_hi_{c}") + 1) & (F.col(f"r_lo_{c}") <= F.col(f"l_hi_{c}") + 1)
    return (left.join(right, "cell").where((F.col("l_block") <= F.col("r_block")) & near)
            .select(F.col("l_block").alias("a"), F.col("r_block").alias("b")).distinct())


class IntervalJoin:
    """Links between two sequences of unit vectors (or within one), counted per row."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, copies: np.ndarray, threshold: float):
        self.x, self.copies, self.threshold = x, copies, threshold
        self.y = x @ axes
        self.limit = 2 - 2 * threshold + 1e-9
        self.links = np.zeros(len(x), np.int64)
        self.forest = PlaceForest(len(x))
        self.boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            part = self.y[a:b]
            self.boxes[a, b] = part.min(axis=0), part.max(axis=0)
        return self.boxes[a, b]

    def join(self, a: int, b: int, c: int, d: int) -> None:
        """Rows a..b with rows c..d: the same interval, or apart."""
        if b <= a or d <= c:
            return
        same = a == c
        if not same:
            (low, high), (low2, high2) = self.box(a, b), self.box(c, d)
            gap = np.maximum(0, np.maximum(low - high2, low2 - high))
            if gap @ gap > self.limit:
                return  # provably distant
        if max(b - a, d - c) <= LEAF_ROWS:
            self._leaf(a, b, c, d, same)
            return
        m, k = (a + b) // 2, (c + d) // 2
        self.join(a, m, c, k)
        self.join(m, b, k, d)
        self.join(a, m, k, d)
        if not same:
            self.join(m, b, c, k)

    def _leaf(self, a: int, b: int, c: int, d: int, same: bool) -> None:
        close = self.x[a:b] @ self.x[c:d].T >= self.threshold
        if same:
            np.fill_diagonal(close, False)
        if not close.any():
            return
        self.links[a:b] += close @ self.copies[c:d]
        if not same:
            self.links[c:d] += close.T @ self.copies[a:b]
        i, j = np.nonzero(close)
        self.forest.join(i + a, j + c)


def _joined(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """Per block pair and row with links: rep, links, root (a row of the pair that hangs together with it)."""
    width = len(axes)
    sides = (pairs.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side"))
             .unionByName(pairs.where("a < b").select("a", "b", F.col("b").alias("block"), F.lit(1).alias("side"))))
    dealt = sides.join(blocks.select("block", "rep", "copies", "embedding",
                                     F.struct(*[c for c in blocks.columns if c[0] == "c" and c[1:].isdigit()]).alias("cell")),
                       "block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cell=[tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in pdf["cell"]])
        pdf = pdf.sort_values(["side", "cell", "rep"], kind="stable")
        work = IntervalJoin(unit_rows(pdf["embedding"].to_list(), width), axes,
                            pdf["copies"].to_numpy(np.int64), threshold)
        n, m = len(pdf), int((pdf["side"] == 0).sum())
        if m == n and pdf["a"].iloc[0] == pdf["b"].iloc[0]:
            work.join(0, n, 0, n)
        else:
            work.join(0, m, m, n)
        rep, linked = pdf["rep"].to_numpy(), work.links > 0
        return pd.DataFrame({"rep": rep[linked], "links": work.links[linked], "root": rep[work.forest.root[linked]]})

    return dealt.groupBy("a", "b").applyInPandas(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    ``n_links``: other rows with a cosine of at least ``threshold``;
    ``component_id``: smallest id reachable over links; ``kept``: whether that
    is the row itself. Identical vectors are compared once and counted as often as they
    occur. Vectors that are null, empty, all zero or hold a null, NaN or
    infinity link with nothing; so do rows with a null id (component null, not
    kept). Shorter vectors count as padded with zeros. Rows that share an id
    share a component and the sum of their links. An empty table gives an empty
    result; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    classes = store(_classes(own), "vector-classes")
    width = classes.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:  # no usable vector: nothing links
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                          F.col("vec_id").isNotNull().alias("kept"))
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    axes = principal_axes(classes, width)
    blocks = _in_grid_order(classes, axes, epsilon, block_rows)
    pairs = _block_pairs(blocks, min(GRID_AXES, width))
    found = store(_joined(blocks, pairs, axes, threshold), "vector-links")
    roots = connected_components(found.select("rep", "root"), "rep", "root")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = (classes.select("embedding", "rep", "copies").join(totals, "rep", "left")
             .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                     F.coalesce("root", "rep").alias("component")))
    usable = F.when(F.col("vec_id").isNotNull(), F.col("embedding"))
    return (own.withColumn("embedding", usable).join(state, "embedding", "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept")))
