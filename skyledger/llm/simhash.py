"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to many reference
fingerprints. By the triangle inequality two fingerprints within k bits differ
by at most k in each of these coordinates, so pairs with a larger maximum
difference are discarded and only the survivors are compared bit by bit.

The coordinates alone do not cut the corpus into independent tasks, so rows are
dealt by bit blocks: two fingerprints within k bits agree on one of k + 1
blocks. A block value with very many rows is dealt again as pairs of bounded chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import arrow_map, id_text, internal_name, internal_names, release, ship_package, store
from .components import PlaceForest, connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
PIVOTS = 32
CHUNK_ROWS = 8192
HASH_SEED = 42


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ``text``, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], HASH_SEED)
                       for a, b in zip(starts.tolist(), ends[k - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at:at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        bits = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column("text")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "bits": pa.array(bits.view(np.int64))}

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, bits long")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of max_bits + 1 blocks that share out the 64 bits."""
    edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def pivots(n: int) -> np.ndarray:
    """Reference fingerprints, the same on every machine."""
    return np.random.default_rng(64).integers(0, 2**64, n, dtype=np.uint64)


def close_pairs(cell: np.ndarray, side: np.ndarray, bits: np.ndarray, max_bits: int, reference: np.ndarray) -> np.ndarray:
    """Positions' roots after joining all pairs within ``max_bits`` of the same cell.

    ``side``: 0 compares with all of its cell; 1 and 2 only with each other
    (two chunks of one block value, each compared within itself elsewhere).
    """
    table = np.bitwise_count(bits[:, None] ^ reference[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], cell))
    forest = PlaceForest(len(bits))
    cell, side, sorted_bits, table, place = cell[order], side[order], bits[order], table[order], order
    left = np.arange(len(bits) - 1)
    step = 1
    while len(left):
        right = left + step
        # Sorted by the first coordinate: once too far apart, all later ones are too.
        left = left[(cell[left] == cell[right]) & (table[right, 0] - table[left, 0] <= max_bits)]
        a, b = left, left + step
        keep = (side[a] != side[b]) | (side[a] == 0)
        a, b = a[keep], b[keep]
        keep = forest.root[place[a]] != forest.root[place[b]]  # already known to hang together
        a, b = a[keep], b[keep]
        for at in range(1, table.shape[1], 4):
            if len(a):
                far = np.abs(table[a, at:at + 4] - table[b, at:at + 4]).max(1) > max_bits
                a, b = a[~far], b[~far]
        near = np.bitwise_count(sorted_bits[a] ^ sorted_bits[b]) <= max_bits
        if near.any():
            forest.join(place[a[near]], place[b[near]])
        step += 1
        left = left[left + step < len(bits)]
    return forest.root


def links(distinct: DataFrame, max_bits: int = MAX_BITS, n_pivots: int = PIVOTS,
          chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edges ``a, b`` that span, cell by cell, all pairs of ``bits`` within ``max_bits``.

    Pairs that a cell already joins through other rows are not listed, so a
    group of near copies gives as many edges as rows, not pairs.
    """
    block_keys = [F.struct(F.lit(i).alias("block"),
                           F.shiftrightunsigned("bits", a).bitwiseAND(F.lit((1 << w) - 1)).alias("value"))
                  for i, (a, w) in enumerate(_blocks(max_bits))]
    keyed = distinct.select("bits", F.explode(F.array(*block_keys)).alias("k")).select("bits", "k.*")
    sizes = (keyed.groupBy("block", "value").count()
             .select("block", "value", F.ceil(F.col("count") / chunk_rows).cast("int").alias("chunks"))
             .where("count > 1"))
    own = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    cells = (keyed.join(sizes, ["block", "value"]).withColumn("own", own)
             .select("bits", "block", "value", "own",
                     F.explode(F.expr("sequence(0, chunks - 1)")).alias("other"))
             .select("bits", F.xxhash64("block", "value", F.least("own", "other"),
                                        F.greatest("own", "other")).alias("cell"),
                     F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side")))
    reference = pivots(n_pivots)

    def edges(cell: np.ndarray, side: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        root = close_pairs(cell, side, bits.view(np.uint64), max_bits, reference)
        child = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(bits[child]), pa.array(bits[root[child]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "side", "bits")])
            open_at = np.searchsorted(rows[0], rows[0, -1])  # the last cell may go on in the next batch
            if held and held[0][0, 0] == rows[0, -1]:
                held.append(rows)
                continue
            done = np.concatenate([*held, rows[:, :open_at]], axis=1)
            held = [rows[:, open_at:]]
            if done.shape[1] > 1:
                yield edges(*done)
        if held:
            yield edges(*np.concatenate(held, axis=1))

    return (cells.repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(run, "a long, b long"))


def _classes(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Distinct fingerprints with the ``root`` fingerprint of their group."""
    distinct = store(distinct, "distinct-fingerprints")
    roots = connected_components(links(distinct.select("bits"), max_bits))
    return (distinct.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
            .withColumn("root", F.coalesce("root", "bits")))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs``, all columns, per group of near-duplicates: the one with the least id.

    A null id comes after all others; of rows that share the least id and its
    fingerprint one stays, the least text first. Null and empty texts share fingerprint
    zero, very long ones are read whole, an empty table gives an empty result,
    and columns may have any names.
    """
    ship_package(docs.sparkSession)
    columns, id_col, text_col = docs.columns, internal_name(docs, id_col), internal_name(docs, text_col)
    docs = internal_names(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), words_per_shingle) for t in batch.column(text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.view(np.int64))],
                                             [*batch.schema.names, "_bits"])

    marked = store(docs.mapInArrow(mark, StructType([*docs.schema.fields, StructField("_bits", LongType())])),
                   "marked-documents")
    place = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    classes = _classes(marked.groupBy(F.col("_bits").alias("bits")).agg(F.min(place).alias("first_id")), max_bits)
    keepers = (classes.groupBy("root").agg(F.min(F.struct("first_id", "bits")).alias("k"))
               .select(F.col("k.first_id").alias("_place"), F.col("k.bits").alias("_bits")))
    same = Window.partitionBy("_place", "_bits").orderBy(text_col)
    return (marked.withColumn("_place", place).join(keepers, ["_place", "_bits"])
            .withColumn("_row", F.row_number().over(same)).where("_row = 1").select(*docs.columns).toDF(*columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, bits, component_id`` of every row.

    ``component_id`` is the smallest id reachable over links of at most
    ``max_bits`` differing bits. Null and empty texts have fingerprint zero and
    link like any other; repeated rows each get a row; a null id keeps its row
    and never is a component's id unless all its ids are null. An empty table gives an empty result;
    further columns are ignored.
    """
    marked = store(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    classes = _classes(marked.groupBy("bits").agg(F.min("doc_id").alias("first_id")), max_bits)
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return (marked.join(classes.join(least, "root").select("bits", "component_id"), "bits")
            .select("doc_id", "bits", "component_id"))
