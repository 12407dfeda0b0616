"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a chunk ends where the hash matches a
mask that is strict before the normal chunk size and loose after it. The
fingerprint is the set of chunk digests, each with its chunk's length; the
likeness of two is the shared length over the smaller one's (containment).
Boundaries depend on nearby bytes only, so an insertion moves no far chunk.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, record_batch

MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 8, 16, 64
STRICT_BITS, LOOSE_BITS = 5, 3
WINDOW = 16  # bytes that a 16-bit gear hash depends on
_GEAR = np.random.default_rng(7).integers(0, 1 << 16, 256, dtype=np.uint16)
_LENGTH_MASK = np.uint64(127)  # a chunk's length stands in the low bits of its digest


def _gear_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash after every byte, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint16(width)
    return h


def chunk_ends(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` from the boundary ``start`` on."""
    n = len(data)
    if start >= n:
        return []
    base = max(0, start - WINDOW)
    top = _gear_hash(np.frombuffer(data, np.uint8)[base:])
    loose_at = np.flatnonzero(top >> np.uint16(16 - LOOSE_BITS) == 0)
    strict = (top[loose_at] >> np.uint16(16 - STRICT_BITS) == 0).tolist()
    cuts = (loose_at + base + 1).tolist()  # a chunk ends after the byte that matches
    ends, k, m = [], 0, len(cuts)
    while start < n:
        least, normal, most = start + MIN_SIZE, start + NORMAL_SIZE, min(start + MAX_SIZE, n)
        while k < m and cuts[k] < least:
            k += 1
        while k < m and cuts[k] < normal and not strict[k]:
            k += 1
        start = cuts[k] if k < m and cuts[k] < most else most
        ends.append(start)
    return ends


def digests(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(data[a:b]) & ~127 | (b - a) for a, b in zip([start, *ends], ends)]


def as_set(values: list[int]) -> np.ndarray:
    return np.unique(np.array(values, np.uint64))


def to_text(prints: np.ndarray) -> str:
    return base64.b64encode(prints.astype("<u8").tobytes()).decode("ascii")


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Shared chunk length over the smaller set's; two empty sets are alike, an empty and another not."""
    total = min(int((a & _LENGTH_MASK).sum()), int((b & _LENGTH_MASK).sum()))
    if not total:
        return float(len(a) == len(b))
    return int((np.intersect1d(a, b, assume_unique=True) & _LENGTH_MASK).sum()) / total


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    return to_text(as_set(digests(data, chunk_ends(data))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row; null text counts as empty (empty fingerprint)."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fingerprint": [fingerprint(t.as_py()) for t in batch.column("text")]}

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, key: str, text: str, per_partition: int = 4) -> DataFrame:
    """Rows in order of ``key``, then of a hash of ``text``, dealt by ranges of both and sorted; each range is
    followed by the next range's first rows.

    Adds ``_range`` and ``_ahead`` (1: a copy from the next range, after the
    last the first). One shuffle: range bounds are quantiles of the key, and a key
    that fills several ranges is cut by the hash into as many, so rows of one key spread
    unless their texts are equal too. The driver gets the bounds and the first row's key and hash of every
    range. Null keys stand first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition
    order = F.coalesce(F.col(key), F.lit(-(2**63)))
    keyed = docs.withColumn("_order", order).withColumn("_mix", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    places = keyed.select(F.col("_order").cast("double").alias("_place"))
    bounds = Counter(places.approxQuantile("_place", [i / parts for i in range(1, parts)], 0.2 / parts))
    splits = [-float("inf"), *(sorted(bounds) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_place", outputCol="_cell").transform(
        keyed.withColumn("_place", F.col("_order").cast("double")))
    # Keys that are a bound several times: cell, key and number of slices, one row for two ranges at most.
    hot = [(float(i), int(b), bounds[b]) for i, b in enumerate(splits[1:-1], 1) if bounds[b] > 1]
    widest = max((n for _, _, n in hot), default=0)
    number = F.col("_cell").cast("long") * (widest + 2)
    if hot:
        table = spark.createDataFrame(hot, "_cell double, _key long, _slices long")
        dealt = dealt.join(F.broadcast(table), "_cell", "left")
        share = F.col("_mix") / F.lit(2.0**64) + 0.5
        place = F.least(F.floor(share * F.col("_slices")), F.col("_slices") - 1) + 1
        number += (F.when(F.col("_order") == F.col("_key"), place)
                   .when(F.col("_order") > F.col("_key"), F.col("_slices") + 1).otherwise(0))
    dealt = dealt.withColumn("_range", number)
    firsts = sorted(dealt.groupBy("_range").agg(F.min(F.struct("_order", "_mix")).alias("first")).collect())
    targets = [(*first, int(firsts[i - 1][0])) for i, (_, first) in enumerate(firsts)]
    heads = F.broadcast(spark.createDataFrame(targets, "_order long, _mix long, _before long"))  # one row per range
    places = F.array(F.struct(F.col("_range"), F.lit(0).alias("_ahead")),
                     F.struct(F.col("_before").alias("_range"), F.lit(1).alias("_ahead")))
    return (dealt.join(heads, ["_order", "_mix"], "left").withColumn("_at", F.explode(places))
            .where(F.col("_at._range").isNotNull())
            .select(*docs.columns, "_at._range", "_at._ahead", "_order", "_mix")
            .repartition("_range").sortWithinPartitions("_range", "_ahead", "_order", "_mix", text).drop("_order", "_mix"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      replaced: int = 4) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Documents stand in the order of id, then of a hash of the text, so that rows of one id
    can be dealt apart. The edited text is the text
    whose last 1/``replaced`` of its code points (rounded down) gives way to as
    many, or all, of the next document's first ones; after the last comes the first.
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Null text counts as empty, null ids stand first, repeated
    rows follow each other; very long texts are read whole; further columns are
    ignored; an empty table gives an empty result.
    """
    target = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def finished(doc: tuple, next_text: str, next_set: np.ndarray) -> tuple:
        doc_id, text, data, ends, values, own = doc
        cut = len(text) // replaced
        keep = text[:len(text) - cut]
        edited_text = keep + next_text[:cut]
        if cut:
            edited = edited_text.encode()
            kept = len(keep.encode())
            shared = int(np.searchsorted(ends, kept, "right"))  # chunks that end before the edit stay
            at = ends[shared - 1] if shared else 0
            if at == kept == len(edited):
                edited_set = as_set(values[:shared])
            else:
                edited_set = as_set(values[:shared] + digests(edited, chunk_ends(edited, at), at))
        else:
            edited, edited_set = data, own
        return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), to_text(own), to_text(edited_set),
                containment(own, edited_set), containment(own, next_set))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            rows = []
            for doc_id, text, ahead in zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                                           batch.column("_ahead").to_pylist(), strict=True):
                if ahead and waiting is None:
                    continue
                text = text.as_py() or ""
                data = text.encode()
                ends = chunk_ends(data)
                values = digests(data, ends)
                own = as_set(values)
                if waiting is not None:
                    rows.append(finished(waiting, text, own))
                waiting = None if ahead else (doc_id, text, data, ends, values, own)
            if rows:
                yield record_batch(dict(zip(target.names, map(list, zip(*rows, strict=True)), strict=True)), target)

    return in_order(id_text(docs, id_col, text_col), "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
