"""Importance resampling towards a target distribution.

Texts become hashed word-run counts. The log-ratio of the target's and the
corpus' bucket shares is one array of gains; a document's weight is the mean
gain of its features, and Gumbel noise from its id turns the heaviest scores
into a sample without replacement.

The drawn documents are found by distributed quickselect: random pivot keys,
the exact numbers of rows below, at and above each of them, and the rows
between the two pivots around the wanted place go on to the next round. Only the
winners are sorted and ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, id_text, record_batch, ship_package, store

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
PIVOTS = 31
SLICE = 1 << 20  # bytes of a text that are words at one time
MASK_33 = (1 << 33) - 1  # row part of monotonically_increasing_id

# Letters, digits and all bytes beyond ASCII make words; A-Z become a-z.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


# --- features and weights -----------------------------------------------------------

def feature_buckets(text: str | None, longest: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the runs that end in them) of a text, slice by slice."""
    data = (text or "").encode().translate(_FOLD)
    carry: list[bytes] = []
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + SLICE)
        stop = len(data) if stop < 0 else stop
        new = data[at:stop].split()
        words, before, at = carry + new, len(carry), stop
        hashes = list(map(zlib.crc32, new))
        for n in range(2, longest + 1):
            hashes += [zlib.crc32(b" ".join(words[i - n + 1:i + 1])) for i in range(max(before, n - 1), len(words))]
        carry = words[-(longest - 1):] if longest > 1 else []
        if new:
            yield len(new), np.array(hashes, np.int64) % buckets


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; each task sends one row per bucket that it met."""
    ship_package(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield record_batch({"bucket": met, "n": total[met]}, schema)

    rows = (texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed target and source shares, rounded down, per bucket."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_source + buckets)
                                                / (float(s + 1) * float(all_target + buckets))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a standard Gumbel variate made from the id (a null id: from the empty text)."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1,
           seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_features", "weight", "score")}
        ids = batch.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, batch.column("text"), strict=True):
            n_words = n_features = total = 0
            for n, found in feature_buckets(text.as_py(), longest, len(shared.value)):
                n_words += n
                n_features += len(found)
                total += int(shared.value[found].sum())
            weight = total // n_features if n_features else 0
            for name, value in zip(out, (n_words, n_features, weight, weight + gumbel(doc_id, seed)), strict=True):
                out[name].append(value)
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, n_words long, n_features long, weight long, score long")


# --- quickselect --------------------------------------------------------------------

_KEY = ("down", "unnamed", "doc_id", "n_features", "row")


def _key() -> Column:
    """Composite key in drawing order: score downwards, then id (null last); ``row`` parts equal rows."""
    return F.struct((-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("unnamed"),
                    F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "n_features", "row")


def _literal(key) -> Column:
    return F.struct(*[F.lit(key[c]).cast("boolean" if c == "unnamed" else "long").alias(c) for c in _KEY])


def kth_key(keys: DataFrame, k: int, n_pivots: int = PIVOTS, salt: int = 0):
    """The ``k``-th smallest (from 1) of the distinct structs in column ``key``.

    A round takes ``n_pivots`` random keys of the rows left, counts the rows
    below and at each, and stores the rows strictly between the two pivots
    around the wanted place, about one in ``n_pivots`` + 1, for the next round.
    The driver holds the pivots and their counts only.
    """
    rest, turn = keys.select("key"), 0
    while True:
        turn += 1
        drawn = rest.orderBy(F.xxhash64("key", F.lit(salt + turn)), "key").limit(n_pivots).collect()
        pivots = sorted((r["key"] for r in drawn), key=tuple)
        if not pivots:
            raise ValueError("fewer rows than the place asked for")
        lower = F.size(F.filter(F.array(*map(_literal, pivots)), lambda p: p < F.col("key")))
        equal = F.exists(F.array(*map(_literal, pivots)), lambda p: p == F.col("key"))
        counts = {(r["lower"], r["equal"]): r["count"]  # per pivot the rows at it and those right below it
                  for r in rest.groupBy(lower.alias("lower"), equal.alias("equal")).count().collect()}
        low, below = None, 0
        for i, p in enumerate(pivots):
            upto = below + counts.get((i, False), 0)
            if k <= upto:
                break
            if k <= upto + counts[i, True]:
                if turn > 1:
                    discard(rest)
                return p
            low, below = p, upto + counts[i, True]
        inside = F.lit(True) if low is None else F.col("key") > _literal(low)
        if k <= upto:
            inside &= F.col("key") < _literal(p)
        narrowed = store(rest.where(inside), "quickselect")
        if turn > 1:
            discard(rest)
        rest, k = narrowed, k - below


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` 1, 2, 3 … by :func:`_key`: one sort by ranges, then the ranges' sizes before each row."""
    place = F.monotonically_increasing_id()  # partition number, then row within the sorted partition; stored once
    table = store(winners.orderBy(_key()).withColumn("place", place), "resampled")
    part = F.shiftright("place", 33)
    before, total = [], 0
    for r in sorted(table.groupBy(part.alias("part")).count().collect()):  # one row per partition
        before.append((r["part"], total))
        total += r["count"]
    offsets = F.broadcast(table.sparkSession.createDataFrame(before, "part long, before long"))
    return (table.withColumn("part", part).join(offsets, "part")
            .withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit(MASK_33)) + 1)
            .drop("part", "before", "place"))


# --- the operator -------------------------------------------------------------------

def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs``.

    Of the N rows with at least ``min_words`` words, floor(``percent`` N / 100) are
    drawn: the highest scores, ties to the smaller id; ``rank`` is their place,
    null for the others. Null and empty texts have no features and weight 0. A
    null id is drawn from its own noise and comes last among equal scores. Repeated rows
    each count and may each be drawn; rows equal in score and id are drawn in the order of
    their features. Very long texts are read whole, in slices. Empty tables, of documents or of
    the target, give an empty result or gains of an empty target. Further
    columns are ignored. The scores are stored once, so that every round of the selection sees
    the same rows.
    """
    own = id_text(docs, id_col, text_col)
    gain = gains(bucket_counts(own, "text", longest, buckets), bucket_counts(target, target_col, longest, buckets))
    table = store(scored(own, gain, longest=longest, seed=seed).withColumn("row", F.monotonically_increasing_id()),
                  "importance")
    wide = F.col("n_words") >= min_words
    k = percent * table.where(wide).count() // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not k:
        return table.select(*names, F.lit(None).cast("long").alias("rank"))
    last = _literal(kth_key(table.where(wide).select(_key().alias("key")), k, salt=seed))
    drawn = wide & (_key() <= last)
    return (ranked(table.where(drawn)).select(*names, "rank")
            .unionByName(table.where(~drawn).select(*names, F.lit(None).cast("long").alias("rank"))))
