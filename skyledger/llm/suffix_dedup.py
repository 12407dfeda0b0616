"""Repeated passages removed by longest-previous-factor arrays.

A byte goes if a string of ``min_length`` bytes that covers it also starts in a
document with a smaller id. Within a task the windows of that length are put in
suffix order; for each, the nearest windows above and below it that belong to a
smaller id bound the longest earlier match (the previous-factor length), and
windows whose previous factor reaches ``min_length`` are removed.

To bring equal windows together without moving every suffix, a window is named
by the least hash among its short grams: equal windows have equal names, and
neighbours mostly share one, so a document is a sequence of *runs* of windows.
Only names seen in two documents go on, as the bytes of their runs.

Steps: names per document, packed by name range (one shuffle of a few bytes per
run); the shared ones back to their documents (small); the bytes of shared runs
dealt by name to the suffix tasks; removed spans back to the documents. Exact copies of
a whole document are found by digest and send nothing.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import arrow_map, internal_name, internal_names, record_batch, release, ship_package, store

MIN_LENGTH = 50
GRAM = 16
HOT_DOCUMENTS = 4096
MAX_HOT_NAMES = 1_000_000
SLICE = 1 << 22
FLUSH_BYTES = 1 << 18  # sorted at once: the sort's columns (some 60 bytes a window) stay near the core's cache
HEAD = 2  # columns of eight bytes that are sorted for all windows
KEY_SEED = 42  # of Spark's xxhash64
_LAST = (1 << 63) - 1  # stands for a null id: later than all


# --- window names -----------------------------------------------------------------

def _gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed polynomial hash of every ``size``-byte gram, put together from powers of two."""
    levels = [(1, (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 0x100000001B3)]
    while 2 * levels[-1][0] <= size:
        width, h, factor = levels[-1]
        levels.append((2 * width, h[:-width] * np.uint64(factor) + h[width:], factor * factor % 2**64))
    done, out, _ = levels[-1]
    for width, h, factor in reversed(levels):
        if done + width <= size:
            out = out[:len(data) - done - width + 1] * np.uint64(factor) + h[done:]
            done += width
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    low, n = values, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    return low if n == width else np.minimum(low[:len(values) - width + 1], low[width - n:])


def runs(data: np.ndarray, min_length: int, gram: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first windows and numbers of windows of the runs of a text (``bits`` high bits of each hash)."""
    found = []
    for at in range(0, max(0, len(data) - min_length + 1), SLICE):
        part = data[at:at + SLICE + min_length - 1]
        names = _sliding_min(_gram_hash(part, gram), min_length - gram + 1) >> np.uint64(64 - bits)
        first = np.concatenate(([0], np.flatnonzero(names[1:] != names[:-1]) + 1))
        found.append((names[first], first + at, np.concatenate((first[1:], [len(names)])) - first))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# --- previous factors -------------------------------------------------------------

def _nearest_smaller(doc: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Per place, the shared length with the nearest earlier place of a smaller doc (0: none).

    ``shared[i]`` is the length that places i-1 and i share. Candidates jump
    over places that cannot be the answer, so the jumps double.
    """
    at = np.arange(len(doc)) - 1
    length = shared.copy()
    todo = np.flatnonzero((at >= 0) & (doc[at] >= doc))
    while len(todo):
        via = at[todo]
        length[todo] = np.minimum(length[todo], length[via])
        at[todo] = at[via]
        todo = todo[at[todo] >= 0]
        todo = todo[doc[at[todo]] >= doc[todo]]
    length[at < 0] = 0
    return length


def _suffix_order(columns: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Windows in suffix order, equal ones by doc.

    The first :data:`HEAD` columns are sorted for all windows, the others only for windows
    that share those with one of another end. All sorts are stable and start from the order of docs.
    """
    by_doc = np.arange(len(doc)) if (doc[1:] >= doc[:-1]).all() else np.argsort(doc, kind="stable")
    order = by_doc[np.lexsort([c[by_doc] for c in reversed(columns[:HEAD])])]
    same_head, apart = np.ones(max(0, len(doc) - 1), bool), np.zeros(max(0, len(doc) - 1), bool)
    for w, column in enumerate(columns):
        ranked = column[order]
        if w < HEAD:
            same_head &= ranked[1:] == ranked[:-1]
        else:
            apart |= ranked[1:] != ranked[:-1]
    apart &= same_head
    if apart.any():
        group = np.concatenate(([0], np.cumsum(~same_head)))
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][apart]] = True
        at = np.flatnonzero(mixed[group])
        own = order[at]
        order[at] = own[np.lexsort([*(c[own] for c in reversed(columns[HEAD:])), group[at]])]
    return order


def previous_factors(data: np.ndarray, window: np.ndarray, doc: np.ndarray, depth: int) -> np.ndarray:
    """Longest match, up to ``depth`` bytes, of each window with a window of a smaller doc.

    ``window``: starts in ``data``, each with ``depth`` bytes behind it.
    """
    words = -(-depth // 8)
    padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
    word_at = np.lib.stride_tricks.sliding_window_view(padded, 8)
    columns = []
    for w in range(words):
        column = np.ascontiguousarray(word_at[window + 8 * w]).view(">u8").ravel().astype(np.uint64)
        spare = 8 * (w + 1) - depth
        columns.append(column >> np.uint64(8 * spare) << np.uint64(8 * spare) if spare > 0 else column)
    order = _suffix_order(columns, doc)
    shared = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for w, column in enumerate(columns):
        ranked = column[order]
        apart = ranked[1:] ^ ranked[:-1]
        first = np.flatnonzero(same & (apart != 0))  # neighbours that part in this column
        apart = apart[first]
        shared[first + 1] = 8 * w + sum((apart < np.uint64(1 << 64 - 8 * b)).astype(np.int64) for b in range(1, 8))
        same[first] = False
    shared[1:][same] = depth
    ranked_doc = doc[order]
    above = _nearest_smaller(ranked_doc, shared)
    below = _nearest_smaller(ranked_doc[::-1], np.concatenate(([0], shared[1:][::-1]))[:len(order)])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(above, below)
    return out


# --- spans ------------------------------------------------------------------------

def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Union of [start, end) spans as rows (start, end), in order."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))
    return np.stack([starts[new], reach[last]], axis=1)


# --- step 1: shared names per document ---------------------------------------------

_PACKET = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _planes(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bytes of the values, byte by byte: the constant ones compress to nothing."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(payload: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(payload, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def _packets(name: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows of one batch of (name, doc), distinct: a record per name and, for names of several docs
    here, the names each such doc shares (known already, so only the first of them stands for all).
    Records are dealt by name, lists of known names by document."""
    order = np.argsort(name, kind="stable")
    name, doc = name[order], doc[order]
    first = np.concatenate(([True], name[1:] != name[:-1]))
    group = np.cumsum(first) - 1
    size = np.bincount(group)
    many = size[group] > 1
    if many.any():
        by_doc = np.argsort(doc[many], kind="stable")
        d, k = doc[many][by_doc], name[many][by_doc]
        cuts = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(d))):
            yield int(d[a]) * 2_654_435_761 % 2**32 % buckets, 1, d[a:a + 1].tobytes() + k[a:b].astype("<u8").tobytes()
    name, doc = name[first], doc[first]
    count = np.minimum(size, 65535)
    bucket = (name >> np.uint64(48)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(name))):
        yield int(bucket[a]), 0, (_planes(name[a:b], 6) + _planes(doc[a:b].view(np.uint64), 8)
                                  + _planes(count[a:b].astype(np.uint64), 2))


def _names(docs: DataFrame, min_length: int, gram: int, bits: int, flush_runs: int = 500_000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: dict[bytes, int] = {}
        names, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if names:
                rows = list(_packets(np.concatenate(names), np.concatenate(ids), 1 << bits - 48))
                for at in range(0, len(rows), 2000):
                    part = rows[at:at + 2000]
                    yield record_batch(dict(zip(_PACKET.names, map(list, zip(*part, strict=True)), strict=True)), _PACKET)

        for batch in batches:
            for doc, text in zip(batch.column("d").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < min_length:
                    continue
                digest = xxhash.xxh3_128_digest(raw)
                if seen.get(digest, doc + 1) <= doc:
                    continue  # a copy of a text that this task has named already
                if len(seen) > 100_000:
                    seen.clear()
                seen[digest] = doc
                own = np.unique(runs(np.frombuffer(raw, np.uint8), min_length, gram, bits)[0])
                names.append(own)
                ids.append(np.full(len(own), doc, np.int64))
                held += len(own)
                if held >= flush_runs:
                    yield from flush()
                    names, ids, held = [], [], 0
        yield from flush()

    return docs.select("d", "text").mapInArrow(run, "bucket int, kind int, payload binary")


_SHARED = pa.schema([("d", pa.int64()), ("name", pa.int64()), ("names", pa.binary()), ("hot", pa.bool_())])


def _shared_names(packets: DataFrame, hot_documents: int) -> DataFrame:
    """(d, name) or (d, names): shared names of a document, one or a list; rows with ``hot`` list names
    held by very many documents."""

    def bucket_pairs(bucket: int, payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        """Shared (name, doc) records of a bucket, and its rows of hot names."""
        parts = []
        for p in payloads:
            n = len(p) // 16
            parts.append((_from_planes(p, 0, n, 6), _from_planes(p, 6 * n, n, 8), _from_planes(p, 14 * n, n, 2)))
        name, doc, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        name, doc = name | np.uint64(bucket << 48), doc.view(np.int64)
        order = np.argsort(name, kind="stable")
        name, doc, count = name[order], doc[order], count[order].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        total = np.add.reduceat(count, cuts)
        hot = total > hot_documents
        rows = [(None, None, np.stack([name[cuts][hot], total[hot].astype(np.uint64)], 1).astype("<u8").tobytes(), True)]
        apart = np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts)
        keep = np.repeat(apart, np.diff(cuts, append=len(name)))
        return name[keep], doc[keep], rows if hot.any() else []

    def by_name(name: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per shared name and document, so the rows follow the names, not the tasks."""
        for at in range(0, len(name), 50_000):
            part = name[at:at + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc[at:at + 50_000]), pa.array(part),
                                              pa.nulls(len(part), pa.binary()), pa.array([False] * len(part))],
                                             schema=_SHARED)

    def send(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 5000):
            yield record_batch(dict(zip(_SHARED.names, map(list, zip(*rows[at:at + 5000], strict=True)), strict=True)),
                               _SHARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads: list[bytes] = []
        now = None

        def finish() -> Iterator[pa.RecordBatch]:
            if payloads:
                name, doc, rows = bucket_pairs(now, payloads)
                payloads.clear()
                yield from send(rows)
                yield from by_name(name, doc)

        for batch in batches:
            known = []
            for bucket, kind, payload in zip(*(batch.column(c).to_pylist() for c in _PACKET.names), strict=True):
                if kind:
                    known.append((int.from_bytes(payload[:8], "little", signed=True), None, payload[8:], False))
                    continue
                if bucket != now:
                    yield from finish()
                now = bucket
                payloads.append(payload)
            yield from send(known)
        yield from finish()

    return (packets.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "d long, name long, names binary, hot boolean"))


# --- step 2: the bytes of shared runs ------------------------------------------------

def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the values are wanted ones; cheaper than numpy's for a few thousand."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    wanted = np.sort(wanted)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


_PIECE = pa.schema([("deal", pa.int64()), ("d", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()),
                    ("n", pa.int64()), ("bytes", pa.binary())])


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _pieces(joined: DataFrame, text_col: str, hot_names: np.ndarray, min_length: int, gram: int, bits: int) -> DataFrame:
    """Runs of shared names as bytes, dealt by name; hot names window by window, dealt by the window.

    A piece whose bytes this task has met in a smaller doc is removed at once
    (null bytes), so a passage in very many documents is sent once per task.
    """
    hot = joined.sparkSession.sparkContext.broadcast(hot_names)  # at most MAX_HOT_NAMES

    def pieces(doc: int, raw: bytes, single: np.ndarray, names: list[bytes], met: dict) -> Iterator[tuple]:
        key = _signed(xxhash.xxh64_intdigest(raw, KEY_SEED))
        name, first, n = runs(np.frombuffer(raw, np.uint8), min_length, gram, bits)
        mine = _among(name, np.concatenate([single.view(np.uint64), np.frombuffer(b"".join(names), "<u8")]))
        name, first, n = name[mine], first[mine], n[mine]
        split = np.isin(name, hot.value) if len(hot.value) else np.zeros(len(name), bool)
        gone_at, gone = 0, 0  # neighbouring windows removed at once go into one row
        for k, a, m, by_window in zip(name.view(np.int64).tolist(), first.tolist(), n.tolist(), split.tolist()):
            for at, windows in [(a + i, 1) for i in range(m)] if by_window else ((a, m),):
                own = raw[at:at + windows + min_length - 1]
                if met.get(own, doc) < doc:
                    if gone and gone_at + gone != at:
                        yield key, doc, key, gone_at, gone, None
                        gone = 0
                    gone_at, gone = at - gone, gone + windows
                    continue
                if len(met) >= 100_000:
                    met.clear()
                met[own] = doc
                yield _signed(xxhash.xxh64_intdigest(own, 1)) if by_window else k, doc, key, at, windows, own
        if gone:
            yield key, doc, key, gone_at, gone, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, int] = {}
        rows: list[tuple] = []
        for batch in batches:
            for doc, text, single, names, copies in zip(batch.column("_d").to_pylist(), batch.column(text_col),
                                                batch.column("_name"), batch.column("_names").to_pylist(),
                                                batch.column("_copies").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) < min_length:
                    continue
                key = _signed(xxhash.xxh64_intdigest(raw, KEY_SEED))
                if key in (copies or ()):
                    rows.append((key, doc, key, 0, len(raw) - min_length + 1, None))
                    continue
                found = pieces(doc, raw, single.values.to_numpy(), names or [], met)
                while True:
                    rows += itertools.islice(found, max(0, 20_000 - len(rows)))
                    if len(rows) < 20_000:
                        break
                    yield record_batch(dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)), _PIECE)
                    rows = []
        if rows:
            yield record_batch(dict(zip(_PIECE.names, map(list, zip(*rows, strict=True)), strict=True)), _PIECE)

    return joined.mapInArrow(run, "deal long, d long, text_key long, start long, n long, bytes binary")


# --- step 3: suffix tasks --------------------------------------------------------------

_REMOVED = pa.schema([("d", pa.int64()), ("text_key", pa.int64()), ("spans", pa.binary())])


def _removed(pieces: DataFrame, min_length: int) -> DataFrame:
    """(d, text_key, spans): removed spans of documents, (start, end) pairs of longs."""

    def by_document(d, key, starts, ends) -> pa.RecordBatch:
        if not len(d):
            return record_batch({"d": [], "text_key": [], "spans": []}, _REMOVED)
        order = np.lexsort((key, d))
        d, key, starts, ends = d[order], key[order], starts[order], ends[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (key[1:] != key[:-1])))
        # All texts' spans at once: each text's places are moved behind those of the one before it.
        length = int(ends.max()) + 1
        moved = (np.cumsum(new) - 1) * length
        spans = _spans(starts + moved, ends + moved)
        text = spans[:, 0] // length
        raw = (spans - (text * length)[:, None]).astype("<i8").tobytes()
        cuts = 16 * np.searchsorted(text, np.arange(text[-1] + 2))
        return record_batch({"d": pa.array(d[new]), "text_key": pa.array(key[new]),
                             "spans": [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]}, _REMOVED)

    def suffix_task(columns: list[np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.stack(columns)
        order = np.argsort(rows[0], kind="stable")
        rows, texts = rows[:, order], [texts[i] for i in order]
        # Of equal pieces the first document's stands for all: the later ones go whole.
        first: dict[bytes, int] = {}
        owner = np.fromiter((first.setdefault(t, i) for i, t in enumerate(texts)), np.int64, len(texts))
        later = rows[0, owner] < rows[0]
        if later.any():
            yield by_document(rows[0, later], rows[1, later], rows[2, later],
                              rows[2, later] + rows[3, later] + min_length - 1)
        d, key, start, n = rows[:, ~later]
        texts = [t for t, gone in zip(texts, later.tolist(), strict=True) if not gone]
        data = np.frombuffer(b"".join(texts), np.uint8)
        base = np.cumsum(n + min_length - 1) - (n + min_length - 1)
        piece = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        gone = previous_factors(data, base[piece] + offset, d[piece], min_length) >= min_length
        piece, at = piece[gone], (start[piece] + offset)[gone]
        # neighbouring windows of a piece as one span
        new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1))) if len(at) else np.zeros(0, bool)
        last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(at) - 1])) if len(at) else np.zeros(0, int)
        yield by_document(d[piece[new]], key[piece[new]], at[new], at[last] + min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[np.ndarray] = []
        texts: list[bytes] = []
        held, last_deal = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in ("d", "text_key", "start", "n")])
            own = batch.column("bytes").to_pylist()
            known = np.array([b is None for b in own])
            if known.any():
                yield by_document(rows[0, known], rows[1, known], rows[2, known],
                                  rows[2, known] + rows[3, known] + min_length - 1)
            deal = batch.column("deal").to_numpy()[~known]
            rows, own = rows[:, ~known], [b for b in own if b is not None]
            if not own:
                continue
            # windows of one name must meet: flush only where the name changes
            cut = int(np.searchsorted(deal, deal[-1]))
            if held and held + sum(map(len, own[:cut])) >= FLUSH_BYTES and (cut or last_deal != deal[0]):
                yield from suffix_task(list(np.concatenate([*columns, rows[:, :cut]], axis=1)), texts + own[:cut])
                columns, texts = [rows[:, cut:]], own[cut:]
            else:
                columns.append(rows)
                texts += own
            held, last_deal = sum(map(len, texts)), deal[-1]
        if texts:
            yield from suffix_task(list(np.concatenate(columns, axis=1)), texts)

    return (pieces.repartition("deal").sortWithinPartitions("deal")
            .mapInArrow(run, "d long, text_key long, spans binary"))


# --- the operator ------------------------------------------------------------------------

def _found(docs: DataFrame, id_col: str, text_col: str, min_length: int, hot_documents: int) -> DataFrame:
    """The rows of ``docs`` under internal names, with ``_found``: the removed spans of their id,
    as the suffix tasks gave them."""
    spark = docs.sparkSession
    ship_package(spark)
    id_col, text_col = internal_name(docs, id_col), internal_name(docs, text_col)
    docs = internal_names(docs)
    gram = max(1, min(GRAM, min_length // 3))
    text = F.col(text_col).cast("string")
    base = docs.withColumn("_d", F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = 48 + min(16, max(4, (4 * partitions - 1).bit_length()))

    own = base.select(F.col("_d").alias("d"), text.alias("text"))
    shared = store(_shared_names(_names(own, min_length, gram, bits), hot_documents), "shared-names")
    hot_rows = shared.where("hot").select("names").collect()  # each lists names of over hot_documents documents
    hot = np.frombuffer(b"".join(r["names"] for r in hot_rows), "<u8").reshape(-1, 2)
    hot = hot[np.argsort(hot[:, 1])[::-1][:MAX_HOT_NAMES], 0]

    texts = own.where(F.octet_length("text") >= min_length).select("d", F.md5("text").alias("digest"),
                                                                 F.xxhash64("text").alias("text_key"))
    firsts = texts.groupBy("digest").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = texts.join(firsts, "digest").where("first < d").select("d", "text_key")
    news = (shared.where("NOT hot").select("d", "name", "names", F.lit(None).cast("long").alias("copy"))
            .unionByName(copies.select("d", F.lit(None).cast("long").alias("name"),
                                       F.lit(None).cast("binary").alias("names"), F.col("text_key").alias("copy")))
            .groupBy(F.col("d").alias("_d")).agg(F.collect_list("name").alias("_name"),
                                                 F.collect_list("names").alias("_names"),
                                                 F.collect_set("copy").alias("_copies")))
    # All columns go along, so that both joins read one shuffle of the documents.
    joined = base.join(news, "_d").select(*base.columns, "_name", "_names", "_copies")
    spans = (_removed(_pieces(joined, text_col, hot, min_length, gram, bits), min_length)
             .groupBy(F.col("d").alias("_d")).agg(F.collect_list(F.struct("text_key", "spans")).alias("_found")))

    return base.join(spans, "_d", "left").select(*docs.columns, "_found")


def _own_spans(raw: bytes, found: list | None) -> np.ndarray:
    """Maximal removed spans of a text, in order, from those found under its id."""
    if not found:
        return np.zeros((0, 2), np.int64)
    key = _signed(xxhash.xxh64_intdigest(raw, KEY_SEED))
    parts = [np.frombuffer(f["spans"], "<i8").reshape(-1, 2) for f in found if f["text_key"] == key]
    pairs = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
    return _spans(pairs[:, 0], pairs[:, 1])


def _each_text(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[str | None, bytes, list[tuple[int, int]]]]:
    """Text, its bytes and its removed spans, row by row."""
    for value, found in zip(batch.column(text_col), batch.column("_found").to_pylist(), strict=True):
        text = value.as_py()
        raw = (text or "").encode()
        yield text, raw, [tuple(p) for p in _own_spans(raw, found).tolist()]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                   hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """Every row, all columns, with ``removed_spans``: an array of (start, end) byte pairs.

    Spans are maximal, apart and in order; empty if nothing is removed. Matches
    never cross documents and are judged on the input. Null text counts as
    empty. Rows that share an id remove nothing from each other; a null id is
    later than all others. An empty table gives an empty result; an input
    column named like the result is replaced.
    """
    docs = docs.drop("removed_spans")
    columns, text_name = docs.columns, internal_name(docs, text_col)
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in pairs] for _, _, pairs in _each_text(batch, text_name)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(pair))],
                                             [*columns, "removed_spans"])

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    return _found(docs, id_col, text_col, min_length, hot_documents).mapInArrow(
        run, StructType([*docs.schema.fields, StructField("removed_spans", ArrayType(span))]))


def without_spans(raw: bytes, pairs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in pairs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def kept_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                 hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row: what :func:`repeated_spans` leaves."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> dict:
        rows = [(len(raw), sum(b - a for a, b in pairs), len(pairs),
                 hashlib.sha256(without_spans(raw, pairs)).hexdigest()) for _, raw, pairs in _each_text(batch, "c1")]
        out = zip(*rows, strict=True) if rows else [()] * 4
        return dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, out), strict=True)) | {
            "doc_id": batch.column("c0")}

    return arrow_map(_found(own, "doc_id", "text", min_length, hot_documents), run,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: bytes, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the characters that they cover only in part."""
    out = []
    for a, b in pairs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
                    min_length: int = MIN_LENGTH) -> DataFrame:
    """The rows of ``docs``, all columns, with the spans of :func:`repeated_spans` cut from their texts.

    Whole characters only. ``length_col``, if it is there, becomes the new number of
    code points. Rows left with nothing by the removal go; empty and null texts
    that lost nothing stay. Rows that share an id remove nothing from each other; a null id is later
    than all others. Very long texts are read whole, an empty table gives an
    empty result, and columns may have any names.
    """
    names, text_at = docs.columns, int(internal_name(docs, text_col)[1:])
    length_at = internal_name(docs, length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_each_text(batch, f"c{text_at}"))
            texts = [without_spans(raw, whole_characters(raw, pairs)).decode() if pairs else text
                     for text, raw, pairs in rows]
            columns = batch.columns[:-1]
            columns[text_at] = pa.array(texts, pa.string())
            if length_at:
                changed = [len(t) if row[2] else n
                           for t, row, n in zip(texts, rows, batch.column(length_at).to_pylist(), strict=True)]
                columns[int(length_at[1:])] = pa.array(changed, batch.column(length_at).type)
            keep = pa.array([not row[2] or bool(t) for t, row in zip(texts, rows, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return _found(docs, id_col, text_col, min_length, HOT_DOCUMENTS).mapInArrow(run, docs.schema)
