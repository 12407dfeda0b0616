"""Best-fit-decreasing packing of token sequences.

Rows are dealt at random into groups of bounded size and every group is packed
on its own: lengths in decreasing order, each into the open bin with the least
room that still holds it. A segment tree over the possible remaining capacities
finds that bin in logarithmic time. A group of tens of thousands of rows wastes
a bin or two at most, so the groups cost next to nothing in fill.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RecentCache, arrow_map, id_text, kept, store
from .word_bpe import WordBpeFile, load, plain_pieces, words

DEFAULT_TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
SEPARATOR_ID = 0
ROWS_PER_GROUP = 16_384
CACHE_MEGABYTES = 56  # of a generation of the worker's word caches


class BestFit:
    """Open bins by remaining capacity, under a segment tree of bin counts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << max(1, capacity).bit_length()
        self.open = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_bins = 0

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.open[node] += by
            node >>= 1

    def tightest(self, size: int) -> int:
        """Least remaining capacity >= size that an open bin has, or -1."""
        node = size + self.leaves
        if self.open[node]:
            return size
        while node > 1:
            if not node & 1 and self.open[node + 1]:  # the right sibling holds larger rooms
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of the next row."""
        room = self.tightest(size)
        if room < 0:
            room, which = self.capacity, self.n_bins
            self.n_bins += 1
        else:
            which = self.bins[room].pop()
            self._change(room, -1)
        self.bins[room - size].append(which)
        self._change(room - size, 1)
        return which, self.capacity - room


def pack_group(sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Bins and offsets of sizes that stand in decreasing order."""
    if len(sizes) and sizes[0] > capacity:
        raise ValueError(f"a row of {sizes[0]} does not fit a sequence of {capacity}")
    fit = BestFit(capacity)
    placed = [fit.place(s) for s in sizes.tolist()]
    return [p[0] for p in placed], [p[1] for p in placed]


def _free_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def best_fit_pack(rows: DataFrame, size_col: str = "length", keys: tuple[str, ...] = ("doc_id", "piece"),
                  capacity: int = CAPACITY, rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row; sizes of a sequence sum to at most ``capacity``.

    ``keys`` and a number that the row gets when it is stored spread the rows
    over groups, so null and repeated keys fill no group beyond its bound;
    ``keys`` order equal sizes; rows equal in all keys may swap places. Null sizes count as 0 and take no room; a size
    above ``capacity`` is an error. An empty table gives an empty result. Columns named
    ``sequence_id`` or ``offset`` in the input are replaced. ``rows`` is read
    once: it is stored in the shared folder, then counted and packed from there.
    """
    given = rows.drop("sequence_id", "offset")
    salt, own_group, own_size = (_free_name(n, given.columns) for n in ("_salt", "_group", "_size"))
    rows = store(given.withColumn(salt, F.monotonically_increasing_id()), "packing-rows")
    groups = max(1, math.ceil(rows.count() / rows_per_group))
    group = F.pmod(F.xxhash64(*[F.col(k) for k in keys], salt), F.lit(groups))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf[size_col].fillna(0).clip(lower=0).astype("int64")
        pdf = pdf.assign(**{own_size: sizes}).sort_values([own_size, *keys], ascending=[False] + [True] * len(keys),
                                                          kind="stable")
        bins, offsets = pack_group(pdf[own_size].to_numpy(), capacity)
        first = int(pdf[own_group].iloc[0]) << 32
        return pdf.assign(sequence_id=np.array(bins, "int64") + first,
                          offset=np.array(offsets, "int64")).drop(columns=[own_group, own_size])

    return (rows.withColumn(own_group, group).drop(salt).groupBy(own_group)
            .applyInPandas(pack, f"{schema}, sequence_id long, offset long"))


class _IdBytes(dict):
    """Little-endian unsigned 32-bit bytes of the ids met, as many as the vocabulary has at most."""

    def __missing__(self, token_id: int) -> bytes:
        value = self[token_id] = struct.pack("<I", token_id)
        return value


class WordEncoder:
    """Token ids of words as little-endian unsigned 32-bit bytes, by the tokenizers library.

    ``cache_megabytes`` bounds a generation of the caches of words and pieces; it changes no result.
    """

    def __init__(self, source: WordBpeFile, cache_megabytes: int = CACHE_MEGABYTES):
        self.source = source
        self.tokenize = source.tokenizer.model.tokenize
        self.id_bytes = _IdBytes().__getitem__
        pieces = max(1, cache_megabytes // 14)
        self.by_piece = RecentCache(self._encode_piece, pieces)
        self.by_word = RecentCache(self._encode_word, max(1, cache_megabytes - pieces))

    def _encode_piece(self, piece: str) -> bytes:
        return b"".join([self.id_bytes(t.id) for t in self.tokenize(piece)])

    def _encode_word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():  # one piece; in lower case the word is the piece
            lower = word.lower()
            return self._encode_piece(word) if lower == word else self.by_word[lower]
        if self.source.plain(word):
            return b"".join([(self.by_word if p.isascii() and p.isalpha() else self.by_piece)[p] for p in plain_pieces(word)])
        return np.array(self.source.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.by_word.__getitem__, words(text)))


def encoder(path: str, cache_megabytes: int = CACHE_MEGABYTES) -> WordEncoder:
    """The worker's own, with its caches."""
    return kept(("encoder", path, cache_megabytes), lambda: WordEncoder(load(path), cache_megabytes))


def document_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    tokenizer_path: str | None = None, capacity: int = CAPACITY,
                    separator_id: int = SEPARATOR_ID, with_ids: bool = True,
                    cache_megabytes: int = CACHE_MEGABYTES) -> DataFrame:
    """Cut every document's ids, followed by ``separator_id``, into pieces of at most ``capacity``.

    ``doc_id, piece, start, length, ids_crc32`` and, on request, the ``ids``
    (little-endian unsigned 32-bit). Null text counts as empty, so it is the
    separator alone. Null ids and repeated rows are kept. ``cache_megabytes`` as in :class:`WordEncoder`.
    """
    path = tokenizer_path or public_tokenizers.path(DEFAULT_TOKENIZER)
    tail, step = np.array([separator_id], "<u4").tobytes(), 4 * capacity

    def run(batch: pa.RecordBatch) -> dict:
        encode = encoder(path, cache_megabytes).encode
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = encode(text.as_py() or "") + tail
            for piece, at in enumerate(range(0, len(ids), step)):
                own = ids[at:at + step]
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(at // 4)
                out["length"].append(len(own) // 4)
                out["ids_crc32"].append(zlib.crc32(own))
                if with_ids:
                    out["ids"].append(own)
        return out

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, piece int, start long, length long, ids_crc32 long"
                     + (", ids binary" if with_ids else ""))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   tokenizer_path: str | None = None, capacity: int = CAPACITY,
                   with_ids: bool = True, rows_per_group: int = ROWS_PER_GROUP,
                   cache_megabytes: int = CACHE_MEGABYTES) -> DataFrame:
    """The pieces of :func:`document_pieces` with their place in a packed sequence."""
    pieces = document_pieces(docs, id_col, text_col, tokenizer_path, capacity, with_ids=with_ids,
                             cache_megabytes=cache_megabytes)
    return best_fit_pack(pieces, capacity=capacity, rows_per_group=rows_per_group)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its length, spans and concatenated ids (at most ``capacity`` ids a row)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(ordered.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"),
                                               lambda a, p: a + p["length"]).alias("n_tokens"),
                    F.transform("parts", lambda p: p.dropFields("ids")).alias("spans"),
                    F.expr("unhex(array_join(transform(parts, p -> hex(p.ids)), ''))").alias("ids")))
