"""Secrets in texts: known forms, and values of credentials that are costly to guess.

Three forms are found by pattern (assignments, access keys, hex strings). On top of
these, every value that stands in the context of a credential is cut into words,
dates, repeats, keyboard walks and brute-force spans at least cost; a value
whose guess cost reaches a bound was made by a generator, not by a writer, and its span
is added. The dictionary of words is learned from the corpus itself: a word's rank is its place by
the number of documents that hold it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, id_text, record_batch, store
from .guess_cost import LONGEST_WORD, GuessCost

DICTIONARY_WORDS = 20_000  # learned words, of at most LONGEST_WORD letters each: under 1 MB to broadcast
SHORTEST_WORD = 3
FLUSH_WORDS = 200_000
MIN_GUESSES = 10 ** 10
KINDS = ("assign", "access", "hex")  # in the order that spans of one start have
GUESS = "guess"

# The forms asked for.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

# A credential's name, a sign or "is", and (looked at, not taken, so a value may name the next credential) its value.
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|authorization|bearer
                          |(?:api|access|private|secret|signing|encryption)[_\x20-]?key)
                          ["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+)["']?(?=([^\s"'<>`]{6,}))""",
                      re.IGNORECASE | re.ASCII | re.VERBOSE)
_TRAILING = ".,;:!?)]}"
# Every name above holds one of these; a text without any is not searched.
_NAMES = ("pass", "pwd", "secret", "token", "credential", "authorization", "bearer", "key")
_HEX_MARKS = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in bytes(range(256)).lower())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three forms, leftmost and apart within a kind; failing matches drop out."""
    out = []
    if any(name in text.lower() for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"1" * LEAST_HEX in text.encode().translate(_HEX_MARKS):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]
    return out


def context_values(text: str) -> list[tuple[int, int]]:
    """Spans of the values of credentials, without closing punctuation."""
    if not any(name in text.lower() for name in _NAMES):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        end = m.end(1)
        while end > m.start(1) and text[end - 1] in _TRAILING:
            end -= 1
        if end - m.start(1) >= LEAST_VALUE:
            out.append((m.start(1), end))
    return sorted(set(out))


def all_spans(text: str, model: GuessCost, min_guesses: float = MIN_GUESSES) -> list[dict]:
    """Base spans and costly values, by start, then kind; ``bits`` is the guess cost of a value."""
    found = [(start, KINDS.index(kind), end, kind, None) for kind, start, end in base_spans(text)]
    for start, end in context_values(text):
        bits = model.cost(text[start:end])
        if bits >= math.log2(min_guesses):
            found.append((start, len(KINDS), end, GUESS, bits))
    return [{"kind": kind, "start": start, "end": end, "bits": bits} for start, _, end, kind, bits in
            sorted(found, key=lambda s: s[:3])]


def word_ranks(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> dict[str, int]:
    """Rank of the words that most documents hold, at most ``words`` of them (ties in alphabetical order).

    Words are runs of 3 to 20 letters a-z, lower-cased. All documents are
    counted. A word is taken if its number of documents reaches the least level that no more
    than ``words`` words reach; levels lie 2^(1/64) apart, so the driver gets one
    row per level and then the words taken.
    """
    own = docs.select(F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(w.decode(), n) for w, n in held.items() if SHORTEST_WORD <= len(w) <= LONGEST_WORD]
            held.clear()
            return record_batch({"word": [r[0] for r in rows], "n": [r[1] for r in rows]}, schema)

        for batch in batches:
            for text in batch.column(0):
                held.update(set((text.as_py() or "").encode().translate(_LETTERS).split()))
                if len(held) >= FLUSH_WORDS:
                    yield flush()
        yield flush()

    counts = own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = store(counts.withColumn("level", F.floor(64 * F.log2("n")).cast("int")), "word-counts")
    least, held = None, 0
    for r in table.groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 levels per doubling
        held += r["count"]
        if held > words:
            break
        least = r["level"]
    taken = [] if least is None else table.where(F.col("level") >= least).select("n", "word").collect()
    discard(table)
    return {r["word"]: i for i, r in enumerate(sorted(taken, key=lambda r: (-r["n"], r["word"])), 1)}


def scan(docs: DataFrame, ranks: dict[str, int], id_col: str = "doc_id", text_col: str = "text",
         min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``doc_id, found`` of every row; ``found``: array of (kind, start, end, bits), code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` are the known forms; ``guess`` is a
    credential's value that takes ``min_guesses`` guesses or more, beside any known form that covers
    it too. Null and empty texts have no spans; very long texts are searched whole (the guess
    cost of a value grows in proportion to its length); null ids and repeated rows are kept;
    an empty table gives an empty result; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(GuessCost(ranks))  # DICTIONARY_WORDS words

    def run(batch: pa.RecordBatch) -> dict:
        model = shared.value
        return {"doc_id": batch.column("doc_id"),
                "found": [all_spans(t.as_py() or "", model, min_guesses) for t in batch.column("text")]}

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, found array<struct<kind:string,start:long,end:long,bits:double>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts, the digest of the known forms' spans and all spans as text, from the rows of :func:`scan`."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    number = lambda kind: F.size(of(kind)).cast("long")
    base: Column = F.filter("found", lambda s: s["kind"] != GUESS)
    return scanned.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"), number(GUESS).alias("n_guess"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_guesses: float = MIN_GUESSES) -> DataFrame:
    """:func:`digests` of all rows under the dictionary that ``docs`` itself gives."""
    own = id_text(docs, id_col, text_col)
    return digests(scan(own, word_ranks(own), min_guesses=min_guesses))
