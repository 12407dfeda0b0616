"""Language identification by multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language make a matrix of log-probabilities
(languages x buckets) that is broadcast; a batch is scored as one sparse product
of its documents x buckets counts with the matrix, in slices of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, id_text, keep_rows, record_batch, release

BUCKETS = 1 << 15
SLICE = 1 << 20
TABLE_SLICE = 1 << 18  # entries of a batch's count table held at once
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


class LanguageModel(NamedTuple):
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages
    seen: np.ndarray | None = None  # buckets x languages: 1 where the training documents hold the gram
    usual: np.ndarray | None = None  # share of a training document's grams that others of its language hold


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def ngram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all 1- to 3-grams of the lower-cased text, slice by slice.

    ASCII that is no letter reads as a space; grams of spaces alone are left out.
    """
    codes_all = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    for at in range(0, len(codes_all), SLICE):
        codes = codes_all[max(0, at - 2):at + SLICE].astype(np.uint64)
        codes[(codes < 128) & ((codes < 97) | (codes > 122))] = 32
        fresh = min(at, 2)  # the first two were the last of the slice before
        grams = codes
        for n in (1, 2, 3):
            if n > 1:
                grams = grams[:-1] * np.uint64(1_000_003) + codes[n - 1:]
            own = grams[max(0, fresh - n + 1):] if fresh else grams
            if not len(own):
                continue
            blank = np.uint64(0)
            for _ in range(n):
                blank = np.uint64((int(blank) * 1_000_003 + 32) % 2**64)
            mixed = (own[own != blank] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(40)
            yield (mixed % np.uint64(buckets)).astype(np.int64)


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for part in ngram_buckets(text, buckets):
        out += np.bincount(part, minlength=buckets)
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        buckets: int = BUCKETS, alpha: float = 0.1) -> LanguageModel:
    """Model from all rows of ``docs``.

    Rows with null text, null language or null id teach nothing. The counts are
    summed by Spark; the driver gets one row of counts per language. Without
    any usable row the model knows no language and every prediction is ``und``.
    """
    usable = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                          F.col(lang_col).cast("string").alias("lang"))
              .where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL"))
    schema = "lang string, docs long, counts array<long>, holders array<long>"
    target = pa.schema([("lang", pa.string()), ("docs", pa.int64()), ("counts", pa.list_(pa.int64())),
                        ("holders", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                own = sums.setdefault(lang, [0, np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)])
                found = gram_counts(text.as_py(), buckets)
                own[0] += 1
                own[1] += found
                own[2] += found > 0
        for lang, (n, counts, holders) in sums.items():
            yield record_batch({"lang": [lang], "docs": [n], "counts": [counts], "holders": [holders]}, target)

    partial = usable.select("text", "lang").mapInArrow(count, schema)

    def add(pdf):
        import pandas as pd
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "docs": [int(pdf["docs"].sum())],
                             **{c: [np.sum(np.stack(pdf[c].to_list()), axis=0)] for c in ("counts", "holders")}})

    rows = sorted(partial.groupBy("lang").applyInPandas(add, schema).collect(), key=lambda r: r["lang"])
    if not rows:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0)))
    raw = np.array([r["counts"] for r in rows], np.float64)
    shared = np.array([r["holders"] for r in rows]) > 1
    counts = raw + alpha
    seen = np.array([r["docs"] for r in rows], np.float64)
    return LanguageModel([r["lang"] for r in rows], np.log(seen / seen.sum()),
                         np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T),
                         np.ascontiguousarray((raw > 0).T.astype(np.float64)),
                         (raw * shared).sum(1) / np.maximum(1, raw.sum(1)))


def gram_table(texts: list, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts of a batch as (row, bucket, count) arrays, the non-zero entries, slice by slice."""
    rows, found, counts, held = [], [], [], 0
    for row, text in enumerate(texts):
        for part in ngram_buckets(text or "", buckets):
            if len(part) < 4096:
                own, n = np.unique(part, return_counts=True)
            else:
                n = np.bincount(part, minlength=buckets)
                own = np.flatnonzero(n)
                n = n[own]
            rows.append(np.full(len(own), row))
            found.append(own)
            counts.append(n)
            held += len(own)
            if held >= TABLE_SLICE:
                yield np.concatenate(rows), np.concatenate(found), np.concatenate(counts)
                rows, found, counts, held = [], [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(found), np.concatenate(counts)


def gram_sums(texts: list, matrix: np.ndarray) -> np.ndarray:
    """Counts of the texts (texts x buckets, sparse) times ``matrix`` (buckets x columns)."""
    out = np.zeros((len(texts), matrix.shape[1]))
    for row, bucket, count in gram_table(texts, len(matrix)):
        for j in range(matrix.shape[1]):
            out[:, j] += np.bincount(row, count * matrix[bucket, j], len(texts))
    return out


def classify_batch(texts: list, model: LanguageModel) -> list[tuple[str, float]]:
    """Language and posterior probability of every text."""
    if not model.languages:
        return [(UNDETERMINED, 0.0)] * len(texts)
    total = gram_sums(texts, model.log_prob) + model.log_prior
    best = total.argmax(1)
    score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [(model.languages[b], s) if has_letter(t) else (UNDETERMINED, 0.0)
            for t, b, s in zip(texts, best.tolist(), score.tolist(), strict=True)]


def classify(text: str | None, model: LanguageModel) -> tuple[str, float]:
    return classify_batch([text], model)[0]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` (posterior probability of the prediction) of every row.

    Null texts and texts without a letter are ``und`` with score 0; equal
    scores go to the first language in alphabetical order. Null ids, repeated
    rows and empty tables are fine; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict:
        found = classify_batch(batch.column("text").to_pylist(), shared.value)
        return {"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return arrow_map(id_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.5,
                    min_familiar: float = 0.9) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined and known to the model.

    The posterior, at least ``min_score``, only says which learned language is
    nearest; it nears 1 for long texts in any language. So the share of a
    text's grams that the training documents of that language hold must also
    reach ``min_familiar`` of the share that a training document finds in the
    others. A language close to a learned one may pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def wanted(texts) -> list[bool]:
        known, texts = shared.value, texts.to_pylist()
        found = classify_batch(texts, known)
        if not known.languages:
            return [False] * len(texts)
        sums = gram_sums(texts, np.hstack([known.seen, np.ones((len(known.seen), 1))]))
        place = {lang: i for i, lang in enumerate(known.languages)}
        return [lang != UNDETERMINED and score >= min_score
                and own[place[lang]] >= min_familiar * known.usual[place[lang]] * own[-1]
                for (lang, score), own in zip(found, sums, strict=True)]

    return keep_rows(docs, text_col, wanted)


def training_rows(docs: DataFrame, id_col: str = "doc_id", modulus: int = 4, held: int = 2) -> DataFrame:
    """Rows whose crc32(id) mod ``modulus`` is not ``held``; never those with a null id."""
    return docs.where(crc_mod(F.col(id_col), modulus) != held)


def held_out_languages(docs: DataFrame, modulus: int = 4, held: int = 2, **fit_options) -> DataFrame:
    """Learn from the rows whose crc32(id) mod ``modulus`` is not ``held``; predict all rows.

    ``doc_id, held_out, lang_pred, score``. Rows with a null id are held out.
    """
    model = fit(training_rows(docs, "doc_id", modulus, held), **fit_options)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(True)).alias("held_out")
    return identify(docs, model).select("doc_id", held_out, "lang_pred", "score")
