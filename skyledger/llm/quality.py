"""Quality scores learned by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of text features; the weights minimise
the logistic loss of the feature differences of (better, worse) document pairs.
The strength that parts the two labels best among the quantiles of the training
strengths becomes the threshold, and maps to ``CUT`` on the 0..1 scale.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, discard, id_text, keep_rows, record_batch, store
from .training import bounded_ids

CUT = 0.3
PAIRS_PER_DOC = 8
PENALTY = 1e-3
LEVELS = np.linspace(0, 1, 2001)
GROUP = 8192  # examples that make their pairs among themselves
LEAST_PER_GROUP = 64  # of each label
FEATURES = ("no_words", "short", "upper", "symbols", "pipes", "marks", "digits", "spaces", "long_words",
            "few_kinds", "repeats", "repeated_lines", "word_symbols", "no_stops")
_PLAIN_MARKS = b".,;:'\"!?()-"


class QualityModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float


def features(text: str | None) -> list[float]:
    """Feature values of a whole text; shares lie in 0..1."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, n_words = max(1, len(raw)), max(1, len(words))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper, digits = int(count[97:123].sum()), int(count[65:91].sum()), int(count[48:58].sum())
    marks = int(sum(count[b] for b in _PLAIN_MARKS))
    ascii_other = int(count[33:127].sum()) - lower - upper - digits - marks
    lines = [line for line in text.split("\n") if line]
    ends = sum(w[-1] in "#$%&*@|!~^=+<>" for w in words)
    stops = sum(w[-1] in ".?!" for w in words)
    return [float(not words), 1 / n_words, upper / max(1, upper + lower), min(1.0, 5 * ascii_other / n),
            min(1.0, 10 * int(count[124]) / n), min(1.0, 5 * marks / n), min(1.0, 5 * digits / n),
            int(count[32] + count[10]) / n, min(1.0, len(text) / n_words / 40),
            1 - len(set(words)) / n_words, sum(map(operator.eq, words, words[1:])) / n_words,
            1 - len(set(lines)) / max(1, len(lines)), ends / n_words, float(not stops)]


def _with_features(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "f": [features(t.as_py()) for t in batch.column("text")]}

    return arrow_map(docs, run, "doc_id long, f array<double>")


def _pairs(label: np.ndarray, pairs_per_doc: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the (better, worse) documents of every pair; each document of the larger class is in ``pairs_per_doc``."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return good[:0], bad[:0]
    rng = np.random.default_rng(6)
    n = pairs_per_doc * max(len(good), len(bad))
    better = np.concatenate([rng.permutation(good) for _ in range(-(-n // len(good)))])[:n]
    worse = np.concatenate([rng.permutation(bad) for _ in range(-(-n // len(bad)))])[:n]
    return better, worse


def _loss_sums(diff: np.ndarray, w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, gradient sum and Hessian sum of log(1 + exp(-w.diff))."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
    return len(diff), -(p[:, None] * diff).sum(0), (diff * (p * (1 - p))[:, None]).T @ diff


def _newton(sums: Callable[[np.ndarray], tuple[int, np.ndarray, np.ndarray]], width: int, penalty: float) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-w.diff)) + penalty/2 |w|^2, from the sums of :func:`_loss_sums`."""
    w = np.zeros(width)
    for _ in range(30):
        n, grad, hess = sums(w)
        step = np.linalg.solve(hess / n + penalty * np.eye(width), grad / n + penalty * w)
        w = w - step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _threshold(at: np.ndarray, errors: np.ndarray, highest_bad_below: Callable[[float], float | None]) -> float:
    """Middle of the first run of quantiles with the least balanced error."""
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    run = best[:np.flatnonzero(np.diff(best, append=best[-1] + 2) > 1)[0] + 1]
    if len(run) > 1:
        return float(at[run].mean())
    low = highest_bad_below(at[run[0]])
    return float((at[run[0]] + (at[run[0]] if low is None else low)) / 2)


def _alike(width: int, cut: float) -> QualityModel:
    """Nothing to compare: all documents score alike, above the cut."""
    return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), -1.0, cut)


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs_per_doc: int = PAIRS_PER_DOC, penalty: float = PENALTY,
              cut: float = CUT) -> QualityModel:
    """Bradley-Terry weights and threshold from feature rows and 0/1 labels."""
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    good, bad = label == 1, label == 0
    if not good.any() or not bad.any():
        return _alike(width, cut)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    better, worse = _pairs(label, pairs_per_doc)
    diff = z[better] - z[worse]
    w = _newton(lambda w: _loss_sums(diff, w), width, penalty)
    strength = z @ w
    at = np.quantile(strength, LEVELS)
    order = np.sort(strength[good]), np.sort(strength[bad])
    # Balanced error of each quantile as threshold: lost good share plus kept bad share.
    errors = np.searchsorted(order[0], at) / good.sum() + 1 - np.searchsorted(order[1], at) / bad.sum()

    def highest_bad_below(value: float) -> float | None:
        low = order[1][order[1] < value]
        return low[-1] if len(low) else None

    return QualityModel(mean, scale, w, _threshold(at, errors, highest_bad_below), cut)


def _dealt(examples: DataFrame, groups: int, n_good: int, n_bad: int) -> DataFrame:
    """Examples in ``groups`` rows ``x array<double>, label array<int>`` of about equal length.

    Dealt by a hash of the id. A class too small to have :data:`LEAST_PER_GROUP` examples in
    each group is dealt several times, to different groups, so that all examples of the other find partners.
    """
    copies = lambda n: min(groups, max(1, math.ceil(groups * LEAST_PER_GROUP / n)))
    count = F.when(F.col("label") == 1, copies(n_good)).otherwise(copies(n_bad)).cast("long")
    rows = (examples.select("doc_id", "f", "label", count.alias("count"),
                            F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("copy"))
            .withColumn("group", F.pmod(F.xxhash64("doc_id") + F.col("copy") * F.floor(groups / F.col("count")),
                                        F.lit(groups).cast("long"))))
    return (rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("doc_id", "label", "f"))).alias("r"))
            .select(F.flatten(F.col("r.f")).alias("x"), F.col("r.label").alias("label")))


def fit_groups(examples: DataFrame, n_good: int, n_bad: int, group_size: int = GROUP,
               pairs_per_doc: int = PAIRS_PER_DOC, penalty: float = PENALTY, cut: float = CUT) -> QualityModel:
    """:func:`fit_pairs` of stored ``doc_id, f, label`` rows of any number, all work on Spark.

    Pairs are made within groups of about ``group_size`` examples that are dealt once; a Newton step is one pass
    over them that brings a gradient and a Hessian per task to the driver. The
    quantiles of the strengths and the errors at them are exact and over all examples.
    """
    if not n_good or not n_bad:
        return _alike(len(FEATURES), cut)
    width, examples = len(FEATURES), examples.where("label IN (0, 1)")
    stats = examples.agg(*[F.avg(F.col("f")[i]) for i in range(width)],
                         *[F.stddev_pop(F.col("f")[i]) for i in range(width)]).first()
    mean, scale = np.array(stats[:width]), np.array(stats[width:]) + 1e-6
    dealt = store(_dealt(examples, math.ceil((n_good + n_bad) / group_size), n_good, n_bad), "quality-groups")

    def sums(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, grad, hess = 0, np.zeros(width), np.zeros((width, width))
            for batch in batches:
                for x, label in zip(batch.column("x"), batch.column("label"), strict=True):
                    z = (x.values.to_numpy().reshape(-1, width) - mean) / scale
                    better, worse = _pairs(label.values.to_numpy(), pairs_per_doc)
                    own = _loss_sums(z[better] - z[worse], w)
                    n, grad, hess = n + own[0], grad + own[1], hess + own[2]
            yield record_batch({"n": [n], "grad": [grad], "hess": [hess.ravel()]}, target)

        target = pa.schema([("n", pa.int64()), ("grad", pa.list_(pa.float64())), ("hess", pa.list_(pa.float64()))])
        rows = dealt.mapInArrow(run, "n long, grad array<double>, hess array<double>").collect()  # one per task
        return (sum(r["n"] for r in rows), np.sum([r["grad"] for r in rows], axis=0),
                np.sum([r["hess"] for r in rows], axis=0).reshape(width, width))

    w = _newton(sums, width, penalty)

    def strength(batch: pa.RecordBatch) -> dict:
        x = batch.column("f").flatten().to_numpy().reshape(-1, width)
        return {"strength": pa.array((x - mean) / scale @ w), "label": batch.column("label")}

    one = lambda k: F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias
    counts = store(arrow_map(examples.select("f", "label"), strength, "strength double, label int")
                   .groupBy("strength").agg(one(1)("good"), one(0)("bad")), "quality-strengths")
    at, errors = _quantile_errors(counts, n_good, n_bad, group_size)
    threshold = _threshold(at, errors, lambda value: counts.where((F.col("bad") > 0) & (F.col("strength") < F.lit(
        float(value)))).agg(F.max("strength")).first()[0])
    model = QualityModel(mean, scale, w, threshold, cut)
    discard(counts)
    discard(dealt)
    return model


def _quantile_errors(counts: DataFrame, n_good: int, n_bad: int, bucket_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the strengths at :data:`LEVELS`, as numpy's, and the balanced error of each as threshold.

    ``counts``: stored rows ``strength, good, bad``, one per strength. They are cut into buckets of about
    ``bucket_size`` strengths; a bucket's counts say which ranks it holds, and its task finds the strengths there.
    """
    n = n_good + n_bad
    buckets = math.ceil(counts.count() / bucket_size)
    bounds = np.array([])
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        bounds = np.unique(counts.agg(F.percentile_approx("strength", shares, 100 * buckets)).first()[0])
    placed = arrow_map(counts, lambda b: {"bucket": np.searchsorted(bounds, b.column("strength").to_numpy(), "right"),
                                          **{c: b.column(c) for c in ("strength", "good", "bad")}},
                       "bucket long, strength double, good long, bad long")
    held = np.zeros((len(bounds) + 1, 2), np.int64)
    for r in placed.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        held[r["bucket"]] = r["good"], r["bad"]
    before = np.cumsum(held, axis=0) - held
    place = LEVELS * (n - 1)
    lower = np.floor(place).astype(np.int64)
    ranks = np.unique(np.concatenate([lower, np.minimum(lower + 1, n - 1)]))

    def find(pdf):
        import pandas as pd
        pdf = pdf.sort_values("strength")
        b = int(pdf["bucket"].iloc[0])
        through = np.cumsum(pdf[["good", "bad"]].to_numpy(), axis=0) + before[b]
        total = through.sum(1)
        own = ranks[(ranks >= before[b].sum()) & (ranks < total[-1])]
        i = np.searchsorted(total, own, "right")
        lost = pdf[["good", "bad"]].to_numpy()[i]
        return pd.DataFrame({"rank": own, "strength": pdf["strength"].to_numpy()[i], "good": through[i, 0],
                             "bad": through[i, 1], "own_good": lost[:, 0], "own_bad": lost[:, 1]})

    found = sorted(placed.groupBy("bucket").applyInPandas(
        find, "rank long, strength double, good long, bad long, own_good long, own_bad long").collect())
    value = np.array([r["strength"] for r in found])
    through = np.array([(r["good"], r["bad"]) for r in found])
    own = np.array([(r["own_good"], r["own_bad"]) for r in found])
    i, j = np.searchsorted(ranks, lower), np.searchsorted(ranks, np.minimum(lower + 1, n - 1))
    part, gap = place - lower, value[j] - value[i]
    at = np.where(part < 0.5, value[i] + gap * part, value[j] - gap * (1 - part))
    # A quantile is the lower strength, or lies above it and not above the next: what it has below it.
    below = np.where((at > value[i])[:, None], through[i], through[i] - own[i])
    return at, below[:, 0] / n_good + 1 - below[:, 1] / n_bad


def _examples(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id, f, label`` of every id of ``marks`` (once there) that ``docs`` holds: its rows' mean features.

    Features are taken where a text is read, so the join shuffles their few numbers and no text.
    """
    means = F.array(*[F.avg(F.col("f")[i]) for i in range(len(FEATURES))]).alias("f")
    return (_with_features(docs.where("doc_id IS NOT NULL")).join(marks, "doc_id")
            .groupBy("doc_id", "label").agg(means).select("doc_id", "f", "label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_training_docs: int | None = None, cut: float = CUT) -> QualityModel:
    """Model from all labelled documents; a caller may ask for ``max_training_docs`` of them at most.

    Rows with a null id or label teach nothing; an id labelled twice counts as
    its highest label. An id is one example: the mean features of its rows,
    taken on Spark, so an id with many rows weighs once. Up to :data:`GROUP` examples are
    one group and fitted by the driver, more by :func:`fit_groups` on Spark.
    """
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")))
    if max_training_docs is not None:
        marks = bounded_ids(marks, max_training_docs, "quality").join(marks, "doc_id")
    examples = store(_examples(id_text(docs, id_col, text_col), marks), "quality-examples")
    count = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if sum(count.values()) > GROUP:
        model = fit_groups(examples, count.get(1, 0), count.get(0, 0), cut=cut)
    else:
        rows = sorted(examples.select("doc_id", "f", "label").collect(), key=lambda r: r["doc_id"])
        model = fit_pairs(np.array([r["f"] for r in rows], float), np.array([r["label"] for r in rows]), cut=cut)
    discard(examples)
    return model


def strengths(texts, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Ranking strengths of texts, and their scores: the strengths on a 0..1 scale, threshold at the cut."""
    x = np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))
    strength = (x - model.mean) / model.scale @ model.weights
    shift = float(np.log(model.cut / (1 - model.cut)))
    return strength, 1 / (1 + np.exp(-np.clip(strength - model.threshold + shift, -500, 500)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, strength, score, predicted`` of every row.

    ``strength`` is the ranking score, ``score`` its place between 0 and 1 with
    the model's threshold at the cut, ``predicted`` 1 from the cut on. Null
    text counts as empty; null ids and repeated rows are kept; further columns
    are ignored.
    """
    def run(batch: pa.RecordBatch) -> dict:
        strength, value = strengths(batch.column("text"), model)
        return {"doc_id": batch.column("doc_id"), "strength": pa.array(strength), "score": pa.array(value),
                "predicted": pa.array((value >= model.cut).astype(np.int32))}

    return arrow_map(id_text(docs, id_col, text_col), run,
                     "doc_id long, strength double, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model scores at its cut or above."""
    return keep_rows(docs, text_col, lambda texts: (strengths(texts, model)[1] >= model.cut).tolist())


def training_labels(labels: DataFrame, id_col: str = "doc_id", modulus: int = 5, held: int = 0) -> DataFrame:
    """Labels of the ids whose crc32 mod ``modulus`` is not ``held``; never of a null id."""
    return labels.where(crc_mod(F.col(id_col), modulus) != held)


def held_out_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, **fit_options) -> DataFrame:
    """Learn from the ids whose crc32 mod ``modulus`` is not ``held``; score all rows.

    ``doc_id, held_out, score, predicted``. Rows with a null id are held out.
    """
    model = fit(docs, training_labels(labels, "doc_id", modulus, held), **fit_options)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(True)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", "predicted")
