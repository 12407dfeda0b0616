"""From raw documents to packed training sequences.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows
its predecessor kept; ``run`` writes each result to the shared folder and reads
it back for the next. All stages but the last return the columns of ``docs``.

Nulls, empty tables and repeated rows: a document without a letter (null and
empty texts too) or in no learned language is rejected by the first stage; a null id never teaches a model and yields
to every other id in the later ones; of repeated rows one stays; empty tables
give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import language, packing, quality, simhash, suffix_dedup
from skyledger.llm.common import store, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model, learned from their ``lang``, knows."""
    return language.keep_identified(docs, language.fit(language.training_rows(docs)))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality model, learned from ``labels``, scores at its cut or above."""
    labels = quality.training_labels(table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each SimHash group."""
    return simhash.first_of_each_group(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out that an earlier document holds; documents left empty by that go."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token pieces of every document in sequences of at most 2048.

    Small word caches: the workers' memory stands beside what the JVM holds after four stages.
    """
    return packing.pack_documents(docs, with_ids=False, cache_megabytes=14)


STAGES = [("language_id", identify_language), ("quality_classifier", filter_quality),
          ("simhash_near_dedup", drop_near_duplicates), ("suffix_array_dedup", remove_repeats),
          ("best_fit_packing", pack)]

# Learned models, fingerprint graphs, suffix orders and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
