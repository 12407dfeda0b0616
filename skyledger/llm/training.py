"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_ids(labelled: DataFrame, bound: int, salt: str) -> DataFrame:
    """At most ``bound`` distinct non-null ``doc_id``, the same ones on every run.

    Taken in the order of a salted hash of the id, so the choice does not lean
    on how ids were given out.
    """
    ids = labelled.select("doc_id").where("doc_id IS NOT NULL").distinct()
    return ids.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(bound)
