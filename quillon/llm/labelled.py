"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: Column) -> Column:
    """Whether a row is held out: crc32 of its id as text is 2 modulo 4. Rows without an id aren't."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, y of labelled rows that may be learned from; where rows disagree the least label counts."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y"))
    return known.filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))


def bounded_ids(ids: DataFrame, most: int, seed: int = 5) -> DataFrame:
    """At most `most` rows of ids, by the order of a hash: small enough to broadcast at any input."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and ids' other columns of the documents that ids names, a row for each row of ids: of the texts
    of an id the first in order, null last. ids is bounded_ids', so it is broadcast."""
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(ids), "id")
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))
