"""The corpus pipeline: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Null and empty texts go in the first stage; empty tables pass through; rows that repeat are
near-duplicates of each other. Stages cut lineage by written tables in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import jaccard, mixing, pieces, quality, suffixes
from quillon.llm.common import WORD, staged, table, tasks

#: Near-duplicates of the pipeline: words of a shingle, and least similarity in percent.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on docs and the labels of its training rows, accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep_row=True).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets hold together: that of the least id, a row
    without an id only where none has one. Rows are told apart by their place, so those that share an id, or
    have none, are judged by their texts alone."""
    row = next(c for c in ("row", *(f"row{k}" for k in range(len(docs.columns) + 1))) if c not in docs.columns)
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    found = jaccard.jaccard_components(keyed, id_col=row, width=SHINGLE, percent=PERCENT).select(F.col(row).alias("at"), "component_id")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))["at"]
    first = keyed.select("doc_id", F.col(row).alias("at")).join(found, "at").groupBy("component_id").agg(best.alias(row)).select(row)
    return keyed.join(first.hint("merge"), row, "left_semi").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages, strings of PASSAGE bytes that occur elsewhere too; those left without a word go."""
    done = suffixes.remove_repeats(docs, keep_text=True, length=suffixes.PASSAGE).filter(F.col("kept_text").rlike(WORD))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, by shard and in the shard's order. The document in which a source
    meets its target is whole or absent, whichever is nearer the target: no text is cut."""
    mixed = mixing.mix(docs, keep=tuple(docs.columns)).filter("taken > 0").select("kept", "size", F.explode("draws").alias("draw"))
    dealt = mixed.filter(2 * F.col("draw.words") >= F.col("size")).repartition(tasks(spark), "draw.shard").sortWithinPartitions("draw.shard", "draw.place")
    return dealt.select(*[F.col("kept")[c].alias(c) for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of every document of the mix."""
    return pieces.encode(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Classifiers, suffix sorting and piece ids aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
