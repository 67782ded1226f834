"""Groups streamed through Python, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import mapped, staged, tasks


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, at_least: int = 12) -> DataFrame:
    """work() applied to the rows of each value of the column key (a long), one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[start]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                if end > start:
                    held.append(b.slice(start, end - start))
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(tasks(df.sparkSession, at_least), key).sortWithinPartitions(key).transform(mapped, run, schema)


def components(edges: DataFrame, label: str = "links", most: int = 60) -> DataFrame:
    """node, component (its least reachable node) of every node that edges (columns a, b: long) name.

    Alternates large-star and small-star steps, which keep what is connected and shrink distances to
    the least node; each round is a written table. A node of many edges is pre-aggregated to its least
    neighbour, and the join back can be split by the adaptive skew join.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), label)
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct()
        edges = staged(small, label)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
