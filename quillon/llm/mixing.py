"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document gets a place in a pseudo-random order of its source: the running sum of words
   before it. Running sums come in two levels (buckets of the order's hash, then within a bucket), so
   that a hot source never meets in one task.
2. A source's target in words is its stream: the whole source once or twice, then the first part of
   the order. Cut into equal blocks, that stream is its exact block quota.
3. The tree splits the quotas among output shards: at each node the left half of the shards gets a
   number of blocks of each source drawn from the multivariate hypergeometric distribution, the right
   half gets the rest. Only quotas (sources x shards, both parameters of the corpus, not its rows) are
   on the driver.
4. A source's blocks are permuted by an affine map, and shards take disjoint runs of permuted blocks.
   Inside a shard `place` is the order of a local shuffle.

Everything that touches documents is DataFrame expressions.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import staged, table, word_count

#: Weights by place in the code-point order of sources, null last.
WEIGHTS = (3.0, 1.0, 2.0)
#: Documents in a bucket of the order, about.
BUCKET_ROWS = 4096
#: The plan of so many sources, under a KB each, is broadcast; that of more is joined.
MAX_BROADCAST_SOURCES = 20_000


def fill_targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, each at most cap * size, the excess reshared by weight until none is above."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        each = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if each * weights[i] > cap * sizes[i]]
        for i in over or open_:
            target[i] = cap * sizes[i] if over else each * weights[i]
        if not over:
            break
        left = max(0.0, left - sum(cap * sizes[i] for i in over))
        open_ = [i for i in open_ if i not in over]
    return target


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` drawn without replacement are good; inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    lg = math.lgamma
    log_p = lambda k: lg(good + 1) - lg(k + 1) - lg(good - k + 1) + lg(bad + 1) - lg(draws - k + 1) - lg(bad - draws + k + 1) - (lg(good + bad + 1) - lg(draws + 1) - lg(good + bad - draws + 1))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    u, a, b = rng.random(), mode, mode
    pa = pb = math.exp(log_p(mode))
    if (u := u - pa) <= 0:
        return mode
    while a > low or b < high:
        if b < high:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            if (u := u - pb) <= 0:
                return b
        if a > low:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            if (u := u - pa) <= 0:
                return a
    return mode


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard its blocks of each source; shards differ by one block at most."""
    rng, out = random.Random(seed), []

    def node(left: list[int], n: int) -> None:
        if n == 1:
            out.append(left)
            return
        half, total = n // 2, sum(left)
        draws = sum(total // n + (i < total % n) for i in range(half))
        taken, rest = [], total
        for q in left:
            k = hypergeometric(rng, q, rest - q, draws)
            taken.append(k)
            draws, rest = draws - k, rest - q
        node(taken, half)
        node([q - k for q, k in zip(left, taken, strict=True)], n - half)

    node(quotas, shards)
    return out


def _stride(n: int, rng: random.Random) -> tuple[int, int]:
    while math.gcd(a := rng.randrange(1, max(2, n)), n) != 1:
        pass
    return a, rng.randrange(n)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, shards: int = 64, block_words: int = 16_384, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, draws.

    draws lists each time the document enters the mix: words, shard and place (the shard's shuffled
    order). size counts words; a null or empty text has size 0 and is never drawn. A null source is a
    source of its own, last in order. Repeated rows are separate documents. An empty table gives an
    empty result. Columns of docs that are not named stay out, whatever their names, but for `keep`.
    A source's taken words are its target, rounded down to a whole word.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("size"))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), *([F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []))
    # the number of a row is written with it, so it stays; texts wait in that table until the draws are known
    whole = staged(rows.withColumns({"key": order, "at_row": F.monotonically_increasing_id()}), "mix-sizes")
    rows = whole.select("id", "source", "size", "key", "at_row")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # a row for each source
    sums.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = [r["size"] for r in sums]
    target = fill_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    takes = [math.floor(t + 1e-6) for t in target]
    blocks = [-(-q // block_words) for q in takes]
    split, rng = split_quotas(blocks, shards, seed), random.Random(seed + 1)
    plan = []
    for i, r in enumerate(sums):
        ends, at = [], 0
        for s in split:
            at += s[i]
            ends.append(at)
        plan.append((r.source, sizes[i], target[i], takes[i], blocks[i], *(_stride(blocks[i], rng) if blocks[i] else (1, 0)), ends, max(1, r.n // BUCKET_ROWS)))
    plan_df = spark.createDataFrame(plan, "p_source string, source_size long, target double, take long, blocks long, a long, b long, ends array<long>, buckets long")
    if len(plan) <= MAX_BROADCAST_SOURCES:
        plan_df = F.broadcast(plan_df)
    same = F.col("source").eqNullSafe(F.col("p_source"))
    rows = rows.join(plan_df.select("p_source", "buckets"), same, "left").drop("p_source").withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 16), F.col("buckets")))
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), F.coalesce(F.sum("words").over(by_source), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")), "left")
    placed = placed.join(plan_df.drop("buckets"), same, "left").withColumn("at", F.col("start") + F.col("within"))

    def draw(n: Column) -> Column:
        first = n * F.col("source_size") + F.col("at")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("take") - first))
        block = F.try_divide(first, F.lit(block_words)).cast("long")
        spot = F.pmod(F.col("a") * block + F.col("b"), F.greatest(F.col("blocks"), F.lit(1)))
        shard = F.size(F.filter("ends", lambda e: e <= spot)).cast("int")
        return F.struct(words.alias("words"), F.least(shard, F.lit(shards - 1)).alias("shard"), F.xxhash64(F.lit(seed), n, F.col("key"), block).alias("place"))

    draws = F.filter(F.transform(F.array(*[F.lit(i).cast("long") for i in range(math.ceil(cap))]), draw), lambda d: d["words"] > 0)
    out = placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "at_row", draws.alias("draws"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda x, d: x + d["words"])
    out = out.select(id_col, "source", "size", "source_size", "target", taken.alias("taken"), "draws", "at_row")
    return whole.select("at_row", "kept").join(out.filter("taken > 0").hint("merge"), "at_row").drop("at_row") if keep else out.drop("at_row")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and draws of every document."""
    return mix(table(spark, sf_dir, "documents")).drop("source")
