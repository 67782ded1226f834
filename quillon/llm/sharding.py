"""Sharding through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table: it starts at
`offset` and walks by `skip`, and as the size is prime it meets every slot once. Shards take turns;
at a turn a shard claims the first free slot of its order. The table is a parameter-sized object
(`slots` rows of two ints), so broadcasting it has a proven bound, and placing a row is one hash, one
modulo and one lookup. Removing a shard moves few keys besides its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default table size, a prime; 65,537 rows of 8 bytes broadcast as about half a megabyte.
SLOTS = 65_537
#: No larger table is broadcast.
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The shard's index for each slot. weights: claims of a shard at one turn (1 each if not given)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from {len(shards)} to {MAX_SLOTS}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("one weight of 1 or more for each shard")
    walks = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        walks.append([int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1])
    owner, free = [-1] * slots, slots
    while free:
        for shard, walk in enumerate(walks):
            for _ in range(min(weights[shard], free)):
                while owner[walk[0]] >= 0:
                    walk[0] = (walk[0] + walk[1]) % slots
                owner[walk[0]] = shard
                free -= 1
            if not free:
                break
    return owner


def shard(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> DataFrame:
    """Adds `slot` int and `shard` string to every row of df, replacing columns of these names.

    Rows with equal keys, repeated rows among them, share a shard. A null key counts as one key of its
    own, an empty string as another. An empty table stays empty. No shuffle takes place.
    """
    spark = df.sparkSession
    owner = lookup_table(shards, slots, weights)
    found = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(owner)], "__slot int, __shard string")
    rest = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    hashed = F.pmod(F.xxhash64(F.coalesce(F.concat(F.lit("k"), df[key].cast("string")), F.lit("n"))), F.lit(slots)).cast("int")
    return (
        df.select(F.struct(*rest).alias("__row"), hashed.alias("__at"))
        .join(F.broadcast(found), F.col("__at") == F.col("__slot"), "left")
        .select("__row.*", F.col("__at").alias("slot"), F.col("__shard").alias("shard"))
    )


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document over 64 shards."""
    from quillon.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id")
    return shard(docs, "doc_id", [f"shard-{i:03d}" for i in range(64)])
