"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table. The shards take
turns; each claims the first slot of its permutation that is still free. A row is
placed by one hash of its key and one look into the table, and when a shard is taken
away most slots keep their owner.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to every executor; with this bound it stays below some megabytes.
MAX_SLOTS = 1 << 20


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int) -> list[int]:
    """The number of the shard that owns each slot.

    The first slot a shard prefers and its step come from two hashes of its name.
    All shards get the same share, one slot more or less.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, and one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_digest(s + "/offset") % slots for s in shards]
    step = [_digest(s + "/skip") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        owner[at[i]] = i
    return owner


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """slot int, shard string; `slots` rows."""
    text = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*map(F.lit, shards))
    one = spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "i"))
    return one.select("slot", F.element_at(names, F.col("i").cast("int") + 1).alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5 as a slot."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], slots: int) -> DataFrame:
    """All rows and columns of `df` with `slot` and `shard`.

    Rows with equal keys share a shard; repeated rows stay. A null key counts as the
    empty text. Columns named slot or shard are replaced. An empty table stays empty.
    Only the table is broadcast, `slots` rows and no more than MAX_SLOTS.
    """
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    kept = df.withColumn("__slot", slot_of(F.coalesce(key.cast("string"), F.lit("")), slots)).drop("slot", "shard")
    return kept.withColumnRenamed("__slot", "slot").join(table, "slot").select(*[c for c in kept.columns if c != "__slot"], "slot", "shard")


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder a shard; files of about equal size, so that a large shard is written by many tasks."""
    placed.hint("rebalance", "shard").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
