"""Placement of keys on shards through a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, from two hashes
of its name. The shards take turns; each claims the first slot of its permutation
that is free, until the table is full. A key's hash modulo the table size is its
slot. The table has a fixed size whatever the data, so it is broadcast, and adding
or removing a shard moves few keys.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm.common import pick

SHARDS = 64
SLOTS_PER_SHARD = 100
LARGEST = 1_000_003
HALF = 2 ** 32


def prime_from(n: int) -> int:
    """The smallest prime that is at least n."""
    while n < 2 or any(n % d == 0 for d in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup(shards: list[str], slots: int) -> list[int]:
    """Slot -> place of its shard in the list; a table of at most LARGEST slots."""
    if not shards or slots < len(shards) or slots > LARGEST or prime_from(slots) != slots:
        raise ValueError(f"{slots} slots for {len(shards)} shards: a prime from the number of shards to {LARGEST} is needed")
    at = [digest(f"offset:{s}") % slots for s in shards]
    step = [digest(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        owner[at[i]] = i
    return owner


def key_slot(key: Column, slots: int) -> Column:
    """A null key counts as the empty string."""
    name = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], slots: int | None = None) -> DataFrame:
    """Rows (key, slot, shard): the shard of every key, equal keys together.

    A null key is placed like the empty string; an empty table gives no rows. Only
    the key column is read. The broadcast table has ``slots`` rows, never more
    than LARGEST, whatever the input.
    """
    slots = slots or prime_from(SLOTS_PER_SHARD * len(shards))
    spark = rows.sparkSession
    owner = lookup(shards, slots)
    lists = spark.range(1).select(F.posexplode(F.lit(owner)).alias("slot", "i"))
    names = F.element_at(F.lit(list(shards)), F.col("i") + 1)
    claims = F.broadcast(lists.select("slot", names.alias("shard")))
    return pick(rows, key).withColumn("slot", key_slot(F.col(key), slots)).join(claims, "slot").select(key, "slot", "shard")


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]
