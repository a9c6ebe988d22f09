"""Shard placement by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size: start and step
come from two hashes of its name. Shards take turns in claiming the next free slot of their order
until the table is full, so each owns nearly the same number of slots, and taking one shard away
moves few slots of the others. A key goes to the shard of slot hash(key) mod size: one lookup. The
table has ``size`` rows, whatever the data, so it is broadcast and placement needs no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.text import narrow

# A prime of more than 100 slots for each of 600 shards.
SLOTS = 65537
MOST_SLOTS = 1 << 20


def _hash(text: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8, salt=salt).digest(), "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], size: int = SLOTS, weights: dict[str, int] | None = None) -> np.ndarray:
    """For each slot the number of its shard in ``shards``; a shard of weight w claims w slots a turn.

    Names must differ and not be empty as a list; ``size`` is a prime of at most ``MOST_SLOTS`` and at
    least the number of shards; weights are 1 or more.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table size must be a prime from {len(shards)} to {MOST_SLOTS}")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be 1 or more")
    table = np.full(size, -1, np.int32)
    # Turns are taken in the order of names, so the order of the list does not matter.
    order = sorted(range(len(shards)), key=shards.__getitem__)
    place = [_hash(s, b"start") % size for s in shards]
    step = [_hash(s, b"step") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    free = size
    while True:
        for s in order:
            for _ in range(turns[s]):
                while table[place[s]] >= 0:
                    place[s] = (place[s] + step[s]) % size
                table[place[s]] = s
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, size: int) -> Column:
    """The first 60 bits of the MD5 of the key as text, modulo the table size; null counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def place(docs: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = SLOTS,
          weights: dict[str, int] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id (the key), slot, shard.

    Equal keys share a shard, so repeated rows stay together; a null key is the empty text. An empty
    table gives an empty result; further columns are ignored.
    """
    table = lookup_table(shards, size, weights)
    spark = docs.sparkSession
    rows = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], "slot long, shard string")
    keyed = narrow(docs, doc_id=key_col).withColumn("slot", slot_of(F.col("doc_id"), size))
    return keyed.join(F.broadcast(rows), "slot").select("doc_id", "slot", "shard")
