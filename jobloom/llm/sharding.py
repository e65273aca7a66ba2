"""Sharding by a permutation-filled lookup table (operator 4)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 8191


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and step of a shard's preference order over the slots; a prime size makes every step a permutation."""
    digest = hashlib.sha256(name.encode()).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> list[int]:
    """The slots' owners (positions in names). Shards claim in turn the next free slot of their order."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, and at least one")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("the number of slots must be prime and no less than the number of shards")
    orders = [preference(n, slots) for n in names]
    turn, owner, free = [0] * len(names), [-1] * slots, slots
    while free:
        for k, (offset, step) in enumerate(orders):
            while owner[slot := (offset + turn[k] * step) % slots] >= 0:
                turn[k] += 1
            owner[slot], free = k, free - 1
            if not free:
                break
    return owner


def slot_of(key: str, slots: int = SLOTS):
    """Slot of a key column: the first 60 bits of the md5 of its text, modulo the table's size; a null key counts as empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with a column `shard` (an existing column of that name is replaced).

    One lookup a row: the table has `slots` rows whatever the input's size, so it is always broadcast. Equal keys, and
    so repeated rows, get the same shard; null keys go to one shard; an empty table stays empty. When a shard is added
    or removed, only about 1/shards of the keys move.
    """
    spark = docs.sparkSession
    owners = spark.createDataFrame(list(enumerate(fill([f"shard-{k}" for k in range(shards)], slots))), "__slot long, __owner int")
    placed = docs.drop("shard").withColumn("__slot", slot_of(key, slots)).join(F.broadcast(owners), "__slot")
    return placed.withColumn("shard", F.col("__owner")).drop("__slot", "__owner")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    owners = fill([f"shard-{k}" for k in range(shards)], slots)
    return f"""
    WITH owners AS (SELECT {owners} AS o),
    keyed AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents)
    SELECT doc_id, CAST(o[slot + 1] AS INTEGER) AS shard FROM keyed, owners"""
