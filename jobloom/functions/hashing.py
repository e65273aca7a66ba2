"""Keyed hashes out of Spark's own functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer key of HMAC over SHA-256."""
    whole = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in whole), bytes(b ^ 0x5C for b in whole)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text or binary column in hex; null stays null. The key is part of the plan: who may read plans may read it."""
    inner, outer = (F.lit(bytearray(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def client_hash(secret: bytes, use: str, address: Column) -> Column:
    """What a client's address is stored as: of one use only, so that hashes of different uses cannot be joined."""
    return hmac_sha256(secret, F.concat(F.lit(f"{use}:"), F.coalesce(address, F.lit(""))))
