"""Hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 32 bits.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a32(x: Column) -> Column:
    """FNV-1a over a text's UTF-8 bytes, as a whole number; null stays null."""
    digits = F.hex(F.encode(x, "UTF-8"))
    byte = lambda i: F.conv(F.substr(digits, 2 * i - F.lit(1), F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), (F.length(digits) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(x.isNotNull(), F.aggregate(places, F.lit(FNV_OFFSET).cast("bigint"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))))


def bucket(x: Column, buckets: int) -> Column:
    return F.pmod(fnv1a32(x), F.lit(buckets))


def sha_shard(x: Column, digits: int = 2) -> Column:
    """The first hex digits of a text's SHA-256."""
    return F.substring(F.sha2(x, 256), 1, digits)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))
