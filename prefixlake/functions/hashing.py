"""Hashes of keys, shards and tokens. 64-bit values are signed longs with the bits of the unsigned ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: FNV-1a's offset and prime.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF


@F.pandas_udf(LongType())
def fnv1a_64(key: pd.Series) -> pd.Series:
    """FNV-1a of 64 bits of a string's or binary's bytes, one byte of all rows at a time; null stays null."""
    data = [x if isinstance(x, bytes) else x.encode() if isinstance(x, str) else None for x in key]
    size = np.array([-1 if x is None else len(x) for x in data], np.int64)
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(x for x in data if x), np.uint8).astype(np.uint64)
    start = (np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0))[order]
    longer = np.searchsorted(-size[order], -np.arange(max(0, size.max(initial=0))), "left")
    h = np.full(len(data), FNV_START, np.uint64)
    for at, n in enumerate(longer.tolist()):
        h[:n] = (h[:n] ^ flat[start[:n] + at]) * np.uint64(FNV_PRIME)
    out = np.empty(len(data), np.int64)
    out[order] = h.view(np.int64)
    return pd.Series(out, dtype="Int64").mask(pd.Series(size < 0))


def fnv1a(key: Column) -> Column:
    """FNV-1a of 64 bits as a struct of halves (hi, lo), both non-negative."""
    h = fnv1a_64(key)
    return F.when(h.isNotNull(), F.struct(F.shiftrightunsigned(h, 32).alias("hi"), h.bitwiseAND(F.lit(_LOW)).alias("lo")))


def fnv1a_hex(key: Column) -> Column:
    h = fnv1a(key)
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def shard_of(key: Column, shards: Column | int) -> Column:
    """FNV-1a modulo the shard count, unsigned; 0 if that is 0."""
    n = F.lit(shards).cast("long") if isinstance(shards, int) else shards.cast("long")
    h = fnv1a(key)
    found = ((h["hi"] % n) * (F.lit(1 << 32) % n) + h["lo"]) % n
    return F.when(n == 0, F.lit(0)).otherwise(found).cast("int")


def lock_shard(key: Column) -> Column:
    """(bucket, lock shard): the low ten and the low eight bits of the hash."""
    low = fnv1a(key)["lo"]
    return F.struct(low.bitwiseAND(F.lit(1023)).cast("int").alias("bucket"), low.bitwiseAND(F.lit(255)).cast("int").alias("lock"))


def _mixed(x: np.ndarray) -> np.ndarray:
    # splitmix64's finalizer; its constants are fixed values.
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(LongType())
def mix64(x: pd.Series) -> pd.Series:
    """splitmix64's finalizer; the multiplications wrap, which Spark's own do not."""
    return pd.Series(_mixed(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))


@F.pandas_udf(LongType())
def rendezvous_weight(node_hash: pd.Series, shard: pd.Series) -> pd.Series:
    own = _mixed(shard.to_numpy(np.int64).view(np.uint64))
    return pd.Series(_mixed(node_hash.to_numpy(np.int64).view(np.uint64) ^ own).view(np.int64))


def as_signed(halves: Column) -> Column:
    """A struct of halves as one signed long of the same bits."""
    high = F.when(halves["hi"] >= (1 << 31), halves["hi"] - (1 << 32)).otherwise(halves["hi"])
    return F.shiftleft(high, 32).bitwiseOR(halves["lo"])


def unsigned_order(x: Column) -> Column:
    """A column that sorts as the unsigned value of x does."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def hex64(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def spill_path(key: Column) -> Column:
    """Two folder levels and a file name from the hash of a key."""
    h = fnv1a_hex(key)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def token_bytes(token: Column) -> Column:
    """A token id as four big-endian bytes, negative ones as two's complement."""
    return F.unhex(F.lpad(F.hex(token.cast("long").bitwiseAND(F.lit(_LOW))), 8, "0"))


def u32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def sized(text: Column) -> Column:
    """Bytes of a string behind their count, four bytes big-endian."""
    data = text.cast("binary")
    return F.concat(u32(F.octet_length(data)), data)
