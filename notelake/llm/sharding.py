"""Operator 13: sharding by a Feistel permutation of global row numbers.

Rows are numbered by their place in the order of (doc_id, sha256 of the text), which depends on the rows alone and not
on files or partitions. A Feistel network on the bits of the row number, keyed by a seed, permutes the smallest domain
of an even number of bits that holds all n numbers; a value that falls outside 0..n-1 is sent through again (cycle
walking) until it falls inside, which makes a permutation of 0..n-1. Place p goes to shard p mod k, slot p div k:
shards differ by one row at most. Shard and slot follow from (row, n, k, seed) without any table, and ``row_of`` is
the way back: which row stands in a slot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, utf8

SHARDS, SEED, ROUNDS = 8, 42, 6
_32 = np.uint64(0xFFFFFFFF)
_ODD = (np.uint64(0x9E3779B1), np.uint64(0x85EBCA77))


def half_bits(n: int) -> int:
    """Bits of each half of the smallest domain 4**bits that holds 0..n-1."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def round_keys(seed: int) -> list[int]:
    return [int(hashlib.sha256(f"{seed}:{r}".encode()).hexdigest()[:8], 16) for r in range(ROUNDS)]


def _mixed(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    h = (half + np.uint64(key)) & _32
    h = h * _ODD[0] & _32
    h ^= h >> np.uint64(15)
    h = h * _ODD[1] & _32
    return (h ^ h >> np.uint64(13)) & mask


def _once(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    bits, mask = np.uint64(half_bits(n)), np.uint64((1 << half_bits(n)) - 1)
    left, right = x >> bits, x & mask
    for key in keys:
        left, right = right, left ^ _mixed(right, key, mask)
    return right << bits | left  # the halves change places once more, so the same rounds with keys reversed undo it


def _walked(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        moved = _once(out[todo], n, keys)
        out[todo] = moved
        todo = todo[moved >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Places of ``rows`` (of 0..n-1) in the shuffle of n rows."""
    return _walked(rows, n, round_keys(seed))


def restored(places: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Rows that stand at ``places``: the inverse of ``permuted``."""
    return _walked(places, n, round_keys(seed)[::-1])


def place_of(rows: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of each row number."""
    p = permuted(rows, n, seed)
    return p % shards, p // shards


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Row number that stands in each (shard, slot)."""
    return restored(slot * shards + shard, n, seed)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with all its columns, row (its number), shard and slot.

    Rows are numbered by doc_id (null first), then by the sha256 of the text (null like empty); rows equal in both are
    numbered one after another in any order. Equal texts are not kept together: copies spread over all shards as other
    rows do, so a group of any size leaves shards even. Fewer rows than shards leave the last shards empty; an empty
    table gives no rows. Columns of ``docs`` named row, shard or slot stay; the new ones then get an underscore.

    The texts move once, to the range of their doc_id; a row number that breaks ties keeps a doc_id with very many
    rows from being one range. The driver sees one count a range.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    text, tie, row, place = fresh("_digest", docs), fresh("_tie", docs), fresh("row", docs), fresh("_place", docs)
    shard, slot = fresh("shard", docs), fresh("slot", docs)
    own = docs.withColumn(text, F.sha2(utf8(), 256)).withColumn(tie, F.monotonically_increasing_id())
    rows, n = numbered(own, [F.col("doc_id").asc_nulls_first(), F.col(text), F.col(tie)], row, "sharded")

    @F.pandas_udf("long")
    def places(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    return (
        rows.drop(text, tie)
        .withColumn(place, places(row))
        .withColumns({shard: (F.col(place) % shards).cast("int"), slot: F.expr(f"{place} div {shards}")})
        .drop(place)
    )


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """The result of ``sharded`` as Parquet under ``path``/shard=k, each file a range of slots in their order."""
    ranged = rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    ranged.write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path)
