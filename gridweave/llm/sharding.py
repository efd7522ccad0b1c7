"""Sharding by a lookup table that the shards fill in turn."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, pick

TABLE_SIZE = 65537
LARGEST_TABLE = 1 << 22  # slots; the table is broadcast


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The shard number of every slot.

    Each shard prefers the slots in an order of its own: from a start in steps of a stride, which
    visits all slots since their number is prime. In turn, each claims the first free slot of its order.
    The slots per shard differ by one at most, and few slots change owner when a shard comes or goes.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need names that differ")
    if not _is_prime(table_size) or not len(shards) <= table_size <= LARGEST_TABLE:
        raise ValueError(f"the table needs a prime size from the number of shards to {LARGEST_TABLE}")
    at = [_number(f"start:{s}") % table_size for s in shards]
    stride = [_number(f"stride:{s}") % (table_size - 1) + 1 for s in shards]
    owner = [-1] * table_size
    free = table_size
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % table_size
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(keys: Sequence[Column], table_size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table size. Null is a key like others."""
    text = F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % table_size).cast("int")


def shard_rows(
    rows: DataFrame, keys: Sequence[str], shards: Sequence[str], table_size: int = TABLE_SIZE
) -> DataFrame:
    """The shard of each row: the key columns, ``slot``, ``shard`` and ``row`` (the whole input row).

    The table depends on the shards alone and has ``table_size`` rows, so it can be broadcast whatever the
    size of the input; a row needs one hash and one lookup, and nothing is shuffled. Equal keys share a shard, so
    repeated rows and copies of one key stay together. An empty table gives an empty result. Key columns named
    ``slot``, ``shard`` or ``row`` are refused; other columns of these names are only in ``row``.
    """
    pick(rows, **{f"k{i}": k for i, k in enumerate(keys)})
    if {"slot", "shard", "row"} & {k.lower() for k in keys}:
        raise ValueError("keys can't be called slot, shard or row")
    table = _as_rows(rows.sparkSession, shards, lookup_table(shards, table_size))
    placed = rows.select(
        *[named(k).alias(k) for k in keys],
        slot_of([named(k) for k in keys], table_size).alias("slot"),
        F.struct(*[named(c) for c in rows.columns]).alias("row"),
    )
    return placed.join(F.broadcast(table), "slot").select(*[named(k) for k in keys], "slot", "shard", "row")


def _as_rows(spark: SparkSession, shards: Sequence[str], owner: list[int]) -> DataFrame:
    numbers = F.from_json(F.lit(json.dumps(owner)), "array<int>")
    names = F.array(*[F.lit(s) for s in shards])
    slots = spark.range(1).select(F.posexplode(numbers).alias("slot", "number"))
    return slots.select("slot", F.element_at(names, F.col("number") + 1).alias("shard"))


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard, with so many files each; rows of a large shard spread over its files."""
    whole = sharded.select("shard", "row.*")
    file = F.pmod(F.xxhash64(*[named(c) for c in whole.columns if c != "shard"]), F.lit(files_per_shard))
    n = files_per_shard * sharded.select("shard").distinct().count()
    whole.repartition(max(1, n), "shard", file).write.partitionBy("shard").parquet(path)
