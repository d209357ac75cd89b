"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by a permutation of its
own (a start and a stride taken from the hash of its name).  The shards take
turns, each claiming the first free slot of its order, until the table is
full.  A row goes to the slot its key hashes to and so to the shard that owns
the slot: one lookup in a broadcast table of fixed size.  Shards get equal
numbers of slots, give or take one, and a shard that comes or goes moves few
rows beside its own.

The table depends on the shard names alone and has ``TABLE_SIZE`` rows however
large the data is, so its broadcast is bounded.
"""

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docketry.llm.frames import named

#: Slots of the lookup table: a prime, over a hundred times the shard number.
TABLE_SIZE = 8191
SHARDS = tuple(f"shard-{n:02d}" for n in range(64))

#: Hex digits of the MD5 that make a hash; 60 bits fit a BIGINT.
HASH_DIGITS = 15


def name_hash(text: str) -> int:
    """The same number as :func:`key_hash` gives for a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def key_hash(text: Column) -> Column:
    """A 60-bit hash of a string column."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def slot_owners(shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it.

    Repeated names, no names, fewer slots than shards or a size that is not
    prime are refused.
    """
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be distinct, at least one and at most the table size")
    if size < 2 or any(size % n == 0 for n in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be prime")
    at = [name_hash(name) % size for name in shards]
    stride = [name_hash(f"{name}#") % (size - 1) + 1 for name in shards]
    owner = [-1] * size
    for turn in range(size):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + stride[shard]) % size
        owner[at[shard]] = shard
    return owner


def lookup_table(
    spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """``slot, shard`` of the whole table, ``size`` rows."""
    owners = F.split(F.lit(",".join(map(str, slot_owners(shards, size)))), ",")
    names = F.array(*[F.lit(name) for name in shards])
    return (
        spark.range(1, numPartitions=1)
        .select(F.posexplode(owners).alias("slot", "owner"))
        .select(F.col("slot").cast("long"), F.get(names, F.col("owner").cast("int")).alias("shard"))
    )


def place(
    rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """``rows`` with ``slot`` and ``shard`` by the key column.

    NULL keys count as the empty text.  Rows of one key share a shard; every
    row comes back once.  Columns of the input named ``slot`` or ``shard`` are
    replaced.  An empty input gives an empty result.
    """
    kept = [named(c) for c in rows.columns if c.lower() not in ("slot", "shard")]
    text = F.coalesce(named(key).cast("string"), F.lit(""))
    slot = F.pmod(key_hash(text), F.lit(size).cast("long"))
    owned = lookup_table(rows.sparkSession, shards, size)
    return rows.select(*kept, slot.alias("slot")).join(F.broadcast(owned), "slot")


def write_shards(
    rows: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> None:
    """One folder ``shard=...`` for each shard under ``path``.

    Rows are dealt by slot, not by shard, so that a shard is written by as many
    tasks as the cluster gives it.
    """
    placed = place(rows, key, shards, size)
    placed.repartition(F.col("slot")).write.partitionBy("shard").parquet(path)
