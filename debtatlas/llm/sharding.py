"""Sharding by a permutation-filled lookup table, in built-in expressions only.

Each shard has its own order of preference over a prime number of slots, from two hashes of
its name. Shards take turns, each claiming the first slot of its order that is still free,
until all are taken. A key's slot is its hash modulo the table size, its shard the slot's
owner. Shares differ by at most one slot, and when a shard leaves, few other slots change.
The table has a fixed size whatever the data, so it is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS, SLOTS = 64, 6_469
#: Slots of the largest table that is broadcast (a few MB).
MOST_SLOTS = 1 << 20
_DIGITS = 12


def _is_prime(number: int) -> bool:
    return number > 1 and all(number % d for d in range(2, int(number ** 0.5) + 1))


def names(count: int) -> list[str]:
    return [f"shard-{n}" for n in range(count)]


def fill(shards: list[str], slots: int) -> list[int]:
    """The number of the owning shard for every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MOST_SLOTS}")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    spots = [int(d[:_DIGITS], 16) % slots for d in digests]
    skips = [int(d[_DIGITS:2 * _DIGITS], 16) % (slots - 1) + 1 for d in digests]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(min(len(shards), slots)):
            while owner[spots[shard]] >= 0:
                spots[shard] = (spots[shard] + skips[shard]) % slots
            owner[spots[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) for every slot."""
    owners = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select(
        F.col("slot").cast("long").alias("slot"), F.col("owner").cast("int").alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: list[str] | None = None, slots: int = SLOTS,
          slot_column: str = "slot", shard_column: str = "shard") -> DataFrame:
    """All rows and columns with their slot and the number of their shard.

    Equal keys go to one shard; NULL keys go together, where the empty string goes. Columns
    that have the new names already are replaced. An empty table gives no rows.
    """
    found = lookup_table(rows.sparkSession, shards or names(SHARDS), slots).toDF("__slot", "__shard")
    rest = rows.drop(*({slot_column, shard_column} & set(rows.columns) - {key}))
    placed = rest.withColumn("__place", slot_of(F.col(key), slots)).join(
        F.broadcast(found), F.col("__place") == F.col("__slot"))
    return placed.withColumn(slot_column, F.col("__slot")).withColumn(
        shard_column, F.col("__shard")).drop("__place", "__slot", "__shard")


def write_shards(rows: DataFrame, path: str, key: str, shards: list[str] | None = None,
                 slots: int = SLOTS, rows_per_file: int = 1_000_000) -> None:
    """Write a folder per shard. As many tasks share each shard, by slot and row, as it takes
    for one to write some ``rows_per_file`` rows, also where most rows have one key."""
    shards = shards or names(SHARDS)
    parts = max(1, -(-rows.count() // (rows_per_file * len(shards))))
    (place(rows, key, shards, slots)
     .withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
     .repartition(len(shards) * parts, "shard", "__part").drop("__part")
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))


def op1_sharding(spark, folder: str) -> DataFrame:
    return place(table(spark, folder, "documents").select("doc_id"), "doc_id")


OP1_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('shard-' || i), 1, {_DIGITS}))::BIGINT % {SLOTS} AS first,
         ('0x' || substr(md5('shard-' || i), {_DIGITS + 1}, {_DIGITS}))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM range({SHARDS}) AS r(i)),
orders AS (SELECT list(first ORDER BY i) AS firsts, list(skip ORDER BY i) AS skips FROM shards),
turns AS (
  SELECT 0::BIGINT AS turn, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner,
         list_transform(range({SHARDS}), lambda x: 0::BIGINT) AS tried, -1::BIGINT AS slot
  UNION ALL
  SELECT turn + 1, owner[:claimed] || [shard] || owner[claimed + 2:],
         tried[:shard] || [step + 1] || tried[shard + 2:], claimed
  FROM (
    SELECT *, (firsts[shard + 1] + step * skips[shard + 1]) % {SLOTS} AS claimed
    FROM (
      SELECT turn, owner, tried, firsts, skips, shard,
             list_filter(range(tried[shard + 1], {SLOTS}), lambda j:
               owner[(firsts[shard + 1] + j * skips[shard + 1]) % {SLOTS} + 1] < 0)[1] AS step
      FROM (SELECT *, turn % {SHARDS} AS shard FROM turns, orders WHERE turn < {SLOTS}))))
SELECT d.doc_id, t.slot, ((t.turn - 1) % {SHARDS})::INTEGER AS shard
FROM documents d JOIN turns t
  ON t.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, {_DIGITS}))::BIGINT % {SLOTS}
"""
