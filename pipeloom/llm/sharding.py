"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size: ``(offset + j * skip) mod size`` for j = 0, 1, ...  Shards take turns; on
its turn a shard claims the first slot of its order that is still free, until the
table is full. So every shard owns ``size / n_shards`` slots give or take one,
and dropping or adding a shard moves few others. A row's slot is a hash of its
key modulo the table size; its shard is a look-up in the table, which is
broadcast (its size is a parameter, at most MAX_SLOTS rows, whatever the data).

The table is filled once on the driver, in ``size`` turns; rows are placed by
DataFrame functions alone.

Defined results: a null key is placed like the empty string; rows with equal
keys, repeated rows included, share a shard; an empty table gives an empty
table; a column that bears the name of a result is replaced, all others stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20
N_SHARDS, N_SLOTS = 32, 4093


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(n_shards: int = N_SHARDS, n_slots: int = N_SLOTS) -> list[int]:
    """The shard of each slot."""
    if n_slots > MAX_SLOTS or n_slots < n_shards or n_slots < 2 or any(n_slots % p == 0 for p in range(2, int(n_slots**0.5) + 1)):
        raise ValueError(f"n_slots must be a prime from n_shards to {MAX_SLOTS}")
    at = [_number(f"offset-{i}") % n_slots for i in range(n_shards)]
    skip = [_number(f"skip-{i}") % (n_slots - 1) + 1 for i in range(n_shards)]
    table = [-1] * n_slots
    for turn in range(n_slots):
        i = turn % n_shards
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % n_slots
        table[at[i]] = i
    return table


def table_frame(spark: SparkSession, n_shards: int, n_slots: int, slot: str, shard: str) -> DataFrame:
    """The look-up table as (slot, shard) rows."""
    claimed = ",".join(map(str, lookup_table(n_shards, n_slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(claimed), ",")).alias(slot, "owner")).select(slot, F.col("owner").cast("int").alias(shard))


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """First 60 bits of the key's MD5 modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % n_slots).cast("int")


def shard(df: DataFrame, key: str = "doc_id", n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of every row."""
    out = df.drop(slot_col, shard_col).withColumn(slot_col, slot_of(F.col(key), n_slots))
    table = table_frame(df.sparkSession, n_shards, n_slots, slot_col, shard_col)
    return out.join(F.broadcast(table), slot_col).select(*[c for c in out.columns if c != slot_col], slot_col, shard_col)


ORACLE = f"""
WITH RECURSIVE prefs AS (
  SELECT i, ('0x' || substr(md5('offset-' || i), 1, 15))::BIGINT % {N_SLOTS} AS off,
         ('0x' || substr(md5('skip-' || i), 1, 15))::BIGINT % {N_SLOTS - 1} + 1 AS skip
  FROM range({N_SHARDS}) t(i)
), fill(turn, slots, slot) AS (
  SELECT 0, list_transform(range({N_SLOTS}), lambda x: false), -1
  UNION ALL
  SELECT turn + 1, list_transform(slots, lambda x, k: x OR k = pick + 1), pick FROM (
    SELECT f.turn, f.slots, (p.off + (list_position(list_transform(range({N_SLOTS}), lambda j: f.slots[(p.off + j * p.skip) % {N_SLOTS} + 1]), false) - 1) * p.skip) % {N_SLOTS} AS pick
    FROM fill f JOIN prefs p ON p.i = f.turn % {N_SHARDS} WHERE f.turn < {N_SLOTS})
), claimed AS (SELECT slot, (turn - 1) % {N_SHARDS} AS shard FROM fill WHERE turn > 0)
SELECT d.doc_id, CAST(c.slot AS INTEGER) AS slot, CAST(c.shard AS INTEGER) AS shard
FROM documents d JOIN claimed c ON c.slot = ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {N_SLOTS}
"""
