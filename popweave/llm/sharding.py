"""Sharding by a permutation-filled lookup table (DataFrame functions only).

Every shard has a preference order over the slots of a prime-sized table, an
arithmetic progression whose offset and step hash the shard's name.  Shards
take turns; each claims the first free slot of its order, until the table is
full, so shares differ by at most one slot and the loss of one shard moves few
other keys.  The table has a fixed size (``slots``, a parameter that no data
raises), is broadcast, and a row's shard is one lookup by its key's hash.

Edge cases: a null key hashes as the empty string; equal keys go to the same
shard; an empty table gives an empty result; the input's columns come back
untouched, with the two new columns under names that the caller gives.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from popweave.functions.hashing import hash_key
from popweave.llm.common import table, whole_row

#: A prime over a hundred times the number of shards.
SLOTS = 2039
SHARDS = 16
SEED = 10


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or slots < max(len(shards), 2) or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    at = [_hash(f"offset:{s}") % slots for s in shards]
    step = [_hash(f"step:{s}") % (slots - 1) + 1 for s in shards]
    held = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while held[at[i]] >= 0:
            at[i] = (at[i] + step[i]) % slots
        held[at[i]] = i
    return held


def place(docs: DataFrame, key_col: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS,
          seed: int = SEED, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``docs`` with the slot and the index of the shard of each row."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    held = ",".join(map(str, lookup_table(names, slots)))
    lookup = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(held), ",")).alias("_slot", "_shard")).select(
        "_slot", F.col("_shard").cast("int").alias("_shard"))
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))
    number = F.conv(F.substring(F.md5(hash_key(seed, key)), 1, 13), 16, 10).cast("long")
    rows = docs.select(whole_row(docs).alias("_row"), F.pmod(number, F.lit(slots)).cast("int").alias("_slot"))
    return rows.join(F.broadcast(lookup), "_slot").select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns],
        F.col("_slot").alias(slot_col), F.col("_shard").alias(shard_col))


def write_shards(docs: DataFrame, path: str, files_per_shard: int = 1, **placing) -> None:
    """One folder ``shard=i`` for each shard, with ``files_per_shard`` files."""
    placed = place(docs, slot_col="_slot", shard_col="_shard", **placing)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files_per_shard))
    (placed.withColumn("_part", part).repartition("_shard", "_part").drop("_slot", "_part")
     .withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place and whole row."""
    return place(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same claims, slot by slot, in a recursive query."""
    h = "('0x' || substr(md5({}), 1, 13))::BIGINT"
    return f"""
WITH RECURSIVE
  names AS (SELECT i, {h.format("'offset:shard-' || i")} % {SLOTS} AS o,
                   {h.format("'step:shard-' || i")} % {SLOTS - 1} + 1 AS s
            FROM generate_series(0, {SHARDS - 1}) t(i)),
  prefs AS (SELECT i, list((o + j * s) % {SLOTS} ORDER BY j) AS p
            FROM names, generate_series(0, {SLOTS - 1}) g(j) GROUP BY i),
  fill(turn, held) AS (
    SELECT 0, list_transform(range({SLOTS}), lambda x: -1)
    UNION ALL
    SELECT turn + 1,
           list_concat(list_concat(held[1:f.slot], [turn % {SHARDS}]), held[f.slot + 2:])
    FROM fill, LATERAL (SELECT list_filter(p, lambda x: held[x + 1] < 0)[1] AS slot
                        FROM prefs WHERE i = turn % {SHARDS}) f
    WHERE turn < {SLOTS}),
  lookup AS (SELECT unnest(range({SLOTS})) AS slot, unnest(held) AS shard FROM fill WHERE turn = {SLOTS})
SELECT d.*, l.slot::INT AS slot, l.shard::INT AS shard
FROM documents d JOIN lookup l
  ON l.slot = {h.format(f"'{SEED}:' || coalesce(d.doc_id::VARCHAR, '')")} % {SLOTS}"""


ORACLE = _oracle()

QUERIES = {"op10_sharding": op10_sharding}
ORACLES = {"op10_sharding": ORACLE}
