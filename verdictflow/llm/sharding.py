"""Rendezvous sharding: every record goes to the shard with the lowest weighted cost for its stable key.

The cost of shard ``s`` with weight ``w`` for key ``k`` is ``-ln(u(k, s)) / w`` with ``u`` a uniform hash in (0, 1).
Costs of the old shards do not depend on the number of shards, so a further shard takes records into itself only.
All work is DataFrame functions: one scan of the table, one shuffle of slim rows (no text) to number the slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictflow.llm.common import materialize, table, text_or_empty

#: Slots are numbered within (shard, part); the parts bound the rows of one window whatever the size of a shard.
SLOT_PARTS = 1024
RECORD_OVERHEAD = 16
SEED = "rendezvous-1"


def shard_cost(key: Column, shard: int, weight: float) -> Column:
    """Cost of one shard for a key. The hash has 53 usable bits and a half step, so the logarithm is always finite."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(shard), key), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))


def choose_shard(key: Column, weights: Sequence[float], ids: Sequence[int] | None = None) -> Column:
    """Struct(cost, shard) of the cheapest shard; equal costs go to the lower shard number.

    Shards with weight 0 or less take no record."""
    ids = list(range(len(weights))) if ids is None else list(ids)
    costs = [F.struct(shard_cost(key, s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in zip(ids, weights, strict=True) if w > 0]
    if not costs:
        raise ValueError("at least one shard needs a positive weight")
    return F.least(*costs) if len(costs) > 1 else costs[0]


def shard_documents(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    slot_parts: int = SLOT_PARTS,
) -> DataFrame:
    """Assign every row of ``docs`` to a shard by ``key``.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard, one row for each input row.

    * A null text has no bytes (size 16, checksum of the empty text 0); a null key is a key of its own.
    * Repeated rows share a shard (the key decides) and get different slots; which of them gets which is arbitrary.
    * An empty table gives an empty result. Other columns of ``docs`` are not read.
    * Slots count from 0 without gaps in each shard. Rows are spread over ``slot_parts`` parts by row, not by key, so that a
      key that holds a third of the rows is still numbered in many tasks; the offsets of the parts are at most
      ``len(weights) * slot_parts`` rows, which is the proven size of what is broadcast.
    """
    n = len(weights)
    k = F.col(key).cast("string")
    slim = (
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(text_or_empty(text)).cast("long") + F.lit(RECORD_OVERHEAD)).cast("long").alias("size"),
            F.crc32(text_or_empty(text).cast("binary")).cast("long").alias("text_crc32"),
            choose_shard(k, weights).alias("_best"),
            shard_cost(k, n, grown_weight).alias("_grown_cost"),
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slot_parts)).cast("int").alias("_part"),
        )
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("_best.shard").alias("shard"),
            F.when(F.col("_grown_cost") < F.col("_best.cost"), F.lit(n)).otherwise(F.col("_best.shard")).alias("grown_shard"),
            "_part",
        )
    )
    slim = materialize(slim, "shards")  # the row numbers behind the parts are fixed here once
    counts = slim.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return slim.join(F.broadcast(offsets), ["shard", "_part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_offset") + F.row_number().over(within) - F.lit(1)).cast("long").alias("slot"),
        "grown_shard",
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 40)
