"""Sharding by jump consistent hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratescope.llm.common import ranks_within, text_of
from ratescope.runtime import settle


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of ``key`` among ``shards``, without a table of shards.

    A key jumps from shard b to shard floor((b + 1) / u), u uniform in (0, 1], as long as the target
    exists; the last shard it stood on is its own. The u of a jump is the key's hash seeded with b, so
    a larger number of shards continues the same jumps: with one more, the key stays or lands
    on the new one, the latter with probability 1 / (shards + 1).
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def jump(state, _):
        on = state["next"]
        u = (F.shiftrightunsigned(F.xxhash64(key, on), 33) + 1) / F.lit(float(1 << 31))
        far = F.least(F.floor((on + 1) / u), F.lit(1 << 40))
        return F.when(on >= shards, state).otherwise(F.struct(on.alias("on"), far.cast("long").alias("next")))

    start = F.struct(F.lit(0).cast("long").alias("on"), F.lit(0).cast("long").alias("next"))
    # each jump goes at least one shard up, so as many steps as shards always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["on"].cast("int"))


def shard_rows(
    docs: DataFrame, shards: int, id_column: str = "doc_id", text_column: str = "text", overhead: int = 8, rows_per_part: int = 50_000
) -> DataFrame:
    """Shard and place of every row; the id and the number of shards decide alone.

    Returns id, size (UTF-8 bytes of the text plus ``overhead``, a null text has none), text_crc32,
    law, shard, slot (from 0 without gaps in each shard) and grown_shard (with one more shard). A
    null id is a key like any other. Slots are numbered in parts of a shard, the number of which
    follows from the row count, so no task sorts a whole shard. Rows with the same id and text
    take neighbouring slots in any order.
    """
    text = text_of("text")
    key = F.col("id")
    sized = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).select(
        "id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = settle(sized.withColumn("shard", jump_shard(key, shards)).withColumn("grown_shard", jump_shard(key, shards + 1)))
    parts = max(1, -(-placed.count() // (shards * rows_per_part)), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    slotted = ranks_within(placed, ["shard"], ["id", "text_crc32", "size"], "slot", F.xxhash64("id", "text_crc32"), parts)
    return slotted.select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
