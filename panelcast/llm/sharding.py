"""Sharding by jump consistent hashing.

A row's shard depends on its key and the number of shards alone.  There is no ring table:
the key seeds a 64-bit linear congruential sequence and the row "jumps" through the shard
counts at which it would move, so that appending a shard moves only the rows that land in
the new one (one row in n + 1 on average).

Slots number the rows of a shard without gaps.  They come from one range-partitioned,
checkpointed table of (key, size, crc, copies): per partition and shard a running sum,
per shard the sum of the partitions before it.  No task sees a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import materialize, shuffle_partitions

#: Fixed values of the jump hash: multiplier of the 64-bit sequence.
MULTIPLIER = 2862933555777941757
#: Identical rows are split over this many groups before they are counted.
COPY_SALT = 64


def jump_shards(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all at once: every pass advances the
    rows that have not yet jumped past ``n_shards`` (about ln(n_shards) passes)."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    jump = np.zeros(len(state), dtype=np.int64)
    while len(live):
        shard[live] = jump[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = np.floor((shard[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[jump[live] < n_shards]
    return shard.astype(np.int32)


def shard_column(key: Column, n_shards: int) -> Column:
    """Shard of a long key (a negative key counts modulo 2^64; null counts as 0)."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump_shards(k.to_numpy(dtype=np.int64).view(np.uint64), n_shards))

    return of(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def key_as_long(df: DataFrame, key_col: str) -> Column:
    """Whole-number keys stand for themselves; any other type is hashed to 64 bits."""
    if dict(df.dtypes)[key_col] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(key_col).cast("long")
    return F.xxhash64(F.col(key_col).cast("string"))


def shard_documents(docs: DataFrame, n_shards: int = 8, key_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row with its shard, its slot in the shard and its shard after one more is added.

    Returns ``key_col``, size (UTF-8 bytes of the text plus 1), text_crc32, law (``key``),
    shard, slot, grown_shard.  Slots follow (key, size, crc) within a shard.

    Defined cases: null text has size 1 and the crc of the empty text; a null key shards
    as 0 and comes first; repeated rows stay in one shard with a slot each; an empty table
    gives no rows; other columns of the input are not read.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(key_col),
        key_as_long(docs, key_col).alias("__key"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        (F.spark_partition_id() % COPY_SALT).alias("__salt"))
    counted = sized.groupBy(key_col, "__key", "size", "text_crc32", "__salt").agg(F.count("*").alias("__n"))
    order = ["__key", key_col, "size", "text_crc32", "__salt"]
    placed = (counted.repartitionByRange(shuffle_partitions(spark), *order)
              .withColumn("__part", F.spark_partition_id())
              .withColumn("shard", shard_column(F.col("__key"), n_shards))
              .withColumn("grown_shard", shard_column(F.col("__key"), n_shards + 1)))
    placed = materialize(placed)

    cells = placed.groupBy("shard", "__part").agg(F.sum("__n").alias("__total"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("shard", "__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    # rows: shards x partitions, both parameters of the job and not of the data
    offsets = F.broadcast(offsets)
    inside = (Window.partitionBy("__part", "shard").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    first = F.col("__offset") + F.coalesce(F.sum("__n").over(inside), F.lit(0))
    return (placed.join(offsets, ["shard", "__part"])
            .withColumn("__first", first)
            .withColumn("slot", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)))
            .select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    F.col("slot").cast("long").alias("slot"), "grown_shard"))
