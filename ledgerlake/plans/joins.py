"""Ranking helper that keeps the plan distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.session import checkpoint_root


def rank_by(df: DataFrame, order_col: str, rank_col: str = "rank", start: int = 1, narrow: bool = False) -> DataFrame:
    """Dense 1..n ranks by a unique, non-null ordering column, without a single-partition window.

    Only the ordering column is range-partitioned, sorted and written as a
    reliable checkpoint (shared ``spark.checkpoint.dir``), which fixes each
    key's partition and position. Per-partition counts (one row per partition:
    a proven size bound) give each partition's offset; a key's rank is offset +
    position in partition. The rows themselves join their key's rank once and
    are never sorted or checkpointed. ``narrow`` frames (an aggregate with a few
    columns, dearer to run again than to write) are written whole and need no
    join. Survives executor loss: recomputation reads the checkpoint, not a
    re-sort.
    """
    checkpoint_root(df.sparkSession)
    key = F.col(order_col).alias("_key")
    fixed = (df.withColumn("_key", key) if narrow else df.select(key)).orderBy("_key").checkpoint(eager=True)
    tagged = fixed.withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    pos = F.col("_mono") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    ranked = (tagged.join(F.broadcast(offsets), "_pid")
              .withColumn(rank_col, (F.col("_off") + pos + F.lit(start)).cast("bigint")).drop("_pid", "_mono", "_off"))
    return ranked.drop("_key") if narrow else df.join(ranked, F.col(order_col) == F.col("_key")).drop("_key")
