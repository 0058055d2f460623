"""Positions in huge groups without putting a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import ensure_checkpoint_dir


def group_positions(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "position") -> DataFrame:
    """Zero-based position of each row inside its group, by the order columns.

    Rows are range-partitioned on (group, order), so one hot group spreads over many tasks.
    A row's position is its index in the partition plus the sizes of the group's earlier
    partitions.  The sorted frame is checkpointed: the ranges are then fixed, and a lost
    executor cannot shift them.  Pass only key columns in ``df`` to keep the shuffle small.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*groups, *order]
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumns({"_pid": F.spark_partition_id(),
                            "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
              .checkpoint())
    parts = ranged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    # One row per (partition, group touching it): partitions + groups rows at most.
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}")) for g in ["_pid", *groups]]
    joined = ranged.alias("r").join(offsets.alias("o"), same)
    return joined.select("r.*", (F.col("o._before") + F.col("r._idx") - F.col("o._first")).alias(out)).drop("_pid", "_idx")


def nearest_ranks(df: DataFrame, group: str, value: str, picks: dict[str, Column]) -> DataFrame:
    """Exact values at given ranks per group.

    ``picks`` maps a name to a zero-based rank computed from ``n``.  The running count walks over
    distinct values, so its window holds as many rows as there are distinct values, not rows.
    """
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumns({"_upto": F.sum("_k").over(upto), "n": F.sum("_k").over(Window.partitionBy(group))})
    hit = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    return running.groupBy(group).agg(
        F.max("n").alias("n"), F.sum(F.col(value) * F.col("_k")).alias("_total"), F.max(value).alias("max_value"),
        *[hit(rank).alias(name) for name, rank in picks.items()])
