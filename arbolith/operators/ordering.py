"""Positions and running totals over a whole table in an order, without one task seeing it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.storage import materialize, small_side


def running_total(df: DataFrame, order: Sequence[str | Column], amount: str, out: str) -> DataFrame:
    """``out``: the sum of ``amount`` up to and with each row, in the order of ``order`` (unique, or ties are in any order).

    Rows are cut into range partitions of the order; a table with one row per
    partition holds their sums, and each partition sums up within itself.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    whole = Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__part").agg(F.sum(amount).alias("__sum"))  # as many rows as partitions
    start = sums.select("__part", F.coalesce(F.sum("__sum").over(whole), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(F.broadcast(start), "__part").withColumn(out, F.col("__start") + F.sum(amount).over(within)).drop("__part", "__start")


def positions(df: DataFrame, order: Sequence[str | Column], out: str = "position") -> DataFrame:
    """``out``: the 0-based position of each row in the order of ``order``."""
    got = running_total(df.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", out)
    return got.withColumn(out, F.col(out) - 1).drop("__one")


def shuffled(df: DataFrame, seed: int, *keys: str, out: str = "position") -> DataFrame:
    """:func:`positions` in the order of md5('seed:key:..'), so that any engine can replay it."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return positions(df.withColumn("__key", key), ["__key", *keys], out).drop("__key")


def ranks_within(df: DataFrame, group: str, order: Sequence[str], out: str = "rank", size: str = "size") -> DataFrame:
    """``out``: the 1-based rank of each row in its ``group`` in the order of ``order``, ``size``: the group's rows.

    The table is ordered by group and order at once, so a group that holds most
    rows is spread over many range partitions; a group's first position is
    taken off, by one row per group. Null groups are one group.
    """
    at = materialize(positions(df, [group, *order], "__at"), "ranks")
    ends = at.groupBy(F.col(group).alias("__own_group")).agg(F.min("__at").alias("__from"), F.count("*").alias(size))
    ends = small_side(materialize(ends, "groups"))
    got = at.join(ends, F.col(group).eqNullSafe(F.col("__own_group")))
    return got.withColumn(out, F.col("__at") - F.col("__from") + 1).drop("__at", "__from", "__own_group")
