"""Test tables and versioned rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``base`` (a file or a folder of files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys``: the one with the largest ``order`` values, nulls last.

    Rows with null keys form a group of their own. Rows equal in ``order`` are
    taken to be equal where it matters, and any of them stays. The rank filter
    becomes a WindowGroupLimit before the shuffle, so a key with very many
    versions sends only one row per map task.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    by = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in cols])
    rank = "__version_rank"
    return df.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank)
