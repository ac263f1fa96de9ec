"""Preference pairs, rejection sampling and what trainers derive from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how far apart the recommended bounds of a class weight are.
SPAN = 1.33


def shift_in_batches(df: DataFrame, ordinal: str, text: str, size: int, group: Sequence[str] = ()) -> DataFrame:
    """``shifted``: the text of the row before in batches of ``size`` by 0-based ``ordinal``; the first takes the batch's last.

    With ``group`` the ordinal counts within each group, and no batch spans two.
    """
    batch = F.floor(F.col(ordinal) / size)
    w = Window.partitionBy(*group, batch).orderBy(ordinal)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.row_number().over(w) == 1
    return df.withColumn("shifted", F.when(first, F.last(text).over(whole)).otherwise(F.lag(text).over(w)))


def best_and_worst(df: DataFrame, prompt: Sequence[str], answer: str, score: str, order: str) -> DataFrame:
    """prompt, chosen, rejected and their scores.

    chosen is the highest-scored answer (the first of tied ones by ``order``),
    rejected the lowest-scored among different answers. Prompts of one row or
    one answer give none; null scores and answers are left out. Answers are
    aggregated first, so a prompt of very many rows costs a row per answer.
    """
    rows = df.filter(F.col(answer).isNotNull() & F.col(score).isNotNull())
    # the best and worst row of every answer of a prompt are enough for both
    per = rows.groupBy(*prompt, answer).agg(
        F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))).alias("high"),
        F.min(F.struct(F.col(score).alias("s"), F.col(order).alias("o"))).alias("low"),
    )
    best = per.groupBy(*prompt).agg(F.max(F.struct("high", F.col(answer).alias("a"))).alias("best"))
    up = Window.partitionBy(*prompt).orderBy("low")
    # of the two lowest answers one is not the best; the rank limit runs before the shuffle
    two = per.withColumn("__n", F.row_number().over(up)).filter("__n <= 2")
    low = two.groupBy(*prompt).agg(F.sort_array(F.collect_list(F.struct("low", F.col(answer).alias("a")))).alias("lows"))
    other = F.filter("lows", lambda x: x["a"] != F.col("best.a"))
    return best.join(low, list(prompt)).withColumn("worst", F.try_element_at(other, F.lit(1))).filter("worst IS NOT NULL").select(
        *prompt,
        F.col("best.a").alias("chosen"),
        F.col("worst.a").alias("rejected"),
        F.col("best.high.s").alias("chosen_score"),
        F.col("worst.low.s").alias("rejected_score"),
    )


def rejection_sample(df: DataFrame, prompt: Sequence[str], score: Column, order: str, keep: int, easy: float | None = None) -> DataFrame:
    """Rows with ``role`` 'positive' (the ``keep`` best of a prompt) or 'negative' (its worst, if not among them).

    Prompts whose mean score reaches ``easy`` are left out.
    """
    rows = df.withColumn("__score", score)
    w = Window.partitionBy(*prompt)
    down = w.orderBy(F.col("__score").desc_nulls_last(), F.col(order))
    rows = rows.withColumn("__n", F.row_number().over(down)).withColumn("__all", F.count(F.lit(1)).over(w))
    if easy is not None:
        rows = rows.withColumn("__mean", F.avg("__score").over(w)).filter(F.col("__mean") < easy).drop("__mean")
    role = F.when(F.col("__n") <= keep, "positive").when(F.col("__n") == F.col("__all"), "negative")
    return rows.withColumn("role", role).filter("role IS NOT NULL").drop("__score", "__n", "__all")


def class_balance(df: DataFrame, label: Column) -> DataFrame:
    """desirable, undesirable (each at least 1) and the recommended bounds of their weights, in one row."""
    counts = df.agg(
        F.greatest(F.count(F.when(label, 1)), F.lit(1)).alias("desirable"),
        F.greatest(F.count(F.when(~label, 1)), F.lit(1)).alias("undesirable"),
    )
    ratio = F.col("undesirable") / F.col("desirable")
    inverse = F.col("desirable") / F.col("undesirable")
    return counts.select(
        "desirable",
        "undesirable",
        F.bround(ratio, 2).alias("desirable_low"),
        F.bround(ratio * SPAN, 2).alias("desirable_high"),
        F.bround(inverse / SPAN, 2).alias("undesirable_low"),
        F.bround(inverse, 2).alias("undesirable_high"),
    )
