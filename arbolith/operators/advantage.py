"""Group-relative advantages, as windows over the prompt group.

Groups are bounded by how often one prompt is sampled. A null or NaN reward
counts as no reward: it takes no part in the statistics and has a null
advantage. Statistics over all rows come from one partial aggregate that is
joined back as a single row, not from a window without partitions, which would
send all rows to one task. Columns named advantage or starting with __ are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.operators.ordering import ranks_within
from arbolith.storage import materialize

EPS = 1e-4
WHITE = 1e-8


def number(c: str | Column) -> Column:
    """A double, NaN and what is no number as null."""
    x = F.expr(f"try_cast(`{c}` AS DOUBLE)") if isinstance(c, str) else c.cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def composite(df: DataFrame, weights: Mapping[str, float], out: str = "reward") -> DataFrame:
    """``out`` = weighted sum of the reward columns, what is no number counting 0."""
    total = sum((F.coalesce(number(c), F.lit(0.0)) * float(w) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, total)


def nan_sum(df: DataFrame, weights: Mapping[str, float], out: str = "reward") -> DataFrame:
    """``out`` as :func:`composite`, but null where every reward is missing; ``all_missing`` says so."""
    missing = F.forall(F.array(*[number(c) for c in weights]), lambda x: x.isNull())
    df = composite(df, weights, out).withColumn("all_missing", missing)
    return df.withColumn(out, F.when(~missing, F.col(out)))


def group_mean(df: DataFrame, group: Sequence[str], reward: str) -> DataFrame:
    """``advantage`` = reward minus its group's mean; 0 in groups of one row."""
    w = Window.partitionBy(*group)
    r = number(reward)
    return df.withColumn("advantage", F.when(F.count(F.lit(1)).over(w) < 2, F.lit(0.0)).otherwise(r - F.avg(r).over(w)))


def length_normalised(df: DataFrame, group: Sequence[str], reward: str, length: str) -> DataFrame:
    """:func:`group_mean` of the reward by unit of length, lengths below 1 counting 1."""
    df = df.withColumn("__per", number(reward) / F.greatest(F.col(length), F.lit(1)))
    return group_mean(df, group, "__per").drop("__per")


def rank(df: DataFrame, group: Sequence[str], reward: str) -> DataFrame:
    """``advantage`` = dense rank from 0 over the distinct rewards, by rows less one, less 0.5; 0 if all are tied."""
    r = number(reward)
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    place = F.dense_rank().over(w.orderBy(r)) - 1
    tied = (F.min(r).over(w) == F.max(r).over(w)) | (n < 2)
    return df.withColumn("advantage", F.when(tied, F.lit(0.0)).otherwise(place / (n - 1) - 0.5))


def _overall(df: DataFrame, *stats: Column) -> DataFrame:
    """``df`` with statistics of all rows as columns: a one-row table, cross joined by broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def grpo(df: DataFrame, group: Sequence[str], reward: str, scale: str = "group", center: str = "mean") -> DataFrame:
    """``advantage`` = (reward - group mean) / (sample deviation + 1e-4).

    ``scale`` 'group' or 'batch' says of which rows the deviation is, 'none'
    leaves it out. A deviation of fewer than two rewards is 0. ``center``
    'loo' takes the mean of the group's other rewards instead (its own group's
    mean where there is no other).
    """
    w = Window.partitionBy(*group)
    r = number(reward)
    n, mean = F.count(r).over(w), F.avg(r).over(w)
    lift = r - mean
    if center == "loo":
        lift = F.when(n > 1, lift * n / (n - 1)).otherwise(lift)
    if scale == "none":
        return df.withColumn("advantage", lift)
    if scale == "group":
        return df.withColumn("advantage", lift / (F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0)) + EPS))
    both = _overall(df, F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("__std"))
    return both.withColumn("advantage", lift / (F.col("__std") + EPS)).drop("__std")


def reinforce_plus(df: DataFrame, group: Sequence[str], reward: str, scale: str = "batch") -> DataFrame:
    """Rewards less the group mean, by the deviation of these differences (over the batch or the group)."""
    lifted = grpo(df, group, reward, scale="none").withColumnRenamed("advantage", "__lift")
    a = F.col("__lift")
    if scale == "group":
        std = F.coalesce(F.stddev_samp(a).over(Window.partitionBy(*group)), F.lit(0.0))
        return lifted.withColumn("advantage", a / (std + EPS)).drop("__lift")
    both = _overall(lifted, F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("__std"))
    return both.withColumn("advantage", a / (F.col("__std") + EPS)).drop("__lift", "__std")


def gdpo(df: DataFrame, group: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """Each reward normalised in its group, missing ones 0, weighted and summed; then whitened over all rows."""
    w = Window.partitionBy(*group)
    total = F.lit(0.0)
    for c, weight in weights.items():
        r = number(c)
        z = (r - F.avg(r).over(w)) / (F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0)) + EPS)
        total = total + F.coalesce(z, F.lit(0.0)) * float(weight)
    summed = df.withColumn("__sum", total)
    x = F.col("__sum")
    both = _overall(summed, F.avg(x).alias("__mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("__std"))
    return both.withColumn("advantage", (x - F.col("__mean")) / (F.col("__std") + WHITE)).drop("__sum", "__mean", "__std")


def whiten(df: DataFrame, column: str) -> DataFrame:
    """``advantage`` = ``column`` by its deviation over all rows, unchanged if that is next to 0."""
    a = number(column)
    both = _overall(df, F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("__std"))
    return both.withColumn("advantage", F.when(F.col("__std") > WHITE, a / (F.col("__std") + WHITE)).otherwise(a)).drop("__std")


def by_request(df: DataFrame, request: str, prompt: str, reward: str, order: str, tolerance: float = 1e-6) -> DataFrame:
    """:func:`group_mean` over prompts with the last row of each request, given to all rows of the request.

    ``inconsistent`` marks requests whose rewards differ by more than ``tolerance``.
    """
    w = Window.partitionBy(request)
    r = number(reward)
    seen = df.withColumn("inconsistent", F.coalesce(F.max(r).over(w) - F.min(r).over(w) > tolerance, F.lit(False)))
    last = seen.withColumn("__r", F.row_number().over(w.orderBy(F.col(order).desc()))).filter("__r = 1").drop("__r")
    advantage = group_mean(last, [prompt], reward).select(F.col(request).alias("__request"), "advantage")
    return seen.join(advantage, F.col(request).eqNullSafe(F.col("__request")), "left").drop("__request")


def min_max(df: DataFrame, group: Sequence[str], column: str, eps: float = 1e-5) -> DataFrame:
    """``normalised``: to 0..1 in the group; a constant group gives min(1, value), or 0 if that is not positive."""
    w = Window.partitionBy(*group)
    x = number(column)
    low, high = F.min(x).over(w), F.max(x).over(w)
    flat = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    return df.withColumn("normalised", F.when(high - low < eps, flat).otherwise((x - low) / (high - low)))


def varied_groups(df: DataFrame, group: Sequence[str], reward: str) -> DataFrame:
    """The rows of groups whose rewards vary."""
    std = F.stddev_samp(number(reward)).over(Window.partitionBy(*group))
    return df.withColumn("__std", std).filter("__std > 0").drop("__std")


def statistics(df: DataFrame, column: str) -> DataFrame:
    """n, non_zero, mean, std (population), min and max of a column in one row."""
    x = number(column)
    return df.agg(
        F.count(x).alias("n"),
        F.count(F.when(x != 0, 1)).alias("non_zero"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )


def group_sizes(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """rows, prompts, multi and single: of groups, in one row."""
    per = df.groupBy(*group).count()
    return per.agg(
        F.sum("count").alias("n_rows"),
        F.count("*").alias("prompts"),
        F.count(F.when(F.col("count") > 1, 1)).alias("multi"),
        F.count(F.when(F.col("count") == 1, 1)).alias("single"),
    )


def flat_share(df: DataFrame, group: Sequence[str], reward: str) -> DataFrame:
    """flat_share: the share of groups whose rewards don't vary."""
    r = number(reward)
    per = df.groupBy(*group).agg(F.coalesce(F.max(r) - F.min(r), F.lit(0.0)).alias("__range"))
    return per.agg(F.avg((F.col("__range") == 0).cast("double")).alias("flat_share"))


def smooth(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, weight: float) -> DataFrame:
    """group, order and ``smoothed``: debiased exponential smoothing of the group's values up to each row.

    Values weigh weight^age, and their weighted sum is divided by the weights'
    sum. A series is cut into blocks so long that what lies two blocks back
    weighs less than 1e-100; each block is summed up by itself and takes over
    the sum of the block before, so a long series is no single task.
    ``weight`` is from 0 to 1; a null or NaN value counts 0.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must be from 0 to 1")
    rows = df.select(F.struct(*group).alias("__g"), *order, F.coalesce(number(value), F.lit(0.0)).alias("__v"))
    if weight == 0:
        return rows.select(*[F.col(f"__g.{c}").alias(c) for c in group], *order, F.col("__v").alias("smoothed"))
    size = 100_000 if weight == 1 else math.ceil(-100 / math.log10(weight))
    rows = ranks_within(rows, "__g", order, "__n", "__size")
    rows = rows.withColumn("__b", F.expr(f"(__n - 1) div {size}")).withColumn("__k", ((F.col("__n") - 1) % size).cast("double"))
    rows = materialize(rows.withColumn("__x", F.col("__v") * F.pow(F.lit(1 / weight), F.col("__k"))), "series")
    sums = rows.groupBy("__g", "__b").agg(F.sum("__x").alias("__s"))
    back = Window.partitionBy("__g").orderBy("__b")
    before = F.sum("__s").over(back.rowsBetween(Window.unboundedPreceding, -1)) if weight == 1 else F.lag("__s").over(back)
    sums = sums.select("__g", "__b", F.coalesce(before, F.lit(0.0)).alias("__before"))
    within = Window.partitionBy("__g", "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    on = rows.join(sums.hint("merge"), ["__g", "__b"]).withColumn("__sum", F.sum("__x").over(within))
    old = F.pow(F.lit(weight), F.lit(float(size)))  # a block's sum is in units of its first row
    total = F.pow(F.lit(weight), F.col("__k")) * (F.col("__sum") + F.col("__before") * old)
    weights = F.col("__n").cast("double") if weight == 1 else (1 - F.pow(F.lit(weight), F.col("__n").cast("double"))) / (1 - weight)
    return on.select(*[F.col(f"__g.{c}").alias(c) for c in group], *order, (total / weights).alias("smoothed"))

