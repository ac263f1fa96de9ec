"""Sampling, splitting, mixing and batching in an order that a seed and the keys fix.

Random draws follow md5 of seed and key: the same rows on any cluster and any
partitioning. Positions over the whole table come from range partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.operators.ordering import positions, ranks_within, shuffled
from arbolith.storage import materialize, small_side


def sample_exactly(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows: every row n // count times, and the first n % count of a shuffle once more; ``copy`` numbers them."""
    total = df.count()
    if not total:
        if n:
            raise ValueError("nothing to sample from")
        return df.withColumn("copy", F.lit(0))
    times, rest = divmod(n, total)
    rows = shuffled(df, seed, *keys)
    copies = F.lit(times) + F.when(F.col("position") < rest, 1).otherwise(0)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)) if times else F.lit(0))
    return (rows if times else rows.filter(F.col("position") < rest)).drop("position")


def split(df: DataFrame, ratio: float, seed: int, *keys: str, n: int | None = None) -> DataFrame:
    """``part`` 'val' or 'train' of each row: val has max(int(min(rows, n) * ratio), 1) rows of a shuffle.

    Ratio 0 has no val and 1 no train. With ``n``, train is cut to n less val's rows.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in 0..1")
    if ratio in (0, 1):
        return df.withColumn("part", F.lit("val" if ratio else "train"))
    total = df.count()
    size = min(total, n or total)
    val = max(int(size * ratio), 1)
    if total - val <= 0:
        raise ValueError("no row left to train on")
    rows = shuffled(df, seed, *keys)
    if n:
        rows = rows.filter(F.col("position") < val + max(n - val, 0))
    return rows.withColumn("part", F.when(F.col("position") < val, "val").otherwise("train")).drop("position")


def take_and_skip(df: DataFrame, order: Sequence[str], n: int, ratio: float) -> DataFrame:
    """``part`` of a stream in its order: the first int(n * ratio) rows are val, all after them train."""
    if not 0 < ratio < 1 or n <= 0:
        raise ValueError("a stream needs n and a ratio between 0 and 1")
    val = int(n * ratio)
    return positions(df, order).withColumn("part", F.when(F.col("position") < val, "val").otherwise("train")).drop("position")


def concat(frames: Sequence[DataFrame]) -> DataFrame | None:
    """All rows of all frames; missing columns are null. None for no frame, the frame itself for one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def interleave(frames: Sequence[tuple[DataFrame, Sequence[str]]], stop: str = "first") -> DataFrame:
    """Rows of the frames in turn, with ``source`` and ``slot``: row i of frame s has slot i * frames + s.

    ``stop`` 'first' ends after the round in which the shortest frame has its
    last row, 'all' goes on with those left.
    """
    parts = [positions(f, order, "__i").withColumn("source", F.lit(s)) for s, (f, order) in enumerate(frames)]
    shortest = min(f.count() for f, _ in frames)
    rows = concat(parts).withColumn("slot", F.col("__i") * len(frames) + F.col("source"))
    return (rows.filter(F.col("__i") < shortest) if stop == "first" else rows).drop("__i")


def stratified_quota(df: DataFrame, stratum: str, quotas: Mapping[str, tuple[int, int]], seed: int, *keys: str, least: int = 1) -> DataFrame:
    """``part`` 'test' or 'train' by (train, test) quotas per stratum, test drawn first; other rows are left out.

    A stratum with too few rows has its train quota scaled down in proportion
    and rounded down, but to ``least`` at least; its other rows are test.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    pairs = [x for s, (a, b) in quotas.items() for x in (F.lit(s), F.struct(F.lit(a).alias("train"), F.lit(b).alias("test")))]
    rows = df.withColumn("__q", F.create_map(*pairs)[F.col(stratum)]).filter("__q IS NOT NULL")
    rows = ranks_within(rows.withColumn("__key", key), stratum, ["__key", *keys], "__r", "__n").drop("__key")
    want = F.col("__q.train") + F.col("__q.test")
    scarce = F.col("__n") < want
    train = F.when(scarce, F.greatest(F.lit(least), F.floor(F.col("__q.train") * (F.col("__n") / want)))).otherwise(F.col("__q.train"))
    test = F.when(scarce, F.col("__n") - train).otherwise(F.col("__q.test"))
    part = F.when(F.col("__r") <= test, "test").when(F.col("__r") <= test + train, "train")
    return rows.withColumn("part", part).filter("part IS NOT NULL").drop("__q", "__n", "__r")


def proportional(df: DataFrame, stratum: str, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows in proportion to the strata, by largest remainders (ties by name); all rows if there are no more.

    The table of strata is small by nature: one row each; a stratum's share
    never exceeds its rows, as n is below their sum.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("__n"))
    every = Window.partitionBy(F.lit(1))
    exact = F.col("__n") * F.lit(float(n)) / F.sum("__n").over(every)
    quota = sizes.withColumn("__exact", exact).withColumn("__base", F.least(F.floor("__exact"), F.col("__n")))
    left = F.lit(n) - F.sum("__base").over(every)
    order = every.orderBy((F.col("__exact") - F.col("__base")).desc(), F.col(stratum))
    quota = quota.withColumn("__take", F.least(F.col("__n"), F.col("__base") + (F.row_number().over(order) <= left).cast("long")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    ranked = ranks_within(df.withColumn("__key", key), stratum, ["__key", *keys], "__r", "__size").drop("__key", "__size")
    same = F.col(stratum).eqNullSafe(F.col("__s"))
    quota = small_side(materialize(quota.select(F.col(stratum).alias("__s"), "__take"), "quota"))
    return ranked.join(quota, same).filter("__r <= __take").drop("__r", "__s", "__take")


def contiguous_shards(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``shard``: n runs whose ends lie evenly spaced over the rows."""
    total = df.count()
    return positions(df, order).withColumn("shard", F.floor(((F.col("position") + 1) * n - 1) / total)).drop("position")


def strided_shards(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``shard``: position modulo n."""
    return positions(df, order).withColumn("shard", F.col("position") % n).drop("position")


def even_chunks(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``chunk``: n runs of rows // n rows, the first rows % n of them with one more."""
    size, more = divmod(df.count(), n)
    at, head = F.col("position"), (size + 1) * more
    chunk = F.when(at < head, F.floor(at / (size + 1))).otherwise(more + F.floor((at - head) / max(size, 1)))
    return positions(df, order).withColumn("chunk", chunk.cast("long")).drop("position")


def piece(df: DataFrame, order: Sequence[str], pieces: int, index: int) -> DataFrame:
    """The ``index``-th run of rows // pieces rows; the rest at the end belongs to none."""
    size = df.count() // pieces
    at = F.col("position")
    return positions(df, order).filter((at >= index * size) & (at < (index + 1) * size)).drop("position")


def rank_batches(df: DataFrame, order: Sequence[str], world: int, size: int) -> DataFrame:
    """``rank`` and ``batch``: rows dealt in turn to ``world`` ranks, ``size`` each a batch; uneven rest dropped."""
    per = df.count() // world
    at = F.col("position")
    rows = positions(df, order).filter(at < per // size * size * world)
    return rows.withColumn("rank", at % world).withColumn("batch", F.floor(F.floor(at / world) / size)).drop("position")


def length_grouped(df: DataFrame, length: str, mega: int, seed: int, *keys: str) -> DataFrame:
    """``slot``: a shuffle in mega-batches of ``mega`` rows, each ordered by falling length."""
    rows = shuffled(df, seed, *keys).withColumn("__m", F.floor(F.col("position") / mega))
    w = Window.partitionBy("__m").orderBy(F.col(length).desc(), *keys)
    return rows.withColumn("slot", F.col("__m") * mega + F.row_number().over(w) - 1).drop("__m", "position")


def weighted_top(df: DataFrame, group: Sequence[str], weight: Column, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows per group drawn without replacement by weight: the largest ln(u) / weight, u from the md5 of the key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(2**48 + 1)
    w = Window.partitionBy(*group).orderBy(F.col("__draw").desc(), *keys)
    rows = df.withColumn("__draw", F.ln(u) / weight).filter(weight > 0)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__draw", "__r")


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Every row ``n`` times, numbered by ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


#: Rows of a shard that one task packs.
SHARD_ROWS = 100_000


def pack_sequences(df: DataFrame, item: str, length: str, capacity: int, batch: int, order: Sequence[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """item, shard, bin: first-fit decreasing over batches of ``batch`` rows, the last bin of a batch going on in the next.

    Shards are runs of the order of at most ``shard_rows`` rows, so a task is
    bounded at any size and the result is the same on any cluster. Items above ``capacity`` have a bin of their own.
    """
    shards = max(1, -(-df.count() // shard_rows))
    rows = contiguous_shards(df.select(item, F.col(length).cast("long").alias("__n"), *[c for c in order if c != item]), order, shards)
    kind = dict(df.dtypes)[item]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        size = pdf["__n"].to_numpy()
        out, done, carry = np.empty(len(pdf), dtype=np.int64), 0, np.empty(0, dtype=np.int64)
        for start in range(0, len(pdf), batch):
            rows_ = np.concatenate([carry, np.arange(start, min(start + batch, len(pdf)))])
            rooms: list[int] = []
            bins: list[list[int]] = []
            for i in rows_[np.argsort(-size[rows_], kind="stable")].tolist():
                b = next((b for b, r in enumerate(rooms) if r >= size[i]), None)
                if b is None:
                    bins.append([])
                    rooms.append(capacity)
                    b = len(bins) - 1
                bins[b].append(i)
                rooms[b] -= size[i]
            last = start + batch >= len(pdf)
            for members in bins if last else bins[:-1]:
                out[members] = done
                done += 1
            carry = np.empty(0, dtype=np.int64) if last else np.array(sorted(bins[-1]), dtype=np.int64)
        return pd.DataFrame({"item": pdf[item], "shard": pdf["shard"], "bin": out})

    packed = rows.groupBy("shard").applyInPandas(run, f"item {kind}, shard long, bin long")
    return packed.withColumnRenamed("item", item)


def bin_totals(packed: DataFrame, lengths: DataFrame, item: str, length: str) -> DataFrame:
    """shard, bin, items, total of :func:`pack_sequences`."""
    return packed.join(lengths.select(item, length), item).groupBy("shard", "bin").agg(F.count("*").alias("items"), F.sum(length).alias("total"))


def negatives(df: DataFrame, key: str, response: str, k: int, seed: int) -> DataFrame:
    """key, negatives: ``k`` other rows' responses for each row, from a shuffle of all: the next ones after the row's own.

    Null responses and those equal to the row's own are left out, so there may be fewer.
    One equi-join on positions; no row meets more than ``k`` others.
    """
    n = df.count()
    rows = shuffled(df.select(key, response), seed, key)
    k = min(k, max(n - 1, 0))
    draws = F.explode(F.sequence(F.lit(1), F.lit(k))) if k else F.explode(F.array().cast("array<int>"))
    wanted = rows.select(key, F.col(response).alias("__own"), "position", draws.alias("__j"))
    wanted = wanted.withColumn("__at", F.pmod(F.col("position") + F.col("__j"), F.lit(max(n, 1))))
    pool = rows.select(F.col("position").alias("__at"), F.col(response).alias("__other"))
    got = wanted.join(pool, "__at").filter(F.col("__other").isNotNull() & ~F.col("__other").eqNullSafe(F.col("__own")))
    lists = got.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__j", "__other"))).alias("__l"))
    return lists.select(key, F.transform("__l", lambda x: x["__other"]).alias("negatives"))
