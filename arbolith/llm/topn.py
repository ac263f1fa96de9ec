"""The N best items of every group, by descending score bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.storage import materialize

#: Bands of about equal rows; each is a round.
BANDS = 4
#: A hot group holds at least one row in so many, so there are at most as many hot groups.
HOT = 1000


def _bands(rows: DataFrame, bands: int) -> list[tuple[int, int]]:
    """(first, last range partition) of each band, the top first; one row per partition is collected."""
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("__part").count().collect())
    total, seen, out, low = sum(n for _, n in sizes), 0, [], None
    for part, n in sizes:
        low = part if low is None else low
        seen += n
        if seen * bands >= total * (len(out) + 1):
            out.append((low, part))
            low = None
    return out


def top_n(
    df: DataFrame, group: Sequence[str], n: int, first: Column, score: Column, ties: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """group, ties, keep and ``rank`` (1 to n) of the ``n`` first rows of each group.

    Order: ``first`` (an int, such as a class; the smallest first, null as the
    last), then ``score`` of any ordered type ascending with null and NaN alike
    after all numbers, then ``ties`` ascending with nulls last. A null group
    value is a group value of its own; repeated rows each count; groups with
    fewer rows give all; an empty table gives none.

    Rows are range-partitioned by the whole order, so no score however
    frequent makes a large partition, and cut into BANDS bands of partitions.
    Bands are processed from the top. In each, rows of groups that are filled
    are anti-joined away (hot groups, at most HOT, by a broadcast before any
    shuffle), what is left is ranked exactly with the rank limit before the
    shuffle, and groups on the boundary take what they still need.
    """
    g = [f"__g{i}" for i in range(len(group))]
    kind = df.select(score.alias("s")).dtypes[0][1]
    rows = df.select(
        F.struct(*[F.col(c).alias(x) for c, x in zip(group, g)]).alias("__g"),  # equal structs may have null fields
        *[F.col(c) for c in dict.fromkeys([*ties, *keep])],
        F.coalesce(first.cast("int"), F.lit(2**31 - 1)).alias("__first"),
        (F.nullif(score, F.lit("NaN").cast(kind)) if kind in ("double", "float") else score).alias("__score"),
    )
    order = [F.col("__first").asc(), F.col("__score").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    rows = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "bands")
    bands = _bands(rows, BANDS)
    sizes = rows.groupBy("__g").agg(F.count("*").alias("__n"))
    hot = materialize(sizes.filter(F.col("__n") >= max(n + 1, -(-rows.count() // HOT))).select("__g"), "hot")  # at most HOT rows
    by = Window.partitionBy("__g").orderBy(*order)

    def ranked(left: DataFrame) -> DataFrame:
        return left.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)

    done: list[DataFrame] = []
    for low, high in bands:
        left = rows.filter(F.col("__part").between(low, high)).drop("__part")
        warm, cold = hot, left.join(F.broadcast(hot), "__g", "left_anti")
        if done:
            taken = _union(done).groupBy("__g").agg(F.count("*").cast("int").alias("__taken"))
            filled = taken.filter(F.col("__taken") == n).select("__g")
            warm, cold = hot.join(filled.hint("merge"), "__g", "left_anti"), cold.join(filled.hint("merge"), "__g", "left_anti")
        best = ranked(cold).unionByName(ranked(left.join(F.broadcast(warm), "__g", "left_semi")))
        if done:
            best = best.join(taken.hint("merge"), "__g", "left").withColumn("rank", F.col("rank") + F.coalesce("__taken", F.lit(0)))
            best = best.filter(F.col("rank") <= n).drop("__taken")
        done.append(materialize(best, "band"))
    out = _union(done) if done else ranked(rows.drop("__part"))
    return out.select(*[F.col(f"__g.{x}").alias(c) for c, x in zip(group, g)], *dict.fromkeys([*ties, *keep]), "rank")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
