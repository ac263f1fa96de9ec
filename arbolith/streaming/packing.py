"""Streams: versions of rows, and packing with an open container or interval as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from arbolith.storage import scratch
from arbolith.tables import latest


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint of the sink holds what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def packed_stream(rows: DataFrame, shard: str, item: str, length: str, capacity: int) -> DataFrame:
    """shard, bin, item, total: a stream of items in containers, one open container a shard.

    Items of a batch are taken in descending length. An item that doesn't fit
    closes the open container; its items come out when it closes. What is open
    at the end stays in the state, as the next batch may fill it. Items above
    the capacity have a container of their own.
    """
    kinds = dict(rows.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bin_, items, total = state.get if state.exists else (0, [], 0)
        items, out = list(items), []
        batch = pd.concat(list(frames)).sort_values([length, item], ascending=[False, True], kind="stable")
        for name, n in zip(batch[item].tolist(), batch[length].tolist()):
            if items and total + n > capacity:
                out += [(key[0], bin_, x, total) for x in items]
                bin_, items, total = bin_ + 1, [], 0
            items.append(name)
            total += n
        state.update((bin_, items, total))
        yield pd.DataFrame(out, columns=["shard", "bin", "item", "total"])

    return rows.groupBy(shard).applyInPandasWithState(
        step,
        f"shard {kinds[shard]}, bin long, item {kinds[item]}, total long",
        f"bin long, items array<{kinds[item]}>, total long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


#: Fixed value: the length of a row that ends its shard.
END = -1


def best_fit(items: Sequence[tuple], capacity: int) -> list[list[tuple]]:
    """(name, length) pairs in bins, longest first, each into the fullest bin with room; above ``capacity`` alone."""
    bins: list[list[tuple]] = []
    totals: list[int] = []
    for x in sorted(items, key=lambda x: -x[1]):
        b = max((b for b, t in enumerate(totals) if t + x[1] <= capacity), key=totals.__getitem__, default=None)
        if b is None:
            b = len(bins)
            bins.append([])
            totals.append(0)
        bins[b].append(x)
        totals[b] += x[1]
    return bins


def packed_intervals(rows: DataFrame, shard: str, item: str, length: str, capacity: int, interval: int = 128) -> DataFrame:
    """shard, bin, item, total: a stream of items in containers, packed by best fit over every ``interval`` items of a shard.

    The last bin of an interval goes on in the next. A row of length END says
    that its shard is finished, and everything of it still open comes out; see
    :func:`run_to_end`. Items of a batch are taken in their order. Items above
    the capacity have a container of their own.
    """
    kinds = dict(rows.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bin_, items, sizes, fresh = state.get if state.exists else (0, [], [], 0)
        held, full, ended = list(zip(items, sizes)), [], False
        batch = pd.concat(list(frames)).sort_values(item, kind="stable")
        for x in zip(batch[item].tolist(), batch[length].tolist()):
            if x[1] == END:
                ended = True
                continue
            held.append(x)
            fresh += 1
            if fresh == interval:
                *done, held = best_fit(held, capacity)
                full += done
                fresh = 0
        if ended:
            full += best_fit(held, capacity)
            held, fresh = [], 0
        out = [(key[0], bin_ + b, name, sum(n for _, n in xs)) for b, xs in enumerate(full) for name, _ in xs]
        state.update((bin_ + len(full), [name for name, _ in held], [n for _, n in held], fresh))
        yield pd.DataFrame(out, columns=["shard", "bin", "item", "total"])

    return rows.groupBy(shard).applyInPandasWithState(
        step,
        f"shard {kinds[shard]}, bin long, item {kinds[item]}, total long",
        f"bin long, items array<{kinds[item]}>, sizes array<long>, fresh long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def run_to_end(stream: DataFrame, path: str, shard: str, item: str, length: str, name: str = "stream") -> DataFrame:
    """What ``stream`` yields from the folder ``path`` once its shards are finished.

    After all that is there, a row of length END for each shard is appended to
    the folder, and the stream goes on from its checkpoint: no order of files is relied on.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)
    _run(stream, out, "append")
    there = spark.read.parquet(path)
    kinds = dict(there.dtypes)
    last = {item: F.lit("0").cast(kinds[item]), length: F.lit(END).cast(kinds[length])}
    ends = there.select(shard).distinct().withColumns(last).select(*there.columns)
    ends.coalesce(1).write.mode("append").parquet(path)
    _run(stream, out, "append")
    return spark.read.schema(stream.schema).parquet(out)


def _run(stream: DataFrame, out: str, mode: str) -> None:
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/_offsets").option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()


def run_once(stream: DataFrame, name: str = "stream", mode: str = "append", out: str | None = None) -> DataFrame:
    """What a stream yields from all that is there now, through a Parquet sink with its checkpoint in the same folder.

    With the same ``out`` a later call goes on where the last one ended and
    yields all there is; without, the folder is a scratch one.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    _run(stream, out, mode)
    return spark.read.schema(stream.schema).parquet(out)


def snapshots(stream: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "snapshots", out: str | None = None) -> DataFrame:
    """The current version of each key after all that is there now: each batch is appended, and read as the latest."""
    return latest(run_once(stream, name, out=out), keys, order)
