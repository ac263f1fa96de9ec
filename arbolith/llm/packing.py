"""Items of varying length into containers of fixed capacity, balanced by attention cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.storage import materialize

#: Items of a shard; a shard is packed in one task, so this bounds its memory.
SHARD = 20_000
#: Copies of one item are numbered in tasks of so many.
COPIES = 100_000
#: Cost of a document of x units: LINEAR * x + QUADRATIC * x * x.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def cost(length: np.ndarray | float) -> np.ndarray | float:
    return LINEAR * length + QUADRATIC * length * length


#: Items of a container that may be swapped, and passes over the containers.
SWAPPED, PASSES = 6, 3
#: Shares of the items, the longest first, that balancing tries to place before best fit takes over.
BALANCED = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0, 1, ...), all at most ``capacity`` long.

    Best fit in descending order tells how few containers do. With that many,
    items go in descending length each to the container of lowest cost among
    those with room, which balances the costs; as even room leaves no fit for
    the last items, best fit places a share of the shortest. The largest share
    in BALANCED that needs no further container is taken. :func:`evened` then
    balances what best fit has placed.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    fit = _best_fit(sizes, capacity, [], 0)
    k = int(fit.max()) + 1 if len(fit) else 0
    out = np.empty(len(lengths), dtype=np.int64)
    for share in BALANCED:
        head = int(len(sizes) * share)
        got, room = _balanced(sizes[:head], capacity, k)
        if got is None:
            continue
        tail = _best_fit(sizes[head:], capacity, room.tolist(), k)
        if not len(tail) or tail.max() < k:
            out[order] = np.concatenate([got, tail])
            return evened(lengths, out)
    out[order] = fit
    return evened(lengths, out)


def evened(lengths: np.ndarray, where: np.ndarray) -> np.ndarray:
    """``where`` with costs nearer to each other, every container as long as before.

    Containers above the mean cost, the dearest first, swap an item or two for
    one or two of the same total length but a lower cost, with the container
    where that brings the costs closest. The SWAPPED longest items of a
    container take part. PASSES over the containers, or until none swaps.
    """
    if not len(where):
        return where
    n, size = int(where.max()) + 1, lengths.tolist()
    inside: list[list[int]] = [[] for _ in range(n)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        inside[where[i]].append(i)
    spent = [QUADRATIC * sum(size[i] ** 2 for i in x) for x in inside]
    mean = sum(spent) / n
    version = [0] * n
    by_total: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}

    def bundles(c: int) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        top = [i for i in inside[c][:SWAPPED] if size[i]]
        for k, a in enumerate(top):
            yield size[a], size[a] ** 2, (a,)
            for b in top[k + 1 :]:
                yield size[a] + size[b], size[a] ** 2 + size[b] ** 2, (a, b)

    def offer(c: int) -> None:
        for total, squares, items in bundles(c):
            by_total.setdefault(total, []).append((squares, c, version[c], items))

    def swap(dear: int) -> bool:
        best = None
        for total, squares, items in bundles(dear):
            for other, c, v, theirs in by_total[total]:
                if v == version[c] and c != dear and other < squares:
                    less = QUADRATIC * (squares - other)
                    gain = less * (spent[dear] - spent[c] - less)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = gain, less, items, c, theirs
        if best is None:
            return False
        _, less, items, c, theirs = best
        for at, out, new in ((dear, items, theirs), (c, theirs, items)):
            inside[at] = sorted([i for i in inside[at] if i not in out] + list(new), key=lambda i: (-size[i], i))
            version[at] += 1
            offer(at)
        spent[dear] -= less
        spent[c] += less
        return True

    for c in range(n):
        offer(c)
    for _ in range(PASSES):
        moved = 0
        for dear in sorted(range(n), key=lambda c: -spent[c]):
            while spent[dear] > mean and swap(dear):
                moved += 1
        if not moved:
            break
    out = where.copy()
    for c, items in enumerate(inside):
        out[items] = c
    return out


def _best_fit(sizes: np.ndarray, capacity: int, room: list[int], n: int) -> np.ndarray:
    """Each item into the fullest container with room; ``room`` is that of the ``n`` containers there are.

    Containers are kept by their room, so each step looks one up. Items of
    length 0 go to the first container.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b, r in enumerate(room):
        by_room[r].append(b)
    there = np.array([bool(x) for x in by_room])
    out = np.empty(len(sizes), dtype=np.int64)
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            out[i], n = 0, max(n, 1)
            continue
        at = int(there[s:].argmax()) + s
        if there[at]:
            b = by_room[at].pop()
            there[at] = bool(by_room[at])
        else:
            b, at, n = n, capacity, n + 1
        out[i] = b
        by_room[at - s].append(b)
        there[at - s] = True
    return out


def _balanced(sizes: np.ndarray, capacity: int, k: int) -> tuple[np.ndarray | None, np.ndarray]:
    """Lowest cost with room among ``k`` containers, and the room left; None if an item finds no room."""
    room, spent = np.full(k, capacity, dtype=np.int64), np.zeros(k)
    out = np.empty(len(sizes), dtype=np.int64)
    costs = cost(sizes.astype(float))
    for i, s in enumerate(sizes.tolist()):
        b = int(np.where(room >= s, spent, np.inf).argmin())
        if room[b] < s:
            return None, room
        room[b] -= s
        spent[b] += costs[i]
        out[i] = b
    return out, room


def containers(df: DataFrame, item: str, length: Column, capacity: int) -> DataFrame:
    """item, container (string), part, start, length: every item with its containers.

    An item longer than ``capacity`` is cut into full parts and a rest; all
    others have one part, never split. Full parts fill a container each and
    need no packing; rests and whole items are packed shard by shard, so one
    task packs at most about SHARD of them. A null length counts 0; an item of
    length 0 is placed like any other. No item is dropped. Equal items of equal
    length are numbered, so that a row's place depends on the rows alone and
    not on files or partitions.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    kind = dict(df.dtypes)[item]
    same = df.select(F.col(item).alias("item"), F.coalesce(length.cast("long"), F.lit(0)).alias("n")).groupBy("item", "n").agg(F.count("*").alias("k"))
    few = same.filter(F.col("k") <= COPIES).withColumn("chunk", F.lit(0).cast("long"))
    many = same.filter(F.col("k") > COPIES).select("item", "n", "k", F.explode(F.sequence(F.lit(0), F.expr(f"(k - 1) div {COPIES}"))).alias("chunk"))
    each = few.unionByName(many.repartition("item", "n", "chunk"))  # copies of one row come from several tasks
    within = F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("k") - F.col("chunk") * COPIES))
    items = each.select("item", "n", "chunk", F.explode(within).alias("c")).select("item", "n", (F.col("chunk") * COPIES + F.col("c")).alias("copy"))
    items = items.withColumn("full", F.expr(f"n div {capacity}")).withColumn("rest", F.col("n") % capacity)
    items = materialize(items, "items")
    name = F.concat_ws(".", F.lit("f"), F.coalesce(F.col("item").cast("string"), F.lit("")), "n", "copy", "part")
    full = items.filter("full > 0").select("item", "n", "copy", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("part"))
    full = full.select(
        "item",
        name.alias("container"),
        F.col("part").cast("int").alias("part"),
        (F.col("part") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
    )
    loose = items.filter("full = 0 OR rest > 0")
    shards = max(1, -(-loose.count() // SHARD))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "item", "n", "copy"], ascending=[False, True, True, True], kind="stable")
        where = pack(pdf["rest"].to_numpy(dtype=np.int64), capacity)
        shard = str(int(pdf["shard"].iloc[0]))
        return pd.DataFrame(
            {
                "item": pdf["item"].to_numpy(),
                "container": [f"s{shard}.{b}" for b in where],
                "part": pdf["full"].astype("int32").to_numpy(),
                "start": (pdf["full"] * capacity).to_numpy(),
                "length": pdf["rest"].to_numpy(),
            }
        )

    shard = F.pmod(F.xxhash64("item", "n", "copy"), F.lit(shards))
    # as many partitions as spread few shards over tasks of their own; a number of its own keeps AQE from joining small ones
    spread = loose.withColumn("shard", shard).repartition(shards if shards > 1000 else 4 * shards, "shard")
    packed = spread.groupBy("shard").applyInPandas(
        run, f"item {kind}, container string, part int, start long, length long"
    )
    return full.unionByName(packed).select(F.col("item").alias(item), "container", "part", "start", "length")
