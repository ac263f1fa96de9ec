"""Search trees: classification, roll-ups over descendants, trajectories, ranking and pruning.

Trees come with a ``path`` from :func:`arbolith.operators.hierarchy.hierarchy`;
roll-ups use its sums, which are aggregated before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolith.functions.scalars import truthy
from arbolith.operators.hierarchy import hierarchy
from arbolith.storage import materialize

#: Parts of a large group.
SALTS = 32


def node_class(max_depth: int) -> Column:
    """'submit_leaf', 'failed', 'expandable' or 'other' of a node."""
    submit = (F.col("action") == "submit") & truthy("boxed_letter").isNotNull()
    terminal = F.coalesce(F.col("is_terminal"), F.lit(False))
    return (
        F.when(submit, "submit_leaf")
        .when(terminal, "failed")
        .when(F.col("action").isin("root", "delegate") & (F.coalesce("depth", F.lit(0)) < max_depth), "expandable")
        .otherwise("other")
    )


def roll_up(df: DataFrame, scope: Sequence[str], node: str, parent: str, leaf: Column, open_: Column, correct: Column, empty: float | None = None) -> DataFrame:
    """scope, node, terminals, correct, has_open, accuracy over the nodes below (``empty``, which may be NaN, where there are none).

    ``leaf`` says which nodes count as terminals, ``open_`` which as open,
    ``correct`` which terminals are right; null counts as false. Sums travel
    up with the peeled leaves, a row per link. Nodes on or below loops give none.
    """
    marks = {
        "leaf": F.coalesce(leaf, F.lit(False)).cast("int"),
        "open": F.coalesce(open_, F.lit(False)).cast("int"),
        "right": F.coalesce(leaf & correct, F.lit(False)).cast("int"),
    }
    sums = hierarchy(df, scope, node, parent, False, marks, {f"own_{k}": v for k, v in marks.items()}).filter("hops >= 0")
    below = {k: F.col(k) - F.col(f"own_{k}") for k in marks}
    return sums.select(
        *scope,
        node,
        below["leaf"].alias("terminals"),
        below["right"].alias("correct"),
        (below["open"] > 0).alias("has_open"),
        F.coalesce(F.try_divide(below["right"], below["leaf"]), F.lit(empty).cast("double")).alias("accuracy"),
    )


def trajectories(tree: DataFrame, scope: Sequence[str], node: str, leaf: Column, **sums: str) -> DataFrame:
    """scope, node (the leaf), node_ids, depth, actions, last_confidence and the path's sums of every leaf.

    last_confidence is that of the last delegate on the path whose answer could
    be read. ``sums`` maps an output to a column; nulls count 0.
    """
    leaves = tree.filter(leaf & F.col("path").isNotNull()).select(*scope, F.col(node).alias("__leaf"), F.col("path"), F.posexplode("path").alias("at", "__id"))
    told = (F.col("action") == "delegate") & F.col("delegate_parse_ok") & F.col("delegate_confidence").isNotNull()
    step = tree.select(
        *scope,
        F.col(node).alias("__id"),
        "action",
        F.when(told, F.nanvl("delegate_confidence", F.lit(None).cast("double"))).alias("__conf"),
        *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(f"__{k}") for k, c in sums.items()],
    )
    on = leaves.join(step.hint("merge"), [*scope, "__id"])
    actions = F.sort_array(F.collect_list(F.struct("at", "action")))
    return on.groupBy(*scope, "__leaf").agg(
        F.first("path").alias("node_ids"),
        (F.count("*") - 1).cast("int").alias("depth"),
        F.transform(actions, lambda x: x["action"]).alias("actions"),
        F.max_by("__conf", F.when(F.col("__conf").isNotNull(), F.col("at"))).alias("last_confidence"),
        *[F.sum(f"__{k}").alias(k) for k in sums],
    ).withColumnRenamed("__leaf", node)


def ranked(df: DataFrame, group: Sequence[str], node: str, confidence: str, cost: str, tokens: str) -> DataFrame:
    """``score`` and ``place``: confidence less cost less tokens, each to 0..1 in the group (0 if constant); ties by node."""
    w = Window.partitionBy(*group)

    def scaled(c: str) -> Column:
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
        low, high = F.min(x).over(w), F.max(x).over(w)
        return F.when(high > low, (x - low) / (high - low)).otherwise(F.lit(0.0))

    scored = df.withColumn("score", F.round(scaled(confidence) - scaled(cost) - scaled(tokens), 9))
    return scored.withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc(), node)))


def without_noise(df: DataFrame) -> DataFrame:
    """Nodes but for failed ones and submits without a letter; the root action stays."""
    noise = (F.col("action") == "error") | ((F.col("action") == "submit") & truthy("boxed_letter").isNull())
    return df.filter(~F.coalesce(noise, F.lit(False)) | (F.col("action") == "root"))


def children(df: DataFrame, scope: Sequence[str], node: str, parent: str) -> DataFrame:
    """scope, node, children: the ids that are there, in order."""
    kids = df.groupBy(*scope, F.col(parent).alias(node)).agg(F.sort_array(F.collect_list(F.col(node))).alias("children"))
    none = F.array().cast("array<string>")
    return df.select(*scope, node).join(kids.hint("merge"), [*scope, node], "left").select(*scope, node, F.coalesce("children", none).alias("children"))


def top_children(df: DataFrame, group: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` children of every parent; the rank limit runs before the shuffle."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__r", r).filter(F.col("__r") <= k).drop("__r")


def spread_width(df: DataFrame, group: Sequence[str], value: str, least: int, cap: int) -> DataFrame:
    """group, n, k: how many children to keep, least + (cap - least) * sqrt(variance / 0.25) rounded half to even; all below 4."""
    v = F.coalesce(F.nanvl(F.col(value), F.lit(None).cast("double")), F.lit(0.0))
    per = df.groupBy(*group).agg(F.count("*").alias("n"), F.var_pop(v).alias("__var"))
    k = least + F.bround((cap - least) * F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.round("__var", 12)) / 0.25)))
    return per.withColumn("k", F.when(F.col("n") < 4, F.col("n")).otherwise(F.least(F.col("n"), k)).cast("int")).drop("__var")


def spread_children(
    df: DataFrame, group: Sequence[str], node: str, value: str, least: int, cap: int, correct: str | None = None, terminals: str | None = None, room: int = 100_000
) -> DataFrame:
    """The children kept of every parent: the best, the worst, then each time the one farthest from those kept.

    Children rank by ``value`` (null and NaN as 0), then ``correct``, then
    ``terminals``, all descending and 0 where there is no such column, then the
    smaller node. Of equally far ones the larger mean distance wins, then the
    larger value, terminals and node. Parents with more than ``room`` children
    are done in rounds of aggregates over all parents at once, one child each.
    """
    zero = F.lit(0.0)

    def number(c: str | None) -> Column:
        return F.coalesce(F.nanvl(F.col(c).cast("double"), zero), zero) if c else zero

    width = spread_width(df, group, value, least, cap).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col("n").alias("__n"), F.col("k").alias("__k"))
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    rows = df.select(*group, node, number(value).alias("__v"), number(correct).alias("__c"), number(terminals).alias("__t"))
    rows = rows.join(width.hint("merge"), same).drop(*[f"__g{i}" for i in range(len(group))])
    whole = rows.filter(F.col("__k") >= F.col("__n")).select(*group, node)
    rows = rows.filter(F.col("__k") < F.col("__n"))
    schema = rows.select(*group, node).schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["__k"].iloc[0])
        pdf = pdf.sort_values(["__v", "__c", "__t", node], ascending=[False, False, False, True], kind="stable")
        v, t = pdf["__v"].to_numpy(), pdf["__t"].to_numpy()
        kept = [0, len(v) - 1][:k]
        gaps = [np.abs(v - v[i]) for i in kept]
        last = pdf[node].rank(method="first").to_numpy()  # the order of the nodes
        while len(kept) < k:
            near, mean = np.minimum.reduce(gaps), np.round(np.mean(gaps, axis=0), 12)
            near = np.round(near, 12)
            near[kept] = -1
            kept.append(int(np.lexsort((last, t, v, mean, near))[-1]))
            gaps.append(np.abs(v - v[kept[-1]]))
        return pdf.iloc[sorted(kept)][[*group, node]]

    few = rows.filter(F.col("__n") <= room).groupBy(*group).applyInPandas(run, schema)
    out = whole.unionByName(few)
    many = rows.filter(F.col("__n") > room)
    if many.limit(1).count():
        out = out.unionByName(_spread_in_rounds(materialize(many, "spread"), group, node, cap))
    return out


def _spread_in_rounds(rows: DataFrame, group: Sequence[str], node: str, cap: int) -> DataFrame:
    """:func:`spread_children` of large groups: a maximum per group and round, aggregated before the shuffle.

    What is kept so far is an array of at most ``cap`` values per group; it is
    repeated for SALTS parts of each group, so no group is joined in one task.
    """
    part = F.pmod(F.xxhash64(node), F.lit(SALTS))
    rows = rows.withColumn("__g", F.struct(*group)).withColumn("__p", part)
    rank = [F.col("__v"), F.col("__c"), F.col("__t")]
    tops = rows.groupBy("__g").agg(F.max(F.struct(*rank)).alias("top"), F.min(F.struct(*rank)).alias("low"), F.first("__k").alias("__k"))
    ends = rows.join(tops.select(F.col("__g").alias("__h"), "top", "low").crossJoin(rows.sparkSession.range(SALTS).withColumnRenamed("id", "__q")).hint("merge"), (F.col("__g") == F.col("__h")) & (F.col("__p") == F.col("__q")))
    at = F.struct(*rank)
    picked = ends.groupBy("__g").agg(F.min(F.when(at == F.col("top"), F.col(node))).alias("best"), F.max(F.when(at == F.col("low"), F.col(node))).alias("worst"))
    state = tops.join(picked.hint("merge"), "__g").select(
        "__g", "__k", F.slice(F.array("best", "worst"), 1, F.least(F.col("__k"), F.lit(2))).alias("kept"), F.slice(F.array("top.__v", "low.__v"), 1, F.least(F.col("__k"), F.lit(2))).alias("values")
    )
    state = materialize(state, "spread")
    for _ in range(2, cap):
        salted = state.select(F.col("__g").alias("__h"), "__k", "kept", "values", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__q"))
        on = rows.drop("__k").join(salted.hint("merge"), (F.col("__g") == F.col("__h")) & (F.col("__p") == F.col("__q")))
        on = on.filter((F.size("kept") < F.col("__k")) & ~F.array_contains("kept", F.col(node)))
        gaps = F.transform("values", lambda x: F.abs(x - F.col("__v")))
        score = F.struct(F.round(F.array_min(gaps), 12).alias("near"), F.round(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size(gaps), 12).alias("mean"), "__v", "__t", node)
        next_ = on.groupBy("__g").agg(F.max(score).alias("s"))
        grown = F.col("s").isNotNull()
        state = materialize(
            state.join(next_.hint("merge"), "__g", "left").select(
                "__g", "__k",
                F.when(grown, F.concat("kept", F.array(F.col(f"s.{node}")))).otherwise(F.col("kept")).alias("kept"),
                F.when(grown, F.concat("values", F.array("s.__v"))).otherwise(F.col("values")).alias("values"),
            ),
            "spread",
        )
    return state.select(*[F.col(f"__g.{c}").alias(c) for c in group], F.explode("kept").alias(node))


def rebuilt(paths: DataFrame, scope: Sequence[str], node_ids: str) -> DataFrame:
    """scope, node_id, parent_id, depth: the tree that trajectories alone describe, each node at its least depth."""
    steps = paths.select(*scope, F.posexplode(node_ids).alias("depth", "node_id"), F.col(node_ids).alias("__p"))
    steps = steps.withColumn("parent_id", F.when(F.col("depth") > 0, F.try_element_at("__p", F.col("depth"))))
    best = F.min(F.struct("depth", "parent_id")).alias("__b")
    return steps.groupBy(*scope, "node_id").agg(best).select(*scope, "node_id", F.col("__b.parent_id").alias("parent_id"), F.col("__b.depth").alias("depth"))


def shape(tree: DataFrame, scope: Sequence[str]) -> DataFrame:
    """scope, nodes, max_depth, by_depth (depth -> nodes) of nodes that reach a root."""
    per = tree.filter("hops >= 0").groupBy(*scope, "hops").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("hops", "n")))
    return per.groupBy(*scope).agg(F.sum("n").alias("nodes"), F.max("hops").alias("max_depth"), pairs.alias("by_depth"))
