"""Parent-child rows to full hierarchies: root, depth, path, sums over the subtree and descendants of each node.

Every join here is a merge join by hint: both sides grow with the nodes, and a
broadcast chosen by the size of compressed files would grow with them. A
parent of very many children is split by AQE (skew join); sums are aggregated
before they are shuffled. Work is done while the result is built, and its
steps are tables in shared storage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.storage import materialize

#: Peeling ends after so many rounds, or when a round removes less than this share of what is left.
PEELS, WORTH = 4, 0.15


class Resolved(NamedTuple):
    """Levels of peeled leaves, the lowest first; roots; stems with loops and their roots; the pointers of each doubling round."""

    levels: list[DataFrame]
    roots: DataFrame
    stems: DataFrame
    rounds: list[DataFrame]
    columns: list[str]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _add(a: str, b: str) -> Column:
    """Overflow gives null; it can only happen on loops, whose sums are dropped."""
    return F.try_add(F.col(a), F.coalesce(F.col(b), F.lit(0).cast("double") if a.startswith("d_") else F.lit(0).cast("bigint")))


def _links(df: DataFrame, scope: Sequence[str], node: str, parent: str, own: Mapping[str, Column]) -> DataFrame:
    """id, pid (null for roots), the scope as c0.., name, pname, kids and ``own`` of every node."""
    c = [f"c{i}" for i in range(len(scope))]
    rows = df.select(*[F.col(s).alias(x) for s, x in zip(scope, c)], F.col(node).alias("name"), F.nullif(F.col(parent), F.lit("")).alias("up"), *[v.alias(k) for k, v in own.items()])
    nodes = rows.groupBy(*c, "name").agg(F.min("up").alias("up"), *[F.max(k).alias(k) for k in own])
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    above = nodes.select(*[F.col(x).alias(f"__{x}") for x in c], F.col("name").alias("pname"), F.col("id").alias("pid"))
    same = F.col("up") == F.col("pname")
    for x in c:
        same = same & F.col(x).eqNullSafe(F.col(f"__{x}"))
    has = F.col("up").isNotNull()  # the rest would meet in one partition as null keys
    linked = nodes.filter(has).join(above.hint("merge"), same, "left").select("id", "pid", *c, "name", "pname", *own)
    top = nodes.filter(~has).select("id", F.lit(None).cast("bigint").alias("pid"), *c, "name", F.lit(None).cast(dict(nodes.dtypes)["name"]).alias("pname"), *own)
    links = materialize(linked.unionByName(top), "links")
    kids = links.filter("pid IS NOT NULL").groupBy(F.col("pid").alias("__to")).agg(F.count("*").alias("kids"))
    return materialize(links.join(kids.hint("merge"), F.col("id") == F.col("__to"), "left").drop("__to").fillna(0, ["kids"]), "links")


def _peel(state: DataFrame, sums: Sequence[str]) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(levels of leaves, roots without anything left below, what is left: roots above stems, stems, loops).

    A round takes the nodes without remaining children and sends their number
    and sums to their parents, aggregated before the shuffle.
    """
    levels, roots = [], []
    left = state.filter("pid IS NOT NULL").count()
    while left and len(levels) < PEELS:
        leaves = state.filter("pid IS NOT NULL AND kids = 0")
        sent = leaves.groupBy(F.col("pid").alias("__to")).agg(F.count("*").alias("__gone"), *[F.sum(s).alias(f"__{s}") for s in sums])
        stay = state.filter("kids > 0").join(sent.hint("merge"), F.col("id") == F.col("__to"), "left")
        levels.append(leaves)
        roots.append(state.filter("pid IS NULL AND kids = 0"))
        stay = stay.withColumn("kids", F.col("kids") - F.coalesce("__gone", F.lit(0))).withColumns({s: _add(s, f"__{s}") for s in sums})
        state = materialize(stay.select(*state.columns), "peel")
        now = state.filter("pid IS NOT NULL").count()
        worth, left = left - now >= WORTH * left, now
        if not worth:
            break
    roots.append(state.filter("pid IS NULL AND kids = 0"))
    return levels, roots, state.filter("pid IS NOT NULL OR kids > 0")


def _stems(rest: DataFrame, c: Sequence[str], sums: Sequence[str], keep: Sequence[str], paths: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(root_id, hops, path and sums of the nodes left by peeling and their roots, the pointers before each round).

    After k rounds a pointer spans 2^k links, so stems of n links take log2(n)
    rounds. Sums follow the same pointers: what a node has gathered from less
    than 2^k links below goes to the node 2^k above it. A round in which no
    node meets a root leaves nodes on or below loops only: root_id '', hops -1.
    """
    top = F.col("pid").isNull()
    now = rest.select(
        "id",
        F.coalesce("pid", "id").alias("ptr"),
        *c,
        "name",
        "pname",
        F.when(top, F.col("name")).alias("root_id"),
        F.when(top, 0).otherwise(1).alias("hops"),
        (F.array("name") if paths else F.lit(None).cast("array<string>")).alias("path"),
        top.alias("done"),
        *sums,
        *keep,
    )
    now, rounds = materialize(now, "stems"), []
    left = now.filter("NOT done").count()
    while left:
        rounds.append(now.filter("NOT done").select("id", "ptr", *c, "pname"))
        full = now
        if sums:
            sent = now.filter("NOT done").groupBy(F.col("ptr").alias("__to")).agg(*[F.try_sum(s).alias(f"__{s}") for s in sums])
            full = now.join(sent.hint("merge"), F.col("id") == F.col("__to"), "left").withColumns({s: _add(s, f"__{s}") for s in sums}).select(*now.columns)
        far = now.select(*[F.col(x).alias(f"__{x}") for x in ("id", "ptr", "pname", "root_id", "hops", "path", "done")])
        moved = full.filter("NOT done").join(far.hint("merge"), F.col("ptr") == F.col("__id"))
        moved = moved.select(
            "id",
            F.col("__ptr").alias("ptr"),
            *c,
            "name",
            F.col("__pname").alias("pname"),
            F.col("__root_id").alias("root_id"),
            (F.col("hops") + F.col("__hops")).alias("hops"),
            (F.concat("__path", "path") if paths else F.col("path")).alias("path"),
            F.col("__done").alias("done"),
            *sums,
            *keep,
        )
        now = materialize(full.filter("done").unionByName(moved), "stems")
        before, left = left, now.filter("NOT done").count()
        if left == before:
            break
    done = F.col("done")
    now = now.select(
        "id", *c, "name", F.when(done, F.col("root_id")).otherwise("").alias("root_id"), F.when(done, F.col("hops")).otherwise(-1).alias("hops"),
        F.when(done, F.col("path")).alias("path"), *[F.when(done, F.col(s)).alias(s) for s in sums], *keep,
    )
    return now, rounds


def _resolve(df: DataFrame, scope: Sequence[str], node: str, parent: str, paths: bool, sums: Mapping[str, Column], keep: Mapping[str, Column]) -> Resolved:
    clash = {"id", "pid", "name", "pname", "up", "kids", "ptr", "root_id", "hops", "path", "done"} & {*sums, *keep}
    if clash:
        raise ValueError(f"names in use: {sorted(clash)}")
    c = [f"c{i}" for i in range(len(scope))]
    kinds = {k: ("d_" if t in ("double", "float") else "n_") + k for k, t in df.select(*[v.alias(k) for k, v in sums.items()]).dtypes}
    own = {kinds[k]: F.coalesce(v.cast("double" if kinds[k][0] == "d" else "bigint"), F.lit(0)) for k, v in sums.items()}
    s = list(own)
    levels, roots, rest = _peel(_links(df, scope, node, parent, own | {f"k_{k}": v for k, v in keep.items()}), s)
    k = [f"k_{x}" for x in keep]
    cols = ["id", *c, "name", "root_id", "hops", "path", *s, *k]
    none = F.lit(None).cast("array<string>")
    top = [r.select("id", *c, "name", F.col("name").alias("root_id"), F.lit(0).alias("hops"), (F.array("name") if paths else none).alias("path"), *s, *k) for r in roots]
    stems, rounds = _stems(rest, c, s, k, paths)
    found, down = [*top, stems], []
    for level in reversed(levels):
        above = _union([x.select(F.col("id").alias("__p"), "root_id", F.col("hops").alias("__h"), F.col("path").alias("__path")) for x in found])
        lost = F.col("__h") < 0
        below = level.join(above.hint("merge"), F.col("pid") == F.col("__p")).select(
            "id", "pid", *c, "name", "pname", "root_id", F.when(lost, -1).otherwise(F.col("__h") + 1).alias("hops"),
            (F.concat("__path", F.array("name")) if paths else F.col("__path")).alias("path"), *[F.when(~lost, F.col(x)).alias(x) for x in s], *k,
        )
        down.append(materialize(below, "down"))
        found.append(down[-1].select(*cols))
    return Resolved(down[::-1], _union(top), stems, rounds, cols)


def hierarchy(
    df: DataFrame, scope: Sequence[str], node: str, parent: str, paths: bool = True, sums: Mapping[str, Column] | None = None, keep: Mapping[str, Column] | None = None
) -> DataFrame:
    """scope, node, root_id, hops, with ``paths`` path (the names from the root to the node), ``sums`` and ``keep``.

    A link holds only to a node of the same ``scope``. Nodes with a null, empty
    or unknown parent are roots (themselves, 0). Nodes on or below a loop have
    root_id '', hops -1 and a null path. Repeated rows of a node count once,
    with their smallest parent and largest values; rows with a null node are
    nodes that nobody links to; null scopes are one scope; an empty table gives
    none. Other columns are not kept.

    ``sums`` maps an output to a number whose sum over the node and all below
    it is wanted (null counts 0, null on and below loops); ``keep`` maps an
    output to a value of the node itself.

    Leaves are peeled from the bottom round by round and send their sums to
    their parents; stems too deep for that are resolved by doubling their
    pointers; the reverse peel order then takes root, depth and path down.
    """
    got = _resolve(df, scope, node, parent, paths, sums or {}, keep or {})
    every = _union([got.roots, got.stems, *[x.select(*got.columns) for x in got.levels]])
    values = [x for x in got.columns if x[:2] in ("d_", "n_", "k_")]
    return every.select(
        *[F.col(f"c{i}").alias(s) for i, s in enumerate(scope)],
        F.col("name").alias(node),
        "root_id",
        F.col("hops").cast("int").alias("hops"),
        *(["path"] if paths else []),
        *[F.col(x).alias(x[2:]) for x in values],
    )


def descendants(df: DataFrame, scope: Sequence[str], node: str, parent: str) -> DataFrame:
    """scope, node, descendant_id, distance: one row per node and node below it.

    Leaves are peeled from the bottom, and each sends its list of descendants
    and itself to its parent; the lists are rows, as a hub's would not fit one
    row. On stems too deep to be peeled lists travel along the doubled
    pointers, so a row is made once there too. Nodes on or below loops give
    none; for the rest see :func:`hierarchy`.
    """
    got = _resolve(df, scope, node, parent, False, {}, {})
    c = [f"c{i}" for i in range(len(scope))]
    cols = ["at", *c, "holder", "descendant_id", "distance"]

    def sent(by: DataFrame, held: list[DataFrame], to: str, span: int) -> DataFrame:
        """Rows held by the nodes of ``by``, sent ``span`` links up to ``to``."""
        lists = _union([h.select(F.col("at").alias("__at"), "descendant_id", "distance") for h in held])
        own = by.select("id", F.col(to).alias("at"), *c, F.col("pname").alias("holder"))
        return own.join(lists.hint("merge"), F.col("id") == F.col("__at")).withColumn("distance", F.col("distance") + span).select(*cols)

    rows: list[DataFrame] = []
    for level in got.levels:
        level = level.filter("hops >= 0")
        new = level.select(F.col("pid").alias("at"), *c, F.col("pname").alias("holder"), F.col("name").alias("descendant_id"), F.lit(1).alias("distance"))
        if rows:
            new = new.unionByName(sent(level, rows, "pid", 1))
        rows.append(materialize(new, "lists"))
    if got.rounds:
        reached = got.stems.filter("hops >= 0")
        selves = reached.select(F.col("id").alias("at"), *c, F.col("name").alias("holder"), F.col("name").alias("descendant_id"), F.lit(0).alias("distance"))
        span, own = 1, reached.select(F.col("id").alias("__r"))
        for pointers in got.rounds:
            live = pointers.join(own.hint("merge"), F.col("id") == F.col("__r"), "left_semi")
            rows.append(materialize(sent(live, [selves, *rows], "ptr", span), "lists"))
            span *= 2
    if not rows:
        kind = dict(df.dtypes)
        text = ", ".join([*[f"`{s}` {kind[s]}" for s in scope], f"`{node}` {kind[node]}", f"descendant_id {kind[node]}", "distance int"])
        return df.sparkSession.createDataFrame([], text)
    names = [F.col(x).alias(s) for x, s in zip(c, scope)]
    return _union(rows).select(*names, F.col("holder").alias(node), "descendant_id", F.col("distance").cast("int").alias("distance"))
