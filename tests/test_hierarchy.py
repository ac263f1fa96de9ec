from collections import Counter

from pyspark.sql import functions as F

from arbolith.operators.hierarchy import descendants, hierarchy

SCOPE = ["task_id"]


def brute(rows):
    parent = {}
    for t, n, p in rows:
        if (t, n) not in parent or (p or "~") < (parent[t, n] or "~"):
            parent[t, n] = p or None
    out = {}
    for key in parent:
        path, at, seen = [key[1]], key, {key}
        while True:
            up = parent[at]
            if not up or (key[0], up) not in parent:
                break
            at = (key[0], up)
            if at in seen:
                path = None
                break
            seen.add(at)
            path.insert(0, at[1])
        out[key] = ("", -1, None) if path is None else (path[0], len(path) - 1, path)
    return out


def check(spark, nodes_frame, rows):
    want = brute(rows)
    df = nodes_frame(rows)
    tree = hierarchy(df, SCOPE, "node_id", "parent_id", sums={"size": F.lit(1), "half": F.lit(0.5)}, keep={"own": F.col("hops")}).cache()
    got = {(r.task_id, r.node_id): (r.root_id, r.hops, r.path) for r in tree.collect()}
    assert got == want
    short = hierarchy(df, SCOPE, "node_id", "parent_id", paths=False)
    assert {(r.task_id, r.node_id): (r.root_id, r.hops) for r in short.collect()} == {k: v[:2] for k, v in want.items()}
    rows_below = descendants(df, SCOPE, "node_id", "parent_id").collect()
    below = {(r.task_id, r.node_id, r.descendant_id, r.distance) for r in rows_below}
    assert len(below) == len(rows_below)
    assert below == {(t, a, n, len(p) - 1 - i) for (t, n), (_, _, p) in want.items() if p for i, a in enumerate(p[:-1])}
    sizes = Counter((t, a) for (t, n), (_, _, p) in want.items() if p for a in p)
    assert {(r.task_id, r.node_id): r.size for r in tree.collect()} == {k: sizes.get(k) for k in want}
    assert {(r.task_id, r.node_id): r.half for r in tree.collect()} == {k: sizes[k] / 2 if k in sizes else None for k in want}
    assert {r.own for r in tree.collect()} == {7}
    tree.unpersist()


def test_small_forest(spark, nodes_frame):
    rows = [("t", "r", None), ("t", "a", "r"), ("t", "b", "a"), ("t", "e", ""), ("t", "lost", "nowhere"), ("u", "a", "r")]
    rows += [("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x"), ("t", "me", "me"), ("t", "below", "z")]
    check(spark, nodes_frame, rows)


def test_deep_stem_with_branches_and_a_loop_tail(spark, nodes_frame):
    rows = [("t", "s000", None)] + [("t", f"s{i:03d}", f"s{i - 1:03d}") for i in range(1, 70)]
    rows += [("t", f"leaf{i}", f"s{i:03d}") for i in range(0, 70, 7)]
    rows += [("t", f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("t", f"d{i}", f"d{i - 1}" if i else "c0") for i in range(12)]
    check(spark, nodes_frame, rows)


def test_hub_of_one_parent(spark, nodes_frame):
    check(spark, nodes_frame, [("t", "hub", None)] + [("t", f"k{i}", "hub") for i in range(500)])


def test_repeated_rows_count_once_with_the_smallest_parent(spark, nodes_frame):
    check(spark, nodes_frame, [("t", "a", None), ("t", "b", None), ("t", "c", "b"), ("t", "c", "a"), ("t", "c", "b")])


def test_null_scope_is_one_scope_and_null_node_a_root(spark, nodes_frame):
    df = nodes_frame([(None, "a", None), (None, "b", "a"), ("t", None, "a")])
    got = {(r.task_id, r.node_id): (r.root_id, r.hops) for r in hierarchy(df, SCOPE, "node_id", "parent_id").collect()}
    assert got == {(None, "a"): ("a", 0), (None, "b"): ("a", 1), ("t", None): (None, 0)}


def test_empty(spark, nodes_frame):
    assert hierarchy(nodes_frame([]), SCOPE, "node_id", "parent_id").count() == 0
