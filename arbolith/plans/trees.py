"""Search-tree queries over the current nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.operators import trees as T
from arbolith.operators.hierarchy import hierarchy
from arbolith.plans.evaluations import NODES, nodes, results
from arbolith.plans.hierarchies import CURRENT
from arbolith.plans.registry import Plans
from arbolith.storage import materialize

plans = Plans()
ID = ["task_id", "node_id"]
FIELDS = ("parent_id", "action", "boxed_letter", "is_terminal", "is_correct", "depth", "cost", "input_tokens", "output_tokens", "delegate_parse_ok", "delegate_confidence", "written_at", "loaded_at")
FULL = CURRENT + """, m AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY task_id, node_id ORDER BY written_at DESC, loaded_at DESC) AS rn FROM search_nodes) WHERE rn = 1),
f AS (SELECT m.task_id, m.node_id, a.root_id, a.hops, a.path, m.action, m.boxed_letter, m.is_terminal, m.is_correct, m.depth, m.delegate_parse_ok, m.delegate_confidence,
      CASE WHEN isnan(m.cost) THEN 0 ELSE coalesce(m.cost, 0) END AS cost, coalesce(m.input_tokens, 0) + coalesce(m.output_tokens, 0) AS tokens,
      m.action = 'submit' AND coalesce(m.boxed_letter, '') <> '' AS leaf
      FROM m JOIN a ON a.task_id = m.task_id AND a.node_id = m.node_id)
"""


def is_leaf():
    """Submits with a letter."""
    return (F.col("action") == "submit") & (F.coalesce("boxed_letter", F.lit("")) != "")


def tree(spark, base):
    """Current nodes with root, hops and path; written once, as plans read it more than once."""
    n = materialize(nodes(spark, base, *FIELDS), "current")
    return materialize(n.join(hierarchy(n, ["task_id"], "node_id", "parent_id").hint("merge"), ID), "tree")


@plans.add(NODES + """SELECT task_id, node_id, CASE WHEN action = 'submit' AND coalesce(boxed_letter, '') <> '' THEN 'submit_leaf' WHEN coalesce(is_terminal, false) THEN 'failed'
    WHEN action IN ('root', 'delegate') AND coalesce(depth, 0) < 8 THEN 'expandable' ELSE 'other' END AS class FROM n""")
def g1_node_class(spark, base):
    return nodes(spark, base, "action", "boxed_letter", "is_terminal", "depth").select(*ID, T.node_class(8).alias("class"))


@plans.add(FULL + "SELECT task_id, node_id, hops, path FROM f WHERE leaf AND path IS NOT NULL")
def g2_j5_leaf_paths(spark, base):
    return tree(spark, base).filter(is_leaf() & F.col("path").isNotNull()).select(*ID, "hops", "path")


TRAJ = FULL + """, s AS (SELECT task_id, node_id, hops, path, unnest(path) AS x, unnest(range(len(path))) AS i FROM f WHERE leaf AND path IS NOT NULL),
tr AS (SELECT s.task_id, s.node_id, any_value(s.path) AS node_ids, any_value(s.hops) AS depth, list(p.action ORDER BY i) AS actions,
      arg_max(p.delegate_confidence, i) FILTER (p.action = 'delegate' AND p.delegate_parse_ok AND p.delegate_confidence IS NOT NULL) AS last_confidence,
      sum(p.cost) AS cost, sum(p.tokens) AS tokens FROM s JOIN f p ON p.task_id = s.task_id AND p.node_id = s.x GROUP BY 1, 2)
"""


def trajectories(spark, base):
    df = tree(spark, base).withColumn("tokens", F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    return T.trajectories(df, ["task_id"], "node_id", is_leaf(), cost="cost", tokens="tokens")


@plans.add(TRAJ + "SELECT task_id, node_id, node_ids, depth, actions, last_confidence, round(cost, 6) AS cost, CAST(tokens AS BIGINT) AS tokens FROM tr")
def g3_w16_w19_trajectories(spark, base):
    return trajectories(spark, base).withColumn("cost", F.round("cost", 6)).withColumn("tokens", F.col("tokens").cast("bigint"))


@plans.add(FULL + """, b AS (SELECT task_id, unnest(path[:-2]) AS node_id, CAST(leaf AS INTEGER) AS leaf, action IN ('root', 'delegate') AND NOT coalesce(is_terminal, false) AS o,
        CAST(leaf AND coalesce(is_correct, false) AS INTEGER) AS r FROM f WHERE path IS NOT NULL),
    s AS (SELECT task_id, node_id, sum(leaf) AS t, sum(r) AS r, bool_or(o) AS o FROM b GROUP BY 1, 2)
    SELECT f.task_id, f.node_id, CAST(coalesce(t, 0) AS BIGINT) AS terminals, CAST(coalesce(r, 0) AS BIGINT) AS correct, coalesce(o, false) AS has_open,
    round(r / nullif(t, 0), 6) AS accuracy FROM f LEFT JOIN s USING (task_id, node_id) WHERE path IS NOT NULL""")
def a8_g4_roll_up(spark, base):
    opened = F.col("action").isin("root", "delegate") & ~F.coalesce(F.col("is_terminal"), F.lit(False))
    n = materialize(nodes(spark, base, *FIELDS), "current")
    out = T.roll_up(n, ["task_id"], "node_id", "parent_id", is_leaf(), opened, F.coalesce(F.col("is_correct"), F.lit(False)))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@plans.add(FULL + "SELECT task_id, node_id FROM f WHERE hops >= 0 AND root_id IN (SELECT r.node_id FROM f r WHERE r.task_id = f.task_id AND r.action = 'root')")
def g5_reachable(spark, base):
    """Nodes that a node with the root action reaches as its tree's root."""
    t = tree(spark, base)
    roots = t.filter("action = 'root'").select("task_id", F.col("node_id").alias("root_id"))
    return t.filter("hops >= 0").join(roots.hint("merge"), ["task_id", "root_id"], "left_semi").select(*ID)


@plans.add(NODES + """SELECT task_id, node_id FROM n WHERE action = 'root' OR NOT coalesce(action = 'error' OR (action = 'submit' AND coalesce(boxed_letter, '') = ''), false)""")
def row_p25_without_noise(spark, base):
    return T.without_noise(nodes(spark, base, "action", "boxed_letter")).select(*ID)


@plans.add(NODES + """SELECT p.task_id, p.node_id, coalesce(list(c.node_id ORDER BY c.node_id) FILTER (c.node_id IS NOT NULL), []) AS children
    FROM n p LEFT JOIN n c ON c.task_id = p.task_id AND c.parent_id = p.node_id GROUP BY 1, 2""")
def row_p25_children(spark, base):
    return T.children(nodes(spark, base, "parent_id"), ["task_id"], "node_id", "parent_id")


@plans.add(NODES + """SELECT task_id, parent_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id, parent_id ORDER BY coalesce(is_correct, false) DESC, coalesce(is_terminal, false) DESC, node_id) AS r
    FROM n WHERE parent_id <> '') WHERE r <= 4""")
def w17_g6_top_children(spark, base):
    n = nodes(spark, base, "parent_id", "is_correct", "is_terminal").filter("parent_id <> ''")
    order = [F.coalesce(F.col("is_correct"), F.lit(False)).desc(), F.coalesce(F.col("is_terminal"), F.lit(False)).desc(), F.col("node_id")]
    return T.top_children(n, ["task_id", "parent_id"], 4, *order).select("task_id", "parent_id", "node_id")


SPREAD = """SELECT task_id, parent_id, count(*) AS n, var_pop(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS v FROM n WHERE parent_id <> '' GROUP BY 1, 2"""


def _scored(spark, base):
    n = nodes(spark, base, "parent_id", "is_correct", "is_terminal").filter("parent_id <> ''")
    return n.withColumn("acc", F.coalesce(F.col("is_correct"), F.lit(False)).cast("double"))


@plans.add(NODES + f"SELECT task_id, parent_id, n, CAST(CASE WHEN n < 4 THEN n ELSE least(n, 4 + round_even(4 * least(1.0, sqrt(greatest(0, round(v, 12)) / 0.25)), 0)) END AS INTEGER) AS k FROM ({SPREAD})")
def w18_spread_width(spark, base):
    return T.spread_width(_scored(spark, base), ["task_id", "parent_id"], "acc", 4, 8)


@plans.add()
def w18_g6_spread(spark, base):
    """Greedy, so held against brute force in the tests."""
    return T.spread_children(_scored(spark, base).withColumn("ends", F.col("is_terminal").cast("int")), ["task_id", "parent_id"], "node_id", "acc", 4, 8, "acc", "ends")


@plans.add(NODES + """, x AS (SELECT task_id, node_id, CASE WHEN isnan(delegate_confidence) THEN 0 ELSE coalesce(delegate_confidence, 0) END AS a, coalesce(price, 0) AS b, CAST(coalesce(input_tokens, 0) AS DOUBLE) AS c FROM n WHERE action = 'delegate'),
    s AS (SELECT task_id, node_id, round(coalesce((a - min(a) OVER g) / nullif(max(a) OVER g - min(a) OVER g, 0), 0) - coalesce((b - min(b) OVER g) / nullif(max(b) OVER g - min(b) OVER g, 0), 0)
        - coalesce((c - min(c) OVER g) / nullif(max(c) OVER g - min(c) OVER g, 0), 0), 9) AS score FROM x WINDOW g AS (PARTITION BY task_id))
    SELECT task_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, node_id) AS place FROM s""")
def w15_ranked(spark, base):
    n = nodes(spark, base, "action", "delegate_confidence", "cost", "input_tokens").filter("action = 'delegate'")
    out = T.ranked(n, ["task_id"], "node_id", "delegate_confidence", "cost", "input_tokens")
    return out.select(*ID, F.round("score", 6).alias("score"), "place")


@plans.add(TRAJ + """, k AS (SELECT task_id, unnest(node_ids) AS node_id, unnest(range(len(node_ids))) AS depth, node_ids FROM tr)
    SELECT task_id, node_id, arg_min(CASE WHEN depth > 0 THEN node_ids[depth] END, depth) AS parent_id, CAST(min(depth) AS INTEGER) AS depth FROM k GROUP BY 1, 2""".replace("arg_min(CASE WHEN depth > 0 THEN node_ids[depth] END, depth)", "min(CASE WHEN depth > 0 THEN node_ids[depth] END)"))
def g7_rebuilt(spark, base):
    return T.rebuilt(trajectories(spark, base), ["task_id"], "node_ids")


@plans.add(NODES + "SELECT run_id FROM r WHERE correct_leaf_count > 0")
def g8_without_all_wrong(spark, base):
    return results(spark, base).filter("correct_leaf_count > 0").select("run_id")


@plans.add(NODES + "SELECT run_id FROM r WHERE final_leaf_count <= 12 AND correct_leaf_count / nullif(final_leaf_count, 0) > 0.2 AND correct_leaf_count / nullif(final_leaf_count, 0) < 0.8")
def g9_accuracy_band(spark, base):
    acc = F.try_divide("correct_leaf_count", "final_leaf_count")
    return results(spark, base).filter((F.col("final_leaf_count") <= 12) & (acc > 0.2) & (acc < 0.8)).select("run_id")


@plans.add(FULL + """, k AS (SELECT task_id, hops, count(*) AS n FROM f WHERE hops >= 0 GROUP BY 1, 2)
    SELECT task_id, CAST(sum(n) AS BIGINT) AS nodes, max(hops) AS max_depth, list({'hops': hops, 'n': n} ORDER BY hops) AS by_depth FROM k GROUP BY 1""")
def a13_shape(spark, base):
    return T.shape(tree(spark, base), ["task_id"])


@plans.add(NODES + """SELECT task_id, depth, count(*) AS created, count(*) FILTER (action = 'submit') AS final, count(*) FILTER (status <> 'completed') AS failed, round(sum(coalesce(price, 0)), 6) AS budget FROM n GROUP BY 1, 2""")
def a14_rounds(spark, base):
    n = nodes(spark, base, "depth", "action", "status", "cost")
    return n.groupBy("task_id", "depth").agg(
        F.count("*").alias("created"),
        F.count(F.when(F.col("action") == "submit", 1)).alias("final"),
        F.count(F.when(F.col("status") != "completed", 1)).alias("failed"),
        F.round(F.sum(F.coalesce("price", F.lit(0.0))), 6).alias("budget"),
    )


@plans.add(NODES + """SELECT task_id, round_index, n, CAST(sum(n) OVER (PARTITION BY task_id ORDER BY round_index) AS BIGINT) AS upto
    FROM (SELECT task_id, round_index, count(*) AS n FROM n WHERE action = 'submit' GROUP BY 1, 2)""")
def a15_cumulative_leaves(spark, base):
    from pyspark.sql import Window

    per = nodes(spark, base, "action", "round_index").filter("action = 'submit'").groupBy("task_id", "round_index").agg(F.count("*").alias("n"))
    w = Window.partitionBy("task_id").orderBy("round_index").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("upto", F.sum("n").over(w))


@plans.add(TRAJ + """SELECT task_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY coalesce(last_confidence, -1) DESC, round(cost, 9), depth DESC, node_id) AS r FROM tr) WHERE r <= 2""")
def o2_best_trajectories(spark, base):
    order = [F.coalesce("last_confidence", F.lit(-1.0)).desc(), F.round("cost", 9), F.col("depth").desc(), F.col("node_id")]
    return T.top_children(trajectories(spark, base), ["task_id"], 2, *order).select(*ID)


@plans.add(TRAJ + """SELECT DISTINCT task_id, unnest(node_ids) AS node_id FROM (SELECT t.*, row_number() OVER (PARTITION BY t.task_id ORDER BY round(t.cost, 9), t.node_id) AS r
    FROM tr t JOIN f ON f.task_id = t.task_id AND f.node_id = t.node_id AND f.is_correct) WHERE r <= 3""")
def o4_g15_correct_paths(spark, base):
    """Nodes on the three cheapest correct paths of each task, each once."""
    t = trajectories(spark, base)
    right = nodes(spark, base, "is_correct").filter("is_correct").select(*ID)
    best = T.top_children(t.join(right, ID, "left_semi"), ["task_id"], 3, F.round("cost", 9), F.col("node_id"))
    return best.select("task_id", F.explode("node_ids").alias("node_id")).distinct()


@plans.add(FULL + "SELECT task_id, max(CAST(nullif(regexp_extract(node_id, '_(\\d+)$', 1), '') AS BIGINT)) AS last_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM f GROUP BY 1")
def x16_resume_state(spark, base):
    from arbolith.functions.scalars import suffix_number

    n = nodes(spark, base, "input_tokens", "output_tokens")
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    last = F.max(F.when(F.col("node_id").rlike(r"_\d+$"), suffix_number("node_id")))
    return n.groupBy("task_id").agg(last.alias("last_id"), F.sum(tokens).alias("tokens"))
