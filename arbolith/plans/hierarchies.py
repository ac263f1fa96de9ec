"""Problem 4: links of the search nodes to full trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.operators.hierarchy import descendants, hierarchy
from arbolith.plans.registry import Plans
from arbolith.tables import latest, table

plans = Plans()

SCOPE = ["task_id"]


def _nodes(spark, base):
    rows = table(spark, base, "search_nodes").select("task_id", "node_id", "parent_id", "written_at", "loaded_at")
    return latest(rows, ["task_id", "node_id"], ["written_at", "loaded_at"])


CURRENT = """WITH RECURSIVE v AS (
    SELECT task_id, node_id, parent_id,
           row_number() OVER (PARTITION BY task_id, node_id ORDER BY written_at DESC, loaded_at DESC) AS rn
    FROM search_nodes),
n AS (SELECT task_id, node_id, nullif(parent_id, '') AS parent_id FROM v WHERE rn = 1),
l AS (SELECT n.task_id, n.node_id, p.node_id AS parent_id
      FROM n LEFT JOIN n p ON p.task_id = n.task_id AND p.node_id = n.parent_id),
t AS (SELECT task_id, node_id, node_id AS root_id, 0 AS hops, [node_id] AS path FROM l WHERE parent_id IS NULL
      UNION ALL
      SELECT l.task_id, l.node_id, t.root_id, t.hops + 1, list_append(t.path, l.node_id)
      FROM l JOIN t ON l.task_id = t.task_id AND l.parent_id = t.node_id),
a AS (SELECT l.task_id, l.node_id, coalesce(t.root_id, '') AS root_id, CAST(coalesce(t.hops, -1) AS INTEGER) AS hops, t.path
      FROM l LEFT JOIN t ON t.task_id = l.task_id AND t.node_id = l.node_id)
"""


@plans.add(CURRENT + "SELECT task_id, node_id, root_id, hops FROM a")
def p4_found(spark, base):
    """Every current node with its root and distance."""
    return hierarchy(_nodes(spark, base), SCOPE, "node_id", "parent_id", paths=False)


@plans.add(
    CURRENT
    + """, s AS (SELECT task_id, x AS node_id, count(*) AS subtree_size
             FROM (SELECT task_id, unnest(path) AS x FROM a) GROUP BY 1, 2)
    SELECT a.task_id, a.node_id, root_id, hops, path, subtree_size FROM a LEFT JOIN s ON s.task_id = a.task_id AND s.node_id = a.node_id"""
)
def p4_paths(spark, base):
    """Each node's path, depth, root and subtree size."""
    return hierarchy(_nodes(spark, base), SCOPE, "node_id", "parent_id", sums={"subtree_size": F.lit(1)})


@plans.add(
    CURRENT
    + """SELECT task_id, path[i] AS node_id, node_id AS descendant_id, CAST(hops - i + 1 AS INTEGER) AS distance
    FROM (SELECT task_id, node_id, hops, path, unnest(range(1, len(path))) AS i FROM a WHERE path IS NOT NULL)"""
)
def p4_descendants(spark, base):
    """Each node with every node below it."""
    return descendants(_nodes(spark, base), SCOPE, "node_id", "parent_id")
