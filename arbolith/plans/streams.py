"""Streams over the tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.plans.registry import Plans
from arbolith.storage import scratch
from arbolith.streaming import packing as P
from arbolith.tables import table

plans = Plans()


@plans.add()
def m17_packed_stream(spark, base):
    """Every document in a container of 8192 as they arrive; sequential, so tests hold its invariants."""
    path = scratch(spark, "m17")
    d = table(spark, base, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    shards = max(8, -(-d.count() // 100_000))  # a shard's containers are packed in one task
    d = d.select("doc_id", "n", F.pmod("doc_id", F.lit(shards)).cast("long").alias("shard"))
    d.repartition(4, "doc_id").write.parquet(path)
    rows = P.read_stream(spark, path, "doc_id long, n long, shard long")
    return P.run_to_end(P.packed_intervals(rows, "shard", "doc_id", "n", 8192), path, "shard", "doc_id", "n", "m17out")


@plans.add("SELECT task_id, node_id, status FROM (SELECT *, row_number() OVER (PARTITION BY task_id, node_id ORDER BY written_at DESC, loaded_at DESC) AS r FROM search_nodes) WHERE r = 1")
def stream_snapshots(spark, base):
    """Logs that are appended to, read as the latest version of each node."""
    path = scratch(spark, "snap")
    cols = ["task_id", "node_id", "status", "written_at", "loaded_at"]
    table(spark, base, "search_nodes").select(*cols).repartition(3, "loaded_at").write.parquet(path)
    rows = P.read_stream(spark, path, "task_id string, node_id string, status string, written_at timestamp, loaded_at timestamp")
    return P.snapshots(rows, ["task_id", "node_id"], ["written_at", "loaded_at"]).select("task_id", "node_id", "status")


@plans.add("SELECT row_id, CASE WHEN answer IS NULL THEN 'no' ELSE upper(answer) END AS answer FROM training_rows")
def stream_map(spark, base):
    """A stateless projection over a stream."""
    path = scratch(spark, "map")
    table(spark, base, "training_rows").select("row_id", "answer").repartition(3, "row_id").write.parquet(path)
    rows = P.read_stream(spark, path, "row_id long, answer string")
    return P.run_once(rows.select("row_id", F.coalesce(F.upper("answer"), F.lit("no")).alias("answer")), "mapout")
