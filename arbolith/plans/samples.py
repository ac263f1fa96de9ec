"""Sampling, splitting, mixing, ordering and batching over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.functions import scalars as S
from arbolith.operators import ordering as O
from arbolith.operators import sampling as M
from arbolith.plans.registry import Plans
from arbolith.tables import table

plans = Plans()
T = "WITH t AS (SELECT id, subject, source, split, question, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS p, row_number() OVER (ORDER BY id) - 1 AS o, count(*) OVER () AS n FROM tasks) "


def tasks(spark, base):
    return table(spark, base, "tasks").select("id", "subject", "source", "split")


@plans.add(T + "SELECT id, copy FROM (SELECT id, p, unnest(range(1 + CASE WHEN p < 1000 % n THEN 1 ELSE 0 END)) AS copy FROM t)")
def m1_sample_exactly(spark, base):
    return M.sample_exactly(tasks(spark, base), 1000, 42, "id").select("id", F.col("copy").cast("bigint").alias("copy"))


@plans.add(T + "SELECT id, CASE WHEN p < 60 THEN 'val' ELSE 'train' END AS part FROM t")
def m2_split(spark, base):
    return M.split(tasks(spark, base), 0.1, 42, "id").select("id", "part")


@plans.add(T + "SELECT id, CASE WHEN o < 50 THEN 'val' ELSE 'train' END AS part FROM t")
def m3_stream_split(spark, base):
    return M.take_and_skip(tasks(spark, base), ["id"], 500, 0.1).select("id", "part")


@plans.add("SELECT id, subject, NULL AS c_name FROM tasks UNION ALL SELECT NULL, NULL, c_name FROM customer")
def m4_o5_concat(spark, base):
    return M.concat([tasks(spark, base).select("id", "subject"), table(spark, base, "customer").select("c_name")])


@plans.add("""WITH a AS (SELECT s_name AS name, (row_number() OVER (ORDER BY s_suppkey) - 1) * 2 AS slot FROM supplier),
    b AS (SELECT c_name AS name, (row_number() OVER (ORDER BY c_custkey) - 1) * 2 + 1 AS slot FROM customer)
    SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE slot < 2 * (SELECT least((SELECT count(*) FROM supplier), (SELECT count(*) FROM customer)))""")
def m5_interleave(spark, base):
    a = table(spark, base, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = table(spark, base, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return M.interleave([(a, ["k"]), (b, ["k"])]).select("name", "slot")


@plans.add(T + "SELECT id, p AS position FROM t")
def m6_shuffle(spark, base):
    return O.shuffled(tasks(spark, base), 42, "id").select("id", "position")


QUOTAS = {"Physics": (10, 15), "Life": (40, 60), "Material": (5, 5)}


QUOTA = """WITH q(subject, a, b) AS (VALUES ('Physics', 10, 15), ('Life', 40, 60), ('Material', 5, 5)),
    t AS (SELECT id, subject, a, b, row_number() OVER (PARTITION BY subject ORDER BY md5('42:' || id), id) AS r, count(*) OVER (PARTITION BY subject) AS n FROM tasks JOIN q USING (subject)),
    s AS (SELECT *, CASE WHEN n < a + b THEN greatest({}, floor(a * (n / (a + b)))) ELSE a END AS train FROM t),
    e AS (SELECT *, CASE WHEN n < a + b THEN n - train ELSE b END AS test FROM s)
    SELECT id, CASE WHEN r <= test THEN 'test' ELSE 'train' END AS part FROM e WHERE r <= test + train"""


@plans.add(QUOTA.format(1))
def m7_stratified_quota(spark, base):
    return M.stratified_quota(tasks(spark, base), "subject", QUOTAS, 42, "id").select("id", "part")


@plans.add(QUOTA.format(0).replace("40, 60", "1, 900"))
def m7_quota_from_none(spark, base):
    """A subject with too few rows may have none in train."""
    quotas = QUOTAS | {"Life": (1, 900)}
    return M.stratified_quota(tasks(spark, base), "subject", quotas, 42, "id", least=0).select("id", "part")


@plans.add("""WITH s AS (SELECT subject, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS x FROM tasks GROUP BY 1),
    b AS (SELECT *, floor(x) AS base, 100 - sum(floor(x)) OVER () AS rest FROM s),
    k AS (SELECT subject, base + CASE WHEN row_number() OVER (ORDER BY x - base DESC, subject NULLS FIRST) <= rest THEN 1 ELSE 0 END AS take FROM b),
    t AS (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY md5('42:' || id), id) AS r FROM tasks)
    SELECT id FROM t JOIN k ON t.subject IS NOT DISTINCT FROM k.subject WHERE r <= take""")
def m8_proportional(spark, base):
    return M.proportional(tasks(spark, base), "subject", 100, 42, "id").select("id")


@plans.add(T + "SELECT id FROM t WHERE p < 25")
def m9_m10_fixed_count(spark, base):
    return O.shuffled(tasks(spark, base), 42, "id").filter("position < 25").select("id")


@plans.add("SELECT id, CASE WHEN id IN (SELECT DISTINCT task_id FROM tree_results) THEN 'test' ELSE 'train' END AS part FROM tasks")
def m11_fixed_split(spark, base):
    ids = table(spark, base, "tree_results").select(F.col("task_id").alias("id")).distinct().withColumn("listed", F.lit(True))
    t = tasks(spark, base).select("id").join(ids, "id", "left")
    return t.select("id", F.when(F.col("listed"), "test").otherwise("train").alias("part"))


@plans.add(T + "SELECT id, ((o + 1) * 7 - 1) // n AS shard FROM t")
def m12_contiguous(spark, base):
    return M.contiguous_shards(tasks(spark, base), ["id"], 7).select("id", "shard")


@plans.add(T + "SELECT id, o % 7 AS shard FROM t")
def m12_x4_strided(spark, base):
    return M.strided_shards(tasks(spark, base), ["id"], 7).select("id", "shard")


@plans.add(T + "SELECT id FROM t WHERE o >= 2 * (n // 7) AND o < 3 * (n // 7)")
def m13_piece(spark, base):
    return M.piece(tasks(spark, base), ["id"], 7, 2).select("id")


@plans.add(T + "SELECT id, o % 4 AS rank, o // 4 // 8 AS batch FROM t WHERE o < n // 4 // 8 * 8 * 4")
def m14_rank_batches(spark, base):
    return M.rank_batches(tasks(spark, base), ["id"], 4, 8).select("id", "rank", "batch")


@plans.add("""WITH d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p FROM documents WHERE n_chars IS NOT NULL)
    SELECT doc_id, p // 64 * 64 + row_number() OVER (PARTITION BY p // 64 ORDER BY n_chars DESC, doc_id) - 1 AS slot FROM d""")
def m15_length_grouped(spark, base):
    """Documents with a length; :func:`m15_length_grouped_all` has those without text too."""
    d = table(spark, base, "documents").select("doc_id", "n_chars").filter("n_chars IS NOT NULL")
    return M.length_grouped(d, "n_chars", 64, 42, "doc_id").select("doc_id", "slot")


def _lengths(spark, base):
    return table(spark, base, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))


@plans.add("""WITH d AS (SELECT doc_id, coalesce(n_chars, 0) AS n, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p FROM documents)
    SELECT doc_id, p // 64 * 64 + row_number() OVER (PARTITION BY p // 64 ORDER BY n DESC, doc_id) - 1 AS slot FROM d""")
def m15_length_grouped_all(spark, base):
    """The whole table; a document without text has length 0."""
    return M.length_grouped(_lengths(spark, base), "n", 64, 42, "doc_id").select("doc_id", "slot")


@plans.add()
def m16_packed(spark, base):
    """Documents in bins of 8192 characters; sequential, so tests hold its invariants against brute force."""
    return M.pack_sequences(_lengths(spark, base), "doc_id", "n", 8192, 1000, ["doc_id"])


@plans.add("SELECT count(*) AS docs, count(DISTINCT doc_id) AS ids, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS total, 0 AS overfull FROM documents")
def m16_packing_invariants(spark, base):
    """Every document in one bin, and no bin of several items above its capacity."""
    lengths = _lengths(spark, base)
    packed = M.pack_sequences(lengths, "doc_id", "n", 8192, 1000, ["doc_id"])
    ids = packed.agg(F.count("*").alias("docs"), F.countDistinct("doc_id").alias("ids"))
    bins = M.bin_totals(packed, lengths, "doc_id", "n").agg(
        F.sum("total").alias("total"), F.count(F.when((F.col("total") > 8192) & (F.col("items") > 1), 1)).cast("int").alias("overfull")
    )
    return ids.crossJoin(bins)  # one row each


@plans.add(T + "SELECT id, ntile(7) OVER (ORDER BY id) - 1 AS chunk FROM t")
def m18_x3_even_chunks(spark, base):
    return M.even_chunks(tasks(spark, base), ["id"], 7).select("id", "chunk")


@plans.add("""WITH u AS (SELECT task_id, node_id, depth, (CAST('0x' || substr(md5('7:' || task_id || ':' || node_id), 1, 12) AS BIGINT) + 1) / (2.0 ** 48 + 1) AS u
        FROM (SELECT DISTINCT task_id, node_id, max(depth) OVER (PARTITION BY task_id, node_id) AS depth FROM search_nodes))
    SELECT task_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ln(u) / (1 / (depth + 1)) DESC, task_id, node_id) AS r FROM u WHERE depth IS NOT NULL AND depth >= 0) WHERE r <= 3""")
def m21_g11_weighted_top(spark, base):
    """Nodes to reopen: three per task by weight 1 / (depth + 1)."""
    n = table(spark, base, "search_nodes").groupBy("task_id", "node_id").agg(F.max("depth").alias("depth")).filter("depth >= 0")
    return M.weighted_top(n, ["task_id"], 1 / (F.col("depth") + 1), 3, 7, "task_id", "node_id").select("task_id", "node_id")


@plans.add("SELECT id, copy FROM (SELECT id, unnest(range(3)) AS copy FROM tasks)")
def m24_replicate(spark, base):
    return M.replicate(tasks(spark, base).select("id"), 3).select("id", F.col("copy").cast("bigint").alias("copy"))


@plans.add("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 100")
def o1_sorted_top(spark, base):
    o = table(spark, base, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return o.orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@plans.add("SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 8")
def o3_top_per_group(spark, base):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey")
    li = table(spark, base, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 8")
    return li.select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice")


@plans.add("SELECT user_id, list(event_type ORDER BY m) AS types FROM (SELECT user_id, event_type, min(event_id) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def o6_first_seen_distinct(spark, base):
    first = table(spark, base, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("m"))
    items = F.sort_array(F.collect_list(F.struct("m", "event_type")))
    return first.groupBy("user_id").agg(F.transform(items, lambda x: x["event_type"]).alias("types"))


@plans.add("SELECT DISTINCT instruction, action FROM search_nodes")
def o8_distinct_prompts(spark, base):
    return table(spark, base, "search_nodes").select("instruction", "action").distinct()


@plans.add("""WITH f AS (SELECT instruction, min((written_at, task_id, node_id)) AS m FROM search_nodes GROUP BY 1)
    SELECT instruction, row_number() OVER (ORDER BY m) - 1 AS prompt_id FROM f""")
def x1_prompt_ids(spark, base):
    """A dense id for each prompt in the order of its first row."""
    first = table(spark, base, "search_nodes").groupBy("instruction").agg(F.min(F.struct("written_at", "task_id", "node_id")).alias("m"))
    return O.positions(first, ["m"], "prompt_id").select("instruction", "prompt_id")
