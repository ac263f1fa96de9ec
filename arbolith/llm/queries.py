"""Queries of the language-model operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.llm.encoding import encoded, token_counts
from arbolith.llm.leaks import cleaned, leaks, longest_runs
from arbolith.llm.packing import containers
from arbolith.llm.pairs import pair_defects
from arbolith.llm.subjects import classify, fit, labelled_sample
from arbolith.llm.topn import top_n
from arbolith.llm.truncation import truncated_values, truncation_rates
from arbolith.storage import small_side
from arbolith.tables import latest, table

NODE = ["task_id", "node_id"]
VERSION = ["written_at", "loaded_at"]
#: Text fields of a node and the column that names the model that wrote them.
WRITTEN_BY = {
    "orchestra_reasoning": "main_model",
    "final_answer_text": "main_model",
    "delegate_evidence": "chosen_model",
}


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """Current nodes' fields that lost their tail."""
    values = truncated_values(table(spark, base, "search_nodes"), NODE, WRITTEN_BY, VERSION)
    return values.filter("truncated").select(*NODE, "field_name")


def p1_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of cut texts by field and the model that wrote them."""
    return truncation_rates(truncated_values(table(spark, base, "search_nodes"), NODE, WRITTEN_BY, VERSION))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """The three best children of every parent among current nodes."""
    rows = table(spark, base, "search_nodes").select(*NODE, "parent_id", "is_correct", "cost", *VERSION)
    rows = latest(rows, NODE, VERSION).filter("parent_id <> ''")
    correct = F.when(F.col("is_correct"), 0).when(~F.col("is_correct"), 1).otherwise(2)
    best = top_n(rows, ["task_id", "parent_id"], 3, correct, F.col("cost"), ["node_id"])
    return best.select("task_id", "parent_id", "node_id")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Defective pairs of the current delegate and submit nodes."""
    tasks = table(spark, base, "tasks").groupBy(F.col("id").alias("task_id")).agg(F.first("question", ignorenulls=True).alias("question"))
    nodes = table(spark, base, "search_nodes").join(small_side(tasks), "task_id", "left")
    delegate, submit = F.col("action") == "delegate", F.col("action") == "submit"
    rows = nodes.select(
        *NODE,
        *VERSION,
        F.coalesce(delegate | submit, F.lit(False)).alias("live"),
        F.when(delegate, F.col("focus_question")).when(submit, F.col("question")).alias("prompt"),
        F.when(delegate, F.col("delegate_answer")).when(submit, F.col("final_answer_text")).alias("answer"),
        "error",
        F.concat_ws(":", "action", F.when(delegate, F.col("chosen_model")).otherwise(F.col("main_model"))).alias("source"),
    )
    return pair_defects(rows, NODE, "prompt", "answer", "error", "source", VERSION, "live")


def _containers(spark: SparkSession, base: str) -> DataFrame:
    capacity = table(spark, base, "container_sizes").agg(F.max("capacity_chars")).first()[0]
    length = F.aggregate(
        F.coalesce(F.col("messages"), F.array()), F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0))
    )
    return containers(table(spark, base, "training_rows"), "row_id", length, int(capacity))


def p5_containers(spark: SparkSession, base: str) -> DataFrame:
    """Every training row with its container, or containers if it is longer than one."""
    return _containers(spark, base)


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """Every document's ids by byte_bpe_50k."""
    return encoded(table(spark, base, "documents"), "doc_id", "text")


def p6_counts(spark: SparkSession, base: str) -> DataFrame:
    """Every document's number of ids."""
    return token_counts(p6_ids(spark, base), "doc_id")


def _test_items(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "tasks").filter("split = 'test'")


def p7_leaks(spark: SparkSession, base: str) -> DataFrame:
    """Documents and the test items they contain, with longest runs and coverage."""
    return leaks(table(spark, base, "documents"), "doc_id", "text", _test_items(spark, base), "id", "question")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents and the test items of which they have twelve consecutive words."""
    return p7_leaks(spark, base).select("doc_id", "item_id")


def p7_items(spark: SparkSession, base: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    return longest_runs(p7_leaks(spark, base), "doc_id")


def p7_cleaned(spark: SparkSession, base: str) -> DataFrame:
    """Documents with leaked spans, without them."""
    return cleaned(table(spark, base, "documents"), "doc_id", "text", _test_items(spark, base), "id", "question")


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Every document with each of its subject areas."""
    names = [r[0] for r in table(spark, base, "subjects").select("subject").distinct().orderBy("subject").collect() if r[0]]
    documents = table(spark, base, "documents")
    model = fit(labelled_sample(documents, table(spark, base, "subject_labels"), names), names)
    return classify(documents, model)


def p8_composition(spark: SparkSession, base: str) -> DataFrame:
    """Documents by subject."""
    return p8_found(spark, base).groupBy("subject").agg(F.count("*").alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


CURRENT = """WITH v AS (
    SELECT *, row_number() OVER (PARTITION BY task_id, node_id ORDER BY written_at DESC, loaded_at DESC) AS rn
    FROM search_nodes),
n AS (SELECT * EXCLUDE (rn) FROM v WHERE rn = 1)
"""


LEAKS = r"""WITH dw AS (
    SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, lower(array_to_string(list_slice(w, p, p + 11), ' ')) AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM dw WHERE len(w) >= 12)),
iw AS (SELECT id AS item_id, regexp_extract_all(question, '[\p{L}\p{Nd}]+') AS w FROM tasks WHERE split = 'test' AND question IS NOT NULL),
i AS (SELECT DISTINCT item_id, lower(array_to_string(list_slice(w, p, p + 11), ' ')) AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM iw WHERE len(w) >= 12))
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have one."""
    return {
        "p2_found": CURRENT
        + """SELECT task_id, parent_id, node_id FROM (
            SELECT task_id, parent_id, node_id, row_number() OVER (
                PARTITION BY task_id, parent_id
                ORDER BY CASE WHEN is_correct THEN 0 WHEN NOT is_correct THEN 1 ELSE 2 END,
                         CASE WHEN isnan(cost) THEN NULL ELSE cost END NULLS LAST, node_id) AS r
            FROM n WHERE parent_id IS NOT NULL AND parent_id <> '') WHERE r <= 3""",
        "p7_found": LEAKS + "SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (gram)",
    }
