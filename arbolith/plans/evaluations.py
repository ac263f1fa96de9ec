"""Accuracy, pools, joins and metrics over nodes, results, tasks, line items and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.functions import scalars as S
from arbolith.operators import evaluation as V
from arbolith.plans.registry import Plans
from arbolith.plans.texts import VEC, vector_pairs
from arbolith.tables import latest, table

plans = Plans()
NODES = """WITH v AS (SELECT *, row_number() OVER (PARTITION BY task_id, node_id ORDER BY written_at DESC, loaded_at DESC) AS rn FROM search_nodes),
n AS (SELECT * EXCLUDE (rn), CASE WHEN isnan(cost) THEN NULL ELSE cost END AS price FROM v WHERE rn = 1),
r AS (SELECT DISTINCT task_id, run_id, stop_reason, majority_boxed_letter, gold_answer_letter, final_leaf_count, open_leaf_count, failed_leaf_count, correct_leaf_count,
      budget_spent, success, majority_correct FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC) AS k FROM tree_results) WHERE k = 1)
"""
EVAL = "WITH ev AS (SELECT l_partkey AS task, l_suppkey AS model, max(l_returnflag = 'R') AS ok FROM lineitem GROUP BY 1, 2) "


def nodes(spark, base, *cols):
    """Current nodes with the named columns, cost without NaN as ``price``."""
    need = dict.fromkeys(["task_id", "node_id", "written_at", "loaded_at", *cols])
    rows = latest(table(spark, base, "search_nodes").select(*need), ["task_id", "node_id"], ["written_at", "loaded_at"])
    return rows.withColumn("price", F.nanvl("cost", F.lit(None).cast("double"))) if "cost" in need else rows


def results(spark, base):
    """The last row of each run."""
    return latest(table(spark, base, "tree_results"), ["run_id"], ["finished_at"])


def evals(spark, base):
    li = table(spark, base, "lineitem").select(F.col("l_partkey").alias("task"), F.col("l_suppkey").alias("model"), "l_returnflag")
    return li.groupBy("task", "model").agg(F.max(F.col("l_returnflag") == "R").alias("ok"))


BY = "SELECT coalesce(nullif({k}, ''), 'unknown') AS key, count(*) AS total, sum(CASE WHEN is_correct THEN 1.0 ELSE 0 END) AS correct, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0 END), 6) AS accuracy FROM n {j} WHERE action = 'submit' GROUP BY 1"


def rounded(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


@plans.add(NODES + BY.format(k="subject", j="LEFT JOIN tasks ON id = task_id"))
def a1_accuracy_by_subject(spark, base):
    t = table(spark, base, "tasks").select(F.col("id").alias("task_id"), "subject")
    df = nodes(spark, base, "action", "is_correct").filter("action = 'submit'").join(t, "task_id", "left")
    return rounded(V.accuracy_by(df, "subject", F.col("is_correct")), "accuracy")


@plans.add(NODES + BY.format(k="CASE WHEN error IS NULL THEN 'clean' ELSE 'warning' END", j=""))
def a2_accuracy_by_warning(spark, base):
    df = nodes(spark, base, "action", "is_correct", "error").filter("action = 'submit'")
    label = F.when(F.col("error").isNull(), "clean").otherwise("warning")
    return rounded(V.accuracy_by(df, label, F.col("is_correct")), "accuracy")


@plans.add(NODES + """SELECT count(*) AS total, count(*) FILTER (f) AS failed, count(*) FILTER (NOT f AND is_correct) AS correct,
    round(avg(CASE WHEN NOT f AND is_correct THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN NOT f THEN CASE WHEN is_correct THEN 1.0 ELSE 0 END END), 6) AS completed_accuracy,
    round(sum(price), 4) AS cost, round(avg(price), 6) AS avg_cost, CAST(sum(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens FROM (SELECT *, status <> 'completed' AS f FROM n)""")
def a3_run_summary(spark, base):
    df = nodes(spark, base, "status", "is_correct", "cost", "input_tokens", "output_tokens")
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    out = V.run_summary(df, F.col("is_correct").cast("double"), F.col("status") != "completed", F.col("price"), tokens)
    return rounded(out.withColumn("cost", F.round("cost", 4)), "accuracy", "completed_accuracy", "avg_cost")


@plans.add(NODES + "SELECT model, count(*) AS n FROM (SELECT unnest(model_pool) AS model FROM n) GROUP BY 1")
def a4_model_usage(spark, base):
    return V.usage_counts(nodes(spark, base, "model_pool"), "model_pool")


@plans.add(NODES + """SELECT count(*) AS runs, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(final_leaf_count), 6) AS avg_leaves,
    round(avg(budget_spent), 6) AS avg_cost, CAST(sum(final_leaf_count) AS BIGINT) AS leaves FROM r""")
def a5_tree_run_summary(spark, base):
    return results(spark, base).agg(
        F.count("*").alias("runs"),
        F.round(F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("double")), 6).alias("success_rate"),
        F.round(F.avg("final_leaf_count"), 6).alias("avg_leaves"),
        F.round(F.avg("budget_spent"), 6).alias("avg_cost"),
        F.sum("final_leaf_count").alias("leaves"),
    )


@plans.add(EVAL + """SELECT task, list_transform(list_sort(list((NOT ok, model))), lambda x: x[2]) AS models,
    list_sort(coalesce(list(model) FILTER (ok), [])) AS correct_models, CAST(count(*) FILTER (ok) AS INTEGER) AS n_correct FROM ev GROUP BY 1""".replace("list((NOT ok, model))", "list(ROW(NOT ok, model))"))
def a6_correct_pools(spark, base):
    return V.correct_pools(evals(spark, base), "task", "model", F.col("ok"))


@plans.add(NODES + """SELECT task_id, majority, votes FROM (SELECT task_id, boxed_letter AS majority, count(*) AS votes,
    row_number() OVER (PARTITION BY task_id ORDER BY count(*) DESC, ascii(boxed_letter)) AS k FROM n WHERE boxed_letter <> '' AND length(boxed_letter) = 1 GROUP BY 1, 2) WHERE k = 1""")
def a9_majority_vote(spark, base):
    df = nodes(spark, base, "boxed_letter").filter("length(boxed_letter) = 1")
    return V.majority(df, ["task_id"], "boxed_letter")


@plans.add(NODES + "SELECT run_id, round(CASE WHEN final_leaf_count > 0 THEN correct_leaf_count / final_leaf_count ELSE 0 END, 6) AS accuracy FROM r")
def a10_leaf_accuracy(spark, base):
    acc = F.coalesce(F.try_divide("correct_leaf_count", "final_leaf_count"), F.lit(0.0))
    return results(spark, base).select("run_id", F.round(acc, 6).alias("accuracy"))


@plans.add(NODES + """, a AS (SELECT least(9, greatest(0, floor(CASE WHEN final_leaf_count > 0 THEN correct_leaf_count / final_leaf_count ELSE 0 END / CAST(0.1 AS DOUBLE)))) AS b FROM r)
    SELECT CAST(x.b AS INTEGER) AS bucket, count(a.b) AS n, round(count(a.b) / (SELECT count(*) FROM a), 6) AS ratio FROM (SELECT unnest(range(10)) AS b) x LEFT JOIN a ON a.b = x.b GROUP BY 1""")
def a11_accuracy_histogram(spark, base):
    acc = F.coalesce(F.try_divide("correct_leaf_count", "final_leaf_count"), F.lit(0.0))
    return rounded(V.histogram(results(spark, base), acc), "ratio")


@plans.add(NODES + """SELECT count(*) FILTER (correct_leaf_count = 0) AS all_wrong, count(*) FILTER (final_leaf_count > 0 AND correct_leaf_count = final_leaf_count) AS all_correct, count(*) AS trees FROM r""")
def a12_extreme_trees(spark, base):
    right, leaves = F.col("correct_leaf_count"), F.col("final_leaf_count")
    return results(spark, base).agg(
        F.count(F.when(right == 0, 1)).alias("all_wrong"),
        F.count(F.when((leaves > 0) & (right == leaves), 1)).alias("all_correct"),
        F.count("*").alias("trees"),
    )


@plans.add("SELECT l_suppkey AS model, count(*) AS calls, CAST(sum(l_quantity * 100) AS BIGINT) AS tokens, round(sum(l_quantity * 100) / 1000 * 0.5, 4) AS cost FROM lineitem GROUP BY 1")
def a19_a20_call_metrics(spark, base):
    tokens = F.sum(F.col("l_quantity") * 100)
    return table(spark, base, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.count("*").alias("calls"), tokens.cast("bigint").alias("tokens"), F.round(tokens / 1000 * 0.5, 4).alias("cost")
    )


@plans.add("SELECT user_id, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def a17_mean(spark, base):
    return table(spark, base, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@plans.add("SELECT count(*) AS ids, round(sum(value), 4) AS total FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)")
def a18_last_per_id(spark, base):
    last = V.last_of(table(spark, base, "events"), ["user_id"], F.struct("ts", "event_id"), "value")
    return last.agg(F.count("*").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@plans.add(NODES + "SELECT status, action, count(*) AS n FROM n GROUP BY 1, 2")
def a25_a27_status_counts(spark, base):
    return nodes(spark, base, "status", "action").groupBy("status", "action").agg(F.count("*").alias("n"))


NORM = r"trim(regexp_replace(replace(lower({}), '<image>', ' '), '\s+', ' ', 'g'))"


@plans.add(NODES + f"SELECT task_id, node_id, id FROM n JOIN tasks ON {NORM.format('focus_question')} = {NORM.format('question')} WHERE action = 'delegate' UNION ALL SELECT t.id, '', u.id FROM tasks t JOIN tasks u ON {NORM.format('t.question')} = {NORM.format('u.question')}")
def j1_join_by_question(spark, base):
    t = table(spark, base, "tasks").select("id", "question")
    n = nodes(spark, base, "action", "focus_question").filter("action = 'delegate'").select("task_id", "node_id", "focus_question")
    own = t.select(F.col("id").alias("task_id"), F.lit("").alias("node_id"), F.col("question").alias("focus_question"))
    return V.join_by_question(n.unionByName(own), "focus_question", t, "question").select("task_id", "node_id", "id")


@plans.add(NODES + f"SELECT {NORM.format('focus_question')} AS key, count(DISTINCT node_id) AS n FROM n GROUP BY 1 HAVING count(DISTINCT node_id) > 1")
def j2_key_conflicts(spark, base):
    """Focus questions, normalised, that stand for several nodes."""
    return V.key_conflicts(nodes(spark, base, "focus_question"), S.normal_question("focus_question"), "node_id")


@plans.add("SELECT task_id, node_id, arg_max(status, (written_at, loaded_at)) AS status FROM search_nodes GROUP BY 1, 2")
def j3_last_call(spark, base):
    return V.last_of(table(spark, base, "search_nodes"), ["task_id", "node_id"], F.struct("written_at", "loaded_at"), "status")


@plans.add(NODES + "SELECT p.task_id, p.node_id, c.node_id AS child_id FROM n p JOIN n c ON c.task_id = p.task_id AND c.parent_id = p.node_id")
def j4_children(spark, base):
    n = nodes(spark, base, "parent_id")
    kids = n.select("task_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"))
    return n.select("task_id", "node_id").join(kids, ["task_id", "node_id"])


@plans.add(NODES + "SELECT id, coalesce(run_id, 'none') AS run_id, coalesce(success, false) AS success FROM tasks LEFT JOIN r ON task_id = id")
def j6_task_results(spark, base):
    r = results(spark, base).select(F.col("task_id").alias("id"), "run_id", "success")
    t = table(spark, base, "tasks").select("id").join(r, "id", "left")
    return t.select("id", F.coalesce("run_id", F.lit("none")).alias("run_id"), F.coalesce("success", F.lit(False)).alias("success"))


@plans.add("SELECT id FROM tasks WHERE NOT EXISTS (SELECT 1 FROM tree_results WHERE task_id = id AND success)")
def j7_o7_excluded(spark, base):
    solved = table(spark, base, "tree_results").filter("success").select(F.col("task_id").alias("id"))
    return table(spark, base, "tasks").select("id").join(solved, "id", "left_anti")


@plans.add("SELECT id FROM tasks WHERE EXISTS (SELECT 1 FROM tree_results WHERE task_id = id AND success)")
def j8_members(spark, base):
    solved = table(spark, base, "tree_results").filter("success").select(F.col("task_id").alias("id"))
    return table(spark, base, "tasks").select("id").join(solved, "id", "left_semi")


@plans.add(NODES + "SELECT task_id, node_id, list_filter(list_distinct(model_pool), lambda x: false) || [x FOR x IN model_pool IF list_contains(['marl-8b', 'corvid-2', 'tern-max'], x)] AS pool FROM n WHERE model_pool IS NOT NULL AND len(model_pool) = len(list_distinct(model_pool))")
def j9_o9_pool_intersection(spark, base):
    n = nodes(spark, base, "model_pool").filter("model_pool IS NOT NULL AND size(model_pool) = size(array_distinct(model_pool))")
    have = F.array(F.lit("marl-8b"), F.lit("corvid-2"), F.lit("tern-max"))
    return n.select("task_id", "node_id", F.array_intersect("model_pool", have).alias("pool"))


@plans.add(VEC + """SELECT a.vec_id AS q, b.vec_id AS d, round(list_dot_product(a.a, b.b), 4) AS s FROM p a JOIN p b ON a.vec_id // 16 = b.vec_id // 16""")
def j12_similarity_in_batch(spark, base):
    p = vector_pairs(spark, base).withColumn("batch", F.expr("vec_id div 16"))
    docs = p.select("batch", F.col("vec_id").alias("d"), F.col("b").alias("v"))
    return p.join(docs, "batch").select(F.col("vec_id").alias("q"), "d", F.round(S.dot("a", "v"), 4).alias("s"))


@plans.add(NODES + "SELECT round(avg(CASE WHEN upper(majority_boxed_letter) = upper(gold_answer_letter) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM r")
def e1_exact_match(spark, base):
    same = F.coalesce(F.upper("majority_boxed_letter") == F.upper("gold_answer_letter"), F.lit(False))
    return results(spark, base).agg(F.round(F.avg(same.cast("double")), 6).alias("accuracy"))


@plans.add("""WITH t AS (SELECT user_id, list(CASE WHEN event_id % 5 = 0 THEN -100 ELSE event_id % 3 END ORDER BY event_id) AS y, list(event_id % 2 ORDER BY event_id) AS p FROM events GROUP BY 1),
    z AS (SELECT user_id, list_filter(list_zip(y[2:], p[:-2]), lambda x: x[1] <> -100) AS z FROM t)
    SELECT CAST(sum(len(z)) AS BIGINT) AS tokens, CAST(sum(len(list_filter(z, lambda x: x[1] = x[2]))) AS BIGINT) AS correct,
    round(sum(len(list_filter(z, lambda x: x[1] = x[2]))) / sum(len(z)), 6) AS accuracy, round(avg(CASE WHEN len(list_filter(z, lambda x: x[1] = x[2])) = len(z) THEN 1.0 ELSE 0 END), 6) AS exact FROM z""")
def e2_token_accuracy(spark, base):
    e = table(spark, base, "events").select("user_id", "event_id")
    y = F.when(F.col("event_id") % 5 == 0, -100).otherwise(F.col("event_id") % 3)
    items = F.sort_array(F.collect_list(F.struct("event_id", y.alias("y"), (F.col("event_id") % 2).alias("p"))))
    rows = e.groupBy("user_id").agg(items.alias("x")).select(F.transform("x", lambda i: i["y"]).alias("y"), F.transform("x", lambda i: i["p"]).alias("p"))
    return rounded(V.token_accuracy(rows, "y", "p"), "accuracy", "exact")


@plans.add(VEC + """, s AS (SELECT CAST(same AS DOUBLE) AS y, list_cosine_similarity(a, b) AS cosine, -list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS l1,
        -list_distance(a, b) AS l2, list_dot_product(a, b) AS dot FROM p),
    u AS (UNPIVOT s ON cosine, l1, l2, dot INTO NAME measure VALUE x),
    k AS (SELECT *, rank() OVER (PARTITION BY measure ORDER BY y) + (count(*) OVER (PARTITION BY measure, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY measure ORDER BY x) + (count(*) OVER (PARTITION BY measure, x) - 1) / 2 AS rx FROM u)
    SELECT measure, round(corr(x, y), 4) AS pearson, round(corr(rx, ry), 4) AS spearman FROM k GROUP BY 1""")
def e4_paired_metrics(spark, base):
    out = V.paired_metrics(vector_pairs(spark, base).withColumn("y", F.col("same").cast("double")), "a", "b", "y")
    return out.select("measure", F.round("pearson", 4).alias("pearson"), F.round("spearman", 4).alias("spearman"))


@plans.add(VEC + """, m AS (SELECT a.vec_id AS q, a.vec_id = b.vec_id AS own, list_cosine_similarity(a.a, b.b) AS s FROM p a JOIN p b ON a.vec_id // 16 = b.vec_id // 16),
    g AS (SELECT q, max(s) FILTER (own) AS pos, avg(s) FILTER (NOT own) AS neg, max(s) FILTER (NOT own) AS hard FROM m GROUP BY 1)
    SELECT round(avg(pos), 5) AS mean_pos, round(avg(neg), 5) AS mean_neg, round(avg(pos - hard), 5) AS margin FROM g""")
def e5_contrast(spark, base):
    p = vector_pairs(spark, base).withColumn("batch", F.expr("vec_id div 16"))
    out = V.contrast(p, ["batch"], "a", "b", "vec_id")
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@plans.add("""WITH x AS (SELECT event_id, user_id, value, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS y FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY user_id ORDER BY y DESC, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM x),
    g AS (SELECT user_id, max(CASE WHEN y > 0 THEN 1 / r END) AS rr, sum((2 ** y - 1) / log2(r + 1)) AS dcg, sum((2 ** y - 1) / log2(i + 1)) AS ideal FROM k WHERE n > 1 GROUP BY 1)
    SELECT round(avg(rr), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg FROM g WHERE ideal > 0""")
def e6_ranking(spark, base):
    y = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return rounded(V.ranking_metrics(table(spark, base, "events").withColumn("y", y), ["user_id"], "value", "y", "event_id"), "mrr", "ndcg")


@plans.add(VEC + """, d AS (SELECT unnest(list_transform(list_zip(a, b), lambda z: greatest(-20, least(20, z[2] - z[1])))) AS d FROM p) SELECT round(avg(-d), 6) AS k1, round(avg(exp(d) - d - 1), 5) AS k3 FROM d""")
def e8_kl(spark, base):
    return V.kl_estimates(vector_pairs(spark, base), "a", "b").select(F.round("k1", 6).alias("k1"), F.round("k3", 5).alias("k3"))


@plans.add("SELECT lang AS channel, round(avg(n_chars), 6) AS mean FROM documents WHERE n_chars <> 0 GROUP BY 1")
def x6_masked_mean(spark, base):
    d = table(spark, base, "documents").filter("n_chars <> 0")
    return d.groupBy(F.col("lang").alias("channel")).agg(F.round(F.avg("n_chars"), 6).alias("mean"))
