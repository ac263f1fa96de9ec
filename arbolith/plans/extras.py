"""Parsing, memories, losses and further rewrites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from arbolith.functions import parsing as P
from arbolith.functions import scalars as S
from arbolith.plans.evaluations import NODES, nodes
from arbolith.operators import sampling
from arbolith.operators import trees as T
from arbolith.plans import trees
from arbolith.plans.registry import Plans
from arbolith.plans.texts import VEC, finals, vector_pairs
from arbolith.plans.trees import FULL
from arbolith.storage import materialize
from arbolith.tables import table

plans = Plans()
NK = ["task_id", "node_id", "written_at", "loaded_at"]


@plans.add()
def f4_payload_answer(spark, base):
    """Answers of payloads; JSON is looked for in Python, so tests hold it."""
    return finals(spark, base).select(*NK, P.payload_answer("final_answer_text").alias("letter"))


K = "(props->>'$.k')"


@plans.add(f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{{"k":' || {K} || '}}' WHEN 1 THEN '{{"last":1}}' WHEN 2 THEN '{{"o":{{"k":' || {K} || '}}}}' WHEN 3 THEN '{{"x":"\\\\alpha"}}' END AS found FROM events""")
def f6_json_object(spark, base):
    """Fenced among broken braces, followed by a bare object, nested, with lost escapes, and none."""
    e, kind = table(spark, base, "events"), F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("so {not json} ```json\n"), "props", F.lit("\n``` done")))
        .when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit('\n``` then {"last": 1} end')))
        .when(kind == 2, F.concat(F.lit('I say "{" and {"o": '), "props", F.lit("} }")))
        .when(kind == 3, F.lit('{"x": "\\alpha"}'))
        .otherwise(F.lit("[1, {]"))
    )
    return e.select("event_id", P.json_object(text).alias("found"))


@plans.add("SELECT task_id, node_id, written_at, loaded_at, CASE WHEN focus_question <> '' THEN '<think>' || chr(10) || focus_question || chr(10) || '</think>' || chr(10) || coalesce(delegate_answer, '') ELSE delegate_answer END AS text FROM search_nodes WHERE action = 'delegate'")
def f16_thinking_block(spark, base):
    n = table(spark, base, "search_nodes").filter("action = 'delegate'")
    return n.select(*NK, P.thinking_block(F.col("focus_question"), F.col("delegate_answer")).alias("text"))


@plans.add(NODES + """SELECT focus_question AS question, list(chosen_model ORDER BY m) AS models FROM (SELECT focus_question, chosen_model, min((written_at, node_id)) AS m FROM n
    WHERE action = 'delegate' AND delegate_parse_ok AND chosen_model IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def a7_correct_models(spark, base):
    """Distinct models whose answer to each question could be read, the first first."""
    n = nodes(spark, base, "action", "delegate_parse_ok", "chosen_model", "focus_question").filter("action = 'delegate' AND delegate_parse_ok AND chosen_model IS NOT NULL")
    first = n.groupBy(F.col("focus_question").alias("question"), "chosen_model").agg(F.min(F.struct("written_at", "node_id")).alias("m"))
    items = F.sort_array(F.collect_list(F.struct("m", "chosen_model")))
    return first.groupBy("question").agg(F.transform(items, lambda x: x["chosen_model"]).alias("models"))


@plans.add("""SELECT id, [{'key': '', 'content': 'start '}, {'key': 'Thought:', 'content': ' ' || source || ' '}, {'key': 'Action:', 'content': ' ' || split}] AS parts FROM tasks""")
def n13_delimited(spark, base):
    text = F.concat(F.lit("start Thought: "), "source", F.lit(" Action: "), "split")
    return table(spark, base, "tasks").select("id", P.delimited(text, ["Thought:", "Action:"]).alias("parts"))


@plans.add("""SELECT id, list_transform(options, lambda o: {'role': 'tool_call', 'content': o}) AS messages FROM tasks""")
def n17_tool_calls(spark, base):
    """A JSON array of answers as one tool call each."""
    answers = F.from_json(F.to_json("options"), "array<string>")
    calls = F.transform(answers, lambda o: F.struct(F.lit("tool_call").alias("role"), o.alias("content")))
    return table(spark, base, "tasks").select("id", calls.alias("messages"))


@plans.add("SELECT id, 'Action: ' || source || chr(10) || 'Action Input: ' || split AS text FROM tasks")
def n18_react_rows(spark, base):
    return table(spark, base, "tasks").select("id", F.format_string("Action: %s\nAction Input: %s", "source", "split").alias("text"))


@plans.add("SELECT row_id, array_to_string(list_transform(messages[1:2], lambda m: m.role || ': ' || coalesce(m.content, '')), chr(10)) AS system FROM training_rows WHERE messages IS NOT NULL")
def n25_folded(spark, base):
    """The first turns of a transcript as one text."""
    r = table(spark, base, "training_rows").filter("messages IS NOT NULL")
    return r.select("row_id", F.array_join(F.transform(F.slice("messages", 1, 2), lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n").alias("system"))


@plans.add("SELECT row_id, {'messages': answer, 'channel': channel} AS chosen, {'messages': upper(answer), 'channel': channel} AS rejected FROM training_rows")
def n30_regrouped(spark, base):
    """Flat columns by side; the rejected side inherits what it lacks."""
    r = table(spark, base, "training_rows").select("row_id", F.col("answer").alias("messages"), "channel", F.upper("answer").alias("rejected_messages"), F.lit(None).cast("string").alias("rejected_channel"))
    chosen = F.struct("messages", "channel")
    rejected = F.struct(F.coalesce("rejected_messages", "messages").alias("messages"), F.coalesce("rejected_channel", "channel").alias("channel"))
    return r.select("row_id", chosen.alias("chosen"), rejected.alias("rejected"))


@plans.add("""SELECT id, [{'content': 'start ', 'weight': 1.0}, {'content': 'Action:', 'weight': 2.0}, {'content': ' ' || source || ' ', 'weight': 2.0}, {'content': 'Observation:', 'weight': 2.0}, {'content': ' ' || split, 'weight': 0.0}] AS spans FROM tasks""")
def q10_span_weights(spark, base):
    text = F.concat(F.lit("start Action: "), "source", F.lit(" Observation: "), "split")
    return table(spark, base, "tasks").select("id", P.span_weights(text, {"Action:": (2, 2), "Observation:": (2, 0)}).alias("spans"))


@plans.add("""WITH w AS (SELECT id, source, string_split(split || ' ' || id, ' ') AS w FROM tasks)
    SELECT source, flatten(list(w ORDER BY id)) AS tokens, flatten(list(range(len(w)) ORDER BY id)) AS positions FROM w GROUP BY 1""")
def q19_flat_pack(spark, base):
    """Rows of a pack in one array, positions starting anew with each."""
    w = F.split(F.concat_ws(" ", "split", "id"), " ")
    t = table(spark, base, "tasks").select("id", "source", w.alias("w"))
    items = F.sort_array(F.collect_list(F.struct("id", "w")))
    per = t.groupBy("source").agg(items.alias("x"))
    return per.select("source", F.flatten(F.transform("x", lambda r: r["w"])).alias("tokens"), F.flatten(F.transform("x", lambda r: F.transform(r["w"], lambda _, i: i.cast("bigint")))).alias("positions"))


@plans.add(NODES + """, d AS (SELECT task_id, node_id, written_at, coalesce(delegate_parse_ok, false) AS ok, CASE WHEN isnan(delegate_confidence) THEN -1 ELSE coalesce(delegate_confidence, -1) END AS c, chosen_model FROM n WHERE action = 'delegate'),
    rk AS (SELECT *, row_number() OVER (PARTITION BY task_id, ok ORDER BY written_at DESC, node_id DESC) AS k, bool_or(ok) OVER (PARTITION BY task_id) AS any_ok FROM d)
    SELECT task_id, list(node_id ORDER BY written_at, node_id) FILTER ((ok AND k <= 4) OR (NOT any_ok AND k <= 2)) AS attempts,
    CASE WHEN max(c) > -1 THEN arg_max(node_id, (c, written_at, node_id)) ELSE arg_max(node_id, (written_at, node_id)) END AS best, count(DISTINCT chosen_model) AS models FROM rk GROUP BY 1""")
def w21_memory(spark, base):
    """The last four readable attempts of a task, else its last two; its best one; its models."""
    n = nodes(spark, base, "action", "delegate_parse_ok", "delegate_confidence", "chosen_model").filter("action = 'delegate'")
    c = F.coalesce(F.nanvl("delegate_confidence", F.lit(-1.0)), F.lit(-1.0))
    ok = F.coalesce(F.col("delegate_parse_ok"), F.lit(False))
    w = Window.partitionBy("task_id", "ok").orderBy(F.col("written_at").desc(), F.col("node_id").desc())
    d = n.select("task_id", "node_id", "written_at", ok.alias("ok"), c.alias("c"), "chosen_model").withColumn("k", F.row_number().over(w))
    some = F.max("ok")
    kept = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.struct("written_at", "node_id"))))
    per = d.groupBy("task_id").agg(
        some.alias("some"),
        kept(F.col("ok") & (F.col("k") <= 4)).alias("good"),
        kept(~F.col("ok") & (F.col("k") <= 2)).alias("other"),
        F.max_by("node_id", F.struct("c", "written_at", "node_id")).alias("best"),
        F.countDistinct("chosen_model").alias("models"),
    )
    return per.select("task_id", F.transform(F.when(F.col("some"), F.col("good")).otherwise(F.col("other")), lambda x: x["node_id"]).alias("attempts"), "best", "models")


@plans.add("SELECT id, CASE WHEN split = 'test' AND subject IS NOT NULL THEN 1.0 ELSE 0.0 END AS reward FROM tasks")
def r8_tool_reward(spark, base):
    """Calls with the keys in another order; they are right for test items, and named right where there is a subject."""
    t = table(spark, base, "tasks").withColumn("want", F.to_json(F.struct("source", "split")))
    given = F.to_json(F.struct(F.lit("test").alias("split"), F.col("source")))
    name = F.when(F.col("subject").isNull(), "g").otherwise(" f ")
    return t.select("id", P.tool_reward(name, given, F.lit("f"), "want").alias("reward"))


@plans.add()
def e3_overlap(spark, base):
    """ROUGE and BLEU of delegates' answers against their evidence."""
    n = nodes(spark, base, "action", "delegate_answer", "delegate_evidence").filter("action = 'delegate'")
    return n.select("task_id", "node_id", P.overlap_metrics("delegate_answer", "delegate_evidence").alias("m")).select("task_id", "node_id", "m.*")


@plans.add(VEC + """, m AS (SELECT a.vec_id AS q, a.vec_id = b.vec_id AS own, list_cosine_similarity(a.a, b.b) / 0.1 AS s FROM p a JOIN p b ON a.vec_id // 16 = b.vec_id // 16)
    SELECT round(avg(l), 4) AS info_nce FROM (SELECT q, ln(sum(exp(s))) - max(s) FILTER (own) AS l FROM m GROUP BY 1)""")
def e7_info_nce(spark, base):
    """Mean in-batch InfoNCE at temperature 0.1."""
    p = vector_pairs(spark, base).withColumn("batch", F.expr("vec_id div 16"))
    docs = p.select("batch", F.col("vec_id").alias("d"), F.col("b").alias("v"))
    s = p.join(docs, "batch").select(F.col("vec_id").alias("q"), (F.col("vec_id") == F.col("d")).alias("own"), (S.cosine("a", "v") / 0.1).alias("s"))
    per = s.groupBy("q").agg((F.ln(F.sum(F.exp("s"))) - F.max(F.when(F.col("own"), F.col("s")))).alias("l"))
    return per.agg(F.round(F.avg("l"), 4).alias("info_nce"))


@plans.add(NODES + """, u AS (SELECT task_id, boxed_letter, count(*) AS c FROM n WHERE action = 'submit' AND boxed_letter <> '' GROUP BY 1, 2) SELECT task_id, CAST(count(*) AS BIGINT) AS letters, CAST(sum(c) AS BIGINT) AS votes FROM u GROUP BY 1""")
def a9_vote_spread(spark, base):
    n = nodes(spark, base, "action", "boxed_letter").filter("action = 'submit' AND boxed_letter <> ''")
    per = n.groupBy("task_id", "boxed_letter").agg(F.count("*").alias("c"))
    return per.groupBy("task_id").agg(F.count("*").alias("letters"), F.sum("c").alias("votes"))


@plans.add("SELECT c_nationkey, CAST(ceil(3 * greatest(count(*) // 8, 1)) AS BIGINT) AS steps FROM customer GROUP BY 1")
def x9_steps(spark, base):
    """Steps of three epochs in batches of eight."""
    n = F.greatest(F.expr("count(*) div 8"), F.lit(1))
    return table(spark, base, "customer").groupBy("c_nationkey").agg(F.ceil(3 * n).cast("bigint").alias("steps"))




@plans.add("""WITH t AS (SELECT id, answer, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS p, count(*) OVER () AS n FROM tasks),
    w AS (SELECT id, answer, n, p, unnest(range(1, 8)) AS j FROM t)
    SELECT w.id, list(t.answer ORDER BY j) AS negatives FROM w JOIN t ON t.p = (w.p + j) % w.n WHERE t.answer IS NOT NULL AND t.answer IS DISTINCT FROM w.answer GROUP BY 1""")
def n16_negatives(spark, base):
    return sampling.negatives(table(spark, base, "tasks"), "id", "answer", 7, 42)


@plans.add("SELECT id, 'see ' || source || ' ' AS head, '```python' || chr(10) || split || chr(10) || '```' AS code FROM tasks")
def n26_fence_split(spark, base):
    text = F.concat(F.lit("see "), "source", F.lit(" ```python\n"), "split", F.lit("\n```"))
    head, code = P.fence_split(text)
    return table(spark, base, "tasks").select("id", head.alias("head"), code.alias("code"))


@plans.add("""SELECT event_id, '{"api_token":null,"in":[' || replace(props, ' ', '') || ']}' AS clean FROM events""")
def x10_scrubbed(spark, base):
    text = F.concat(F.lit('{"api_token": "s3cret", "in": ['), "props", F.lit("]}"))
    return table(spark, base, "events").select("event_id", P.scrub_json(text).alias("clean"))


@plans.add(FULL + """, b AS (SELECT task_id, unnest(path[:-2]) AS node_id, CAST(leaf AS INTEGER) AS leaf, CAST(leaf AND coalesce(is_correct, false) AS INTEGER) AS r FROM f WHERE path IS NOT NULL),
    s AS (SELECT task_id, node_id, sum(leaf) AS t, sum(r) AS r FROM b GROUP BY 1, 2)
    SELECT f.task_id, f.node_id, CAST(coalesce(t, 0) AS BIGINT) AS terminals, round(r / nullif(t, 0), 6) AS accuracy FROM f LEFT JOIN s USING (task_id, node_id)
    WHERE path IS NOT NULL AND NOT leaf AND NOT coalesce(is_terminal, false) AND action IN ('root', 'delegate') AND coalesce(depth, 0) < 8""")
def g10_expandable(spark, base):
    """Nodes that may grow, with what is below them."""
    t = materialize(trees.nodes(spark, base, *trees.FIELDS), "current")
    below = T.roll_up(t, ["task_id"], "node_id", "parent_id", trees.is_leaf(), F.lit(False), F.coalesce(F.col("is_correct"), F.lit(False)))
    grow = t.filter(T.node_class(8) == "expandable").select("task_id", "node_id")
    return grow.join(below.hint("merge"), ["task_id", "node_id"]).select("task_id", "node_id", "terminals", F.round("accuracy", 6).alias("accuracy"))
