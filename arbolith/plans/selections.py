"""Selections, repairs, draws, tool calls and losses over the domain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbolith.functions import parsing as P
from arbolith.functions import scalars as S
from arbolith.operators import chats as C
from arbolith.operators import evaluation as V
from arbolith.operators import selection as L
from arbolith.operators.sampling import contiguous_shards
from arbolith.plans import trees
from arbolith.plans.evaluations import NODES, nodes
from arbolith.plans.registry import Plans
from arbolith.plans.texts import VEC, vector_pairs
from arbolith.plans.trees import TRAJ
from arbolith.sources import files
from arbolith.storage import scratch
from arbolith.tables import table

plans = Plans()


def tasks(spark, base):
    return table(spark, base, "tasks")


@plans.add("""SELECT id FROM tasks WHERE coalesce(nullif(subject, ''), 'unknown') IN ('physics', 'unknown', 'biology') AND id NOT IN (SELECT task_id FROM tree_results WHERE success AND task_id IS NOT NULL)
    AND id IN (SELECT task_id FROM search_nodes WHERE depth > 1)""")
def row_p18_listed(spark, base):
    """Tasks of some subjects, without those solved, of those with deeper trees."""
    solved = table(spark, base, "tree_results").filter("success").select(F.col("task_id").alias("id"))
    deep = table(spark, base, "search_nodes").filter("depth > 1").select(F.col("task_id").alias("id"))
    return L.listed(tasks(spark, base), "id", "subject", ["physics", "unknown", "biology"], solved, deep).select("id")


@plans.add("SELECT id, trim(question) AS question, trim(answer) AS answer FROM tasks WHERE trim(id) <> '' AND trim(question) <> '' AND trim(answer) <> ''")
def row_p27_without_blanks(spark, base):
    return L.without_blanks(tasks(spark, base), "id", "question", "answer").select("id", "question", "answer")


@plans.add("SELECT id, list_transform(images, lambda p: {'bytes': CAST(NULL AS VARCHAR), 'path': p}) AS images FROM tasks")
def row_p10_media(spark, base):
    plain = F.transform(L.media(F.col("images")), lambda m: F.struct(m["bytes"].cast("string").alias("bytes"), m["path"].alias("path")))
    return tasks(spark, base).select("id", plain.alias("images"))


@plans.add("SELECT id, CAST(json_object('id', id, 'source', source, 'split', split, 'subject', subject) AS VARCHAR) AS key FROM tasks")
def f17_canonical_json(spark, base):
    return tasks(spark, base).select("id", L.canonical_json("subject", "source", "split", "id").alias("key"))


@plans.add("SELECT t.id, s.n, row_number() OVER (ORDER BY md5('42:' || t.id), t.id) - 1 AS position FROM tasks t JOIN (SELECT task_id, count(*) AS n FROM search_nodes GROUP BY 1) s ON s.task_id = t.id")
def j13_in_input_order(spark, base):
    """Counts per task, back in the order of a shuffled input."""
    from arbolith.operators.ordering import shuffled

    done = table(spark, base, "search_nodes").groupBy(F.col("task_id").alias("id")).agg(F.count("*").alias("n"))
    inputs = shuffled(tasks(spark, base).join(done.select("id"), "id", "left_semi").select("id"), 42, "id")
    return L.in_input_order(done, "id", inputs, "position")


PLAIN, LABELLED = "{prompt}\n\nA candidate:\n{answer}\n\nVerify it.", "{prompt}\n\nA candidate:\n{answer}\n\nThe truth:\n{label}\n\nVerify it."


@plans.add("""SELECT id, CASE WHEN coalesce(subject, '') <> '' THEN question || chr(10) || chr(10) || 'A candidate:' || chr(10) || answer || chr(10) || chr(10) || 'The truth:' || chr(10) || subject || chr(10) || chr(10) || 'Verify it.'
    ELSE question || chr(10) || chr(10) || 'A candidate:' || chr(10) || answer || chr(10) || chr(10) || 'Verify it.' END AS prompt FROM tasks WHERE answer IS NOT NULL AND question <> ''""")
def r11_teacher_prompt(spark, base):
    p = L.teacher_prompt(F.col("question"), F.col("answer"), F.col("subject"), PLAIN, LABELLED)
    return tasks(spark, base).select("id", p.alias("prompt")).filter("prompt IS NOT NULL")


@plans.add("SELECT id, '[{''a'': ''' || source || '''},{''b'': 1},{''c'': 2},{''d'': 3}]' AS literal FROM tasks")
def n20_mended_literal(spark, base):
    broken = F.concat(F.lit("[{'a': '"), "source", F.lit("'}{'b': 1}\n{'c': 2}\n  {'d': 3}]"))
    return tasks(spark, base).select("id", L.mended_literal(broken).alias("literal"))


TAG = "<ref-object><bbox>"


@plans.add(f"SELECT id, substr(question, 1, 2) || '{TAG}' || substr(question, 6, 3) || '{TAG}' || substr(question, 12) AS text FROM tasks WHERE length(question) >= 12")
def n27_tagged_spans(spark, base):
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((2, 5), (8, 11))])
    return tasks(spark, base).filter("length(question) >= 12").select("id", L.tagged_spans(F.col("question"), spans).alias("text"))


PICK = "CAST(('0x' || substr(md5('42:' || id), 1, 8)) AS BIGINT)"


@plans.add(f"SELECT id, (['Describe it.', 'What is shown?', 'Say what you see.'])[{PICK} % 3 + 1] AS prompt FROM tasks")
def n28_drawn(spark, base):
    return tasks(spark, base).select("id", L.drawn(["Describe it.", "What is shown?", "Say what you see."], F.col("id")).alias("prompt"))


@plans.add(f"SELECT id, CASE WHEN {PICK} % 5 < 4 THEN 'Find: ' ELSE '请找到：' END || coalesce(subject, '') AS prompt FROM tasks")
def n9_grounding_prompt(spark, base):
    """Four of five prompts in English, the others in Chinese, by the id's md5."""
    head = L.drawn(["Find: "] * 4 + ["请找到："], F.col("id"))
    return tasks(spark, base).select("id", F.concat(head, F.coalesce("subject", F.lit(""))).alias("prompt"))


@plans.add(NODES + "SELECT task_id, node_id, replace(replace(instruction, 'the', 'THE'), 'and', 'THE') AS text FROM n WHERE instruction IS NOT NULL")
def x14_rewritten(spark, base):
    return nodes(spark, base, "instruction").filter("instruction IS NOT NULL").select("task_id", "node_id", L.rewritten(F.col("instruction"), ["the", "and"], "THE").alias("text"))


@plans.add("""WITH t AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS o, count(*) OVER () AS n FROM tasks)
    SELECT id, CAST(((o + 1) * least(n, 7) - 1) // n AS BIGINT) AS shard FROM t""")
def x17_shards(spark, base):
    """Contiguous shards for seven workers, or as many as there are rows."""
    t = tasks(spark, base)
    return contiguous_shards(t, ["id"], max(1, min(7, t.count()))).select("id", F.col("shard").cast("bigint").alias("shard"))


@plans.add("""SELECT id, array_to_string(list_transform(options, lambda o: '<tool_call>' || chr(10) || '{"name":"' || source || '","arguments":{"k":"v"}}' || chr(10) || '</tool_call>'), chr(10)) AS text FROM tasks""")
def q17_hermes_rendered(spark, base):
    call = F.concat(F.lit('{"name":"'), F.col("source"), F.lit('","arguments":{"k":"v"}}'))
    return tasks(spark, base).select("id", L.hermes_calls(F.transform("options", lambda o: call)).alias("text"))


@plans.add("""SELECT id, [{'name': source, 'arguments': '{"k":1}'}, {'name': 'g', 'arguments': NULL}] AS calls FROM tasks""")
def q17_hermes_parsed(spark, base):
    text = F.concat(F.lit('I call <tool_call>\n{"name":"'), "source", F.lit('","arguments":{"k":1}}</tool_call> and <tool_call>{broken</tool_call><tool_call> {"name": "g"} </tool_call>'))
    return tasks(spark, base).select("id", L.hermes_parsed(text).alias("calls"))


@plans.add("SELECT id, 'Action: ' || source || chr(10) || 'Action Input: ' || coalesce(answer, '{}') AS text FROM tasks")
def q17_react_rendered(spark, base):
    return tasks(spark, base).select("id", L.react_calls(F.col("source"), F.col("answer")).alias("text"))


@plans.add(NODES + """, m AS (SELECT task_id, node_id, unnest(list_distinct(model_pool)) AS m FROM n WHERE model_pool IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY task_id, node_id ORDER BY md5('42:' || task_id || node_id || ':' || m), m) - 1 AS k FROM m WHERE m IS NOT NULL),
    p AS (SELECT task_id, node_id, CAST(k % 3 AS INTEGER) AS child, list(m ORDER BY k) AS pool FROM o GROUP BY 1, 2, 3) SELECT * FROM p""")
def g12_partitioned_pools(spark, base):
    """A node's models dealt to three children without overlap."""
    n = nodes(spark, base, "model_pool").filter("model_pool IS NOT NULL")
    pools = L.partitioned_pools(F.filter("model_pool", lambda m: m.isNotNull()), F.concat("task_id", "node_id"), 3)
    return n.select("task_id", "node_id", F.posexplode(pools).alias("child", "pool")).filter(F.size("pool") > 0)


TOLD = "action = 'delegate' AND coalesce(delegate_parse_ok, false) AND delegate_confidence IS NOT NULL AND (trim(coalesce(delegate_answer, '')) <> '' OR trim(coalesce(delegate_evidence, '')) <> '')"


@plans.add(NODES + f"SELECT task_id, node_id FROM n WHERE {TOLD}")
def g16_informative(spark, base):
    n = nodes(spark, base, "action", "delegate_parse_ok", "delegate_confidence", "delegate_answer", "delegate_evidence")
    return n.filter(L.informative()).select("task_id", "node_id")


@plans.add(TRAJ + f""", told AS (SELECT task_id, node_id FROM m WHERE {TOLD}),
    c AS (SELECT * FROM (SELECT tr.*, row_number() OVER (PARTITION BY tr.task_id ORDER BY tr.depth, tr.node_id) AS r FROM tr JOIN f USING (task_id, node_id) WHERE f.is_correct) WHERE r <= 3),
    st AS (SELECT task_id, node_id AS leaf, unnest(node_ids) AS node_id FROM c),
    hit AS (SELECT st.* FROM st JOIN told USING (task_id, node_id)),
    sub AS (SELECT task_id, leaf FROM hit GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT DISTINCT task_id, node_id, 'delegate' AS kind FROM hit UNION ALL SELECT task_id, leaf, 'submit' FROM sub""")
def g15_kept_for_training(spark, base):
    """Informative delegates of the three shortest right paths of a task, and the submits with two of them above."""
    t = trees.tree(spark, base)
    right = t.filter(trees.is_leaf() & F.col("path").isNotNull() & F.col("is_correct")).select("task_id", "node_id", F.col("path").alias("node_ids"), "hops")
    n = nodes(spark, base, "action", "delegate_parse_ok", "delegate_confidence", "delegate_answer", "delegate_evidence")
    return L.kept_for_training(right, n, ["task_id"], "node_id", "node_id", 2, 3, [F.col("hops")])


@plans.add()
def m22_g6_sampled(spark, base):
    """Four children of every parent by a mix of softmax and uniform; draws depend on each other, so tests hold it."""
    n = nodes(spark, base, "parent_id", "is_correct").filter("parent_id <> ''").withColumn("acc", F.coalesce(F.col("is_correct"), F.lit(False)).cast("double"))
    return L.sampled_children(n, ["task_id", "parent_id"], "node_id", "acc", 4, 0.3, 0.5)


SHARE = """WITH sl AS (SELECT s AS slot, CASE WHEN CAST(CAST(('0x' || substr(md5('42:' || s), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296 < 0.75 THEN 0 ELSE 1 END AS source FROM range(0, 40 * (SELECT count(*) + 100 FROM tasks)) r(s)),
    sn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY slot) AS k FROM sl),
    a AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM tasks), b AS (SELECT c_name AS id, row_number() OVER (ORDER BY c_name) AS k FROM customer),
    e AS (SELECT least(min(slot) FILTER (source = 0 AND k > (SELECT count(*) FROM a)), min(slot) FILTER (source = 1 AND k > (SELECT count(*) FROM b))) AS e FROM sn),
    j AS (SELECT slot, source, id FROM sn JOIN a USING (k) WHERE source = 0 UNION ALL SELECT slot, source, id FROM sn JOIN b USING (k) WHERE source = 1)
"""


@plans.add(SHARE + "SELECT slot, source, id FROM j WHERE slot < (SELECT e FROM e)")
def m5_interleaved_by_share(spark, base):
    """Three tasks to a customer, by chance, until one of the tables is used up."""
    frames = [(tasks(spark, base).select("id"), ["id"]), (table(spark, base, "customer").select(F.col("c_name").alias("id")), ["id"])]
    return L.interleave_by_share(frames, [3, 1]).select("slot", "source", "id")


@plans.add(VEC + """, s AS (SELECT CAST(same AS INTEGER) AS y, list_cosine_similarity(a, b) AS c FROM p),
    e AS (SELECT max(CASE WHEN y = 1 THEN 1 - c END) AS pm, avg(CASE WHEN y = 1 THEN 1 - c END) AS pa, count(*) FILTER (y = 1) AS np, min(CASE WHEN y = 0 THEN 1 - c END) AS nm, avg(CASE WHEN y = 0 THEN 1 - c END) AS na, count(*) FILTER (y = 0) AS nn FROM s)
    SELECT round(avg((c - y) ** 2), 5) AS cosine_mse, round(avg(CASE WHEN y = 1 THEN 0.5 * (1 - c) ** 2 ELSE 0.5 * greatest(0, 0.5 - (1 - c)) ** 2 END), 5) AS contrastive,
    round(sum(CASE WHEN y = 1 AND 1 - c > (CASE WHEN nn > 1 THEN nm ELSE pa END) THEN (1 - c) ** 2 WHEN y = 0 AND 1 - c < (CASE WHEN np > 1 THEN pm ELSE na END) THEN greatest(0, 0.5 - (1 - c)) ** 2 ELSE 0 END), 4) AS online
    FROM s, e""")
def e7_pair_losses(spark, base):
    """Cosine, contrastive and online contrastive losses of vector pairs."""
    p = vector_pairs(spark, base).select(F.col("same").cast("int").alias("y"), S.cosine("a", "b").alias("c"))
    out = V.pair_losses(p, "c", "y")
    return out.select(F.round("cosine_mse", 5).alias("cosine_mse"), F.round("contrastive", 5).alias("contrastive"), F.round("online", 4).alias("online"))


@plans.add("""WITH x AS (SELECT user_id, event_id, value / 50 AS s, CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END AS y, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
    l AS (SELECT user_id, g, ln(sum(exp(s))) - max(CASE WHEN y = 1 THEN s END) AS l, count(*) AS n FROM x WHERE g > 0 GROUP BY 1, 2)
    SELECT round((SELECT avg(greatest(s, 0) - s * y + ln(1 + exp(-abs(s)))) FROM x), 6) AS pointwise, round((SELECT avg(l) FROM l WHERE n >= 2), 6) AS listwise""")
def e7_ranking_losses(spark, base):
    """Pointwise and listwise losses; a list starts at each positive of a user."""
    y = F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(0.0)
    e = table(spark, base, "events").select("user_id", "event_id", (F.col("value") / 50).alias("s"), y.alias("y"))
    out = V.ranking_losses(e, ["user_id"], "event_id", "s", "y")
    return out.select(F.round("pointwise", 6).alias("pointwise"), F.round("listwise", 6).alias("listwise"))


@plans.add(NODES + """, k AS (SELECT *, coalesce(is_correct, false) AS ok, coalesce(is_terminal, false) AS te FROM n WHERE parent_id <> ''),
    g AS (SELECT task_id, parent_id, count(*) AS c, round(var_pop(CAST(ok AS INTEGER)), 6) AS spread FROM k GROUP BY 1, 2) SELECT task_id, parent_id, c AS children, spread FROM g WHERE c > 1""")
def g11_variance_weight(spark, base):
    """How much the children of a parent differ in being right."""
    n = nodes(spark, base, "parent_id", "is_correct").filter("parent_id <> ''")
    ok = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    per = n.groupBy("task_id", "parent_id").agg(F.count("*").alias("children"), F.round(F.var_pop(ok), 6).alias("spread"))
    return per.filter("children > 1")



TOOL = """CASE ascii(right(id, 1)) % 3 WHEN 0 THEN '{"name":"' || source || '"}' WHEN 1 THEN '{"type":"function","function":{"name":"' || source || '"}}' ELSE '{"name_for_model":"m","name":"n"}' END"""


@plans.add(f"""WITH t AS (SELECT id, source, {TOOL} AS tool, ascii(right(id, 1)) % 3 AS k FROM tasks)
    SELECT id, CASE WHEN k = 1 THEN tool ELSE '{{"type":"function","function":' || tool || '}}' END AS wrapped, CASE WHEN k = 1 THEN '{{"name":"' || source || '"}}' ELSE tool END AS bare, CASE WHEN k = 2 THEN 'm' ELSE source END AS name FROM t""")
def q16_tools(spark, base):
    t = tasks(spark, base).select("id", F.expr(TOOL).alias("tool"))
    return t.select("id", L.wrapped_tool(F.col("tool")).alias("wrapped"), L.bare_tool(F.col("tool")).alias("bare"), L.tool_name(F.col("tool")).alias("name"))


@plans.add("""WITH x AS (SELECT row_id, list_transform(coalesce(messages, []), lambda m: CAST(coalesce(length(m.content), 0) + 1 AS DOUBLE)) AS v FROM training_rows)
    SELECT row_id, round(list_avg(v), 5) AS mean, round(list_stddev_pop(v), 5) AS std, list_min(v) AS least, list_max(v) AS most, CAST(len(v) AS INTEGER) AS size FROM x""")
def a16_nested_statistics(spark, base):
    """Statistics of a row's messages, each a list of two numbers that are summed first."""
    pairs = F.transform(F.coalesce("messages", F.array()), lambda m: F.array(F.length(m["content"]), F.lit(1)))
    s = table(spark, base, "training_rows").select("row_id", L.array_statistics(L.summed(pairs)).alias("s")).select("row_id", "s.*")
    return s.withColumn("mean", F.round("mean", 5)).withColumn("std", F.round("std", 5))


@plans.add("SELECT row_id, answer, expected_acc_reward, task_id, node_id, parent_id, len(messages) AS n FROM training_rows")
def g17_standard_record(spark, base):
    r = L.record(table(spark, base, "training_rows"), "standard", "row_id")
    return r.withColumn("n", F.when(F.col("messages").isNotNull(), F.size("messages")).cast("bigint")).drop("messages")


@plans.add("""WITH x AS (SELECT event_id, user_id, value, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS y, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY value DESC, event_id) AS r, row_number() OVER (PARTITION BY user_id, g ORDER BY y DESC, event_id) AS i, count(*) OVER (PARTITION BY user_id, g) AS n FROM x WHERE g > 0),
    p AS (SELECT user_id, g, max(CASE WHEN y > 0 THEN 1 / r END) AS rr, sum((2 ** y - 1) / log2(r + 1)) AS dcg, sum((2 ** y - 1) / log2(i + 1)) AS ideal FROM k WHERE n > 1 GROUP BY 1, 2)
    SELECT round(avg(rr), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg FROM p WHERE ideal > 0""")
def e6_running_lists(spark, base):
    """Ranking metrics over lists that start at each positive."""
    y = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    e = table(spark, base, "events").select("user_id", "event_id", "value", y.alias("y"))
    lists = V.running_lists(e, ["user_id"], "event_id", "y", "list")
    out = V.ranking_metrics(lists, ["user_id", "list"], "value", "y", "event_id")
    return out.select(F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@plans.add(trees.FULL + """, b AS (SELECT task_id, unnest(path[:-2]) AS node_id, CAST(coalesce(is_terminal, false) AS INTEGER) AS te, CAST(coalesce(is_terminal AND is_correct, false) AS INTEGER) AS r FROM f WHERE path IS NOT NULL),
    s AS (SELECT task_id, node_id, sum(te) AS t, sum(r) AS r FROM b GROUP BY 1, 2)
    SELECT f.task_id, f.node_id, CAST(coalesce(t, 0) AS BIGINT) AS terminals, round(coalesce(r / nullif(t, 0), 0), 6) AS accuracy FROM f LEFT JOIN s USING (task_id, node_id) WHERE path IS NOT NULL""")
def a8_all_terminals(spark, base):
    """Accuracy over all terminal nodes below, not the submits only; 0 where there are none."""
    from arbolith.operators import trees as T
    from arbolith.storage import materialize

    n = materialize(nodes(spark, base, *trees.FIELDS), "current")
    out = T.roll_up(n, ["task_id"], "node_id", "parent_id", F.col("is_terminal"), F.lit(False), F.col("is_correct"), empty=0.0)
    return out.select("task_id", "node_id", "terminals", F.round("accuracy", 6).alias("accuracy"))


@plans.add("SELECT 'kept' AS part, id, source FROM tasks WHERE split IS DISTINCT FROM 'test' UNION ALL SELECT 'written', id, source FROM tasks WHERE split = 'test'")
def s21_split_sink(spark, base):
    """The test split as JSON lines, read back beside what is kept."""
    path = scratch(spark, "s21")
    kept = files.write_split(tasks(spark, base).select("id", "source", "split"), "split", "test", path, 100)
    back = files.read_jsonl(spark, path, "id string, source string")
    return kept.select(F.lit("kept").alias("part"), "id", "source").unionByName(back.select(F.lit("written").alias("part"), "id", "source"))


@plans.add("SELECT id, split || '/' || source AS sample FROM tasks WHERE split IS NOT NULL AND source IS NOT NULL")
def x15_sample_folders(spark, base):
    """Tasks in folders of their split and source, found again whatever the depth."""
    path = scratch(spark, "x15")
    rows = tasks(spark, base).filter("split IS NOT NULL AND source IS NOT NULL").select("id", "split", "source")
    rows.repartition("split", "source").write.partitionBy("split", "source").json(path)
    found = files.read_samples(spark, path, "id string")
    return found.select("id", F.regexp_replace("sample", r"split=|source=", "").alias("sample"))


@plans.add("""SELECT id, CASE WHEN coalesce(question, '') LIKE '%which%' THEN [{'content': 'a 12 b ' || source, 'weight': 3.0}]
    ELSE [{'content': 'a ', 'weight': 1.0}, {'content': '12', 'weight': 2.0}, {'content': ' ', 'weight': 1.0}, {'content': 'b', 'weight': 0.5}, {'content': ' ' || source, 'weight': 1.0}] END AS spans FROM (SELECT id, question, replace(upper(source), 'B', 'C') AS source FROM tasks)""")
def q10_pattern_weights(spark, base):
    """Spans by patterns with a weight each, or the whole text by a word of the question."""
    text = F.concat(F.lit("a 12 b "), F.replace(F.upper("source"), F.lit("B"), F.lit("C")))
    return tasks(spark, base).select("id", P.pattern_weights(text, {r"\d+": 2.0, r"\bb\b": 0.5}, F.col("question"), {"which": 3.0}).alias("spans"))


@plans.add("""SELECT id, list_filter([{'role': 'user', 'content': source}, {'role': 'assistant', 'content': split || chr(39) || 's'}, {'role': 'user', 'content': question}, {'role': 'assistant', 'content': options[1]}],
    lambda m: m.content IS NOT NULL) AS messages FROM tasks WHERE source IS NOT NULL AND split IS NOT NULL""")
def n2_history_literal(spark, base):
    """A history as a literal, and the first of several responses."""
    t = tasks(spark, base).filter("source IS NOT NULL AND split IS NOT NULL")
    history = P.literal_pairs(F.concat(F.lit("[['"), "source", F.lit("', \""), "split", F.lit("'s\"]]")))
    messages = C.from_query(F.col("question"), F.try_element_at("options", F.lit(1)), None, history)
    return t.select("id", F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
